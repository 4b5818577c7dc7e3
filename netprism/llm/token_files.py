"""Token-ID output (1): Arrow stream files of equal-length sequences and masks.

Documents are range-partitioned and sorted by id; each task encodes its texts
and writes one Arrow stream file whose record batches hold ``rows`` sequences
as fixed-size lists: ``ids`` (uint16 or uint32 by vocabulary size) and
``mask`` (false only behind the last id of the file).  Sequences run across
documents; a second stream file keeps each document's id and length.  As all
batches but the last have the same number of equal-length sequences, sequence
``i`` is row ``i % rows`` of batch ``i // rows``: a memory-mapped file gives
it as a view, without a copy (``SequenceFile``).

Edge cases: a null text is an empty one (only the end id); null ids come
first; equal rows are all written, next to each other; an empty table gives no
file and no rows; other columns are ignored.  Files are written to the shared
folder under a private name and moved, so a task can be run again.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import binary_column, filesystem, publish
from .subword import encoder


@dataclass(frozen=True)
class TokenFiles:
    """Where the files lie: ``totals[i]`` is the number of ids in file ``i``."""

    base: str
    totals: dict[int, int]
    length: int


def sequence_schema(length: int, dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)),
                      ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


class _SequenceWriter:
    """Collects ids and writes them as batches of ``rows`` sequences."""

    def __init__(self, sink, length: int, rows: int, dtype):
        self.length, self.rows, self.dtype = length, rows, dtype
        self.schema = sequence_schema(length, dtype)
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.rows * self.length:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        full = self.rows * self.length
        at = 0
        while len(flat) - at >= full or last and at < len(flat):
            part = flat[at:at + full]
            sequences = -(-len(part) // self.length)
            ids = np.zeros(sequences * self.length, self.dtype)
            ids[:len(part)] = part
            mask = np.arange(len(ids)) < len(part)
            self.writer.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)],
                schema=self.schema))
            at += len(part)
        self.held, self.n = [flat[at:]], len(flat) - at

    def close(self) -> None:
        self.flush(last=True)
        self.writer.close()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 1024,
                      rows: int = 256, kind: str = "word") -> TokenFiles:
    """Encode ``docs(doc_id, text)`` and write the files; see the module text."""
    spark = docs.sparkSession
    base = scratch_path(spark, "token-files")
    store, folder = filesystem(base)
    store.create_dir(folder, recursive=True)

    def write(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        words = encoder(kind, tokenizer)
        end = np.array([end_id], words.dtype).tobytes()
        store, folder = filesystem(base)
        doc_ids, sizes = [], []

        def sequences(sink):
            out = _SequenceWriter(sink, length, rows, words.dtype)
            b = first
            while b is not None:
                doc_ids.append(b.column(0).cast(pa.int64()))
                texts = binary_column(b, "text")
                for i in range(0, len(texts), 64):
                    ids = [words.encoded(t) + end for t in texts[i:i + 64]]
                    sizes.extend(len(x) // words.dtype.itemsize for x in ids)
                    out.add(np.frombuffer(b"".join(ids), words.dtype))
                b = next((b for b in batches if b.num_rows), None)
            out.close()

        def index(sink):
            with pa.ipc.new_stream(sink, INDEX) as out:
                out.write_table(pa.table([pa.chunked_array(doc_ids), pa.array(sizes, pa.int64())], schema=INDEX))

        publish(store, sequences, f"{folder}/tokens-{number:07d}.arrow")
        publish(store, index, f"{folder}/index-{number:07d}.arrow")
        yield pa.RecordBatch.from_pylist([{"file": number, "n_tokens": sum(sizes)}],
                                         schema=pa.schema([("file", pa.int64()), ("n_tokens", pa.int64())]))

    keys = ["doc_id", F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*keys).sortWithinPartitions(*keys)
    made = ordered.mapInArrow(write, "file long, n_tokens long")
    # one small row per file; the action that writes them
    totals = {r["file"]: r["n_tokens"] for r in made.collect()}
    return TokenFiles(base, totals, length)


class SequenceFile:
    """Random access to the sequences of one file: ``file[i]`` is (ids, mask)."""

    def __init__(self, source):
        with pa.ipc.open_stream(source) as reader:
            self.batches = list(reader)
        self.rows = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int):
        batch, row = self.batches[i // self.rows], i % self.rows
        ids, mask = batch.column(0), batch.column(1)
        n = ids.type.list_size
        return (ids.flatten().slice(row * n, n).to_numpy(zero_copy_only=True), mask.flatten().slice(row * n, n))


def _documents_of(base: str, number: int):
    """(doc_id, ids as a list of arrays) of each document of a file, in order."""
    store, folder = filesystem(base)
    with store.open_input_file(f"{folder}/index-{number:07d}.arrow") as f:
        index = pa.ipc.open_stream(f).read_all()
    with store.open_input_file(f"{folder}/tokens-{number:07d}.arrow") as f:
        batches = iter(pa.ipc.open_stream(f))
        left = np.empty(0, np.uint16)
        for doc_id, n in zip(index["doc_id"].to_pylist(), index["n_tokens"].to_pylist(), strict=True):
            parts = []
            while n:
                if not len(left):
                    b = next(batches)
                    left = b.column(0).flatten().to_numpy()
                    mask = b.column(1).flatten()
                    if mask.true_count < len(mask):
                        left = left[mask.to_numpy(zero_copy_only=False)]
                    continue
                parts.append(left[:n])
                left, n = left[len(parts[-1]):], n - len(parts[-1])
            yield doc_id, parts


def read_documents(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Each document as read back from the files: doc_id, start (ids of all
    documents before it), n_tokens and the crc32 of its ids as uint32."""
    starts, at = {}, 0
    for number in sorted(files.totals):
        starts[number] = at
        at += files.totals[number]
    base = files.base
    numbers = sorted(starts)
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                number = numbers[i]
                at, rows = starts[number], []
                for doc_id, parts in _documents_of(base, number):
                    crc = 0
                    for p in parts:
                        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                    n = sum(map(len, parts))
                    rows.append((doc_id, at, n, crc))
                    at += n
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=out)

    n = max(len(numbers), 1)
    return spark.range(0, len(numbers), 1, n).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")

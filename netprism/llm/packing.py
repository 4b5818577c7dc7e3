"""Packing (7): cost-balanced sequences.

A document's ids (with its end id) are cut into pieces of at most ``length``;
full pieces are sequences of their own.  The rest pieces of up to ``block``
documents are packed together: ``ceil(ids / length)`` sequences are opened and
the pieces, in descending order of their estimated attention cost
``linear * n + quadratic * n * n``, go one by one to the sequence of lowest
cost so far that still has room.  A piece for which no sequence has room is
cut: it fills the cheapest sequence with any room and goes on with what is
left.  So only the last ids of a block can leave padding (less than one
sequence per block), and attention cost is spread evenly over the sequences.

Everything happens while the table is scanned: no shuffle; a task holds the
rest pieces of one block at most.  Sequence ids are unique over all tasks
(``task << 33 | counter``) and a task that is run again gives the same ones.

Edge cases: a null or empty text is only its end id; repeated rows and null
ids are packed like any others; ties go by order of arrival; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binary_column
from .subword import encoder


def attention_cost(n, linear: float = 1.0, quadratic: float = 1.0 / 512):
    """Estimated cost of a piece: work per id, and per pair of ids within it."""
    return linear * n + quadratic * n * n


def balance(lengths, length: int, cost=attention_cost) -> list[tuple[int, int, int, int, int]]:
    """(piece, begin within it, n, sequence, offset in the sequence) for pieces
    shorter than ``length``; sequences are numbered from 0."""
    lengths = np.asarray(lengths, np.int64)
    count = -(-int(lengths.sum()) // length)
    room = np.full(count, length, np.int64)
    load = np.zeros(count)
    out = []
    for i in np.argsort(-lengths, kind="stable"):
        begin, n = 0, int(lengths[i])
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            s = int(np.argmin(np.where(fits, load, np.inf)))
            m = min(n, int(room[s]))
            out.append((int(i), begin, m, s, length - int(room[s])))
            room[s] -= m
            load[s] += cost(m)
            begin, n = begin + m, n - m
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, block: int = 2048,
         kind: str = "byte", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset; ``with_ids`` adds the piece's ids."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        from pyspark import TaskContext

        words = encoder(kind, tokenizer)
        end = np.array([end_id], words.dtype).tobytes()
        next_id = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        rest: list[tuple] = []  # (doc_id, start, ids, doc_tokens)

        def piece(doc_id, start, ids, doc_tokens, sequence, offset):
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, sequence, offset,
                         *([ids.astype(np.int32)] * with_ids)))

        def settle():
            nonlocal next_id
            placed = balance([len(x[2]) for x in rest], length)
            for i, begin, n, sequence, offset in placed:
                doc_id, start, ids, total = rest[i]
                piece(doc_id, start + begin, ids[begin:begin + n], total, next_id + sequence, offset)
            next_id += 1 + max((p[3] for p in placed), default=-1)
            rest.clear()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), binary_column(b, "text"), strict=True):
                ids = np.frombuffer(words.encoded(text) + end, words.dtype)
                full = len(ids) // length * length
                for start in range(0, full, length):
                    piece(doc_id, start, ids[start:start + length], len(ids), next_id, 0)
                    next_id += 1
                if full < len(ids):
                    rest.append((doc_id, full, ids[full:].copy(), len(ids)))
                if len(rest) >= block:
                    settle()
                if len(rows) >= (500 if with_ids else 8192):
                    yield flush()
        settle()
        if rows:
            yield flush()

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, kinds + ", ids array<int>" * with_ids)

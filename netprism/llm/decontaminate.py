"""Benchmark decontamination (3): Wu-Manber search for test passages.

Patterns are the windows of ``window`` consecutive words of each benchmark
text (a shorter text is one window).  Windows of one length m make a group
with the tables of the Wu-Manber method, over words instead of letters:

* shift table: for each block of two words (by hash) the distance from its
  last place in any pattern to the pattern's end, m - 1 if it is in none.
  The search looks at the block that ends at a position and jumps by its
  shift, so most positions are never looked at;
* suffix-hash buckets: where the shift is 0, the block is the end of some
  patterns; its bucket lists them;
* direct comparison: the words of the position are compared byte by byte with
  each listed pattern.

Documents of an Arrow batch are searched side by side: texts are cut into
lanes of ``LANE`` end positions and every step moves all lanes by their
shifts.  Pattern tables are broadcast in blocks of ``block_bytes`` of
benchmark text (each document batch meets all blocks, one at a time), so a
large benchmark costs more blocks, not more memory.

Edge cases: a null text has no words and no hits; an item without words is no
pattern; a null item id counts as an item of its own and prints as empty;
items with equal texts all count; repeated documents are judged one by one;
empty tables give no rows, or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_names, with_kept

#: Bytes that belong to words: 0-9, a-z (A-Z lower-cased before), every byte from 0x80 on.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
#: End positions that one lane searches.
LANE = 256
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of some texts, end to end: ``flat`` has them with one blank
    after each, ``start``/``end`` their places there, ``hash`` a 64-bit hash,
    ``first``/``count`` the range of words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        inside = IN_WORD[low]
        n = len(low)
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < n]
        begin[cuts] = inside[cuts]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        stop[ends] = inside[ends]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.count = np.searchsorted(s, offsets[1:]) - np.searchsorted(s, offsets[:-1])
        self.first = np.cumsum(self.count) - self.count
        size = e - s
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.flat = np.full(int(self.end[-1]) + 1 if len(s) else 0, 32, np.uint8)
        self.flat[np.arange(len(self.flat)) != np.repeat(self.end, size + 1)] = low[inside]
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        """Polynomial hash of each word modulo 2**64: differences of a running sum."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        size = self.end - self.start
        place = np.arange(len(self.flat), dtype=np.int64) - np.repeat(self.start, size + 1)
        powers = np.empty(int(size.max()) + 1, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(np.full(len(powers) - 1, BASE, np.uint64), out=powers[1:])
        terms = (self.flat.astype(np.uint64) + np.uint64(1)) * powers[place]
        terms[self.end] = 0
        h = np.add.reduceat(terms, self.start)
        h ^= h >> np.uint64(31)
        return h * MIX


def block_hash(words: Words, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at word ``at``."""
    h = words.hash[at]
    if size == 2:
        h = (words.hash[at - 1] ^ (h >> np.uint64(29))) * BASE + h
    return h ^ (h >> np.uint64(32))


class Group:
    """Tables of the patterns of ``m`` words."""

    def __init__(self, m: int, patterns: dict[bytes, list[int]]):
        self.m, self.block = m, min(2, m)
        self.items = list(patterns.values())
        text = list(patterns)
        flat = np.frombuffer(b" ".join(text), np.uint8)
        sizes = np.array([len(t) + 1 for t in text])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        offsets[-1] -= 1
        words = Words(flat, offsets)
        bits = max(12, int(len(text) * m * 4).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.block + 1, np.int16)
        for j in range(self.block - 1, m):  # later places have smaller shifts
            at = words.first + j
            np.minimum.at(self.shift, (block_hash(words, at, self.block) & self.mask).astype(np.int64), m - 1 - j)
        self.bucket: dict[int, list[tuple[bytes, int]]] = {}
        for i, h in enumerate((block_hash(words, words.first + m - 1, self.block)).tolist()):
            self.bucket.setdefault(h, []).append((text[i], i))

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence."""
        m, none = self.m, np.empty(0, np.int64)
        long = np.flatnonzero(words.count >= m)
        if not len(long):
            return none, none
        low, high = words.first[long] + m - 1, words.first[long] + words.count[long]
        lanes = -(-(high - low) // LANE)
        nth = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(low, lanes) + nth * LANE
        stop = np.minimum(at + LANE, np.repeat(high, lanes))
        found_at, found = [], []
        flat, start, end = words.flat, words.start, words.end
        while len(at):
            h = block_hash(words, at, self.block)
            step = self.shift[(h & self.mask).astype(np.int64)]
            for i in np.flatnonzero(step == 0).tolist():
                first = int(at[i]) - m + 1
                for text, p in self.bucket.get(int(h[i]), ()):
                    if flat[start[first]:end[first + m - 1]].tobytes() == text:
                        found_at.append(first)
                        found.append(p)
            at = at + np.maximum(step, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        return np.array(found_at, np.int64), np.array(found, np.int64)


def item_words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode("utf-8"), np.uint8)]
    return np.where(IN_WORD[data], data, 32).astype(np.uint8).tobytes().split()


def tables(items: list[tuple[int | None, str | None]], window: int) -> list[Group]:
    """Wu-Manber tables of the windows of ``items``, one group per window length.

    ``Group.items`` are positions in ``items``."""
    groups: dict[int, dict[bytes, list[int]]] = {}
    for k, (_, text) in enumerate(items):
        words = item_words(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            held = groups.setdefault(m, {}).setdefault(b" ".join(words[i:i + m]), [])
            if not held or held[-1] != k:
                held.append(k)
    return [Group(m, patterns) for m, patterns in sorted(groups.items())]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8_000_000,
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurrence),
    n_items, items_sha256, contaminated and spans (word ranges that are hit);
    ``keep`` names columns of ``docs`` to carry along, as ``_keep0`` and so on."""
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // block_bytes) or 1
    named = benchmark.select("item_id", "text")
    blocks = []
    for i in range(n_blocks):
        # about block_bytes of benchmark text, whatever the number of documents
        part = named if n_blocks == 1 else named.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == i)
        rows = [(r[0], r[1]) for r in part.toLocalIterator()]
        blocks.append(spark.sparkContext.broadcast((rows, window)))
    n_keep = len(keep)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                     ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
                     ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        held = {}

        def groups(b):
            if n_blocks > 1:  # one block's tables at a time
                held.clear()
            if b not in held:
                items, w = blocks[b].value
                held[b] = [x[0] for x in items], tables(items, w)
            return held[b]

        for batch in batches:
            for piece in _slices(batch):
                columns = _judge(piece.column(0), piece.column(1), [groups(b) for b in range(n_blocks)]
                                 if n_blocks == 1 else (groups(b) for b in range(n_blocks)))
                arrays = [pa.array(c, f.type) for c, f in zip(columns, out, strict=True)]
                extra = [piece.column(2 + k) for k in range(n_keep)]
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), *arrays[1:], *extra],
                                                 names=[*out.names, *kept_names(keep)])

    rows, kinds = with_kept(docs, keep)
    return rows.mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean,"
        " spans array<array<bigint>>" + kinds)


def _slices(batch, most: int = 4_000_000):
    """Parts of an Arrow batch with about ``most`` bytes of text (one row at least)."""
    sizes = np.array([len(x) if x is not None else 0 for x in batch.column(1).cast(pa.binary()).to_pylist()])
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _judge(ids, texts, blocks):
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    n = len(raw)
    delta = np.zeros(len(words.start) + 1, np.int32)
    items: list[set] = [set() for _ in range(n)]
    for b, (names, groups) in enumerate(blocks):
        for g in groups:
            at, which = g.search(words)
            if not len(at):
                continue
            np.add.at(delta, at, 1)
            np.add.at(delta, at + g.m, -1)
            doc = np.searchsorted(words.first + words.count, at, "right")
            for d, p in zip(doc.tolist(), which.tolist(), strict=True):
                # a null id makes an item of its own for each row
                items[d].update((names[k], None) if names[k] is not None else (None, (b, k)) for k in g.items[p])
    hit = np.cumsum(delta[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[words.first + words.count] - total[words.first]
    sha, spans = [], []
    nothing = hashlib.sha256(b"").hexdigest()
    for d in range(n):
        if not items[d]:
            sha.append(nothing)
            spans.append([])
            continue
        ids_text = ",".join(sorted("" if x[0] is None else str(x[0]) for x in items[d]))
        sha.append(hashlib.sha256(ids_text.encode()).hexdigest())
        own = np.concatenate([[False], hit[words.first[d]:words.first[d] + words.count[d]], [False]])
        edges = np.flatnonzero(own[1:] != own[:-1])
        spans.append(edges.reshape(-1, 2).tolist())
    return [ids, words.count, n_hit, np.array([len(x) for x in items]), sha, n_hit > 0, spans]

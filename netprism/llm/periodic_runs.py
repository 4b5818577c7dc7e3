"""Periodic run detection (11): suffix automaton with link-cut access.

A run is a stretch of words with smallest period q (words q apart are equal)
of at least ``max(least, 2 * q)`` words that no neighbouring word extends.  An
automaton of all suffixes grows word by word; a state stands for stretches
with the same occurrences, and its suffix links form a tree.  After word i the
path from the state of the whole prefix to the root holds all suffixes that
end at i, so every state on it last occurred at i.  The path falls into
segments of one previous last occurrence e each; the longest stretch of a
segment, L words, ends at e and at i.  If d = i - e is at most L the two
occurrences meet or overlap: the last L + d words are a square of smallest
period d, and none longer.  The same (start, d) at the next words extends it;
the last of them is the end of the run.

Segments are the splay trees of a link-cut tree over the suffix links: one
tree holds states of one last occurrence, ``access`` climbs from tree to tree
and joins the part of each that lies on the path into one, so a word costs a
logarithmic number of steps, amortised.

Before that, a text is cut where no run can pass.  Any word of a run stands in
``least // 2`` consecutive words that occur again, q words on, in the same run (or
there are fewer than q + ``least // 2`` words in it); stretches without such words
are left out, again and again until nothing changes.  Hashes decide that, so a
collision only leaves a stretch in.  The automaton gets all the rest, and its
size is bounded by one text.

Edge cases: a null or empty text has no words and no run; words are compared
byte by byte; repeated rows give equal rows; a null id stays null; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column

#: Multiplier of the rolling keys (odd, golden ratio of 64 bits).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def runs_of(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, by start and period."""
    # automaton: longest stretch and transitions of each state; state 0 is the empty stretch
    longest, moves = [0], [{}]
    # link-cut tree: children and parent in the splay tree (or the path parent); last occurrence at its root
    left, right, parent, seen = [-1], [-1], [-1], [-1]
    link = [-1]
    ends: dict[tuple[int, int], int] = {}

    def splay(x: int) -> None:
        """Brings ``x`` to the root of its splay tree."""
        p = parent[x]
        while p >= 0 and (left[p] == x or right[p] == x):
            g = parent[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                y = p if (left[g] == p) == (left[p] == x) else x
                turn(y)
            turn(x)
            p = parent[x]

    def turn(x: int) -> None:
        """Rotates ``x`` above its parent."""
        p = parent[x]
        g = parent[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b >= 0:
            parent[b] = p
        parent[p] = x
        parent[x] = g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
            else:
                seen[x] = seen[p]
        else:
            seen[x] = seen[p]

    last = 0
    for i, word in enumerate(words):
        new = len(longest)
        longest.append(i + 1)
        moves.append({})
        left.append(-1)
        right.append(-1)
        seen.append(i)
        p = last
        while p >= 0 and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if p < 0:
            up = 0
        else:
            q = moves[p][word]
            if longest[q] == longest[p] + 1:
                up = q
            else:
                # a copy of q for its shorter stretches stands right above it, with the same last occurrence
                up = new + 1
                longest.append(longest[p] + 1)
                moves.append(moves[q].copy())
                seen.append(-1)
                splay(q)
                above = left[q]
                left.append(above)
                right.append(-1)
                if above >= 0:
                    parent[above] = up
                left[q] = up
                link.append(up)  # of new
                parent.append(up)
                link.append(link[q])
                parent.append(q)
                link[q] = up
                while p >= 0 and moves[p].get(word) == q:
                    moves[p][word] = up
                    p = link[p]
        if len(link) == new:
            link.append(up)
            parent.append(up)
        # access: one step for each segment on the path to the root
        below, x = new, up
        while x >= 0:
            splay(x)
            e = seen[x]
            size = longest[x]
            d = i - e
            if e >= 0 and d <= size and size + d >= least:
                ends[i - size - d + 1, d] = i
            cut = right[x]
            if cut >= 0:
                seen[cut] = e
            right[x] = below
            below = x
            x = parent[x]
        seen[below] = i
        last = new
    return sorted((start, end - start + 1, d) for (start, d), end in ends.items())


def repeating_stretches(words: list, least: int = 12) -> list[tuple[int, int]]:
    """(start, end) of the stretches outside which no run can lie."""
    n, k = len(words), max(least // 2, 1)
    if n < max(least, 2):
        return []
    keys = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    grams = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        grams = grams * GOLDEN + keys[j:n - k + 1 + j]
    grams ^= grams >> np.uint64(29)
    alive = np.ones(n, bool)
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], alive, [False]]).astype(np.int8)))
        starts, stops = edge[::2], edge[1::2]
        long = stops - starts >= least
        starts, stops = starts[long], stops[long]
        if not len(starts):
            return []
        size = stops - starts - (k - 1)
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        mine = grams[at] + np.repeat(np.arange(len(starts), dtype=np.uint64) * GOLDEN, size)
        order = np.argsort(mine)
        same = mine[order][1:] == mine[order][:-1]
        again = np.zeros(len(mine), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        cover = np.zeros(n + 1, np.int64)
        found = at[again]
        np.add.at(cover, found, 1)
        np.add.at(cover, found + k, -1)
        now = np.cumsum(cover[:-1]) > 0
        if np.array_equal(now, alive):
            return list(zip(starts.tolist(), stops.tolist(), strict=True))
        alive = now


def find_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, by start and period."""
    found = []
    for a, b in repeating_stretches(words, least):
        found += [(a + s, n, q) for s, n, q in runs_of(words[a:b], least)]
    return found


def collapse(words: list, runs) -> list:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    drop = bytearray(len(words))
    for start, length, period in runs:
        drop[start + period:start + length] = b"\x01" * (length - period)
    return [w for w, gone in zip(words, drop, strict=True) if not gone]


def split_words(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words of a text: what stands between ASCII white space."""
    return text.split()


def document_runs(docs: DataFrame, words: Callable[[int | None, bytes], list[bytes]] = split_words,
                  least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and collapsed (the
    words that are kept, joined by a blank) of every row; ``words`` makes the
    list of words from id and UTF-8 text."""
    part = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in batches:
            counts, spans, texts = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), binary_column(b, "text"), strict=True):
                own = words(doc_id, text)
                runs = find_runs(own, least)
                counts.append(len(own))
                spans.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(b" ".join(collapse(own, runs)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(part)),
                 pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, "
                                "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeated_words(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words of a text; in a tenth of the documents, picked by the crc32 of
    the id, the words from a place on repeat a stretch (a null id is empty text)."""
    import zlib

    words = text.split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest
    run (ties: the first, then the smallest period), runs_sha256, collapsed_sha256."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("_best.n"), F.col("_best.p")
    return rows.select("doc_id", "n_runs", F.col("_best.s").alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

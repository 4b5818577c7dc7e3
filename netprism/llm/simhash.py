"""SimHash near-dedup (4): fingerprints and a binary-trie self-join.

Fingerprints: 64 bits from the XXH64 (seed 42) of a text's word shingles.
Equal fingerprints are collapsed first.  A pair within ``errors`` bits agrees
in full on at least one of ``errors + 1`` equal stretches of the 64 bits; so
each fingerprint enters ``errors + 1`` tries, rotated so that this stretch
comes first and costs no errors.  Below it the trie is joined with itself:
node pairs are expanded together bit by bit, the bits in which the two paths
differ are added up, and a pair is dropped as soon as they exceed the budget.
A trie is a sorted array; a node is a range of it.

A trie node with over ``cell`` fingerprints is cut once more by the same
argument: the bits below it fall into ``errors + 1`` stretches, of which a near
pair shares one, so its fingerprints go to that many deeper nodes.  With many
documents every first node is that large, and a fingerprint still costs a fixed
number of rows.  A deeper node that is too large as well (near copies of one
text) is dealt into hashed cells of about ``cell`` fingerprints; every pair of
cells is one small join, so no task holds the group.  Tasks return, instead of
all pairs, links that connect what they found connected; components follow
from ``components``.

Edge cases: null and wordless texts have fingerprint 0 and link like any
other; fewer words than a shingle make one shingle of all; repeated rows and
copies share their class; a null id never names a component unless all ids of
it are null (then the component is null); an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, stored
from .components import connected_components

#: Fingerprints of a trie node that one task joins with itself; more are cut deeper, then dealt in cells.
CELL = 1024
#: Large nodes up to which their list is broadcast (48 bytes each).
BROADCAST_ROWS = 300_000


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray, step: int = 32_768) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[i:i + step]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, ``fp``, the fingerprint as a signed long, and ``text_hash``."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_hashes(t, width, seed)) for t in binary_column(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), b.column(2)],
                names=["doc_id", "fp", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, fp long, text_hash long")


def rotated(fp: np.ndarray, by: int) -> np.ndarray:
    """uint64 values turned left by ``by`` bits."""
    if by % 64 == 0:
        return fp
    return (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


def stretches(errors: int) -> tuple[int, int]:
    """Bits of a trie's first stretch, and of the second one below it."""
    bits = 64 // (errors + 1)
    return bits, (64 - bits) // (errors + 1)


def trie_key(fp: np.ndarray, t: int, s: int, errors: int) -> np.ndarray:
    """``fp`` with stretch ``t`` first and, if ``s`` is not -1, stretch ``s`` of the other bits next."""
    bits, deep = stretches(errors)
    turned = rotated(fp, t * bits)
    if s <= 0:
        return turned
    rest = np.uint64(64 - bits)
    low = turned & ((np.uint64(1) << rest) - np.uint64(1))
    by = np.uint64(s * deep)
    low = ((low << by) | (low >> (rest - by))) & ((np.uint64(1) << rest) - np.uint64(1))
    return (turned >> rest << rest) | low


def trie_pairs(values: np.ndarray, pairs: np.ndarray, depth: int, errors: int, most: int = 400_000):
    """Joins tries over ``values`` (uint64; sorted within each node's range).

    pairs: rows (lo, hi, lo2, hi2) of node pairs whose first ``depth`` bits
    agree; equal ranges mean a self-join.  Yields arrays (i, j) of positions
    within ``errors`` bits, no pair twice.  The frontier is kept below about
    ``most`` node pairs by working off parts of it depth first.
    """
    ones_before: dict[int, np.ndarray] = {}

    def split(lo, hi, bit):
        if bit not in ones_before:
            b = (values >> np.uint64(63 - bit)) & np.uint64(1)
            ones_before[bit] = np.concatenate([[0], np.cumsum(b.astype(np.int64))])
        ones = ones_before[bit]
        return hi - (ones[hi] - ones[lo])  # zeros first

    stack = [(depth, pairs, np.zeros(len(pairs), np.int8))]
    while stack:
        bit, front, spent = stack.pop()
        if len(front) > most:
            half = len(front) // 2
            stack += [(bit, front[:half], spent[:half]), (bit, front[half:], spent[half:])]
            continue
        n1, n2 = front[:, 1] - front[:, 0], front[:, 3] - front[:, 2]
        leaf = (n1 * n2 <= 16) | (bit >= 64)
        if leaf.any():
            f = front[leaf]
            size = n1[leaf] * n2[leaf]
            for a in range(0, len(f), most // 16):
                part, count = f[a:a + most // 16], size[a:a + most // 16]
                nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                wide = np.repeat(part[:, 3] - part[:, 2], count)
                i = np.repeat(part[:, 0], count) + nth // wide
                j = np.repeat(part[:, 2], count) + nth % wide
                near = np.bitwise_count(values[i] ^ values[j]) <= errors
                near &= ~(np.repeat((part[:, 0] == part[:, 2]) & (part[:, 1] == part[:, 3]), count) & (i >= j))
                if near.any():
                    yield i[near], j[near]
        f, used = front[~leaf], spent[~leaf]
        if not len(f):
            continue
        lo, hi, lo2, hi2 = f.T
        mid, mid2 = split(lo, hi, bit), split(lo2, hi2, bit)
        own = (lo == lo2) & (hi == hi2)
        children = [(np.stack([lo, mid, lo2, mid2], 1), used, None), (np.stack([mid, hi, mid2, hi2], 1), used, None),
                    (np.stack([lo, mid, mid2, hi2], 1), used + 1, None),
                    (np.stack([mid, hi, lo2, mid2], 1), used + 1, own)]  # of a self-join the same pair again
        rows, cost = [], []
        for c, u, skip in children:
            ok = (c[:, 0] < c[:, 1]) & (c[:, 2] < c[:, 3]) & (u <= errors)
            if skip is not None:
                ok &= ~skip
            rows.append(c[ok])
            cost.append(u[ok])
        stack.append((bit + 1, np.concatenate(rows), np.concatenate(cost)))


def spanning_links(n: int, found) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, root) of the vertices that ``found`` pairs join, roots left out:
    union of arrays of pairs, by hooking and pointer jumping."""
    parent = np.arange(n)
    for i, j in found:
        while True:
            a, b = parent[i], parent[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    at = np.flatnonzero(parent != np.arange(n))
    return at, parent[at]


def _join_cells(keys: np.ndarray, side: np.ndarray, fps: np.ndarray, errors: int):
    """Links within each group of ``keys`` (columns: trie, its first bits,
    deeper trie or -1, its bits, pair of cells); ``side`` 0 or 1 is the cell of
    a pair, 2 a group joined with itself."""
    bits, deep = stretches(errors)
    turned = fps.copy()
    for t, s in np.unique(keys[:, [0, 2]], axis=0):
        own = (keys[:, 0] == t) & (keys[:, 2] == s)
        turned[own] = trie_key(fps[own], int(t), int(s), errors)
    order = np.lexsort((turned, side, *keys.T[::-1]))
    keys, side, fps, turned = keys[order], side[order], fps[order], turned[order]
    new_group = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
    new_part = new_group | np.concatenate([[True], side[1:] != side[:-1]])
    lo = np.flatnonzero(new_part)
    hi = np.append(lo[1:], len(fps))
    own = side[lo] == 2
    nodes = [np.stack([lo, hi, lo, hi], 1)[own]]
    pair = (~own[:-1]) & (~new_group[lo[1:]]) if len(lo) > 1 else np.zeros(0, bool)
    k = np.flatnonzero(pair)
    nodes.append(np.stack([lo[k], hi[k], lo[k + 1], hi[k + 1]], 1))
    nodes = np.concatenate(nodes)
    cut = keys[nodes[:, 0], 2] >= 0
    found = chain(trie_pairs(turned, nodes[~cut], bits, errors), trie_pairs(turned, nodes[cut], bits + deep, errors))
    at, root = spanning_links(len(fps), found)
    return fps[at], fps[root]


def near_links(distinct: DataFrame, errors: int = 3, cell: int = CELL) -> DataFrame:
    """Links (a, b) between fingerprints of ``distinct(fp)`` within ``errors``
    bits: enough of them to connect all that are connected."""
    tries = errors + 1
    bits, deep = stretches(errors)
    turned = [F.struct(F.lit(t).alias("t"), (F.shiftleft("fp", t * bits).bitwiseOR(
        F.shiftrightunsigned("fp", 64 - t * bits)) if t else F.col("fp")).alias("_r")) for t in range(tries)]
    nodes = distinct.select("fp", F.inline(F.array(*turned))).withColumn("p", F.shiftrightunsigned("_r", 64 - bits))
    # at most tries * 2 ** bits groups, and only those over ``cell`` are kept
    hot = nodes.groupBy("t", "p").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cell)
    below = [F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("_r", 64 - bits - (s + 1) * deep).bitwiseAND(
        F.lit((1 << deep) - 1).cast("long")).alias("q")) for s in range(tries)]
    whole = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("q")))
    nodes = nodes.join(F.broadcast(hot), ["t", "p"], "left").select(
        "t", "p", "fp", F.inline(F.when(F.col("_n").isNull(), whole).otherwise(F.array(*below))))
    node = ["t", "p", "s", "q"]
    large = stored(nodes.where(F.col("s") >= 0).groupBy(*node).agg(F.count(F.lit(1)).alias("_n"))
                   .where(F.col("_n") > cell), "large-nodes")
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    cells = F.coalesce(F.ceil(F.col("_n") / cell), F.lit(1)).cast("int")
    dealt = (nodes.join(large, node, "left")
             .withColumn("_k", cells).withColumn("_c", F.pmod(F.xxhash64("fp"), F.col("_k")).cast("int"))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
             .select(*node, F.least("_c", "_o").alias("x"), F.greatest("_c", "_o").alias("y"),
                     F.when(F.col("_k") == 1, 2).when(F.col("_c") == F.col("_o"), 2)
                     .when(F.col("_c") < F.col("_o"), 0).otherwise(1).cast("int").alias("side"), "fp"))
    group = [*node, "x", "y"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def work(table):
            keys = np.stack([table[c].to_numpy().astype(np.int64) for c in group], 1)
            a, b = _join_cells(keys, table["side"].to_numpy(), table["fp"].to_numpy().astype(np.int64).view(np.uint64),
                               errors)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 100_000:
                table = pa.Table.from_batches(held)
                keys = np.stack([table[c].to_numpy() for c in group], 1)
                cut = int(np.flatnonzero((keys != keys[-1]).any(1)).max(initial=-1)) + 1  # the last group may go on
                if cut:
                    yield work(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows -= cut
        if rows:
            yield work(pa.Table.from_batches(held))

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, errors: int = 3, seed: int = 42, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id that can
    be reached over links), fp, root (a fingerprint that names the component) and
    text_hash of every document."""
    marked = stored(fingerprints(docs, width, seed), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = near_links(classes.select("fp"), errors, cell)
    roots = stored(connected_components(links).withColumnsRenamed({"vertex": "fp"}), "roots")
    # only classes that have links take part
    linked = stored(classes.join(roots, "fp"), "linked")
    least = stored(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = linked.join(least, "root").select("fp", "component_id", "root")
    names = stored(classes.join(named, "fp", "left").select(
        "fp", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("root", "fp").alias("root")), "names")
    # one row per fingerprint meets the documents; a hot fingerprint can be split
    return marked.join(names, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "root", "text_hash")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the first by id (null last),
    fingerprint and hash of the text.

    A row is named by its id and text, so an id with two texts is two documents;
    rows equal in both go but for one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "text_hash")).alias("first")
    keep = found.groupBy("root").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    rows = docs.withColumn("_text_hash", F.xxhash64("text"))
    same = (rows["_text_hash"] == keep["_hash"]) & rows["doc_id"].eqNullSafe(keep["_id"])
    return rows.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")

"""Exact top-k search (5): M-trees, searched best first.

The largest inner product is a nearest-neighbour question: with M at least
the longest vector, v' = (v, sqrt(M**2 - |v|**2)) and q' = (q, 0) give
|q' - v'|**2 = |q|**2 + M**2 - 2 <q, v>, a true metric.  Every ``tree_rows``
vectors of a partition make an M-tree over v': nodes are pages of at most ``page``
entries; an entry of an inner page has a routing vector, a covering radius
and its distance to the parent's routing vector, an entry of a leaf page a
vector and that distance.  A search keeps the pages in a heap by the least
distance they can hold and stops when it exceeds the k-th best so far.
Before a distance is computed, the stored ones bound it:
|d(q, parent) - d(entry, parent)| - radius.  Bounds get a small slack for
rounding; scores themselves are integers, computed exactly.

Queries are written once to the shared folder; every tree reads them in
blocks of ``block`` rows, so neither the query set, nor a partition, nor a group
of equal vectors is held whole anywhere.  Each tree returns its k best per
query, the window over them is cut to k.

Vectors whose scaled squared norm is 2**60 or more could overflow a long on the way;
they stand beside the tree and are scored in Python's integers, and so are all
candidates of such a query.  Only a score that is itself no long has no row.

Edge cases: rows whose vector is null or holds a null or non-finite component take no part;
rows that repeat an id are candidates and queries of their own (a query id has
the k best over all of them, and rows of its own id are not its candidates); a row without an id is a
candidate, after all others on a tie, and no query; empty vectors have score 0;
vectors of different lengths never meet; ties go to the smaller id; fewer
candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import filesystem, stored

PAGE = 48
#: Of bounds, as a part of the longest distance; of vectors whose squares doubles round, more.
SLACK, SLACK_ROUNDED = 1e-9, 1e-6


class Node:
    """A page: ``centres`` (rows), ``to_parent``, and for inner pages ``radii``
    and ``children``; for leaf pages ``ids`` and ``vectors`` (integers)."""

    __slots__ = ("centres", "to_parent", "radii", "children", "ids", "vectors")


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - to) ** 2).sum(axis=-1), 0.0))


class MTree:
    """M-tree over integer ``vectors`` for inner-product search."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, seed: int = 7):
        self.page = page
        self.rng = np.random.default_rng(seed)
        exact = vectors.astype(np.float64)
        square = (exact ** 2).sum(axis=1)
        self.limit = float(square.max())
        points = np.hstack([exact, np.sqrt(self.limit - square)[:, None]])
        # products are exact in doubles up to 2**53
        self.vectors = exact if np.abs(exact).max() ** 2 * exact.shape[1] < 2 ** 52 else vectors
        self.ids = ids
        self.root, self.radius, self.centre = self._load(np.arange(len(ids)), points, None)

    def _load(self, rows, points, parent):
        """Bulk load: (node, covering radius, routing vector) of ``rows``."""
        centre = points[rows[0]] if len(rows) <= 2 else points[rows].mean(axis=0)
        own = _distances(points[rows], centre)
        node = Node()
        if len(rows) <= self.page:
            node.ids, node.vectors = self.ids[rows], self.vectors[rows]
            node.centres, node.to_parent, node.children, node.radii = points[rows], own, None, None
            return node, float(own.max()), centre
        # far-apart seeds among a sample; every row goes to its nearest seed
        sample = self.rng.choice(rows, min(len(rows), 8 * self.page), replace=False)
        seeds = [int(sample[0])]
        far = _distances(points[sample], points[seeds[0]])
        for _ in range(min(self.page, -(-len(rows) // self.page)) - 1):
            k = int(far.argmax())
            if far[k] == 0:
                break
            seeds.append(int(sample[k]))
            far = np.minimum(far, _distances(points[sample], points[sample[k]]))
        if len(seeds) == 1:  # equal vectors: pages of any of them
            parts = np.array_split(rows, min(self.page, -(-len(rows) // self.page)))
        else:
            at = points[seeds]
            near = ((points[rows] ** 2).sum(1)[:, None] - 2 * points[rows] @ at.T + (at ** 2).sum(1)).argmin(axis=1)
            parts = [rows[near == s] for s in range(len(seeds))]
            parts = [p for p in parts if len(p)]
            if len(parts) == 1:
                parts = np.array_split(rows, 2)
        made = [self._load(p, points, centre) for p in parts]
        node.children = [m[0] for m in made]
        node.radii = np.array([m[1] for m in made])
        node.centres = np.stack([m[2] for m in made])
        node.to_parent = _distances(node.centres, centre)
        node.ids = node.vectors = None
        radius = min(float(own.max()), float((node.to_parent + node.radii).max()))
        return node, radius, centre

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of a query vector without id ``own``, best first."""
        q = query.astype(np.float64)
        point = np.append(q, 0.0)
        square = float(q @ q) + self.limit
        exact = self.vectors.dtype == np.float64 and float(q @ q) < 2 ** 52
        slack = (SLACK if exact else SLACK_ROUNDED) * (1.0 + np.sqrt(square))
        # products are exact in doubles up to 2**53; longs hold all that quantised() lets through
        small = self.vectors.dtype == np.float64 and np.sqrt(float(q @ q) * self.limit) < 2 ** 52
        product = q if small else query
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        reach = np.inf  # distance of the k-th best
        first = float(_distances(self.centre, point))
        heap = [(max(first - self.radius, 0.0), 0, first, self.root)]
        count = 1
        while heap:
            least, _, to_centre, node = heapq.heappop(heap)
            if least > reach + slack:
                break
            bound = np.abs(to_centre - node.to_parent)
            if node.children is None:
                near = np.flatnonzero(bound <= reach + slack)
                scores = node.vectors[near] @ product if small else node.vectors[near].astype(np.int64) @ product
                if len(best) == k:
                    # equal scores may still win by id
                    wins = scores >= best[0][0]
                    near, scores = near[wins], scores[wins]
                for i, s in zip(near.tolist(), scores.tolist(), strict=True):
                    vec_id = int(node.ids[i])
                    if vec_id == own:
                        continue
                    entry = (int(s), -vec_id)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    reach = np.sqrt(max(square - 2.0 * best[0][0], 0.0))
            else:
                near = np.flatnonzero(bound - node.radii <= reach + slack)
                to = _distances(node.centres[near], point)
                for i, d in zip(near.tolist(), to.tolist(), strict=True):
                    floor = max(least, d - node.radii[i])
                    if floor <= reach + slack:
                        heapq.heappush(heap, (floor, count, d, node.children[i]))
                        count += 1
        return [(s, -i) for s, i in sorted(best, reverse=True)]


#: Id of rows that have none (the largest, so they come last on a tie).
NO_ID = 2 ** 63 - 1
LONG = 2 ** 63


def quantised(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (the integer vector) and raw (the scaled vector, of those too long for ``v``) of every row
    that takes part."""
    x = F.transform("embedding", lambda e: e.cast("double") * scale)
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf))
    # a score is at most the product of two norms
    norm = F.aggregate(x, F.lit(0.0), lambda t, e: t + F.pow(F.abs(e) + 1, 2.0))
    rows = table.where(F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)))
    small = norm < float(2 ** 60)
    return rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"),
                       F.when(small, F.transform(x, lambda e: F.floor(e))).alias("v"),
                       F.when(~small, x).alias("raw"), F.col("vec_id").isNotNull().alias("named"))


class Vectors:
    """Vectors of one length: a tree of the short ones, the long ones as Python integers."""

    def __init__(self, ids, vectors, big_ids, big, page):
        self.tree = MTree(ids, vectors, page) if len(ids) else None
        self.ids, self.vectors, self.big_ids, self.big = ids, vectors, big_ids, big

    def search(self, query, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) without id ``own``; ``query`` is an integer vector, of Python integers if long."""
        long = query.dtype == object
        found = self.tree.search(query, own, k) if self.tree is not None and not long else []
        rest = [(self.big_ids, self.big)] + ([(self.ids, self.vectors)] if long else [])
        for ids, vectors in rest:
            if len(ids):
                scores = vectors.astype(object) @ query.astype(object)
                found += [(int(s), int(i)) for s, i in zip(scores, ids.tolist(), strict=True) if i != own and -LONG <= s < LONG]
        return sorted(found, key=lambda e: (-e[0], e[1]))[:k]


def top_k(table: DataFrame, k: int = 5, every: int = 50, block: int = 4096, page: int = PAGE,
          tree_rows: int = 250_000) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of every query (rows whose
    id is divisible by ``every``) among all other rows."""
    spark = table.sparkSession
    vectors = stored(quantised(table), "vectors")
    place = scratch_path(spark, "queries")
    vectors.where(F.col("named") & (F.col("vec_id") % every == 0)).write.parquet(place)

    def whole(raw):
        """A long vector as Python integers (its components are scaled already)."""
        return np.array([math.floor(x) for x in raw] or [0], object)

    def forest(held):
        """{components: vectors} of some batches."""
        rows = pa.Table.from_batches(held)
        ids = rows["vec_id"].to_numpy()
        short = rows["v"].is_valid().to_numpy()
        lengths = [pc.fill_null(pc.list_value_length(rows[c]), 0).to_numpy() for c in ("v", "raw")]
        size = np.where(short, *lengths)
        big = {i: whole(rows["raw"][i].as_py()) for i in np.flatnonzero(~short).tolist()}
        flat = rows["v"].combine_chunks()
        flat = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy()
        inside = np.where(short, size, 0)
        at = np.cumsum(inside) - inside
        trees = {}
        for n in np.unique(size).tolist():
            own, long = np.flatnonzero(short & (size == n)), np.flatnonzero(~short & (size == n))
            cells = flat[at[own][:, None] + np.arange(n)] if n else np.zeros((len(own), 1), np.int64)
            trees[n] = Vectors(ids[own], cells, ids[long], np.array([big[i] for i in long.tolist()], object), page)
        return trees

    def answers(trees):
        import pyarrow.dataset as ds

        store, folder = filesystem(place)
        files = ds.dataset(folder, filesystem=store, format="parquet")
        for b in files.to_batches(batch_size=block, batch_readahead=1, fragment_readahead=1):
            found = []
            for query_id, v, raw in zip(b["vec_id"].to_pylist(), b["v"].to_pylist(), b["raw"].to_pylist(), strict=True):
                n = len(raw if v is None else v)
                if n in trees:
                    query = whole(raw) if v is None else np.array(v or [0], np.int64)
                    best = trees[n].search(query, query_id, k)
                    found += [(query_id, vec_id, s) for s, vec_id in best]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)],
                                                 names=["query_id", "vec_id", "score"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= tree_rows:
                yield from answers(forest(held))
                held, rows = [], 0
        if rows:
            yield from answers(forest(held))

    near = vectors.repartition("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score"))

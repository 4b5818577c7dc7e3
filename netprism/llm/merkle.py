"""Merkle dataset manifest (12): pointer-jumping proofs.

A row's leaf is the digest of its fields.  The leaves of a source, by id, make
a tree: every ``arity`` consecutive nodes (the last run may have fewer, even
one) have the digest of their digests above them, up to the source's subroot.
The subroots, by source, make the manifest's tree in the same way.

* Positions come from one exchange by ranges of (source, id, leaf), so a source
  of any size spreads over many tasks.
* The digests of ``LEVELS`` levels are made in one go, from groups of
  ``arity ** LEVELS`` consecutive nodes, by Spark's own sha2.
* Proofs: every node starts with its siblings and a pointer to its parent.
  A self-join along the pointers appends the segment that the parent holds and
  takes over its pointer, so the distance to the ancestor doubles: a tree of height
  h takes log2(h) joins.  Rows that reached the root leave the
  joins; of inner nodes only those stay that a leaf can still point to.  Each
  round is a written table, so a lost executor costs no earlier round.

A segment is the siblings' digests (32 bytes each, from the leaf upwards, left to
right) and one letter a level for the node's place in its run and the run's length.

Edge cases: null fields have a mark of their own, so null and empty differ; a
null source is first, null ids come before others; rows that repeat an id
are ordered by their leaves, equal rows get equal leaves and each its own proof;
a single row is leaf, subroot and root; an empty table gives no rows; columns
that the digest does not name are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, running_totals, stored

#: Levels made in one go (arity ** LEVELS digests of 64 letters in a group).
LEVELS = 5
#: Most subroots to broadcast (about 150 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Most goals of a self-join to broadcast (about 65 bytes for each level of the tree).
BROADCAST_GOALS = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Key of the tree of subroots; trees of sources begin with 0 (null) or 1.
TOP = "top"


def digest(parts: Column) -> Column:
    """sha256 (lower-case hex) of a text."""
    return F.sha2(parts, 256)


def field_text(c: Column) -> Column:
    """A field as written into the leaf: ``-`` for null, else byte count, colon, value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*[field_text(c) for c in fields]))


def height(count: Column, arity: int) -> Column:
    """Levels above ``count`` nodes until one is left."""
    out, h, most = F.when(count <= 1, F.lit(0)), 1, arity
    while most < 2 ** 62:
        out, h, most = out.when(count <= most, F.lit(h)), h + 1, most * arity
    return out.otherwise(F.lit(h)).cast("int")


def _row_above(row: str, arity: int) -> Column:
    """The digests above the array column ``row``."""
    runs = F.ceil(F.size(row) / arity).cast("int")
    return F.transform(F.sequence(F.lit(0), runs - 1),
                       lambda g: digest(F.array_join(F.slice(F.col(row), g * arity + 1, arity), "")))


def _named(row: str, level: int, width: int) -> Column:
    """The digests of one level of a block, ``width`` nodes in a full one, with level and position."""
    return F.transform(row, lambda h, i: F.struct(F.lit(level).alias("level"), (F.col("_block") * width + i).alias("idx"),
                                                  h.alias("hash")))


def grown(rows: DataFrame, arity: int, name: str) -> DataFrame:
    """All nodes (tree, level, idx, hash, top = the tree's height) over
    ``rows`` (tree, idx, hash, top), level 0 being these rows."""
    block = arity ** LEVELS
    level = rows.select("tree", F.lit(0).alias("level"), "idx", "hash", "top")
    made, base = [level], 0
    while True:
        rest = level.where(F.col("top") > base)
        # one small number: how high the highest tree goes on
        if not rest.limit(1).count():
            break
        groups = (rest.groupBy("tree", "top", F.expr(f"idx div {block}").alias("_block"))
                  .agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("_h0")))
        for k in range(LEVELS):
            groups = groups.withColumn(f"_h{k + 1}", F.when(F.col("top") > base + k, _row_above(f"_h{k}", arity))
                                       .otherwise(F.array().cast("array<string>")))
        levels = F.concat(*[_named(f"_h{k}", base + k, block // arity ** k) for k in range(1, LEVELS + 1)])
        new = stored(groups.select("tree", "top", F.explode(levels).alias("n"))
                     .select("tree", "n.level", "n.idx", "n.hash", "top"), name)
        made.append(new)
        base += LEVELS
        level = new.where(F.col("level") == base)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def linked(nodes: DataFrame, arity: int) -> DataFrame:
    """Every node with a pointer to its parent (null at the tree's top) and the
    segment of its siblings: one row goes to each run, not one node to another."""
    run = (nodes.where(F.col("level") < F.col("top"))
           .groupBy("tree", "level", "top", F.expr(f"idx div {arity}").alias("_run"))
           .agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("_nodes")))
    one = run.select("tree", "level", "top", "_run", "_nodes", F.posexplode("_nodes").alias("_at", "_own"))
    others = F.transform(F.filter("_nodes", lambda x: x["idx"] != F.col("_own.idx")), lambda x: x["hash"])
    return one.select("tree", "level", F.col("_own.idx").alias("idx"), F.col("_own.hash").alias("hash"),
                      F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), F.col("_run").alias("up_idx"),
                      F.unhex(F.array_join(others, "")).alias("siblings"),
                      F.char(F.lit(48) + F.size("_nodes") * arity + F.col("_at")).alias("places"))


class Manifest:
    """``leaves`` (the rows of ``docs``' digest fields with tree and idx), ``proofs``
    (tree, idx, siblings, places), ``subroots`` (tree, subroot) and ``root``."""

    def __init__(self, leaves, proofs, subroots, root, arity):
        self.leaves, self.proofs, self.subroots, self.root, self.arity = leaves, proofs, subroots, root, arity


def jumped(nodes: DataFrame) -> DataFrame:
    """(tree, idx, siblings, places) of every level-0 node outside the top tree,
    its segments concatenated up to the root."""
    key, up = ["tree", "level", "idx"], ["up_tree", "up_level", "up_idx"]
    is_leaf = (F.col("level") == 0) & (F.col("tree") != TOP)
    arrived = F.col("up_tree").isNull()
    finished, distance, rows = [], 1, nodes
    while True:
        finished.append(rows.where(is_leaf & arrived))
        open_ = rows.where(is_leaf & ~arrived)
        if not open_.limit(1).count():
            break
        # only nodes that stand ``distance`` or more above a leaf are pointed to
        inner = rows.where((F.col("level") >= distance) | (F.col("tree") == TOP))
        goal = inner.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(u).alias(f"_{u}") for u in up],
                            F.col("siblings").alias("_siblings"), F.col("places").alias("_places"))
        # high above the leaves few goals are left, with many rows pointing to each
        if goal.count() <= BROADCAST_GOALS:
            goal = F.broadcast(goal)
        movers = rows.where(~arrived & (is_leaf | (F.col("level") >= 2 * distance) | (F.col("tree") == TOP)))
        hit = (F.col("up_tree") == F.col("_tree")) & (F.col("up_level") == F.col("_level")) & (F.col("up_idx") == F.col("_idx"))
        moved = movers.join(goal, hit).select(
            *key, *[F.col(f"_{u}").alias(u) for u in up], F.concat("siblings", "_siblings").alias("siblings"),
            F.concat("places", "_places").alias("places"))
        # what stands at the root already stays a goal
        rest = rows.where(arrived & ~is_leaf & ((F.col("level") >= 2 * distance) | (F.col("tree") == TOP)))
        rows = stored(moved.unionByName(rest.select(moved.columns)), "proofs")
        distance *= 2
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select("tree", "idx", "siblings", "places")


def build(rows: DataFrame, arity: int = 3) -> Manifest:
    """The manifest of ``rows``: source, doc_id, leaf and any columns to carry."""
    tree = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    placed = running_totals(rows.withColumn("tree", tree), "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf")],
                            None, "leaves")
    leaves = stored(placed.withColumnRenamed("_before", "idx").withColumn("top", height(F.col("_total"), arity))
                    .drop("_total", "_row"), "placed")
    nodes = grown(leaves.select("tree", "idx", F.col("leaf").alias("hash"), "top"), arity, "nodes")
    subroots = stored(nodes.where(F.col("level") == F.col("top")).select("tree", "level", F.col("hash").alias("subroot")), "subroots")
    ranked = running_totals(subroots.select("tree", "level", "subroot", F.lit(TOP).alias("_all")), "_all", [F.col("tree")],
                            None, "sources")
    ranked = stored(ranked.select("tree", "level", "subroot", F.col("_before").alias("rank"),
                                  height(F.col("_total"), arity).alias("top")), "ranked")
    summit = grown(ranked.select(F.lit(TOP).alias("tree"), F.col("rank").alias("idx"), F.col("subroot").alias("hash"), "top"),
                   arity, "summit")
    # one row
    root = next((r["hash"] for r in summit.where(F.col("level") == F.col("top")).collect()), None)
    # a subroot points to its place in the top tree, which is the same node; the root points nowhere
    bridge = ranked.select("tree", "level", F.lit(0).cast("long").alias("idx"), F.lit(TOP).alias("up_tree"),
                           F.lit(0).alias("up_level"), F.col("rank").alias("up_idx"), F.lit(b"").alias("siblings"),
                           F.lit("").alias("places"))
    crown = (summit.where(F.col("level") == F.col("top"))
             .select("tree", "level", "idx", F.lit(None).cast("string").alias("up_tree"), F.lit(None).cast("int").alias("up_level"),
                     F.lit(None).cast("long").alias("up_idx"), F.lit(b"").alias("siblings"), F.lit("").alias("places")))
    links = linked(nodes, arity).unionByName(linked(summit, arity)).drop("hash")
    proofs = jumped(stored(links.unionByName(bridge).unionByName(crown), "links"))
    return Manifest(leaves, proofs, subroots.drop("level"), root, arity)


def folded(start: Column, siblings: Column, places: Column, arity: int) -> Column:
    """The digest at the end of a proof: ``start`` put into its place among the
    siblings of each level, upwards."""
    text = F.lower(F.hex(siblings))
    codes = F.transform(F.split(places, ""), lambda c: F.ascii(c) - 48)

    def step(state, code):
        at, size = code % arity, (code / arity).cast("int")
        left = F.substr(text, state["used"] + 1, at * 64)
        rest = F.substr(text, state["used"] + 1 + at * 64, (size - at - 1) * 64)
        return F.struct(digest(F.concat(left, state["hash"], rest)).alias("hash"),
                        (state["used"] + (size - 1) * 64).alias("used"))

    return F.when(F.length(places) == 0, start).otherwise(F.aggregate(
        codes, F.struct(start.alias("hash"), F.lit(0).alias("used")), step, lambda s: s["hash"]))


def with_proofs(manifest: Manifest) -> DataFrame:
    """The leaves with subroot, root, siblings and places."""
    few = manifest.subroots
    if few.count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    return (manifest.leaves.join(manifest.proofs, ["tree", "idx"]).join(few, "tree")
            .withColumn("root", F.lit(manifest.root).cast("string")))


def document_manifest(docs: DataFrame, arity: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of
    every row; where 2 divides the crc32 of the id, the line feeds of the text were
    deleted before the proof was checked (a null id counts as empty text)."""
    fields = [F.col(c) for c in FIELDS]
    shown = F.when(id_bucket(F.col("doc_id"), 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", leaf(fields).alias("leaf"), leaf([*fields[:-1], shown]).alias("shown"))
    found = with_proofs(build(rows, arity))
    found = found.withColumn("folded_root", folded(F.col("shown"), F.col("siblings"), F.col("places"), arity))
    return found.select("doc_id", "leaf", "subroot", "root", digest(F.lower(F.hex("siblings"))).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

"""URL filters (2): curated rules, and association rules mined from them.

Curated rules (host, path, verdict) decide the urls they fit.  Those urls are
the labelled ones: each is a basket of tokens (labels of the host by their
place, path segments by theirs, file extension, names of query parameters)
together with its verdict.  Spark's FP-growth mines token combinations that
imply a verdict; rules below the least support or confidence, and rules no
better than a rule with fewer tokens, are pruned.  Tokens that stand in the very
same baskets (the segments of one deep path) are mined as one item: a rule with
two of them is never better than with one, and n of them would make 2**n
combinations.  Such an item is met by any of its tokens.

Other urls are matched by an inverted index: a url keeps its tokens that occur
in some rule, the few different token sets that remain meet the index token by
token, a rule whose tokens were all met matches, and the best match (by
confidence, support, fewer tokens, block before allow) gives the verdict; without
a match it is ``default``.  Everything is DataFrame work inside the JVM.

Edge cases: a url that is null or has no ``://`` has an empty host and path
and gets the default verdict; repeated rows are judged alike; without labelled
urls, or in an empty table, nothing is mined; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (host, path, verdict) of the curated rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Rows up to which a table of token sets or postings is broadcast (each under 1 kB).
BROADCAST_ROWS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as the module text has them."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), _UPPER, _LOWER), F.regexp_extract(text, parts, 2)


def curated(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null.

    ``rules`` is a short list that becomes part of the plan."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                   F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules]
    if not fits:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url (empty without a host)."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    host_tokens = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    pieces = F.filter(F.split(path, "/"), lambda x: x != "")
    path_tokens = F.transform(pieces, lambda x, i: F.concat(
        F.lit("p"), i.cast("string"), F.lit("="), F.regexp_replace(x, r"[0-9]+", "0")))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                        lambda x: F.concat(F.lit("q="), F.substring_index(x, "=", 1)))
    tokens = F.concat(host_tokens, path_tokens, names,
                      F.when(extension != "", F.array(F.concat(F.lit("e="), extension))).otherwise(
                          F.array().cast("array<string>")))
    return F.when(host != "", F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def mine_rules(baskets: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """Pruned rules (rule_id, items, size, verdict, confidence, support, alternatives) from
    ``baskets(items, label)``, label 'allow' or 'block'.  ``alternatives`` has for each item
    the tokens that stand in the same baskets, the item (their smallest) included."""
    from pyspark.ml.fpm import FPGrowth

    verdicts = ["v=allow", "v=block"]
    rows = baskets.select(F.array_append("items", F.concat(F.lit("v="), F.col("label"))).alias("items"))
    # tokens below the support can be in no rule: a count, and lists of at most tokens / support names
    total = rows.count()
    frequent = rows.select(F.explode("items").alias("t")).groupBy("t").count().where(F.col("count") >= min_support * total)
    names = F.lit([r["t"] for r in frequent.toLocalIterator()]).cast("array<string>")
    rows = stored(rows.select(F.array_intersect("items", names).alias("items")).where(F.size("items") > 0)
                  .withColumn("basket", F.monotonically_increasing_id()), "baskets")
    equal = equal_tokens(rows)
    items = F.lit([g[0] for g in equal] + verdicts).cast("array<string>")
    single = stored(rows.select(F.array_intersect("items", items).alias("items")), "single-baskets")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(single)
    rules = (model.associationRules.where(F.array_contains(F.lit(verdicts), F.col("consequent")[0]))
             .select(F.array_sort("antecedent").alias("items"), F.size("antecedent").alias("size"),
                     F.substring(F.col("consequent")[0], 3, 5).alias("verdict"), "confidence", "support")
             .where(~F.arrays_overlap("items", F.lit(verdicts))))
    rules = stored(rules.withColumn("rule_id", F.xxhash64("items", "verdict")), "rules")
    # a rule no better than one with a part of its tokens says nothing more: leave out one token at a time
    parts = rules.select("rule_id", "verdict", "confidence", F.explode(
        F.transform("items", lambda t: F.array_except("items", F.array(t)))).alias("part"))
    less = rules.select(F.col("items").alias("part"), "verdict", F.col("confidence").alias("c"))
    idle = parts.join(less, ["part", "verdict"]).where(F.col("c") >= F.col("confidence")).select("rule_id").distinct()
    kept = rules.join(idle, "rule_id", "left_anti")
    several = [g for g in equal if len(g) > 1]
    heads = F.lit([g[0] for g in several]).cast("array<string>")
    tokens = F.array(*[F.lit(g) for g in several]).cast("array<array<string>>")

    def alternatives(t):
        place = F.array_position(heads, t).cast("int")
        return F.when(place > 0, F.get(tokens, place - 1)).otherwise(F.array(t))

    return stored(kept.withColumn("alternatives", F.transform("items", alternatives)), "pruned-rules")


def equal_tokens(rows: DataFrame) -> list[list[str]]:
    """The tokens of ``rows(basket, items)`` but the verdicts, in sorted lists of those that stand in the
    same baskets: as many baskets, and equal 128 bits of hash over them.  ``items`` holds frequent
    tokens only, so their number is at most the mean tokens of a basket / the least support."""
    marks = rows.select("basket", F.explode("items").alias("t")).where(~F.startswith("t", F.lit("v="))).groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("basket", F.lit(1))).alias("a"),
        F.bit_xor(F.xxhash64("basket", F.lit(2))).alias("b"))
    groups: dict[tuple, list[str]] = {}
    for r in marks.toLocalIterator():
        groups.setdefault((r["n"], r["a"], r["b"]), []).append(r["t"])
    return sorted(sorted(g) for g in groups.values())


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict, items) of the best rule for each token set that some rule fits; ``items``
    are tokens of the set.  ``rules`` may have ``alternatives`` (see ``mine_rules``)."""
    any_of = F.col("alternatives") if "alternatives" in rules.columns else F.transform("items", lambda t: F.array(t))
    postings = (rules.select("rule_id", F.posexplode(any_of).alias("place", "any_of"))
                .select("rule_id", "place", F.explode("any_of").alias("t")))
    if postings.count() <= BROADCAST_ROWS:
        postings = F.broadcast(postings)
    met = (sets.select("tokens", F.explode("tokens").alias("t")).join(postings, "t")
           .groupBy("tokens", "rule_id", "place").agg(F.min("t").alias("t"))
           .groupBy("tokens", "rule_id").agg(F.count(F.lit(1)).alias("met"), F.sort_array(F.collect_list("t")).alias("items")))
    full = met.join(rules.drop("items"), (met["rule_id"] == rules["rule_id"]) & (met["met"] == rules["size"]))
    best = F.max(F.struct("confidence", "support", -F.col("size"), "verdict", "items"))
    return full.groupBy("tokens").agg(best.alias("b")).select("tokens", "b.verdict", "b.items")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow",
               min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """page_id, host, path, rule (curated, or null), verdict and mined (tokens
    of the association rule that decided, or null) of every row."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.select("*", curated(F.col("host"), F.col("path"), rules).alias("fit"),
                       url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    baskets = rows.where(F.col("fit").isNotNull()).select(F.col("tokens").alias("items"),
                                                          F.col("fit.verdict").alias("label"))
    mined = mine_rules(baskets, min_support, min_confidence)
    # the names that occur in rules: at most (mean tokens of a url) / min_support
    known = F.lit(sorted(r["t"] for r in mined.select(F.explode(F.flatten("alternatives")).alias("t")).distinct().toLocalIterator()))
    rows = rows.withColumn("tokens", F.when(F.col("fit").isNull(), F.array_sort(
        F.array_intersect("tokens", known.cast("array<string>")))))
    sets = rows.where(F.size("tokens") > 0).select("tokens").distinct()
    verdicts = stored(match_rules(sets, mined), "verdicts").withColumnsRenamed({"verdict": "method", "items": "mined"})
    if verdicts.count() <= BROADCAST_ROWS:
        verdicts = F.broadcast(verdicts)
    return rows.join(verdicts, "tokens", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "method", F.lit(default)).alias("verdict"), "mined")

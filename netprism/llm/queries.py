"""Queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (attention_lm, decontaminate, merkle, mixing, mtree, packing, periodic_runs, preference, sharding, simhash,
               token_files, toxicity, url_rules)
from .common import id_bucket, read_table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_arrow_token_files(spark: SparkSession, sf: str) -> DataFrame:
    files = token_files.write_token_files(read_table(spark, sf, "documents"), WORD_TOKENIZER)
    return token_files.read_documents(spark, files)


def op2_url_association_rules(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judge_urls(read_table(spark, sf, "pages"))


def op3_wu_manber_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_simhash_trie(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_mtree_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return mtree.top_k(read_table(spark, sf, "embeddings"))


def op6_attention_lm(spark: SparkSession, sf: str) -> DataFrame:
    return attention_lm.score_texts(read_table(spark, sf, "documents"), WORD_TOKENIZER)


def op7_cost_balanced_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read_table(spark, sf, "documents"), BYTE_TOKENIZER)


def op8_toxic_sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    model = toxicity.train(docs, read_table(spark, sf, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted",
                      F.transform("offending", lambda x: x["text"]).alias("offending"))


def op9_weighted_hash_tree(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf, "documents"))


def op10_preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = preference.swapped_replies(read_table(spark, sf, "conversations"))
    return preference.preference_segments(pairs)


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return periodic_runs.run_digests(periodic_runs.document_runs(docs, words=periodic_runs.repeated_words))


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.document_manifest(read_table(spark, sf, "documents"))


def op13_source_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.document_shares(read_table(spark, sf, "documents"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_arrow_token_files, op2_url_association_rules, op3_wu_manber_decontamination, op4_simhash_trie, op5_mtree_top_k,
    op6_attention_lm, op7_cost_balanced_packing, op8_toxic_sentences, op9_weighted_hash_tree, op10_preference_pairs,
    op11_periodic_runs, op12_merkle_manifest, op13_source_mixture, pipeline)}

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

#: crc32 of a text, bit by bit.
_CRC = ("xor(list_reduce([CAST(4294967295 AS BIGINT)] || CAST([ord(x) FOR x IN string_split({}, '')] AS BIGINT[]), "
        "lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)")


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}) END"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + "))"


ORACLE = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE b AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("shown")} AS shown
  FROM (SELECT *, CASE WHEN doc_id IS NULL OR {_CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0
                       THEN replace(text, chr(10), '') ELSE text END AS shown FROM documents)),
l AS (SELECT *, row_number() OVER () AS id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM b),
t AS (SELECT tree, 0 AS level, idx, leaf AS hash FROM l
      UNION ALL
      SELECT tree, level + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx))
      FROM (SELECT *, max(idx) OVER (PARTITION BY tree) AS last FROM t) WHERE last > 0 GROUP BY tree, level, idx // 3),
sub AS (SELECT tree, arg_max(hash, level) AS subroot, max(level) AS height FROM t GROUP BY tree),
s AS (SELECT 0 AS level, tree AS idx, subroot AS hash FROM sub
      UNION ALL
      SELECT level + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx))
      FROM (SELECT *, max(idx) OVER () AS last FROM s) WHERE last > 0 GROUP BY level, idx // 3),
top AS (SELECT arg_max(hash, level) AS root, max(level) AS height FROM s),
runs AS (SELECT tree, level, idx // 3 AS run, list(hash ORDER BY idx) AS h FROM t GROUP BY ALL),
crown AS (SELECT level, idx // 3 AS run, list(hash ORDER BY idx) AS h FROM s GROUP BY ALL),
p AS (SELECT id, tree, 0 AS level, idx AS pos, '' AS sib, shown AS h FROM l
      UNION ALL
      SELECT id, p.tree, p.level + 1, pos // 3,
             concat(sib, array_to_string(r.h[1:pos % 3], ''), array_to_string(r.h[pos % 3 + 2:], '')),
             sha256(concat(array_to_string(r.h[1:pos % 3], ''), p.h, array_to_string(r.h[pos % 3 + 2:], '')))
      FROM p JOIN sub USING (tree) JOIN runs r ON r.tree = p.tree AND r.level = p.level AND r.run = pos // 3
      WHERE p.level < sub.height),
q AS (SELECT id, 0 AS level, tree AS pos, sib, h FROM p JOIN sub USING (tree) WHERE level = height
      UNION ALL
      SELECT id, q.level + 1, pos // 3,
             concat(sib, array_to_string(r.h[1:pos % 3], ''), array_to_string(r.h[pos % 3 + 2:], '')),
             sha256(concat(array_to_string(r.h[1:pos % 3], ''), q.h, array_to_string(r.h[pos % 3 + 2:], '')))
      FROM q JOIN crown r ON r.level = q.level AND r.run = pos // 3, top WHERE q.level < top.height)
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, h AS folded_root, h = root AS verified
FROM q JOIN top ON level = height JOIN l USING (id) JOIN sub USING (tree)""",
    "op3_wu_manber_decontamination": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS pat
      FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
            FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT m FROM p),
win AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS pat
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT win.doc_id, win.i, win.m, p.item_id FROM win JOIN p ON win.m = p.m AND win.pat = p.pat),
cover AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM (SELECT DISTINCT doc_id, i, m FROM hit))
          GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(s, ',' ORDER BY s) AS names
          FROM (SELECT DISTINCT doc_id, item_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_mtree_top_k": """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e || [0.0], c.e || [0.0]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank,
             vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_preference_pairs": r"""
WITH t AS (SELECT conv_id AS pair_id, turn, min(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))) AS said,
                  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
a AS (SELECT pair_id, min(turn) AS pos FROM t WHERE said.role = 'assistant' GROUP BY pair_id),
r AS (SELECT t.pair_id, t.turn, t.said FROM t LEFT JOIN a USING (pair_id) WHERE pos IS NULL OR t.turn < pos
      UNION ALL
      SELECT own.pair_id, own.pos + t.turn - other.pos, t.said
      FROM t JOIN a other USING (pair_id) JOIN a own ON own.pair_id + 1 = other.pair_id WHERE t.turn >= other.pos),
s AS (SELECT coalesce(t.pair_id, r.pair_id) AS pair_id, coalesce(t.turn, r.turn) AS turn, t.said AS c, r.said AS r
      FROM t FULL JOIN r ON t.pair_id = r.pair_id AND t.turn = r.turn),
f AS (SELECT pair_id, min(turn) FILTER (WHERE c IS DISTINCT FROM r) AS fork FROM s GROUP BY pair_id),
u AS (SELECT pair_id, 'prompt' AS part, turn, c AS said FROM s JOIN f USING (pair_id) WHERE fork IS NULL OR turn < fork
      UNION ALL SELECT pair_id, 'chosen', turn, c FROM s JOIN f USING (pair_id) WHERE turn >= fork AND c IS NOT NULL
      UNION ALL SELECT pair_id, 'rejected', turn, r FROM s JOIN f USING (pair_id) WHERE turn >= fork AND r IS NOT NULL)
SELECT pair_id, part, turn, concat('<|', said.role, '|>', chr(10)) AS header, concat(said.text, chr(10)) AS text,
       CAST(CASE WHEN part <> 'prompt' AND said.role = 'assistant' THEN 1 ELSE 0 END AS INTEGER) AS mask
FROM u""",
}

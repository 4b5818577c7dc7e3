"""Registered queries against their SQL, and the pipeline against a plain version."""

from collections import defaultdict

import pytest

import corpus_pipeline
from netprism.llm import queries, simhash, toxicity
from netprism.llm.common import read_table
from tests.llm.test_llm_brute import classes, contaminated, fingerprint
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, key):
    r = compare(spark, key, queries.QUERIES[key], queries.ORACLE[key], SF, duck(SF))
    assert r["status"] == "match" and not r["type_diffs"], r


def test_entry_registers_the_operators():
    import __spark_entry__ as entry

    names = [k for k in entry.queries() if k.startswith("op") or k == "pipeline"]
    assert len(names) == 14 and set(entry.oracle_sql()) <= set(entry.queries())


def test_stages_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    model = toxicity.train(docs, read_table(spark, SF, "labels"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["predicted"]}
    assert {r["doc_id"] for r in clean.collect()} == set(text) - toxic

    ids = sorted(text)
    fps = [fingerprint(text[i]) for i in ids]
    near = [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert single.columns == docs.columns
    kept = [r["doc_id"] for r in single.collect()]
    assert sorted(kept) == sorted(set(classes(ids, near)))

    bench = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
    sound = corpus_pipeline.drop_contaminated(spark, docs.where("doc_id < 40"), SF)
    assert {r["doc_id"] for r in sound.collect()} == {i for i in ids if i < 40 and not contaminated(text[i], bench, 10)[1]}


def test_run_packs_what_the_stages_keep(spark):
    docs = read_table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = {r["doc_id"] for r in docs.select("doc_id").collect()}
    parts = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        parts[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert set(parts) == want
    for p in parts.values():
        at = 0
        for start, n, total in sorted(p):
            assert start == at
            at += n
        assert at == total


def test_keep_one_with_null_and_repeated_ids(spark):
    rows = [(1, "a b c d", 0), (2, "a b c d", 1), (2, "a b c d", 1), (None, "x y z", 2), (None, "x y z", 2), (3, "other words here", 3), (3, "other words here", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.keep_one(docs, simhash.near_duplicates(docs)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "x y z"), (1, "a b c d"), (3, "other words here")]


def test_keep_one_tells_texts_of_one_id_apart(spark):
    rows = [(5, "a b c d"), (5, "quite another text of its own"), (6, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, "X y  z"),
            (7, "words that stand alone"), (8, "of this one only copies"), (7, "of this one only copies")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.keep_one(docs, simhash.near_duplicates(docs)).collect()
    ids = sorted((r["doc_id"] or 0, r["text"].lower().split()[0]) for r in got)
    assert ids == [(0, "x"), (5, "a"), (5, "quite"), (7, "of"), (7, "words")]

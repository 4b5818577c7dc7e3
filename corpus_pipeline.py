"""Corpus pipeline: toxicity filter, near-duplicate removal, decontamination,
packing.  Each stage takes (spark, docs, sf_dir); ``run`` writes its result as
Parquet in the shared folder and gives it to the next one.

Null texts stay until packing (they are neither toxic, nor contaminated, and
count as empty texts for near-duplicates); other columns of ``documents`` are
carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netprism.llm import decontaminate, packing, simhash, toxicity
from netprism.llm.common import kept_names, read_table, stored
from netprism.llm.queries import BYTE_TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(8) Documents that the sentence model calls toxic go."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    judged = toxicity.score(docs, model, keep=_carried(docs))
    return _restored(judged.where(F.col("predicted") == 0), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(4) One document of each group of near copies stays."""
    return simhash.keep_one(docs, simhash.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(3) Documents with a passage of the benchmark go."""
    found = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), keep=_carried(docs))
    return _restored(found.where(~F.col("contaminated")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(7) What is left, packed into sequences of at most 1024 ids."""
    return packing.pack(docs, BYTE_TOKENIZER)


def _carried(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "doc_id"]


def _restored(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names, in their order."""
    kept = dict(zip(_carried(docs), kept_names(_carried(docs)), strict=True))
    return judged.select(*[F.col(kept.get(c, c)).alias(c) for c in docs.columns])


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates),
          ("benchmark_decontamination", drop_contaminated), ("packing", pack_sequences)]

#: Tokenizer ids and learned weights cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

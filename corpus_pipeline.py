"""A training corpus from raw documents: the stages, and run() over them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the
last adds the columns of its shards. A stage works on all rows that the one before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.llm import common, decontaminate, jaccard_join, mixing, quality, queries, sharding

SHARDS = 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier scores at 0.3 or more, whether labelled or not.

    Null and empty texts are scored by the bias alone; repeated rows are scored alike, so all or
    none stay. Columns of any name stay as they are. Empty in, empty out.
    """
    score = common.free_name(docs, "score")
    scored = quality.score_quality(docs, queries.quality_model(spark, sf_dir), score_col=score)
    return scored.filter(F.col(score) >= 0.3).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that five-word shingles link at 0.8: one with the least id.

    Rows are told apart by id and text, so a repeated or null id takes no other text with it, and
    of repeated rows one stays. Null texts and texts without words link with nothing and stay.
    Columns of any name stay as they are. Empty in, empty out.
    """
    return jaccard_join.without_near_duplicates(docs, words=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, repeated rows alike.

    Null and empty texts hold nothing and stay, and without items all stays. Columns of any name
    stay as they are. Empty in, empty out.
    """
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; one that is not taken goes.

    Documents without words have no size to mix by and go. Null sources are one source. Of
    repeated rows as many are taken as their source's target asks for. The documents' columns
    stay; names of the mix's own columns give way to them. Empty in, empty out.
    """
    given = {c: f"{c}_of_docs" for c in docs.columns if c in ("size", "source_size", "target", "taken")}
    given = dict(zip(given, common.free_names(docs, *given.values()), strict=True))
    mixed = mixing.mix(docs.withColumnsRenamed(given))
    return mixing.repeated(mixed, [given.get(c, c) for c in docs.columns]).toDF(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard, slot and the other columns of the shards, in place of columns of their names.

    Rows with the same or no id share a shard; null texts have size 1. Empty in, empty out.
    """
    return sharding.shard(docs, weights=[1.0] * SHARDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier is learnt, which SQL cannot express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each on a table that the one before has written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, made = common.written(docs, f"stage-{i}")
            if path:
                common.drop(spark, path)
            path = made
    return docs

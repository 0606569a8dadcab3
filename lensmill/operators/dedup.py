"""Exact duplicates: candidate sizes, content hashes, groups, members, what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value occurs at least twice; only these can be duplicates, so only these are hashed."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_")).filter("n_ > 1").select(column)
    return df.join(counts, column, "left_semi")


def hashed(df: DataFrame, size: str, content: Column) -> DataFrame:
    """Candidates by size with the SHA-256 of their whole content, as ``exact_hash``."""
    return repeated_values(df, size).withColumn("exact_hash", F.sha2(content, 256))


def groups(rows: DataFrame, path: str, size: str) -> DataFrame:
    """Hashes that occur at least twice: members, bytes, bytes that deleting wins, and the least path to keep."""
    grouped = rows.groupBy("exact_hash").agg(
        F.count("*").alias("member_count"), F.sum(size).alias("total_bytes"), (F.sum(size) - F.max(size)).alias("wasted_bytes"), F.min(path).alias("keep_path")
    )
    return grouped.filter("member_count > 1")


def members(rows: DataFrame, grouped: DataFrame, path: str) -> DataFrame:
    """Every member of a group, and whether it is the one to keep."""
    return rows.join(grouped.select("exact_hash", "keep_path"), "exact_hash").select("exact_hash", path, (F.col(path) == F.col("keep_path")).alias("keep"))


def page_of_members(member_rows: DataFrame, path: str, most: int = 100) -> DataFrame:
    """At most ``most`` members of each group, the kept one first, then by path."""
    w = Window.partitionBy("exact_hash").orderBy(F.col("keep").desc(), F.col(path))
    return member_rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def invalidated(grouped: DataFrame, member_rows: DataFrame, existing: DataFrame, path: str) -> DataFrame:
    """Groups with a flag that is set once fewer than two members still exist."""
    left = member_rows.join(existing.select(path), path, "left_semi").groupBy("exact_hash").agg(F.count("*").alias("left_"))
    return grouped.join(left, "exact_hash", "left").withColumn("invalidated", F.coalesce("left_", F.lit(0)) < 2).drop("left_")

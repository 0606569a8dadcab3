"""Joining sources and merging rows into a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmill.functions import strings

CATALOG, FILES = 1, 2


def merge_sources(catalog: DataFrame, files: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer join of two sources: the catalog's value first, the files' where it is null or blank.

    source_mask says where a row was seen: 1 catalog, 2 files, 3 both.
    """
    a = catalog.select(key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(CATALOG).alias("a_mask"))
    b = files.select(key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(FILES).alias("b_mask"))
    text = {c for c in columns if catalog.schema[c].dataType.typeName() == "string"}
    pick = [(strings.first_not_blank(F.col(f"a_{c}"), F.col(f"b_{c}")) if c in text else F.coalesce(f"a_{c}", f"b_{c}")).alias(c) for c in columns]
    mask = F.coalesce("a_mask", F.lit(0)).bitwiseOR(F.coalesce("b_mask", F.lit(0))).alias("source_mask")
    return a.join(b, key, "full_outer").select(key, *pick, mask)


def replace(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new, and those of existing whose key is not in new."""
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def ignore(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of existing, and those of new whose key is not in existing."""
    return existing.unionByName(new.join(existing.select(*keys), list(keys), "left_anti"))


def missing(df: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows of df whose key is not in done: what is still to do."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def common_keys(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys that both tables have."""
    return df.select(*keys).join(other.select(*keys), list(keys), "left_semi").distinct()


def stale(df: DataFrame, version: str, current) -> DataFrame:
    """Rows of another version than the current one; rows without a version are not known to be stale."""
    return df.filter(F.col(version) != current)


def abort(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Both tables; a key that occurs twice fails the query when it runs."""
    both = existing.unionByName(new)
    twice = both.groupBy(*keys).agg(F.count("*").alias("n_"))
    checked = twice.withColumn("ok_", F.when(F.col("n_") > 1, F.raise_error(F.lit("duplicate key"))).otherwise(F.lit(True)))
    return both.join(checked.filter("ok_").drop("n_", "ok_"), list(keys), "left_semi")


def guarded_update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """df with new values in the rows that meet the condition."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


#: Columns that analysis or the user sets, which a scan must not overwrite.
KEPT = ("isFavorite", "isTrashed", "deletedAtMs", "sceneType", "ocrText", "qualityScore", "faceClusterId", "thumbnailPath")


def upsert(existing: DataFrame, fresh: DataFrame, tombstones: DataFrame, generation: int, kept: tuple[str, ...] = KEPT) -> DataFrame:
    """Scanned rows merged into the media table, with ``changed`` for those that need new analysis.

    Known rows keep what analysis and the user set. A path with a tombstone is trashed, with the
    later of both times. A row has changed when it is new or its time, size or fingerprint differs.
    """
    kept = tuple(c for c in kept if c in existing.columns)
    old = existing.select("filePath", F.lit(True).alias("known_"), *[F.col(c).alias(f"old_{c}") for c in (*kept, "modifiedAtMs", "fileSize", "fingerprintHead")])
    gone = tombstones.groupBy("filePath").agg(F.max("deletedAtMs").alias("gone_"))
    rows = fresh.join(old, "filePath", "left").join(gone, "filePath", "left")
    known = F.coalesce("known_", F.lit(False))
    same = F.lit(True)
    for c in ("modifiedAtMs", "fileSize", "fingerprintHead"):
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    values = {c: F.when(known, F.col(f"old_{c}")).otherwise(F.col(c)) for c in kept}
    buried = F.col("gone_").isNotNull()
    if "isTrashed" in kept:
        values["isTrashed"] = buried | F.coalesce(values["isTrashed"], F.lit(False))
    if "deletedAtMs" in kept:
        values["deletedAtMs"] = F.when(buried, F.greatest(F.coalesce(values["deletedAtMs"], F.lit(0)), F.col("gone_"))).otherwise(values["deletedAtMs"])
    rows = rows.withColumn("changed", ~known | ~same).withColumns(values).withColumn("scanGeneration", F.lit(generation).cast("long"))
    return rows.select(*fresh.columns, *([] if "scanGeneration" in fresh.columns else ["scanGeneration"]), "changed")


def latest_per_group(df: DataFrame, group: str, *order: str) -> DataFrame:
    """The last row of each group in the order of these columns, by a grouped maximum."""
    rest = [c for c in df.columns if c != group and c not in order]
    top = df.groupBy(group).agg(F.max(F.struct(*order, *rest)).alias("r_"))
    return top.select(group, *[F.col(f"r_.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, name: str) -> DataFrame:
    """left with the last value of right at or before each row's time, by key (an extension).

    One shuffle and sort by key over both tables instead of a range join.
    """
    from pyspark.sql import Window

    a = left.withColumn("v_", F.lit(None).cast(right.schema[value].dataType)).withColumn("side_", F.lit(1))
    b = right.select(key, time, F.col(value).alias("v_"), F.lit(0).alias("side_"))
    w = Window.partitionBy(key).orderBy(time, "side_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(name, F.last("v_", ignorenulls=True).over(w))
    return both.filter("side_ = 1").select(*left.columns, name)

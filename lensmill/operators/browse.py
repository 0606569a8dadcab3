"""Browsing: filters, sort modes, pages and places in an order.

Every order ends in the key, so it is total: pages neither repeat nor skip rows. Pages continue
from a key (keyset), which is a pushed-down filter and a bounded top-k, not a scan of all before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmill.functions import strings

SORTS = ("NAME_ASC", "NAME_DESC", "DATE_DESC", "DATE_ASC", "MODIFIED_DESC", "MODIFIED_ASC", "SIZE_DESC", "SIZE_ASC")


@dataclass(frozen=True)
class Media:
    """Column names of a media table."""

    path: str = "filePath"
    name: str = "fileName"
    directory: str = "parentPath"
    kind: str | None = "mediaType"
    captured: str = "capturedAtMs"
    modified: str = "modifiedAtMs"
    size: str = "fileSize"
    trashed: str | None = "isTrashed"


def sort_keys(sort: str, m: Media) -> list[tuple[Column, bool]]:
    """(key, descending) pairs of a sort mode; the path decides last, downwards only in NAME_DESC."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort mode {sort}")
    what, way = sort.split("_")
    key = {"NAME": strings.nocase(F.col(m.name)), "DATE": F.col(m.captured), "MODIFIED": F.col(m.modified), "SIZE": F.col(m.size)}[what]
    return [(key, way == "DESC"), (F.col(m.path), sort == "NAME_DESC")]


def order(keys: list[tuple[Column, bool]]) -> list[Column]:
    return [k.desc() if down else k.asc() for k, down in keys]


def before(keys: list[tuple[Column, bool]], values: list) -> Column:
    """Whether a row comes before the row with these key values."""
    out, equal = F.lit(False), F.lit(True)
    for (k, down), v in zip(keys, values, strict=True):
        v = F.lit(v)
        out = out | (equal & ((k > v) if down else (k < v)))
        equal = equal & (k == v)
    return out


def after(keys: list[tuple[Column, bool]], values: list) -> Column:
    return before([(k, not down) for k, down in keys], values)


def in_directory(df: DataFrame, m: Media, directory, kind: str | None = None) -> DataFrame:
    """Rows of one directory that are not trashed, of one kind if given. A blank directory is an error."""
    if directory is None or str(directory).strip() == "":
        raise ValueError("directory must not be blank")
    out = df.filter(F.col(m.directory) == directory)
    if m.trashed:
        out = out.filter(~F.col(m.trashed))
    return out.filter(F.col(m.kind) == kind) if kind is not None else out


def page(df: DataFrame, keys: list[tuple[Column, bool]], size: int, cursor: list | None = None) -> DataFrame:
    """The next rows after a cursor (null: the first) in an order."""
    rows = df if cursor is None else df.filter(after(keys, cursor))
    return rows.orderBy(*order(keys)).limit(size)


def offset_page(df: DataFrame, keys: list[tuple[Column, bool]], size: int, offset: int) -> DataFrame:
    return df.orderBy(*order(keys)).offset(offset).limit(size)


def offset_of(df: DataFrame, keys: list[tuple[Column, bool]], values: list) -> DataFrame:
    """One row: how many rows come before the anchor."""
    return df.filter(before(keys, values)).agg(F.count("*").alias("offset"))


def places(df: DataFrame, keys: list[tuple[Column, bool]], *within: str, name: str = "place") -> DataFrame:
    """Each row's place from 0 inside its group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order(keys))) - 1)


def between(df: DataFrame, column: str, low, high) -> DataFrame:
    """Both ends count."""
    return df.filter(F.col(column).between(low, high))


def expired(df: DataFrame, deleted: str, now_ms: int, days: int = 30) -> DataFrame:
    """Trashed rows whose time is set and at least ``days`` ago."""
    return df.filter((F.col(deleted) > 0) & (F.col(deleted) <= now_ms - days * 86_400_000))


def by_paths(df: DataFrame, path: str, wanted: list[str], most: int = 500) -> DataFrame:
    """Rows of an explicit list, in its order: blanks and repeats left out, at most ``most``."""
    listed = list(dict.fromkeys(w for w in wanted if w and w.strip()))[:most]
    spark = df.sparkSession
    at = spark.createDataFrame(list(zip(listed, range(len(listed)), strict=True)), "wanted_ string, at_ int")
    return df.join(F.broadcast(at), F.col(path) == F.col("wanted_")).orderBy("at_").drop("wanted_", "at_")


def ocr_scope(scene: Column) -> Column:
    """Scenes that are worth reading: documents, screenshots and texts."""
    return F.coalesce(F.lower(scene).rlike("document|screenshot|text|文档|截图"), F.lit(False))


def of_scene(df: DataFrame, scene: str, wanted: str) -> DataFrame:
    """Rows of one scene."""
    return df.filter(F.col(scene) == wanted)


def favourites(df: DataFrame, favourite: str, trashed: str | None = None) -> DataFrame:
    """Favourites that are not trashed."""
    out = df.filter(F.col(favourite))
    return out.filter(~F.col(trashed)) if trashed else out


def trash(df: DataFrame, trashed: str, deleted: str, path: str) -> DataFrame:
    """Trashed rows, the last deleted first, then by path."""
    return df.filter(F.col(trashed)).orderBy(F.col(deleted).desc(), path)


def having(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all of these columns are set: a place, a hash, a cluster."""
    return df.dropna("any", subset=list(columns))


def lacking(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of these columns is set, such as those without a thumbnail."""
    missing = F.lit(True)
    for c in columns:
        missing = missing & F.col(c).isNull()
    return df.filter(missing)


def other_generation(df: DataFrame, generation: str, current: int) -> DataFrame:
    """Rows that the current generation has not seen; rows without one count as unseen."""
    return df.filter(~F.col(generation).eqNullSafe(F.lit(current)))


def version_rows(df: DataFrame, path: str, modified: str, fingerprint: str) -> DataFrame:
    """What a scan compares: path, time of change and fingerprint. The scan reads no other column."""
    return df.select(path, modified, fingerprint)


def without_prefix(df: DataFrame, column: str, prefix: str = "pending:") -> DataFrame:
    """Rows whose value is set and does not start with the prefix."""
    return df.filter(~F.col(column).startswith(prefix))


def features_of(df: DataFrame, *, path: str | None = None, plugin: str | None = None, kind: str | None = None) -> DataFrame:
    """Rows of the feature store by file, plugin, type, or any of these together."""
    for column, wanted in (("filePath", path), ("pluginId", plugin), ("featureType", kind)):
        if wanted is not None:
            df = df.filter(F.col(column) == wanted)
    return df


def refined(hits: DataFrame, *, kind: str | None = None, day: str | None = None, camera: str | None = None, kind_col: str = "mediaType", time_col: str = "capturedAt", camera_col: str = "model") -> DataFrame:
    """Search hits of one kind, one local day (yyyy-MM-dd) and one camera, as far as these are given."""
    if kind is not None:
        hits = hits.filter(F.col(kind_col) == kind)
    if day is not None:
        hits = hits.filter(F.to_date(time_col) == F.lit(day).cast("date"))
    return hits.filter(strings.nocase(F.col(camera_col)) == strings.nocase(F.lit(camera))) if camera is not None else hits

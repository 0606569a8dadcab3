"""Group summaries, time lines and directory trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def downwards(df: DataFrame, column: str) -> Column:
    """A number that falls as a number or time rises; null comes last."""
    kind, c = df.schema[column].dataType.typeName(), F.col(column)
    if kind == "timestamp_ntz":
        c = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")
    elif kind in ("timestamp", "date"):
        c = F.unix_micros(c) if kind == "timestamp" else F.unix_date(c)
    return F.struct(c.isNull().alias("none"), (-c).alias("down"))


def directory_summary(df: DataFrame, directory: str, time: str, path: str, thumbnail: str | None = None) -> DataFrame:
    """Per directory: rows, newest time, and path (and thumbnail) of the newest row; of equal times the least path.

    One grouped minimum with partial aggregation; no window runs, and paths are of any type.
    """
    cover = F.struct(F.col(path).alias("path"), (F.col(thumbnail) if thumbnail else F.lit(None).cast("string")).alias("thumbnail"))
    newest = F.min_by(cover, F.struct(downwards(df, time).alias("t"), F.col(path).alias("p")))
    out = df.groupBy(directory).agg(F.count("*").alias("media_count"), F.max(time).alias("latest_at"), newest.alias("c_"))
    shown = [F.col("c_.path").alias("cover_path"), *([F.col("c_.thumbnail").alias("cover_thumbnail")] if thumbnail else [])]
    return out.select(directory, "media_count", "latest_at", *shown)


def by_day(df: DataFrame, album: str, time: str) -> DataFrame:
    """Days of each album with rows, newest first: (album, day, n, place from 0)."""
    days = df.groupBy(album, F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("place", F.row_number().over(Window.partitionBy(album).orderBy(F.col("day").desc())) - 1)


def flattened(nodes: DataFrame, count: str, name: str) -> DataFrame:
    """Directories of a tree that hold rows of their own, the largest first, then by name."""
    return nodes.filter(F.col(count) > 0).orderBy(F.col(count).desc(), name)


def histogram(df: DataFrame, column: str, count: str = "n") -> DataFrame:
    """Rows by value; null is no value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(count))


def year_buckets(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(F.year(time).alias("year")).agg(F.count("*").alias("n"))


def cluster_summary(df: DataFrame, cluster: str, member: str, time: str, key: str, name: str) -> DataFrame:
    """Per cluster: distinct members, rows, the earliest row's key, and any name that is not null."""
    return df.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        F.count_distinct(member).alias("members"),
        F.count("*").alias("n"),
        F.min(F.struct(time, key))[key].alias("representative"),
        F.max(name).alias("any_name"),
    )


def timeline(df: DataFrame, time: str) -> DataFrame:
    """Headers of a time line: one row per year, month (0 to 11) and day, with rows and the newest time.

    level is 0 for years, 1 for months and 2 for days; finer columns of coarser rows are null.
    """
    t = F.col(time)
    parts = df.select(F.year(t).alias("year"), (F.month(t) - 1).alias("month"), F.dayofmonth(t).alias("day"), t.alias("t_"))
    rolled = parts.rollup("year", "month", "day").agg(F.count("*").alias("n"), F.max("t_").alias("newest"), F.grouping_id().alias("g_"))
    return rolled.filter("g_ < 7").select("year", "month", "day", "n", "newest", F.when(F.col("g_") == 3, 0).when(F.col("g_") == 1, 1).otherwise(2).alias("level"))


def flat_timeline(df: DataFrame, time: str) -> DataFrame:
    """Years and days as one list of headers: (year, day or null, rows, newest time)."""
    t = F.col(time)
    parts = df.select(F.year(t).alias("year"), F.to_date(t).alias("day"), t.alias("t_"))
    rolled = parts.rollup("year", "day").agg(F.count("*").alias("n"), F.max("t_").alias("newest"), F.grouping_id().alias("g_"))
    return rolled.filter("g_ < 3").drop("g_")


def available_years(df: DataFrame, time: str) -> DataFrame:
    return df.select(F.year(time).alias("year")).distinct()


def ancestors(path: Column) -> Column:
    """The directory itself and all directories above it, root first: /a, /a/b, /a/b/c."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def tree(df: DataFrame, directory: str) -> DataFrame:
    """Per directory of the tree: rows of its own, rows below and in it, directories with rows, and depth.

    Rows are summed by directory first; only these sums are handed to the ancestors, so the work
    grows with the number of directories and not with that of rows.
    """
    own = df.groupBy(F.col(directory).alias("d_")).agg(F.count("*").alias("c_"))
    up = own.select("d_", "c_", F.explode(ancestors(F.col("d_"))).alias("path"))
    here = F.when(F.col("d_") == F.col("path"), F.col("c_")).otherwise(0)
    return up.groupBy("path").agg(F.sum(here).alias("own"), F.sum("c_").alias("total"), F.count("*").alias("leaves")).select(
        "path", "own", "total", "leaves", (F.size(F.split("path", "/")) - 1).alias("depth")
    )


def covers(df: DataFrame, directory: str, time: str, path: str, most: int = 4) -> DataFrame:
    """Up to ``most`` newest paths of each directory and all below it.

    Ranks inside a directory come first, so an ancestor meets at most ``most`` rows of each.
    """
    w = Window.partitionBy(directory).orderBy(F.col(time).desc(), F.col(path))
    top = df.withColumn("r_", F.row_number().over(w)).filter(F.col("r_") <= most)
    up = top.select(F.explode(ancestors(F.col(directory))).alias("dir"), F.col(time).alias("t_"), F.col(path).alias("cover"))
    w = Window.partitionBy("dir").orderBy(F.col("t_").desc(), F.col("cover"))
    return up.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("dir", "rank", "cover")


def latency(df: DataFrame, operation: str, at: str, key: str, value: str, failed: Column, window: int = 512) -> DataFrame:
    """Per operation: calls, failures, least, largest and mean value, and p50 and p95 of the last ``window``.

    A percentile is the value at place ceil((n - 1) f) of the sorted sample.
    """
    whole = df.groupBy(operation).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("failures"), F.min(value).alias("least"), F.max(value).alias("largest"), F.avg(value).alias("mean")
    )
    w = Window.partitionBy(operation).orderBy(F.col(at).desc(), F.col(key).desc())
    last = df.withColumn("r_", F.row_number().over(w)).filter(F.col("r_") <= window)
    sample = last.groupBy(operation).agg(F.sort_array(F.collect_list(value)).alias("s_"))  # at most ``window`` values
    at_share = lambda f: F.element_at("s_", (F.ceil((F.size("s_") - 1) * F.lit(f)) + 1).cast("int"))
    return whole.join(sample.select(operation, at_share(0.5).alias("p50"), at_share(0.95).alias("p95")), operation)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group: element means by position, then put together in order."""
    long = df.select(group, F.posexplode(vector).alias("i_", "x_"))
    means = long.groupBy(group, "i_").agg(F.avg(F.col("x_").cast("double")).alias("m_"))
    parts = means.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i_", "m_"))).alias("v_"))  # as many as dimensions
    return parts.select(group, F.transform("v_", lambda x: x["m_"]).alias("centroid"))


def share(condition: Column) -> Column:
    """The share of rows for which a condition holds (an aggregate); one that is null does not hold."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def group_metrics(df: DataFrame, group: str, time: str, quality: Column, favourite: Column) -> DataFrame:
    """Per group: rows, first and last time, whole days between (1 at least), mean quality, shares of favourites and weekends."""
    return df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.min(time).alias("first_at"),
        F.max(time).alias("last_at"),
        F.avg(quality).alias("quality"),
        share(favourite).alias("favourites"),
        share(F.dayofweek(time).isin(1, 7)).alias("weekends"),
    ).withColumn("span_days", F.greatest(F.lit(1), F.floor((F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 86_400_000_000)))

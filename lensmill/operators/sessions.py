"""Sessions, busy windows, eviction and rotation: orders within groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmill.functions import dates, maths

WINDOW_SIZES = (7, 14, 21, 30)


def hour(df: DataFrame, time: str) -> Column:
    """Number of a row's hour: of a time, or of milliseconds. Rows without a time come before all others."""
    kind, c = df.schema[time].dataType.typeName(), F.col(time)
    if kind == "timestamp_ntz":
        c = F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', date_trunc('HOUR', `{time}`))")
    elif kind in ("timestamp", "date"):
        c = F.floor(F.unix_seconds(c.cast("timestamp")) / 3600)
    else:
        c = F.floor(c / 3_600_000)
    return F.coalesce(c.cast("long"), F.lit(-(1 << 62)))


def sessions(df: DataFrame, group: str | None, time: str, key: str, *, most_hours: int = 6, place: tuple[str, str] | None = None, most_km: float = 5.0) -> DataFrame:
    """df with ``session``, a number from 1 inside its group, or over the whole table without a group.

    A session ends when whole hours to the next row exceed ``most_hours`` (so 6 h 59 min still
    joins) or both rows have a place and these are further apart than ``most_km``. Rows are
    ordered inside an hour of a group only; the last row of the hour before and the sessions
    begun so far come from tables of hours, so no task sorts a whole group.
    """
    within = [group] if group else []
    rows = df.withColumn("hour_", hour(df, time))
    seen = F.struct(F.col(time).alias("t"), *([F.col(place[0]).alias("lat"), F.col(place[1]).alias("lon")] if place else []))
    hours = Window.partitionBy(*within).orderBy("hour_")
    ends = rows.groupBy(*within, "hour_").agg(F.max_by(seen, F.struct(time, key)).alias("last_"))
    ends = ends.select(*within, "hour_", F.lag("last_").over(hours).alias("before_"))
    w = Window.partitionBy(*within, "hour_").orderBy(time, key)
    rows = same_keys(rows, ends, [*within, "hour_"]).withColumn("before_", F.coalesce(F.lag(seen).over(w), "before_"))
    new = dates.whole_hours(F.col("before_.t"), F.col(time)) > most_hours
    if place:
        lat, lon = (F.col(c) for c in place)
        new = new | F.coalesce(maths.haversine_km(F.col("before_.lat"), F.col("before_.lon"), lat, lon) > most_km, F.lit(False))
    rows = rows.withColumn("new_", F.coalesce(new, F.lit(True)).cast("long"))
    begun = rows.groupBy(*within, "hour_").agg(F.sum("new_").alias("begun_"))
    begun = begun.select(*within, "hour_", F.coalesce(F.sum("begun_").over(hours.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier_"))
    inside = F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = same_keys(rows, begun, [*within, "hour_"]).withColumn("session", F.col("earlier_") + inside)
    return out.select(*df.columns, "session")


def same_keys(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of ``other``, which has a row for each of their keys; null keys are equal."""
    other = other.withColumnsRenamed({k: f"of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return rows.join(other, same, "left").drop(*[f"of_{k}" for k in keys])


def events(df: DataFrame, group: str | None, time: str, key: str, least: int = 3, **options) -> DataFrame:
    """Sessions with at least ``least`` rows: rows, first and last time, whole hours between."""
    rows = sessions(df, group, time, key, **options)
    found = rows.groupBy(*([group] if group else []), "session").agg(F.count("*").alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))
    return found.filter(F.col("n") >= least).withColumn("span_hours", dates.whole_hours(F.col("first_at"), F.col("last_at")))


def busy_windows(df: DataFrame, group: str, time: str, sizes: tuple[int, ...] = WINDOW_SIZES, factor: float = 1.5) -> DataFrame:
    """Runs of ``size`` active days whose rows per day of ``size`` reach ``factor`` times the group's mean.

    Days without rows do not count as steps, so a run may span more calendar days. Rows are
    summed by day first; running sums over days give each run without a range join.
    """
    days = df.groupBy(group, F.to_date(time).alias("day")).agg(F.count("*").alias("c_"), F.min(time).alias("lo_"), F.max(time).alias("hi_"))
    whole = Window.partitionBy(group)
    w = whole.orderBy("day")
    span = F.greatest(F.lit(1), dates.whole_days(F.min("lo_").over(whole), F.max("hi_").over(whole)))
    days = days.withColumn("mean_", F.sum("c_").over(whole) / span)
    days = days.withColumn("runs_", F.array(*[F.struct(F.lit(s).alias("size"), F.lead("day", s - 1).over(w).alias("last_day"), F.sum("c_").over(w.rowsBetween(0, s - 1)).alias("n")) for s in sizes]))
    runs = days.select(group, F.col("day").alias("first_day"), "mean_", F.explode("runs_").alias("r_")).select(group, "first_day", "r_.*", "mean_")
    runs = runs.filter(F.col("last_day").isNotNull()).withColumn("density", F.col("n") / F.col("size"))
    return runs.filter(F.col("density") >= F.col("mean_") * factor).drop("mean_")


def pick_apart(windows: DataFrame, group: str, score: str, most: int = 3, margin_days: int = 3) -> DataFrame:
    """Greedily the best windows of a group that stay ``margin_days`` apart, at most ``most``.

    The best window is taken, those near it go, and again: ``most`` rounds of grouped maxima, so no
    group is held in one task.
    """
    left, taken = windows.withColumn("order_", F.struct(F.col(score), -F.unix_date("first_day"), -F.unix_date("last_day"))), None
    for i in range(most):
        best = left.groupBy(group).agg(F.max_by(F.struct("first_day", "last_day", "size"), "order_").alias("b_"))
        near = (F.col("first_day") <= F.date_add(F.col("b_.last_day"), margin_days)) & (F.col("last_day") >= F.date_sub(F.col("b_.first_day"), margin_days))
        joined = left.join(best, group)
        picked = joined.filter((F.col("first_day") == F.col("b_.first_day")) & (F.col("last_day") == F.col("b_.last_day")) & (F.col("size") == F.col("b_.size")))
        picked = picked.select(*windows.columns, F.lit(i + 1).alias("pick"))
        taken = picked if taken is None else taken.unionByName(picked)
        left = joined.filter(~near).drop("b_")
    return taken


def evicted(cache: DataFrame, time: str, size: str, keys: list[str], *, budget: int, protected: Column, group: str | None = None) -> DataFrame:
    """Entries that an LRU cache drops: the oldest first while the total exceeds the budget.

    Protected entries count but stay. A cache is a group, or all without one. Sizes are summed by
    hour (or by value, where ``time`` is a text) first, so no task sorts a whole cache.
    """
    within = [group] if group else []
    total = cache.groupBy(*within).agg(F.coalesce(F.sum(size), F.lit(0)).alias("total_"))
    span = F.col(time) if cache.schema[time].dataType.typeName() == "string" else hour(cache, time)
    free = cache.filter(~protected).withColumn("span_", span)
    spans = free.groupBy(*within, "span_").agg(F.sum(size).alias("size_"))
    before = Window.partitionBy(*within).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*within, "span_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("earlier_"))
    inside = Window.partitionBy(*within, "span_").orderBy(time, *keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = same_keys(free, spans, [*within, "span_"]).withColumn("gone_", F.col("earlier_") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    rows = same_keys(rows, total, within) if group else rows.join(F.broadcast(total))  # one row
    return rows.filter(F.col("total_") - F.col("gone_") > budget).select(*cache.columns)


def first_claims(shown: DataFrame, item: str, rank: str) -> DataFrame:
    """Each item once, under the recommendation with the least rank."""
    claims = shown.groupBy(item).agg(F.min(rank).alias(rank))
    return shown.join(claims, [item, rank], "left_semi").dropDuplicates([item, rank])


def leftovers(items: DataFrame, claimed: DataFrame, item: str, order: list[str], size: int = 20, group: str | None = None) -> DataFrame:
    """Items that nothing claimed, in chunks of ``size`` by order (numbered from 0)."""
    w = Window.partitionBy(*([group] if group else [])).orderBy(*order)
    return items.join(claimed.select(item), item, "left_anti").withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))


def batch(df: DataFrame, order: list[Column], number: int, size: int = 10) -> DataFrame:
    """The rows of one batch, batches counted from 0 in this order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def diversified(rows: list[dict], most: int | None = None, category: str = "category", album: str = "album", streak: int = 2) -> list[dict]:
    """Best first, but at most ``streak`` in a row of a category and of an album while others are left."""
    left = sorted(rows, key=lambda r: (-r["score"], r["id"]))
    out: list[dict] = []
    last, runs = {category: None, album: None}, {category: 0, album: 0}
    while left and (most is None or len(out) < most):
        at = next((i for i, r in enumerate(left) if all(r[k] != last[k] or runs[k] < streak for k in last)), None)
        r = left.pop(0 if at is None else at)
        for k in last:
            runs[k] = runs[k] + 1 if at is not None and r[k] == last[k] else 1
            last[k] = r[k]
        out.append(r)
    return out


def diversify(df: DataFrame, list_col: str, schema: str, most: int | None = None) -> DataFrame:
    """Each list's recommendations in diversified order, one list a task.

    A list is what one user is offered. Of a longer one the first ``most`` are enough, which stops
    the search early; without it the time grows with the square of the list's length.
    """

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = diversified(pdf.to_dict("records"), most)
        return pd.DataFrame([r | {"place": i} for i, r in enumerate(rows)], columns=[*pdf.columns, "place"])

    return df.groupBy(list_col).applyInPandas(ordered, f"{schema}, place long")


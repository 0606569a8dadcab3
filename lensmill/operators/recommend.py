"""Recommendations: scored albums, windows, events, scenes and clusters of vectors.

Scores are weighted sums of a logarithmic density, an age factor (older counts more), mean
quality, the shares of weekends and favourites, group size and cohesion. ``now`` is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmill.functions import dates, maths
from lensmill.operators import rollup, sessions

#: Weights by kind: density, age, quality, weekends, favourites, size, cohesion.
WEIGHTS = {
    "WHOLE_ALBUM": {"density": 0.3, "age": 0.3, "quality": 0.2, "weekends": 0.1, "favourites": 0.1},
    "TIME_WINDOW": {"density": 0.3, "age": 0.25, "quality": 0.2, "weekends": 0.15, "favourites": 0.1},
    "EVENT": {"density": 0.2, "age": 0.25, "quality": 0.25, "weekends": 0.1, "size": 0.1, "favourites": 0.1},
    "SCENE_THEME": {"quality": 0.4, "age": 0.3, "size": 0.2, "favourites": 0.1},
    "SEMANTIC_CLUSTER": {"quality": 0.3, "age": 0.3, "size": 0.2, "cohesion": 0.2},
}
BALANCED, QUALITY, FAVORITES, MEMORIES, RECENT = "BALANCED", "QUALITY", "FAVORITES", "MEMORIES", "RECENT"
#: Columns that recommendations of all kinds share.
COMMON = ("category", "id", "n", "first_at", "last_at", "quality", "favourites", "score")


def score(kind: str, now: Column, **parts: Column) -> Column:
    """The score of a kind from density, last_at, quality, weekends, favourites, n and cohesion."""
    values = {
        "density": lambda: maths.log_density(parts["density"]),
        "age": lambda: maths.age_factor(dates.whole_days(parts["last_at"], now)),
        "size": lambda: maths.size_factor(parts["n"]),
    }
    out = F.lit(0.0)
    for name, weight in WEIGHTS[kind].items():
        out = out + weight * (values[name]() if name in values else parts[name])
    return out


def albums(df: DataFrame, album: str, time: str, quality: Column, favourite: Column, now: Column, large: int = 500, large_days: int = 60) -> DataFrame:
    """One recommendation for each album, and whether it is large."""
    m = rollup.group_metrics(df, album, time, quality, favourite)
    density = F.when(F.col("n") == 1, 1.0).otherwise(F.col("n") / F.col("span_days"))
    s = score("WHOLE_ALBUM", now, density=density, last_at=F.col("last_at"), quality=F.col("quality"), weekends=F.col("weekends"), favourites=F.col("favourites"))
    return m.withColumn("is_large", (F.col("n") >= large) & (F.col("span_days") >= large_days)).withColumn("score", s)


def windows(df: DataFrame, album: str, time: str, quality: Column, favourite: Column, now: Column, most: int = 3) -> DataFrame:
    """The best busy windows of each album, apart from each other."""
    found = sessions.busy_windows(df, album, time)
    rows = df.select(F.col(album).alias("al_"), F.to_date(time).alias("d_"), F.col(time).alias("t_"), quality.alias("q_"), favourite.cast("double").alias("f_"))
    days = rows.groupBy("al_", "d_").agg(F.sum("q_").alias("q_"), F.sum("f_").alias("f_"), F.sum(F.dayofweek("t_").isin(1, 7).cast("double")).alias("w_"), F.min("t_").alias("lo_"), F.max("t_").alias("hi_"))
    joined = found.join(days, (F.col(album) == F.col("al_")) & F.col("d_").between(F.col("first_day"), F.col("last_day")))
    m = joined.groupBy(album, "first_day", "last_day", "size", "n", "density").agg(
        (F.sum("q_") / F.first("n")).alias("quality"), (F.sum("f_") / F.first("n")).alias("favourites"), (F.sum("w_") / F.first("n")).alias("weekends"), F.min("lo_").alias("first_at"), F.max("hi_").alias("last_at")
    )
    s = score("TIME_WINDOW", now, density=F.col("density"), last_at=F.col("last_at"), quality=F.col("quality"), weekends=F.col("weekends"), favourites=F.col("favourites"))
    return sessions.pick_apart(m.withColumn("score", s), album, "score", most)


def events(df: DataFrame, group: str | None, time: str, key: str, quality: Column, favourite: Column, now: Column, **options) -> DataFrame:
    """Events across directories with their scores; sessions of fewer than three rows are none."""
    rows = sessions.sessions(df, group, time, key, **options)
    m = rows.groupBy(*([group] if group else []), "session").agg(
        F.count("*").alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.avg(quality).alias("quality"), rollup.share(favourite).alias("favourites"), rollup.share(F.dayofweek(time).isin(1, 7)).alias("weekends")
    )
    m = m.filter("n >= 3").withColumn("density", F.col("n") / F.greatest(F.lit(1), dates.whole_hours(F.col("first_at"), F.col("last_at"))))
    parts = {c: F.col(c) for c in ("density", "last_at", "quality", "weekends", "favourites", "n")}
    return m.withColumn("score", score("EVENT", now, **parts))


def top_per_group(df: DataFrame, group: str, order: list[Column], most: int = 20, least: int = 1) -> DataFrame:
    """The first ``most`` rows of each group with at least ``least`` rows, with their ``rank``."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= max(most, least))
    if least > 1:
        big = ranked.filter(F.col("rank") == least).select(group)
        ranked = ranked.join(big, group, "left_semi")
    return ranked.filter(F.col("rank") <= most)


def scenes(df: DataFrame, scene: str, time: str, key: str, quality: str, favourite: Column, now: Column, most: int = 20, least: int = 5) -> DataFrame:
    """One theme for each scene with at least five rows, over its best twenty."""
    top = top_per_group(df.filter(F.col(scene).isNotNull()), scene, [F.col(quality).desc(), F.col(time).desc(), F.col(key)], most, least)
    m = top.groupBy(scene).agg(F.count("*").alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.avg(F.col(quality).cast("double")).alias("quality"), rollup.share(favourite).alias("favourites"))
    return m.withColumn("score", score("SCENE_THEME", now, last_at=F.col("last_at"), quality=F.col("quality"), favourites=F.col("favourites"), n=F.col("n")))


def cohesion(distance: Column) -> Column:
    """1 less half the mean distance of a cluster's members to its centre, within 0 and 1 (an aggregate)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.avg(distance) / 2))


def clusters(members: DataFrame, cluster: str, distance: str, time: str, key: str, quality: str, favourite: Column, now: Column, most: int = 20, least: int = 5) -> DataFrame:
    """One theme for each cluster of vectors with at least five members, over its best twenty.

    Cohesion is that of all members, the other parts are those of the best.
    """
    close = members.groupBy(cluster).agg(cohesion(F.col(distance)).alias("cohesion"))
    top = top_per_group(members, cluster, [F.col(quality).desc(), F.col(time).desc(), F.col(key)], most, least)
    m = top.groupBy(cluster).agg(F.count("*").alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.avg(F.col(quality).cast("double")).alias("quality"), rollup.share(favourite).alias("favourites"))
    m = m.join(close, cluster)
    return m.withColumn("score", score("SEMANTIC_CLUSTER", now, last_at=F.col("last_at"), quality=F.col("quality"), n=F.col("n"), cohesion=F.col("cohesion")))


def preferred(df: DataFrame, preference: str, now: Column | None = None) -> DataFrame:
    """df with ``rank_score``: the score and a bonus of up to 0.35, by quality, share of favourites, or age.

    MEMORIES prefers what began long ago (up to a year), RECENT what ended lately (within 30 days).
    """
    seconds = lambda since: F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(since).cast("timestamp"))
    bonus = {
        BALANCED: lambda: F.lit(0.0),
        QUALITY: lambda: F.col("quality") * 0.35,
        FAVORITES: lambda: F.col("favourites") * 0.35,
        MEMORIES: lambda: F.least(seconds("first_at") / 31_536_000.0, F.lit(1.0)) * 0.35,
        RECENT: lambda: (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), seconds("last_at") / 2_592_000.0))) * 0.35,
    }[preference]
    return df.withColumn("rank_score", F.col("score") + bonus())


def ranked(parts: dict[str, tuple[DataFrame, Column]], preference: str = BALANCED, now: Column | None = None, most: int | None = None) -> DataFrame:
    """The union of all recommenders as one list: COMMON and rank_score, in order.

    parts: each category's recommendations and the column that names one. The best come first; of
    equal ones the categories' order and then the name decides. ``most`` makes it a bounded top-k.
    """
    out = None
    for i, (category, (rows, name)) in enumerate(parts.items()):
        rows = rows.withColumn("category", F.lit(category)).withColumn("id", name.cast("string")).select(*COMMON, F.lit(i).alias("kind_"))
        out = rows if out is None else out.unionByName(rows)
    out = preferred(out, preference, now).orderBy(F.col("rank_score").desc(), "kind_", "id")
    out = (out.limit(most) if most is not None else out).drop("kind_")
    return out


def preview(items: Column, most: int = 4) -> Column:
    """The best items of an array of structs (quality, time, path), best first."""
    return F.slice(F.sort_array(items, asc=False), 1, most)

"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source's target stops at its cap (a number of
epochs of its size) and the excess goes to the others by weight, until none is above its cap.
That fixed point has a closed form: in the order of cap over weight, the capped sources come
first, and one level serves the rest.

A source then gives floor(target / size) whole repetitions of each document, and one more of as
many as fill the rest of its target: those that come first in a seeded order of hashes. The order
is cut without sorting a source: sizes are added up by cells of the hash, the cell where the
target is reached is found from these sums, and only that cell's documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmill.llm import common

#: Hexadecimal digits of the hash that make a cell: 4096 cells in each source.
CELL_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, *, size: str = "source_size", weight: str = "weight", epochs: float = 3.0, budget: Column | None = None) -> DataFrame:
    """Adds ``target`` to a table with one row per source.

    The budget is the sum of all sizes, or the column given. Where even the caps of all sources
    do not reach it, each gets its cap. Sources without words get 0, and null weights count as 0.
    One row per source is sorted in one task: sources, not documents.
    """
    cap = F.col(size) * F.lit(float(epochs))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    rows = sources.withColumn("cap_", cap).withColumn("w_", w).withColumn("r_", F.when(F.col("w_") > 0, F.col("cap_") / F.col("w_")))
    by = Window.orderBy(F.col("r_").asc_nulls_last(), F.col("cap_"))
    total = F.sum(F.col(size)).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if budget is None else budget
    before = F.coalesce(F.sum(F.when(F.col("w_") > 0, F.col("cap_")).otherwise(0.0)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w_").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level_", F.when(F.col("w_") > 0, (total - before) / rest))
    # The first source whose cap is not below the level that it and those after it would share.
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.min(F.when(F.col("r_") >= F.col("level_"), F.struct("r_", "cap_", "level_"))).over(everything)["level_"]
    target = F.when(F.col("w_") <= 0, 0.0).when(level.isNull(), F.col("cap_")).otherwise(F.least("cap_", level * F.col("w_")))
    return rows.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("cap_", "w_", "r_", "level_")


def cyclic_weights(sources: DataFrame, source_col: str, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Adds ``weight``: sources in code point order, null last, take the cycle's values in turn."""
    at = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(x)) for x in cycle])
    return sources.withColumn("weight", F.element_at(values, (at % len(cycle) + 1).cast("int")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, epochs: float = 3.0, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target and taken.

    size is the number of words, source_size its sum over the source, target the source's share
    in words, and taken the words that the mix takes of this document, repetitions counted: a
    whole multiple of size, at most ceil(epochs) times. The sum of taken over a source misses its
    target by less than its largest document. weights: a table of source_col and weight (a
    source without a row weighs 0); by default 1, 2, 3 repeating over the sorted sources.

    Null sources are one source; empty and null texts have size 0 and taken 0. Rows without an id
    count as an empty id. Where rows have the same id, size and text, as many of them are taken as
    reach the target. The same seed and rows give the same result on any number of machines.
    Documents are not shuffled, but for such equal rows where the target falls among them. New
    columns replace columns of docs that have their names; the others stay. Empty in, empty out.
    """
    new = ["size", "source_size", "target", "taken"]
    docs = docs.drop(*[c for c in new if c not in (id_col, text_col, source_col)])
    own, total, number = common.free_names(docs, "hash_", "sum_", "number_")
    hashed = docs.withColumn(own, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    hashed = hashed.withColumn(total, F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0)))
    rows = hashed.withColumn("size", word_count(F.col(text_col)))
    cell = F.substring(own, 1, CELL_DIGITS)

    # Words by source and cell of the hash, then by source: tables of sources, not of documents.
    cells = rows.groupBy(F.col(source_col).alias("src_"), cell.alias("cell_")).agg(F.sum("size").alias("words_"))
    cells, cells_path = common.written(cells, "cells")
    totals = cells.groupBy("src_").agg(F.sum("words_").alias("source_size"))
    if weights is None:
        totals = cyclic_weights(totals, "src_")
    else:
        given = weights.groupBy(F.col(source_col).alias("given_")).agg(F.max("weight").alias("weight"))
        totals = totals.join(given, F.col("src_").eqNullSafe(F.col("given_")), "left").drop("given_")
    filled = water_fill(totals, epochs=epochs).drop("weight")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("whole_", whole).withColumn("rest_", F.col("target") - F.col("whole_") * F.col("source_size"))
    filled, filled_path = common.written(filled, "filled")
    known = filled.count()

    # In each source, the cell where the rest is reached, and in it the last rows that are taken.
    before = Window.partitionBy("src_").orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
    cut = cells.withColumn("before_", F.coalesce(F.sum("words_").over(before), F.lit(0))).withColumnRenamed("src_", "of_")
    cut = cut.join(common.small(filled, known), F.col("of_").eqNullSafe(F.col("src_")))
    cut = cut.filter((F.col("before_") < F.col("rest_")) & (F.col("before_") + F.col("words_") > F.col("rest_")))
    cut = cut.select("of_", F.col("cell_").alias("in_"), "before_", "rest_")
    near = hashed.select(F.col(source_col).alias("src_"), F.col(text_col).alias("text_"), F.col(own).alias("hash_"), cell.alias("cell_"), F.col(total).alias("sum_"))
    near = near.join(common.small(cut, known), F.col("src_").eqNullSafe(F.col("of_")) & (F.col("cell_") == F.col("in_")))
    near = near.select("src_", "hash_", "before_", "rest_", word_count(F.col("text_")).alias("size_"), "sum_")
    near = near.groupBy("src_", "hash_", "size_", "sum_", "before_", "rest_").agg(F.count("*").alias("rows_"))  # equal rows together
    inside = Window.partitionBy("src_").orderBy("hash_", "size_", "sum_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before_") + F.sum(F.col("size_") * F.col("rows_")).over(inside)
    # A row that straddles the target is taken when more than half of it lies below.
    fits = F.when(F.col("size_") > 0, F.floor((F.col("rest_") - F.col("upto_")) / F.col("size_") + F.col("rows_") + 0.5))
    near = near.withColumn("upto_", upto).withColumn("fits_", F.greatest(fits, F.lit(0)))
    key = F.struct("hash_", "size_", "sum_")
    last = near.groupBy("src_").agg(
        F.max(F.when(F.col("fits_") >= F.col("rows_"), key)).alias("last_"),
        F.min(F.when((F.col("fits_") > 0) & (F.col("fits_") < F.col("rows_")), F.struct("hash_", "size_", "sum_", "fits_"))).alias("tied_"),
    )
    edge = cells.join(common.small(filled.withColumnRenamed("src_", "of_"), known), F.col("of_").eqNullSafe(F.col("src_"))).drop("of_")
    edge = edge.withColumn("upto_", F.sum("words_").over(Window.partitionBy("src_").orderBy("cell_").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = edge.groupBy("src_").agg(F.max(F.when(F.col("upto_") <= F.col("rest_"), F.col("cell_"))).alias("full_"))
    limits = filled.join(last.withColumnRenamed("src_", "of_"), F.col("of_").eqNullSafe(F.col("src_")), "left").drop("of_")
    limits = limits.join(edge.withColumnRenamed("src_", "of_"), F.col("of_").eqNullSafe(F.col("src_")), "left").drop("of_", "rest_")
    limits, _ = common.written(limits, "limits")
    common.drop(docs.sparkSession, cells_path, filled_path)

    helpers = ["src_", "whole_", "last_", "tied_", "full_"]
    src, whole_, last_, tied_, full_ = common.free_names(rows, *helpers)
    tied = limits.filter("tied_ is not null").select("src_").count()
    limits = limits.withColumnsRenamed(dict(zip(helpers, (src, whole_, last_, tied_, full_), strict=True)))
    out = rows.join(common.small(limits, known), F.col(source_col).eqNullSafe(F.col(src))).drop(src)
    key = F.struct(F.col(own).alias("hash_"), F.col("size").alias("size_"), F.col(total).alias("sum_"))
    extra = (cell <= F.col(full_)) | (key <= F.col(last_))
    if tied:  # of equal rows, as many as fit
        equal = F.coalesce((F.col(own) == F.col(f"{tied_}.hash_")) & (F.col("size") == F.col(f"{tied_}.size_")) & (F.col(total) == F.col(f"{tied_}.sum_")), F.lit(False))
        among, _ = common.numbered(out.filter(equal), [source_col], number)
        among = among.withColumn("taken", F.col("size") * (F.col(whole_) + (F.col(number) < F.col(f"{tied_}.fits_")).cast("int"))).drop(number)
        out = out.filter(~equal)
    out = out.withColumn("taken", F.col("size") * (F.col(whole_) + F.when(extra, 1).otherwise(0)))
    out = out.unionByName(among) if tied else out
    return out.drop(own, total, whole_, full_, last_, tied_)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a mix, each as often as it is taken; documents without words drop out."""
    times, copy = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int"), common.free_name(mixed, "copy_")
    return mixed.select(*columns, F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).drop(copy)

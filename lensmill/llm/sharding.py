"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Each record scores every shard by a hash of its key and the shard's number, and goes to the shard
with the highest score (Thaler and Ravishankar, 1998; the weighted score -w / ln(u) is of Schindler
and Schomaker). Another shard takes only the records that it now wins; no other record moves.

Slots within a shard are gapless without a window over a whole shard: rows are numbered inside
cells (a shard and some bits of the key's hash), and a prefix sum over the small table of cell
counts gives each cell its first slot. A cell that is too large is numbered task by task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmill.llm import common

#: Bits of the key's hash that split a shard into cells for numbering.
CELL_BITS = 12
#: Rows of a cell that one task may number.
CELL_ROWS = 500_000


def unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) from 52 bits of md5 of the salt and the key as text."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("long") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float], salt: str = "shard") -> Column:
    """Number of the shard that the key belongs to; ties go to the lower number.

    A shard of weight 0 takes nothing; a null key counts as empty text.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be at least 0, and one above")
    scores = [F.struct((F.lit(float(w)) / -F.log(unit(key, f"{salt}{i}"))).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["i"]).cast("int")


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None, grown: list[float] | None = None) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard.

    size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 the unsigned checksum of those
    bytes (null: 0). law is ``key``: id and weights alone decide the shard. slot counts from 0
    in each shard, by key hash, then key, size and checksum; rows that agree in all of these are
    interchangeable. grown_shard is the shard under the weights ``grown`` (by default one shard
    more, of weight 1). Repeated ids go to one shard; null ids count as empty text. A column of
    docs that has one of the new names is replaced; the others stay. Empty in, empty out.
    """
    weights = weights or [1.0] * 16
    grown = grown or [*weights, 1.0]
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    key, text = F.col(id_col), F.col(text_col)
    rows = docs.drop(*[c for c in new if c not in (id_col, text_col)])
    rows = rows.select(
        "*",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
    )
    return slots(rows, id_col)


def slots(rows: DataFrame, id_col: str) -> DataFrame:
    """Adds slot, a gapless number from 0 within each shard.

    The table of cells has a fixed size: shards times 2 ** CELL_BITS rows at most. A cell with
    more than CELL_ROWS rows (ids that repeat without end) is numbered by the tasks that hold its
    rows, in any order; the others by key hash.
    """
    digest, cell, first, at, shard_, cell_, hot = common.free_names(rows, "digest", "cell", "first", "at", "of_shard", "of_cell", "hot")
    rows = rows.withColumn(digest, F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = rows.withColumn(cell, F.conv(F.substring(digest, 1, CELL_BITS // 4), 16, 10).cast("int"))
    counts = rows.groupBy(F.col("shard").alias(shard_), F.col(cell).alias(cell_)).agg(F.count("*").alias(at))
    before = Window.partitionBy(shard_).orderBy(cell_).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard_, cell_, F.coalesce(F.sum(at).over(before), F.lit(0)).alias(first), (F.col(at) > CELL_ROWS).alias(hot))
    counts, _ = common.written(counts, "cells")
    hot_cells = counts.filter(hot).count()
    rows = rows.join(F.broadcast(counts), (F.col("shard") == F.col(shard_)) & (F.col(cell) == F.col(cell_))).drop(shard_, cell_)
    inside = Window.partitionBy("shard", cell).orderBy(digest, F.col(id_col), "size", "text_crc32")
    out = (rows.filter(~F.col(hot)) if hot_cells else rows).withColumn(at, F.row_number().over(inside) - 1)
    if hot_cells:
        out = out.unionByName(common.numbered(rows.filter(hot), ["shard", cell], at)[0])
    return out.withColumn("slot", F.col(first) + F.col(at)).drop(digest, cell, first, at, hot)

"""What the operators share: tables written between steps, words, components of a graph."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word contracts; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\v\f\r"
#: A side with at most so many rows (of two or three numbers each) may be broadcast: tens of MB.
BROADCAST_ROWS = 500_000

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where that is unset a temporary folder stands in, but only if all runs on this machine.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lensmill-"))
    return _own_dir[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that written() made."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # noqa: BLE001  the session has ended: nothing is left to ask
        pass


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path.

    It cuts the lineage: a lost executor costs only tasks that read the table again. What a
    returned DataFrame still reads goes when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lensmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop_quietly, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only when its counted rows are few; else Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold 8 MB, where the session has Spark's default of 64 MB.

    A task holds several batches at once, in the JVM and in each of its Python workers.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def crc_of(key: Column | str) -> Column:
    """crc32 of a key as text; a null key counts as empty text."""
    return F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """name, or a variant of it that df does not have yet."""
    return free_names(df, name)[0]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, or variants of them that df does not have yet, all different."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(rows: DataFrame, keys: list[str], number: str) -> tuple[DataFrame, str]:
    """rows with ``number``, from 0 without gaps within each key; and the path of their table.

    For keys that may have any share of the rows. They are written once with the task that wrote
    them; each task's rows of a key are numbered for themselves, after those of the tasks before.
    """
    part, first, before, *of = free_names(rows, "part", "first", "before", *(f"of_{k}" for k in keys), number)[:-1]
    rows, path = written(rows.withColumn(part, F.spark_partition_id()), "numbered")
    counts = rows.groupBy(*keys, part).agg(F.count("*").alias(before))
    ahead = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(first, F.coalesce(F.sum(before).over(ahead), F.lit(0))).drop(before)
    counts = counts.toDF(*of, f"of_{part}", first)
    same = F.col(part) == F.col(f"of_{part}")
    for key, other in zip(keys, of, strict=True):
        same = same & F.col(key).eqNullSafe(F.col(other))
    inside = Window.partitionBy(*keys, part).orderBy(F.lit(0))
    out = rows.withColumn(number, F.row_number().over(inside) - 1).join(counts, same)
    return out.withColumn(number, F.col(number) + F.col(first)).drop(part, first, f"of_{part}", *of), path


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for the words met so far, up to about ``most`` bytes of them."""

    def __init__(self, most: int = 24 << 20):
        super().__init__()
        self.most, self.room = most, most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) < 100:  # longer ones seldom come again
            self.room -= len(word) + 180  # of the word, its hash and their place
            if self.room < 0:
                self.clear()
                self.room = self.most
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, the same on every machine."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes of a text that are hashed together, and bytes of the longest word that is hashed with others.
PIECE, LONGEST = 1 << 15, 255
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in SPACES]] = True
with np.errstate(over="ignore"):
    _LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _POWERS, _INVERSE = (np.cumprod(np.array([1] + [x] * (PIECE + LONGEST), np.uint64), dtype=np.uint64) for x in (0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words: runs of anything but six white-space characters, A-Z in lower case.

    A word's hash is a polynomial of its letters' random numbers, from running sums over the text;
    for words of over LONGEST bytes it is xxhash64.
    """
    if not text:
        return np.zeros(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass").lower()
    a = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    np.logical_not(_BLANK[a], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    out, at = np.zeros(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = starts[at]
            to = int(np.searchsorted(starts, base + PIECE)) if len(a) > PIECE else len(starts)
            last = starts[to - 1] + min(size[to - 1], LONGEST)
            sums = np.zeros(last - base + 1, np.uint64)
            np.cumsum(_LETTERS[a[base:last]] * _POWERS[: last - base], out=sums[1:])
            first = starts[at:to] - base
            out[at:to] = (sums[np.minimum(ends[at:to] - base, last - base)] - sums[first]) * _INVERSE[first]
            at = to
        out = mix(out + size.astype(np.uint64))
    for i in np.flatnonzero(size > LONGEST).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return out


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words make one shingle together."""
    count = len(hashes)
    if not count:
        return hashes
    width = min(n, count)
    with np.errstate(over="ignore"):
        h = np.full(count - width + 1, np.uint64(width), np.uint64)
        for i in range(width):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += hashes[i : count - width + 1 + i]
            h ^= h >> np.uint64(29)
    h = mix(h)
    h.sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def batches(rows: Iterable[list], schema: pa.Schema, size: int = 500, most_bytes: int = 16 << 20):
    """Record batches of the rows; a batch ends after ``size`` rows or about ``most_bytes``."""
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += sum(len(v) * (1 if isinstance(v, str | bytes) else 8) for v in row if hasattr(v, "__len__"))
        if len(held) >= size or held_bytes >= most_bytes:
            yield _batch(held, schema)
            held, held_bytes = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def components(edges: DataFrame, name: str = "cc") -> tuple[DataFrame, str]:
    """(node, comp) of every node of the edges (u, v); comp is the least node that it reaches.

    Large-star and small-star steps (Kiveris and others, 2014): each hangs neighbours below the
    least of a neighbourhood. Only counts and minima are gathered by node, never lists, and each
    round is a table in the shared folder. Rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e, path = written(e, name)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e2, path2 = written(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        drop(spark, path)
        e, path = e2, path2
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select("v", F.col("v").alias("comp")).distinct().toDF("node", "comp")), path

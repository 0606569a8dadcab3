"""Quality classifier: naive Bayes features under a linear support vector machine.

Method (Wang and Manning, "Baselines and bigrams", ACL 2012): each text is a set of n-gram
indicators; the log-count ratio of the two classes scales them; a linear model with hinge loss is
fitted on the scaled features by dual coordinate descent (Hsieh and others, ICML 2008).

The class counts cover every training row: each task counts its own and Spark adds them up. Only
the descent works on a sample of labelled rows, which ``most_rows`` bounds, in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lensmill.llm import common

#: Hashed features: n-grams of 1 to 4 characters and of 1 and 2 word shapes.
WIDTH = 1 << 17
#: Marks of 2 and 3 words in a row that do (1) or do not (0) repeat the word before.
REPEATS = (b"\1\1", b"\1\0", b"\0\1", b"\1\1\1", b"\1\0\1", b"\0\1\0", b"\0\0\0")


def grams(text: str | None) -> np.ndarray:
    """Indices of the text's distinct n-grams, sorted. Digits and letter case count as shapes."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c[(c >= 48) & (c <= 57)] = 48
    flags = np.zeros(WIDTH, bool)
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint64)
        for n in range(1, 5):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
            flags[common.mix(h) & np.uint64(WIDTH - 1)] = True
        # Word shapes: runs of one kind of character, by kind and length up to 3.
        kind = np.where(c <= 32, 0, np.where((c >= 97) & (c <= 122), 1, np.where((c >= 65) & (c <= 90), 2, np.where(c == 48, 3, np.where(c > 127, 4, c)))))
        start = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        run = np.diff(np.concatenate([start, [len(c)]]))
        shape = kind[start].astype(np.uint64) * np.uint64(4) + np.minimum(run, 3).astype(np.uint64)
        h = shape + np.uint64(1 << 40)
        for n in range(1, 4):
            flags[common.mix(h) & np.uint64(WIDTH - 1)] = True
            if len(shape) <= n:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[n:] + np.uint64(n << 50)
    # Whether each word repeats the one before it: n-grams of 2 and 3 of these marks.
    words = text.split()
    same = bytes(a == b for a, b in zip(words, words[1:]))  # noqa: B905  pairs of neighbours
    for i, pattern in enumerate(REPEATS):
        if pattern in same:
            flags[i] = True
    return np.flatnonzero(flags)


def ratios(rows: list[tuple[int, int, int]], alpha: float = 1.0) -> np.ndarray:
    """Log-count ratio of each feature, from rows (feature, texts of label 1, texts of label 0)."""
    pos, neg = np.full(WIDTH, alpha), np.full(WIDTH, alpha)
    for k, p, q in rows:
        pos[k] += p
        neg[k] += q
    return np.log(pos / pos.sum()) - np.log(neg / neg.sum())


def scaled(index: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The values of a text's features: ratios, at unit length."""
    x = r[index]
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def descend(samples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of an L1-loss linear SVM by dual coordinate descent."""
    w, alpha = np.zeros(WIDTH + 1), np.zeros(len(samples))
    order, rng = np.arange(len(samples)), np.random.default_rng(seed)
    norm = np.array([float(x @ x) + 1.0 for _, x in samples])
    for _ in range(rounds):
        rng.shuffle(order)
        for i in order:
            index, x = samples[i]
            gradient = y[i] * (w[index] @ x + w[WIDTH]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[index] += step * x
                w[WIDTH] += step
                alpha[i] = new
    return w


def calibrate(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed targets (Platt)."""
    n1, n0 = positive.sum(), (~positive).sum()
    t = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = g @ margin + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (s * margin) @ margin + 1e-3, s @ margin, s.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def fit(samples: list[np.ndarray], labels: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Feature weights, and calibration of the margins by two-fold cross-fitting."""
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.array([(y == v).mean() for v in (-1.0, 1.0)])
    cost = np.where(y > 0, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9))
    rows = [(i, scaled(i, r)) for i in samples]
    margin = np.zeros(len(rows))
    half = np.arange(len(rows)) % 2
    for k in (0, 1):
        at, to = np.flatnonzero(half != k), np.flatnonzero(half == k)
        if len(at) and len(to):
            w = descend([rows[i] for i in at], y[at], cost[at])
            margin[to] = [w[rows[i][0]] @ rows[i][1] + w[WIDTH] for i in to]
    a, b = calibrate(margin, y > 0)
    return descend(rows, y, cost), a, b


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 6000) -> dict | None:
    """The model, or None without labelled rows; score_quality() takes it.

    docs and labels share id_col; labels other than 0 and 1, null ids and null labels are passed
    over. With one class only, or without texts of both, every text gets the smoothed share of label 1
    as its score.
    ``most_rows`` bounds the rows of the descent: all when there are fewer, else those with the
    least hashes of id and text, about that many and never twice as many, should one id repeat
    without end. Every training row counts for the ratios.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counted = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counted.values())
    if not total:
        return None
    if len(counted) < 2:
        return {"constant": (counted.get(1, 0) + 1) / (total + 2)}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(common.small(known, total), "id").select("y", "text", "id")
    if total > common.BROADCAST_ROWS:  # the join shuffles texts: once, and not for counts and sample each
        texts, _ = common.written(texts, "labelled")

    def counts(it):
        by = np.zeros((2, WIDTH), np.int64)
        for batch in it:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by[y, grams(text)] += 1
        at = np.flatnonzero(by.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(by[1, at]), pa.array(by[0, at])], names=["k", "p", "q"])

    summed = texts.select("y", "text").mapInArrow(counts, "k long, p long, q long").groupBy("k").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    r = ratios([tuple(x) for x in summed.collect()])  # at most WIDTH rows
    sent = spark.sparkContext.broadcast(r.astype(np.float32))

    part = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    picked = texts.select("y", "text", part.alias("part"))
    if total > most_rows:  # rare labels are kept at a higher rate, at most half of the sample each
        rate = {y: min(1.0, most_rows / 2 / n) for y, n in counted.items()}
        picked = picked.filter(F.when(F.col("y") == 1, F.col("part") < rate[1]).otherwise(F.col("part") < rate[0]))

    def indexed(it):
        for batch in it:
            rows = zip(*(batch.column(c).to_pylist() for c in ("y", "text", "part")), strict=True)
            yield from common.batches(([y, grams(t).astype(np.int32), p] for y, t, p in rows), schema)

    schema = pa.schema([("y", pa.int32()), ("at", pa.list_(pa.int32())), ("part", pa.float64())])

    def fitted(it):
        samples, y = [], []
        for batch in it:
            y += batch.column("y").to_pylist()
            column = batch.column("at")
            values, ends = column.flatten().to_numpy(), np.cumsum([len(x) for x in column])
            samples += np.split(values, ends[:-1])
        if len(set(y)) < 2:
            return
        order = sorted(range(len(y)), key=lambda i: (y[i], len(samples[i]), samples[i].tobytes()))
        weights, a, b = fit([samples[i] for i in order], np.array(y)[order], sent.value)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([a]), pa.array([b])], names=["w", "a", "b"])

    # One partition: the bounded sample, as feature numbers. Where one id and text repeat without
    # end, the order makes the limit keep equal rows in each run.
    picked = picked.mapInArrow(indexed, "y int, at array<int>, part double").orderBy("part", "y").limit(2 * most_rows)
    one = picked.select("y", "at").mapInArrow(fitted, "w binary, a double, b double").first()
    if one is None:
        return {"constant": (counted[1] + 1) / (total + 2)}
    return {"r": sent, "w": np.frombuffer(one["w"], np.float32), "a": one["a"], "b": one["b"]}


def score_quality(docs: DataFrame, model: dict | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; higher means that label 1 is likelier.

    Reads whole texts. Null and empty texts have no features: the bias alone scores them. Without
    a model (no labelled rows) each score is 0.5. Equal texts get equal scores. A column of docs
    called score_col is replaced; all others stay.
    """
    docs = docs.drop(score_col)
    if model is None or "constant" in model:
        return docs.withColumn(score_col, F.lit(0.5 if model is None else model["constant"]))
    spark = docs.sparkSession
    common.small_batches(spark)
    weights = spark.sparkContext.broadcast((model["w"][:WIDTH], float(model["w"][WIDTH])))
    ratio, a, b = model["r"], model["a"], model["b"]

    def scores(it):
        w, bias = weights.value
        r = ratio.value
        wr = (w * r).astype(np.float64)
        rr = (r * r).astype(np.float64)
        for batch in it:
            out = []
            for text in batch.column(text_col).to_pylist():
                i = grams(text)
                m = wr[i].sum() / max(float(np.sqrt(rr[i].sum())), 1e-9) + bias
                out.append(float(1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(scores, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def held_out(key: str | Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves ``part`` modulo ``parts``; a null key counts as ''."""
    return common.crc_of(key) % parts == part

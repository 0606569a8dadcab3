"""Language of documents that may mix several.

Method (after Lui, Lau and Baldwin, "Automatic detection and language identification of
multilingual documents", TACL 2014): each language has an n-gram model; a document's words are
drawn from a mixture of languages; expectation-maximisation estimates the proportions from the
words' n-gram likelihoods. The set of languages grows from the best single one: another joins
while it raises the likelihood by more than a penalty per language.

Models are counts of hashed n-grams by language, added up over all training documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from lensmill.llm import common

#: Hashed n-grams of 1 to 3 letters, with marks at the ends of words.
WIDTH = 1 << 15
#: Languages that a model can have; its size is WIDTH numbers for each. More are an error.
MOST_LANGUAGES = 500
#: Penalty on the log-likelihood for each language, times the log of the number of words.
PENALTY = 3.0
#: Characters of a text that are looked at together.
CHUNK = 1 << 20


def letters(text: str) -> np.ndarray:
    """Code points in lower case, anything but letters as 0: one at each end, one between words."""
    low = text.lower()
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = (c >= 97) & (c <= 122)
    if (high := np.flatnonzero(c > 127)).size:
        keep[high] = [low[i].isalpha() for i in high.tolist()]
    c = np.concatenate([[0], np.where(keep, c, 0), [0]])
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])].astype(np.uint64)


def grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams in the order of their last letter, three per letter, and each word's first row."""
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[np.uint64(0)], c[:-1]])
    after = np.concatenate([c[1:], [np.uint64(0)]])
    at = np.flatnonzero(c)
    one, two, three = c[at], before[at] << np.uint64(21) | c[at], before[at] << np.uint64(42) | c[at] << np.uint64(21) | after[at]
    salt = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = np.stack([common.mix(one + salt), common.mix(two + salt * np.uint64(3)), common.mix(three + salt * np.uint64(5))], axis=1)
    first = np.flatnonzero(before[at] == 0) * 3
    return (h & np.uint64(WIDTH - 1)).astype(np.int64).ravel(), first


def pieces(text: str):
    """The text in pieces of about CHUNK characters that end between words where they can."""
    start = 0
    while start < len(text):
        end = start + CHUNK
        if end < len(text):
            cut = max(text.rfind(" ", start + CHUNK // 2, end), text.rfind("\n", start + CHUNK // 2, end))
            end = cut if cut > start else end
        yield text[start:end]
        start = end


def word_scores(text: str, logp: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word (row) in each language (column)."""
    rows = []
    for piece in pieces(text):
        h, first = grams(letters(piece))
        if len(h):
            rows.append(np.add.reduceat(logp[h], first, axis=0))
    return np.concatenate(rows) if rows else np.zeros((0, logp.shape[1]), np.float32)


def proportions(s: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Mixture weights of the columns of likelihoods, by expectation-maximisation, and the log-likelihood."""
    top = s.max(axis=1, keepdims=True)
    p = np.exp(s - top)
    theta = np.full(s.shape[1], 1 / s.shape[1])
    for _ in range(rounds):
        mixed = p @ theta
        new = theta * ((1 / mixed) @ p) / len(p)
        done = np.abs(new - theta).max() < 1e-4
        theta = new
        if done:
            break
    return theta, float(np.log(p @ theta).sum() + top.sum())


def mixture(s: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The languages of a text, from its words' scores, and their proportions."""
    single = s.sum(axis=0)
    chosen, theta = [int(np.argmax(single))], np.ones(1)
    have = float(single[chosen[0]])
    penalty = PENALTY * np.log(len(s) + 1)
    while len(chosen) < s.shape[1]:
        # Candidates by how much better than the chosen ones they explain the words that they explain best.
        with_chosen = s[:, chosen].max(axis=1, keepdims=True)
        gain = np.maximum(s - with_chosen, 0).sum(axis=0)
        gain[chosen] = -1
        k = int(np.argmax(gain))
        if gain[k] <= penalty:  # no mixture with it can gain more
            break
        new, likelihood = proportions(s[:, [*chosen, k]])
        if likelihood - have <= penalty:
            break
        chosen, theta, have = [*chosen, k], new, likelihood
    return chosen, theta


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: languages (sorted) and log-probabilities of n-grams. Null texts and languages are passed over."""
    spark = docs.sparkSession
    common.small_batches(spark)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def counts(it):
        by: dict[str, np.ndarray] = {}
        for batch in it:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in by:
                    if len(by) >= MOST_LANGUAGES:
                        raise ValueError(f"more than {MOST_LANGUAGES} languages")
                    by[lang] = np.zeros(WIDTH, np.int64)
                for piece in pieces(text):
                    by[lang] += np.bincount(grams(letters(piece))[0], minlength=WIDTH)
        for lang, n in by.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int64()), pa.array([0, *n[at].tolist()], pa.int64())], names=["lang", "k", "n"])

    summed = known.mapInArrow(counts, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))

    def packed(table: pa.Table) -> pa.Table:  # at most WIDTH + 1 rows a language
        n, k = np.zeros(WIDTH, np.int64), table.column("k").to_numpy()
        n[k[k >= 0]] = table.column("n").to_numpy()[k >= 0]
        return pa.table({"lang": [table.column("lang")[0].as_py()], "counts": pa.array([n.tobytes()], pa.binary())})

    rows = summed.groupBy("lang").applyInArrow(packed, "lang string, counts binary").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    by = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    langs = sorted(by)
    if not langs:
        return {"langs": [], "logp": None}
    table = np.stack([by[x] for x in langs], axis=1)
    background = table.sum(axis=1, keepdims=True) + 0.5
    background /= background.sum()
    logp = np.log((table + 200 * background) / (table.sum(axis=0) + 200))
    return {"langs": langs, "logp": spark.sparkContext.broadcast(logp.astype(np.float32))}


def identify(docs: DataFrame, model: dict, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and proportions.

    lang_pred is the learned language with the largest proportion of the words (of equal ones the
    first in code point order), or ``und`` for texts that are null or have no letter, and for all
    texts when the model has no language. score is that proportion (0 for ``und``), proportions a
    map of the languages found. Whole texts are read. Equal texts get equal results. New columns
    replace columns of docs that have their names; the others stay. Empty in, empty out.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in ("lang_pred", "score", "proportions") if c != text_col])
    langs, sent = model["langs"], model["logp"]
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("proportions", MapType(StringType(), DoubleType()))])
    names = schema.names
    kinds = [pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64())]

    def found(it):
        for batch in it:
            preds, scores, shares = [], [], []
            for text in batch.column(text_col).to_pylist():
                s = word_scores(text, sent.value) if text and langs else ()
                if not len(s):
                    preds.append("und")
                    scores.append(0.0)
                    shares.append([])
                    continue
                chosen, theta = mixture(s)
                order = sorted(range(len(chosen)), key=lambda i: (-theta[i], chosen[i]))
                preds.append(langs[chosen[order[0]]])
                scores.append(min(1.0, max(0.0, float(theta[order[0]]))))
                shares.append([(langs[chosen[i]], float(theta[i])) for i in order])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip((preds, scores, shares), kinds, strict=True))], names=names)

    return docs.mapInArrow(found, schema)


def held_out(key: str | Column) -> Column:
    """Whether crc32 of the key as text leaves 2 modulo 4."""
    return common.crc_of(key) % 4 == 2

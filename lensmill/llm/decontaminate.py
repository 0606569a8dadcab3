"""Benchmark decontamination by SimHash windows and exact weighted shingles.

Method: a text is read as windows of words that have the size of a benchmark item, at every word;
a text shorter than the item is one window.
Candidates are verified by the shared weight of five-word shingles, weighted by inverse document
frequency over all documents. Each window has a 64-bit SimHash of its words (Charikar, 2002), but
no radius under 64 bits keeps every window of a given similarity: with a fifth of its words
replaced a copy is some 12 bits away, often more. So fingerprints drop nothing. An item is a
candidate where its shingles in the text can reach the similarity, which an inverted index of
shingles tells, and so is each of its windows; the best one's distance is reported.

Texts that hold no shingle of any item cannot pass verification. Most documents are such, and are
read once, with no more than look-ups of their words.

The benchmark is the stated query set: it is read in blocks of at most BLOCK_WORDS words, one
broadcast index after the other. Documents are neither shuffled nor joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructType

from lensmill.llm import common

BLOCK_WORDS = 500_000
#: Sums in another order differ by less.
ROUNDING = 1e-9
#: Letters of scripts without spaces between words (Thai to Myanmar, Khmer, kana, ideographs): each is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED_LETTER = re.compile(f"[{UNSPACED}]")
TOKEN = re.compile(r"\w+")
UNSPACED_TOKEN = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")


def tokens(text: str | None) -> list[str]:
    """Words in lower case without punctuation."""
    if not text:
        return []
    low = text.lower()
    return (TOKEN if low.isascii() or not UNSPACED_LETTER.search(low) else UNSPACED_TOKEN).findall(low)


def hashed(words: list[str], hashes: common.WordHashes) -> np.ndarray:
    return hashes.of([w.encode("utf-8", "surrogatepass") for w in words])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words at each place; nothing for fewer words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
            h ^= h >> np.uint64(31)
    return common.mix(h)


def signs(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64 numbers, 1 or -1, by the bits of each word's hash."""
    bits = np.unpackbits(common.mix(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit SimHashes from rows of summed signs; a sum of 0 gives a 1."""
    return np.packbits(sums >= 0, axis=1).view(np.uint64).ravel()


class Items:
    """The index over one block of items."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        hashes = common.WordHashes()
        said = [(k, tokens(text)) for k, text in items]
        kept = [(k, hashed(w, hashes)) for k, w in said if w]
        #: Hashes of the words of the items; no other word can be in a shared shingle.
        self.known = {w: hashes[w.encode("utf-8", "surrogatepass")] for _, each in said for w in each}
        self.ids = [k for k, _ in kept]
        self.lengths = np.array([len(h) for _, h in kept], np.int64)
        #: Words of an item's shingles: fewer where the item has fewer.
        self.widths = np.minimum(self.lengths, words)
        self.sets = [np.unique(grams(h, int(n))) for (_, h), n in zip(kept, self.widths, strict=True)]
        self.each_width = sorted(set(self.widths.tolist()))
        self.vocabulary = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        self.prints = fingerprints(np.stack([signs(h).sum(axis=0) for _, h in kept])) if kept else np.zeros(0, np.uint64)
        #: The items that have each shingle of the vocabulary, one after the other.
        held = [self.places(each) for each in self.sets]
        order = np.argsort(np.concatenate([*held, np.zeros(0, np.int64)]), kind="stable")
        self.owners = np.repeat(np.arange(len(held)), [len(each) for each in held])[order]
        self.starts = np.searchsorted(np.concatenate([*held, np.zeros(0, np.int64)])[order], np.arange(len(self.vocabulary) + 1))
        self.set_weights(np.ones(len(self.vocabulary)))

    def set_weights(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.totals = np.array([weights[self.places(each)].sum() for each in self.sets], np.float64)

    def weigh(self, documents: int, frequency: dict[int, int]) -> None:
        """Sets inverse document frequencies; frequency: documents by place in the vocabulary."""
        df = np.zeros(len(self.vocabulary))
        for k, v in frequency.items():
            df[k] = v
        self.set_weights(np.log((documents + 1) / (df + 1)) + 1.0)

    def places(self, shingled: np.ndarray) -> np.ndarray:
        """Place in the vocabulary of each shingle, or -1."""
        if not len(self.vocabulary):
            return np.full(len(shingled), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, shingled), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == shingled, at, -1)

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First words of the text's shingles that an item has, and these shingles' places in the vocabulary."""
        h = np.fromiter(map(self.known.get, words, repeat(0)), np.uint64, len(words))
        inside = h != 0
        ends = np.concatenate([[0], np.cumsum(inside)])
        firsts, shared = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.each_width if ends[-1] else ():
            at = np.flatnonzero(ends[n:] - ends[:-n] == n)
            if len(at):
                g = np.zeros(len(at), np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(n):  # as grams() does, only at these places
                        g = g * np.uint64(0x9E3779B97F4A7C15) + h[at + i]
                        g ^= g >> np.uint64(31)
                found = self.places(common.mix(g))
                firsts.append(at[found >= 0])
                shared.append(found[found >= 0])
        if len(firsts) < 3:
            return firsts[-1], shared[-1]
        at = np.concatenate(firsts)
        order = np.argsort(at, kind="stable")
        return at[order], np.concatenate(shared)[order]

    def similarity(self, shingled: np.ndarray, item: int) -> float:
        """Share of the item's shingle weight that is among these shingles."""
        w = self.weights[np.searchsorted(self.vocabulary, self.sets[item])]
        return float(w[np.isin(self.sets[item], shingled)].sum() / w.sum())

    def matches(self, text: str | None, least: float, known: common.WordHashes) -> dict[int, tuple[float, int, int]]:
        """The best window of each item that reaches ``least``: similarity, first word, distance."""
        words = tokens(text)
        at, places = self.hits(words)
        best: dict[int, tuple[float, int, int]] = {}
        if not len(at):
            return best
        # Items that the shingles of the whole text could lift to least; no others have such a window.
        shared = np.unique(places)
        count = self.starts[shared + 1] - self.starts[shared]
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner = self.owners[np.repeat(self.starts[shared], count) + offset]
        weight = np.bincount(owner, np.repeat(self.weights[shared], count), len(self.ids))
        for k in np.flatnonzero((weight > 0) & (weight >= least * self.totals - ROUNDING)).tolist():
            mine = self.places(self.sets[k])
            held = np.isin(places, mine)
            first, place = at[held], places[held]
            size, span = int(self.lengths[k]), int(self.lengths[k] - self.widths[k])
            # A window changes where a shingle enters or leaves it; of equal windows the first counts.
            starts = np.unique(np.clip(np.concatenate([first - span, first + 1, [0]]), 0, max(len(words) - size, 0)))
            lo, hi = np.searchsorted(first, starts), np.searchsorted(first, starts + span, "right")
            sums = np.concatenate([[0.0], np.cumsum(self.weights[place])])
            bound = (sums[hi] - sums[lo]) / self.totals[k]
            top = (least, -len(words))
            for i in np.lexsort((starts, -bound)).tolist():
                if bound[i] < top[0] - ROUNDING:
                    break
                w = self.weights[mine]
                score = float(w[np.isin(mine, place[lo[i] : hi[i]])].sum() / w.sum())
                top = max(top, (score, -int(starts[i])))
            if top[1] > -len(words):
                s = -top[1]
                a = fingerprints(signs(hashed(words[s : s + size], known)).sum(axis=0)[None, :])[0]
                best[k] = (top[0], s, int(np.bitwise_count(a ^ self.prints[k])))
        return best


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of at most BLOCK_WORDS words (or one item), by id; nulls are left out."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    held, total = [], 0
    for row in rows.orderBy("id", "text").toLocalIterator():
        size = len(row["text"]) // 2 + 1  # no text has more words than that
        if held and total + size > BLOCK_WORDS:
            yield held
            held, total = [], 0
        held.append((row["id"], row["text"]))
        total += size
    if held:
        yield held


def first_pass(docs: DataFrame, index: Items, text_col: str, keep: str | None):
    """Document frequencies of the index's shingles over all of docs, and the documents with any.

    Each task adds up its own counts, so what is gathered has at most as many rows as the
    vocabulary. The documents (id and text) are kept only if ``keep`` names their id.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(index)
    columns = [F.col(text_col).alias("text"), *([F.col(keep).alias("doc")] if keep else [])]
    source = docs.select(*columns)
    kind = source.schema["doc"].dataType if keep else IntegerType()
    id_type = to_arrow_type(kind)

    def read(it):
        index = sent.value
        df, n = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in it:
            held, texts = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                n += 1
                _, places = index.hits(tokens(text))
                if len(places):
                    df[np.unique(places)] += 1
                    if keep:
                        held.append(i)
                        texts.append(text)
            if held:
                blank = pa.nulls(len(held), pa.int64())
                yield pa.RecordBatch.from_arrays([blank, blank, batch.column("doc").take(pa.array(held)), pa.array(texts, pa.string())], names=["k", "n", "doc", "text"])
        at = np.flatnonzero(df)
        k = pa.array([-1, *at.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([k, pa.array([n, *df[at].tolist()], pa.int64()), pa.nulls(len(k), id_type), pa.nulls(len(k), pa.string())], names=["k", "n", "doc", "text"])

    rows = source.mapInArrow(read, f"k long, n long, doc {kind.simpleString()}, text string")
    if keep:
        rows, _ = common.written(rows, "hits")
    counts = rows.filter("k is not null").groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    sent.destroy()  # all that used it is written or collected
    by = {r["k"]: r["n"] for r in counts}
    index.weigh(by.pop(-1, 0), by)
    return spark.sparkContext.broadcast(index), rows.filter("k is null").select("doc", "text") if keep else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document and benchmark item that it holds a copy of.

    Columns: id_col, item_id (both as in the tables), similarity (0 to 1, the share of the item's
    shingle weight), first_word (the best window's place; the first of equal ones), n_words (of the
    item; a shorter text is one window) and distance (bits by which the fingerprints differ). Letter case and punctuation do not count.

    Words are runs of letters, digits and underscores; in scripts without spaces each letter is a
    word. An item of fewer words than a shingle is one shingle: it is found where all its words
    stand in a row. Whole texts are read. Null and empty texts hold nothing; items that are null
    or without words match nothing, so without usable items the result is empty. Items with the
    same text are all reported. Repeated documents are reported as often as they occur, null ids
    included. Other columns are not read.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType
    schema = f"`{id_col}` {kind}, item_id {item_kind.simpleString()}, similarity double, first_word long, n_words long, distance long"
    item_type, out = to_arrow_type(item_kind), None
    for block in item_blocks(benchmark, item_id, item_text):
        sent, candidates = first_pass(docs, Items(block, words), text_col, id_col)

        def found(it, sent=sent):
            index, hashes = sent.value, common.WordHashes()
            for batch in it:
                rows = []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for k, (score, first, apart) in sorted(index.matches(text, least, hashes).items()):
                        rows.append((i, index.ids[k], score, first, int(index.lengths[k]), apart))
                if rows:
                    at, *rest = zip(*rows, strict=True)
                    doc, (items, *numbers) = batch.column("doc").take(pa.array(at)), rest
                    yield pa.RecordBatch.from_arrays([doc, pa.array(items, item_type), *(pa.array(c) for c in numbers)], names=[id_col, "item_id", "similarity", "first_word", "n_words", "distance"])

        part = candidates.mapInArrow(found, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """docs without the rows in which find_leaks() finds an item.

    All columns and all other rows stay, null and empty texts, repeated rows and columns of any
    name among them. Without items all of docs stays. Empty in, empty out.
    """
    # All blocks weigh by the same documents, so weights do not depend on how items fall into blocks.
    indexes = [first_pass(docs, Items(block, words), text_col, None)[0] for block in item_blocks(benchmark, item_id, item_text)]
    for sent in indexes:

        def clean(it, sent=sent):
            index, hashes = sent.value, common.WordHashes()
            for batch in it:
                yield batch.filter(pa.array([not index.matches(t, least, hashes) for t in batch.column(text_col).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, StructType(docs.schema.fields))
    return docs

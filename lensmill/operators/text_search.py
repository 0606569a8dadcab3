"""Full-text search over an inverted index that is a table of (token, document).

A text becomes distinct lower-case tokens without diacritics (runs of letters and digits). A
search reads the tokens it needs: an equality or a range of tokens, which a table sorted or
partitioned by token answers without reading the rest.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Distinct tokens. Accents that Unicode writes as marks of their own are dropped."""
    plain = F.regexp_replace(F.lower(text), r"\p{M}+", "")
    return F.filter(F.array_distinct(F.split(plain, TOKEN_BREAK)), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    """Tokens of a user's text, in order, without repeats."""
    plain = re.sub(r"\s+", " ", "".join(c for c in text.lower() if unicodedata.category(c)[0] != "M"))
    return list(dict.fromkeys(t for t in re.split(r"[^\w]+|_", plain) if t))


def index(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(token, key) rows of all given columns; nulls hold no tokens."""
    text = F.concat_ws(" ", *[F.col(c) for c in columns])
    return df.select(F.explode(tokens(text)).alias("token"), F.col(key))


def stored(idx: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """The index as a table whose files are ranges of tokens, sorted inside.

    It is made once. A search for a token or a prefix then reads the row groups whose range of
    tokens holds it, by their statistics, and no text at all.
    """
    ranged = idx.repartitionByRange(parts, "token") if parts else idx.repartitionByRange("token")
    ranged.sortWithinPartitions("token").write.mode("overwrite").parquet(path)
    return idx.sparkSession.read.schema(idx.schema).parquet(path)


def prefix_or(idx: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of documents with a token that starts with any of the text's tokens; none for a blank text."""
    wanted = query_tokens(text)
    hit = F.lit(False)
    for w in wanted:
        hit = hit | ((F.col("token") >= w) & (F.col("token") < w + "\U0010ffff"))
    return idx.filter(hit).select(key).distinct()


def token_and(idx: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of documents that have all the text's tokens."""
    wanted = query_tokens(text)
    hits = idx.filter(F.col("token").isin(wanted)).groupBy(key).agg(F.count_distinct("token").alias("n_"))
    return hits.filter(F.col("n_") == len(wanted)).select(key) if wanted else hits.select(key).limit(0)


def document_frequency(idx: DataFrame) -> DataFrame:
    return idx.groupBy("token").agg(F.count("*").alias("documents"))


def search(df: DataFrame, hits: DataFrame, key: str, *conditions: Column) -> DataFrame:
    """The rows of the hits that meet all conditions; leave out what the user left open."""
    for c in conditions:
        df = df.filter(c)
    return df.join(hits, key, "left_semi")

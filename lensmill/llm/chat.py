"""Chat formatting with loss masks aligned by offsets.

A whole conversation is rendered to one text and encoded once, with the offsets of its tokens.
The spans of the turns are sorted, and so are the tokens: binary search gives the tokens of each
turn that is to be learnt. Markers around roles and texts are special tokens of their own, so no
token lies across the end of a turn.

Control strings inside texts and roles are escaped: the escape character after their first letter
keeps them from being read as markers, and a string that holds it already gets one more, so the
original text always comes back.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.llm import common

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates in public use give a meaning; fixed values.
CONTROLS = (START, MIDDLE, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>")
ESCAPE = "\\"
_ANY = "|".join(f"{re.escape(c[0])}(?={re.escape(ESCAPE)}*{re.escape(c[1:])})" for c in CONTROLS)
_TO = re.compile(f"({_ANY})")
_FROM = re.compile("|".join(f"(?<={re.escape(c[0])}){re.escape(ESCAPE)}(?={re.escape(ESCAPE)}*{re.escape(c[1:])})" for c in CONTROLS))
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(END)}", re.DOTALL)
#: Texts of conversations that are encoded together.
TOGETHER = 64


def escape(text: str) -> str:
    return _TO.sub(lambda m: m[1] + ESCAPE, text)


def unescape(text: str) -> str:
    return _FROM.sub("", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        at += len(head)
        spans.append((at, at + len(body)))
        parts += [head, body, END]
        at += len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the sorted, disjoint spans; token starts and ends are sorted."""
    out = np.zeros(len(starts), bool)
    for lo, hi in spans:
        out[np.searchsorted(starts, lo, "left") : np.searchsorted(ends, hi, "right")] |= lo < hi
    return out


def learnt(formatted: str, starts: np.ndarray, ends: np.ndarray, under: np.ndarray) -> list[str]:
    """The texts under the mask, one for each run of tokens, with escapes undone."""
    at = np.flatnonzero(under)
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
    return [unescape(formatted[starts[r[0]] : ends[r[-1]]]) for r in runs]


def load(described: str):
    """A tokenizer of the tokenizers library from its JSON, with the markers as special tokens."""
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_str(described)
    tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, MIDDLE, END)])
    return tokenizer


def conversations(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    """Conversations from batches that are sorted by conversation and turn."""
    key, turns = None, []
    for batch in it:
        for k, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
            if k != key and turns:
                yield key, turns
                turns = []
            key = k
            turns.append((role or "", text or ""))
    if turns:
        yield key, turns


def format_chats(
    turns: DataFrame,
    *,
    tokenizer: str,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: conv_col, formatted, token_ids, token_starts, token_ends, loss_mask.

    Offsets count code points of ``formatted``. loss_mask marks the tokens of the texts of the
    roles in ``learn``, without markers. Rows of a conversation are taken by turn, null first;
    equal turns by role, then text, and repeated rows stay. Null roles and texts count as empty;
    rows without a conversation id form one conversation. Other columns are not read. An empty
    table gives an empty table. A conversation is one row, so it must fit into a task's memory.

    ``tokenizer`` is the path of a tokenizer description that the driver can read; the executors
    get its contents.
    """
    spark = turns.sparkSession
    common.small_batches(spark)
    described = spark.sparkContext.broadcast(Path(tokenizer).read_text())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), F.col(turn_col).alias("turn"))
    rows = rows.repartition(parts, "conv").sortWithinPartitions(F.col("conv"), F.col("turn"), F.col("role"), F.col("text"))
    kind = rows.schema["conv"].dataType.simpleString()
    schema = pa.schema([(conv_col, pa.null()), ("formatted", pa.string()), *((c, pa.list_(pa.int32())) for c in ("token_ids", "token_starts", "token_ends")), ("loss_mask", pa.list_(pa.bool_()))])

    def encoded(it):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = load(described.value)
        first = next(it, None)
        if first is None:
            return
        typed = schema.set(0, pa.field(conv_col, first.schema.field(0).type))

        def chain():
            yield first
            yield from it

        def some(held):
            made = encode.encode_batch([f for _, f, _ in held], add_special_tokens=False)
            for (key, formatted, spans), e in zip(held, made, strict=True):
                offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                starts, ends = offsets[:, 0], offsets[:, 1]
                yield [key, formatted, np.array(e.ids, np.int32), starts, ends, mask(spans, starts, ends)]

        def rows():
            held = []
            for key, turns in conversations(chain()):
                formatted, spans = render(turns)
                held.append((key, formatted, [s for s, (role, _) in zip(spans, turns, strict=True) if role in learn]))
                if len(held) == TOGETHER:
                    yield from some(held)
                    held = []
            yield from some(held)

        yield from common.batches(rows(), typed, 200)

    return rows.select("conv", "role", "text").mapInArrow(encoded, f"`{conv_col}` {kind}, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>")


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the outputs of format_chats() say when they are read back, as digests."""
    kind = chats.schema[conv_col].dataType.simpleString()

    def read(it):
        import hashlib

        for batch in it:
            out = []
            for formatted, starts, ends, under in zip(*(batch.column(c) for c in ("formatted", "token_starts", "token_ends", "loss_mask")), strict=True):
                formatted = formatted.as_py()
                turns = read_back(formatted)
                loss = "".join(learnt(formatted, starts.values.to_numpy(), ends.values.to_numpy(), under.values.to_numpy(zero_copy_only=False)))
                turned = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((len(turns), hashlib.sha256(turned.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted), len(starts.values)))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(conv_col), *(pa.array(c) for c in zip(*out, strict=True))], names=[conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])

    return chats.mapInArrow(read, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")

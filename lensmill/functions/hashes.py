"""Content, path and identity hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\u001f"


def content_hash(content: Column) -> Column:
    """SHA-256 of the whole content."""
    return F.sha2(content, 256)


def head_fingerprint(content: Column) -> Column:
    """SHA-256 of the first 4 KiB."""
    return F.sha2(F.substring(content.cast("binary"), 1, 4096), 256)


def path_key(path: Column) -> Column:
    return F.sha2(path, 256)


def short_path_hash(path: Column) -> Column:
    """The first 8 bytes of the path's hash, as hexadecimal text."""
    return F.left(F.sha2(path, 256), F.lit(16))


def space_id(provider: Column, model: Column, version: Column, dimension: Column, codec: Column, form: Column) -> Column:
    """Identity of a vector space: vectors of unlike ids are never compared."""
    fields = [c.cast("string") for c in (provider, model, version, dimension, codec, form)]
    return F.concat(F.lit("sem:"), F.sha2(F.concat_ws(UNIT, *fields), 256))


def name_uuid(name: Column) -> Column:
    """UUID of version 3 (MD5 of a name without a name space)."""
    h = F.md5(name)
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(F.lit(8) + F.pmod(digit, F.lit(4))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def fnv1a(texts: list[str], seed: int = 0) -> np.ndarray:
    """64-bit FNV-1a of UTF-8 bytes, as unsigned numbers, for all texts at once: a step for each byte place."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-size, kind="stable")  # the texts that still have a byte are the first ones
    first = np.concatenate([[0], np.cumsum(size)[:-1]])[order] if len(raw) else size
    joined, size = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), size[order]
    h = np.full(len(raw), (0xCBF29CE484222325 ^ seed) & (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, "left"))
            h[:n] = (h[:n] ^ joined[first[:n] + i]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a_priority(path: Column, seed: int = 0) -> Column:
    """FNV-1a of the path's UTF-8 bytes with the sign bit flipped: signed numbers in the order of the unsigned hashes."""

    @F.pandas_udf("long")
    def priority(paths: pd.Series) -> pd.Series:
        known = paths.notna().to_numpy()
        out = pd.Series(pd.NA, index=paths.index, dtype="Int64")
        out[known] = (fnv1a(paths[known].tolist(), seed) ^ np.uint64(1 << 63)).view(np.int64)
        return out

    return priority(path)

"""Media files as tables: scans, roots, ignore rules, types, EXIF."""

from __future__ import annotations

import json
import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.functions import dates, strings

# MIME types by extension, images then videos, and directories that scans skip.
IMAGES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "heic": "image/heic", "heif": "image/heif", "tif": "image/tiff", "tiff": "image/tiff"}
VIDEOS = {"mp4": "video/mp4", "mkv": "video/x-matroska", "mov": "video/quicktime", "avi": "video/x-msvideo", "webm": "video/webm", "3gp": "video/3gpp", "m4v": "video/x-m4v", "ts": "video/mp2ts", "flv": "video/x-flv"}
IGNORED = ("thumbnails", "cache", "tmp", "temp", "lost+found", "recycle", "trash")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root: path, modificationTime, length. Contents are read only if a query asks."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def catalog(df: DataFrame, roots: list[str], patterns: list[str], path: str = "filePath", taken: str = "capturedAtMs") -> DataFrame:
    """Catalog rows under the roots whose name no pattern finds, newest first."""
    name = strings.base_name(F.col(path))
    return df.filter(under_roots(F.col(path), roots) & ~ignored_name(name, patterns)).orderBy(F.col(taken).desc(), F.col(path))


def normal_roots(roots: list[str]) -> list[str]:
    """Trimmed roots without trailing slashes, dots or repeats, in order."""
    out = []
    for r in roots:
        if r := r.strip():
            parts: list[str] = []
            for p in r.split("/"):
                if p == "..":
                    parts = parts[:-1]
                elif p not in ("", "."):
                    parts.append(p)
            out.append("/" + "/".join(parts))
    return list(dict.fromkeys(out))


def under_roots(path: Column, roots: list[str]) -> Column:
    """Whether a path is a root or lies below one; /a/bc does not lie below /a/b."""
    hit = F.lit(False)
    for r in normal_roots(roots):
        hit = hit | (path == r) | path.startswith("/" if r == "/" else r + "/")
    return hit


def ignored_name(name: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found in the name; patterns that are no regular expression are passed over."""
    hit = F.lit(False)
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        hit = hit | F.coalesce(name.rlike(p), F.lit(False))
    return hit


def visible(df: DataFrame, path: str, patterns: list[str] = ()) -> DataFrame:
    """Rows outside hidden and ignored directories and outside directories that hold ``.nomedia``, whose names no pattern finds."""
    p = F.col(path)
    parts = F.split(strings.parent_directory(p), "/")
    bad = F.exists(parts, lambda x: x.startswith(".") | F.lower(x).isin(*IGNORED))
    name = strings.base_name(p)
    closed = df.filter(name == ".nomedia").select(strings.parent_directory(p).alias("closed_")).distinct()
    rows = df.filter(~bad & (name != ".nomedia") & ~ignored_name(name, list(patterns)))
    from lensmill.operators.rollup import ancestors

    key = "path_of_row_"
    rows = rows.withColumn(key, p)
    hidden = rows.select(key, F.explode(ancestors(strings.parent_directory(p))).alias("closed_")).join(closed, "closed_", "left_semi").select(key).distinct()
    return rows.join(hidden, key, "left_anti").drop(key)


def media_type(name: Column) -> Column:
    """IMAGE, VIDEO or null, by the extension."""
    e = strings.extension(name)
    return F.when(e.isin(*IMAGES), "IMAGE").when(e.isin(*VIDEOS), "VIDEO")


def mime_type(name: Column) -> Column:
    """MIME type by the extension; application/octet-stream for others."""
    table = F.create_map(*[F.lit(x) for pair in (IMAGES | VIDEOS).items() for x in pair])
    return F.coalesce(F.try_element_at(table, strings.extension(name)), F.lit("application/octet-stream"))


# EXIF tags of interest.
EXIF_TAGS = {271: "make", 272: "model", 306: "date_time", 274: "orientation", 36867: "date_time_original", 36868: "date_time_digitized", 33437: "aperture", 37386: "focal_length", 34855: "iso", 33434: "exposure_time"}
EXIF_SCHEMA = "make string, model string, date_time string, orientation int, date_time_original string, date_time_digitized string, aperture double, focal_length double, iso int, exposure_time double, latitude double, longitude double"
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def read_exif(data: bytes | None) -> dict:
    """EXIF fields of a JPEG; what is missing or broken is left out."""
    out: dict = {}
    at = (data or b"").find(b"Exif\0\0")
    if at < 0:
        return out
    body = data[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(body[:2])
    if order is None:
        return out

    def directory(start: int) -> dict[int, tuple]:
        tags = {}
        (n,) = struct.unpack_from(order + "H", body, start)
        for i in range(min(n, 200)):
            tag, kind, count = struct.unpack_from(order + "HHI", body, start + 2 + 12 * i)
            size = _SIZES.get(kind, 0) * count
            if not size or size > len(body):
                continue
            place = start + 10 + 12 * i
            if size > 4:
                (place,) = struct.unpack_from(order + "I", body, place)
            raw = body[place : place + size]
            if kind == 2:
                tags[tag] = (raw.split(b"\0")[0].decode("utf-8", "replace").strip(),)
            elif kind in (5, 10):
                pairs = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
                tags[tag] = tuple(a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True))
            else:
                tags[tag] = struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 7: 'B', 9: 'i'}[kind] }", raw)
        return tags

    try:
        first = directory(struct.unpack_from(order + "I", body, 4)[0])
        tags = first | (directory(first[34665][0]) if 34665 in first else {})
        gps = directory(first[34853][0]) if 34853 in first else {}
    except (struct.error, IndexError):
        return out
    for tag, name in EXIF_TAGS.items():
        if tag in tags:
            out[name] = tags[tag][0]
    for name, ref, value, negative in (("latitude", 1, 2, "S"), ("longitude", 3, 4, "W")):
        if value in gps and len(gps[value]) == 3:
            d, m, s = gps[value]
            out[name] = (d + m / 60 + s / 3600) * (-1 if gps.get(ref, ("",))[0] == negative else 1)
    return out


def exif(content: Column) -> Column:
    """EXIF fields of file contents, as a struct."""

    @F.pandas_udf("string")
    def fields(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: json.dumps(read_exif(c)))

    return F.from_json(fields(content), EXIF_SCHEMA)


def exif_listing(e: Column) -> Column:
    """EXIF fields as lines of text, without those that are missing."""
    lines = [
        F.concat(F.lit("Camera: "), F.concat_ws(" ", e["make"], e["model"])),
        F.concat(F.lit("Aperture: f/"), F.format_string("%.1f", e["aperture"])),
        F.concat(F.lit("Exposure: "), F.when(e["exposure_time"] < 1, F.concat(F.lit("1/"), F.round(1 / e["exposure_time"]).cast("int").cast("string"))).otherwise(F.format_string("%.1f", e["exposure_time"])), F.lit(" s")),
        F.concat(F.lit("ISO: "), e["iso"].cast("string")),
        F.concat(F.lit("Focal length: "), F.format_string("%.1f", e["focal_length"]), F.lit(" mm")),
    ]
    shown = (e["make"].isNotNull() | e["model"].isNotNull(), e["aperture"].isNotNull(), e["exposure_time"] > 0, e["iso"].isNotNull(), e["focal_length"].isNotNull())
    return F.concat_ws("\n", *[F.when(c, line) for c, line in zip(shown, lines, strict=True)])


def media_rows(files: DataFrame, tz: str = "UTC") -> DataFrame:
    """Rows of the media table from scanned files with their contents."""
    name = strings.base_name(F.col("path"))
    rows = files.withColumn("fileName", name).filter(media_type(name).isNotNull()).withColumn("e_", exif(F.col("content")))
    mtime = F.unix_millis("modificationTime")
    captured = dates.captured_at(F.col("e_.date_time_original"), F.col("e_.date_time"), F.col("e_.date_time_digitized"), mtime=F.col("modificationTime"), tz=tz)
    return rows.select(
        F.col("path").alias("filePath"), "fileName", media_type(name).alias("mediaType"), F.unix_millis(captured).alias("capturedAtMs"), mtime.alias("modifiedAtMs"),
        strings.parent_directory(F.col("path")).alias("parentPath"), F.col("length").alias("fileSize"), mime_type(name).alias("mimeType"),
        "e_.make", "e_.model", "e_.latitude", "e_.longitude", "e_.aperture", "e_.iso", F.sha2(F.substring("content", 1, 4096), 256).alias("fingerprintHead"),
    )

"""TIFF media columns: one row per page of each file.

Reads classic and big files of either byte order: the chain of image directories, strips and
tiles, no compression, PackBits, LZW and deflate, the horizontal and the floating-point
predictor, 1 to 64 bits a sample, interleaved and separate planes. Also writes files, for tests
and for payloads that are kept as images. Files are decoded a page at a time in the task that
reads the row; nothing is shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from lensmill.llm import common

#: Fixed values of the format: bytes of each field type, and tag numbers.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, COLORS, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FORMAT, FILL_ORDER = 284, 317, 320, 322, 323, 324, 325, 339, 266
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


class TiffError(ValueError):
    """The file cannot be read."""


@dataclass
class Page:
    """One decoded page; samples are rows of interleaved samples in the machine's byte order."""

    width: int
    height: int
    samples: int
    bits: int
    format: int
    photometric: int
    compression: int
    predictor: int
    data: bytes


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits, up to ``size`` bytes."""
    out, i, have = [], 0, 0
    while i < len(data) and have < size:
        n = data[i]
        i += 1
        if n < 128:
            part = data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            part = data[i : i + 1] * (257 - n)
            i += 1
        else:
            continue
        out.append(part)
        have += len(part)
    return b"".join(out)[:size]


def pack_bits(row: bytes) -> bytes:
    """PackBits of one row: runs of 3 or more as repeats, the rest as literals."""
    a = np.frombuffer(row, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
    long = np.flatnonzero(np.diff(starts) >= 3)
    out, at = [], 0
    for lo, hi in [*((int(starts[k]), int(starts[k + 1])) for k in long), (len(row), len(row))]:
        while at < lo:
            n = min(128, lo - at)
            out.append(bytes([n - 1]) + row[at : at + n])
            at += n
        while at < hi:
            n = min(128, hi - at)
            out.append(bytes([(257 - n) & 255 if n > 1 else 0, row[at]]))
            at += n
    return b"".join(out)


def code_widths(most: int = 4094 - 257) -> np.ndarray:
    """Bits of the n-th code after a clear code, n from 0: one more from 511, 1023 and 2047 entries on."""
    entries = 258 + np.maximum(np.arange(most + 1) - 1, 0)
    return 9 + (entries >= 511).astype(np.int64) + (entries >= 1023) + (entries >= 2047)


LZW_WIDTHS = code_widths()
LZW_ENDS = np.cumsum(LZW_WIDTHS)
LZW_FIRST = [bytes([i]) for i in range(256)] + [b"", b""]


def unpack_lzw(data: bytes, size: int) -> bytes:
    """LZW as in TIFF 6.0 (high bits first, widths change one code early), up to ``size`` bytes."""
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, at, have, out = len(data) * 8, 0, 0, []
    while at + 9 <= total and have < size:
        fits = int(np.searchsorted(LZW_ENDS, total - at, "right"))
        starts = at + LZW_ENDS[:fits] - LZW_WIDTHS[:fits]
        byte = starts >> 3
        word = (padded[byte] << 16) | (padded[byte + 1] << 8) | padded[byte + 2]
        codes = (word >> (24 - (starts & 7) - LZW_WIDTHS[:fits]).astype(np.uint32)) & ((1 << LZW_WIDTHS[:fits]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        end = int(stop[0]) if len(stop) else fits
        table, before, entries, done = list(LZW_FIRST), b"", 258, len(out)
        for code in codes[:end].tolist():
            if code < entries:
                entry = table[code]
            elif code == entries and before:
                entry = before + before[:1]
            else:
                raise TiffError("LZW code out of range")
            if before:
                table.append(before + entry[:1])
                entries += 1
            out.append(entry)
            before = entry
        have += sum(map(len, out[done:]))
        if end >= fits or codes[end] == 257:
            break
        at += int(LZW_ENDS[end])
    return b"".join(out)[:size]


def pack_lzw(data: bytes) -> bytes:
    """LZW as unpack_lzw() reads it."""
    codes, clears = [256], [0]
    if data:
        table, entries, before = {}, 258, data[0]
        for byte in memoryview(data)[1:]:
            key = before << 8 | byte
            if key in table:
                before = table[key]
                continue
            codes.append(before)
            table[key] = entries
            entries += 1
            before = byte
            if entries >= 4094:
                clears.append(len(codes))
                codes.append(256)
                table, entries = {}, 258
        codes.append(before)
    codes.append(257)
    c, places = np.array(codes, np.int64), np.arange(len(codes))
    since = places - 1 - np.array(clears)[np.searchsorted(clears, places) - 1]  # codes after the last clear code
    w = np.where(places, LZW_WIDTHS[np.maximum(since, 0)], 9)
    bits = ((c[:, None] >> np.arange(11, -1, -1)) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12)[None, :] >= 12 - w[:, None]]).tobytes()


def unpacked(data: bytes, compression: int, size: int) -> bytes:
    """A strip or tile of ``size`` bytes; one that holds less is an error."""
    if compression == NONE:
        out = data[:size]
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression == LZW:
        out = unpack_lzw(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    else:
        raise TiffError(f"compression {compression} is not supported")
    if len(out) < size:
        raise TiffError(f"a strip or tile has {len(out)} of {size} bytes")
    return out


def packed(data: bytes, compression: int, row: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return b"".join(pack_bits(data[i : i + row]) for i in range(0, len(data), row))
    if compression == LZW:
        return pack_lzw(data)
    return zlib.compress(data, 1)


class Reader:
    """The image directories of one file. A page with more than ``most_bytes`` of samples is an error."""

    def __init__(self, data: bytes, most_bytes: int = 1 << 29):
        self.data, self.most_bytes = data, most_bytes
        if data[:2] not in (b"II", b"MM"):
            raise TiffError("not a TIFF file")
        self.order = "<" if data[:2] == b"II" else ">"
        version = self.number(2, "H")
        if version == 42:
            self.big, self.next = False, self.number(4, "I")
        elif version == 43 and self.number(4, "H") == 8:
            self.big, self.next = True, self.number(8, "Q")
        else:
            raise TiffError("not a TIFF file")

    def number(self, at: int, letter: str) -> int:
        try:
            return struct.unpack_from(self.order + letter, self.data, at)[0]
        except struct.error:
            raise TiffError("the file ends early") from None

    def directories(self) -> Iterator[dict[int, tuple]]:
        """The tags of each directory; a chain that meets itself ends."""
        seen = set()
        while self.next and self.next not in seen:
            seen.add(self.next)
            at = self.next
            count, at = (self.number(at, "Q"), at + 8) if self.big else (self.number(at, "H"), at + 2)
            step = 20 if self.big else 12
            if at + count * step > len(self.data):
                raise TiffError("the file ends early")
            tags = {}
            for i in range(count):
                e = at + i * step
                tag, kind = self.number(e, "H"), self.number(e + 2, "H")
                n = self.number(e + 4, "Q" if self.big else "I")
                if letter := LETTERS.get(kind):
                    size, room, place = n * SIZES[kind], 8 if self.big else 4, e + (12 if self.big else 8)
                    if size > room:
                        place = self.number(place, "Q" if self.big else "I")
                    if place + size > len(self.data):
                        raise TiffError("the file ends early")
                    tags[tag] = struct.unpack_from(f"{self.order}{n}{letter}", self.data, place)
            self.next = self.number(at + count * step, "Q" if self.big else "I")
            yield tags

    def pages(self) -> Iterator[Page]:
        for tags in self.directories():
            yield self.page(tags)

    def page(self, tags: dict[int, tuple]) -> Page:
        def many(tag: int, default: tuple = ()) -> tuple:
            values = tags.get(tag) or default
            if any(not isinstance(v, int) or v < 0 for v in values):
                raise TiffError(f"tag {tag} has other than whole numbers from 0")
            return values

        one = lambda tag, default: many(tag, (default,))[0]
        width, height, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
        depth, compression, predictor, separate = many(BITS, (1,)), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        bits = depth[0]
        if len(set(depth)) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
            raise TiffError(f"{depth[:8]} bits a sample are not supported")
        if one(FILL_ORDER, 1) != 1:
            raise TiffError("fill order 2 is not supported")
        if not width or not height or not samples or samples * width * height * max(bits, 8) > 8 * self.most_bytes:
            raise TiffError(f"a page of {width} x {height} x {samples}")
        tiled = TILE_OFFSETS in tags
        wide, high = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        if not wide or not high or wide * high * samples * max(bits, 8) > 8 * self.most_bytes:
            raise TiffError("tiles or strips without extent, or too large")
        offsets, counts = many(TILE_OFFSETS if tiled else STRIP_OFFSETS), many(TILE_COUNTS if tiled else STRIP_COUNTS)
        across, down, planes = -(-width // wide), -(-height // high), samples if separate else 1
        if min(len(offsets), len(counts)) < across * down * planes:
            raise TiffError("strips or tiles are missing")
        each = 1 if separate else samples
        kind = np.dtype(f"{self.order}u{max(bits, 8) // 8}")
        out = np.zeros((planes, height, width, each), kind.newbyteorder("="))
        for k in range(across * down * planes):
            plane, y, x = k // (across * down), k // across % down * high, k % across * wide
            rows = high if tiled else min(high, height - y)
            row = (wide * each * bits + 7) // 8
            if offsets[k] + counts[k] > len(self.data):
                raise TiffError("the file ends early")
            a = np.frombuffer(unpacked(self.data[offsets[k] : offsets[k] + counts[k]], compression, rows * row), np.uint8).reshape(rows, row)
            block = self.block(a, wide, each, bits, kind, predictor)
            out[plane, y : y + rows, x : x + wide] = block[: height - y, : width - x]
        if separate:
            out = np.moveaxis(out, 0, 2).reshape(1, height, width, samples)
        return Page(width, height, samples, bits, one(FORMAT, 1), one(PHOTOMETRIC, 0), compression, predictor, out.tobytes())

    def block(self, a: np.ndarray, wide: int, each: int, bits: int, kind: np.dtype, predictor: int) -> np.ndarray:
        """Samples of a strip or tile from its bytes, with the predictor undone."""
        rows = len(a)
        if bits < 8:
            if predictor != 1:
                raise TiffError("a predictor needs 8 bits or more")
            ones = np.unpackbits(a, axis=1).reshape(rows, -1, bits)
            return (ones @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)[:, : wide * each].reshape(rows, wide, each)
        if predictor == 3:
            # Bytes of a row are differences, ordered by significance: all high bytes first.
            size, count = bits // 8, wide * each
            sums = a.reshape(rows, -1, each).cumsum(axis=1, dtype=np.uint8).reshape(rows, size, count)
            return np.ascontiguousarray(np.moveaxis(sums, 1, 2)).view(f">u{size}").reshape(rows, wide, each).astype(kind.newbyteorder("="))
        block = np.ascontiguousarray(a).view(kind).reshape(rows, wide, each).astype(kind.newbyteorder("="))
        if predictor == 2:
            block = block.cumsum(axis=1, dtype=block.dtype)
        elif predictor != 1:
            raise TiffError(f"predictor {predictor} is not supported")
        return block


def write(pages: list[np.ndarray], *, compression: int = DEFLATE, predictor: int = 1, rows: int = 64, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A classic file of arrays (height, width, samples) of unsigned numbers, one page each.

    Strips of ``rows`` rows, or tiles of the width and height ``tile`` (multiples of 16) if given.
    """
    out = [b"II" if order == "<" else b"MM", struct.pack(order + "H", 42), b"\0\0\0\0"]
    at, link = 8, 4
    for page in pages:
        height, width, samples = page.shape
        bits = page.dtype.itemsize * 8
        wide, high = tile or (width, min(rows, height))
        offsets, counts = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                part = page[y : y + high, x : x + wide]
                if tile:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                raw = packed(part.astype(part.dtype.newbyteorder(order)).tobytes(), compression, part.shape[1] * samples * bits // 8)
                offsets.append(at)
                counts.append(len(raw))
                out.append(raw)
                at += len(raw)
        if at % 2:
            out.append(b"\0")
            at += 1
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1])]
        tags += [(SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [wide]), (TILE_LENGTH, 4, [high]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [high]), (STRIP_COUNTS, 4, counts)]
        tags.sort()
        after = at + 2 + 12 * len(tags) + 4
        entries, extra = [struct.pack(order + "H", len(tags))], []
        for tag, kind, values in tags:
            raw = struct.pack(f"{order}{len(values)}{LETTERS[kind]}", *values)
            if len(raw) > 4:
                place = struct.pack(order + "I", after + sum(map(len, extra)))
                extra.append(raw + b"\0" * (len(raw) % 2))
            else:
                place = raw.ljust(4, b"\0")
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + place)
        out.append((link, at))
        body = b"".join(entries)
        link = at + len(body)
        out += [body, b"\0\0\0\0", *extra]
        at += len(body) + 4 + sum(map(len, extra))
    # The links between directories are known only now.
    links = dict(x for x in out if isinstance(x, tuple))
    whole = bytearray(b"".join(x for x in out if isinstance(x, bytes)))
    for place, target in links.items():
        whole[place : place + 4] = struct.pack(order + "I", target)
    return bytes(whole)


def feature(page: Page) -> str:
    """Size, mean, deviation and entropy of a page's bytes, as text."""
    a = np.frombuffer(page.data, np.uint8)
    n = np.bincount(a, minlength=256).astype(np.float64)
    p = n[n > 0] / max(len(a), 1)
    mean = float(n @ np.arange(256) / max(len(a), 1))
    deviation = float(np.sqrt(max(n @ (np.arange(256) - mean) ** 2 / max(len(a), 1), 0.0)))
    return f"{page.width}x{page.height}x{page.samples}:{mean:.4f}:{deviation:.4f}:{-(p * np.log2(p)).sum():.4f}"


PAGE_FIELDS = [
    *(StructField(c, IntegerType()) for c in ("page", "width", "height", "samples_per_pixel", "bits", "sample_format", "photometric", "compression", "predictor")),
    StructField("samples", BinaryType()),
    StructField("feature", StringType()),
    StructField("error", StringType()),
]


KINDS = {IntegerType: pa.int32(), BinaryType: pa.binary(), StringType: pa.string()}


def read_pages(files: DataFrame, *, media_col: str = "media", most_bytes: int = 1 << 29) -> DataFrame:
    """One row per page: the columns of files, then page, width, height and the other PAGE_FIELDS.

    page counts from 0. samples holds rows of interleaved samples in little-endian order, one
    byte each below 8 bits. A file that is null or empty, or no file of this format, gives one
    row with an error; pages before a broken one are given, then one row with the broken page's
    number and an error. So is a page whose strips or tiles end early, or with more than
    ``most_bytes`` of samples. A file's rows follow one another, in the order of files. Columns of
    files that have the names of new ones are replaced. Repeated rows are read each. Empty in,
    empty out.
    """
    common.small_batches(files.sparkSession)
    names = {f.name for f in PAGE_FIELDS} - {media_col}
    files = files.drop(*names)
    fields = [f for f in PAGE_FIELDS if f.name in names]
    kept = files.schema.fields

    def rows(data: bytes | None):
        if not data:
            yield [0, *[None] * 10, "no media"]
            return
        i = 0
        try:
            for p in Reader(data, most_bytes).pages():
                yield [i, p.width, p.height, p.samples, p.bits, p.format, p.photometric, p.compression, p.predictor, p.data, feature(p), None]
                i += 1
        except TiffError as e:
            yield [i, *[None] * 10, str(e)]

    def read(it):
        for batch in it:
            at, made, held = [], [], 0

            def flush(batch=batch):
                columns = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(kept))]
                new = [pa.array(c, KINDS[type(f.dataType)]) for c, f in zip(zip(*made, strict=True), PAGE_FIELDS, strict=True) if f.name in names]
                return pa.RecordBatch.from_arrays([*columns, *new], names=[*(f.name for f in kept), *(f.name for f in fields)])

            for i, data in enumerate(batch.column(media_col)):
                for row in rows(data.as_py()):
                    at.append(i)
                    made.append(row)
                    held += len(row[9] or b"") + 200
                    if held > 4 << 20:
                        yield flush()
                        at, made, held = [], [], 0
            if at:
                yield flush()

    return files.mapInArrow(read, StructType([*kept, *fields]))


def joined_pages(pages: DataFrame, kept: list[str]) -> DataFrame:
    """One row per file from the rows of read_pages(), as they follow one another: nothing is shuffled.

    Columns: ``kept`` (of the first row), pages (int), samples (of all pages, one after the other;
    null if a page is broken), feature (of the pages, with blanks between) and error (or null).
    """
    fields = [*(pages.schema[c] for c in kept), StructField("pages", IntegerType()), StructField("samples", BinaryType()), StructField("feature", StringType()), StructField("error", StringType())]

    def join(it):
        first, parts, said, error = None, [], [], None
        names = [f.name for f in fields]

        def row():
            return [*first, len(parts), None if error else b"".join(parts), None if error else " ".join(said), error]

        def made(rows, like):
            types = [like.column(c).type for c in kept] + [pa.int32(), pa.binary(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        batch = None
        for batch in it:
            rows, held = [], 0
            columns, numbers = [batch.column(c) for c in kept], batch.column("page").to_pylist()
            for i, (page, samples, what, wrong) in enumerate(zip(numbers, *(batch.column(c) for c in ("samples", "feature", "error")), strict=True)):
                if page == 0:
                    if first is not None:
                        rows.append(row())
                        held += len(rows[-1][-3] or b"")
                    if held > 4 << 20:
                        yield made(rows, batch)
                        rows, held = [], 0
                    first, parts, said, error = [c[i].as_py() for c in columns], [], [], None
                if wrong.is_valid:
                    error = wrong.as_py()
                else:
                    parts.append(samples.as_py())
                    said.append(what.as_py())
            if rows:
                yield made(rows, batch)
        if first is not None:
            yield made([row()], batch)

    return pages.select(*kept, "page", "samples", "feature", "error").mapInArrow(join, StructType(fields))


#: Width of the images that hold payloads.
PAYLOAD_WIDTH = 576
#: How payloads are stored: compression, predictor, and whether in tiles; a third in each compression.
FORMS = ((DEFLATE, 1, False), (DEFLATE, 2, False), (DEFLATE, 2, True), (LZW, 1, False), (LZW, 1, True), (LZW, 2, False), (PACKBITS, 1, False), (PACKBITS, 1, False), (PACKBITS, 1, True))
#: Width and height of tiles; pages of fewer than half their height have strips.
PAYLOAD_TILE = (192, 16)
#: Pages that a payload is split into, if it has as many rows.
PAYLOAD_PAGES = 3


def payload_image(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and a file of them, filled up with 255 to whole rows.

    The payload's checksum picks the form, the byte order and 1 to PAYLOAD_PAGES pages.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw + b"\xff" * ((-len(raw)) % PAYLOAD_WIDTH or (0 if raw else PAYLOAD_WIDTH))
    crc = zlib.crc32(padded)
    compression, predictor, tiled = FORMS[crc % len(FORMS)]
    image = np.frombuffer(padded, np.uint8).reshape(-1, PAYLOAD_WIDTH, 1)
    pages = np.array_split(image, min(len(image), 1 + (crc >> 8) % PAYLOAD_PAGES))
    tile = PAYLOAD_TILE if tiled and 2 * len(pages[-1]) >= PAYLOAD_TILE[1] else None
    return len(raw), write(pages, compression=compression, predictor=predictor, tile=tile, order="<>"[crc >> 16 & 1])


def payload_files(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs without text_col, with n_bytes and media: each whole text as an image. Null counts as empty."""
    common.small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text_col, "n_bytes", "media")]
    fields = [*(docs.schema[c] for c in kept), StructField("n_bytes", LongType()), StructField("media", BinaryType())]

    def store(it):
        for batch in it:
            sizes, media, start, held = [], [], 0, 0

            def flush(batch=batch):
                columns = [batch.column(c).slice(start, len(sizes)) for c in kept]
                return pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*kept, "n_bytes", "media"])

            for text in batch.column(text_col):
                n, data = payload_image(text.as_py())
                sizes.append(n)
                media.append(data)
                held += len(data)
                if held > 4 << 20:
                    yield flush()
                    start, sizes, media, held = start + len(sizes), [], [], 0
            if sizes:
                yield flush()

    return docs.select(*kept, text_col).mapInArrow(store, StructType(fields))

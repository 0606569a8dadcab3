"""N-gram Jaccard self-join of texts, exact at its threshold.

Method: universe partition with the pigeonhole principle (Deng, Li, Wen and Feng, "An efficient
partition based method for exact set similarity joins", VLDB 2015). Sets in a size band hash
their shingles into segments. Two sets that differ in at most H shingles and use segments of
weights v with sum(v) > H must have a segment i with fewer than v_i differences: weight 1
asks for equal segments, weight 2 for equal segments or one deletion apart. A cost model picks
how many segments of each weight a band has. A segment's signature is a sum of mixed shingle
hashes, so a one-deletion signature is that sum less one term.

Empty segments would make buckets of unrelated sets. With some more segments than H + 1 the
principle holds for the others alone: a set whose segments of weight 1 that hold something, with
those of weight 2, weigh more than H does not sign its empty ones (see ``sign``).

Plan (each step distributed, nothing per document reaches the driver):

1. One pass over the texts: hash each one's shingles and sign the set. Equal sets form a class,
   which is one node below; a task signs a class once.
2. Signatures are sorted by themselves; what several classes hold is a bucket, all others go at
   once. Buckets with the same members count once. Inside a bucket, parity sketches (the parity
   of the number of shingles in each of some hundred cells; Hamming distance never exceeds the
   symmetric difference) drop pairs that cannot link. What stays is passed on as a spanning
   forest, at most one row per member.
3. Components of those forests are candidate groups. Each group's sets are compared exactly.
   A large bucket or group is cut into blocks, and tasks get pairs of blocks.
4. Components of the exact links.

Shingles are compared as 64-bit hashes. Classes are told apart by 128 further bits and their
size; a node's number is the first half of these.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.llm import common

#: Rows of a bucket that one task compares with each other, and shingles of a group likewise.
BUCKET_BLOCK = 2048
GROUP_BLOCK = 400_000
#: Cost of comparing the sketches of a pair, in signatures made, shuffled and sorted.
PAIR_COST = 0.05
#: Rows of a bucket that are held until its last is read, and classes that a task remembers.
HELD_ROWS = 200_000
SEEN_CLASSES = 200_000


@dataclass(frozen=True)
class Scheme:
    """How sets of up to ``hi`` shingles are cut when the larger set of a pair has at least ``lo``."""

    lo: int
    hi: int
    least: int  # size of the smallest partner
    differ: int  # H
    single: int  # segments of weight 1
    double: int  # segments of weight 2, each with twice the share of the universe
    cells: int  # of the parity sketch


def bands(largest: int, ratio: float) -> list[tuple[int, int]]:
    """Size bands from 1 up to ``largest``, each about ``ratio`` times the one before."""
    out, lo = [], 1
    while lo <= largest:
        up = max(lo + 1, int(np.ceil(lo * ratio)))
        out.append((lo, up - 1))
        lo = up
    return out


BANDS = bands(1 << 40, 1.5)


def band_of(size: int) -> int:
    """Index of the band with sets of this size."""
    return bisect.bisect_right(BANDS, (size, math.inf)) - 1


def too_few(tries: int, chance: float, most: int) -> float:
    """The chance of at most ``most`` successes; from 60 tries on by the normal approximation."""
    if most < 0 or tries <= most:
        return float(most >= 0)
    if tries < 60:
        return sum(math.comb(tries, k) * chance**k * (1 - chance) ** (tries - k) for k in range(most + 1))
    deviation = math.sqrt(tries * chance * (1 - chance)) + 1e-9
    return 0.5 * math.erfc((tries * chance - most - 0.5) / deviation / math.sqrt(2))


def allocate(size: int, differ: int, rows: int) -> tuple[int, int]:
    """Segments of weight 1 and 2 with the least expected cost for ``rows`` sets of this size.

    A set pays for its signatures, and for each unrelated set that shares one. Unrelated sets
    meet where both sign an empty segment of weight 1, which only sets with few others do, and
    where both have next to nothing in a segment of weight 2.
    """
    best = (math.inf, 0, 0)
    for units in sorted({differ + 1, *(math.ceil((differ + 1) * x) for x in (1.05, 1.1, 1.2, 1.35, 1.6))}):
        for double in sorted({round(units // 2 * i / 64) for i in range(65)}):
            single, share = units - 2 * double, size / units
            empty = math.exp(-share)
            signs = min(empty, too_few(single, 1 - empty, differ - 2 * double))
            made = single * (1 - empty + signs) + double * (1 + 2 * share)
            meet = single * signs**2 + double * (1 + 4 * share) * math.exp(-4 * share)
            best = min(best, (made + PAIR_COST * max(rows - 1, 0) / 2 * meet, single, double))
    return best[1], best[2]


def schemes(sizes: dict[int, int], num: int, den: int) -> list[Scheme]:
    """One scheme per band that can have links; sizes: number of sets by band index."""
    out = []
    for i, (lo, hi) in enumerate(BANDS[: max(sizes, default=-1) + 1]):
        if differ := 2 * hi * (den - num) // (den + num):
            single, double = allocate(lo, differ, sizes.get(i, 0) + sizes.get(i - 1, 0))
            cells = 256
            while cells < 6 * differ:
                cells *= 2
            out.append(Scheme(lo, hi, -(-lo * num // den), differ, single, double, cells))
    return out


def sign(sets: np.ndarray, scheme: Scheme, number: int, mixed: np.ndarray | None = None) -> np.ndarray:
    """The signatures of one set (sorted) under one scheme; mixed: mixed_of() the set.

    At most H segments differ in a linked pair, by weight. So where a set's own segments (those
    of weight 1 that hold something, and all of weight 2) weigh more than H, one of them matches
    in the other set, and the other set signs it too: there it holds the same, or it has weight 2.
    Empty segments of weight 1 are signed only by sets without that much.
    """
    units = scheme.single + 2 * scheme.double
    total = scheme.single + scheme.double
    segment = ((sets >> np.uint64(32)) * np.uint64(units) >> np.uint64(32)).astype(np.int64)  # ascending, as sets
    if scheme.double:
        segment = np.where(segment < scheme.single, segment, scheme.single + (segment - scheme.single) // 2)
    size = np.bincount(segment, minlength=total)
    ends = np.cumsum(size)
    with np.errstate(over="ignore"):
        mixed = mixed_of(sets) if mixed is None else mixed
        summed = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(mixed, out=summed[1:])
        sums = summed[ends] - summed[ends - size]
        salt = salts(total, number)
        whole = common.mix(sums ^ salt)
        if np.count_nonzero(size[: scheme.single]) + 2 * scheme.double > scheme.differ:
            size[scheme.single :] += 1
            whole = whole[size > 0]
        if not scheme.double:
            return whole
        long = segment >= scheme.single
        at = segment[long]
        return np.unique(np.concatenate([whole, common.mix((sums[at] - mixed[long]) ^ salt[at])]))


@functools.cache
def salts(segments: int, number: int) -> np.ndarray:
    """What tells the segments of all schemes apart."""
    with np.errstate(over="ignore"):
        return common.mix(np.arange(segments, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number + 1) * np.uint64(0xD1B54A32D192ED03))


def mixed_of(sets: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix(sets + np.uint64(0x51ED270B))


def sketch(sets: np.ndarray, cells: int) -> np.ndarray:
    """Parities of the set's counts in ``cells`` cells, as bytes; halves can be folded by XOR."""
    cell = (sets & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=cells) & 1).astype(np.uint8))


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of unlike widths as rows of 64-bit words, all folded to the narrowest."""
    width = min(map(len, sketches))
    rows = []
    for s in sketches:
        a = np.frombuffer(s, np.uint8)
        while len(a) > width:
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        rows.append(a)
    return np.stack(rows).view(np.uint64)


def passing(n: np.ndarray, bits: np.ndarray, i: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Those of ``others`` that may link with row i by size and sketch; none that links is left out."""
    a, b = n[i], n[others]
    fits = (np.minimum(a, b) * den >= np.maximum(a, b) * num)
    others = others[fits]
    if len(others):
        apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
        others = others[apart * (den + num) <= (a + n[others]) * (den - num)]
    return others


class Forest:
    """Union-find over row numbers; the root of a tree is its least row."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, node) sorted by both: the rows of signatures with several nodes, and their sums.

    Equal rows count once. The sums are rows without a node: m, the number of nodes, and two sums
    of hashes that tell the sets of nodes apart. A signature without end is passed on in parts.
    """
    sig, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    m, h1, h2 = 0, np.uint64(0), np.uint64(0)  # of the rows of sig[0] that are passed on already

    def told(sig, node, last):
        """Passes on the rows up to ``last``, where a signature begins or, in a part, goes on."""
        nonlocal m, h1, h2
        starts = np.flatnonzero(np.concatenate([[True], sig[1:last] != sig[: last - 1]]))
        size = np.diff(np.append(starts, last))
        with np.errstate(over="ignore"):
            plain = node[:last].view(np.uint64)
            one = np.add.reduceat(common.mix(plain + np.uint64(1)), starts)
            two = np.add.reduceat(common.mix(plain ^ np.uint64(0x9E3779B97F4A7C15)), starts)
            size[0], one[0], two[0] = size[0] + m, one[0] + h1, two[0] + h2
        ended = np.ones(len(starts), bool)
        ended[-1] = last == len(sig) or sig[last] != sig[last - 1]
        many = size > 1
        m, h1, h2 = (0, np.uint64(0), np.uint64(0)) if ended[-1] else (int(size[-1]), one[-1], two[-1])
        rows = np.repeat(many | ~ended, np.diff(np.append(starts, last)))
        sums = many & ended
        if rows.any() or sums.any():
            k, none = int(sums.sum()), int(rows.sum())
            columns = [pa.array(np.concatenate([sig[:last][rows], sig[starts][sums]])), pa.concat_arrays([pa.array(node[:last][rows]), pa.nulls(k, pa.int64())])]
            columns += [pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(x[sums].astype(np.int64))]) for x in (size, one, two)]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "node", "m", "h1", "h2"])

    for batch in it:
        sig = np.concatenate([sig, batch.column(0).to_numpy()])
        node = np.concatenate([node, batch.column(1).to_numpy()])
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[new], node[new]
        last = int(np.searchsorted(sig, sig[-1]))  # the last signature may go on
        if len(sig) - last > HELD_ROWS:
            last = len(sig) - 1
        if last:
            yield from told(sig, node, last)
            sig, node = sig[last:], node[last:]
    if len(sig):
        yield from told(sig, node, len(sig))


@dataclass
class Rows:
    """The rows of one task, by column; ``text`` is whatever bytes they carry."""

    own: list[int]
    node: list[int]
    n: list[int]
    carried: list[bytes]
    copies: list[int]


def groups(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Rows]]:
    """The blocks and rows of each task, from batches sorted by (key, a_, b_, node); of equal nodes one row."""
    key, held = None, Rows([], [], [], [], [])
    for batch in it:
        names = batch.schema.names
        columns = [batch.column(c).to_pylist() for c in ("own_", "node", "n", "copies")] if "copies" in names else [*(batch.column(c).to_pylist() for c in ("own_", "node", "n")), [1] * len(batch)]
        carried = batch.column("carried")
        for i, (k, own, node, n, copies) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in ("key", "a_", "b_")), strict=True), *columns, strict=True)):
            if k != key:
                if len(held.node) > 1:
                    yield key[1:], held
                key, held = k, Rows([], [], [], [], [])
            elif node == held.node[-1]:
                continue
            held.own.append(own)
            held.node.append(node)
            held.n.append(n)
            held.copies.append(copies)
            held.carried.append(carried[i].as_py())
    if len(held.node) > 1:
        yield key[1:], held


def dealt(df: DataFrame, partitions: int) -> DataFrame:
    """Rows for the tasks (key, a_, b_) with a_ <= b_: each pair of the key's blocks meets in one task.

    ``blocks`` has the key's number of blocks; ``node`` is hashed to one. With one block this is
    one row per row. Rows of a task are sorted together.
    """
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")), lambda o: F.struct(F.least("own_", o).alias("a_"), F.greatest("own_", o).alias("b_")))
    out = df.withColumn("own_", own).withColumn("pair_", F.explode(pair)).select("*", "pair_.a_", "pair_.b_").drop("pair_", "blocks")
    return out.repartition(partitions, "key", "a_", "b_").sortWithinPartitions("key", "a_", "b_", "node")


def split_rows(task: tuple[int, int], own: list[int]):
    """Row i is compared with partners(i): later rows, and across blocks only those of the other."""
    a, b = task
    own, at = np.array(own), np.arange(len(own))

    def partners(i: int) -> np.ndarray:
        return at[i + 1 :] if a == b else at[i + 1 :][own[i + 1 :] != own[i]]

    return partners


def near_forest(task: tuple[int, int], rows: Rows, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and sketches let pass, as pairs of nodes.

    Rows of one tree are not compared again: only their tree is passed on.
    """
    if len(rows.node) == 2:
        a, b = rows.n
        apart = apart_of(*rows.carried) if min(a, b) * den >= max(a, b) * num else a + b
        return [tuple(rows.node)] if apart * (den + num) <= (a + b) * (den - num) and (task[0] == task[1] or rows.own[0] != rows.own[1]) else []
    n, bits, partners = np.array(rows.n), folded(rows.carried), split_rows(task, rows.own)
    tree, out = np.arange(len(n)), []
    for i in range(len(n) - 1):
        others = partners(i)
        others = passing(n, bits, i, others[tree[others] != tree[i]], num, den)
        if len(others):
            roots, first = np.unique(tree[others], return_index=True)
            out += [(rows.node[i], rows.node[j]) for j in others[first].tolist()]
            tree[np.isin(tree, roots)] = tree[i]
    return out


def apart_of(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, folded to the narrower."""
    if len(a) < len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a), int.from_bytes(b), len(a) * 8
    while bits > len(b) * 8:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def jaccard_tables(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame, Callable[[], None]]:
    """Rows (doc, t, n, d1, d2) of docs; classes (d1, d2, n, first, t, copies, comp, least, links); what drops their tables.

    t is a hash of the text, ``first`` the least id of a class and the class's t one of that id;
    comp is null for classes without links, ``least`` the least id of the component.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))
    id_type = source.schema["doc"].dataType

    # Documents by size for the cost model, by steps of a tenth of the number of blanks; no text has
    # more words than half its bytes.
    step = F.floor(F.log(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1) / math.log(1.1))
    counted = source.filter("text is not null").groupBy(step.alias("step")).agg(F.count("*").alias("sets"), F.max(F.octet_length("text")).alias("bytes")).collect()
    by_band = {band_of(max((r["bytes"] for r in counted), default=0) // 2 + 1): 0}
    for r in counted:
        i = band_of(int(1.1 ** (r["step"] + 0.5)))
        by_band[i] = by_band.get(i, 0) + r["sets"]
    plan = schemes(by_band, num, den)
    fits = np.array([(p.least, p.hi) for p in plan]).reshape(-1, 2)

    def signed(it):
        seen = set()

        def rows(batch):
            for doc, t, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                s = common.shingles(common.word_hashes(text.as_py()), words)
                mixed = mixed_of(s)
                d1, d2 = digest(mixed)
                row = [doc.as_py(), t.as_py(), len(s), d1, d2, None, None]
                if len(s) and (d1, d2) not in seen:
                    seen.clear() if len(seen) >= SEEN_CLASSES else None
                    seen.add((d1, d2))
                    mine = np.flatnonzero((fits[:, 0] <= len(s)) & (fits[:, 1] >= len(s))).tolist()
                    if mine:
                        row[5] = sketch(s, max(plan[i].cells for i in mine)).tobytes()
                        row[6] = np.concatenate([sign(s, plan[i], i, mixed) for i in mine]).view(np.int64)
                yield row

        for batch in it:
            schema = pa.schema([("doc", batch.schema.field(0).type), *((c, pa.int64()) for c in ("t", "n", "d1", "d2")), ("sketch", pa.binary()), ("sigs", pa.list_(pa.int64()))])
            yield from common.batches(rows(batch), schema)

    sets, sets_path = common.written(source.mapInArrow(signed, f"doc {id_type.simpleString()}, t long, n long, d1 long, d2 long, sketch binary, sigs array<long>"), "sets")
    classes = sets.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc").alias("first"), F.min_by("t", "doc").alias("of_first"), F.min("t").alias("any"), F.count("*").alias("copies"))
    classes = classes.select("d1", "d2", "n", "first", F.coalesce("of_first", "any").alias("t"), "copies")
    classes, classes_path = common.written(classes, "classes")

    # Buckets: each signature is sent once, and only what several classes hold goes on.
    sigs = sets.filter("sigs is not null").select(F.explode("sigs").alias("sig"), F.col("d1").alias("node"))
    sigs = sigs.repartition(parts, "sig").sortWithinPartitions("sig", "node")
    held, held_path = common.written(sigs.mapInArrow(shared, "sig long, node long, m long, h1 long, h2 long"), "shared")
    buckets = held.filter("node is null").groupBy("m", "h1", "h2").agg(F.min("sig").alias("key")).select("key", "m")
    members = held.filter("node is not null").select("sig", "node").join(buckets, F.col("sig") == F.col("key"))
    members = members.select("key", "node", F.ceil(F.col("m") / BUCKET_BLOCK).cast("int").alias("blocks"))
    sketches = sets.filter("sketch is not null").select(F.col("d1").alias("node"), "n", F.col("sketch").alias("carried"))
    members = members.join(sketches, "node")

    def near(it):
        u, v = [], []
        for task, rows in groups(it):
            for a, b in near_forest(task, rows, num, den):
                u.append(a)
                v.append(b)
            if len(u) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    candidates, candidates_path = common.components(dealt(members, parts).mapInArrow(near, "u long, v long"), "candidates")

    # Candidate groups with their sets, in blocks of bounded weight. A class is read from one text.
    groups_of = candidates.join(classes.withColumn("node", F.col("d1")), "node")
    groups_of, groups_path = common.written(groups_of, "groups")
    weight = groups_of.groupBy("comp").agg(F.ceil(F.sum("n") / GROUP_BLOCK).cast("int").alias("blocks"))
    wanted = groups_of.join(weight, "comp").select(F.col("comp").alias("key"), "blocks", "node", "n", "d1", "d2", "copies", F.col("first").alias("of"), F.col("t").alias("of_t"))
    texts = source.join(common.small(wanted, groups_of.count()), (F.col("t") == F.col("of_t")) & F.col("doc").eqNullSafe(F.col("of"))).drop("doc", "t", "of", "of_t")
    carried_schema = pa.schema([("key", pa.int64()), ("blocks", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("copies", pa.int64()), ("carried", pa.binary())])

    def carried(it):
        seen = set()

        def rows(batch):
            for key, blocks, node, n, d1, d2, copies, text in zip(*(batch.column(c) for c in ("key", "blocks", "node", "n", "d1", "d2", "copies", "text")), strict=True):
                if (k := node.as_py()) in seen:
                    continue
                s = common.shingles(common.word_hashes(text.as_py()), words)
                if (len(s), *digest(mixed_of(s))) == (n.as_py(), d1.as_py(), d2.as_py()):
                    seen.clear() if len(seen) >= SEEN_CLASSES else None
                    seen.add(k)
                    yield [key.as_py(), blocks.as_py(), k, len(s), copies.as_py(), s.tobytes()]

        for batch in it:
            yield from common.batches(rows(batch), carried_schema)

    def exact(it):
        for task, rows in groups(it):
            yield from verified(task, rows, [np.frombuffer(s, np.uint64) for s in rows.carried], num, den)

    texts = texts.mapInArrow(carried, "key long, blocks int, node long, n long, copies long, carried binary")
    links, links_path = common.written(dealt(texts, parts).mapInArrow(exact, "u long, v long, links long"), "links")
    found, found_path = common.components(links.filter("v is not null").select("u", "v"), "components")
    counts = links.filter("links is not null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    of = found.join(counts, "node", "left").join(groups_of.select("node", "first"), "node")
    least = of.groupBy("comp").agg(F.min("first").alias("least"))
    of = of.join(least, "comp").select(F.col("node").alias("d1"), "comp", "least", "links")
    made, made_path = common.written(classes.join(of, "d1", "left"), "linked")
    common.drop(spark, held_path, candidates_path, groups_path, links_path, found_path, classes_path)
    return sets.select("doc", "t", "n", "d1", "d2"), made, lambda: common.drop(spark, sets_path, made_path)


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Links documents whose sets of ``words``-word shingles have a Jaccard of num/den or more.

    Returns one row per row of ``docs``: id_col, n_shingles (long), component_id (the least id
    reachable by links, its own included), class_id (least id with the same set) and n_links
    (long, the number of other rows that it links with).

    Words are runs of anything but the six ASCII white-space characters, with A-Z in lower case.
    A text of fewer words than ``words`` is one shingle. Null, empty and blank texts have no
    shingles and link with nothing, not even each other. Repeated rows are rows: they link. A
    null id is never a least id unless a whole component lacks one; it still gets its row. Other
    columns of ``docs`` are not read. An empty table gives an empty table.
    """
    rows, classes, _ = jaccard_tables(docs, id_col, text_col, words, num, den)
    # Two plain tables: rows of a class with very many copies can be split over tasks.
    result = rows.join(classes.drop("t"), ["d1", "d2", "n"], "left")
    return result.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("least", "first", "doc").alias("component_id"),
        F.coalesce("first", "doc").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
    )


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component of jaccard_join(): the least id's, or any one without ids.

    The decision is by row: of rows with the same id, only those whose text is in the component
    go. Of rows that have the kept id and text, one stays. Texts without words link with nothing,
    and all their rows stay. All columns stay; clashing names do no harm. Empty in, empty out.
    """
    rows, classes, done = jaccard_tables(docs, id_col, text_col, words, num, den)
    # Of each component the class with the least id, and its row with that id; then what else there is.
    group = F.coalesce("comp", "d1").alias("group")
    kept = classes.groupBy(group).agg(F.min_by(F.struct("d1", "d2", F.col("t").alias("kept_t")), F.struct(F.col("first").isNull(), "first", "d1")).alias("kept"))
    kept = kept.select("group", F.col("kept.d1").alias("kept_1"), F.col("kept.kept_t"))
    told = rows.filter("n > 0").join(classes.select("d1", "d2", "n", "first", group), ["d1", "d2", "n"]).join(kept, "group")
    stays = (F.col("d1") == F.col("kept_1")) & (F.col("t") == F.col("kept_t")) & F.col("doc").eqNullSafe(F.col("first"))
    by_key = told.groupBy("doc", "t").agg(F.max(stays).alias("stays"), F.count("*").alias("rows")).filter("not stays or rows > 1")
    doc, t, stays_, rows_ = (common.free_name(docs, c) for c in ("doc", "t", "stays", "rows"))
    by_key, key_path = common.written(by_key.toDF(doc, t, stays_, rows_), "gone")
    done()
    by_key = common.small(by_key, by_key.count())
    fits = F.xxhash64(docs[text_col].cast("string")).eqNullSafe(F.col(t)) & docs[id_col].eqNullSafe(F.col(doc))
    once = docs.join(by_key.filter(F.col(stays_)), fits).dropDuplicates([doc, t]).select(docs.columns)
    return docs.join(by_key, fits, "left_anti").unionByName(once)


def digest(mixed: np.ndarray) -> tuple[int, int]:
    """128 bits of a set from mixed_of() it, as two signed numbers."""
    with np.errstate(over="ignore"):
        a = mixed.sum(dtype=np.uint64)
        b = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def verified(task: tuple[int, int], rows: Rows, sets: list[np.ndarray], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the exact links, and for each row how many rows it links with here."""
    n = np.array([len(s) for s in sets])
    cells = 256
    while cells < n.max() // 4:
        cells *= 2
    bits = np.stack([sketch(s, cells) for s in sets]).view(np.uint64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    codes = [codes[e - k : e] for e, k in zip(ends, n, strict=True)]
    mark = np.zeros(len(values), np.int64)
    tree, partners, links = Forest(len(n)), split_rows(task, rows.own), [0] * len(n)
    for i in range(len(n) - 1):
        others = passing(n, bits, i, partners(i), num, den)
        if not len(others):
            continue
        mark[codes[i]] = 1
        both = np.add.reduceat(mark[np.concatenate([codes[j] for j in others])], np.concatenate([[0], np.cumsum(n[others])[:-1]]))
        mark[codes[i]] = 0
        for j in others[both * den >= (n[i] + n[others] - both) * num].tolist():
            tree.join(i, j)
            links[i] += rows.copies[j]
            links[j] += rows.copies[i]
    out = [(rows.node[i], rows.node[r], None) for i in range(len(n)) if (r := tree.find(i)) != i]
    out += [(rows.node[i], None, k) for i, k in enumerate(links) if k]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v", "links"])

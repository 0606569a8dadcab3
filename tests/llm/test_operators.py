"""Each operator against brute force, and on nulls, empty texts, ties, repeats, empty tables and clashing names."""

import functools
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lensmill.llm import chat, common, decontaminate, html_text, jaccard_join, language, mixing, quality, queries, sharding, tiff, url_filter

DOC = "doc_id long, text string, lang string, source string"
format_chats = functools.partial(chat.format_chats, tokenizer=queries.TOKENIZER)


def docs_of(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def words(rng, n, vocabulary=400):
    return [f"w{int(x)}" for x in rng.integers(0, vocabulary, n)]


# --- 1: n-gram Jaccard join -----------------------------------------------------------------


def sets_of(text, n):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set())


def brute_components(rows, n, num, den):
    sets = [sets_of(t, n) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {(k, len(sets[i]), least[find(i)], links[i]) for i, (k, _) in enumerate(rows)}


def test_word_hashes_are_those_of_the_words(monkeypatch):
    monkeypatch.setattr(common, "PIECE", 300)
    rng, said, of = random.Random(1), {}, {}
    texts = ["a" * 300 + " " + "a" * 301 + " b", "x " * 900 + "y" * 700 + " z", " \t lead", "É é  E", "w" * 255 + " " + "w" * 256, "", "   ", "\u00a0 \x1c", "A\nB\vC\fD\rE\tF"]
    texts += ["".join(rng.choice("abcAB é\n") for _ in range(rng.randrange(900))) for _ in range(200)]
    for text in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        hashes = common.word_hashes(text).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes, strict=True):
            assert said.setdefault(w, h) == h and of.setdefault(h, w) == w
    assert len(common.word_hashes(None)) == 0


def near_copies(seed, groups=12, each=6, longest=160):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(groups):
        base = words(rng, int(rng.integers(1, longest)))
        for _ in range(each):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(copy)))
                copy[at : at + 1] = [[], ["X" + str(rng.integers(9))], [copy[at], "new"]][int(rng.integers(3))]
            texts.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard_equals_brute_force(spark, n, num, den):
    rows = [*near_copies(n), (900, None), (901, ""), (902, "  \t"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "É é"), (907, "é É"), (908, "a\u00a0b")]
    got = jaccard_join.jaccard_join(docs_of(spark, rows, "doc_id long, text string"), words=n, num=num, den=den).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == brute_components(rows, n, num, den)


def test_jaccard_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "GROUP_BLOCK", 200)
    rows = near_copies(4, groups=3, each=16)
    got = jaccard_join.jaccard_join(docs_of(spark, rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == brute_components(rows, 3, 90, 100)


def test_jaccard_odd_rows(spark):
    rows = [(5, "a b c d", "x"), (5, "a b c d", "x"), (None, "a b c d", "y"), (7, "q r s", "z"), (5, "other words here now", "x")]
    df = docs_of(spark, rows, "doc_id long, text string, node string")
    got = sorted(((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(df).collect()), key=str)
    assert got == sorted([(5, 5, 2), (5, 5, 2), (None, 5, 2), (7, 7, 0), (5, 5, 0)], key=str)
    assert jaccard_join.jaccard_join(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 120), st.integers(0, 12), st.sampled_from([(90, 100), (80, 100), (1, 2)]), st.sampled_from([1, 10, 10**9]))
def test_linked_sets_always_share_a_signature(seed, size, changes, ratio, rows):
    num, den = ratio
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    drop = min(changes // 2, len(a) - 1)
    b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, changes - drop).astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    plan = jaccard_join.schemes({i: rows for i in range(20)}, num, den)
    signed = [{(i, int(s)) for i, p in enumerate(plan) if p.least <= len(x) <= p.hi for s in jaccard_join.sign(x, p, i)} for x in (a, b)]
    if both * den >= num * (len(a) + len(b) - both) and both < max(len(a), len(b)):
        assert signed[0] & signed[1]
    for cells in (256, 1024):
        apart = np.bitwise_count(jaccard_join.sketch(a, cells) ^ jaccard_join.sketch(b, cells)).sum()
        assert apart <= len(a) + len(b) - 2 * both
    fold = jaccard_join.folded([jaccard_join.sketch(a, 1024).tobytes(), jaccard_join.sketch(a, 256).tobytes()])
    assert (fold[0] == fold[1]).all()


def test_allocation_weighs_costs():
    single, double = jaccard_join.allocate(500, 52, 1000)
    assert (single, double) == (53, 0)
    assert jaccard_join.allocate(10, 1, 10**9) == (0, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 5)), max_size=60), st.integers(1, 9), st.integers(1, 6))
def test_shared_signatures_equal_brute_force(rows, size, held):
    import pyarrow as pa

    rows, before = sorted(rows), jaccard_join.HELD_ROWS
    jaccard_join.HELD_ROWS = held
    try:
        made = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], names=["sig", "node"]) for i in range(0, len(rows), size)]
        got = [r for b in jaccard_join.shared(iter(made)) for r in b.to_pylist()]
    finally:
        jaccard_join.HELD_ROWS = before
    nodes = {s: {n for x, n in rows if x == s} for s, _ in rows}
    many = {s for s, n in nodes.items() if len(n) > 1}
    told = [(r["sig"], r["node"]) for r in got if r["node"] is not None]
    assert len(told) == len(set(told)) and {x for x in told if x[0] in many} == {(s, n) for s in many for n in nodes[s]}
    sums = {r["sig"]: (r["m"], r["h1"], r["h2"]) for r in got if r["node"] is None}
    assert {s: x[0] for s, x in sums.items()} == {s: len(nodes[s]) for s in many}
    for a in many:
        for b in many:
            assert (sums[a] == sums[b]) == (nodes[a] == nodes[b])


def test_rows_of_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "a"), (5, "other words that link with nothing", "a"), (7, long + " x", "b"), (None, long, "c"), (9, None, "d"), (9, None, "d"), (None, "q r s t u v", "e"), (None, "q r s t u v", "f"), (3, "", "g")]
    docs = docs_of(spark, rows, "doc_id long, text string, t string").withColumn("stays", F.lit(1))
    got = jaccard_join.without_near_duplicates(docs)
    assert got.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    want = [(5, long), (5, "other words that link with nothing"), (9, None), (9, None), (None, "q r s t u v"), (3, "")]
    assert got == sorted(want, key=str)
    assert jaccard_join.without_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + rng.randrange(1, 50)) for _ in range(40)] + [(-5, -7)]
    got, _ = common.components(spark.createDataFrame(edges, "u long, v long"))
    got = {r["node"]: r["comp"] for r in got.collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[-5] == got[-7] == -7
    assert {v for k, v in got.items() if k >= 100} == {100}


# --- 2: language ----------------------------------------------------------------------------

LANGS = {"aa": "the and of that with for this from", "bb": "der die und das nicht mit für über", "cc": "que para con los una por como más"}


def talk(rng, lang, n=30):
    return " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))


def test_language_mixtures(spark):
    rng = random.Random(2)
    train = [(i, talk(rng, lang), lang, "s") for i, lang in enumerate(list(LANGS) * 20)]
    model = language.train(docs_of(spark, [*train, (99, None, "aa", "s"), (98, "x", None, "s")]))
    assert model["langs"] == ["aa", "bb", "cc"]
    rows = [(1, talk(rng, "aa"), None, "s"), (2, talk(rng, "bb", 60) + " " + talk(rng, "cc", 40), None, "s"), (3, None, None, "s"), (4, " 12 !", None, "s"), (5, "", None, "s"), (1, talk(rng, "cc") * 50, "x", "s")]
    df = docs_of(spark, rows).withColumn("score", F.lit("clash"))
    got = language.identify(df, model).collect()
    assert [r["lang_pred"] for r in got] == ["aa", "bb", "und", "und", "und", "cc"]
    assert got[1]["proportions"].keys() == {"bb", "cc"} and abs(got[1]["proportions"]["bb"] - 0.6) < 0.1
    assert all(0 <= r["score"] <= 1 for r in got) and got[3]["score"] == 0
    none = language.train(df.limit(0))
    assert [r["lang_pred"] for r in language.identify(df, none).collect()] == ["und"] * 6
    assert language.identify(df.limit(0), model).count() == 0


def test_language_held_out(spark):
    df = spark.range(200).withColumn("h", language.held_out(F.col("id")))
    assert {r["id"] for r in df.filter("h").collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_em_finds_the_likeliest_mixture():
    rng = np.random.default_rng(0)
    s = np.log(np.where(rng.random((400, 1)) < 0.3, [[0.9, 0.1]], [[0.1, 0.9]]))
    theta, ll = language.proportions(s)
    grid = [(np.log(np.exp(s) @ [p, 1 - p]).sum(), p) for p in np.linspace(0.001, 0.999, 999)]
    assert abs(theta[0] - max(grid)[1]) < 0.02 and ll >= max(grid)[0] - 0.01


def test_language_sets_equal_all_subsets(spark):
    """The set that grows from the best language is the best of all sets by penalised likelihood."""
    from itertools import combinations

    rng = random.Random(7)
    model = language.train(docs_of(spark, [(i, talk(rng, lang), lang, "s") for i, lang in enumerate(list(LANGS) * 20)]))
    for trial in range(60):
        parts = rng.sample(list(LANGS), 1 + trial % 3)
        text = " ".join(talk(rng, lang, rng.choice([8, 20, 60])) for lang in parts)
        s = language.word_scores(text, model["logp"].value)
        worth = {}
        for n in (1, 2, 3):
            for some in combinations(range(3), n):
                worth[some] = language.proportions(s[:, list(some)], 2000)[1] - (n - 1) * language.PENALTY * np.log(len(s) + 1)
        chosen, theta = language.mixture(s)
        assert worth[tuple(sorted(chosen))] >= max(worth.values()) - 0.5 and abs(theta.sum() - 1) < 1e-6
        best = max(worth, key=worth.get)
        if worth[best] - sorted(worth.values())[-2] > 0.5:
            assert tuple(sorted(chosen)) == best


# --- 3: chat --------------------------------------------------------------------------------

TOKENS = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", ">", "[", "/", "s", " ", "\n", "é", "日", "😀", "a", "INST]", "|im_end|>"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(TOKENS)
def test_escapes_come_back(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]), TOKENS), min_size=1, max_size=6))
def test_masks_cover_the_texts(turns):
    encode = test_masks_cover_the_texts.__dict__.setdefault("t", chat.load(open("/opt/tokenizers/byte_bpe_50k.json").read()))
    formatted, spans = chat.render(turns)
    e = encode.encode(formatted, add_special_tokens=False)
    offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
    mine = [s for s, (role, _) in zip(spans, turns, strict=True) if role == "assistant"]
    under = chat.mask(mine, offsets[:, 0], offsets[:, 1])
    brute = [any(lo <= a and b <= hi and lo < hi for lo, hi in mine) for a, b in offsets]
    assert under.tolist() == brute
    assert "".join(chat.learnt(formatted, offsets[:, 0], offsets[:, 1], under)) == "".join(t for role, t in turns if role == "assistant")
    assert chat.read_back(formatted) == turns


def test_chats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "assistant", "x"), (None, 0, "user", "n"), (1, 1, "assistant", "b"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss_mask", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(format_chats(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\na\nassistant\nb\nassistant\nb\n") and got[1]["loss_sha256"] == sha("bb")
    assert got[2]["turns_sha256"] == sha("assistant\nx\n\n\n") and got[None]["loss_chars"] == 0
    assert got[-7]["loss_sha256"] == sha("</s>[INST] ok [/INST]") and len(got) == 4
    assert format_chats(df.limit(0)).count() == 0


# --- 4: decontamination ---------------------------------------------------------------------


def brute_leaks(index, text, least):
    words = decontaminate.tokens(text)
    h = decontaminate.hashed(words, common.WordHashes())
    out = {}
    for k, size in enumerate(index.lengths.tolist()):
        for s in range(len(words) - size + 1):
            fingerprint = decontaminate.fingerprints(decontaminate.signs(h[s : s + size]).sum(axis=0)[None, :])[0]
            apart = int(np.bitwise_count(fingerprint ^ index.prints[k]))
            score = index.similarity(decontaminate.grams(h[s : s + size], 5), k)
            if score >= least:
                out[k] = max(out.get(k, (-1.0,)), (score, -s, -apart))
    return {k: (v[0], -v[1], -v[2]) for k, v in out.items()}


def test_leaks_equal_brute_force():
    rng = np.random.default_rng(5)
    items = [(i, " ".join(words(rng, int(rng.integers(5, 40))))) for i in range(12)]
    index, hashes = decontaminate.Items(items, 5), common.WordHashes()
    assert len(index.ids) == 12
    for trial in range(40):
        text = words(rng, 60)
        for _ in range(3):
            piece = items[int(rng.integers(12))][1].split()
            for _ in range(trial % 3):
                piece[int(rng.integers(len(piece)))] = "edited"
            at = int(rng.integers(60))
            text[at:at] = piece
        text = " ".join(text)
        assert index.matches(text, 0.6, hashes) == brute_leaks(index, text, 0.6)


def test_short_items_and_scripts_without_spaces():
    long = "这是一个没有空格的基准题目请给出正确答案并解释原因"
    items = [(1, "Yes, it is."), (2, "yes"), (3, long), (4, "กขคงจฉชซ"), (5, "?!")]
    index, known = decontaminate.Items(items, 5), common.WordHashes()
    assert index.ids == [1, 2, 3, 4]
    found = lambda text: {index.ids[k]: v[1] for k, v in index.matches(text, 0.8, known).items()}
    assert found("well yes: IT is so") == {1: 1, 2: 1}
    assert found("it is yes") == {2: 2} and found("yesterday it is") == {}
    assert found(f"前面的话{long}后面的话") == {3: 4}
    assert found(long[:23] + "别的") == {3: 0} and found(long[:12]) == {}
    assert found("x กขคงจฉชซ") == {4: 1}


@pytest.mark.parametrize("size", [10, 15, 20, 40, 80])
def test_recall_of_copies_with_a_fifth_changed(size):
    """Copies whose words are changed at either end, by sets of shingles alone."""
    rng, known = np.random.default_rng(size), common.WordHashes()
    items = [(i, " ".join(f"w{w}" for w in rng.integers(0, 10**6, size))) for i in range(60)]
    index, wanted, found = decontaminate.Items(items, 5), 0, 0
    for k, (_, item) in enumerate(items):
        mine = item.split()
        for _ in range(5):
            cut, piece = int(rng.integers(0, size // 5 + 1)), list(mine)
            at = slice(0, cut) if rng.random() < 0.5 else slice(size - cut, size)
            piece[at] = [f"z{w}" for w in rng.integers(0, 10**6, cut)]
            sets = [{tuple(x[i : i + 5]) for i in range(size - 4)} for x in (mine, piece)]
            if len(sets[0] & sets[1]) >= 0.8 * len(sets[0]):
                wanted += 1
                text = " ".join(["before"] * 30 + piece + ["after"] * 30)
                found += k in index.matches(text, 0.8, known)
    assert wanted > 100 and found == wanted


def test_edited_leaks_are_found_at_any_distance():
    rng, known = np.random.default_rng(8), common.WordHashes()
    items = [(i, " ".join(f"w{w}" for w in rng.integers(0, 10**6, int(rng.integers(15, 60))))) for i in range(300)]
    index, far = decontaminate.Items(items, 5), 0
    for k, (_, item) in enumerate(items):
        piece = item.split()
        kept = len(piece) - int(0.2 * (len(piece) - 4))  # the last words replaced: at least 0.8 of the shingles stay
        text = " ".join(["before"] * 70 + piece[:kept] + [f"z{w}" for w in rng.integers(0, 10**6, 70)])
        got = index.matches(text, 0.8, known)
        assert list(got) == [k] and got[k][0] == (kept - 4) / (len(piece) - 4)
        far += got[k][2] > 11
    assert far > 0


def test_texts_shorter_than_the_item_are_one_window():
    rng, known = np.random.default_rng(9), common.WordHashes()
    items = [(i, " ".join(words(rng, int(rng.integers(5, 60))))) for i in range(40)]
    index, found = decontaminate.Items(items, 5), 0
    for k, (_, item) in enumerate(items):
        for cut in range(12):
            for text in (item.split()[cut:], item.split()[: len(item.split()) - cut]):
                h = decontaminate.hashed(text, known)
                got = index.matches(" ".join(text), 0.8, known)
                for other, size in enumerate(index.lengths.tolist()):  # every window of the item's size, or all
                    scores = [index.similarity(decontaminate.grams(h[s : s + size], 5), other) for s in range(max(len(h) - size, 0) + 1)]
                    assert got.get(other, (0.0, 0))[:2] == ((max(scores), scores.index(max(scores))) if max(scores) >= 0.8 else (0.0, 0))
                found += cut > 0 and k in got
    assert found > 0


def test_leak_queries(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)  # several blocks of items
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "too short"), (5, "one two three four five six seven")], "item_id int, text string")
    rows = [(10, f"start {item.upper()}, end", None, "a"), (11, "clean words only here and there again", None, "a"), (None, item, None, "a"), (12, None, None, "a"), (13, "", None, "a"), (10, item, None, "b"), (14, "x " * 30000 + item + " y" * 30000, None, "b")]
    df = docs_of(spark, rows).withColumn("item_id", F.lit("clash"))
    got = sorted(((r["doc_id"], r["item_id"], r["first_word"]) for r in decontaminate.find_leaks(df, bench).collect()), key=str)
    assert got == sorted([(d, k, w) for d, w in ((10, 1), (10, 0), (None, 0), (14, 30000)) for k in (1, 2)], key=str)
    kept = decontaminate.decontaminate(df, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [11, 12, 13] and kept.columns == df.columns
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.decontaminate(df, bench.limit(0)).count() == 7
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0


def test_blocks_weigh_by_all_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)  # each item is a block
    first, second = " ".join(f"a{i}" for i in range(10)), [f"b{i}" for i in range(24)]
    bench = spark.createDataFrame([(1, first), (2, " ".join(second))], "item_id int, text string")
    rows = [(i, f"{first} x{i} {' '.join(second[15:])}", None, "a") for i in range(30)] + [(30, " ".join([*second[:19], *"pqrstuvw"]), None, "a")] + [(31 + i, f"clean text number {i} here", None, "a") for i in range(9)]
    df = docs_of(spark, rows)
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(df, bench).collect()}
    assert leaks == set(range(31))
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()) == list(range(31, 40))


# --- 5: TIFF --------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS, tiff.OLD_DEFLATE])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, order):
    rng = np.random.default_rng(compression)
    for predictor in (1, 2):
        for tile in (None, (16, 16), (48, 16)):
            for kind in (np.uint8, np.uint16, np.uint32):
                pages = [rng.integers(0, 50, (h, w, s)).astype(kind) for h, w, s in ((1, 1, 1), (5, 7, 3), (40, 33, 1))]
                got = list(tiff.Reader(tiff.write(pages, compression=compression, predictor=predictor, tile=tile, order=order, rows=16)).pages())
                assert [p.data for p in got] == [p.tobytes() for p in pages]


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=6000))
def test_codecs_round_trip(data):
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data


def test_lzw_clears_its_table():
    data = np.random.default_rng(0).integers(0, 256, 60000).astype(np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data


def test_predictor_3_planes_and_bits():
    import struct

    a = np.random.default_rng(1).normal(0, 1, (3, 5, 1)).astype(">f4")
    raw = a.view(np.uint8).reshape(3, 5, 4).transpose(0, 2, 1).reshape(3, 20)
    coded = np.concatenate([raw[:, :1], raw[:, 1:] - raw[:, :-1]], axis=1).tobytes()
    reader = tiff.Reader(tiff.write([np.zeros((1, 1, 1), np.uint8)]))
    block = reader.block(np.frombuffer(coded, np.uint8).reshape(3, 20), 5, 1, 32, np.dtype("<u4"), 3)
    assert (block.view("<f4") == a.astype("<f4")).all()
    bits = reader.block(np.array([[0b10100000]], np.uint8), 3, 1, 1, np.dtype("u1"), 1)
    assert bits.ravel().tolist() == [1, 0, 1]
    tags = [(256, 4, 1, 2), (257, 4, 1, 1), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 3, 134), (277, 3, 1, 3), (278, 4, 1, 1), (279, 4, 3, 146), (284, 3, 1, 2)]
    body = struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    body = body.ljust(134, b"\0") + struct.pack("<6I", 158, 160, 162, 2, 2, 2) + bytes([1, 2, 3, 4, 5, 6])
    assert next(tiff.Reader(body).pages()).data == bytes([1, 3, 5, 2, 4, 6])


def test_tiff_rows(spark):
    good = tiff.write([np.zeros((2, 2, 1), np.uint8), np.ones((1, 3, 1), np.uint8)])
    rows = [(1, good), (2, None), (3, b""), (4, b"no image"), (5, good[:-3]), (1, good), (6, b"II*\0\xff\xff\xff\x7f")]
    df = spark.createDataFrame(rows, "id int, media binary").withColumn("page", F.lit("clash"))
    got = tiff.read_pages(df).collect()
    by = [(r["id"], r["page"], r["error"] is not None) for r in got]
    assert by.count((1, 0, False)) == 2 and by.count((1, 1, False)) == 2
    assert {(2, 0, True), (3, 0, True), (4, 0, True), (6, 0, True)} <= set(by) and any(i == 5 and e for i, _, e in by)
    assert tiff.read_pages(df.limit(0)).count() == 0
    files = sorted(((r["id"], r["pages"], r["error"] is None) for r in tiff.joined_pages(tiff.read_pages(df), ["id", "media"]).collect()))
    assert files == sorted([(1, 2, True), (1, 2, True), (2, 0, False), (3, 0, False), (4, 0, False), (6, 0, False), next((i, n, e) for i, n, e in files if i == 5)])
    small = tiff.read_pages(df.filter("id = 1"), most_bytes=3).collect()
    assert [(r["page"], r["error"] is None) for r in small] == [(0, False)] * 2


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_short_strips_are_errors(compression):
    for keep in (0, 1, 20):
        data = bytearray(tiff.write([np.random.default_rng(1).integers(0, 256, (8, 20, 1)).astype(np.uint8)], compression=compression))
        at = data.index(struct.pack("<HHI", tiff.STRIP_COUNTS, 4, 1)) + 8
        data[at : at + 4] = struct.pack("<I", keep)
        with pytest.raises(tiff.TiffError):
            list(tiff.Reader(bytes(data)).pages())


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 3), st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), min_size=1, max_size=6))
def test_broken_files_are_errors(form, changes):
    """Any bytes give pages or a TiffError: zero counts, negative and fractional tags among them."""
    data = bytearray(tiff.write([np.ones((6, 9, 1), np.uint8), np.zeros((20, 18, 3), np.uint16)], compression=(tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS)[form], predictor=1 + form % 2, order="<>"[form // 2], tile=(16, 16) if form == 1 else None))
    for at, value in changes:
        data[at % len(data)] = value
    try:
        list(tiff.Reader(bytes(data), 1 << 20).pages())
    except tiff.TiffError:
        pass


def test_odd_tags_are_errors():
    plain = tiff.write([np.ones((2, 2, 1), np.uint8)])
    at = plain.index(struct.pack("<HHI", tiff.WIDTH, 4, 1))
    for kind, count, value in ((4, 0, b"\0\0\0\0"), (9, 1, struct.pack("<i", -2)), (11, 1, struct.pack("<f", 2.0))):
        with pytest.raises(tiff.TiffError):
            list(tiff.Reader(plain[:at] + struct.pack("<HHI", tiff.WIDTH, kind, count) + value + plain[at + 12 :]).pages())


def test_payloads(spark):
    texts = [None, "", "a" * 576, "é" * 1000, "same", "same", "x" * 200_000, *(" ".join(words(np.random.default_rng(i), 60 * i)) for i in range(1, 60))]
    df = docs_of(spark, [(i, t, None, "s") for i, t in enumerate(texts)]).withColumn("media", F.lit(1))
    pages = tiff.read_pages(tiff.payload_files(df))
    got = tiff.joined_pages(pages, ["doc_id", "n_bytes", "media"]).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        size = max(576, -(-len(raw) // 576) * 576)
        assert r["n_bytes"] == len(raw) and bytes(r["samples"]) == raw.ljust(size, b"\xff") and r["error"] is None
    assert got[4]["media"] == got[5]["media"] and got[4]["feature"] == got[5]["feature"]
    seen = pages.collect()
    assert {r["compression"] for r in seen} == {tiff.LZW, tiff.DEFLATE, tiff.PACKBITS} and {r["page"] for r in seen} == {0, 1, 2}
    assert {bytes(r["media"][:2]) for r in got} == {b"II", b"MM"} and {r["predictor"] for r in seen} == {1, 2}


# --- 6: quality -----------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice("the cat sat on a mat and saw some birds".split()) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(["win$$$", "BUY!!", "%%%", "click&&&"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), None, "s") for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100)] + [(5, None), (None, 1), (7, 9)], "doc_id long, quality int")
    df = docs_of(spark, [*rows, (900, None, None, "s"), (901, "", None, "s"), (1, "the cat", None, "s"), (902, "good words " * 5000, None, "s")]).withColumn("score", F.lit("clash"))
    model = quality.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(df, model).collect() if r["doc_id"] >= 100}
    assert all((got[i] >= 0.3) == (i % 3 > 0) for i in range(100, 150)) and 0 <= got[900] == got[901] <= 1
    sampled = quality.train(df, labels, most_rows=40)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(df, sampled).collect()}
    assert sum((got[i] >= 0.3) == (i % 3 > 0) for i in range(100, 150)) >= 48
    assert quality.train(df, labels.limit(0)) is None
    assert quality.score_quality(df, None).select("score").distinct().first()["score"] == 0.5
    one = quality.train(df, labels.filter("quality = 1"))
    assert quality.score_quality(df, one).first()["score"] > 0.9
    assert quality.score_quality(df.limit(0), model).count() == 0


def plain_grams(text):
    """The features of a text, one by one, in whole numbers of Python."""
    mask, c = (1 << 64) - 1, [48 if 48 <= ord(x) <= 57 else ord(x) for x in text]

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return (x ^ x >> 31) % quality.WIDTH

    found = set()
    for n in range(1, 5):
        for i in range(len(c) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x9E3779B97F4A7C15 + c[i + k] + k + 1) & mask
            found.add(mixed(h))
    kind = [0 if x <= 32 else 1 if 97 <= x <= 122 else 2 if 65 <= x <= 90 else 3 if x == 48 else 4 if x > 127 else x for x in c]
    runs = []
    for x in kind:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    shape = [4 * x + min(n, 3) for x, n in runs]
    for n in range(1, 4):
        for i in range(len(shape) - n + 1):
            h = shape[i] + (1 << 40)
            for k in range(1, n):
                h = (h * 0x9E3779B97F4A7C15 + shape[i + k] + (k << 50)) & mask
            found.add(mixed(h))
    words = text.split()
    same = bytes(a == b for a, b in zip(words, words[1:], strict=False))
    return sorted(found | {i for i, p in enumerate(quality.REPEATS) if p in same})


def test_quality_equals_plain_counts(spark):
    """Features, counts, ratios, fit and scores against loops over the rows."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "The", "cat", "12", "win$$$", "é", "the the"]) for _ in range(rng.randrange(0, 30))), None, "s") for i in range(80)] + [(80, None, None, "s"), (80, "again", None, "s")]
    labels = {i: int(i % 3 > 0) for i in range(0, 81, 2)}
    model = quality.train(docs_of(spark, rows), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    for _, t, _, _ in rows:
        assert quality.grams(t).tolist() == (plain_grams(t) if t else [])
    pos, neg = np.ones(quality.WIDTH), np.ones(quality.WIDTH)
    known = [(labels[i], plain_grams(t) if t else []) for i, t, _, _ in rows if i in labels]
    for y, at in known:
        (pos if y else neg)[at] += 1
    r = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    np.testing.assert_allclose(model["r"].value, r, rtol=1e-5, atol=1e-6)
    order = sorted(known, key=lambda x: (x[0], len(x[1]), np.array(x[1], np.int32).tobytes()))
    w, a, b = quality.fit([np.array(x[1], np.int64) for x in order], np.array([x[0] for x in order]), r.astype(np.float32))
    np.testing.assert_allclose(model["w"], w, rtol=1e-3, atol=1e-4)
    for i, row in enumerate(quality.score_quality(docs_of(spark, rows), model).collect()):
        at = plain_grams(rows[i][1]) if rows[i][1] else []
        x = r[at] / max(np.sqrt((r[at] ** 2).sum()), 1e-9)
        want = 1 / (1 + np.exp(-(a * (w[at] @ x + w[quality.WIDTH]) + b)))
        assert abs(row["score"] - want) < 1e-3


def test_descent_reaches_the_optimum():
    """The duality gap closes, which no other point than the optimum does."""
    rng = np.random.default_rng(4)
    samples = [(np.sort(rng.choice(50, 8, replace=False)), rng.normal(0, 1, 8)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    cost = np.full(60, 0.7)
    w = quality.descend(samples, y, cost, rounds=2000)
    margin = np.array([w[i] @ x + w[quality.WIDTH] for i, x in samples])
    primal = 0.5 * w @ w + (cost * np.maximum(0, 1 - y * margin)).sum()
    better = [0.5 * v @ v + (cost * np.maximum(0, 1 - y * np.array([v[i] @ x + v[quality.WIDTH] for i, x in samples]))).sum() for v in (w + d for d in rng.normal(0, 0.01, (20, len(w))) * (w != 0))]
    assert primal <= min(better) + 1e-6


# --- 7: HTML --------------------------------------------------------------------------------


def test_main_text_by_marks():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav><div class="cookie-notice">ok?</div>
    <article><header><h1>A &amp; B</h1></header><p>one  two<br>three<p>x &lt;y&gt;&nbsp;z<ul><li>i<li>j</ul><aside>no</aside><form><input>no</form><script>var a = "<p>";</script><!-- no --><b>bold</b> tail</article>
    <div id="comments"><article>nice</article></div><aside class="sidebar">s</aside><footer>f</footer></body></html>"""
    assert html_text.main_text(page, frozenset()) == "A & B\none two three\nx <y> z\ni\nj\nbold tail"
    assert html_text.main_text("<p>a<p>b &am", frozenset()) == "a\nb &am"
    assert html_text.main_text("", frozenset()) == ""
    assert html_text.main_text("<div><div><p>deep</div>after</div>" * 300, frozenset()).count("deep") == 300


@pytest.mark.parametrize(
    "marks",
    ['div style="overflow:hidden"', "div aria-hidden=false", 'div title="hidden costs"', 'div data-hidden data-class="ad"', "div data-role='menu'", 'div class="content has-sidebar"', "div class=has-sidebar", 'div class="page" class="ad"', "div title='a > b' lang=en"],
)
def test_marks_are_whole_attributes(marks):
    assert html_text.main_text(f"<{marks}><article class='post comments-open'><p>one</p><p style='overflow:hidden'>two</p></article></div><div class=ad>no</div>", frozenset()) == "one\ntwo"


def test_marked_noise_still_goes():
    for marks in ("hidden", "HIDDEN=''", 'aria-hidden="true"', "class='x ad'", 'class="cookie-notice"', "role=menu", "class=comment-list"):
        assert html_text.main_text(f"<article><p>one</p><div {marks}>no</div></article>", frozenset()) == "one", marks
    assert html_text.main_text("<article><p>one</p></article><ol class=comment-list><li class='comment even'><article class=comment-body>no</article></ol>", frozenset()) == "one"
    assert html_text.main_text("<div class='content has-sidebar'><p>one</p></div><div class=sidebar>no</div>", frozenset()) == "one"


def test_words_of_noise_in_longer_names_stay_in_articles():
    for name in ("social-history", "tags-explained", "comment-culture", "adProduct", "footer-notes story"):
        assert html_text.main_text(f"<article><p>one</p><div class='{name}'><p>two</p></div></article><div class='{name.split()[0]}-x'>no</div>", frozenset()) == "one\ntwo", name
    for name in ("share", "comment-list", "newsletter signup", "adBox"):
        assert html_text.main_text(f"<article><p>one</p><div class='{name}'><p>two</p></div></article>", frozenset()) == "one", name


def test_style_tree_removes_shared_branches(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    page = lambda: f"<body><div class=x1><p>Shared line</p><p>Shared {rng.choice('ab')}</p></div><div class=x2><p>{word()} {word()}</p><p>{word()}</p></div></body>"
    rows = [(i, "http://big.example.com/p", page()) for i in range(40)] + [(100, "http://small.example.com/", page()), (101, None, None), (102, "no host", ""), (1, "http://big.example.com/p", page())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumns({c: F.lit(1) for c in ("host_", "of_", "noisy_", "host", "path")})
    got = html_text.extract(df).collect()
    for r in got:
        if r["page_id"] == 100:
            assert r["text"].startswith("Shared line\n") and r["text"].count("\n") == 3
        elif r["page_id"] > 100:
            assert (r["text"], r["n_chars"]) == ("", 0)
        else:
            assert "Shared" not in r["text"] and r["text"].count("\n") == 1 and r["n_chars"] == len(r["text"])
    assert html_text.extract(df.limit(0)).count() == 0
    tree = {r["host"]: r["importance"] for r in html_text.style_tree(df).orderBy("importance").collect()}
    assert set(tree) == {"big.example.com", "small.example.com"}


def test_style_tree_reaches_into_marked_articles(spark):
    body = lambda i: f"<article><h1>title {i}</h1><p>text {i}</p><div class=x9><p>Shared line</p></div></article>"
    copy = "<article><h1>one</h1><div class=x9><p>same text</p></div></article>"
    rows = [(i, "http://big.example.com/p", body(i)) for i in range(40)] + [(100, "http://small.example.com/", body(100))] + [(200 + i, "http://copies.example.com/", copy) for i in range(20)]
    rows.append((300, "http://big.example.com/q", "<article><div class=x9><p>Shared line</p></div></article>"))
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"title {i}\ntext {i}" for i in range(40))
    assert got[100] == "title 100\ntext 100\nShared line"  # too few pages for an entropy
    assert all(got[200 + i] == "one\nsame text" for i in range(20))  # the article itself is what repeats
    assert got[300] == "Shared line"  # a marked article is not emptied


def test_unmarked_pages_equal_a_plain_tree(spark):
    """Pages without a mark and with misleading names: what the tree of a host says, worked out from nested lists."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    line = lambda shared: shared if rng.random() < 0.9 else word()

    def page(host):
        """A nested list: a node is (tag, class, children), a text a string."""
        tell = {"big": 1.0, "mid": 0.5}.get(host, 0.0)
        parts = [("div", "x1", [("p", "", ["Home"]), ("p", "", [line("Products")])]), ("div", "x2", [("p", "", [f"{word()} {word()}"]) for _ in range(rng.randrange(1, 4))])]
        parts += [("div", "historyofads", [("p", "", [word()])]), ("div", "x3", [("p", "", ["Same line" if rng.random() < tell else word()])]), ("div", "x4", [("div", "x5", [("p", "", [rng.choice(["Left", "Right"])])]), ("p", "", [word()])])]
        return ("body", "", parts)

    def html(node):
        return node if isinstance(node, str) else f"<{node[0]}{' class=' + node[1] if node[1] else ''}>{''.join(map(html, node[2]))}</{node[0]}>"

    def walk(node, path):
        path = (*path, (node[0], node[1]))
        yield path, 0, tuple(c[:2] for i, c in enumerate(x for x in node[2] if not isinstance(x, str)) if not i or c[:2] != [x for x in node[2] if not isinstance(x, str)][i - 1][:2])
        for child in node[2]:
            if isinstance(child, str):
                yield path, 1, child
            else:
                yield from walk(child, path)

    made = [(host, page(host)) for host, n in (("big", 40), ("mid", 14), ("few", 3)) for _ in range(n)]
    noisy = {}
    for host in ("big", "mid", "few"):
        facts = [{f for f in walk(p, ())} for h, p in made if h == host]
        count = {}
        for each in facts:
            for f in each:
                count[f] = count.get(f, 0) + 1
        noisy[host] = set()
        for path in {f[0] for f in count}:
            own = [n for (p, kind, _), n in count.items() if p == path and kind == 0]
            below = [n for (p, kind, _), n in count.items() if p[: len(path)] == path and kind == 1]
            m = sum(own)
            if not below:
                continue
            entropy = -sum(n / m * np.log(n / m) for n in own) / np.log(m) if m > 1 else 1.0
            content = 1 - sum(map(np.log, below)) / len(below) / np.log(m) if m > 1 else 1.0
            importance = 0.1 * entropy + 0.9 * max(content, 0.0)
            if 1 - (1 - importance) * m / (m + 4) < 0.4:
                noisy[host].add(path)
    df = spark.createDataFrame([(i, f"http://{h}.org/{i}", html(p)) for i, (h, p) in enumerate(made)], "page_id long, url string, html string")
    decided = 0
    for r in html_text.extract(df).collect():
        host, p = made[r["page_id"]]
        texts = [(path, t) for path, kind, t in walk(p, ()) if kind == 1]
        left = [t for path, t in texts if not any(path[:i] in noisy[host] for i in range(1, len(path) + 1))]
        assert r["text"] == "\n".join(left), (host, r["page_id"])
        decided += len(left) < len(texts)
    assert decided >= 40 and not noisy["few"]


def test_importance_equals_its_definition(spark):
    texts = ["a", "a", "a", "b", "c", "d", "d", "e"]
    df = spark.createDataFrame([(f"http://h/{i}", f"<body><div><p>{t}</p></div></body>") for i, t in enumerate(texts)], "url string, html string")
    got = {round(r["importance"], 9) for r in html_text.style_tree(df).collect()}
    logs = [np.log(texts.count(t)) for t in sorted(set(texts))]
    want = 0.9 * (1 - sum(logs) / len(logs) / np.log(8))
    assert got == {round(want, 9)}


# --- 8: URL rules ---------------------------------------------------------------------------

SITES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def brute_verdict(url, patterns=url_filter.PATTERNS):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL)
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    fits = []
    for action, rule in SITES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    if fits:
        _, rule, action = max(fits)
        return host, path, rule, action
    bad = any(re.search(f"(^|[^A-Za-z0-9]){p.strip('^')}([^A-Za-z0-9]|$)", host + path) for _, p in patterns)
    return host, path, None, "block" if bad else "allow"


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(5)
    hosts, tails = ["a.example.com", "EXAMPLE.net", "xnet", "net", "b.org", "casino.org", "my-casino-win.net", "org", "é.com", "com:80"], ["", "/", "/en/7", "/en/71?x", "/de/8#y", "/de/", "/es/1", "/EN/7", "/en", "?q=/en/", "#://net/de/", "/spam/x", "/spa\u212am"]
    urls = [rng.choice(["http://", "https://", "x://"]) + rng.choice(hosts) + rng.choice(tails) for _ in range(200)] + [None, "", "com/en/", "://net/de/1", "http://"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:20])], "page_id int, url string").withColumns({c: F.lit(0) for c in ("host", "rule", "host_", "path_", "token", "seen", "best")})
    got = url_filter.judge(df, url_filter.rule_table(spark, SITES)).collect()
    assert len(got) == len(urls) + 20
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_verdict(r["url"]), r["url"]
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark, SITES)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, url_filter.rule_table(spark, [], [])).collect()} == {"allow"}


def test_url_patterns(spark):
    rules = url_filter.rule_table(spark, [], [("block", "*track*pixel*"), ("allow", "^ok^"), ("block", "^good^pixel")])
    urls = {"http://a.com/mytrackerpixels": "block", "http://ok.com/x": "allow", "http://good.pixel": "block", "http://goods.pixel": "allow"}
    got = url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()
    assert {r["url"]: r["verdict"] for r in got} == urls


# --- 9: mixing ------------------------------------------------------------------------------


def brute_targets(sizes, epochs=3.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > epochs * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), None, rng.choice(["b", "é", None] + ["big"] * 9)) for i in range(600)]
    rows += [(5000, "tiny", None, "a"), (5001, None, None, "a"), (5002, "", None, "zero"), (None, "x y", None, "big"), (None, "x y", None, "big")]
    df = docs_of(spark, rows).withColumn("size", F.lit("clash")).withColumn("hash_", F.lit(1)).withColumn("weight", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine)
        assert all(r["size"] * (want[s] // max(sizes[s], 1)) <= r["taken"] <= 3 * r["size"] for r in mine)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(df.limit(0)).count() == 0
    copies = mixing.repeated(mixing.mix(df), ["doc_id", "text"]).count()
    assert copies == sum(r["taken"] // r["size"] for r in got if r["size"])


def test_mix_of_repeated_rows(spark):
    rows = [(7, "w w w w", None, "a")] * 50 + [(8 + i, "w w w", None, "a") for i in range(3)] + [(None, "v v v v", None, "b")] * 30 + [(100 + i, "x", None, "c") for i in range(9)]
    df = docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("src_", "whole_", "rest_", "last_", "full_", "tied_", "hash_", "sum_", "number_", "part", "of_source")}).repartition(3)
    mixed = mixing.mix(df)
    got = mixed.collect()
    assert len(got) == len(rows) and set(mixed.columns) == {*df.columns, "size", "source_size", "target", "taken"}
    for s in "abc":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine), s
        assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"] for r in mine)
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(got) == key(mixing.mix(df.repartition(5)).collect())
    again = mixed.withColumns({c: F.lit(0) for c in ("copy_", "copy")})
    assert mixing.repeated(again, ["doc_id"]).count() == sum(r["taken"] // r["size"] for r in got)


def test_mix_with_given_weights(spark):
    df = docs_of(spark, [(i, "w " * 10, None, "ab"[i % 2]) for i in range(400)])
    weights = spark.createDataFrame([("a", 3.0), ("c", 9.0)], "source string, weight double")
    got = mixing.mix(df, weights=weights).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert {r["source"]: (r["t"], r["g"]) for r in got} == {"a": (4000, 4000.0), "b": (0, 0.0)}


# --- 10: sharding ---------------------------------------------------------------------------


def brute_shard(key, n):
    return max(range(n), key=lambda i: (int(hashlib.md5(f"shard{i}:{'' if key is None else key}".encode()).hexdigest()[:13], 16), -i))


def test_shards(spark):
    rows = [(i, "t" * (i % 50), None, "s") for i in range(3000)] + [(None, "é", None, "s"), (7, None, None, "s"), (7, None, None, "s"), (8, "", None, "s")]
    df = docs_of(spark, rows).withColumn("shard", F.lit("clash")).withColumn("cell", F.lit(1)).withColumn("digest", F.lit(1))
    got = sharding.shard(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["shard"] == brute_shard(r["doc_id"], 16) and r["grown_shard"] == brute_shard(r["doc_id"], 17) and r["grown_shard"] in (r["shard"], 16)
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    place = lambda rs: sorted((str(r["doc_id"]), r["size"], r["shard"], r["slot"]) for r in rs)
    assert place(got) == place(sharding.shard(df.repartition(5)).collect())
    assert sharding.shard(df.limit(0)).count() == 0


def test_shards_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    rows = [(7, "x", None, "s")] * 100 + [(None, "y" * (i % 3), None, "s") for i in range(60)] + [(i, "z", None, "s") for i in range(300)]
    df = docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("at", "first", "rows_", "at_", "first_", "hot", "of_shard", "cell", "digest", "part")}).repartition(3)
    placed = sharding.shard(df)
    got = placed.collect()
    assert len(got) == len(rows) and set(placed.columns) == {*df.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    assert all(r["shard"] == brute_shard(r["doc_id"], 16) for r in got)
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_weighted_shards(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = {r["shard"]: r["n"] for r in sharding.shard(df, weights=[1.0, 0.0, 3.0]).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {0, 2} and 0.72 < got[2] / 20000 < 0.78
    moved = sharding.shard(df, weights=[1.0, 0.0, 3.0]).filter("grown_shard not in (shard, 3)").count()
    assert moved == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("x"), [0.0])


# --- all: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names ----

#: Names that operators use for columns of their own.
CLASHES = """size score host path rule t doc node n d1 d2 sig sketch carried key comp first copies k hash_ cell_ src_ media n_bytes page samples feature error shard slot cell
    digest noisy_ of_ host_ path_ stays rows gone_ copy_ taken target source_size sum_ number_ whole_ last_ tied_ full_ part at of_shard of_cell hot group least links item_id similarity
    lang_pred proportions held_out token verdict pattern n_chars formatted loss_mask blocks a_ b_ own_ text_crc32 law grown_shard predicted y id""".split()
LONG = "The quick brown fox jumps over a lazy dog 12 times. " * 100_000


def odd_docs(spark):
    rows = [(1, "plain words of a first text", "en", "a"), (1, "plain words of a first text", "en", "a"), (1, "another text with the same id", "en", "a"), (None, "plain words of a first text", None, None), (None, None, None, None), (2, None, "en", "b"), (3, "", "en", "b"), (4, " \t\n ", "fr", "b"), (5, LONG, "en", "a"), (6, "\u0000 \U0001f600 e\u0301", "xx", ""), (7, "one", "en", "a"), (8, "one", "en", "a")]
    return docs_of(spark, rows).withColumns({c: F.lit("clash") for c in CLASHES})


def odd_cases(spark):
    bench = spark.createDataFrame([(1, "words of a first text"), (None, "one"), (2, None), (3, ""), (4, "another text with the same id")], "item_id int, text string")
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None), (8, 1), (2, 0), (3, 5)], "doc_id long, quality int")
    docs = odd_docs(spark)
    model, langs = quality.train(docs, labels), language.train(docs.filter(~language.held_out("doc_id")))
    pages = lambda d: d.withColumn("url", F.concat(F.lit("http://h.com/"), "doc_id")).withColumn("html", F.concat(F.lit("<p>"), "text"))
    files = lambda d: tiff.joined_pages(tiff.read_pages(tiff.payload_files(d)), ["doc_id", "n_bytes", "media"])
    chats = lambda d: format_chats(d, conv_col="doc_id", turn_col="source", role_col="lang")
    return docs, {
        "jaccard_join": (jaccard_join.jaccard_join, 12),
        "without_near_duplicates": (jaccard_join.without_near_duplicates, 9),
        "identify": (lambda d: language.identify(d, langs), 12),
        "language train": (lambda d: language.identify(docs, language.train(d)), 12),
        "format_chats": (lambda d: chat.digests(chats(d), "doc_id"), 9),
        "find_leaks": (lambda d: decontaminate.find_leaks(d, bench), 4),
        "decontaminate": (lambda d: decontaminate.decontaminate(d, bench), 8),
        "payloads": (files, 12),
        "score_quality": (lambda d: quality.score_quality(d, model), 12),
        "quality train": (lambda d: quality.score_quality(docs, quality.train(d, labels)), 12),
        "extract": (lambda d: html_text.extract(pages(d)), 12),
        "judge": (lambda d: url_filter.judge(pages(d), url_filter.rule_table(spark, SITES)), 12),
        "mix": (mixing.mix, 12),
        "shard": (sharding.shard, 12),
    }


def test_odd_rows_and_names(spark):
    docs, cases = odd_cases(spark)
    for name, (run, rows) in cases.items():
        out = run(docs)
        got = out.collect()
        assert len(got) == rows, name
        if name in ("without_near_duplicates", "decontaminate"):
            assert out.columns == docs.columns
        if "text" in out.columns and name != "extract":
            assert any(r["text"] == LONG for r in got), name
        if name not in ("language train", "quality train"):
            assert run(docs.limit(0)).count() == 0, name
        else:
            run(docs.limit(0)).count()

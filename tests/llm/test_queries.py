"""The registered queries: SQL, held-out accuracy, round trips, and the pipeline against brute force."""

import hashlib
import math
import zlib
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lensmill.llm import common, mixing, queries, sharding, tiff

from ..conftest import DATA
from ..test_oracles import canon
from .test_operators import LONG, brute_components, odd_docs


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.collect(), df.columns) == canon(want.fetchall(), columns)


def rows_of(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def test_languages_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in rows_of("documents")}
    got = [r for r in queries.QUERIES["op2_language_mixture"](spark, DATA).collect() if r["held_out"]]
    assert len(got) > 20 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_quality_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["quality"] for r in rows_of("labels")}
    got = [r for r in queries.QUERIES["op6_quality_classifier"](spark, DATA).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in got) >= 0.85 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_leaks_equal_a_search_of_all_windows(spark):
    """Every window of every text against every item, by sets of five words, both ways."""
    import math
    import re

    said = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    docs, items = rows_of("documents"), {r["item_id"]: said(r["text"]) for r in rows_of("benchmark")}
    sets = {k: set(grams(w)) for k, w in items.items()}
    texts = [(r["doc_id"], said(r["text"])) for r in docs]
    all_grams, df = set().union(*sets.values()), {}
    for _, w in texts:
        for g in set(grams(w)) & all_grams:
            df[g] = df.get(g, 0) + 1
    weight = {g: math.log((len(texts) + 1) / (df.get(g, 0) + 1)) + 1 for g in all_grams}
    want = {}
    for d, w in texts:
        mine = grams(w)
        shared = set(mine) & all_grams
        for k, item in items.items():
            total = sum(weight[g] for g in sets[k])
            if sum(weight[g] for g in sets[k] & shared) < 0.8 * total - 1e-9:
                continue
            span = max(len(item) - 4, 0)
            scores = [sum(weight[g] for g in sets[k] & set(mine[s : s + span])) / total for s in range(max(len(w) - len(item), 0) + 1)]
            if max(scores) >= 0.8:
                want[d, k] = (round(max(scores), 9), len(item))
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["n_words"]) for r in queries.QUERIES["op4_benchmark_leaks"](spark, DATA).collect()}
    assert got == want and len(want) > 0


def test_payloads_come_back(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_tiff_payloads"](spark, DATA).collect()}
    for r in rows_of("documents"):
        raw = r["text"].encode()
        payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = tiff.payload_image(r["text"])[1]
        assert (g["media_bytes"], g["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        at, pages = 0, g["feature"].split(" ")
        for page in pages:  # width x height x samples : mean : deviation : entropy
            shape, *numbers = page.split(":")
            part = payload[at : at + 576 * int(shape.split("x")[1])]
            at += len(part)
            mean = sum(part) / len(part)
            share = [part.count(bytes([i])) / len(part) for i in set(part)]
            want = (mean, (sum((x - mean) ** 2 for x in part) / len(part)) ** 0.5, -sum(p * math.log2(p) for p in share))
            assert all(abs(float(x) - y) < 1e-4 for x, y in zip(numbers, want, strict=True))
        assert at == len(payload) and len(pages) <= 3


def test_pages_give_their_articles(spark):
    import html
    import re

    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op7_main_text"](spark, DATA).collect()}
    for r in rows_of("pages"):
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(common.written(stage(spark, tables[-1], DATA), "test")[0])
    columns = docs.columns
    assert all(t.columns == columns for t in tables[:-1]) and set(columns) < set(tables[-1].columns)
    ids = [sorted(r["doc_id"] for r in t.select("doc_id").collect()) for t in tables]
    # Quality: what the query rejects goes.
    scored = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op6_quality_classifier"](spark, DATA).collect()}
    assert ids[1] == sorted(d for d in ids[0] if scored[d])
    # Near duplicates: the least id of each component, by brute force.
    kept = [(d, before[d]) for d in ids[1]]
    assert ids[2] == sorted({c for _, _, c, _ in brute_components(kept, 5, 80, 100)})
    # Decontamination: no text holds an item, and only those that hold (almost all of) one went.
    items = [r["text"] for r in rows_of("benchmark")]
    assert not any(i in before[d] for d in ids[3] for i in items)
    assert {d for d in ids[2] if any(i in before[d] for i in items)} == set(ids[2]) - set(ids[3])
    # Mixing: as often as the operator says. Sharding: all rows, gapless.
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(tables[3]).collect() if r["size"]}
    assert ids[4] == sorted(d for d, n in taken.items() for _ in range(n))
    assert ids[5] == ids[4]
    for s in range(corpus_pipeline.SHARDS):
        slots = sorted(r["slot"] for r in tables[5].filter(F.col("shard") == s).select("slot").collect())
        assert slots == list(range(len(slots)))
    assert {r["doc_id"] for r in tables[5].filter(F.col("shard") == sharding.rendezvous(F.col("doc_id"), [1.0] * 16)).collect()} == set(ids[5])


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 50 and "shard" in out.columns


def test_stages_take_odd_rows(spark):
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        got = out.collect()
        if name == "near duplicates":
            assert len(got) == 9 and sum(r["text"] == "one" for r in got) == 1 and any(r["text"] == "another text with the same id" for r in got)
        if name == "benchmark decontamination":
            assert len(got) == 12
        if name == "mixing sources":
            assert not any(not (r["text"] or "").split() for r in got)
        assert all(r["size"] == "clash" for r in got) and stage(spark, docs.limit(0), DATA).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == 12 and any(r["text"] == LONG for r in last.select("text").collect()) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0

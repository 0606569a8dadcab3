"""Operators against small literal tables and plain Python."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensmill import schemas
from lensmill.functions import dates, detect, features, hashes, maths, strings, vectors
from lensmill.operators import browse, cluster, dedup, merge, recommend, rollup, sessions, text_search, vector
from lensmill.plans import pipeline, plugins, tasks
from lensmill.sources import backup, codecs, media_files
from lensmill.sources.store import Store
from lensmill.streaming import live


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items())) if values else spark.range(1)
    return row.select(*columns).first()


def kind(v):
    return {bool: "boolean", int: "long", float: "double", str: "string", list: "array<float>", bytes: "binary", type(None): "string"}[type(v)]


LISTING = [("/album/c.jpg", "c.jpg", "IMAGE", 30, 10, 100, False), ("/album/A.jpg", "A.jpg", "IMAGE", 10, 30, 300, False), ("/album/b.mp4", "b.mp4", "VIDEO", 20, 20, 200, False), ("/other/z.jpg", "z.jpg", "IMAGE", 99, 99, 999, False), ("/album/trashed.jpg", "trashed.jpg", "IMAGE", 40, 40, 400, True)]


@pytest.fixture
def listing(spark):
    df = spark.createDataFrame(LISTING, "filePath string, fileName string, mediaType string, capturedAtMs long, modifiedAtMs long, fileSize long, isTrashed boolean")
    return df.withColumn("parentPath", strings.parent_directory(F.col("filePath")))


@pytest.mark.parametrize(("sort", "only", "want"), [("DATE_DESC", None, "cbA"), ("DATE_ASC", None, "Abc"), ("NAME_ASC", None, "Abc"), ("NAME_DESC", None, "cbA"), ("SIZE_DESC", None, "Abc"), ("SIZE_ASC", None, "cbA"), ("MODIFIED_DESC", None, "Abc"), ("DATE_DESC", "IMAGE", "cA"), ("NAME_ASC", "VIDEO", "b")])
def test_directory_listing(listing, sort, only, want):
    m = browse.Media()
    rows = browse.in_directory(listing, m, "/album", only)
    got = browse.page(rows, browse.sort_keys(sort, m), 10).collect()
    assert "".join(r["fileName"][0] for r in got) == want


def test_anchor_offset_and_pages_meet(listing):
    m = browse.Media()
    rows = browse.in_directory(listing, m, "/album", "IMAGE")
    assert browse.offset_of(rows, browse.sort_keys("DATE_ASC", m), [30, "/album/c.jpg"]).first()["offset"] == 1
    keys = browse.sort_keys("SIZE_DESC", m)
    first = browse.page(listing, keys, 2).collect()
    rest = browse.page(listing, keys, 10, [first[-1]["fileSize"], first[-1]["filePath"]]).collect()
    assert [r["filePath"] for r in first + rest] == [r["filePath"] for r in browse.page(listing, keys, 10).collect()]
    with pytest.raises(ValueError):
        browse.in_directory(listing, m, " ")


def test_string_functions(spark):
    got = one(spark, strings.extension(F.col("p")), strings.base_name(F.col("p")), strings.parent_directory(F.col("p")), strings.fts_expression(F.col("q")), strings.masked_error(F.col("e")), p="/a/b.c/D.JPG", q=' be"ach  (sun) ', e="open file:///x/y failed at /data/z")
    assert tuple(got) == ("jpg", "D.JPG", "/a/b.c", '"beach"* OR "sun"*', "open <uri> failed at <path>")
    got = one(spark, *[strings.byte_size(F.lit(n).cast("long")) for n in (12, 2048, 5 << 20, 3 << 30)])
    assert tuple(got) == ("12 B", "2 KB", "5.0 MB", "3.00 GB")
    assert one(spark, strings.first_not_blank(F.col("a"), F.col("b")), a="  ", b="x")[0] == "x"


def test_date_functions(spark):
    got = one(spark, dates.exif_instant(F.col("a")).cast("string"), dates.exif_instant(F.col("b")), dates.exif_instant(F.col("a"), "Asia/Shanghai").cast("string"), a="2024:05:01 10:20:30", b="2024-05-01")
    assert tuple(got) == ("2024-05-01 10:20:30", None, "2024-05-01 02:20:30")
    low, high = dates.day_bounds_ms(F.lit("2024-01-01").cast("date"), F.lit("2024-01-01").cast("date"), "UTC")
    assert tuple(one(spark, low, high)) == (1704067200000, 1704153599999)
    hour = dates.whole_hours(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 06:59:59").cast("timestamp"))
    assert one(spark, hour)[0] == 6


def test_maths(spark):
    assert [one(spark, maths.backoff(F.lit(i), 1000, 5000))[0] for i in range(5)] == [1000, 2000, 4000, 5000, 5000]
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one(spark, maths.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)))[0] == pytest.approx(1 / 3)


def test_hashes(spark):
    import hashlib
    import uuid

    got = one(spark, hashes.name_uuid(F.col("p")), hashes.path_key(F.col("p")), hashes.fnv1a_priority(F.col("p")), p="album/x")
    digest = bytearray(hashlib.md5(b"album/x").digest())
    assert got[0] == str(uuid.UUID(bytes=bytes(digest), version=3))
    assert got[1] == hashlib.sha256(b"album/x").hexdigest()
    assert got[2] >= 0


def test_vector_codecs(spark):
    row = one(spark, vectors.to_csv(F.col("v")), vectors.decode_blob(vectors.encode_blob(F.col("v"))), v=[1.25, -0.5, 0.0])
    assert tuple(row) == ("1.250000,-0.500000,0.000000", [1.25, -0.5, 0.0])
    assert one(spark, vectors.parse_csv(F.col("a")), vectors.parse_csv(F.col("b")), vectors.parse_csv(F.col("a"), strict=False), a="1,x,2", b="1, 2.5")[0:3] == (None, [1.0, 2.5], [1.0, 2.0])
    assert one(spark, vectors.parse_csv(F.col("a")), a="1,Infinity")[0] is None
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), vectors.cosine_distance(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0])[0:2] == (0.0, 2.0)


def test_concepts():
    at = lambda q: set(np.flatnonzero(features.text_vector(q)))
    assert at("日落") == at("sunset") == {0}
    assert at("海边的日落") == {0, 2}
    assert at("zzqq") == {31} and at(" ") == set()
    assert np.linalg.norm(features.text_vector("海边的日落")) == pytest.approx(1, abs=1e-6)


def test_image_rules(spark):
    f = {k: F.lit(0.5) for k in ("brightness", "saturation", "red", "green", "blue", "blue_green", "aspect", "center_brightness", "edge_brightness", "center_saturation", "contrast", "quality")}
    f |= {"squarish": F.lit(False), "uniform": F.lit(False), "width": F.lit(10), "height": F.lit(10), "scene": F.lit("food"), "ocr": F.lit("beach party")}
    v = one(spark, features.image_concepts(f))[0]
    assert v[7] == pytest.approx(0.9 + 0.0005) and v[2] > 0 and v[23] > 0
    assert one(spark, features.best_label(features.scene_scores(f)))[0] in features.scene_scores(f)
    flat, noisy = bytes(3 * 64), bytes(np.random.default_rng(0).integers(0, 256, 3 * 64).astype(np.uint8))
    a, b = features.pixel_row(flat, 8, 8), features.pixel_row(noisy, 8, 8)
    assert a["blurry"] and not b["blurry"] and b["quality"] > a["quality"]
    got = one(spark, features.pixel_features(F.col("p"), F.lit(8), F.lit(8)), features.pixel_features(F.col("p"), F.lit(9), F.lit(9)), p=noisy)
    assert got[0]["quality"] == pytest.approx(b["quality"]) and got[1] is None


def test_detection(spark):
    boxes = [(0, 0, 10, 10, 0.9), (1, 1, 10, 10, 0.8), (20, 20, 30, 30, 0.7)]
    assert detect.suppress(boxes) == [boxes[0], boxes[2]]
    grid = np.zeros((4, 6))
    grid[0, 0:2] = grid[2:4, 3] = 1
    assert detect.regions(grid) == [(0, 0, 2, 1), (3, 2, 4, 4)]
    got = spark.createDataFrame([([0, 1, 1, 0, 1, 2],), ([],)], "b array<int>").select(detect.ctc_text(F.col("b"), ["a", "b"])).collect()
    assert [r[0] for r in got] == ["aab", ""]
    rows = spark.createDataFrame([([dict(zip(("left", "top", "right", "bottom", "score"), map(float, b), strict=True)) for b in boxes],)], f"b {detect.BOXES}")
    assert len(rows.select(detect.nms(F.col("b"))).first()[0]) == 2


def test_tree_and_covers(spark):
    df = spark.createDataFrame([("/a", 1), ("/a/b", 2), ("/a/b", 3), ("/c", 4)], "d string, k long")
    got = {r["path"]: (r["own"], r["total"], r["leaves"], r["depth"]) for r in rollup.tree(df, "d").collect()}
    assert got == {"/a": (1, 3, 2, 1), "/a/b": (2, 2, 1, 2), "/c": (1, 1, 1, 1)}
    got = [(r["dir"], r["cover"]) for r in rollup.covers(df, "d", "k", "k", 2).orderBy("dir", "rank").collect()]
    assert got == [("/a", 3), ("/a", 2), ("/a/b", 3), ("/a/b", 2), ("/c", 4)]


def test_text_search(spark):
    df = spark.createDataFrame([(1, "Café beaches", None), (2, "beach", "x.jpg"), (3, None, None)], "k int, a string, b string")
    idx = text_search.index(df, "k", "a", "b").cache()
    keys = lambda x: sorted(r[0] for r in x.collect())
    assert keys(text_search.prefix_or(idx, "k", "beach foo")) == [1, 2]
    assert keys(text_search.token_and(idx, "k", "beach jpg")) == [2]
    assert keys(text_search.prefix_or(idx, "k", " ")) == keys(text_search.token_and(idx, "k", "")) == []


def vectors_around(rng, centres, each, noise):
    return np.concatenate([c + rng.normal(0, noise, (each, len(c))) for c in centres])


def test_dbscan_graph_equals_sequential(spark):
    rng = np.random.default_rng(3)
    v = vectors_around(rng, np.eye(6)[:4], 12, 0.12)
    v = np.concatenate([v, rng.normal(0, 1, (6, 6)), np.zeros((1, 6))])
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")
    got = {r["id"]: (r["cluster"], r["core"]) for r in cluster.dbscan(df, "id", "v", 0.05, 4).collect()}
    want = cluster.dbscan_in_order(list(range(len(v))), v, 0.05, 4)
    assert got.keys() == want.keys()
    cores = [i for i, (_, core) in got.items() if core]
    for i in cores:
        for j in cores:
            assert (got[i][0] == got[j][0]) == (want[i] == want[j])
    # The sequential order leaves some border points as noise; the graph finds them all.
    assert {i for i, (c, _) in got.items() if c is None} <= {i for i, c in want.items() if c is None}


def test_dbscan_small_cases():
    near = np.array([[1, 0], [0.99, 0.01], [0.98, 0.02]])
    assert cluster.dbscan_in_order([5, 6, 7], near) == {5: 5, 6: 5, 7: 5}
    assert cluster.dbscan_in_order([1], near[:1]) == {1: None}
    assert cluster.dbscan_in_order([1, 2, 3], np.array([[1, 0], [0.99, 0.01], [-1, 0.1]])) == {1: 1, 2: 1, 3: None}


def test_prototypes():
    made, rejected = cluster.fold_prototypes([np.array([1.0, 0, 0]), np.array([0.99, 0.05, 0]), np.array([0, 1.0, 0]), np.array([0, 0, 1.0]), np.array([-1.0, -1, -1])])
    assert [n for _, n in made] == [2, 1, 1] and rejected == 1


def test_assignment_groups_unmatched(spark):
    faces = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.99, 0.05]), (4, [0.0, 0.0, 1.0])], "id long, v array<double>")
    known = spark.createDataFrame([("anna", [0.98, 0.1, 0.0])], "c string, p array<double>")
    got = {r["id"]: (r["cluster"], r["is_new"]) for r in cluster.assign(faces, known, "id", "v", "c", "p").collect()}
    assert got == {1: ("anna", False), 2: ("new:2", True), 3: ("new:2", True), 4: ("new:4", True)}


def test_largest_face(spark):
    df = spark.createDataFrame([("p", 1, (0.0, 0.0, 2.0, 2.0)), ("p", 2, (0.0, 0.0, 3.0, 3.0)), ("p", 3, (3.0, 3.0, 0.0, 0.0)), ("q", 4, (0.0, 0.0, 0.0, 0.0))], "photo string, id int, box struct<left: double, top: double, right: double, bottom: double>")
    assert {(r["photo"], r["id"]) for r in cluster.largest_per_photo(df, "photo", "id", "box").collect()} == {("p", 2), ("q", 4)}


def test_kmeans_is_stable():
    rng = np.random.default_rng(1)
    v = vectors_around(rng, np.eye(4)[:3], 10, 0.05)
    names = [f"{i:03}" for i in range(30)]
    a, _ = cluster.kmeans(names, v, 3)
    order = rng.permutation(30)
    b, _ = cluster.kmeans([names[i] for i in order], v[order], 3)
    assert (a[order] == b).all() and len({tuple(a[i : i + 10]) for i in (0, 10, 20)}) == 3 and all(len(set(a[i : i + 10])) == 1 for i in (0, 10, 20))


def test_sessions_by_hours_and_place(spark):
    rows = [(1, "2024-01-01 00:00:00", 39.9, 116.4), (2, "2024-01-01 06:59:00", 39.91, 116.41), (3, "2024-01-01 07:30:00", None, None), (4, "2024-01-01 08:00:00", 31.0, 121.0), (5, "2024-01-01 08:30:00", 39.9, 116.4), (6, "2024-01-02 00:00:00", 39.9, 116.4)]
    df = spark.createDataFrame(rows, "id int, t string, la double, lo double").withColumn("t", F.col("t").cast("timestamp")).withColumn("g", F.lit(1))
    got = {r["id"]: r["session"] for r in sessions.sessions(df, "g", "t", "id", place=("la", "lo")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 3}


def test_lru_protects(spark):
    df = spark.createDataFrame([(1, 10, 50, False), (2, 20, 50, True), (3, 30, 50, False), (4, 40, 50, False)], "k int, t long, s long, p boolean")
    assert [r["k"] for r in sessions.evicted(df, "t", "s", ["k"], budget=120, protected=F.col("p")).orderBy("k").collect()] == [1, 3]


def test_windows_are_apart(spark):
    df = spark.createDataFrame([("a", f"2024-01-{i // 3 + 1:02}", i) for i in range(60)], "g string, d string, k int").withColumn("t", F.col("d").cast("timestamp"))
    found = sessions.busy_windows(df, "g", "t", sizes=(3,), factor=0.5)
    picked = sessions.pick_apart(found.withColumn("score", F.unix_date("first_day").cast("double")), "g", "score").orderBy("first_day").collect()
    assert len(picked) == 3
    for a, b in zip(picked, picked[1:]):
        assert (b["first_day"] - a["last_day"]).days > 3


def test_diversified():
    rows = [{"id": i, "score": 10 - i, "category": "x" if i < 4 else "y", "album": str(i)} for i in range(6)]
    assert [r["id"] for r in sessions.diversified(rows)] == [0, 1, 4, 2, 3, 5]
    assert [r["id"] for r in sessions.diversified([dict(r, category="x", album="1") for r in rows])] == [0, 1, 2, 3, 4, 5]


def test_scores_rise_with_quality(spark):
    df = spark.createDataFrame([("a", i, 0.2) for i in range(10)] + [("b", i, 0.9) for i in range(10)], "g string, h int, q double")
    df = df.withColumn("t", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, h)"))
    now = F.lit("2024-02-01").cast("timestamp")
    got = {r["g"]: r["score"] for r in recommend.albums(df, "g", "t", F.col("q"), F.lit(False), now).collect()}
    assert got["b"] > got["a"]
    assert recommend.windows(df, "g", "t", F.col("q"), F.lit(False), now).count() == 0
    ranked = recommend.preferred(recommend.albums(df, "g", "t", F.col("q"), F.lit(False), now), recommend.QUALITY)
    assert ranked.filter("rank_score <= score").count() == 0


def test_rotation_shows_each_file_once(spark):
    shown = spark.createDataFrame([("f1", 1), ("f1", 2), ("f2", 2)], "item string, rank int")
    claims = sessions.first_claims(shown, "item", "rank")
    assert {(r["item"], r["rank"]) for r in claims.collect()} == {("f1", 1), ("f2", 2)}
    items = spark.createDataFrame([(f"f{i}",) for i in range(1, 46)], "item string")
    left = sessions.leftovers(items, claims, "item", ["item"])
    assert left.count() == 43 and left.filter("chunk = 0").count() == 20


def test_merge_policies(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(merge.replace(old, new, "k")) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(merge.ignore(old, new, "k")) == [(1, "a"), (2, "b"), (3, "d")]
    with pytest.raises(Exception, match="duplicate key"):
        merge.abort(old, new, "k").collect()


def media(spark, rows):
    names = [c.strip().split()[0] for c in schemas.MEDIA.split(", ")]
    base = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.MEDIA)
    return base.fillna({"isTrashed": False, "isFavorite": False, "deletedAtMs": 0, "scanGeneration": 0})


def test_upsert_keeps_what_analysis_set(spark):
    old = media(spark, [{"filePath": "/a", "modifiedAtMs": 1, "fileSize": 1, "sceneType": "food", "isFavorite": True}, {"filePath": "/b", "modifiedAtMs": 1, "fileSize": 1}])
    fresh = media(spark, [{"filePath": "/a", "modifiedAtMs": 1, "fileSize": 1}, {"filePath": "/b", "modifiedAtMs": 2, "fileSize": 1}, {"filePath": "/c", "modifiedAtMs": 1}])
    stones = spark.createDataFrame([("/b", 50)], "filePath string, deletedAtMs long")
    got = {r["filePath"]: r for r in merge.upsert(old, fresh, stones, 7).collect()}
    assert (got["/a"]["sceneType"], got["/a"]["isFavorite"], got["/a"]["changed"]) == ("food", True, False)
    assert (got["/b"]["isTrashed"], got["/b"]["deletedAtMs"], got["/b"]["changed"]) == (True, 50, True)
    assert got["/c"]["changed"] and got["/c"]["scanGeneration"] == 7


def test_store_publishes_together(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    store.save(t=a, u=a)
    version = store.write("t", a.withColumn("v", F.lit("y")))
    assert store.read("t").first()["v"] == "x"
    store.publish(t=version)
    assert store.read("t").first()["v"] == "y" and store.read("u").first()["v"] == "x"
    store.upsert("t", spark.createDataFrame([(2, "z")], "k int, v string"), "k")
    assert store.read("t").count() == 2
    store.delete_where("t", F.col("k") == 1)
    store.cascade(spark.createDataFrame([(2,)], "k int"), "k", ["t", "u", "missing"])
    assert store.read("t").count() == 0 and store.read("u").count() == 1
    assert store.vacuum("t") > 0


def test_scan_run_purges_only_when_complete(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    row = lambda p: media(spark, [{"filePath": p, "modifiedAtMs": 1, "fileSize": 1}])
    run = pipeline.ScanRun(store, 10)
    run.commit(row("/a"))
    run.commit(row("/b"))
    run.source_done("catalog")
    assert not run.purge()
    run.source_done("files")
    assert run.purge() and store.read("media_items").count() == 2
    again = pipeline.ScanRun(store, 5)
    assert again.generation == 11
    again.commit(row("/b"))
    again.source_done("catalog")
    again.source_done("files")
    assert again.purge() and [r["filePath"] for r in store.read("media_items").collect()] == ["/b"]


def test_generations(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    runs = spark.createDataFrame([("dup", 1, "COMPLETED", None, 0, 0, 0, True), ("dup", 2, "FINALIZING", None, 0, 0, 0, False)], schemas.RUNS)
    store.save(maintenance_runs=runs)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "generation long, x string")
    seen = lambda: [r["x"] for r in pipeline.active_rows(rows, store.read("maintenance_runs"), "dup").collect()]
    assert seen() == ["a"]
    pipeline.publish_generation(store, "maintenance_runs", "dup", 2)
    assert seen() == ["b"] and pipeline.next_generation(store.read("maintenance_runs"), "dup").first()[0] == 3


def task(i, path="/a", version="1", scope="full", status="PENDING", priority=0, created=0):
    return (i, path, version, scope, priority, status, 0, 0, 0, None, created)


def test_task_queue(spark):
    queue = spark.createDataFrame([task(1, priority=1), task(2, "/b", priority=5), task(3, "/c", status="DONE"), task(4, "/d", status="SUPERSEDED")], schemas.TASKS)
    held = tasks.claim(queue, 100, 1, "me")
    assert [r["taskId"] for r in held.filter("status = 'LEASED'").collect()] == [2]
    assert [r["taskId"] for r in tasks.claimable(held, 100, 9).collect()] == [1]
    assert tasks.recover(held, 100 + tasks.LEASE_MS).filter("status = 'PENDING'").count() == 2
    ids = spark.createDataFrame([(2,)], "taskId long")
    assert tasks.finish(held, "me", ids).filter("taskId = 2").first()["status"] == "DONE"
    assert tasks.finish(held, "you", ids).filter("taskId = 2").first()["status"] == "LEASED"
    failed = tasks.fail(held, "me", ids, 100).filter("taskId = 2").first()
    assert (failed["status"], failed["attemptCount"], failed["nextRetryAt"]) == ("PENDING", 1, 60_100)
    again = tasks.enqueue(queue, spark.createDataFrame([task(9, "/c"), task(10, "/d"), task(11, "/e")], schemas.TASKS))
    assert {r["filePath"]: r["status"] for r in again.collect()} == {"/a": "PENDING", "/b": "PENDING", "/c": "PENDING", "/d": "SUPERSEDED", "/e": "PENDING"}
    newer = spark.createDataFrame([("/a", "full", "2")], "filePath string, pipelineScope string, sourceVersion string")
    assert tasks.supersede(queue, newer).filter("taskId = 1").first()["status"] == "SUPERSEDED"
    assert tasks.supersede(queue, newer).filter("taskId = 2").first()["status"] == "PENDING"


def test_tombstones(spark):
    none = spark.createDataFrame([], schemas.TOMBSTONES)
    buried = tasks.bury(none, spark.createDataFrame([("/a",), ("/b",)], "filePath string"), "DELETE", 5)
    held = tasks.claim_tombstones(buried, 10, 9, "t1", 100)
    assert held.filter("state = 'LEASED'").count() == 2 and tasks.claim_tombstones(held, 50, 9, "t2").filter("leaseToken = 't2'").count() == 0
    assert tasks.claim_tombstones(held, 110, 9, "t2").filter("leaseToken = 't2'").count() == 2
    done = tasks.settle_tombstones(held, "t1", spark.createDataFrame([("/a",)], "filePath string"), 20)
    assert {r["filePath"]: r["state"] for r in done.collect()} == {"/a": "COMPLETED", "/b": "PENDING"}
    assert tasks.exhume(done, spark.createDataFrame([("/b",)], "filePath string")).count() == 1


def test_stage_order():
    stage = lambda n, *after: pipeline.Stage(n, lambda df: df, after)
    assert [s.name for s in pipeline.ordered([stage("c", "b"), stage("b", "a", "nowhere"), stage("a")])] == ["a", "b", "c"]
    with pytest.raises(pipeline.CycleError):
        pipeline.ordered([stage("a", "b"), stage("b", "a")])


def test_stage_runner_isolates_failures(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    files = spark.createDataFrame([("/a",), ("/b",)], "filePath string")

    def broken(df):
        raise RuntimeError("no model")

    half = lambda df: df.withColumn("failed", F.col("filePath") == "/b")
    stages = [pipeline.Stage("bad", broken), pipeline.Stage("half", half, ("bad",))]
    first = pipeline.run_stages(files, stages, store)
    assert [(r.stage, r.files, r.failed, bool(r.error)) for r in first] == [("bad", 0, 0, True), ("half", 2, 1, False)]
    second = pipeline.run_stages(files, stages, store)
    assert (second[1].files, second[1].failed) == (1, 1)
    shares = {r["stageId"]: r["share"] for r in pipeline.progress(store.read("analysis_state"), 2, ["bad", "half"], 1.0).collect()}
    assert shares == {"bad": 0.0, "half": 0.5}


def test_plugins(spark):
    m = plugins.Manifest("p1", "upper", 1, plugins.CLASSIFICATION)
    assert plugins.Manifest(" ", "x", 0, "odd").problems()
    p = plugins.Provider(m, lambda: str.upper, lambda model, batch: batch.map(model))
    r = plugins.Registry()
    r.register(p, "scene")
    assert r.provider("scene") is p and r.provider("face") is None
    with pytest.raises(ValueError):
        r.register(p, "face")
    assert one(spark, r.provider("scene").column(F.col("x"), "string"), x="abc")[0] == "ABC"
    none = spark.createDataFrame([], schemas.FEATURES)
    rows = spark.createDataFrame([("/a", "x")], "filePath string, label string")
    stored = plugins.store_features(none, rows, m, F.struct("label"))
    assert plugins.store_features(stored, rows, m, F.struct("label")).count() == 1
    assert json.loads(stored.first()["dataJson"]) == {"label": "x"}


def test_backup_round_trip(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = media(spark, [{"filePath": "/a", "latitude": 1.5, "ocrText": 'x"\n'}, {"filePath": "/b"}])
    blobs = spark.createDataFrame([("/a", b"\x00\xff", "s1")], "filePath string, embeddingBlob binary, spaceId string")
    backup.export({"media_items": rows, "media_embeddings": blobs}, f"file://{tmp_path}/out")
    schemas_of = {"media_items": rows.schema, "media_embeddings": blobs.schema}
    assert backup.restore(spark, f"file://{tmp_path}/out", schemas_of, store) == {"media_items": 2, "media_embeddings": 1}
    assert sorted(map(str, store.read("media_items").collect())) == sorted(map(str, rows.collect()))
    assert bytes(store.read("media_embeddings").first()["embeddingBlob"]) == b"\x00\xff"
    part = next(p for p in (tmp_path / "out" / "media_items.ndjson").glob("part-*") if "/b" in p.read_text())
    part.write_text(part.read_text().replace("/b", "/x"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    before = store.pointer()
    with pytest.raises(backup.BackupError):
        backup.restore(spark, f"file://{tmp_path}/out", schemas_of, store)
    assert store.pointer() == before
    with pytest.raises(backup.BackupError):
        backup.check_manifest({"version": 2, "capabilities": ["odd"], "entries": {}})


def test_legacy_backup(spark, tmp_path):
    rows = spark.createDataFrame([("/a", 1), ("/b", 2)], "filePath string, fileSize long")
    faces = spark.createDataFrame([(7, "/a")], "faceId long, filePath string")
    backup.write_legacy({"media": rows, "faces": faces}, f"file://{tmp_path}/old")
    back = backup.read_legacy(spark, f"file://{tmp_path}/old", {"media": "filePath string, fileSize long", "faces": "faceId long, filePath string"})
    assert sorted(map(tuple, back["media"].collect())) == [("/a", 1), ("/b", 2)] and back["faces"].count() == 1


def test_search_hits_and_backfill(spark):
    media_rows = spark.createDataFrame([("/a", False), ("/b", True)], "filePath string, isTrashed boolean")
    hits = spark.createDataFrame([("/b", 0.9), ("/a", 0.5), ("/gone", 0.8)], "filePath string, similarity double")
    assert [r["filePath"] for r in vector.hydrated(hits, media_rows, "filePath").collect()] == ["/b", "/a"]
    assert [r["filePath"] for r in vector.hydrated(hits, media_rows, "filePath", include_trashed=False).collect()] == ["/a"]
    df = spark.createDataFrame([(1, "1,2", None), (2, "x", None), (3, "1", b"abcd")], "k int, t string, b binary")
    got = {r["k"]: (r["backfill"], r["b"] is not None) for r in vector.backfilled(df, "t", "b").collect()}
    assert got == {1: ("filled", True), 2: ("bad", False), 3: ("kept", True)}
    spaces = spark.createDataFrame([("s1",)], "spaceId string")
    assert vector.space_state(spaces, "spaceId", "s2").first()["state"] == vector.SPACE_MISMATCH
    assert vector.space_state(spaces.limit(0), "spaceId", "s2").first()["state"] == vector.NOT_BUILT
    meta = spark.createDataFrame([("s1", True), ("s2", True)], "spaceId string, isActive boolean")
    assert {r["spaceId"]: r["isActive"] for r in backup.drop_orphan_spaces(meta, spaces).collect()} == {"s1": True, "s2": False}


def test_duplicate_groups_lose_members(spark):
    rows = spark.createDataFrame([("/a", 5, b"x"), ("/b", 5, b"x"), ("/c", 5, b"y"), ("/d", 9, b"z")], "p string, s long, c binary")
    hashed = dedup.hashed(rows, "s", F.col("c"))
    grouped = dedup.groups(hashed, "p", "s")
    found = dedup.members(hashed, grouped, "p")
    assert grouped.select("member_count", "total_bytes", "wasted_bytes", "keep_path").first()[0:4] == (2, 10, 5, "/a")
    assert [r["p"] for r in dedup.page_of_members(found, "p").orderBy("place").collect()] == ["/a", "/b"]
    left = rows.filter("p <> '/b'")
    assert dedup.invalidated(grouped, found, left, "p").first()["invalidated"] and not dedup.invalidated(grouped, found, rows, "p").first()["invalidated"]


def test_top_classes_and_labels(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [0.1, 0.7, 0.2])], "l array<string>, s array<double>")
    assert [r["label"] for r in df.select(features.top_classes(F.col("l"), F.col("s"), 2)).first()[0]] == ["b", "c"]
    got = spark.range(3).select(features.mapped_label(F.col("id"), {0: "pet", 2: "food"})).collect()
    assert [r[0] for r in got] == ["pet", "other", "food"]


def test_zip_checks(tmp_path):
    ok, slip = tmp_path / "ok.zip", tmp_path / "slip.zip"
    with zipfile.ZipFile(ok, "w") as z:
        z.writestr("media_items.ndjson", "{}\n")
    with zipfile.ZipFile(slip, "w") as z:
        z.writestr("../x", "y")
    assert backup.check_zip(str(ok)) == ["media_items.ndjson"]
    with pytest.raises(backup.BackupError):
        backup.check_zip(str(slip))


def test_codecs(spark):
    row = one(spark, codecs.decode_output(F.col("a")), a='{"type": "detection", "boxes": [{"left": 1, "label": "x"}]}')[0]
    assert row["type"] == "detection" and row["detection"]["boxes"][0]["label"] == "x" and row["feature"] is None


def test_media_rules(spark):
    assert media_files.normal_roots([" /a/b/ ", "/a/./b", "", "/a/c/.."]) == ["/a/b", "/a"]
    df = spark.createDataFrame([("/a/x.jpg",), ("/ab/y.jpg",), ("/a/.h/z.jpg",), ("/a/n/.nomedia",), ("/a/n/k/q.jpg",), ("/a/Cache/r.jpg",), ("/a/skip1.jpg",)], "p string")
    assert {r["p"] for r in media_files.visible(df, "p", ["skip\\d", "(bad"]).collect()} == {"/a/x.jpg", "/ab/y.jpg"}
    assert {r["p"] for r in df.filter(media_files.under_roots(F.col("p"), ["/a/"])).collect()} == {r["p"] for r in df.collect()} - {"/ab/y.jpg"}
    assert tuple(one(spark, media_files.media_type(F.col("a")), media_files.mime_type(F.col("a")), media_files.media_type(F.col("b")), a="x.MP4", b="x.txt")) == ("VIDEO", "video/mp4", None)


def test_scan_reads_exif(spark, tmp_path):
    import struct

    make = b"ACME\0"
    body = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHI", 271, 2, len(make)) + struct.pack("<I", 38) + struct.pack("<HHI", 306, 2, 20) + struct.pack("<I", 44) + b"\0\0\0\0"
    body = body.ljust(38, b"\0") + make + b"\0" + b"2024:05:01 10:20:30\0"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jpg").write_bytes(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + body)
    (tmp_path / "d" / "b.txt").write_text("x")
    got = media_files.media_rows(media_files.scan(spark, str(tmp_path))).collect()
    assert [(r["fileName"], r["make"], r["capturedAtMs"]) for r in got] == [("a.jpg", "ACME", 1714558830000)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, g string")
    rows.write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/s")
    for _ in range(2):  # the second run finds nothing new
        live.merge_into(live.watch(spark, f"{tmp_path}/in", "k int, g string"), store, "t", "g", time="k", checkpoint=f"{tmp_path}/c").awaitTermination()
    assert sorted((r["k"], r["g"]) for r in store.read("t").collect()) == [(2, "a"), (3, "b")]
    files = spark.createDataFrame([("/a",), ("/a",), ("/b",)], "filePath string")
    files.write.parquet(f"{tmp_path}/files")
    stream = live.watch(spark, f"{tmp_path}/files", "filePath string")
    live.once_per_file(stream, store, "ocr", 1, lambda df: df, f"{tmp_path}/c2").awaitTermination()
    assert store.read("analysis_state").count() == 2


def test_event_time_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:30", "a"), ("2024-01-01 01:00:00", "b")], "t string, g string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = live.debounced(stream, "t", "g").writeStream.format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["changes"] for r in spark.table("bursts").collect()) == [1, 2]
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = live.windowed(stream, "t", "g", "1 minute").writeStream.format("memory").queryName("wins").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["g"], r["n"]) for r in spark.table("wins").collect()] == [("a", 3)]


def test_library_collects_no_tables():
    """Bounded driver reads only: no toPandas and no unbounded collect in the library."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "lensmill"
    for f in [*root.glob("functions/*.py"), *root.glob("operators/*.py"), *root.glob("sources/*.py"), *root.glob("streaming/*.py")]:
        text = f.read_text()
        assert ".toPandas(" not in text and "localCheckpoint" not in text, f
        assert text.count(".collect()") <= (2 if f.name == "vector.py" else 0), f


def plain_priority(text):
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    return (h ^ 2**63) - (2**64 if h ^ 2**63 >= 2**63 else 0)


def test_path_priority(spark):
    # Known values of 64-bit FNV-1a: "", "a" and "foobar".
    assert [int(h) for h in hashes.fnv1a(["", "a", "foobar"])] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    paths = ["", "a", "/storage/emulated/0/DCIM/é 图.jpg", None, "x" * 300, *(f"/album/{i}.jpg" for i in range(50))]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    got = {r["i"]: r["h"] for r in df.select("i", hashes.fnv1a_priority(F.col("p")).alias("h")).collect()}
    assert all(got[i] == (None if p is None else plain_priority(p)) for i, p in enumerate(paths))
    assert min(got[i] for i in got if got[i] is not None) < 0
    want = sorted((plain_priority(p), p) for p in paths if p is not None)[:20]
    picked = cluster.sample(df.filter("p is not null").select("p"), "p", 20)
    assert sorted(r["p"] for r in picked.collect()) == sorted(p for _, p in want)


def test_directory_summary_of_paths(spark):
    rows = [("/x", "/x/2.jpg", 5, "t2"), ("/x", "/x/1.jpg", 5, None), ("/x", "/x/0.jpg", None, "t0"), ("/y", "/y/9.jpg", 1, "t9"), (None, "/z.jpg", None, None)]
    df = spark.createDataFrame(rows, "d string, p string, t long, th string")
    got = {r["d"]: tuple(r)[1:] for r in rollup.directory_summary(df, "d", "t", "p", "th").collect()}
    assert got == {"/x": (3, 5, "/x/1.jpg", None), "/y": (1, 1, "/y/9.jpg", "t9"), None: (1, None, "/z.jpg", None)}
    for kind in ("timestamp", "timestamp_ntz", "date"):
        timed = df.withColumn("t", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t").cast("int")).cast(kind))
        assert {r["d"]: r["cover_path"] for r in rollup.directory_summary(timed, "d", "t", "p").collect()}["/x"] == "/x/1.jpg"


def test_components_of_a_long_path(spark):
    n = 300
    nodes = spark.range(n).select(F.col("id").alias("node"))
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert [r["root"] for r in cluster.connected(nodes, edges).select("root").distinct().collect()] == [0]


def test_sessions_equal_a_scan(spark):
    import datetime
    import random

    rng, start = random.Random(3), datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice("ab"), start + datetime.timedelta(minutes=rng.randrange(0, 40000)), rng.choice([None, 10.0, 10.2]), 5.0) for i in range(300)] + [(900, "a", None, None, None), (901, None, start, None, None)]
    df = spark.createDataFrame(rows, "k int, g string, t timestamp_ntz, la double, lo double")
    for group, place in ((None, None), ("g", None), (None, ("la", "lo")), ("g", ("la", "lo"))):
        want, last, number = {}, {}, {}
        for k, g, t, la, lo in sorted(rows, key=lambda r: (r[2] is not None, r[2] or start, r[0])):
            g = g if group else "all"
            new = g not in last or t is None or last[g][0] is None or (t - last[g][0]).total_seconds() // 3600 > 6
            if not new and place and la is not None and last[g][1] is not None:
                new = abs(la - last[g][1]) > 0.1  # 22 km
            last[g], number[g] = (t, la), number.get(g, 0) + new
            want[k] = number[g]
        got = {r["k"]: r["session"] for r in sessions.sessions(df, group, "t", "k", place=place).collect()}
        assert got == want, (group, place)


def test_eviction_of_groups_equals_a_scan(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(0, 10**8), rng.randrange(1, 50), rng.random() < 0.1) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, g string, t long, s int, held boolean")
    for group in (None, "g"):
        want = set()
        for name in {r[1] for r in rows} if group else {"all"}:
            mine = [r for r in rows if not group or r[1] == name]
            total = sum(r[3] for r in mine)
            for k, _, _, s, held in sorted(mine, key=lambda r: (r[2], r[0])):
                if not held and total > 300:
                    want.add(k)
                    total -= s
        got = {r["k"] for r in sessions.evicted(df, "t", "s", ["k"], budget=300, protected=F.col("held"), group=group).collect()}
        assert got == want


def test_concepts_of_texts_equal_the_plain_rule(spark):
    import random

    rng = random.Random(5)
    terms = [t for each in features.CONCEPTS for t in each]
    texts = [None, "", "  ", "Sunset", " at the BEACH, dogs!", "日落", "我的海边旅行", "zzz", "b&w", "close-up", "sun", "山", "fall foliage"] + [" ".join(rng.choice(terms)[: rng.randrange(1, 9)] for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", features.embed_text(F.col("t")).alias("v")).collect():
        np.testing.assert_allclose(r["v"], features.text_vector(r["t"] or ""), atol=1e-6, err_msg=str(r["t"]))


def test_prototypes_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(40)] + [(40, None), (41, [0.0] * 4), (42, [1.0])], "k int, v array<float>")
    known = spark.createDataFrame([(f"p{i:02}", [float(x) for x in rng.normal(0, 1, 4)]) for i in range(25)] + [("zz", [0.0] * 4)], "p string, w array<float>")
    want = {r["k"]: (r["prototype"], round(r["distance"], 5)) for r in vector.nearest_prototype(rows, "v", known, "p", "w").collect()}
    monkeypatch.setattr(vector, "LITERAL_PROTOTYPES", 3)
    monkeypatch.setattr(vector, "BLOCK_PROTOTYPES", 7)
    got = {r["k"]: (r["prototype"], round(r["distance"], 5)) for r in vector.nearest_prototype(rows, "v", known, "p", "w").collect()}
    assert {k: got[k] for k in range(40)} == {k: want[k] for k in range(40)} and got[41][1] == want[41][1] == 2.0
    near = vector.nearest_prototype(rows, "v", known, "p", "w", most=0.2).collect()
    assert all((r["prototype"] is None) == (r["distance"] > 0.2) for r in near if r["k"] < 40)


def test_search_account(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0]), ("d", None), ("e", [float("nan"), 1.0]), ("f", [0.0, 1.0])], "k string, v array<float>")
    hits, about = vector.search_detailed(rows, "k", "v", [1.0, 0.0], 5, 0.1, exclude="a")
    assert [r["k"] for r in hits.collect()] == ["b"] and tuple(about.select("scanned", "invalid", "hits", "encoded").first()) == (6, 3, 1, True)
    hits, about = vector.search_detailed(rows, "k", "v", [0.0, 0.0])
    assert hits.count() == 0 and not about.first()["encoded"]


def test_one_ranked_list(spark):
    parts = {}
    for category, made in (("WHOLE_ALBUM", [("b", 0.5, 0.1), ("a", 0.5, 0.1)]), ("EVENT", [("c", 0.4, 0.9)])):
        rows = spark.createDataFrame([(n, 5, q, 0.0, s) for n, s, q in made], "name string, n long, quality double, favourites double, score double")
        rows = rows.withColumn("first_at", F.lit("2020-01-01 00:00:00").cast("timestamp")).withColumn("last_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
        parts[category] = (rows, F.col("name"))
    now = F.lit("2024-01-16 00:00:00").cast("timestamp")
    order = lambda p, **k: [(r["id"], round(r["rank_score"], 4)) for r in recommend.ranked(parts, p, now, **k).collect()]
    assert order(recommend.BALANCED) == [("a", 0.5), ("b", 0.5), ("c", 0.4)]
    assert order(recommend.QUALITY, most=2) == [("c", 0.715), ("a", 0.535)]
    assert order(recommend.MEMORIES)[0] == ("a", 0.85) and order(recommend.RECENT)[0] == ("a", 0.675)


def test_window_recommendations_equal_a_scan(spark):
    import datetime

    start = datetime.date(2024, 1, 1)
    busy = {"x": set(range(20, 27)), "y": {5, 6, 7, 8, 9, 10, 11, 40, 41, 42, 43, 44, 45, 46}}
    rows = [(album, start + datetime.timedelta(days=d), (d * 7 + k) % 10 / 10, k % 3 == 0) for album in busy for d in range(60) for k in range(9 if d in busy[album] else 1)]
    df = spark.createDataFrame([(a, datetime.datetime.combine(d, datetime.time(12)), q, f) for a, d, q, f in rows], "a string, t timestamp_ntz, q double, f boolean")
    now = datetime.datetime(2024, 6, 1)
    got = recommend.windows(df, "a", "t", F.col("q"), F.col("f"), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).collect()
    assert {r["a"] for r in got} == {"x", "y"}
    for r in got:
        mine = [x for x in rows if x[0] == r["a"] and r["first_day"] <= x[1] <= r["last_day"]]
        density = len(mine) / r["size"]
        age = (now - datetime.datetime.combine(r["last_day"], datetime.time(12))).days
        weekend = sum(x[1].weekday() >= 5 for x in mine) / len(mine)
        want = 0.3 * min(1, np.log1p(density) / np.log(11)) + 0.25 * (1 - np.exp(-age / 30)) + 0.2 * np.mean([x[2] for x in mine]) + 0.15 * weekend + 0.1 * np.mean([x[3] for x in mine])
        assert r["n"] == len(mine) and abs(r["score"] - want) < 1e-9
    for a in "xy":
        spans = sorted((r["first_day"], r["last_day"]) for r in got if r["a"] == a)
        assert all((b[0] - x[1]).days > 3 for x, b in zip(spans, spans[1:])) and len(spans) <= 3  # noqa: B905


def test_stored_index_is_pruned(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("word"), F.col("id") % 500, F.lit(" common")).alias("t"))
    idx = text_search.stored(text_search.index(docs, "k", "t"), f"file://{tmp_path}/i", 4)
    assert idx.count() == 4000 and text_search.token_and(idx, "k", "common word7").count() == 4
    plan = text_search.prefix_or(idx, "k", "word12")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token,word12)" in plan


def test_archives(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = media(spark, [{"filePath": "/a", "mediaType": "IMAGE", "modifiedAtMs": 1, "fileSize": 2, "isTrashed": False}, {"filePath": "/b", "mediaType": "VIDEO", "isTrashed": False}, {"filePath": "/c", "mediaType": "IMAGE", "isTrashed": True}])
    meta = spark.createDataFrame([("s1", True), ("s2", True)], "spaceId string, isActive boolean")
    vectors_ = spark.createDataFrame([("/a", "s1")], "filePath string, spaceId string")
    tables = {"media_items": rows, "semantic_index_meta": meta, "media_embeddings": vectors_}
    store.save(faces=vectors_, scan_runs=meta, other=meta)
    backup.export_zip(tables, f"file://{tmp_path}/out", f"{tmp_path}/a.zip")
    shapes = {n: df.schema for n, df in tables.items()}
    assert backup.restore_zip(spark, f"{tmp_path}/a.zip", f"file://{tmp_path}/in", shapes, store, now=7) == {"media_items": 3, "semantic_index_meta": 2, "media_embeddings": 1}
    assert sorted(map(str, store.read("media_items").collect())) == sorted(map(str, rows.collect()))
    assert {r["spaceId"]: r["isActive"] for r in store.read("semantic_index_meta").collect()} == {"s1": True, "s2": False}
    assert [(r["filePath"], r["sourceVersion"], r["status"], r["createdAt"]) for r in store.read("analysis_tasks").collect()] == [("/a", "1:2", "PENDING", 7)]
    assert sorted(r["filePath"] for r in store.read("thumbnail_tasks").collect()) == ["/a", "/b"]
    assert store.read("faces").count() == 0 and store.read("scan_runs").count() == 0 and store.read("other").count() == 2
    before = store.pointer()
    for i, change in enumerate(("drop", "extra", "edit")):
        bad = f"{tmp_path}/{change}.zip"
        with zipfile.ZipFile(f"{tmp_path}/a.zip") as old, zipfile.ZipFile(bad, "w") as new:
            for n in old.namelist():
                if change != "drop" or n != "media_embeddings.ndjson":
                    new.writestr(n, old.read(n).replace(b"/b", b"/x") if change == "edit" else old.read(n))
            if change == "extra":
                new.writestr("more.ndjson", "{}")
        with pytest.raises(backup.BackupError):
            backup.restore_zip(spark, bad, f"file://{tmp_path}/in{i}", shapes, store)
    assert store.pointer() == before


def test_maintenance_goes_on_where_it_stopped(spark, tmp_path):
    from lensmill.plans import maintenance

    store = Store(spark, f"file://{tmp_path}/s")
    rows = [(f"/{i:02}", 10 + i % 3, f"content {i % 4}") for i in range(24)] + [("/99", 10, None)]
    media_rows = spark.createDataFrame(rows, "filePath string, fileSize long, body string")
    content = F.col("body").cast("binary")
    assert not maintenance.exact_duplicates(store, media_rows, content, size=7, steps=2)
    run = store.read("maintenance_runs").first()
    assert (run["status"], run["scannedCount"], run["cursorPath"], run["isActive"]) == ("RUNNING", 14, "/13", False) and not store.exists("duplicate_groups")
    assert maintenance.exact_duplicates(store, media_rows, content, size=7, steps=10)
    run = store.read("maintenance_runs").first()
    assert (run["status"], run["generation"], run["scannedCount"], run["eligibleCount"], run["failedCount"], run["isActive"]) == ("COMPLETED", 1, 25, 24, 1, True)
    want = {}
    for p, _, body in rows[:-1]:
        want.setdefault(body, []).append(p)
    members = store.read("duplicate_members").collect()
    assert sorted(r["filePath"] for r in members) == sorted(p for g in want.values() for p in g) and sum(r["keep"] for r in members) == 4
    assert store.read("duplicate_exact_staging").count() == 0
    assert maintenance.exact_duplicates(store, media_rows.filter("filePath < '/12'"), content, size=50)
    assert sorted((r["generation"], r["isActive"]) for r in store.read("maintenance_runs").collect()) == [(1, False), (2, True)]
    broken = maintenance.Maintenance(store, "DUPLICATE_EXACT")
    broken.fail()
    assert not broken.step(media_rows, 5, lambda b: b) and not broken.finish(lambda b: {})
    assert maintenance.Maintenance(store, "DUPLICATE_EXACT").generation == 4


def test_a_scan_writes_the_media_table_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    row = lambda p, n: media(spark, [{"filePath": p, "modifiedAtMs": n, "fileSize": 1}])
    run = pipeline.ScanRun(store, 10)
    for i in range(4):
        run.commit(row("/a", i).unionByName(row(f"/{i}", i)))
    assert not store.exists("media_items")
    run.merge()
    got = {r["filePath"]: r["modifiedAtMs"] for r in store.read("media_items").collect()}
    assert got == {"/a": 3, "/0": 0, "/1": 1, "/2": 2, "/3": 3} and store.read("scan_staging").count() == 0


def test_manifests_and_schemas_as_json():
    m = plugins.Manifest("p1", "名", 2, plugins.FEATURE, stage="PRE", order=3, enabled=False, shape=(1, -1), options={"a": [1]})
    assert plugins.Manifest.from_json(m.to_json()) == m and json.loads(m.to_json())["pluginId"] == "p1"
    assert plugins.Manifest.from_json('{"pluginId": "p", "name": "n", "version": 1, "kind": "image", "more": 1}') == plugins.Manifest("p", "n", 1, "image")
    for bad, said in (("{", "no JSON"), ("[]", "object"), ('{"name": "n"}', "pluginId is missing"), ('{"pluginId": 1, "name": "n", "version": 1, "kind": "image"}', "pluginId"), ('{"pluginId": "p", "name": "n", "version": 1, "kind": "image", "shape": ["x"]}', "shape")):
        with pytest.raises(plugins.ManifestError, match=said):
            plugins.Manifest.from_json(bad)
    schema = plugins.FeatureSchema("p1", "faces", 4, (("box", "FLOAT_ARRAY", (4,)), ("label", "STRING", None)))
    assert plugins.FeatureSchema.from_json(schema.to_json()) == schema
    with pytest.raises(plugins.ManifestError):
        plugins.FeatureSchema.from_json('{"pluginId": "p", "featureType": "f", "fields": [{"name": "x", "dataType": "ODD"}]}')


def test_live_page(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    sort = [(F.col("at"), True), (F.col("p"), False)]
    for i, rows in enumerate(([("/a", 1), ("/b", 2), ("/c", 3)], [("/a", 9), ("/d", 2), ("/a", 5)])):
        spark.createDataFrame(rows, "p string, at long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live.watch(spark, f"{tmp_path}/in", "p string, at long")
        live.live_page(stream, store, "media", "p", time="at", sort=sort, size=3, page="first_page", checkpoint=f"{tmp_path}/c").awaitTermination()
        want = [["/c", "/b", "/a"], ["/a", "/c", "/b"]][i]
        assert [r["p"] for r in store.read("first_page").orderBy(F.col("at").desc(), "p").collect()] == want
    assert store.read("media").count() == 4


def test_concepts_are_worked_out_once_a_row(spark):
    import time

    texts = spark.range(0, 4000, 1, 4).select(F.concat(F.lit("large ring "), F.col("id")).alias("t"))
    began = time.perf_counter()
    rows = texts.select(features.embed_text(F.col("t")).alias("v")).distinct().collect()
    assert time.perf_counter() - began < 15  # in the order of a minute when each of 32 numbers works out all of them
    np.testing.assert_allclose([r["v"] for r in rows], [features.text_vector("large ring 7")], atol=1e-6)


def test_near_pairs_of_many_vectors(spark):
    import time

    rng = np.random.default_rng(8)
    near = np.concatenate([rng.normal(0, 1, (6500, 64)), vectors_around(rng, rng.normal(0, 1, (5, 64)), 100, 0.5)]).astype("f4")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "id long, v array<float>").repartition(4).cache()
    rows.count()
    began = time.perf_counter()
    got = {(r["a"], r["b"]): r["distance"] for r in vector.near_pairs(rows, "id", "v", 0.6).collect()}
    assert time.perf_counter() - began < 25  # some minutes where every product is a fold of its own
    unit = near / np.linalg.norm(near.astype(float), axis=1, keepdims=True)
    far = 1 - unit @ unit.T
    assert got.keys() == {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(far <= 0.6)), strict=True) if i < j}
    assert all(abs(d - far[k]) < 1e-9 for k, d in got.items())


def test_near_pairs_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(9)
    made = [v for n in (3, 5) for v in vectors_around(rng, np.eye(n), 12, 0.2).tolist()] + [[1.0, 0.0, 0.0]] * 12
    odd = [None, [], [0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0], [None, 1.0, 0.0], [float("inf"), 0.0, 0.0], [1.0]]
    rows = spark.createDataFrame([(f"k{i:03}", v) for i, v in enumerate(made + odd)] + [(None, [1.0, 0.0, 0.0])], "id string, v array<double>")
    for most in (0.0, 0.02, 0.6, 2.0):
        want = set()
        for i, a in enumerate(made):
            for j, b in enumerate(made[:i]):
                if len(a) == len(b) and max(0.0, 1 - float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))) <= most:
                    want.add((f"k{j:03}", f"k{i:03}"))
        got = [(r["a"], r["b"]) for r in vector.near_pairs(rows, "id", "v", most).collect()]
        assert len(got) == len(set(got)) and set(got) == want, most
    assert vector.near_pairs(rows.filter("v is null"), "id", "v", 0.6).count() == 0


def test_dbscan_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(10)
    v = np.concatenate([vectors_around(rng, np.eye(4), 12, 0.25), [[1.0, 0, 0, 0]] * 8, rng.normal(0, 1, (12, 4)), np.zeros((1, 4))])
    keys = rng.permutation(len(v)).tolist()
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in zip(keys, v, strict=True)] + [(500, None), (501, [1.0])], "id int, v array<double>").cache()
    with np.errstate(invalid="ignore"):
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.nan_to_num(unit @ unit.T, nan=-1.0) >= 1 - 0.03
    np.fill_diagonal(near, True)
    for least in (1, 2, 4, 9):
        core = near.sum(axis=1) >= least
        root = np.array(keys)
        while True:  # the least key among the cores near a core, until nothing changes
            new = np.array([min(root[j] for j in np.flatnonzero(near[i] & core)) if core[i] else root[i] for i in range(len(v))])
            if (new == root).all():
                break
            root = new
        want = {k: (min((int(root[j]) for j in np.flatnonzero(near[i] & core)), default=None), bool(core[i])) for i, k in enumerate(keys)}
        want |= {k: (k if least == 1 else None, least == 1) for k in (500, 501)}
        got = {r["id"]: (r["cluster"], r["core"]) for r in cluster.dbscan(rows, "id", "v", 0.03, least).collect()}
        assert got == want, least


def test_dbscan_of_a_dense_group(spark):
    import time

    rng = np.random.default_rng(12)
    v = np.concatenate([vectors_around(rng, np.eye(64)[:2], 2500, 0.02), rng.normal(0, 1, (200, 64))]).astype("f4")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>").repartition(4).cache()
    rows.count()
    began = time.perf_counter()
    got = {r["id"]: (r["cluster"], r["core"]) for r in cluster.dbscan(rows, "id", "v", 0.2, 3).collect()}
    assert time.perf_counter() - began < 45  # six million near pairs, of which none need be listed
    assert got == {i: (0, True) if i < 2500 else (2500, True) if i < 5000 else (None, False) for i in range(len(v))}


def test_assignment_of_many_vectors(spark):
    import time

    rng = np.random.default_rng(13)
    centres = np.eye(64)[:3]
    v = np.concatenate([vectors_around(rng, centres, 2000, 0.02), rng.normal(0, 1, (100, 64))]).astype("f4")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>").repartition(4).cache()
    known = spark.createDataFrame([("old", centres[0].tolist())], "name string, c array<double>")
    rows.count()
    began = time.perf_counter()
    got = {r["id"]: (r["cluster"], r["is_new"]) for r in cluster.assign(rows, known, "id", "v", "name", "c", most=0.3, eps=0.2).collect()}
    assert time.perf_counter() - began < 45
    assert got == {i: ("old", False) if i < 2000 else (f"new:{2000 if i < 4000 else 4000 if i < 6000 else i}", True) for i in range(len(v))}

"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lensmill.functions import features
from lensmill.plans import registry

from .conftest import DATA


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.collect(), df.columns) == canon(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


# --- queries that SQL cannot express, against plain loops over the same rows ----------------------


def rows_of(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def unit(v):
    return np.asarray(v, float) / np.linalg.norm(v)


def plain_prototypes(samples):
    """At most three unit vectors with counts: join within 0.30, else start one, else join within 0.38."""
    out = []
    for s in samples:
        s = unit(s)
        far = [1 - float(p @ s) for p, _ in out]
        near = min(range(len(far)), key=far.__getitem__, default=None)
        if near is not None and (far[near] <= 0.30 or len(out) == 3 and far[near] <= 0.38):
            p, n = out[near]
            out[near] = (unit((p * n + s) / (n + 1)), min(n + 1, 10_000))
        elif len(out) < 3:
            out.append((s, 1))
    return out


def test_prototypes_query(spark):
    rows = sorted(rows_of("embeddings"), key=lambda r: r["vec_id"])
    got = {(r["label"], r["prototype"]): r for r in registry.QUERIES["cluster_prototypes"](spark, DATA).collect()}
    want = {(label, i): p for label in {r["label"] for r in rows} for i, p in enumerate(plain_prototypes([r["embedding"] for r in rows if r["label"] == label]))}
    assert got.keys() == want.keys()
    for k, (p, n) in want.items():
        assert got[k]["sample_count"] == n
        np.testing.assert_allclose([float(x) for x in got[k]["embedding"].split(",")], p, atol=1e-4)


def plain_dbscan(vectors, eps, least):
    """Least core of each point's cluster, or None."""
    v = np.array([unit(x) for x in vectors.values()])
    keys, near = list(vectors), (1 - v @ v.T) <= eps
    core = near.sum(axis=1) >= least
    root = {}
    for i in range(len(keys)):
        if core[i] and i not in root:
            found, todo = {i}, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core).tolist():
                    if j not in found:
                        found.add(j)
                        todo.append(j)
            root |= dict.fromkeys(found, min(keys[j] for j in found))
    return {k: root.get(i, min((root[j] for j in np.flatnonzero(near[i] & core).tolist()), default=None)) for i, k in enumerate(keys)}


def test_assignment_query(spark):
    rows = rows_of("embeddings")
    known = {label: np.mean([r["embedding"] for r in rows if r["label"] == label], axis=0) for label in range(5)}
    known = {f"known:{k}": v for k, v in known.items() if np.ndim(v)}
    want, left = {}, {}
    for r in rows:
        far = {k: 1 - float(unit(c) @ unit(r["embedding"])) for k, c in known.items()}
        best = min(far, key=lambda k: (far[k], k))
        if far[best] <= 0.7:
            want[r["vec_id"]] = (best, False)
        else:
            left[r["vec_id"]] = r["embedding"]
    if left:
        want |= {k: (f"new:{k if c is None else c}", True) for k, c in plain_dbscan(left, 0.6, 2).items()}
    assert {r["vec_id"]: (r["cluster"], r["is_new"]) for r in registry.QUERIES["incremental_assignment"](spark, DATA).collect()} == want


def test_semantic_clusters_query(spark):
    rows = sorted(rows_of("embeddings"), key=lambda r: str(r["vec_id"]))
    v = [unit(r["embedding"]) for r in rows]
    centres = [v[0]]
    while len(centres) < max(1, min(8, len(v) // 5)):
        near = [min(1 - float(x @ c) for c in centres) for x in v]
        centres.append(v[near.index(max(near))])
    label = None
    for _ in range(20):
        new = [min(range(len(centres)), key=lambda c: 1 - float(x @ centres[c])) for x in v]
        if new == label:
            break
        label = new
        for c in range(len(centres)):
            if mine := [x for x, y in zip(v, label, strict=True) if y == c]:
                centres[c] = unit(np.mean(mine, axis=0))
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in registry.QUERIES["semantic_clusters"](spark, DATA).collect()}
    for r, x, c in zip(rows, v, label, strict=True):
        assert got[r["vec_id"]][0] == c and abs(got[r["vec_id"]][1] - (1 - float(x @ centres[c]))) < 2e-4


def test_diversified_query(spark):
    lists = {}
    for r in registry.QUERIES["diversified_ranking"](spark, DATA).collect():
        lists.setdefault(r["list"], []).append(r)
    orders = rows_of("orders")
    assert sum(map(len, lists.values())) == len({(r["o_orderpriority"], r["o_orderstatus"], r["o_custkey"]) for r in orders})
    for rows in lists.values():
        rows.sort(key=lambda r: r["place"])
        left, shown = list(rows), []
        while left:  # the best that makes no third in a row of a category or an album; the best if there is none
            third = lambda r, k: len(shown) >= 2 and shown[-1][k] == shown[-2][k] == r[k]  # noqa: B023, E731
            fits = [r for r in left if not third(r, "category") and not third(r, "album")]
            if not fits:
                break  # from here on runs are counted anew, which the cases in test_library show
            best = min(fits, key=lambda r: (-r["score"], r["id"]))
            assert rows[len(shown)]["id"] == best["id"]
            shown.append(best)
            left.remove(best)


def test_concepts_query(spark):
    names = {r["p_partkey"]: r["p_name"] for r in rows_of("part")}
    got = {r["p_partkey"]: r["concepts"] for r in registry.QUERIES["concept_vectors"](spark, DATA).collect()}
    assert got.keys() == names.keys()
    for k, name in names.items():
        np.testing.assert_allclose([float(x) for x in got[k].split(",")], features.text_vector(name), atol=1e-5)


def test_all_recommendations_on_large_albums_and_nulls(spark, tmp_path):
    rng = np.random.default_rng(11)
    users = np.concatenate([rng.integers(0, 400, 6000), np.full(700, 1000)])  # the last album is large: 700 rows over months
    start = datetime.datetime(2023, 10, 1)
    rows = [
        {"event_id": i, "ts": start + datetime.timedelta(seconds=int(rng.integers(0, 150 * 86400))), "user_id": int(u), "event_type": [None, "purchase", "view", "error"][i % 4], "value": round(float(rng.uniform(0, 100)), 2), "props": "{}"}
        for i, u in enumerate(users)
    ]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema([("event_id", "int64"), ("ts", pa.timestamp("us")), ("user_id", "int64"), ("event_type", "string"), ("value", "double"), ("props", "string")])), tmp_path / "events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = c.execute(registry.ORACLES["all_recommendations"])
    columns = [x[0] for x in want.description]
    df = registry.QUERIES["all_recommendations"](spark, str(tmp_path))
    assert canon(df.collect(), df.columns) == canon(want.fetchall(), columns)

"""Exact search against brute force and against SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=50, top=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, v) in enumerate(ok):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for n, (j, w) in enumerate(ok) if n != k and len(w) == len(v))
            out += [(i, r + 1, j, max(-(2**63) + 1, min(2**63 - 1, -s))) for r, (s, j) in enumerate(found[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(1)
    unit = lambda x: (x / np.linalg.norm(x)).astype(np.float32).tolist()
    rows = [(i, unit(r.normal(size=16)), 0) for i in range(600)]
    for c in range(8):
        centre = r.normal(size=16)
        rows += [(1000 + 100 * c + i, unit(centre + 0.05 * r.normal(size=16)), c) for i in range(80)]
    rows += [(3000 + i, rows[50][1], 1) for i in range(300)]  # a third are copies of one query
    rows += [(5000 + i, [0.5, -0.25], 2) for i in range(60)] + [(6000, [], 1), (6050, [], 1), (6001, [], 1), (6100, [1.0, 2.0, 3.0], 1)]
    rows += [(6150, None, 0), (6200, [None] * 16, 0), (6250, [float("nan")] * 16, 0), (6300, [float("inf")] + [0.0] * 15, 0), (None, rows[0][1], 0)]
    rows += [(50, rows[50][1], 3), (50, rows[7][1], 3), (-100, rows[9][1], 3), (6350, [0.0] * 16, 0)]
    return rows


@pytest.mark.parametrize("shard,chunk,block", [(2048, 1024, 512), (64, 10, 3)])
def test_search(spark, vectors, monkeypatch, shard, chunk, block):
    for name, value in (("SHARD", shard), ("CHUNK", chunk), ("BLOCK", block), ("LEAF", 8)):
        monkeypatch.setattr(topk, name, value)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in vectors], SCHEMA + ", rid int, part string, size int").repartition(5)
    assert sorted(tuple(r) for r in topk.highest(df).collect()) == plain(vectors)


def test_against_sql(spark, vectors):
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [r[0] for r in vectors], "embedding": pa.array([r[1] for r in vectors], pa.list_(pa.float32()))}))
    assert sorted(con.execute(f"select query_id, rank, vec_id, score from ({topk.ORACLE})").fetchall()) == plain(vectors)


def test_few_and_none(spark):
    rows = [(0, [1.0], 0), (1, [1.0], 0), (2, [-1.0], 0)]
    assert sorted(tuple(r) for r in topk.highest(spark.createDataFrame(rows, SCHEMA)).collect()) == [(0, 1, 1, 65536), (0, 2, 2, -65536)]
    assert topk.highest(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).collect() == []
    assert topk.highest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_components(spark):
    """Products beyond what double precision holds exactly, and beyond 64 bits."""
    rows = [(0, [1e6, 3.7, 1e7], 0), (1, [1e6 + 1, 2.1, 1e7], 0), (2, [1e6, 3.7, 1e7 + 1], 0), (3, [-1e30, 0.0, 0.0], 0), (4, [1e30, 1e30, 1e30], 0), (5, [0.1, 0.2, 1e7], 0)]
    assert sorted(tuple(r) for r in topk.highest(spark.createDataFrame(rows, SCHEMA)).collect()) == plain(rows)


def test_clusters_are_skipped():
    """Far clusters are proven out of reach: most products are never worked out, and the result is that of all."""
    r = np.random.default_rng(2)
    v = np.concatenate([c + r.normal(size=(256, 8)) for c in 300 * r.normal(size=(32, 8))]).round()
    ids = r.permutation(len(v))
    tree = topk.Tree(ids, np.arange(len(v)), v)
    rows = np.arange(0, len(v), 50)
    scores, found = np.full((len(rows), 5), topk._NONE), np.full((len(rows), 5), topk._LAST)
    _, looked = topk.search(tree, v[rows], rows, scores, found)
    every = topk.products(v[rows], v)
    every[np.arange(len(rows)), rows] = topk._NONE
    best = np.lexsort((np.broadcast_to(ids, every.shape), -np.where(every == topk._NONE, -topk._LAST, every)), axis=1)[:, :5]
    assert (found == ids[best]).all() and (scores == np.take_along_axis(every, best, axis=1)).all()
    assert looked < 0.2 * every.size


def test_asked_rows_are_not_broadcast(spark, vectors, monkeypatch):
    """What grows with queries times shards goes between tasks, never through the driver."""
    monkeypatch.setattr(topk, "SHARD", 64)
    out = topk.highest(spark.createDataFrame(vectors, SCHEMA))
    out.collect()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()

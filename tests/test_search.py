"""Block search: every row that brute force gives, and blocks that are skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import related, vectors


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


def clusters(seed, n, each, dims=24, spread=0.05):
    r = np.random.default_rng(seed)
    x = np.concatenate([c + spread * r.normal(size=(each, dims)) for c in r.normal(size=(n, dims))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plain(q, qi, p, pi, top_k, least, strict, itself):
    raw = np.clip(q @ p.T, 0, 1)
    score = np.floor(raw * 1e4 + 0.5) / 1e4
    out = {}
    for a, i in enumerate(qi):
        found = [(-score[a, b], int(j)) for b, j in enumerate(pi) if (itself or i != j) and (least is None or (score[a, b] > least if strict else raw[a, b] >= least))]
        out[int(i)] = sorted(found)[:top_k]
    return out


@pytest.mark.parametrize("top_k,least,strict,itself", [(5, None, True, False), (1, 0.5, False, True), (None, 0.6, True, False), (7, 0.3, True, False), (10_000, None, True, True)])
@pytest.mark.parametrize("far", [True, False])
def test_search_equals_brute_force(spark, monkeypatch, top_k, least, strict, itself, far):
    monkeypatch.setattr(vectors, "POOL_BLOCK", 40)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 16)
    monkeypatch.setattr(vectors, "BOUND_BLOCKS", 7)
    monkeypatch.setattr(vectors, "DIRECT_PAIRS", 0)
    x = clusters(1, 15, 30) if far else clusters(2, 450, 1)
    x[5] = x[200] = x[3]
    pool, queries = frame(spark, x), frame(spark, x).where("id % 7 = 0")
    rows, visited, every = vectors.search(queries, pool, top_k, least, strict, itself)
    want = plain(x[::7], np.arange(len(x))[::7], x, np.arange(len(x)), top_k, least, strict, itself)
    got = {i: [] for i in want}
    for r in rows.collect():
        got[r.query].append((-r.score, r.id))
    assert {i: sorted(v)[:top_k] for i, v in got.items()} == want
    assert 0 < visited <= every
    if far and (least or 0) >= 0.5 or far and top_k == 5:
        assert visited < 0.4 * every


def test_search_of_nothing(spark):
    none, some = frame(spark, np.zeros((0, 3))), frame(spark, np.eye(3))
    assert vectors.top_k(none, some).collect() == [] == vectors.top_k(some, none).collect()
    assert [(r["query"], r["id"]) for r in vectors.top_k(some, some, 1).orderBy("query").collect()] == [(0, 1), (1, 0), (2, 0)]


def test_maintenance_looks_at_one_candidate_more_than_links(spark):
    """Pages whose best candidates are all linked already get the next one, as brute force over all pages says."""
    x = clusters(3, 6, 25)
    n = len(x)
    pages = frame(spark, x).withColumn("current", F.when(F.col("id") % 3 == 0, (F.col("id") + 1) % n))
    raw = np.clip(x @ x.T, 0, 1)
    np.fill_diagonal(raw, -1)
    best = np.argsort(-raw, axis=1, kind="stable")[:, :3]
    links = spark.createDataFrame([(i, int(j)) for i in range(n) for j in best[i, : i % 4]], "query long, id long")
    got = {r.id: r.candidate for r in related.maintenance(pages, frame(spark, x).where("id % 10 = 0").select("id"), links).collect()}
    linked = {(r.query, r.id) for r in links.collect()}
    for i, candidate in got.items():
        score = np.floor(np.clip(raw[i], 0, 1) * 1e4 + 0.5) / 1e4
        rest = sorted((-score[j], j) for j in range(n) if j != i and (i, j) not in linked and score[j] > vectors.RELATED_LEAST)
        assert candidate == (rest[0][1] if rest else None)


def test_candidates_are_cut_in_tiles(spark, monkeypatch):
    """Blocks are sent and candidates cut once a tile, not once a pair of blocks; one block of queries is dealt to many tiles."""
    for name, value in (("POOL_BLOCK", 20), ("QUERY_BLOCK", 16), ("DIRECT_PAIRS", 0)):
        monkeypatch.setattr(vectors, name, value)
    x = clusters(4, 300, 1)
    pool = frame(spark, x)
    want = plain(x, np.arange(len(x)), x, np.arange(len(x)), 2, None, True, False)
    counts = []
    for tile in ({"q": 100, "p": 100}, {"q": 2, "p": 3}):
        monkeypatch.setattr(vectors, "TILE_BLOCKS", tile)
        found = vectors.search(pool, pool, 2)[0].collect()
        got = {i: sorted((-r.score, r.id) for r in found if r["query"] == i)[:2] for i in want}
        assert got == want
        counts.append(len(found))
    # two rows a query from its first block, two from all the others
    assert counts[0] <= 4 * len(x) < counts[1]

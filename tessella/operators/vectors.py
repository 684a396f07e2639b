"""Exact similarity search: a set of query vectors against a pool, in blocks that are skipped where they can't matter.

Both sides are packed into blocks of near vectors. A block's centre and radius bound the score that any of its vectors can
have with a query, so only pairs of blocks in which some query may still find something are multiplied. For the k best,
each query first goes to its most promising block; the k-th score it has then is what the other blocks must reach. What
is shuffled is blocks, for the pairs that are wanted, and candidates; never pairs of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import held

# Fixed values.
TOP_K = 5
STRONG_OVERLAP = 0.80
SAME_BATCH_MOST, RELATED_TOP_K, RELATED_LEAST, REPLACE_MARGIN = 5, 3, 0.7, 0.04
QUERY_BLOCK, POOL_BLOCK = 1024, 4096
#: Vectors that block centres are fitted on at most, centres at most, blocks whose bounds one group works out. None of them changes a result.
CENTRE_SAMPLE, CENTRES, BOUND_BLOCKS = 2048, 256, 512
#: Copies of a group of centres, so that blocks of queries don't all go to one task for it.
SALTS = 64
#: Blocks of queries and of the pool in a tile, about: 8 and 16 MB of 64 dimensions.
TILE_BLOCKS = {"q": 16, "p": 8}
#: Pairs of blocks up to which all are multiplied.
DIRECT_PAIRS = 16


def cosine(a: Column, b: Column) -> Column:
    """Dot product of normalised vectors, of the length both have, held to 0..1; for a few pairs."""
    n = F.least(F.size(a), F.size(b))
    product = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), product)))


def _centres(pool: DataFrame, n: int) -> np.ndarray:
    """At most CENTRES means of near vectors in a bounded sample of the pool."""
    sample = _matrix(pool.select("vector").orderBy(F.xxhash64("id")).limit(CENTRE_SAMPLE).toArrow().column(0).combine_chunks())
    out = sample[np.linspace(0, len(sample) - 1, min(len(sample), CENTRES, max(1, n // POOL_BLOCK * 2))).astype(int)]
    for _ in range(5):
        near = _nearest(sample, out)
        out = np.array([sample[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(out)])
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1).astype(np.int32)


def _blocks(rows: DataFrame, centres: np.ndarray | None, size: int, prefix: str) -> DataFrame:
    """Rows ``id``, ``vector`` packed into blocks (``cell``, ``part``) of about ``size`` near ones, with ``centre`` and ``radius``."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = pa.array(_nearest(_matrix(batch.column(1)), centres) if batch.num_rows else [], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=["id", "vector", "cell"])

    def packed(block: pa.Table) -> pa.Table:
        x = _matrix(block.column("vector").combine_chunks())
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        own = [pa.array([block.column(k)[0].as_py()], pa.int32()) for k in ("cell", "part")]
        lists = [pa.array([v], pa.list_(kind)) for v, kind in ((block.column("id").to_numpy(), pa.int64()), (x.reshape(-1), pa.float64()), (centre, pa.float64()))]
        return pa.Table.from_arrays([*own, *lists, pa.array([radius])], names=["cell", "part", "ids", "flat", "centre", "radius"])

    rows = rows.select("id", "vector")
    dealt = rows.withColumn("cell", F.lit(0)) if centres is None else rows.mapInArrow(placed, "id long, vector array<double>, cell int")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))  # CENTRES rows at most
    dealt = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    made = dealt.groupBy("cell", "part").applyInArrow(packed, "cell int, part int, ids array<long>, flat array<double>, centre array<double>, radius double")
    return made.select(*(F.col(c).alias(f"{prefix}_{c}") for c in made.columns))


def _rounded(raw: np.ndarray) -> np.ndarray:
    return np.floor(raw * 1e4 + 0.5) / 1e4


def _wanted(chunks: DataFrame, blocks: DataFrame, edges: DataFrame | None, least: float | None, first: bool) -> DataFrame:
    """``q_cell``, ``q_part``, ``p_cell``, ``p_part``: pairs of blocks that may hold something for some query.

    first: only each query's most promising block. edges: ``query``, ``edge``, the score that a query's candidates must reach. A row is
    one block of queries with about BOUND_BLOCKS centres, whatever the sizes of both sides.
    """
    supers, salts = max(1, -(-blocks.count() // BOUND_BLOCKS)), max(1, min(SALTS, chunks.count()))
    keys = ["q_cell", "q_part"]
    balls = blocks.groupBy(F.pmod(F.xxhash64("p_cell", "p_part"), F.lit(supers)).cast("int").alias("super")).agg(F.collect_list(F.struct("p_cell", "p_part", "p_centre", "p_radius")).alias("balls"))
    balls = balls.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asks = chunks.select(*keys, "q_ids", "q_flat")
    if edges is not None:
        each = chunks.select(*keys, F.explode("q_ids").alias("query")).join(edges, "query")
        asks = asks.join(each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("query", "edge"))).alias("edges")), keys, "left")
    else:
        asks = asks.withColumn("edges", F.lit(None).cast("map<long,double>"))
    asks = asks.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")).withColumn("super", F.explode(F.sequence(F.lit(0), F.lit(supers - 1))))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell, part, ids, flat, edge, balls = (batch.column(k)[row] for k in range(6))
                ids, balls = ids.values.to_numpy(), balls.values
                q = flat.values.to_numpy().reshape(len(ids), -1)
                reach = q @ _matrix(balls.field("p_centre")).T
                reach = reach + np.sqrt((q**2).sum(axis=1))[:, None] * balls.field("p_radius").to_numpy()[None, :] + 1e-9
                reach = _rounded(np.clip(reach, 0, 1))
                known = dict(edge.as_py() or [])
                need = np.array([known.get(i, 0.0) for i in ids.tolist()])
                if least is not None:
                    need = np.maximum(need, _rounded(np.array(least - 1e-4)))
                may = reach >= need[:, None]
                hit = np.unique(reach.argmax(axis=1)) if first else np.nonzero(may.any(axis=0))[0]
                hit = hit[may[:, hit].any(axis=0)]
                own = [pa.array([k.as_py()] * len(hit), pa.int32()) for k in (cell, part)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(balls.field(k).to_numpy()[hit], pa.int32()) for k in ("p_cell", "p_part"))], names=["q_cell", "q_part", "p_cell", "p_part"])

    met = asks.join(balls, ["super", "salt"]).select(*keys, "q_ids", "q_flat", "edges", "balls")
    return met.mapInArrow(bound, "q_cell int, q_part int, p_cell int, p_part int")


def _best(qi: np.ndarray, q: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], top_k: int | None, least: float | None, strict: bool, itself: bool) -> list[np.ndarray]:
    """``query``, ``id``, ``score``, ``raw`` of the best rows of one block of queries in all of the blocks (ids, vectors) of the pool."""
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]  # row of the query, id, score, raw
    whole, need = [], np.full(len(qi), -1.0)  # need: the last score a query has, once it has top_k
    for pi, p in parts:
        raw = np.clip(q @ p.T, 0.0, 1.0)
        bar = need
        if top_k is not None and (need < 0).any() and raw.shape[1] > top_k:
            # one more than wanted, as one may be the query itself
            bar = np.maximum(need, _rounded(-np.partition(-raw, top_k, axis=1)[:, top_k]))
        # a score may be rounded up by half of its last place
        bar = bar - 1e-4
        if least is not None:
            bar = np.maximum(bar, least - 1e-4)
        a, b = np.nonzero(raw >= bar[:, None])
        raw = raw[a, b]
        score = _rounded(raw)
        ok = np.ones(len(a), bool) if itself else qi[a] != pi[b]
        if least is not None:
            ok &= score > least if strict else raw >= least
        found = [a[ok], pi[b[ok]], score[ok], raw[ok]]
        if top_k is None:
            whole.append(found)
            continue
        kept = [np.concatenate(x) for x in zip(kept, found)]
        order = np.lexsort((kept[1], -kept[2], kept[0]))
        kept = [x[order] for x in kept]
        start = np.searchsorted(kept[0], np.arange(len(qi)))
        keep = np.arange(len(order)) - start[kept[0]] < top_k
        kept = [x[keep] for x in kept]
        start, end = (np.searchsorted(kept[0], np.arange(len(qi)), side) for side in ("left", "right"))
        full = np.nonzero(end - start == top_k)[0]
        need[full] = kept[2][end[full] - 1]
    if top_k is None and whole:
        kept = [np.concatenate(x) for x in zip(*whole)]
    return [qi[kept[0]], *kept[1:]]


_FOUND = "query long, id long, score double, raw double"


def _block(ids: pa.Scalar, flat: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    ids = ids.values.to_numpy()
    return ids, flat.values.to_numpy().reshape(len(ids), -1)


def _visited_each(met: DataFrame, *how: object) -> DataFrame:
    """``query``, ``id``, ``score``, ``raw``: the best rows of each pair of blocks; a row holds both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qi, q, pi, p = (batch.column(k)[row] for k in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(*_block(qi, q), [_block(pi, p)], *how)], names=["query", "id", "score", "raw"])

    return met.select("q_ids", "q_flat", "p_ids", "p_flat").mapInArrow(run, _FOUND)


def _visited(pairs: DataFrame, chunks: DataFrame, blocks: DataFrame, *how: object) -> DataFrame:
    """The same for the wanted pairs of blocks, the best rows of each tile of them.

    A tile is about TILE_BLOCKS blocks of either side. A block is sent once to each tile that wants it for any pair, not once a pair,
    and a tile is a group of its own, so that no task gathers all that a block meets.
    """
    sides = {"q": (["q_cell", "q_part"], chunks), "p": (["p_cell", "p_part"], blocks)}
    tiles = {k: F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-df.count() // TILE_BLOCKS[k])))).cast("int").alias(f"{k}_tile") for k, (keys, df) in sides.items()}
    wanted = pairs.select("*", *tiles.values())
    none = {"ids": F.lit(None).cast("array<long>"), "flat": F.lit(None).cast("array<double>")}
    both = wanted.select("q_tile", "p_tile", "q_cell", "q_part", "p_cell", "p_part", *(c.alias(k) for k, c in none.items()))
    for k, (keys, df) in sides.items():
        sent = wanted.select("q_tile", "p_tile", *keys).distinct().join(df.select(*keys, F.col(f"{k}_ids").alias("ids"), F.col(f"{k}_flat").alias("flat")), keys)
        own = [F.col(c) if c in keys else F.lit(None).cast("int").alias(c) for c in ("q_cell", "q_part", "p_cell", "p_part")]
        both = both.unionAll(sent.select("q_tile", "p_tile", *own, "ids", "flat"))

    def visit(tile: pa.Table) -> pa.Table:
        keys = list(zip(*(tile.column(c).to_pylist() for c in ("q_cell", "q_part", "p_cell", "p_part"))))
        ids, flat = tile.column("ids"), tile.column("flat")
        held = {key: _block(ids[row], flat[row]) for row, key in enumerate(keys) if None in key}
        asked: dict[tuple, list[tuple]] = {}
        for key in keys:
            if None not in key:
                asked.setdefault((*key[:2], None, None), []).append((None, None, *key[2:]))
        found = [_best(*held[q], [held[p] for p in sorted(parts, key=str)], *how) for q, parts in asked.items()]
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["query", "id", "score", "raw"])

    return both.groupBy("q_tile", "p_tile").applyInArrow(visit, _FOUND)


def search(queries: DataFrame, pool: DataFrame, top_k: int | None = None, least: float | None = None, strict: bool = True, itself: bool = False) -> tuple[DataFrame, int, int]:
    """The rows of scores(), and how many of how many pairs of blocks were multiplied for them."""
    spark, n = queries.sparkSession, pool.count()
    if not n or queries.isEmpty():
        return spark.createDataFrame([], "query long, id long, score double, raw double"), 0, 0
    few = -(-n // POOL_BLOCK) * -(-queries.count() // QUERY_BLOCK)
    if few <= DIRECT_PAIRS:  # less work than finding out what to skip
        chunks, blocks = _blocks(queries, None, QUERY_BLOCK, "q"), _blocks(pool, None, POOL_BLOCK, "p")
        return _visited_each(blocks.crossJoin(chunks), top_k, least, strict, itself), few, few
    centres = _centres(pool, n)
    chunks, blocks = held(_blocks(queries, centres, QUERY_BLOCK, "q")), held(_blocks(pool, centres, POOL_BLOCK, "p"))
    every = chunks.count() * blocks.count()
    keys = ["q_cell", "q_part", "p_cell", "p_part"]
    if top_k is None:
        pairs = held(_wanted(chunks, blocks, None, least, first=False))
        return _visited(pairs, chunks, blocks, top_k, least, strict, itself), pairs.count(), every
    begun = held(_wanted(chunks, blocks, None, least, first=True))
    rows = held(_visited(begun, chunks, blocks, top_k, least, strict, itself))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    edges = rows.withColumn("place", place).where(F.col("place") == top_k).select("query", F.col("score").alias("edge"))
    rest = held(_wanted(chunks, blocks, edges, least, first=False).join(begun, keys, "left_anti"))
    return rows.unionAll(_visited(rest, chunks, blocks, top_k, least, strict, itself)), begun.count() + rest.count(), every


def scores(queries: DataFrame, pool: DataFrame, top_k: int | None = None, least: float | None = None, strict: bool = True, itself: bool = False) -> DataFrame:
    """``query``, ``id``, ``score`` (4 decimals, halves up), ``raw`` of each query's best in the pool.

    queries, pool: ``id`` (long), ``vector`` (array<double>, normalised). top_k is applied within each tile of blocks by
    (score descending, id), so the callers' ranking over the result is exact; least keeps scores above (strict) or
    from it on, by the rounded (strict) or raw score. itself: whether a query may find its own id.
    """
    return search(queries, pool, top_k, least, strict, itself)[0]


def _matrix(lists: pa.ListArray) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def top_k(queries: DataFrame, pool: DataFrame, k: int = TOP_K) -> DataFrame:
    """``query``, ``id``, ``score``, ``rank``: ties go to the smaller id."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = scores(queries, pool, top_k=k).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query", "id", "score", "rank")


def related(queries: DataFrame, pool: DataFrame, links: DataFrame, least: float = RELATED_LEAST, k: int = RELATED_TOP_K) -> DataFrame:
    """``query``, ``id``, ``score``, ``decision``, ``rank`` of all candidates above the threshold.

    links: ``query``, ``id`` already linked from the body; those are filtered, the k best others kept, the rest cut off.
    """
    found = scores(queries, pool, least=least).join(links.distinct().withColumn("linked", F.lit(True)), ["query", "id"], "left")
    order = Window.partitionBy("query", F.col("linked").isNull()).orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.when(F.col("linked").isNull(), F.row_number().over(order)))
    decision = F.when(F.col("linked"), "already_body_link").when(F.col("rank") <= k, "kept").otherwise("cutoff")
    return ranked.select("query", "id", "score", decision.alias("decision"), "rank")


def strong_overlaps(hits: DataFrame, decisions: DataFrame, least: float = STRONG_OVERLAP) -> DataFrame:
    """``query``, ``id``, ``score`` of best hits from the threshold on that no update or noop decision refers to.

    decisions: ``query``, ``action``, ``target`` and optionally ``matched`` (array of ids).
    """
    best = hits.where(F.col("rank") == 1).where(F.col("score") >= least).select("query", "id", "score")
    used = decisions.where(F.col("action").isin("update", "noop"))
    targets = used.select("query", F.col("target").alias("id"))
    if "matched" in decisions.columns:
        targets = targets.unionByName(used.select("query", F.explode("matched").alias("id")))
    return best.join(targets.where("id is not null").distinct(), ["query", "id"], "left_anti")


def pool_after(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows that weren't written again, and the new ones; rows whose vector is missing are an error."""
    both = old.join(new.select("id"), "id", "left_anti").unionByName(new)
    return both.withColumn("vector", F.when(F.col("vector").isNull(), F.raise_error(F.concat(F.lit("no vector for "), F.col("id").cast("string")))).otherwise(F.col("vector")))

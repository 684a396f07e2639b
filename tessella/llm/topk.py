"""Exact highest inner products, by branch and bound over one ball tree for each shard of the vectors.

Vectors are dealt to the nearest of a few centres, and a centre's vectors into shards of about SHARD rows; each shard is a
ball tree. An inner product with any vector of a ball is at most that with its centre plus the query's length times the
radius, so a ball whose bound is under a query's current last score holds nothing for it. A query is first searched for in
the shard it lies in. The last score it has then is shared with all other shards: shards out of its reach are never sent
to it, and in the others it is the score to beat from the start. A tree is walked once for a whole chunk of queries: each
ball keeps those that it may still serve, of two balls the one of the higher bounds comes first.

The centres come from a bounded sample and only decide how much can be skipped: every vector is in a shard, and what is
skipped is proven. Where nothing can be (vectors in all directions), what remains is one matrix product for each chunk and leaf.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import apart, mapped, sliced, stored

SCALE, EVERY, TOP = 256, 50, 5
#: Rows of a shard, of a leaf of its tree, of a chunk of queries, of a block of shards whose bounds are worked out together.
SHARD, LEAF, CHUNK, BLOCK = 2048, 64, 1024, 512
#: Vectors that the centres are fitted on at most, and centres at most.
SAMPLE_ROWS, CENTRES = 2048, 256
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_KEYS = ["size", "cell", "part"]


def quantised(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); whole numbers in double precision, exact as SCALE is a power of two."""
    return np.floor(SCALE * flat.astype(np.float64))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows; those beyond 64 bits are the largest or smallest number in them."""
    if not q.shape[1]:
        return np.zeros((len(q), len(v)), dtype=np.int64)
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] < 2.0**53:
        return (q @ v.T).astype(np.int64)
    big = lambda x: np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)
    return np.clip(big(q) @ big(v).T, _NONE + 1, _LAST).astype(np.int64)


class Tree:
    """A ball tree over the rows v with ids and row numbers; nodes are ranges of the rows in the tree's order."""

    def __init__(self, ids: np.ndarray, rids: np.ndarray, v: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(v))
        ends, kids, centre, radius, low = [], [], [], [], []
        stack = [(0, len(v), None)]
        while stack:
            a, b, parent = stack.pop()
            k, rows = len(ends), order[a:b]
            if parent is not None:
                kids[parent].append(k)
            middle = v[rows].mean(axis=0)
            far = np.sqrt(((v[rows] - middle) ** 2).sum(axis=1))
            ends.append((a, b)), kids.append([]), centre.append(middle), radius.append(far.max()), low.append(ids[rows].min())
            if b - a > leaf and radius[-1] > 0:
                # cut in half along the line through the two rows far apart
                one = v[rows[far.argmax()]]
                other = v[rows[((v[rows] - one) ** 2).sum(axis=1).argmax()]]
                m = (a + b) // 2
                order[a:b] = rows[np.argpartition(v[rows] @ (other - one), m - a)]
                stack += [(a, m, k), (m, b, k)]
        self.ids, self.rids, self.v = ids[order], rids[order], v[order]
        self.ends, self.kids = ends, kids
        self.centre, self.radius, self.low = np.array(centre), np.array(radius), np.array(low)


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The highest inner product that each row of q can have with a point of each ball, rounded up beyond all error."""
    length, reach = np.sqrt((q**2).sum(axis=1)), radius + np.sqrt((centre**2).sum(axis=1))
    with np.errstate(all="ignore"):
        bound = q @ centre.T + np.outer(length, radius)
        bound = np.floor(bound + 1e-9 * np.outer(length, reach) + 1e-6)
    return np.where(np.isnan(bound), np.inf, bound)


def serves(bound: np.ndarray, low: np.ndarray | int, score: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a ball of this bound and smallest id may still hold a row that goes before a last score and its id."""
    return (bound > score) | ((bound == score) & (low < last))


def search(tree: Tree, q: np.ndarray, rids: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, int]:
    """Bring each query's TOP scores and ids up to date in place; which of them are the tree's, and how many products were needed."""
    mine, looked = np.zeros(scores.shape, dtype=bool), 0
    reach = bounds(q, tree.centre, tree.radius)
    stack = [(0, np.arange(len(q)))]
    while stack:
        node, rows = stack.pop()
        rows = rows[serves(reach[rows, node], tree.low[node], scores[rows, -1], ids[rows, -1])]
        if not len(rows):
            continue
        if tree.kids[node]:
            first, second = sorted(tree.kids[node], key=lambda k: -reach[rows, k].sum())
            stack += [(second, rows), (first, rows)]
            continue
        a, b = tree.ends[node]
        for i in range(a, b, 4 * LEAF):  # a leaf of equal rows may be long
            part = slice(i, min(b, i + 4 * LEAF))
            found = products(q[rows], tree.v[part])
            looked += found.size
            found[rids[rows][:, None] == tree.rids[part]] = _NONE
            better = np.nonzero(found.max(axis=1) >= scores[rows, -1])[0]
            if not len(better):
                continue
            at = rows[better]
            every = np.concatenate([scores[at], found[better]], axis=1)
            names = np.concatenate([ids[at], np.where(found[better] == _NONE, _LAST, tree.ids[part])], axis=1)
            own = np.concatenate([mine[at], np.broadcast_to(found[better] > _NONE, found[better].shape)], axis=1)
            best = np.lexsort((names, np.where(every == _NONE, _LAST, -(every + 1))), axis=1)[:, : scores.shape[1]]
            scores[at], ids[at], mine[at] = (np.take_along_axis(x, best, axis=1) for x in (every, names, own))
    return mine, looked


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an array column, all of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


def centres(sample: np.ndarray, most: int) -> np.ndarray:
    """At most so many centres of a sample, by a few rounds of nearest means from rows spread over it."""
    out = np.unique(sample, axis=0)
    out = out[np.linspace(0, len(out) - 1, min(most, len(out))).astype(int)]
    for _ in range(4):
        near = nearest(sample, out)
        out = np.array([sample[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(out)])
    return out


def nearest(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return ((middle**2).sum(axis=1) - 2 * x @ middle.T).argmin(axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """``rid`` (a number of the row), ``vec_id``, ``size``, ``v``: rows with an id and nothing but finite components."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) <= 1e300)))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.size("v").alias("size"), "v")


def shards(vectors: DataFrame, every: int, top: int) -> tuple[DataFrame, DataFrame]:
    """Written trees (``size``, ``cell``, ``part``, ``low``, ``centre``, ``radius``, ``tree``) and queries, searched for where they lie
    (``size``, ``cell``, ``part``, ``rid``, ``query_id``, ``v``, ``scores``, ``ids``)."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "topk-rows")
    some = rows.select("size", "v").orderBy(F.xxhash64("vec_id", "rid")).limit(SAMPLE_ROWS).toArrow()
    most = min(CENTRES, -(-rows.count() // SHARD))
    sizes = some.column("size").to_numpy()
    fitted = {int(s): centres(quantised(_matrix(some.column("v").filter(pa.array(sizes == s)))), most) for s in np.unique(sizes) if s}
    shipped = spark.sparkContext.broadcast(fitted)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            size = batch.column(2).to_numpy()
            cell = np.zeros(len(size), dtype=np.int32)
            for s in np.unique(size):
                if int(s) in shipped.value:
                    here = np.nonzero(size == s)[0]
                    cell[here] = nearest(quantised(_matrix(batch.column(3).take(pa.array(here)))), shipped.value[int(s)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["rid", "vec_id", "size", "v", "cell"])

    rows = mapped(rows, dealt, "rid long, vec_id long, size int, v array<double>, cell int")
    parts = rows.groupBy("size", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    rows = rows.join(apart(parts), ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")).drop("parts")

    def build(shard: pa.Table) -> pa.Table:
        ids, rids, v = shard.column("vec_id").to_numpy(), shard.column("rid").to_numpy(), quantised(_matrix(shard.column("v")))
        tree = Tree(ids, rids, v)
        asks = np.nonzero(ids % every == 0)[0]
        scores, found = np.full((len(asks), top), _NONE), np.full((len(asks), top), _LAST)
        search(tree, v[asks], rids[asks], scores, found)
        n = len(asks) + 1
        key = [pa.repeat(pa.scalar(shard.column(k)[0].as_py(), pa.int32()), n) for k in _KEYS]
        lists = [pa.concat_arrays([_rows(x), pa.nulls(1, pa.list_(pa.from_numpy_dtype(x.dtype)))]) for x in (v[asks], scores, found)]
        own = [pa.array([*x[asks].tolist(), None], pa.int64()) for x in (rids, ids)]
        only = lambda x, kind: pa.array([None] * (n - 1) + [x], kind)
        whole = [only(int(ids.min()), pa.int64()), only(tree.centre[0].tolist(), pa.list_(pa.float64())), only(float(tree.radius[0]), pa.float64()), only(pickle.dumps(tree, 5), pa.binary())]
        return pa.Table.from_arrays([*key, *own, *lists, *whole], names=[*_KEYS, "rid", "query_id", "v", "scores", "ids", "low", "centre", "radius", "tree"])

    schema = "size int, cell int, part int, rid long, query_id long, v array<double>, scores array<long>, ids array<long>, low long, centre array<double>, radius double, tree binary"
    out = stored(rows.groupBy(*_KEYS).applyInArrow(build, schema), "topk-shards")
    return out.where("tree is not null").select(*_KEYS, "low", "centre", "radius", "tree"), out.where("rid is not null").select(*_KEYS, "rid", "query_id", "v", "scores", "ids")


def reached(trees: DataFrame, queries: DataFrame, chunks: int, blocks: int) -> DataFrame:
    """``size``, ``cell``, ``part``, ``chunk``, ``rid``: the shards, but for its own, that may hold something for a query.

    A group is a chunk of queries and a block of shards; neither side of it grows with the data.
    """
    asks = queries.select(*_KEYS, "rid", "v", F.col("scores")[F.size("scores") - 1].alias("score"), F.col("ids")[F.size("ids") - 1].alias("last"), F.lit(None).cast("double").alias("radius"))
    asks = asks.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    balls = trees.select(*_KEYS, F.lit(None).cast("long").alias("rid"), F.col("centre").alias("v"), F.lit(None).cast("long").alias("score"), F.col("low").alias("last"), "radius")
    balls = balls.withColumn("block", F.pmod(F.xxhash64(*_KEYS), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    both = asks.unionByName(balls)

    def bound(group: pa.Table) -> pa.Table:
        is_ball = group.column("rid").is_null().to_numpy(zero_copy_only=False)
        balls, asks = group.filter(pa.array(is_ball)), group.filter(pa.array(~is_ball))
        x, y = np.nonzero(np.zeros((0, 0)))
        if len(balls) and len(asks):
            reach = bounds(_matrix(asks.column("v")), _matrix(balls.column("v")), balls.column("radius").to_numpy())
            may = serves(reach, balls.column("last").to_numpy()[None, :], asks.column("score").to_numpy()[:, None], asks.column("last").to_numpy()[:, None])
            same = np.ones(may.shape, dtype=bool)
            for k in ("cell", "part"):
                same &= asks.column(k).to_numpy()[:, None] == balls.column(k).to_numpy()[None, :]
            x, y = np.nonzero(may & ~same)
        key = [pa.array(balls.column(k).to_numpy()[y] if len(y) else [], pa.int32()) for k in _KEYS]
        chunk = pa.repeat(pa.scalar(group.column("chunk")[0].as_py(), pa.int32()), len(x))
        return pa.Table.from_arrays([*key, chunk, pa.array(asks.column("rid").to_numpy()[x] if len(x) else [], pa.int64())], names=[*_KEYS, "chunk", "rid"])

    return both.groupBy("size", "block", "chunk").applyInArrow(bound, "size int, cell int, part int, chunk int, rid long")


def visited(asks: DataFrame, trees: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """``rid``, ``query_id``, ``score``, ``vec_id``: what the reached shards add to the queries' highest scores.

    Stored, the asked rows are a few bits each, so Spark would take millions for a table small enough to broadcast. Sort-merge
    joins keep them, and the pairs of shards and chunks, away from the driver.
    """
    rows = asks.hint("merge").join(queries.drop(*_KEYS), "rid").select(*_KEYS, "chunk", "rid", "query_id", "v", "scores", "ids", F.lit(None).cast("binary").alias("tree"))
    needed = asks.select(*_KEYS, "chunk").distinct().hint("merge").join(trees.select(*_KEYS, "tree"), _KEYS)
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("rid", "long"), ("query_id", "long"), ("v", "array<double>"), ("scores", "array<long>"), ("ids", "array<long>"))]
    both = rows.unionAll(needed.select(*_KEYS, "chunk", *none, "tree"))

    def visit(group: pa.Table) -> pa.Table:
        is_tree = group.column("rid").is_null().to_numpy(zero_copy_only=False)
        tree = pickle.loads(group.column("tree").filter(pa.array(is_tree))[0].as_py())
        asks = group.filter(pa.array(~is_tree))
        rids, names = asks.column("rid").to_numpy(), asks.column("query_id").to_numpy()
        scores, ids = (asks.column(k).combine_chunks().flatten().to_numpy().reshape(len(rids), top).copy() for k in ("scores", "ids"))
        mine, _ = search(tree, _matrix(asks.column("v")), rids, scores, ids)
        at = np.nonzero(mine)[0]
        return pa.Table.from_arrays([pa.array(rids[at]), pa.array(names[at]), pa.array(scores[mine]), pa.array(ids[mine])], names=["rid", "query_id", "score", "vec_id"])

    return both.groupBy(*_KEYS, "chunk").applyInArrow(visit, "rid long, query_id long, score long, vec_id long")


def highest(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``top`` highest inner products of each row whose id ``every`` divides.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; vectors of
    different lengths have no product. Equal scores go to the smaller vec_id. A row is never its own neighbour, but another
    row with the same id is. A product beyond 64 bits counts as the last number in them. Other columns are ignored; an empty
    table gives an empty result.
    """
    trees, queries = shards(vectors, every, top)
    chunks, blocks = max(1, -(-queries.count() // CHUNK)), max(1, -(-trees.count() // BLOCK))
    asks = stored(reached(trees, queries, chunks, blocks), "topk-reached")
    home = queries.select("rid", "query_id", F.explode(F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("vec_id"))).alias("x")).select("rid", "query_id", "x.score", "x.vec_id")
    every_ = home.where(F.col("score") > F.lit(int(_NONE))).unionAll(visited(asks, trees, queries, top))
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return every_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.r <> c.r and len(q.v) = len(c.v) where q.vec_id % {EVERY} = 0),
k as (select *, row_number() over (partition by r order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from k where rank <= {TOP}
"""

"""Near duplicates among vectors by cross-polytope hashing.

Equal vectors of a label, by 128 bits of hash, are one representative; the vectors themselves are shuffled only for that. Each of TABLES tables hashes a representative by HASHES random
rotations (sign flips and fast Hadamard transforms, three times over): a rotated vector goes to its nearest signed
axis. The PROBES next-nearest combinations are visited as well. Buckets are first filled with ids alone; only where two
meet do vectors follow, to be compared exactly, in tiles, in double precision. A pair that meets more than once is
counted where it meets first, and only links that join two trees leave a tile, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import apart, cut, mapped
from tessella.llm.components import components

THRESHOLD = 0.98
TABLES, HASHES, PROBES = 5, 3, 3
SEED = 20
#: Vectors in a tile, and in the blocks that one matrix product takes.
TILE, BLOCK = 1024, 512


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of sign flips and a fast Hadamard transform along the last axis, whose length is a power of two."""
    for s in signs:
        x = x * s
        h = 1
        while h < x.shape[1]:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
            h *= 2
        x = x / np.sqrt(x.shape[1])
    return x


def buckets(x: np.ndarray) -> np.ndarray:
    """Bucket numbers, rows x TABLES x (1 + PROBES), the vector's own first; -1 where no further probe exists."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = _unit(x)
    out = np.full((len(x), TABLES, 1 + PROBES), -1, dtype=np.int64)
    rng = np.random.default_rng([SEED, width])
    rows = np.arange(len(x))
    for t in range(TABLES):
        best, value = [], []
        for _ in range(HASHES):
            y = rotate(padded, rng.integers(0, 2, (3, width)) * 2.0 - 1.0)
            both = np.concatenate([y, -y], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, : 1 + PROBES]
            best.append(top)
            value.append(np.take_along_axis(both, top, axis=1))
        own = [b[:, 0] for b in best]
        out[:, t, 0] = sum(b * (2 * width) ** k for k, b in enumerate(own))
        # one hash moves to its r-th axis, the others stay: the cheapest such moves come first
        cost = np.stack([v[:, [0]] - v[:, 1:] for v in value], axis=1).reshape(len(x), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        for p in range(order.shape[1]):
            k, r = order[:, p] // (best[0].shape[1] - 1), order[:, p] % (best[0].shape[1] - 1) + 1
            moved = np.stack(best, axis=0)[k, rows, r]
            out[:, t, 1 + p] = out[:, t, 0] + (moved - np.stack(own, axis=0)[k, rows]) * (2 * width) ** k
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first_meeting(table: int, bucket: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs with bucket numbers a and b (pairs x TABLES x (1 + PROBES)) meet in this bucket and no earlier one.

    They meet wherever both have been put, be it their own bucket or one that they probe; the first place is the least
    bucket of the first table in which they meet.
    """
    common = ((a[:, : table + 1, :, None] == b[:, : table + 1, None, :]) & (a[:, : table + 1, :, None] >= 0)).any(axis=3)
    earlier = common[:, :table].any(axis=(1, 2))
    first = np.where(common[:, table], a[:, table], np.iinfo(np.int64).max).min(axis=1)
    return ~earlier & (first == bucket)


def tile_pairs(table: int, bucket: int, between: bool, own: np.ndarray, x: np.ndarray, marks: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Linked copies of each vector of a tile (between: only pairs across its two halves), and a forest of the links."""
    n, linked, label, forest = len(x), np.zeros(len(x), dtype=np.int64), np.arange(len(x)), []
    unit = _unit(x)
    for i in range(0, n, BLOCK):
        for j in range(i, n, BLOCK):
            near = unit[i : i + BLOCK] @ unit[j : j + BLOCK].T >= THRESHOLD
            p, q = np.nonzero(near)
            p, q = p + i, q + j
            ok = (p < q) & ((own[p] != own[q]) if between else True)
            p, q = p[ok], q[ok]
            for s in range(0, len(p), 1 << 15):
                a, b = p[s : s + (1 << 15)], q[s : s + (1 << 15)]
                here = _first_meeting(table, bucket, marks[a], marks[b])
                np.add.at(linked, a[here], copies[b[here]])
                np.add.at(linked, b[here], copies[a[here]])
            open_ = label[p] != label[q]
            while open_.any():
                p, q = p[open_], q[open_]
                forest.append((int(p[0]), int(q[0])))
                label[label == label[q[0]]] = label[p[0]]
                open_ = label[p] != label[q]
    return linked, forest


def representatives(vectors: DataFrame) -> DataFrame:
    """``rid``, ``label``, ``h1``, ``h2`` (128 bits of hash of the vector), ``embedding``, ``first``, ``copies``: the distinct usable vectors of each label."""
    distinct = vectors.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    return cut(distinct.withColumn("rid", F.monotonically_increasing_id()))


def candidate_links(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rid``, ``linked`` (copies of other representatives linked with it) and ``a``, ``b`` (links enough to connect)."""
    width = 1 + PROBES

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            marks = np.zeros((len(sizes), TABLES, width), dtype=np.int64)
            for size in np.unique(sizes):
                rows = np.nonzero(sizes == size)[0]
                marks[rows] = buckets(flat[starts[rows][:, None] + np.arange(size)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(marks.reshape(len(sizes), -1)), pa.list_(pa.int64()))], names=["rid", "marks"]
            )

    marks = cut(mapped(reps.select("rid", "embedding"), hashed, "rid long, marks array<long>"))
    short = reps.select("rid", "label", F.size("embedding").alias("size")).join(marks, "rid")
    spread = short.select("rid", "label", "size", F.posexplode("marks").alias("at", "bucket")).where("bucket >= 0")
    spread = cut(spread.withColumn("t", F.floor(F.col("at") / width).cast("int")).drop("at"))
    key = ["label", "size", "t", "bucket"]
    cells = spread.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    dealt = spread.join(apart(cells), key).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.join(marks.join(reps.select("rid", "copies", "embedding"), "rid"), "rid")
    groups = dealt.groupBy(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.struct("rid", "own", "copies", "marks", "embedding")).alias("members")
    )
    groups = groups.where("size(members) > 1").select("t", "bucket", (F.col("i") != F.col("j")).alias("between"), "members")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int | None, int]] = []
            for t, bucket, between, members in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                m = members.values
                rid, own, copies = (m.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                marks_ = m.field(3).flatten().to_numpy(zero_copy_only=False).reshape(len(rid), TABLES, width)
                x = m.field(4).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rid), -1)
                linked, forest = tile_pairs(t, bucket, between, own, x, marks_, copies)
                found += [(int(rid[k]), None, int(linked[k])) for k in np.nonzero(linked)[0]]
                found += [(int(rid[a]), int(rid[b]), 0) for a, b in forest]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["a", "b", "linked"])

    out = cut(mapped(groups, compared, "a long, b long, linked long"))
    counts = out.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("linked").alias("linked"))
    return counts, out.where("b is not null").select("a", "b")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row.

    Vectors are compared when labels and lengths are equal and the cosine is at least THRESHOLD. Null, empty and zero
    vectors, those with a null or non-finite component and those without a label link with nothing and are kept. Rows
    that repeat are links of one another; a null id is never kept and never names a component. Empty in, empty out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    short = F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(SEED), F.col("embedding")).alias("h2")
    good = rows.where(usable).select("vec_id", "label", "embedding", *short)
    reps = representatives(good)
    counts, links = candidate_links(reps)
    roots = components(links)
    classes = reps.join(counts, "rid", "left").join(roots, F.col("rid") == F.col("node"), "left")
    classes = classes.select("label", "h1", "h2", "first", "copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "rid").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(apart(smallest), "root").select("label", "h1", "h2", (F.col("linked") + F.col("copies") - 1).alias("n_links"), "component_id")
    found = good.select("vec_id", "label", "h1", "h2").join(named, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: Exact links in SQL; the same rows as long as hashing finds every link.
ORACLE = f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
u as (select * from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r as (select vec_id as id, vec_id as root from v union select l.b, r.root from r join l on r.id = l.a),
c as (select id, min(root) as root from r group by id), n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n, 0) as n_links, root as component_id, vec_id = root as kept from v join c on id = vec_id left join n on a = vec_id
"""

"""Best-fit packing of documents into training sequences, with conflicts.

Bins are kept in order of their room. A document, longest first, goes to the bin with the least room that holds it; if
that bin's bitmaps show a document of the same duplicate cluster, or as many of the same source as a bin may take, the
search goes on to the next larger room until a compatible bin is found, else a bin is opened. Documents are dealt by
hash into shards of bounded size that are packed independently: the tightest bin is that of the shard. How many documents
of a source a bin may take follows the source's share, so that a corpus of one source still fills its bins.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, mapped, sliced, text_bytes

#: Words of a bin, documents of one source that every bin may take, documents of a shard on average.
CAPACITY, PER_SOURCE, SHARD_DOCS = 4096, 4, 4096
BINS = "bin_id long, doc_ids array<long>, starts array<long>, lengths array<long>, n_words long"


def pack_shard(items: list[tuple[int | None, int, str | None, int | None]], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[list[tuple[int | None, int, int]]]:
    """Bins as lists of (doc_id, start, length) from (doc_id, words, source, cluster).

    Whole multiples of the capacity fill bins of their own; what remains of a document is packed. A bin takes ``per_source``
    documents of a source, or twice what an even mix of the shard would put there if that is more. A document without a
    source or cluster conflicts with none in that respect; one without words isn't packed.
    """
    bins: list[list[tuple[int | None, int, int]]] = []
    rest = []
    for doc, n, source, cluster in items:
        full = n // capacity
        bins += [[(doc, k * capacity, capacity)] for k in range(full)]
        if n % capacity:
            rest.append((n % capacity, full * capacity, doc, source, cluster))
    rest.sort(key=lambda x: (-x[0], x[2] is None, x[2] or 0, x[1]))
    held_by = Counter(source for _, _, _, source, _ in rest if source is not None)
    mean = sum(n for n, *_ in rest) / max(1, len(rest))
    limits = {s: max(per_source, math.ceil(2 * k / len(rest) * capacity / mean)) for s, k in held_by.items()}
    first = 0
    sources: dict[str, tuple[int, int]] = {}
    for s, limit in limits.items():  # a source's bits in a bin's bitmap: its first, and all of them
        sources[s], first = (first, (1 << limit) - 1), first + limit
    clusters: dict[int, int] = {}
    of_sources: dict[int, int] = {}
    of_clusters: dict[int, int] = {}
    room: list[tuple[int, int]] = []
    for n, start, doc, source, cluster in rest:
        at, every = sources[source] if source is not None else (-1, 0)
        bit = 1 << clusters.setdefault(cluster, len(clusters)) if cluster is not None else 0
        i = bisect_left(room, (n, -1))
        while i < len(room):
            b = room[i][1]
            if not of_clusters[b] & bit and (at < 0 or (of_sources[b] >> at) & every != every):
                break
            i += 1
        if i < len(room):
            left, b = room.pop(i)
            bins[b].append((doc, start, n))
        else:
            left, b = capacity, len(bins)
            bins.append([(doc, start, n)])
            of_sources[b] = of_clusters[b] = 0
        if at >= 0:
            held = (of_sources[b] >> at) & every
            of_sources[b] |= (held + 1) << at  # held is 0, 1, 3, 7 and so on: the next bit
        of_clusters[b] |= bit
        insort(room, (left - n, b))
    return bins


def sized(docs: DataFrame, cluster_col: str | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``n`` (words) and ``cluster`` of every row: the given column's value, else a hash of the lower-cased words, so that exact copies share it."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    given = F.col(cluster_col).cast("long") if cluster_col else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words = [t.split() for t in text_bytes(batch.column(3))]
            hashes = pa.array([xxhash.xxh64_intdigest(b" ".join(w).lower()) - (1 << 63) for w in words], pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pc.coalesce(batch.column(2), hashes)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "n", "cluster"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), given.alias("given"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, source string, n long, cluster long")


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_docs: int = SHARD_DOCS, cluster_col: str | None = None) -> DataFrame:
    """One row for each bin: ``bin_id``, and in the order of the bin ``doc_ids``, ``starts`` (first word), ``lengths``; ``n_words`` together.

    cluster_col: a column of duplicate clusters, such as a component_id; without one, exact copies are a cluster. Texts
    stay where they are: only lengths are shuffled. Documents that are null or have no words are returned each in a row
    whose bin_id is null. Rows that repeat are documents of one cluster, never in one bin, and dealt apart like any
    others. Null ids are packed like others. An empty table gives no rows.
    """
    lengths = cut(sized(docs, cluster_col))
    shards = max(1, -(-lengths.count() // shard_docs))
    # the checkpoint fixes each row's place, so a task that runs again deals its rows as before
    spread = F.pmod(F.xxhash64("doc_id", "cluster", F.monotonically_increasing_id()), F.lit(shards))

    def run(part: pa.Table) -> pa.Table:
        shard = part.column("shard")[0].as_py()
        items = list(zip(*(part.column(c).to_pylist() for c in ("doc_id", "n", "source", "cluster")), strict=True))
        bins = pack_shard(items, capacity, per_source)
        rows = [(shard << 32 | i, [d for d, _, _ in b], [a for _, a, _ in b], [k for _, _, k in b], sum(k for _, _, k in b)) for i, b in enumerate(bins)]
        rows += [(None, [d], [0], [0], 0) for d, n, _, _ in items if not n]
        kinds = (pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int64())
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bin_id", "doc_ids", "starts", "lengths", "n_words"])

    return lengths.withColumn("shard", spread).groupBy("shard").applyInArrow(run, BINS)

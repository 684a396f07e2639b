"""Near duplicates by 64-bit SimHash, compared exactly in tiles.

A fingerprint bit is the majority of that bit over the XXH64 values of a text's 3-word shingles. Fingerprints that
differ in at most three bits agree on at least one of their four 16-bit blocks, so tiles are cut inside groups that
share a block; no other pair can link. A group's fingerprints lie in its tiles by their population counts, and two tiles
are paired only as far as their counts are within the radius of each other: other pairs of tiles are never shipped. Within
and between tiles numpy compares every pair by exclusive-or and bit counts, and passes over blocks of a tile in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import apart, byte_words, cut, mapped, sliced, text_bytes, without_ids
from tessella.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints in one tile, and in the blocks of a tile that are passed over together.
TILE, BLOCK = 2048, 256


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of one text as an unsigned 64-bit number; zero without words."""
    words = byte_words(text.lower())
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    array = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(array), 1 << 16):
        ones += np.unpackbits(array[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(array)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's bits as a signed long) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(t) for t in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, fp long")


def _forest(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Of the links between positions, those that join trees not yet joined; label is brought up to date."""
    out = []
    differ = label[left] != label[right]
    while differ.any():
        left, right = left[differ], right[differ]
        a, b = label[left[0]], label[right[0]]
        out.append((int(left[0]), int(right[0])))
        label[label == b] = a
        differ = label[left] != label[right]
    return out


def tile_links(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among one tile's (or tile pair's) fingerprints, as pairs of values."""
    values = np.unique(values)
    counts = np.bitwise_count(values).astype(np.int16)
    order = np.argsort(counts, kind="stable")
    values, counts = values[order], counts[order]
    label = np.arange(len(values))
    found: list[tuple[int, int]] = []
    for i in range(0, len(values), BLOCK):
        a = values[i : i + BLOCK]
        for j in range(i, len(values), BLOCK):
            if counts[j] - counts[min(i + BLOCK, len(values)) - 1] > radius:
                break
            near = np.bitwise_count(a[:, None] ^ values[None, j : j + BLOCK]) <= radius
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            keep = x < y
            found += _forest(len(values), x[keep], y[keep], label)
    return [(int(values[x]), int(values[y])) for x, y in found]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: links enough to connect all fingerprints (column ``fp``, distinct) within the radius.

    A group that shares a block value is laid out by population count and cut into tiles of TILE places. A fingerprint goes
    to its own tile and to those where counts within the radius of its own lie; what has no other fingerprint there goes
    nowhere. Each pair of tiles is a group of its own, so no task gathers more than two tiles.
    """
    if radius != RADIUS:
        raise ValueError("four blocks are exact for a radius of 3")
    rows = distinct.select(
        "fp", F.bit_count("fp").alias("ones"), F.posexplode(F.array(*[F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in range(4)])).alias("band", "value")
    )
    group = Window.partitionBy("band", "value").orderBy("ones")
    cells = rows.groupBy("band", "value", "ones").agg(F.count("*").alias("n"))  # at most 65 rows in a group
    cells = cells.withColumn("end", F.sum("n").over(group)).withColumn("start", F.col("end") - F.col("n"))
    cells = cells.withColumn("low", F.min("start").over(group.rangeBetween(-radius, 0))).withColumn("high", F.max("end").over(group.rangeBetween(0, radius)))
    cells = cells.where("high - low > 1").select("band", "value", "ones", "n", "start", "low", "high")
    dealt = rows.join(apart(cells), ["band", "value", "ones"])
    tile = lambda place: F.floor(place / TILE).cast("int")
    own = tile(F.col("start") + F.pmod(F.xxhash64("fp", "band"), F.col("n")))
    dealt = dealt.select("fp", "band", "value", own.alias("own"), F.explode(F.sequence(tile(F.col("low")), tile(F.col("high") - 1))).alias("other"))
    groups = dealt.groupBy("band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    groups = groups.agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            lists = batch.column(0)
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = lists.offsets.to_numpy()
            small = np.diff(offsets) == 2
            a, b = flat[offsets[:-1][small]], flat[offsets[:-1][small] + 1]
            near = np.bitwise_count(a ^ b) <= radius
            found += zip(a[near].tolist(), b[near].tolist(), strict=True)
            for k in np.nonzero(~small)[0]:
                found += tile_links(flat[offsets[k] : offsets[k + 1]], radius)
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return mapped(groups, run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id reachable) of every row.

    Null or empty texts have fingerprint zero and link with one another. Rows that repeat a doc_id are returned each;
    a row whose doc_id is null takes part in links but never names a component. Other columns are ignored. An empty
    table gives an empty result.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(fingerprint_links(distinct))
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(classes.join(apart(smallest), "root").select("fp", "component_id"))
    out = prints.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents (all their columns) but those whose component has a smaller id.

    Rows that repeat a kept doc_id stay, and so do rows without a doc_id, as they can't be told from one another by it.
    """
    return without_ids(docs, simhash_components(docs).where("doc_id <> component_id"))

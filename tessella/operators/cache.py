"""Upkeep of cached page vectors: what can be kept, what must be embedded anew, what has no page any more."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import canonical_hash

# Fixed values.
CONTRACT = ["backend", "dimensions", "input_version", "max_page_chars", "model", "normalize_embeddings", "query_prompt_name", "schema_version"]
DEFAULTS = {"top_k_pages": 5, "dimensions": 1024, "max_page_chars": 6000, "max_query_chars": 4000, "max_excerpt_chars": 800, "batch_size": 8}


def contract_hash(config: dict[str, object]) -> Column:
    """One hash over the settings that a vector depends on; a vector made under another is stale."""
    return canonical_hash(*(F.lit(config.get(k)).alias(k) for k in CONTRACT))


def diff(pages: DataFrame, cached: DataFrame) -> DataFrame:
    """``path``, ``state``, ``refresh``, ``n_chars`` of every page and every cached vector, by one full outer join.

    pages: ``path``, ``input_sha256``, ``content_sha256``, ``contract``, ``n_chars``; cached: ``path``, ``input_sha256``, ``content_sha256``,
    ``contract``, ``ok`` (its length fits). state: hit, miss (no vector), stale (a vector for other input), pruned (no page). refresh:
    a hit whose page changed in ways the vector doesn't depend on, so that only its record is brought up to date.
    """
    old = cached.select(*(F.col(c).alias(f"c_{c}") for c in ("path", "input_sha256", "content_sha256", "contract", "ok")))
    rows = pages.join(old, F.col("path") == F.col("c_path"), "full_outer")
    fits = F.col("ok_") & (F.col("input_sha256") == F.col("c_input_sha256")) & (F.col("contract") == F.col("c_contract"))
    state = F.when(F.col("path").isNull(), "pruned").when(F.col("c_path").isNull(), "miss").when(fits, "hit").otherwise("stale")
    rows = rows.withColumn("ok_", F.coalesce("c_ok", F.lit(False))).withColumn("state", state)
    refresh = (F.col("state") == "hit") & ~F.col("content_sha256").eqNullSafe(F.col("c_content_sha256"))
    return rows.select(F.coalesce("path", "c_path").alias("path"), "state", refresh.alias("refresh"), "n_chars")


def metrics(found: DataFrame) -> DataFrame:
    """One row of counts over a diff."""
    count = lambda s: F.count_if(F.col("state") == s)
    return found.agg(
        F.count_if(F.col("state") != "pruned").alias("page_count"), count("hit").alias("cache_hit"), count("miss").alias("cache_miss"),
        count("stale").alias("cache_stale"), (count("miss") + count("stale")).alias("cache_refreshed"), count("pruned").alias("cache_pruned"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("text_char_count"),
    )


def embedded(cards: DataFrame, encoder: Callable[[], Callable[[list[str]], Iterable[Iterable[float]]]], dimensions: int, batch: int = DEFAULTS["batch_size"]) -> DataFrame:
    """``path``, ``vector`` of cards (``path``, ``card``): cut to the dimensions, normalised, 8 decimals.

    encoder makes the model, once in each Python worker; nothing stands in for a missing one.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or encoder()
            vectors = []
            for i in range(0, len(frame), batch):
                for row in model(frame["card"].iloc[i : i + batch].tolist()):
                    v = [float(x) for x in row][:dimensions]
                    if len(v) < dimensions:
                        raise ValueError(f"the encoder gives {len(v)} dimensions of {dimensions}")
                    norm = sum(x * x for x in v) ** 0.5
                    vectors.append([round(x / norm, 8) if norm else 0.0 for x in v])
            yield pd.DataFrame({"path": frame["path"], "vector": vectors})

    return cards.select("path", "card").mapInPandas(run, "path string, vector array<double>")


def sentence_encoder(name: str) -> Callable[[], Callable[[list[str]], Iterable[Iterable[float]]]]:
    """An encoder by a local sentence-transformers model, loaded once in each worker; the library is optional."""

    def make() -> Callable[[list[str]], Iterable[Iterable[float]]]:
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(name).encode

    return make


def synced(pages: DataFrame, cached: DataFrame, encoder: Callable, dimensions: int) -> DataFrame:
    """The cache as it must be: kept vectors and new ones for what missed or is stale; vectors without a page go.

    pages as in diff, with ``card``; cached with ``vector``. Only what changed is embedded.
    """
    found = diff(pages, cached)
    kept = cached.join(found.where("state = 'hit'").select("path"), "path", "left_semi").select("path", "vector")
    todo = pages.join(found.where("state in ('miss', 'stale')").select("path"), "path", "left_semi")
    vectors = kept.unionByName(embedded(todo, encoder, dimensions))
    return pages.select("path", "input_sha256", "content_sha256", "contract").join(vectors, "path")

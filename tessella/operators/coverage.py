"""How well claims and digest items are covered: shares weighted by importance, and what fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import coverage_score, percent, strip

# Fixed values.
STATUSES = ["covered", "partial", "missing", "contradicted"]
CORE = 4
LEAST_RAW, LEAST_CORE, LEAST_CONCEPT = 85.0, 95.0, 95.0


def _weighted(status: Column, importance: Column) -> dict[str, Column]:
    score, core = coverage_score(status), importance >= CORE
    return {
        "weight": F.sum(importance),
        "score": F.sum(score * importance),
        "core_weight": F.sum(F.when(core, importance).otherwise(0)),
        "core_score": F.sum(F.when(core, score * importance).otherwise(0.0)),
    }


def judged(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claims with their result; of several results the last counts, a claim without one is missing.

    claims: ``operation_id``, ``claim_id``, ``importance``, ``concept_terms``; results: ``operation_id``, ``claim_id``, ``pos``, ``status``.
    """
    last = results.groupBy("operation_id", "claim_id").agg(F.max_by("status", "pos").alias("status"))
    return claims.join(last, ["operation_id", "claim_id"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def claim_report(rows: DataFrame) -> DataFrame:
    """One row for each operation: counts by status and the three percentages, from judged claims.

    A concept counts once, with its best claim; two levels of aggregation, so that no list of terms is gathered.
    """
    base = rows.groupBy("operation_id").agg(
        F.count("*").alias("claim_count"),
        *(F.count_if(F.col("status") == s).alias(f"{s}_claim_count") for s in STATUSES),
        F.count_if(F.col("importance") >= CORE).alias("core_claim_count"),
        F.count_if((F.col("importance") >= CORE) & F.col("status").isin("missing", "contradicted")).alias("core_missing_claim_count"),
        *(v.alias(f"_{k}") for k, v in _weighted(F.col("status"), F.col("importance")).items()),
    )
    terms = rows.select("operation_id", coverage_score(F.col("status")).alias("s"), F.explode("concept_terms").alias("t"))
    terms = terms.select("operation_id", "s", strip(F.col("t")).alias("t")).where("t <> ''")
    concepts = terms.groupBy("operation_id", "t").agg(F.max("s").alias("s")).groupBy("operation_id").agg(F.sum("s").alias("_cs"), F.count("*").alias("_cn"))
    return base.join(concepts, "operation_id", "left").select(
        *(c for c in base.columns if not c.startswith("_")),
        percent(F.col("_score"), F.col("_weight")).alias("raw_claim_coverage_percent"),
        percent(F.col("_core_score"), F.col("_core_weight")).alias("core_claim_coverage_percent"),
        percent(F.col("_cs"), F.col("_cn")).alias("concept_coverage_percent"),
    )


def digest_report(items: DataFrame) -> DataFrame:
    """One row for each operation from digest items; a core item counts as missing if missing or partial."""
    base = items.groupBy("operation_id").agg(
        F.count("*").alias("item_count"),
        *(F.count_if(F.col("status") == s).alias(f"{s}_item_count") for s in STATUSES[:3]),
        F.count_if((F.col("importance") >= CORE) & F.col("status").isin("missing", "partial")).alias("core_missing_item_count"),
        *(v.alias(f"_{k}") for k, v in _weighted(F.col("status"), F.col("importance")).items()),
    )
    return base.select(
        *(c for c in base.columns if not c.startswith("_")),
        percent(F.col("_score"), F.col("_weight")).alias("coverage_percent"),
        percent(F.col("_core_score"), F.col("_core_weight")).alias("core_coverage_percent"),
    )


def failures(report: DataFrame) -> DataFrame:
    """``operation_id``, ``failure`` of a claim report, in the order in which they are told."""
    rules = F.array(
        F.when(F.col("partial_claim_count") > 0, "partial_claims"),
        F.when(F.col("missing_claim_count") > 0, "missing_claims"),
        F.when(F.col("raw_claim_coverage_percent") < LEAST_RAW, "raw_coverage"),
        F.when(F.col("core_claim_coverage_percent") < LEAST_CORE, "core_coverage"),
        F.when(F.col("concept_coverage_percent") < LEAST_CONCEPT, "concept_coverage"),
        F.when(F.col("core_missing_claim_count") > 0, "core_missing"),
        F.when(F.col("contradicted_claim_count") > 0, "contradicted_claims"),
    )
    return report.select("operation_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("failure"))


def incomplete_digests(report: DataFrame) -> DataFrame:
    """Digests that may not pass: anything missing or partial, or not wholly covered."""
    return report.where((F.col("missing_item_count") > 0) | (F.col("partial_item_count") > 0) | (F.col("coverage_percent") < 100))

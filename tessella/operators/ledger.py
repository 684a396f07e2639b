"""Operations, their steps, receipts, and whether their artifacts are still what was recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
STEPS = [
    "raw_binding", "source_digest", "digest_coverage_judge", "candidate_pages_warmup", "candidate_pages", "wiki_snapshot", "candidate_contexts",
    "merge_plan", "composition_plan", "page_update_plan", "final_pages", "final_coverage_judge", "related_refresh", "validation", "knowledge_write",
    "page_state_write", "source_record_write", "embedding_cache_refresh", "related_maintenance", "index_log_write", "receipt",
]


def raw_candidates(raws: DataFrame, receipts: DataFrame, include_processed: bool = False, limit: int | None = None) -> DataFrame:
    """``raws`` (``raw_path`` and more) with ``processed``, by path; those in the receipts (``raw_path``) left out unless asked for."""
    done = receipts.select("raw_path").where("raw_path is not null").distinct()
    if include_processed:
        rows = raws.join(done.withColumn("processed", F.lit(True)), "raw_path", "left").withColumn("processed", F.coalesce("processed", F.lit(False)))
    else:
        rows = raws.join(done, "raw_path", "left_anti").withColumn("processed", F.lit(False))
    rows = rows.orderBy("raw_path")
    return rows if limit is None else rows.limit(limit)


def artifact_drift(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """``operation_id``, ``code``, ``path``: recorded artifacts that are missing or changed. Both: ``operation_id``, ``path``, ``sha256``, ``size_bytes``."""
    now = files.select("operation_id", "path", F.col("sha256").alias("now"), F.col("size_bytes").alias("now_size"))
    rows = artifacts.join(now, ["operation_id", "path"], "left")
    code = F.when(F.col("now").isNull(), "artifact_missing").when((F.col("now") != F.col("sha256")) | (F.col("now_size") != F.col("size_bytes")), "artifact_hash_drift")
    return rows.select("operation_id", code.alias("code"), "path").where("code is not null")


def raw_drift(bindings: DataFrame, raws: DataFrame) -> DataFrame:
    """Raw files that changed since they were bound; those that are gone aren't told."""
    now = raws.select("raw_path", F.col("raw_sha256").alias("now"))
    rows = bindings.join(now, "raw_path").where("now <> raw_sha256")
    return rows.select("operation_id", F.lit("raw_hash_drift").alias("code"), F.col("raw_path").alias("path"))


def verify(bindings: DataFrame, raws: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    return raw_drift(bindings, raws).unionByName(artifact_drift(artifacts, files))


def operation_status(events: DataFrame) -> DataFrame:
    """``operation_id``, ``status``, ``step``, ``n_events``: what the last event (``operation_id``, ``pos``, ``step``, ``status``) of each says."""
    last = events.groupBy("operation_id").agg(F.max_by(F.struct("status", "step"), "pos").alias("l"), F.count("*").alias("n_events"))
    return last.select("operation_id", "l.status", "l.step", "n_events")


def latest(operations: DataFrame) -> DataFrame:
    """The operation with the greatest id; ids begin with their time."""
    return operations.join(F.broadcast(operations.agg(F.max("operation_id").alias("operation_id"))), "operation_id", "left_semi")


def receipts(steps: DataFrame, written: DataFrame) -> DataFrame:
    """One receipt for each operation: calls, repairs, what was written, and the status that follows.

    steps: ``operation_id``, ``model_calls``, ``repair_count``, ``failed``; written: ``operation_id``, ``kind``, ``target_path``, ``content_sha256``.
    """
    sums = steps.groupBy("operation_id").agg(F.sum("model_calls").alias("model_call_count"), F.sum("repair_count").alias("repair_count"), F.max("failed").alias("failed"))
    items = F.array_sort(F.collect_list(F.struct("kind", "target_path", "content_sha256")))
    sets = written.groupBy("operation_id").agg(
        F.sha2(F.to_json(items), 256).alias("write_set_sha256"), F.count_if(F.col("kind") == "knowledge").alias("n_knowledge"), F.count("*").alias("n_written")
    )
    rows = sums.join(sets, "operation_id", "left")
    status = F.when(F.col("failed"), "failed").when(F.coalesce("n_knowledge", F.lit(0)) > 0, "written").otherwise("source_recorded")
    return rows.select("operation_id", status.alias("status"), "model_call_count", "repair_count", F.coalesce("n_written", F.lit(0)).alias("n_written"), "write_set_sha256")


def new_receipts(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Receipts to append; one that exists already is an error, as receipts never change."""
    old = existing.select("operation_id", F.lit(True).alias("_old"))
    rows = found.join(old, "operation_id", "left")
    told = F.when(F.col("_old"), F.raise_error(F.concat(F.lit("receipt exists: "), F.col("operation_id")))).otherwise(F.col("operation_id"))
    return rows.withColumn("operation_id", told).drop("_old")

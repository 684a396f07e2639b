"""State of pages over time: an append-only ledger of nodes and claims, and logs whose rows are replaced by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import coverage_policy, heading_key, headings, state_id
from tessella.operators.plans import best_anchor

NODE = ["page_path", "node_id", "title", "kind", "section_hint", "parent_node_id", "source_content_unit_ids", "claim_ids", "status"]
CLAIM = ["page_path", "state_claim_id", "source_claim_id", "text", "importance", "node_id", "source_content_unit_id", "source_operation_id", "status", "coverage_policy", "current_anchor"]


def loaded(states: DataFrame, page_paths: DataFrame, schema: str) -> DataFrame:
    """``page_path``, ``state`` of the wanted pages from JSON (``page_path``, ``json``): null where there is none, an error where it is broken."""
    parsed = states.select("page_path", F.from_json("json", schema, {"mode": "FAILFAST"}).alias("state"))
    return page_paths.select("page_path").distinct().join(parsed, "page_path", "left")


def updated_nodes(units: DataFrame, claims: DataFrame, previous: DataFrame) -> DataFrame:
    """Previous nodes and the new ones of an operation's units (``operation_id``, ``page_path``, ``content_unit_id``, ``title``, ``content_role``,
    ``section_hint``, ``anchor_unit_id``, ``claim_ids``). claims: ``operation_id``, ``page_path``, ``claim_id``.

    A unit's parent is its anchor's node; where that node is neither old nor new, a previous node of the same title, else none.
    """
    ids = units.withColumn("node_id", state_id(F.col("operation_id"), F.col("content_unit_id")))
    wanted = F.when(F.col("anchor_unit_id") != F.col("content_unit_id"), state_id(F.col("operation_id"), F.col("anchor_unit_id")))
    ids = ids.withColumn("wanted", wanted)
    known = previous.select("page_path", F.col("node_id").alias("wanted")).unionByName(ids.select("page_path", F.col("node_id").alias("wanted"))).distinct()
    titled = previous.groupBy("page_path", heading_key(F.col("title")).alias("key")).agg(F.min("node_id").alias("titled"))
    parents = ids.join(known.withColumn("there", F.lit(True)), ["page_path", "wanted"], "left").withColumn("key", heading_key(F.col("title"))).join(titled, ["page_path", "key"], "left")
    held = units.select("operation_id", "page_path", "content_unit_id", F.posexplode("claim_ids").alias("at", "claim_id"))
    held = held.join(claims.select("operation_id", "page_path", "claim_id").distinct(), ["operation_id", "page_path", "claim_id"], "left_semi")
    lists = held.groupBy("operation_id", "page_path", "content_unit_id").agg(F.array_sort(F.collect_list(F.struct("at", "claim_id"))).alias("l"))
    rows = parents.join(lists, ["operation_id", "page_path", "content_unit_id"], "left")
    fresh = rows.join(previous.select("page_path", "node_id"), ["page_path", "node_id"], "left_anti").select(
        "page_path", "node_id", "title", F.col("content_role").alias("kind"), "section_hint",
        F.when(F.col("there"), F.col("wanted")).when(F.col("wanted").isNotNull(), F.col("titled")).alias("parent_node_id"),
        F.array("content_unit_id").alias("source_content_unit_ids"),
        F.coalesce(F.transform("l", lambda x: state_id(F.col("operation_id"), x["claim_id"])), F.array().cast("array<string>")).alias("claim_ids"),
        F.lit("活跃").alias("status"),
    )
    return previous.select(*NODE).unionByName(fresh)


def updated_claims(units: DataFrame, claims: DataFrame, pages: DataFrame, previous: DataFrame) -> DataFrame:
    """Previous claims and every use of a claim (``operation_id``, ``page_path``, ``claim_id``, ``text``, ``importance``) by a unit that isn't
    there yet. A claim that two units share is appended for each. pages: ``page_path``, ``markdown``, for the anchors."""
    uses = units.select("operation_id", "page_path", "content_unit_id", "title", "content_role", "absorption_decision", "section_hint", F.explode("claim_ids").alias("claim_id"))
    rows = uses.join(claims, ["operation_id", "page_path", "claim_id"]).withColumn("state_claim_id", state_id(F.col("operation_id"), F.col("claim_id")))
    rows = rows.join(previous.select("page_path", "state_claim_id"), ["page_path", "state_claim_id"], "left_anti")
    rows = rows.join(pages.select("page_path", headings(F.col("markdown")).alias("found")), "page_path", "left")
    fresh = rows.select(
        "page_path", "state_claim_id", F.col("claim_id").alias("source_claim_id"), "text", "importance",
        state_id(F.col("operation_id"), F.col("content_unit_id")).alias("node_id"), F.col("content_unit_id").alias("source_content_unit_id"),
        F.col("operation_id").alias("source_operation_id"), F.lit("活跃").alias("status"),
        coverage_policy(F.col("content_role"), F.col("absorption_decision"), F.col("importance")).alias("coverage_policy"),
        best_anchor(F.coalesce("found", F.array().cast("array<string>")), F.col("section_hint"), F.col("title")).alias("current_anchor"),
    )
    return previous.select(*CLAIM).unionByName(fresh)


def appended(previous: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Previous rows as they are and new rows whose key isn't among them."""
    return previous.unionByName(new.join(previous.select(key), key, "left_anti"))


def upserted(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by one aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*keys, "r.*")


def daily_log(operations: DataFrame, existing: DataFrame) -> DataFrame:
    """``log_date``, ``pos``, ``operation_id``, ``raw_path``, ``created``, ``updated``, ``noop``: an operation's row is replaced where it
    stands, a new one is put at the end of its day. existing: the same columns; operations: without ``pos``."""
    old = existing.withColumn("_new", F.lit(0))
    end = existing.groupBy("log_date").agg((F.max("pos") + 1).alias("_end"))
    fresh = operations.join(end, "log_date", "left").withColumn("pos", F.coalesce("_end", F.lit(0)).cast("long")).drop("_end").withColumn("_new", F.lit(1))
    both = old.unionByName(fresh)
    rest = ["raw_path", "created", "updated", "noop"]
    merged = both.groupBy("log_date", "operation_id").agg(F.min(F.struct("_new", "pos")).alias("p"), F.max_by(F.struct(*rest), "_new").alias("r"))
    order = Window.partitionBy("log_date").orderBy("p.pos", "p._new", "operation_id")
    return merged.select("log_date", (F.row_number().over(order) - 1).cast("long").alias("pos"), "operation_id", "r.*")

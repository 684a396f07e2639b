"""Requests of the model steps, as rows that a provider answers. The wording is this engine's own.

What depends on the data is put together on the executors; a step's rules and schema are constants. Requests of one
operation share a prefix to the byte, so that a provider can cache it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.granularity import stats

RULES = {
    "source_digest": "Split the document into claims and content units. Every unit uses at least one claim; attached units point to a trunk unit.",
    "digest_coverage_judge": "List what the document says and whether the digest covers it. Name the claims and units that do.",
    "digest_coverage_repair": "The digest leaves out what the listed items say. Give the whole digest again with that put right, and every item with the claims and units that now cover it.",
    "candidate_pages_warmup": "Read the shared prefix and answer with status ok.",
    "candidate_pages": "Write one page for the anchor unit, with all units attached to it.",
    "merge_plan": "Decide for each candidate page: create, update one of its context pages, or noop.",
    "composition_plan": "Plan for each writable target what is kept, inserted and dropped, and in which order.",
    "final_pages": "Write the target page, section by section, from its candidates. Report for each requirement the words of the new page that keep it.",
    "final_coverage_judge": "Say for each claim whether the page covers it, and where, with evidence and reason.",
    "final_page_coverage_repair": "The page leaves claims out. Write the whole page again with them, and say for each claim where it is covered, with evidence and reason.",
}


def payload(**columns: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in sorted(columns.items()))))


def request(step: str, rows: DataFrame, key: Column, user: Column, schema: str = "", prefix: Column | None = None, task: str | None = None) -> DataFrame:
    """Rows for the provider of a step; ``task`` names its rules and schema where they aren't the step's own (repairs)."""
    task = task or step
    return rows.select(
        "operation_id", F.lit(step).alias("step"), key.cast("string").alias("request_key"), F.lit(RULES[task]).alias("system_prompt"), user.alias("user_payload"),
        F.lit(task).alias("schema_name"), F.lit(schema).alias("schema"), (F.lit(None).cast("string") if prefix is None else prefix).alias("cache_prefix"),
    )


def again(asked: DataFrame, told: DataFrame) -> DataFrame:
    """Requests asked again: with the previous ``answer`` and its ``problem``. told: ``operation_id``, ``request_key``, both."""
    rows = asked.join(told.select("operation_id", "request_key", "answer", "problem"), ["operation_id", "request_key"])
    return rows.withColumn("user_payload", payload(request=F.col("user_payload"), previous_answer=F.col("answer"), problem=F.col("problem"))).select(*asked.columns)


def digest_requests(raws: DataFrame) -> DataFrame:
    """raws: ``operation_id``, ``raw_path``, ``raw_sha256``, ``text``."""
    return request("source_digest", raws, F.col("raw_path"), payload(raw_path=F.col("raw_path"), raw_sha256=F.col("raw_sha256"), raw_text=F.col("text"), granularity=stats(F.col("text"))))


def coverage_requests(raws: DataFrame, digests: DataFrame) -> DataFrame:
    """digests: ``operation_id``, ``digest`` (JSON)."""
    rows = raws.join(digests, "operation_id")
    return request("digest_coverage_judge", rows, F.col("raw_path"), payload(raw_text=F.col("text"), digest=F.col("digest")))


def digest_repair_requests(raws: DataFrame, digests: DataFrame, open_items: DataFrame) -> DataFrame:
    """open_items (``operation_id``, ``item_id``, ``importance``, ``status``): what the digest doesn't cover wholly."""
    listed = open_items.groupBy("operation_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("item_id", "importance", "status")))).alias("items"))
    user = payload(raw_path=F.col("raw_path"), raw_text=F.col("text"), digest=F.col("digest"), open_items=F.col("items"))
    return request("digest_coverage_judge", raws.join(digests, "operation_id").join(listed, "operation_id"), F.col("raw_path"), user, task="digest_coverage_repair")


def shared_prefix() -> Column:
    return payload(raw_text=F.col("text"), digest=F.col("digest"))


def page_requests(raws: DataFrame, digests: DataFrame, groups: DataFrame) -> DataFrame:
    """One request for each anchor (``operation_id``, ``anchor_unit_id``, ``members``)."""
    rows = raws.join(digests, "operation_id").join(groups, "operation_id")
    return request("candidate_pages", rows, F.col("anchor_unit_id"), payload(anchor=F.col("anchor_unit_id"), units=F.to_json("members")), prefix=shared_prefix())


def warmup_requests(raws: DataFrame, digests: DataFrame) -> DataFrame:
    return request("candidate_pages_warmup", raws.join(digests, "operation_id"), F.lit("warmup"), F.lit("{}"), prefix=shared_prefix())


def merge_requests(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Candidates (``operation_id``, ``candidate_page_id``, ``title``, ``summary``) with their context pages (``candidate_page_id``, ``rank``, ``path``, ``score``,
    ``excerpt``), without page types: those are the decision's to make."""
    context = hits.groupBy("operation_id", "candidate_page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "score", "excerpt"))).alias("context"))
    rows = candidates.join(context, ["operation_id", "candidate_page_id"], "left")
    listed = rows.groupBy("operation_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("candidate_page_id", "title", "summary", "context")))).alias("c"))
    return request("merge_plan", listed, F.lit("merge_plan"), payload(candidates=F.col("c")))


def composition_requests(decisions: DataFrame, page_types: DataFrame) -> DataFrame:
    """Writable targets, distinct and sorted, with the sections their type asks for (``page_type``, ``directory``, ``sections``)."""
    targets = decisions.where("action <> 'noop'").select("operation_id", "target_path").distinct()
    typed = targets.join(F.broadcast(page_types), F.col("target_path").startswith(F.concat(F.col("directory"), F.lit("/"))), "left")
    listed = typed.groupBy("operation_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("target_path", "page_type", "sections")))).alias("t"))
    return request("composition_plan", listed, F.lit("composition_plan"), payload(targets=F.col("t")))


def final_page_requests(items: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """One request for each item (``operation_id``, ``final_page_id``, ``target_path``, ``candidate_page_ids``, ``requirements``) with its own candidates;
    known (``operation_id``, ``paths``): pages it may link to, those of the operation and the context of its candidates."""
    wanted = items.select("operation_id", "final_page_id", F.explode("candidate_page_ids").alias("candidate_page_id"))
    bodies = wanted.join(candidates, ["operation_id", "candidate_page_id"]).groupBy("operation_id", "final_page_id")
    bodies = bodies.agg(F.to_json(F.array_sort(F.collect_list(F.struct("candidate_page_id", "title", "summary")))).alias("c"))
    rows = items.join(bodies, ["operation_id", "final_page_id"], "left").join(known, "operation_id", "left")
    return request("final_pages", rows, F.col("final_page_id"), payload(target=F.col("target_path"), candidates=F.col("c"), requirements=F.to_json("requirements"), allowed=F.to_json("paths")))


def judge_requests(pages: DataFrame, assigned: DataFrame) -> DataFrame:
    """One request for each page (``operation_id``, ``final_page_id``, ``markdown``) with the claims it is to cover (``claim_id``, ``text``)."""
    listed = assigned.groupBy("operation_id", "final_page_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("claim_id", "text")))).alias("c"))
    return request("final_coverage_judge", pages.join(listed, ["operation_id", "final_page_id"]), F.col("final_page_id"), payload(page=F.col("markdown"), claims=F.col("c")))


def page_repair_requests(pages: DataFrame, assigned: DataFrame) -> DataFrame:
    """One request for each page (``operation_id``, ``final_page_id``, ``title``, ``markdown``) with all claims it is to cover and how the judge
    found each (``claim_id``, ``text``, ``status``)."""
    listed = assigned.groupBy("operation_id", "final_page_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("claim_id", "text", "status")))).alias("c"))
    user = payload(title=F.col("title"), page=F.col("markdown"), claims=F.col("c"))
    return request("final_coverage_judge", pages.join(listed, ["operation_id", "final_page_id"]), F.col("final_page_id"), user, task="final_page_coverage_repair")

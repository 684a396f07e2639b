"""Checks, numbering, links and rendering on documents and orders, ten of which stand in for what one operation brings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import links, text, usage
from tessella.operators import coverage, ledger, plans, related, render, validate
from tessella.plans.tables import table


def _n() -> Column:
    """An order's number."""
    return F.col("n")


def _none() -> Column:
    return F.array().cast("array<string>")


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: ``n`` (a key's number), ``op`` (ten orders are an operation), ``pos`` inside it."""
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("n"), F.floor(n / 10).cast("string").alias("operation_id"), (n % 10).alias("pos"), "o_orderstatus", "o_orderpriority")


def _id(prefix: str, column: Column | None = None) -> Column:
    return F.concat(F.lit(prefix), (_n() if column is None else column).cast("string"))


def digest_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims and units with ids of their own, blank titles, blank and unknown anchors, repeated references."""
    rows = _numbers(spark, sf_dir)
    claims = rows.select("operation_id", "pos", _id("x").alias("claim_id"), F.concat(F.lit(" "), "o_orderpriority").alias("text"), F.array("o_orderstatus", F.lit(" "), "o_orderstatus").alias("concept_terms"))
    units = rows.select(
        "operation_id", "pos", _id("u").alias("content_unit_id"), F.when(_n() % 4 == 0, " ").otherwise(F.col("o_orderpriority")).alias("title"),
        F.when(_n() % 3 == 0, " ").when(_n() % 3 == 1, _id("u", _n() - _n() % 10)).otherwise("far").alias("anchor_unit_id"), F.array(_id(" x"), F.lit(" "), F.lit("none"), _id("x")).alias("claim_ids"),
    )
    new_claims, new_units = plans.normalized_digest(claims, units)
    found = new_claims.select("operation_id", "pos", "claim_id", "text", F.array_join("concept_terms", ",").alias("terms"))
    return found.join(new_units.withColumn("claim_ids", F.array_join("claim_ids", ",")), ["operation_id", "pos"])


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("o_orderstatus") == "F", "create").when(F.col("o_orderstatus") == "O", "update").otherwise("noop")
    made = F.when(_n() % 4 == 0, _id("concepts/Concept_")).when(_n() % 4 == 1, _id("other/../")).otherwise(_id("concepts/x"))
    return _numbers(spark, sf_dir).select(
        "operation_id", "pos", "n", F.when(_n() % 6 == 0, "same").otherwise(_id("d")).alias("decision_id"), _id("c").alias("candidate_page_id"), action.alias("action"),
        F.when(_n() % 9 == 0, " ").otherwise(F.concat(made, F.when(_n() % 5 == 0, "").otherwise(".md"))).alias("target_path"),
        F.when((action == "create") | (_n() % 8 == 0), F.when(_n() % 7 == 0, "unheard").otherwise("concept")).alias("page_type"),
        F.when(_n() % 12 == 0, "").otherwise("scope").alias("content_scope"), F.when(_n() % 15 == 0, 0).otherwise(1).alias("n_refs"),
    )


def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decisions(spark, sf_dir)
    types = spark.createDataFrame([("concept", "concepts", "Concept_")], "page_type string, directory string, title_prefix string")
    hits = rows.where("n % 2 = 0").select("operation_id", "candidate_page_id", F.col("target_path").alias("path"))
    found = validate.merge_plan(rows.where("n % 20 <> 0"), rows.where("n % 25 <> 0").select("operation_id", "candidate_page_id"), hits, types)
    return found.select("operation_id", "rule", "key")


def first_decision_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decisions(spark, sf_dir)
    found = validate.together(
        validate.duplicates(rows, "decision_id", "duplicate_decision", 1), validate.blank(rows, ["target_path", "content_scope"], "candidate_page_id", 2),
        validate.violations(rows.where("n_refs = 0"), "no_source_refs", "candidate_page_id", 3),
    )
    return validate.first_violation(found)


def decision_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decisions(spark, sf_dir).select(
        "operation_id", "pos", F.when(_n() % 6 == 0, " ").otherwise(F.col("decision_id")).alias("decision_id"), "candidate_page_id", "action", F.concat(F.lit(" /"), F.replace("target_path", F.lit("/"), F.lit("\\"))).alias("target_path"),
        "page_type", "content_scope", F.when(_n() % 2 == 0, F.array(F.lit("here"), F.lit(" "))).alias("locators"),
    )
    own = _numbers(spark, sf_dir).where("n % 5 <> 0").select("operation_id", _id("c").alias("candidate_page_id"), F.col("o_orderpriority").alias("title"), F.lit("摘").alias("summary"), _id("u").alias("content_unit_id"))
    out = plans.normalized_decisions(rows, own)
    return out.withColumn("locators", F.array_join("locators", "|"))


def composition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    path = _id("p", F.floor(_n() / 2))
    decisions = rows.select("operation_id", _id("d").alias("decision_id"), path.alias("target_path"), F.when(_n() % 11 == 0, "noop").otherwise("update").alias("action"))
    items = rows.where("n % 2 = 0 and n % 14 <> 0").select(
        "operation_id", path.alias("target_path"), F.array(_id("d"), F.when(_n() % 16 == 0, _id("d")).otherwise(_id("d", _n() + 1))).alias("merge_decision_ids"),
        F.array(_id("p", F.floor(_n() / 2) + 1), F.when(_n() % 18 == 0, path).otherwise(_id("p", F.floor(_n() / 2) - 1))).alias("related_paths"),
    )
    return validate.composition(items, decisions).select("operation_id", "rule", "key")


def final_target_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    pages = rows.where("n % 13 <> 0").select("operation_id", _id("p", F.floor(_n() / 2)).alias("target_path"), F.when(_n() % 17 == 0, " \n").otherwise("text").alias("markdown"), (_n() % 19).alias("n_refs"))
    return validate.final_targets(pages, rows.where("n % 7 <> 0").select("operation_id", _id("p", F.floor(_n() / 2)).alias("target_path"))).select("operation_id", "rule", "key")


def preimage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old pages with two sections of their own, or none; reports with requirements left out, made up, or anchored nowhere."""
    rows = _numbers(spark, sf_dir).withColumn("target_path", _id("p"))
    body = F.when(_n() % 4 == 0, F.concat(F.lit("plain "), "o_orderpriority")).otherwise(F.concat(F.lit("# Title\n\n## 摘要\n\na\n\n## Own "), "o_orderpriority", F.lit("\n\nb\n\n### Deep\n\nc\n")))
    old = rows.select("operation_id", "target_path", F.lit("Title").alias("title"), F.when(_n() % 3 == 0, "").otherwise("short").alias("summary"), body.alias("markdown"))
    wanted = validate.preimage_requirements(old)
    n = F.substring("target_path", 2, 20).cast("long")
    made_up = F.when((n % 7 == 0) & (F.col("requirement_id") != "OLD-BODY"), F.concat("requirement_id", F.lit("9")))
    told = F.explode(F.array_compact(F.array(F.when(n % 6 != 0, F.col("requirement_id")), made_up)))
    anchor = F.when(n % 8 == 0, "全文").when(n % 5 == 0, "Nowhere").otherwise("Own")
    reports = wanted.select("operation_id", "target_path", told.alias("requirement_id"), anchor.alias("final_anchor"))
    new = rows.select("operation_id", "target_path", F.concat(F.lit("## Own\n\n全文 "), "o_orderpriority").alias("markdown"))
    return validate.preimage_coverage(wanted, reports, new).groupBy("operation_id", "rule").agg(F.count("*").alias("n"))


def judge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir).withColumn("claim_id", _id("c", F.floor(_n() / 3)))
    status = F.when(_n() % 3 == 0, "covered").when(_n() % 3 == 1, "partial").otherwise("missing")
    results = rows.where("n % 10 <> 4").select("operation_id", "claim_id", status.alias("status"), F.when(_n() % 4 == 0, _none()).otherwise(F.array(F.lit("p"))).alias("covered_by"))
    return validate.judge_results(results, rows.where("n % 8 <> 0").select("operation_id", "claim_id")).select("operation_id", "rule", "key")


def digest_item_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    status = F.when(_n() % 3 == 0, "covered").when(_n() % 3 == 1, "partial").otherwise("missing")
    items = rows.select("operation_id", _id("i", _n() - F.when(_n() % 20 == 1, 1).otherwise(0)).alias("item_id"), status.alias("status"), F.array(_id("c")).alias("claim_refs"), F.when(_n() % 5 == 0, F.array(_id("u"))).otherwise(_none()).alias("unit_refs"))
    claims = rows.where("n % 4 = 0").select("operation_id", _id("c").alias("claim_id"))
    return validate.coverage_items(items, claims, rows.where("n % 10 <> 0").select("operation_id", _id("u").alias("content_unit_id"))).select("operation_id", "rule", "key")


def pre_write_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages about to be written with every kind of fault: targets, sections, hashes, references, pages that are there or not."""
    rows = _numbers(spark, sf_dir)
    body = F.when(_n() % 6 == 0, "## 摘要\n").when(_n() % 31 == 0, " ").otherwise("## 摘要\n\n## 核心内容\n\n## 矛盾与未解决问题\n")
    target = F.when(_n() % 15 == 0, _id("../p")).when(_n() % 14 == 0, "index.md").when(_n() % 21 == 0, "twice.md").otherwise(F.concat(_id("p"), F.lit(".md")))
    pages = rows.withColumn("markdown", body).select(
        "operation_id", target.alias("target_path"), F.when(_n() % 2 == 0, "create").otherwise("update").alias("action"), "markdown", F.when(_n() % 9 == 0, "?").otherwise(F.sha2("markdown", 256)).alias("content_sha256"),
        F.when(_n() % 5 != 0, _id("v", _n() % 3)).alias("preimage_sha256"),
        F.when(_n() % 11 == 0, F.array().cast("array<struct<raw_path:string,raw_sha256:string>>")).otherwise(F.array(F.struct(_id("r", F.floor(_n() / 10)).alias("raw_path"), F.when(_n() % 12 == 0, "z").otherwise("h").alias("raw_sha256")))).alias("source_refs"),
    )
    current = rows.where("n % 4 < 2").select(F.concat(_id("p"), F.lit(".md")).alias("target_path"), F.lit("v1").alias("current_sha256"))
    raws = rows.where("pos = 0").select("operation_id", F.concat(F.lit("r"), "operation_id").alias("raw_path"), F.lit("h").alias("bound_sha256"), F.when(_n() % 70 == 0, "changed").otherwise("h").alias("raw_sha256"))
    return validate.pre_write(pages, current, raws).groupBy("operation_id", "code").agg(F.count("*").alias("n"))


def field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties as answers whose schema has no ``k``, and blank required fields."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("operation_id"), "event_id", "props", F.when(F.col("event_id") % 10 == 0, " ").otherwise(F.col("event_type")).alias("kind"))
    found = validate.together(validate.unknown_json_keys(rows, "props", ["other"], "event_id"), validate.blank(rows, ["kind", "props"], "event_id"))
    return found.select("operation_id", "rule", "key")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second order as a page in one of four folders."""
    folder = F.concat(F.lit("f"), (_n() % 4).cast("string"), F.lit("/"))
    return _numbers(spark, sf_dir).where("n % 2 = 0").select(_n().alias("pos"), F.concat(folder, F.lit("Concept_p_"), _n().cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Page No "), _n().cast("string")).alias("title"))


def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by path, by title, by file name, and by a wrong folder, led to canonical paths or made plain text."""
    one = F.concat(F.lit("a [["), F.lit("f"), (_n() % 4).cast("string"), F.lit("/Concept_p_"), _n().cast("string"), F.lit("|shown]] b [[page no-"), (_n() + 1).cast("string"), F.lit("]] c [[concept p-"), (_n() + 2).cast("string"), F.lit("]] d [[x/Concept_p_"), _n().cast("string"), F.lit("]]"))
    documents = _numbers(spark, sf_dir).select(_n().alias("id"), one.alias("markdown"))
    return links.canonical_links(documents, _pages(spark, sf_dir))


def link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _pages(spark, sf_dir)
    n = F.col("pos")
    body = F.concat(
        F.lit("see [[Page No "), F.when(n % 6 == 0, n).otherwise(n + 2).cast("string"), F.lit("]] and [[no such]]"), F.when(n % 8 == 0, F.lit(" [[a]] [[raw/x]]")).otherwise(F.lit("")),
        F.when(n % 10 == 0, F.lit("\n\n## Related\n\n- [[a]]\n")).otherwise(F.lit("")),
    )
    return links.link_issues(known.select("path", "title", body.alias("markdown")), known).groupBy("path", "code").agg(F.count("*").alias("n"))


def related_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    refs = rows.select(F.concat(F.lit("p"), "operation_id").alias("page"), "pos", _id("p", F.floor(_n() / 10) + _n() * 7 % 5).alias("target"))
    known = rows.where("n % 30 <> 0 and pos = 0").select(F.concat(F.lit("p"), "operation_id").alias("path"))
    return related.selected(refs, known, 2)


def same_batch_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    refs = rows.select(F.concat(F.lit("p"), "operation_id").alias("page"), "pos", _id("p", F.floor(_n() / 10) + _n() * 7 % 9).alias("target"))
    return related.same_batch(refs, rows.where("n % 30 <> 0 and pos = 0").select(F.concat(F.lit("p"), "operation_id").alias("path")))


def receipt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    steps = rows.select("operation_id", (_n() % 3).alias("model_calls"), (_n() % 2).alias("repair_count"), (_n() % 40 == 7).alias("failed"))
    written = rows.where("n % 30 < 20").select("operation_id", F.when((_n() % 30 < 10) & (_n() % 5 == 0), "knowledge").otherwise("source").alias("kind"), _id("p").alias("target_path"), _id("h").alias("content_sha256"))
    return ledger.receipts(steps, written)


def raw_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    bound = rows.select("operation_id", _id("raw/").alias("raw_path"), _id("h").alias("raw_sha256"))
    now = rows.where("n % 9 <> 0").select(_id("raw/").alias("raw_path"), _id("h", _n() - F.when(_n() % 6 == 0, 1).otherwise(0)).alias("raw_sha256"))
    return ledger.raw_drift(bound, now)


def latest_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMddHHmmss").alias("operation_id"), "event_id"))


def judged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir).select("operation_id", _id("c").alias("claim_id"), (_n() % 5 + 1).alias("importance"), F.array("o_orderpriority").alias("concept_terms"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    status = F.when(F.col("flag") == "A", "covered").when(F.col("flag") == "N", "partial").otherwise("contradicted")
    results = lines.select(F.floor(F.col("l_orderkey") / 10).cast("string").alias("operation_id"), _id("c", F.col("l_orderkey")).alias("claim_id"), F.col("l_linenumber").alias("pos"), status.alias("status"))
    return coverage.judged(rows, results).select("operation_id", "claim_id", "importance", "status")


def claim_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    units = rows.where("n % 3 = 0").select(
        "operation_id", _id("u").alias("content_unit_id"), F.when(_n() % 2 == 0, "主干").otherwise("附属").alias("content_role"), F.when(_n() % 4 == 1, "降级为段落").otherwise("独立成页").alias("absorption_decision"),
        F.array(_id("c"), _id("c", _n() + 1)).alias("claim_ids"),
    )
    return plans.claim_policy(units, rows.select("operation_id", _id("c").alias("claim_id"), (_n() % 5 + 1).alias("importance")))


def repaired_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that use a failed claim, and pages with the repair that came for them."""
    rows = _numbers(spark, sf_dir)
    units = rows.select("operation_id", _id("u").alias("content_unit_id"), F.array(_id("c"), _id("c", _n() + 1)).alias("claim_ids"))
    hit = plans.touched_units(units, rows.where("n % 10 = 3").select("operation_id", _id("c").alias("claim_id"))).select("operation_id", F.col("content_unit_id").alias("final_page_id"), F.lit("old").alias("markdown"))
    repairs = rows.where("n % 3 = 0").select(_id("u").alias("final_page_id"), F.when(_n() % 2 == 0, "old").otherwise("new").alias("markdown"))
    return plans.repaired(hit, repairs)


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    items = rows.where("n % 7 <> 0").select("operation_id", _id("FP").alias("final_page_id"), _id("t").alias("target_path"), F.when(_n() % 2 == 0, "create").otherwise("update").alias("action"))
    pages = rows.select("operation_id", "n", F.when(_n() % 3 == 0, "?").otherwise(_id("FP")).alias("final_page_id"), F.when(_n() % 2 == 0, _id("t")).otherwise("?").alias("target_path"), F.lit("noop").alias("action"))
    return plans.page_item(pages, items)


def rendered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index table of each priority, the log page of each month, the record of each operation's raw file, by hash and size."""
    rows = _numbers(spark, sf_dir)
    index = render.index_tables(rows.select(F.col("o_orderstatus").alias("page_type"), _id("T|").alias("title"), F.concat(_id("p"), F.lit(".md")).alias("path"), F.lit("a\nb").alias("summary"), _id("2", _n() % 7).alias("updated")))
    log = render.log_pages(rows.select(F.col("o_orderpriority").alias("log_date"), _n().alias("pos"), "operation_id", _id("raw/").alias("raw_path"), (_n() % 2).alias("created"), (_n() % 3).alias("updated"), (_n() % 5).alias("noop")))
    made = rows.select("operation_id", F.concat(F.lit("raw/"), "operation_id", F.lit(".md")).alias("raw_path"), F.lit("h").alias("raw_sha256"), F.when(_n() % 3 == 0, F.concat(_id("p"), F.lit(".md"))).alias("target_path"))
    parts = (
        index.select(F.lit("index").alias("kind"), F.col("page_type").alias("name"), F.col("table").alias("m")), log.select(F.lit("log"), "log_date", "markdown"),
        render.source_records(made).select(F.lit("source"), "target_path", "markdown"),
    )
    return parts[0].union(parts[1]).union(parts[2]).select("kind", "name", text.sha256(F.col("m")).alias("sha256"))


def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    name = F.when(F.col("pos") == 0, " 摘要").when(F.col("pos") == 1, "核心内容").otherwise(F.when(_n() % 70 == 2, "摘要").when(_n() % 110 == 2, "else").otherwise("矛盾与未解决问题"))
    sections = rows.where("pos < 3 and n % 90 <> 1").select(F.col("operation_id").alias("final_page_id"), name.alias("heading"), F.when(_n() % 30 == 0, " ").otherwise(F.concat(F.lit("# x\n"), "o_orderpriority")).alias("body_markdown"))
    return render.page_body(sections, validate.REQUIRED_SECTIONS)


def shown_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, shares, times, lists and days as they are written."""
    return _numbers(spark, sf_dir).select(
        "n", usage.shown_price(_n() / 1000).alias("price"), usage.shown_percent(_n() / 4).alias("share"), usage.shown_milliseconds(_n() * 1.0).alias("ms"), usage.shown_seconds(_n() * 1.0).alias("s"),
        text.yaml_list("k", F.when(_n() % 2 == 0, F.array(_id("v"), F.lit('q"'))).otherwise(_none())).alias("yaml"), text.operation_date(F.format_string("ING-202403%02dT", _n() % 28 + 1)).cast("string").alias("day"),
    )


def anchors_and_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array(F.lit("Intro"), F.concat(F.lit("About "), "o_orderpriority"), F.lit("End"))
    hint = F.when(_n() % 3 == 0, F.lower(F.col("o_orderpriority"))).when(_n() % 3 == 1, F.lit("nothing")).otherwise(F.lit(""))
    name = F.when(_n() % 2 == 0, "the end").otherwise("zzz")
    body = F.array(F.lit("- 第一 x"), F.concat(F.lit("* 问题 "), "o_orderpriority"))
    asked = F.when(_n() % 3 == 0, F.concat(F.lit("- "), "o_orderpriority")).when(_n() % 3 == 1, F.lit("* 为何")).otherwise(F.lit(" "))
    return _numbers(spark, sf_dir).select("n", plans.best_anchor(found, hint, name).alias("anchor"), text.open_question(asked, body).alias("question"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        digest_numbering, decision_rules, first_decision_rule, decision_cleanup, composition_rules, final_target_rules, preimage_rules, judge_rules, digest_item_rules, pre_write_issues, field_rules,
        link_resolution, link_rules, related_choice, same_batch_refs, receipt_summary, raw_drift, latest_operation, judged_claims, claim_policies, repaired_units, page_items, rendered_tables, page_bodies,
        shown_numbers, anchors_and_questions,
    )
}

_ORDERS = "o as (select o_orderkey as n, (o_orderkey // 10)::varchar as op, o_orderkey % 10 as pos, o_orderstatus as st, o_orderpriority as pr from orders)"
_DECISIONS = f"""{_ORDERS}, b as (select *, case when n % 6 = 0 then 'same' else 'd' || n end as did, 'c' || n as cid, case st when 'F' then 'create' when 'O' then 'update' else 'noop' end as action,
  case when n % 9 = 0 then ' ' else (case n % 4 when 0 then 'concepts/Concept_' when 1 then 'other/../' else 'concepts/x' end) || n || case when n % 5 = 0 then '' else '.md' end end as path,
  case when n % 12 = 0 then '' else 'scope' end as scope, case when n % 15 = 0 then 0 else 1 end as refs from o),
d as (select *, case when action = 'create' or n % 8 = 0 then case when n % 7 = 0 then 'unheard' else 'concept' end end as type from b)"""
_MULTISET = """select op as operation_id, {prefix} || case when d > 0 then 'left' else 'right' end as rule, k as key
from (select op, k, unnest(range(abs(d))) as i, d from (select coalesce(a.op, b.op) as op, coalesce(a.k, b.k) as k, coalesce(a.c, 0) - coalesce(b.c, 0) as d
  from (select op, k, count(*) as c from {a} group by op, k) a full join (select op, k, count(*) as c from {b} group by op, k) b on a.op = b.op and a.k = b.k) where d <> 0)"""
ORACLES = {
    "digest_numbering": f"""with {_ORDERS}, t as (select *, printf('CU-%03d', pos + 1) as u from o)
select op as operation_id, pos, printf('C-%03d', pos + 1) as claim_id, pr as text, st as terms, u as content_unit_id, case when n % 4 = 0 then '未命名内容单元 ' || (pos + 1) else pr end as title,
  case n % 3 when 0 then u when 1 then 'CU-001' else 'far' end as anchor_unit_id, printf('C-%03d', pos + 1) || ',none' as claim_ids from t""",
    "decision_rules": f"""with {_DECISIONS}, k as (select * from d where n % 20 <> 0), u as (select * from k where action = 'create'), v as (
select op, case when n % 20 = 0 then 'candidate_without_decision' else 'unknown_candidate' end as rule, cid as key from d where (n % 20 = 0) <> (n % 25 = 0)
union all select op, 'duplicate_decision', did from k group by op, did having count(*) > 1 union all select op, 'no_target', did from k where action <> 'noop' and trim(path) = ''
union all select op, 'no_source_refs', did from k where refs = 0 union all select op, 'no_scope', did from k where scope = '' union all select op, 'update_out_of_context', did from k where action = 'update' and n % 2 = 1
union all select op, 'type_without_create', did from k where action <> 'create' and type is not null union all select op, 'unknown_type', did from u where type <> 'concept'
union all select op, 'path_escape', did from u where contains(path, '..') union all select op, 'wrong_directory', did from u where type = 'concept' and not starts_with(path, 'concepts/')
union all select op, 'not_markdown', did from u where not ends_with(path, '.md') union all select op, 'wrong_prefix', did from u where type = 'concept' and not starts_with(regexp_extract(path, '([^/]*)$', 1), 'Concept_'))
select op as operation_id, rule, key from v""",
    "first_decision_rule": f"""with {_DECISIONS}, v as (select op, 1 as r, did as key, 'duplicate_decision' as rule from d group by op, did having count(*) > 1
union all select op, 2, cid, 'blank_target_path' from d where trim(path) = '' union all select op, 2, cid, 'blank_content_scope' from d where scope = '' union all select op, 3, cid, 'no_source_refs' from d where refs = 0)
select op as operation_id, arg_min(rule, (r, key, rule)) as rule, arg_min(key, (r, key, rule)) as key from v group by op""",
    "decision_cleanup": f"""with {_DECISIONS} select op as operation_id, pos, case when n % 6 = 0 then printf('MD-%03d', pos + 1) else did end as decision_id, cid as candidate_page_id, action, trim(path) as target_path,
  case when action = 'create' then type end as page_type, scope as content_scope,
  case when n % 2 = 0 then '候选内容定位：here' when n % 5 <> 0 then concat_ws('|', case when scope <> '' then '候选内容定位：scope' end, '候选页标题：' || pr, '候选页摘要：摘', '内容单元：u' || n) else '' end as locators,
  n % 2 <> 0 and n % 5 <> 0 as locators_repaired from d""",
    "composition_rules": f"""with {_ORDERS}, w as (select op, 'd' || n as k, n // 2 as p from o where n % 11 <> 0), i as (select op, n, n // 2 as p from o where n % 2 = 0 and n % 14 <> 0),
a as (select op, 'd' || n as k from i union all select op, 'd' || case when n % 16 = 0 then n else n + 1 end from i), r as (select op, p, p + 1 as r from i union all select op, p, case when n % 18 = 0 then p else p - 1 end from i)
select op as operation_id, 'target_without_item' as rule, 'p' || p as key from (select distinct op, p from w) x where not exists (select 1 from i where i.op = x.op and i.p = x.p)
union all select op, 'unknown_target', 'p' || p from (select distinct op, p from i) x where not exists (select 1 from w where w.op = x.op and w.p = x.p)
union all {_MULTISET.format(prefix="'decision_only_'", a="a", b="w")}
union all select op, 'related_out_of_batch', 'p' || r from r where not exists (select 1 from i where i.op = r.op and i.p = r.r) union all select op, 'related_to_itself', 'p' || r from r where p = r""",
    "final_target_rules": f"""with {_ORDERS}, a as (select op, 'p' || (n // 2) as k, n from o where n % 13 <> 0), b as (select op, 'p' || (n // 2) as k from o where n % 7 <> 0)
{_MULTISET.format(prefix="'target_only_'", a="a", b="b")} union all select op, 'no_source_refs', k from a where n % 19 = 0 union all select op, 'empty_page', k from a where n % 17 = 0""",
    "preimage_rules": f"""with {_ORDERS}, q as (select *, unnest(list_filter([case when n % 3 <> 0 then 'OLD-SUMMARY' end, case when n % 4 <> 0 then 'OLD-SECTION-001' end, case when n % 4 <> 0 then 'OLD-SECTION-002' end,
  case when n % 3 = 0 and n % 4 = 0 then 'OLD-BODY' end], lambda x: x is not null)) as r from o), m as (select * from q where n % 7 = 0 and r <> 'OLD-BODY'), p as (select * from q where n % 6 <> 0 union all select * from m),
v as (select op, 'unreported' as rule from q where n % 6 = 0 union all select op, 'unknown_requirement' from m union all select op, 'generic_anchor' from p where n % 8 = 0 union all select op, 'anchor_not_found' from p where n % 8 <> 0 and n % 5 = 0)
select op as operation_id, rule, count(*) as n from v group by op, rule""",
    "judge_rules": f"""with {_ORDERS}, a as (select *, 'c' || (n // 3) as k from o where n % 10 <> 4), b as (select op, 'c' || (n // 3) as k from o where n % 8 <> 0)
{_MULTISET.format(prefix="'claim_only_'", a="a", b="b")} union all select op, 'covered_without_page', k from a where n % 3 < 2 and n % 4 = 0""",
    "digest_item_rules": f"""with {_ORDERS}, i as (select *, 'i' || (n - case when n % 20 = 1 then 1 else 0 end) as k, (n % 4 = 0) or (n % 5 = 0 and n % 10 <> 0) as known from o)
select op as operation_id, 'duplicate_item' as rule, k as key from i group by op, k having count(*) > 1 union all select op, 'covered_without_reference', k from i where n % 3 < 2 and not known
union all select op, 'missing_with_reference', k from i where n % 3 = 2 and known""",
    "pre_write_issues": f"""with {_ORDERS}, p as (select *, case when n % 15 = 0 then '../p' || n when n % 14 = 0 then 'index.md' when n % 21 = 0 then 'twice.md' else 'p' || n || '.md' end as t from o),
q as (select *, starts_with(t, 'p') and n % 4 < 2 as there, n % 2 = 1 as upd from p),
v as (select op, unnest(list_filter([case when n % 15 = 0 then 'target_escape' end, case when n % 15 = 0 or n % 14 = 0 then 'invalid_knowledge_target' end, case when n % 6 = 0 or n % 31 = 0 then 'missing_required_sections' end,
  case when n % 9 = 0 then 'content_hash_mismatch' end, case when n % 31 = 0 and n % 6 <> 0 then 'empty_final_page' end, case when n % 11 = 0 then 'missing_source_refs' end, case when n % 12 = 0 and n % 11 <> 0 then 'source_ref_mismatch' end,
  case when not upd and there then 'unsafe_overwrite' end, case when upd and n % 5 = 0 then 'update_missing_preimage' end, case when upd and n % 5 <> 0 and not there then 'preimage_target_missing' end,
  case when upd and n % 5 <> 0 and there and n % 3 <> 1 then 'preimage_drift' end], lambda x: x is not null)) as code from q
  union all select op, 'duplicate_target' from q group by op, t having count(*) > 1 union all select op, 'raw_hash_drift' from o where n % 70 = 0)
select op as operation_id, code, count(*) as n from v group by op, code""",
    "field_rules": """select user_id as operation_id, 'unknown_field' as rule, event_id::varchar as key from events where len(list_filter(json_keys(props), lambda k: k <> 'other')) > 0
union all select user_id, 'blank_kind', event_id::varchar from events where event_id % 10 = 0 or trim(coalesce(event_type, '')) = '' union all select user_id, 'blank_props', event_id::varchar from events where trim(coalesce(props, '')) = ''""",
    "link_resolution": f"""with {_ORDERS}, l as (select n, exists (select 1 from o x where x.n = o.n + 1) as a1, exists (select 1 from o x where x.n = o.n + 2) as a2 from o), f as (select n, n % 4 as f0, (n + 1) % 4 as f1, (n + 2) % 4 as f2, a1, a2 from l)
select n as id, 'a ' || case when n % 2 = 0 then '[[f' || f0 || '/Concept_p_' || n || '|shown]]' else 'shown' end
  || ' b ' || case when n % 2 = 1 and a1 then '[[f' || f1 || '/Concept_p_' || (n + 1) || ']]' else 'page no-' || (n + 1) end
  || ' c ' || case when n % 2 = 0 and a2 then '[[f' || f2 || '/Concept_p_' || (n + 2) || ']]' else 'concept p-' || (n + 2) end || ' d p ' || n as markdown from f""",
    "link_rules": f"""with {_ORDERS}, p as (select n, 'f' || (n % 4) || '/Concept_p_' || n || '.md' as path from o where n % 2 = 0),
v as (select path, 'model_related_section' as code, 1 as n from p where n % 10 = 0 union all select path, 'body_wikilink_too_many', 1 from p where n % 8 = 0 or n % 10 = 0 union all select path, 'source_graph_link', 1 from p where n % 8 = 0
  union all select path, 'self_wikilink', 1 from p where n % 6 = 0
  union all select path, 'body_wikilink_unknown_target', 1 + (n % 8 = 0)::int + (n % 10 = 0)::int + (n % 6 <> 0 and not exists (select 1 from p x where x.n = p.n + 2))::int from p
  union all select path, 'body_wikilink_invalid_target', 1 from p where n % 8 = 0)
select path, code, n::bigint as n from v""",
    "related_choice": f"""with {_ORDERS}, r as (select 'p' || op as page, pos, 'p' || (n // 10 + n * 7 % 5) as target from o), k as (select 'p' || op as path from o where n % 30 <> 0 and pos = 0),
w as (select *, case when target = page then 'self_link' when target not in (select path from k) then 'unknown_target' when row_number() over (partition by page, target order by pos) > 1 then 'duplicate_target' end as why from r),
c as (select *, sum((why is null)::int) over (partition by page order by pos) as kept from w)
select page, pos, target, case when why is not null then 'filtered' when kept > 2 then 'cutoff' else 'kept' end as decision, case when why is not null then why when kept > 2 then 'limit' end as reject_reason from c""",
    "same_batch_refs": f"""with {_ORDERS}, r as (select 'p' || op as page, pos, 'p' || (n // 10 + n * 7 % 9) as target from o), f as (select page, target, min(pos) as pos from r
  where target <> page and target in (select 'p' || op from o where n % 30 <> 0 and pos = 0) group by page, target),
x as (select page, target, row_number() over (partition by page order by pos) as rank from f) select * from x where rank <= {related.SAME_BATCH_MOST}""",
    "receipt_summary": f"""with {_ORDERS}, s as (select op, sum(n % 3)::bigint as calls, sum(n % 2)::bigint as repairs, bool_or(n % 40 = 7) as failed from o group by op),
w as (select op, case when n % 30 < 10 and n % 5 = 0 then 'knowledge' else 'source' end as kind, 'p' || n as t, 'h' || n as h from o where n % 30 < 20),
g as (select op, count(*) as n, count(*) filter (where kind = 'knowledge') as k, sha256('[' || string_agg('{{"kind":"' || kind || '","target_path":"' || t || '","content_sha256":"' || h || '"}}', ',' order by kind, t) || ']') as sha from w group by op)
select op as operation_id, case when failed then 'failed' when coalesce(k, 0) > 0 then 'written' else 'source_recorded' end as status, calls as model_call_count, repairs as repair_count, coalesce(n, 0) as n_written, sha as write_set_sha256
from s left join g using (op)""",
    "raw_drift": f"with {_ORDERS} select op as operation_id, 'raw_hash_drift' as code, 'raw/' || n as path from o where n % 9 <> 0 and n % 6 = 0",
    "latest_operation": "with e as (select strftime(ts, '%Y%m%d%H%M%S') as operation_id, event_id from events) select * from e where operation_id = (select max(operation_id) from e)",
    "judged_claims": f"""with {_ORDERS}, l as (select l_orderkey as n, l_linenumber as p, max(l_returnflag) as f from lineitem where l_linenumber > 2 group by 1, 2), r as (select n, arg_max(f, p) as f from l group by n)
select op as operation_id, 'c' || n as claim_id, n % 5 + 1 as importance, case f when 'A' then 'covered' when 'N' then 'partial' when 'R' then 'contradicted' else 'missing' end as status from o left join r using (n)""",
    "claim_policies": f"""with {_ORDERS}, u as (select *, unnest([n, n + 1]) as c from o where n % 3 = 0)
select u.op as operation_id, 'u' || u.n as content_unit_id, 'c' || c as claim_id, case when u.n % 4 = 1 and c % 5 + 1 <= 2 then '低价值' when u.n % 2 = 0 or c % 5 + 1 >= 4 then '必须保留' else '可摘要' end as coverage_policy
from u join o on o.op = u.op and o.n = c""",
    "repaired_units": f"""with {_ORDERS} select op as operation_id, 'u' || n as final_page_id, case when n % 6 = 3 then 'new' else 'old' end as markdown, n % 6 = 3 as changed from o where n % 10 in (2, 3)
  and exists (select 1 from o x where x.n = o.n // 10 * 10 + 3)""",
    "page_items": f"""with {_ORDERS}, m as (select *, n % 7 <> 0 and (n % 3 <> 0 or n % 2 = 0) as found from o)
select op as operation_id, n, case when found then 'FP' || n end as final_page_id, case when found then 't' || n end as target_path, case when found then case when n % 2 = 0 then 'create' else 'update' end end as action from m""",
    "rendered_tables": rf"""with {_ORDERS}, i as (select st, string_agg('| T\|' || n || ' | [[p' || n || ']] | a<br>b | 2' || (n % 7) || ' |', chr(10) order by '2' || (n % 7) desc, 'T|' || n desc) as b from o group by st),
l as (select pr, string_agg('| `' || op || '` | `raw/' || n || '` | ' || (n % 2) || ' | ' || (n % 3) || ' | ' || (n % 5) || ' |', chr(10) order by n) as b from o group by pr),
s as (select op, string_agg('- [[p' || n || ']]', chr(10) order by 'p' || n || '.md') filter (where n % 3 = 0) as b from o group by op)
select 'index' as kind, st as name, sha256('| 标题 | 页面 | 摘要 | 更新日期 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || b) as sha256 from i
union all select 'log', pr, sha256('# ' || pr || chr(10) || chr(10) || '| 操作 | 原始材料 | 新建数 | 实际更新数 | 未改动数 |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || b || chr(10)) from l
union all select 'source', 'sources/Source_' || op || '.md', sha256('# Source ' || op || chr(10) || chr(10) || '- raw: `raw/' || op || '.md`' || chr(10) || '- sha256: `h`' || chr(10) || chr(10) || '## 派生页面' || chr(10) || chr(10) || coalesce(b, '- 无') || chr(10)) from s""",
    "page_bodies": f"""with {_ORDERS}, s as (select op, case pos when 0 then '摘要' when 1 then '核心内容' else case when n % 70 = 2 then '摘要' when n % 110 = 2 then 'else' else '矛盾与未解决问题' end end as h,
  case when n % 30 = 0 then '暂无。' else '### x' || chr(10) || pr end as b from o where pos < 3 and n % 90 <> 1),
g as (select op, count(*) as n, count(distinct h) as d, count(distinct h) filter (where h <> 'else') as w, bool_or(h = 'else') as e, max(b) filter (where h = '摘要') as b1, max(b) filter (where h = '核心内容') as b2, max(b) filter (where h = '矛盾与未解决问题') as b3 from s group by op),
p as (select *, case when d < n then 'repeated_section' when w < 3 then 'missing_section' when e then 'unknown_section' end as problem from g)
select op as final_page_id, case when problem is null then '## 摘要' || chr(10) || chr(10) || b1 || chr(10) || chr(10) || '## 核心内容' || chr(10) || chr(10) || b2 || chr(10) || chr(10) || '## 矛盾与未解决问题' || chr(10) || chr(10) || b3 end as markdown, problem from p""",
    "shown_numbers": f"""with {_ORDERS} select n, case when n >= 10 then printf('¥%.4f', (n / 1000.0)::double) else printf('¥%.6f', (n / 1000.0)::double) end as price, printf('%.2f%%', (n / 4.0)::double) as share,
  case when n >= 1000 then printf('%.2fs', (round(n / 10.0) / 100)::double) else n || 'ms' end as ms, case when n >= 60 then (n // 60) || '分' || (n % 60) || '秒' else n || '.00s' end as s,
  case when n % 2 = 0 then 'k:' || chr(10) || '  - "v' || n || '"' || chr(10) || '  - "q\\""' else 'k: []' end as yaml, printf('2024-03-%02d', n % 28 + 1) as day from o""",
    "anchors_and_questions": f"""with {_ORDERS} select n, case when n % 3 = 0 then 'About ' || pr when n % 2 = 0 then 'End' else 'Intro' end as anchor,
  case n % 3 when 0 then '问题 ' || pr when 1 then '为何' end as question from o""",
}

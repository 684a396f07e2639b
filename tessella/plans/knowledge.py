"""Plans, coverage, merging, ledgers and caches on the driver's tables, whose rows stand in for claims, units and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text, usage
from tessella.operators import cache, coverage, diffs, ledger, plans, render, state, validate
from tessella.plans.tables import SENTENCES, table


def _judged(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Order lines as claims: status by return flag, importance by line number."""
    status = F.when(F.col("l_returnflag") == "A", "covered").when(F.col("l_returnflag") == "N", "partial").otherwise("missing")
    return table(spark, sf_dir, "lineitem").select(
        F.col(key).alias("operation_id"), "l_partkey", status.alias("status"), F.least(F.col("l_linenumber"), F.lit(5)).cast("long").alias("importance"),
        F.array("l_linestatus", F.concat(F.lit("k"), (F.col("l_partkey") % 7).cast("string"))).alias("concept_terms"),
    )


def coverage_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.claim_report(_judged(spark, sf_dir, "l_orderkey"))


def coverage_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.failures(coverage.claim_report(_judged(spark, sf_dir, "l_orderkey")))


def digest_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.digest_report(_judged(spark, sf_dir, "l_suppkey"))


def concept_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir, "l_suppkey").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("p_brand").alias("operation_id"), "status", "importance", F.split("p_type", " ").alias("concept_terms"))
    return coverage.claim_report(rows).select("operation_id", "claim_count", "concept_coverage_percent")


def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("o_orderstatus") == "F", "create").when(F.col("o_orderstatus") == "O", "update").otherwise("noop")
    return plans.action_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("operation_id"), action.alias("action")))


def reference_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.lit("all").alias("operation_id"), F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), "o_orderstatus")
    customers = table(spark, sf_dir, "customer").where("c_custkey % 50 <> 0").select(F.lit("all").alias("operation_id"), F.col("c_custkey").alias("custkey"))
    items = table(spark, sf_dir, "lineitem").select(F.lit("all").alias("operation_id"), F.col("l_orderkey").alias("orderkey"))
    found = validate.together(
        validate.unknown_references(orders, customers, "custkey", "unknown_customer", 1),
        validate.totality(orders.where("o_orderstatus = 'F'"), items.where("orderkey % 20 <> 0"), "orderkey", "order_without_lines", "unknown_order", 2),
    )
    return found.select("rule", "key", F.col("rule_order").cast("long").alias("rule_order"))


def claim_plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as units of their order: the first is the trunk and anchor of the others; some anchors and claims are wrong."""
    lines = table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_linenumber") == 1, "主干").otherwise("附属")
    units = lines.select(
        F.col("l_orderkey").alias("operation_id"), F.col("l_linenumber").cast("string").alias("content_unit_id"), role.alias("content_role"),
        F.when((F.col("l_linenumber") == 1) & (F.col("l_partkey") % 10 > 0), "独立成页").otherwise("降级为段落").alias("absorption_decision"),
        F.when(F.col("l_partkey") % 9 == 0, "7").otherwise("1").alias("anchor_unit_id"), F.array(F.col("l_linenumber").cast("string"), (F.col("l_linenumber") + 1).cast("string")).alias("claim_ids"),
    )
    claims = lines.select(F.col("l_orderkey").alias("operation_id"), F.col("l_linenumber").cast("string").alias("claim_id"))
    return validate.claim_plan(claims, units).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("operation_id").alias("n_operations"))


def composition_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as items, by order, line, part and quantity; of two lines that agree in all of these the one read first is the first, as where the SQL is run in order."""
    items = table(spark, sf_dir, "lineitem").where("l_orderkey is not null and l_partkey is not null").select(
        (F.col("l_orderkey") % 100).alias("operation_id"), F.col("l_partkey").alias("target_path"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 100 + F.rint("l_quantity").cast("long")).alias("pos"),
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("l_shipdate").alias("shipped"), F.array("l_returnflag").alias("flags"), F.array(F.col("l_suppkey").cast("string")).alias("suppliers"),
    )
    merged = plans.merged_items(items, ["shipped"], ["flags", "suppliers"], ("file", "row"))
    joined = [F.when(F.size(F.array_compact(c)) > 0, F.array_join(c, ",")).alias(c) for c in ("flags", "suppliers")]  # null, not empty, where no line has a value
    return merged.select("operation_id", "final_page_id", "target_path", "n_items", "shipped", *joined)


def update_plan_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as targets, their parts as candidate pages, suppliers as attached units, line numbers as claims."""
    lines = table(spark, sf_dir, "lineitem").withColumn("operation_id", F.col("l_orderkey"))
    items = lines.groupBy("operation_id").agg(F.collect_set("l_partkey").alias("candidate_page_ids")).withColumn("target_path", F.col("operation_id"))
    pages = lines.select("operation_id", F.col("l_partkey").alias("candidate_page_id"), F.col("l_partkey").alias("content_unit_id")).distinct()
    units = lines.select("operation_id", F.col("l_suppkey").alias("content_unit_id"), F.col("l_partkey").alias("anchor_unit_id"), F.array("l_linenumber").alias("claim_ids"))
    claims = lines.where("l_linenumber % 2 = 1").select("operation_id", F.col("l_linenumber").alias("claim_id"))
    held = lines.where("l_orderkey % 3 = 0").select(
        F.col("l_orderkey").alias("page_path"), F.when(F.col("l_returnflag") == "R", "已废弃").otherwise("活跃").alias("status"), F.when(F.col("l_linenumber") == 1, "低价值").otherwise("可摘要").alias("coverage_policy")
    )
    units = units.withColumns({"content_unit_id": F.col("content_unit_id").cast("string"), "claim_ids": F.col("claim_ids").cast("array<string>")})
    out = plans.update_plan(items, pages, units, claims.withColumn("claim_id", F.col("claim_id").cast("string")), held)
    return out.select("operation_id", F.array_join("unit_ids", ",").alias("unit_ids"), F.array_join("claim_ids", ",").alias("claim_ids"), "state_exists", "previous_claims", "previous_active")


def content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("operation_id"), F.col("l_linenumber").alias("pos"), F.col("l_linenumber").cast("string").alias("content_unit_id"),
        F.when(F.col("l_linenumber") <= 2, "主干").otherwise("附属").alias("content_role"), F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber")).otherwise(F.col("l_partkey") % 2 + 1).cast("string").alias("anchor_unit_id"),
    )
    return plans.content_groups(units).select("operation_id", "anchor_unit_id", F.array_join("members", ",").alias("members"))


def multiset_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("key"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") % 1000).alias("key"))
    return validate.multiset_difference(orders, lines).groupBy("side", "key").agg(F.count("*").alias("n"))


def pending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("raw/"), F.col(c).cast("string"), F.lit(".md"))
    raws = table(spark, sf_dir, "documents").select(path("doc_id").alias("raw_path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))
    return ledger.raw_candidates(raws, table(spark, sf_dir, "labels").select(path("doc_id").alias("raw_path")))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("h"), F.length("text").cast("long").alias("n_chars"))
    same = F.lit("c1").alias("contract")
    pages = docs.where("doc_id % 5 <> 0").select("path", F.col("h").alias("input_sha256"), F.col("h").alias("content_sha256"), same, "n_chars")
    changed = lambda n: F.when(F.col("doc_id") % n == 0, F.concat(F.lit("x"), "h")).otherwise(F.col("h"))
    contract = F.when(F.col("doc_id") % 13 == 0, "c0").otherwise("c1")
    old = docs.where("doc_id % 7 <> 0").select("path", changed(11).alias("input_sha256"), changed(3).alias("content_sha256"), contract.alias("contract"), (F.col("doc_id") % 17 != 0).alias("ok"))
    return pages, old


def cache_sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.diff(*_versions(spark, sf_dir))


def cache_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.metrics(cache.diff(*_versions(spark, sf_dir)))


def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    old = events.where("event_id % 3 <> 0").withColumn("origin", F.lit("old"))
    return state.appended(old, events.where("event_id % 2 = 0").withColumn("origin", F.lit("new")), "event_id")


def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return state.upserted(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of a day as operations: odd events made the log that is there, even ones bring rows in."""
    events = table(spark, sf_dir, "events").withColumn("log_date", F.to_date("ts"))
    kind = F.pmod(F.col("event_id"), F.lit(5))
    rows = events.groupBy("log_date", F.format_string("op-%06d", "user_id").alias("operation_id"), (F.col("event_id") % 2).alias("part")).agg(
        F.count_if(kind < 2).alias("created"), F.count_if(kind == 2).alias("updated"), F.count_if(kind > 2).alias("noop"), F.min("event_id").alias("first")
    )
    rows = rows.withColumn("raw_path", F.concat(F.lit("raw/"), F.col("first").cast("string")))
    columns = ["log_date", "operation_id", "raw_path", "created", "updated", "noop"]
    old = rows.where("part = 1").select(*columns, F.col("first").alias("pos"))
    return state.daily_log(rows.where("part = 0").select(*columns), old).withColumn("log_date", F.col("log_date").cast("string"))


def operation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") < 10, "failed").otherwise("running")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("operation_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("step"), status.alias("status"))
    return ledger.operation_status(rows)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.when(F.col("turn") % 5 == 4, "paused").otherwise("success").alias("status"),
        F.when(F.col("role") == "user", "deepseek-chat").when(F.col("role") == "assistant", "deepseek-v4-pro[1m]").otherwise("other").alias("model"),
        F.to_json(F.struct(F.struct(n.alias("prompt_tokens"), F.struct(F.floor(n / 4).alias("cached_tokens")).alias("prompt_tokens_details"), F.floor(n / 3).alias("completion_tokens")).alias("usage"))).alias("response"),
    )
    found = rows.withColumn("u", usage.extracted(F.col("response")))
    return usage.priced(found.select("conv_id", "role", "status", "model", *(F.col(f"u.{t}").alias(t) for t in usage.TOKENS)))


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = usage.totals(_calls(spark, sf_dir), "conv_id", "role")
    return steps.select("conv_id", "role", "api_call_count", "api_success_count", "prompt_tokens", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens", "total_tokens", "cache_hit_rate_percent", F.round("price_cny", 6).alias("price_cny"))


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.rolled_up(usage.totals(_calls(spark, sf_dir), "conv_id", "role"), "conv_id")
    return out.select("conv_id", "api_call_count", "prompt_tokens", "total_tokens", "cache_hit_rate_percent", F.round("price_cny", 6).alias("price_cny"))


def artifact_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("operation_id"), F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), "text")
    kept = docs.select("operation_id", "path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))
    altered = docs.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return ledger.artifact_drift(kept, altered.select("operation_id", "path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes")))


def document_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against that of the next id: lines that go and come, and the hash of what the hunks make of it."""
    docs = table(spark, sf_dir, "documents")
    later = docs.select((F.col("doc_id") - 1).alias("id"), F.col("doc_id").alias("next_id"), F.col("text").alias("new"))
    pairs = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("old")).join(later, "id")
    found = diffs.hunks(pairs)
    sizes = found.groupBy("id").agg(F.sum(F.size("added") - F.size("removed")).alias("net_lines"))
    made = diffs.applied(pairs, found).join(pairs.select("id", "next_id"), "id").join(sizes, "id", "left")
    return made.select(F.col("id").alias("doc_id"), "next_id", F.coalesce("net_lines", F.lit(0)).alias("net_lines"), F.sha2("text", 256).alias("applied_sha256"))


def index_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    from tessella.functions.links import wikilink

    # sorted before rendering: a sort works out its input twice, once to sample its keys
    ordered = docs.select(F.col("lang").alias("page_type"), F.col("n_chars").alias("updated"), path.alias("path"), "source", "text").orderBy("page_type", F.desc("updated"), F.desc("path"))
    made = render.row(F.concat(F.col("source"), F.lit(" | "), "page_type"), wikilink(F.col("path")), text.summary(F.col("text")), F.col("updated"))
    return ordered.select("page_type", "updated", "path", made.alias("row"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        coverage_by_order, coverage_failures, digest_coverage, concept_coverage, action_counts, reference_integrity, claim_plan_violations, composition_merge, update_plan_chain,
        content_groups, multiset_equality, pending_documents, cache_sync_diff, cache_metrics, ledger_append, latest_upsert, daily_log, operation_status, usage_cost, usage_rollup,
        artifact_verify, document_diffs, index_listing,
    )
}

_CLAIMS = """c as (select *, l_orderkey as op, case l_returnflag when 'A' then 'covered' when 'N' then 'partial' else 'missing' end as status, least(l_linenumber, 5) as w from lineitem),
s as (select *, case status when 'covered' then 1.0 when 'partial' then 0.5 else 0 end::double as sc from c)"""
_REPORT = f"""{_CLAIMS},
t as (select op, term, max(sc) as sc from (select op, sc, unnest([l_linestatus, 'k' || (l_partkey % 7)]) as term from s) group by op, term),
k as (select op, round(sum(sc) * 100.0 / count(*), 2) as concept from t group by op),
r as (select op as operation_id, count(*) as claim_count, count(*) filter (where status = 'covered') as covered_claim_count, count(*) filter (where status = 'partial') as partial_claim_count,
  count(*) filter (where status = 'missing') as missing_claim_count, 0::bigint as contradicted_claim_count, count(*) filter (where w >= 4) as core_claim_count,
  count(*) filter (where w >= 4 and status = 'missing') as core_missing_claim_count, round(sum(sc * w) * 100.0 / sum(w), 2) as raw_claim_coverage_percent,
  coalesce(round(sum(sc * w) filter (where w >= 4) * 100.0 / nullif(sum(w) filter (where w >= 4), 0), 2), 100.0) as core_claim_coverage_percent, any_value(concept) as concept_coverage_percent
  from s join k using (op) group by op)"""
_CALLS = """c as (select conv_id, role, turn, length(text) as n, length(text) // 4 as hit, length(text) // 3 as out from conversations),
p as (select *, case role when 'user' then round(hit / 1e6 * 0.02 + (n - hit) / 1e6 * 1.0 + out / 1e6 * 2.0, 8) when 'assistant' then round(hit / 1e6 * 0.025 + (n - hit) / 1e6 * 3.0 + out / 1e6 * 6.0, 8) else 0 end as price from c)"""
ORACLES = {
    "coverage_by_order": f"with {_REPORT} select * from r",
    "coverage_failures": f"""with {_REPORT} select operation_id, unnest(list_filter([case when partial_claim_count > 0 then 'partial_claims' end, case when missing_claim_count > 0 then 'missing_claims' end,
  case when raw_claim_coverage_percent < 85 then 'raw_coverage' end, case when core_claim_coverage_percent < 95 then 'core_coverage' end, case when concept_coverage_percent < 95 then 'concept_coverage' end,
  case when core_missing_claim_count > 0 then 'core_missing' end], lambda x: x is not null)) as failure from r""",
    "digest_coverage": f"""with {_CLAIMS} select l_suppkey as operation_id, count(*) as item_count, count(*) filter (where status = 'covered') as covered_item_count, count(*) filter (where status = 'partial') as partial_item_count,
  count(*) filter (where status = 'missing') as missing_item_count, count(*) filter (where w >= 4 and status <> 'covered') as core_missing_item_count, round(sum(sc * w) * 100.0 / sum(w), 2) as coverage_percent,
  coalesce(round(sum(sc * w) filter (where w >= 4) * 100.0 / nullif(sum(w) filter (where w >= 4), 0), 2), 100.0) as core_coverage_percent from s group by l_suppkey""",
    "concept_coverage": f"""with {_CLAIMS}, j as (select p_brand as op2, sc, string_split(p_type, ' ') as terms from s join part on l_partkey = p_partkey),
t as (select op2, term, max(sc) as sc from (select op2, sc, unnest(terms) as term from j) where trim(term) <> '' group by op2, term), k as (select op2, round(sum(sc) * 100.0 / count(*), 2) as pc from t group by op2)
select op2 as operation_id, count(*) as claim_count, any_value(pc) as concept_coverage_percent from j join k using (op2) group by op2""",
    "action_counts": """select o_orderpriority as operation_id, count(*) filter (where o_orderstatus = 'F') as "create", count(*) filter (where o_orderstatus = 'O') as "update",
  count(*) filter (where o_orderstatus not in ('F', 'O')) as noop from orders group by 1""",
    "reference_integrity": """select 'unknown_customer' as rule, o_custkey::varchar as key, 1::bigint as rule_order from orders where o_custkey not in (select c_custkey from customer where c_custkey % 50 <> 0)
union all select case when l is null then 'order_without_lines' else 'unknown_order' end, coalesce(o, l)::varchar, 2
from (select distinct o_orderkey as o from orders where o_orderstatus = 'F') full join (select distinct l_orderkey as l from lineitem where l_orderkey % 20 <> 0) on o = l where o is null or l is null""",
    "claim_plan_violations": """with u as (select l_orderkey as op, l_linenumber::varchar as unit, l_linenumber = 1 as trunk, l_linenumber = 1 and l_partkey % 10 > 0 as alone, case when l_partkey % 9 = 0 then '7' else '1' end as anchor,
  [l_linenumber::varchar, (l_linenumber + 1)::varchar] as claims from lineitem),
c as (select op, unit as claim from u), k as (select distinct op, unit as anchor, trunk as anchor_trunk from u), j as (select u.*, anchor_trunk from u left join k using (op, anchor)),
e as (select op, unnest(claims) as claim from u), n as (select op, count(*) filter (where trunk) as t from u group by op),
v as (select 'duplicate_claim' as rule, op from c group by op, claim having count(*) > 1 union all select 'duplicate_unit', op from c group by op, claim having count(*) > 1
  union all select 'no_trunk', op from n where t = 0 union all select 'anchor_missing', op from j where anchor_trunk is null union all select 'anchor_not_trunk', op from j where not anchor_trunk
  union all select 'trunk_not_own_anchor', op from j where trunk and anchor <> unit union all select 'trunk_not_standalone', op from j where trunk and not alone
  union all select 'attached_own_anchor', op from j where not trunk and anchor = unit union all select 'attached_standalone', op from j where not trunk and alone
  union all select 'unknown_claim', op from e where not exists (select 1 from c where c.op = e.op and c.claim = e.claim)
  union all select 'unassigned_claim', op from c where not exists (select 1 from e where c.op = e.op and c.claim = e.claim))
select rule, count(*) as n, count(distinct op) as n_operations from v group by rule""",
    "composition_merge": """with i as (select l_orderkey % 100 as op, l_partkey as target, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + l_quantity::bigint as pos, l_shipdate, l_returnflag, l_suppkey::varchar as sup from lineitem),
f as (select op, target, v, min(pos) as pos from (select op, target, pos, l_returnflag as v from i) group by all), s as (select op, target, v, min(pos) as pos from (select op, target, pos, sup as v from i) group by all),
fl as (select op, target, string_agg(v, ',' order by pos) as flags from f group by all), sl as (select op, target, string_agg(v, ',' order by pos) as suppliers from s group by all),
g as (select op, target, min(pos) as p, count(*) as n, arg_min(l_shipdate, pos) as shipped from i group by all)
select op as operation_id, printf('FP-%03d', dense_rank() over (partition by op order by p)) as final_page_id, target as target_path, n as n_items, shipped, flags, suppliers from g join fl using (op, target) join sl using (op, target)""",
    "update_plan_chain": """with l as (select * from lineitem), u as (select l_orderkey as op, string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar) as unit_ids from l group by 1),
c as (select l_orderkey as op, string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) as claim_ids from l where l_linenumber % 2 = 1 group by 1),
h as (select l_orderkey as op, count(*) as n, count(*) filter (where l_returnflag <> 'R' and l_linenumber <> 1) as a from l where l_orderkey % 3 = 0 group by 1)
select op as operation_id, unit_ids, coalesce(claim_ids, '') as claim_ids, h.n is not null as state_exists, coalesce(n, 0) as previous_claims, coalesce(a, 0) as previous_active from u left join c using (op) left join h using (op)""",
    "content_groups": """with u as (select l_orderkey as op, l_linenumber as n, case when l_linenumber <= 2 then l_linenumber else l_partkey % 2 + 1 end as a from lineitem),
m as (select op, a, string_agg(n::varchar, ',' order by n) as members from u group by op, a)
select u.op as operation_id, u.n::varchar as anchor_unit_id, coalesce(members, u.n::varchar) as members from u left join m on u.op = m.op and u.n = m.a where u.n <= 2""",
    "multiset_equality": """with o as (select o_orderkey % 1000 as key, count(*) as n from orders group by 1), l as (select l_orderkey % 1000 as key, count(*) as n from lineitem where l_linenumber = 1 group by 1),
d as (select coalesce(o.key, l.key) as key, coalesce(o.n, 0) - coalesce(l.n, 0) as d from o full join l on o.key = l.key)
select case when d > 0 then 'left' else 'right' end as side, key, abs(d) as n from d where d <> 0""",
    "pending_documents": """select 'raw/' || doc_id || '.md' as raw_path, sha256(text) as sha256, octet_length(encode(text))::bigint as size_bytes, false as processed from documents where doc_id not in (select doc_id from labels)""",
    "cache_sync_diff": """with p as (select doc_id, length(text)::bigint as n_chars from documents where doc_id % 5 <> 0), o as (select doc_id from documents where doc_id % 7 <> 0)
select 'p' || coalesce(p.doc_id, o.doc_id) as path, case when p.doc_id is null then 'pruned' when o.doc_id is null then 'miss' when o.doc_id % 11 = 0 or o.doc_id % 13 = 0 or o.doc_id % 17 = 0 then 'stale' else 'hit' end as state,
  coalesce(p.doc_id is not null and o.doc_id is not null and o.doc_id % 11 <> 0 and o.doc_id % 13 <> 0 and o.doc_id % 17 <> 0 and o.doc_id % 3 = 0, false) as refresh, n_chars from p full join o on p.doc_id = o.doc_id""",
    "cache_metrics": """with d as (select doc_id, doc_id % 5 <> 0 as p, doc_id % 7 <> 0 as o, doc_id % 11 = 0 or doc_id % 13 = 0 or doc_id % 17 = 0 as s, length(text) as n from documents)
select count(*) filter (where p) as page_count, count(*) filter (where p and o and not s) as cache_hit, count(*) filter (where p and not o) as cache_miss, count(*) filter (where p and o and s) as cache_stale,
  count(*) filter (where p and (not o or s)) as cache_refreshed, count(*) filter (where o and not p) as cache_pruned, sum(n) filter (where p)::bigint as text_char_count from d""",
    "ledger_append": """select event_id, user_id, event_type, case when event_id % 3 <> 0 then 'old' else 'new' end as origin from events where event_id % 3 <> 0 or event_id % 2 = 0""",
    "latest_upsert": """select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1""",
    "daily_log": """with e as (select ts::date as log_date, printf('op-%06d', user_id) as operation_id, event_id % 2 as part, count(*) filter (where event_id % 5 < 2) as created, count(*) filter (where event_id % 5 = 2) as updated,
  count(*) filter (where event_id % 5 > 2) as noop, min(event_id) as first from events group by all),
o as (select * from e where part = 1), f as (select * from e where part = 0), j as (select coalesce(o.log_date, f.log_date) as log_date, coalesce(o.operation_id, f.operation_id) as operation_id, o.first as pos,
  coalesce(f.first, o.first) as first, coalesce(f.created, o.created) as created, coalesce(f.updated, o.updated) as updated, coalesce(f.noop, o.noop) as noop from o full join f on o.log_date = f.log_date and o.operation_id = f.operation_id)
select log_date::varchar as log_date, row_number() over (partition by log_date order by pos nulls last, operation_id) - 1 as pos, operation_id, 'raw/' || first as raw_path, created, updated, noop from j""",
    "operation_status": """select user_id as operation_id, case when arg_max(value, event_id) < 10 then 'failed' else 'running' end as status, arg_max(event_type, event_id) as step, count(*) as n_events from events group by 1""",
    "usage_cost": f"""with {_CALLS} select conv_id, role, count(*) as api_call_count, count(*) filter (where turn % 5 <> 4) as api_success_count, sum(n)::bigint as prompt_tokens, sum(hit)::bigint as prompt_cache_hit_tokens,
  sum(n - hit)::bigint as prompt_cache_miss_tokens, sum(n + out)::bigint as total_tokens, case when sum(n) > 0 then round(sum(hit) / sum(n) * 100, 2) else 0 end as cache_hit_rate_percent, round(sum(price), 6) as price_cny from p group by 1, 2""",
    "usage_rollup": f"""with {_CALLS} select conv_id, count(*) as api_call_count, sum(n)::bigint as prompt_tokens, sum(n + out)::bigint as total_tokens,
  case when sum(n) > 0 then round(sum(hit) / sum(n) * 100, 2) else 0 end as cache_hit_rate_percent, round(sum(price), 6) as price_cny from p group by 1""",
    "artifact_verify": """select source as operation_id, case when doc_id % 10 = 0 then 'artifact_missing' else 'artifact_hash_drift' end as code, 'a/' || doc_id as path from documents where doc_id % 10 = 0 or doc_id % 7 = 0""",
    "document_diffs": """select d.doc_id, n.doc_id as next_id, (len(string_split(n.text, chr(10))) - len(string_split(d.text, chr(10))))::bigint as net_lines, sha256(n.text) as applied_sha256
from documents d join documents n on n.doc_id = d.doc_id + 1""",
    "index_listing": rf"""with s as (select *, {SENTENCES} as sentences from documents), j as (select *, array_to_string(sentences[1:2], ' ') as two from s)
select lang as page_type, n_chars as updated, source || '/' || doc_id || '.md' as path, '| ' || concat_ws(' | ', replace(source || ' | ' || lang, '|', '\|'), replace('[[' || source || '/' || doc_id || ']]', '|', '\|'),
  replace(case when length(two) <= 240 then two else rtrim(substr(two, 1, 239)) || '...' end, '|', '\|'), n_chars::varchar) || ' |' as row from j""",
}

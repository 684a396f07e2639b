"""Checks that return what breaks them: rows of ``operation_id``, ``rule``, ``key``; no row means that all is well.

``rule_order`` on a rule gives the first message that a check that stops at its first failure would tell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import has_cjk, heading_key, headings, let, strip, strip_frontmatter
from tessella.session import spread

# Fixed values.
TRUNK, STANDALONE = "主干", "独立成页"
TECHNICAL = [
    "adk", "agent", "agents", "api", "aws", "azure", "cli", "css", "deepseek", "docker", "gemini", "git", "github", "gitlab", "go",
    "google", "html", "http", "https", "java", "javascript", "json", "jsonl", "kotlin", "kubernetes", "langchain", "llm", "mcp",
    "markdown", "npm", "openai", "pip", "python", "rag", "ruby", "rust", "sdk", "sql", "swift", "typescript", "url", "uri", "yaml",
]
REQUIRED_SECTIONS = ["摘要", "核心内容", "矛盾与未解决问题"]
GENERIC_ANCHORS = ["正文", "全文", "页面", "内容"]


def violations(rows: DataFrame, rule: str, key: Column | str, order: int) -> DataFrame:
    column = F.col(key) if isinstance(key, str) else key
    return rows.select("operation_id", F.lit(rule).alias("rule"), column.cast("string").alias("key"), F.lit(order).alias("rule_order"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def first_violation(found: DataFrame) -> DataFrame:
    """``operation_id``, ``rule``, ``key``: the one that would be told first."""
    best = found.groupBy("operation_id").agg(F.min(F.struct("rule_order", "key", "rule")).alias("v"))
    return best.select("operation_id", "v.rule", "v.key")


def duplicates(rows: DataFrame, key: str, rule: str, order: int = 0) -> DataFrame:
    again = rows.groupBy("operation_id", key).agg(F.count("*").alias("n")).where("n > 1")
    return violations(again, rule, key, order)


def unknown_references(references: DataFrame, known: DataFrame, key: str, rule: str, order: int = 0) -> DataFrame:
    """References (``operation_id``, key) to keys that don't exist in the same operation."""
    return violations(references.join(known.select("operation_id", key).distinct(), ["operation_id", key], "left_anti"), rule, key, order)


def blank(rows: DataFrame, columns: list[str], key: str, order: int = 0) -> DataFrame:
    """Required columns that are null or blank."""
    named = F.explode(F.filter(F.array(*(F.when(F.coalesce(strip(F.col(c)), F.lit("")) == "", F.lit(c)) for c in columns)), lambda x: x.isNotNull()))
    return rows.select("operation_id", F.col(key).alias("_key"), named.alias("_column")).select(
        "operation_id", F.concat(F.lit("blank_"), F.col("_column")).alias("rule"), F.col("_key").cast("string").alias("key"), F.lit(order).alias("rule_order")
    )


def unknown_json_keys(rows: DataFrame, json: str, allowed: list[str], key: str, order: int = 0) -> DataFrame:
    """JSON objects with keys that their schema doesn't have; reading with a schema would drop those silently."""
    extra = F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))
    return violations(rows.where(F.size(extra) > 0), "unknown_field", key, order)


def claim_plan(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Checks of a digest's plan. claims: ``operation_id``, ``claim_id``; units: ``operation_id``, ``content_unit_id``,
    ``content_role``, ``absorption_decision``, ``anchor_unit_id``, ``claim_ids``."""
    anchors = units.select("operation_id", F.col("content_unit_id").alias("anchor_unit_id"), F.col("content_role").alias("anchor_role")).distinct()
    rows = units.join(anchors, ["operation_id", "anchor_unit_id"], "left")
    trunk, own = F.col("content_role") == TRUNK, F.col("anchor_unit_id") == F.col("content_unit_id")
    uses = units.select("operation_id", F.explode("claim_ids").alias("claim_id"))
    counts = units.groupBy("operation_id").agg(F.count_if(trunk).alias("trunks"))
    return together(
        duplicates(claims, "claim_id", "duplicate_claim", 1),
        duplicates(units, "content_unit_id", "duplicate_unit", 2),
        violations(counts.join(claims, "operation_id", "left_anti"), "units_without_claims", F.lit(""), 3),
        violations(counts.where("trunks = 0"), "no_trunk", F.lit(""), 4),
        violations(rows.where("anchor_role is null"), "anchor_missing", "content_unit_id", 5),
        violations(rows.where(F.col("anchor_role") != TRUNK), "anchor_not_trunk", "content_unit_id", 6),
        violations(rows.where(trunk & ~own), "trunk_not_own_anchor", "content_unit_id", 7),
        violations(rows.where(trunk & (F.col("absorption_decision") != STANDALONE)), "trunk_not_standalone", "content_unit_id", 8),
        violations(rows.where(~trunk & own), "attached_own_anchor", "content_unit_id", 9),
        violations(rows.where(~trunk & (F.col("absorption_decision") == STANDALONE)), "attached_standalone", "content_unit_id", 10),
        violations(rows.where(F.coalesce(F.size("claim_ids"), F.lit(0)) <= 0), "unit_without_claims", "content_unit_id", 11),
        unknown_references(uses, claims, "claim_id", "unknown_claim", 12),
        violations(claims.join(uses.distinct(), ["operation_id", "claim_id"], "left_anti"), "unassigned_claim", "claim_id", 13),
    )


def totality(left: DataFrame, right: DataFrame, key: str, only_left: str, only_right: str, order: int = 0) -> DataFrame:
    """Keys on one side only, by one count of both sides; a null is on no side but its own."""
    sides = [rows.select("operation_id", key, F.lit(i == 0).alias("l"), F.lit(i == 1).alias("r")) for i, rows in enumerate((left, right))]
    rows = spread(sides[0].union(sides[1]), "operation_id", key).groupBy("operation_id", key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    alone = F.col("operation_id").isNull() | F.col(key).isNull()
    rules = F.array(F.when(F.col("l") & (alone | ~F.col("r")), only_left), F.when(F.col("r") & (alone | ~F.col("l")), only_right))
    found = rows.select("operation_id", key, F.explode(F.array_compact(rules)).alias("rule"))
    return found.select("operation_id", "rule", F.col(key).cast("string").alias("key"), F.lit(order).alias("rule_order"))


def merge_plan(decisions: DataFrame, candidates: DataFrame, hits: DataFrame, page_types: DataFrame) -> DataFrame:
    """Checks of merge decisions. decisions: ``operation_id``, ``decision_id``, ``candidate_page_id``, ``action``, ``target_path``,
    ``page_type``, ``content_scope``, ``n_refs``; candidates, hits: ``operation_id``, ``candidate_page_id`` (hits also ``path``);
    page_types: ``page_type``, ``directory``, ``title_prefix`` (a handful of rows)."""
    updates = decisions.where("action = 'update'")
    top = hits.select("operation_id", "candidate_page_id", F.col("path").alias("target_path")).distinct()
    created = decisions.where("action = 'create'").join(F.broadcast(page_types), "page_type", "left")
    path, name = F.col("target_path"), F.regexp_extract("target_path", r"([^/]*)$", 1)
    return together(
        totality(candidates, decisions, "candidate_page_id", "candidate_without_decision", "unknown_candidate", 1),
        duplicates(decisions, "decision_id", "duplicate_decision", 2),
        violations(decisions.where("action <> 'noop' and coalesce(trim(target_path), '') = ''"), "no_target", "decision_id", 3),
        violations(decisions.where("n_refs = 0"), "no_source_refs", "decision_id", 4),
        violations(decisions.where("coalesce(trim(content_scope), '') = ''"), "no_scope", "decision_id", 5),
        violations(updates.join(top, ["operation_id", "candidate_page_id", "target_path"], "left_anti"), "update_out_of_context", "decision_id", 6),
        violations(decisions.where("action <> 'create' and page_type is not null"), "type_without_create", "decision_id", 7),
        violations(created.where("directory is null"), "unknown_type", "decision_id", 8),
        violations(created.where(path.contains("..")), "path_escape", "decision_id", 9),
        violations(created.where(~path.startswith(F.concat(F.col("directory"), F.lit("/")))), "wrong_directory", "decision_id", 10),
        violations(created.where(~path.endswith(".md")), "not_markdown", "decision_id", 11),
        violations(created.where(~name.startswith(F.col("title_prefix"))), "wrong_prefix", "decision_id", 12),
    )


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``side``, and the columns: rows one side has more often than the other, each as often as it is in excess."""
    both = a.select("*", F.lit(1).alias("_n")).union(b.select("*", F.lit(-1).alias("_n")))
    rows = spread(both, *a.columns).groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "left").otherwise("right")
    return rows.select(*a.columns, F.explode(F.array_repeat(side, F.abs("_n").cast("int"))).alias("side"))


def composition(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Checks of composition items (``operation_id``, ``target_path``, ``merge_decision_ids``, ``related_paths``) against decisions."""
    writable = decisions.where("action <> 'noop'")
    planned = items.select("operation_id", F.explode("merge_decision_ids").alias("decision_id"))
    gap = multiset_difference(planned, writable.select("operation_id", "decision_id"))
    related = items.select("operation_id", "target_path", F.explode("related_paths").alias("related"))
    targets = items.select("operation_id", F.col("target_path").alias("related"))
    keys = ["operation_id", "related"]
    return together(
        totality(items, writable, "target_path", "unknown_target", "target_without_item", 1),
        gap.select("operation_id", F.concat(F.lit("decision_only_"), F.col("side")).alias("rule"), F.col("decision_id").alias("key"), F.lit(2).alias("rule_order")),
        violations(spread(related.select(*keys), *keys).join(spread(targets, *keys), keys, "left_anti"), "related_out_of_batch", "related", 3),
        violations(related.where("related = target_path"), "related_to_itself", "related", 4),
    )


def final_targets(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Final pages (``operation_id``, ``target_path``, ``markdown``, ``n_refs``) against the items they were written for."""
    keys = ["operation_id", "target_path"]
    gap = multiset_difference(pages.select(*keys), items.select(*keys))
    return together(
        gap.select("operation_id", F.concat(F.lit("target_only_"), F.col("side")).alias("rule"), F.col("target_path").alias("key"), F.lit(1).alias("rule_order")),
        violations(pages.where("n_refs = 0"), "no_source_refs", "target_path", 2),
        violations(pages.where(strip(F.col("markdown")) == ""), "empty_page", "target_path", 3),
    )


def readable(c: Column) -> Column:
    """Prose of a field: code and links taken out."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "`[^`]*`", " "), r"\[[^\]]*\]\([^)]*\)", " "), r"\[\[[^\]]*\]\]", " "))


# What a command begins with, and what stands for code, commands, links and addresses once they are taken out.
COMMANDS = "pip|npm|npx|uv|go|git|curl|brew|docker|kubectl"
STAND_INS = ["code", "cmd", "link", "url"]


def is_technical(c: Column) -> Column:
    """Whether every Latin word of a fragment is a technical one: code, an address, a link, a command, a known token, or written
    like a name (digits or signs inside, all capitals, a capital first in three letters or more, a capital after a small letter)."""
    marked = [
        ("`[^`]*`", " CODE "), (r"https?://\S+", " URL "), (r"\[[^\]]*\]\([^)]*\)", " LINK "), (r"\[\[[^\]]*\]\]", " LINK "),
        (rf"(?i)\b(?:{COMMANDS})\s+[\w@./:+#=-]+(?:\s+[\w@./:+#=-]+)*", " CMD "),
    ]
    whole = F.coalesce(c, F.lit(""))
    bare = whole
    for pattern, name in marked:
        bare = F.regexp_replace(bare, pattern, name)
    named = r"[_@./:+#-]|[0-9]|^[A-Z]{2,}$|^[A-Z].{2,}|[a-z][A-Z]"
    # each of the marks has one of these characters; most words have none
    words = F.regexp_extract_all(F.when(whole.rlike(r"[`\[/\s]"), bare).otherwise(whole), F.lit(r"[A-Za-z][A-Za-z0-9_@./:+#-]*"), 0)
    return let(words, lambda found: (F.size(found) > 0) & F.forall(found, lambda w: F.lower(w).isin(TECHNICAL + STAND_INS) | w.rlike(named)))


def language_gate(rows: DataFrame, fields: list[str], key: str, script: str = r"[㐀-鿿]", technical: list[str] | None = None) -> DataFrame:
    """``operation_id``, ``rule``, ``key``, ``rule_order`` for fields with prose but no letter of the script; fields in
    ``technical`` may also be all technical tokens."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(f in (technical or [])).alias("may")) for f in fields))
    each = rows.select("operation_id", F.col(key).alias("_key"), F.explode(pairs).alias("x")).select("operation_id", "_key", "x.*")
    prose = readable(F.col("value"))
    bad = each.where((prose != "") & ~prose.rlike(script) & ~(F.col("may") & is_technical(strip(F.col("value")))))
    return bad.select("operation_id", F.concat(F.lit("language_"), F.col("field")).alias("rule"), F.col("_key").cast("string").alias("key"), F.lit(0).alias("rule_order"))


def preimage_requirements(pages: DataFrame) -> DataFrame:
    """``operation_id``, ``target_path``, ``requirement_id``, ``text`` that a rewritten page must report on: the old summary,
    its specific sections, or its body where it has neither. pages: ``operation_id``, ``target_path``, ``title``, ``summary``, ``markdown``."""
    generic = [*REQUIRED_SECTIONS, "相关页面", "Related"]
    specific = F.filter(headings(F.col("markdown")), lambda h: ~h.isin(generic) & (heading_key(h) != heading_key(F.col("title"))))
    sections = F.transform(specific, lambda h, i: F.struct(F.format_string("OLD-SECTION-%03d", i + 1).alias("requirement_id"), h.alias("text")))
    head = F.when(strip(F.coalesce("summary", F.lit(""))) != "", F.array(F.struct(F.lit("OLD-SUMMARY").alias("requirement_id"), F.col("summary").alias("text"))))
    all_ = F.concat(F.coalesce(head, F.array().cast("array<struct<requirement_id:string,text:string>>")), sections)
    body = F.array(F.struct(F.lit("OLD-BODY").alias("requirement_id"), F.substring(strip_frontmatter(F.col("markdown")), 1, 240).alias("text")))
    rows = pages.select("operation_id", "target_path", F.explode(F.when(F.size(all_) > 0, all_).otherwise(body)).alias("r"))
    return rows.select("operation_id", "target_path", "r.*")


def preimage_coverage(requirements: DataFrame, reports: DataFrame, pages: DataFrame) -> DataFrame:
    """Requirements without a report, reports without a requirement, and anchors that are generic or not on the new page.

    reports: ``operation_id``, ``target_path``, ``requirement_id``, ``final_anchor``; pages: ``operation_id``, ``target_path``, ``markdown``.
    """
    keys = ["operation_id", "target_path"]
    name = lambda df: df.select("operation_id", F.concat_ws("#", "target_path", "requirement_id").alias("requirement"))
    # a page's key is worked out once, and only it goes to the page's reports
    texts = pages.select(*keys, heading_key(F.col("markdown")).alias("_text"))
    anchored = spread(reports, *keys).join(spread(texts, *keys), keys).where(~F.contains("_text", heading_key(F.col("final_anchor"))))
    return together(
        totality(name(requirements), name(reports), "requirement", "unreported", "unknown_requirement", 1),
        violations(reports.where(F.col("final_anchor").isin(GENERIC_ANCHORS)), "generic_anchor", "requirement_id", 2),
        violations(anchored, "anchor_not_found", "requirement_id", 3),
    )


def coverage_items(items: DataFrame, claims: DataFrame, units: DataFrame) -> DataFrame:
    """Digest coverage items: unique ids; covered and partial ones need known references, missing ones none.

    items: ``operation_id``, ``item_id``, ``status``, ``claim_refs``, ``unit_refs``. Unknown references are dropped first.
    """
    known_claims = claims.groupBy("operation_id").agg(F.collect_set("claim_id").alias("claims"))
    known_units = units.groupBy("operation_id").agg(F.collect_set("content_unit_id").alias("units"))
    rows = items.join(known_claims, "operation_id", "left").join(known_units, "operation_id", "left")
    none = F.array().cast("array<string>")
    refs = F.size(F.array_intersect("claim_refs", F.coalesce("claims", none))) + F.size(F.array_intersect("unit_refs", F.coalesce("units", none)))
    return together(
        duplicates(items, "item_id", "duplicate_item", 1),
        violations(rows.where(F.col("status").isin("covered", "partial") & (refs == 0)), "covered_without_reference", "item_id", 2),
        violations(rows.where((F.col("status") == "missing") & (refs > 0)), "missing_with_reference", "item_id", 3),
    )


def judge_results(results: DataFrame, claims: DataFrame) -> DataFrame:
    """Results (``operation_id``, ``claim_id``, ``status``, ``covered_by``) must be the claims exactly, and name what covers them."""
    keys = ["operation_id", "claim_id"]
    gap = multiset_difference(results.select(*keys), claims.select(*keys))
    return together(
        gap.select("operation_id", F.concat(F.lit("claim_only_"), F.col("side")).alias("rule"), F.col("claim_id").alias("key"), F.lit(1).alias("rule_order")),
        violations(results.where(F.col("status").isin("covered", "partial") & (F.size("covered_by") == 0)), "covered_without_page", "claim_id", 2),
    )


def pre_write(pages: DataFrame, current: DataFrame, raws: DataFrame) -> DataFrame:
    """Issues of pages about to be written: ``operation_id``, ``code``, ``path``.

    pages: ``operation_id``, ``target_path``, ``action``, ``markdown``, ``content_sha256``, ``preimage_sha256``, ``source_refs`` (array of
    structs with ``raw_path`` and ``raw_sha256``); current: ``target_path``, ``current_sha256``; raws: ``operation_id``, ``raw_path``,
    ``bound_sha256``, ``raw_sha256`` (as it is now).
    """
    from tessella.functions.links import normalize_path

    own = pages.select("operation_id", "target_path", "action", "markdown", "content_sha256", "preimage_sha256", "source_refs")
    rows = own.join(current.withColumnRenamed("current_sha256", "now"), "target_path", "left").join(raws, "operation_id", "left")
    wrong = F.exists("source_refs", lambda r: (r["raw_path"] != F.col("raw_path")) | (r["raw_sha256"] != F.col("bound_sha256")))
    lacking = F.size(F.array_except(F.array(*map(F.lit, REQUIRED_SECTIONS)), headings(F.col("markdown")))) > 0
    update = F.col("action") == "update"
    codes = F.array(
        F.when(F.col("target_path").contains(".."), "target_escape"),
        F.when(normalize_path(F.col("target_path")).isNull(), "invalid_knowledge_target"),
        F.when(lacking, "missing_required_sections"),
        F.when(F.sha2("markdown", 256) != F.col("content_sha256"), "content_hash_mismatch"),
        F.when(strip(strip_frontmatter(F.col("markdown"))) == "", "empty_final_page"),
        F.when(F.size("source_refs") == 0, "missing_source_refs"),
        F.when(wrong, "source_ref_mismatch"),
        F.when((F.col("action") == "create") & F.col("now").isNotNull(), "unsafe_overwrite"),
        F.when(update & F.col("preimage_sha256").isNull(), "update_missing_preimage"),
        F.when(update & F.col("preimage_sha256").isNotNull() & F.col("now").isNull(), "preimage_target_missing"),
        F.when(update & (F.col("preimage_sha256") != F.col("now")), "preimage_drift"),
    )
    each = rows.select("operation_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"), F.col("target_path").alias("path"))
    again = pages.groupBy("operation_id", "target_path").agg(F.count("*").alias("n")).where("n > 1")
    drift = raws.where(~F.col("bound_sha256").eqNullSafe(F.col("raw_sha256")))
    return together(
        each,
        again.select("operation_id", F.lit("duplicate_target").alias("code"), F.col("target_path").alias("path")),
        drift.select("operation_id", F.lit("raw_hash_drift").alias("code"), F.col("raw_path").alias("path")),
    )


# Fixed values.
LEGACY_KEYS = ["type", "source_refs"]
PROVENANCE = ["source_raw_paths", "source_raw_hashes", "source_operation_ids"]


def header_issues(pages: DataFrame, type_key: str = "page_type", operation_key: str = "last_operation") -> DataFrame:
    """Issues of the headers of pages about to be written: ``operation_id``, ``code``, ``path``; a page without a header has only that one.

    pages: ``operation_id``, ``target_path``, ``title``, ``page_type``, ``markdown``.
    """
    from tessella.functions.text import frontmatter

    rows = pages.select("operation_id", "target_path", "title", "page_type", frontmatter(F.col("markdown")).alias("fm"))
    one = lambda key: F.get(F.try_element_at("fm", F.lit(key)), F.lit(0))
    lacks = lambda key: F.coalesce(F.size(F.try_element_at("fm", F.lit(key))), F.lit(0)) <= 0
    found = F.array(
        F.when(~one("title").eqNullSafe(strip(F.col("title"))), "frontmatter_title_mismatch"),
        F.when(~one(type_key).eqNullSafe(F.col("page_type")), "frontmatter_type_mismatch"),
        *(F.when(F.map_contains_key("fm", key), "frontmatter_legacy_field") for key in LEGACY_KEYS),
        F.when(~F.map_contains_key("fm", "aliases"), "frontmatter_missing_aliases"),
        *(F.when(lacks(key), "frontmatter_missing_provenance") for key in PROVENANCE),
        F.when(lacks("created") | lacks("updated") | lacks(operation_key), "frontmatter_missing_dates"),
    )
    codes = F.when(F.col("fm").isNull(), F.array(F.lit("missing_frontmatter"))).otherwise(F.filter(found, lambda c: c.isNotNull()))
    return rows.select("operation_id", F.explode(codes).alias("code"), F.col("target_path").alias("path"))


def error_kind(message: Column) -> Column:
    """What a failed call is told as."""
    low = F.lower(message)
    return (
        F.when(low.rlike("timeout|timed out"), "provider_timeout")
        .when(low.contains("truncated") | low.contains("length"), "truncated_response")
        .when(low.contains("json"), "invalid_json")
        .when(low.contains("schema") | low.contains("validation"), "schema_validation")
        .otherwise("provider_error")
    )


def retry_set(requests: DataFrame, errors: DataFrame) -> DataFrame:
    """Requests whose key failed; the others keep their results. Both: ``operation_id``, ``request_key``."""
    return requests.join(errors.select("operation_id", "request_key").distinct(), ["operation_id", "request_key"], "left_semi")

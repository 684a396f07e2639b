"""Set-based operators on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import cache, coverage, ledger, plans, provider, related, render, requests, state, validate, vectors


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


VECTORS = "id long, vector array<double>"


def test_scores_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(vectors, "POOL_BLOCK", 32)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    r = np.random.default_rng(0)
    x = np.abs(r.normal(size=(150, 3)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[8] = x[9]
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    got = {}
    for q, i, s, k in rows(vectors.top_k(pool.where("id % 10 = 0"), pool), "query", "id", "score", "rank"):
        got.setdefault(q, []).append((k, i, s))
    for q, found in got.items():
        score = np.floor(np.clip(x @ x[q], 0, 1) * 1e4 + 0.5) / 1e4
        want = sorted((i for i in range(150) if i != q), key=lambda i: (-score[i], i))[:5]
        assert [i for _, i, _ in sorted(found)] == want
    assert len(got) == 15


def test_cosine(spark):
    c = lambda a, b: spark.range(1).select(vectors.cosine(F.array(*map(F.lit, a)).cast("array<double>"), F.array(*map(F.lit, b)).cast("array<double>"))).first()[0]
    assert c([1.0, 0.0], [0.8, 0.6]) == 0.8 and c([1.0], [-1.0]) == 0.0 and c([1.0, 1.0], [1.0]) == 1.0 and c([], [1.0]) == 0.0


def test_related(spark):
    pool = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.6, 0.8])], VECTORS)
    links = spark.createDataFrame([(0, 1)], "query long, id long")
    got = rows(vectors.related(pool.where("id = 0"), pool, links), "id", "decision")
    assert got == [(1, "already_body_link"), (2, "kept")]


@pytest.mark.parametrize(
    ("current", "score", "best", "action"),
    [(2, 0.75, 0.95, "replace"), (2, 0.78, 0.80, "keep_existing"), (None, None, 0.9, "add"), (99, None, 0.9, "replace"), (99, None, 0.5, None), (1, 0.95, 0.95, "keep_existing")],
)
def test_maintenance(spark, current, score, best, action):
    v = lambda c: [c, (1 - c * c) ** 0.5]
    pages = [(0, [1.0, 0.0], current), (1, v(best), None), (2, v(score or 0.1), None)]
    df = spark.createDataFrame(pages, "id long, vector array<double>, current long")
    got = {r.id: r for r in related.maintenance(df, spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "query long, id long")).collect()}
    assert (got[0].action if 0 in got else None) == action


def test_maintenance_removes_invalid(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], None)], "id long, vector array<double>, current long")
    got = related.maintenance(df, spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(0, 1)], "query long, id long")).first()
    assert (got.id, got.action) == (0, "remove")


def test_selection(spark):
    refs = spark.createDataFrame([("p", i, t) for i, t in enumerate(["a", "p", "a", "x", "b", "c"])], "page string, pos int, target string")
    known = spark.createDataFrame([(t,) for t in "abcp"], "path string")
    assert rows(related.selected(refs, known, 2), "pos", "decision") == [(0, "kept"), (1, "filtered"), (2, "filtered"), (3, "filtered"), (4, "kept"), (5, "cutoff")]
    assert rows(related.same_batch(refs, known, 2), "target", "rank") == [("a", 1), ("b", 2)]


def test_strong_overlap(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 1), (2, 11, 0.9, 1), (3, 12, 0.7, 1), (1, 12, 0.85, 2)], "query long, id long, score double, rank int")
    decisions = spark.createDataFrame([(1, "update", 10, []), (2, "create", 11, []), (3, "noop", None, [])], "query long, action string, target long, matched array<long>")
    assert rows(vectors.strong_overlaps(hits, decisions), "query") == [(2,)]


def test_pool_needs_vectors(spark):
    old = spark.createDataFrame([(1, [1.0]), (2, [1.0])], VECTORS)
    assert vectors.pool_after(old, spark.createDataFrame([(2, [0.5])], VECTORS)).count() == 2
    with pytest.raises(Exception, match="no vector for 3"):
        vectors.pool_after(old, spark.createDataFrame([(3, None)], VECTORS)).collect()


CLAIMS = "operation_id string, claim_id string, importance int, concept_terms array<string>"


def test_coverage(spark):
    claims = spark.createDataFrame([("o", "C-001", 5, ["a", " "]), ("o", "C-002", 1, ["a", "b"]), ("o", "C-003", 4, ["c"])], CLAIMS)
    results = spark.createDataFrame([("o", "C-001", 0, "missing"), ("o", "C-001", 1, "covered"), ("o", "C-002", 2, "partial")], "operation_id string, claim_id string, pos int, status string")
    report = coverage.claim_report(coverage.judged(claims, results))
    got = report.first()
    assert (got.raw_claim_coverage_percent, got.core_claim_coverage_percent, got.concept_coverage_percent) == (55.0, 55.56, 50.0)
    assert (got.covered_claim_count, got.partial_claim_count, got.missing_claim_count, got.core_missing_claim_count) == (1, 1, 1, 1)
    assert {f for _, f in rows(coverage.failures(report), "operation_id", "failure")} == {"partial_claims", "missing_claims", "raw_coverage", "core_coverage", "concept_coverage", "core_missing"}
    items = spark.createDataFrame([("o", 5, "covered"), ("o", 1, "missing"), ("o", 5, "covered")], "operation_id string, importance int, status string")
    digest = coverage.digest_report(items)
    assert digest.first().coverage_percent == 90.91 and coverage.incomplete_digests(digest).count() == 1


UNITS = "operation_id string, pos int, content_unit_id string, title string, content_role string, absorption_decision string, anchor_unit_id string, claim_ids array<string>"


def test_claim_plan(spark):
    claims = spark.createDataFrame([("o", f"C-00{i}") for i in (1, 2)], "operation_id string, claim_id string")
    good = [("o", 0, "U1", "t", "主干", "独立成页", "U1", ["C-001"]), ("o", 1, "U2", "t", "附属", "并入主干", "U1", ["C-001", "C-002"])]
    assert validate.claim_plan(claims, spark.createDataFrame(good, UNITS)).count() == 0
    bad = [("o", 0, "U1", "t", "主干", "降级为段落", "U1", ["C-001"]), ("o", 1, "U2", "t", "附属", "独立成页", "U9", ["C-009"])]
    found = validate.claim_plan(claims, spark.createDataFrame(bad, UNITS))
    assert {r for r, in rows(found, "rule")} == {"trunk_not_standalone", "anchor_missing", "attached_standalone", "unknown_claim", "unassigned_claim"}
    assert rows(validate.first_violation(found), "rule") == [("anchor_missing",)]


def test_merge_and_composition(spark):
    d = "operation_id string, decision_id string, candidate_page_id string, action string, target_path string, page_type string, content_scope string, n_refs int"
    decisions = spark.createDataFrame(
        [("o", "D1", "CP-1", "update", "concepts/X.md", None, "s", 1), ("o", "D2", "CP-2", "create", "concepts/A.txt", "concept", "s", 1), ("o", "D3", "CP-9", "noop", None, "concept", "", 0)], d
    )
    candidates = spark.createDataFrame([("o", "CP-1"), ("o", "CP-2"), ("o", "CP-3")], "operation_id string, candidate_page_id string")
    hits = spark.createDataFrame([("o", "CP-1", "concepts/Y.md")], "operation_id string, candidate_page_id string, path string")
    types = spark.createDataFrame([("concept", "concepts", "Concept_")], "page_type string, directory string, title_prefix string")
    got = {(r, k) for r, k in rows(validate.merge_plan(decisions, candidates, hits, types), "rule", "key")}
    assert got == {("candidate_without_decision", "CP-3"), ("unknown_candidate", "CP-9"), ("no_source_refs", "D3"), ("no_scope", "D3"), ("update_out_of_context", "D1"), ("type_without_create", "D3"), ("not_markdown", "D2"), ("wrong_prefix", "D2")}
    items = spark.createDataFrame([("o", "concepts/X.md", ["D1", "D1"], ["concepts/X.md", "q"])], "operation_id string, target_path string, merge_decision_ids array<string>, related_paths array<string>")
    got = {r for r, in rows(validate.composition(items, decisions), "rule")}
    assert got == {"target_without_item", "decision_only_left", "decision_only_right", "related_out_of_batch", "related_to_itself"}


def test_multiset(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([1, 1, 2], [1, 2, 3]))
    assert rows(validate.multiset_difference(a, b), "side", "k") == [("left", 1), ("right", 3)]


def test_language_gate(spark):
    df = spark.createDataFrame([("o", "1", "English only", "pip install"), ("o", "2", "`code` [x](y)", "中文"), ("o", "3", "中 ok", "An English sentence")], "operation_id string, k string, a string, b string")
    assert rows(validate.language_gate(df, ["a", "b"], "k", technical=["b"]), "rule", "key") == [("language_a", "1"), ("language_b", "3")]
    tech = spark.createDataFrame([("o", "1", "npm docker"), ("o", "2", "v1.2 gpt-4"), ("o", "3", "plain words")], "operation_id string, k string, b string")
    assert rows(validate.language_gate(tech, ["b"], "k", technical=["b"]), "key") == [("3",)]


def test_strict_json_blank_and_items(spark):
    df = spark.createDataFrame([("o", "1", '{"a":1,"zz":2}', " "), ("o", "2", '{"a":1}', "x")], "operation_id string, k string, j string, t string")
    assert rows(validate.unknown_json_keys(df, "j", ["a", "b"], "k"), "key") == [("1",)] and rows(validate.blank(df, ["t"], "k"), "rule", "key") == [("blank_t", "1")]
    items = spark.createDataFrame([("o", "I1", "covered", ["C9"], []), ("o", "I2", "missing", ["C1"], []), ("o", "I3", "covered", [], ["U1"])], "operation_id string, item_id string, status string, claim_refs array<string>, unit_refs array<string>")
    claims = spark.createDataFrame([("o", "C1")], "operation_id string, claim_id string")
    units = spark.createDataFrame([("o", "U1")], "operation_id string, content_unit_id string")
    assert rows(validate.coverage_items(items, claims, units), "rule", "key") == [("covered_without_reference", "I1"), ("missing_with_reference", "I2")]


def test_preimage(spark):
    page = "# T\n\n## 摘要\n\ns\n\n## 核心内容\n\n### Part one\n\nx\n\n### Part two\n\ny"
    pages = spark.createDataFrame([("o", "p.md", "T", "old", page), ("o", "q.md", "Q", "", "just text")], "operation_id string, target_path string, title string, summary string, markdown string")
    need = validate.preimage_requirements(pages)
    assert [r for r, in rows(need.where("target_path = 'p.md'"), "requirement_id")] == ["OLD-SECTION-001", "OLD-SECTION-002", "OLD-SUMMARY"] and rows(need.where("target_path = 'q.md'"), "requirement_id") == [("OLD-BODY",)]
    reports = spark.createDataFrame([("o", "p.md", "OLD-SUMMARY", "正文"), ("o", "p.md", "OLD-SECTION-001", "Part-One"), ("o", "p.md", "EXTRA", "gone")], "operation_id string, target_path string, requirement_id string, final_anchor string")
    got = {(r, k) for r, k in rows(validate.preimage_coverage(need.where("target_path = 'p.md'"), reports, pages), "rule", "key")}
    assert got == {("unreported", "p.md#OLD-SECTION-002"), ("unknown_requirement", "p.md#EXTRA"), ("generic_anchor", "OLD-SUMMARY"), ("anchor_not_found", "EXTRA"), ("anchor_not_found", "OLD-SUMMARY")}


def test_pre_write(spark):
    ref = lambda h: [("raw/a.md", h)]
    good = "# T\n\n## 摘要\n\na\n\n## 核心内容\n\nb\n\n## 矛盾与未解决问题\n\nc"
    pages = [("o", "concepts/New.md", "create", good, None, None, ref("h")), ("o", "concepts/Old.md", "create", good, None, None, ref("wrong")), ("o", "concepts/U.md", "update", "x", "bad", "then", ref("h")), ("o", "raw/x.md", "update", good, None, None, [])]
    df = spark.createDataFrame(pages, "operation_id string, target_path string, action string, markdown string, content_sha256 string, preimage_sha256 string, source_refs array<struct<raw_path:string,raw_sha256:string>>")
    df = df.withColumn("content_sha256", F.coalesce("content_sha256", F.sha2("markdown", 256)))
    current = spark.createDataFrame([("concepts/Old.md", "x"), ("concepts/U.md", "now")], "target_path string, current_sha256 string")
    raws = spark.createDataFrame([("o", "raw/a.md", "h", "h2")], "operation_id string, raw_path string, bound_sha256 string, raw_sha256 string")
    got = set(rows(validate.pre_write(df, current, raws), "path", "code"))
    assert got == {
        ("concepts/Old.md", "source_ref_mismatch"), ("concepts/Old.md", "unsafe_overwrite"), ("concepts/U.md", "missing_required_sections"), ("concepts/U.md", "content_hash_mismatch"),
        ("concepts/U.md", "preimage_drift"), ("raw/x.md", "invalid_knowledge_target"), ("raw/x.md", "missing_source_refs"), ("raw/x.md", "update_missing_preimage"), ("raw/a.md", "raw_hash_drift"),
    }


def test_digest_normalisation(spark):
    claims = spark.createDataFrame([("o", 0, "TEMP-CLAIM", " t ", [" a", "a", ""]), ("o", 1, "X", "u", [])], "operation_id string, pos int, claim_id string, text string, concept_terms array<string>")
    units = spark.createDataFrame([("o", 0, "TEMP", " ", "主干", "独立成页", "TEMP", ["TEMP-CLAIM", "TEMP-CLAIM", "other"]), ("o", 1, "T2", "b", "附属", "x", "", [])], UNITS)
    c, u = plans.normalized_digest(claims, units)
    assert rows(c, "claim_id", "text", "concept_terms") == [("C-001", "t", ["a"]), ("C-002", "u", [])]
    assert rows(u, "content_unit_id", "title", "anchor_unit_id", "claim_ids") == [("CU-001", "未命名内容单元 1", "CU-001", ["C-001", "other"]), ("CU-002", "b", "CU-002", [])]
    assert rows(plans.content_groups(units), "anchor_unit_id", "members") == [("TEMP", ["TEMP"])]


def test_merged_items_and_pages(spark):
    items = spark.createDataFrame([("o", 2, "b", "B2", ["y"]), ("o", 0, "a", "A", ["x", "y"]), ("o", 1, "b", "B", ["x"]), ("o", 3, "a", "A2", ["z", "x"])], "operation_id string, pos int, target_path string, goal string, refs array<string>")
    assert rows(plans.merged_items(items, ["goal"], ["refs"]), "final_page_id", "target_path", "goal", "refs") == [("FP-001", "a", "A", ["x", "y", "z"]), ("FP-002", "b", "B", ["x", "y"])]
    known = spark.createDataFrame([("o", "FP-001", "p1", "update"), ("o", "FP-002", "p2", "create")], "operation_id string, final_page_id string, target_path string, action string")
    pages = spark.createDataFrame([("o", "FP-001", "wrong", "x", "m"), ("o", "?", "p2", "x", "n")], "operation_id string, final_page_id string, target_path string, action string, markdown string")
    assert rows(plans.page_item(pages, known), "final_page_id", "target_path", "action", "markdown") == [("FP-001", "p1", "update", "m"), ("FP-002", "p2", "create", "n")]
    fixed = plans.repaired(pages, spark.createDataFrame([("FP-001", "M")], "final_page_id string, markdown string"))
    assert rows(fixed, "markdown", "changed") == [("M", True), ("n", False)]
    h = {r.operation_id: r.hash for r in plans.ordered_hash(items, ["operation_id"], "pos", ["goal"]).collect()}
    assert h != {r.operation_id: r.hash for r in plans.ordered_hash(items.withColumn("pos", -F.col("pos")), ["operation_id"], "pos", ["goal"]).collect()}


def test_cache(spark):
    p = "path string, input_sha256 string, content_sha256 string, contract string, n_chars int, card string"
    pages = spark.createDataFrame([("a", "1", "1", "c", 5, "A"), ("b", "2", "2", "c", 6, "B"), ("c", "3", "3", "c", 7, "C"), ("d", "4", "4", "c", 8, "D")], p)
    old = spark.createDataFrame([("a", "1", "old", "c", True, [1.0, 0.0]), ("b", "x", "2", "c", True, [1.0, 0.0]), ("c", "3", "3", "c0", True, [1.0, 0.0]), ("z", "9", "9", "c", True, [1.0, 0.0])], "path string, input_sha256 string, content_sha256 string, contract string, ok boolean, vector array<double>")
    found = cache.diff(pages, old)
    assert rows(found, "path", "state", "refresh") == [("a", "hit", True), ("b", "stale", False), ("c", "stale", False), ("d", "miss", False), ("z", "pruned", False)]
    m = cache.metrics(found).first()
    assert (m.page_count, m.cache_hit, m.cache_miss, m.cache_stale, m.cache_refreshed, m.cache_pruned, m.text_char_count) == (4, 1, 1, 2, 3, 1, 26)
    encoder = lambda: lambda texts: [[3.0 * len(t), 4.0 * len(t), 9.0] for t in texts]
    got = {r.path: r.vector for r in cache.synced(pages, old, encoder, 2).collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.6, 0.8], "c": [0.6, 0.8], "d": [0.6, 0.8]}
    same = [spark.range(1).select(cache.contract_hash(c)).first()[0] for c in ({"model": "m", "dimensions": 3}, {"dimensions": 3, "model": "m"}, {"model": "n", "dimensions": 3})]
    assert same[0] == same[1] != same[2]


def test_page_state(spark):
    u = "operation_id string, page_path string, content_unit_id string, title string, content_role string, absorption_decision string, section_hint string, anchor_unit_id string, claim_ids array<string>"
    units = spark.createDataFrame([("NEW", "p", "CU-001", "Main", "主干", "独立成页", "core", "CU-001", ["C-002"]), ("NEW", "p", "CU-002", "Old node", "附属", "降级为段落", "", "CU-009", ["C-002", "C-003", "C-404"])], u)
    claims = spark.createDataFrame([("NEW", "p", "C-002", "t2", 2), ("NEW", "p", "C-003", "t3", 2)], "operation_id string, page_path string, claim_id string, text string, importance int")
    node = "page_path string, node_id string, title string, kind string, section_hint string, parent_node_id string, source_content_unit_ids array<string>, claim_ids array<string>, status string"
    old_nodes = spark.createDataFrame([("p", "OLD:CU-001", "old-node", "主干", "", None, ["CU-001"], ["OLD:C-001"], "活跃")], node)
    nodes = {r.node_id: r for r in state.updated_nodes(units, claims, old_nodes).collect()}
    assert set(nodes) == {"OLD:CU-001", "NEW:CU-001", "NEW:CU-002"} and nodes["NEW:CU-002"].parent_node_id == "OLD:CU-001" and nodes["NEW:CU-002"].claim_ids == ["NEW:C-002", "NEW:C-003"]
    c = "page_path string, state_claim_id string, source_claim_id string, text string, importance int, node_id string, source_content_unit_id string, source_operation_id string, status string, coverage_policy string, current_anchor string"
    old = spark.createDataFrame([("p", "OLD:C-001", "C-001", "t", 5, "OLD:CU-001", "CU-001", "OLD", "活跃", "必须保留", "x")], c)
    pages = spark.createDataFrame([("p", "# P\n\n## Core things\n\n## Old-node facts")], "page_path string, markdown string")
    got = rows(state.updated_claims(units, claims, pages, old), "state_claim_id", "source_content_unit_id", "coverage_policy", "current_anchor")
    assert got == [("NEW:C-002", "CU-001", "必须保留", "Core things"), ("NEW:C-002", "CU-002", "低价值", "Old-node facts"), ("NEW:C-003", "CU-002", "低价值", "Old-node facts"), ("OLD:C-001", "CU-001", "必须保留", "x")]


def test_daily_log(spark):
    log = "log_date string, pos long, operation_id string, raw_path string, created long, updated long, noop long"
    old = spark.createDataFrame([("d", 0, "a", "r", 1, 0, 0), ("d", 1, "b", "r", 0, 1, 0)], log)
    new = spark.createDataFrame([("d", "a", "r2", 9, 0, 0), ("d", "c", "r|3", 2, 1, 0), ("e", "x", "r", 0, 0, 1)], log.replace("pos long, ", ""))
    merged = state.daily_log(new, old)
    assert rows(merged, "log_date", "pos", "operation_id", "created") == [("d", 0, "a", 9), ("d", 1, "b", 0), ("d", 2, "c", 2), ("e", 0, "x", 0)]
    page = {r.log_date: r.markdown for r in render.log_pages(merged).collect()}["d"]
    assert page == "# d\n\n| 操作 | 原始材料 | 新建数 | 实际更新数 | 未改动数 |\n| --- | --- | --- | --- | --- |\n| `a` | `r2` | 9 | 0 | 0 |\n| `b` | `r` | 0 | 1 | 0 |\n| `c` | `r\\|3` | 2 | 1 | 0 |\n"


def test_index(spark):
    e = "page_type string, title string, path string, summary string, updated string"
    entries = spark.createDataFrame([("concept", "A", "concepts/A.md", "s\nt", "2024"), ("concept", "B", "concepts/B.md", "", "2025"), ("odd_type", "C", "x/C.md", "z", None)], e)
    none = spark.createDataFrame([], "question string, path string, updated string")
    page = render.index_page(entries, none, ["concept", "design"]).first().markdown
    assert page.index("## 概念") < page.index("[[concepts/B]]") < page.index("[[concepts/A]] | s<br>t") < page.index("## Odd Type") < page.index("## 矛盾与未解决问题") < page.index("暂无未决问题记录")
    assert "暂无知识页记录" in render.index_page(entries.limit(0), none, ["concept"]).first().markdown


def test_rendered_pages(spark):
    sections = spark.createDataFrame([("1", "B", "x\n## stray"), ("1", "A", " "), ("2", "A", "x"), ("3", "A", ""), ("3", "B", ""), ("3", "C", "")], "final_page_id string, heading string, body_markdown string")
    got = {r.final_page_id: r for r in render.page_body(sections, ["A", "B"]).collect()}
    assert got["1"].markdown == "## A\n\n暂无。\n\n## B\n\nx\n### stray" and (got["2"].problem, got["3"].problem) == ("missing_section", "unknown_section")
    final = spark.createDataFrame([("o", "raw/dir/a.md", "h", "concepts/B.md"), ("o", "raw/dir/a.md", "h", "concepts/A.md")], "operation_id string, raw_path string, raw_sha256 string, target_path string")
    record = render.source_records(final).first()
    assert record.target_path == "sources/Source_a.md" and record.markdown.endswith("- [[concepts/A]]\n- [[concepts/B]]\n")


def test_ledger(spark):
    raws = spark.createDataFrame([("raw/b",), ("raw/a",), ("raw/c",)], "raw_path string")
    done = spark.createDataFrame([("raw/a",), ("raw/a",), (None,)], "raw_path string")
    assert [r.raw_path for r in ledger.raw_candidates(raws, done).collect()] == ["raw/b", "raw/c"]
    assert [r.processed for r in ledger.raw_candidates(raws, done, True, 2).collect()] == [True, False]
    a = "operation_id string, path string, sha256 string, size_bytes long"
    kept = spark.createDataFrame([("o", "x", "1", 1), ("o", "y", "2", 2), ("o", "z", "3", 3)], a)
    now = spark.createDataFrame([("o", "x", "1", 1), ("o", "y", "9", 2)], a)
    assert rows(ledger.artifact_drift(kept, now), "path", "code") == [("y", "artifact_hash_drift"), ("z", "artifact_missing")]
    steps = spark.createDataFrame([("o", 2, 1, False), ("o", 1, 0, False), ("p", 0, 0, True), ("q", 0, 0, False)], "operation_id string, model_calls int, repair_count int, failed boolean")
    written = spark.createDataFrame([("o", "knowledge", "p", "h"), ("q", "source", "s", "h")], "operation_id string, kind string, target_path string, content_sha256 string")
    made = ledger.receipts(steps, written)
    assert rows(made, "operation_id", "status", "model_call_count") == [("o", "written", 3), ("p", "failed", 0), ("q", "source_recorded", 0)]
    with pytest.raises(Exception, match="receipt exists"):
        ledger.new_receipts(made, spark.createDataFrame([("o",)], "operation_id string")).collect()


GOOD = provider.Spec(spec="openai_compatible:deepseek-chat", endpoint="https://h/v1/chat/completions", api_key="k", max_retries=1, retry_backoff_seconds=0.0, max_tokens=8, timeout_seconds=5.0)


def answer(content, finish="stop"):
    return {"choices": [{"finish_reason": finish, "message": {"content": content}}], "usage": {"prompt_tokens": 10, "completion_tokens": 5}}


def test_provider(spark):
    raws = spark.createDataFrame([("o", "raw/a.md", "h", "text one"), ("o", "raw/b.md", "h", "text two"), ("o", "raw/c.md", "h", "x")], "operation_id string, raw_path string, raw_sha256 string, text string")
    asked = requests.digest_requests(raws)
    script = {
        ("source_digest", "raw/a.md"): [answer('{"n"', "length"), answer('ok {"n": 1}')], ("source_digest", "raw/b.md"): [answer('{"n": 2}')], ("source_digest", "raw/c.md"): [ValueError("boom")],
    }
    made = provider.calls(asked, provider.Replay(script), provider.Registry({"default": GOOD})).checkpoint()
    assert rows(made, "request_key", "attempt", "status") == [("raw/a.md", 0, "paused"), ("raw/a.md", 1, "success"), ("raw/b.md", 0, "success"), ("raw/c.md", 0, "paused"), ("raw/c.md", 1, "paused")]
    out = {r.request_key: r for r in provider.outputs(made, "n int").collect()}
    assert (out["raw/a.md"].output.n, out["raw/b.md"].output.n, out["raw/c.md"].problem) == (1, 2, "boom")
    assert provider.accounted(made).where("price_cny > 0").count() == 3
    errors = spark.createDataFrame([("o", "raw/b.md", "bad plan")], "operation_id string, request_key string, message string")
    assert rows(provider.semantically_failed(made, errors).where("request_key = 'raw/b.md'"), "status", "error") == [("paused", "bad plan")]
    assert rows(validate.retry_set(asked, errors), "request_key") == [("raw/b.md",)]


def test_provider_settings():
    registry = provider.Registry({"default": provider.Spec(spec="local:heuristic")}, {"merge_plan": GOOD})
    assert registry.of("merge_plan") is GOOD and "api_key" not in GOOD.shown()
    with pytest.raises(ValueError, match="not a model"):
        registry.require()
    assert GOOD.for_retry(1, "truncated_response").max_tokens == 16 and provider.replace(GOOD, max_tokens=200000).for_retry(1, "truncated_response").max_tokens == 262144
    body = provider.payload(GOOD, {"system_prompt": "s", "cache_prefix": "p", "user_payload": "u", "schema": "{}", "schema_name": "n"})
    assert [m["content"] for m in body["messages"]] == ["s", "p", "u"] and body["response_format"]["type"] == "json_schema"
    assert [provider.parallelism(c, n) for c, n in (({}, 16), ({"max_parallel_requests": 7}, 23))] == [16, 7]
    import time

    with pytest.raises(TimeoutError):
        provider.within(0.01, lambda: time.sleep(1))


def test_requests_share_their_prefix(spark):
    raws = spark.createDataFrame([("o", "raw/a.md", "h", "text")], "operation_id string, raw_path string, raw_sha256 string, text string")
    digests = spark.createDataFrame([("o", "{}")], "operation_id string, digest string")
    groups = spark.createDataFrame([("o", "CU-001", ["CU-001"]), ("o", "CU-002", ["CU-002"])], "operation_id string, anchor_unit_id string, members array<string>")
    prefixes = {r.cache_prefix for df in (requests.page_requests(raws, digests, groups), requests.warmup_requests(raws, digests)) for r in df.collect()}
    assert len(prefixes) == 1


def test_decisions_are_put_right(spark):
    d = "operation_id string, pos int, decision_id string, candidate_page_id string, action string, target_path string, page_type string, content_scope string, locators array<string>"
    decisions = spark.createDataFrame([("o", 0, " ", "CP-1", "create", "/a\\b.md", " concept ", "全部", ["O-001", "摘要"]), ("o", 1, "X", "CP-2", "update", "c.md", "concept", "scope", [" "])], d)
    candidates = spark.createDataFrame([("o", "CP-2", "T", "S", "CU-1")], "operation_id string, candidate_page_id string, title string, summary string, content_unit_id string")
    got = {r.pos: r for r in plans.normalized_decisions(decisions, candidates).collect()}
    assert (got[0].decision_id, got[0].target_path, got[0].page_type, got[0].locators) == ("MD-001", "a/b.md", "concept", ["候选内容定位：O-001", "摘要"])
    assert (got[1].decision_id, got[1].page_type, got[1].locators, got[1].locators_repaired) == ("X", None, ["候选内容定位：scope", "候选页标题：T", "候选页摘要：S", "内容单元：CU-1"], True)


def test_loaded_states_and_reports(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "page_path string")
    states = spark.createDataFrame([("a", '{"n": 1}')], "page_path string, json string")
    assert rows(state.loaded(states, wanted, "n int"), "page_path", "state.n") == [("a", 1), ("b", None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        state.loaded(states.withColumn("json", F.lit("{")), wanted, "n int").collect()
    table = spark.createDataFrame([("o", 1, "b|c"), ("o", 0, "a")], "operation_id string, pos int, x string")
    assert render.report(table, "operation_id", "R", ["pos", "x"]).first().markdown == "# R\n\n| pos | x |\n| --- | --- |\n| 0 | a |\n| 1 | b\\|c |\n"


def test_diff(spark):
    from tessella.functions.text import unified_diff

    df = spark.createDataFrame([("a\nb", "a\nc", "p.md"), (None, "x", "q.md")], "o string, n string, p string")
    got = [r[0] for r in df.select(unified_diff("o", "n", "p")).collect()]
    assert got[0].split("\n")[:2] == ["--- a/p.md", "+++ b/p.md"] and got[0].endswith("-b\n+c") and got[1].endswith("+x")

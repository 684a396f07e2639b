"""Cases that were wrong once: technical fragments, impossible dates, types from folders, headers, endpoints without schemas."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import plans, provider, validate
from tessella.sources import vault


@pytest.mark.parametrize(
    "fragment, want",
    [
        ("Redis", True), ("GPU", True), ("Redis and Kafka", False), ("Redis Kafka", True), ("pip install requests", True), ("npm i left-pad", True), ("https://example.com/a", True), ("`x = 1`", True),
        ("[guide](docs/a.md)", True), ("useState", True), ("utf8", True), ("A", False), ("It", False), ("plain words", False), ("python sdk", True), ("", False), ("123", False), ("请看 Redis", True),
    ],
)
def test_is_technical(spark, fragment, want):
    assert spark.createDataFrame([(fragment,)], "t string").select(validate.is_technical(F.col("t"))).first()[0] is want


def test_gate_lets_technical_fields_through(spark):
    rows = spark.createDataFrame([("o", 1, "pip install requests"), ("o", 2, "see the words"), ("o", 3, "说明 words"), ("o", 4, "`code`")], "operation_id string, k int, t string")
    found = validate.language_gate(rows, ["t"], "k", technical=["t"])
    assert [(r.rule, r.key) for r in found.collect()] == [("language_t", "2")]


def test_impossible_dates_spoil_one_header_only(spark):
    rows = spark.createDataFrame([("---\ncreated: 2024-02-30\n---\nx",), ("---\na: [b\n---\nx",), ("---\ncreated: 2024-02-28\n---\nx",)], "t string")
    assert [r[0] for r in rows.select(text.frontmatter("t")).collect()] == [None, None, {"created": ["2024-02-28"]}]


def test_type_from_folder(spark):
    files = [("designs/A.md", "# A\n\nbody", "h"), ("concepts/B.md", "---\npage_type: entity\n---\n# B", "h"), ("elsewhere/C.md", "no header", "h"), ("concepts/D.md", "---\npage_type: odd\n---\nx", "h")]
    got = {r.path: r.page_type for r in vault.parsed_pages(spark.createDataFrame(files, "path string, text string, sha256 string")).collect()}
    assert got == {"designs/A.md": "design", "concepts/B.md": "entity", "elsewhere/C.md": "concept"}


def test_header_issues(spark):
    head = lambda **x: "---\n" + "".join(f"{k}: {v}\n" for k, v in x.items()) + "---\n\n# T\n"
    good = {"page_type": "concept", "title": "T", "aliases": "[]", "created": "2024-01-01", "updated": "2024-01-02", "source_raw_paths": "[a]", "source_raw_hashes": "[b]", "source_operation_ids": "[o]", "last_operation": "o"}
    cases = {
        "none": "# T", "good": head(**good), "title": head(**good | {"title": "U"}), "type": head(**good | {"page_type": "design"}), "legacy": head(**good, type="x"),
        "aliases": head(**{k: v for k, v in good.items() if k != "aliases"}), "source": head(**good | {"source_raw_paths": "[]"}), "dates": head(**{k: v for k, v in good.items() if k != "updated"}),
    }
    pages = spark.createDataFrame([("o", k, "T", "concept", v) for k, v in cases.items()], "operation_id string, target_path string, title string, page_type string, markdown string")
    assert {(r.path, r.code) for r in validate.header_issues(pages).collect()} == {
        ("none", "missing_frontmatter"), ("title", "frontmatter_title_mismatch"), ("type", "frontmatter_type_mismatch"), ("legacy", "frontmatter_legacy_field"),
        ("aliases", "frontmatter_missing_aliases"), ("source", "frontmatter_missing_provenance"), ("dates", "frontmatter_missing_dates"),
    }


def test_settings_of_a_provider():
    spec = provider.Spec(spec="openai_compatible:m", endpoint="https://h/v1/chat/completions", api_key="k")
    assert spec.max_tokens == provider.TOKEN_CAP and not spec.json_schema_strict and spec.effective_json_mode() == "json_schema"
    plain = provider.replace(spec, endpoint="https://api.deepseek.com/chat/completions")
    asked = {"system_prompt": "s", "user_payload": "u", "schema": "{}", "schema_name": "n"}
    assert provider.payload(plain, asked)["response_format"] == {"type": "json_object"}
    assert provider.payload(spec, asked)["response_format"]["json_schema"]["strict"] is False


def test_claims_go_to_planned_pages_first(spark):
    claims = spark.createDataFrame([("o", "C1", "redis cache speed", ["redis"]), ("o", "C2", "kafka queue", [""]), ("p", "C1", "lonely claim", [""])], "operation_id string, claim_id string, claim_text string, concept_terms array<string>")
    pages = spark.createDataFrame([("o", "FP-1", "redis cache"), ("o", "FP-2", "kafka queue redis cache speed"), ("o", "FP-3", "kafka")], "operation_id string, final_page_id string, text string")
    planned = spark.createDataFrame([("o", "C1", "FP-1"), ("o", "C1", "FP-9")], "operation_id string, claim_id string, final_page_id string")
    got = {(r.operation_id, r.claim_id): (r.final_page_id, r.n_candidates) for r in plans.assigned_claims(claims, pages, planned).collect()}
    assert got == {("o", "C1"): ("FP-1", 1), ("o", "C2"): ("FP-2", 3)}


def test_a_written_page_replaces_the_old_one(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "wiki" / "concepts").mkdir(parents=True)
    (tmp_path / "wiki" / "concepts" / "A.md").write_text("old")
    seen = spark.createDataFrame([("concepts/A.md", __import__("hashlib").sha256(b"old").hexdigest()), ("concepts/B.md", None)], "target_path string, preimage_sha256 string")
    new = spark.createDataFrame([("concepts/A.md", "new"), ("concepts/B.md", "made")], "target_path string, markdown string")
    vault.write_pages(spark, root, new, seen).collect()
    assert sorted(p.name for p in (tmp_path / "wiki" / "concepts").iterdir() if p.suffix == ".md") == ["A.md", "B.md"]
    assert (tmp_path / "wiki" / "concepts" / "A.md").read_text() == "new"
    with pytest.raises(ValueError, match="changed"):
        vault.write_pages(spark, root, new, seen)


def test_pool_hash_goes_by_paths_and_contents(spark):
    rows = [(f"p{i}.md", f"h{i}") for i in range(300)]
    of = lambda rows: vault.pool_hash(spark.createDataFrame(rows, "path string, sha256 string").repartition(3)).first()["pool_hash"]
    assert of(rows) == of(rows[::-1]) and len(of(rows)) == 64
    assert len({of(rows), of(rows[1:]), of([("p0.md", "other"), *rows[1:]]), of([("q.md", "h0"), *rows[1:]]), of([])}) == 5


def test_update_plan_joins_its_chain_once(spark):
    """Units and claims of a target come from one chain of joins; repeated rows, units without claims and unknown claims change nothing."""
    items = spark.createDataFrame([(1, "a", ["p", "q", "p"]), (1, "b", ["r"]), (2, "a", [])], "operation_id int, target_path string, candidate_page_ids array<string>")
    pages = spark.createDataFrame([(1, "p", "u1"), (1, "p", "u1"), (1, "q", "u2")], "operation_id int, candidate_page_id string, content_unit_id string")
    units = spark.createDataFrame([(1, "u1", "u1", ["c1", "c9", None]), (1, "x", "u1", []), (1, "y", "u2", None), (1, "u1", "u1", ["c2"])], "operation_id int, content_unit_id string, anchor_unit_id string, claim_ids array<string>")
    claims = spark.createDataFrame([(1, "c1"), (1, "c1"), (1, "c2"), (2, "c9")], "operation_id int, claim_id string")
    held = spark.createDataFrame([("b", "活跃", "可摘要")], "page_path string, status string, coverage_policy string")
    out = plans.update_plan(items, pages, units, claims, held)
    assert sorted(map(tuple, out.collect())) == [(1, "a", ["u1", "x", "y"], ["c1", "c2"], False, 0, 0), (1, "b", [], [], True, 1, 1), (2, "a", [], [], False, 0, 0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 5


def test_both_sides_are_counted_at_once(spark):
    """Differences of keys by one aggregate over both sides, without sorts; nulls and repeats as before."""
    a = spark.createDataFrame([("o", "x"), ("o", "x"), ("o", "y"), ("o", None), (None, "z")], "operation_id string, k string")
    b = spark.createDataFrame([("o", "x"), ("o", "w"), ("o", "w"), ("o", None), (None, "z")], "operation_id string, k string")
    total = validate.totality(a, b, "k", "left", "right")
    assert sorted((r.operation_id or "", r.rule, r.key or "") for r in total.collect()) == [("", "left", "z"), ("", "right", "z"), ("o", "left", ""), ("o", "left", "y"), ("o", "right", ""), ("o", "right", "w")]
    gap = validate.multiset_difference(a, b)
    assert sorted((r.k, r.side) for r in gap.collect()) == [("w", "right"), ("w", "right"), ("x", "left"), ("y", "left")]
    for out in (total, gap):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


@pytest.mark.parametrize("name", ["preimage_rules", "composition_rules"])
def test_joins_of_rules_keep_their_tasks(spark, name):
    """Joins read a number of partitions that was given, which isn't lowered to a few large tasks."""
    from tessella.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 3


def test_composition_merge_equals_its_sql_on_ties_and_nulls(spark, tmp_path):
    """Lines of one order, line, part and quantity go by the order in which they are read, and what is missing is left out as in SQL."""
    import duckdb

    from tessella.plans import knowledge

    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute("create table lineitem (l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_returnflag varchar, l_suppkey bigint, l_shipdate timestamp)")
    lines = [
        (1, 1, 7, 5.0, "R", 9, 3), (1, 1, 7, 5.0, "A", 2, 2), (1, 1, 7, 5.0, "N", 30, 1), (101, 2, 8, 5.6, "R", 1, 4), (101, 2, 8, 5.4, "A", 1, 5), (201, 1, 7, 1.0, "A", 9, 6),
        (2, 1, 7, 1.0, None, None, None), (2, 2, 7, 1.0, None, 4, 7), (3, 1, 7, 1.0, None, None, None), (4, None, 7, 1.0, "A", 1, 8), (4, 1, 8, 1.0, "R", 2, None), (4, 3, 7, 1.0, "N", 3, 9),
        (5, None, 7, 1.0, "", 1, 8), (5, 1, 9, 1.0, "R", 1, 1), (None, 1, 7, 1.0, "A", 1, 8), (6, 1, None, 1.0, "A", 1, 8), (6, 1, 7, 1.0, "A", 1, 8),
    ]
    con.executemany("insert into lineitem values (?, ?, ?, ?, ?, ?, timestamp '1995-01-01' + to_days(?::int))", lines)
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    key = lambda r: (r[0], r[2])
    want = sorted(con.execute(knowledge.ORACLES["composition_merge"]).fetchall(), key=key)
    assert sorted(map(tuple, knowledge.composition_merge(spark, str(tmp_path)).collect()), key=key) == want
    assert want[0][4].day == 4 and want[0][5:] == ("R,A,N", "9,2,30")


def test_section_edits_equal_their_sql_on_odd_documents(spark, tmp_path):
    """What isn't edited stays as it is, its line ends and blanks too; a missing text, language or source hides no more than hangs on it."""
    import duckdb

    from tessella.plans import texts

    pieces = ["a\n", "a\n\n", "a\r\nb", "a\r", "a\x0bb\x0c", "a\x1c", "a\x85b\x85", "a b ", "a\xa0", "a　", "a \t", "\n", "", " ", "a\n#", "## Related\n\nx", "---\n---", "$1 \\1", None]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", [(3 * i + k, t, lang, source) for i, t in enumerate(pieces) for k, (lang, source) in enumerate([("en", "s"), (None, "s"), ("de", None), ("fr", "a\n---\nb")][: 3 + i % 2])])
    con.execute(f"copy documents to '{tmp_path}/documents.parquet'")
    want = con.execute(texts.ORACLES["section_edits"]).fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(texts.section_edits(spark, str(tmp_path)).collect()) == order(want)

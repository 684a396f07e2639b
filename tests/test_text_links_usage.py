"""Column functions against plain Python on the awkward cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import links, text, usage
from tessella.operators import granularity, plans


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [("---\na: 1\n---\nbody", "body"), ("---\n---\nbody", "---\n---\nbody"), ("---\na: 1\n", "---\na: 1\n"), ("plain", "plain"), ("---\na\n---\n\n  x", "x")],
)
def test_strip_frontmatter(spark, value, want):
    assert one(spark, text.strip_frontmatter(F.col("t")), t=value) == want


@pytest.mark.parametrize(("value", "want"), [("x\n# Head \ny", "Head"), ("#  \nx", "#"), ("\n\n  first line\n", "first line"), ("", "none"), ("a" * 100, "a" * 80), ("## two", "## two")])
def test_title(spark, value, want):
    assert one(spark, text.title(F.col("t"), "none"), t=value) == want


def test_sentences_and_summary(spark):
    value = "第一句。 第二句！no break.Here? Yes.\n\nLast one"
    assert one(spark, text.sentences(F.col("t")), t=value) == ["第一句。", "第二句！no break.Here?", "Yes.", "Last one"]
    assert one(spark, text.summary(F.col("t"), 2, 240), t=value) == "第一句。 第二句！no break.Here?"
    assert one(spark, text.summary(F.col("t"), 2, 10), t="abcdefg hij klm.") == "abcdefg h..."
    assert one(spark, text.summary(F.col("t")), t="  ") == ""


def test_keys_and_cjk(spark):
    assert one(spark, text.heading_key(F.col("t")), t="Core 概念-1!é") == "core概念1"
    assert one(spark, text.name_key(F.col("t")), t="Ünï_Code 2") == "ünïcode2"
    assert one(spark, text.has_cjk(F.col("t")), t="abc") is False and one(spark, text.has_cjk(F.col("t")), t="a中") is True


PAGE = "# T\n\nintro\n\n## 核心内容\n\nbody [[A|x]]\n\n## Related\n\n- [[concepts/B]]\n\n## 末\n\nend"


def test_sections(spark):
    assert one(spark, text.without_sections(F.col("t"), ["related"]), t=PAGE) == PAGE.replace("## Related\n\n- [[concepts/B]]\n\n", "")
    assert one(spark, text.section_body(F.col("t"), ["Related"]), t=PAGE) == "- [[concepts/B]]"
    assert one(spark, text.has_section(F.col("t"), ["RELATED"]), t=PAGE) is True
    replaced = one(spark, text.with_section(F.col("t"), "Related", F.lit("- $new \\1")), t=PAGE)
    assert "## Related\n\n- $new \\1\n\n## 末" in replaced and "concepts/B" not in replaced
    assert one(spark, text.with_section(F.col("t"), "Links", F.lit("x")), t="a\n\n") == "a\n\n## Links\n\nx\n"
    assert one(spark, text.headings(F.col("t")), t="# A\n## B \n#### no\n## B\n#bad\n### C") == ["A", "B", "C"]
    assert one(spark, text.demoted(F.col("t")), t="# a\n## b\n### c") == "### a\n### b\n### c"


def test_excerpt_cards_yaml(spark):
    got = one(spark, text.excerpt(F.col("t"), 6), t=" ab\n\n\n\ncd ef ")
    assert (got.text, got.truncated) == ("ab\n\ncd", True)
    assert one(spark, text.card(F.lit(" a "), F.lit(None).cast("string"), F.lit(" "), F.lit("b"))) == "a\n\nb"
    assert one(spark, text.yaml_list("k", F.array(F.lit('a"b'), F.lit("é"))))[:14] == 'k:\n  - "a\\"b"\n'
    assert one(spark, text.yaml_list("k", F.array().cast("array<string>"))) == "k: []"
    assert one(spark, text.labelled(F.lit("O-001"), "候选内容定位")) == "候选内容定位：O-001" and one(spark, text.labelled(F.lit("摘要"), "x")) == "摘要"


def test_frontmatter_and_json(spark):
    rows = spark.createDataFrame([("---\ntitle: A\ntags: [x, '', y]\nn: 3\n---\nb",), ("---\na: [\n---\n",), ("none",), (None,)], "t string")
    got = [r[0] for r in rows.select(text.frontmatter("t")).collect()]
    assert got == [{"title": ["A"], "tags": ["x", "y"], "n": ["3"]}, None, None, None]
    answers = spark.createDataFrame([('```json\n{"a": 1} tail',), ("{bad {\"b\": {\"c\": 2}}",), ("[1]",)], "t string")
    assert [r[0] and json.loads(r[0]) for r in answers.select(text.json_object("t")).collect()] == [{"a": 1}, {"b": {"c": 2}}, None]


def test_policy_and_percent(spark):
    policy = lambda r, d, i: one(spark, text.coverage_policy(F.lit(r), F.lit(d), F.lit(i)))
    assert [policy("主干", "降级为段落", 2), policy("主干", "独立成页", 1), policy("附属", "并入主干", 4), policy("附属", "并入主干", 3)] == ["低价值", "必须保留", "必须保留", "可摘要"]
    assert one(spark, text.percent(F.lit(0.0), F.lit(0))) == 100.0 and one(spark, text.percent(F.lit(10.0), F.lit(11))) == 90.91
    assert str(one(spark, text.operation_date(F.lit("ING-20260616T000000Z-x")))) == "2026-06-16"


@pytest.mark.parametrize(
    ("target", "want"),
    [
        ("concepts/A", "concepts/A.md"), ("wiki/concepts/A.md#part", "concepts/A.md"), ("./x?y", "x.md"), ("`<x\\y>`", "x/y.md"), ("/abs", None), ("../up", None), ("a/../b", None),
        ("index.md", None), ("raw/a.md", None), ("logs/2020", None), ("Source_x", None), ("wiki/sources/a", None), ("", None), ("#only", None), ("a b", "a b.md"),
    ],
)
def test_normalize_path(spark, target, want):
    assert one(spark, links.normalize_path(F.col("t")), t=target) == want


def test_links(spark):
    assert one(spark, links.wikilinks(F.col("t")), t="[[A|x]] [[ ]] [[b/C]]") == ["A", "b/C"]
    assert one(spark, links.body_links(F.col("t")), t=PAGE) == ["A.md"]
    assert one(spark, links.links_outside_graph(F.col("t")), t='<a href="raw/x.md">') is True
    assert one(spark, links.links_outside_graph(F.col("t")), t="[x](https://e.org)") is False
    assert one(spark, links.wikilink(F.lit("a/B.md"), F.lit("B"))) == "[[a/B|B]]" and one(spark, links.wikilink(F.lit("a/B.md"))) == "[[a/B]]"


def test_resolution_and_issues(spark):
    known = spark.createDataFrame([(0, "concepts/Concept_A.md", "Alpha"), (1, "concepts/B.md", "Beta"), (2, "concepts/C.md", "alpha!")], "pos int, path string, title string")
    docs = spark.createDataFrame([("1", "x [[concepts/B|b]] [[Alpha]] [[Concept_Gone_page]] [[nope|shown]] end")], "id string, markdown string")
    assert links.canonical_links(docs, known).first().markdown == "x [[concepts/B|b]] [[concepts/C]] Gone page shown end"
    page = "# T\n\n[[concepts/B]] [[T]] [[unknown]] [[raw/x]]\n\n## Related\n\n- a"
    pages = spark.createDataFrame([("concepts/T.md", "T", page)], "path string, title string, markdown string")
    codes = {r.code for r in links.link_issues(pages, known.unionByName(spark.createDataFrame([(3, "concepts/T.md", "T")], known.schema))).collect()}
    assert codes == {"model_related_section", "body_wikilink_too_many", "source_graph_link", "self_wikilink", "body_wikilink_unknown_target", "body_wikilink_invalid_target"}


def test_usage(spark):
    answer = {"usage": {"prompt_tokens": 1000, "prompt_cache_hit_tokens": 400, "prompt_cache_miss_tokens": 600, "completion_tokens": 200, "completion_tokens_details": {"reasoning_tokens": 50}}}
    nested = {"usage": {"prompt_tokens": 1000, "prompt_tokens_details": {"cached_tokens": 250}, "completion_tokens": "7"}}
    rows = spark.createDataFrame([("deepseek-chat", json.dumps(answer)), ("deepseek-v4-pro[1m]", json.dumps(answer)), ("other", json.dumps(nested)), ("other", "{}")], "model string, r string")
    rows = rows.withColumn("u", usage.extracted(F.col("r"))).select("model", "u.*", F.lit("success").alias("status"))
    got = usage.priced(rows).collect()
    by = {r.model: r for r in got if r.prompt_tokens}
    assert by["deepseek-chat"].price_cny == 0.001008 and by["deepseek-v4-pro[1m]"].price_cny == 0.00301 and by["other"].price_cny == 0
    assert (by["other"].prompt_cache_miss_tokens, by["other"].total_tokens, by["deepseek-chat"].total_tokens, by["deepseek-chat"].reasoning_tokens) == (750, 1007, 1200, 50)
    total = usage.totals(usage.priced(rows)).first()
    assert total.api_call_count == 4 and total.cache_hit_rate_percent == 35.0
    assert one(spark, usage.shown_price(F.lit(0.001))) == "¥0.001000" and one(spark, usage.shown_seconds(F.lit(75.0))) == "1分15秒"


def test_granularity(spark):
    sentence = "这是一个用来测试粒度统计的句子哦。"
    got = one(spark, granularity.stats(F.col("t")), t=sentence * 500)
    assert (got.effective_char_count, got.suggested_target_candidate_pages, got.suggested_min_candidate_pages, got.suggested_max_candidate_pages) == (8500, 2.2, 1, 4)
    md = "# T\n\nSkip to content\n\n[a](b) [c](d)\n\n- [x](y) [z](w)\n\n```\n# no\n```\n\npara one\n\npara two [l](m)"
    got = one(spark, granularity.stats(F.col("t")), t=md)
    assert (got.heading_count, got.code_block_count, got.markdown_link_count, got.navigation_noise_line_count, got.paragraph_count) == (1, 1, 5, 3, 3)
    errors = ["Warning: Target URL returned error 404", "Title: Page Not Found\n\n# Page not found", "Source URL: x\n\n# Not Found"]
    assert all(one(spark, granularity.is_error_page(F.col("t")), t=e) for e in errors) and not one(spark, granularity.is_error_page(F.col("t")), t="# About 404")
    rows = [("a", errors[0], 1, 0, 0, ""), ("b", "short", 0, 0, 0, ""), ("c", sentence * 60, 2, 2, 2, ""), ("d", sentence * 60, 0, 0, 0, "导航噪声"), ("e", sentence * 60, 1, 1, 0, "")]
    found = granularity.boundary_violations(spark.createDataFrame(rows, "operation_id string, text string, n_claims int, n_units int, n_groups int, noise_reasons string"))
    assert {(r.operation_id, r.rule) for r in found.collect()} == {("a", "error_page_with_claims"), ("a", "no_groups"), ("c", "too_many_groups"), ("e", "no_groups")}


def test_assignment(spark):
    assert sorted(one(spark, plans.assignment_terms(F.col("t")), t="Use GPT-4 at ok 知识库 abc/def 一二三四五六七八九")) == sorted(["use", "gpt-4", "知识库", "abc/def", *("一二三四五六七八九"[i : i + 4] for i in range(6))])
    claims = spark.createDataFrame([("o", 1, "alpha beta", ["alpha"]), ("o", 2, "zzz", [])], "operation_id string, claim_id int, claim_text string, concept_terms array<string>")
    pages = spark.createDataFrame([("o", "FP-001", "alpha here"), ("o", "FP-002", "alpha here")], "operation_id string, final_page_id string, text string")
    got = {r.claim_id: r for r in plans.assigned_claims(claims, pages, spark.createDataFrame([("o", 2, "FP-001"), ("o", 2, "gone")], "operation_id string, claim_id int, final_page_id string")).collect()}
    assert (got[1].final_page_id, got[1].score, got[1].n_candidates) == ("FP-002", 1.5, 2) and (got[2].final_page_id, got[2].score) == ("FP-001", 0.0)


def test_trims_and_sentences_equal_their_patterns(spark):
    """Trimming by characters and sentences by single blanks give what the patterns over all white space gave."""
    import random
    import re

    space = "[" + "".join(text.SPACES) + "]"
    r = random.Random(8)
    rows = ["".join(r.choice(["a", "B.", "。", "!", "? ", " ", "  ", "\n", "\t", "\x85", "\u2028", "\u3000", "\xa0", "\x1c", "é", "😀"]) for _ in range(r.randrange(0, 40))) for _ in range(400)]
    cut = lambda s: re.sub(f"^{space}+|{space}+\\Z", "", s)
    for t, a, b, c, d in spark.createDataFrame([(x,) for x in rows], "t string").select("t", text.strip(F.col("t")), text.strip_end(F.col("t")), text.sentences(F.col("t")), text.summary(F.col("t"), 3, 12)).collect():
        flat = cut(re.sub(space + "+", " ", t))
        want = [s for s in map(cut, re.split(r"(?<=[。！？.!?])\s+", flat)) if s]
        joined = " ".join(want[:3])
        assert (a, b, c) == (cut(t), re.sub(f"{space}+\\Z", "", t), want)
        assert d == (joined if len(joined) <= 12 else re.sub(f"{space}+\\Z", "", joined[:11]) + "..."), t


def test_sections_equal_a_fold_over_lines(spark):
    """Sections as slices between headings, and lines split without a pattern where it isn't needed."""
    import random
    import re

    r = random.Random(9)
    pieces = ["## A", " ##  a ", "## B", "##", "### c", "x", "", "y ", "## 😀"]
    rows = [r.choice(["\n", "\n", "\r\n", " "]).join(r.choice(pieces) for _ in range(r.randrange(0, 12))) + r.choice(["", "\n"]) for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in [*rows, None]], "t string").select("t", text.lines(F.col("t")), text.without_sections(F.col("t"), ["A"]), text.section_body(F.col("t"), ["a"]), text.has_section(F.col("t"), ["A"]))
    ends = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
    for t, lines, without, inside, has in got.collect():
        if t is None:
            assert (lines, without, inside, has) == (None,) * 4
            continue
        # a pattern's $ stands before a last line end too
        whole = re.sub(f"(?:{ends})(?=(?:{ends})?\\Z)", "", t)
        assert lines == ([] if t == "" else re.split(ends, whole)), t
        now, out, into, seen = False, [], [], False
        for line in lines:
            name = line.strip()[3:].strip().lower() if line.strip().startswith("## ") else None
            now = now if name is None else name == "a"
            seen |= name == "a"
            (out if not now else into if name is None else []).append(line)
        assert (without, inside, has) == ("\n".join(out), "\n".join(into).strip(), seen), t


def test_section_edits_work_a_page_out_once(spark):
    """The header is looked for twice a page (in its body, and for its headings), and no list of lines is copied for every line."""
    from tessella.plans import texts

    plan = texts.section_edits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("locate(") == 4 and "array_append" not in plan and "arrayappend" not in plan


def test_targets_named_by_many_pages_are_not_sorted(spark):
    """Pages are the side that a task holds; a target's path is worked out once."""
    from tessella.plans import contracts

    for name in ("link_rules", "link_resolution"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = contracts.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 2 and plan.count("REPARTITION_BY_NUM") >= 4

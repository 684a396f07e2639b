"""Inverted indexes against every pair, written out."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import plans, postings


@pytest.mark.parametrize("small", [10_000, 0])
def test_containing(spark, small):
    r = random.Random(2)
    texts = [(o, i, "".join(r.choice("abc 日本é") for _ in range(r.randrange(0, 60)))) for o in "xy" for i in range(60)] + [("x", 100, ""), ("x", 101, "abcab"), ("z", 1, "alone")]
    needles = sorted({(o, "".join(r.choice("abc 日本é") for _ in range(n))) for o in "xyw" for n in (1, 2, 3, 4, 6) for _ in range(8)} | {("x", "abcab")})
    got = postings.containing(spark.createDataFrame(needles, "op string, needle string"), spark.createDataFrame(texts, "op string, page int, text string"), ["op"], "page", small)
    assert sorted(tuple(x) for x in got.collect()) == sorted((o, n, i) for o, n in needles for p, i, t in texts if o == p and n in t)
    none = postings.containing(spark.createDataFrame([], "op string, needle string"), spark.createDataFrame(texts, "op string, page int, text string"), ["op"], "page", small)
    assert none.columns == ["op", "needle", "page"] and none.collect() == []


def terms_of(text):
    low = text.lower()
    out = set(re.findall(r"[a-z0-9][a-z0-9_./+-]{2,}", low))
    for run in re.findall(r"[一-鿿]{2,}", low):
        out |= {run} if len(run) <= 8 else {run[i : i + 4] for i in range(len(run) - 3)}
    return out


def test_assignment_equals_every_pair(spark):
    """Claims with and without planned pages, without terms, with concepts named twice, sharing nothing; Latin and CJK text; equal scores."""
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "知识编译器", "页面", "索引结构与检索方法的比较", "ab", "x1y"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    pages = [(o, f"FP-{i:03d}", line(r.randrange(0, 6))) for o in "pq" for i in range(12)] + [("r", "FP-000", "nothing in common")]
    claims = [(o, f"C-{i:03d}", line(r.randrange(0, 5)), [r.choice([*words, "", "gam", "编译"]) for _ in range(r.randrange(0, 3))] * r.choice([1, 1, 2])) for o in "pq" for i in range(40)]
    claims += [("r", "C-000", "other words", []), ("r", "C-001", "", ["common"]), ("s", "C-000", "no page", [])]
    planned = [("p", f"C-{i:03d}", f"FP-{(i * 5) % 14:03d}") for i in range(0, 20)] + [("p", "C-003", "FP-001"), ("p", "C-003", "FP-001"), ("q", "C-001", "gone")]
    text = {(o, p): t for o, p, t in pages}
    want = set()
    for o, c, t, concepts in claims:
        mine = sorted({p for a, b, p in planned if (a, b) == (o, c) and (o, p) in text}) or [p for a, p in text if a == o]

        def score(p):
            terms = terms_of(t)
            return (len(terms & terms_of(text[o, p])) + 2 * sum(1 for x in concepts if x and x in text[o, p])) / len(terms) if terms else 0.0

        if mine:
            best = max(mine, key=lambda p: (score(p), p))
            want.add((o, c, best, round(score(best) + 1e-12, 4), len(mine)))
    out = plans.assigned_claims(
        spark.createDataFrame(claims, "operation_id string, claim_id string, claim_text string, concept_terms array<string>"),
        spark.createDataFrame(pages, "operation_id string, final_page_id string, text string"),
        spark.createDataFrame(planned, "operation_id string, claim_id string, final_page_id string"),
    )
    assert {tuple(x) for x in out.collect()} == want


def test_assignment_of_many_claims_equals_that_of_few(spark):
    """Claims sent to every task, and claims that meet pages by the inverted index; a concept may look like a marked term."""
    r = random.Random(6)
    words = ["alpha", "beta", "\u0001alpha", "知识编译器", "😀x", "ab"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    pages = spark.createDataFrame([(o, i, line(r.randrange(0, 5))) for o in "pq" for i in range(15)], "operation_id string, final_page_id long, text string")
    claims = spark.createDataFrame([(o, i, line(r.randrange(0, 4)), [r.choice([*words, ""]), "lph"]) for o in "pq" for i in range(20)], "operation_id string, claim_id long, claim_text string, concept_terms array<string>")
    none = spark.createDataFrame([], "operation_id string, claim_id long, final_page_id long")
    few, many = (sorted(map(tuple, plans.assigned_claims(claims, pages, none, *limits).collect())) for limits in ((1000, 1000), (0, 0)))
    assert few == many and len(few) == 40


def test_few_claims_are_counted_where_a_page_lies(spark):
    """A page's terms go to one task; its pairs with claims aren't shuffled, nor is a text taken apart into pieces."""
    claims = spark.createDataFrame([("o", 1, "alpha beta", ["alp"])], "operation_id string, claim_id long, claim_text string, concept_terms array<string>")
    pages = spark.createDataFrame([("o", 7, "alpha")], "operation_id string, final_page_id long, text string")
    out = plans.assigned_claims(claims, pages, spark.createDataFrame([], "operation_id string, claim_id long, final_page_id long"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(operation_id, claim_id, final_page_id" not in plan.replace("#", "").translate(str.maketrans("", "", "0123456789")) and "piece" not in plan
    assert [tuple(x) for x in out.collect()] == [("o", 1, 7, 1.5, 1)]


def test_assignment_makes_no_pairs_that_share_nothing(spark):
    """No product of claims and pages anywhere in the plan."""
    rows = spark.range(50).select(F.format_string("op%d", F.col("id") % 1).alias("operation_id"), "id")
    claims = rows.select("operation_id", F.col("id").alias("claim_id"), F.format_string("word%d", "id").alias("claim_text"), F.array(F.lit("word1")).alias("concept_terms"))
    pages = rows.select("operation_id", F.col("id").alias("final_page_id"), F.format_string("word%d other", "id").alias("text"))
    out = plans.assigned_claims(claims, pages, spark.createDataFrame([], "operation_id string, claim_id long, final_page_id long"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "collect_list" not in plan and len(out.collect()) == 50

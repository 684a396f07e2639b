"""Joins over time against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import temporal


@pytest.mark.parametrize("rows,tolerance", [(200_000, None), (20, None), (7, 40)])
def test_as_of(spark, rows, tolerance):
    r = random.Random(3)
    states = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(-300, 300)]), i, r.choice("xyz")) for i in range(150)] + [("a", 5, 1, "q"), ("a", 5, 2, "q")]
    moments = [(r.choice(["a", "a", "b", "c", None]), r.choice([None, *range(-350, 350)]), i) for i in range(200)] + [("a", 5, 900), ("a", 4, 901)]
    got = temporal.as_of(spark.createDataFrame(moments, "k string, time long, id int"), spark.createDataFrame(states, "k string, time long, v int, w string"), ["k"], "time", tolerance, rows)
    got = {x.id: (x.state.time, x.state.v, x.state.w) if x.state else None for x in got.collect()}
    for k, t, i in moments:
        held = [s[1:] for s in states if t is not None and k is not None and s[0] == k and s[1] is not None and s[1] <= t and (tolerance is None or t - s[1] <= tolerance)]
        assert got[i] == max(held, default=None), (k, t)
    assert len(got) == len(moments)


def test_as_of_nothing(spark):
    none = temporal.as_of(spark.createDataFrame([("a", 1)], "k string, time long"), spark.createDataFrame([], "k string, time long, v int"), ["k"]).collect()
    assert [tuple(x) for x in none] == [("a", 1, None)]
    assert temporal.as_of(spark.createDataFrame([], "k string, time long"), spark.createDataFrame([("a", 1, 1)], "k string, time long, v int"), ["k"]).collect() == []


def test_inside(spark):
    r = random.Random(4)
    start = lambda: r.choice([None, *range(-200, 200)])
    spans = [(r.choice(["a", "a", "b", None]), s, None if s is None else s + r.choice([-3, 0, 1, 2, 3, 4, 7, 8, 9, 64, 1000]), i) for i in range(120) for s in [start()]]
    spans += [("a", -(2**60), 2**60, 900), ("a", 0, 2**33 + 1, 901), ("a", -1, 1, 902)]
    moments = [(r.choice(["a", "b", "c", None]), r.choice([None, *range(-250, 250)]), i) for i in range(150)] + [("a", 2**33, 900), ("a", 2**59, 901)]
    got = temporal.inside(spark.createDataFrame(moments, "k string, time long, id int"), spark.createDataFrame(spans, "k string, start long, end long, span int"), ["k"])
    want = sorted((i, s[3]) for k, t, i in moments for s in spans if t is not None and k is not None and s[0] == k and s[1] is not None and s[1] <= t < s[2])
    assert sorted((x.id, x.span) for x in got.collect()) == want
    assert temporal.inside(spark.createDataFrame(moments, "k string, time long, id int"), spark.createDataFrame([], "k string, start long, end long, span int"), ["k"]).collect() == []


def test_a_long_span_is_no_more_rows(spark):
    """Rows that a span is laid out in don't follow its length."""
    moments = spark.range(100).select(F.lit("a").alias("k"), (F.col("id") * 10**9).alias("time"))
    spans = spark.createDataFrame([("a", 0, 10**11)], "k string, start long, end long")
    assert temporal.inside(moments, spans, ["k"]).count() == 100


def test_moments_are_sent_to_few_levels(spark):
    """Spans of forty lengths, each twice the last, lie in a third as many levels; the pairs are those of a plain join."""
    import re

    spans = spark.range(40).select((F.col("id") % 3).alias("k"), F.col("id").alias("s"), (F.col("id") * 1_000_003).alias("start"), (F.col("id") * 1_000_003 + F.expr("shiftleft(1L, cast(id as int))")).alias("end"))
    moments = spark.range(600).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.expr("shiftleft(1L, cast(id % 41 as int))")).alias("time"))
    found = temporal.inside(moments, spans, ["k"])
    plain = moments.join(spans, "k").where("start <= time and time < end")
    assert sorted(map(tuple, found.select("k", "time", "s").collect())) == sorted(map(tuple, plain.select("k", "time", "s").collect())) != []
    levels = re.search(r"explode\(array\(([0-9, ]+)\)\)", found._jdf.queryExecution().analyzed().toString())[1].split(",")
    assert len(levels) <= 15

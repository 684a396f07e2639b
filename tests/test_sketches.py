"""Sketches by day against exact counts and ranks over every range."""

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import sketches


def test_ranges_are_within_their_bounds(spark):
    n = 60_000
    rows = spark.range(n).select(
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 12).cast("int")).alias("at"), F.when(F.col("id") % 3 == 0, "judge").otherwise("write").alias("step"),
        F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(9000))).alias("page"), F.when(F.col("id") % 40 != 0, F.exp(F.randn(7))).alias("ms"),
    ).cache()
    days = sketches.daily(rows, F.col("at"), F.col("page"), F.col("ms"), "step").cache()
    assert days.count() == 24 or days.count() == 12
    exact = rows.toPandas()
    for first, last in (("2026-01-01", "2026-01-12"), ("2026-01-03", "2026-01-05"), ("2026-01-07", "2026-01-07")):
        found = sketches.between(days, first, last, "step").select("step", "n", "total", sketches.distinct_pages().alias("pages"), *(sketches.quantile(q).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.95))).collect()
        inside = exact[(exact["at"].astype(str) >= first) & (exact["at"].astype(str) <= last)]
        assert {r.step for r in found} == set(inside.step)
        for r in found:
            mine = inside[inside.step == r.step]
            values = np.sort(mine.ms.dropna().to_numpy())
            assert r.n == len(mine) and abs(r.total - values.sum()) < 1e-6 * values.sum()
            assert abs(r.pages - mine.page.nunique()) <= 4 * sketches.DISTINCT_ERROR * mine.page.nunique()
            for q in (0.1, 0.5, 0.95):
                assert abs(np.searchsorted(values, r[f"q{int(q * 100)}"]) / len(values) - q) <= 2 * sketches.RANK_ERROR


def test_merging_in_steps_is_merging_at_once(spark):
    rows = spark.range(5000).select(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("at"), F.col("id").alias("page"), (F.col("id") * 1.0).alias("ms"))
    days = sketches.daily(rows, F.col("at"), F.col("page"), F.col("ms"))
    weeks = sketches.merged(days.withColumn("week", F.weekofyear("day")), "week").withColumn("day", F.col("first_day"))
    a, b = (sketches.merged(x).select("n", "total", sketches.distinct_pages().alias("p"), sketches.quantile(0.5).alias("m")).first() for x in (days, weeks))
    assert (a.n, a.total, a.p) == (b.n, b.total, b.p) and abs(a.m - b.m) <= 2 * sketches.RANK_ERROR * 5000
    none = sketches.merged(sketches.daily(rows.where("id < 0") if "id" in rows.columns else rows.where("page < 0"), F.col("at"), F.col("page"), F.col("ms")), "day")
    assert none.count() == 0
    blank = sketches.daily(rows.limit(3).withColumn("ms", F.lit(None).cast("double")), F.col("at"), F.col("page"), F.col("ms"))
    assert sketches.merged(blank).select("n", sketches.quantile(0.5).alias("q")).first()[:] == (3, None)


def test_weekly_users_are_exact(spark, tmp_path):
    """Far more users than a sketch tells exactly, and rows without a user, a kind or a number."""
    import duckdb

    from tessella.plans import analytics

    n = F.col("id")
    rows = spark.range(30_000).select(
        n.alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + n * 40).cast("timestamp_ntz").alias("ts"), F.when(n % 97 != 0, F.pmod(F.xxhash64(n), F.lit(9000))).alias("user_id"),
        F.when(n % 5 != 0, F.when(n % 2 == 0, "view").otherwise("click")).alias("event_type"), F.when((n % 5 != 0) & (n % 31 != 0), F.exp(F.randn(3))).alias("value"),
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in analytics.weekly_sketches(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = set(con.execute(analytics.ORACLES["weekly_sketches"]).fetchall())
    assert got == want and len(want) >= 6

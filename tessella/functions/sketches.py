"""Summaries of calls that are kept by day and merged for any range of days, without the calls.

A day's row holds exact counts and sums, a HyperLogLog sketch of the pages called for and a KLL sketch of a number such as tokens or
milliseconds. Sketches are of a fixed size however many calls there are, and merging them gives what one sketch over all would, within the
same bounds: distinct counts within DISTINCT_ERROR in two of three cases, a quantile's rank within RANK_ERROR in 99 of 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameters, and the errors that come with them.
DISTINCT_BITS, QUANTILE_K = 12, 200
DISTINCT_ERROR, RANK_ERROR = 0.0163, 0.0133
SKETCHES = ["pages", "numbers"]


def daily(calls: DataFrame, day: Column, page: Column, number: Column, *by: str) -> DataFrame:
    """``day``, by, ``n``, ``total``, ``pages``, ``numbers`` of all calls; null pages and numbers are in no sketch."""
    rows = calls.select(F.to_date(day).alias("day"), *by, page.cast("string").alias("page"), number.cast("double").alias("number"))
    return rows.groupBy("day", *by).agg(
        F.count("*").alias("n"), F.sum("number").alias("total"), F.hll_sketch_agg("page", F.lit(DISTINCT_BITS)).alias("pages"), F.kll_sketch_agg_double("number", F.lit(QUANTILE_K)).alias("numbers"),
    )


def merged(days: DataFrame, *by: str) -> DataFrame:
    """The same columns over all rows of ``by``, whatever days they are of. A table of days may be merged in steps, in any order."""
    return days.groupBy(*by).agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.hll_union_agg("pages").alias("pages"), F.kll_merge_agg_double("numbers", F.lit(QUANTILE_K)).alias("numbers"),
    )


def between(days: DataFrame, first: str, last: str, *by: str) -> DataFrame:
    """Merged over the days from first to last, both included."""
    return merged(days.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))), *by)


def distinct_pages() -> Column:
    return F.hll_sketch_estimate("pages")


def quantile(rank: float) -> Column:
    """The number at a rank from 0 to 1; null of no numbers."""
    return F.when(F.kll_sketch_get_n_double("numbers") > 0, F.kll_sketch_get_quantile_double("numbers", F.lit(rank)))

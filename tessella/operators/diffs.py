"""Differences of two versions of a text, by line.

Lines that come up once in either version are anchors; the longest chain of anchors in the order of both stays, and what lies
between two of them, less the lines that agree at either end, is a hunk. Hashes of lines are grouped, not the texts; an
anchor counts only if its lines are equal. Hunks applied to the old text give the new one.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

PAIR = "array<struct<i:int,j:int>>"


@F.pandas_udf(ArrayType(StructType([StructField("i", IntegerType()), StructField("j", IntegerType())])))
def longest_chain(anchors: pd.Series) -> pd.Series:
    """Of pairs in the order of i, the most whose j rise too."""

    def chain(pairs):
        tops, ends, before = [], [], []
        for k, p in enumerate(pairs):
            at = bisect_left(tops, p["j"])
            before.append(ends[at - 1] if at else -1)
            tops[at : at + 1], ends[at : at + 1] = [p["j"]], [k]
        out, k = [], ends[-1] if ends else -1
        while k >= 0:
            out.append({"i": int(pairs[k]["i"]), "j": int(pairs[k]["j"])})
            k = before[k]
        return out[::-1]

    return anchors.map(chain)


def _agree(a: Column, b: Column) -> Column:
    """How many lines two lists begin with alike."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), False)
    return F.when(differs > 0, differs - 1).otherwise(n).cast("int")


def hunks(pairs: DataFrame) -> DataFrame:
    """``id``, ``old_start``, ``removed``, ``new_start``, ``added``: lines (from 0) of ``old`` that go and lines of ``new`` that come in their place.

    pairs: ``id`` (once each), ``old``, ``new``; a null is a text that isn't there, without lines. Lines end at line feeds; equal texts have no hunk.
    """
    lines = lambda c: F.coalesce(F.split(c, "\n", -1), F.array().cast("array<string>"))
    rows = pairs.select("id", lines(F.col("old")).alias("a"), lines(F.col("new")).alias("b")).where(~F.col("old").eqNullSafe(F.col("new")))
    hashed = lambda side: F.transform(side, lambda x, k: F.struct(F.xxhash64(x).alias("h"), k.alias("k")))
    each = rows.select("id", F.lit(0).alias("side"), F.inline(hashed(F.col("a")))).unionAll(rows.select("id", F.lit(1).alias("side"), F.inline(hashed(F.col("b")))))
    of = lambda side: F.when(F.col("side") == side, F.col("k"))
    once = each.groupBy("id", "h").agg(F.count(of(0)).alias("m"), F.count(of(1)).alias("n"), F.min(of(0)).alias("i"), F.min(of(1)).alias("j")).where("m = 1 and n = 1")
    anchors = once.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("anchors"))  # one text's lines at most
    met = rows.join(anchors, "id", "left")
    equal = F.filter(F.coalesce("anchors", F.array().cast(PAIR)), lambda p: F.get("a", p["i"]) == F.get("b", p["j"]))
    met = met.select("id", "a", "b", longest_chain(equal).alias("chain"))
    edge = lambda i, j: F.array(F.struct(i.cast("int").alias("i"), j.cast("int").alias("j")))
    stops = F.concat(edge(F.lit(-1), F.lit(-1)), "chain", edge(F.size("a"), F.size("b")))
    met = met.withColumn("stops", stops)
    gaps = F.zip_with(F.slice("stops", F.lit(1), F.size("stops") - 1), F.slice("stops", F.lit(2), F.size("stops") - 1), lambda x, y: F.struct((x["i"] + 1).alias("i"), y["i"].alias("k"), (x["j"] + 1).alias("j"), y["j"].alias("l")))
    gaps = F.filter(gaps, lambda g: (g["i"] < g["k"]) | (g["j"] < g["l"]))
    cut = F.transform(gaps, lambda g: F.struct(g["i"].alias("i"), g["j"].alias("j"), F.slice("a", g["i"] + 1, g["k"] - g["i"]).alias("x"), F.slice("b", g["j"] + 1, g["l"] - g["j"]).alias("y")))
    found = met.select("id", F.inline(cut)).withColumn("head", _agree(F.col("x"), F.col("y")))
    rest = lambda c: F.slice(c, F.col("head") + 1, F.size(c) - F.col("head"))
    found = found.select("id", (F.col("i") + F.col("head")).alias("old_start"), (F.col("j") + F.col("head")).alias("new_start"), rest("x").alias("x"), rest("y").alias("y"))
    found = found.withColumn("tail", _agree(F.reverse("x"), F.reverse("y")))
    less = lambda c: F.slice(c, F.lit(1), F.size(c) - F.col("tail"))
    found = found.select("id", "old_start", less("x").alias("removed"), "new_start", less("y").alias("added"))
    return found.where((F.size("removed") > 0) | (F.size("added") > 0))


def applied(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``id``, ``text``: what hunks make of the old texts (``id``, ``old``); null where no line is left."""
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("old_start", F.size("removed").alias("n"), "added"))).alias("hunks"))
    rows = texts.select("id", F.coalesce(F.split("old", "\n", -1), F.array().cast("array<string>")).alias("a")).join(lists, "id", "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("made"))
    step = lambda s, h: F.struct((h["old_start"] + h["n"]).alias("at"), F.concat(s["made"], F.slice("a", s["at"] + 1, h["old_start"] - s["at"]), h["added"]).alias("made"))
    finish = lambda s: F.concat(s["made"], F.slice("a", s["at"] + 1, F.greatest(F.size("a") - s["at"], F.lit(0))))
    made = F.aggregate(F.coalesce("hunks", F.array().cast("array<struct<old_start:int,n:int,added:array<string>>>")), start, step, finish)
    return rows.select("id", made.alias("m")).select("id", F.when(F.size("m") > 0, F.array_join("m", "\n")).alias("text"))


def unified(found: DataFrame) -> DataFrame:
    """``id``, ``diff``: the hunks in the unified form, without lines of context."""
    span = lambda start, c: F.concat((F.col(start) + F.when(F.size(c) > 0, 1).otherwise(0)).cast("string"), F.lit(","), F.size(c).cast("string"))
    marked = lambda sign, c: F.transform(c, lambda x: F.concat(F.lit(sign), x))
    head = F.concat(F.lit("@@ -"), span("old_start", "removed"), F.lit(" +"), span("new_start", "added"), F.lit(" @@"))
    text = F.array_join(F.concat(F.array(head), marked("-", "removed"), marked("+", "added")), "\n")
    return found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("old_start", "new_start", text.alias("t")))).alias("h")).select("id", F.array_join(F.transform("h", lambda x: x["t"]), "\n").alias("diff"))

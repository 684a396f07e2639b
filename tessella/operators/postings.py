"""Inverted indexes over texts: which texts hold a term, and which hold a string anywhere.

Both are joins of short postings. A common term is a hot key of plain exchanges, which the adaptive skew join splits; points
of one pair are summed where they arise before anything is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import spread

#: Needles up to which they are sent to every task with the texts, counted before; beyond, candidates are joined with their texts again.
BROADCAST_NEEDLES = 10_000
#: Terms asked for, and needles of a key, up to which a text is held against all of them where it lies.
BROADCAST_ASKED, NEEDLES_A_TEXT = 200_000, 1000
#: Characters of the piece by which a longer needle is looked up.
GRAM = 3


def points(asked: DataFrame, held: DataFrame, by: list[str], asker: str, holder: str) -> DataFrame:
    """``by``, ``asker``, ``holder``, ``points``: the sum of the asked terms' ``weight`` that the holder has; pairs without any don't arise.

    asked: ``by``, asker, ``term``, ``weight``; held: ``by``, holder, ``term``, each term of a holder once.
    """
    return asked.join(held, [*by, "term"]).groupBy(*by, asker, holder).agg(F.sum("weight").alias("points"))


def points_in_place(asked: DataFrame, needles: DataFrame, held: DataFrame, by: list[str], asker: str, holder: str) -> DataFrame:
    """``by``, ``asker``, ``holder``, ``points``: the weights of the asked terms that the holder has and of the needles that its text holds, for few askers.

    asked: as for points; needles: ``by``, asker, ``needle``, ``weight``; held: ``by``, holder, ``text``, ``terms`` (distinct). What is asked
    goes to every task, a holder's terms to one: no pair is shuffled.
    """
    mark = lambda c: F.concat(F.lit("\u0001"), c)  # noqa: E731  no term begins so
    every = needles.groupBy(*by).agg(F.collect_set("needle").alias("needles"))
    inside = F.transform(F.filter("needles", lambda n: F.contains("text", n)), mark)
    rows = held.join(F.broadcast(every), by, "left").select(*by, holder, F.concat("terms", F.coalesce(inside, F.array().cast("array<string>"))).alias("terms"))
    terms = spread(rows, holder).select(*by, holder, F.explode("terms").alias("term"))
    both = asked.select(*by, asker, "term", "weight").unionByName(needles.select(*by, asker, mark(F.col("needle")).alias("term"), "weight"))
    return terms.join(F.broadcast(both), [*by, "term"]).groupBy(*by, asker, holder).agg(F.sum("weight").alias("points"))


def _pieces(text: Column, n: int) -> Column:
    """All pieces of the text of n characters, in order, in one pass; of a shorter text the text."""
    return F.when(F.length(text) <= n, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def _anchor(needle: Column) -> Column:
    """The piece by which a needle is found: its least piece of GRAM characters by hash; a shorter needle itself."""
    return F.array_min(F.transform(_pieces(needle, GRAM), lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("p"))))["p"]


def containing(needles: DataFrame, texts: DataFrame, by: list[str], holder: str, small: int = BROADCAST_NEEDLES) -> DataFrame:
    """``by``, ``needle``, ``holder``: which texts hold a needle anywhere in them, exactly.

    needles: ``by``, ``needle``, distinct, none empty; texts: ``by``, holder, ``text``. A needle has one anchor, a piece of it that
    each text with the needle must hold too; what meets by the anchor is looked at.
    """
    anchored = needles.select(*by, "needle", _anchor(F.col("needle")).alias("piece"))
    sizes = sorted(r[0] for r in anchored.select(F.length("piece")).distinct().collect())  # GRAM values at most
    if not sizes:
        return texts.join(needles, by, "left_semi").where("false").select(*by, F.lit("").alias("needle"), holder)
    spread = texts.select(*by, holder, "text", F.explode(F.array_distinct(F.concat(*(_pieces(F.col("text"), n) for n in sizes)))).alias("piece"))
    if needles.limit(small + 1).count() <= small:
        found = spread.join(F.broadcast(anchored), [*by, "piece"])
    else:
        found = spread.drop("text").join(anchored, [*by, "piece"]).select(*by, "needle", holder).join(texts, [*by, holder])
    return found.where(F.contains("text", "needle")).select(*by, "needle", holder)

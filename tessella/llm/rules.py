"""Quality rules as weak supervision, in DataFrame operations only.

Every rule looks at one statistic of a text. Rules against a defect vote bad (-1) or abstain (0); rules on what prose
is like vote good (1), bad or abstain. Expectation-maximisation over the counts of vote patterns (at most 3 to the number of
rules, whatever the table's size) estimates how often each rule casts each vote on good and on bad texts, which is its
accuracy, and the share of good texts; a text is kept by its posterior probability of being good, not because it
passes every rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, words_column

KEEP_FROM = 0.5
ROUNDS = 200
#: Log-odds of a good and a bad vote before anything is known: the first is right two times in three, the second 19 times in 20.
START = (0.69, -2.94)
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: a lambda's variable holds a result, where a column would be worked out anew for each element of an array."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows sorted by hash and place, equal neighbours flagged, and the union of the flagged windows counted."""

    def covered(places: Column) -> Column:
        total = F.aggregate(
            F.sequence(F.lit(1), F.size(places) - 1), F.lit(3), lambda acc, k: acc + F.least(F.lit(3), F.get(places, k) - F.get(places, k - 1))
        )
        return F.when(F.size(places) < 2, F.lit(0)).otherwise(total)

    def flagged(windows: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:
            return (x["h"] == F.get(windows, k - 1)["h"]) | (x["h"] == F.get(windows, k + 1)["h"])

        return F.sort_array(F.transform(F.filter(windows, repeated), lambda x: x["p"]))

    hashed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
    )
    return F.when(n < 4, F.lit(0)).otherwise(_let(F.sort_array(hashed), lambda s: _let(flagged(s), covered)))


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and what the rules look at, one row for each document; a null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            _repeat_words(w, F.size(w)).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    size = F.length("t")
    plain = _without(F.col("t"), SYMBOLS)
    quiet = _without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    calm = _without(F.col("t"), SYMBOLS + "!?.,;:()[]{}\"'_-=+/\\~^`@")
    out = rows.select(
        "doc_id",
        _let(words_column(F.col("t")), of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        (size - F.length(plain)).cast("long").alias("n_symbols"),
        (size - F.length(quiet)).cast("long").alias("n_capitals"),
        (size - F.length(calm)).cast("long").alias("n_marks"),
        (size - F.length(_without(F.col("t"), "."))).cast("long").alias("n_stops"),
    )
    return out.select("doc_id", "w.*", "l.*", "n_symbols", "n_capitals", "n_marks", "n_stops")


def _vote(good: Column | None, bad: Column) -> Column:
    return F.when(bad, -1).otherwise(0) if good is None else F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """Rules over the statistics; those on prose abstain between their two limits and on texts without words."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    some = F.col("n_words") > 0
    symbols, capitals, marks = F.col("n_symbols") / chars, F.col("n_capitals") / chars, F.col("n_marks") / chars
    repeats, distinct = F.col("n_repeat_words") / n, F.col("n_distinct") / n
    lines, length, pace = F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), chars / n, F.col("n_stops") / n
    return {
        "symbols": _vote(None, symbols > 0.08),
        "marks": _vote(None, marks > 0.1),
        "capitals": _vote(None, capitals > 0.5),
        "repeats": _vote(None, repeats > 0.5),
        "lines": _vote(None, lines > 0.3),
        "distinct": _vote((n >= 20) & (distinct > 0.3), (n >= 20) & (distinct < 0.1)),
        "length": _vote((length >= 3.5) & (length <= 9), some & ((length < 2.5) | (length > 12))),
        "pace": _vote((n >= 20) & (pace > 0.04) & (pace < 0.4), (n >= 40) & (pace < 0.01)),
        "size": _vote(n >= 100, n < 25),
    }


def log_odds(vote: tuple[int, ...], prior: float, weights: list[dict[int, float]]) -> float:
    return prior + sum(w[v] for v, w in zip(vote, weights))


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """Prior log-odds of good, and for each rule what each of its votes adds, by expectation-maximisation over patterns.

    Each round weighs the patterns by their posteriors and counts each rule's votes on good and on bad texts, smoothed
    by one vote of each kind.
    """
    rules = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    prior, weights = 0.0, [{1: START[0], -1: START[1], 0: 0.0} for _ in range(rules)]
    for _ in range(ROUNDS):
        before = prior
        shares = [1 / (1 + math.exp(-max(-30.0, min(30.0, log_odds(v, prior, weights))))) for v, _ in patterns]
        good = sum(p * n for p, (_, n) in zip(shares, patterns))
        prior = math.log((good + 1) / (total - good + 1))
        for j in range(rules):
            cast = {v: [1.0, 1.0] for v in (1, -1, 0)}
            for p, (v, n) in zip(shares, patterns):
                cast[v[j]][0] += n * p
                cast[v[j]][1] += n * (1 - p)
            weights[j] = {v: math.log(c[0] / (good + 3) / (c[1] / (total - good + 3))) for v, c in cast.items()}
        if abs(prior - before) < 1e-12:
            break
    return prior, weights


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``p_good`` and ``kept`` of every row.

    The statistics, a few numbers a row, are checkpointed, so texts are read once. Null texts count as empty: they fail
    the base. Repeated rows are judged each. An empty table gives an empty result.
    """
    rules = votes()
    rows = cut(statistics(docs, id_col, text_col)).withColumns({f"v_{k}": v for k, v in rules.items()})
    names = [f"v_{k}" for k in rules]
    counted = rows.groupBy(*names).agg(F.count("*").alias("n")).collect()
    prior, weights = fit(sorted((tuple(r[k] for k in names), r["n"]) for r in counted))
    weights = weights or [{1: 0.0, -1: 0.0, 0: 0.0}] * len(names)
    odds = F.lit(prior)
    for name, w in zip(names, weights):
        odds = odds + F.when(F.col(name) > 0, w[1]).when(F.col(name) < 0, w[-1]).otherwise(w[0])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = 1 / (1 + F.exp(-odds))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (good >= KEEP_FROM)).alias("kept"), good.alias("p_good"),
    )

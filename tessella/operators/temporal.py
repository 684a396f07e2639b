"""Joins over time: the state that held at a moment, and moments inside spans.

Times are whole numbers (microseconds, say). Neither join makes pairs that don't belong together, and neither gives one task
all rows of a key: a key's line of time is cut into stretches, across which only one row each is carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one stretch of a key's time, about, if rows are spread evenly over it.
STRETCH_ROWS = 200_000
#: Levels of spans: a span of level n is at most 2 ** n long.
LEVELS = 62
#: Levels that are told apart: a moment is sent once a level, and a cell is at most 2 ** STEP times as long as a span in it.
STEP = 3


def as_of(moments: DataFrame, states: DataFrame, on: list[str], time: str = "time", tolerance: int | None = None, rows: int = STRETCH_ROWS) -> DataFrame:
    """``moments`` with ``state``, a struct of the last of its key's ``states`` at or before its ``time``, or null.

    states: ``on``, ``time`` and other columns; of several at one time the one whose other columns are greatest, in their order. A state more
    than ``tolerance`` older is none. A null key or time has no state; states without a time are none.
    Both sides are put in one line and sorted once, by key and stretch; what held at the end of a stretch is carried over the later ones.
    """
    others = [c for c in states.columns if c not in (*on, time)]
    kind = F.struct(F.col(time), *others)
    known = F.col(time).isNotNull()
    for c in on:
        known &= F.col(c).isNotNull()
    mine = F.struct(*(F.col(c) for c in moments.columns))
    left = moments.select(*on, F.col(time).cast("long").alias("t"), mine.alias("moment"), known.alias("known"))
    right = states.where(known).select(*on, F.col(time).cast("long").alias("t"), kind.alias("s"))
    low, high, n = left.select("t").unionAll(right.select("t")).agg(F.min("t"), F.max("t"), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0)) // max(1, -(-n // rows)) + 1)
    both = left.withColumn("s", F.lit(None).cast(right.schema["s"].dataType)).unionByName(right.withColumn("moment", F.lit(None).cast(left.schema["moment"].dataType)).withColumn("known", F.lit(True)))
    both = both.withColumn("stretch", F.floor((F.col("t") - F.lit(low or 0)) / F.lit(width)))
    keys = [*on, "stretch"]
    ends = both.groupBy(*keys).agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.struct("t", "s"))).alias("end"))
    earlier = Window.partitionBy(*on).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    line = Window.partitionBy(*keys).orderBy("t", F.col("moment").isNotNull(), "s").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("held", F.last("s", ignorenulls=True).over(line)).where(F.col("moment").isNotNull())
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"k{i}"))
    found = held.join(ends, same, "left").withColumn("state", F.when(F.col("known"), F.coalesce("held", "carried")))
    if tolerance is not None:
        found = found.withColumn("state", F.when(F.col("t") - F.col(f"state.{time}") <= tolerance, F.col("state")))
    return found.select("moment.*", "state")


def inside(moments: DataFrame, spans: DataFrame, on: list[str], time: str = "time", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of ``moments`` and ``spans`` of one key with start <= time < end; all columns of both, the key once.

    A span lies in at most two cells of the level, of every STEP-th one, whose cells are at least as long as it; a moment looks in one cell of each level that
    there is, so a long span costs no more than a short one. Empty spans and nulls meet nothing. Cells of many rows are split by the adaptive skew join.
    """
    length = F.col(end).cast("long") - F.col(start).cast("long")
    level = F.ceil(F.log2(F.greatest(length, F.lit(1)))).cast("int")
    # the logarithm of a large number may be rounded down
    level = F.when(F.expr(f"shiftleft(1L, {LEVELS})") <= length, LEVELS).otherwise(level)
    laid = spans.where(length > 0).withColumn("_level", level).withColumn("_level", F.when(F.expr("shiftleft(1L, _level)") < length, F.col("_level") + 1).otherwise(F.col("_level")))
    laid = laid.withColumn("_level", F.least(F.lit(LEVELS), F.ceil(F.col("_level") / STEP) * STEP).cast("int"))
    cells = F.array_distinct(F.array(F.expr(f"shiftright(cast({start} as long), _level)"), F.expr(f"shiftright(cast({end} as long) - 1, _level)")))
    laid = laid.withColumn("_cell", F.explode(cells))
    levels = sorted(r[0] for r in laid.select("_level").distinct().collect())  # LEVELS + 1 at most
    seen = moments.where(F.col(time).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")))
    seen = seen.withColumn("_cell", F.expr(f"shiftright(cast({time} as long), _level)"))
    met = seen.join(laid, [*on, "_level", "_cell"])
    return met.where((F.col(start) <= F.col(time)) & (F.col(time) < F.col(end))).drop("_level", "_cell")

"""Multi-party dialogues rendered from every participant's side.

For each participant the whole dialogue is written with that speaker as the assistant and all others as named users;
only the assistant's words carry training loss. Masks are run lengths over the characters of the rendering. Every turn has
a place in the order of its dialogue, found by one sort over all dialogues, and every PART_TURNS places are a part,
whatever a dialogue's size or numbering. Marks in what speakers say are escaped, so that nobody can write another's turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from tessella.llm.common import apart, mapped, stored

#: Speakers that set the scene and take no side.
NARRATORS = ("system",)
#: Turns of a dialogue in one row of the result.
PART_TURNS = 4096
#: Characters of a speaker or a text that ranges are cut by.
KEY_CHARS = 64
END = "<|end|>\n"
# What opens a mark and what closes one, each with the back slashes it has been given already.
_OPENS, _CLOSES = r"<(\\*)\|", r"\|(\\*)>"


def escaped(said: Column) -> Column:
    """Text in which no mark can begin: ``<|`` gets a back slash inside, and one more where it has some, so that taking one off gives the text back."""
    return F.regexp_replace(F.coalesce(said, F.lit("")), _OPENS, r"<\\$1|")


def plain(said: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(said, r"<\\(\\*)\|", "<$1|")


def escaped_name(name: Column) -> Column:
    """A name that neither begins a mark nor ends the one it stands in."""
    return F.regexp_replace(escaped(name), _CLOSES, r"|\\$1>")


def _head(turn: Column, side: Column) -> Column:
    name = F.coalesce(turn["speaker"], F.lit(""))
    return (
        F.when(name.isin(*NARRATORS), F.concat(F.lit("<|"), name, F.lit("|>\n")))
        .when(turn["speaker"] == side, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), escaped_name(name), F.lit("|>\n")))
    )


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows that repeat inside a batch, so that a row repeated very often doesn't all go to the task that sorts it."""
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([]).to_batches()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with ``nth``, their number in the task's run of their dialogue, whether that run is the task's first, and the task."""
    task, runs, n, current = TaskContext.get().partitionId(), 0, 0, None
    for batch in batches:
        nth, lead = [], []
        for c in batch.column(0).to_pylist():
            if not runs or c != current:
                runs, n, current = runs + 1, 0, c
            nth.append(n)
            lead.append(runs == 1)
            n += 1
        columns = [pa.array(nth, pa.int64()), pa.array(lead, pa.bool_()), pa.repeat(pa.scalar(task, pa.int32()), len(nth))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "nth", "lead", "task"])


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ``rows`` (``conv_id``, ``turn``, ``speaker``, ``text``) with ``place``, from 0; and ``c``, ``total`` of every dialogue.

    One sort by dialogue and turn deals all rows, even those of one dialogue, evenly among tasks; rows that repeat meet in one.
    Ranges are cut by the first KEY_CHARS characters of speaker and text only, as Spark samples what it cuts by to the
    driver; that never parts rows against their order. A row's place is that within its task's run of the dialogue; only a task's first
    dialogue can have begun in tasks before, so at most one number a task is added, which is broadcast. The sorted rows are
    written once, as a task that is run again must find them dealt as before.
    """
    order = ["conv_id", "turn", "speaker", "text"]
    short = F.length(F.coalesce("speaker", F.lit(""))) <= KEY_CHARS  # behind a speaker that is cut short the text says nothing about the order
    keyed = rows.withColumn("speaker_key", F.left("speaker", F.lit(KEY_CHARS))).withColumn("text_key", F.when(short, F.left("text", F.lit(KEY_CHARS))))
    ranged = mapped(keyed, _fewer, keyed.schema).repartitionByRange("conv_id", "turn", "speaker_key", "text_key").distinct().sortWithinPartitions(*order).select(*order)
    fields = StructType([*ranged.schema.fields, StructField("nth", LongType()), StructField("lead", BooleanType()), StructField("task", IntegerType())])
    dealt = stored(mapped(ranged, _numbered, fields), "turns")
    held = dealt.groupBy("conv_id", "task", "lead").agg(F.count("*").alias("held"))
    earlier = F.sum("held").over(Window.partitionBy("conv_id").orderBy("task")) - F.col("held")
    begun = held.select("lead", F.col("task").alias("k"), earlier.alias("earlier")).where("lead and earlier > 0")  # at most one row a task
    found = dealt.join(F.broadcast(begun.select("k", "earlier")), F.col("lead") & (F.col("task") == F.col("k")), "left")
    totals = held.groupBy(F.col("conv_id").alias("c")).agg(F.sum("held").alias("total"))
    return found.select(*order, (F.col("nth") + F.coalesce("earlier", F.lit(0))).alias("place")), totals


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``perspective``, ``part``, ``first_turn``, ``n_turns``, ``total_turns``, ``rendered``, ``mask`` for each participant and part.

    mask is ``characters:learn`` runs, comma-joined, learn 1 on what the assistant says with its end mark. Turns are in
    the order of (turn, speaker, text), nulls first, and numbered from 0; a part is PART_TURNS of them in a row, from
    ``first_turn`` on, so parts one after another are the dialogue. A null text is empty, a null speaker is a user without
    a name and no participant, a null dialogue or turn number is a group like others. Rows that repeat exactly are one
    turn. A dialogue of narrators only gives no row, an empty table none.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(speaker_col).cast("string").alias("speaker"), F.col(text_col).cast("string").alias("text")
    )
    turns_at, totals = placed(rows)
    parts = turns_at.withColumn("part", F.floor(F.col("place") / PART_TURNS)).groupBy(F.struct(F.col("conv_id").alias("id")).alias("dialogue"), "part")
    parts = parts.agg(F.sort_array(F.collect_list(F.struct("place", "speaker", "text"))).alias("turns"))
    sides = rows.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*NARRATORS)).select(F.col("conv_id").alias("s"), F.col("speaker").alias("perspective")).distinct()
    # who faces which part, ids and names only; an id in a struct equals itself when null, and by it texts stay where they were gathered
    last = F.floor((F.col("total") - 1) / PART_TURNS)
    faces = totals.join(sides, F.col("c").eqNullSafe(F.col("s"))).select(F.struct(F.col("c").alias("id")).alias("d"), "perspective", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("p"))
    faced = parts.join(faces, (F.col("dialogue") == F.col("d")) & (F.col("part") == F.col("p"))).withColumn("conv_id", F.col("dialogue.id"))
    said = lambda t: F.concat(escaped(t["text"]), F.lit(END))
    side = F.col("perspective")
    written = F.transform("turns", lambda t: F.struct(_head(t, side).alias("head"), said(t).alias("said"), F.coalesce(t["speaker"] == side, F.lit(False)).alias("own")))
    rendered = faced.select("conv_id", "perspective", "part", "turns", "total", written.alias("w"))
    runs = F.transform(
        "w", lambda t: F.concat(F.length(t["head"]).cast("string"), F.lit(":0,"), F.length(t["said"]).cast("string"), F.when(t["own"], ":1").otherwise(":0"))
    )
    return rendered.select(
        "conv_id", "perspective", "part", F.get("turns", F.lit(0))["place"].alias("first_turn"), F.size("turns").cast("long").alias("n_turns"), F.col("total").alias("total_turns"),
        F.array_join(F.transform("w", lambda t: F.concat(t["head"], t["said"])), "").alias("rendered"), F.array_join(runs, ",").alias("mask"),
    )


#: The same rows in SQL.
ORACLE = rf"""
with d as (select distinct conv_id, turn, role, text from conversations),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) - 1 as place,
  count(*) over (partition by conv_id) as total, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) as said,
  regexp_replace(regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') as name from d),
s as (select distinct conv_id, role as perspective from d where role is not null and role not in ('system')),
x as (
  select t.conv_id, perspective, place // {PART_TURNS} as part, place, total, role, said,
    case when role in ('system') then '<|' || role || '|>' || chr(10)
         when role = perspective then '<|assistant|>' || chr(10)
         else '<|user name=' || name || '|>' || chr(10) end as head
  from t join s on t.conv_id is not distinct from s.conv_id)
select conv_id, perspective, part, min(place) as first_turn, count(*) as n_turns, any_value(total) as total_turns,
  string_agg(head || said, '' order by place) as rendered,
  string_agg(length(head)::varchar || ':0,' || length(said)::varchar || case when role = perspective then ':1' else ':0' end, ',' order by place) as mask
from x group by conv_id, perspective, part
"""

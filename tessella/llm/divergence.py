"""How the sources of a language differ in their words, by exact sums over joint count histograms.

Words are counted once, batch by batch where the texts lie. What two sources of a language have in common is told by how
many terms have which pair of counts: a term's share in a source depends on its count alone, so the difference of two
shares is worked out once for each distinct pair of counts and multiplied by the terms that have it. Pairs of counts are
tallied in tiles: a tile pair holds the counts of up to TILE_TERMS terms in up to two times TILE_SOURCES sources, as a
matrix, and only distinct pairs with their multiplicity leave it. Terms that neither source has are never listed: they
are what is left of the vocabulary, one pair of zeros with that multiplicity.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import apart, mapped, sliced, stored, text_bytes

LEAST_DOCS, TOP_TERMS = 30, 50
#: A share is in parts of SCALE, over counts that are PRIOR higher than seen.
SCALE, PRIOR = 1_000_000_000, 5
TILE_SOURCES, TILE_TERMS = 64, 256
#: Counts that a worker gathers before it passes them on; bytes of a text that are cut into terms at once.
GATHERED, CHUNK = 200_000, 1 << 20
#: Whatever is no letter of ASCII and below 0x80 ends a term.
_TABLE = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else b if b >= 0x80 or chr(b) in string.ascii_lowercase else 0x20 for b in range(256))


def terms(text: bytes) -> Counter[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z in lower case, with their counts."""
    out: Counter[bytes] = Counter()
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and _TABLE[text[end]] != 0x20:
            end += 1
        out.update(text[at:end].translate(_TABLE).split())
        at = end
    return out


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``df`` (rows with it): partial sums, a term more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, rows) in gathered.items():
                words = list(times)
                for i in range(0, len(words), 1 << 16):
                    some = words[i : i + (1 << 16)]
                    columns = [pa.repeat(lang, len(some)), pa.repeat(source, len(some)), pa.array(some, pa.binary()), pa.array([times[w] for w in some]), pa.array([rows[w] for w in some])]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])
            gathered.clear()

        for batch in sliced(batches):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                found = terms(text)
                if not found:
                    continue
                times, rows = gathered.setdefault((lang, source), (Counter(), Counter()))
                before = len(times)
                times.update(found)
                rows.update(found.keys())
                held += len(times) - before
                if held > GATHERED:
                    yield from told()
                    held = 0
        yield from told()

    rows = docs.select(_filled(docs["lang"]).alias("lang"), _filled(docs["source"]).alias("source"), docs["text"].cast("string").alias("text"))
    return mapped(rows, run, "lang string, source string, term binary, n long, df long").withColumn("term", F.col("term").cast("string"))


def _filled(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def share(n: str, total: str, size: str) -> str:
    """SQL: parts of SCALE, rounded down, plus one, that a term of count ``n`` has of ``total`` counts over ``size`` terms."""
    return f"1 + (cast({n} + {PRIOR} as decimal(20, 0)) * {SCALE}) div nullif(cast({total} + {PRIOR} * {size} as decimal(20, 0)), 0)"


def kept_cells(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``, ``n_lang``, ``first``: counts above zero of the terms in enough rows of their language.

    ``first`` is true for one row of each language's term.
    """
    own = Window.partitionBy("lang", "term")
    cells = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    cells = cells.select("*", F.sum("df").over(own).alias("rows"), F.sum("n").over(own).alias("n_lang"), (F.min("source").over(own) == F.col("source")).alias("first"))
    return cells.where(F.col("rows") >= least).drop("df", "rows")


def tile_tally(term: np.ndarray, source: np.ndarray, n: np.ndarray, tile: np.ndarray, crossed: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair of sources of a tile pair (crossed: of different tiles): distinct pairs of counts, not both zero, and how many terms have them.

    term, source: numbers from 0; a term of -1 says that a source is there. tile: 0 or 1 of each row.
    """
    width, height = int(source.max()) + 1, int(term.max()) + 1
    counts = np.zeros((width, max(0, height)), dtype=np.int64)
    real = term >= 0
    counts[source[real], term[real]] = n[real]
    side = np.zeros(width, dtype=np.int8)
    side[source] = tile
    for s in range(width):
        for t in range(s + 1, width):
            if crossed and side[s] == side[t]:
                continue
            a, b = counts[s], counts[t]
            some = (a > 0) | (b > 0)
            both, times = np.unique(np.stack([a[some], b[some]]), axis=1, return_counts=True)
            yield s, t, both[0], both[1], times


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` of every pair of sources of a language and of each source's telling terms.

    Null languages and sources are empty strings, null texts have no term. Rows that repeat count each. A source without
    terms, or a language without vocabulary, still has its pairs, of value 0 in the latter; a source that is alone in its language has none.
    Equal values are ranked by the item's bytes. Other columns are ignored; an empty table gives an empty result.
    """
    cells = stored(kept_cells(docs, least), "divergence-cells")
    groups = docs.select(_filled(docs["lang"]).alias("lang"), _filled(docs["source"]).alias("source")).distinct()
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
    groups = groups.join(apart(sums), ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("firsts", F.lit(0)).alias("firsts"))
    groups = stored(groups, "divergence-groups")
    langs = groups.groupBy("lang").agg(
        F.sum("firsts").alias("size"), F.sum("total").alias("lang_total"), F.ceil(F.count("*") / TILE_SOURCES).cast("int").alias("tiles"),
        F.greatest(F.ceil(F.sum("firsts") / TILE_TERMS), F.lit(1)).cast("int").alias("buckets"),
    )
    groups = groups.join(apart(langs), "lang")
    both = _pairs(cells, groups, langs).unionAll(_terms(cells, groups, top))
    return both.select("lang", "source", "part", "item", "value", "rank")


def _pairs(cells: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")
    rows = cells.join(apart(langs), "lang").select("lang", "source", "tiles", bucket.alias("bucket"), "term", "n", F.lit(0).cast("long").alias("size"))
    there = groups.select("lang", "source", "tiles", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "size")
    rows = rows.unionAll(there).withColumn("own", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("lang", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "source", "term", "n", "own", "size")

    def tally(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        of_source, of_term = (tile.column(k).combine_chunks().dictionary_encode() if tile.num_rows else None for k in ("source", "term"))
        names = sorted(of_source.dictionary.to_pylist())  # every tile has a pair the same way round
        source = np.array([names.index(x) for x in of_source.dictionary.to_pylist()])[of_source.indices.to_numpy()]
        term = of_term.indices.fill_null(-1).to_numpy()
        n, own = tile.column("n").to_numpy(), tile.column("own").to_numpy()
        totals = dict(zip(source[term < 0].tolist(), n[term < 0].tolist()))
        lang, size, i, j = tile.column("lang")[0].as_py(), int(tile.column("size").to_numpy().max()), int(tile.column("i")[0].as_py()), int(tile.column("j")[0].as_py())
        out: list[list] = [[] for _ in range(7)]
        for s, t, a, b, times in tile_tally(term, source, n, (own == j).astype(np.int8), i != j):
            # the pair itself, so that it is there even if no term is
            for column, value in zip(out, ([names[s]] * (len(a) + 1), [names[t]] * (len(a) + 1), [totals[s]] * (len(a) + 1), [totals[t]] * (len(a) + 1), [*a.tolist(), 0], [*b.tolist(), 0], [*times.tolist(), 0])):
                column += value
        columns = [pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(out)]
        return pa.Table.from_arrays([pa.array([lang] * len(out[0]), pa.string()), pa.array([size] * len(out[0]), pa.int64()), *columns], names=["lang", "size", "s", "t", "s_total", "t_total", "a", "b", "times"])

    schema = "lang string, size long, s string, t string, s_total long, t_total long, a long, b long, times long"
    found = rows.groupBy("lang", "bucket", "i", "j").applyInArrow(tally, schema)
    pair = ["lang", "size", "s", "t", "s_total", "t_total"]
    found = found.groupBy(*pair, "a", "b").agg(F.sum("times").alias("times"))
    differ = lambda a, b: F.expr(f"abs(({share(a, 's_total', 'size')}) - ({share(b, 't_total', 'size')}))")
    found = found.withColumn("f", differ("a", "b") * F.col("times")).groupBy(*pair).agg(F.sum("f").alias("f"), F.sum("times").alias("listed"))
    value = F.coalesce(F.col("f") + differ("0", "0") * (F.col("size") - F.col("listed")), F.lit(0)).cast("long")
    found = found.select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item")))).alias("x"))
    order = Window.partitionBy("lang", "x.source").orderBy(F.desc("value"), "x.item")
    return found.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value", F.row_number().over(order).alias("rank"))


def _terms(cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    rows = cells.join(apart(groups), ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), (F.expr(share("n", "total", "size")) - F.expr(share("n_lang", "lang_total", "size"))).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return rows.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _sql_share(n: str, total: str) -> str:
    return f"1 + ({SCALE}::hugeint * ({n} + {PRIOR})) // nullif({total} + {PRIOR} * v, 0)"


ORACLE = f"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as text from documents),
w as (select k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*)::hugeint as c from w group by all having count(distinct k) >= {LEAST_DOCS}),
g as (select distinct lang, source from d),
v as (select g.lang, coalesce(max(k.v), 0)::hugeint as v, coalesce(max(k.n), 0)::hugeint as n from g left join (select lang, count(*) as v, sum(c) as n from kept group by all) k using (lang) group by g.lang),
seen as (select lang, source, term, count(*)::hugeint as c from w semi join kept using (lang, term) group by all),
cells as (select g.lang, g.source, k.term, coalesce(s.c, 0)::hugeint as c, sum(coalesce(s.c, 0)) over (partition by g.lang, g.source)::hugeint as n, k.c as lang_c
  from g join kept k using (lang) left join seen s using (lang, source, term)),
shares as (select cells.lang, source, term, c, ({_sql_share('c', 'cells.n')}) as p, ({_sql_share('lang_c', 'v.n')}) as q from cells join v using (lang)),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
tops as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from shares where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from tops))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""

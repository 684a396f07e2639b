"""Removal of repeated passages: every word of a 20-word window whose words already start earlier.

Windows are the edges of a de Bruijn graph over words. Neighbouring windows that share their least 6-word hash (their
anchor) form one path, stored as a single row: an anchor hash, a hash of the path's words and its source coordinate. An
anchor seen once belongs to windows seen once, so those paths go first, by a join with the anchor's count. Equal paths
are nonbranching repeats: the first source coordinate keeps its words and all others lose theirs, whatever the length of
the repeat, without looking at single windows. Only where one anchor leads to several different paths, where the graph
branches, are the first copies of those paths taken apart into windows, which are compared by 128 bits of hash (the
anchor's and the window's) and resolved by the least source coordinate in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import apart, byte_words, dropped, fresh, mapped, sliced, steps, stored, text_bytes

WINDOW, ANCHOR = 20, 6
_BASE, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes."""
    n = len(words) - k + 1
    out = words[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += words[j : j + n]
    for shift, factor in ((30, _MIX1), (27, _MIX2)):
        out ^= out >> np.uint64(shift)
        out *= factor
    return out ^ (out >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each run of width."""
    low, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = low[:-step], low[step:]
        right = b < a
        low, at, span = np.where(right, b, a), np.where(right, at[step:], at[:-step]), span + step
    return at


def paths(words: np.ndarray, ends: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of the concatenated word hashes of documents that end at ``ends``: document, first window, windows, anchor hash and path hash of every path."""
    if len(words) < window:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    anchors = _rolled(words, anchor)
    at = _least(anchors, window - anchor + 1)
    whole = _rolled(words, window)
    place = np.arange(len(whole))
    doc = np.searchsorted(ends, place, side="right")
    inside = place + window <= ends[doc]
    place, doc, at = place[inside], doc[inside], at[inside]
    if not len(place):
        return paths(words[:0], ends, window, anchor)
    first = np.nonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))[0]
    n = np.diff(np.append(first, len(place)))
    start, doc = place[first], doc[first]
    path = whole[start] * _BASE ^ whole[start + n - 1]
    path = (path ^ (path >> np.uint64(29)) ^ n.astype(np.uint64)) * _MIX1
    return doc, start - np.concatenate([[0], ends])[doc], n, anchors[at[first]], path


def _paths_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    words = [byte_words(t) for t in texts]
    hashes = _word_hashes([w for ws in words for w in ws])
    return paths(hashes, np.cumsum([len(ws) for ws in words]))


def _all_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = text_bytes(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in steps(texts):
            doc, start, n, anchor, path = _paths_of(texts[a:b])
            columns = [anchor.view(np.int64), path.view(np.int64), ids[a:b][doc], start.astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "path", "doc_id", "start", "n"])


_PATHS = "anchor long, path long, doc_id long, start int, n int"


def _branch_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the wanted paths (column 2: structs of start, n, anchor) of each text."""
    for batch in batches:
        texts = text_bytes(batch.column(1))
        ids = batch.column(0).to_pylist()
        for i, text in enumerate(texts):
            wanted = batch.column(2)[i].values
            start, n, anchor = (wanted.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            whole = _rolled(_word_hashes(byte_words(text)), WINDOW)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(start, n) + inside
            columns = [whole[place].view(np.int64), np.repeat(anchor, n), np.full(len(place), ids[i]), place.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["window", "anchor", "doc_id", "start"])


def covered(texts: DataFrame) -> DataFrame:
    """``doc_id``, ``spans`` (structs of first window and number of windows, in words): what repeats something earlier.

    texts: ``doc_id`` not null, ``text``. Keys that many rows share are reduced by partial aggregates, and their joins
    are of the kind whose partitions Spark splits; each step is written to the shared folder.
    """
    occurrences = stored(mapped(texts, _all_paths, _PATHS), "paths")
    again = occurrences.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor")
    repeated = stored(occurrences.join(apart(again), "anchor", "left_semi"), "repeated")
    dropped(occurrences)
    firsts = repeated.groupBy("anchor", "path").agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("times"), F.first("n").alias("n")
    )
    firsts = stored(firsts, "firsts")
    branching = firsts.groupBy("anchor").agg(F.count("*").alias("ways")).where("ways > 1").select("anchor")
    branches = firsts.join(apart(branching), "anchor", "left_semi").select("first.doc_id", "first.start", "n", "anchor")
    wanted = branches.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("wanted"))
    windows = stored(
        mapped(texts.join(wanted, "doc_id").select("doc_id", "text", "wanted"), _branch_windows, "window long, anchor long, doc_id long, start int"), "windows"
    )
    known = firsts.where("times > 1").select("anchor", "path", "first")
    spans = repeated.join(known, ["anchor", "path"]).where(F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", "n")
    least = windows.groupBy("window", "anchor").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("times"))
    single = windows.join(apart(least.where("times > 1")), ["window", "anchor"]).where(F.struct("doc_id", "start") != F.col("first"))
    both = spans.unionAll(single.select("doc_id", "start", F.lit(1).alias("n")))
    both = both.groupBy("doc_id", "start").agg(F.max("n").alias("n"))  # an id that repeats finds its spans as often
    out = stored(both.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans")
    for table in (repeated, firsts, windows):
        dropped(table)
    return out


def _kept(n_words: int, spans: pa.StructArray | None) -> np.ndarray | None:
    """Which words stay; None if all."""
    if spans is None or not len(spans):
        return None
    start, n = (spans.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + n - 1 + WINDOW, n_words), -1)
    return np.cumsum(edge[:-1]) == 0


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts, covered(texts.where("doc_id is not null"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by spaces) of every row.

    Null and empty texts have no words. Rows that repeat a doc_id are one document given twice and lose the same
    words. Rows without a doc_id have no place in the order: they lose nothing and take nothing from others.
    """
    texts, spans = _with_spans(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = []
            for text, part in zip(text_bytes(batch.column(1)), batch.column(2)):
                words = byte_words(text)
                keep = _kept(len(words), part.values)
                left = words if keep is None else list(compress(words, keep.tolist()))
                found.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return mapped(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut_lines(raw: bytes, keep: np.ndarray) -> bytes:
    """The kept words of each line joined by a space; lines left without words go."""
    lines, done = [], 0
    for line in raw.split(b"\n"):
        words = byte_words(line)
        left = list(compress(words, keep[done : done + len(words)].tolist()))
        done += len(words)
        if left:
            lines.append(b" ".join(left))
    return b"\n".join(lines)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with repeated passages cut from ``text`` (and ``n_chars`` brought up to date).

    A text that loses nothing stays as it is; of others, the kept words of each line are joined by a space and lines
    left without words go. Rows without a doc_id stay as they are.
    """
    _, spans = _with_spans(docs, "doc_id", "text")
    of_doc = fresh(docs, "of_doc")
    spans = spans.select(F.col("doc_id").alias(of_doc), F.col("spans").alias(of_doc + "_spans"))
    joined = docs.join(spans, docs["doc_id"].cast("long") == spans[of_doc], "left")
    joined = joined.select(F.struct(*(docs[c] for c in docs.columns)).alias("document"), spans[of_doc + "_spans"].alias("spans"))
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            columns = batch.column(0).flatten()
            names = [batch.column(0).type.field(k).name for k in range(len(columns))]
            raw, spans_ = text_bytes(columns[at]), batch.column(1)
            keep = [_kept(len(byte_words(t)), part.values) if part.is_valid else None for t, part in zip(raw, spans_)]
            new = [t if k is None else _cut_lines(t, k) for t, k in zip(raw, keep)]
            known = columns[at].is_valid().to_pylist()
            text = pa.array([t.decode() if ok else None for t, ok in zip(new, known)], pa.string())
            columns[at] = text
            if size >= 0:
                changed = pa.array([k is not None for k in keep], pa.bool_())
                columns[size] = pc.if_else(changed, pc.utf8_length(text).cast(columns[size].type), columns[size])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(joined, run, docs.schema)


#: The same rows in SQL, for tables of moderate size.
ORACLE = f"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d where len(w) >= {WINDOW}),
g as (select doc_id, i, sha256(array_to_string(w[i:i + {WINDOW - 1}], ' ')) as h from p),
r as (select doc_id, i, row_number() over (partition by h order by doc_id, i) as k from g),
c as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as j from r where k > 1),
e as (select doc_id, unnest(range(1, len(w) + 1)) as j, unnest(w) as x from d),
m as (select doc_id, string_agg(x, ' ' order by j) as kept, count(*) as n from e anti join c using (doc_id, j) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join m on d.doc_id = m.doc_id
"""

"""The source audit against a plain version and against SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=30, top=50):
    count, docs, lang_count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(found)
        docs[lang].update(set(found))
        lang_count[lang].update(found)
    out = []
    for lang, sources in groups.items():
        vocabulary = [w for w, n in docs[lang].items() if n >= least]

        def shares(counts):
            total = sum(counts[w] for w in vocabulary)
            return {w: 1 + 10**9 * (counts[w] + 5) // (total + 5 * len(vocabulary)) for w in vocabulary}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(lang_count[lang])
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[t][w]) for w in vocabulary), t) for t in sources if t != s]
            terms = [(p[s][w] - q[w], w) for w in vocabulary if count[lang, s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.fixture(scope="module")
def documents():
    r = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(180)] + ["Äpfel", "äpfel", "日本", "UPPER", "upper", "\U0001f600", "￮"]
    rows = []
    for i in range(1500):
        source = "src0" if i % 3 == 0 else f"src{i % 11}"
        lang = ["en", "de", None, ""][i % 4]
        low = {"src0": 0, "src1": 60}.get(source, 20)
        text = " ".join(words[int(k)] for k in r.integers(low, len(words), int(r.integers(0, 60))))
        rows.append((i, text + [".", "9x", "\x7f", "`y"][i % 4], lang, source))
    rows += [(2000 + i, "the same text " * 3, "en", "copies") for i in range(400)] + [(2000, "the same text ", "en", "copies")] * 5
    rows += [(3000, None, "en", "silent"), (3001, "", "en", None), (3002, "few words", "fr", "a"), (3003, None, "fr", "b"), (3004, "123", "fr", "c"), (3005, "alone", "it", "x")]
    rows += [(None, "long " * 500_000 + "tail", "en", "src1"), (3006, "é" * 30, "en", "src2")]
    return rows


@pytest.mark.parametrize("sources,terms,gathered", [(64, 256, 200_000), (3, 7, 50)])
def test_audit(spark, documents, monkeypatch, sources, terms, gathered):
    for name, value in (("TILE_SOURCES", sources), ("TILE_TERMS", terms), ("GATHERED", gathered), ("CHUNK", 1000)):
        monkeypatch.setattr(divergence, name, value)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in documents], SCHEMA + ", n int, term string, size int").repartition(4)
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == plain(documents)


def test_against_sql(spark, documents):
    con = duckdb.connect()
    con.register("documents", pa.table({name: [r[k] for r in documents] for k, name in enumerate(("doc_id", "text", "lang", "source"))}))
    result = con.execute(divergence.ORACLE)
    assert [c[0] for c in result.description] == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(result.fetchall()) == plain(documents)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_beyond_64_bits(spark):
    """The product with SCALE is worked out in decimals."""
    from pyspark.sql import functions as F

    n, total = 10**15, 3 * 10**15 + 7
    assert spark.range(1).select(F.expr(divergence.share(f"{n}L", f"{total}L", "4L"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 20)

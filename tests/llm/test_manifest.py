"""The Merkle manifest against a plain version and against SQL."""

import hashlib
import zlib

import duckdb
import pyarrow as pa
import pytest

from tessella.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    """Levels, leaves first."""
    out = [list(digests)]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def plain(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = [], []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        members.append(own)
        trees.append(tree(leaf(*r) for r in own))
    top = tree(t[-1][0] for t in trees)
    out = []
    for k, own in enumerate(members):
        for i, r in enumerate(own):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if tampered else r[1]
            fold, proof = leaf(r[0], low, *r[2:]), []
            for levels, at in ((trees[k], i), (top, k)):
                for level in levels[:-1]:
                    run, place = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += run[:place] + run[place + 1 :]
                    fold = sha(*run[:place], fold, *run[place + 1 :])
                    at //= 16
            out.append((r[0], leaf(*r), trees[k][-1][0], top[-1][0], sha(*proof), fold, fold == top[-1][0]))
    return out


def documents():
    rows = [(i, f"Text {i} Ä" if i % 3 else f"text {i}", "en", f"s{i % 7}", i) for i in range(400)]
    rows += [(1000 + i, "Hot", "de", "hot", None) for i in range(700)]
    rows += [(2000 + i, "One of many sources", None, f"many {i}", 3) for i in range(40)]
    rows += [(5000, None, None, None, None), (5001, "", "", "", 0), (5001, "", "", "", 0), (5001, "x", "", "", 0), (None, "no Id", "en", "s1", 2), (None, "no Id", "en", None, 2)]
    rows += [(6000, "Long " * 40_000, "en", "ü", 1), (-5, "Negative", "en", "s1", 1), (5, "A", "en", "\U0001f600", 1), (5, "A", "en", "￮", 1)]
    return rows


KEYS = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("some", [slice(None), slice(0, 1), slice(400, 657), slice(1100, 1101)])
def test_proofs(spark, some):
    rows = documents()[some]
    got = [tuple(r) for r in manifest.prove(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert sorted(got, key=KEYS) == sorted(plain(rows), key=KEYS)


def test_blocks_of_many_levels(spark, monkeypatch):
    """Shares asked for by blocks of one level, so that upper levels are deep."""
    monkeypatch.setattr(manifest, "OWN", 1)
    monkeypatch.setattr(manifest, "BLOCK_BITS", 4)
    rows = [(i, f"T{i % 50}", "en", "one" if i < 4200 else "two", i) for i in range(4500)]
    got = [tuple(r) for r in manifest.prove(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=KEYS) == sorted(plain(rows), key=KEYS)


def test_against_sql(spark):
    rows = [r for r in documents() if r[0] != 6000]
    con = duckdb.connect()
    con.register("documents", pa.table({name: [r[k] for r in rows] for k, name in enumerate(("doc_id", "text", "lang", "source", "n_chars"))}))
    result = con.execute(manifest.ORACLE)
    names = [c[0] for c in result.description]
    want = result.fetchall()
    df = manifest.prove(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=KEYS) == sorted(want, key=KEYS)


def test_a_changed_node_is_found(spark):
    """Rows that were tampered with, and no others, fail."""
    out = {r.doc_id: r.verified for r in manifest.prove(spark.createDataFrame(documents(), SCHEMA).where("source like 's%' and doc_id is not null")).collect()}
    assert all(ok == (zlib.crc32(str(i).encode()) % 5 != 0 or (i % 3 == 0 and i >= 0)) for i, ok in out.items())


def test_empty_and_clashing_names(spark):
    assert manifest.prove(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, "T", "en", "s", 1) for i in range(40)]
    extra = spark.createDataFrame([(*r, 1, "x", 2, "k", 3) for r in rows], SCHEMA + ", part int, row string, tree int, key string, last int")
    assert sorted((tuple(r) for r in manifest.prove(extra).collect()), key=KEYS) == sorted(plain(rows), key=KEYS)

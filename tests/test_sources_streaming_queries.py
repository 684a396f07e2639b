"""Vaults on disk, streams, the command line, and queries against their SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella import cli
from tessella.plans import registry
from tessella.sources import vault
from tessella.streaming import journal

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def root(tmp_path):
    for name, body in {
        "raw/a.md": "# A", "raw/sub/b.md": "# B", "wiki/index.md": "x", "wiki/logs/2024.md": "x", "wiki/concepts/Concept_A.md": "---\npage_type: concept\ntitle: Alpha\naliases: [al]\n---\n# Alpha\n\nFirst. Second. Third.",
        "wiki/odd/X.md": "---\npage_type: novel\n---\nx", "wiki/designs/D.md": "---\nold_type: design\n---\n# Dee",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return str(tmp_path)


def test_vault_reading(spark, root):
    pages = {r.path: r for r in vault.pages(spark, root).collect()}
    assert set(pages) == {"concepts/Concept_A.md", "designs/D.md"}
    a = pages["concepts/Concept_A.md"]
    assert (a.title, a.page_type, a.aliases, a.summary) == ("Alpha", "concept", ["al"], "# Alpha First. Second.") and pages["designs/D.md"].title == "Dee"
    assert sorted(r.raw_path for r in vault.raw_files(spark, root).collect()) == ["raw/a.md", "raw/sub/b.md"]
    kinds = spark.createDataFrame([("designs/x.md",), ("y.md",)], "p string").select(vault.type_of_path(F.col("p"))).collect()
    assert [k[0] for k in kinds] == ["design", "concept"]
    assert vault.resolve_raw("a//b.md") == "raw/a/b.md"
    with pytest.raises(ValueError, match="not a path"):
        vault.resolve_raw("../x")


def test_vault_writing(spark, root):
    new = spark.createDataFrame([("concepts/New.md", "# N"), ("concepts/Concept_A.md", "# A2")], "target_path string, markdown string")
    old = {r.path: r.sha256 for r in vault.pages(spark, root).collect()}
    seen = spark.createDataFrame([("concepts/Concept_A.md", old["concepts/Concept_A.md"])], "target_path string, preimage_sha256 string")
    vault.write_pages(spark, root, new, seen)
    texts = {r.path: r.text for r in vault.text_files(spark, f"{root}/wiki", "*.md").collect()}
    assert texts["concepts/New.md"] == "# N" and texts["concepts/Concept_A.md"] == "# A2"
    with pytest.raises(ValueError, match="changed since"):
        vault.write_pages(spark, root, new, seen)
    assert sorted(vault.initialise(spark, root)) == ["cache", "receipts", "runs", "state"] and vault.initialise(spark, root) == []


def test_page_markdown(spark):
    row = ("concepts/A.md", "concept", "A", "body. more.", "ING-20260616T000000Z-x", ["raw/n"], ["h2"], ["al"], "2020-01-01", ["raw/o"], ["h1"], ["OLD"], "Other")
    columns = "target_path string, page_type string, title string, body string, operation_id string, raw_paths array<string>, raw_hashes array<string>, old_aliases array<string>, old_created string, old_raw_paths array<string>, old_raw_hashes array<string>, old_operations array<string>, model_title string"
    got = vault.page_markdown(spark.createDataFrame([row], columns)).first().markdown
    read = vault.parsed_pages(spark.createDataFrame([("concepts/A.md", got, "h")], "path string, text string, sha256 string")).first()
    assert (read.title, read.aliases, read.created, read.updated, read.source_raw_paths, read.source_operation_ids) == ("A", ["al", "Other"], "2020-01-01", "2026-06-16", ["raw/o", "raw/n"], ["OLD", "ING-20260616T000000Z-x"])
    assert got.endswith("---\n\n# A\n\nbody. more.\n")


def test_command_line(spark, root, capsys, tmp_path):
    vault.append(spark.createDataFrame([("op", "raw/a.md")], "operation_id string, raw_path string"), f"{root}/receipts")
    assert [r["raw_path"] for r in cli.raw_candidates(spark, root)] == ["raw/sub/b.md"]
    assert len(cli.raw_candidates(spark, root, include_processed=True)) == 2
    vault.append(spark.createDataFrame([("op1", 0, "a", "running"), ("op2", 0, "a", "running"), ("op2", 1, "b", "written")], cli.EVENTS), f"{root}/runs/events")
    vault.append(spark.createDataFrame([("op2", "raw/a.md", "nope", 3)], cli.ARTIFACTS), f"{root}/runs/artifacts")
    states, drift = cli.status(spark, root, verify=True)
    assert (states[0]["operation_id"], states[0]["status"], drift[0]["code"]) == ("op2", "written", "artifact_hash_drift")
    config = tmp_path / "providers.json"
    config.write_text(json.dumps({"default": {"spec": "local:heuristic"}}))
    assert cli.main(["providers-check", str(config), "--json"]) == 2 and "not a model" in capsys.readouterr().out


def stream_of(spark, df, folder, parts=3):
    for i in range(parts):
        df.where(F.col("event_id") % parts == i).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    source = stream_of(spark, events, f"{tmp_path}/in")
    run(journal.daily_counts(source, "event_type", late="400 days"), "daily", "complete")
    batch = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert spark.table("daily").exceptAll(batch).count() == 0 == batch.exceptAll(spark.table("daily")).count()
    twice = stream_of(spark, events.unionByName(events), f"{tmp_path}/twice")
    run(journal.first_receipts(twice, "event_id", late="400 days"), "once", "append")
    assert spark.table("once").count() == events.count() == spark.table("once").select("event_id").distinct().count()
    run(journal.sessions(source, "user_id", gap="6 hours", late="400 days"), "runs", "complete")
    want = registry.QUERIES["event_sessions"](spark, DATA)
    assert spark.table("runs").count() == want.count()


def test_ledger_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "event_type")
    source = stream_of(spark, events.unionByName(events), f"{tmp_path}/in")
    write = journal.to_ledger(f"{tmp_path}/ledger", "event_id")
    source.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start().awaitTermination(120)
    write(events.limit(50), 9)
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == events.count()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def shown(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "" if v is None or str(v) in ("<NA>", "NaT", "nan") else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return list(frame.columns), sorted(tuple(text(v.item() if hasattr(v, "item") else v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, database, name):
    assert shown(registry.QUERIES[name](spark, DATA).toPandas()) == shown(database.sql(registry.ORACLES[name]).df())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_text_operators(monkeypatch):
    """The entry module still works where the optional subpackage is gone."""
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("tessella.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tessella.llm", None)
    assert set(entry.queries()) == set(registry.QUERIES)

"""Command line: make a vault, list what is to be ingested, look at operations, check providers.

    python -m tessella.cli init VAULT
    python -m tessella.cli raw-candidates VAULT [--include-processed] [--limit N] [--json]
    python -m tessella.cli ingest VAULT RAW... --providers CONFIG.json --encoder MODEL [--dimensions N] [--json]
    python -m tessella.cli status VAULT [OPERATION] [--verify] [--json]
    python -m tessella.cli inspect VAULT OPERATION [--json]
    python -m tessella.cli providers-check CONFIG.json [--json]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cache, ingest, ledger
from tessella.operators.provider import ChatCompletions, Registry, Spec
from tessella.session import session
from tessella.sources import vault

EVENTS = "operation_id string, pos long, step string, status string"
ARTIFACTS = "operation_id string, path string, sha256 string, size_bytes long"


def _exists(spark: SparkSession, path: str) -> bool:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name)


def _json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def raw_candidates(spark: SparkSession, root: str, include_processed: bool = False, limit: int | None = None) -> list[dict[str, Any]]:
    done = _json_table(spark, f"{root}/receipts", "operation_id string, raw_path string")
    rows = ledger.raw_candidates(vault.raw_files(spark, root).select("raw_path", "raw_sha256", "size_bytes"), done, include_processed, limit)
    return [r.asDict() for r in rows.collect()]  # a listing for a person, cut by limit


def status(spark: SparkSession, root: str, operation: str | None = None, verify: bool = False) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """State of one operation, or of the latest; with verify also what drifted since."""
    events = _json_table(spark, f"{root}/runs/events", EVENTS)
    found = ledger.operation_status(events)
    found = found.where(F.col("operation_id") == operation) if operation else ledger.latest(found)
    states = [r.asDict() for r in found.collect()]
    if not verify or not states:
        return states, []
    kept = _json_table(spark, f"{root}/runs/artifacts", ARTIFACTS).where(F.col("operation_id") == states[0]["operation_id"])
    files = vault.text_files(spark, root).select("path", "sha256", "size_bytes").withColumn("operation_id", F.lit(states[0]["operation_id"]))
    return states, [r.asDict() for r in ledger.artifact_drift(kept, files).collect()]


def inspect(spark: SparkSession, root: str, operation: str) -> list[dict[str, Any]]:
    """An operation's steps in order, with how many artifacts it left."""
    events = _json_table(spark, f"{root}/runs/events", EVENTS).where(F.col("operation_id") == operation)
    kept = _json_table(spark, f"{root}/runs/artifacts", ARTIFACTS).groupBy("operation_id").agg(F.count("*").alias("artifacts"))
    return [r.asDict() for r in events.join(kept, "operation_id", "left").orderBy("pos").collect()]


def _registry(*paths: str, optional: tuple[str, ...] = ()) -> Registry:
    """Providers of all files by name, a later file's before an earlier one's; optional files, the last, may be missing."""
    levels = []
    for path in [*paths, *(p for p in optional if os.path.exists(p))]:
        with open(path) as file:
            found = json.load(file)
        if not isinstance(found, dict) or not all(isinstance(v, dict) for v in found.values()):
            raise ValueError(f"{path}: providers are settings by name")
        levels.append({k: Spec(**v) for k, v in found.items()})
    return Registry(*levels)


def _print(rows: Any, as_json: bool) -> None:
    if as_json:
        print(json.dumps(rows, ensure_ascii=False, default=str))
    else:
        for row in rows:
            print("  ".join(f"{k}={v}" for k, v in row.items()))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella")
    commands = parser.add_subparsers(dest="command", required=True)
    made = {}
    for name in ("init", "raw-candidates", "ingest", "status", "inspect", "providers-check"):
        made[name] = commands.add_parser(name)
        made[name].add_argument("path")
        made[name].add_argument("--json", action="store_true")
    made["raw-candidates"].add_argument("--include-processed", action="store_true")
    made["raw-candidates"].add_argument("--limit", type=int)
    made["ingest"].add_argument("raw", nargs="+")
    made["ingest"].add_argument("--providers", required=True, action="append", help="settings by name; of several files the later wins, the vault's own providers.json last")
    made["ingest"].add_argument("--resume", default="", metavar="STAMP", help="take up a run that stopped")
    made["providers-check"].add_argument("--over", action="append", default=[], help="another file whose providers win")
    made["providers-check"].add_argument("--live", action="store_true", help="ask each provider one small question")
    made["ingest"].add_argument("--encoder", required=True)
    made["ingest"].add_argument("--dimensions", type=int, default=cache.DEFAULTS["dimensions"])
    made["status"].add_argument("operation", nargs="?")
    made["inspect"].add_argument("operation")
    made["status"].add_argument("--verify", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "providers-check":
        registry = _registry(args.path, *args.over)
        rows = registry.report(ChatCompletions) if args.live else registry.check()
        _print(rows, args.json)
        return 0 if all(r["ok"] for r in rows) else 2
    spark = session("tessella")
    if args.command == "init":
        _print([{"made": name} for name in vault.initialise(spark, args.path)], args.json)
        return 0
    if args.command == "raw-candidates":
        _print(raw_candidates(spark, args.path, args.include_processed, args.limit), args.json)
        return 0
    if args.command == "ingest":
        registry = _registry(*args.providers, optional=(os.path.join(args.path, "providers.json"),))
        run = ingest.Run(spark, args.path, ChatCompletions(registry), registry, cache.sentence_encoder(args.encoder), args.dimensions, stamp=args.resume)
        done = [r.asDict() for r in ingest.ingest(run, args.raw).collect()]
        _print(done, args.json)
        return 2 if any(r["status"] == "failed" for r in done) else 0
    if args.command == "inspect":
        found = inspect(spark, args.path, args.operation)
        _print(found, args.json)
        return 0 if found else 2
    states, drift = status(spark, args.path, args.operation, args.verify)
    _print([*states, *drift], args.json)
    return 2 if drift or not states else 0


if __name__ == "__main__":
    sys.exit(main())

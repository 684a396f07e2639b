"""A run that is stopped anywhere and taken up again ends as one that wasn't stopped, and asks no model twice."""

import pytest

from tessella.operators import ingest, provider
from tessella.sources import vault
from tests.test_ingest import SPEC, Model, encoder, root  # noqa: F401


class Stopped(Exception):
    pass


class Counted(Model):
    """Asked requests are written down in a file, as answers are given by worker processes."""

    def __init__(self, where, log):
        super().__init__(where)
        self.log = log

    def answer(self, step, request, attempt):
        with open(self.log, "a") as f:
            f.write(f"{step}\n")
        return super().answer(step, request, attempt)


def state_of(spark, where, run):
    wiki = {r.path: r.text.replace(run.stamp, "STAMP") for r in vault.text_files(spark, f"{where}/wiki", "*.md").collect()}
    tables = ingest._tables(run).snapshot()
    claims = sorted(r.state_claim_id.replace(run.stamp, "STAMP") for r in tables.read("page_state_claims", ingest.CLAIM_SCHEMA).collect())
    receipts = sorted((r.raw_path, r.status) for r in spark.read.json(f"{where}/receipts").select("raw_path", "status").collect())
    events = sorted((r.operation_id.replace(run.stamp, "STAMP"), r.step, r.status) for r in spark.read.json(f"{where}/runs/events").select("operation_id", "step", "status").collect())
    artifacts = sorted(r.path for r in spark.read.json(f"{where}/runs/artifacts").select("path").collect())
    return wiki, claims, receipts, events, artifacts


def run_of(spark, where, log, stamp=""):
    return ingest.Run(spark, str(where), Counted(str(where), str(log)), provider.Registry({"default": SPEC}), encoder, 2, stamp=stamp)


def test_a_stopped_run_is_taken_up_again(spark, root, tmp_path_factory, monkeypatch):  # noqa: F811
    import shutil

    other, logs = tmp_path_factory.mktemp("stopped") / "vault", tmp_path_factory.mktemp("logs")
    shutil.copytree(root, other)
    whole = run_of(spark, root, logs / "whole")
    ingest.ingest(whole, ["a.md"]).collect()
    want = state_of(spark, root, whole)
    # stopped when pages and their states are written, and neither upkeep, index nor receipts are
    kept, run = ingest.Run.kept, run_of(spark, other, logs / "stopped")

    def stops(self, df, name):
        out = kept(self, df, name)
        if name == "maintained":
            raise Stopped
        return out

    monkeypatch.setattr(ingest.Run, "kept", stops)
    with pytest.raises(Stopped):
        ingest.ingest(run, ["a.md"]).collect()
    monkeypatch.undo()
    stamp = run.stamp
    last = run_of(spark, other, logs / "stopped", stamp)
    ingest.ingest(last, ["a.md"]).collect()
    assert {"coverage_items", "write_set", "maintained"} <= set(last.reused) and "receipts" not in last.reused
    assert state_of(spark, other, last) == want
    asked = [sorted((logs / name).read_text().split()) for name in ("whole", "stopped")]
    assert asked[0] == asked[1]
    # other inputs are other steps: nothing of the old run is taken for them
    (other / "raw" / "a.md").write_text((other / "raw" / "a.md").read_text() + "。")
    changed = run_of(spark, other, logs / "changed", stamp)
    changed.given(vault.raw_files(spark, str(other)).where("raw_path = 'raw/a.md'"))
    changed.kept(spark.range(1), "raw_binding")
    assert changed.reused == []

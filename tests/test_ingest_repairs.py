"""One ingest of documents that each go wrong in their own way: what is repaired, what is asked again, and what fails."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import ingest, ledger, provider
from tessella.sources import vault
from tests.test_ingest import ITEMS, PAGE, RAW, SECTIONS, SPEC, encoder, said

CLAIMS = [("T1", "编译文档", 5, ["编译"]), ("T2", "维护页面", 2, [])]


def plan(units, texts=None):
    claims = [{"claim_id": c, "text": (texts or {}).get(c, t), "importance": i, "concept_terms": k, "raw_locator": "p1"} for c, t, i, k in CLAIMS]
    made = [{"content_unit_id": u, "title": f"知识{u}", "content_role": "主干", "absorption_decision": "独立成页", "anchor_unit_id": u, "section_hint": "核心内容", "claim_ids": c} for u, c in units.items()]
    return {"claims": claims, "content_units": made, "noise": []}


ONE, TWO = {"U": ["T1", "T2"]}, {"U": ["T1"], "V": ["T2"]}
OPEN = {"coverage_items": [{"item_id": "I1", "importance": 5, "status": "missing", "claim_refs": [], "unit_refs": []}]}
FULL = {"coverage_items": [{"item_id": "I1", "importance": 5, "status": "covered", "claim_refs": ["C-001"], "unit_refs": []}]}


def found(missing=(), evidence="编译文档。", claims=("C-001", "C-002")):
    return [{"claim_id": c, "status": "missing" if c in missing else "covered", "covered_by": [] if c in missing else ["FP"], "evidence": evidence, "reason": "页面写明"} for c in claims]


def asked(request):
    """The request's payload, of a retry the one it repeats."""
    payload = json.loads(request["user_payload"])
    return json.loads(payload["request"]) if "request" in payload else payload


class Model:
    def answer(self, step, request, attempt):
        name = request["operation_id"].split("-")[2]
        task, key = request["schema_name"], request["request_key"]
        title = f"编译{name}{key[-1]}"
        if task == "source_digest":
            return said(plan(TWO if name == "keys" else ONE, {"T1": "compile documents"} if name == "latin" else None))
        if task == "digest_coverage_judge":
            return said(OPEN) if name in ("mend", "hole") else ITEMS
        if task == "digest_coverage_repair":
            assert json.loads(asked(request)["open_items"])[0]["item_id"] == "I1"
            return said({"source_digest": plan(ONE), **(FULL if name == "mend" and attempt == 2 else OPEN)})
        if task == "candidate_pages":
            assert "C-001" in request["cache_prefix"]
            return said({"title": "", "summary": "编译", "body_markdown": "正文"}) if name == "keys" and key == "CU-002" and attempt == 0 else PAGE
        pages = [c["candidate_page_id"] for c in json.loads(asked(request)["candidates"])] if task == "merge_plan" else []
        paths = [f"concepts/Concept_{name}{i + 1}.md" for i in range(2 if name == "keys" else 1)]
        if name == "old":
            paths = ["concepts/Concept_Alpha.md"]
        if task == "merge_plan":
            kind = {"action": "update"} if name == "old" else {"action": "create", "page_type": "concept"}
            return said({"decisions": [{"decision_id": "", "candidate_page_id": p, "target_path": "/" + t, "content_scope": "全部"} | kind for p, t in zip(pages, paths)]})
        if task == "composition_plan":
            return said({"items": [{"target_path": t, "merge_decision_ids": [f"MD-{i + 1:03d}"], "related_paths": [x for x in paths if x != t]} for i, t in enumerate(paths)]})
        if task == "final_pages":
            wanted = json.loads(asked(request)["requirements"])
            assert (len(wanted) > 0) == (name == "old")
            told = [{"requirement_id": r["requirement_id"], "final_anchor": "编译文档"} for r in wanted] if attempt else []
            return said({"title": title, "sections": SECTIONS, "preimage_coverage": told})
        if task == "final_page_coverage_repair":
            claims = json.loads(asked(request)["claims"])
            assert {c["claim_id"]: c["status"] for c in claims} == {"C-001": "covered", "C-002": "missing"}
            more = [SECTIONS[0], {"heading": "核心内容", "body_markdown": "补上维护页面。"}, SECTIONS[2]]
            return said({"title": title, "sections": more, "claim_results": found()})
        if task == "final_coverage_judge":
            own = [c["claim_id"] for c in json.loads(asked(request)["claims"])]
            missing = ["C-002"] if name == "gap" else []
            # a result for a claim of another page is dropped
            return said({"claim_results": found(missing, "" if name == "mute" else "编译文档。", own) + found((), "越界。", ["C-777"])})
        return said({"status": "ok"})


@pytest.fixture(scope="module")
def outcome(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    raws = {name: RAW * (4 if name == "keys" else 1) + "。" * i for i, name in enumerate(["mend", "hole", "keys", "old", "gap", "latin", "mute"])}
    files = {f"raw/{k}.md": v for k, v in raws.items()} | {"wiki/concepts/Concept_Alpha.md": "---\npage_type: concept\ntitle: Alpha\n---\n# Alpha\n\n编译旧页。"}
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    run = ingest.Run(spark, str(root), Model(), provider.Registry({"default": SPEC}), encoder, 2)
    rows = {r.raw_path[4:-3]: r for r in ingest.ingest(run, [f"{k}.md" for k in raws]).collect()}
    return run, rows, {r.path: r.markdown for r in vault.pages(spark, str(root)).collect()}


def calls(run, name):
    return sorted((r.operation_id.split("-")[2], r.request_key) for r in run.spark.read.parquet(f"{run.root}/runs/{run.stamp}/{name}").collect())


def test_what_is_written_and_what_fails(outcome):
    _, rows, _ = outcome
    told = {k: (r.status, r.step if r.status == "failed" else "", r.message) for k, r in rows.items()}
    assert {k: v[0] for k, v in told.items()} == {"mend": "written", "hole": "failed", "keys": "written", "old": "written", "gap": "written", "latin": "failed", "mute": "failed"}, told
    assert told["hole"][1:] == ("digest_coverage_judge", "incomplete_digest:")
    assert told["latin"][1] == "source_digest" and told["latin"][2].startswith("language_claim")
    assert told["mute"][1] == "final_coverage_judge" and told["mute"][2].startswith("blank_evidence")


def test_digests_are_repaired_three_times_at_most(outcome):
    run, _, _ = outcome
    assert [calls(run, f"digest_coverage_repair-calls-{i}") for i in range(3)] == [[("hole", "raw/hole.md"), ("mend", "raw/mend.md")]] * 3


def test_only_the_failing_request_is_asked_again(outcome):
    run, _, pages = outcome
    assert calls(run, "candidate_pages-calls-1") == [("keys", "CU-002")]
    assert calls(run, "final_pages-calls-1") == [("old", "FP-001")]
    made = run.spark.read.parquet(f"{run.root}/runs/{run.stamp}/receipts").where("raw_path = 'raw/keys.md'").first()
    assert made.repair_count == 1 and made.n_written == 3 and len(made.write_set_sha256) == 64


def test_pages_of_one_batch_are_related(outcome):
    _, _, pages = outcome
    first, second = pages["concepts/Concept_keys1.md"], pages["concepts/Concept_keys2.md"]
    assert "- [[concepts/Concept_keys2]]" in first and "- [[concepts/Concept_keys1]]" in second and "[[concepts/Concept_keys1]]" not in first


def test_an_update_reports_what_it_keeps(outcome):
    run, _, pages = outcome
    assert "编译文档。" in pages["concepts/Concept_Alpha.md"]
    wrong = run.spark.read.parquet(f"{run.root}/runs/{run.stamp}/final_pages-wrong-0").collect()
    assert wrong and all(r.message.startswith("unreported") and r.request_key == "FP-001" for r in wrong)


def test_a_page_that_leaves_a_claim_out_is_written_again(outcome):
    run, rows, pages = outcome
    assert "补上维护页面" in pages["concepts/Concept_gap1.md"]
    receipts = run.spark.read.parquet(f"{run.root}/runs/{run.stamp}/receipts")
    assert {r.raw_path[4:-3]: r.changed_pages for r in receipts.where("changed_pages > 0").collect()} == {"gap": 1}


def test_events_tell_how_far_a_run_came(outcome):
    run, _, _ = outcome
    events = run.spark.read.json(f"{run.root}/runs/events").withColumn("name", F.split("operation_id", "-")[2])
    of = lambda name: [(r.step, r.status) for r in events.where(F.col("name") == name).orderBy("pos").collect()]
    assert ("source_digest", "failed") in of("latin") and not any(s == "candidate_pages" for s, _ in of("latin"))
    assert ("final_coverage_judge", "completed") in of("mend")


def test_vectors_come_from_the_cache(spark, outcome):
    run, _, _ = outcome

    def refuses():
        raise RuntimeError("nothing is to be embedded")

    again = ingest.Run(spark, run.root, Model(), run.registry, refuses, 2)
    pages = again.kept(vault.pages(spark, run.root), "same_pages")
    stale = again.kept(ingest._embeddings(run, pages, "brought up to date"), "seen")
    assert ingest._embeddings(again, pages, "cached").count() == stale.count() == 5


def test_a_replacement_that_stopped_halfway_loses_nothing(spark, tmp_path):
    run = ingest.Run(spark, str(tmp_path), Model(), provider.Registry({"default": SPEC}), encoder, 2)
    one, two = (spark.createDataFrame([(k,)], "a int") for k in (1, 2))
    ingest._tables(run).commit(lambda s: {"t": ("replace", one)})
    two.write.parquet(f"{tmp_path}/state/data/t-of a writer that died")
    assert [r.a for r in ingest._tables(run).snapshot().read("t", "a int").collect()] == [1]
    ingest._tables(run).commit(lambda s: {"t": ("replace", two)})
    assert [r.a for r in ingest._tables(run).snapshot().read("t", "a int").collect()] == [2]


def test_two_ingests_side_by_side_keep_each_others_receipts(spark, tmp_path):
    """What another ingest commits between reading and committing is read again; a receipt that both would make is refused."""
    run = ingest.Run(spark, str(tmp_path), Model(), provider.Registry({"default": SPEC}), encoder, 2)
    log, schema, calls = ingest._tables(run), "operation_id string, status string", []
    mine = spark.createDataFrame([("op-1", "written")], schema)

    def told(other):
        def change(snapshot):
            there = snapshot.read("receipts", "operation_id string")
            if not calls:
                log.commit(lambda s: {"receipts": ("append", spark.createDataFrame([(other, "written")], schema))})
            calls.append(1)
            return {"receipts": ("append", ledger.new_receipts(mine, there))}

        return change

    log.commit(told("op-2"))
    assert len(calls) == 2 and sorted(r.operation_id for r in log.snapshot().read("receipts", schema).collect()) == ["op-1", "op-2"]
    with pytest.raises(Exception, match="receipt exists"):
        log.commit(lambda s: {"receipts": ("append", ledger.new_receipts(mine, s.read("receipts", "operation_id string")))})

"""A whole ingest over a small vault with recorded answers: one document passes, one needs a retry, one fails."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import ingest, provider
from tessella.sources import vault

SPEC = provider.Spec(spec="openai_compatible:deepseek-chat", endpoint="https://h/v1/chat/completions", api_key="k", max_retries=0, retry_backoff_seconds=0.0)
RAW = "知识编译把文档变成可维护的页面。" * 60


def said(value):
    return {"choices": [{"finish_reason": "stop", "message": {"content": json.dumps(value, ensure_ascii=False)}}], "usage": {"prompt_tokens": 100, "completion_tokens": 10}}


def digest(claims=("T1", "T2")):
    return said({
        "claims": [{"claim_id": "T1", "text": "编译文档", "importance": 5, "concept_terms": ["编译"], "raw_locator": "p1"}, {"claim_id": "T2", "text": "维护页面", "importance": 2, "concept_terms": [], "raw_locator": "p2"}],
        "content_units": [{"content_unit_id": "U", "title": "知识编译", "content_role": "主干", "absorption_decision": "独立成页", "anchor_unit_id": "U", "section_hint": "核心内容", "claim_ids": list(claims)}],
        "noise": [],
    })


ITEMS = said({"coverage_items": [{"item_id": "I1", "importance": 5, "status": "covered", "claim_refs": ["C-001"], "unit_refs": []}]})
PAGE = said({"title": "知识编译", "summary": "编译", "body_markdown": "正文"})
SECTIONS = [{"heading": "摘要", "body_markdown": "编译文档。"}, {"heading": "核心内容", "body_markdown": "维护页面，见 [[Alpha]]。"}, {"heading": "矛盾与未解决问题", "body_markdown": "- 规模如何？"}]
RESULTS = said({"claim_results": [{"claim_id": c, "status": "covered", "covered_by": ["FP-001"], "evidence": "编译文档。", "reason": "页面写明"} for c in ("C-001", "C-002")]})


class Model:
    """Answers by step and document; the document is recognised by its path in the request or by the operation."""

    def __init__(self, target):
        self.target = target

    def answer(self, step, request, attempt):
        operation = request["operation_id"]
        if step == "source_digest" and "-b-" in operation and attempt == 0:
            return digest(claims=["T1"])
        if step == "source_digest" and "-c-" in operation:
            return digest(claims=["T9"])
        name = "New" if "-a-" in operation else "Other"
        return {
            "source_digest": digest(), "digest_coverage_judge": ITEMS, "candidate_pages_warmup": said({"status": "ok"}), "candidate_pages": PAGE,
            "merge_plan": said({"decisions": [{"decision_id": "MD-001", "candidate_page_id": "CP-CU-001", "action": "create", "target_path": f"concepts/Concept_{name}.md", "page_type": "concept", "content_scope": "全部"}]}),
            "composition_plan": said({"items": [{"target_path": f"concepts/Concept_{name}.md", "merge_decision_ids": ["MD-001"]}]}),
            "final_pages": said({"title": f"编译 {name}", "sections": SECTIONS}), "final_coverage_judge": RESULTS,
        }[step]


def encoder():
    """Fixed directions: new texts on compiling are alike, the old page is related to them (0.75) but no strong overlap."""
    return lambda texts: [[0.75, 0.66] if "旧页" in t else [1.0, 0.0] if "编译" in t else [0.0, 1.0] for t in texts]


@pytest.fixture
def root(tmp_path):
    for name, body in {"raw/a.md": RAW, "raw/b.md": RAW + "。", "raw/c.md": RAW, "wiki/concepts/Concept_Alpha.md": "---\npage_type: concept\ntitle: Alpha\n---\n# Alpha\n\n编译旧页。"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return str(tmp_path)


def test_ingest(spark, root):
    run = ingest.Run(spark, root, Model(root), provider.Registry({"default": SPEC}), encoder, 2)
    out = {r.raw_path: r for r in ingest.ingest(run, ["a.md", "raw/b.md", "c.md"]).collect()}
    assert {k: r.status for k, r in out.items()} == {"raw/a.md": "written", "raw/b.md": "written", "raw/c.md": "failed"}, out
    assert out["raw/c.md"].step == "source_digest" and "unknown_claim" in out["raw/c.md"].message + out["raw/c.md"].step or "unassigned" in out["raw/c.md"].message
    assert out["raw/b.md"].model_calls == out["raw/a.md"].model_calls + 1
    pages = {r.path: r for r in vault.pages(spark, root).collect()}
    assert set(pages) == {"concepts/Concept_Alpha.md", "concepts/Concept_New.md", "concepts/Concept_Other.md"}
    new = pages["concepts/Concept_New.md"]
    assert "[[concepts/Concept_Alpha]]" in new.markdown and "## 相关页面" in new.markdown and new.source_raw_paths == ["raw/a.md"] and new.title == "编译 New"
    assert "## 相关页面" in pages["concepts/Concept_Alpha.md"].markdown
    files = {r.path: r.text for r in vault.text_files(spark, f"{root}/wiki").collect()}
    assert "规模如何？" in files["index.md"] and "Concept_New" in files["index.md"] and any(k.startswith("logs/") for k in files) and "sources/Source_a.md" in files
    tables = ingest._tables(run).snapshot()
    claims = tables.read("page_state_claims", ingest.CLAIM_SCHEMA)
    assert claims.count() == 4 and claims.where("coverage_policy = '必须保留'").count() == 4
    told = {r.target_path: r.diff for r in spark.read.parquet(f"{root}/runs/{run.stamp}/page_diffs").collect()}
    assert set(told) >= {"concepts/Concept_New.md"} and told["concepts/Concept_New.md"].startswith("@@ -0,0 +1,") and "\n+# 编译 New" in told["concepts/Concept_New.md"]
    contexts = spark.read.parquet(f"{root}/runs/{run.stamp}/candidate_contexts").collect()
    assert contexts and len({c.pool_hash for c in contexts}) == 1 and all([h["rank"] for h in c.hits] == list(range(1, len(c.hits) + 1)) for c in contexts) and any(c.hits for c in contexts)
    receipts = spark.read.json(f"{root}/receipts")
    assert sorted(r.raw_path for r in receipts.select("raw_path").collect()) == ["raw/a.md", "raw/b.md"]
    assert tables.read("embeddings", "path string, vector array<double>").where(F.size("vector") == 2).count() == 3


def test_refuses_without_a_model(spark, root):
    run = ingest.Run(spark, root, Model(root), provider.Registry({"default": provider.Spec(spec="local:heuristic")}), encoder, 2)
    with pytest.raises(ValueError, match="not a model"):
        ingest.ingest(run, ["a.md"])

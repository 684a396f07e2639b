"""The whole way from raw files to written pages, for many raw files at once, each an operation of its own.

Every step is a function from tables to tables; what a model answers is written before it is used. An answer that breaks
a rule is asked for again with what is wrong, alone; an operation whose answers still break one is marked failed and
leaves the later steps, the others go on. What a digest or a page leaves out is repaired before it counts as a failure.
Pages are written only after all checks, receipts last.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import links, text
from tessella.operators import cache, coverage, diffs, granularity, ledger, plans, provider, related, render, requests, state, validate, vectors
from tessella.sources import vault
from tessella.sources.snapshots import Snapshot, TableLog

DIGEST = """struct<claims:array<struct<claim_id:string,text:string,importance:int,concept_terms:array<string>,raw_locator:string>>,
content_units:array<struct<content_unit_id:string,title:string,content_role:string,absorption_decision:string,anchor_unit_id:string,section_hint:string,claim_ids:array<string>>>,noise:array<string>>"""  # fmt: skip
ITEMS = "struct<coverage_items:array<struct<item_id:string,importance:int,status:string,claim_refs:array<string>,unit_refs:array<string>>>>"
DIGEST_REPAIR = f"struct<source_digest:{DIGEST},{ITEMS.removeprefix('struct<')}"
PAGE = "struct<title:string,summary:string,body_markdown:string>"
DECISIONS = "struct<decisions:array<struct<decision_id:string,candidate_page_id:string,action:string,target_path:string,page_type:string,content_scope:string,locators:array<string>>>>"
COMPOSITION = "struct<items:array<struct<target_path:string,merge_decision_ids:array<string>,related_paths:array<string>>>>"
FINAL = "struct<title:string,sections:array<struct<heading:string,body_markdown:string>>,preimage_coverage:array<struct<requirement_id:string,final_anchor:string>>>"
RESULTS = "struct<claim_results:array<struct<claim_id:string,status:string,covered_by:array<string>,evidence:string,reason:string>>>"
PAGE_REPAIR = f"{FINAL.removesuffix('>')},{RESULTS.removeprefix('struct<')}"
#: How often a repair of a digest is asked for.
DIGEST_REPAIRS = 3


@dataclass
class Run:
    """One run: where, with whom, and what it has told so far."""

    spark: SparkSession
    root: str
    model: provider.Provider
    registry: provider.Registry
    encoder: Callable
    dimensions: int
    types: dict[str, str] = field(default_factory=lambda: dict(vault.TYPES))
    #: What a text must hold a letter of; None: any language.
    script: str | None = r"[㐀-鿿]"
    #: Of a run that stopped: it is taken up again where it was. Empty: a new run, named by the time.
    stamp: str = ""
    calls: list[DataFrame] = field(default_factory=list)
    failed: list[DataFrame] = field(default_factory=list)

    def __post_init__(self):
        self.resumed = bool(self.stamp)
        self.stamp = self.stamp or datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%SZ")
        self.key, self.reused = "", []

    def given(self, raws: DataFrame) -> None:
        """What the run's first step goes by: the raw files' contents and all settings. raws: ``raw_path``, ``raw_sha256``."""
        sums = raws.select(F.count("*"), *(F.sum(F.pmod(F.xxhash64("raw_path", "raw_sha256", F.lit(k)), F.lit(1 << 40))) for k in range(3))).first()
        self.key = sha256(repr([*sums, self.registry.check(), self.dimensions, sorted(self.types.items()), self.script]).encode()).hexdigest()

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """A step's rows, written below the vault's runs and read again.

        A step is addressed by a hash of the run's inputs and of all steps before it, for what a step does follows from these
        and from what they have written. One that stands under its address isn't worked out again, so a model isn't asked twice.
        """
        self.key = sha256(f"{self.key} {name}".encode()).hexdigest()
        path, mark = (f"{self.root.rstrip('/')}/runs/{self.stamp}/{part}" for part in (name, f"steps/{name}.json"))
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(mark)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if self.resumed and fs.exists(hadoop) and self.spark.read.schema("key string").json(mark).first()["key"] == self.key:
            self.reused.append(name)
        else:
            df.write.mode("overwrite").parquet(path)
            out = fs.create(hadoop, True)
            out.write(bytearray(json.dumps({"key": self.key, "step": name, "at": datetime.datetime.now(datetime.UTC).isoformat()}).encode()))
            out.close()
        return self.spark.read.schema(df.schema).parquet(path)

    def told(self, rows: DataFrame, journal: str, keys: list[str]) -> None:
        """Append to one of the vault's journals; what a resumed run has told before it stopped isn't told again."""
        path = f"{self.root.rstrip('/')}/{journal}"
        if self.resumed and _exists(self, path):
            there = self.spark.read.schema(rows.schema).json(path).select(*keys).distinct()
            rows = rows.join(there, keys, "left_anti").select(*rows.columns)
        vault.append(rows, path)

    def ask(self, step: str, asked: DataFrame, schema: str, check: Callable[[DataFrame], DataFrame], attempts: int = 2, name: str | None = None) -> DataFrame:
        """``operation_id``, ``request_key``, ``output``: answers that pass the check. Only requests whose answer breaks a rule are asked
        again, with that answer and what is wrong with it, ``attempts`` times in all; what is wrong then fails its operation.

        check gives ``operation_id``, ``rule``, ``key`` and, where a rule speaks of one request, ``request_key``; it sees all answers of the
        step at once, those that have passed before too. A call whose answer breaks a rule isn't a success in the accounts.
        """
        name, keys = name or step, ["operation_id", "request_key"]
        asked = self.kept(asked, f"{name}-requests")
        if asked.isEmpty():
            return provider.outputs(self.spark.createDataFrame([], provider.CALLS), schema).select(*keys, "output")
        pending, answers, wrong = asked, None, None
        for attempt in range(attempts):
            made = self.kept(provider.calls(pending, Shifted(self.model, attempt), self.registry), f"{name}-calls-{attempt}")
            fresh = provider.outputs(made, schema)
            passed = None if answers is None else answers.join(pending.select(*keys), keys, "left_anti")
            answers = self.kept(fresh if passed is None else passed.unionByName(fresh), f"{name}-answers-{attempt}")
            wrong = self.kept(self._wrong(answers, asked, check), f"{name}-wrong-{attempt}")
            self.calls.append(provider.semantically_failed(made, wrong))
            if attempt + 1 == attempts or wrong.isEmpty():
                break
            told = wrong.groupBy(*keys).agg(F.concat_ws("; ", F.array_sort(F.collect_set("message"))).alias("problem"))
            told = told.join(answers.select(*keys, F.to_json("output").alias("answer")), keys, "left")
            pending = self.kept(requests.again(validate.retry_set(asked, wrong), told), f"{name}-requests-{attempt + 1}")
        self.failed.append(wrong.select("operation_id", F.lit(step).alias("step"), "message"))
        self.tell(step, asked.select("operation_id"), wrong)
        return answers.join(wrong.select("operation_id").distinct(), "operation_id", "left_anti").select(*keys, "output")

    def tell(self, step: str, operations: DataFrame, wrong: DataFrame) -> None:
        """An event for each operation once a step is done, so that the state of a run that stops is known."""
        bad = wrong.select("operation_id", F.lit(True).alias("bad")).distinct()
        rows = operations.distinct().join(bad, "operation_id", "left")
        status = F.when(F.col("bad"), "failed").otherwise("completed").alias("status")
        self.told(rows.select("operation_id", F.lit(ledger.STEPS.index(step)).cast("long").alias("pos"), F.lit(step).alias("step"), status), "runs/events", ["operation_id", "step", "status"])

    @staticmethod
    def _wrong(answers: DataFrame, asked: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``operation_id``, ``request_key``, ``message``; a rule of a whole operation is broken by all its requests."""
        keys = ["operation_id", "request_key"]
        lost = answers.where(F.col("problem").isNotNull() | F.col("output").isNull()).select(*keys, F.coalesce("problem", F.lit("no_output")).alias("message"))
        broken = check(answers.where("problem is null and output is not null"))
        broken = broken if "request_key" in broken.columns else broken.join(asked.select(*keys), "operation_id")
        return lost.unionByName(broken.select(*keys, F.concat_ws(":", "rule", "key").alias("message")))

    def gate(self, rows: DataFrame, fields: list[str], technical: list[str] | None = None) -> DataFrame:
        """``operation_id``, ``request_key``, ``rule``, ``key``: fields of answers (``operation_id``, ``request_key``) without the vault's script."""
        if self.script is None:
            return rows.select("operation_id", "request_key", F.lit("").alias("rule"), F.lit("").alias("key")).limit(0)
        found = validate.language_gate(rows, fields, "request_key", self.script, technical)
        return found.select("operation_id", F.col("key").alias("request_key"), "rule", F.lit("").alias("key"))


class Shifted:
    """A provider asked for the second time: its answers continue after those of the first round."""

    def __init__(self, inner: provider.Provider, by: int = 1):
        self.inner, self.by = inner, by

    def answer(self, step, request, attempt):
        return self.inner.answer(step, request, attempt + self.by)


def _digest_parts(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    one = answers.select("operation_id", "output.digest.*")
    claims = one.select("operation_id", F.posexplode("claims").alias("pos", "c")).select("operation_id", "pos", "c.*")
    units = one.select("operation_id", F.posexplode("content_units").alias("pos", "u")).select("operation_id", "pos", "u.*")
    return claims, units


def _normal(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digest answers as numbered claims and units, with the columns that numbering doesn't touch."""
    claims, units = _digest_parts(answers)
    new_claims, new_units = plans.normalized_digest(claims, units)
    c = new_claims.join(claims.select("operation_id", "pos", F.coalesce("importance", F.lit(1)).alias("importance"), F.coalesce("raw_locator", F.lit("")).alias("raw_locator")), ["operation_id", "pos"])
    u = new_units.join(units.select("operation_id", "pos", "content_role", "absorption_decision", F.coalesce("section_hint", F.lit("")).alias("section_hint")), ["operation_id", "pos"])
    return c, u


def _digest_json(operations: DataFrame, claims: DataFrame, units: DataFrame) -> DataFrame:
    """``operation_id``, ``digest``: the numbered claims and units of each operation, as later requests and answers name them."""
    listed = lambda df, *c: df.groupBy("operation_id").agg(F.array_sort(F.collect_list(F.struct("pos", *c))).alias("l"))
    c = listed(claims, "claim_id", "text", "importance", "concept_terms", "raw_locator").withColumnRenamed("l", "claims")
    u = listed(units, "content_unit_id", "title", "content_role", "absorption_decision", "anchor_unit_id", "section_hint", "claim_ids").withColumnRenamed("l", "content_units")
    rows = operations.select("operation_id").join(c, "operation_id", "left").join(u, "operation_id", "left")
    return rows.select("operation_id", F.to_json(F.struct("claims", "content_units")).alias("digest"))


def _of_page(df: DataFrame) -> DataFrame:
    """Rows by page: ``operation_id`` and ``final_page_id`` in one key, for checks that look at one operation at a time."""
    return df.withColumn("operation_id", F.concat_ws("#", "operation_id", "final_page_id"))


def _by_page(found: DataFrame) -> DataFrame:
    """What such checks found, by operation and request."""
    k = F.split("operation_id", "#", 2)
    return found.select(k[0].alias("operation_id"), k[1].alias("request_key"), "rule", "key")


def _plain(found: DataFrame) -> DataFrame:
    return found.select("operation_id", "rule", "key")


def ingest(run: Run, raw_paths: list[str]) -> DataFrame:
    """Ingest raw files of a vault; ``operation_id``, ``status``, ``step``, ``message`` of each when all is done."""
    run.registry.require()
    vault.initialise(run.spark, run.root)
    wanted = run.spark.createDataFrame([(vault.resolve_raw(p),) for p in raw_paths], "raw_path string").distinct()
    name = text.slug(F.regexp_extract("raw_path", r"([^/]*?)(?:\.[^./]*)?$", 1), "raw")
    raws = vault.raw_files(run.spark, run.root).join(F.broadcast(wanted), "raw_path", "left_semi").where("trim(text) <> ''")
    run.given(raws)
    raws = run.kept(raws.withColumn("operation_id", F.concat(F.lit(f"ING-{run.stamp}-"), name, F.lit("-"), F.substring(F.sha2("raw_path", 256), 1, 6))), "raw_binding")

    # Digest and its coverage; a digest that leaves something out is repaired.
    def digest_rules(rows: DataFrame) -> DataFrame:
        """rows: ``operation_id``, ``request_key``, ``output.digest``."""
        claims, units = _normal(rows)
        sizes = rows.select("operation_id", F.size("output.digest.claims").alias("n_claims"), F.size("output.digest.content_units").alias("n_units"), F.concat_ws(" ", "output.digest.noise").alias("noise_reasons"))
        groups = units.where("content_role = '主干'").groupBy("operation_id").agg(F.count("*").alias("n_groups"))
        size_rows = sizes.join(groups, "operation_id", "left").join(raws.select("operation_id", "text"), "operation_id").fillna(0, ["n_groups"])
        bounds = granularity.boundary_violations(size_rows).withColumn("key", F.lit(""))
        said = rows.select("operation_id", "request_key", F.explode("output.digest.claims").alias("c")).select("operation_id", "request_key", F.col("c.text").alias("claim"))
        titled = rows.select("operation_id", "request_key", F.explode("output.digest.content_units").alias("u")).select("operation_id", "request_key", F.concat_ws(" ", "u.title", "u.section_hint").alias("unit"))
        gates = run.gate(said, ["claim"]).unionByName(run.gate(titled, ["unit"]))
        lost = rows.where("output.digest is null").select("operation_id", F.lit("no_digest").alias("rule"), F.lit("").alias("key"))
        return validate.together(_plain(validate.claim_plan(claims, units)), bounds.select("operation_id", "rule", "key"), _plain(gates), lost)

    as_digest = lambda rows, c: rows.withColumn("output", F.struct(F.col(c).alias("digest")))
    digests = run.ask("source_digest", requests.digest_requests(raws), DIGEST, lambda a: digest_rules(as_digest(a, "output")))
    claims, units = (run.kept(t, n) for t, n in zip(_normal(as_digest(digests, "output")), ("first_claims", "first_units")))
    digest_json = run.kept(_digest_json(digests, claims, units), "first_digests")

    def items_of(answers: DataFrame) -> DataFrame:
        return answers.select("operation_id", F.explode("output.coverage_items").alias("i")).select("operation_id", "i.*")

    def repair_rules(answers: DataFrame) -> DataFrame:
        rows = as_digest(answers, "output.source_digest")
        open_ = coverage.incomplete_digests(coverage.digest_report(items_of(answers)))
        unsaid = answers.where("coalesce(size(output.coverage_items), 0) <= 0").select("operation_id", F.lit("no_items").alias("rule"), F.lit("").alias("key"))
        told = open_.select("operation_id", F.lit("incomplete_digest").alias("rule"), F.lit("").alias("key"))
        return validate.together(digest_rules(rows), _plain(validate.coverage_items(items_of(answers), *_normal(rows))), told, unsaid)

    judged = run.ask("digest_coverage_judge", requests.coverage_requests(raws, digest_json), ITEMS, lambda a: _plain(validate.coverage_items(items_of(a), claims, units)))
    found = run.kept(items_of(judged), "coverage_items")
    incomplete = coverage.incomplete_digests(coverage.digest_report(found)).select("operation_id")
    open_items = found.where("status <> 'covered'").join(incomplete, "operation_id", "left_semi")
    mended = run.ask("digest_coverage_judge", requests.digest_repair_requests(raws, digest_json, open_items), DIGEST_REPAIR, repair_rules, DIGEST_REPAIRS, "digest_coverage_repair")
    new_claims, new_units = _normal(as_digest(mended, "output.source_digest"))
    sound = judged.select("operation_id").join(incomplete, "operation_id", "left_anti")
    claims = run.kept(claims.join(sound, "operation_id", "left_semi").unionByName(new_claims), "claims")
    units = run.kept(units.join(sound, "operation_id", "left_semi").unionByName(new_units), "units")
    digest_json = run.kept(_digest_json(sound.unionByName(mended.select("operation_id")), claims, units), "digests")

    # Candidate pages, one for each trunk unit, and the pages they may belong to.
    groups = plans.content_groups(units)
    run.calls.append(run.kept(provider.calls(requests.warmup_requests(raws, digest_json), run.model, run.registry), "warmup-calls"))

    def draft_rules(answers: DataFrame) -> DataFrame:
        rows = answers.select("operation_id", "request_key", "output.*")
        blank = validate.blank(rows, ["title", "body_markdown"], "request_key").select("operation_id", F.col("key").alias("request_key"), "rule", F.lit("").alias("key"))
        return blank.unionByName(run.gate(rows.withColumn("title", F.concat_ws(" ", "title", "summary", "body_markdown")), ["title", "summary", "body_markdown"]))

    drafted = run.ask("candidate_pages", requests.page_requests(raws, digest_json, groups), PAGE, draft_rules)
    candidates = run.kept(drafted.select("operation_id", F.concat(F.lit("CP-"), "request_key").alias("candidate_page_id"), F.col("request_key").alias("content_unit_id"), "output.*"), "candidates")
    pages = run.kept(vault.pages(run.spark, run.root, run.types), "snapshot")
    pool_hash = run.kept(vault.pool_hash(pages), "pool_hash").first()["pool_hash"]
    embed = lambda cards: cache.embedded(cards, run.encoder, run.dimensions).select("path", F.xxhash64("path").alias("id"), "vector")
    pool = _embeddings(run, pages, "pool").select("path", F.xxhash64("path").alias("id"), "vector")
    key = F.concat_ws("#", "operation_id", "candidate_page_id")
    queries = run.kept(embed(candidates.select(key.alias("path"), text.card(F.col("title"), F.col("summary"), F.col("body_markdown")).alias("card"))), "queries")
    top = vectors.top_k(queries.select("id", "vector"), pool.select("id", "vector"))
    named = top.join(queries.select(F.col("id").alias("query"), F.split("path", "#", 2).alias("k")), "query").join(pool.select("id", F.col("path").alias("hit")), "id")
    hits = named.join(pages.select(F.col("path").alias("hit"), F.col("text_excerpt").alias("excerpt")), "hit")
    hits = run.kept(hits.select(F.col("k")[0].alias("operation_id"), F.col("k")[1].alias("candidate_page_id"), "rank", F.col("hit").alias("path"), "score", "excerpt"), "contexts")
    listed = hits.groupBy("operation_id", "candidate_page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "score", "excerpt"))).alias("hits"))  # TOP_K at most
    whole = candidates.select("operation_id", "candidate_page_id").join(listed, ["operation_id", "candidate_page_id"], "left")
    run.kept(whole.withColumn("hits", F.coalesce("hits", F.array().cast(listed.schema["hits"].dataType))).withColumn("pool_hash", F.lit(pool_hash)), "candidate_contexts")

    # Decisions, and what is to be written where.
    types = vault.page_type_rows(run.spark, run.types)

    def decided(answers: DataFrame) -> DataFrame:
        rows = answers.select("operation_id", F.posexplode("output.decisions").alias("pos", "d")).select("operation_id", "pos", "d.*")
        return plans.normalized_decisions(rows, candidates).withColumn("n_refs", F.lit(1))  # every decision refers to its operation's raw file

    def merge_rules(answers: DataFrame) -> DataFrame:
        rows = decided(answers)
        strong = hits.where((F.col("rank") == 1) & (F.col("score") >= vectors.STRONG_OVERLAP)).join(answers.select("operation_id"), "operation_id", "left_semi")
        used = rows.where("action in ('update', 'noop')").select("operation_id", "candidate_page_id", F.col("target_path").alias("path"))
        ignored = strong.join(used, ["operation_id", "candidate_page_id", "path"], "left_anti")
        asked = candidates.join(answers.select("operation_id"), "operation_id", "left_semi")
        told = validate.merge_plan(rows, asked, hits, types.select("page_type", "directory", "title_prefix"))
        said = run.gate(rows.withColumn("request_key", F.lit("merge_plan")), ["content_scope"])
        return validate.together(_plain(told), ignored.select("operation_id", F.lit("strong_overlap_ignored").alias("rule"), F.col("path").alias("key")), _plain(said))

    decisions = run.kept(decided(run.ask("merge_plan", requests.merge_requests(candidates, hits), DECISIONS, merge_rules)), "decisions")

    def composed(answers: DataFrame) -> DataFrame:
        rows = answers.select("operation_id", F.posexplode("output.items").alias("pos", "i")).select("operation_id", "pos", "i.*")
        return rows.withColumn("related_paths", F.coalesce("related_paths", F.array().cast("array<string>")))

    section_types = types.withColumn("sections", F.array(*map(F.lit, validate.REQUIRED_SECTIONS)))
    composition_rules = lambda a: _plain(validate.composition(composed(a), decisions.join(a.select("operation_id"), "operation_id", "left_semi")))
    planned = composed(run.ask("composition_plan", requests.composition_requests(decisions, section_types), COMPOSITION, composition_rules))
    merged = plans.merged_items(planned, ["related_paths"], ["merge_decision_ids"])
    action = decisions.where("action <> 'noop'").groupBy("operation_id", "target_path").agg(
        F.when(F.max(F.col("action") == "update"), "update").otherwise("create").alias("action"), F.collect_set("candidate_page_id").alias("candidate_page_ids"), F.max("page_type").alias("declared_type")
    )
    items = run.kept(merged.join(action, ["operation_id", "target_path"]), "composition")

    # Pages: what an update must keep, the model's sections, canonical Markdown.
    old = items.where("action = 'update'").join(pages.select(F.col("path").alias("target_path"), "title", "summary", "markdown"), "target_path")
    active = _tables(run).snapshot().read("page_state_claims", CLAIM_SCHEMA).where("status = '活跃'").select(F.col("page_path").alias("target_path")).distinct()
    keep = validate.preimage_requirements(old.join(active, "target_path", "left_anti")).join(items.select("operation_id", "target_path", "final_page_id"), ["operation_id", "target_path"])
    keep = run.kept(keep, "preimage_requirements")
    needed = keep.groupBy("operation_id", "target_path").agg(F.array_sort(F.collect_list(F.struct("requirement_id", "text"))).alias("requirements"))
    near_by = hits.select("operation_id", "path").unionByName(items.select("operation_id", F.col("target_path").alias("path")))
    known = near_by.groupBy("operation_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))  # its candidates' best hits and its own targets, so few
    asked = items.join(needed, ["operation_id", "target_path"], "left").withColumn("requirements", F.coalesce("requirements", F.array().cast("array<struct<requirement_id:string,text:string>>")))

    def bodies(answers: DataFrame) -> DataFrame:
        each = answers.select("operation_id", "request_key", F.explode("output.sections").alias("s"))
        keyed = each.select(F.concat_ws("#", "operation_id", "request_key").alias("final_page_id"), "s.*")
        made = render.page_body(keyed, validate.REQUIRED_SECTIONS)
        return made.select(F.split("final_page_id", "#", 2)[0].alias("operation_id"), F.split("final_page_id", "#", 2)[1].alias("final_page_id"), "markdown", "problem")

    def page_rules(answers: DataFrame) -> DataFrame:
        made = bodies(answers)
        unsaid = answers.where("coalesce(size(output.sections), 0) <= 0").select("operation_id", "request_key", F.lit("no_sections").alias("rule"), F.lit("").alias("key"))
        shape = made.where("problem is not null").select("operation_id", F.col("final_page_id").alias("request_key"), F.col("problem").alias("rule"), F.lit("").alias("key"))
        sections = answers.select("operation_id", "request_key", "output.title", F.explode("output.sections").alias("s")).select("operation_id", "request_key", F.concat_ws(" ", "title", "s.body_markdown").alias("title"), F.col("s.body_markdown").alias("section"))
        mine = answers.select("operation_id", F.col("request_key").alias("final_page_id"))
        reports = answers.select("operation_id", F.col("request_key").alias("final_page_id"), F.explode("output.preimage_coverage").alias("r")).select("operation_id", "final_page_id", F.lit("").alias("target_path"), "r.*")
        wanted = keep.join(mine, ["operation_id", "final_page_id"], "left_semi").withColumn("target_path", F.lit(""))
        kept = validate.preimage_coverage(_of_page(wanted), _of_page(reports), _of_page(made.withColumn("target_path", F.lit(""))))
        return validate.together(unsaid, shape, run.gate(sections, ["title", "section"]), _by_page(kept).select("operation_id", "request_key", "rule", "key"))

    before = pages.select(
        F.col("path").alias("target_path"), F.col("title").alias("old_title"), F.col("aliases").alias("old_aliases"), F.col("created").alias("old_created"),
        F.col("source_raw_paths").alias("old_raw_paths"), F.col("source_raw_hashes").alias("old_raw_hashes"), F.col("source_operation_ids").alias("old_operations"), F.col("sha256").alias("preimage_sha256"),
    )

    def finished(answered: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Pages of the answers with what they keep of the old ones and links put right; and the issues of their links."""
        titles = answered.select("operation_id", F.col("request_key").alias("final_page_id"), F.col("output.title").alias("model_title"))
        written = bodies(answered).join(titles, ["operation_id", "final_page_id"]).join(items.select("operation_id", "final_page_id", "target_path", "action", "declared_type", "related_paths"), ["operation_id", "final_page_id"])
        rows = written.join(before, "target_path", "left").join(raws.select("operation_id", "raw_path", "raw_sha256"), "operation_id")
        rows = rows.withColumns({
            "title": F.coalesce("old_title", "model_title"), "page_type": F.coalesce("declared_type", vault.type_of_path(F.col("target_path"), run.types)),
            "raw_paths": F.array("raw_path"), "raw_hashes": F.array("raw_sha256"),
        })
        everything = pages.select("path", "title").unionByName(rows.select(F.col("target_path").alias("path"), "title")).dropDuplicates(["path"]).withColumn("pos", F.lit(0))
        linked = links.canonical_links(rows.select(F.concat_ws("#", "operation_id", "target_path").alias("id"), "markdown"), everything)
        rows = rows.withColumn("id", F.concat_ws("#", "operation_id", "target_path")).drop("markdown").join(linked.select("id", F.col("markdown").alias("body")), "id")
        rows = run.kept(rows, name)
        issues = links.link_issues(rows.select(F.col("id").alias("path"), "title", F.col("body").alias("markdown")), everything)
        return rows, run.kept(issues.select(F.split("path", "#", 2)[0].alias("operation_id"), F.lit("final_pages").alias("step"), F.col("code").alias("message")), f"{name}-links")

    answered = run.ask("final_pages", requests.final_page_requests(asked, candidates, known), FINAL, page_rules)
    final, link_failures = finished(answered, "final_bodies")

    # Coverage of every claim by the page it belongs to; pages that leave claims out are written again.
    plan = plans.update_plan(items, candidates, units, claims, _tables(run).snapshot().read("page_state_claims", CLAIM_SCHEMA))
    uses = plan.select("operation_id", "target_path", F.explode("claim_ids").alias("claim_id")).join(items.select("operation_id", "target_path", "final_page_id"), ["operation_id", "target_path"])
    claim_text = F.concat_ws(" ", "text", F.concat_ws(" ", "concept_terms"), "raw_locator")
    texts = final.select("operation_id", "final_page_id", plans.page_text(F.col("title"), F.col("target_path"), F.col("page_type"), F.col("body")).alias("text"))
    assigned = run.kept(plans.assigned_claims(claims.select("operation_id", "claim_id", claim_text.alias("claim_text"), "concept_terms"), texts, uses.select("operation_id", "claim_id", "final_page_id")), "assigned")
    mine = assigned.join(claims.select("operation_id", "claim_id", "text"), ["operation_id", "claim_id"])
    judged_page = lambda rows: rows.select("operation_id", "final_page_id", F.col("body").alias("markdown"), "title")

    def results(answers: DataFrame) -> DataFrame:
        """Results of the claims that a page was asked for; others are dropped."""
        each = answers.select("operation_id", F.col("request_key").alias("final_page_id"), F.posexplode("output.claim_results").alias("pos", "r")).select("operation_id", "final_page_id", "pos", "r.*")
        each = each.withColumn("covered_by", F.coalesce("covered_by", F.array().cast("array<string>")))
        return each.join(mine.select("operation_id", "final_page_id", "claim_id"), ["operation_id", "final_page_id", "claim_id"], "left_semi")

    def result_rules(answers: DataFrame) -> DataFrame:
        rows = results(answers)
        told = rows.withColumn("request_key", F.col("final_page_id"))
        expected = mine.join(answers.select("operation_id", F.col("request_key").alias("final_page_id")), ["operation_id", "final_page_id"], "left_semi")
        blank = validate.blank(_of_page(rows), ["evidence", "reason"], "claim_id")
        return validate.together(_by_page(validate.judge_results(_of_page(rows), _of_page(expected))), _by_page(blank), run.gate(told, ["evidence", "reason"], ["evidence"]))

    def short(found: DataFrame) -> DataFrame:
        """``operation_id``, ``failure`` of operations whose claims aren't covered well enough."""
        ours = claims.join(judged_operations, "operation_id", "left_semi")
        return coverage.failures(coverage.claim_report(coverage.judged(ours, found)))

    covered = run.ask("final_coverage_judge", requests.judge_requests(judged_page(final), mine), RESULTS, result_rules)
    judged_operations = covered.select("operation_id").distinct()
    first = run.kept(results(covered), "claim_results")
    low = run.kept(short(first).select("operation_id").distinct(), "low_coverage")
    status = first.groupBy("operation_id", "final_page_id", "claim_id").agg(F.max_by("status", "pos").alias("status"))
    open_claims = mine.join(low, "operation_id", "left_semi").join(status, ["operation_id", "final_page_id", "claim_id"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    poor = open_claims.where("status <> 'covered'").select("operation_id", "final_page_id").distinct()
    wanted = open_claims.join(poor, ["operation_id", "final_page_id"], "left_semi")
    plain_page = lambda a: a.withColumn("output", F.struct("output.title", "output.sections", "output.preimage_coverage"))
    both = lambda a: page_rules(plain_page(a)).unionByName(result_rules(a))
    mended = run.ask("final_coverage_judge", requests.page_repair_requests(judged_page(final), wanted), PAGE_REPAIR, both, name="final_page_repair")
    keys = ["operation_id", "request_key"]
    answered = answered.join(mended.select(*keys), keys, "left_anti").unionByName(plain_page(mended).select(*keys, "output"))
    earlier = final.select("operation_id", "final_page_id", F.col("body").alias("earlier"))
    if not mended.isEmpty():
        final, link_failures = finished(answered, "repaired_bodies")
    run.failed.append(link_failures)
    changed = final.join(earlier, ["operation_id", "final_page_id"]).groupBy("operation_id").agg(F.count_if(~F.col("body").eqNullSafe(F.col("earlier"))).alias("changed_pages"))
    run.kept(changed, "changed_pages")
    again = results(mended)
    last = first.join(again.select("operation_id", "final_page_id").distinct(), ["operation_id", "final_page_id"], "left_anti").unionByName(again)
    run.failed.append(run.kept(short(last).select("operation_id", F.lit("final_coverage_judge").alias("step"), F.col("failure").alias("message")), "coverage-failed"))
    good = judged_operations
    for bad in run.failed:
        good = good.join(bad.select("operation_id").distinct(), "operation_id", "left_anti")
    good = run.kept(good, "good")
    final = final.join(good, "operation_id", "left_semi")

    # Related pages, header, checks before writing.
    cards = final.select(F.col("target_path").alias("path"), text.page_card(F.col("title"), F.col("page_type"), text.summary(F.col("body")), F.col("target_path"), F.col("body")).alias("card")).dropDuplicates(["path"])
    new_vectors = run.kept(embed(cards), "new_vectors")
    whole = run.kept(vectors.pool_after(pool.select("id", "vector"), new_vectors.select("id", "vector")), "whole_pool")
    paths = pool.select("id", "path").unionByName(new_vectors.select("id", "path")).dropDuplicates(["id"])
    body_links = final.select(F.xxhash64("target_path").alias("query"), F.explode(links.body_links(F.col("body"))).alias("path")).select("query", F.xxhash64("path").alias("id"))
    near = vectors.related(new_vectors.select("id", "vector"), whole, body_links).where("decision = 'kept'").join(paths, "id")
    page = F.concat_ws("#", "operation_id", "target_path")
    named = final.select(page.alias("page"), F.posexplode("related_paths").alias("pos", "name"), "operation_id")
    batch = final.select(page.alias("path"))
    together = related.same_batch(named.select("page", "pos", F.concat_ws("#", "operation_id", links.normalize_path(F.col("name"))).alias("target")), batch)
    most = vectors.SAME_BATCH_MOST + vectors.RELATED_TOP_K
    refs = together.select("page", F.col("rank").alias("pos"), F.split("target", "#", 2)[1].alias("target")).unionByName(
        final.select(page.alias("page"), F.xxhash64("target_path").alias("query")).join(near, "query").select("page", (F.col("rank") + vectors.SAME_BATCH_MOST).alias("pos"), F.col("path").alias("target"))
    )
    report = run.kept(related.selected(refs, paths.select("path"), most), "related_report")
    listed = report.where("decision = 'kept'").groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: F.concat(F.lit("- "), links.wikilink(x["target"]))), "\n").alias("related"))
    rows = final.withColumn("page", page).join(listed, "page", "left").drop("page")
    rows = rows.withColumn("body", F.when(F.col("related").isNotNull(), text.with_section(F.col("body"), "相关页面", F.col("related"))).otherwise(F.col("body")))
    rows = run.kept(rows, "related_pages")
    output = vault.page_markdown(rows).join(rows.select("target_path", "operation_id", "action", "preimage_sha256", "raw_path", "raw_sha256", "title", "page_type"), "target_path")
    output = run.kept(output.withColumn("content_sha256", F.sha2("markdown", 256)).withColumn("source_refs", F.array(F.struct("raw_path", "raw_sha256"))), "pages")
    now = vault.text_files(run.spark, f"{run.root.rstrip('/')}/wiki", "*.md").select(F.col("path").alias("target_path"), F.col("sha256").alias("current_sha256"))
    again = vault.raw_files(run.spark, run.root).select("raw_path", F.col("raw_sha256").alias("now"))
    bound = raws.join(good, "operation_id", "left_semi").join(again, "raw_path", "left").select("operation_id", "raw_path", F.col("raw_sha256").alias("bound_sha256"), F.col("now").alias("raw_sha256"))
    targets = validate.final_targets(output.withColumn("n_refs", F.size("source_refs")), items.join(good, "operation_id", "left_semi"))
    issues = validate.together(validate.pre_write(output, now, bound), validate.header_issues(output), targets.select("operation_id", F.col("rule").alias("code"), F.col("key").alias("path")))
    blocked = run.kept(issues.select("operation_id", F.lit("validation").alias("step"), F.concat_ws(":", "code", "path").alias("message")), "validation")
    run.failed.append(blocked)
    output = run.kept(output.join(blocked.select("operation_id").distinct(), "operation_id", "left_anti"), "write_set")
    return _write(run, raws, units, claims, output, candidates, items, decisions)


NODE_SCHEMA = "page_path string, node_id string, title string, kind string, section_hint string, parent_node_id string, source_content_unit_ids array<string>, claim_ids array<string>, status string"
CLAIM_SCHEMA = "page_path string, state_claim_id string, source_claim_id string, text string, importance int, node_id string, source_content_unit_id string, source_operation_id string, status string, coverage_policy string, current_anchor string"


def _exists(run: Run, path: str) -> bool:
    name = run.spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(run.spark._jsc.hadoopConfiguration()).exists(name)


def _tables(run: Run) -> TableLog:
    """The vault's state: page states, vectors, daily log and receipts, which change together by numbered snapshots."""
    return TableLog(run.spark, f"{run.root.rstrip('/')}/state")


def _write(run: Run, raws: DataFrame, units: DataFrame, claims: DataFrame, output: DataFrame, candidates: DataFrame, items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pages, page states, source records, upkeep of old pages, index, log, journal and receipts, in this order."""
    root = run.root.rstrip("/")
    spark = run.spark
    # what each page becomes, told before it is written: a resumed run finds it here
    seen = vault.text_files(spark, f"{root}/wiki", "*.md").select(F.col("path").alias("target_path"), F.col("text").alias("old"))
    pairs = output.select("operation_id", "target_path", F.col("markdown").alias("new")).join(seen, "target_path", "left").withColumn("id", F.struct("operation_id", "target_path"))
    run.kept(diffs.unified(diffs.hunks(pairs.select("id", "old", "new"))).select("id.*", "diff"), "page_diffs")
    vault.write_pages(spark, root, output.select("target_path", "markdown"), output.select("target_path", "preimage_sha256"), run.resumed)
    done = output.select("operation_id").distinct()

    anchors = items.join(done, "operation_id", "left_semi").select("operation_id", "target_path", F.explode("candidate_page_ids").alias("candidate_page_id"))
    of_page = anchors.join(candidates.select("operation_id", "candidate_page_id", F.col("content_unit_id").alias("anchor_unit_id")), ["operation_id", "candidate_page_id"])
    page_units = units.join(of_page.select("operation_id", "anchor_unit_id", F.col("target_path").alias("page_path")).distinct(), ["operation_id", "anchor_unit_id"])
    uses = page_units.select("operation_id", "page_path", F.explode("claim_ids").alias("claim_id")).distinct()
    page_claims = claims.join(uses, ["operation_id", "claim_id"])
    texts = output.select(F.col("target_path").alias("page_path"), "markdown")

    def page_states(snapshot: Snapshot) -> dict[str, tuple[str, DataFrame]]:
        out = {}
        for name, schema, key, made in (
            ("page_state_nodes", NODE_SCHEMA, "node_id", lambda old: state.updated_nodes(page_units, page_claims, old)),
            ("page_state_claims", CLAIM_SCHEMA, "state_claim_id", lambda old: state.updated_claims(page_units, page_claims, texts, old)),
        ):
            old = snapshot.read(name, schema)
            out[name] = ("append", made(old).join(old.select("page_path", key), ["page_path", key], "left_anti"))
        return out

    _tables(run).commit(page_states, note=run.stamp)

    records = render.source_records(output.select("operation_id", "raw_path", "raw_sha256", "target_path"))
    there = vault.text_files(spark, f"{root}/wiki", "*.md").select(F.col("path").alias("target_path"), F.col("sha256").alias("preimage_sha256"))
    vault.write_pages(spark, root, records, records.select("target_path").join(there, "target_path", "left"), run.resumed)

    _maintain(run, output)
    _index_and_log(run, output, decisions)

    failed = reduce(DataFrame.unionByName, run.failed).distinct()
    first = failed.groupBy("operation_id").agg(F.min(F.struct("step", "message")).alias("f"))
    status = raws.select("operation_id", "raw_path", "raw_sha256").join(first, "operation_id", "left").join(done.withColumn("written", F.lit(True)), "operation_id", "left")
    calls = provider.accounted(reduce(DataFrame.unionByName, run.calls))
    counts = calls.groupBy("operation_id").agg(F.count("*").alias("model_calls"), F.round(F.sum("price_cny"), 8).alias("price_cny"), F.count_if(F.col("status") != "success").alias("repair_count"))
    files = output.select("operation_id", F.lit("knowledge").alias("kind"), "target_path", "content_sha256").unionByName(
        records.select("operation_id", F.lit("source").alias("kind"), "target_path", F.sha2("markdown", 256).alias("content_sha256"))
    )
    steps = counts.join(first.select("operation_id", F.lit(True).alias("failed")), "operation_id", "left").fillna(False, ["failed"])
    sets = ledger.receipts(steps, files).select("operation_id", "n_written", "write_set_sha256")
    changed = spark.read.schema("operation_id string, changed_pages long").parquet(f"{root}/runs/{run.stamp}/changed_pages")
    rows = status.join(counts, "operation_id", "left").join(sets, "operation_id", "left").join(changed, "operation_id", "left").select(
        "operation_id", "raw_path", "raw_sha256", F.when(F.col("written"), "written").when(F.col("f").isNotNull(), "failed").otherwise("source_recorded").alias("status"),
        F.coalesce("f.step", F.lit("receipt")).alias("step"), F.coalesce("f.message", F.lit("")).alias("message"), "model_calls", "repair_count", "price_cny",
        F.coalesce("n_written", F.lit(0)).alias("n_written"), "write_set_sha256", F.coalesce("changed_pages", F.lit(0)).alias("changed_pages"),
    )
    rows = run.kept(rows, "receipts")
    journal = spark.read.schema("operation_id string").json(f"{root}/receipts") if _exists(run, f"{root}/receipts") else spark.createDataFrame([], "operation_id string")

    def receipts(snapshot: Snapshot) -> dict[str, tuple[str, DataFrame]]:
        """New receipts alone; with those of an ingest that was at it at the same time, which the commit makes this one read."""
        there = snapshot.read("receipts", "operation_id string").unionByName(journal).distinct()
        mine = rows.join(there, "operation_id", "left_anti").select(*rows.columns) if run.resumed else rows  # an operation's name holds its run's
        return {"receipts": ("append", ledger.new_receipts(mine, there).where("status <> 'failed'"))}

    _tables(run).commit(receipts, note=run.stamp)
    run.told(rows.where("status <> 'failed'"), "receipts", ["operation_id"])
    run.told(rows.select("operation_id", F.lit(len(ledger.STEPS)).cast("long").alias("pos"), "step", "status"), "runs/events", ["operation_id", "step", "status"])
    artifacts = output.select("operation_id", F.concat(F.lit("wiki/"), "target_path").alias("path"), F.col("content_sha256").alias("sha256"), F.octet_length("markdown").cast("long").alias("size_bytes"))
    run.told(artifacts, "runs/artifacts", ["operation_id", "path"])
    return rows.select("operation_id", "raw_path", "status", "step", "message", "model_calls", "price_cny")


def _maintain(run: Run, output: DataFrame) -> None:
    """Links of old pages that written pages bear on: added, replaced, removed or left."""
    pages = run.kept(vault.pages(run.spark, run.root, run.types), "maintained_from")
    fresh = _embeddings(run, pages, "embeddings")
    current = F.xxhash64(F.get(F.filter(F.transform(links.wikilinks(text.section_body(F.col("markdown"), links.RELATED)), links.normalize_path), lambda x: x.isNotNull()), F.lit(0)))
    has = F.size(links.wikilinks(text.section_body(F.col("markdown"), links.RELATED))) > 0
    rows = pages.select("path", "markdown", F.when(has, current).alias("current")).join(fresh.select("path", "vector"), "path").withColumn("id", F.xxhash64("path"))
    body = rows.select(F.col("id").alias("query"), F.explode(links.body_links(F.col("markdown"))).alias("p")).select("query", F.xxhash64("p").alias("id"))
    moves = related.maintenance(rows.select("id", "vector", "current"), output.select(F.xxhash64("target_path").alias("id")), body)
    moves = moves.where("action in ('add', 'replace', 'remove')").join(rows.select("id", "path", "markdown"), "id")
    target = rows.select(F.col("id").alias("candidate"), F.col("path").alias("candidate_path"))
    made = moves.join(target, "candidate", "left")
    section = text.with_section(F.col("markdown"), "相关页面", F.concat(F.lit("- "), links.wikilink(F.col("candidate_path"))))
    changed = made.select(F.col("path").alias("target_path"), F.when(F.col("action") == "remove", text.without_sections(F.col("markdown"), links.RELATED)).otherwise(section).alias("markdown"), F.sha2("markdown", 256).alias("preimage_sha256"))
    changed = run.kept(changed.where(F.sha2("markdown", 256) != F.col("preimage_sha256")), "maintained")
    vault.write_pages(run.spark, run.root, changed.select("target_path", "markdown"), changed.select("target_path", "preimage_sha256"), run.resumed)


def _embeddings(run: Run, pages: DataFrame, name: str) -> DataFrame:
    """The vectors of all pages, from the vault's cache where their cards are as they were; the cache is brought up to date."""
    card = text.page_card(F.col("title"), F.col("page_type"), F.col("summary"), F.col("path"), F.col("markdown"))
    contract = cache.contract_hash({"dimensions": run.dimensions})
    inputs = pages.select("path", F.sha2(card, 256).alias("input_sha256"), F.col("sha256").alias("content_sha256"), contract.alias("contract"), F.length(card).alias("n_chars"), card.alias("card"))
    schema = "path string, input_sha256 string, content_sha256 string, contract string, vector array<double>"

    def synced(snapshot: Snapshot) -> dict[str, tuple[str, DataFrame]]:
        old = snapshot.read("embeddings", schema).withColumn("ok", F.size("vector") == run.dimensions)
        return {"embeddings": ("replace", run.kept(cache.synced(inputs, old, run.encoder, run.dimensions), name))}

    return _tables(run).commit(synced, note=run.stamp).read("embeddings", schema)


def _index_and_log(run: Run, output: DataFrame, decisions: DataFrame) -> None:
    root = run.root.rstrip("/")
    pages = vault.pages(run.spark, run.root, run.types)
    tension = F.explode(F.filter(F.transform(text.lines(text.section_body(F.col("markdown"), ["矛盾与未解决问题"])), lambda x: text.open_question(x, F.array(x))), lambda q: q.isNotNull()))
    asked = pages.select(tension.alias("question"), "path", "updated").where(F.col("question") != render.EMPTY_SECTION)
    counts = plans.action_counts(decisions.join(output.select("operation_id").distinct(), "operation_id", "left_semi"))
    operations = counts.join(output.select("operation_id", "raw_path").distinct(), "operation_id").select(
        F.date_format(text.operation_date(F.col("operation_id")), "yyyy-MM-dd").alias("log_date"), "operation_id", "raw_path", F.col("create").alias("created"), F.col("update").alias("updated"), "noop"
    )
    schema = "log_date string, pos long, operation_id string, raw_path string, created long, updated long, noop long"
    operations = run.kept(operations, "logged_operations")
    log = _tables(run).commit(lambda s: {"daily_log": ("replace", state.daily_log(operations, s.read("daily_log", schema)))}, note=run.stamp).read("daily_log", schema)
    logs = render.log_pages(log.join(operations.select("log_date").distinct(), "log_date", "left_semi")).select(F.concat(F.lit("logs/"), "log_date", F.lit(".md")).alias("target_path"), "markdown")
    index = render.index_page(pages.select("page_type", "title", "path", "summary", "updated"), asked, list(run.types)).select(F.lit("index.md").alias("target_path"), "markdown")
    system = run.kept(logs.unionByName(index), "system_pages")
    there = vault.text_files(run.spark, f"{root}/wiki", "*.md").select(F.col("path").alias("target_path"), F.col("sha256").alias("preimage_sha256"))
    vault.write_pages(run.spark, run.root, system, system.select("target_path").join(there, "target_path", "left"), run.resumed)

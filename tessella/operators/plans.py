"""From digests and decisions to pages: numbering, grouping, merging, and the chain of joins behind an update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import coverage_policy, labelled, let, strip, strip_frontmatter, summary
from tessella.operators import postings


def numbered(prefix: str, position: Column) -> Column:
    """C-001, CU-012 and so on from positions that start at zero."""
    return F.format_string(f"{prefix}-%03d", position + 1)


def normalized_digest(claims: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and units numbered anew by position, texts trimmed, references led to the new ids.

    claims: ``operation_id``, ``pos``, ``claim_id``, ``text``, ``concept_terms``; units: ``operation_id``, ``pos``, ``content_unit_id``, ``title``,
    ``anchor_unit_id``, ``claim_ids``. A blank title gets a numbered one, a blank anchor the unit itself.
    """
    ids = claims.groupBy("operation_id", "claim_id").agg(F.max("pos").alias("p")).select("operation_id", "claim_id", numbered("C", F.col("p")).alias("new_id"))
    terms = F.array_distinct(F.filter(F.transform("concept_terms", strip), lambda t: t != ""))
    new_claims = claims.select("operation_id", "pos", numbered("C", F.col("pos")).alias("claim_id"), strip(F.col("text")).alias("text"), terms.alias("concept_terms"))
    last = units.groupBy("operation_id", "content_unit_id").agg(F.max("pos").alias("p"))
    unit_ids = last.select("operation_id", "content_unit_id", numbered("CU", F.col("p")).alias("new_unit"))
    refs = units.select("operation_id", "pos", F.posexplode("claim_ids").alias("at", "raw")).withColumn("claim_id", strip(F.col("raw"))).where("claim_id <> ''")
    refs = refs.join(ids, ["operation_id", "claim_id"], "left").withColumn("id", F.coalesce("new_id", "claim_id"))
    lists = refs.groupBy("operation_id", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("r"))
    anchors = unit_ids.select("operation_id", F.col("content_unit_id").alias("anchor"), F.col("new_unit").alias("new_anchor"))
    rows = units.withColumn("anchor", strip(F.col("anchor_unit_id"))).join(unit_ids, ["operation_id", "content_unit_id"]).join(anchors, ["operation_id", "anchor"], "left")
    rows = rows.join(lists, ["operation_id", "pos"], "left")
    title = strip(F.col("title"))
    new_units = rows.select(
        "operation_id", "pos", F.col("new_unit").alias("content_unit_id"),
        F.when(title == "", F.concat(F.lit("未命名内容单元 "), (F.col("pos") + 1).cast("string"))).otherwise(title).alias("title"),
        F.coalesce("new_anchor", F.when(F.col("anchor") != "", F.col("anchor")), "new_unit").alias("anchor_unit_id"),
        F.coalesce(F.array_distinct(F.transform("r", lambda x: x["id"])), F.array().cast("array<string>")).alias("claim_ids"),
    )
    return new_claims, new_units


def content_groups(units: DataFrame) -> DataFrame:
    """``operation_id``, ``anchor_unit_id``, ``members`` (ids in order) for each trunk unit; one without members is its own."""
    anchors = units.where("content_role = '主干'").select("operation_id", F.col("content_unit_id").alias("anchor_unit_id"))
    members = units.groupBy("operation_id", "anchor_unit_id").agg(F.array_sort(F.collect_list(F.struct("pos", "content_unit_id"))).alias("m"))
    rows = anchors.join(members, ["operation_id", "anchor_unit_id"], "left")
    return rows.select("operation_id", "anchor_unit_id", F.coalesce(F.transform("m", lambda x: x["content_unit_id"]), F.array("anchor_unit_id")).alias("members"))


def action_counts(decisions: DataFrame) -> DataFrame:
    """``operation_id``, ``create``, ``update``, ``noop``: zero where an action has no decision."""
    return decisions.groupBy("operation_id").agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("create", "update", "noop")))


def merged_items(items: DataFrame, scalars: list[str], lists: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Items of one target (``operation_id``, ``pos``, ``target_path``) become one: the first one's scalars, ordered distinct unions of the lists.

    ``final_page_id`` numbers the targets in the order in which they first appear. ties: columns that say which of two items at the same position is the
    first. Items without a position come last and give no scalars; where the first one has no value, the next one's is taken.
    """
    item = F.struct(F.col("pos").isNull().alias("late"), "pos", *ties, *scalars, *lists)
    rows = items.groupBy("operation_id", "target_path").agg(F.min("pos").alias("first_pos"), F.array_sort(F.collect_list(item)).alias("m"))
    rank = F.dense_rank().over(Window.partitionBy("operation_id").orderBy(F.col("first_pos").asc_nulls_last())) - 1

    def first(c: str) -> Column:
        return F.get(F.filter("m", lambda x: ~x["late"] & x[c].isNotNull()), F.lit(0))[c].alias(c)

    flat = [F.array_distinct(F.flatten(F.col("m")[c])).alias(c) for c in lists]
    return rows.select("operation_id", numbered("FP", rank).alias("final_page_id"), "target_path", F.size("m").cast("long").alias("n_items"), *map(first, scalars), *flat)


def update_plan(items: DataFrame, pages: DataFrame, units: DataFrame, claims: DataFrame, state: DataFrame) -> DataFrame:
    """``operation_id``, ``target_path``, counts and ids of what an item brings and what its page holds already.

    items: ``operation_id``, ``target_path``, ``candidate_page_ids``; pages: ``operation_id``, ``candidate_page_id``, ``content_unit_id``; units:
    ``operation_id``, ``content_unit_id``, ``anchor_unit_id``, ``claim_ids``; claims: ``operation_id``, ``claim_id``; state: ``page_path``, ``status``, ``coverage_policy``.
    """
    wanted = items.select("operation_id", "target_path", F.explode("candidate_page_ids").alias("candidate_page_id"))
    anchors = wanted.join(pages, ["operation_id", "candidate_page_id"]).select("operation_id", "target_path", F.col("content_unit_id").alias("anchor_unit_id")).distinct()
    brought = anchors.join(units, ["operation_id", "anchor_unit_id"]).select("operation_id", "target_path", "content_unit_id", F.explode_outer("claim_ids").alias("claim_id"))
    used = brought.join(claims.select("operation_id", "claim_id", F.lit(True).alias("known")).distinct(), ["operation_id", "claim_id"], "left")
    keys = ["operation_id", "target_path"]
    # one chain of joins for both lists; the sets leave out what comes twice
    both = used.groupBy(*keys).agg(F.array_sort(F.collect_set("content_unit_id")).alias("unit_ids"), F.array_sort(F.collect_set(F.when(F.col("known"), F.col("claim_id")))).alias("claim_ids"))
    active = (F.col("status") == "活跃") & (F.col("coverage_policy") != "低价值")
    held = state.groupBy(F.col("page_path").alias("target_path")).agg(F.count("*").alias("previous_claims"), F.count_if(active).alias("previous_active"))
    rows = items.select(*keys).join(both, keys, "left").join(held, "target_path", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        *keys, F.coalesce("unit_ids", none).alias("unit_ids"), F.coalesce("claim_ids", none).alias("claim_ids"),
        F.col("previous_claims").isNotNull().alias("state_exists"), F.coalesce("previous_claims", F.lit(0)).alias("previous_claims"),
        F.coalesce("previous_active", F.lit(0)).alias("previous_active"),
    )


def assignment_terms(text: Column) -> Column:
    """Distinct terms: Latin words of three characters and more; CJK runs of up to eight whole, longer ones as 4-grams."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit(r"[a-z0-9][a-z0-9_./+-]{2,}"), 0)
    runs = F.regexp_extract_all(low, F.lit(r"[一-鿿]{2,}"), 0)
    grams = F.transform(runs, lambda r: F.when(F.length(r) <= 8, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 3, F.lit(1))), lambda i: F.substr(r, i, F.lit(4)))))
    return F.array_distinct(F.concat(latin, F.flatten(grams)))


def page_text(title: Column, path: Column, page_type: Column, markdown: Column) -> Column:
    return F.concat_ws(" ", title, path, page_type, summary(strip_frontmatter(markdown), 20, 3000))


def assignment_score(claim_text: Column, concepts: Column, text: Column, claim_terms: Column | None = None) -> Column:
    """Shared terms plus twice the concepts the page names, over the claim's terms."""
    terms = assignment_terms(claim_text) if claim_terms is None else claim_terms
    shared = F.size(F.array_intersect(terms, assignment_terms(text)))
    named = F.size(F.filter(concepts, lambda c: (c != "") & F.contains(text, c))) * 2
    return F.when(F.size(terms) == 0, 0.0).otherwise((shared + named) / F.greatest(F.lit(1), F.size(terms)))


def assigned_claims(claims: DataFrame, pages: DataFrame, planned: DataFrame, few: int = postings.BROADCAST_ASKED, few_concepts: int = postings.NEEDLES_A_TEXT) -> DataFrame:
    """``operation_id``, ``claim_id``, ``final_page_id``, ``score``, ``n_candidates``: the page that speaks most of a claim.

    claims: ``operation_id``, ``claim_id``, ``claim_text`` (text, concepts and locator), ``concept_terms``; pages: ``operation_id``, ``final_page_id``,
    ``text``; planned: ``operation_id``, ``claim_id``, ``final_page_id``. A claim without a planned page may go to any of its own
    operation's; of equal scores the larger id wins. Such claims meet pages by an inverted index, so a pair that shares nothing never
    arises; a claim that shares nothing with any page gets the largest id. Where the claims have few terms and concepts, a page is held
    against them where it lies.
    """
    op = ["operation_id"]
    known = claims.select("operation_id", "claim_id", "claim_text", "concept_terms", assignment_terms(F.col("claim_text")).alias("claim_terms"))
    plan = planned.distinct()
    plan = F.broadcast(plan) if planned.limit(few + 1).count() <= few else plan
    wanted = pages.select("operation_id", "final_page_id", "text").join(plan, ["operation_id", "final_page_id"])
    own = wanted.join(known, ["operation_id", "claim_id"])
    own = own.select("operation_id", "claim_id", "final_page_id", assignment_score(F.col("claim_text"), F.col("concept_terms"), F.col("text"), F.col("claim_terms")).alias("score"))
    best = lambda rows: rows.groupBy("operation_id", "claim_id").agg(F.max(F.struct("score", "final_page_id")).alias("b"), F.count("*").alias("n_candidates"))
    own = best(own).select("operation_id", "claim_id", "b.*", "n_candidates")

    free = known.join(own.select("operation_id", "claim_id"), ["operation_id", "claim_id"], "left_anti").withColumn("n", F.size("claim_terms")).drop("claim_text")
    asked = free.select("operation_id", "claim_id", F.explode("claim_terms").alias("term"), F.lit(1).alias("weight"))
    concepts = free.select("operation_id", "claim_id", F.explode("concept_terms").alias("needle")).where("needle <> ''").groupBy("operation_id", "claim_id", "needle").agg((2 * F.count("*")).alias("weight"))
    held = pages.select("operation_id", "final_page_id", "text", assignment_terms(F.col("text")).alias("terms"))
    if asked.limit(few + 1).count() <= few and concepts.limit(few_concepts + 1).count() <= few_concepts:
        both = postings.points_in_place(asked, concepts, held, op, "claim_id", "final_page_id")
    else:
        shared = postings.points(asked, held.select("operation_id", "final_page_id", F.explode("terms").alias("term")), op, "claim_id", "final_page_id")
        inside = postings.containing(concepts.select("operation_id", "needle").distinct(), pages, op, "final_page_id")
        named = postings.points(concepts.withColumnRenamed("needle", "term"), inside.withColumnRenamed("needle", "term"), op, "claim_id", "final_page_id")
        both = shared.unionByName(named).groupBy("operation_id", "claim_id", "final_page_id").agg(F.sum("points").alias("points"))
    found = both.join(free.where("n > 0").select("operation_id", "claim_id", "n"), ["operation_id", "claim_id"])
    found = best(found.select("operation_id", "claim_id", "final_page_id", (F.col("points") / F.col("n")).alias("score"))).select("operation_id", "claim_id", "b")
    every = pages.groupBy("operation_id").agg(F.max("final_page_id").alias("last"), F.count("*").alias("n_candidates"))
    rest = free.select("operation_id", "claim_id").join(found, ["operation_id", "claim_id"], "left").join(every, "operation_id")
    rest = rest.select("operation_id", "claim_id", F.coalesce("b.score", F.lit(0.0)).alias("score"), F.coalesce("b.final_page_id", "last").alias("final_page_id"), "n_candidates")
    return own.unionByName(rest).select("operation_id", "claim_id", "final_page_id", F.round("score", 4).alias("score"), "n_candidates")


def touched_units(units: DataFrame, claims: DataFrame) -> DataFrame:
    """Units that use any of the claims (``operation_id``, ``claim_id``)."""
    uses = units.select("operation_id", "content_unit_id", F.explode("claim_ids").alias("claim_id"))
    hit = uses.join(claims, ["operation_id", "claim_id"], "left_semi").select("operation_id", "content_unit_id").distinct()
    return units.join(hit, ["operation_id", "content_unit_id"], "left_semi")


def page_item(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Final pages with their item, found by id, else by target; the item's id, path and action replace the page's own."""
    by_id = items.select(F.col("operation_id").alias("o1"), F.col("final_page_id").alias("i_id"), F.col("target_path").alias("i_path"), F.col("action").alias("i_action"))
    first = pages.join(by_id, (F.col("operation_id") == F.col("o1")) & (F.col("final_page_id") == F.col("i_id")), "left")
    again = items.select(F.col("operation_id").alias("o2"), F.col("final_page_id").alias("j_id"), F.col("target_path").alias("j_path"), F.col("action").alias("j_action"))
    rows = first.join(again, (F.col("operation_id") == F.col("o2")) & (F.col("target_path") == F.col("j_path")), "left")
    kept = [c for c in pages.columns if c not in ("final_page_id", "target_path", "action")]
    return rows.select(*kept, *(F.coalesce(f"i_{a}", f"j_{a}").alias(b) for a, b in (("id", "final_page_id"), ("path", "target_path"), ("action", "action"))))


def repaired(pages: DataFrame, repairs: DataFrame, key: str = "final_page_id", value: str = "markdown") -> DataFrame:
    """Pages with the repaired text where there is one, and whether it changed."""
    new = repairs.select(key, F.col(value).alias("_new"))
    rows = pages.join(new, key, "left").withColumn("changed", F.coalesce(F.col("_new") != F.col(value), F.lit(False)))
    return rows.withColumn(value, F.coalesce("_new", value)).drop("_new")


def ordered_hash(rows: DataFrame, keys: list[str], pos: str, columns: list[str]) -> DataFrame:
    """``hash`` over a key's rows in their order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_pos"), *columns)))
    return rows.groupBy(*keys).agg(F.sha2(F.to_json(F.transform(listed, lambda x: F.struct(*(x[c].alias(c) for c in columns)))), 256).alias("hash"))


def claim_policy(units: DataFrame, claims: DataFrame) -> DataFrame:
    """``operation_id``, ``content_unit_id``, ``claim_id``, ``coverage_policy`` for every use of a claim by a unit."""
    uses = units.select("operation_id", "content_unit_id", "content_role", "absorption_decision", F.explode("claim_ids").alias("claim_id"))
    rows = uses.join(claims.select("operation_id", "claim_id", "importance"), ["operation_id", "claim_id"])
    return rows.select("operation_id", "content_unit_id", "claim_id", coverage_policy(F.col("content_role"), F.col("absorption_decision"), F.col("importance")).alias("coverage_policy"))


def best_anchor(found: Column, hint: Column, title: Column) -> Column:
    """First heading that holds, or is held by, the section hint, else the title; else the first heading, else the hint."""
    from tessella.functions.text import heading_key

    def near(wanted: Column) -> Column:
        key = heading_key(wanted)

        def close(h: Column) -> Column:
            k = heading_key(h)
            return (k != "") & (F.contains(k, key) | F.contains(key, k))

        return F.when(key != "", F.get(F.filter(found, close), F.lit(0)))

    return let(F.struct(near(hint).alias("a"), near(title).alias("b")), lambda x: F.coalesce(x["a"], x["b"], F.get(found, F.lit(0)), hint))


def normalized_decisions(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions with what the engine owns put right: ids, types, paths, and where in the candidate they hold.

    decisions: ``operation_id``, ``pos``, ``decision_id``, ``candidate_page_id``, ``action``, ``target_path``, ``page_type``, ``content_scope``, ``locators``;
    candidates: ``operation_id``, ``candidate_page_id``, ``title``, ``summary``, ``content_unit_id``. Blank ids are numbered, only creations keep
    a type, paths lose back slashes and leading ones; decisions without locators get them from their candidate.
    """
    own = candidates.select("operation_id", "candidate_page_id", F.col("title").alias("c_title"), F.col("summary").alias("c_summary"), F.col("content_unit_id").alias("c_unit"))
    rows = decisions.join(own, ["operation_id", "candidate_page_id"], "left")
    given = F.filter(F.coalesce("locators", F.array().cast("array<string>")), lambda x: strip(x) != "")
    made = F.array("content_scope", F.concat(F.lit("候选页标题："), "c_title"), F.concat(F.lit("候选页摘要："), "c_summary"), F.concat(F.lit("内容单元："), "c_unit"))
    usable = F.array_distinct(F.filter(made, lambda x: x.isNotNull() & (strip(x) != "")))
    chosen = F.when(F.size(given) > 0, given).when(F.col("c_unit").isNotNull(), usable).otherwise(given)
    clean = F.regexp_replace(F.replace(strip(F.col("target_path")), F.lit("\\"), F.lit("/")), "^/+", "")
    identity = strip(F.coalesce("decision_id", F.lit("")))
    return rows.select(
        "operation_id", "pos", F.when(identity == "", numbered("MD", F.col("pos"))).otherwise(identity).alias("decision_id"), "candidate_page_id", "action",
        clean.alias("target_path"), F.when(F.col("action") == "create", strip(F.col("page_type"))).alias("page_type"), "content_scope",
        F.transform(chosen, lambda x: labelled(x, "候选内容定位")).alias("locators"), ((F.size(given) == 0) & F.col("c_unit").isNotNull()).alias("locators_repaired"),
    )

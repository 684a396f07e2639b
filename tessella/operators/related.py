"""Upkeep of the links of old pages when pages are written: a link changes only for a clear gain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.vectors import RELATED_LEAST, REPLACE_MARGIN, SAME_BATCH_MOST, cosine, scores


#: Body links of a page up to which its best other candidates are searched for by number, not by threshold alone.
LINKS_MOST = 64


def maintenance(pages: DataFrame, written: DataFrame, links: DataFrame, least: float = RELATED_LEAST, margin: float = REPLACE_MARGIN) -> DataFrame:
    """``id``, ``current``, ``current_score``, ``candidate``, ``candidate_score``, ``action`` of each affected old page.

    pages: ``id``, ``vector``, ``current`` (linked page or null), the whole pool; written: ``id``; links: ``query``, ``id`` of
    body links. A page is affected if it links to a written page or a written page is as near as the threshold (by the
    raw score). Only affected pages are searched. The best candidate's score is rounded, the current link's isn't.
    """
    written = written.select("id").distinct()
    vectors = pages.select("id", "vector")
    old = pages.join(written, "id", "left_anti")
    near = scores(old.select("id", "vector"), vectors.join(written, "id", "left_semi"), top_k=1, least=least, strict=False).select(F.col("query").alias("id"))
    by_link = old.join(written.select(F.col("id").alias("w")), F.col("current") == F.col("w"), "left_semi").select("id")
    affected = old.join(near.unionByName(by_link).distinct(), "id", "left_semi")
    # of one more than a page links to, one at least isn't linked
    most = links.distinct().groupBy("query").count().agg(F.max("count")).first()[0] or 0
    found = scores(affected.select("id", "vector"), vectors, top_k=most + 1 if most <= LINKS_MOST else None, least=least).join(links.distinct(), ["query", "id"], "left_anti")
    best = found.groupBy("query").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), "id")).alias("best"))
    best = best.select(F.col("query").alias("id"), F.col("best.id").alias("candidate"), F.col("best.score").alias("candidate_score"))
    target = vectors.select(F.col("id").alias("current"), F.col("vector").alias("target_vector"))
    linked = links.select(F.col("query").alias("id"), F.col("id").alias("current"), F.lit(True).alias("in_body")).distinct()
    rows = affected.join(best, "id", "left").join(target, "current", "left").join(linked, ["id", "current"], "left")
    score = F.when(F.col("target_vector").isNotNull(), cosine(F.col("vector"), F.col("target_vector")))
    invalid = F.col("target_vector").isNull() | F.coalesce("in_body", F.lit(False))
    action = (
        F.when(F.col("candidate").isNull(), F.when(F.col("current").isNotNull() & invalid, "remove").otherwise("keep_no_candidate"))
        .when(F.col("current").isNull(), "add")
        .when(F.col("current") == F.col("candidate"), "keep_existing")
        .when(invalid, "replace")
        .when(F.col("candidate_score") >= score + margin, "replace")
        .otherwise("keep_existing")
    )
    return rows.select("id", "current", F.round(score, 4).alias("current_score"), "candidate", "candidate_score", action.alias("action"))


def same_batch(refs: DataFrame, batch: DataFrame, most: int = SAME_BATCH_MOST) -> DataFrame:
    """``page``, ``target``, ``rank``: references to pages of the same batch, the first of each, at most ``most`` a page.

    refs: ``page``, ``pos``, ``target``; batch: ``path``. References to the page itself or out of the batch go.
    """
    inside = refs.where("target <> page").join(batch.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    first = inside.groupBy("page", "target").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("pos")))
    return ranked.where(F.col("rank") <= most).select("page", "target", "rank")


def selected(refs: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """Every reference with its ``decision`` and ``reject_reason``: unknown, own or repeated targets are filtered, what
    comes after ``limit`` kept ones is cut off. refs: ``page``, ``pos``, ``target``; known: ``path``."""
    marked = refs.join(known.select(F.col("path").alias("target"), F.lit(True).alias("known")).distinct(), "target", "left")
    nth = F.row_number().over(Window.partitionBy("page", "target").orderBy("pos"))
    reason = F.when(F.col("target") == F.col("page"), "self_link").when(F.col("known").isNull(), "unknown_target").when(nth > 1, "duplicate_target")
    marked = marked.withColumn("why", reason)
    kept = F.sum(F.col("why").isNull().cast("int")).over(Window.partitionBy("page").orderBy("pos"))
    why = F.when(F.col("why").isNotNull(), F.col("why")).when(kept > limit, "limit")
    decision = F.when(F.col("why").isNotNull(), "filtered").when(kept > limit, "cutoff").otherwise("kept")
    return marked.select("page", "pos", "target", decision.alias("decision"), why.alias("reject_reason"))

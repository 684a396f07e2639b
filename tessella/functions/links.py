"""Links between pages: targets, their canonical paths, and the contract that a page's links keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import has_section, let, name_key, strip, strip_frontmatter, without_sections
from tessella.session import spread

# Fixed values.
EXCLUDED_ROOTS = ["raw", "sources", "logs"]
SYSTEM_FILES = ["index.md", "log.md"]
RELATED = ["Related", "相关页面"]
BODY_LINK_LIMIT = 2
TITLE_PREFIXES = "Concept_|Overview_|Design_|Entity_|Comparison_"

WIKILINK = r"\[\[([^\]]+)\]\]"


def clean_target(c: Column) -> Column:
    """Without quoting characters, fragment, query and leading ``./`` or ``/``; back slashes turned."""
    bare = F.trim(F.trim(strip(c), F.lit("`")), F.lit("<>"))
    return F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("\\"), F.lit("/")), r"[#?].*$", ""), r"^(?:\./)*/*", "")


def _parts(c: Column) -> Column:
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    return let(parts, lambda p: F.when(F.get(p, F.lit(0)) == "wiki", F.slice(p, 2, 1 << 20)).otherwise(p))


def stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def _outside(parts: Column) -> Column:
    last = F.lower(stem(F.get(parts, F.size(parts) - 1)))
    inside = F.array_join(parts, "/").isin(SYSTEM_FILES) | F.lower(F.get(parts, F.lit(0))).isin(EXCLUDED_ROOTS) | last.startswith("source_")
    return F.when(F.size(parts) == 0, False).otherwise(inside)


def is_excluded(c: Column) -> Column:
    """Targets outside the graph of pages: system files, raw, source and log folders, source records."""
    return let(_parts(clean_target(c)), _outside)


def normalize_path(c: Column) -> Column:
    """Canonical path of a page below the wiki folder, or null for what can't be one."""

    def checked(cleaned: Column) -> Column:
        bad = strip(c).startswith("/") | (cleaned == "") | F.array_contains(F.split(cleaned, "/"), "..")
        path = let(F.array_join(_parts(cleaned), "/"), lambda j: F.when(j.endswith(".md"), j).otherwise(F.concat(j, F.lit(".md"))))
        return let(path, lambda p: F.when(~bad & ~is_excluded(p), p))

    return let(clean_target(c), checked)


def wikilinks(c: Column) -> Column:
    """Targets of all wikilinks in order, without aliases."""
    found = F.transform(F.regexp_extract_all(c, F.lit(WIKILINK), 1), lambda x: strip(F.split(x, r"\|")[0]))
    return F.filter(found, lambda x: x != "")


def body_links(markdown: Column) -> Column:
    """Canonical targets outside the Related section, distinct, in order."""
    body = without_sections(strip_frontmatter(markdown), RELATED)
    return F.array_distinct(F.filter(F.transform(wikilinks(body), normalize_path), lambda x: x.isNotNull()))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), 1)


def markdown_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), 1)


def links_outside_graph(c: Column) -> Column:
    """Whether any wikilink, Markdown link or href leads to an excluded target."""
    return F.exists(F.concat(wikilinks(c), markdown_links(c), hrefs(c)), lambda t: F.coalesce(is_excluded(t), F.lit(False)))


def wikilink(path: Column, alias: Column | None = None) -> Column:
    target = F.regexp_replace(path, r"\.md$", "")
    plain = F.concat(F.lit("[["), target, F.lit("]]"))
    if alias is None:
        return plain
    name = strip(alias)
    return F.when((F.coalesce(name, F.lit("")) == "") | (name == target), plain).otherwise(F.concat(F.lit("[["), target, F.lit("|"), name, F.lit("]]")))


def display_title(path: Column) -> Column:
    return F.replace(stem(path), F.lit("_"), F.lit(" "))


def plain_text(target: Column, alias: Column) -> Column:
    """What stays of a link whose target is unknown: its alias, else its name without folder and type prefix."""
    name = strip(F.replace(F.regexp_replace(stem(F.replace(strip(target), F.lit("\\"), F.lit("/"))), f"^(?:{TITLE_PREFIXES})", ""), F.lit("_"), F.lit(" ")))
    return F.when(F.coalesce(strip(alias), F.lit("")) != "", strip(alias)).when(name != "", name).otherwise(strip(target))


def link_keys(pages: DataFrame) -> DataFrame:
    """``key``, ``key_path``: pages by the keys of title and file name; of several pages the last in ``pos`` wins."""
    keys = pages.select("pos", "path", F.posexplode(F.array(name_key(F.col("title")), name_key(stem(F.col("path"))))).alias("which", "key"))
    return keys.groupBy("key").agg(F.max_by("path", F.struct("pos", "which")).alias("key_path")).where("key <> ''")


def keyed(targets: DataFrame) -> DataFrame:
    """``targets`` (column ``target``) with the path and the key that pages are found by."""
    return targets.select("*", normalize_path(F.col("target")).alias("_path"), name_key(strip(F.col("target"))).alias("_key"))


def resolve(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Keyed targets with ``resolved``: the page of that path, else that of that title or name, else null.

    pages: ``pos``, ``path``, ``title``. Two equi-joins, one row a page each; pages are what a task holds, so a target that many pages name costs no memory.
    """
    paths = spread(pages.select(F.col("path").alias("known_path")), "known_path").distinct().hint("shuffle_hash")
    keys = spread(link_keys(pages), "key").hint("shuffle_hash")
    rows = spread(targets, "_path").join(paths, F.col("_path") == F.col("known_path"), "left").drop("_path")
    rows = spread(rows, "_key").join(keys, F.col("_key") == F.col("key"), "left")
    return rows.withColumn("resolved", F.coalesce("known_path", "key_path")).drop("_key", "known_path", "key", "key_path")


def canonical_links(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``id``, ``markdown`` with every wikilink led to its page's path; links without a page become plain text.

    The text is cut at its links, the links are resolved by joins and the pieces put together in order again.
    """
    pieces = documents.select("id", F.posexplode(F.split(F.regexp_replace("markdown", WIKILINK, "\u0000\u0001$1\u0000"), "\u0000")).alias("pos", "piece"))
    links = pieces.where(F.col("piece").startswith("\u0001")).select("id", "pos", F.substring("piece", 2, 1 << 20).alias("inner"))
    halves = links.select("id", "pos", F.split("inner", r"\|", 2).alias("h")).select(
        "id", "pos", F.col("h")[0].alias("target"), F.get("h", F.lit(1)).alias("alias")
    )
    found = resolve(keyed(halves), pages)
    text = F.when(F.col("resolved").isNull(), plain_text(F.col("target"), F.coalesce("alias", F.lit("")))).otherwise(
        F.concat(F.lit("[["), F.regexp_replace("resolved", r"\.md$", ""), F.coalesce(F.concat(F.lit("|"), strip(F.col("alias"))), F.lit("")), F.lit("]]"))
    )
    done = pieces.where(~F.col("piece").startswith("\u0001")).unionByName(found.select("id", "pos", text.alias("piece")))
    return done.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("markdown"))


def link_issues(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``path``, ``code`` of every broken rule: at most two body links, none to the page itself, to unknown pages or out
    of the graph, and no Related section of the model's own.

    pages: ``path``, ``title``, ``markdown``; known: ``pos``, ``path``, ``title``.
    """
    body = without_sections(strip_frontmatter(F.col("markdown")), ["相关页面"])
    rows = pages.select("path", "title", body.alias("body")).withColumn("targets", wikilinks(F.col("body")))
    whole = rows.select(
        "path",
        F.explode(
            F.filter(
                F.array(
                    F.when(has_section(F.col("body"), ["Related"]), "model_related_section"),
                    F.when(F.size("targets") > BODY_LINK_LIMIT, "body_wikilink_too_many"),
                    F.when(links_outside_graph(F.col("body")), "source_graph_link"),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("code"),
    )
    mine = rows.select(F.col("path").alias("page"), normalize_path(F.col("path")).alias("page_path"), name_key(F.col("title")).alias("title_key"), name_key(stem(F.col("path"))).alias("stem_key"), "targets")
    each = keyed(mine.select("page", "page_path", "title_key", "stem_key", F.explode("targets").alias("target")))
    own = (F.col("_path") == F.col("page_path")) | (F.col("_key") == F.col("title_key")) | (F.col("_key") == F.col("stem_key"))
    gone = F.when(F.col("_path").isNull(), "body_wikilink_invalid_target").otherwise("body_wikilink_unknown_target")
    found = resolve(each.select("page", "_path", "_key", own.alias("own"), gone.alias("gone")), known)
    codes = F.array(F.when(F.col("own"), "self_wikilink"), F.when(F.col("resolved").isNull(), F.col("gone")))
    return whole.unionByName(found.select(F.col("page").alias("path"), F.explode(F.array_compact(codes)).alias("code")))

"""How much a raw document holds: counts, a suggested number of pages, and whether it is an error page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import SPACE, let, lines, strip, strip_frontmatter

# Fixed values.
NAVIGATION = r"\b(skip to|search|sign in|log in|navigation|menu|footer|header|breadcrumb)\b"
LINK_BULLET = r"^[-*+]\s*(\[.*?\]\(.*?\)\s*)+$"
FENCE = r"(?s)```.*?```"
NOT_FOUND = "page not found|not found|404|403 forbidden|access denied"
WARNED = r"(?im)^\s*warning:\s*target url returned error\s+(?:401|403|404|410)\b"
TITLED = rf"(?im)^\s*title:\s*[\"']?(?:{NOT_FOUND})[\"']?\s*$"
HEADED = rf"(?im)^\s*#\s*(?:{NOT_FOUND})\s*$"
SOURCED = r"(?im)^\s*(?:url source|source url):.*$"
HEADED_PLAIN = r"(?im)^\s*#\s*(?:page not found|not found)\s*$"
NOISE_REASON = r"404|not found|无法访问|导航|菜单|噪声|重复|证据不足|空页面|错误页"


def is_navigation(line: Column) -> Column:
    """Short lines that name a part of a site's frame, hold several links, or are a bullet of links only."""

    def of(bare: Column) -> Column:
        links = (F.length(bare) - F.length(F.replace(bare, F.lit("](")))) / 2
        named = (F.length(bare) <= 80) & F.lower(bare).rlike(NAVIGATION)
        return (bare != "") & (F.length(bare) <= 120) & (named | (links >= 2) | bare.rlike(LINK_BULLET))

    return let(strip(line), of)


def is_error_page(text: Column) -> Column:
    body = strip_frontmatter(text)
    return body.rlike(WARNED) | (body.rlike(TITLED) & body.rlike(HEADED)) | (body.rlike(SOURCED) & body.rlike(HEADED_PLAIN))


def _dense(c: Column) -> Column:
    return F.length(F.regexp_replace(c, SPACE + "+", ""))


def stats(text: Column, raw_size: Column | None = None) -> Column:
    """A struct of the counts and the suggested range; one pass over the text, no Python."""

    def of(body: Column) -> Column:
        no_code = F.regexp_replace(body, FENCE, "\n")

        def of_lines(rows: Column) -> Column:
            kept = F.filter(rows, lambda x: ~is_navigation(x))
            return let(kept, lambda k: F.struct((F.size(rows) - F.size(k)).alias("noise"), F.array_join(k, "\n").alias("content")))

        def of_content(plain: Column) -> Column:
            parts = F.filter(F.split(plain["content"], rf"\n{SPACE}*\n"), lambda x: strip(x) != "")
            return let(_dense(plain["content"]), lambda n: row(n, parts, plain["noise"]))

        def row(n: Column, parts: Column, noise: Column) -> Column:
            target = F.greatest(F.lit(1.0), 1.0 + F.greatest(F.lit(0), n - 2500) / 5000.0)
            low = F.greatest(F.lit(1), F.floor(target * 0.6)).cast("long")
            high = F.when(n <= 1200, 1).otherwise(F.greatest(low, F.floor(target * 1.45 + 0.999))).cast("long")
            return F.struct(
                (F.octet_length(text) if raw_size is None else raw_size).cast("long").alias("raw_size_bytes"),
                _dense(body).cast("long").alias("char_count"),
                n.cast("long").alias("effective_char_count"),
                F.size(parts).cast("long").alias("paragraph_count"),
                F.size(F.regexp_extract_all(no_code, F.lit(r"(?m)^\s{0,3}#{1,6}\s+\S"), 0)).cast("long").alias("heading_count"),
                F.size(F.regexp_extract_all(body, F.lit(FENCE), 0)).cast("long").alias("code_block_count"),
                F.size(F.regexp_extract_all(no_code, F.lit(r"\[[^\]]+\]\([^)]+\)"), 0)).cast("long").alias("markdown_link_count"),
                noise.cast("long").alias("navigation_noise_line_count"),
                low.alias("suggested_min_candidate_pages"),
                (F.floor(target * 100 + 0.5) / 100).alias("suggested_target_candidate_pages"),
                high.alias("suggested_max_candidate_pages"),
            )

        return let(let(lines(no_code), of_lines), of_content)

    return let(strip_frontmatter(text), of)


def boundary_violations(digests: DataFrame) -> DataFrame:
    """``operation_id``, ``rule`` for digests that claim too much or too little of their raw text.

    digests: ``operation_id``, ``text``, ``n_claims``, ``n_units``, ``n_groups``, ``noise_reasons`` (one string).
    """
    rows = digests.select("*", stats(F.col("text")).alias("s"), is_error_page(F.col("text")).alias("error_page"))
    noisy = F.lower("noise_reasons").rlike(NOISE_REASON)
    none_allowed = (F.col("n_claims") == 0) & ((F.col("s.effective_char_count") < 600) | F.coalesce(noisy, F.lit(False)))
    rules = F.array(
        F.when(F.col("error_page") & ((F.col("n_claims") > 0) | (F.col("n_units") > 0)), "error_page_with_claims"),
        F.when((F.col("n_groups") == 0) & ~none_allowed, "no_groups"),
        F.when(F.col("n_groups") > F.col("s.suggested_max_candidate_pages"), "too_many_groups"),
    )
    return rows.select("operation_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))

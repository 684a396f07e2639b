"""Text and Markdown as column expressions; nothing here leaves the JVM but YAML and embedded JSON.

White space means Unicode white space and the separators U+001C to U+001F throughout, written out as a class: that is
what the data model's strings are stripped by, and several times faster than the regex flag for Unicode classes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

SPACE = r"[\s\p{Z}\x85\x1c-\x1f]"
#: All its characters, for trimming from the ends, which reads no further than it must.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
OTHER_LINE_ENDS = "[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\u2028\u2029]"

# Fixed values.
SENTENCE_ENDS = "。！？.!?"
CJK = r"[㐀-鿿]"
COVERAGE_SCORES = {"covered": 1.0, "partial": 0.5}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def strip_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def canonical_hash(*columns: Column | str) -> Column:
    """sha256 of a JSON object whose keys are the columns' names in the order given; callers sort them."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def lines(c: Column) -> Column:
    """Lines without their ends; a final line end starts no further line. Text whose only line ends are \\n is split by that alone, which needs no pattern."""

    def cut(x: Column) -> Column:
        plain = F.split(F.when(x.endswith("\n"), F.regexp_replace(x, "\n$", "")).otherwise(x), "\n")
        other = F.split(F.regexp_replace(x, f"(?:{LINE_ENDS})$", ""), LINE_ENDS)
        return F.when(x == "", F.array().cast("array<string>")).when(x.rlike(OTHER_LINE_ENDS), other).otherwise(plain)

    return let(c, cut)


def strip_frontmatter(c: Column) -> Column:
    """Without a header between ``---`` lines; the end is looked for from the fifth character on."""
    end = F.locate("\n---", c, 5)
    rest = F.ltrim(c.substr(end + 4, F.length(c)), F.lit(SPACES))
    return F.when(c.startswith("---\n") & (end > 0), rest).otherwise(c)


def title(c: Column, fallback: Column | str) -> Column:
    """First ``# `` line, else the first line that isn't blank cut to 80 characters, else the fallback."""
    back = F.lit(fallback) if isinstance(fallback, str) else fallback

    def pick(stripped: Column) -> Column:
        head = F.get(F.filter(stripped, lambda x: x.startswith("# ")), F.lit(0))
        named = strip(F.substring(head, 3, 1 << 20))
        first = F.get(F.filter(stripped, lambda x: x != ""), F.lit(0))
        return F.when(head.isNotNull(), F.when(named == "", back).otherwise(named)).otherwise(F.coalesce(F.substring(first, 1, 80), back))

    return let(F.transform(lines(c), strip), pick)


def _flat(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends; a single blank is no match."""
    return strip(F.regexp_replace(c, rf"{SPACE}{{2,}}|[{SPACE}&&[^ ]]", " "))


def _flat_sentences(flat: Column) -> Column:
    """Only single blanks are left, so a sentence has none at its ends; looked for by the blank, which costs less than looking behind every character."""
    return F.filter(F.split(flat, rf" (?<=[{SENTENCE_ENDS}] )"), lambda s: s != "")


def sentences(c: Column) -> Column:
    return _flat_sentences(_flat(c))


def summary(c: Column, most_sentences: int = 2, most_chars: int = 240) -> Column:
    """The first sentences, cut; they are what the flat text begins with, so no more of it than shows is taken apart."""
    return summary_of(_flat_sentences(F.substring(_flat(c), 1, most_chars + 2)), most_sentences, most_chars)


def summary_of(found: Column, most_sentences: int = 2, most_chars: int = 240) -> Column:
    """The first of a text's sentences, cut."""

    def cut(text: Column) -> Column:
        short = F.concat(strip_end(F.substring(text, 1, most_chars - 1)), F.lit("..."))
        return F.when(F.length(text) <= most_chars, text).otherwise(short)

    return let(F.array_join(F.slice(found, 1, most_sentences), " "), cut)


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def heading_key(c: Column) -> Column:
    """Lower case, CJK and ASCII letters and digits only: the key that headings and titles are compared by."""
    return F.regexp_replace(F.lower(c), r"[^一-鿿A-Za-z0-9]", "")


def name_key(c: Column) -> Column:
    """Lower case letters and digits of any script: the key that link targets are compared by."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def excerpt(c: Column, most: int) -> Column:
    """Runs of blank lines shortened, trimmed and cut; with a flag that says whether it was cut."""

    def cut(text: Column) -> Column:
        return F.struct(strip_end(F.substring(text, 1, most)).alias("text"), (F.length(text) > most).alias("truncated"))

    return let(strip(F.regexp_replace(c, r"\n{3,}", "\n\n")), cut)


def _heading(line: Column) -> Column:
    """Text of a second-level heading, else null."""
    bare = strip(line)
    return F.when(bare.startswith("## "), F.lower(strip(F.substring(bare, 4, 1 << 20))))


def _sections(c: Column, headings: list[str], wanted: bool) -> Column:
    """Lines inside (or outside) second-level sections with these headings: slices between one heading and the next."""
    names = [h.lower() for h in headings]

    def cut(found: Column) -> Column:
        heads = F.filter(F.transform(found, lambda x, i: F.struct(i.alias("at"), _heading(x).alias("name"))), lambda h: h["name"].isNotNull())
        top = F.array(F.struct(F.lit(-1 if wanted else 0).alias("at"), F.lit(None).cast("string").alias("name")))  # what stands before the first heading

        def kept(h: Column, first: Column, end: Column) -> Column:
            inside = F.coalesce(h["name"].isin(names), F.lit(False))
            return F.when(inside if wanted else ~inside, F.slice(found, first + 1, F.greatest(end - first, F.lit(0)))).otherwise(F.array().cast("array<string>"))

        def parts(s: Column) -> Column:
            end = lambda i: F.coalesce(F.get(s, i + 1)["at"], F.size(found))
            return F.flatten(F.transform(s, lambda h, i: kept(h, h["at"] + 1 if wanted else h["at"], end(i))))

        return F.array_join(let(F.concat(top, heads), parts), "\n")

    return let(lines(c), cut)


def without_sections(c: Column, headings: list[str]) -> Column:
    return _sections(c, headings, wanted=False)


def section_body(c: Column, headings: list[str]) -> Column:
    return strip(_sections(c, headings, wanted=True))


def has_section(c: Column, headings: list[str]) -> Column:
    return F.exists(lines(c), lambda x: F.coalesce(_heading(x).isin([h.lower() for h in headings]), F.lit(False)))


def _section(headings: list[str]) -> str:
    """Pattern of the second-level sections with these headings, up to the next one or the end."""
    names = "|".join(re.escape(h) for h in headings)
    return rf"(?ms)^[ \t]*##[ ]+(?:{names})[ \t]*$.*?(?=^[ \t]*##[ ]|\z)"


def cut_sections(c: Column, headings: list[str]) -> Column:
    """The text without these sections and otherwise as it is, its line ends too, which without_sections doesn't keep."""
    return F.regexp_replace(c, F.lit(_section(headings)), F.lit(""))


def with_section(c: Column, heading: str, body: Column, blanks: str = SPACES) -> Column:
    """The section with this heading replaced, or appended where there is none; blanks at the text's end go."""
    block = F.concat(F.lit(f"## {heading}\n\n"), body)
    end = lambda x: F.rtrim(x, F.lit(blanks))

    def put(x: Column) -> Column:
        replaced = F.regexp_replace(x, F.lit(_section([heading])), F.concat(F.regexp_replace(block, r"([\\$])", r"\\$1"), F.lit("\n\n")))
        appended = F.concat(end(x), F.lit("\n\n"), block, F.lit("\n"))
        return F.when(has_section(x, [heading]), F.concat(end(replaced), F.lit("\n"))).otherwise(appended)

    return let(c, put)


def headings(c: Column, deepest: int = 3) -> Column:
    """Distinct headings of the first levels in order, header aside."""

    def name(line: Column) -> Column:
        return F.regexp_extract(strip(line), rf"^(?:#[^ ]{{0,{deepest - 1}}}) (.*)$", 1)

    return F.array_distinct(F.filter(F.transform(lines(strip_frontmatter(c)), lambda x: strip(name(x))), lambda x: x != ""))


def coverage_headings(c: Column, title_column: Column, generic: list[str], most: int = 8) -> Column:
    """Headings that can stand for content: neither the title nor a generic one."""
    keys = [g.lower() for g in generic]
    return F.slice(F.filter(headings(c), lambda h: (heading_key(h) != heading_key(title_column)) & ~F.lower(h).isin(keys)), 1, most)


def demoted(c: Column) -> Column:
    """First- and second-level headings inside a section body become third-level ones."""
    return F.regexp_replace(c, r"(?m)^(\s*)#{1,2} ", "$1### ")


def slug(c: Column, fallback: str) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(made, F.lit("")) == "", F.lit(fallback)).otherwise(made)


def safe_filename(c: Column, fallback: str = "untitled") -> Column:
    made = F.regexp_replace(strip(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]+', "_")), "^[._]+|[._]+$", "")
    return F.when(F.coalesce(made, F.lit("")) == "", F.lit(fallback)).otherwise(made)


def utc_now() -> Column:
    return F.date_format(F.date_trunc("second", F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def operation_date(operation_id: Column) -> Column:
    """Date in an operation id, else today."""
    digits = F.regexp_extract(operation_id, r"ING-(\d{8})T", 1)
    return F.coalesce(F.to_date(F.nullif(digits, F.lit("")), "yyyyMMdd"), F.current_date())


def card(*parts: Column) -> Column:
    """Parts that aren't blank, trimmed, with a blank line between: what an embedder reads."""
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda p: strip(F.coalesce(p, F.lit("")))), lambda p: p != ""), "\n\n")


def page_card(page_title: Column, page_type: Column, page_summary: Column, path: Column, markdown: Column, most: int = 6000) -> Column:
    body = without_sections(strip_frontmatter(markdown), ["Related", "相关页面"])
    return excerpt(card(page_title, page_type, page_summary, path, body), most)["text"]


def labelled(c: Column, label: str) -> Column:
    """The label put before text without CJK letters, so that it reads as Chinese."""
    text = strip(c)
    return F.when(has_cjk(text) | (text == ""), text).otherwise(F.concat(F.lit(f"{label}："), text))


def yaml_scalar(c: Column) -> Column:
    """A string as a YAML scalar: JSON's quoting is YAML's too."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)


def yaml_list(name: str, items: Column) -> Column:
    body = F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), yaml_scalar(x))), "\n"))
    return F.when(F.size(items) == 0, F.lit(f"{name}: []")).otherwise(body)


def state_id(operation_id: Column, local_id: Column) -> Column:
    return F.concat_ws(":", operation_id, local_id)


def coverage_policy(role: Column, decision: Column, importance: Column) -> Column:
    """What must survive of a claim; the rules hold in this order."""
    return F.when((decision == "降级为段落") & (importance <= 2), "低价值").when((role == "主干") | (importance >= 4), "必须保留").otherwise("可摘要")


def coverage_score(status: Column) -> Column:
    out = F.lit(0.0)
    for name, value in COVERAGE_SCORES.items():
        out = F.when(status == name, value).otherwise(out)
    return out


def percent(score: Column, total: Column) -> Column:
    """100 where there is nothing to cover."""
    return F.when(F.coalesce(total, F.lit(0)) <= 0, 100.0).otherwise(F.round(score * 100.0 / total, 2))


def open_question(question: Column, body_lines: Column) -> Column:
    """A question as it is if it has CJK letters; a bare locator becomes the first line with CJK letters that names it."""
    text = strip(F.regexp_replace(question, r"^\s*[-*+]\s*", ""))
    found = F.get(F.filter(body_lines, lambda x: x.contains(text) & has_cjk(x)), F.lit(0))
    return F.when(text == "", None).when(has_cjk(text), text).otherwise(strip(F.regexp_replace(found, r"^\s*[-*+]\s*", "")))


@F.pandas_udf(MapType(StringType(), ArrayType(StringType())))
def frontmatter(text: pd.Series) -> pd.Series:
    """A YAML header as lists of strings by key; null without a header or with a broken one.

    YAML has no form in column expressions. Lists keep their strings that aren't blank, scalars are lists of one.
    """
    import yaml

    def read(t: str | None) -> dict[str, list[str]] | None:
        if not t or not t.startswith("---\n") or (end := t.find("\n---", 4)) < 0:
            return None
        try:
            data = yaml.safe_load(t[4:end])
        except (yaml.YAMLError, ValueError):  # ValueError: a date that no calendar has
            return None
        if not isinstance(data, dict):
            return None
        return {str(k): [str(x).strip() for x in (v if isinstance(v, list) else [v]) if x is not None and str(x).strip()] for k, v in data.items()}

    return text.map(read)


@F.pandas_udf(StringType())
def json_object(text: pd.Series) -> pd.Series:
    """The first JSON object in an answer, written again; null without one. Backtracking over braces has no column form."""
    import json

    decoder = json.JSONDecoder()

    def read(t: str | None) -> str | None:
        at = (t or "").find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(t, at)
            except ValueError:
                value = None
            if isinstance(value, dict):
                return json.dumps(value, ensure_ascii=False)
            at = t.find("{", at + 1)
        return None

    return text.map(read)


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series, name: pd.Series) -> pd.Series:
    """A page's change as a unified diff; finding the longest common runs has no column form."""
    import difflib

    def of(a: str | None, b: str | None, path: str) -> str:
        return "\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), f"a/{path}", f"b/{path}", lineterm=""))

    return pd.Series([of(*x) for x in zip(old, new, name)])

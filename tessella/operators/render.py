"""Tables, index, log and reports as Markdown, put together on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.links import wikilink
from tessella.functions.text import SPACE, demoted, lines, strip

# Fixed values.
TYPE_HEADINGS = {
    "concept": "概念", "entity": "实体", "design": "设计", "comparison": "对比", "overview": "总览", "event": "事件", "memory": "记忆", "idea": "想法", "open_question": "未决问题页",
}
INDEX_COLUMNS = ["标题", "页面", "摘要", "更新日期"]
LOG_COLUMNS = ["操作", "原始材料", "新建数", "实际更新数", "未改动数"]
EMPTY_SECTION = "暂无。"


def cell(c: Column) -> Column:
    """A table cell: white space collapsed, lines joined by breaks, bars escaped."""
    text = strip(F.coalesce(c.cast("string"), F.lit("")))
    many = F.array_join(F.transform(lines(text), strip), "<br>")
    return F.replace(F.when(text.contains("\n"), many).otherwise(F.regexp_replace(text, SPACE + "+", " ")), F.lit("|"), F.lit(r"\|"))


def row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in cells)), F.lit(" |"))


def head(names: list[str]) -> str:
    return "| " + " | ".join(names) + " |\n| " + " | ".join("---" for _ in names) + " |"


def type_heading(page_type: Column) -> Column:
    out = F.initcap(F.replace(page_type, F.lit("_"), F.lit(" ")))
    for name, shown in TYPE_HEADINGS.items():
        out = F.when(page_type == name, shown).otherwise(out)
    return out


def index_tables(entries: DataFrame) -> DataFrame:
    """``page_type``, ``n_pages``, ``table``: each type's pages, newest first, ties by title and path, all descending.

    entries: ``page_type``, ``title``, ``path``, ``summary``, ``updated``. A page's row is made before rows are gathered by type.
    """
    made = row(F.col("title"), wikilink(F.col("path")), F.col("summary"), F.col("updated"))
    keyed = entries.select("page_type", F.struct(F.coalesce("updated", F.lit("")).alias("u"), "title", "path", made.alias("row")).alias("r"))
    listed = keyed.groupBy("page_type").agg(F.count("*").alias("n_pages"), F.sort_array(F.collect_list("r"), asc=False).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["row"]), "\n")
    return listed.select("page_type", "n_pages", F.concat(F.lit(head(INDEX_COLUMNS) + "\n"), body).alias("table"))


def index_page(entries: DataFrame, questions: DataFrame, type_order: list[str]) -> DataFrame:
    """``markdown`` of the index: a table for each type in the given order, other types after, then open questions
    (``question``, ``path``, ``updated``)."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, type_order)), F.col("page_type")), F.lit(0))
    sections = index_tables(entries).select(F.when(rank == 0, len(type_order) + 1).otherwise(rank).alias("o"), "page_type", F.concat(F.lit("## "), type_heading(F.col("page_type")), F.lit("\n\n"), "table").alias("s"))
    body = sections.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "page_type", "s"))), lambda x: x["s"]), "\n\n").alias("body"))
    asked = questions.agg(F.array_join(F.array_sort(F.collect_list(row(F.col("question"), wikilink(F.col("path")), F.col("updated")))), "\n").alias("asked"))
    none = F.lit("| 暂无未决问题记录 |  |  |")
    empty = F.lit("## 知识页\n\n" + head(INDEX_COLUMNS) + "\n| 暂无知识页记录 |  |  |  |")
    parts = F.concat(
        F.lit("# 索引\n\n"), F.when(F.col("body") == "", empty).otherwise(F.col("body")), F.lit("\n\n## 矛盾与未解决问题\n\n" + head(["问题", "关联页面", "更新日期"]) + "\n"),
        F.when(F.col("asked") == "", none).otherwise(F.col("asked")), F.lit("\n"),
    )
    return body.crossJoin(asked).select(parts.alias("markdown"))  # one row each


def log_pages(log: DataFrame) -> DataFrame:
    """``log_date``, ``markdown`` from the rows of a daily log."""
    made = row(F.concat(F.lit("`"), "operation_id", F.lit("`")), F.concat(F.lit("`"), "raw_path", F.lit("`")), F.col("created"), F.col("updated"), F.col("noop"))
    listed = log.groupBy("log_date").agg(F.array_sort(F.collect_list(F.struct("pos", made.alias("row")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["row"]), "\n")
    return listed.select("log_date", F.concat(F.lit("# "), F.col("log_date").cast("string"), F.lit("\n\n" + head(LOG_COLUMNS) + "\n"), body, F.lit("\n")).alias("markdown"))


def page_body(sections: DataFrame, required: list[str]) -> DataFrame:
    """``final_page_id``, ``markdown``, ``problem``: sections (``final_page_id``, ``heading``, ``body_markdown``) in the required order.

    Headings inside a section become third-level ones; sections that are missing, repeated or not asked for are a problem.
    """
    wanted = F.array(*map(F.lit, required))
    rows = sections.groupBy("final_page_id").agg(F.collect_list(strip(F.col("heading"))).alias("h"), F.collect_list(F.struct(strip(F.col("heading")).alias("k"), F.col("body_markdown").alias("v"))).alias("s"))
    problem = (
        F.when(F.size(F.array_distinct("h")) < F.size("h"), "repeated_section")
        .when(F.size(F.array_except(wanted, "h")) > 0, "missing_section")
        .when(F.size(F.array_except("h", wanted)) > 0, "unknown_section")
    )

    def section(name: Column) -> Column:
        body = demoted(strip(F.get(F.filter("s", lambda x: x["k"] == name), F.lit(0))["v"]))
        return F.concat(F.lit("## "), name, F.lit("\n\n"), F.when(F.coalesce(body, F.lit("")) == "", EMPTY_SECTION).otherwise(body))

    text = F.array_join(F.transform(wanted, section), "\n\n")
    return rows.select("final_page_id", F.when(problem.isNull(), text).alias("markdown"), problem.alias("problem"))


def source_records(final: DataFrame) -> DataFrame:
    """``operation_id``, ``markdown``: for each raw file the pages made from it. final: ``operation_id``, ``raw_path``, ``raw_sha256``, ``target_path``."""
    listed = final.groupBy("operation_id", "raw_path", "raw_sha256").agg(F.array_sort(F.collect_set("target_path")).alias("t"))
    made = F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), wikilink(x))), "\n")
    name = F.regexp_extract("raw_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    text = F.concat(F.lit("# Source "), name, F.lit("\n\n- raw: `"), "raw_path", F.lit("`\n- sha256: `"), "raw_sha256", F.lit("`\n\n## 派生页面\n\n"), F.when(F.size("t") == 0, "- 无").otherwise(made), F.lit("\n"))
    return listed.select("operation_id", F.concat(F.lit("sources/Source_"), name, F.lit(".md")).alias("target_path"), text.alias("markdown"))


def report(found: DataFrame, key: str, title: str, columns: list[str]) -> DataFrame:
    """``key``, ``markdown``: the rows of each key (by ``pos``) as a table below a title; what people read of an artifact."""
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", row(*(F.col(c) for c in columns)).alias("row")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["row"]), "\n")
    return listed.select(key, F.concat(F.lit(f"# {title}\n\n{head(columns)}\n"), body, F.lit("\n")).alias("markdown"))

"""Vaults: folders of raw files and Markdown pages, read and written through Spark, so that any Hadoop store will do."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.links import stem
from tessella.functions.text import SPACE, frontmatter, sha256, strip_frontmatter, summary, title
from tessella.sources import page_sink

# Fixed values.
SYSTEM = r"^(?:index\.md|log\.md|logs/.*|sources/.*)$"
EXCERPT = 1200
#: Parts of a pool that are hashed one by one.
POOL_PARTS = 4096
LAYOUT = ["raw", "wiki", "state", "cache", "receipts", "runs"]
TYPES = {"concept": "concepts", "overview": "overviews", "design": "designs", "entity": "entities", "comparison": "comparisons"}


def text_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path`` (below root), ``text``, ``sha256``, ``size_bytes``, ``modified`` of all files below a folder.

    Bytes that aren't UTF-8 are an error when their text is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/*", "/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.concat(F.lit("^\\Q"), base, F.lit("\\E/*")), F.lit(""))
    return files.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def page_type_rows(spark: SparkSession, types: dict[str, str] | None = None) -> DataFrame:
    """``pos``, ``page_type``, ``directory``, ``title_prefix``: a handful of rows."""
    rows = [(i, t, d, f"{t.capitalize()}_") for i, (t, d) in enumerate((types or TYPES).items())]
    return spark.createDataFrame(rows, "pos int, page_type string, directory string, title_prefix string")


def pages(spark: SparkSession, root: str, types: dict[str, str] | None = None, type_key: str = "page_type") -> DataFrame:
    """Knowledge pages of a vault's wiki folder: header fields, title, summary, excerpt; system pages and unknown types left out."""
    return parsed_pages(text_files(spark, f"{root.rstrip('/')}/wiki", "*.md").where(~F.col("path").rlike(SYSTEM)), types, type_key)


def parsed_pages(files: DataFrame, types: dict[str, str] | None = None, type_key: str = "page_type") -> DataFrame:
    """files: ``path``, ``text``, ``sha256``. The type is the header's ``type_key``, or another key that ends so, or that of the page's folder."""
    names = list(types or TYPES)
    rows = files.withColumn("fm", frontmatter(F.col("text"))).withColumn("body", strip_frontmatter(F.col("text")))
    one = lambda key: F.get(F.try_element_at("fm", F.lit(key)), F.lit(0))
    many = lambda key: F.coalesce(F.try_element_at("fm", F.lit(key)), F.array().cast("array<string>"))
    other = F.get(F.filter(F.map_keys("fm"), lambda k: k.endswith("_type")), F.lit(0))
    kind = F.coalesce(one(type_key), F.get(F.try_element_at("fm", other), F.lit(0)), type_of_path(F.col("path"), types, names[0]))
    return rows.withColumn("page_type", kind).where(F.col("page_type").isin(names)).select(
        "path", F.coalesce(one("title"), title(F.col("body"), stem(F.col("path")))).alias("title"), "page_type", "sha256",
        F.coalesce(one("summary"), summary(F.col("body"))).alias("summary"), many("aliases").alias("aliases"), F.coalesce(one("created"), F.lit("")).alias("created"),
        F.coalesce(one("updated"), F.lit("")).alias("updated"), *(many(k).alias(k) for k in ("source_raw_paths", "source_raw_hashes", "source_prepared_hashes", "source_operation_ids")),
        F.substring("body", 1, EXCERPT).alias("text_excerpt"), F.col("text").alias("markdown"),
    )


def pool_hash(entries: DataFrame) -> DataFrame:
    """``pool_hash`` over paths and contents, whatever their order: a hash over POOL_PARTS hashes, each over the entries, in the order
    of the paths, whose path falls to it. No row holds the whole pool."""
    part = F.pmod(F.xxhash64("path"), F.lit(POOL_PARTS)).alias("part")
    hashed = lambda *c: F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*c)))), 256)
    parts = entries.groupBy(part).agg(hashed("path", "sha256").alias("h"))
    return parts.agg(hashed("part", "h").alias("pool_hash"))


def type_of_path(path: Column, types: dict[str, str] | None = None, default: str = "concept") -> Column:
    """The first type, in the order of declaration, whose folder the path lies in."""
    out = F.lit(default)
    for name, directory in reversed((types or TYPES).items()):
        out = F.when(path.startswith(f"{directory}/"), name).otherwise(out)
    return out


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """Raw files of a vault, ``raw_path`` from the vault's root."""
    files = text_files(spark, f"{root.rstrip('/')}/raw")
    return files.select(F.concat(F.lit("raw/"), "path").alias("raw_path"), "text", F.col("sha256").alias("raw_sha256"), "size_bytes", "modified")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """``raw_path``, ``operation_id`` of a receipts file of JSON lines; lines that don't parse are left out."""
    return spark.read.schema("operation_id string, raw_path string").option("mode", "DROPMALFORMED").json(path)


def resolve_raw(name: str) -> str:
    """A raw path given by a user, below ``raw/``; what leaves that folder is refused."""
    parts = [p for p in name.replace("\\", "/").removeprefix("raw/").split("/") if p not in ("", ".")]
    if not parts or ".." in parts or name.startswith("/"):
        raise ValueError(f"not a path below raw/: {name}")
    return "raw/" + "/".join(parts)


def merged_config(*levels: dict[str, Any]) -> dict[str, Any]:
    """Settings from general to particular: later levels win, key by key."""
    out: dict[str, Any] = {}
    for level in levels:
        out.update(level or {})
    return out


def canonical_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def append(df: DataFrame, path: str) -> None:
    """Append rows to a journal of JSON lines; Spark's commit makes them visible together."""
    df.write.mode("append").json(path)


def tracked_by_git(folder: str) -> list[str]:
    """Files of a local folder that git tracks; a vault's own folders should have none. Empty where there is no git."""
    import subprocess

    try:
        found = subprocess.run(["git", "-C", folder, "ls-files"], capture_output=True, text=True, timeout=30, check=False)
    except (OSError, subprocess.SubprocessError):
        return []
    return found.stdout.split("\n")[:-1] if found.returncode == 0 else []


def initialise(spark: SparkSession, root: str) -> list[str]:
    """Make the layout of a vault; what is there already stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    made = []
    for name in LAYOUT:
        folder = path(f"{root.rstrip('/')}/{name}")
        if not fs.exists(folder):
            fs.mkdirs(folder)
            made.append(name)
    return made


def write_pages(spark: SparkSession, root: str, new: DataFrame, preimages: DataFrame, again: bool = False) -> DataFrame:
    """Write pages (``target_path``, ``markdown``) whose present content is still what was seen; ``target_path``, ``content_sha256``.

    preimages: ``target_path``, ``preimage_sha256`` (null: the page must not exist). Any page that changed meanwhile stops the
    whole write before anything is in place. again: the write may have been made before, by a run that was stopped; a page that holds
    the new text already is done then. Tasks write the files, the driver only has them moved; see page_sink.
    """
    page_sink.recover(f"{root.rstrip('/')}/wiki")
    current = text_files(spark, f"{root.rstrip('/')}/wiki", "*.md").select(F.col("path").alias("target_path"), F.col("sha256").alias("now"))
    rows = new.join(preimages, "target_path", "left").join(current, "target_path", "left")
    if again:
        rows = rows.where(~F.col("now").eqNullSafe(sha256(F.col("markdown"))))
    drift = [r[0] for r in rows.where(~F.col("now").eqNullSafe(F.col("preimage_sha256"))).select("target_path").limit(5).collect()]
    if drift:
        raise ValueError(f"pages changed since they were read: {', '.join(drift)}")
    spark.dataSource.register(page_sink.Pages)
    sink = rows.select("target_path", "markdown", "preimage_sha256").write.format("pages").mode("append")
    sink.option("root", f"{root.rstrip('/')}/wiki").option("job", uuid.uuid4().hex).save()
    return new.select("target_path", sha256(F.col("markdown")).alias("content_sha256"))


def page_markdown(rows: DataFrame) -> DataFrame:
    """``target_path``, ``markdown`` of canonical pages: a header with provenance joined to the old page's, then the body.

    rows: ``target_path``, ``page_type``, ``title``, ``body``, ``operation_id``, ``raw_paths``, ``raw_hashes``, and of the old page ``old_aliases``, ``old_created``,
    ``old_raw_paths``, ``old_raw_hashes``, ``old_operations`` (null without one), ``model_title``.
    """
    from tessella.functions.text import operation_date, yaml_list, yaml_scalar

    none = F.array().cast("array<string>")
    union = lambda old, new: F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(new, none)))
    body = F.when(F.col("body").startswith("# "), F.col("body")).otherwise(F.concat(F.lit("# "), "title", F.lit("\n\n"), "body"))
    extra = F.when(F.col("old_created").isNotNull() & (F.col("model_title") != F.col("title")), F.array("model_title")).otherwise(none)
    today = F.date_format(operation_date(F.col("operation_id")), "yyyy-MM-dd")
    parts = [
        F.lit("---"), F.concat(F.lit("page_type: "), "page_type"), F.concat(F.lit("title: "), yaml_scalar(F.col("title"))),
        yaml_list("aliases", union(F.col("old_aliases"), extra)), F.concat(F.lit("summary: "), yaml_scalar(summary(body, 2, 260))),
        F.concat(F.lit("created: "), F.coalesce(F.nullif("old_created", F.lit("")), today)), F.concat(F.lit("updated: "), today),
        yaml_list("source_raw_paths", union(F.col("old_raw_paths"), F.col("raw_paths"))), yaml_list("source_raw_hashes", union(F.col("old_raw_hashes"), F.col("raw_hashes"))),
        yaml_list("source_operation_ids", union(F.col("old_operations"), F.array("operation_id"))), F.concat(F.lit("last_operation: "), yaml_scalar(F.col("operation_id"))), F.lit("---"),
    ]
    text = F.concat(F.concat_ws("\n", *parts), F.lit("\n\n"), F.regexp_replace(body, f"{SPACE}+$", ""), F.lit("\n"))
    return rows.select("target_path", text.alias("markdown"))

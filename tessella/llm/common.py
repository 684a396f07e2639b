"""What the text operators share: words, tables, durable intermediate results."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one numpy or Python step works on at a time, so that memory does not follow the Arrow batch.
STEP_CHARS = 2_000_000
#: Rows and bytes of a batch that Spark hands to a Python worker; its own defaults (10,000 rows, 64 MB) are more than
#: six workers on small executors have room for. A session that sets either keeps its value.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2048"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: exactly what bytes.split() cuts, which knows ASCII white space only."""
    return text.split()


def words_column(text: Column) -> Column:
    """The same words as an array column; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get, where the session has Spark's defaults."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def give_back() -> None:
    """Return a worker's free memory to the machine: workers live on from task to task, beside a JVM that may need it next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``mapInArrow`` over bounded batches, by workers that give their memory back when a task ends."""
    small_batches(df.sparkSession)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidied, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir`` or the checkpoint folder of the context.

    Where neither is set, one machine makes a temporary folder; a cluster has none that its executors share and gets an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STORED = re.compile(r"-[0-9a-f]{32}$")
_writing: Counter[int] = Counter()
_before: dict[int, str] = {}
_lock = threading.Lock()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write to a table in the shared folder and read it again: columnar, for intermediate results of many rows.

    The shuffle files of the write are removed when it ends, so disk use follows the largest step, not the sum. The
    setting for that is put back when the last of a session's writes ends, however many run side by side.
    """
    spark, key = df.sparkSession, id(df.sparkSession)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with _lock:
        if not _writing[key]:
            _before[key] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writing[key] += 1
    try:
        df.write.parquet(path)
    finally:
        with _lock:
            _writing[key] -= 1
            if not _writing[key]:
                spark.conf.set(_CLEANUP, _before.pop(key))
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """An aggregate dealt anew before a join on its key.

    Joined where it was made, an aggregate shares its exchange's place in the plan, and Spark can't split the other
    side's hot keys; with a plain exchange on both sides the adaptive skew join can. The aggregate is the small side.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """The name, made longer until no column of the table has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents, all columns, whose ``doc_id`` isn't one of ``gone`` (column ``doc_id``); those without an id stay."""
    name = fresh(docs, "gone_id")
    ids = apart(gone.select(F.col("doc_id").alias(name)).distinct())
    return docs.join(ids, docs["doc_id"].cast("long") == ids[name], "left_anti")


def dropped(df: DataFrame) -> None:
    """Remove the stored tables that a result was read from, when nothing reads them any more; other files stay."""
    spark, root = df.sparkSession, shared_dir(df.sparkSession).rstrip("/").rsplit("/", 1)[-1]
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        above, _, name = folder.rpartition("/")
        if _STORED.search(name) and above.rsplit("/", 1)[-1] == root:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in smaller slices, so that a worker holds the Python objects of few rows at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def steps(texts: list[bytes], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)

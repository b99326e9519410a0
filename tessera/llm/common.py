"""Helpers shared by the operators: table access, free column names, cuts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many characters, so that the
#: numpy arrays of one slice stay small however large an Arrow batch is.
SLICE_CHARS = 1 << 19
#: Bytes of an Arrow batch. Spark's own bound is 32 times as much, which a
#: worker holds several times over (as Arrow, as Python strings, as results).
BATCH_BYTES = "2m"
#: Input bytes of a task that writes an intermediate table, at least, where there
#: are more tasks than four a core.
TASK_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``,
    else the warehouse. On a cluster, a warehouse in the driver's own file system
    is refused: executors would write where nobody else can read."""
    folder = (spark.conf.get("spark.checkpoint.dir", None)
              or spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        if folder.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/tessera-llm-{spark.sparkContext.applicationId}"


def scanned_bytes(df: DataFrame) -> int:
    """Size of the tables that ``df`` reads, as the planner knows it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage so that a lost executor costs nothing that came before,
    and gives the planner the true size of the table. A small table is written in
    at most four files a core, however many partitions it lies in; the bound
    grows with the tables read, ``TASK_BYTES`` a task, lest it hold up the scan or
    shuffle before it. The file system deletes the folder when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    tasks = max(4 * spark.sparkContext.defaultParallelism, scanned_bytes(df) // TASK_BYTES)
    df.coalesce(min(tasks, (1 << 31) - 1)).write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, to be read in small Arrow batches: bounds them for the session
    unless it has a bound of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "64m").rstrip("b") in ("64m", "64M", str(64 << 20)):
        conf.set(key, BATCH_BYTES)
    return df


def give_back() -> None:
    """Return freed memory to the system: workers stay alive between stages, next
    to an executor whose memory they share."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):      # not glibc
        pass


def lean(run):
    """A function for mapInArrow that gives its free memory back, batch by batch."""
    def lean_run(batches):
        for out in run(batches):
            yield out
            pa.default_memory_pool().release_unused()
        give_back()

    return lean_run


def slices(texts: Iterable[str | None], size: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts that together have about ``size``
    characters; a longer text makes a run of its own."""
    start = n = i = 0
    for i, t in enumerate(texts, 1):
        n += len(t) if t else 0
        if n >= size:
            yield start, i
            start, n = i, 0
    if start < i:
        yield start, i


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

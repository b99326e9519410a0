"""Session settings and lineage cutting.

``build_session`` is what ``bench.py`` uses; on a cluster the session comes
from the platform.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are planned for. AQE re-plans joins from runtime sizes
# (broadcast only below the threshold, sort-merge beyond it) and splits skewed
# partitions of sort-merge joins; forceOptimizeSkewedJoin lets it add a
# shuffle to do so inside a chain of joins on one key.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.parquet.filterPushdown": "true",
    # delete checkpoint files once their RDD is gone (static: set at start)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    for k, v in {**RECOMMENDED, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Shared folder for reliable checkpoints: the one already given to the
    context, else ``spark.checkpoint.dir``; None where neither is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not current and configured:
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir() or configured
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, which survives executor loss. A session without a
    checkpoint folder keeps the lineage and persists instead."""
    try:
        folder = checkpoint_dir(df.sparkSession)
    except AttributeError:
        folder = "connect"      # Spark Connect: the server checkpoints into its own configured folder
    return df.checkpoint(eager=True) if folder else df.persist()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again. Cuts the lineage as
    ``cut_lineage`` does, but columns are compressed, which takes a fraction of a
    checkpoint's bytes, and the planner knows the table's size."""
    spark = df.sparkSession
    try:
        folder = checkpoint_dir(spark)
    except AttributeError:
        folder = None           # Spark Connect
    if not folder:
        return cut_lineage(df)
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of files that one task shall get where its memory grows with its rows.
TASK_BYTES = 4 << 20


def parts_for(df: DataFrame) -> int:
    """Partitions for ``df`` that grow with the files it reads, so that a task's share
    does not; the session's shuffle partitions at least, and where no file is read."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not hasattr(df, "_jdf"):
        return least            # Spark Connect
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = (x for x in map(leaves.apply, range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRelation")
    return max(least, -(-sum(int(str(x.stats().sizeInBytes())) for x in files) // TASK_BYTES))


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, under the checkpoint
    folder (the warehouse without one); deleted when the application ends."""
    root = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/tessera-scratch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path

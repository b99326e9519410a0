"""Scan of the driver's parquet tables.

A plain ``spark.read.parquet`` keeps every optimisation: Catalyst prunes the
columns a query does not use and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    # tessera.scan.partitions: a count given by whoever runs the job on files
    # of very few splits (the benchmark does); unset, the scan is as it is
    parts = spark.conf.get("tessera.scan.partitions", None)
    return df.repartition(int(parts)) if parts else df


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` reads on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]

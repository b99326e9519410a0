"""Readers and writers of the mapping, rule, lineage and catalog artefacts
(S3, S5-S7, S10-S14). All go through Spark's distributed writers: one file
per task, nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.lineage import quarantine
from tessera.operators.mapping import (MAPPING_FIELDS, csv_projection, flatten_catalog,
                                       from_csv_projection)

# CSV dialect of Python's csv module: quote only when needed, double quotes
# inside quoted fields, empty string written as nothing
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
               # Spark's writer trims blanks by default; Python's csv keeps them
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def ensure_databases(spark: SparkSession, names=("staging_db", "core_db", "final_db")) -> None:
    """S6."""
    for n in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {n}")


def save_table(df: DataFrame, table: str) -> None:
    """Overwrite a managed table."""
    df.write.mode("overwrite").saveAsTable(table)


#: How the large tables are laid out: by the date that a run filters on, and in
#: buckets of the key that they are joined on.
LAYOUT = {
    "account": ("load_date", "account_id"), "transaction": ("load_date", "account_id"),
    "archived_account": (None, "account_id"), "archived_transaction": (None, "account_id"),
    "product_dim": (None, "account_id"), "branch_dim": (None, "account_id"),
    "credit_bureau": ("report_date", "customer_id"), "segmentation_rules": (None, "customer_id"),
    "sanctions_list": (None, "customer_id"), "customer_region": (None, "cust_id"),
}


def save_layout(df: DataFrame, table: str, name: str, buckets: int, path: str | None = None) -> None:
    """``df`` as ``table``, laid out as ``LAYOUT`` has it for ``name``; ``path``
    for an external table. A bucket is dealt to one task before it is written, so it is
    one file (per date)."""
    date, key = LAYOUT[name]
    out = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if date is not None:
        out = out.partitionBy(date)
    (out if path is None else out.option("path", path)).saveAsTable(table)


def read_catalog(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """S7 + M1. ``one_document``: the file is a single JSON object (read whole);
    otherwise one catalog object per line, read in parallel splits."""
    text = spark.read.text(path, wholetext=one_document)
    return flatten_catalog(text, "value")


def mapping_documents(mappings: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """(key, text): one ``{"mappings": [..]}`` document per key, ordered by ``order``.

    A document is the mappings of one script. It is one value by definition, so
    a key's mappings meet in one task; mappings that belong to no single script
    are written one per line instead (``write_mapping_json(key=None)``).
    """
    # a field that is missing in JSON is a default, not a loss; the order goes in front for sorting only
    one = F.struct(F.col(order).alias("__o"), F.struct(*MAPPING_FIELDS).alias("m"))
    docs = mappings.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("ms"))
    return docs.select(key, F.to_json(F.struct(F.transform("ms", lambda x: x["m"]).alias("mappings"))).alias("text"))


def csv_line(*columns: str) -> Column:
    """The columns as one line of CSV, in the dialect of the files."""
    return F.to_csv(F.struct(*columns), {k: v for k, v in CSV_OPTIONS.items() if k != "header"})


def parse_csv_line(c, columns) -> Column:
    """A line (or several, inside quotes) of CSV as a struct of texts."""
    schema = ", ".join(f"{x} string" for x in columns)
    return F.from_csv(c, schema, {**{k: v for k, v in CSV_OPTIONS.items() if k != "header"}, "multiLine": "true"})


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df``, and where its number of rows will be once it was written (M9):
    observed by the job that writes, so nothing runs twice."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_mapping_csv(mappings: DataFrame, path: str) -> int:
    """The eight fields in fixed order, header, arrays joined with ', '.
    Returns the number of mappings written (M9)."""
    rows, seen = _counted(csv_projection(mappings))
    rows.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return seen.get["rows"]


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of CSV files, numbered from 0 in each file,
    line breaks inside quotes kept. Files are read in splits of any size.

    A line begins a record if the quotes before it, in the whole file, are even in
    number. A split cannot know those, so it counts for both cases: its quotes, and
    the records that begin in it if the quotes before it are even, or odd. One row
    per split and a running sum over a file's splits tell which case holds and the
    number of its first record; the lines of a record then meet by that number.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    inside = Window.partitionBy("file", "split").orderBy("at")
    before = F.coalesce(F.sum(quotes).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumns({"quotes": quotes, "odd": before % 2})
    lines = lines.withColumns({"even_starts": F.sum(1 - F.col("odd")).over(inside), "odd_starts": F.sum("odd").over(inside)})
    splits = lines.groupBy("file", "split").agg(
        (F.sum("quotes") % 2).alias("odd"), F.max("even_starts").alias("even_starts"), F.max("odd_starts").alias("odd_starts"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("odd_before", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("odd_before") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    splits = splits.select("file", "split", "odd_before", F.coalesce(F.sum(starts).over(earlier), F.lit(0)).alias("first"))
    own = F.when(F.col("odd_before") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    numbered = lines.join(splits, ["file", "split"]).select("file", (F.col("first") + own - 1).alias("record"), "split", "at", "line")
    parts = F.array_sort(F.collect_list(F.struct("split", "at", "line")))
    return numbered.groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


def read_mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """Fixed schema (no inference), the header of each file left out, empties
    back to defaults. Cells may hold line breaks; files are read in many tasks. A
    quote that is never closed makes one record of the rest of its file."""
    text = F.regexp_replace("text", r"\r\z", "")
    rows = csv_records(spark, path).where("record > 0").select(text.alias("text")).where("text <> ''")
    return from_csv_projection(rows.select(parse_csv_line("text", MAPPING_FIELDS).alias("m")).select("m.*"))


def write_mapping_json(mappings: DataFrame, path: str, key: str | None = "doc_id",
                       order: str = "pos") -> int:
    """UTF-8 JSON, non-ASCII kept. With ``key``, one ``{"mappings": [..]}``
    document per key (the mappings of one script, ordered by ``order``);
    without, one mapping per line. Returns the number of mappings written (M9)."""
    rows, seen = _counted(mappings)
    if key is None:
        rows.select(*MAPPING_FIELDS).write.mode("overwrite").json(path)
    else:
        mapping_documents(rows, key, order).select("text").write.mode("overwrite").text(path)
    return seen.get["rows"]


def write_rules_csv(rules: DataFrame, path: str) -> None:
    """source_table, source_column, target_table, target_column, rule."""
    (rules.select("source_table", "source_column", "target_table", "target_column", "rule")
     .write.mode("overwrite").options(**CSV_OPTIONS).csv(path))


def lineage_json(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """S14 as rows: (key, text) of the valid documents."""
    text = F.when(F.col("error").isNull(), F.array(F.to_json(F.struct(F.col("doc.steps").alias("steps")))))
    return parsed.select(key, F.explode(text).alias("text"))


def write_lineage_json(parsed: DataFrame, path: str, key: str = "doc_id", quarantine_path: str | None = None) -> None:
    """The valid lineage documents, one per line; the others, with their
    errors, into ``quarantine_path``. Without one, a document that is not valid
    fails the job, as it does in the original."""
    if quarantine_path is None:
        parsed = parsed.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")))
    else:
        quarantine(parsed, key).write.mode("overwrite").json(quarantine_path)
    lineage_json(parsed, key).select("text").write.mode("overwrite").text(path)

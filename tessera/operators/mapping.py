"""Source-to-target mapping (STM) tables: catalog flattening (M1), catalog
enrichment (M2, M3), alias clean-up (M4, M5), validation and explosion of
mapping documents (M6, M7), the flat CSV projection (M8) and the final-table
filter (M11).

Mapping documents are rows of a table keyed by ``doc_id`` (one per script or
per model response), so one job handles any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.json import is_a, is_string_list, kind, member, with_strict_variant
from tessera.functions.text import remove_aliases

META = T.StructType([
    T.StructField("data_type", T.StringType()),
    T.StructField("is_categorical", T.BooleanType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
])
# catalog document: table -> column -> metadata
CATALOG_SCHEMA = T.MapType(T.StringType(), T.MapType(T.StringType(), META))

REQUIRED = ("source_table", "source_column", "target_table", "target_column",
            "transformation_logic")
OPTIONAL = ("data_type", "is_categorical", "categories")
MAPPING_FIELDS = REQUIRED + OPTIONAL

MAPPING_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in REQUIRED + ("data_type",)]
    + [T.StructField("is_categorical", T.BooleanType()),
       T.StructField("categories", T.ArrayType(T.StringType()))])
DOCUMENT_SCHEMA = T.StructType([T.StructField("mappings", T.ArrayType(MAPPING_SCHEMA))])



def _empty():
    return F.array().cast(T.ArrayType(T.StringType()))


# ---------------------------------------------------------------- M1

def parse_catalog(docs: DataFrame, text_col: str = "value") -> DataFrame:
    """Adds ``cat`` (the catalog as a map) and ``error``, NULL for a readable one."""
    read = with_strict_variant(docs, F.col(text_col), "__v")
    return (read.withColumn("cat", F.when(kind(F.col("__v")).startswith("OBJECT<"), F.from_json(F.col(text_col), CATALOG_SCHEMA)))
                .withColumn("error", F.when(F.col("cat").isNull(), F.lit("malformed catalog"))).drop("__v"))


def flatten_catalog(docs: DataFrame, text_col: str = "value") -> DataFrame:
    """One row per (table, column) of every readable catalog document in ``docs``;
    the others are the rows of ``parse_catalog`` with an error.

    Numbers in a domain (``[0, 1]``) come back as strings.
    """
    # readability inside the generator: a Filter would parse again
    tables = parse_catalog(docs, text_col).select(F.explode("cat").alias("table_name", "cols"))
    cols = tables.select("table_name", F.explode("cols").alias("column_name", "meta"))
    return cols.select("table_name", "column_name", "meta.data_type", "meta.is_categorical",
                       "meta.categories")


NO_OBJECT, BAD_TABLE, BAD_COLUMN = "malformed catalog", "table is no object", "column of a wrong type"


def catalog_pieces(docs: DataFrame, text_col: str = "value") -> DataFrame:
    """The catalog taken apart entry by entry, with other columns of ``docs`` kept:
    (table_name, column_name, data_type, is_categorical, categories, error, raw).

    A document is read once as a variant; a table function gives a row per table, a
    second one a row per column, which go on separately. An entry of a wrong type
    has an error and its JSON in ``raw``, the others of its document come out. An
    empty table or catalog has no rows.
    """
    spark, keep = docs.sparkSession, [c for c in docs.columns if c != text_col]
    read = with_strict_variant(docs, F.col(text_col), "__v")
    is_object = lambda v: F.coalesce(kind(v), F.lit("")).startswith("OBJECT<")

    def piece(df: DataFrame, v: str, name: str, value: str, error: str) -> DataFrame:
        """A row per member of the variant ``v``, or one with an error where it is no object."""
        members = spark.tvf.variant_explode_outer(F.when(is_object(F.col(v)), F.col(v)).outer())
        out = df.lateralJoin(members.select(F.col("key").alias(name), F.col("value").alias(value)))
        empty = is_object(F.col(v)) & F.col(name).isNull()
        return out.where(~F.coalesce(empty, F.lit(False))).withColumn(
            "error", F.coalesce("error", F.when(~is_object(F.col(v)), F.lit(error))))

    # a document without a value is an error of its own, so the first level keeps it
    tables = piece(read.withColumn("error", F.lit(None).cast("string")), "__v", "table_name", "__cols", NO_OBJECT)
    whole = tables.where("error IS NOT NULL").withColumns({"column_name": F.lit(None).cast("string"), "raw": F.col(text_col)})
    cols = piece(tables.where("error IS NULL"), "__cols", "column_name", "__meta", BAD_TABLE)
    meta = F.col("__meta")
    bad = ~is_object(meta) | ~is_a(member(meta, "data_type"), "STRING", "VOID") | ~is_a(member(meta, "is_categorical"), "BOOLEAN", "VOID") | ~(
        is_a(member(meta, "categories"), "VOID") | F.coalesce(kind(member(meta, "categories")), F.lit("")).startswith("ARRAY<"))
    error = F.coalesce("error", F.when(bad, F.lit(BAD_COLUMN)))
    get = lambda name, to: F.when(error.isNull(), F.try_variant_get(meta, f"$.{name}", to)).alias(name)
    raw = F.when(error.isNotNull(), F.to_json(F.coalesce("__meta", "__cols")))
    entries = cols.select(*keep, "table_name", "column_name", get("data_type", "string"), get("is_categorical", "boolean"),
                          get("categories", "array<string>"), error.alias("error"), raw.alias("raw"))
    lost = whole.select(*keep, "table_name", "column_name", F.lit(None).cast("string").alias("data_type"),
                        F.lit(None).cast("boolean").alias("is_categorical"),
                        F.lit(None).cast("array<string>").alias("categories"), "error", "raw")
    return entries.unionByName(lost)


# ---------------------------------------------------------------- M2, M3, M5

def default_logic(c: Column) -> Column:
    """M3: NULL or empty logic becomes 'Direct mapping'; blank text stays."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("Direct mapping")).otherwise(c)


def clean_logic(c: Column) -> Column:
    """M5: alias removal on non-empty logic only."""
    return F.when(F.coalesce(c, F.lit("")) != "", remove_aliases(c)).otherwise(c)


def enrich_with_catalog(mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """M2 (+M3, M5 in the original order): look up the *source* column in the
    catalog; type, flag and domain are overwritten from it, a miss gives
    ``''``, ``false``, ``[]``. Row count is kept: a catalog key that is given
    more than once counts once (see ``dedupe_catalog``).

    The catalog holds one row per warehouse column; when it is small its
    broadcast is decided by AQE from the measured size, otherwise this is a
    sort-merge join that AQE splits on hot (table, column) keys.
    """
    cat = dedupe_catalog(catalog).select(F.col("table_name").alias("__t"), F.col("column_name").alias("__c"),
                         F.col("data_type").alias("__dt"),
                         F.col("is_categorical").alias("__cat"),
                         F.col("categories").alias("__dom"))
    keep = [c for c in mappings.columns if c not in OPTIONAL]
    j = mappings.select(*keep).join(
        cat, (F.col("source_table") == F.col("__t")) & (F.col("source_column") == F.col("__c")),
        "left")
    logic = clean_logic(default_logic(F.col("transformation_logic")))
    return j.select(
        *[logic.alias(c) if c == "transformation_logic" else F.col(c) for c in keep],
        F.coalesce("__dt", F.lit("")).alias("data_type"),
        F.coalesce("__cat", F.lit(False)).alias("is_categorical"),
        F.coalesce("__dom", _empty()).alias("categories"))


def dedupe_catalog(catalog: DataFrame, order_col: str | None = None) -> DataFrame:
    """One entry per (table, column): the last by ``order_col``, as a JSON object
    keeps the last of a repeated key; without an order the greatest entry."""
    rest = [c for c in catalog.columns if c not in ("table_name", "column_name", order_col)]
    entry = F.struct(*rest)
    one = F.max_by(entry, F.col(order_col)) if order_col else F.max(entry)
    return catalog.groupBy("table_name", "column_name").agg(one.alias("e")).select("table_name", "column_name", "e.*")


# ---------------------------------------------------------------- M6, M7

# the type of a mapping whose fields are all as they shall be
_PLAIN = ("^OBJECT<(categories: ARRAY<(STRING|VOID)>, )?(data_type: STRING, )?(is_categorical: BOOLEAN, )?"
          "source_column: STRING, source_table: STRING, target_column: STRING, target_table: STRING, "
          "transformation_logic: STRING>$")

NO_LIST = "malformed document or no mappings list"
NO_FIELD = "mapping without a required field"
BAD_TYPE = "field of a wrong type"


def _bad_type(m: Column) -> Column:
    """A mapping (variant) with a field of a wrong type; a null is no string, flag or list."""
    got = lambda c: F.coalesce(kind(member(m, c)), F.lit("none"))
    odd = [~got(c).isin("none", "STRING") for c in REQUIRED + ("data_type",)]
    odd += [~got("is_categorical").isin("none", "BOOLEAN"), ~is_string_list(member(m, "categories"))]
    full = F.greatest(~kind(m).startswith("OBJECT<"), *odd)
    return F.greatest(~kind(m).startswith("OBJECT<"), *odd)


def parse_documents(docs: DataFrame, text_col: str = "text", mode: str = "PERMISSIVE") -> DataFrame:
    """Parse mapping documents; adds ``doc`` (struct) and ``error`` (string).

    A document is valid when it is one JSON value with a list ``mappings`` of
    objects that have the five required strings, and where ``data_type`` is a
    string, ``is_categorical`` a flag and ``categories`` a list of strings if they
    are there (their defaults come later). Unknown fields don't matter. With mode
    FAILFAST the first document that is not valid fails the job.
    """
    # columns of their own are computed once a document
    parsed = with_strict_variant(docs, F.col(text_col), "__v").withColumn("__list", member(F.col("__v"), "mappings"))
    parsed = (parsed.withColumn("__items", F.try_variant_get(F.col("__list"), "$", "array<variant>")).drop("__v", "__list")
                    .withColumn("__doc", F.from_json(text_col, DOCUMENT_SCHEMA)))
    lacks = lambda m: F.greatest(*[kind(member(m, c)).isNull() for c in REQUIRED])
    # most documents hold plain mappings and no null in a list, which one look tells; the others are asked what
    plain = (~F.exists("__items", lambda m: ~F.coalesce(kind(m).rlike(_PLAIN), F.lit(False)))
             & ~F.exists("__doc.mappings", lambda m: F.exists(F.coalesce(m["categories"], _empty()), lambda x: x.isNull())))
    error = (F.when(F.col("__items").isNull(), F.lit(NO_LIST)).when(F.coalesce(plain, F.lit(False)), F.lit(None))
             .when(F.exists("__items", lambda m: F.when(kind(m).startswith("OBJECT<"), lacks(m)).otherwise(False)), F.lit(NO_FIELD))
             .when(F.exists("__items", _bad_type), F.lit(BAD_TYPE)))
    if mode == "FAILFAST":
        error = F.when(error.isNotNull(), F.raise_error(F.concat(error, F.lit(": "), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, 200))).cast("string"))
    return (parsed.withColumn("error", error).drop("__items")
                  .withColumn("doc", F.when(F.col("error").isNull(), F.col("__doc"))).drop("__doc"))


def valid_mappings(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """M7: one row per mapping of each valid document, with its position."""
    # validity inside the generator: a Filter would re-run from_json (see lineage._steps)
    maps = F.when(F.col("error").isNull(), F.col("doc.mappings"))
    rows = parsed.select(key, F.posexplode(maps).alias("pos", "m"))
    return rows.select(
        key, "pos", *[F.col(f"m.{c}").alias(c) for c in REQUIRED],
        F.coalesce("m.data_type", F.lit("")).alias("data_type"),
        F.coalesce("m.is_categorical", F.lit(False)).alias("is_categorical"),
        F.coalesce("m.categories", _empty()).alias("categories"))


def quarantine(parsed: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents the original would have rejected, with the reason."""
    bad = F.when(F.col("error").isNotNull(), F.array(F.struct("error", text_col)))
    return parsed.select(key, F.explode(bad).alias("q")).select(key, "q.error", f"q.{text_col}")


# ---------------------------------------------------------------- M8

def csv_projection(m: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """M8: the eight CSV fields as text: arrays joined with ', ', flags as
    ``True``/``False``, NULL as empty."""
    def text(c: str) -> Column:
        if c == "categories":
            return F.coalesce(F.array_join(F.col(c), ", "), F.lit(""))
        if c == "is_categorical":
            return (F.when(F.col(c), F.lit("True")).when(~F.col(c), F.lit("False"))
                    .otherwise(F.lit("")))
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    return m.select(*extra, *[text(c).alias(c) for c in MAPPING_FIELDS])


def from_csv_projection(m: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Inverse of M8 after a CSV read (S12): empty cells, which the reader
    returns as NULL, become the defaults (T24)."""
    return m.select(
        *extra, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in REQUIRED + ("data_type",)],
        F.coalesce(F.lower(F.col("is_categorical")) == "true", F.lit(False)).alias("is_categorical"),
        F.when(F.coalesce(F.col("categories"), F.lit("")) == "", _empty())
        .otherwise(F.split(F.col("categories"), ", ")).alias("categories"))


# ---------------------------------------------------------------- M11

def final_table_only(mappings: DataFrame, sinks: DataFrame, sink_col: str = "dataset") -> DataFrame:
    """Mappings whose target is a sink of the lineage graph."""
    s = sinks.select(F.col(sink_col).alias("__sink")).distinct()
    return mappings.join(s, F.col("target_table") == F.col("__sink"), "left_semi")

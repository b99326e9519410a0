"""Lineage tables from lineage documents (L1-L8) and the transitive
resolution to base tables (L7, M10).

A lineage document is ``{"steps": [{name, output, columns, sources: [{name,
columns}]}]}``; the input is a table of them keyed by ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.json import is_a, is_string_list, items, kind, member, with_strict_variant
from tessera.functions.text import strip_code_fence
from tessera.operators import reach
from tessera.session import stored as cut_lineage

STRINGS = T.ArrayType(T.StringType())
SOURCE = T.StructType([T.StructField("name", T.StringType()),
                       T.StructField("columns", STRINGS)])
STEP = T.StructType([T.StructField("name", T.StringType()),
                     T.StructField("output", T.StringType()),
                     T.StructField("columns", STRINGS),
                     T.StructField("sources", T.ArrayType(SOURCE))])
LINEAGE_SCHEMA = T.StructType([T.StructField("steps", T.ArrayType(STEP))])


def _empty():
    return F.array().cast(STRINGS)


# ---------------------------------------------------------------- L1, L2

NO_STEPS = "malformed document or no steps list"
NO_NAME = "step without output or source without name"
BAD_TYPE = "field of a wrong type"
_LIST = "ARRAY<(STRING|VOID)>"
# the type of a list of steps whose fields are all as they shall be
_PLAIN = (f"^ARRAY<(VOID|OBJECT<(columns: {_LIST}, )?(name: STRING, )?output: STRING"
          f"(, sources: ARRAY<(VOID|OBJECT<(columns: {_LIST}, )?name: STRING>)>)?>)>$")


def _bad_step(s: Column) -> Column:
    """A step (variant) with a field of a wrong type; null names are told later."""
    def bad_source(x: Column) -> Column:
        return ~kind(x).startswith("OBJECT<") | ~is_a(member(x, "name"), "STRING", "VOID") | ~is_string_list(member(x, "columns"), "VOID")

    sources = member(s, "sources")
    return (~kind(s).startswith("OBJECT<") | ~is_a(member(s, "name"), "STRING", "VOID")
            | ~is_a(member(s, "output"), "STRING", "VOID") | ~is_string_list(member(s, "columns"), "VOID")
            | ~F.coalesce(kind(sources).startswith("ARRAY<") | (kind(sources) == "VOID"), F.lit(True))
            | F.exists(items(sources), bad_source))


def parse_lineage(docs: DataFrame, text_col: str = "text", key: str = "doc_id", mode: str = "PERMISSIVE") -> DataFrame:
    """L2: (key, doc, error). A document is valid when it is, inside its code
    fence, one JSON value with a list ``steps`` of objects with an output, whose
    sources have a name; names are strings and columns lists of strings, or
    missing or null. The original raises on everything else; here it goes to
    quarantine and the rest goes on. With mode FAILFAST the job fails."""
    text = F.col("__text")
    # braces at both ends leave nothing to strip
    json = F.when(text.startswith("{") & text.endswith("}"), text).otherwise(strip_code_fence("__text"))
    parsed = docs.select(key, F.col(text_col).alias("__text")).withColumn("__json", json)
    # columns of their own are computed once a document
    parsed = with_strict_variant(parsed, F.col("__json"), "__v").withColumn("__listed", member(F.col("__v"), "steps"))
    parsed = parsed.withColumn("__kind", kind(F.col("__listed"))).withColumn("doc", F.from_json("__json", LINEAGE_SCHEMA))
    steps = F.col("doc.steps")
    sources = lambda s: F.coalesce(s["sources"], F.array().cast(T.ArrayType(SOURCE)))
    no_name = F.exists(steps, lambda s: s["output"].isNull() | F.exists(sources(s), lambda x: x.isNull() | x["name"].isNull()))
    null_in = lambda c: F.exists(F.coalesce(c, _empty()), lambda x: x.isNull())
    bad_list = F.exists(steps, lambda s: null_in(s["columns"]) | F.exists(sources(s), lambda x: null_in(x["columns"])))
    # most documents lack nothing, which one walk tells; the others are asked what
    null = lambda x: x.isNull()
    lacking = F.exists(steps, lambda s: s["output"].isNull() | F.exists(s["columns"], null) | F.exists(
        s["sources"], lambda x: x["name"].isNull() | F.exists(x["columns"], null)))
    # most documents are plain, which one look at the type of the whole list tells
    bad = F.when(F.col("__kind").rlike(_PLAIN), False).otherwise(F.exists(items(F.col("__listed")), _bad_step))
    error = (F.when(~F.coalesce(F.col("__kind"), F.lit("none")).startswith("ARRAY<"), F.lit(NO_STEPS))
             .when(bad, F.lit(BAD_TYPE))
             .when(lacking, F.when(F.exists(steps, null) | no_name, F.lit(NO_NAME)).when(bad_list, F.lit(BAD_TYPE))))
    if mode == "FAILFAST":
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    return parsed.withColumn("error", error).withColumn("text", text).select(key, "doc", "error", "text")


def quarantine(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that are not valid: (key, error, text)."""
    bad = F.when(F.col("error").isNotNull(), F.array(F.struct("error", "text")))
    return parsed.select(key, F.explode(bad).alias("q")).select(key, "q.error", "q.text")


def _steps(parsed: DataFrame, key: str) -> DataFrame:
    """Steps of valid documents. The validity test sits inside the generator:
    a Filter here would be pushed below the projection and evaluate
    ``from_json`` a second time per row."""
    steps = F.when(F.col("error").isNull(), F.col("doc.steps"))
    return parsed.select(key, F.posexplode(steps).alias("step_pos", "step"))


# ---------------------------------------------------------------- L3, L4

def lineage_edges(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """L3/L4: one edge per (step, source), repeats kept."""
    s = _steps(parsed, key)
    e = s.select(key, "step_pos", F.col("step.name").alias("step_name"),
                 F.col("step.output").alias("output"),
                 F.posexplode("step.sources").alias("source_pos", "src"))
    return e.select(key, "step_pos", "source_pos", "step_name",
                    F.col("src.name").alias("source"), "output")


# ---------------------------------------------------------------- L5

def lineage_nodes(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One node per dataset of a document with the columns it is drawn
    with. A dataset that is an output anywhere takes the columns of its last
    output step (a redraw replaces the earlier box); a dataset that is only a
    source takes those of its first appearance. Missing lists are empty.

    Nodes belong to one document, so they are computed inside the row with
    array functions: candidates ranked (outputs first, later steps first;
    then sources, earlier first), sorted, first per dataset kept. No shuffle.
    """
    steps = F.when(F.col("error").isNull(), F.col("doc.steps"))
    outs = F.transform(steps, lambda s, i: F.struct(
        s["output"].alias("dataset"), F.lit(0).alias("kind"), (-i).alias("a"), F.lit(0).alias("b"),
        F.coalesce(s["columns"], _empty()).alias("columns")))
    srcs = F.flatten(F.transform(steps, lambda s, i: F.transform(
        F.coalesce(s["sources"], F.array().cast(T.ArrayType(SOURCE))),
        lambda src, j: F.struct(src["name"].alias("dataset"), F.lit(1).alias("kind"), i.alias("a"),
                                j.alias("b"), F.coalesce(src["columns"], _empty()).alias("columns")))))
    ranked = parsed.select(key, F.array_sort(F.concat(outs, srcs)).alias("c"))
    first = F.filter("c", lambda x, i: (i == 0) | (x["dataset"] != F.element_at(F.col("c"), i)["dataset"]))
    nodes = ranked.select(key, F.explode(first).alias("n"))
    return nodes.select(key, F.col("n.dataset").alias("dataset"),
                        F.when(F.col("n.kind") == 0, "output").otherwise("source").alias("drawn_as"),
                        F.col("n.columns").alias("columns"))


# ---------------------------------------------------------------- L8

def lineage_columns(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Columns written by each step and read from each of its sources."""
    # what a step writes goes in front of its sources, so the document is parsed once
    step = F.col("step")
    ends = F.concat(F.array(F.struct(step["output"].alias("name"), step["columns"].alias("columns"))),
                    F.coalesce(step["sources"], F.array().cast(T.ArrayType(SOURCE))))
    listed = _steps(parsed, key).select(key, "step_pos", F.posexplode(ends).alias("__i", "end"))
    return listed.select(key, "step_pos", F.col("end.name").alias("dataset"),
                         F.when(F.col("__i") == 0, "write").otherwise("read").alias("role"),
                         F.posexplode("end.columns").alias("col_pos", "column_name"))


# ---------------------------------------------------------------- L6, L7

def roots_and_sinks(edges: DataFrame) -> DataFrame:
    """Base tables (sources that are no output) and sinks (outputs that
    are no source), over the whole edge table.

    Each edge is read once and gives a row per end; one aggregate of (seen as
    source, seen as output) per dataset, whose partial sums collapse a dataset
    that appears in millions of edges before it is shuffled.
    """
    end = lambda c, src: F.struct(F.col(c).alias("dataset"), F.lit(src).alias("src"), F.lit(not src).alias("out"))
    seen = edges.select(F.explode(F.array(end("source", True), end("output", False))).alias("x")).select("x.*")
    flags = seen.groupBy("dataset").agg(F.max("src").alias("src"), F.max("out").alias("out"))
    role = F.when(F.col("src") & ~F.col("out"), "base").when(F.col("out") & ~F.col("src"), "sink")
    return flags.select("dataset", role.alias("role")).where(F.col("role").isNotNull())


def _inner_and_direct(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges as (dataset, node): those whose source is written somewhere, and
    those that read a base table."""
    e = cut_lineage(edges.select(F.col("output").alias("dataset"), F.col("source").alias("node")).distinct())
    written = e.select(F.col("dataset").alias("__written")).distinct()
    # one join tells which is which
    e = cut_lineage(e.join(written, F.col("node") == F.col("__written"), "left")
                    .select("dataset", "node", F.col("__written").isNotNull().alias("inner")))
    return (e.where("inner AND dataset <> node").select("dataset", "node"),
            e.where("NOT inner").select("dataset", F.col("node").alias("base")))


def _read(inner: DataFrame) -> DataFrame:
    """(dataset): datasets that others read."""
    return inner.select(F.col("node").alias("dataset")).distinct()


def lineage_cycles(edges: DataFrame) -> DataFrame:
    """Datasets that are built from themselves: (dataset, component), the
    component being the least dataset of its cycles; a step that reads what it
    writes is a cycle of one."""
    inner, _ = _inner_and_direct(edges)
    own = edges.where("source = output").select(F.col("output").alias("dataset"), F.col("output").alias("component")).distinct()
    # what nobody reads is on no cycle
    found = reach.cycles(inner.join(_read(inner), "dataset", "left_semi"))
    return own if found is None else found.unionByName(own.join(found, "dataset", "left_anti"))


def closure_to_base(edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(dataset, base table) pairs with a path base -> .. -> dataset.

    With ``targets`` (a column ``dataset``) the pairs of these datasets only.

    Datasets on a common cycle have the same bases, so cycles are collapsed; what
    is left is doubled (see ``reach``): after round k the bases within 2^k steps
    are known, so rounds grow with the logarithm of the depth. Datasets that nobody
    reads take no part in the rounds, they are one step from those that do. Without
    targets only pairs with bases are kept on the way, each round's own; with targets
    the datasets that each of them reaches, which then meet the tables read directly.
    """
    inner, direct = _inner_and_direct(edges)
    tables, ended = reach.walks(inner.join(_read(inner), "dataset", "left_semi"))
    component = None if ended else reach.cycles(tables[0], tables)
    if component is not None:
        tables, _ = reach.walks(reach.collapsed(tables[0], component, "dataset", "node").where("dataset <> node"))
    if targets is None:
        low = direct.join(_read(inner), "dataset", "left_semi").select("dataset", "base")
        steps = inner
        if component is not None:
            low = reach.collapsed(low, component, "dataset")
            members = component.select("dataset", F.col("component").alias("node"))
            steps = reach.collapsed(inner, component, "node").unionByName(members).distinct()
        found = cut_lineage(low)
        for w in tables:
            found = found.unionByName(cut_lineage(reach.then(w, found).distinct()))
        return direct.unionByName(reach.then(steps, found)).distinct()
    wanted = targets.select("dataset").distinct()
    if component is not None:
        wanted = reach.collapsed(wanted, component, "dataset")
        inner = reach.collapsed(inner, component, "dataset", "node")
        direct = reach.collapsed(direct, component, "dataset")
    up = wanted.select("dataset", F.col("dataset").alias("node"))
    for w in (inner, *tables):
        up = cut_lineage(up.unionByName(reach.then(up, w)).distinct())
    found = reach.then(up, direct).distinct()
    if component is not None:
        members = found.join(component.withColumnRenamed("dataset", "__member"), F.col("dataset") == F.col("component"))
        found = (found.join(component.select("dataset"), "dataset", "left_anti")
                 .unionByName(members.select(F.col("__member").alias("dataset"), "base"))
                 .join(targets.select("dataset").distinct(), "dataset", "left_semi"))
    return found.select("dataset", "base")


def missing_from_lineage(refs: DataFrame, nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Datasets a script references that its lineage document lacks."""
    return (refs.select(key, "dataset").distinct()
            .join(nodes.select(key, "dataset"), [key, "dataset"], "left_anti"))

"""Data-quality rules: flattening of rule answers (D2-D7), deterministic
derivation of rules from a mapping row and the catalog (D8, replacing the
model call), and checks of a table against rules in one pass (D9).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_blank, py_strip, strip_numbering
from tessera.operators.mapping import dedupe_catalog

ROW_FIELDS = ("source_table", "source_column", "target_table", "target_column")


# ---------------------------------------------------------------- D2-D7

def flatten_rules(answers: DataFrame, text_col: str = "raw", error_col: str = "error",
                  split_commas: bool = False) -> DataFrame:
    """One row per rule of each answer, in answer order (``rule_no`` from 1).

    The answer is stripped, split on runs of line breaks (the prompt asks for
    commas but the original splits on line breaks only, T17; ``split_commas``
    splits on both), blank pieces dropped, each piece stripped and its
    numbering removed. A failed request, or one without an answer, gives one
    ``[ERROR] ..`` rule.
    """
    sep = "[\n,]+" if split_commas else "\n+"
    pieces = F.split(py_strip(text_col), sep)
    pieces_as_rules = F.transform(F.filter(pieces, lambda r: ~is_blank(r)), strip_numbering)
    rules = F.when(F.col(error_col).isNotNull(),
                   F.array(F.concat(F.lit("[ERROR] "), F.col(error_col))))
    rules = rules.when(F.col(text_col).isNull(), F.array(F.lit("[ERROR] no answer"))).otherwise(pieces_as_rules)
    fields = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ROW_FIELDS]
    return (answers.select(*fields, F.posexplode(rules).alias("pos", "rule"))
            .select(*ROW_FIELDS, (F.col("pos") + 1).alias("rule_no"), "rule"))


# ---------------------------------------------------------------- D8

NUMERIC = ("tinyint", "int", "bigint", "double")


def _is_numeric(t: Column) -> Column:
    return t.isin(*NUMERIC) | t.startswith("decimal(")


def derive_rules(mappings: DataFrame, catalog: DataFrame, as_of: dt.date) -> DataFrame:
    """2-3 rules per mapping row, as (four row fields, kind, rule, argument).

    ``rule`` is the wording, a SQL predicate wherever one row can be tested;
    ``argument`` is what ``compile_rules`` needs to test it: the domain (a JSON
    list), the date, the type, or the parent ``table.column`` of a reference.

    Type and domain come from the catalog entry of the *target* column; only
    when it has none and the logic is a direct mapping do the source's
    (enriched) metadata stand in (T25). Domain values compare as strings.
    """
    cat = dedupe_catalog(catalog).select(
        F.col("table_name").alias("__tt"), F.col("column_name").alias("__tc"),
        F.col("data_type").alias("__dt"), F.col("is_categorical").alias("__cat"), F.col("categories").alias("__dom"))
    m = mappings.join(cat, (F.col("target_table") == F.col("__tt"))
                      & (F.col("target_column") == F.col("__tc")), "left")
    direct = F.col("transformation_logic") == "Direct mapping"
    dtype = F.coalesce(F.col("__dt"), F.when(direct & (F.col("data_type") != ""), F.col("data_type")))
    is_cat = F.coalesce(F.col("__cat"), F.when(direct, F.col("is_categorical")), F.lit(False))
    dom = F.coalesce(F.col("__dom"), F.when(direct, F.col("categories")), F.array().cast("array<string>"))
    col = F.col("target_column")
    logic = F.upper(F.ltrim(F.coalesce(F.col("transformation_logic"), F.lit(""))))
    aggregated = logic.startswith("COUNT") | logic.startswith("SUM") | logic.startswith("AVG")
    numeric = _is_numeric(F.coalesce(dtype, F.lit("")))
    source = F.concat(F.col("source_table"), F.lit("."), F.col("source_column"))

    def rule(cond: Column, kind: str, text: Column, argument: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), text.alias("rule"),
                                     (none if argument is None else argument).alias("argument")))

    quoted = F.transform(dom, lambda v: F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'")))
    rules = F.array(
        rule(F.lit(True), "completeness", F.concat(col, F.lit(" IS NOT NULL"))),
        rule(is_cat & (F.size(dom) > 0), "domain",
             F.concat(col, F.lit(" IN ("), F.array_join(quoted, ", "), F.lit(")")), F.to_json(dom)),
        rule(dtype == "date", "not_future",
             F.concat(col, F.lit(f" <= DATE '{as_of.isoformat()}'")), F.lit(as_of.isoformat())),
        rule(numeric & aggregated, "non_negative", F.concat(col, F.lit(" >= 0"))),
        rule(numeric & ~aggregated, "type",
             F.concat(F.lit("try_cast("), col, F.lit(" AS "), dtype, F.lit(") IS NOT NULL")), dtype),
        rule((dtype == "string") & ~is_cat, "not_blank",
             F.concat(F.lit("length(trim("), col, F.lit(")) > 0"))),
        rule(dtype.isNull(), "catalog", F.concat(source, F.lit(" is listed in the catalog")), source),
        rule(col.endswith("_id") & direct, "reference", F.concat(col, F.lit(" exists in "), source), source),
    )
    out = m.select(*ROW_FIELDS, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    return out.select(*ROW_FIELDS, "r.*")


# ---------------------------------------------------------------- D9

@dataclass(frozen=True)
class RowRule:
    """A rule a single row passes or fails: ``ok`` is true for a good row."""
    name: str
    ok: Column


INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"


def _type_ok(column: str, dtype: str, kind: str) -> Column:
    """Whether a value of type ``kind`` can be read as ``dtype``. Of texts only
    those that look like a number are cast: a failed cast costs far more than a
    pattern."""
    c = F.col(f"`{column}`")
    if kind == dtype:
        return c.isNotNull()
    if kind != "string":
        return c.try_cast(dtype).isNotNull()
    pattern = INTEGER_TEXT if dtype in ("tinyint", "int", "bigint") else r"^\s*[+-]?[0-9.]+([eE][+-]?[0-9]+)?\s*$"
    return F.when(c.rlike(pattern), c.try_cast(dtype).isNotNull()).otherwise(F.lit(False))


def compile_rules(rules: DataFrame, df: DataFrame) -> tuple[list[RowRule], list[tuple[str, str, str]]]:
    """The rules derived for the columns of one table, ready to run on
    ``df``: row rules, and references as (name, column, parent table.column).

    The driver collects the rules of one table, a few per column of ``df``;
    rules for columns that ``df`` lacks, and ``catalog`` notes (nothing to test in
    a row), are left out.
    """
    kinds = dict(df.dtypes)
    row_rules, references = [], []
    wanted = rules.where(F.col("target_column").isin(*df.columns)).select("target_column", "kind", "argument").distinct()
    for column, kind, argument in sorted(tuple(r) for r in wanted.collect()):
        c, name = F.col(f"`{column}`"), f"{column}_{kind}"
        if kind == "reference":
            references.append((f"{name}_{argument}", column, argument))
            continue
        ok = {"completeness": lambda: c.isNotNull(),
              "domain": lambda: c.cast("string").isin(*json.loads(argument)),
              "not_future": lambda: c <= F.lit(dt.date.fromisoformat(argument)),
              "non_negative": lambda: c >= 0,
              "type": lambda: _type_ok(column, argument, kinds[column]),
              "not_blank": lambda: F.length(F.trim(c)) > 0}.get(kind)
        if ok:
            row_rules.append(RowRule(name, ok()))
    return row_rules, references


def check_rows(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """D9, row rules: one scan and one global aggregate for all rules, then
    ``unpivot`` to (rule, bad, total). A rule whose test is NULL counts as
    bad (an unknown value did not pass)."""
    aggs = [F.count(F.lit(1)).alias("__total")]
    aggs += [F.sum(F.when(F.coalesce(r.ok, F.lit(False)), 0).otherwise(1)).cast("bigint").alias(r.name)
             for r in rules]
    wide = df.agg(*aggs)
    long = wide.unpivot("__total", [r.name for r in rules], "rule", "bad")
    return long.select("rule", F.coalesce("bad", F.lit(0)).cast("bigint").alias("bad"),
                       F.col("__total").alias("total"))


def check_references(child: DataFrame, references: Sequence[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """D9, referential rules (name, child key, parent, parent key): child rows
    whose key is missing in the parent (NULL keys are not checked), as (rule,
    bad, total).

    The child is counted per foreign key first, so a hot key is one row before
    any join, and rules on one child key share that count; rows without a key
    never reach the join; a ``left_anti`` join leaves the orphans' counts.
    """
    names = F.array(*[F.lit(r[0]) for r in references])
    parts = child.agg(F.count(F.lit(1)).alias("total")).select(F.explode(names).alias("rule"), F.lit(0).alias("bad"), "total")
    counts = {}
    for name, key, parent, parent_key in references:
        if key not in counts:
            counts[key] = (child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k"))
                           .agg(F.count(F.lit(1)).alias("__n")))
        orphans = counts[key].join(parent.select(F.col(parent_key).alias("__p")), F.col("__k") == F.col("__p"), "left_anti")
        parts = parts.unionByName(orphans.select(F.lit(name).alias("rule"), F.col("__n").alias("bad"), F.lit(0).alias("total")))
    return parts.groupBy("rule").agg(F.sum("bad").cast("bigint").alias("bad"), F.sum("total").cast("bigint").alias("total"))


def check_reference(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """One referential rule."""
    return check_references(child, [(name, child_key, parent, parent_key)])

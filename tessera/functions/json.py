"""Strict reading of JSON texts as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_strict_variant(df: DataFrame, c: Column, name: str) -> DataFrame:
    """Adds the one JSON value that a text is; NULL for anything else.

    Spark's parser stops after the first value, so the text is parsed as the
    first item of an array whose second one is the text's own digest: text behind
    the value, a second value or an early bracket leave another array. Single
    quotes and repeated keys are refused by the parser itself. The array is a
    column of its own, so that it is parsed once; its items are read by their place.
    """
    array, seal = f"{name}_array", F.md5(c)
    parsed = F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), seal, F.lit('"]')))
    item = lambda i, to="variant": F.try_variant_get(F.col(array), f"$[{i}]", to)
    sealed = (item(1, "string") == seal) & item(2).isNull()
    return df.withColumn(array, parsed).withColumn(name, F.when(sealed, item(0))).drop(array)


def kind(v: Column) -> Column:
    """The type of a variant as text, e.g. STRING or ARRAY<STRING>; NULL if missing."""
    return F.schema_of_variant(v)


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def items(v: Column) -> Column:
    """The items of a list; none for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def is_a(v: Column, *kinds: str) -> Column:
    """Missing, or of one of these types."""
    return F.coalesce(kind(v), F.lit("none")).isin("none", *kinds)


def is_string_list(v: Column, *others: str) -> Column:
    """Missing, a list of strings (none of them null), or of one of the other types."""
    return is_a(v, "ARRAY<STRING>", "ARRAY<VOID>", *others) & ~F.exists(items(v), lambda x: kind(x) != "STRING")

"""Lookups of a large fact side against dimension tables.

A left join shuffles NULL keys like any other value, so every fact row without
a key would land in one reducer. Here the join key is one struct (key, salt):
the salt is 0 for rows that have a key and for the dimension, and spreads the
rows without one, which match nothing. (As a second, separate key the salt
would be folded away, because it is a constant on the dimension's side.)

No broadcast is hinted: adaptive execution decides it from measured sizes, and
splits hot keys of a single sort-merge join. In a chain of joins on one key it
can do so only at the first, so keys known to be hot (``hot_keys``, a mergeable
sketch of the fact's keys) take a salt as well: their fact rows are dealt to
``HOT_SALTS`` places by a hash of the row and their few dimension rows are
repeated once for each. The sketch only says where to salt; the result does not
depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# salt range for fact rows without a key
NULL_SPREAD = 1024
# column of the struct key
KEY = "__key"
# places that the rows of a hot key are dealt to
HOT_SALTS = 64


class Lookup(NamedTuple):
    dim: DataFrame
    key: str                  # of the dimension
    keep: Sequence[str]       # columns that it adds


def hot_keys(fact: DataFrame, keys: Sequence[str], share: float = 0.01, tracked: int = 1 << 14) -> dict[str, list]:
    """For each key column the values on more than ``share`` of the rows.

    One pass, with a sketch of at most ``tracked`` counters per column and task
    (frequent items, merged like partial sums): a value above the share is never
    missed as long as 3.5 / tracked is below it. At most 1 / share values a column
    come to the driver. NULL is no value here: such rows are spread anyway.
    """
    if not 4 / tracked < share < 1:
        raise ValueError(f"a share of {share} is beyond {tracked} counters")
    top = int(2 / share)
    row = fact.agg(F.count("*").alias("n"), *(
        F.expr(f"approx_top_k(`{k}`, {min(top, tracked)}, {tracked})").alias(f"t{i}") for i, k in enumerate(keys))).first()
    return {k: sorted(x["item"] for x in row[f"t{i}"] or [] if x["item"] is not None and x["count"] > share * row["n"])
            for i, k in enumerate(keys)}


def _row_hash(fact: DataFrame, places: int, by: Sequence[str] | None = None) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in by or fact.columns]), F.lit(places)).cast("int") + 1


def spread_key(fact: DataFrame, key: str, spread: int = NULL_SPREAD, hot: Sequence = (), salts: int = HOT_SALTS,
               by: Sequence[str] | None = None) -> Column:
    """(key, salt): the salt is a hash of the row, so a retried task sends each
    row to the same place. Rows without a key are spread by the columns ``by`` only,
    if given: then rows that agree in them and in the key stay together."""
    salt = F.when(F.col(key).isNull(), _row_hash(fact, spread, by))
    if hot:
        salt = salt.when(F.col(key).isin(*hot), _row_hash(fact, salts))
    return F.struct(F.col(key).alias("k"), salt.otherwise(F.lit(0)).alias("s"))


def _salted_dim(look: Lookup, name: str, hot: Sequence, salts: int) -> DataFrame:
    """The dimension under its (key, salt), rows of hot keys once for each salt."""
    dim = look.dim.where(F.col(look.key).isNotNull())
    if not hot:
        return dim.select(F.struct(F.col(look.key).alias("k"), F.lit(0).alias("s")).alias(name), *look.keep)
    places = F.when(F.col(look.key).isin(*hot), F.sequence(F.lit(1), F.lit(salts))).otherwise(F.array(F.lit(0)))
    return (dim.select(F.col(look.key).alias("__k"), *look.keep, F.explode(places).alias("__s"))
            .select(F.struct(F.col("__k").alias("k"), F.col("__s").alias("s")).alias(name), *look.keep))


def lookup_all(fact: DataFrame, fact_key: str, lookups: Sequence[Lookup],
               spread: int = NULL_SPREAD, hot: Sequence = (), salts: int = HOT_SALTS) -> DataFrame:
    """Several ``LEFT JOIN dim ON fact.fact_key = dim.key``, one after another.

    The struct key is made once, so the joins share one partitioning of the
    fact side, in which the rows of ``hot`` keys are dealt to many places. Fan-out
    is kept: a key with two dimension rows doubles the fact row, as in SQL. A fact
    that has the key already (``KEY``, without hot keys) keeps it, for steps that
    share the partitioning.
    """
    keyed = KEY in fact.columns
    out = fact if keyed else fact.withColumn(KEY, spread_key(fact, fact_key, spread, hot, salts))
    for i, look in enumerate(lookups):
        k = f"__k{i}"
        out = out.join(_salted_dim(look, k, hot, salts), F.col(KEY) == F.col(k), "left").drop(k)
    return out if keyed else out.drop(KEY)


def lookup_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                keep: Sequence[str], spread: int = NULL_SPREAD, hot: Sequence = ()) -> DataFrame:
    """``fact LEFT JOIN dim ON fact.fact_key = dim.dim_key``, adding ``keep``."""
    return lookup_all(fact, fact_key, [Lookup(dim, dim_key, keep)], spread, hot)

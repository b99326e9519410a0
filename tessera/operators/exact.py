"""Aggregates that merge without loss: order-free averages, distinct counts as bitmaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- averages

#: A double is split at 2^-SCALE; the rest is kept to 53 more bits.
SCALE, REST = 30, 53
LIMIT = float(1 << 62 - SCALE)


def average(c: str) -> Column:
    """AVG of a double column that does not depend on the order of the rows.

    A double sum rounds after every addition, so it changes with the
    partitioning. Here each value is cut into two whole numbers, a multiple of
    2^-30 and the rest in units of 2^-83; both are summed as decimals, exactly, and
    only the two totals become doubles. Values of 2^32 and more raise an error.
    NULLs don't count; NaN and infinities give what AVG gives, in any order.
    """
    x = F.col(c)
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    safe = F.when(finite & (F.abs(x) < LIMIT), x).when(
        finite, F.raise_error(F.concat(F.lit("average: out of range: "), x.cast("string"))).cast("double"))
    scaled = safe * float(1 << SCALE)
    high = F.floor(scaled)
    low = F.floor((scaled - high.cast("double")) * float(1 << REST))
    total = lambda part: F.sum(part.cast("decimal(20,0)")).cast("double")
    exact = (total(high) * 2.0 ** -SCALE + total(low) * 2.0 ** -(SCALE + REST)) / F.count(x).cast("double")
    return F.when(F.coalesce(F.bool_or(~finite), F.lit(False)), F.avg(x)).otherwise(exact)


# ---------------------------------------------------------------- distinct counts (A4)

def distinct_state(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """(keys, bucket, bits): the distinct non-NULL whole numbers of ``c`` per key,
    as bitmaps of 32,768 neighbouring values each. Groups without a value have one
    row without bitmap, so that they are not lost."""
    v = F.col(c).cast("long")
    return (df.withColumn("__b", F.bitmap_bucket_number(v)).withColumn("__p", F.bitmap_bit_position(v))
              .groupBy(*keys, F.col("__b").alias("bucket"))
              .agg(F.max(v).alias("__any"), F.bitmap_construct_agg("__p").alias("bits"))
              .select(*keys, "bucket", F.when(F.col("__any").isNotNull(), F.col("bits")).alias("bits")))


def merge_distinct(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state of coarser groups, or of several states put together: bitmaps are
    or-ed, no value is looked at again."""
    return state.groupBy(*keys, "bucket").agg(
        F.when(F.max(F.col("bits").isNotNull()), F.bitmap_or_agg(F.coalesce("bits", F.lit(b"")))).alias("bits"))


def count_state(state: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, name): the number of distinct values of each group."""
    n = F.when(F.col("bits").isNull(), F.lit(0)).otherwise(F.bitmap_count("bits"))
    return merge_distinct(state, keys).groupBy(*keys).agg(F.sum(n).cast("long").alias(name))

"""Semi-join reduction by a Bloom filter that is an ordinary aggregate.

The filter is a table (word, bits) of 64-bit words: a key sets ``PROBES`` bits of
one word, so building is one grouping with ``bit_or`` (words are merged before
the shuffle) and asking is one join on the word. Rows whose key was never added
are left out except for a few false ones, which the join that follows drops
anyway; rows of added keys always stay.

The filter is broadcast, so its size is checked first: keys that need more words
than ``max_words`` (16 bytes each) get no filter and everything goes on as without.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
PROBES = 4
#: 2^21 words: 32 MB of rows.
MAX_WORDS = 1 << 21


class Filter(NamedTuple):
    words: DataFrame      # (word, bits)
    n_words: int


def _word(key: Column, n_words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_words))


def _bits(key: Column) -> Column:
    """PROBES bits of 64, from six bits each of another hash."""
    h = F.xxhash64(F.lit("bits"), key)
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"),
                                    F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    out = one(0)
    for i in range(1, PROBES):
        out = out.bitwiseOR(one(i))
    return out


def words_for(n_keys: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n_keys * BITS_PER_KEY / 64))))


def build(keys: DataFrame, key: str, n_words: int | None = None, max_words: int = MAX_WORDS) -> Filter | None:
    """A filter of the non-NULL values of ``key``, None if it would be too large.
    ``n_words`` sets its size (fewer words, more false answers)."""
    if n_words is None:
        n_words = words_for(keys.agg(F.approx_count_distinct(key)).first()[0])
    if n_words > max_words:
        return None
    k = F.col(key)
    return Filter(keys.where(k.isNotNull()).select(_word(k, n_words).alias("word"), _bits(k).alias("bits"))
                  .groupBy("word").agg(F.bit_or("bits").alias("bits")), n_words)


def maybe_in(df: DataFrame, key: str, filter_: Filter | None) -> DataFrame:
    """Rows of ``df`` whose key the filter may hold; all rows without a filter."""
    if filter_ is None:
        return df
    words = F.broadcast(filter_.words.toDF("__word", "__bits"))       # at most max_words rows
    k = F.col(key)
    return df.join(words, (_word(k, filter_.n_words) == F.col("__word"))
                   & (F.col("__bits").bitwiseAND(_bits(k)) == _bits(k)), "left_semi")

"""Mixing sources to target weights by iterative proportional fitting (operator 10).

Token counts are tabulated by source, language and topic. The table is raked:
a factor per category of each margin is scaled, margin after margin, until the
expected kept tokens of every category meet their target. A document's
probability is the product of its three factors, at most 1, and a hash of its id
decides, so the sample is the same on every run and for any partitioning.

Categories without a target of their own are one category, "other"; so the table
has at most (sources + 1) * (languages + 1) * (topics + 1) rows whatever the size
of the corpus, which bounds what the driver collects. The factors go into the
plan as three literal maps: no join, and no shuffle but the table's, which is
summed first.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh, in_batches

OTHER = "other"
SOURCES = {f"src{i}": 0.05 for i in range(20)}
LANGUAGES = {"en": 0.45, "de": 0.20, "fr": 0.20, "es": 0.15}
TOPICS = {"note": 0.10, "article": 0.60, "book": 0.15, "table": 0.075, "marked": 0.075}


_SURFACE = T.StructType([T.StructField(c, T.LongType()) for c in ("tokens", "marks", "bars", "chars")])


def surface(text: Column) -> Column:
    """White-space separated words, marks (#%&*$!), bars and characters of a
    text; all 0 for NULL. One Arrow batch at a time: splitting by a pattern in
    the JVM takes several times as long."""
    def count(texts: pd.Series) -> pd.DataFrame:
        rows = [(0, 0, 0, 0) if not t else
                (len(t.split()), sum(map(t.count, "#%&*$!")), t.count("|"), len(t)) for t in texts]
        return pd.DataFrame(rows, columns=["tokens", "marks", "bars", "chars"], dtype="int64")

    return F.pandas_udf(count, _SURFACE)(text)


def surface_topic(s: Column) -> Column:
    """Topic by ``surface`` form, for corpora without a topic column: ``table``
    (one word in four is a bar), ``marked`` (a twentieth of the characters are
    marks), else ``note`` (under 150 words), ``article`` or ``book`` (1,500 or more)."""
    tokens, marks, bars, chars = (s[c] for c in ("tokens", "marks", "bars", "chars"))
    return (F.when((bars > 0) & (bars * 4 >= tokens), "table")
             .when((marks > 0) & (marks * 20 >= chars), "marked")
             .when(tokens < 150, "note").when(tokens < 1500, "article").otherwise("book"))


def _category(c: Column, targets: Mapping[str, float]) -> Column:
    return F.when(c.cast("string").isin(*targets), c.cast("string")).otherwise(F.lit(OTHER))


def rake(cells: np.ndarray, mass: np.ndarray, targets: list[np.ndarray], keep: float,
         rounds: int = 500, tolerance: float = 1e-9) -> list[np.ndarray]:
    """Factors of each margin's categories.

    ``cells``: category numbers, a row per cell; ``targets``: shares by category.
    The expected kept mass of category k shall be keep * total * share k, where a
    cell keeps min(1, product of its factors) of its mass. Categories without
    mass drop out and the others' shares are scaled to 1. A category that lacks
    the mass for its target ends at probability 1.
    """
    total = float(mass.sum())
    goals, factors = [], []
    for j, t in enumerate(targets):
        there = np.bincount(cells[:, j], weights=mass, minlength=len(t)) > 0
        share = np.where(there, t, 0.0)
        goals.append(keep * total * share / share.sum() if share.sum() > 0 else keep * total * there / max(1, there.sum()))
        factors.append(np.ones(len(t)))
    for _ in range(rounds):
        worst = 0.0
        for j, goal in enumerate(goals):
            p = np.minimum(1.0, np.prod([f[cells[:, i]] for i, f in enumerate(factors)], axis=0))
            now = np.bincount(cells[:, j], weights=p * mass, minlength=len(goal))
            scale = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            worst = max(worst, float(np.abs(scale[now > 0] - 1).max(initial=0.0)))
            factors[j] = np.clip(factors[j] * scale, 0.0, 1e6)
        if worst < tolerance:
            break
    return factors


def with_probability(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                     lang: str = "lang", topic: Column | None = None, sources: Mapping[str, float] = SOURCES,
                     languages: Mapping[str, float] = LANGUAGES, topics: Mapping[str, float] = TOPICS,
                     keep: float = 0.5, seed: int = 10) -> DataFrame:
    """``docs`` plus n_tokens, topic, probability and sampled (replacing columns
    of these names).

    ``keep`` is the share of all tokens that the sample shall hold. NULL and
    unlisted categories count as "other", with the target that the listed ones
    leave; if their targets sum to 1, "other" has its share of the tokens and the
    listed ones share the rest. Only a target of 0 for "other" drops it. A text without words has no weight in
    the table and the probability of its cell. Copies of a row share its fate; a
    NULL id is decided by its text.
    """
    n, c = fresh(docs, "tokens"), [fresh(docs, x) for x in ("source", "lang", "topic")]
    look = fresh(docs, "surface")
    counted = in_batches(docs).withColumn(look, surface(F.col(text))).withColumn(n, F.col(look)["tokens"])
    counted = (counted
               .withColumn(c[2], surface_topic(F.col(look)) if topic is None else topic)
               .withColumn(c[0], _category(F.col(source), sources)).withColumn(c[1], _category(F.col(lang), languages))
               .withColumn(c[2], _category(F.col(c[2]), topics)).drop(look))
    rows = counted.groupBy(*c).agg(F.sum(n)).collect()
    margins = []
    total = sum(r[3] or 0 for r in rows)
    for j, t in enumerate((sources, languages, topics)):
        listed = sum(t.values())
        if OTHER in t or listed < 1 - 1e-9:
            margins.append({**t, OTHER: t.get(OTHER, 1.0 - listed)})
        else:
            seen = sum(r[3] or 0 for r in rows if r[j] == OTHER) / total if total else 0.0
            margins.append({**{k: v * (1.0 - seen) for k, v in t.items()}, OTHER: seen})
    number = [{k: i for i, k in enumerate(m)} for m in margins]
    rows = [r for r in rows if r[3]]
    if rows:
        cells = np.array([[number[j][r[j]] for j in range(3)] for r in rows])
        factors = rake(cells, np.array([float(r[3]) for r in rows]), [np.array(list(m.values())) for m in margins], keep)
    else:
        factors = [np.full(len(m), 1.0) for m in margins]
    p = F.lit(1.0)
    for j, m in enumerate(margins):
        pairs = [x for k, f in zip(m, factors[j], strict=True) for x in (F.lit(k), F.lit(float(f)))]
        p = p * F.element_at(F.create_map(*pairs), F.col(c[j]))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.when(F.col(doc_id).isNull(), F.col(text)),
                                        F.col(doc_id)), 11) / F.lit(float(1 << 53))
    return (counted.withColumn("n_tokens", F.col(n)).withColumn("topic", F.col(c[2]))
                   .withColumn("probability", F.least(F.lit(1.0), p))
                   .withColumn("sampled", u < F.col("probability")).drop(n, *c))

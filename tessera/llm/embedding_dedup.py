"""Near-duplicate embeddings by quantised tile products (operator 3).

Vectors of one label are compared in square tiles. Each vector is scaled to unit
length and quantised to int8 with a scale of its own; the norm of what the
rounding lost bounds the error of any product rigorously:

    |x.y - sx sy qx.qy| <= ex + (1 + ex) ey

A tile's int8 products (as exact float sums: 127 * 127 * 1024 < 2 ** 24) plus that
bound rule out nearly all pairs; only pairs possibly at or above the threshold
are computed again in double precision. A tile returns sums, not pairs: links
per vector, and for the components at most one edge per vector.

Scale: exact copies are collapsed first, so a vector that a third of all rows
share is compared once. Vectors are dealt to blocks of a label by hash; a label
of n vectors has n / ``block`` blocks, and every pair of blocks is a task of its
own, so a hot label is many equal tasks and none holds more than two blocks. The
work is quadratic in the label, as all-pairs comparison within a label is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.components import connected, least_labels

_CHUNK = 1 << 15      # pairs computed at a time in double precision


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32), scales and error norms of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None])
    lost = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q.astype(np.float32), scale, lost + 1e-12


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (rows of x, rows of y) whose cosine is at least ``threshold``."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, ex), (qy, sy, ey) = quantise(x / nx[:, None]), quantise(y / ny[:, None])
    product = np.zeros((len(x), len(y)))
    for k in range(0, x.shape[1], 1024):
        product += qx[:, k:k + 1024] @ qy[:, k:k + 1024].T
    upper = product * sx[:, None] * sy[None, :] + (ex[:, None] + (1 + ex)[:, None] * ey[None, :])
    a, b = np.nonzero(upper >= threshold)
    keep = np.zeros(len(a), bool)
    for k in range(0, len(a), _CHUNK):
        i, j = a[k:k + _CHUNK], b[k:k + _CHUNK]
        keep[k:k + _CHUNK] = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= threshold
    return a[keep], b[keep]


def _tile(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        vectors = np.array(pdf["embedding"].tolist(), dtype=np.float64)
        vectors /= np.abs(vectors).max(axis=1)[:, None]       # no overflow or underflow in the squares
        rep, copies, block = (pdf[c].to_numpy() for c in ("rep", "copies", "block"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = linked_pairs(vectors[left], vectors[right], threshold)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        links = np.zeros(len(pdf), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        label = least_labels(len(pdf), a, b)
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[some], "links": links[some], "least": rep[label[some]]})

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    threshold: float = 0.98, block: int = 1024) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not NULL and their cosine
    is at least ``threshold``. NULL, empty and zero vectors, vectors with NULL or
    non-finite parts, and vectors without an id or of different lengths link
    with nothing. A row that repeats a vec_id with the same vector counts as one
    more vector at the same place.
    """
    e = F.col("embedding")
    ok = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull()
          & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0))
    base = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    keyed = (base.withColumn("ok", F.coalesce(ok, F.lit(False)))
                 .withColumn("h1", F.when(F.col("ok"), F.xxhash64("label", "embedding")))
                 .withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit("vector"), "embedding", "label"))))
    usable = keyed.where("ok")
    reps = cut(usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    one = usable.join(reps.drop("copies"), ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["h1", "h2"])
    one = cut(one.drop("rep", "ok").join(reps, ["h1", "h2"]).withColumn("dim", F.size("embedding")))
    sizes = one.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    dealt = (one.join(sizes, ["label", "dim"])
                .withColumn("block", F.pmod(F.xxhash64("rep", "h1"), "blocks").cast("int"))
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                        "block", "rep", "copies", "embedding"))
    found = cut(dealt.groupBy("label", "dim", "i", "j")
                     .applyInPandas(_tile(threshold), "rep long, links long, least long"))
    groups = connected(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (reps.join(links, "rep", "left")
                 .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("component", "rep").alias("component_id")))
    return (keyed.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
                 .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
                 .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))

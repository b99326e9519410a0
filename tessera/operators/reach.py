"""Reachability over an edge table in logarithmically many rounds.

Edges are (dataset, node): ``node`` is read by ``dataset``. ``walks`` doubles
them: table k joins the ends of walks of exactly 2^k edges, made by joining
table k - 1 with itself, so a chain of a thousand datasets takes ten rounds.
Every length is a sum of different powers of two, hence any property that
passes along a walk (a mark, a least label, the bases found) is carried over the
whole graph by one join per table.

A graph without cycles runs out of walks at its depth. If from one table to the
next no dataset drops out, none ever will (a finite depth would pass through all
the depths below it), so the rest reaches a cycle. Strongly connected components
are found there by colours: every dataset takes the least (hashed) name it
reaches, and the datasets of one colour that the colour's own dataset reaches are
a component. A component shows itself if its colour is the least that it reaches;
hashed names make that so for all after an expected logarithmic number of passes.

Each table is written to the checkpoint folder, in columns. Names that most edges share are
split by adaptive execution (both sides of the joins are shuffled, nothing is
hinted). The driver sees a count and one boolean a round. Doubling costs most in
a component with many ways round: its walks may join all pairs of its members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stored as cut_lineage


def _renamed(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


def then(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dataset, x) for a's (dataset, node) and b's (node, x)."""
    left = _renamed(a.select("dataset", "node"), "dataset", "__via")
    right = _renamed(b, "__from", b.columns[1])
    return left.join(right, F.col("__via") == F.col("__from")).select("dataset", b.columns[1])


def walks(edges: DataFrame) -> tuple[list[DataFrame], bool]:
    """Tables (dataset, node) of walks of exactly 1, 2, 4, .. edges, as long as
    there are any, and whether they ended (no cycle)."""
    tables, before = [], None
    now = cut_lineage(edges.select("dataset", "node").distinct())
    while (n := now.select("dataset").distinct().count()) not in (0, before):
        tables.append(now)
        now, before = cut_lineage(then(now, now).distinct()), n
    return (tables, True) if n == 0 else ([*tables, now], False)


def _among(df: DataFrame, names: DataFrame, how: str, *cols: str) -> DataFrame:
    """``df`` semi- or anti-joined with the datasets of ``names``, column by column."""
    out = df
    for c in cols:
        out = out.join(_renamed(names.select("dataset"), c), c, how)
    return out.select(*df.columns)       # a join by name puts that name first


def _least_reached(doubled: list[DataFrame], names: DataFrame) -> DataFrame:
    """(dataset, c): the least (hash, name) that a dataset reaches, itself included.
    ``doubled`` grows by as many tables as that takes."""
    colour = names.select("dataset", F.struct(F.xxhash64("dataset").alias("h"), F.col("dataset").alias("of")).alias("c"))
    k = 0
    while True:
        if k == len(doubled):
            doubled.append(cut_lineage(then(doubled[-1], doubled[-1]).distinct()))
        colour = cut_lineage(colour.unionByName(then(doubled[k], colour)).groupBy("dataset").agg(F.min("c").alias("c")))
        k += 1
        better = then(doubled[0], colour).join(_renamed(colour, "dataset", "own"), "dataset").where("c < own")
        if better.isEmpty():
            return colour


def _reached_by_own(doubled: list[DataFrame], colour: DataFrame) -> DataFrame:
    """(dataset, c): datasets that the dataset of their colour reaches."""
    own = _renamed(colour, "dataset", "own")
    marked, n, k = colour.where(F.col("c.of") == F.col("dataset")), 0, 0
    while True:
        for w in {0: doubled[0], k: doubled[min(k, len(doubled) - 1)]}.values():
            down = w.select(F.col("node").alias("dataset"), F.col("dataset").alias("node"))
            stepped = then(down, _renamed(marked, "node", "c")).join(own, "dataset").where(F.col("c") == F.col("own"))
            marked = marked.unionByName(stepped.select("dataset", "c"))
        marked = cut_lineage(marked.distinct())
        before, n = n, marked.count()
        if n == before:
            return marked
        k += 1


def cycles(edges: DataFrame, tables: list[DataFrame] | None = None) -> DataFrame | None:
    """(dataset, component) of the datasets on cycles of more than one, None if
    there are none; the component is its least dataset. ``tables`` are the walks of
    ``edges`` where they are known already and don't end."""
    ended, found = False, None
    if tables is None:
        tables, ended = walks(edges)
    while not ended:
        # what reaches a cycle, and is reached from as far as the last walks go
        last = tables[-1]
        middle = cut_lineage(last.select("dataset").intersect(last.select("node")))
        doubled = [cut_lineage(_among(tables[0], middle, "left_semi", "dataset", "node"))]
        colour = _least_reached(doubled, middle)
        marked = _reached_by_own(doubled, colour)
        least = marked.groupBy("c").agg(F.min("dataset").alias("component"), F.count("*").alias("n"))
        part = marked.join(least, "c").where("n > 1").select("dataset", "component")
        found = part if found is None else found.unionByName(part)
        tables, ended = walks(_among(doubled[0], marked, "left_anti", "dataset", "node"))
    return None if found is None else cut_lineage(found)


def collapsed(edges: DataFrame, component: DataFrame, *cols: str) -> DataFrame:
    """``edges`` with the datasets of ``cols`` replaced by their components."""
    for c in cols:
        to = _renamed(component.select("dataset", "component"), "__d", "__c")
        edges = (edges.join(to, F.col(c) == F.col("__d"), "left")
                 .withColumn(c, F.coalesce("__c", c)).drop("__d", "__c"))
    return edges.distinct()

"""Merkle manifest of a dataset (operator 12), by slot pivots.

Each row is a leaf, each group (``lang``) a tree of ``FANOUT`` children a node,
and the groups' roots are the leaves of one more tree. A level is one grouping:
conditional aggregates spread the children of a parent into ``FANOUT`` columns
(slots), and the hash of the concatenated columns is the parent. Coming down
again, a parent's row yields its children, one per slot; concatenating the
columns before and after the own slot gives a child's siblings, so no level is
joined with itself.

Scale. Texts are read once, where the leaf is hashed; all that follows carries
digests. Positions come from one range partitioning by (group, id), whose sorted
partitions number their rows by themselves; offsets come from the counts per
(partition, group), so a group with most of the rows has no task of its own. A
level is an eighth of the one below, in rows and in shuffle, and every parent
has at most ``FANOUT`` children. The driver sees the largest level size and the
number of levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut

FANOUT = 8
SLOTS = [f"s{k}" for k in range(FANOUT)]


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """``-`` for NULL, else byte length, colon, value: no two rows read alike."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column ``g``) plus ``idx``, the position within ``g`` by
    ``order`` (ascending, NULLs first), and ``n``, the number of rows of ``g``.
    Rows that are equal in ``order`` share no position; which comes first is open."""
    at = cut(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
             .withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    runs = at.groupBy("g", part).agg(F.min("at").alias("start"), F.count("*").alias("size"))
    by_group = Window.partitionBy("rg")
    runs = runs.select(F.col("g").alias("rg"), F.col("part"), "start", "size").withColumn(
        "before", F.sum("size").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select(
        "rg", "part", "start", F.coalesce("before", F.lit(0)).alias("before"), F.sum("size").over(by_group).alias("n"))
    return (at.withColumn("p", part).join(runs, (F.col("p") == F.col("part")) & F.col("g").eqNullSafe(F.col("rg")))
              .withColumn("idx", F.col("at") - F.col("start") + F.col("before"))
              .drop("at", "p", "part", "rg", "start", "before"))


def pivot(nodes: DataFrame, value: str) -> DataFrame:
    """One row per parent of ``nodes`` (g, idx, n, ``value``): g, idx, n of the
    next level, the children in the slot columns, NULL where there is none."""
    slot = F.col("idx") % FANOUT
    return (nodes.groupBy("g", F.floor(F.col("idx") / FANOUT).alias("up"))
                 .agg(*(F.max(F.when(slot == k, F.col(value))).alias(s) for k, s in enumerate(SLOTS)),
                      F.first("n").alias("n"))
                 .select("g", F.col("up").alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"), *SLOTS))


def _hashes(child) -> Column:
    """Hash of the slot columns; ``child`` takes a slot's column to its digest."""
    return digest(F.concat_ws("", *(child(F.col(s)) for s in SLOTS)))


def _children(parents: DataFrame, child) -> DataFrame:
    """(g, idx, subroot, slot, path) for every filled slot: the path of a child is
    its own (left, right) siblings, then its parent's path."""
    def beside(k):
        left, right = (F.concat_ws("", *(child(F.col(s)) for s in part)) if part else F.lit("")
                       for part in (SLOTS[:k], SLOTS[k + 1:]))
        return F.struct(left.alias("l"), right.alias("r"))

    each = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(s).alias("slot"), beside(k).alias("own"))
                     for k, s in enumerate(SLOTS)))
    return (parents.select("g", "idx", "subroot", "path", F.explode(F.filter(each, lambda x: x["slot"].isNotNull())).alias("c"))
                   .select("g", (F.col("idx") * FANOUT + F.col("c.k")).alias("idx"), "subroot", F.col("c.slot").alias("slot"),
                           F.concat(F.array(F.col("c.own")), F.col("path")).alias("path")))


def _self(c):
    return c


def _leaf_digest(c):
    return c["h"]


def grown(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The roots (g, root) of the trees over ``leaves`` (g, idx, n, and ``leaf``:
    a struct whose field ``h`` is the digest), and the levels that were built,
    lowest first. A group of one row is its own root and in no level."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    roots = leaves.where("n = 1").select("g", F.col("leaf.h").alias("root"))
    levels, now = [], leaves.where("n > 1").select("g", "idx", "n", "leaf")
    while most > 1:
        value, child = ("h", _self) if levels else ("leaf", _leaf_digest)
        level = cut(pivot(now, value).withColumn("h", _hashes(child)))
        levels.append(level)
        roots = roots.unionAll(level.where("n = 1").select("g", F.col("h").alias("root")))
        now = level.where("n > 1").select("g", "idx", "n", "h")
        most = -(-most // FANOUT)
    return roots, levels


def paths(leaves: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, subroot, leaf, path) for every leaf: path is the array of (left, right) siblings
    from the leaf's level up to the group's root, then the group's path in
    ``above`` (a, subroot, path), which has one row per group."""
    def rooted(nodes):
        return nodes.where("n = 1").join(above, F.col("g").eqNullSafe(F.col("a"))).drop("a")

    found = rooted(leaves).select("g", "subroot", "leaf", "path")
    down = None
    for i in range(len(levels) - 1, -1, -1):
        parents = rooted(levels[i])
        if down is not None:
            at = down.select(F.col("g").alias("dg"), F.col("idx").alias("di"), "subroot", "path")
            parents = parents.unionByName(levels[i].where("n > 1").join(
                at, (F.col("idx") == F.col("di")) & F.col("g").eqNullSafe(F.col("dg"))).drop("dg", "di"))
        down = _children(parents, _leaf_digest if i == 0 else _self)
    return found if down is None else found.unionAll(down.select("g", "subroot", F.col("slot").alias("leaf"), "path"))


def proof(path: Column) -> Column:
    """All siblings of a path one after another."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, x: digest(x["l"], h, x["r"]))


def manifest(rows: DataFrame, fields: list[str], key: str, group: str,
             where: Column | None = None, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``rows``: key, group, leaf, subroot, root, path (array
    of left and right siblings, leaf level first, through the group's root to the
    root), folded_root and verified (folded_root equals root).

    A leaf hashes ``fields``; groups are ordered NULL first, then by bytes, and so
    are keys within a group. ``folded_root`` is recomputed along the path from the
    leaf of the row as it is found later: with the ``changed`` fields where
    ``where`` is true. Rows of one key are ordered by their leaf; identical rows
    are leaves of their own. An empty table has no rows. Other columns are not
    read, whatever their names.
    """
    values = {f: F.col(f) for f in fields}
    leaf, later = (digest(*map(field, v.values())) for v in (values, {**values, **(changed or {})}))
    if where is not None:
        later = F.when(where, later).otherwise(leaf)
    hashed = cut(rows.select(F.col(group).alias("g"), F.col(key).alias("key"), leaf.alias("h"), later.alias("later")))
    leaves = cut(numbered(hashed, ["key", "h", "later"])
                 .select("g", "idx", "n", F.struct("h", "key", "later").alias("leaf")))
    subroots, levels = grown(leaves)
    # the groups' roots make one more tree: a single group, whose leaves carry the names
    tops = cut(numbered(subroots.select(F.lit(0).alias("g"), F.col("g").alias("name"), F.col("root").alias("h")), ["name"])
               .select("g", "idx", "n", F.struct("h", "name").alias("leaf")))
    roots, top_levels = grown(tops)
    root = (roots.first() or [None, None])[1]
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    alone = roots.select(F.col("g").alias("a"), F.col("root").alias("subroot"), nothing.alias("path"))
    above = cut(paths(tops, top_levels, alone).select(F.col("leaf.name").alias("a"), F.col("leaf.h").alias("subroot"), "path"))
    found = paths(leaves, levels, above)
    return found.select(
        F.col("leaf.key").alias(key), F.col("g").alias(group), F.col("leaf.h").alias("leaf"), "subroot",
        F.lit(root).cast("string").alias("root"), "path", fold(F.col("leaf.later"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

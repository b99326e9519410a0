"""Reachability by doubling: against plain searches, and how many rounds it takes."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lineage as LN
from tessera.operators import reach


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "source string, output string")


def plain_reach(pairs):
    reads = {}
    for source, output in pairs:
        reads.setdefault(output, set()).add(source)
    out = {}
    for start in reads:
        seen, stack = set(), [start]
        while stack:
            for s in reads.get(stack.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    stack.append(s)
        out[start] = seen
    return out


def plain(pairs):
    """(pairs with bases, component of each dataset on a cycle)."""
    to = plain_reach(pairs)
    bases = {(d, n) for d, ns in to.items() for n in ns if n not in to}
    return bases, {d: min(n for n in ns if d in to.get(n, ())) for d, ns in to.items() if d in ns}


def check(spark, pairs):
    bases, components = plain(pairs)
    e = graph(spark, pairs)
    assert {tuple(r) for r in LN.closure_to_base(e).collect()} == bases
    assert {r.dataset: r.component for r in LN.lineage_cycles(e).collect()} == components
    wanted = sorted({o for _, o in pairs})[::3] + ["nowhere"]
    targets = spark.createDataFrame([(d,) for d in wanted], "dataset string")
    assert {tuple(r) for r in LN.closure_to_base(e, targets).collect()} == {p for p in bases if p[0] in wanted}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = 14 + 6 * seed
    pairs = [(f"d{rnd.randrange(n)}", f"d{rnd.randrange(n)}") for _ in range(n + seed * 4)]
    check(spark, pairs + [(f"base{i}", f"d{rnd.randrange(n)}") for i in range(4)])


def test_cycles_in_a_row(spark):
    """Components that read each other: every one is found, whatever its colour."""
    pairs = [("b", "c0_0")]
    for i in range(6):
        pairs += [(f"c{i}_0", f"c{i}_1"), (f"c{i}_1", f"c{i}_2"), (f"c{i}_2", f"c{i}_0"), (f"c{i}_1", f"c{i + 1}_0")]
    check(spark, pairs)


def test_no_edges_and_a_single_loop(spark):
    check(spark, [("a", "a")])
    assert LN.closure_to_base(graph(spark, [])).collect() == []
    assert LN.lineage_cycles(graph(spark, [])).collect() == []


@pytest.fixture()
def rounds(monkeypatch):
    seen = []
    real = reach.cut_lineage
    for module in (reach, LN):
        monkeypatch.setattr(module, "cut_lineage", lambda df: (seen.append(1), real(df))[1])
    return seen


def test_chain_of_a_thousand_takes_logarithmically_many_rounds(spark, rounds):
    chain = [(f"n{i:04}", f"n{i + 1:04}") for i in range(1000)] + [("side", "n0500")]
    got = {tuple(r) for r in LN.closure_to_base(graph(spark, chain)).collect()}
    assert got == {(f"n{i:04}", "n0000") for i in range(1, 1001)} | {(f"n{i:04}", "side") for i in range(500, 1001)}
    assert len(rounds) <= 2 * 10 + 6


def test_cycle_of_three_hundred(spark, rounds):
    cycle = [(f"n{i:03}", f"n{(i + 1) % 300:03}") for i in range(300)] + [("base", "n007"), ("n100", "out")]
    bases, components = plain(cycle)
    e = graph(spark, cycle)
    assert {tuple(r) for r in LN.closure_to_base(e).collect()} == bases
    assert len(rounds) <= 5 * 10 + 10
    assert set(components.values()) == {"n000"}
    assert {r.dataset: r.component for r in LN.lineage_cycles(e).collect()} == components


def test_hot_source(spark):
    """A dataset that most others read stays one row per reader, no more."""
    pairs = [("b", "hot")] + [("hot", f"r{i}") for i in range(3000)] + [(f"r{i}", f"z{i % 7}") for i in range(3000)]
    found = LN.closure_to_base(graph(spark, pairs))
    assert found.count() == 3000 + 7 + 1 and found.select("base").distinct().count() == 1
    tables, ended = reach.walks(graph(spark, pairs).select(F.col("output").alias("dataset"), F.col("source").alias("node")))
    assert ended and len(tables) == 2


@pytest.mark.parametrize("back", [[], [("n1", "n3")]])
def test_datasets_that_nobody_reads_take_no_part_in_the_rounds(spark, monkeypatch, back):
    """Neither in the search for cycles nor in the doubling; they are one step from the rest."""
    pairs = [("b", "n0")] + [(f"n{i}", f"n{i + 1}") for i in range(4)] + [(o, s) for s, o in back]
    pairs += [("n4", f"leaf{i}") for i in range(200)] + [("other", f"leaf{i}") for i in range(100)]
    seen, real = [], reach.walks
    monkeypatch.setattr(reach, "walks", lambda e: (seen.append(e.count()), real(e))[1])
    bases, _ = plain(pairs)
    e = graph(spark, pairs)
    assert {tuple(r) for r in LN.closure_to_base(e).collect()} == bases
    assert {tuple(r) for r in LN.closure_to_base(e, spark.createDataFrame([("leaf7",), ("n3",)], "dataset string")).collect()} == {
        p for p in bases if p[0] in ("leaf7", "n3")}
    LN.lineage_cycles(e).collect()
    assert max(seen) <= 5


def test_edges_with_a_null_end(spark):
    e = graph(spark, [(None, "a"), ("a", "b"), ("b", None)])
    assert {tuple(r) for r in LN.closure_to_base(e).collect()} == {("a", None), ("b", None)}


def test_stored_tables_keep_their_rows(spark):
    from tessera.session import stored
    df = spark.createDataFrame([("a", 1, True), (None, None, False), ("a", 1, True)], "s string, n long, b boolean")
    for rows in (df, df.where("n > 5")):
        kept = stored(rows)
        assert kept.schema == rows.schema and sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
        assert "LogicalRelation" in kept._jdf.queryExecution().optimizedPlan().getClass().getSimpleName()

"""The customer-summary job's mechanisms for large and skewed tables."""

import datetime as dt
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tessera.compare import multiset
from tessera.operators import bloom, exact
from tessera.operators import layers as L
from tessera.operators import scaled as SC
from tessera.operators.joins import Lookup, hot_keys, lookup_all
from tessera.oracle.bank_sql import exact_risk, layers_over_views
from tessera.params import DEFAULT
from tessera.sources.bank import BankViews
from test_skew import hot  # noqa: F401  (fixture)


@contextmanager
def settings(spark, **conf):
    conf = {f"spark.sql.{k.replace('__', '.')}": v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(df):
    return multiset(df.columns, df.collect())


# ------------------------------------------------------------------ hot keys

def fact_with_hot_key(spark, n=30_000):
    """A third of all rows on key 7, a tenth without key, the rest one of 5,000."""
    i = F.col("id")
    k = F.when(i % 3 == 0, 7).when(i % 10 == 1, F.lit(None)).otherwise(1000 + i % 5000)
    return spark.range(n).select("id", k.cast("long").alias("k"))


def dims(spark):
    base = spark.range(0, 6000).withColumnRenamed("id", "dk")
    return [Lookup(base.withColumn(f"a{j}", F.concat(F.lit(f"d{j}_"), "dk")), "dk", [f"a{j}"]) for j in range(4)] + [
        Lookup(spark.createDataFrame([(7, "x"), (7, "y"), (8, "z"), (None, "n")], "dk long, twice string"), "dk", ["twice"])]


def test_sketch_finds_every_value_above_the_share(spark):
    fact = fact_with_hot_key(spark).repartition(16)
    assert hot_keys(fact, ["k"], 0.01) == {"k": [7]}
    assert hot_keys(fact, ["k", "id"], 0.5) == {"k": [], "id": []}
    assert hot_keys(fact.limit(0), ["k"]) == {"k": []}
    words = spark.createDataFrame([("a",)] * 60 + [("b",)] * 30 + [(None,)] * 50 + [(str(i),) for i in range(60)], "w string")
    assert hot_keys(words, ["w"], 0.1) == {"w": ["a", "b"]}
    with pytest.raises(ValueError):
        hot_keys(fact, ["k"], 0.01, tracked=100)


def test_rows_of_a_hot_key_are_dealt_to_all_partitions(spark):
    """Four lookups in a row on one key: no partition has twice the mean, with the
    hot key known; without, one has a third of all rows."""
    fact = fact_with_hot_key(spark)
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__enabled="false", shuffle__partitions="16"):
        def largest(keys):
            out = lookup_all(fact, "k", dims(spark)[:4], hot=keys)
            assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(__key#") == 1
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 30_000
            return max(sizes)
        assert largest(()) > 10_000
        assert largest([7]) < 2 * 30_000 / 16


def test_salted_lookups_give_the_same_rows(spark):
    fact, d = fact_with_hot_key(spark, 3000), dims(spark)
    plain = rows(lookup_all(fact, "k", d))
    assert rows(lookup_all(fact, "k", d, hot=[7, 1005, 4])) == plain
    assert sum(plain.values()) == 4000          # key 7 has two rows in the last dimension
    assert rows(lookup_all(fact, "k", d, hot=[7], salts=1)) == plain


@pytest.mark.parametrize("share", [0.001, 0.02, 0.5])
def test_scaled_summary_equals_sql_on_hot_tables(hot, share):  # noqa: F811
    views, con = hot
    cur = con.execute(f"WITH {layers_over_views(DEFAULT)},\n{exact_risk(DEFAULT)}\n"
                      "SELECT s.* REPLACE (x.risk_score AS risk_score) FROM q_summary s LEFT JOIN exact_risk x USING (customer_id)")
    cols = [c[0] for c in cur.description]
    got = SC.customer_summary(views, DEFAULT, hot_share=share)
    assert rows(got) == multiset(cols, cur.fetchall())


# ------------------------------------------------------------------ Bloom filter

def test_filter_holds_all_its_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("k"))
    f = bloom.build(keys.union(spark.createDataFrame([(None,)], "k string")), "k")
    assert bloom.maybe_in(keys, "k", f).count() == 20_000
    others = spark.range(100_000).select(F.concat(F.lit("x"), "id").alias("k"))
    assert bloom.maybe_in(others, "k", f).count() < 5_000
    assert f.words.count() <= f.n_words == bloom.words_for(20_000)


def test_no_keys_no_rows_and_too_many_keys_no_filter(spark):
    keys = spark.range(1000).select(F.col("id").alias("k"))
    assert bloom.maybe_in(keys, "k", bloom.build(keys.limit(0), "k")).count() == 0
    assert bloom.build(keys, "k", max_words=4) is None
    assert bloom.maybe_in(keys, "k", None).count() == 1000


@pytest.fixture(scope="module")
def views(spark):
    return BankViews.from_testdata(spark, SF001)


def test_flags_shrink_before_they_are_shuffled(spark, views):
    """Nine tenths of the flags are of no transaction: they don't reach the shuffle."""
    every = L.active(views.fraud_flags).select("txn_id", "fraud_flag")
    with settings(spark, adaptive__enabled="false"):
        kept = bloom.maybe_in(every, "txn_id", SC.transaction_filter(views))
        assert kept.count() < 0.3 * every.count()
        df = SC.fraud_flags(views)
        plan = df._jdf.queryExecution().executedPlan().toString()
        # the semi join stands below the only exchange that deals flags
        assert plan.index("Exchange hashpartitioning(txn_id") < plan.index("LeftSemi")
        assert "BroadcastNestedLoop" not in plan


def test_transactions_of_no_account_are_not_shuffled(spark, views):
    """Most transactions of the test tables are of other accounts than the run's."""
    owned = SC.with_owned_transactions(views)
    kept = L.recent_transactions(owned.transaction).count()
    accounts = L.snapshot(views.account, "load_date").select("account_id")
    joined = L.recent_transactions(views.transaction).join(accounts, "account_id", "left_semi").count()
    assert joined <= kept <= joined + 0.1 * L.recent_transactions(views.transaction).count()
    plan = L.recent_transactions(owned.transaction)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" in plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]      # filters still reach the scan
    for size in ({"n_words": 1}, {"max_words": 0}, {}):
        assert rows(L.union_layer(SC.with_owned_transactions(views, **size))) == rows(L.union_layer(views))


@pytest.mark.parametrize("size", [{"n_words": 1}, {"n_words": 64}, {"max_words": 0}, {}])
def test_false_positives_do_no_harm(spark, views, size):
    want = rows(L.nested_layer(views))
    n = L.nested_from_union(L.union_layer(views), views, dims={"fraud": SC.fraud_flags(views, **size)})
    got = n.withColumn("region", L.unknown_if_null("region_raw")).select(*L.NESTED_COLUMNS)
    assert rows(got) == want


# ------------------------------------------------------------------ DISTINCT by digest

def wide_rows():
    rnd = random.Random(3)
    pick = lambda *v: rnd.choice(v)
    return [(pick(1, 2, None), pick("x", "", None), pick("x", "", None), pick(dt.date(2001, 1, 1), None), pick(1, 2, None))
            for _ in range(3000)]


def test_distinct_by_digest_equals_distinct(spark):
    df = spark.createDataFrame(wide_rows(), "id int, a string, b string, d date, m int")
    assert rows(SC.distinct_by_digest(df, ["id"])) == rows(df.distinct().select("id"))
    assert rows(SC.distinct_by_digest(df, ["d", "m"])) == rows(df.distinct().select("d", "m"))


def test_colliding_digests_fail_the_job(spark):
    df = spark.createDataFrame(wide_rows(), "id int, a string, b string, d date, m int")
    with pytest.raises(Exception, match="share a digest"):
        SC.distinct_by_digest(df, ["id"], bits=2).collect()


def shuffled_bytes(df):
    """Bytes that the exchanges write (the first time: then they are reused)."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    total, stack = 0, [plan]
    while stack:
        node = stack.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("dataSize").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_wide_columns_stay_behind(spark, views):
    """Bytes that the exchanges write: digests instead of long texts, and less on the real union too."""
    i = F.col("id")
    df = spark.range(20_000).select((i % 5000).alias("k"), F.repeat(F.concat(F.lit("text "), i % 7), 40).alias("a"), (i % 2).alias("b"))
    with settings(spark, adaptive__enabled="false"):
        plain, digest = df.distinct().select("k"), SC.distinct_by_digest(df, ["k"])
        assert shuffled_bytes(digest) < 0.3 * shuffled_bytes(plain)
        assert rows(plain) == rows(digest)
        assert shuffled_bytes(SC.union_digest(views)) < shuffled_bytes(L.union_layer(views))


def test_union_digest_equals_the_union(views):
    assert rows(SC.union_digest(views)) == rows(L.union_layer(views).select(*L.USED))


# ------------------------------------------------------------------ averages

def test_average_is_the_same_to_the_bit_in_any_order(spark):
    rnd = random.Random(6)
    values = [(i % 3, rnd.uniform(-1, 1) * 10 ** rnd.randrange(-12, 9)) for i in range(4000)] + [(0, None), (5, None)]
    df = spark.createDataFrame(values, "k int, v double")
    seen, plain = set(), set()
    for n in range(1, 11):
        shuffled = df.orderBy(F.xxhash64("v", F.lit(n))).repartition(n)
        got = shuffled.groupBy("k").agg(exact.average("v").alias("a"), F.avg("v").alias("p")).orderBy("k").collect()
        seen.add(tuple((r.k, r.a.hex() if r.a is not None else None) for r in got))
        plain.add(tuple(r.p for r in got))
    assert len(seen) == 1 and len(plain) > 1      # the plain average does change
    from fractions import Fraction
    for k in range(3):
        own = [Fraction(v) for g, v in values if g == k and v is not None]
        want = float(sum(own) / len(own))
        assert abs(float.fromhex(dict(next(iter(seen)))[k]) - want) <= 4e-16 * abs(want)


def test_average_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, nan), (1, 1.0), (2, inf), (2, 1.0), (3, inf), (3, -inf), (4, -0.5), (4, 1.5)], "k int, v double")
    got = {r.k: r.a for r in df.groupBy("k").agg(exact.average("v").alias("a")).collect()}
    assert got[1] != got[1] and got[2] == inf and got[3] != got[3] and got[4] == 0.5
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(1e10,)], "v double").agg(exact.average("v")).collect()
    assert spark.createDataFrame([], "v double").agg(exact.average("v").alias("a")).first().a is None


# ------------------------------------------------------------------ distinct counts

def test_bitmaps_of_two_levels_equal_count_distinct(spark, views):
    n = L.nested_layer(views)
    keys = list(L.SUMMARY_KEYS)
    state = exact.distinct_state(n, keys + ["fraud_flag", "account_type"], "account_id")
    got = exact.count_state(state, keys, "total_accounts")
    assert rows(got) == rows(n.groupBy(*keys).agg(F.count_distinct("account_id").alias("total_accounts")))


def test_states_of_parts_merge(spark):
    rnd = random.Random(2)
    values = [(rnd.choice("abc"), rnd.choice([None, rnd.randrange(-70_000, 70_000), rnd.randrange(5)])) for _ in range(3000)] + [("d", None)]
    df = spark.createDataFrame(values, "k string, v long")
    parts = [exact.distinct_state(df.where(F.pmod(F.xxhash64("v", "k"), F.lit(3)) == i), ["k"], "v") for i in range(3)]
    merged = exact.merge_distinct(parts[0].union(parts[1]), ["k"]).union(parts[2])
    want = {k: len({v for g, v in values if g == k and v is not None}) for k in "abcd"}
    assert {r.k: r.n for r in exact.count_state(merged, ["k"], "n").collect()} == want
    assert {r.k: r.n for r in exact.count_state(exact.distinct_state(df, ["k"], "v"), ["k"], "n").collect()} == want

"""Hot keys: one customer owns a third of all accounts and transactions, one
merchant a third of all transactions, many rows without merchant or
transactions. With AQE skew thresholds lowered so splitting happens, every
layer still equals the plain SQL."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import bank_fixture as BF
from tessera.compare import multiset
from tessera.operators import layers as L
from tessera.oracle.bank_sql import layers_over_views
from tessera.params import DEFAULT


def hot_rows(seed: int = 7):
    rnd = random.Random(seed)
    R = {k: [] for k in BF.SCHEMAS}
    n_cust, n_acct, n_txn = 60, 300, 3000
    for c in range(1, n_cust + 1):
        R["customer"].append((c, f"c{c}", rnd.choice(["GOLD", "SILVER", None])))
        R["segmentation_rules"].append((c, rnd.choice(["GOLD", "SILVER"])))
        R["customer_region"].append((c, rnd.choice(["WEST", "UNKNOWN", None]), rnd.choice("YN")))
        R["credit_bureau"].append((c, 600 + c, rnd.choice([BF.F_, BF.S_])))
        if c % 2 == 0:
            R["archived_customer"].append((c, f"c{c}", None))
    for a in range(1, n_acct + 1):
        cust = 1 if a % 3 == 0 else rnd.randint(2, n_cust)          # hot customer 1
        R["account"].append((a, rnd.choice(["CHECKING", "LOAN"]), "ACTIVE", cust, rnd.choice([BF.F_, BF.F_, BF.S_])))
        R["archived_account"].append((10_000 + a, "SAVINGS", "ACTIVE", 2 * rnd.randint(1, n_cust // 2)))
        if a % 4:
            R["product_dim"].append((a, "p", "DEPOSIT"))
        R["branch_dim"].append((a, "b", "NYC"))
    for t in range(n_txn):
        acct = rnd.randint(1, n_acct)
        merch = 9001 if t % 3 == 0 else (None if t % 7 == 0 else rnd.randint(9002, 9010))   # hot merchant
        row = (acct, f"t{t}", Decimal(rnd.randint(1, 10000)) / 100, rnd.choice(["DEBIT", "CREDIT"]),
               dt.date(2001, 7, 1) + dt.timedelta(days=rnd.randint(0, 30)), merch)
        R["transaction"].append(row + (BF.F_,))
        R["archived_transaction"].append((10_000 + acct,) + row[1:4] + (dt.date(1999, 1, 1),) + row[5:])
        if t % 5 == 0:
            R["fraud_flags"].append((f"t{t}", rnd.choice("YN"), "Y"))
    R["merchant_dim"] = [(m, f"m{m}") for m in range(9001, 9011)]
    R["sanctions_list"] = [(c, "Y") for c in range(1, n_cust + 1, 5)]
    R["risk_assessment"] = [(c, rnd.random(), BF.R_) for c in range(1, n_cust + 1)]
    return R


@pytest.fixture(scope="module")
def hot(spark):
    rows = hot_rows()
    saved_rows = BF.ROWS
    BF.ROWS = rows
    try:
        views, con = BF.spark_views(spark), BF.duck()
    finally:
        BF.ROWS = saved_rows
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield views, con
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("fn,rel", [(L.union_layer, "q_union"), (L.nested_layer, "q_nested"),
                                    (L.customer_summary, "q_summary")])
def test_hot_keys_exact(hot, fn, rel):
    views, con = hot
    df = fn(views, DEFAULT)
    if rel == "q_summary":
        df = df.withColumn("risk_score", F.round("risk_score", 6))
    cur = con.execute(f"WITH {layers_over_views(DEFAULT)}\nSELECT * FROM {rel}")
    cols = [c[0] for c in cur.description]
    assert multiset(df.columns, df.collect()) == multiset(cols, cur.fetchall())


def test_rows_without_a_key_are_spread(spark):
    """The exchange of a lookup carries the salt: NULL keys reach all partitions, in even parts."""
    from tessera.operators.joins import lookup_join, spread_key
    fact = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("k"))
    dim = spark.createDataFrame([(i, f"d{i}") for i in range(7)] + [(None, "none")], "dk long, name string")
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lookup_join(fact, dim, "k", "dk", ["name"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(__key" in plan
        rows = out.withColumn("p", F.spark_partition_id()).where("k IS NULL").groupBy("p").count().collect()
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert len(rows) == parts and max(r["count"] for r in rows) < 2 * 18_000 / parts
        got = out.groupBy("name").count().collect()
        assert {r["name"]: r["count"] for r in got}[None] == 18_000 and len(got) == 8
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert spread_key(fact, "k") is not None

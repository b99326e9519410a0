"""The four layers of the customer-summary job (Q1-Q4).

Semantics follow the original SQL, including its fan-out on duplicate
dimension keys (T6), NULL region kept apart from a literal 'UNKNOWN' until the
last step (T8), and the 9-key grain of the result (T5). Where the original
text cannot run (T1: an 11-column and a 12-column branch under UNION), the
live branch carries ``merchant_id`` as its 12th column.

Plan shape (see README "Scale"):

* ``union_layer`` de-duplicates once, over all 12 columns (T9), without the
  redundant inner DISTINCT of the live branch.
* ``nested_layer`` joins all eight dimensions to the transactions and groups
  once. Steps on one key share a partitioning of the fact side, and rows
  without a key are spread (see ``joins``): the union is dealt by account for its
  DISTINCT and the account lookups, and the customer lookups come last, as both
  groupings can be done where a customer's rows are.
* ``customer_summary`` aggregates before the risk lookup: the risk table is
  unique per customer and ``risk_score`` depends on ``customer_id`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import KEY, Lookup, lookup_all, lookup_join, spread_key
from tessera.params import DEFAULT, RunParams
from tessera.sources.bank import BankViews

LAYER_COLUMNS = ("customer_id", "name", "account_id", "account_type", "status", "txn_id",
                 "amount", "txn_type", "txn_date", "segment", "load_date", "merchant_id")

NESTED_KEYS = ("customer_id", "account_id", "account_type", "segment_name", "region",
               "product_name", "product_category", "branch_name", "branch_region",
               "merchant_category", "fraud_flag", "external_credit_score", "sanctions_hit")

SUMMARY_KEYS = ("customer_id", "segment_name", "region", "product_name", "product_category",
                "branch_name", "branch_region", "merchant_category")

NESTED_COLUMNS = ("customer_id", "account_id", "account_type", "total_debit", "total_credit",
                  "txn_count", "segment_name", "region", "last_txn_date", "product_name",
                  "product_category", "branch_name", "branch_region", "merchant_category",
                  "fraud_flag", "external_credit_score", "sanctions_hit")

SUMMARY_COLUMNS = ("customer_id", "total_accounts", "total_debit", "total_credit",
                   "last_txn_date", "segment_name", "region", "product_name",
                   "product_category", "branch_name", "branch_region", "merchant_category",
                   "risk_score", "credit_score", "fraud_txn_count", "sanctions_match")

MONEY = "decimal(18,2)"


# ---------------------------------------------------------------- filters

def snapshot(df: DataFrame, date_col: str, p: RunParams = DEFAULT) -> DataFrame:
    """Rows of the run date only."""
    return df.where(F.col(date_col) == F.lit(p.as_of))


def recent_transactions(txn: DataFrame, p: RunParams = DEFAULT) -> DataFrame:
    """Today's load, shipped within the trailing window."""
    return snapshot(txn, "load_date", p).where(F.col("txn_date") >= F.lit(p.window_start))


def unknown_if_null(c: str) -> Column:
    """P4."""
    return F.coalesce(F.col(c), F.lit("UNKNOWN"))


def active(df: DataFrame) -> DataFrame:
    """P7."""
    return df.where(F.col("active_flag") == "Y")


def sanctions_decoded(sanctions: DataFrame) -> DataFrame:
    """1 for a blacklisted customer, 0 otherwise (NULL flag included)."""
    return sanctions.select(
        "customer_id",
        F.when(F.col("blacklisted") == "Y", 1).otherwise(0).alias("sanctions_hit"))


def risk_by_customer(risk: DataFrame, p: RunParams = DEFAULT) -> DataFrame:
    """Average score of the risk snapshot per customer."""
    return (risk.where(F.col("as_of_date") == F.lit(p.risk_as_of))
            .groupBy("customer_id").agg(F.avg("score").alias("risk_score")))


# ---------------------------------------------------------------- Q1, Q2

def _live_branch(v: BankViews, p: RunParams) -> DataFrame:
    accounts = snapshot(v.account, "load_date", p).select(
        "customer_id", "account_id", "account_type", "status")
    txns = recent_transactions(v.transaction, p).select(
        "account_id", "txn_id", "amount", "txn_type", "txn_date", "merchant_id")
    owned = v.customer.join(accounts, "customer_id", "left")        # J1 + J2 residual
    # J3; customers without an account have a NULL key
    return (lookup_join(owned, txns, "account_id", "account_id", [c for c in txns.columns if c != "account_id"])
            .select("customer_id", "name", "account_id", "account_type", "status",
                    "txn_id", "amount", "txn_type", "txn_date",
                    unknown_if_null("segment").alias("segment"),
                    F.lit(p.as_of).alias("load_date"), "merchant_id"))


def base_layer(v: BankViews, p: RunParams = DEFAULT) -> DataFrame:
    """Q1: customers, today's accounts and recent transactions, de-duplicated."""
    return _live_branch(v, p).distinct()


def archive_branch(v: BankViews, p: RunParams = DEFAULT) -> DataFrame:
    """Archived customers with their accounts (inner) and the
    transactions after ``archive_after`` (left, residual in ON)."""
    txns = v.archived_transaction.where(F.col("txn_date") > F.lit(p.archive_after)).select(
        "account_id", "txn_id", "amount", "txn_type", "txn_date", "merchant_id")
    accounts = v.archived_account.select("customer_id", "account_id", "account_type", "status")
    return (v.archived_customer.join(accounts, "customer_id", "inner")
            .join(txns, "account_id", "left")
            .select("customer_id", "name", "account_id", "account_type", "status",
                    "txn_id", "amount", "txn_type", "txn_date",
                    unknown_if_null("segment").alias("segment"),
                    F.lit(p.as_of).alias("load_date"), "merchant_id"))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """SQL UNION - by position, equal column count, then DISTINCT."""
    if len(a.columns) != len(b.columns):
        raise ValueError(f"UNION of {len(a.columns)} and {len(b.columns)} columns")
    return a.union(b).distinct()


def union_layer(v: BankViews, p: RunParams = DEFAULT) -> DataFrame:
    """Q2: live and archive branches; one DISTINCT covers both (the live
    branch's own DISTINCT would only add a shuffle)."""
    return union_distinct(_live_branch(v, p), archive_branch(v, p))


def union_by_account(v: BankViews, p: RunParams = DEFAULT) -> DataFrame:
    """Q2 for the account lookups, with their key: its rows are dealt by account
    before the DISTINCT, so one exchange does for both."""
    both = _live_branch(v, p).union(archive_branch(v, p))
    return both.withColumn(KEY, spread_key(both, "account_id")).repartition(KEY).distinct()


# ---------------------------------------------------------------- Q3

def _dims(v: BankViews, p: RunParams) -> dict[str, DataFrame]:
    return {
        "seg": v.segmentation_rules.select("customer_id", "segment_name").distinct(),   # J6
        "region": active(v.customer_region).select("cust_id", "region"),                 # J7
        "product": v.product_dim.select("account_id", "product_name", "product_category"),
        "branch": v.branch_dim.select("account_id", "branch_name", "branch_region"),
        "merchant": v.merchant_dim.select("merchant_id", "merchant_category"),
        "fraud": active(v.fraud_flags).select("txn_id", "fraud_flag").distinct(),        # J11
        "credit": snapshot(v.credit_bureau, "report_date", p).select(
            "customer_id", "external_credit_score"),                                     # J12
        "sanctions": sanctions_decoded(v.sanctions_list),                                # J13
    }


def _amount_if(txn_type: str) -> Column:
    """A3: CASE WHEN txn_type = .. THEN amount ELSE 0 END."""
    return F.when(F.col("txn_type") == txn_type, F.col("amount")).otherwise(F.lit(0))


# columns of the union that the later layers use
USED = ("customer_id", "account_id", "account_type", "txn_id", "amount", "txn_type", "txn_date", "merchant_id")


def nested_from_union(u: DataFrame, v: BankViews, p: RunParams = DEFAULT, hot: dict[str, list] | None = None,
                      dims: dict[str, DataFrame] | None = None) -> DataFrame:
    """Q3 with NULL regions kept. ``hot``: values by key column that many rows
    share (``joins.hot_keys``); ``dims``: dimensions that replace the usual ones.
    Without hot customers the rows keep the customers' key, for the final grouping."""
    d, hot = {**_dims(v, p), **(dims or {})}, hot or {}
    t = lookup_all(u.select(*USED, *(c for c in u.columns if c == KEY)), "account_id", [    # J8, J9
        Lookup(d["product"], "account_id", ["product_name", "product_category"]),
        Lookup(d["branch"], "account_id", ["branch_name", "branch_region"])], hot=hot.get("account_id", ())).drop(KEY)
    t = lookup_join(t, d["merchant"], "merchant_id", "merchant_id", ["merchant_category"],   # J10
                    hot=hot.get("merchant_id", ()))
    t = lookup_join(t, d["fraud"], "txn_id", "txn_id", ["fraud_flag"], hot=hot.get("txn_id", ()))   # J11
    if not hot.get("customer_id"):
        # rows of one group have one key, also those without a customer
        t = t.withColumn(KEY, spread_key(t, "customer_id", by=[k for k in SUMMARY_KEYS if k in t.columns]))
    t = lookup_all(t, "customer_id", [                                               # J6, J7, J12, J13
        Lookup(d["seg"], "customer_id", ["segment_name"]),
        Lookup(d["region"], "cust_id", ["region"]),
        Lookup(d["credit"], "customer_id", ["external_credit_score"]),
        Lookup(d["sanctions"], "customer_id", ["sanctions_hit"])], hot=hot.get("customer_id", ()))
    key = [c for c in t.columns if c == KEY]
    out = (t.groupBy(*key, *NESTED_KEYS)                                             # A10
           .agg(F.sum(_amount_if("DEBIT")).alias("total_debit"),
                F.sum(_amount_if("CREDIT")).alias("total_credit"),
                F.count_distinct("txn_id").alias("txn_count"),
                F.max("txn_date").alias("last_txn_date")))
    return out.select(
        "customer_id", "account_id", "account_type",
        F.col("total_debit").cast("decimal(28,2)").alias("total_debit"),
        F.col("total_credit").cast("decimal(28,2)").alias("total_credit"),
        "txn_count", "segment_name",
        F.col("region").alias("region_raw"),
        "last_txn_date", "product_name", "product_category", "branch_name", "branch_region",
        "merchant_category", "fraud_flag", "external_credit_score", "sanctions_hit", *key)


def account_profile(v: BankViews, p: RunParams = DEFAULT) -> DataFrame:
    """J8 and J9 for today's accounts: product and branch of each. Over tables in
    buckets of account_id (``sinks.save_layout``) nothing is shuffled, and only
    the partition of the run's date is read."""
    return (snapshot(v.account, "load_date", p).select("account_id", "customer_id", "account_type")
            .join(v.product_dim.select("account_id", "product_name", "product_category"), "account_id", "left")
            .join(v.branch_dim.select("account_id", "branch_name", "branch_region"), "account_id", "left"))


def nested_layer(v: BankViews, p: RunParams = DEFAULT) -> DataFrame:
    """Q3 as published: ``region`` is coalesced to 'UNKNOWN' (A12)."""
    n = nested_from_union(union_by_account(v, p), v, p)
    return n.select(*(unknown_if_null("region_raw").alias("region") if c == "region" else c
                      for c in NESTED_COLUMNS))


# ---------------------------------------------------------------- Q4

def summary_from_nested(n: DataFrame, v: BankViews, p: RunParams = DEFAULT, risk: DataFrame | None = None) -> DataFrame:
    """``n`` has ``region_raw``; the final grouping merges NULL and 'UNKNOWN'. Where
    ``n`` has the customers' key, the grouping and the lookup are done where it is."""
    n = n.withColumn("region", unknown_if_null("region_raw"))
    agg = (n.groupBy(*(c for c in n.columns if c == KEY), *SUMMARY_KEYS)                                                  # A11
           .agg(F.count_distinct("account_id").alias("total_accounts"),              # A4
                F.sum("total_debit").cast(MONEY).alias("total_debit"),               # A7
                F.sum("total_credit").cast(MONEY).alias("total_credit"),
                F.max("last_txn_date").alias("last_txn_date"),                       # A5
                F.max("external_credit_score").alias("credit_score"),                # A6
                F.sum(F.when(F.col("fraud_flag") == "Y", 1).otherwise(0))
                .cast("bigint").alias("fraud_txn_count"),                            # A8
                F.max("sanctions_hit").alias("sanctions_match")))
    out = lookup_join(agg, risk_by_customer(v.risk_assessment, p) if risk is None else risk,
                      "customer_id", "customer_id", ["risk_score"])                   # J14
    return out.select(*SUMMARY_COLUMNS)


def customer_summary(v: BankViews, p: RunParams = DEFAULT) -> DataFrame:
    """Q4, the table written to ``final_db.customer_summary``."""
    return summary_from_nested(nested_from_union(union_by_account(v, p), v, p), v, p)


def save_summary(df: DataFrame, table: str = "final_db.customer_summary") -> None:
    """S3: overwrite the target managed table."""
    df.write.mode("overwrite").saveAsTable(table)

"""The fifteen bank tables of the customer-summary job, as views over the
driver's TPC-H-like tables (FIXTURES.md section 3).

Each view is a projection (sometimes a join) of one test table, so its size
grows with the test data. On a real warehouse these would be
``spark.table("staging_db.customer")`` etc.; ``BankViews.from_catalog`` reads
them that way.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.params import DEFAULT, RunParams
from tessera.sources.tables import Tables

# database names of the original script
STAGING_DB = "staging_db"
CORE_DB = "core_db"
FINAL_DB = "final_db"


def txn_key(prefix: str = "l_") -> Column:
    """Unique transaction id. (orderkey, linenumber) alone repeats in the
    test data, the four-part key does not."""
    return F.concat_ws("-", *(F.col(prefix + c).cast("string")
                              for c in ("orderkey", "linenumber", "partkey", "suppkey")))


@dataclass
class BankViews:
    customer: DataFrame
    account: DataFrame
    transaction: DataFrame
    archived_customer: DataFrame
    archived_account: DataFrame
    archived_transaction: DataFrame
    segmentation_rules: DataFrame
    customer_region: DataFrame
    product_dim: DataFrame
    branch_dim: DataFrame
    merchant_dim: DataFrame
    fraud_flags: DataFrame
    credit_bureau: DataFrame
    sanctions_list: DataFrame
    risk_assessment: DataFrame

    @classmethod
    def from_catalog(cls, spark: SparkSession, staging_db: str = STAGING_DB,
                     core_db: str = CORE_DB) -> "BankViews":
        t = spark.table
        return cls(
            customer=t(f"{staging_db}.customer"), account=t(f"{staging_db}.account"),
            transaction=t(f"{staging_db}.transaction"),
            archived_customer=t(f"{core_db}.archived_customer"),
            archived_account=t(f"{core_db}.archived_account"),
            archived_transaction=t(f"{core_db}.archived_transaction"),
            segmentation_rules=t(f"{core_db}.segmentation_rules"),
            customer_region=t(f"{core_db}.customer_region"),
            product_dim=t(f"{core_db}.product_dim"), branch_dim=t(f"{core_db}.branch_dim"),
            merchant_dim=t(f"{core_db}.merchant_dim"), fraud_flags=t(f"{core_db}.fraud_flags"),
            credit_bureau=t(f"{core_db}.credit_bureau"),
            sanctions_list=t(f"{core_db}.sanctions_list"),
            risk_assessment=t(f"{core_db}.risk_assessment"))

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str,
                      p: RunParams = DEFAULT) -> "BankViews":
        return _TestViews(Tables(spark, sf_dir), p)


def _snapshot_date(is_stale: Column, p: RunParams) -> Column:
    return F.when(is_stale, F.lit(p.stale)).otherwise(F.lit(p.as_of))


def _missing(key: str, where: Column) -> Column:
    """The key, negated where nothing shall match it."""
    return F.when(where, -F.col(key)).otherwise(F.col(key))


class _TestViews:
    """The views over the test tables, each built when it is first asked for."""

    def __init__(self, t: Tables, p: RunParams):
        self._t, self._p = t, p

    @cached_property
    def customer(self) -> DataFrame:
        return self._t.customer.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("segment"))

    def _accounts(self, when: Column, *more: Column) -> DataFrame:
        return self._t.orders.where(when).select(
            F.col("o_orderkey").alias("account_id"), F.col("o_orderpriority").alias("account_type"),
            F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer_id"), *more)

    @cached_property
    def account(self) -> DataFrame:
        return self._accounts(F.col("o_orderdate").cast("date") >= F.lit(self._p.live_from),
                              _snapshot_date(F.col("o_orderkey") % 10 == 0, self._p).alias("load_date"))

    @cached_property
    def archived_account(self) -> DataFrame:
        return self._accounts(F.col("o_orderdate").cast("date") < F.lit(self._p.live_from))

    def _transactions(self, *more: Column) -> DataFrame:
        return self._t.lineitem.select(
            F.col("l_orderkey").alias("account_id"), txn_key().alias("txn_id"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
            F.when(F.col("l_returnflag") == "R", "DEBIT").otherwise("CREDIT").alias("txn_type"),
            F.col("l_shipdate").cast("date").alias("txn_date"), F.col("l_suppkey").alias("merchant_id"), *more)

    @cached_property
    def transaction(self) -> DataFrame:
        return self._transactions(_snapshot_date(F.col("l_linenumber") == 7, self._p).alias("load_date"))

    @cached_property
    def archived_transaction(self) -> DataFrame:
        return self._transactions()

    # a miss is a row under a key that nobody has: the negative of its own

    @cached_property
    def archived_customer(self) -> DataFrame:
        return self.customer.withColumn("customer_id", _missing("customer_id", F.col("customer_id") % 2 != 0))

    @cached_property
    def segmentation_rules(self) -> DataFrame:
        return (self._t.orders.join(self._t.customer, F.col("o_custkey") == F.col("c_custkey"))
                .select(_missing("o_custkey", F.col("o_custkey") % 5 == 0).alias("customer_id"),
                        F.col("c_mktsegment").alias("segment_name")))

    @cached_property
    def _customer_geo(self) -> DataFrame:
        t = self._t
        geo = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
               .select("n_nationkey", "n_name", "r_name"))
        return t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def customer_region(self) -> DataFrame:
        return self._customer_geo.select(
            F.col("c_custkey").alias("cust_id"), F.col("r_name").alias("region"),
            F.when(F.col("c_acctbal") > 0, "Y").otherwise("N").alias("active_flag"))

    @cached_property
    def product_dim(self) -> DataFrame:
        return self._t.orders.select(
            _missing("o_orderkey", F.col("o_orderkey") % 7 == 0).alias("account_id"),
            F.col("o_orderpriority").alias("product_name"), F.col("o_orderstatus").alias("product_category"))

    @cached_property
    def branch_dim(self) -> DataFrame:
        return (self._t.orders.join(self._customer_geo, F.col("o_custkey") == F.col("c_custkey"))
                .select(F.col("o_orderkey").alias("account_id"), F.col("n_name").alias("branch_name"),
                        F.col("r_name").alias("branch_region")))

    @cached_property
    def merchant_dim(self) -> DataFrame:
        return (self._t.supplier.join(self._t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
                .select(F.col("s_suppkey").alias("merchant_id"), F.col("n_name").alias("merchant_category")))

    @cached_property
    def fraud_flags(self) -> DataFrame:
        return self._t.lineitem.select(
            F.when(F.col("l_discount") >= 0.08, txn_key()).otherwise(F.concat(F.lit("none-"), txn_key())).alias("txn_id"),
            F.when(F.col("l_discount") >= 0.09, "Y").otherwise("N").alias("fraud_flag"),
            F.when(F.col("l_linestatus") == "O", "Y").otherwise("N").alias("active_flag"))

    @cached_property
    def credit_bureau(self) -> DataFrame:
        return self._t.customer.select(
            F.col("c_custkey").alias("customer_id"),
            F.floor("c_acctbal").cast("int").alias("external_credit_score"),
            _snapshot_date(F.col("c_custkey") % 4 == 0, self._p).alias("report_date"))

    @cached_property
    def sanctions_list(self) -> DataFrame:
        return self._t.customer.select(
            _missing("c_custkey", F.col("c_custkey") % 11 != 0).alias("customer_id"),
            F.when(F.col("c_custkey") % 2 == 0, "Y").otherwise("N").alias("blacklisted"))

    @cached_property
    def risk_assessment(self) -> DataFrame:
        return self._t.events.select(
            F.col("user_id").alias("customer_id"), F.col("value").alias("score"),
            F.col("ts").cast("date").alias("as_of_date"))

"""The customer-summary job for large and skewed tables: the same four layers, by
other mechanisms where the plain ones depend on the data being kind.

* ``union_digest`` (U1): the four columns that no later layer uses go through the
  de-duplication as a 128-bit digest, not as themselves.
* hot customers, accounts and merchants (J6-J13) are found in the union by a
  sketch and salted, once for all lookups on a key.
* fraud flags (J11) meet a Bloom filter of the run's transactions before their
  DISTINCT and its shuffle, transactions (J3, J5) one of the accounts they can
  belong to before theirs.
* the risk average (A9) does not depend on the order of its rows.

The results are those of ``layers``. The union is written to the checkpoint folder,
since it is read by the sketch and by the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import bloom
from tessera.operators.exact import average
from tessera.operators.joins import hot_keys
from tessera.operators.layers import (LAYER_COLUMNS, USED, _live_branch, active, archive_branch, nested_from_union,
                                      recent_transactions, snapshot, summary_from_nested)
from tessera.params import DEFAULT, RunParams
from tessera.session import cut_lineage
from tessera.sources.bank import BankViews

#: Rows of the union from which on a key counts as hot.
HOT_SHARE = 0.005


def digest(columns: list[str], seed: int) -> Column:
    """64 bits of the columns; NULLs count (a plain hash passes over them)."""
    nulls = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns))
    return F.xxhash64(F.lit(seed), nulls, *(F.col(c) for c in columns))


def distinct_by_digest(rows: DataFrame, keep: list[str], bits: int = 64) -> DataFrame:
    """``rows.distinct()`` reduced to the columns ``keep`` (repeats stay): other
    columns are compared by two digests of ``bits`` bits and never shuffled. A third
    one tells if two different rows were taken for one; the job then fails."""
    rest = [c for c in rows.columns if c not in keep]
    a, b = (F.shiftrightunsigned(digest(rest, seed), 64 - bits) for seed in (1, 2))
    named = rows.select(*keep, a.alias("__a"), b.alias("__b"), digest(rest, 3).alias("__c"))
    one = named.groupBy(*keep, "__a", "__b").agg(F.min("__c").alias("__low"), F.max("__c").alias("__high"))
    clash = F.when(F.col("__low") != F.col("__high"), F.raise_error(F.lit("two rows share a digest")).cast("boolean"))
    return one.where(F.coalesce(clash, F.lit(True))).select(*keep)


class _Replaced:
    """Views with some tables replaced."""

    def __init__(self, views: BankViews, **tables: DataFrame):
        self._views = views
        self.__dict__.update(tables)

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(self._views, name)


def with_owned_transactions(v: BankViews, p: RunParams = DEFAULT, **size) -> _Replaced:
    """Transactions whose account may be one of the run's. The others join
    with nothing: both joins keep accounts, not transactions."""
    live = bloom.build(snapshot(v.account, "load_date", p).select("account_id"), "account_id", **size)
    archived = bloom.build(v.archived_account.select("account_id"), "account_id", **size)
    return _Replaced(v, transaction=bloom.maybe_in(v.transaction, "account_id", live),
                     archived_transaction=bloom.maybe_in(v.archived_transaction, "account_id", archived))


def union_digest(v: BankViews, p: RunParams = DEFAULT) -> DataFrame:
    """Q2 as the later layers need it: the columns ``USED`` of its distinct rows."""
    v = with_owned_transactions(v, p)
    live, archive = (b.select(*LAYER_COLUMNS) for b in (_live_branch(v, p), archive_branch(v, p)))
    return distinct_by_digest(live.union(archive), list(USED))


def transaction_filter(v: BankViews, p: RunParams = DEFAULT, **size) -> bloom.Filter | None:
    """Bloom filter of the transactions that can be in the union: both sources,
    after the filters that reach their scans, one column each."""
    archived = v.archived_transaction.where(F.col("txn_date") > F.lit(p.archive_after))
    return bloom.build(recent_transactions(v.transaction, p).select("txn_id").union(archived.select("txn_id")), "txn_id", **size)


def fraud_flags(v: BankViews, p: RunParams = DEFAULT, **size) -> DataFrame:
    """J11's dimension: the distinct active flags of transactions of this run."""
    flags = active(v.fraud_flags).select("txn_id", "fraud_flag")
    return bloom.maybe_in(flags, "txn_id", transaction_filter(v, p, **size)).distinct()


def risk_by_customer(risk: DataFrame, p: RunParams = DEFAULT) -> DataFrame:
    """J14/A9 with the order-free average."""
    return (risk.where(F.col("as_of_date") == F.lit(p.risk_as_of))
            .groupBy("customer_id").agg(average("score").alias("risk_score")))


def customer_summary(v: BankViews, p: RunParams = DEFAULT, hot_share: float = HOT_SHARE) -> DataFrame:
    """Q4."""
    u = cut_lineage(union_digest(v, p))
    hot = hot_keys(u, ["customer_id", "account_id", "merchant_id"], hot_share)
    n = nested_from_union(u, v, p, hot=hot, dims={"fraud": fraud_flags(v, p)})
    return summary_from_nested(n, v, p, risk=risk_by_customer(v.risk_assessment, p))

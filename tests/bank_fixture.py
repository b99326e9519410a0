"""Hand-made bank tables that hit every path of the customer-summary job:
fan-out on duplicate dimension keys (T6), a customer without accounts (T10),
NULL region next to a literal 'UNKNOWN' (T8), inactive and duplicate fraud
flags (T7), stale snapshots (P8), a transaction without merchant, archived
accounts with and without transactions, and risk scores on two dates."""

import datetime as dt
from decimal import Decimal as Dm

from pyspark.sql import types as T

F_ = dt.date(2001, 8, 1)     # fresh = as_of
S_ = dt.date(2001, 7, 31)    # stale
R_ = dt.date(2024, 1, 3)     # risk snapshot
L, S, D, I, DEC, DBL = "bigint", "string", "date", "int", "decimal(18,2)", "double"

SCHEMAS = {
    "customer": [("customer_id", L), ("name", S), ("segment", S)],
    "account": [("account_id", L), ("account_type", S), ("status", S), ("customer_id", L), ("load_date", D)],
    "transaction": [("account_id", L), ("txn_id", S), ("amount", DEC), ("txn_type", S), ("txn_date", D),
                    ("merchant_id", L), ("load_date", D)],
    "archived_customer": [("customer_id", L), ("name", S), ("segment", S)],
    "archived_account": [("account_id", L), ("account_type", S), ("status", S), ("customer_id", L)],
    "archived_transaction": [("account_id", L), ("txn_id", S), ("amount", DEC), ("txn_type", S),
                             ("txn_date", D), ("merchant_id", L)],
    "segmentation_rules": [("customer_id", L), ("segment_name", S)],
    "customer_region": [("cust_id", L), ("region", S), ("active_flag", S)],
    "product_dim": [("account_id", L), ("product_name", S), ("product_category", S)],
    "branch_dim": [("account_id", L), ("branch_name", S), ("branch_region", S)],
    "merchant_dim": [("merchant_id", L), ("merchant_category", S)],
    "fraud_flags": [("txn_id", S), ("fraud_flag", S), ("active_flag", S)],
    "credit_bureau": [("customer_id", L), ("external_credit_score", I), ("report_date", D)],
    "sanctions_list": [("customer_id", L), ("blacklisted", S)],
    "risk_assessment": [("customer_id", L), ("score", DBL), ("as_of_date", D)],
}

ROWS = {
    "customer": [(1, "Ann", "GOLD"), (2, "Bo", None), (3, "Cy", "SILVER"), (4, "Di", "BRONZE")],
    "account": [(101, "CHECKING", "ACTIVE", 1, F_), (102, "SAVINGS", "ACTIVE", 1, S_),
                (103, "LOAN", "CLOSED", 1, F_), (301, "CHECKING", "ACTIVE", 3, F_)],
    "transaction": [
        (101, "t1", Dm("200.00"), "DEBIT", dt.date(2001, 7, 20), 9001, F_),
        (101, "t2", Dm("500.50"), "CREDIT", dt.date(2001, 7, 25), 9002, F_),
        (101, "t3", Dm("75.25"), "DEBIT", dt.date(2000, 1, 5), 9001, F_),       # outside window
        (101, "t4", Dm("10.00"), "DEBIT", dt.date(2001, 7, 26), 9001, S_),      # stale load
        (102, "t5", Dm("33.00"), "CREDIT", dt.date(2001, 7, 1), 9003, F_),      # stale account
        (301, "t6", Dm("99.99"), "DEBIT", dt.date(2001, 6, 30), 9999, F_),      # unknown merchant
        (301, "t7", Dm("1.01"), "CREDIT", dt.date(2001, 6, 30), None, F_),      # no merchant
    ],
    "archived_customer": [(2, "Bo", None), (4, "Di", "BRONZE")],
    "archived_account": [(401, "SAVINGS", "ACTIVE", 4), (402, "LOAN", "CLOSED", 2), (403, "LOAN", "OPEN", 4)],
    "archived_transaction": [
        (401, "a1", Dm("5.00"), "DEBIT", dt.date(1998, 3, 1), 9001),
        (401, "a2", Dm("7.00"), "CREDIT", dt.date(1996, 3, 1), 9002),           # before archive_after
        (401, "t1", Dm("200.00"), "DEBIT", dt.date(1999, 3, 1), 9001),          # id reused
    ],
    "segmentation_rules": [(1, "GOLD"), (1, "GOLD"), (1, "PLATINUM"), (3, "SILVER"), (4, "BRONZE")],
    "customer_region": [(1, "NORTHEAST", "Y"), (2, "WEST", "N"), (3, "UNKNOWN", "Y"), (4, None, "Y")],
    "product_dim": [(101, "Everyday", "DEPOSIT"), (101, "Everyday", "DEPOSIT"), (301, "Loan", "LOAN")],
    "branch_dim": [(101, "Main", "NYC"), (102, "Main", "NYC"), (401, "West", "CA"), (301, "Up", "NJ")],
    "merchant_dim": [(9001, "GROCERY"), (9002, "DINING"), (9003, "TRAVEL")],
    "fraud_flags": [("t1", "Y", "Y"), ("t1", "Y", "Y"), ("t2", "N", "Y"), ("t6", "Y", "N"), ("a1", "Y", "Y")],
    "credit_bureau": [(1, 700, F_), (1, 650, S_), (3, 610, F_), (4, 720, F_), (4, 730, F_)],
    "sanctions_list": [(1, "Y"), (3, "N"), (4, None)],
    "risk_assessment": [(1, 0.7, R_), (1, 0.2, R_), (3, 0.4, dt.date(2024, 1, 2)), (4, 0.9, R_)],
}


def spark_views(spark):
    from tessera.sources.bank import BankViews
    dfs = {}
    for name, cols in SCHEMAS.items():
        schema = T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in cols])
        dfs[name] = spark.createDataFrame(ROWS[name], schema)
    return BankViews(**dfs)


def duck(con=None):
    import duckdb
    con = con or duckdb.connect()
    typ = {L: "BIGINT", S: "VARCHAR", D: "DATE", I: "INTEGER", DEC: "DECIMAL(18,2)", DBL: "DOUBLE"}
    for name, cols in SCHEMAS.items():
        con.execute(f"CREATE TABLE b_{name} ({', '.join(f'{c} {typ[t]}' for c, t in cols)})")
        if ROWS[name]:
            con.executemany(f"INSERT INTO b_{name} VALUES ({', '.join('?' for _ in cols)})", ROWS[name])
    return con

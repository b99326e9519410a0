"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL
twins for DuckDB. Every query reads the driver's test tables, or data Spark
derives from them row by row, so its work grows with the tables."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import remove_aliases, strip_code_fence
from tessera.operators import exact as X
from tessera.operators import layers as L
from tessera.operators import lineage as LN
from tessera.operators import mapping as M
from tessera.operators import quality as Q
from tessera.operators import scaled as SC
from tessera.operators import scripts as R
from tessera.operators.joins import hot_keys, lookup_join
from tessera.oracle import bank_sql as B
from tessera.oracle import derived_sql as DS
from tessera.params import DEFAULT
from tessera.session import scratch
from tessera.sources import derived as D
from tessera.sources import sinks
from tessera.sources.bank import BankViews
from tessera.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
P = DEFAULT
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _v(spark, sf_dir) -> BankViews:
    return BankViews.from_testdata(spark, sf_dir, P)


def _t(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


d = B.d

# ====================================================================== Q1-Q4

@register("q_base_layer", B.with_layers("SELECT * FROM q_base"))
def q_base_layer(spark, sf_dir):
    return L.base_layer(_v(spark, sf_dir), P)


@register("q_union_layer", B.with_layers("SELECT * FROM q_union"))
def q_union_layer(spark, sf_dir):
    return L.union_layer(_v(spark, sf_dir), P)


@register("q_nested_layer", B.with_layers(
    "SELECT * REPLACE (CAST(total_debit AS DECIMAL(28,2)) AS total_debit, "
    "CAST(total_credit AS DECIMAL(28,2)) AS total_credit) FROM q_nested"))
def q_nested_layer(spark, sf_dir):
    return L.nested_layer(_v(spark, sf_dir), P)


@register("q_customer_summary", B.with_layers("SELECT * FROM q_summary"))
def q_customer_summary(spark, sf_dir):
    return L.customer_summary(_v(spark, sf_dir), P).withColumn("risk_score", F.round("risk_score", 6))


# ====================================================================== P, J, A

@register("q_coalesce_default", B.with_bank(
    "SELECT customer_id, coalesce(segment, 'UNKNOWN') AS segment FROM b_customer"))
def q_coalesce_default(spark, sf_dir):
    return _v(spark, sf_dir).customer.select("customer_id", L.unknown_if_null("segment").alias("segment"))


@register("q_snapshot_filter", B.with_bank(
    f"SELECT account_id, customer_id, account_type FROM b_account WHERE load_date = {d(P.as_of)}"))
def q_snapshot_filter(spark, sf_dir):
    return L.snapshot(_v(spark, sf_dir).account, "load_date", P).select("account_id", "customer_id", "account_type")


@register("q_recent_txn", B.with_bank(
    "SELECT account_id, txn_id, amount, txn_type, txn_date, merchant_id FROM b_transaction "
    f"WHERE load_date = {d(P.as_of)} AND txn_date >= {d(P.window_start)}"))
def q_recent_txn(spark, sf_dir):
    return L.recent_transactions(_v(spark, sf_dir).transaction, P).select(
        "account_id", "txn_id", "amount", "txn_type", "txn_date", "merchant_id")


@register("q_left_join_residual", B.with_bank(
    "SELECT c.customer_id, c.name, a.account_id, a.account_type FROM b_customer c "
    f"LEFT JOIN b_account a ON c.customer_id = a.customer_id AND a.load_date = {d(P.as_of)}"))
def q_left_join_residual(spark, sf_dir):
    v = _v(spark, sf_dir)
    acc = L.snapshot(v.account, "load_date", P).select("customer_id", "account_id", "account_type")
    return v.customer.join(acc, "customer_id", "left").select("customer_id", "name", "account_id", "account_type")


@register("q_archive_join", B.with_layers("SELECT * FROM q_archive"))
def q_archive_join(spark, sf_dir):
    return L.archive_branch(_v(spark, sf_dir), P)


@register("q_join_distinct_dim", B.with_bank(
    "SELECT c.customer_id, s.segment_name FROM b_customer c LEFT JOIN "
    "(SELECT DISTINCT customer_id, segment_name FROM b_segmentation_rules) s ON c.customer_id = s.customer_id"))
def q_join_distinct_dim(spark, sf_dir):
    v = _v(spark, sf_dir)
    seg = v.segmentation_rules.select("customer_id", "segment_name").distinct()
    return lookup_join(v.customer.select("customer_id"), seg, "customer_id", "customer_id", ["segment_name"])


@register("q_active_region", B.with_bank(
    "SELECT c.customer_id, r.region FROM b_customer c LEFT JOIN "
    "(SELECT cust_id, region FROM b_customer_region WHERE active_flag = 'Y') r ON c.customer_id = r.cust_id"))
def q_active_region(spark, sf_dir):
    v = _v(spark, sf_dir)
    r = L.active(v.customer_region).select("cust_id", "region")
    return lookup_join(v.customer.select("customer_id"), r, "customer_id", "cust_id", ["region"])


@register("q_fraud_join", B.with_bank(
    "SELECT t.txn_id, t.account_id, f.fraud_flag FROM b_transaction t LEFT JOIN "
    "(SELECT DISTINCT txn_id, fraud_flag FROM b_fraud_flags WHERE active_flag = 'Y') f ON t.txn_id = f.txn_id"))
def q_fraud_join(spark, sf_dir):
    v = _v(spark, sf_dir)
    f = L.active(v.fraud_flags).select("txn_id", "fraud_flag").distinct()
    return lookup_join(v.transaction.select("txn_id", "account_id"), f, "txn_id", "txn_id", ["fraud_flag"])


@register("q_credit_snapshot", B.with_bank(
    "SELECT c.customer_id, cb.external_credit_score FROM b_customer c LEFT JOIN "
    f"(SELECT customer_id, external_credit_score FROM b_credit_bureau WHERE report_date = {d(P.as_of)}) cb "
    "ON c.customer_id = cb.customer_id"))
def q_credit_snapshot(spark, sf_dir):
    v = _v(spark, sf_dir)
    cb = L.snapshot(v.credit_bureau, "report_date", P)
    return lookup_join(v.customer.select("customer_id"), cb, "customer_id", "customer_id",
                       ["external_credit_score"])


@register("q_sanctions_flag", B.with_bank(
    "SELECT c.customer_id, s.sanctions_hit FROM b_customer c LEFT JOIN "
    "(SELECT customer_id, CASE WHEN blacklisted = 'Y' THEN 1 ELSE 0 END AS sanctions_hit FROM b_sanctions_list) s "
    "ON c.customer_id = s.customer_id"))
def q_sanctions_flag(spark, sf_dir):
    v = _v(spark, sf_dir)
    return lookup_join(v.customer.select("customer_id"), L.sanctions_decoded(v.sanctions_list),
                       "customer_id", "customer_id", ["sanctions_hit"])


@register("q_risk_score", B.with_bank(
    "SELECT c.customer_id, round(r.risk_score, 6) AS risk_score FROM b_customer c LEFT JOIN "
    f"(SELECT customer_id, AVG(score) AS risk_score FROM b_risk_assessment WHERE as_of_date = {d(P.risk_as_of)} "
    "GROUP BY customer_id) r ON c.customer_id = r.customer_id"))
def q_risk_score(spark, sf_dir):
    v = _v(spark, sf_dir)
    out = lookup_join(v.customer.select("customer_id"), L.risk_by_customer(v.risk_assessment, P),
                      "customer_id", "customer_id", ["risk_score"])
    return out.withColumn("risk_score", F.round("risk_score", 6))


@register("q_conditional_sum", B.with_bank(
    "SELECT account_id, "
    "CAST(SUM(CASE WHEN txn_type = 'DEBIT' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS total_debit, "
    "CAST(SUM(CASE WHEN txn_type = 'CREDIT' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS total_credit, "
    "MAX(txn_date) AS last_txn_date FROM b_transaction GROUP BY account_id"))
def q_conditional_sum(spark, sf_dir):
    t = _v(spark, sf_dir).transaction
    return t.groupBy("account_id").agg(
        F.sum(L._amount_if("DEBIT")).cast(L.MONEY).alias("total_debit"),
        F.sum(L._amount_if("CREDIT")).cast(L.MONEY).alias("total_credit"),
        F.max("txn_date").alias("last_txn_date"))


@register("q_count_distinct", B.with_bank(
    "SELECT merchant_id, COUNT(DISTINCT txn_id) AS txn_count, COUNT(DISTINCT account_id) AS account_count "
    "FROM b_transaction GROUP BY merchant_id"))
def q_count_distinct(spark, sf_dir):
    t = _v(spark, sf_dir).transaction
    return t.groupBy("merchant_id").agg(F.count_distinct("txn_id").alias("txn_count"),
                                        F.count_distinct("account_id").alias("account_count"))


@register("q_two_level_agg", B.with_bank(
    "SELECT account_id, CAST(SUM(debit) AS DECIMAL(18,2)) AS total_debit, "
    "CAST(SUM(credit) AS DECIMAL(18,2)) AS total_credit, COUNT(*) AS merchants FROM ("
    "SELECT account_id, merchant_id, SUM(CASE WHEN txn_type = 'DEBIT' THEN amount ELSE 0 END) AS debit, "
    "SUM(CASE WHEN txn_type = 'CREDIT' THEN amount ELSE 0 END) AS credit "
    "FROM b_transaction GROUP BY account_id, merchant_id) x GROUP BY account_id"))
def q_two_level_agg(spark, sf_dir):
    t = _v(spark, sf_dir).transaction
    first = t.groupBy("account_id", "merchant_id").agg(
        F.sum(L._amount_if("DEBIT")).alias("debit"), F.sum(L._amount_if("CREDIT")).alias("credit"))
    return first.groupBy("account_id").agg(
        F.sum("debit").cast(L.MONEY).alias("total_debit"), F.sum("credit").cast(L.MONEY).alias("total_credit"),
        F.count(F.lit(1)).alias("merchants"))


@register("q_region_null_groups", B.with_bank(
    "SELECT coalesce(region, 'UNKNOWN') AS region, n_customers FROM ("
    "SELECT r.region, COUNT(*) AS n_customers FROM b_customer c LEFT JOIN "
    "(SELECT cust_id, CASE WHEN region = 'MIDDLE EAST' THEN 'UNKNOWN' ELSE region END AS region "
    " FROM b_customer_region WHERE active_flag = 'Y') r ON c.customer_id = r.cust_id GROUP BY r.region) g"))
def q_region_null_groups(spark, sf_dir):
    """The NULL group and a literal 'UNKNOWN' group stay two rows."""
    v = _v(spark, sf_dir)
    r = L.active(v.customer_region).select(
        "cust_id", F.when(F.col("region") == "MIDDLE EAST", "UNKNOWN").otherwise(F.col("region")).alias("region"))
    g = lookup_join(v.customer.select("customer_id"), r, "customer_id", "cust_id", ["region"])
    return (g.groupBy("region").agg(F.count(F.lit(1)).alias("n_customers"))
            .select(L.unknown_if_null("region").alias("region"), "n_customers"))


# ====================================================================== the job for large and skewed tables

@register("q_scaled_summary", f"WITH {B.layer_ctes(P)},\n{B.exact_risk(P)}\n"
          "SELECT s.* REPLACE (x.risk_score AS risk_score) FROM q_summary s LEFT JOIN exact_risk x USING (customer_id)")
def q_scaled_summary(spark, sf_dir):
    return SC.customer_summary(_v(spark, sf_dir), P)


@register("q_union_digest", B.with_layers(
    "SELECT customer_id, account_id, account_type, txn_id, amount, txn_type, txn_date, merchant_id FROM q_union"))
def q_union_digest(spark, sf_dir):
    return SC.union_digest(_v(spark, sf_dir), P)


@register("q_fraud_join_bloom", B.with_bank(
    "SELECT t.txn_id, t.account_id, f.fraud_flag FROM "
    f"(SELECT txn_id, account_id FROM b_transaction WHERE load_date = {d(P.as_of)} AND txn_date >= {d(P.window_start)} "
    f"UNION ALL SELECT txn_id, account_id FROM b_archived_transaction WHERE txn_date > {d(P.archive_after)}) t LEFT JOIN "
    "(SELECT DISTINCT txn_id, fraud_flag FROM b_fraud_flags WHERE active_flag = 'Y') f ON t.txn_id = f.txn_id"))
def q_fraud_join_bloom(spark, sf_dir):
    v = _v(spark, sf_dir)
    archived = v.archived_transaction.where(F.col("txn_date") > F.lit(P.archive_after))
    t = L.recent_transactions(v.transaction, P).select("txn_id", "account_id").union(archived.select("txn_id", "account_id"))
    return lookup_join(t, SC.fraud_flags(v, P), "txn_id", "txn_id", ["fraud_flag"])


@register("q_hot_merchants", B.with_bank(
    "SELECT merchant_id, count(*) AS n_txn FROM b_transaction GROUP BY merchant_id "
    "HAVING count(*) > 0.0005 * (SELECT count(*) FROM b_transaction)"))
def q_hot_merchants(spark, sf_dir):
    """Merchants of more than 0.05 % of all transactions: found by the sketch, counted exactly."""
    t = _v(spark, sf_dir).transaction
    hot = hot_keys(t, ["merchant_id"], 0.0004)["merchant_id"]
    counts = t.where(F.col("merchant_id").isin(*hot)).groupBy("merchant_id").agg(F.count("*").alias("n_txn"))
    return counts.where(F.col("n_txn") > 0.0005 * t.count())


@register("q_risk_exact", f"WITH {B.bank_ctes(P)},\n{B.exact_risk(P)}\nSELECT * FROM exact_risk")
def q_risk_exact(spark, sf_dir):
    return SC.risk_by_customer(_v(spark, sf_dir).risk_assessment, P)


@register("q_accounts_rollup", B.with_layers(
    "SELECT segment_name, region, count(DISTINCT account_id) AS total_accounts FROM q_nested GROUP BY segment_name, region"))
def q_accounts_rollup(spark, sf_dir):
    """A4 over two levels: bitmaps built at Q3's product grain, or-ed for the rollup."""
    v = _v(spark, sf_dir)
    n = L.nested_layer(v, P)
    state = X.distinct_state(n, ["segment_name", "region", "product_category"], "account_id")
    return X.count_state(state, ["segment_name", "region"], "total_accounts")


# ====================================================================== mapping

@register("q_catalog_flat", DS.CATALOG_FLAT)
def q_catalog_flat(spark, sf_dir):
    return M.flatten_catalog(D.catalog_documents(_t(spark, sf_dir).part), "value")


def _catalog_with_holes(t: Tables) -> DataFrame:
    """The catalog, with the entries of small parts under a table that nobody asks for."""
    e = D.catalog_entries(t.part)
    table = F.when(F.col("p_size") > 5, F.col("table_name")).otherwise(F.concat(F.lit("gone."), "table_name"))
    return e.select(table.alias("table_name"), "column_name", "data_type", "is_categorical", "categories")


@register("q_enrich_mapping", DS.ENRICH_MAPPING)
def q_enrich_mapping(spark, sf_dir):
    t = _t(spark, sf_dir)
    return M.enrich_with_catalog(D.mapping_rows(t.lineitem), _catalog_with_holes(t))


@register("q_default_logic", DS.DEFAULT_LOGIC)
def q_default_logic(spark, sf_dir):
    m = D.mapping_rows(_t(spark, sf_dir).lineitem)
    return m.select("mapping_id", M.default_logic(F.col("transformation_logic")).alias("transformation_logic"))


@register("q_strip_alias", DS.STRIP_ALIAS)
def q_strip_alias(spark, sf_dir):
    t = _t(spark, sf_dir)
    pages = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                           remove_aliases("url").alias("cleaned"))
    docs = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
                              remove_aliases("text").alias("cleaned"))
    return pages.unionByName(docs)


def _parsed_mapping_docs(spark, sf_dir) -> DataFrame:
    return M.parse_documents(D.mapping_documents(_t(spark, sf_dir).orders), "text")


@register("q_mapping_validate", DS.MAPPING_VALID)
def q_mapping_validate(spark, sf_dir):
    return M.valid_mappings(_parsed_mapping_docs(spark, sf_dir))


@register("q_mapping_quarantine", DS.MAPPING_QUARANTINE)
def q_mapping_quarantine(spark, sf_dir):
    return M.quarantine(_parsed_mapping_docs(spark, sf_dir)).select("doc_id", "error")


@register("q_mapping_csv_rows", DS.MAPPING_CSV)
def q_mapping_csv_rows(spark, sf_dir):
    return M.csv_projection(M.valid_mappings(_parsed_mapping_docs(spark, sf_dir)), ("doc_id", "pos"))


def _lineage_parsed(spark, sf_dir) -> DataFrame:
    return LN.parse_lineage(D.lineage_documents(_t(spark, sf_dir).lineitem))


@register("q_mapping_final_only", DS.MAPPING_FINAL_ONLY)
def q_mapping_final_only(spark, sf_dir):
    t = _t(spark, sf_dir)
    sinks = LN.roots_and_sinks(LN.lineage_edges(_lineage_parsed(spark, sf_dir))).where(F.col("role") == "sink")
    return M.final_table_only(D.mapping_rows(t.lineitem), sinks).select(
        "mapping_id", "source_table", "source_column", "target_table", "target_column")


# ====================================================================== lineage

@register("q_strip_fence", DS.STRIP_FENCE)
def q_strip_fence(spark, sf_dir):
    docs = D.fenced_answers(_t(spark, sf_dir).documents)
    return docs.select("doc_id", strip_code_fence("text").alias("cleaned"))


@register("q_lineage_edges", DS.LINEAGE_EDGES)
def q_lineage_edges(spark, sf_dir):
    return LN.lineage_edges(_lineage_parsed(spark, sf_dir))


@register("q_lineage_nodes", DS.LINEAGE_NODES)
def q_lineage_nodes(spark, sf_dir):
    return LN.lineage_nodes(_lineage_parsed(spark, sf_dir))


@register("q_lineage_columns", DS.LINEAGE_COLUMNS)
def q_lineage_columns(spark, sf_dir):
    return LN.lineage_columns(_lineage_parsed(spark, sf_dir))


@register("q_lineage_roots", DS.LINEAGE_ROOTS)
def q_lineage_roots(spark, sf_dir):
    return LN.roots_and_sinks(D.lineage_tree_edges(_t(spark, sf_dir).part))


@register("q_lineage_closure", DS.LINEAGE_CLOSURE)
def q_lineage_closure(spark, sf_dir):
    return LN.closure_to_base(D.lineage_tree_edges(_t(spark, sf_dir).part))


@register("q_lineage_cycles", DS.LINEAGE_CYCLES)
def q_lineage_cycles(spark, sf_dir):
    return LN.lineage_cycles(D.lineage_line_edges(_t(spark, sf_dir).lineitem))


@register("q_lineage_cyclic_closure", DS.LINEAGE_CYCLIC_CLOSURE)
def q_lineage_cyclic_closure(spark, sf_dir):
    return LN.closure_to_base(D.lineage_line_edges(_t(spark, sf_dir).lineitem))


@register("q_lineage_quarantine", DS.LINEAGE_QUARANTINE)
def q_lineage_quarantine(spark, sf_dir):
    return LN.quarantine(LN.parse_lineage(D.lineage_answers(_t(spark, sf_dir).orders))).select("doc_id", "error")


@register("q_lineage_json_docs", DS.LINEAGE_JSON)
def q_lineage_json_docs(spark, sf_dir):
    return sinks.lineage_json(LN.parse_lineage(D.lineage_answers(_t(spark, sf_dir).orders)))


@register("q_script_refs", DS.SCRIPT_REFS)
def q_script_refs(spark, sf_dir):
    return R.script_references(D.scripts_from_documents(_t(spark, sf_dir).documents), key="doc_id")


@register("q_lineage_missing", DS.LINEAGE_MISSING)
def q_lineage_missing(spark, sf_dir):
    scripts = D.scripts_with_lineage(_t(spark, sf_dir).documents)
    refs = R.script_references(scripts.select("doc_id", "text"), key="doc_id")
    return LN.missing_from_lineage(refs, LN.lineage_nodes(LN.parse_lineage(scripts, "lineage")))


# ====================================================================== DQ

@register("q_rule_flatten", DS.RULE_FLATTEN)
def q_rule_flatten(spark, sf_dir):
    return Q.flatten_rules(D.rule_answers(_t(spark, sf_dir).documents))


@register("q_dq_rules", DS.DQ_RULES)
def q_dq_rules(spark, sf_dir):
    t = _t(spark, sf_dir)
    cat = _catalog_with_holes(t)
    enriched = M.enrich_with_catalog(D.dq_mapping_rows(t.part), cat)
    return Q.derive_rules(enriched, cat, P.as_of)


# catalog entries and mapping rows of the transaction table, as configuration
TRANSACTION = "bank.transaction"
TRANSACTION_CATALOG = [
    (TRANSACTION, "account_id", "bigint", False, []), (TRANSACTION, "merchant_id", "bigint", False, []),
    (TRANSACTION, "txn_id", "bigint", False, []), (TRANSACTION, "amount", "decimal(18,2)", False, []),
    (TRANSACTION, "txn_type", "string", True, ["DEBIT", "CREDIT"]), (TRANSACTION, "txn_date", "date", False, [])]
TRANSACTION_MAPPINGS = [
    ("core_db.all_accounts", "account_id", TRANSACTION, "account_id", "Direct mapping"),
    ("staging_db.account", "account_id", TRANSACTION, "account_id", "Direct mapping"),
    ("core_db.merchant_dim", "merchant_id", TRANSACTION, "merchant_id", "Direct mapping"),
    ("staging_db.lines", "key", TRANSACTION, "txn_id", "concat_ws('-', key, line)"),
    ("staging_db.lines", "price", TRANSACTION, "amount", "SUM(price)"),
    ("staging_db.lines", "flag", TRANSACTION, "txn_type", "CASE WHEN flag = 'R' THEN 'DEBIT' ELSE 'CREDIT' END"),
    ("staging_db.lines", "day", TRANSACTION, "txn_date", "CAST(day AS date)")]


def _transaction_rules(spark, df):
    """D8's rules for the transaction table, compiled for ``df``."""
    cat = spark.createDataFrame(TRANSACTION_CATALOG, "table_name string, column_name string, data_type string, "
                                                     "is_categorical boolean, categories array<string>")
    maps = spark.createDataFrame(TRANSACTION_MAPPINGS, ", ".join(f"{c} string" for c in M.REQUIRED))
    return Q.compile_rules(Q.derive_rules(M.enrich_with_catalog(maps, cat), cat, P.as_of), df)


@register("q_dq_row_checks", DS.DQ_ROW_CHECKS)
def q_dq_row_checks(spark, sf_dir):
    txn = _v(spark, sf_dir).transaction
    return Q.check_rows(txn, _transaction_rules(spark, txn)[0])


@register("q_dq_referential", DS.DQ_REFERENTIAL)
def q_dq_referential(spark, sf_dir):
    v = _v(spark, sf_dir)
    parents = {"core_db.all_accounts.account_id": (_t(spark, sf_dir).orders, "o_orderkey"),
               "staging_db.account.account_id": (v.account, "account_id"),
               "core_db.merchant_dim.merchant_id": (v.merchant_dim, "merchant_id")}
    references = _transaction_rules(spark, v.transaction)[1]
    return Q.check_references(v.transaction, [(n, c, *parents[p]) for n, c, p in references])


# ====================================================================== artefacts as rows

@register("q_mapping_json_docs", DS.MAPPING_JSON)
def q_mapping_json_docs(spark, sf_dir):
    return sinks.mapping_documents(M.valid_mappings(_parsed_mapping_docs(spark, sf_dir)))


@register("q_csv_round_trip", DS.CSV_ROUND_TRIP)
def q_csv_round_trip(spark, sf_dir):
    """Mappings to CSV text and back, with quotes, commas and line breaks in the logic."""
    m = M.valid_mappings(_parsed_mapping_docs(spark, sf_dir)).withColumn(
        "transformation_logic", F.concat("transformation_logic", F.lit('\n  -- "as is", '), "target_column"))
    lines = M.csv_projection(m, ("doc_id", "pos")).select("doc_id", "pos", sinks.csv_line(*M.MAPPING_FIELDS).alias("line"))
    back = lines.select("doc_id", "pos", sinks.parse_csv_line("line", M.MAPPING_FIELDS).alias("m"))
    return M.from_csv_projection(back.select("doc_id", "pos", "m.*"), ("doc_id", "pos"))


@register("q_csv_files", DS.CSV_FILES)
def q_csv_files(spark, sf_dir):
    """S11 and S12 by way of files: written, and read back in splits."""
    m = M.valid_mappings(_parsed_mapping_docs(spark, sf_dir)).withColumn(
        "transformation_logic", F.concat("transformation_logic", F.lit('\n  -- "as is", '), "target_column"))
    path = scratch(spark)
    sinks.write_mapping_csv(m, path)
    return sinks.read_mapping_csv(spark, path)


@register("q_written_counts", DS.WRITTEN_COUNTS)
def q_written_counts(spark, sf_dir):
    """M9: what the jobs that wrote S10 and S11 have seen."""
    m = M.valid_mappings(_parsed_mapping_docs(spark, sf_dir))
    seen = [("csv", sinks.write_mapping_csv(m, scratch(spark))), ("json", sinks.write_mapping_json(m, scratch(spark)))]
    return spark.createDataFrame(seen, "artefact string, mappings long")


@register("q_catalog_pieces", DS.CATALOG_PIECES)
def q_catalog_pieces(spark, sf_dir):
    return M.catalog_pieces(D.damaged_catalogs(_t(spark, sf_dir).part)).drop("raw")


@register("q_layout_profile", B.with_bank(
    "SELECT a.account_id, a.customer_id, a.account_type, p.product_name, p.product_category, z.branch_name, z.branch_region "
    "FROM b_account a LEFT JOIN b_product_dim p ON p.account_id = a.account_id LEFT JOIN b_branch_dim z ON z.account_id = a.account_id "
    f"WHERE a.load_date = {d(P.as_of)}"))
def q_layout_profile(spark, sf_dir):
    """S1, S3, S5, P8, J8, J9 over tables laid out by date and in buckets, written and read back."""
    return L.account_profile(_laid_out(spark, _v(spark, sf_dir), ("account", "product_dim", "branch_dim")), P)


def _laid_out(spark, v: BankViews, names) -> SimpleNamespace:
    """Views over new tables in the shared folder, laid out for the job."""
    root, buckets = scratch(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = {n: f"layout_{root.rsplit('/', 1)[1]}_{n}" for n in names}
    for n, table in tables.items():
        sinks.save_layout(getattr(v, n), table, n, buckets, f"{root}/{n}")
    return SimpleNamespace(**{n: spark.table(t) for n, t in tables.items()})


@register("q_rules_csv_rows", DS.RULES_CSV)
def q_rules_csv_rows(spark, sf_dir):
    rules = Q.flatten_rules(D.rule_answers(_t(spark, sf_dir).documents))
    return rules.select("target_column", "rule_no", sinks.csv_line(*Q.ROW_FIELDS, "rule").alias("line"))


@register("q_mapping_count", DS.MAPPING_COUNT)
def q_mapping_count(spark, sf_dir):
    """M9, by target table."""
    t = _t(spark, sf_dir)
    return (M.enrich_with_catalog(D.mapping_rows(t.lineitem), _catalog_with_holes(t))
            .groupBy("target_table").agg(F.count(F.lit(1)).alias("mappings")))


@register("q_date_arithmetic", B.with_bank(
    f"SELECT l_orderkey, l_linenumber, {d(P.as_of)} - CAST(l_linenumber * 5 AS INTEGER) AS seed_date, "
    f"CAST(l_shipdate AS DATE) >= {d(P.as_of)} - CAST(l_linenumber * 5 AS INTEGER) AS is_recent FROM lineitem"))
def q_date_arithmetic(spark, sf_dir):
    """Dates a number of days before the run date."""
    seed = F.date_sub(F.lit(P.as_of), (F.col("l_linenumber") * 5).cast("int"))
    return _t(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", seed.alias("seed_date"),
                                            (F.col("l_shipdate").cast("date") >= seed).alias("is_recent"))


__all__ = ["QUERIES", "ORACLE", "register"]

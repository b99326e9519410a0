"""Bank views (FIXTURES.md section 3) and the four layers in plain SQL."""

from __future__ import annotations

from tessera.params import DEFAULT, RunParams


def d(x) -> str:
    return f"DATE '{x.isoformat()}'"


def bank_ctes(p: RunParams = DEFAULT) -> str:
    snap = lambda cond: f"CASE WHEN {cond} THEN {d(p.stale)} ELSE {d(p.as_of)} END"
    txn_id = ("CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || "
              "CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR)")
    txn_cols = (f"l_orderkey AS account_id, {txn_id} AS txn_id, "
                "CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, "
                "CASE WHEN l_returnflag = 'R' THEN 'DEBIT' ELSE 'CREDIT' END AS txn_type, "
                "CAST(l_shipdate AS DATE) AS txn_date, l_suppkey AS merchant_id")
    return f"""
b_customer AS (
  SELECT c_custkey AS customer_id, c_name AS name, NULLIF(c_mktsegment, 'HOUSEHOLD') AS segment
  FROM customer),
b_account AS (
  SELECT o_orderkey AS account_id, o_orderpriority AS account_type, o_orderstatus AS status,
         o_custkey AS customer_id, {snap('o_orderkey % 10 = 0')} AS load_date
  FROM orders WHERE CAST(o_orderdate AS DATE) >= {d(p.live_from)}),
b_archived_account AS (
  SELECT o_orderkey AS account_id, o_orderpriority AS account_type, o_orderstatus AS status,
         o_custkey AS customer_id
  FROM orders WHERE CAST(o_orderdate AS DATE) < {d(p.live_from)}),
b_transaction AS (
  SELECT {txn_cols}, {snap('l_linenumber = 7')} AS load_date FROM lineitem),
b_archived_transaction AS (SELECT {txn_cols} FROM lineitem),
b_archived_customer AS (
  SELECT CASE WHEN customer_id % 2 = 0 THEN customer_id ELSE -customer_id END AS customer_id, name, segment
  FROM b_customer),
b_segmentation_rules AS (
  SELECT CASE WHEN o.o_custkey % 5 = 0 THEN -o.o_custkey ELSE o.o_custkey END AS customer_id,
         c.c_mktsegment AS segment_name
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
b_geo AS (
  SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
b_customer_region AS (
  SELECT c.c_custkey AS cust_id, g.r_name AS region,
         CASE WHEN c.c_acctbal > 0 THEN 'Y' ELSE 'N' END AS active_flag
  FROM customer c JOIN b_geo g ON c.c_nationkey = g.n_nationkey),
b_product_dim AS (
  SELECT CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey ELSE o_orderkey END AS account_id,
         o_orderpriority AS product_name, o_orderstatus AS product_category
  FROM orders),
b_branch_dim AS (
  SELECT o.o_orderkey AS account_id, g.n_name AS branch_name, g.r_name AS branch_region
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN b_geo g ON c.c_nationkey = g.n_nationkey),
b_merchant_dim AS (
  SELECT s.s_suppkey AS merchant_id, n.n_name AS merchant_category
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey),
b_fraud_flags AS (
  SELECT CASE WHEN l_discount >= 0.08 THEN '' ELSE 'none-' END || {txn_id} AS txn_id,
         CASE WHEN l_discount >= 0.09 THEN 'Y' ELSE 'N' END AS fraud_flag,
         CASE WHEN l_linestatus = 'O' THEN 'Y' ELSE 'N' END AS active_flag
  FROM lineitem),
b_credit_bureau AS (
  SELECT c_custkey AS customer_id, CAST(floor(c_acctbal) AS INTEGER) AS external_credit_score,
         {snap('c_custkey % 4 = 0')} AS report_date
  FROM customer),
b_sanctions_list AS (
  SELECT CASE WHEN c_custkey % 11 = 0 THEN c_custkey ELSE -c_custkey END AS customer_id,
         CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS blacklisted
  FROM customer),
b_risk_assessment AS (
  SELECT user_id AS customer_id, value AS score, CAST(ts AS DATE) AS as_of_date FROM events)"""


def layer_ctes(p: RunParams = DEFAULT) -> str:
    return bank_ctes(p) + ",\n" + layers_over_views(p)


def layers_over_views(p: RunParams = DEFAULT) -> str:
    """The layers over relations named b_customer, b_account, ..., worked out
    in another way than the job's: live and archive are flat lists of
    (customer, account) and their transactions; the dimensions of a customer
    and of an account are put together before they meet a transaction; and each
    measure of the summary is computed in a step of its own from the flat rows,
    to be joined on the summary's keys.
    """
    return f"""
held AS (
  SELECT c.customer_id, c.name, c.segment, x.account_id, x.account_type, x.status, 'live' AS kind
  FROM b_customer c LEFT JOIN (SELECT * FROM b_account WHERE load_date = {d(p.as_of)}) x USING (customer_id)
  UNION ALL
  SELECT c.customer_id, c.name, c.segment, x.account_id, x.account_type, x.status, 'archive'
  FROM b_archived_customer c, b_archived_account x WHERE x.customer_id = c.customer_id),
moves AS (
  SELECT account_id, txn_id, amount, txn_type, txn_date, merchant_id, 'live' AS kind FROM b_transaction
  WHERE load_date = {d(p.as_of)} AND txn_date >= {d(p.window_start)}
  UNION ALL
  SELECT account_id, txn_id, amount, txn_type, txn_date, merchant_id, 'archive' FROM b_archived_transaction
  WHERE txn_date > {d(p.archive_after)}),
flat AS (
  SELECT h.kind, h.customer_id, h.name, h.account_id, h.account_type, h.status, m.txn_id, m.amount, m.txn_type,
         m.txn_date, ifnull(h.segment, 'UNKNOWN') AS segment, {d(p.as_of)} AS load_date, m.merchant_id
  FROM held h LEFT JOIN moves m ON m.account_id = h.account_id AND m.kind = h.kind),
q_base AS (SELECT DISTINCT * EXCLUDE (kind) FROM flat WHERE kind = 'live'),
q_archive AS (SELECT * EXCLUDE (kind) FROM flat WHERE kind = 'archive'),
q_union AS (SELECT DISTINCT * EXCLUDE (kind) FROM flat),
of_customer AS (
  SELECT ids.customer_id, g.segment_name, w.region, k.external_credit_score,
         CASE b.blacklisted WHEN 'Y' THEN 1 ELSE CASE WHEN b.customer_id IS NOT NULL THEN 0 END END AS sanctions_hit
  FROM (SELECT DISTINCT customer_id FROM q_union) ids
  LEFT JOIN (SELECT customer_id, segment_name FROM b_segmentation_rules GROUP BY ALL) g USING (customer_id)
  LEFT JOIN b_customer_region w ON w.cust_id = ids.customer_id AND w.active_flag = 'Y'
  LEFT JOIN b_credit_bureau k ON k.customer_id = ids.customer_id AND k.report_date = {d(p.as_of)}
  LEFT JOIN b_sanctions_list b ON b.customer_id = ids.customer_id),
of_account AS (
  SELECT ids.account_id, a.product_name, a.product_category, z.branch_name, z.branch_region
  FROM (SELECT DISTINCT account_id FROM q_union) ids
  LEFT JOIN b_product_dim a USING (account_id) LEFT JOIN b_branch_dim z USING (account_id)),
flagged AS (SELECT txn_id, fraud_flag FROM b_fraud_flags WHERE active_flag = 'Y' GROUP BY ALL),
wide AS (
  SELECT x.customer_id, x.account_id, x.account_type, x.txn_id, x.amount, x.txn_type, x.txn_date,
         y.segment_name, y.region, z.product_name, z.product_category, z.branch_name, z.branch_region,
         v.merchant_category, e.fraud_flag, y.external_credit_score, y.sanctions_hit
  FROM q_union x
  JOIN of_customer y ON y.customer_id IS NOT DISTINCT FROM x.customer_id
  JOIN of_account z ON z.account_id IS NOT DISTINCT FROM x.account_id
  LEFT JOIN b_merchant_dim v ON v.merchant_id = x.merchant_id
  LEFT JOIN flagged e ON e.txn_id = x.txn_id),
q_nested AS (
  SELECT customer_id, account_id, account_type,
         ifnull(sum(amount) FILTER (txn_type = 'DEBIT'), 0) AS total_debit,
         ifnull(sum(amount) FILTER (txn_type = 'CREDIT'), 0) AS total_credit,
         count(DISTINCT txn_id) AS txn_count, segment_name, ifnull(region, 'UNKNOWN') AS region,
         max(txn_date) AS last_txn_date, product_name, product_category, branch_name, branch_region,
         merchant_category, fraud_flag, external_credit_score, sanctions_hit
  FROM wide
  GROUP BY customer_id, account_id, account_type, segment_name, wide.region, product_name, product_category,
           branch_name, branch_region, merchant_category, fraud_flag, external_credit_score, sanctions_hit),
keyed AS (
  SELECT * EXCLUDE (region), ifnull(region, 'UNKNOWN') AS shown_region,
         (customer_id, segment_name, ifnull(region, 'UNKNOWN'), product_name, product_category, branch_name,
          branch_region, merchant_category) AS grain, region AS raw_region
  FROM wide),
money AS (
  SELECT grain, sum(amount) FILTER (txn_type = 'DEBIT') AS debit, sum(amount) FILTER (txn_type = 'CREDIT') AS credit
  FROM keyed GROUP BY grain),
accounts AS (SELECT grain, count(*) AS n FROM (SELECT DISTINCT grain, account_id FROM keyed WHERE account_id IS NOT NULL) GROUP BY grain),
frauds AS (
  SELECT grain, count(*) AS n FROM (
    SELECT DISTINCT grain, raw_region, account_id, account_type, external_credit_score, sanctions_hit
    FROM keyed WHERE fraud_flag = 'Y') GROUP BY grain),
tops AS (
  SELECT grain, max(txn_date) AS last_date, max(external_credit_score) AS score, max(sanctions_hit) AS hit
  FROM keyed GROUP BY grain),
risks AS (
  SELECT customer_id, avg(score) AS mean_score FROM b_risk_assessment
  WHERE as_of_date = {d(p.risk_as_of)} GROUP BY customer_id),
q_summary AS (
  SELECT k.customer_id, ifnull(accounts.n, 0) AS total_accounts,
         CAST(ifnull(money.debit, 0) AS DECIMAL(18,2)) AS total_debit,
         CAST(ifnull(money.credit, 0) AS DECIMAL(18,2)) AS total_credit, tops.last_date AS last_txn_date,
         k.segment_name, k.shown_region AS region, k.product_name, k.product_category, k.branch_name, k.branch_region,
         k.merchant_category, round(risks.mean_score, 6) AS risk_score, tops.score AS credit_score,
         CAST(ifnull(frauds.n, 0) AS BIGINT) AS fraud_txn_count, tops.hit AS sanctions_match
  FROM (SELECT DISTINCT grain, customer_id, segment_name, shown_region, product_name, product_category, branch_name,
                        branch_region, merchant_category FROM keyed) k
  JOIN money ON money.grain IS NOT DISTINCT FROM k.grain
  JOIN tops ON tops.grain IS NOT DISTINCT FROM k.grain
  LEFT JOIN accounts ON accounts.grain IS NOT DISTINCT FROM k.grain
  LEFT JOIN frauds ON frauds.grain IS NOT DISTINCT FROM k.grain
  LEFT JOIN risks ON risks.customer_id = k.customer_id)"""


def with_layers(select: str, p: RunParams = DEFAULT) -> str:
    return f"WITH {layer_ctes(p)}\n{select}"


def with_bank(select: str, p: RunParams = DEFAULT) -> str:
    return f"WITH {bank_ctes(p)}\n{select}"


def exact_risk(p: RunParams = DEFAULT) -> str:
    """CTE exact_risk (customer_id, risk_score): the average without regard to the
    order of the rows, from whole multiples of 2^-30 and the rest in 2^-83."""
    return f"""
cut_scores AS (
  SELECT customer_id, score, floor(score * 1073741824::DOUBLE) AS whole, score * 1073741824::DOUBLE AS scaled
  FROM b_risk_assessment WHERE as_of_date = {d(p.risk_as_of)}),
exact_risk AS (
  SELECT customer_id, (sum(CAST(whole AS HUGEINT))::DOUBLE * power(2::DOUBLE, -30)
                       + sum(CAST(floor((scaled - whole) * 9007199254740992::DOUBLE) AS HUGEINT))::DOUBLE * power(2::DOUBLE, -83))
                      / count(score)::DOUBLE AS risk_score
  FROM cut_scores GROUP BY customer_id)"""

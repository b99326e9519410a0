"""SQL twins of the queries over derived inputs. Each rebuilds the input
rule by rule from the raw tables and applies the operator's semantics in
plain SQL (windows, recursive CTE, list functions) - it never parses the
JSON that Spark writes, so the Spark side's parsing is checked too."""

from __future__ import annotations

from tessera.functions.text import NUMBERING_PATTERN, WORD, WS_CHARS
from tessera.oracle.bank_sql import bank_ctes
from tessera.params import DEFAULT as P

WS = "(" + " || ".join(f"chr({ord(c)})" for c in WS_CHARS) + ")"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def vc(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


TXN_ID = (f"{vc('l_orderkey')} || '-' || {vc('l_linenumber')} || '-' || {vc('l_partkey')} || '-' "
          f"|| {vc('l_suppkey')}")
ALIAS = q(f"{WORD}+\\.({WORD}+)")        # RE2 reads it in linear time as it is
NUMBERING = q(NUMBERING_PATTERN)
EMPTY = "CAST([] AS VARCHAR[])"

CATALOG_COLS = f"""
  'catalog_db.part_group_' || {vc('p_partkey // 100')} AS table_name,
  'c' || {vc('p_partkey')} AS column_name,
  CASE WHEN p_size <= 10 THEN 'bigint' WHEN p_size <= 20 THEN 'string'
       WHEN p_size <= 30 THEN 'decimal(18,2)' WHEN p_size <= 40 THEN 'date' ELSE 'double' END AS data_type,
  (p_size > 10 AND p_size <= 20) AS is_categorical,
  CASE WHEN p_size > 10 AND p_size <= 20 THEN string_split(p_name, ' ') ELSE {EMPTY} END AS categories"""

CATALOG_FLAT = f"SELECT {CATALOG_COLS} FROM part"
CAT_HOLES = (f"cat AS (SELECT CASE WHEN p_size > 5 THEN table_name ELSE 'gone.' || table_name END AS table_name, "
             f"column_name, data_type, is_categorical, categories FROM (SELECT p_size, {CATALOG_COLS} FROM part))")

CATALOG_PIECES = f"""WITH e AS (SELECT p_partkey, p_size, {CATALOG_COLS} FROM part)
SELECT p_partkey AS doc_id, table_name, column_name, data_type, is_categorical, categories, NULL::VARCHAR AS error FROM e WHERE p_size <> 11
UNION ALL
SELECT p_partkey, table_name, 'x_' || column_name, CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 THEN 'int' END, NULL, NULL,
       CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN 'column of a wrong type' END FROM e WHERE p_size <> 11
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, 'malformed catalog' FROM e WHERE p_size = 11"""

MAPPING_ROWS = f"""m AS (
  SELECT {TXN_ID} AS mapping_id,
         'catalog_db.part_group_' || {vc('l_partkey // 100')} AS source_table,
         'c' || {vc('l_partkey')} AS source_column,
         CASE WHEN l_linestatus = 'F' THEN 'stg.order_' || {vc('l_orderkey')}
              ELSE 'final_db.supplier_' || {vc('l_suppkey')} END AS target_table,
         'line_' || {vc('l_linenumber')} AS target_column,
         CASE WHEN l_returnflag = 'R' THEN NULL
              WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN ''
              WHEN l_returnflag = 'A' THEN '  '
              ELSE 'SUM(li.l_quantity * 0.' || {vc('l_linenumber')} || ') + p.p_retailprice' END AS logic
  FROM lineitem)"""

ENRICH_MAPPING = f"""WITH {CAT_HOLES}, {MAPPING_ROWS}
SELECT m.mapping_id, m.source_table, m.source_column, m.target_table, m.target_column,
       CASE WHEN coalesce(m.logic, '') = '' THEN 'Direct mapping'
            ELSE regexp_replace(m.logic, {ALIAS}, '\\1', 'g') END AS transformation_logic,
       coalesce(c.data_type, '') AS data_type,
       coalesce(c.is_categorical, false) AS is_categorical,
       coalesce(c.categories, {EMPTY}) AS categories
FROM m LEFT JOIN cat c ON m.source_table = c.table_name AND m.source_column = c.column_name"""

DEFAULT_LOGIC = f"""WITH {MAPPING_ROWS}
SELECT mapping_id, CASE WHEN coalesce(logic, '') = '' THEN 'Direct mapping' ELSE logic END AS transformation_logic
FROM m"""

STRIP_ALIAS = f"""
SELECT 'page' AS kind, page_id AS id, regexp_replace(url, {ALIAS}, '\\1', 'g') AS cleaned FROM pages
UNION ALL
SELECT 'document' AS kind, doc_id AS id, regexp_replace(text, {ALIAS}, '\\1', 'g') AS cleaned FROM documents"""

_DOC_STATE = """d AS (
  SELECT o_orderkey AS doc_id, o_custkey, o_orderstatus,
         'final_db.order_summary_' || lower(o_orderstatus) AS tgt,
         CASE o_orderpriority || '/' || o_orderstatus
              WHEN '5-LOW/P' THEN 'malformed document or no mappings list'
              WHEN '5-LOW/F' THEN 'malformed document or no mappings list'
              WHEN '3-MEDIUM/P' THEN 'malformed document or no mappings list'
              WHEN '3-MEDIUM/F' THEN 'malformed document or no mappings list'
              WHEN '2-HIGH/O' THEN 'malformed document or no mappings list'
              WHEN '1-URGENT/F' THEN 'mapping without a required field'
              WHEN '2-HIGH/P' THEN 'field of a wrong type'
              WHEN '2-HIGH/F' THEN 'field of a wrong type' END AS error
  FROM orders)"""

_VALID_ROWS = f"""WITH {_DOC_STATE},
v AS (
  SELECT doc_id, 0 AS pos, 'staging_db.orders' AS source_table, 'o_totalprice' AS source_column, tgt AS target_table,
         'total_' || {vc('o_custkey')} AS target_column, 'SUM(o.o_totalprice)' AS transformation_logic,
         'double' AS data_type, false AS is_categorical, {EMPTY} AS categories FROM d WHERE error IS NULL
  UNION ALL
  SELECT doc_id, 1, 'staging_db.customer', 'c_custkey', tgt, 'customer_id', '', '', false, {EMPTY}
  FROM d WHERE error IS NULL
  UNION ALL
  SELECT doc_id, 2, 'staging_db.orders', 'o_orderstatus', tgt, 'status', 'o.o_orderstatus', 'string', true,
         ['F', 'O', 'P'] FROM d WHERE error IS NULL)"""

MAPPING_VALID = _VALID_ROWS + "\nSELECT * FROM v"
MAPPING_QUARANTINE = f"WITH {_DOC_STATE}\nSELECT doc_id, error FROM d WHERE error IS NOT NULL"
MAPPING_CSV = _VALID_ROWS + """
SELECT doc_id, pos, source_table, source_column, target_table, target_column, transformation_logic, data_type,
       CASE WHEN is_categorical THEN 'True' ELSE 'False' END AS is_categorical,
       array_to_string(categories, ', ') AS categories
FROM v"""

MAPPING_FINAL_ONLY = f"""WITH {MAPPING_ROWS},
sinks AS (SELECT DISTINCT 'final_db.supplier_' || {vc('l_suppkey')} AS dataset FROM lineitem WHERE l_returnflag <> 'R')
SELECT mapping_id, source_table, source_column, target_table, target_column
FROM m WHERE target_table IN (SELECT dataset FROM sinks)"""

_FENCED = f"""w AS (
  SELECT doc_id, CASE lang
      WHEN 'en' THEN '```json' || chr(10) || coalesce(text, '') || chr(10) || '```'
      WHEN 'fr' THEN '  ```' || chr(10) || coalesce(text, '') || chr(10) || '``` ' || chr(10)
      WHEN 'de' THEN chr(9) || chr(10) || coalesce(text, '') || chr(160)
      ELSE coalesce(text, '') || '```' END AS raw
  FROM documents),
s AS (SELECT doc_id, {strip('raw')} AS t FROM w)"""

STRIP_FENCE = f"""WITH {_FENCED}
SELECT doc_id, CASE WHEN starts_with(t, '```')
    THEN {strip("rtrim(" + strip("regexp_replace(t, '^```(json)?', '')") + ", '`')")}
    ELSE t END AS cleaned
FROM s"""

_LINEAGE = f"""li AS (
  SELECT {TXN_ID} || '-' || {vc('CAST(l_shipdate AS DATE)')} AS doc_id, l_orderkey, l_suppkey, l_partkey,
         l_linenumber, l_returnflag, l_linestatus
  FROM lineitem),
steps AS (
  SELECT doc_id, 0 AS step_pos, 'extract' AS step_name, 'stg.order_' || {vc('l_orderkey')} AS output,
         ['l_orderkey', 'l_quantity', 'p_retailprice'] AS cols FROM li
  UNION ALL
  SELECT doc_id, 1, 'load', CASE WHEN l_returnflag = 'R' THEN 'stg.order_' || {vc('l_orderkey')}
                                 ELSE 'final_db.supplier_' || {vc('l_suppkey')} END, ['supplier_total'] FROM li
  UNION ALL
  SELECT doc_id, 2, 'redraw', 'stg.order_' || {vc('l_orderkey')}, ['l_orderkey'] FROM li WHERE l_linenumber = 1),
srcs AS (
  SELECT doc_id, 0 AS step_pos, 0 AS source_pos, 'src.lineitem' AS name,
         ['l_orderkey', 'l_partkey', 'l_quantity'] AS cols FROM li
  UNION ALL
  SELECT doc_id, 0, 1, 'catalog_db.part_group_' || {vc('l_partkey // 100')},
         CASE WHEN l_linestatus = 'F' THEN NULL ELSE ['p_partkey', 'p_retailprice'] END FROM li
  UNION ALL
  SELECT doc_id, 1, 0, 'stg.order_' || {vc('l_orderkey')}, ['l_quantity'] FROM li
  UNION ALL
  SELECT doc_id, 2, 0, 'src.lineitem', ['l_orderkey'] FROM li WHERE l_linenumber = 1)"""

LINEAGE_EDGES = f"""WITH {_LINEAGE}
SELECT s.doc_id, s.step_pos, s.source_pos, st.step_name, s.name AS source, st.output
FROM srcs s JOIN steps st ON s.doc_id = st.doc_id AND s.step_pos = st.step_pos"""

LINEAGE_NODES = f"""WITH {_LINEAGE},
cand AS (
  SELECT doc_id, output AS dataset, cols AS columns, 0 AS kind, -step_pos AS a, 0 AS b FROM steps
  UNION ALL
  SELECT doc_id, name, coalesce(cols, {EMPTY}), 1, step_pos, source_pos FROM srcs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, dataset ORDER BY kind, a, b) AS rn FROM cand)
SELECT doc_id, dataset, CASE WHEN kind = 0 THEN 'output' ELSE 'source' END AS drawn_as, columns
FROM ranked WHERE rn = 1"""

LINEAGE_COLUMNS = f"""WITH {_LINEAGE}
SELECT doc_id, step_pos, output AS dataset, 'write' AS role,
       CAST(generate_subscripts(cols, 1) - 1 AS INTEGER) AS col_pos, unnest(cols) AS column_name FROM steps
UNION ALL
SELECT doc_id, step_pos, name, 'read', CAST(generate_subscripts(coalesce(cols, {EMPTY}), 1) - 1 AS INTEGER),
       unnest(coalesce(cols, {EMPTY})) FROM srcs"""

_TREE = f"""e AS (
  SELECT 'ds_' || {vc('p_partkey')} AS source, 'ds_' || {vc('p_partkey // 3')} AS output
  FROM part WHERE p_partkey // 3 <> p_partkey)"""

LINEAGE_ROOTS = f"""WITH {_TREE}
SELECT DISTINCT source AS dataset, 'base' AS role FROM e WHERE source NOT IN (SELECT output FROM e)
UNION ALL
SELECT DISTINCT output AS dataset, 'sink' AS role FROM e WHERE output NOT IN (SELECT source FROM e)"""

LINEAGE_CLOSURE = f"""WITH RECURSIVE {_TREE},
b AS (SELECT DISTINCT source FROM e WHERE source NOT IN (SELECT output FROM e)),
r(dataset, base) AS (
  SELECT e.output, e.source FROM e JOIN b ON e.source = b.source
  UNION
  SELECT e.output, r.base FROM r JOIN e ON r.dataset = e.source)
SELECT dataset, base FROM r"""


_LINE = """e AS (
  SELECT DISTINCT source, output FROM (
    SELECT 'ord_' || l_orderkey || '_' || (l_linenumber - 1) AS source, 'ord_' || l_orderkey || '_' || l_linenumber AS output FROM lineitem
    UNION ALL SELECT 'raw_' || l_suppkey, 'ord_' || l_orderkey || '_' || l_linenumber FROM lineitem
    UNION ALL SELECT 'ord_' || l_orderkey || '_' || l_linenumber, 'ord_' || l_orderkey || '_1' FROM lineitem WHERE l_quantity > 45)),
r(dataset, node) AS (
  SELECT output, source FROM e
  UNION
  SELECT r.dataset, e.source FROM r JOIN e ON r.node = e.output)"""

LINEAGE_CYCLES = f"""WITH RECURSIVE {_LINE}
SELECT a.dataset, min(a.node) AS component FROM r a JOIN r b ON a.dataset = b.node AND a.node = b.dataset GROUP BY a.dataset"""

LINEAGE_CYCLIC_CLOSURE = f"""WITH RECURSIVE {_LINE}
SELECT dataset, node AS base FROM r WHERE node NOT IN (SELECT output FROM e)"""


def _script_rows(which: int, rows: list[tuple[str, int, str]]) -> list[str]:
    return [f"SELECT doc_id, '{role}' AS role, {block} AS block_no, {name} AS dataset FROM documents WHERE doc_id % 4 = {which}"
            for role, block, name in rows]


_STAGING = "'staging_' || lang || '.events_' || source"
_LAYER = f"'layer_' || {vc('doc_id')}"
_REPORT = "'final_db.report_' || source"
SCRIPT_REFS = "\nUNION ALL ".join(
    _script_rows(0, [("read", 1, _STAGING), ("read", 1, "'core_db.dim_' || lang"), ("write", 1, _LAYER),
                     ("read", 2, _LAYER), ("read", 2, "'core_db.keys'"), ("write", 2, _REPORT)])
    + _script_rows(1, [("write", 1, _LAYER), ("read", 1, _STAGING), ("read", 2, _LAYER),
                       ("write", 2, "'core_db.copy_' || source"), ("write", 3, _REPORT),
                       ("read", 3, "'core_db.copy_' || source"), ("read", 3, "'core_db.keys'")])
    + _script_rows(2, [("read", 1, _STAGING), ("read", 1, "'lake.core_db.dim_' || lang"), ("write", 1, _REPORT)])
    + _script_rows(3, [("read", 1, _STAGING), ("write", 1, _LAYER), ("read", 2, "'core_db.keys'"), ("read", 2, _LAYER),
                       ("write", 2, "'core_db.out_' || source")]))

LINEAGE_MISSING = """
SELECT doc_id, 'core_db.keys' AS dataset FROM documents WHERE doc_id % 4 <> 2
UNION ALL SELECT doc_id, 'core_db.dim_' || lang FROM documents WHERE doc_id % 4 = 0 AND lang <> 'en'
UNION ALL SELECT doc_id, 'core_db.copy_' || source FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 'lake.core_db.dim_' || lang FROM documents WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, 'core_db.out_' || source FROM documents WHERE doc_id % 4 = 3"""

_ANSWER_STATE = """a AS (
  SELECT o_orderkey AS doc_id, CASE o_orderpriority || '/' || o_orderstatus
      WHEN '5-LOW/P' THEN 'malformed document or no steps list' WHEN '5-LOW/O' THEN 'malformed document or no steps list'
      WHEN '5-LOW/F' THEN 'malformed document or no steps list' WHEN '2-HIGH/P' THEN 'field of a wrong type'
      WHEN '2-HIGH/F' THEN 'field of a wrong type' WHEN '2-HIGH/O' THEN 'step without output or source without name'
      END AS error
  FROM orders)"""
LINEAGE_QUARANTINE = f"WITH {_ANSWER_STATE}\nSELECT doc_id, error FROM a WHERE error IS NOT NULL"
LINEAGE_JSON = f"""WITH {_ANSWER_STATE}
SELECT doc_id, '{{"steps":[{{"name":"s","output":"final_db.order_' || {vc('doc_id')}
    || '","columns":["a","b"],"sources":[{{"name":"stg.orders","columns":["a"]}}]}}]}}' AS text
FROM a WHERE error IS NULL"""

_FIELDS = ("source_table", "source_column", "target_table", "target_column", "transformation_logic", "data_type")
MAPPING_JSON = _VALID_ROWS + f"""
SELECT doc_id, '{{"mappings":[' || string_agg('{{' || {" || ',' || ".join(f"'{chr(34)}{c}{chr(34)}:{chr(34)}' || {c} || '{chr(34)}'" for c in _FIELDS)}
    || ',"is_categorical":' || CASE WHEN is_categorical THEN 'true' ELSE 'false' END || ',"categories":['
    || array_to_string(list_transform(categories, lambda v: '"' || v || '"'), ',') || ']}}', ',' ORDER BY pos) || ']}}' AS text
FROM v GROUP BY doc_id"""
CSV_ROUND_TRIP = _VALID_ROWS + """
SELECT * REPLACE (transformation_logic || chr(10) || '  -- "as is", ' || target_column AS transformation_logic) FROM v"""
MAPPING_COUNT = f"WITH {MAPPING_ROWS}\nSELECT target_table, count(*) AS mappings FROM m GROUP BY target_table"

WRITTEN_COUNTS = _VALID_ROWS + """
SELECT unnest(['csv', 'json']) AS artefact, (SELECT count(*) FROM v) AS mappings"""
CSV_FILES = CSV_ROUND_TRIP.replace("SELECT * REPLACE", "SELECT * EXCLUDE (doc_id, pos) REPLACE")

RULE_FLATTEN = f"""WITH a AS (
  SELECT 'docs.' || lang AS source_table, source AS source_column, 'dq.' || lang AS target_table,
         'doc_' || {vc('doc_id')} AS target_column,
         array_to_string(list_transform(string_split(text, chr(10)),
             lambda x, i: {vc('i')} || CASE WHEN (i - 1) % 2 = 0 THEN '. ' ELSE ') ' END || x), chr(10)) AS raw,
         CASE WHEN source = 'src0' THEN 'rate limited' END AS error
  FROM documents),
r AS (
  SELECT source_table, source_column, target_table, target_column,
         CASE WHEN error IS NOT NULL THEN ['[ERROR] ' || error]
              ELSE list_transform(
                  list_filter(regexp_split_to_array({strip('raw')}, '\\n+'), lambda x: {strip('x')} <> ''),
                  lambda x: regexp_replace({strip('x')}, {NUMBERING}, '')) END AS rules
  FROM a)
SELECT source_table, source_column, target_table, target_column,
       CAST(generate_subscripts(rules, 1) AS INTEGER) AS rule_no, unnest(rules) AS rule
FROM r"""

def _csv_cell(c: str) -> str:
    return f"""CASE WHEN {c} LIKE '%,%' OR {c} LIKE '%"%' OR contains({c}, chr(10)) OR contains({c}, chr(13))
      THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


RULES_CSV = f"""SELECT target_column, rule_no, {" || ',' || ".join(_csv_cell(c) for c in ("source_table", "source_column", "target_table", "target_column", "rule"))} AS line
FROM ({RULE_FLATTEN}) f"""

_NUMERIC = "(dtype IN ('tinyint', 'int', 'bigint', 'double') OR starts_with(dtype, 'decimal('))"
_KEYS = "source_table, source_column, target_table, target_column"
DQ_RULES = f"""WITH {CAT_HOLES},
m0 AS (
  SELECT 'catalog_db.part_group_' || {vc('p_partkey // 100')} AS source_table,
         'c' || {vc('p_partkey')} AS source_column,
         'catalog_db.part_group_' || {vc('(p_partkey // 2) // 100')} AS target_table,
         CASE WHEN p_size > 45 THEN 'c' || {vc('p_partkey // 2')} || '_id' ELSE 'c' || {vc('p_partkey // 2')} END
           AS target_column,
         CASE WHEN p_retailprice < 1200 THEN 'Direct mapping' WHEN p_retailprice < 1600 THEN 'SUM(x.amount)'
              ELSE 'coalesce(y.v, 0)' END AS logic
  FROM part),
m AS (
  SELECT m0.*, regexp_replace(logic, {ALIAS}, '\\1', 'g') AS tl,
         coalesce(s.data_type, '') AS sdt, coalesce(s.is_categorical, false) AS scat,
         coalesce(s.categories, {EMPTY}) AS sdom
  FROM m0 LEFT JOIN cat s ON m0.source_table = s.table_name AND m0.source_column = s.column_name),
x AS (
  SELECT m.*,
         coalesce(t.data_type, CASE WHEN tl = 'Direct mapping' AND sdt <> '' THEN sdt END) AS dtype,
         coalesce(t.is_categorical, CASE WHEN tl = 'Direct mapping' THEN scat END, false) AS is_cat,
         coalesce(t.categories, CASE WHEN tl = 'Direct mapping' THEN sdom END, {EMPTY}) AS dom,
         (starts_with(upper(ltrim(tl)), 'COUNT') OR starts_with(upper(ltrim(tl)), 'SUM')
          OR starts_with(upper(ltrim(tl)), 'AVG')) AS agg
  FROM m LEFT JOIN cat t ON m.target_table = t.table_name AND m.target_column = t.column_name)
SELECT {_KEYS}, 'completeness' AS kind, target_column || ' IS NOT NULL' AS rule, CAST(NULL AS VARCHAR) AS argument FROM x
UNION ALL SELECT {_KEYS}, 'domain', target_column || ' IN ('
    || array_to_string(list_transform(dom, lambda v: chr(39) || replace(v, chr(39), chr(39) || chr(39)) || chr(39)), ', ') || ')',
    '[' || array_to_string(list_transform(dom, lambda v: '"' || v || '"'), ',') || ']' FROM x
    WHERE is_cat AND len(dom) > 0
UNION ALL SELECT {_KEYS}, 'not_future', target_column || ' <= DATE ''{P.as_of.isoformat()}''', '{P.as_of.isoformat()}' FROM x
    WHERE dtype = 'date'
UNION ALL SELECT {_KEYS}, 'non_negative', target_column || ' >= 0', NULL FROM x WHERE {_NUMERIC} AND agg
UNION ALL SELECT {_KEYS}, 'type', 'try_cast(' || target_column || ' AS ' || dtype || ') IS NOT NULL', dtype FROM x
    WHERE {_NUMERIC} AND NOT agg
UNION ALL SELECT {_KEYS}, 'not_blank', 'length(trim(' || target_column || ')) > 0', NULL FROM x
    WHERE dtype = 'string' AND NOT is_cat
UNION ALL SELECT {_KEYS}, 'catalog', source_table || '.' || source_column || ' is listed in the catalog',
    source_table || '.' || source_column FROM x WHERE dtype IS NULL
UNION ALL SELECT {_KEYS}, 'reference', target_column || ' exists in ' || source_table || '.' || source_column,
    source_table || '.' || source_column FROM x WHERE ends_with(target_column, '_id') AND tl = 'Direct mapping'"""


def _row_rule(name: str, ok: str) -> str:
    return (f"SELECT '{name}' AS rule, CAST(SUM(CASE WHEN coalesce({ok}, false) THEN 0 ELSE 1 END) AS BIGINT) "
            "AS bad, COUNT(*) AS total FROM b_transaction")


DQ_ROW_CHECKS = f"WITH {bank_ctes(P)}\n" + "\nUNION ALL ".join([
    *[_row_rule(f"{c}_completeness", f"{c} IS NOT NULL")
      for c in ("account_id", "merchant_id", "txn_id", "amount", "txn_type", "txn_date")],
    _row_rule("txn_type_domain", "txn_type IN ('DEBIT', 'CREDIT')"),
    _row_rule("txn_date_not_future", f"txn_date <= DATE '{P.as_of.isoformat()}'"),
    _row_rule("amount_non_negative", "amount >= 0"),
    _row_rule("account_id_type", "TRY_CAST(account_id AS BIGINT) IS NOT NULL"),
    _row_rule("merchant_id_type", "TRY_CAST(merchant_id AS BIGINT) IS NOT NULL"),
    _row_rule("txn_id_type", "TRY_CAST(txn_id AS BIGINT) IS NOT NULL"),
])


def _ref_rule(name: str, key: str, parent: str) -> str:
    return (f"SELECT '{name}' AS rule, CAST(COUNT(*) FILTER (WHERE {key} IS NOT NULL AND {key} NOT IN "
            f"(SELECT k FROM {parent} WHERE k IS NOT NULL)) AS BIGINT) AS bad, COUNT(*) AS total FROM b_transaction")


DQ_REFERENTIAL = (f"WITH {bank_ctes(P)},\n"
                  "pk_orders AS (SELECT o_orderkey AS k FROM orders),\n"
                  "pk_merch AS (SELECT merchant_id AS k FROM b_merchant_dim),\n"
                  "pk_live AS (SELECT account_id AS k FROM b_account)\n"
                  + "\nUNION ALL ".join([
                      _ref_rule("account_id_reference_core_db.all_accounts.account_id", "account_id", "pk_orders"),
                      _ref_rule("merchant_id_reference_core_db.merchant_dim.merchant_id", "merchant_id", "pk_merch"),
                      _ref_rule("account_id_reference_staging_db.account.account_id", "account_id", "pk_live")]))

"""Inputs of the mapping, lineage and DQ operators, derived by Spark from the
driver's tables, one output row per input row (no grouping), so each grows
with its table:

* catalog documents: one JSON catalog document per ``part`` row
  (table ``catalog_db.part_group_<partkey div 100>``, column ``c<partkey>``);
* mapping rows: one per ``lineitem`` row, pointing at that catalog;
* mapping documents: one JSON ``{"mappings": [..]}`` per ``orders`` row, some
  of them damaged the way a model answer can be;
* lineage documents: one per ``lineitem`` row (extract, load and sometimes a
  redraw step);
* a lineage tree over ``part`` (``k -> k div 3``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.bank import txn_key

S = F.lit


def _s(c) -> Column:
    return F.col(c).cast("string")


# ---------------------------------------------------------------- catalog

def catalog_table_of(partkey_col: str) -> Column:
    return F.concat(S("catalog_db.part_group_"), F.expr(f"{partkey_col} div 100").cast("string"))


def catalog_entries(part: DataFrame) -> DataFrame:
    """(table_name, column_name, data_type, is_categorical, categories) per part."""
    size = F.col("p_size")
    dtype = (F.when(size <= 10, "bigint").when(size <= 20, "string")
             .when(size <= 30, "decimal(18,2)").when(size <= 40, "date").otherwise("double"))
    categorical = (size > 10) & (size <= 20)
    return part.select(
        "p_partkey", "p_size",
        catalog_table_of("p_partkey").alias("table_name"),
        F.concat(S("c"), _s("p_partkey")).alias("column_name"),
        dtype.alias("data_type"), categorical.alias("is_categorical"),
        F.when(categorical, F.split("p_name", " "))
        .otherwise(F.array().cast("array<string>")).alias("categories"))


def catalog_documents(part: DataFrame) -> DataFrame:
    """(doc_id, value): a catalog document holding one table with one column."""
    e = catalog_entries(part)
    meta = F.struct("data_type", "is_categorical", "categories")
    doc = F.to_json(F.create_map(F.col("table_name"), F.create_map(F.col("column_name"), meta)))
    return e.select(F.col("p_partkey").alias("doc_id"), doc.alias("value"))


def damaged_catalogs(part: DataFrame) -> DataFrame:
    """(doc_id, value): a catalog document of one table with two columns per part; the
    second one has a number for a data type if the part's size is a multiple of 5, is a
    text if it is one of 7. Documents of parts of size 11 are cut short."""
    e = catalog_entries(part)
    good = F.to_json(F.struct("data_type", "is_categorical", "categories"))
    second = F.when(F.col("p_size") % 5 == 0, '{"data_type":5}').when(F.col("p_size") % 7 == 0, '"int"').otherwise('{"data_type":"int"}')
    doc = F.concat(S('{"'), F.col("table_name"), S('":{"'), F.col("column_name"), S('":'), good, S(',"x_'), F.col("column_name"),
                   S('":'), second, F.when(F.col("p_size") == 11, "").otherwise("}}"))
    return e.select(F.col("p_partkey").alias("doc_id"), doc.alias("value"))


# ---------------------------------------------------------------- mapping rows

def mapping_rows(lineitem: DataFrame) -> DataFrame:
    """Model-extracted mapping rows (before enrichment), one per line item."""
    logic = (F.when(F.col("l_returnflag") == "R", S(None).cast("string"))
             .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), S(""))
             .when(F.col("l_returnflag") == "A", S("  "))
             .otherwise(F.concat(S("SUM(li.l_quantity * 0."), _s("l_linenumber"),
                                 S(") + p.p_retailprice"))))
    target = F.when(F.col("l_linestatus") == "F",
                    F.concat(S("stg.order_"), _s("l_orderkey"))).otherwise(
        F.concat(S("final_db.supplier_"), _s("l_suppkey")))
    return lineitem.select(
        txn_key().alias("mapping_id"),
        catalog_table_of("l_partkey").alias("source_table"),
        F.concat(S("c"), _s("l_partkey")).alias("source_column"),
        target.alias("target_table"),
        F.concat(S("line_"), _s("l_linenumber")).alias("target_column"),
        logic.alias("transformation_logic"),
        S("string").alias("data_type"), S(True).alias("is_categorical"),
        F.array(S("x")).alias("categories"))


# ---------------------------------------------------------------- mapping documents

def mapping_documents(orders: DataFrame) -> DataFrame:
    """(doc_id, text) with three mappings per order, damaged in the ways in
    which a model's answer can be: 5-LOW/P an unbalanced brace, 5-LOW/F prose
    behind the JSON, 3-MEDIUM/P two values in a row, 3-MEDIUM/F single quotes,
    1-URGENT/F a mapping without target_column, 2-HIGH/O no mappings list,
    2-HIGH/P a flag that is a text, 2-HIGH/F a table name that is a number."""
    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    none = S(None).cast("string")

    def m(st, sc, tt, tc, logic, dt, cat, dom):
        return F.struct(st.alias("source_table"), sc.alias("source_column"),
                        tt.alias("target_table"), tc.alias("target_column"),
                        logic.alias("transformation_logic"), dt.alias("data_type"),
                        cat.alias("is_categorical"), dom.alias("categories"))

    target = F.concat(S("final_db.order_summary_"), F.lower(status))
    m1 = m(S("staging_db.orders"), S("o_totalprice"), target,
           F.concat(S("total_"), _s("o_custkey")), S("SUM(o.o_totalprice)"),
           S("double"), S(False).cast("boolean"), F.array().cast("array<string>"))
    lost = (prio == "1-URGENT") & (status == "F")
    m2 = m(S("staging_db.customer"), S("c_custkey"), target,
           F.when(lost, none).otherwise(S("customer_id")), S(""), none,
           S(None).cast("boolean"), S(None).cast("array<string>"))
    m3 = m(S("staging_db.orders"), S("o_orderstatus"), target, S("status"),
           S("o.o_orderstatus"), S("string"), S(True), F.array(S("F"), S("O"), S("P")))
    body = F.to_json(F.struct(F.array(m1, m2, m3).alias("mappings")))
    is_ = lambda p, s: (prio == p) & (status == s)
    text = (F.when(is_("5-LOW", "P"), F.concat(S("{"), body))
            .when(is_("5-LOW", "F"), F.concat(body, S("\nI hope this helps.")))
            .when(is_("3-MEDIUM", "P"), F.concat(body, S("\n"), body))
            .when(is_("3-MEDIUM", "F"), F.translate(body, '"', "'"))
            .when(is_("2-HIGH", "P"), F.replace(body, S('"is_categorical":true'), S('"is_categorical":"maybe"')))
            .when(is_("2-HIGH", "F"), F.replace(body, S('"source_table":"staging_db.customer"'), S('"source_table":5')))
            .when((prio == "2-HIGH") & (status == "O"), F.to_json(F.struct(S("none").alias("note"))))
            .otherwise(body))
    return orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


# ---------------------------------------------------------------- lineage

def lineage_documents(lineitem: DataFrame) -> DataFrame:
    """(doc_id, text): lineage document per line item.

    extract: stg.order_<o> from src.lineitem and the part group table;
    load: final_db.supplier_<s> (or stg.order_<o> itself for returned lines)
    from stg.order_<o>; lines with linenumber 1 redraw stg.order_<o> with
    fewer columns; lines with status F list the part source without columns.
    """
    stg = F.concat(S("stg.order_"), _s("l_orderkey"))
    final = F.concat(S("final_db.supplier_"), _s("l_suppkey"))
    part = catalog_table_of("l_partkey")

    def named(field, value, end=','):
        """A member whose value needs no escapes; nothing for a null, as in to_json."""
        return F.coalesce(F.concat(S(f'"{field}":"'), value, S(f'"{end}')), S(""))

    # put together as text, which costs less than structures written by to_json
    part_src = F.when(F.col("l_linestatus") == "F", named("name", part, "")).otherwise(
        F.concat(named("name", part), S('"columns":["p_partkey","p_retailprice"]')))
    text = F.concat(
        S('{"steps":[{"name":"extract",'), named("output", stg),
        S('"columns":["l_orderkey","l_quantity","p_retailprice"],"sources":[{"name":"src.lineitem",'
          '"columns":["l_orderkey","l_partkey","l_quantity"]},{'), part_src,
        S('}]},{"name":"load",'), named("output", F.when(F.col("l_returnflag") == "R", stg).otherwise(final)),
        S('"columns":["supplier_total"],"sources":[{'), named("name", stg), S('"columns":["l_quantity"]}]}'),
        F.when(F.col("l_linenumber") == 1, F.concat(
            S(',{"name":"redraw",'), named("output", stg),
            S('"columns":["l_orderkey"],"sources":[{"name":"src.lineitem","columns":["l_orderkey"]}]}'))).otherwise(""),
        S("]}"))
    # the four-part key repeats once at sf0.001; the ship date separates it
    doc_id = F.concat_ws("-", txn_key(), F.col("l_shipdate").cast("date").cast("string"))
    return lineitem.select(doc_id.alias("doc_id"), text.alias("text"))


def lineage_tree_edges(part: DataFrame) -> DataFrame:
    """(source, output): ds_<k> feeds ds_<k div 3>; no self edge."""
    k = F.col("p_partkey")
    parent = F.expr("p_partkey div 3")
    return part.where(parent != k).select(
        F.concat(S("ds_"), k.cast("string")).alias("source"),
        F.concat(S("ds_"), parent.cast("string")).alias("output"))


def lineage_line_edges(lineitem: DataFrame) -> DataFrame:
    """(source, output): a dataset per order line, which reads the line before it
    and its supplier's table; a line of more than 45 pieces is read by the
    order's first line too, which makes a cycle (of one, if it is the first)."""
    def line(n):
        return F.concat(S("ord_"), _s("l_orderkey"), S("_"), n.cast("string"))

    n = F.col("l_linenumber")
    read = [line(n - 1), F.concat(S("raw_"), _s("l_suppkey"))]
    edges = F.array(*(F.struct(c.alias("source"), line(n).alias("output")) for c in read),
                    F.when(F.col("l_quantity") > 45, F.struct(line(n).alias("source"), line(F.lit(1)).alias("output"))))
    return lineitem.select(F.explode(edges).alias("e")).where("e IS NOT NULL").select("e.*")


def lineage_answers(orders: DataFrame) -> DataFrame:
    """(doc_id, text): raw lineage answers per order. 1-URGENT in a code fence;
    damaged: 5-LOW/P prose behind the JSON, 5-LOW/O two values, 5-LOW/F single
    quotes, 2-HIGH/P columns that are a number, 2-HIGH/F sources that are a text,
    2-HIGH/O a step without output."""
    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    output = F.concat(S('"output":"final_db.order_'), _s("o_orderkey"), S('",'))

    def doc(output=output, columns='["a","b"]', sources='[{"name":"stg.orders","columns":["a"]}]'):
        return F.concat(S('{"steps":[{"name":"s",'), output, S(f'"columns":{columns},"sources":{sources}}}]}}'))

    is_ = lambda p, s: (prio == p) & (status == s)
    text = (F.when(prio == "1-URGENT", F.concat(S("```json\n"), doc(), S("\n```")))
            .when(is_("5-LOW", "P"), F.concat(doc(), S(" Done.")))
            .when(is_("5-LOW", "O"), F.concat(doc(), doc()))
            .when(is_("5-LOW", "F"), F.translate(doc(), '"', "'"))
            .when(is_("2-HIGH", "P"), doc(columns="5"))
            .when(is_("2-HIGH", "F"), doc(sources='"stg.orders"'))
            .when(is_("2-HIGH", "O"), doc(output=S("")))
            .otherwise(doc()))
    return orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


# ---------------------------------------------------------------- scripts

def _fill(template: str) -> Column:
    """A template with <lang>, <src> and <id> filled in from the row."""
    fields = {"<lang>": F.col("lang"), "<src>": F.col("source"), "<id>": _s("doc_id")}
    return F.concat(*[fields.get(x, S(x)) for x in re.split("(<lang>|<src>|<id>)", template) if x])


SCRIPTS = (
    # f-strings with database variables, views and tables from data frames
    '''from jobs import spark
base = "staging_<lang>"
core = 'core_db'      # FROM here.nothing
a = spark.sql(f"""SELECT x.k, y.v
    FROM {base}.events_<src> x LEFT JOIN {core}.dim_<lang> y ON x.k = y.k""")
a.createOrReplaceTempView("layer_<id>")
b = spark.sql("""SELECT * FROM layer_<id> JOIN core_db.keys USING (k)""")
b.write.mode("overwrite").saveAsTable("final_db.report_<src>")
''',
    # statements without a data frame, a table read by name, a list of tables
    '''spark.sql("CREATE OR REPLACE TEMP VIEW layer_<id> AS SELECT * FROM staging_<lang>.events_<src>")
spark.table("layer_<id>").write.mode("overwrite").saveAsTable("core_db.copy_<src>")
spark.sql("""INSERT INTO final_db.report_<src>
             SELECT * FROM core_db.copy_<src> c, core_db.keys k""")
''',
    # WITH queries, back quotes, three-part names, comments, literals, FROM in a function
    '''c = spark.sql("""
WITH recent AS (SELECT * FROM `staging_<lang>`.`events_<src>` -- FROM dead.code
), named AS (SELECT * FROM recent, lake.core_db.dim_<lang> d)
SELECT EXTRACT(YEAR FROM n.day) AS y, 'FROM text.literal' AS t FROM named n /* JOIN old.tbl o */""")
c.write.saveAsTable("final_db.report_<src>")
''',
    # one data frame and one variable used twice
    '''db = "staging_<lang>"
df = spark.sql(f"SELECT * FROM {db}.events_<src>")
df.createOrReplaceTempView("layer_<id>")
db = "core_db"
df = spark.sql(f"SELECT * FROM {db}.keys WHERE k IN (SELECT k FROM layer_<id>)")
df.write.insertInto(f"{db}.out_<src>")
''',
)


def _script(comment: Column) -> Column:
    which = F.pmod(F.col("doc_id"), S(len(SCRIPTS)))
    out = _fill(SCRIPTS[0])
    for i, template in enumerate(SCRIPTS):
        out = F.when(which == i, _fill(template)).otherwise(out)
    return F.concat(out, comment, S("\n"))


def scripts_from_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text): a pipeline script per document, by one of the templates;
    the whole document text follows as a comment (it must not yield references)."""
    comment = F.regexp_replace(F.coalesce(F.col("text"), S("")), "(?m)^", "# ")
    return documents.select("doc_id", _script(comment).alias("text"))


def scripts_with_lineage(documents: DataFrame) -> DataFrame:
    """(doc_id, text, lineage): each script with a lineage answer that names the
    dimension only for English documents and never ``core_db.keys``."""
    comment = F.regexp_replace(F.coalesce(F.col("text"), S("")), "(?m)^", "# ")
    lang, src, i = F.col("lang"), F.col("source"), _s("doc_id")
    layer = F.concat(S("layer_"), i)
    staging = F.struct(F.concat(S("staging_"), lang, S(".events_"), src).alias("name"))
    dim = F.struct(F.concat(S("core_db.dim_"), lang).alias("name"))
    first = F.struct(S("df").alias("name"), layer.alias("output"),
                     F.when(lang == "en", F.array(staging, dim)).otherwise(F.array(staging)).alias("sources"))
    second = F.struct(S("out").alias("name"), F.concat(S("final_db.report_"), src).alias("output"),
                      F.array(F.struct(layer.alias("name"))).alias("sources"))
    answer = F.to_json(F.struct(F.array(first, second).alias("steps")))
    return documents.select("doc_id", _script(comment).alias("text"), answer.alias("lineage"))


# ---------------------------------------------------------------- DQ inputs

def rule_answers(documents: DataFrame) -> DataFrame:
    """Model answers for rule generation: each document with its lines
    numbered ``1. ``, ``2) ``, ..; documents of source src0 failed."""
    numbered = F.array_join(F.transform(
        F.split(F.col("text"), "\n"),
        lambda x, i: F.concat((i + 1).cast("string"),
                              F.when(i % 2 == 0, S(". ")).otherwise(S(") ")), x)), "\n")
    return documents.select(
        F.concat(S("docs."), F.col("lang")).alias("source_table"),
        F.col("source").alias("source_column"),
        F.concat(S("dq."), F.col("lang")).alias("target_table"),
        F.concat(S("doc_"), _s("doc_id")).alias("target_column"),
        numbered.alias("raw"),
        F.when(F.col("source") == "src0", S("rate limited")).alias("error"))


def dq_mapping_rows(part: DataFrame) -> DataFrame:
    """Mapping rows from part: source c<k>, target c<k div 2> (``_id`` suffix
    for the largest parts), logic by price band."""
    half = F.expr("p_partkey div 2").cast("string")
    price = F.col("p_retailprice")
    return part.select(
        catalog_table_of("p_partkey").alias("source_table"),
        F.concat(S("c"), _s("p_partkey")).alias("source_column"),
        F.concat(S("catalog_db.part_group_"), F.expr("(p_partkey div 2) div 100").cast("string"))
        .alias("target_table"),
        F.when(F.col("p_size") > 45, F.concat(S("c"), half, S("_id")))
        .otherwise(F.concat(S("c"), half)).alias("target_column"),
        F.when(price < 1200, S("Direct mapping")).when(price < 1600, S("SUM(x.amount)"))
        .otherwise(S("coalesce(y.v, 0)")).alias("transformation_logic"))


def fenced_answers(documents: DataFrame) -> DataFrame:
    """Raw answers wrapped as models do: en in a ```json fence, fr in a bare
    fence with stray blanks, de with tab/no-break-space padding, es with
    trailing backticks only (no opening fence, so they stay)."""
    t, lang = F.coalesce(F.col("text"), S("")), F.col("lang")
    wrapped = (F.when(lang == "en", F.concat(S("```json\n"), t, S("\n```")))
               .when(lang == "fr", F.concat(S("  ```\n"), t, S("\n``` \n")))
               .when(lang == "de", F.concat(S("\t\n"), t, S("\u00a0")))
               .otherwise(F.concat(t, S("```"))))
    return documents.select("doc_id", wrapped.alias("text"))

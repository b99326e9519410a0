"""Sinks: databases and managed tables (S3, S5, S6), rule CSV (S13),
lineage JSON (S14)."""

import csv
import glob
import json
import os

import pytest

from bank_fixture import spark_views
from tessera.operators import layers as L
from tessera.operators import lineage as LN
from tessera.operators import quality as Q
from tessera.params import DEFAULT
from tessera.sources import sinks


def test_databases_and_summary_table(spark):
    sinks.ensure_databases(spark)
    assert {"staging_db", "core_db", "final_db"} <= {r[0] for r in spark.sql("SHOW DATABASES").collect()}
    v = spark_views(spark)
    sinks.save_table(v.customer, "staging_db.customer")                  # S5 seed write
    summary = L.customer_summary(v, DEFAULT)
    L.save_summary(summary)                                               # S3
    L.save_summary(summary)                                               # overwrite, not append
    assert spark.table("final_db.customer_summary").count() == summary.count()
    assert spark.table("staging_db.customer").count() == 4


def test_rules_csv(spark, tmp_out):
    answers = spark.createDataFrame(
        [("s", "c", "t", "x", "1. a, with comma\n2) \"quoted\"", None)],
        "source_table string, source_column string, target_table string, target_column string, "
        "raw string, error string")
    path = os.path.join(tmp_out, "rules")
    sinks.write_rules_csv(Q.flatten_rules(answers), path)
    rows = []
    for f in sorted(glob.glob(os.path.join(path, "*.csv"))):
        with open(f, newline="", encoding="utf-8") as fh:
            rows += list(csv.DictReader(fh))
    assert [r["rule"] for r in rows] == ["a, with comma", '"quoted"']
    assert list(rows[0]) == ["source_table", "source_column", "target_table", "target_column", "rule"]


def test_lineage_json(spark, tmp_out):
    doc = {"steps": [{"name": "s", "output": "o", "columns": ["c"], "sources": [{"name": "i", "columns": ["c"]}]}]}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, "{bad")], "doc_id int, text string")
    path = os.path.join(tmp_out, "lineage")
    bad = os.path.join(tmp_out, "quarantine")
    sinks.write_lineage_json(LN.parse_lineage(docs), path, quarantine_path=bad)
    assert [(r.doc_id, r.text) for r in spark.read.json(bad).collect()] == [(2, "{bad")]
    lines = [json.loads(ln) for f in glob.glob(os.path.join(path, "part-*")) for ln in open(f, encoding="utf-8")]
    assert len(lines) == 1 and lines[0]["steps"][0]["output"] == "o"
    with pytest.raises(Exception, match="malformed"):
        sinks.write_lineage_json(LN.parse_lineage(docs), path)


def test_layers_from_catalog_tables(spark):
    """The job over saved tables equals the job over views."""
    from tessera.sources.bank import BankViews
    sinks.ensure_databases(spark)
    v = spark_views(spark)
    for name, df in vars(v).items():
        core = name in ("archived_customer", "archived_account", "archived_transaction", "segmentation_rules", "customer_region",
                        "product_dim", "branch_dim", "merchant_dim", "fraud_flags", "credit_bureau", "sanctions_list", "risk_assessment")
        sinks.save_table(df, f"{'core_db' if core else 'staging_db'}.{name}")
    saved = BankViews.from_catalog(spark)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(L.customer_summary(saved, DEFAULT)) == key(L.customer_summary(v, DEFAULT))

"""Mapping (STM) operators: catalog flattening, enrichment defaults,
document validation, CSV/JSON round trips."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import mapping as M
from tessera.sources import sinks

# a small catalog in the original's format (fixed values of our own)
CATALOG = {
    "staging_db.customer": {
        "customer_id": {"data_type": "bigint", "is_categorical": False, "categories": []},
        "segment": {"data_type": "string", "is_categorical": True,
                    "categories": ["BRONZE", "SILVER", "GOLD", "PLATINUM", "UNKNOWN"]},
    },
    "final_db.customer_summary": {
        "total_debit": {"data_type": "decimal(18,2)", "is_categorical": False, "categories": []},
        "sanctions_match": {"data_type": "tinyint", "is_categorical": True, "categories": [0, 1]},
    },
}

MAPPINGS = [
    ("staging_db.customer", "customer_id", "final_db.customer_summary", "customer_id", None),
    ("staging_db.customer", "segment", "final_db.customer_summary", "segment_name", ""),
    ("core_db.sanctions_list", "sanctions_hit", "final_db.customer_summary", "sanctions_match",
     "MAX(n.sanctions_hit)"),
    ("staging_db.transaction", "amount", "final_db.customer_summary", "total_debit",
     "SUM(CASE WHEN u.txn_type = 'DEBIT' THEN u.amount ELSE 0 END)"),
    ("x", "y", "z", "w", "   "),
]


def _catalog(spark):
    return M.flatten_catalog(spark.createDataFrame([(json.dumps(CATALOG),)], "value string"))


def _mappings(spark):
    return spark.createDataFrame(MAPPINGS, "source_table string, source_column string, target_table string, "
                                           "target_column string, transformation_logic string")


def test_flatten_catalog(spark):
    rows = {(r.table_name, r.column_name): r for r in _catalog(spark).collect()}
    assert len(rows) == 4
    assert rows[("final_db.customer_summary", "sanctions_match")].categories == ["0", "1"]
    assert rows[("staging_db.customer", "segment")].is_categorical is True


def test_read_catalog_file(spark, tmp_out):
    p = os.path.join(tmp_out, "catalog.json")
    with open(p, "w") as f:
        json.dump(CATALOG, f, indent=2)
    assert sinks.read_catalog(spark, p).count() == 4


def test_enrich_defaults_and_logic(spark):
    out = {r.target_column: r for r in M.enrich_with_catalog(_mappings(spark), _catalog(spark)).collect()}
    assert len(out) == len(MAPPINGS)
    assert out["customer_id"].transformation_logic == "Direct mapping"          # NULL -> default
    assert out["segment_name"].transformation_logic == "Direct mapping"        # '' -> default
    assert out["w"].transformation_logic == "   "                               # blank kept
    assert out["sanctions_match"].data_type == "" and out["sanctions_match"].categories == []  # T20 miss
    assert out["sanctions_match"].transformation_logic == "MAX(sanctions_hit)"
    assert out["total_debit"].transformation_logic == \
        "SUM(CASE WHEN txn_type = 'DEBIT' THEN amount ELSE 0 END)"
    assert out["segment_name"].categories[0] == "BRONZE"


def test_validate_and_quarantine(spark):
    good = {"mappings": [{"source_table": "a", "source_column": "b", "target_table": "c",
                          "target_column": "d", "transformation_logic": "e", "extra": 1}]}
    missing = {"mappings": [{"source_table": "a", "source_column": "b", "target_table": "c",
                             "transformation_logic": "e"}]}
    docs = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(missing)), (3, "{not json"),
                                  (4, json.dumps({"other": []}))], "doc_id int, text string")
    parsed = M.parse_documents(docs)
    valid = M.valid_mappings(parsed).collect()
    assert [(r.doc_id, r.pos, r.data_type, r.is_categorical, r.categories) for r in valid] == [(1, 0, "", False, [])]
    q = {r.doc_id: r.error for r in M.quarantine(parsed).collect()}
    assert set(q) == {2, 3, 4}


BASE = {"source_table": "a", "source_column": "b", "target_table": "c", "target_column": "d", "transformation_logic": "e"}


def _doc(**kw):
    return json.dumps({"mappings": [{**BASE, **kw}]})


@pytest.mark.parametrize("text,error", [
    (_doc(), None), (_doc(extra={"x": 1}), None), (_doc(categories=[]), None), ('{"mappings": []}', None),
    (_doc(is_categorical=True, categories=["x"], data_type="int"), None), (" " + _doc() + "\n", None),
    (_doc(data_type=None), M.BAD_TYPE), (_doc(is_categorical="maybe"), M.BAD_TYPE), (_doc(categories="A"), M.BAD_TYPE),
    (_doc(categories=["A", None]), M.BAD_TYPE), (_doc(source_table=5), M.BAD_TYPE), (_doc(source_table={"a": 1}), M.BAD_TYPE),
    ('{"mappings": [5]}', M.BAD_TYPE), ('{"mappings": [null]}', M.BAD_TYPE),
    (_doc() + " text", M.NO_LIST), (_doc() + _doc(), M.NO_LIST), (_doc().replace('"', "'"), M.NO_LIST),
    (_doc() + '],["x"', M.NO_LIST), ("", M.NO_LIST), (None, M.NO_LIST), ('{"mappings": 5}', M.NO_LIST), ("[1]", M.NO_LIST)])
def test_strict_documents(spark, text, error):
    row = M.parse_documents(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()[0]
    assert row.error == error and (row.doc is None) == (error is not None)


def test_failfast(spark):
    docs = spark.createDataFrame([(1, _doc()), (2, "{bad")], "doc_id int, text string")
    assert M.valid_mappings(M.parse_documents(docs.where("doc_id = 1"), mode="FAILFAST")).count() == 1
    with pytest.raises(Exception, match="malformed document"):
        M.valid_mappings(M.parse_documents(docs, mode="FAILFAST")).collect()


def test_malformed_catalogs_are_kept_apart(spark):
    docs = spark.createDataFrame([(1, json.dumps(CATALOG)), (2, "{bad"), (3, None), (4, "[]")], "doc_id int, value string")
    errors = {r.doc_id: r.error for r in M.parse_catalog(docs).collect()}
    assert errors == {1: None, 2: "malformed catalog", 3: "malformed catalog", 4: "malformed catalog"}
    assert M.flatten_catalog(docs).count() == 4


def test_repeated_catalog_keys_do_not_fan_out(spark):
    cat = _catalog(spark)
    assert M.enrich_with_catalog(_mappings(spark), cat.unionByName(cat)).count() == len(MAPPINGS)
    ordered = spark.createDataFrame([("t", "c", "int", 1), ("t", "c", "date", 2)], "table_name string, column_name string, data_type string, pos int")
    assert [r.data_type for r in M.dedupe_catalog(ordered, "pos").collect()] == ["date"]


def test_csv_keeps_line_breaks_and_defaults(spark, tmp_out):
    rows = [("s", "c", "t", "x", 'CASE\n  WHEN "a" THEN 1,\r\n END', "", False, []), ("s", "c", "t", "y", "", "", False, [])]
    df = spark.createDataFrame(rows, "source_table string, source_column string, target_table string, target_column string, "
                                     "transformation_logic string, data_type string, is_categorical boolean, categories array<string>")
    path = os.path.join(tmp_out, "multi")
    sinks.write_mapping_csv(df, path)
    back = sinks.read_mapping_csv(spark, path).collect()
    assert sorted(tuple(r) for r in back) == sorted(tuple(r) for r in df.collect())
    with open(os.path.join(tmp_out, "flag.csv"), "w") as f:
        f.write(",".join(M.MAPPING_FIELDS) + "\ns,c,t,x,l,,,\n")
    assert sinks.read_mapping_csv(spark, os.path.join(tmp_out, "flag.csv")).collect()[0].is_categorical is False


def test_csv_round_trip(spark, tmp_out):
    enriched = M.enrich_with_catalog(_mappings(spark), _catalog(spark))
    path = os.path.join(tmp_out, "stm_csv")
    sinks.write_mapping_csv(enriched, path)
    back = sinks.read_mapping_csv(spark, path)
    key = lambda r: (r.target_column, r.transformation_logic, r.data_type, r.is_categorical, tuple(r.categories))
    assert sorted(map(key, back.collect())) == sorted(map(key, enriched.collect()))
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    assert '"SUM(CASE WHEN txn_type = \'DEBIT\' THEN amount ELSE 0 END)"' not in text  # no comma, no quoting
    assert '"BRONZE, SILVER, GOLD, PLATINUM, UNKNOWN"' in text
    assert ",True," in text and ",False," in text


def test_json_documents(spark, tmp_out):
    enriched = M.enrich_with_catalog(_mappings(spark), _catalog(spark)).withColumn("doc_id", F.lit(7)) \
        .withColumn("pos", F.monotonically_increasing_id())
    path = os.path.join(tmp_out, "stm_json")
    sinks.write_mapping_json(enriched, path)
    docs = spark.read.json(path).collect()
    assert len(docs) == 1 and len(docs[0].mappings) == len(MAPPINGS)


def test_final_table_only(spark):
    sinks_df = spark.createDataFrame([("final_db.customer_summary",)], "dataset string")
    assert M.final_table_only(_mappings(spark), sinks_df).count() == 4

"""Files and tables: CSV in splits, tables by date and bucket, counts with the write, catalogs in pieces."""

import csv
import json
import os
import random

import pytest
from conftest import SF001
from tessera import registry
from tessera.operators import layers as L
from tessera.operators import mapping as M
from tessera.plans.inspect import physical_plan
from tessera.sources import sinks
from tessera.sources.bank import BankViews
from test_scaled import rows, settings

FIELDS = list(M.MAPPING_FIELDS)


def write_csv(path, records, newline="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(FIELDS)
        w.writerows(records)


def odd_records(n, seed=1):
    rnd = random.Random(seed)
    cells = ["", "a", "é🙂", 'say "x"', '"', '""', "a,b", "two\nlines", '\n"\n', "\n\n", " padded ", "tail\n", 'q"\n"r', "x" * 30]
    return [["t%d" % i, *(rnd.choice(cells) for _ in range(5)), rnd.choice(["True", "False"]), rnd.choice(["", "a, b", "1"])] for i in range(n)]


def whole(spark, path):
    """The same files read by Spark's own reader, a file a task."""
    raw = spark.read.options(**sinks.CSV_OPTIONS, multiLine="true").schema(", ".join(f"{c} string" for c in FIELDS)).csv(path)
    return M.from_csv_projection(raw)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 64, 1000])
def test_csv_cut_at_any_byte_reads_the_same(spark, tmp_out, size):
    """Splits of one byte cut at every position; every size gives the same rows."""
    path = os.path.join(tmp_out, "m.csv")
    write_csv(path, odd_records(8 if size < 3 else 60))
    want = rows(whole(spark, path))
    with settings(spark, files__maxPartitionBytes=str(size), shuffle__partitions="4"):
        got = sinks.read_mapping_csv(spark, path)
        records = sinks.csv_records(spark, path)
        assert sorted(r.record for r in records.collect()) == list(range((8 if size < 3 else 60) + 1))
        assert rows(got) == want
    if size <= 64:
        with settings(spark, files__maxPartitionBytes=str(size), files__openCostInBytes="1"):
            assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 4


def test_csv_of_many_files_and_line_ends(spark, tmp_out):
    for k, newline in enumerate(["\n", "\r\n", "\n"]):
        write_csv(os.path.join(tmp_out, f"p{k}.csv"), [[f"f{k}", "a", "b", "c,d", f'"{k}"', "int", "False", ""]] * (3 * k), newline)
    got = sinks.read_mapping_csv(spark, tmp_out)
    assert rows(got) == rows(whole(spark, tmp_out)) and got.count() == 9


def test_counts_come_from_the_job_that_writes(spark, tmp_out):
    m = registry.M.valid_mappings(registry._parsed_mapping_docs(spark, SF001))
    want = m.count()
    sc = spark.sparkContext
    for k, write in enumerate((sinks.write_mapping_csv, sinks.write_mapping_json, lambda x, p: sinks.write_mapping_json(x, p, key=None))):
        sc.setJobGroup(f"write{k}", "")
        assert write(m, os.path.join(tmp_out, str(k))) == want
        counted = len(sc.statusTracker().getJobIdsForGroup(f"write{k}"))
        sc.setJobGroup(f"plain{k}", "")
        csv_rows = M.csv_projection(m) if k == 0 else sinks.mapping_documents(m).select("text") if k == 1 else m.select(*FIELDS)
        getattr(csv_rows.write.mode("overwrite"), ("csv", "text", "json")[k])(os.path.join(tmp_out, f"plain{k}"))
        assert counted == len(sc.statusTracker().getJobIdsForGroup(f"plain{k}"))      # not one job more
    sc.setJobGroup("", "")


# ------------------------------------------------------------------ layout

def test_laid_out_tables_are_pruned_and_not_shuffled(spark):
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__enabled="false", shuffle__partitions="4"):
        v = BankViews.from_testdata(spark, SF001)
        laid = registry._laid_out(spark, v, ("account", "product_dim", "branch_dim"))
        out = L.account_profile(laid)
        plan = physical_plan(out)
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        scan = next(ln for ln in plan.splitlines() if "PartitionFilters" in ln and "load_date" in ln)
        assert "2001-08-01" in scan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
        assert "Exchange" in physical_plan(L.account_profile(v))
        assert rows(out) == rows(L.account_profile(v))


def test_a_bucket_is_one_file(spark, tmp_out):
    v = BankViews.from_testdata(spark, SF001)
    sinks.save_layout(v.credit_bureau, "layout_test_credit", "credit_bureau", 3, os.path.join(tmp_out, "credit"))
    parts = [f for d, _, fs in os.walk(os.path.join(tmp_out, "credit")) for f in fs if f.startswith("part-")]
    dates = [d for d in os.listdir(os.path.join(tmp_out, "credit")) if d.startswith("report_date=")]
    assert len(dates) == 2 and len(parts) == 6
    back = spark.table("layout_test_credit").select(*v.credit_bureau.columns)
    assert rows(back) == rows(v.credit_bureau)


# ------------------------------------------------------------------ catalogs

def test_a_damaged_column_leaves_the_others(spark):
    docs = [
        {"t1": {"a": {"data_type": "int", "is_categorical": False, "categories": []}, "b": {"data_type": 5}, "c": "int",
                "d": {"is_categorical": "no"}, "e": {"categories": "x"}, "f": {}, "g": {"data_type": None, "categories": [0, 1, None]}},
         "t2": ["a"], "t3": {}, "t4": {"a": {"data_type": "date", "extra": 1}}}, {}]
    texts = [(i, json.dumps(x)) for i, x in enumerate(docs)] + [(7, '{"t": {"a": {}}'), (8, None), (9, "[]"), (10, '{"t": {"a": {}}} x')]
    got = {(r.id, r.table_name, r.column_name): r for r in M.catalog_pieces(spark.createDataFrame(texts, "id int, value string")).collect()}
    errors = {k: r.error for k, r in got.items() if r.error}
    assert errors == {**{(0, "t1", c): M.BAD_COLUMN for c in "bcde"}, (0, "t2", None): M.BAD_TABLE,
                      **{(i, None, None): M.NO_OBJECT for i in (7, 8, 9, 10)}}
    assert {k for k, r in got.items() if not r.error} == {(0, "t1", "a"), (0, "t1", "f"), (0, "t1", "g"), (0, "t4", "a")}
    assert got[0, "t1", "g"].categories == ["0", "1", None] and got[0, "t1", "a"].data_type == "int"
    assert json.loads(got[0, "t1", "b"].raw) == {"data_type": 5} and got[7, None, None].raw == texts[2][1]


def test_pieces_equal_the_whole_where_nothing_is_damaged(spark):
    docs = registry.D.catalog_documents(registry._t(spark, SF001).part)
    pieces = M.catalog_pieces(docs)
    assert pieces.where("error IS NOT NULL").isEmpty()
    plain = M.flatten_catalog(docs, "value")
    assert rows(pieces.select(*plain.columns)) == rows(plain)

"""Script references (R1) with variables resolved."""

import os

import pytest

from tessera.operators import scripts as R

SCRIPT = '''import os
from utils import helper          # no table
raw = "land"
mart = "mart"
# from a comment: FROM nowhere.tbl must not count
clean = spark.sql(f"""
    WITH recent AS (SELECT * FROM {raw}.orders o, {raw}.lines l -- FROM dead.code
                    WHERE o.id = l.order_id)
    SELECT EXTRACT(YEAR FROM r.day) AS y, TRIM(BOTH ' ' FROM r.note) AS n, 'FROM text.literal' AS t
    FROM recent r LEFT JOIN `dim schema`.`city` c ON r.city IS DISTINCT FROM c.name
    /* JOIN old.tbl */ JOIN cat.{raw}.{stage} s USING (id)
""")
clean.createOrReplaceTempView("clean_orders")
raw = "other"
clean = spark.sql(f"SELECT * FROM {raw}.orders WHERE EXISTS (SELECT 1 FROM keys)")
clean.repartition(4).write.mode("overwrite").option("a", "b") \\
    .saveAsTable(f"{mart}.orders")
spark.sql("INSERT OVERWRITE TABLE mart.daily SELECT * FROM clean_orders")
spark.table("seed").write.mode("overwrite").saveAsTable("land.seed")
spark.sql("CREATE OR REPLACE TEMP VIEW v AS SELECT * FROM VALUES (1), (2) AS t(a)")
'''


def test_script_files(spark, tmp_out):
    files = {"job.py": SCRIPT, "skip.md": "FROM x.y", "load.sql": "INSERT INTO a.b SELECT ';' FROM c.d;\n\nSELECT * FROM e, f;",
             "note.txt": 'spark.sql("SELECT * FROM g.h")', "plain.txt": "DELETE FROM i.j"}
    for name, text in files.items():
        with open(os.path.join(tmp_out, name), "w") as f:
            f.write(text)
    scripts = R.read_scripts(spark, tmp_out)
    assert scripts.count() == 4
    refs = {}
    for r in R.script_references(scripts).collect():
        refs.setdefault(r.script_id.rsplit("/", 1)[1], []).append((r.role, r.block_no, r.dataset))
    refs = {k: sorted(v) for k, v in refs.items()}
    assert refs["job.py"] == sorted([
        ("read", 1, "land.orders"), ("read", 1, "land.lines"), ("read", 1, "dim schema.city"), ("read", 1, "cat.land.{stage}"),
        ("write", 1, "clean_orders"), ("read", 2, "other.orders"), ("read", 2, "keys"), ("write", 2, "mart.orders"),
        ("write", 3, "mart.daily"), ("read", 3, "clean_orders"), ("read", 4, "seed"), ("write", 4, "land.seed"), ("write", 5, "v")])
    assert refs["load.sql"] == [("read", 1, "c.d"), ("read", 2, "e"), ("read", 2, "f"), ("write", 1, "a.b")]
    assert refs["note.txt"] == [("read", 1, "g.h")] and refs["plain.txt"] == [("write", 1, "i.j")]


CONSTRUCTS = [
    ("SELECT a, b FROM range(10), t LATERAL VIEW explode(z) e AS p, q", [("read", "t")]),
    ("MERGE INTO t.x USING s.y ON a = b WHEN MATCHED THEN UPDATE SET a = 1", [("write", "t.x"), ("read", "s.y")]),
    ("UPDATE q.r SET a = (SELECT max(b) FROM z.z), c = 1", [("write", "q.r"), ("read", "z.z")]),
    ("CREATE TABLE IF NOT EXISTS n.t AS SELECT * FROM (SELECT * FROM m) x, o", [("write", "n.t"), ("read", "m"), ("read", "o")]),
    ("CREATE DATABASE IF NOT EXISTS staging", []),
    ("", []), ("FROM", []), ("SELECT 'unclosed FROM a.b", []), (")) FROM a", [("read", "a")]),
    ("WITH RECURSIVE x (n) AS (SELECT 1), y AS (SELECT * FROM a) SELECT * FROM x, y, z", [("read", "a"), ("read", "z")]),
    ("DELETE FROM `a b`.c WHERE d IN (SELECT e FROM f.g)", [("write", "a b.c"), ("read", "f.g")]),
    ("CREATE OR REPLACE GLOBAL TEMPORARY VIEW IF NOT EXISTS v AS TABLE t", [("write", "v")]),
    ("SELECT TRIM(BOTH 'x' FROM (SELECT max(a) FROM t.u))", [("read", "t.u")]),
    ("-- FROM a\nSELECT 1 /* FROM b */ FROM c", [("read", "c")]),
]


def test_sql_constructs(spark):
    texts = spark.createDataFrame([(i, sql) for i, (sql, _) in enumerate(CONSTRUCTS)], "id int, sql string")
    found = {}
    for r in R.sql_tables(texts, ["id"]).collect():
        found.setdefault(r.id, []).append((r.role, r.name.replace("`", "")))
    for i, (sql, want) in enumerate(CONSTRUCTS):
        assert sorted(found.get(i, [])) == sorted(want), sql


def test_length_does_not_matter(spark):
    """A literal with a semicolon and a FROM stays one, however long the file is."""
    sql = "INSERT INTO a.b VALUES ('x; FROM c.d', 'it''s; FROM e.f')"
    pad = "-- " + "don't " * 20_000 + "\n"
    rows = [(1, sql, "sql"), (2, pad + sql, "sql"), (3, pad + sql + ";\n" + pad + "SELECT 1 FROM g", "sql")]
    df = spark.createDataFrame(rows, "script_id int, text string, kind string")
    got = sorted((r.script_id, r.block_no, r.role, r.dataset) for r in R.script_references(df).collect())
    assert got == [(1, 1, "write", "a.b"), (2, 1, "write", "a.b"), (3, 1, "write", "a.b"), (3, 2, "read", "g")]


def test_long_literals_and_chains_of_variables(spark):
    text = ('db = "d1"\nq = spark.sql(f"""SELECT * FROM {db}.t -- ' + "x" * 100_000 + '\n""")\n'
            + "".join(f"v{i} = {'q' if i == 0 else f'v{i - 1}'}.where(a)\n" for i in range(30))
            + 'db = load()\nv29.write.saveAsTable(f"{db}.out")\nother.write.saveAsTable("free")\n'
            + 'q = make(\n  spark.table(f"{db}.u"))\nq.write.insertInto("last")\n')
    df = spark.createDataFrame([(1, text), (2, text.replace("d1", "d2"))], "script_id int, text string")
    got = sorted(((r.script_id, r.role, r.block_no, r.dataset) for r in R.script_references(df).collect()), key=str)
    want = [(k, *x) for k in (1, 2) for x in [("read", 1, f"d{k}.t"), ("read", 2, "{db}.u"), ("write", 1, "{db}.out"),
                                               ("write", 2, "last"), ("write", None, "free")]]
    assert got == sorted(want, key=str)


def test_odd_scripts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x = (\n'''"), (4, "# " + "word " * 200_000)], "script_id int, text string")
    assert R.script_references(df).count() == 0
    assert R.script_references(df.limit(0)).count() == 0

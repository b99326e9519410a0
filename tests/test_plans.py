"""Plan checks on every registered query: no Python UDF, no cartesian
product; filters of the base layer reach the parquet scan."""

import pytest

from pyspark.sql import functions as F

from conftest import SF001
from tessera.plans.inspect import check_plan, physical_plan
from tessera.registry import QUERIES

# run when they are asked for: what is left of the plan is the last round
LOOPS = {"q_lineage_closure", "q_lineage_cycles", "q_lineage_cyclic_closure"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in LOOPS])
def test_no_udf_no_cartesian(spark, name):
    facts = check_plan(QUERIES[name](spark, SF001))
    assert not facts["python_udf"], name
    assert not facts["cartesian"], name


def test_filters_pushed(spark):
    facts = check_plan(QUERIES["q_base_layer"](spark, SF001))
    pushed = " ".join(facts["pushed_filters"])
    assert "l_shipdate" in pushed and "o_orderdate" in pushed


def test_one_parse_and_one_scan(spark):
    """L8 and the sinks of M11 read and parse each document once."""
    from tessera.operators import lineage as LN
    from tessera.sources import derived as D
    from tessera.sources.tables import read_table
    for df in (QUERIES["q_lineage_columns"](spark, SF001),
               LN.roots_and_sinks(LN.lineage_edges(LN.parse_lineage(D.lineage_documents(read_table(spark, SF001, "lineitem")))))):
        plan = physical_plan(df)
        assert plan.count("FileScan parquet") == 1
        assert plan.count("parseJson") == 1


def test_scripts_are_dealt_by_script(spark):
    """Tokens meet by script, never in a single partition, and without Python."""
    from tessera.operators import scripts as R
    from tessera.sources import derived as D
    from tessera.sources.tables import read_table
    calls = R._python_calls(D.scripts_from_documents(read_table(spark, SF001, "documents")), "doc_id")
    tables = R.sql_tables(calls.select("doc_id", "block", F.col("value").alias("sql")), ["doc_id", "block"])
    for df in (calls, tables):
        facts, plan = check_plan(df), physical_plan(df)
        assert not facts["python_udf"] and "SinglePartition" not in plan
        dealt = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln]
        assert dealt and all("doc_id" in ln or "__k" in ln for ln in dealt)


def test_documents_are_read_without_casting_variants(spark):
    """Each document is parsed once for its types and once for its fields; columns come by plain generators."""
    from tessera.operators import lineage as LN
    from tessera.operators import mapping as M
    texts = spark.createDataFrame([(1, "{}")], "doc_id int, text string")
    columns, maps = physical_plan(LN.lineage_columns(LN.parse_lineage(texts))), physical_plan(M.parse_documents(texts))
    for plan in (columns, maps):
        assert plan.count("parseJson") == 1 and plan.count("from_json") == 1
        assert "try_variant_get(__v_array" in plan and "size(__v_array" not in plan
    assert not any("transform(" in line for line in columns.splitlines() if "Generate" in line)


def test_tasks_of_scripts_grow_with_the_files(spark, tmp_path, monkeypatch):
    from tessera import session
    from tessera.operators import scripts as R
    text = 'spark.table("a").write.saveAsTable("b")\n'
    rows = spark.range(50).selectExpr("id AS script_id", f"concat('{text.strip()}', '\\n# ', id) AS text")
    rows.repartition(4).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.parts_for(df) == least == session.parts_for(spark.createDataFrame([(1,)], "a int"))
    monkeypatch.setattr(session, "TASK_BYTES", 100)
    parts = session.parts_for(df)
    assert parts > 2 * least
    assert f", {parts}), REPARTITION_BY_NUM" in physical_plan(R._python_calls(df, "script_id"))
    refs = R.script_references(df, "script_id")
    assert refs.count() == 100 and refs.where("dataset = 'a' AND role = 'read'").count() == 50

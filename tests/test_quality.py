"""DQ operators: rule flattening, derivation, row and referential checks."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import quality as Q

ANSWERS = [
    ("a", "b", "c", "d", "\n 1. Not null\n\n2) Unique  \n   \n- bullet stays\n", None),
    ("a", None, "c", "e", "only, one, line", None),
    ("a", "b", "c", "f", "ignored", "timeout"),
    ("a", "b", "c", "g", None, None),
]


def test_flatten_rules(spark):
    df = spark.createDataFrame(ANSWERS, "source_table string, source_column string, target_table string, "
                                        "target_column string, raw string, error string")
    got = [(r.target_column, r.rule_no, r.rule, r.source_column) for r in Q.flatten_rules(df).collect()]
    assert got == [("d", 1, "Not null", "b"), ("d", 2, "Unique", "b"), ("d", 3, "- bullet stays", "b"),
                   ("e", 1, "only, one, line", ""), ("f", 1, "[ERROR] timeout", "b"), ("g", 1, "[ERROR] no answer", "b")]
    commas = Q.flatten_rules(df.where("target_column = 'e'"), split_commas=True).collect()
    assert [r.rule for r in commas] == ["only", "one", "line"]


def test_derive_rules(spark):
    m = spark.createDataFrame([
        ("s.t", "seg", "f.t", "segment_name", "Direct mapping", "string", True, ["A", "O'Brien"]),
        ("s.t", "amt", "f.t", "total", "SUM(amt)", "decimal(18,2)", False, []),
        ("s.t", "id", "f.t", "customer_id", "Direct mapping", "bigint", False, []),
        ("s.t", "q", "f.t", "unknown_col", "MAX(q)", "", False, []),
    ], "source_table string, source_column string, target_table string, target_column string, "
       "transformation_logic string, data_type string, is_categorical boolean, categories array<string>")
    cat = spark.createDataFrame([("f.t", "total", "decimal(18,2)", False, []),
                                 ("f.t", "d", "date", False, [])],
                                "table_name string, column_name string, data_type string, "
                                "is_categorical boolean, categories array<string>")
    r = {(x.target_column, x.kind): x.rule for x in Q.derive_rules(m, cat, dt.date(2001, 8, 1)).collect()}
    assert r[("segment_name", "domain")] == "segment_name IN ('A', 'O''Brien')"
    assert ("segment_name", "not_blank") not in r
    assert r[("total", "non_negative")] == "total >= 0"
    assert r[("customer_id", "type")] == "try_cast(customer_id AS bigint) IS NOT NULL"
    assert ("customer_id", "reference") in r
    assert ("unknown_col", "catalog") in r
    assert all(("%s" % k[0], "completeness") in r for k in r)


def test_row_and_reference_checks(spark):
    df = spark.createDataFrame([(1, "A", 5), (2, None, -1), (None, "B", 3)], "k int, c string, v int")
    rows = {r.rule: (r.bad, r.total) for r in Q.check_rows(df, [
        Q.RowRule("c_complete", F.col("c").isNotNull()), Q.RowRule("v_pos", F.col("v") >= 0),
        Q.RowRule("c_domain", F.col("c").isin("A"))]).collect()}
    assert rows == {"c_complete": (1, 3), "v_pos": (1, 3), "c_domain": (2, 3)}
    parent = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    ref = Q.check_reference(df, "k", parent, "k", "k_ref").collect()[0]
    assert (ref.bad, ref.total) == (1, 3)
    assert all(r.bad <= r.total for r in Q.check_rows(df, [Q.RowRule("x", F.lit(None))]).collect())


def test_derived_rules_run(spark):
    """D8's rules, compiled, find what is planted."""
    maps = spark.createDataFrame([
        ("p", "id", "t", "p_id", "Direct mapping", "", False, []), ("p", "s", "t", "seg", "x", "", False, []),
        ("p", "n", "t", "num", "x", "", False, []), ("p", "d", "t", "day", "x", "", False, []),
        ("p", "a", "t", "amt", "SUM(a)", "", False, []), ("p", "m", "t", "memo", "x", "", False, []), ("p", "g", "t", "gone", "x", "", False, [])],
        "source_table string, source_column string, target_table string, target_column string, "
        "transformation_logic string, data_type string, is_categorical boolean, categories array<string>")
    cat = spark.createDataFrame([
        ("t", "p_id", "bigint", False, []), ("t", "seg", "string", True, ["A", "O'Brien", 'q"']), ("t", "num", "int", False, []),
        ("t", "day", "date", False, []), ("t", "amt", "double", False, []), ("t", "memo", "string", False, [])],
        "table_name string, column_name string, data_type string, is_categorical boolean, categories array<string>")
    rules = Q.derive_rules(maps, cat, dt.date(2001, 8, 1))
    df = spark.createDataFrame([
        (1, "A", " 12 ", dt.date(2001, 8, 1), 1.0, "x"), (1, "O'Brien", "1x", dt.date(2002, 1, 1), -1.0, " "),
        (None, 'q"', "99999999999", None, None, None), (7, "B", "5-6", dt.date(1999, 1, 1), 0.0, "y")],
        "p_id long, seg string, num string, day date, amt double, memo string")
    row_rules, refs = Q.compile_rules(rules, df)
    bad = {r.rule: r.bad for r in Q.check_rows(df, row_rules).collect()}
    assert bad == {"p_id_completeness": 1, "seg_completeness": 0, "num_completeness": 0, "day_completeness": 1, "amt_completeness": 1,
                   "memo_completeness": 1, "p_id_type": 1, "seg_domain": 1, "num_type": 3, "day_not_future": 2, "amt_non_negative": 2,
                   "memo_not_blank": 2}
    assert refs == [("p_id_reference_p.id", "p_id", "p.id")]
    parent = spark.createDataFrame([(1,), (None,)], "id long")
    out = Q.check_references(df, [(refs[0][0], "p_id", parent, "id")]).collect()
    assert [tuple(r) for r in out] == [("p_id_reference_p.id", 1, 4)]
    assert [tuple(r) for r in Q.check_references(df.limit(0), [("x", "p_id", parent, "id")]).collect()] == [("x", 0, 0)]

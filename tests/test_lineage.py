"""Lineage operators: document parsing, edges, node precedence, roots and
sinks, closure with a cycle."""

import json

import pytest

from tessera.operators import lineage as LN

DOC = {"steps": [
    {"name": "df", "output": "base", "columns": ["a", "b"],
     "sources": [{"name": "stg.c", "columns": ["a"]}, {"name": "stg.t", "columns": ["b"]}]},
    {"name": "u", "output": "union", "columns": ["a"],
     "sources": [{"name": "base"}, {"name": "stg.c", "columns": ["zzz"]}]},
    {"name": "again", "output": "base", "columns": ["a2"], "sources": []},
    {"name": "fin", "output": "final", "sources": [{"name": "union", "columns": ["a"]}]},
]}


@pytest.fixture(scope="module")
def parsed(spark):
    docs = spark.createDataFrame([
        (1, "```json\n" + json.dumps(DOC) + "\n```"),
        (2, "not json"),
        (3, json.dumps({"steps": [{"name": "x", "sources": [{"name": "a"}]}]})),
    ], "doc_id int, text string")
    return LN.parse_lineage(docs)


def test_errors(parsed):
    err = {r.doc_id: r.error for r in parsed.collect()}
    assert err[1] is None and err[2] is not None and err[3] is not None


def test_edges(parsed):
    e = [(r.step_pos, r.source, r.output) for r in LN.lineage_edges(parsed).orderBy("step_pos", "source_pos").collect()]
    assert e == [(0, "stg.c", "base"), (0, "stg.t", "base"), (1, "base", "union"), (1, "stg.c", "union"),
                 (3, "union", "final")]


def test_node_precedence(parsed):
    """Outputs take their last drawing; sources only keep the first."""
    n = {r.dataset: (r.drawn_as, r.columns) for r in LN.lineage_nodes(parsed).collect()}
    assert n["base"] == ("output", ["a2"])        # redrawn by step 'again'
    assert n["stg.c"] == ("source", ["a"])        # first appearance wins
    assert n["final"] == ("output", [])           # missing columns -> []
    assert n["union"] == ("output", ["a"])


def test_columns(parsed):
    c = LN.lineage_columns(parsed).collect()
    assert {(r.dataset, r.role, r.column_name) for r in c} >= {("stg.c", "read", "zzz"), ("base", "write", "a2")}


def test_roots_sinks_and_closure_with_cycle(spark):
    edges = spark.createDataFrame([
        ("s1", "m1"), ("s2", "m1"), ("m1", "m2"), ("m2", "m3"), ("m3", "m2"),   # m2 <-> m3 cycle
        ("m3", "out"), ("s1", "out")], "source string, output string")
    roles = {(r.dataset, r.role) for r in LN.roots_and_sinks(edges).collect()}
    assert roles == {("s1", "base"), ("s2", "base"), ("out", "sink")}
    pairs = {(r.dataset, r.base) for r in LN.closure_to_base(edges).collect()}
    want = {(d, b) for d in ("m1", "m2", "m3", "out") for b in ("s1", "s2")}
    assert pairs == want
    # idempotent: closing the closure's own edges adds nothing new
    again = LN.closure_to_base(spark.createDataFrame(sorted(pairs), "output string, source string")
                               .select("source", "output"))
    assert {(r.dataset, r.base) for r in again.collect()} == pairs


def test_missing_from_lineage(spark, parsed):
    refs = spark.createDataFrame([(1, "stg.c"), (1, "stg.x"), (1, "final")], "doc_id int, dataset string")
    miss = LN.missing_from_lineage(refs, LN.lineage_nodes(parsed)).collect()
    assert [(r.doc_id, r.dataset) for r in miss] == [(1, "stg.x")]


STEP = {"name": "x", "output": "o", "columns": ["a"], "sources": [{"name": "i", "columns": ["a"]}]}


def _doc(**kw):
    return json.dumps({"steps": [{**STEP, **kw}]})


@pytest.mark.parametrize("text,error", [
    (_doc(), None), (_doc(extra=1), None), (_doc(columns=None), None), (_doc(sources=[]), None), ('{"steps": []}', None),
    ("```json\n" + _doc() + "\n```", None), (_doc(sources=[{"name": "i"}, {"name": "j", "columns": []}]), None),
    (_doc(columns=5), LN.BAD_TYPE), (_doc(sources="i"), LN.BAD_TYPE), (_doc(output=4), LN.BAD_TYPE), (_doc(sources=[5]), LN.BAD_TYPE),
    (_doc(columns=[None]), LN.BAD_TYPE), (_doc(sources=[{"name": "i", "columns": 5}]), LN.BAD_TYPE),
    (_doc(output=None), LN.NO_NAME), (_doc(sources=[{"columns": []}]), LN.NO_NAME), ('{"steps": [null]}', LN.NO_NAME),
    (_doc() + " x", LN.NO_STEPS), (_doc() + _doc(), LN.NO_STEPS), (_doc().replace('"', "'"), LN.NO_STEPS), (None, LN.NO_STEPS),
    ('{"steps": {}}', LN.NO_STEPS)])
def test_strict_documents(spark, text, error):
    parsed = LN.parse_lineage(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert parsed.collect()[0].error == error
    assert [(r.error, r.text) for r in LN.quarantine(parsed).collect()] == ([(error, text)] if error else [])
    if error:
        failing = LN.parse_lineage(spark.createDataFrame([(1, text)], "doc_id int, text string"), mode="FAILFAST")
        with pytest.raises(Exception, match="."):
            failing.collect()


def test_closure_of_targets_and_depth(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("other", "far"), ("side", "n20")]
    edges = spark.createDataFrame(chain, "source string, output string")
    targets = spark.createDataFrame([("n40",), ("n3",), ("nowhere",)], "dataset string")
    pairs = {(r.dataset, r.base) for r in LN.closure_to_base(edges, targets).collect()}
    assert pairs == {("n40", "n0"), ("n40", "side"), ("n3", "n0")}
    everything = LN.closure_to_base(edges)
    assert everything.count() == 40 + 21 + 1
    assert everything._jdf.queryExecution().analyzed().toString().count("LogicalRDD") <= 10


def test_missing_of_scripts(spark):
    """References of scripts against their own answers; an answer that is not valid lacks all."""
    from tessera.operators import scripts as R
    df = spark.createDataFrame([(1, 'a = spark.sql("SELECT * FROM i, z")\na.write.saveAsTable("o")', _doc()),
                                (2, 'spark.table("i").write.saveAsTable("i")', "{bad"), (3, None, None)],
                               "doc_id int, text string, lineage string")
    refs = R.script_references(df.select("doc_id", "text"), "doc_id")
    out = LN.missing_from_lineage(refs, LN.lineage_nodes(LN.parse_lineage(df, "lineage"))).collect()
    assert sorted((r.doc_id, r.dataset) for r in out) == [(1, "z"), (2, "i")]

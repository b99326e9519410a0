"""Merkle manifest against a plain recursive version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, queries
from tessera.llm.common import ascii_lower

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Root, and for each leaf its siblings by level as (left, right)."""
    paths, place, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = nodes[p // 8 * 8: p // 8 * 8 + 8]
            paths[i].append(("".join(run[:p % 8]), "".join(run[p % 8 + 1:])))
        place = [p // 8 for p in place]
        nodes = [h(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain(rows):
    """Rows as op12 returns them; rows are (doc_id, source, lang, n_chars, text)."""
    none_first = lambda v: (v is not None, v if v is not None else 0)
    langs = {}
    for r in rows:
        t = r[4]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and t is not None:
            t = t.translate(LOWER)
        langs.setdefault(r[2], []).append((r[0], h(*map(enc, r)), h(*map(enc, (*r[:4], t)))))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for x in names:
        langs[x].sort(key=lambda d: (none_first(d[0]), d[1], d[2]))
        trees.append(tree([d[1] for d in langs[x]]))
    root, top = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for x, (sub, paths), above in zip(names, trees, top):
        for (doc_id, leaf, later), path in zip(langs[x], paths):
            for left, right in (path := path + above):
                later = h(left, later, right)
            out.append((doc_id, leaf, sub, root, h(*(a + b for a, b in path)), later, later == root))
    return out


def run(df):
    lower = {"text": ascii_lower("text")}
    got = merkle.manifest(df, FIELDS, "doc_id", "lang", F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower)
    return [tuple(r) for r in got.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256), "folded_root", "verified").collect()]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("n, langs", [(1, 1), (8, 1), (9, 1), (65, 2), (700, 3), (90, 20)])
def test_trees_of_all_heights(spark, n, langs):
    rnd = random.Random(n)
    names = [None, "", "en", "é", "🙂", "zz"] + [f"l{i}" for i in range(langs)]
    names = names[:langs] if langs > 1 else ["en"]
    rows = [(i, rnd.choice([None, "s", "é"]), names[min(int(rnd.expovariate(1)), len(names) - 1)], rnd.choice([None, 3]),
             rnd.choice([None, "", "Text é A", "lower", "X" * 9000])) for i in rnd.sample(range(10 * n), n)]
    assert order(run(spark.createDataFrame(rows, DOCS).repartition(5))) == order(plain(rows))


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(7, "a", "en", 1, "Same")] * 11 + [(7, "b", "en", 1, "Other"), (None, "a", "en", 1, "No id"),
                                              (None, "a", None, None, None)] + [(i, "a", "en", 1, "T") for i in range(80)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("g", "idx", "n", "h", "leaf", "path", "slot", "key", "s0", "at", "later"):
        df = df.withColumn(c, F.lit("x"))
    assert order(run(df)) == order(plain(rows))


def test_empty_table(spark):
    assert run(spark.createDataFrame([], DOCS)) == []


def test_one_changed_letter_is_found(spark):
    rows = [(i, "s", "en", 4, f"text{i}") for i in range(100)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), FIELDS, "doc_id", "lang", F.col("doc_id") == 42,
                          {"text": F.concat("text", F.lit("."))})
    assert [r.doc_id for r in got.where("NOT verified").collect()] == [42]


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    got = [tuple(r) for r in queries.QUERIES["op12_merkle_manifest"](spark, sf).collect()]
    assert order(got) == order(plain(rows)) and {r[-1] for r in got} == {True, False}

"""Token counts against the library of the vocabulary's file."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tessera.llm import queries, token_counts  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def lib(texts):
    t = tokenizers.Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.read_merges(PATH))


def odd_texts(n=1500):
    rnd = random.Random(5)
    letters = "ab'sSdtlrevm \n\t\r\x0b\x1c\x85   éß12٣90日本한́🙂<|endoftext|>.,!?thetion"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(200))) for _ in range(n)]
    return texts + [None, "", " ", "   a   ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>  \n", "<|endoftext|",
                    "a" * 5001, "ab" * 3000, "日本" * 2000, " " * 9000, "".join(rnd.choice("abcdeinort") for _ in range(9000))]


def test_odd_texts_equal_the_library(counter):
    texts = odd_texts()
    assert counter.counts(texts).tolist() == lib(texts)


def test_every_code_point(counter):
    letters = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    texts = [f(letters[i:i + 128]) for i in range(0, len(letters), 128)
             for f in ("".join, " ".join, lambda b: "".join(f"a{x}b " for x in b))]
    assert counter.counts(texts).tolist() == lib(texts)


def test_numbering_starts_anew_and_runs_are_cut(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN", 50)
    monkeypatch.setattr(token_counts, "RUN", 7)
    monkeypatch.setattr(token_counts, "SLICE_CHARS", 40)
    texts = odd_texts(120)
    assert token_counts.Counter(counter.merges).counts(texts).tolist() == lib(texts)


def test_occurrences_of_a_pair_merge_from_the_left():
    # symbols 0..255 are bytes; "aa" is 256, "aaa" (256 + a) is 257
    a = ord("a")
    keys = np.array([a << 32 | a, 256 << 32 | a], dtype=np.int64)
    m = token_counts.Merges(np.arange(256), keys, np.array([0, 1], np.int32), np.array([256, 257]), ())
    got = token_counts.merged_lengths(b"a" * 10 + b"ba", np.array([1, 2, 3, 4, 0, 2]), m)
    assert got.tolist() == [1, 1, 1, 2, 0, 2]


def test_vocabularies_it_cannot_read_are_refused():
    with pytest.raises(ValueError):
        token_counts.read_merges(public_tokenizers.path("word_bpe_49k.json"))


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(1, "Hello wörld"), (1, "Hello wörld"), (None, None), (3, ""), (4, "x " * 1100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n_bytes", "n_tokens", "over_limit"):
        df = df.withColumn(c, F.lit("x"))
    got = [tuple(r) for r in token_counts.count_tokens(df, PATH).collect()]
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, lib([t for _, t in rows]))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(df.limit(0), PATH).collect() == []


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (len((r.text or "").encode()), n) for r, n in zip(rows, lib([r.text for r in rows]))}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.QUERIES["op13_token_counts"](spark, sf).collect()}
    assert got == want

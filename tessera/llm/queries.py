"""Queries ``opN_<name>`` over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import (conversation_repair, decontaminate, embedding_dedup, html_extract, jaccard_join, license_scan,
                         line_dedup, merkle, mixing, secret_scan, token_counts, toxicity, url_filter)
from tessera.llm.common import ascii_lower, table

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_html_extraction(spark, sf_dir):
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query
def op4_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op5_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_secret_scan(spark, sf_dir):
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


@query
def op8_license_scan(spark, sf_dir):
    return license_scan.find_licenses(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark, sf_dir):
    return (line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
            .select("doc_id", "text", "n_lines", "n_dropped"))


ORACLE["op9_line_dedup"] = line_dedup.sql()


@query
def op10_mixing(spark, sf_dir):
    return (mixing.with_probability(table(spark, sf_dir, "documents"))
            .select("doc_id", "source", "lang", "n_tokens", "topic", F.round("probability", 9).alias("probability"), "sampled"))


@query
def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def toxicity_model(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return toxicity.fit(table(spark, sf_dir, "documents"), labels.where(~toxicity.held_out("doc_id")))


@query
def op1_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))


@query
def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return (conversation_repair.repair(conversation_repair.damage(rows), ids=rows)
            .withColumnRenamed("sha256", "repaired_sha256").drop("repaired"))


@query
def op12_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"],
                            key="doc_id", group="lang", where=tampered, changed={"text": ascii_lower("text")})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
                        "folded_root", "verified")


@query
def op13_token_counts(spark, sf_dir):
    import public_tokenizers      # the files' place is a matter of the machine the driver runs on
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

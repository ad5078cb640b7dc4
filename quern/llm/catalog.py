"""The registered queries of the corpus operators, with their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontamination, jaccard, oracles, pii, quality, substrings, templates, token_counts, urls, warc
from quern.plans import scratch
from quern.session import table

#: Fixed rules of the URL query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1 that rules decide, which SQL can express."""
    host, path = urls.host_path(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = urls.rule_of(F.col("host"), F.col("path"), RULES)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select("doc_id", *[number(k) for k in range(4)], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(pii.all_spans()).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.records(warc.read(spark, path))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:x-page:(-?[0-9]+)>', 1) AS BIGINT)")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = token_counts.count(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_pretokens", "n_tokens")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), "start", "n_windows")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat, wherever in a line they begin."""
    return substrings.passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.judge(docs, carry=["doc_id"])


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard.link(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linked.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count=True)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op7_passages": op7_passages,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": corpus_pipeline.run,
    "url_rules": url_rules,
}
ORACLE = {
    "op4_warc": oracles.OP4,
    "op6_decontamination": oracles.OP6,
    "op7_substring_dedup": oracles.OP7,
    "op7_passages": oracles.OP7_PASSAGES,
    "op8_quality_rules": oracles.OP8,
    "op9_ngram_jaccard": oracles.OP9,
    "op10_line_dedup": oracles.OP10,
    "url_rules": oracles.URL_RULES,
}

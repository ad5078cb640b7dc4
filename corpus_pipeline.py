"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontamination, jaccard, quality, templates
from quern.plans import scratch
from quern.session import table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_made: list = []


def stage(work: Stage) -> Stage:
    """A stage that begins by deleting the tables which the stage before made on its way, once its output is written:
    then `docs` no longer reads any of them."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _made else []
        if not any(path.rpartition("/")[2] in file for _, path in _made for file in read):
            scratch.drop(_made)
        before = scratch.written()
        out = work(spark, docs, sf_dir)
        _made[:] = [x for x in scratch.written() if x not in before]
        return out

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, or the verdict on their source, reject go. Null and empty texts go, as they have no
    words; an empty table stays empty; columns beside the rules' pass through."""
    own = {c: f"__q_own_{c}" for c in docs.columns if c in (*quality.RULES, "kept")}
    judged = quality.judge(docs.withColumnsRenamed(own)).where("kept")
    return judged.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from the texts; n_chars follows. Null texts stay; a text may become empty."""
    cleaned = templates.drop_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


@stage
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, that with the smallest doc_id stays. Documents without a word, and those
    without an id, stay; rows that repeat a doc_id stay or go together."""
    return jaccard.keep_one(docs, jaccard.link(docs, count=False))


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window similar to a benchmark item go; those without an id stay."""
    return decontamination.drop(docs, decontamination.find(docs, table(spark, sf_dir, "benchmark")))


@stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, decoded again: same says whether the bytes are the text's. Null texts have no ids; of the
    other columns those that are there pass through, but for the text and its length."""
    done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    kept = [c for c in docs.columns if c not in ("text", "n_chars", "ids_sha256", "decoded_sha256", *bpe.ADDED)]
    return done.select(*kept, "n_tokens", "ids_le", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "same")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the template tree, the components and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = scratch.cut(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

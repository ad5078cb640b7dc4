"""The stages one after another, each against a brute-force version on its own input."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from quern.llm import bpe, jaccard, oracles
from quern.plans import scratch
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng, n):
    return " ".join(rng.choice("kalomineruta") + rng.choice(["ban", "dor", "fel", "gim", "hos", "jut"]) + str(rng.randrange(90)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))


def corpus():
    rng = random.Random(11)
    items = [(i, sentences(rng, 20)) for i in range(4)]
    texts = [f"{sentences(rng, 70)}\nAll rights reserved by owner number {i}\n{sentences(rng, 40)}" for i in range(30)]
    for i in range(6):
        words = texts[i].split(" ")
        words[5 * i + 2] = "edited"
        texts += [texts[i], " ".join(words)]
    texts += [f"{sentences(rng, 50)} {items[i % 4][1]} {sentences(rng, 30)}" for i in range(5)]
    texts += ["too short", "", None, "x y z " * 40]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[40], (None, texts[29] + " and more of it", "en", None, 9)], items


def test_stages_by_brute_force(spark, tmp_path):
    rows, items = corpus()
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = scratch.cut(stage(spark, docs, folder), name)
        seen[name] = (before, docs.collect())
        assert name == "byte_bpe" or docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    with_ids = lambda part: [(r.doc_id, r.text) for r in part if r.doc_id is not None]
    before, after = seen["quality_rules"]
    judged = {dict(r)["doc_id"]: dict(r)["kept"] for r in plain.by_sql(oracles.OP8, documents=(("doc_id", "source", "text"), [(r.doc_id, r.source, r.text) for r in before]))}
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(r.doc_id for r in before if r.doc_id is not None and judged[r.doc_id])
    assert 0 < len(after) < len(before)
    before, after = seen["line_dedup"]
    unique = list(dict.fromkeys(with_ids(before)))  # the SQL takes ids as unique
    want = {dict(r)["doc_id"]: dict(r)["text_sha256"] for r in plain.by_sql(oracles.OP10, documents=(("doc_id", "text"), unique))}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after if r.doc_id is not None} == want
    assert all(r.n_chars == len(r.text) for r in after) and sum("rights reserved" in r.text for r in after) == 0
    before, after = seen["ngram_jaccard"]
    components = plain.linked([x for x in with_ids(before)])
    assert {r.doc_id for r in after if r.doc_id is not None} == {d for d, (_, c) in components.items() if c == d} and any(r.doc_id is None for r in after)
    before, after = seen["benchmark_decontamination"]
    gone = {d for d, _ in plain.decontaminated(with_ids(before), items)}
    assert {r.doc_id for r in after if r.doc_id is not None} == {r.doc_id for r in before if r.doc_id is not None} - gone and len(gone) == 5
    before, after = seen["byte_bpe"]
    tokenizer = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before) and all(r.same and list(memoryview(r.ids_le).cast("I")) == tokenizer.encode_ordinary(texts[r.doc_id]) for r in after)
    again = corpus_pipeline.run(spark, folder)
    assert sorted(r.ids_sha256 for r in again.collect()) == sorted(r.ids_sha256 for r in after)


def test_pipeline_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA + ", kept int, n_words string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    done = corpus_pipeline.run(spark, folder)
    assert done.count() == 0 and {"doc_id", "kept", "n_words", "ids_le", "same"} <= set(done.columns)


def test_keep_one_of_strings(spark):
    docs = spark.createDataFrame([("a", "one two three four five six"), ("b", "One two three four five six"), ("c", "else")], "doc_id string, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(docs, jaccard.link(docs)).select("doc_id").collect()) == ["a", "c"]
    assert jaccard.link(docs).where(F.col("component_id") == "a").count() == 2

"""Removal of repeated text units: lines or paragraphs (sentences as an option).

Units are normalised (lower case, runs of space and U+0009 to U+000D as one space) and hashed to 128 bits. Digests are
grouped over all documents; of equal units, the earliest ranked one (smallest doc_id, then first in the text) stays and
all others are marked for removal with their offsets in the original text.

`passages` takes runs of PASSAGE words or more as units, wherever in a line they begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import arrows
from quern.plans import scratch

UNITS = {
    "line": r"[^\n]+",
    "paragraph": r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*",
    # up to the end of a sentence or of the line
    "sentence": r"[^\n.!?]+(?:[.!?]+(?=[^\s.!?])[^\n.!?]+)*[.!?]*",
}
BLANK = " \t\n\v\f\r"
PASSAGE = 51  # words
_WORD = re.compile(rf"[^{BLANK}]+")


def units(docs: DataFrame, doc: str = "doc_id", text: str = "text", unit: str = "line", least_words: int = 1) -> DataFrame:
    """A row for each unit of `least_words` words or more: doc_id, start and end (code points, end exclusive; the unit begins
    with its first word), h1 and h2 (the digest), first (whether it is the first such unit of its text)."""
    out = T.StructType([T.StructField(doc, docs.schema[doc].dataType), *[T.StructField(n, T.LongType()) for n in ("start", "end", "h1", "h2")], T.StructField("first", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, digest = re.compile(UNITS[unit]).finditer, xxhash.xxh3_128_digest
        for batch in arrows.slices(batches, text):
            index, starts, ends, hashes, first = [], [], [], [], []
            for row, value in enumerate(arrows.texts(batch.column(text))):
                seen: set[bytes] = set()
                for match in find(value):
                    raw = match.group()
                    words = raw.lower().encode("utf-8", "replace").split()  # of bytes: at ASCII white space only
                    if len(words) < max(least_words, 1):
                        continue
                    h = digest(b" ".join(words))
                    index.append(row)
                    starts.append(match.end() - len(raw.lstrip(BLANK)) if raw[0] in BLANK else match.start())
                    ends.append(match.end())
                    hashes.append(h)
                    first.append(h not in seen)
                    seen.add(h)
            both = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
            ids = batch.column(doc).take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(first, pa.bool_())], names=out.names)

    return arrows.modest(docs.select(docs[doc], docs[text])).mapInArrow(work, out)


def repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", unit: str = "line", least_words: int = 1) -> DataFrame:
    """The spans to remove: doc_id, start, end, kept_doc_id (where the unit stays), one row each.

    A null text is empty. Ids may be of any type that has an order; a null doc_id ranks last. Rows that repeat a doc_id
    are one document for the ranks: all keep its first unit of a kind. Units below `least_words` words always stay, as
    do those without a word. Texts of any length are walked unit by unit. An empty table gives no rows. Input columns
    other than the two are ignored.
    """
    found = scratch.cut(units(docs, doc, text, unit, least_words).withColumnRenamed(doc, "__q_doc"), "units")
    twice = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("__q_doc").alias("kept")).where("n > 1").drop("n")
    twice = scratch.cut(twice, "repeated")
    later = F.coalesce(F.col("__q_doc") > F.col("kept"), F.col("__q_doc").isNull() & F.col("kept").isNotNull())
    rows = found.join(twice, ["h1", "h2"]).where(later | ~F.col("first"))
    return rows.select(F.col("__q_doc").alias(doc), "start", "end", F.col("kept").alias("kept_doc_id"))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of hashes."""
    x = (a ^ (b >> np.uint64(29)) ^ (b << np.uint64(35))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on that has so many."""
    size, out = 1, hashes
    while size * 2 <= n:
        out, size = _mix(out[:-size], out[size:]), size * 2
    return out if size == n else _mix(out[: len(out) - (n - size)], out[n - size :])


def _hashed(text: str) -> np.ndarray:
    """Two 64-bit hashes of each word, lower-cased."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w.lower().encode("utf-8", "replace")) for w in _WORD.findall(text)]), dtype=np.uint64).reshape(-1, 2)


def _least(hashes: np.ndarray, words: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of `of` words, and where the smallest one of each run of `words` words is."""
    runs = _runs(hashes[:, 0], of)
    views = np.lib.stride_tricks.sliding_window_view(runs, words - of + 1)
    return runs, views.argmin(axis=1) + np.arange(len(views))


def _segments(docs: DataFrame, doc: str, words: int, of: int) -> DataFrame:
    """A row for each segment, the runs of `words` words that have one anchor in common: __q_doc, th, at (its first run's
    word), size (its runs), a (the anchor: of the hashes of `of` words in a run the smallest), h (a hash of its runs in order).

    Equal runs have equal anchors at equal places in them, and so no two runs of a segment are equal."""
    out = T.StructType([T.StructField("__q_doc", docs.schema[doc].dataType), *[T.StructField(n, T.LongType()) for n in ("th", "at")], T.StructField("size", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("a", "h")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrows.slices(batches, "text"):
            index, found = [], []
            for row, value in enumerate(arrows.texts(batch.column("text"))):
                hashes = _hashed(value)
                if len(hashes) < words:
                    continue
                short, least = _least(hashes, words, of)
                at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                sizes = np.diff(at, append=len(least))
                places = (np.arange(len(least)) - np.repeat(at, sizes)).astype(np.uint64)
                index.append(np.full(len(at), row))
                found.append((at, sizes.astype(np.int32), short[least[at]].view(np.int64), np.add.reduceat(_mix(_runs(hashes[:, 1], words), places), at).view(np.int64)))
            if index:
                rows = pa.array(np.concatenate(index))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]], names=out.names)

    return arrows.modest(docs).mapInArrow(work, out)


def _windows(docs: DataFrame, doc: str, words: int) -> DataFrame:
    """A row for each run of `words` words in the segments `held`: a and h (its segment's), o (its place there), w (its hash),
    __q_doc, at (its first word)."""
    out = T.StructType([*[T.StructField(n, T.LongType()) for n in ("a", "h", "o", "w")], T.StructField("__q_doc", docs.schema[doc].dataType), T.StructField("at", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrows.slices(batches, "text"):
            for row, value in enumerate(arrows.texts(batch.column("text"))):
                runs = _runs(_hashed(value)[:, 1], words).view(np.int64)
                held = pa.RecordBatch.from_struct_array(batch.column("held")[row].values)
                for i in range(0, len(held), 1 << 12):
                    begin, sizes, a, h = (held.column(n).to_numpy()[i : i + (1 << 12)] for n in ("at", "size", "a", "h"))
                    o = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    at = np.repeat(begin, sizes) + o
                    ids = batch.column(0).take(pa.array(np.full(len(at), row)))
                    yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in (np.repeat(a, sizes), np.repeat(h, sizes), o, runs[at])], ids, pa.array(at)], names=out.names)

    return arrows.modest(docs).mapInArrow(work, out)


def _placed(docs: DataFrame, doc: str, words: int) -> DataFrame:
    """__q_doc, th, start, end, kept of each span `held`, which are given by the first words of their first and last runs."""
    out = T.StructType([T.StructField("__q_doc", docs.schema[doc].dataType), *[T.StructField(n, T.LongType()) for n in ("th", "start", "end")], T.StructField("kept", docs.schema[doc].dataType)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrows.slices(batches, "text"):
            for row, value in enumerate(arrows.texts(batch.column("text"))):
                places = np.array([m.span() for m in _WORD.finditer(value)], dtype=np.int64)
                held = pa.RecordBatch.from_struct_array(batch.column("held")[row].values)
                rows = pa.array(np.full(len(held), row))
                start, end = places[held.column("lo").to_numpy(), 0], places[held.column("hi").to_numpy() + words - 1, 1]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start), pa.array(end), held.column("kept")], names=out.names)

    return arrows.modest(docs).mapInArrow(work, out)


def _holding(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """The texts that have a row in `lists` (by __q_doc and th), with its `held`."""
    lists = scratch.cut(lists, "lists").withColumnsRenamed({"__q_doc": "__q_id", "th": "__q_th"})
    return texts.join(lists, F.col("__q_doc").eqNullSafe(F.col("__q_id")) & (F.col("th") == F.col("__q_th"))).select("__q_doc", "th", "text", "held")


def passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = PASSAGE) -> DataFrame:
    """The spans of repeated runs of `words` words or more, wherever they begin: doc_id, start, end, kept_doc_id, one row each.

    A run of exactly `words` words is repeated if an equal one is earlier, by (doc_id, place); within one document only one
    that it doesn't overlap. Overlapping or touching runs are one span; kept_doc_id is the smallest id that keeps one of them.
    Words are normalised as in `repeats`, and nulls, repeated ids, empty tables and other columns are taken as there.

    Only runs with a repeated anchor are compared: each run of `words` words holds the smallest hash of its shorter runs, and
    equal ones hold the same, so that none is lost. Runs with one anchor in common go as one row; they are compared one by one
    only between different such segments of one anchor, once for each. Runs are equal if their anchors and their own hashes,
    64 bits each, are.
    """
    of, made = max(1, words // 2), scratch.written()
    texts = docs.select(docs[doc].alias("__q_doc"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))
    none = F.col("__q_doc").isNull().alias("none")
    rank = F.struct(none, F.col("__q_doc").alias("doc"), F.col("at").alias("at"))
    found = scratch.cut(_segments(texts, "__q_doc", words, of), "segments")
    # an anchor that stands once is no key of any other row
    twice = scratch.cut(found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "anchored")
    held = scratch.cut(found.join(twice, "a", "left_semi"), "held")
    scratch.drop([x for x in scratch.written()[:-1] if x not in made])
    # equal segments are one kind, for which its first one stands
    kinds = held.groupBy("a", "h").agg(F.min("size").alias("size"), F.min(F.struct(none, F.col("__q_doc").alias("doc"), "at", "th")).alias("first"))
    kinds = scratch.cut(kinds, "kinds")
    several = kinds.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    several = scratch.cut(several, "several")
    lists = kinds.join(several, "a", "left_semi").groupBy(F.col("first.doc").alias("__q_doc"), F.col("first.th").alias("th"))
    lists = lists.agg(F.collect_list(F.struct(F.col("first.at").alias("at"), "size", "a", "h")).alias("held"))
    runs = scratch.cut(_windows(_holding(texts, lists), "__q_doc", words), "windows")
    first = runs.groupBy("a", "w").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").drop("n")
    # where the runs of a kind from lo to hi stand first: there the segment would begin at `at`
    source = runs.join(first, ["a", "w"], "left").withColumn("first", F.coalesce("first", rank))
    source = source.select("a", "h", "o", F.struct(F.col("first.none").alias("none"), F.col("first.doc").alias("doc"), (F.col("first.at") - F.col("o")).alias("at")).alias("first"))
    source = source.groupBy("a", "h", "first").agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
    whole = kinds.join(several, "a", "left_anti").select("a", "h", F.struct("first.none", "first.doc", "first.at").alias("first"), F.lit(0).cast("long").alias("lo"), (F.col("size") - 1).cast("long").alias("hi"))
    sources = scratch.cut(source.unionByName(whole), "sources")
    own = F.col("__q_doc").eqNullSafe(F.col("first.doc"))
    later = held.join(sources, ["a", "h"]).where(~own | (F.col("at") >= F.col("first.at") + words))
    later = later.select("__q_doc", "th", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"), F.struct("first.none", "first.doc").alias("kept"))
    rows = Window.partitionBy("__q_doc", "th").orderBy("lo")
    begun = F.coalesce(F.col("lo") > F.max("hi").over(rows.rowsBetween(Window.unboundedPreceding, -1)) + words, F.lit(True)).cast("int")
    spans = later.withColumn("new", begun).withColumn("span", F.sum("new").over(rows)).groupBy("__q_doc", "th", "span")
    spans = spans.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("kept").alias("kept"))
    lists = spans.groupBy("__q_doc", "th").agg(F.collect_list(F.struct("lo", "hi", F.col("kept.doc").alias("kept"))).alias("held"))
    both = _holding(texts, lists)
    scratch.drop([x for x in scratch.written()[:-1] if x not in made])
    placed = _placed(both, "__q_doc", words).dropDuplicates(["__q_doc", "th", "start"])
    return placed.select(F.col("__q_doc").alias(doc), "start", "end", F.col("kept").alias("kept_doc_id"))


def strip(docs: DataFrame, spans: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the spans of `repeats` cut out of their texts; a doc_id's rows all lose its spans.

    Null texts stay null; overlapping spans are cut once; other columns pass through, and an empty table gives an empty one.
    """
    lists = spans.groupBy(F.col(doc).alias("__q_doc")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__q_spans"))
    both = docs.join(lists, docs[doc].eqNullSafe(F.col("__q_doc")), "left").drop("__q_doc")
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrows.slices(batches, text):
            out = []
            for value, spans in zip(batch.column(text), batch.column("__q_spans"), strict=True):
                body, cuts = value.as_py(), spans.as_py()
                if body is None or not cuts:
                    out.append(body)
                    continue
                kept, at = [], 0
                for cut in cuts:
                    kept.append(body[at : cut["start"]])
                    at = max(at, cut["end"])
                out.append("".join([*kept, body[at:]]))
            columns = [pa.array(out, pa.string()) if n == text else batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrows.modest(both).mapInArrow(work, schema)

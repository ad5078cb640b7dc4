"""Line dedup by a log-template tree of fixed depth.

Lines go down a tree: number of tokens, then the leading tokens, tokens with a digit being variable from the start.
In a leaf, a token is constant at a place where two documents of the leaf have it there, and variable elsewhere; a
line's template keeps its constant tokens. Templates that are constant for the most part and recur across documents
are dropped, whatever their variable fields hold. This does not depend on the order of lines, so leaves need no
sequential pass: that two documents have something is a smallest and a largest key that differ, which is partial
before it is shuffled, and no leaf meets in one task.

Copies of a document are one document, or else they would lose all they have and the near-duplicate stage could keep
none of them. So a template recurs if a document has it that is no copy of the first document that has it, where a copy
is one with a Jaccard similarity of COPY or more of its runs of five words, by one-permutation MinHash. (Two documents
that each have 0.65 in common with a third one have at least 0.3 in common.) Recurring templates are dropped from all
documents, copies included, however little is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import arrows, shingling
from quern.plans import scratch

LEADING = 3
CONSTANT = 0.6
COPY = 0.3
BUCKETS = 64
BROADCAST_ROWS = 500_000
_VARIABLE = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _spare(n):
    """How many of n tokens (an array or a Column) can be variable in a template."""
    return n - (F.ceil(n * CONSTANT - 1e-9) if isinstance(n, Column) else np.ceil(n * CONSTANT - 1e-9).astype(np.int64))


class _Lines:
    """The lines with a token of an Arrow column of texts, as arrays: text (index), pos (line in the text), n (tokens),
    leaf, key (of the whole line), start (of its tokens); for each token t (it at its place in the leaf), place, and
    fixed (whether it holds no digit)."""

    def __init__(self, column: pa.Array):
        body, ends = shingling.lowered(*arrows.raw_bytes(column))
        if not len(body):
            body, ends = np.full(1, 32, np.uint8), np.ones(1, np.int64)
        first, last = shingling.word_spans(body, ends)
        self.words = shingling.span_hashes(body, first, last)
        self.word_text = np.searchsorted(ends, first, side="right")
        newline = np.zeros(len(body) + 1, np.int64)
        np.cumsum(body == 10, out=newline[1:])
        digit = np.zeros(len(body) + 1, np.int64)
        np.cumsum((body >= 48) & (body <= 57), out=digit[1:])
        begin = np.concatenate([[0], ends[:-1]])
        line = newline[first] - newline[begin[self.word_text]]
        new = np.ones(len(first), bool)
        new[1:] = (line[1:] != line[:-1]) | (self.word_text[1:] != self.word_text[:-1])
        self.start = np.flatnonzero(new)
        self.n = np.diff(np.append(self.start, len(first)))
        self.text, self.pos = self.word_text[self.start], line[self.start]
        self.fixed = digit[last] == digit[first]
        token = np.where(self.fixed, self.words, _VARIABLE)
        self.place = np.arange(len(first)) - np.repeat(self.start, self.n)
        here = shingling.mix(token + (self.place + 1).astype(np.uint64) * _STEP)
        leaf = shingling.mix(shingling.sums_by(np.where(self.place < LEADING, here, np.uint64(0)), self.n) + self.n.astype(np.uint64) * _STEP)
        self.t = shingling.mix(here ^ np.repeat(leaf, self.n))
        self.leaf = leaf.view(np.int64)
        self.key = shingling.mix(shingling.sums_by(self.t, self.n) + leaf).view(np.int64)

    def count(self, which: np.ndarray) -> np.ndarray:
        """For each line how many of its tokens are in `which`."""
        total = np.concatenate([[0], np.cumsum(which)]).astype(np.int32)
        return total[self.start + self.n] - total[self.start]

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """For each line how many of its fixed tokens are leading, and how many in its probe: more places after the
        leading ones than can be variable in a template, the same ones for all lines of a leaf."""
        last = np.repeat(LEADING + _spare(self.n) + 1, self.n)
        lead = self.place < LEADING
        return self.count(self.fixed & lead), self.count(self.fixed & ~lead & (self.place < last))

    def fixed_tokens(self) -> tuple[pa.ListArray, np.ndarray]:
        """For each line its fixed tokens, in order, and the exclusive or of them."""
        ends = np.concatenate([[0], np.cumsum(self.count(self.fixed))]).astype(np.int32)
        tokens = self.t[self.fixed]
        total = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(tokens)]) if len(tokens) else np.zeros(1, np.uint64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.view(np.int64))), (total[ends[1:]] ^ total[ends[:-1]]).view(np.int64)


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(docs[doc].alias("id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("t"))


def _places(keyed: DataFrame) -> DataFrame:
    """id, th, leaf, lk (key) of each line; sketch (null but in the first line) of the document."""
    schema = T.StructType([keyed.schema["id"], *[T.StructField(k, T.LongType()) for k in ("th", "leaf", "lk")], T.StructField("sketch", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrows.slices(batches, "t"):
            lines = _Lines(batch.column("t"))
            drawn = shingling.sketches(*shingling.runs(lines.words, lines.word_text, batch.num_rows), batch.num_rows, BUCKETS)
            first = np.ones(len(lines.text), bool)
            first[1:] = lines.text[1:] != lines.text[:-1]
            sketch = pa.array([drawn[i].tobytes() if f else None for i, f in zip(lines.text, first, strict=True)], pa.binary())
            at = pa.array(lines.text)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("th").take(at), pa.array(lines.leaf), pa.array(lines.key), sketch], names=schema.names)

    return arrows.modest(keyed).mapInArrow(work, schema)


def _tokens(keyed: DataFrame) -> DataFrame:
    """id, th, pos, n, lead and probe (see _Lines.probes), leaf, lk (key), toks (fixed ones) and x (of them) of each line."""
    ints, longs = ("pos", "n", "lead", "probe"), ("th", "leaf", "lk", "x")
    schema = T.StructType([keyed.schema["id"], *[T.StructField(k, T.LongType()) for k in longs], *[T.StructField(k, T.IntegerType()) for k in ints], T.StructField("toks", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrows.slices(batches, "t"):
            lines = _Lines(batch.column("t"))
            at = pa.array(lines.text)
            toks, x = lines.fixed_tokens()
            numbers = [pa.array(k.astype(np.int32)) for k in (lines.pos, lines.n, *lines.probes())]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("th").take(at), pa.array(lines.leaf), pa.array(lines.key), pa.array(x), *numbers, toks], names=schema.names)

    return arrows.modest(keyed).mapInArrow(work, schema)


def _small(df: DataFrame) -> DataFrame:
    return scratch.small(df, BROADCAST_ROWS)


def _key(c: str) -> Column:
    return F.xxhash64("leaf", c, "x")


def _constant(rows: DataFrame) -> DataFrame:
    """k of the tokens that two documents have at one place; `rows` have k, and lo and hi, two documents of it."""
    return rows.groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select(F.col("k").alias("constant"))


def templates(seen: DataFrame) -> DataFrame:
    """leaf, lk, key (the template's) of the distinct lines of `seen` that are constant for the most part.

    All tokens of a line that two documents have are constant. Of other lines, those go on that have a constant token in
    their probe, as any line must that can pass; only their leaves are counted token by token.
    """
    ends = seen.groupBy("leaf", "lk").agg(F.min("row").alias("one"), F.min("dk").alias("lo"), F.max("dk").alias("hi")).drop("leaf", "lk")
    lines = seen.join(_small(scratch.cut(ends, "ends")), F.col("row") == F.col("one"))
    lines = scratch.cut(lines.select("leaf", "lk", "n", "lo", "hi", "lead", "probe", "x", "toks"), "lines")
    least = F.col("n") - _spare(F.col("n"))
    again = lines.where("lo <> hi").where(F.size("toks") >= least).select("leaf", "lk", F.xxhash64("leaf", F.size("toks").cast("long"), "x").alias("key"))
    probes = lines.select("leaf", "lk", "lo", "hi", F.explode_outer(F.slice("toks", F.col("lead") + 1, F.col("probe"))).alias("k")).where("k IS NOT NULL")
    alive = probes.where("lo = hi").join(_small(scratch.cut(_constant(probes), "probes")), F.col("k") == F.col("constant"), "left_semi").select("leaf", "lk")
    short = lines.where((F.col("lo") == F.col("hi")) & (F.col("n") < LEADING + _spare(F.col("n")) + 1)).select("leaf", "lk")
    alive = scratch.cut(alive.unionByName(short).distinct().withColumnsRenamed({"leaf": "leaf2", "lk": "lk2"}), "alive")
    # keys hold the leaf too, so they name a line or a token by themselves
    rows = lines.join(_small(alive.select("leaf2").distinct()), F.col("leaf") == F.col("leaf2"), "left_semi")
    tokens = rows.select("lo", "hi", F.explode_outer("toks").alias("k")).where("k IS NOT NULL")
    constant = _small(scratch.cut(_constant(tokens), "constant"))
    opened = scratch.cut(lines.join(_small(alive.select("lk2")), F.col("lk") == F.col("lk2"), "left_semi").select("leaf", "lk", "n", "toks"), "open")
    counted = opened.select("lk", F.explode_outer("toks").alias("k")).join(constant, F.col("k") == F.col("constant")).groupBy("lk").agg(F.count("*").alias("c"), F.bit_xor("k").alias("x"))
    counted = opened.select("leaf", F.col("lk").alias("own"), "n").join(counted, F.col("lk") == F.col("own")).where(F.col("c") >= least)
    return again.unionByName(counted.select("leaf", "lk", _key("c").alias("key")))


def _unlike(pairs: DataFrame) -> DataFrame:
    """key of the `pairs` (keys, a, b: two sketches) that are no copies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("a", "b"))
            yield batch.select(["keys"]).filter(pa.array(shingling.likeness(a, b) < COPY))

    return arrows.modest(pairs).mapInArrow(work, "keys array<long>").select(F.explode_outer("keys").alias("key"))


def recurring(found: DataFrame, sketches: DataFrame) -> DataFrame:
    """The keys of the templates that recur; `found` has id, th, key, and `sketches` id, th, sketch of every row."""
    first = found.groupBy("key").agg(F.min(F.struct("id", "th")).alias("r")).select(F.col("key").alias("k"), F.col("r.id").alias("rid"), F.col("r.th").alias("rth"))
    first = scratch.cut(first, "first")
    own = F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))
    pairs = found.select("id", "th", "key").join(_small(first), F.col("key") == F.col("k")).where(~own)
    pairs = scratch.cut(pairs.groupBy("id", "th", "rid", "rth").agg(F.collect_set("key").alias("keys")), "pairs")

    def side(i: str, h: str, x: str) -> DataFrame:
        wanted = _small(scratch.cut(pairs.select(F.col(i).alias("j"), F.col(h).alias("g")).distinct(), "wanted"))
        drawn = sketches.select(F.col("id").alias(f"i{x}"), F.col("th").alias(f"h{x}"), F.col("sketch").alias(x))
        return drawn.join(wanted, F.col(f"i{x}").eqNullSafe(F.col("j")) & (F.col(f"h{x}") == F.col("g")), "left_semi").dropDuplicates([f"i{x}", f"h{x}"])

    rights = scratch.cut(side("rid", "rth", "b"), "rights")
    both = pairs.join(_small(rights), F.col("rid").eqNullSafe(F.col("ib")) & (F.col("rth") == F.col("hb")))
    both = both.join(side("id", "th", "a"), F.col("id").eqNullSafe(F.col("ia")) & (F.col("th") == F.col("ha")))
    return _unlike(both.select("keys", "a", "b")).distinct()


def _without(docs: DataFrame, text: str) -> DataFrame:
    """`docs`, with the lines of the numbers in __q_pos (null: none) taken out of `text`."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != "__q_pos"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrows.slices(batches, text):
            column, gone = batch.column(text), batch.column("__q_pos")
            some = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                out = column.to_pylist()
                for i in some:
                    drop = set(gone[int(i)].as_py())
                    out[i] = "\n".join([x for k, x in enumerate(out[i].split("\n")) if k not in drop])
                column = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([column if n == text else batch.column(n) for n in schema.names], names=schema.names)

    return arrows.modest(docs).mapInArrow(work, schema)


def drop_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", count: bool = False) -> DataFrame:
    """`docs` with the lines of recurring templates taken out of `text`; with `count` also n_lines, n_dropped (long).

    A null text stays null and has no lines; an empty one has one line, which stays, as do all lines without a token.
    A text that loses all of its lines is empty. Texts of any length are handled whole, in time linear in their length.
    Rows that repeat both doc_id and text are one document, and each is cleaned; rows that repeat a doc_id with other
    texts are documents of their own; a null doc_id counts by its text and comes before all others. Other columns pass
    through, but for input columns of the two names with `count`. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if not (count and c in ("n_lines", "n_dropped"))]
    keyed = _keyed(docs, doc, text)
    places = scratch.cut(_places(keyed), "leaves")
    dk = F.xxhash64("id", "th")
    leaves = places.groupBy("leaf").agg(F.min(dk).alias("lo"), F.max(dk).alias("hi"), (F.min("lk") != F.max("lk")).alias("many")).where("lo <> hi")
    leaves = scratch.cut(leaves.select(F.col("leaf").alias("known"), "many"), "known")
    seen = _tokens(keyed).join(_small(leaves), F.col("leaf") == F.col("known")).drop("known")
    seen = scratch.cut(seen.withColumns({"row": F.monotonically_increasing_id(), "dk": dk, "c": F.size("toks").cast("long"), "toks": F.when(F.col("many"), F.col("toks"))}), "seen")
    # where a leaf has one line, all of its tokens are constant
    same = seen.where(~F.col("many") & (F.col("c") >= F.col("n") - _spare(F.col("n")))).select("id", "th", "pos", _key("c").alias("key"))
    kinds = scratch.cut(templates(seen.where("many")).withColumnsRenamed({"leaf": "leaf2", "lk": "lk2"}), "templates")
    found = seen.where("many").select("id", "th", "pos", "leaf", "lk").join(_small(kinds), (F.col("leaf") == F.col("leaf2")) & (F.col("lk") == F.col("lk2")))
    found = scratch.cut(found.select("id", "th", "pos", "key").unionByName(same), "found")
    sketches = places.where("sketch IS NOT NULL").select("id", "th", "sketch")
    gone = scratch.cut(recurring(found, sketches).withColumnRenamed("key", "gone"), "recurring")
    cuts = found.join(_small(gone), F.col("key") == F.col("gone"), "left_semi").groupBy("id", "th").agg(F.collect_set("pos").alias("pos"))
    cuts = scratch.cut(cuts.select(F.col("id").alias("__q_id"), F.col("th").alias("__q_th"), F.col("pos").alias("__q_pos")), "cuts")
    base = docs.select(*[docs[c] for c in names])
    added = []
    if count:
        added = [F.coalesce(F.length(base[text]) - F.length(F.translate(base[text], "\n", "")) + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__q_pos"), F.lit(0)).cast("long").alias("n_dropped")]
    both = base.join(_small(cuts), base[doc].eqNullSafe(F.col("__q_id")) & (F.xxhash64(base[text]) == F.col("__q_th")), "left")
    return _without(both.select(*[base[c] for c in names], *added, F.when(F.size("__q_pos") > 0, F.col("__q_pos")).alias("__q_pos")), text)

"""Exact n-gram Jaccard self-join by vertical partitioning, and its connected components.

Documents of equal shingle sets are one class. All shingles have one global order: estimated frequency (a counting
sketch of fixed size), then hash. A class posts its prefix in that order, of which a partner at the threshold must
share `needed(n)` shingles, a number that grows with the set, so that few pairs are candidates by chance. Postings give candidate pairs under the size and position bounds. The order is cut into fragments, a
candidate's overlap is counted separately in each, and the partial counts are summed per pair: the last fragment has the
frequent shingles, which are the order's end, and the others are ranges of the rest. Before that, the parities of 256
buckets of each set give a least number of shingles in which two sets differ.

Frequent shingles come last in the order. So sets that share no other shingle can only link if a fifth of either at
most is not frequent, and only such sets post frequent ones. These don't emit all pairs: every class with such a shingle is compared with one hub of it first; what
is then in one component needs no more comparing, and the rest goes on with HUBS hubs and GROWTH times as many each round
until no shingle spans two components or all members of a list have been hubs. So no component is split. Hubs are met by
broadcast, or by salted keys where they are too many, so a shingle of any number of sets is dealt to many tasks.

Links are counted afterwards, as all of them lie within components: the sets of a component are dealt into blocks, and
each two blocks are compared by products of 0-1 matrices of the shingles they share. That takes time with the square of
a component's classes, but only counts leave the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import arrows
from quern.llm.shingling import parities, set_id, set_keys, shingles
from quern.operators.components import components
from quern.plans import scratch

PERCENT = 80
FRAGMENTS = 4
SKETCH_BITS = 22
SMALL = 24  # members of a posting list of which all pairs are compared at once
HUBS = 16  # of a frequent shingle in the second round
GROWTH = 64  # of the hubs in each round after
HOT = 10_000  # sets of a shingle that one task meets
SALTS = 64  # tasks that a more frequent shingle is dealt to
HELD = 200_000  # postings that a task holds at once
DEALT = 2_000_000  # shingles for one partition of postings
BROADCAST_ROWS = 1_000_000
BLOCK = 256  # classes of a component that are compared with as many others in one task
COLUMNS = 4096  # shingles of a product
STEP = 25  # words of a set for one more shingle to share


def needed(n):
    """The shingles that sets of this size (an array or a Column) must share in their prefixes: a prefix has one shingle
    more for each beyond the first. Of sets of two sizes the smaller number holds."""
    return 1 + (F.floor(n / STEP).cast("long") if isinstance(n, Column) else n // STEP)


BITS = T.StructType([T.StructField(f"b{k}", T.LongType()) for k in range(4)])


def _bits(words: list[np.ndarray]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(w.view(np.int64)) for w in words], names=[f"b{k}" for k in range(4)])


def _signatures(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """kind 0: doc_id, n, k1, k2, bits (parities) of each document. kind 1: bucket (k1) and count (n) of the sketch, of buckets that
    one task counted well above its mean."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("doc", docs.schema[doc].dataType), T.StructField("n", T.LongType()), *[T.StructField(k, T.LongType()) for k in ("k1", "k2")], T.StructField("bits", BITS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        ids = None
        for batch in arrows.slices(batches, text):
            h, _, n = shingles(*arrows.raw_bytes(batch.column(text)))
            np.add.at(sketch, h >> np.uint64(64 - SKETCH_BITS), 1)
            k1, k2 = set_keys(h, n)
            ids = batch.column(doc)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), ids, pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), _bits(parities(h, n))], names=schema.names)
        if ids is not None:
            mean = sketch.mean()
            full = np.flatnonzero(sketch >= 4 + mean + 6 * mean**0.5)
            nothing = pa.nulls(len(full), ids.type)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(full), np.int32)), nothing, pa.array(sketch[full].astype(np.int64)), pa.array(full.astype(np.int64)), pa.array(np.zeros(len(full), np.int64)), _bits([np.zeros(len(full), np.uint64)] * 4)], names=schema.names)

    return arrows.modest(docs.select(docs[doc].alias(doc), docs[text].alias(text))).mapInArrow(work, schema)


def _frequencies(signatures: DataFrame) -> np.ndarray:
    """For each bucket of the sketch the logarithm of its count, 0 below 32: 4 MB whatever the input."""
    rows = signatures.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).where("n >= 32").select(F.col("k1").cast("int"), F.log2("n").cast("int").alias("c")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def _postings(docs: DataFrame, doc: str, text: str, seed: int, classes, percent: int) -> DataFrame:
    """g (shingle), s (set), n (its size), pos (of g in the order), f (whether g is frequent), nf (frequent ones in the
    prefix) of all prefixes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = classes.value
        for batch in arrows.slices(batches, text):
            h, d, n = shingles(*arrows.raw_bytes(batch.column(text)))
            s = set_id(*set_keys(h, n), seed)
            _, at = np.unique(s, return_index=True)
            once = np.zeros(len(n), bool)
            once[at] = True
            c = known[h >> np.uint64(64 - SKETCH_BITS)]
            order = np.lexsort((h, c, d))
            pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            size = n[d]
            spare = size - (percent * size + 99) // 100
            keep = np.flatnonzero((pos < spare + needed(size)) & once[d])
            g, f, d, pos, spare = h[order[keep]], c[order[keep]] > 0, d[keep], pos[keep], spare[keep]
            nf = np.bincount(d[f], minlength=len(n))
            rare = n - np.bincount(np.repeat(np.arange(len(n)), n)[c > 0], minlength=len(n))
            keep = np.flatnonzero(~f | (rare[d] <= spare))
            g, f, d, pos = g[keep], f[keep], d[keep], pos[keep]
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(s[d]), *(pa.array(x.astype(np.int32)) for x in (n[d], pos)), pa.array(f), pa.array(nf[d].astype(np.int32))], names=["g", "s", "n", "pos", "f", "nf"])

    return arrows.modest(docs.select(docs[doc], docs[text])).mapInArrow(work, "g long, s long, n int, pos int, f boolean, nf int")


def _sets(docs: DataFrame, doc: str, text: str, seed: int, classes) -> DataFrame:
    """s, part, seg: the shingles of each set, cut at fixed places of the global order into fragments, each sorted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = classes.value
        for batch in arrows.slices(batches, text):
            h, d, n = shingles(*arrows.raw_bytes(batch.column(text)))
            s = set_id(*set_keys(h, n), seed)
            part = (h >> np.uint64(32)).astype(np.int64) * (FRAGMENTS - 1) >> 32
            part[known[h >> np.uint64(64 - SKETCH_BITS)] > 0] = FRAGMENTS - 1
            order = np.argsort(d * FRAGMENTS + part, kind="stable")
            h, d, part = h[order], d[order], part[order]
            new = np.flatnonzero(np.diff(d * FRAGMENTS + part, prepend=-1))
            ends = np.append(new, len(h)).astype(np.int32)
            segs = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(s[d[new]]), pa.array(part[new].astype(np.int32)), segs], names=["s", "part", "seg"])

    return arrows.modest(docs.select(docs[doc], docs[text])).mapInArrow(work, "s long, part int, seg array<long>")


def _may_link(n: Column, pos: Column, n2: Column, pos2: Column, percent: int) -> Column:
    """Size and position bounds for two sets of which the k-th shared shingle is at these places, for any k up to the
    needed number: before it they share at most k - 1 others."""
    small, large = F.least(n, n2).cast("long"), F.greatest(n, n2).cast("long")
    return (100 * small >= percent * large) & ((100 + percent) * (F.least(n - pos, n2 - pos2) + needed(small) - 1) >= percent * (n.cast("long") + n2))


def _alike(n: Column, bits: Column, n2: Column, bits2: Column, percent: int) -> Column:
    """Whether the sets can be at the threshold, as they differ in one shingle at least for each bit that differs."""
    both = n.cast("long") + n2
    differing = sum((F.bit_count(bits[f"b{k}"].bitwiseXOR(bits2[f"b{k}"])) for k in range(4)), F.lit(0))
    return (100 + percent) * (both - differing) >= 2 * percent * both


def _short_lists(percent: int):
    """Of all postings of a partition, sorted by g and s: the pairs of lists of up to SMALL members (a < b, n: shared here),
    and as rows with a null b the members of longer lists and of frequent shingles, which are not dealt by shingle. A
    task holds about HELD postings at once; a list that is longer is passed on as it comes."""
    names, fields = ["a", "b", "g", "n", "pos", "nf", "f"], ("g", "s", "n", "pos", "nf")

    def passed(c: dict[str, np.ndarray], frequent: bool) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(c["g"]), 50_000):
            g, s, n, pos, nf = (c[k][at : at + 50_000] for k in fields)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.nulls(len(s), pa.int64()), pa.array(g), *(pa.array(x.astype(np.int32)) for x in (n, pos, nf)), pa.array(np.full(len(s), frequent))], names=names)

    def once(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        new = np.ones(len(c["g"]), bool)
        new[1:] = (c["g"][1:] != c["g"][:-1]) | (c["s"][1:] != c["s"][:-1])
        return {k: v[new] for k, v in c.items()}

    def lists(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], c["g"][1:] != c["g"][:-1]]))
        size = np.diff(np.append(first, len(c["g"])))
        size = np.repeat(size, size)
        yield from passed({k: v[size > SMALL] for k, v in c.items()}, False)
        keep = (size > 1) & (size <= SMALL)
        g, s, n, pos, nf = (c[k][keep] for k in fields)
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        for step in range(1, SMALL):
            if step >= len(g):
                break
            i = np.flatnonzero(g[step:] == g[:-step])
            j = i + step
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (100 * small >= percent * large) & ((100 + percent) * (np.minimum(n[i] - pos[i], n[j] - pos[j]) + needed(small) - 1) >= percent * (n[i] + n[j]))
            a, b, both = s[i[ok]], s[j[ok]], np.minimum(nf[i[ok]], nf[j[ok]])
            if len(a):
                order = np.lexsort((b, a))
                a, b, both = a[order], b[order], both[order]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                times = np.diff(np.append(new, len(a)))
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.nulls(len(new), pa.int64()), pa.array(times.astype(np.int32)), pa.nulls(len(new), pa.int32()), pa.array(both[new].astype(np.int32)), pa.nulls(len(new), pa.bool_())], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        rows, long = 0, None
        for batch in batches:
            f = batch.column("f").to_numpy(zero_copy_only=False)
            c = {k: batch.column(k).to_numpy() for k in fields}
            yield from passed({k: v[f] for k, v in c.items()}, True)
            c = {k: v[~f] for k, v in c.items()}
            if long is not None:  # the list that was passed on so far may go on
                yield from passed({k: v[c["g"] == long] for k, v in c.items()}, False)
                c = {k: v[c["g"] != long] for k, v in c.items()}
            held.append(c)
            rows += len(c["g"])
            if rows < HELD:
                continue
            c = once({k: np.concatenate([x[k] for x in held]) for k in fields})
            cut = int(np.searchsorted(c["g"], c["g"][-1]))
            head, tail = ({k: v[part] for k, v in c.items()} for part in (slice(0, cut), slice(cut, None)))
            if cut:
                yield from lists(head)
            long = None
            if len(tail["g"]) > SMALL:
                long = tail["g"][0]
                yield from passed(tail, False)
                tail = {k: v[:0] for k, v in tail.items()}
            held, rows = [tail], len(tail["g"])
        if rows:
            yield from lists(once({k: np.concatenate([x[k] for x in held]) for k in fields}))

    return work


def _met(heavy: DataFrame, hubs: DataFrame, by: list[str]) -> DataFrame:
    """`heavy` and `hubs` joined on `by`; `hubs` has many, the number of rows that heavy has of its g. Where the hubs are
    too many for a broadcast, those of shingles beyond HOT rows are few, and are broadcast or salted by themselves."""
    hubs = scratch.cut(hubs, "hubs")
    if scratch.fits(hubs, BROADCAST_ROWS):
        return heavy.join(F.broadcast(hubs), by).drop("many")
    hot, cold = hubs.where(F.col("many") > HOT), hubs.where(F.col("many") <= HOT)
    names = scratch.small(scratch.cut(hot.select("g").distinct(), "hot"), BROADCAST_ROWS)
    rest = heavy.join(names, "g", "left_anti").join(cold, by)
    if scratch.fits(hot, BROADCAST_ROWS):
        met = heavy.join(F.broadcast(hot), by)
    else:
        dealt = heavy.join(names, "g", "left_semi").withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(SALTS)).cast("int"))
        met = dealt.join(hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*by, "salt"]).drop("salt")
    return rest.unionByName(met).drop("many")


def _promising(pairs: DataFrame, shared: DataFrame, often: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), with their sizes, that can be at the threshold by their parities, and that can share as many prefix shingles as they need: those counted in short
    lists, and at most as many of frequent ones and of long lists as either has."""
    sizes = classes.join(often, "s", "left").select("s", "n", "bits", F.coalesce("nf", F.lit(0)).alias("nf"), F.coalesce("long", F.lit(0)).alias("long"))
    side = lambda x: sizes.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"), F.col("nf").alias(f"nf_{x}"), F.col("long").alias(f"long_{x}"))
    out = pairs.join(shared, ["a", "b"], "left").join(side("a"), "a").join(side("b"), "b")
    most = F.coalesce("shared", F.lit(0)) + F.coalesce("both_nf", F.least("nf_a", "nf_b")) + F.least("long_a", "long_b")
    out = out.where(_alike(F.col("na"), F.col("bits_a"), F.col("nb"), F.col("bits_b"), percent))
    return out.where(most >= needed(F.least("na", "nb"))).select("a", "b", "na", "nb", F.coalesce("shared", F.lit(0)).alias("shared"))


def _verify(pairs: DataFrame, labels: DataFrame | None, classes: DataFrame, docs: DataFrame, doc: str, text: str, seed: int, percent: int, frequent) -> DataFrame | None:
    """The labels after the links among `pairs` (a, b, na, nb, shared); None if there is no link.

    The sets are made again, from the texts of the documents that stand for them. Pairs go in three waves: for each
    set its best partner; for each two components one pair; all that are left. Pairs of one component need no more
    comparing, so a large group is joined by about as many comparisons as it has members.
    """
    ids = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    reps = scratch.cut(classes.join(ids, "s", "left_semi").select(F.col("rep").alias("__q_rep")).distinct(), "wanted")
    reps = F.broadcast(reps) if scratch.fits(reps, BROADCAST_ROWS) else reps
    source = docs.select(docs[doc].alias(doc), docs[text].alias(text))
    source = source.join(reps, source[doc].eqNullSafe(reps["__q_rep"]), "left_semi")
    sets = scratch.cut(_sets(source, doc, text, seed, frequent), "sets")
    any_link, left = False, pairs.withColumns({"ra": F.col("a"), "rb": F.col("b")})
    for wave in range(3):
        if labels is not None:
            known = lambda x: labels.select(F.col("id").alias(f"i{x}"), F.col("root").alias(f"r{x}"))
            left = left.drop("ra", "rb").join(known("a"), F.col("a") == F.col("ia"), "left").join(known("b"), F.col("b") == F.col("ib"), "left")
            left = left.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb").drop("ia", "ib")
            left = scratch.cut(left, "left")
            if left.isEmpty():
                break
        now = left
        if wave < 2:
            by = [F.col("b").alias("x")] if wave == 0 else [F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")]
            rank = F.col("shared") * 1048576 + F.pmod(F.xxhash64("a"), F.lit(1048576))
            best = left.select(*by, rank.alias("rank")).groupBy(*[c for c in ("x", "y")[: wave + 1]]).agg(F.max("rank").alias("best"))
            on = (F.col("b") == F.col("x")) if wave == 0 else (F.least("ra", "rb") == F.col("x")) & (F.greatest("ra", "rb") == F.col("y"))
            now = left.join(best, on & (rank == F.col("best")), "left_semi")
        now = scratch.cut(now.select("a", "b", "na", "nb"), "wave")
        found = scratch.cut(_linked(now, sets, percent), "links")
        left = left.join(now.select("a", "b"), ["a", "b"], "left_anti")
        if not found.isEmpty():
            any_link = True
            edges = found if labels is None else found.unionByName(labels.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")))
            labels = scratch.cut(components(edges), "labels")
    return labels if any_link else None


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose overlap, counted by fragment and summed, reaches the threshold."""
    segs_a, segs_b = sets.select(F.col("s").alias("a"), "part", F.col("seg").alias("seg_a")), sets.select(F.col("s").alias("b"), "part", F.col("seg").alias("seg_b"))
    counted = pairs.join(segs_a, "a").join(segs_b, ["b", "part"]).select("a", "b", "na", "nb", "part", F.size(F.array_intersect("seg_a", "seg_b")).alias("both"))
    shared = counted.groupBy("a", "b", "na", "nb", "part").agg(F.max("both").alias("both")).groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return shared.where((100 + percent) * F.col("both") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _overlaps(g: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """For each two of k sets the number of shingles in both; `g` are the shingles, `owner` their sets."""
    _, column, times = np.unique(g, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    column, owner = np.unique(column[keep], return_inverse=True)[1], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((k, k), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        a = np.zeros((k, int(column[j - 1]) - low + 1), np.float32)
        a[owner[i:j], column[i:j] - low] = 1
        out += (a @ a.T).astype(np.int64)
    return out


def _degrees(rooted: DataFrame, labels: DataFrame, docs: DataFrame, doc: str, text: str, seed: int, percent: int, frequent) -> DataFrame:
    """s, n_links: for each class the number of other classes at the threshold. `rooted` has s, n, rep, root."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = lambda df: F.broadcast(df) if scratch.fits(df, BROADCAST_ROWS) else df
    sizes = labels.groupBy(F.col("root").alias("__q_root")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = scratch.cut(sizes, "sizes")
    members = rooted.join(small(sizes), F.col("root") == F.col("__q_root")).drop("__q_root")
    members = scratch.cut(members.withColumn("block", F.pmod(F.xxhash64("s"), "blocks").cast("int")), "members")
    reps = small(scratch.cut(members.select(F.col("rep").alias("__q_rep")).distinct(), "wanted"))
    source = docs.select(docs[doc].alias(doc), docs[text].alias(text))
    source = source.join(reps, source[doc].eqNullSafe(reps["__q_rep"]), "left_semi")
    rows = _sets(source, doc, text, seed, frequent).join(small(members.drop("rep")), "s")
    rows = rows.select("s", "n", "root", "block", "blocks", "seg", F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    alone = F.col("blocks") == 1  # small components share groups
    rows = rows.select("s", "n", "root", "block", "seg", F.when(alone, F.pmod(F.xxhash64("root"), F.lit(8 * width))).otherwise(F.col("root")).alias("x"), F.when(alone, -1).otherwise(F.least("block", "other")).alias("i"), F.when(alone, -1).otherwise(F.greatest("block", "other")).alias("j"))

    def work(group: pa.Table) -> pa.Table:
        s, n, root, block, i, j = (group.column(c).to_numpy() for c in ("s", "n", "root", "block", "i", "j"))
        segs = group.column("seg").combine_chunks()
        g, lengths = segs.flatten().to_numpy(), segs.value_lengths().to_numpy()
        ids, at, which = np.unique(s, return_index=True, return_inverse=True)
        n, root, block = n[at].astype(np.int64), root[at], block[at]
        owner = np.repeat(which, lengths)
        order = np.argsort(root[owner], kind="stable")
        g, owner = g[order], owner[order]
        cuts = np.flatnonzero(np.diff(root[owner], prepend=root[owner[0]] - 1))
        degree = np.zeros(len(ids), np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(g)), strict=True):
            here, local = np.unique(owner[a:b], return_inverse=True)
            ok = (100 + percent) * _overlaps(g[a:b], local, len(here)) >= percent * (n[here][:, None] + n[here][None, :])
            np.fill_diagonal(ok, False)
            if i[0] < j[0]:
                ok &= block[here][:, None] != block[here][None, :]
            degree[here] = ok.sum(axis=1)
        return pa.table({"s": ids, "n_links": degree})

    return rows.groupBy("x", "i", "j").applyInArrow(work, "s long, n_links long").groupBy("s").agg(F.sum("n_links").alias("n_links"))


def link(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT, count: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (the smallest doc_id of its shingle set), n_links (the number
    of other classes that its class links with; not counted and 0 without `count`), component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct five-word shingles (A-Z
    lower-cased; fewer words are one shingle). A null or empty text has no shingles, links with nothing and is its
    own component. A null doc_id ranks last: its component is named by the smallest other doc_id reached, else
    null. Rows that repeat a doc_id each have a row; equal texts are of one class. Input columns other than the
    two are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    signatures = scratch.cut(_signatures(docs, doc, text), "signatures")
    own = signatures.where("kind = 0 AND n > 0")
    frequent = spark.sparkContext.broadcast(_frequencies(signatures))
    for seed in range(8):  # another one if two different sets happen to get one id
        named = scratch.cut(_named(own, seed), "named")
        classes = scratch.cut(named.groupBy("s", "n", "k1", "k2", "bits").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "classes")
        if classes.groupBy("s").count().where("count > 1").isEmpty():
            break
    postings = _postings(docs, doc, text, seed, frequent, percent)
    total = classes.agg(F.sum("n")).first()[0] or 0
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / DEALT))
    dealt = postings.repartition(width, F.when(F.col("f"), F.xxhash64("g", "s")).otherwise(F.col("g")))
    lists = scratch.cut(arrows.modest(dealt).sortWithinPartitions("g", "s").mapInArrow(_short_lists(percent), "a long, b long, g long, n int, pos int, nf int, f boolean"), "lists")
    members = scratch.cut(lists.where("b IS NULL").select("g", F.col("a").alias("s"), "n", "pos", "nf", "f").distinct(), "members")
    often = scratch.cut(members.groupBy("s").agg(F.max("nf").alias("nf"), F.count_if(~F.col("f")).alias("long")), "often")
    heavy = scratch.cut(members.select("g", "s", "n", "pos").join(classes.select(F.col("s").alias("x"), "bits"), F.col("s") == F.col("x")).drop("x"), "heavy")
    # edits bring rare shingles, which come first: a text that others were copied from has the smallest position
    hubs = heavy.groupBy("g").agg(F.min(F.struct("pos", "s", "n", "bits")).alias("at"), F.count("*").alias("many")).where("many > 1")
    hubs = hubs.select("g", "many", F.col("at.s").alias("hub"), F.col("at.n").alias("n2"), F.col("at.pos").alias("pos2"), F.col("at.bits").alias("bits2"))
    stars = _met(heavy, hubs, ["g"]).where((F.col("s") != F.col("hub")) & _alike(F.col("n"), F.col("bits"), F.col("n2"), F.col("bits2"), percent) & _may_link(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"), percent)).select(F.col("hub").alias("a"), F.col("s").alias("b"))
    shared = lists.where("b IS NOT NULL").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("shared"), F.max("nf").alias("both_nf"))
    shared = scratch.cut(shared, "shared")
    pairs = shared.select("a", "b").unionByName(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    pairs = scratch.cut(_promising(pairs, shared, often, classes, percent), "pairs")
    got = _verify(pairs, None, classes, docs, doc, text, seed, percent, frequent)
    labels = got or spark.createDataFrame([], "id long, root long")
    done, more, last = pairs.select("a", "b"), HUBS, False
    while not last:
        known = heavy.join(labels, heavy["s"] == labels["id"], "left").select("g", "s", "n", "pos", "bits", F.coalesce("root", "s").alias("root"))
        open_lists = known.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high").select(F.col("g").alias("h"), "size")
        heavy = scratch.cut(known.join(scratch.small(scratch.cut(open_lists, "open"), BROADCAST_ROWS), F.col("g") == F.col("h")).select("g", "s", "n", "pos", "bits", "root", "size"), "open")
        most = heavy.agg(F.max("size")).first()[0]
        if most is None:
            break
        last = more >= most
        chosen = heavy.where(F.lit(last) | (F.pmod(F.xxhash64("s", F.lit(more)), F.col("size")) < more))
        # a hub meets only the sizes that its own size and position allow: at most three bands of a factor each
        band = lambda n: F.floor(F.log(n) / math.log(100 / percent)).cast("int")
        most_n = F.least(F.floor(100 * F.col("n2") / percent), F.floor(((100 + percent) * (F.col("n2") - F.col("pos2") + needed(F.col("n2")) - 1) - percent * F.col("n2")) / percent))
        least_n = F.ceil(percent * F.col("n2") / 100)
        chosen = chosen.select("g", F.col("size").alias("many"), F.col("s").alias("hub"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("bits").alias("bits2"), F.col("root").alias("root2"))
        chosen = chosen.where(least_n <= most_n).select("*", F.explode_outer(F.sequence(band(least_n), band(most_n))).alias("band"))
        heavy = heavy.withColumn("band", band(F.col("n")))
        new = _met(heavy, chosen, ["g", "band"]).where((F.col("root") != F.col("root2")) & _alike(F.col("n"), F.col("bits"), F.col("n2"), F.col("bits2"), percent) & _may_link(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"), percent))
        new = new.select(F.least("s", "hub").alias("a"), F.greatest("s", "hub").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        new = scratch.cut(_promising(new, shared, often, classes, percent), "pairs")
        heavy, more = heavy.select("g", "s", "n", "pos", "bits"), more * GROWTH
        if new.isEmpty():
            continue
        done = done.unionByName(new.select("a", "b"))
        got = _verify(new, labels, classes, docs, doc, text, seed, percent, frequent)
        if got:
            labels = got
    rooted = classes.join(labels, classes["s"] == labels["id"], "left").select("s", "n", "rep", F.coalesce("root", "s").alias("root"))
    rooted = scratch.cut(rooted, "rooted")
    degree = scratch.cut(_degrees(rooted, labels, docs, doc, text, seed, percent, frequent), "degrees") if count else spark.createDataFrame([], "s long, n_links long")
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named_classes = rooted.join(smallest, "root").join(degree, "s", "left").select("s", F.col("rep").alias("class_id"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    linked = named.join(named_classes, "s").select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), "class_id", "n_links", "component_id")
    alone = signatures.where("kind = 0 AND n = 0").select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc").alias("component_id"))
    return linked.unionByName(alone)


def _named(own: DataFrame, seed: int) -> DataFrame:
    """Adds s, the set's id under this seed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("k1", "k2"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(set_id(k1, k2, seed))], names=["doc", "n", "k1", "k2", "bits", "s"])

    source = own.select("doc", "n", "k1", "k2", "bits")
    return arrows.modest(source).mapInArrow(work, T.StructType([*source.schema.fields, T.StructField("s", T.LongType())]))


def keep_one(docs: DataFrame, linked: DataFrame, doc: str = "doc_id") -> DataFrame:
    """`docs` without all documents but the smallest doc_id of each component. A null doc_id stays."""
    gone = linked.where(F.col(doc) != F.col("component_id")).select(F.col(doc).alias("__q_gone")).distinct()
    gone = scratch.cut(gone, "gone")
    gone = F.broadcast(gone) if scratch.fits(gone, BROADCAST_ROWS) else gone
    return docs.join(gone, docs[doc] == gone["__q_gone"], "left_anti")

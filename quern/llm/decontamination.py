"""Benchmark decontamination by SimHash over item-sized windows.

An item's shingles are its runs of five words (lower case). A document's windows have as many words as an item, and
a 64-bit SimHash of their shingles, each counted as often as it occurs. Fingerprints are cut into BLOCKS blocks; two
fingerprints within the radius differ by RADIUS // BLOCKS bits or fewer in one block at least, so the items are entered
under every value within that distance of each of their blocks, and a join on (window size, block, value) finds all
pairs within the radius. Only ids go through that join. The pairs are verified by the exact weighted Jaccard similarity
of the shingles (sum of the smaller counts over sum of the larger ones).

Only windows that could pass are fingerprinted: those that share a shingle with an item of their size, in documents
where at least THRESHOLD times the item's shingles occur. No window beyond that bound can reach the threshold.
Items of fewer than five words have the whole sequence as their one shingle, so a window of their size is equal or not
similar at all; those are found by that shingle alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans import scratch

WIDTH = 5
THRESHOLD = 0.8
RADIUS = 18
BLOCKS = 5
BROADCAST_ROWS = 500_000
_SEPARATORS = "\t\n\u000b\f\r"


def words(text: Column) -> Column:
    flat = F.translate(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS, " " * 5)
    return F.array_remove(F.split(flat, " "), "")


def shingles(w: Column) -> Column:
    """The hash of each run of WIDTH words, in order; `w` must be a plain column."""
    return F.transform(F.slice(w, WIDTH, F.greatest(F.size(w) - (WIDTH - 1), F.lit(0))), lambda x, i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH - 1)], x))


def _lanes(grams: Column, lanes: int) -> Column:
    """Counts of the 64 bits over an array of hashes, 64 // lanes of them at once, in lanes of equal width of a long."""
    width = 64 // lanes
    ones = F.lit(sum(1 << i * lanes for i in range(width)))

    def count(k: int) -> Column:
        return F.aggregate(grams, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(ones))

    return F.array(*[count(k) for k in range(lanes)])


def with_simhash(df: DataFrame, grams: str, name: str) -> DataFrame:
    """Adds the 64-bit SimHash of the array column `grams`, repeats counted. The sums of arrays of up to 32,767 hashes
    have lanes of 16 bits, those of longer ones 32. They have a step of their own, so each is made once."""
    out = df.withColumn("__q_l", F.when(F.size(grams) < 1 << 15, _lanes(F.col(grams), 16)).otherwise(_lanes(F.col(grams), 32)))
    # the lanes are named often, so that the optimizer keeps their step apart
    count = "if(size(__q_l) = 16, shiftrightunsigned(__q_l[b % 16], 16 * cast(b div 16 AS INT)) & 65535L, shiftrightunsigned(__q_l[b % 32], 32 * cast(b div 32 AS INT)) & 4294967295L)"
    bits = f"aggregate(sequence(0, 63), 0L, (a, b) -> a | if(2 * ({count}) > size({grams}), shiftleft(1L, b), 0L))"
    return out.withColumn(name, F.expr(f"if(size(__q_l) > 0, {bits}, NULL)")).drop("__q_l")


def block_masks(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(shift, bits) of blocks that cover 64 bits."""
    at, out = 0, []
    for i in range(blocks):
        bits = 64 // blocks + (i < 64 % blocks)
        out.append((at, bits))
        at += bits
    return out


def _values(fingerprint: Column, blocks: int) -> Column:
    """The value of each block."""
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << bits) - 1)).alias("value")) for i, (at, bits) in enumerate(block_masks(blocks))])


def _index(items: DataFrame, radius: int, blocks: int) -> DataFrame:
    """item, m2, fp2, block2, value2: every value that a fingerprint within the radius may have in one block."""
    rows = items.select("item", F.col("m").alias("m2"), F.col("fp").alias("fp2"), F.explode_outer(_values(F.col("fp"), blocks)).alias("b"))
    widths = ", ".join(str(bits) for _, bits in block_masks(blocks))
    masks = F.expr(f"filter(sequence(0L, shiftleft(1L, get(array({widths}), b.block)) - 1), x -> bit_count(x) <= {radius // blocks})")
    rows = rows.select("item", "m2", "fp2", F.col("b.block").alias("block2"), F.col("b.value").alias("v"), F.explode_outer(masks).alias("mask"))
    return rows.select("item", "m2", "fp2", "block2", F.col("v").bitwiseXOR(F.col("mask")).alias("value2"))


def _verified(pairs: DataFrame, windows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """id, item, start, similarity of the `pairs` (id, th, m, start, item) at the threshold."""
    near = windows.join(_small(pairs.withColumnsRenamed({"id": "i", "th": "h", "m": "k", "start": "s"})), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")) & (F.col("m") == F.col("k")) & (F.col("start") == F.col("s")))
    near = near.select("id", "th", "m", "start", "item", "grams").join(_small(items.select(F.col("item").alias("item2"), F.col("m").alias("m2"), F.col("grams").alias("grams2")).dropDuplicates(["item2", "grams2"])), F.col("item").eqNullSafe(F.col("item2")) & (F.col("m") == F.col("m2")))
    near = near.select("id", "th", "start", "item", "grams", "grams2", (F.size("grams") + F.size("grams2")).alias("both"))
    near = near.withColumn("once", (F.size(F.array_distinct("grams")) == F.size("grams")) | (F.size(F.array_distinct("grams2")) == F.size("grams2")))
    near = scratch.cut(near, "near")
    plain = near.where("once").select("id", "item", "start", "both", F.size(F.array_intersect("grams", "grams2")).alias("shared"))
    # where both repeat shingles, the smaller counts are summed hash by hash
    key = ["id", "th", "start", "item", "both"]
    twice = near.where("NOT once").withColumn("which", F.xxhash64("grams2"))
    side = lambda c, n: twice.select(*key, "which", F.explode_outer(c).alias("h")).groupBy(*key, "which", "h").agg(F.count("*").alias(n))
    a, b = side("grams", "a"), side("grams2", "b").select(*[F.col(c).alias(f"{c}2") for c in (*key, "which", "h")], "b")
    on = F.lit(True)
    for c in (*key, "which", "h"):
        on = on & F.col(c).eqNullSafe(F.col(f"{c}2"))
    counted = a.join(b, on).groupBy(*key, "which").agg(F.sum(F.least("a", "b")).cast("int").alias("shared")).select("id", "item", "start", "both", "shared")
    return plain.unionByName(counted).select("id", "item", "start", (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= threshold)


def _short(texts: DataFrame, items: DataFrame) -> DataFrame:
    """id, item, start, similarity of all windows that equal an item of fewer than WIDTH words."""
    sizes = sorted(r.m for r in items.select("m").distinct().collect())  # WIDTH - 1 at most
    whole = lambda size, w, i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])

    def windows(m: int) -> Column:
        starts = F.slice("w", 1, F.greatest(F.size("w") - (m - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: F.struct(F.lit(m).alias("m"), i.alias("start"), whole(m, F.col("w"), i).alias("g")))

    found = texts.select("id", "th", F.explode_outer(F.concat(*map(windows, sizes))).alias("x")).select("id", "th", "x.*")
    hashed = [items.where(F.col("m") == m).select("item", "m", whole(m, F.col("w"), F.lit(0)).alias("g")) for m in sizes]
    keys = reduce(DataFrame.unionByName, hashed).distinct()
    return found.join(_small(keys), ["m", "g"]).select("id", "th", "item", "start").distinct().select("id", "item", "start", F.lit(1.0).alias("similarity"))


def _small(df: DataFrame) -> DataFrame:
    return scratch.small(df, BROADCAST_ROWS)


def find(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """A row for each document and item of which a window reaches the threshold: doc_id, item_id, similarity (of its
    best window), start (the first word of the first such window), n_windows (windows that reach the threshold).

    A document that is shorter than the item is one window as a whole. Items of fewer than five words have one shingle;
    items without a word, and null ones, are not looked for; null texts are empty. Items and texts may be of any length,
    but a text is given all windows of an item's size that could pass, so very long items cost most. Rows that repeat a doc_id are looked at one by one and
    reported together; rows with a null doc_id are reported under null. Repeated items are found under each of
    their ids. Benchmark tables are broadcast if they have BROADCAST_ROWS shingles and 64 MB at most; larger ones are
    joined by shuffles. Empty tables give no rows. Input columns other than the named ones are ignored.
    """
    items = benchmark.select(benchmark[item].alias("item"), words(benchmark[item_text]).alias("w"))
    short = scratch.cut(items.where(F.size("w").between(1, WIDTH - 1)).select("item", F.size("w").alias("m"), "w"), "short-items")
    items = items.select("item", F.size("w").alias("m"), shingles(F.col("w")).alias("grams")).where(f"m >= {WIDTH}")
    items = scratch.cut(with_simhash(items, "grams", "fp"), "items")
    item_grams = items.select("item", "m", F.explode(F.array_distinct("grams")).alias("g"))
    all_grams = scratch.cut(item_grams.select(F.col("g").alias("h")).distinct(), "item-grams")

    # explode_outer throughout: for explode, the optimizer adds a filter on the array's size and moves it below the
    # steps that make the array, where a lambda would compute them again for every element
    key = [F.col("id"), F.col("th")]
    base = docs.select(docs[doc].alias("id"), docs[text].alias("t"))
    texts = base.select("id", F.xxhash64("t").alias("th"), words(F.col("t")).alias("w"))
    hits = texts.select(*key, F.size("w").alias("n"), shingles(F.col("w")).alias("s")).select(*key, "n", F.posexplode_outer("s").alias("pos", "g"))
    hits = scratch.cut(hits.join(_small(all_grams), F.col("g") == F.col("h"), "left_semi"), "hits")
    at = hits.join(_small(item_grams), "g").groupBy("id", "th", "n", "item", "m").agg(F.collect_set("pos").alias("at"))
    at = at.where(F.size("at") >= F.ceil(threshold * (F.col("m") - (WIDTH - 1))))
    # every window that holds one of the positions: all of the document where it is shorter than the item
    last = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(F.least(F.greatest(p - (F.col("m") - WIDTH), F.lit(0)), last), F.least(p, last)))))
    wanted = at.select("id", "th", "m", F.explode_outer(starts).alias("start")).distinct().groupBy("id", "th").agg(F.collect_list(F.struct("m", "start")).alias("wins"))
    wanted = scratch.cut(wanted.select(F.col("id").alias("wid"), F.col("th").alias("wth"), "wins"), "wanted")

    ids = _small(wanted.select("wid").distinct())
    again = base.join(ids, base["id"].eqNullSafe(ids["wid"]), "left_semi").select("id", F.xxhash64("t").alias("th"), words(F.col("t")).alias("w")).select(*key, shingles(F.col("w")).alias("s"))
    again = again.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))).dropDuplicates(["id", "th"])
    windows = again.select(*key, F.explode_outer(F.transform("wins", lambda x: F.struct(x["m"].alias("m"), x["start"].alias("start"), F.slice(F.col("s"), x["start"] + 1, x["m"] - (WIDTH - 1)).alias("grams")))).alias("x")).select(*key, "x.*")
    windows = scratch.cut(with_simhash(windows, "grams", "fp"), "windows")

    index = _small(scratch.cut(_index(items, radius, blocks), "index"))
    probes = windows.select(*key, "m", "start", "fp", F.explode_outer(_values(F.col("fp"), blocks)).alias("b")).select(*key, "m", "start", "fp", "b.*")
    pairs = probes.join(index, (F.col("m") == F.col("m2")) & (F.col("block") == F.col("block2")) & (F.col("value") == F.col("value2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius))
    pairs = scratch.cut(pairs.select(*key, "m", "start", "item").distinct(), "pairs")
    similar = _verified(pairs, windows, items, threshold)
    if not short.isEmpty():
        similar = similar.unionByName(_short(texts, short))
    best = similar.groupBy("id", "item").agg(F.max("similarity").alias("similarity"), F.min("start").alias("start"), F.count("*").alias("n_windows"))
    return best.select(F.col("id").alias(doc), F.col("item").alias(item), "similarity", F.col("start").cast("long").alias("start"), "n_windows")


def drop(docs: DataFrame, found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """`docs` without the documents in `found`; a null doc_id stays."""
    gone = scratch.cut(found.select(F.col(doc).alias("__q_gone")).where("__q_gone IS NOT NULL").distinct(), "gone")
    return docs.join(_small(gone), docs[doc] == F.col("__q_gone"), "left_anti")

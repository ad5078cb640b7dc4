"""Density clusters of short texts by cosine similarity of their character n-grams.

An inverted index gives the pairs: texts that share no gram have similarity 0 and are never compared. Grams,
weights, neighbours and components are all frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.components import components
from quern.plans import scratch

EPS, LEAST_MEMBERS, SIZES = 0.35, 3, (2, 3, 4)


def grams(texts: DataFrame, column: str) -> DataFrame:
    """doc, g, tf: n-grams within words, which are padded by a blank on either side; a word that is no longer than n
    gives one gram."""
    words = texts.select(F.col(column).alias("doc"), F.explode(F.split(F.lower(F.trim(column)), r"\s+")).alias("w")).select("doc", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    lists = [F.expr(f"transform(sequence(1, greatest(length(w) - {n} + 1, 1)), i -> substring(w, i, {n}))") for n in SIZES]
    # a word shorter than n is counted once, for the first such n
    lists = [lists[0], *[F.when(F.length("w") > n - 1, x).otherwise(F.array().cast("array<string>")) for n, x in zip(SIZES[1:], lists[1:], strict=True)]]
    return words.select("doc", F.explode(F.concat(*lists)).alias("g")).groupBy("doc", "g").agg(F.count("*").alias("tf"))


def weights(texts: DataFrame, column: str) -> DataFrame:
    """doc, g, w: tf * (ln((1 + N) / (1 + df)) + 1), each text's vector of length 1."""
    tf = scratch.cut(grams(texts, column), "grams")
    total = tf.select("doc").distinct().count()
    df = tf.groupBy("g").agg(F.count("*").alias("df"))
    raw = tf.join(df, "g").select("doc", "g", (F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1)).alias("x"))
    norms = raw.groupBy(F.col("doc").alias("d")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norms, F.col("doc") == F.col("d")).select("doc", "g", (F.col("x") / F.col("norm")).alias("w"))


def neighbours(texts: DataFrame, column: str, eps: float = EPS) -> DataFrame:
    """a, b: ordered pairs of different texts at a cosine distance of at most `eps`.

    Grams are ordered by their number of texts, rare ones first, and a text is entered under those grams only after
    which the rest of its vector is still as long as the similarity looked for. The first gram that two near texts share
    is one of these for both, so frequent grams make pairs only where texts have little else.
    """
    least = 1 - eps - 1e-12
    w = scratch.cut(weights(texts, column), "weights")
    often = w.groupBy(F.col("g").alias("h")).agg(F.count("*").alias("df"))
    from_here = Window.partitionBy("doc").orderBy(F.col("df").desc(), F.col("g").desc())
    entered = w.join(often, F.col("g") == F.col("h")).withColumn("rest", F.sum(F.col("w") * F.col("w")).over(from_here)).where(F.col("rest") >= least * least - 1e-9)
    entered = scratch.cut(entered.select("doc", "g"), "entered")
    pairs = entered.select(F.col("doc").alias("a"), "g").join(entered.select(F.col("doc").alias("b"), "g"), "g").where("a < b").select("a", "b").distinct()
    counted = pairs.join(w.select(F.col("doc").alias("a"), "g", F.col("w").alias("wa")), "a").join(w.select(F.col("doc").alias("b"), "g", F.col("w").alias("wb")), ["b", "g"])
    near = counted.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cos")).where(F.col("cos") >= least).select("a", "b")
    near = scratch.cut(near, "alike")
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))


def density_clusters(texts: DataFrame, column: str, eps: float = EPS, least: int = LEAST_MEMBERS) -> DataFrame:
    """column, cluster: members of clusters; texts without a cluster have no row.

    A core has `least` texts or more within eps, itself included. Cores within eps of each other are of one
    cluster; another text joins the cluster of its smallest neighbouring core. A cluster is named by a digest of
    its smallest core, so that names don't depend on the order of rows.
    """
    near = scratch.cut(neighbours(texts, column, eps), "near")
    cores = scratch.cut(near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= least).select(F.col("a").alias("core")), "cores")
    between = near.join(cores, F.col("a") == F.col("core"), "left_semi").join(cores, F.col("b") == F.col("core"), "left_semi")
    linked = components(between)
    roots = cores.join(linked, F.col("core") == F.col("id"), "left").select("core", F.coalesce("root", "core").alias("root"))
    border = near.join(cores, F.col("a") == F.col("core"), "left_anti").join(cores, F.col("b") == F.col("core")).groupBy("a").agg(F.min("core").alias("to"))
    members = roots.select(F.col("core").alias("doc"), "root").unionByName(border.join(roots, F.col("to") == F.col("core")).select(F.col("a").alias("doc"), "root"))
    return members.select(F.col("doc").alias(column), F.substring(F.sha2("root", 256), 1, 10).alias("cluster"))

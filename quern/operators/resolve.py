"""Merchant resolution: normalised text, then exact, similar, clustered or unresolved; and category imputation.

Each tier works on the distinct normalised descriptors that are left, which joins back once at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import cleaning as c
from quern.functions.similarity import Candidates, best_match, token_set_ratio
from quern.operators.cluster import density_clusters
from quern.plans import scratch

SIMILAR = 88.0
ALIASES = 500_000  # of a dictionary that is broadcast
TIERS = ("exact", "fuzzy", "cluster")


def exact(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """names (descriptor_clean, n) with the dictionary's columns where the alias is equal; of equal aliases the last."""
    best = dictionary.groupBy("alias").agg(F.max_by("merchant_id", "position").alias("merchant_id"), F.max_by("canonical_name", "position").alias("merchant_name"))
    return names.join(scratch.small(best, ALIASES), F.col("descriptor_clean") == F.col("alias"), "left").drop("alias")


def similar(names: DataFrame, dictionary: DataFrame, least: float = SIMILAR) -> DataFrame:
    """descriptor_clean, merchant_id, merchant_name, match_confidence of those with a similar alias; ties go to the
    alias that comes first. The dictionary is a bounded reference list. Only candidates are scored (see Candidates)."""
    rows = dictionary.orderBy("position").select("alias", "merchant_id", "canonical_name").collect()
    aliases = [r.alias for r in rows]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Candidates(aliases, least)
        for batch in batches:
            found = [(s, *m) for s in batch.column(0).to_pylist() if (m := best_match(s, aliases, token_set_ratio, least, index.of(s)))]
            texts = [[s for s, _, _ in found], [rows[i].merchant_id for _, i, _ in found], [rows[i].canonical_name for _, i, _ in found]]
            scores = pa.array([x / 100 for _, _, x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*(pa.array(t, pa.string()) for t in texts), scores], names=["descriptor_clean", "merchant_id", "merchant_name", "match_confidence"])

    return names.select("descriptor_clean").mapInArrow(work, "descriptor_clean string, merchant_id string, merchant_name string, match_confidence double")


def resolved_names(df: DataFrame, dictionary: DataFrame, tiers: tuple[str, ...] = TIERS, least: float = SIMILAR) -> DataFrame:
    """descriptor_clean, merchant_id, merchant_name, match_method, match_confidence: one row per distinct text."""
    names = df.where(F.col("descriptor_clean") != "").groupBy("descriptor_clean").agg(F.count("*").alias("n"))
    first = scratch.cut(exact(names, dictionary), "names") if len(tiers) > 1 else exact(names, dictionary)
    done = first.where("merchant_id IS NOT NULL").select("descriptor_clean", "merchant_id", "merchant_name", F.lit("exact").alias("match_method"), F.lit(1.0).alias("match_confidence"))
    left = first.where("merchant_id IS NULL").select("descriptor_clean", "n")
    if "fuzzy" in tiers:
        close = scratch.cut(similar(left, dictionary, least), "similar")
        done = done.unionByName(close.select("descriptor_clean", "merchant_id", "merchant_name", F.lit("fuzzy").alias("match_method"), "match_confidence"))
        left = left.join(close, "descriptor_clean", "left_anti")
    if "cluster" in tiers:
        grouped = scratch.cut(density_clusters(left, "descriptor_clean"), "clusters")
        clustered = grouped.join(_heads(grouped, left), "cluster").select("descriptor_clean", F.concat(F.lit("CLUSTER_"), "cluster").alias("merchant_id"), "merchant_name", F.lit("cluster").alias("match_method"), F.lit(0.5).alias("match_confidence"))
        done = done.unionByName(clustered)
        left = left.join(grouped, "descriptor_clean", "left_anti")
    return done.unionByName(left.select("descriptor_clean", F.lit(None).cast("string").alias("merchant_id"), F.col("descriptor_clean").alias("merchant_name"), F.lit("unresolved").alias("match_method"), F.lit(0.0).alias("match_confidence")))


def _heads(grouped: DataFrame, left: DataFrame) -> DataFrame:
    """The member of each cluster that the most rows have; of equals the first by name."""
    counted = grouped.join(left, "descriptor_clean")
    top = counted.groupBy("cluster").agg(F.max("n").alias("top")).withColumnRenamed("cluster", "c")
    return counted.join(top, (F.col("cluster") == F.col("c")) & (F.col("n") == F.col("top"))).groupBy("cluster").agg(F.min("descriptor_clean").alias("merchant_name"))


def merchants(df: DataFrame, dictionary: DataFrame, tiers: tuple[str, ...] = TIERS, least: float = SIMILAR) -> DataFrame:
    """Adds descriptor_clean, merchant_id, merchant_name, match_method, match_confidence. Blank descriptors stay
    without a method, at confidence 0."""
    out = df.withColumn("descriptor_clean", c.normal_descriptor(F.col("merchant_descriptor")))
    names = resolved_names(out, dictionary, tiers, least).withColumnRenamed("descriptor_clean", "__q_d")
    out = out.join(names, F.col("descriptor_clean") == F.col("__q_d"), "left").drop("__q_d")
    return out.withColumn("match_confidence", F.coalesce("match_confidence", F.lit(0.0)))


def impute_mcc(df: DataFrame, otherwise: str = "9999") -> DataFrame:
    """A missing mcc becomes the merchant's most frequent one (of equals the smallest), else `otherwise`;
    mcc_imputed_flag says so."""
    missing = c.mcc_missing(F.col("mcc"))
    counts = df.where(~missing & F.col("merchant_id").isNotNull()).groupBy("merchant_id", "mcc").agg(F.count("*").alias("n"))
    out = df.join(_modes(counts), F.col("merchant_id") == F.col("__q_m"), "left")
    return out.withColumn("mcc_imputed_flag", missing).withColumn("mcc", F.when(missing, F.coalesce("__q_mode", F.lit(otherwise))).otherwise(F.col("mcc"))).drop("__q_m", "__q_mode")


def _modes(counts: DataFrame) -> DataFrame:
    top = counts.groupBy("merchant_id").agg(F.max("n").alias("top")).withColumnRenamed("merchant_id", "__q_m")
    both = counts.join(top, (F.col("merchant_id") == F.col("__q_m")) & (F.col("n") == F.col("top")))
    return both.groupBy("__q_m").agg(F.min("mcc").alias("__q_mode"))

"""Duplicates and outliers of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOT_COMPARED = ["transaction_id", "mcc_imputed_flag", "descriptor_clean", "match_method", "match_confidence"]
WINDOW_SECONDS = 120
OUTLIER_Z = 3.5


def number_copies(df: DataFrame) -> DataFrame:
    """Adds copy_no: 1 for the first of rows that agree in all columns but NOT_COMPARED (nulls agree), by id.

    Rows are dealt by a hash of the compared columns and only then sorted by them.
    """
    keys = [c for c in df.columns if c not in NOT_COMPARED]
    order = [F.col(c) for c in NOT_COMPARED if c in df.columns]
    return df.withColumn("copy_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def drop_copies(df: DataFrame) -> DataFrame:
    return number_copies(df).where("copy_no = 1").drop("copy_no")


def dropped_copies(df: DataFrame) -> DataFrame:
    return number_copies(df).where("copy_no > 1").drop("copy_no")


def flag_near(df: DataFrame, seconds: int = WINDOW_SECONDS, keys: tuple[str, ...] = ("account_id", "merchant_id", "amount_inr"), time: str = "txn_timestamp") -> DataFrame:
    """is_near_duplicate: the row before or after with the same keys is at most `seconds` away. A null key or time
    never is one, and such rows aren't dealt at all. lag and lead share one sort."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).asc_nulls_last())
    at = F.unix_micros(F.col(time).cast("timestamp"))
    near = ((at - F.lag(at).over(w)) <= seconds * 1_000_000) | ((F.lead(at).over(w) - at) <= seconds * 1_000_000)
    known = F.col(time).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    flagged = df.where(known).withColumn("is_near_duplicate", F.coalesce(near, F.lit(False)))
    return flagged.unionByName(df.where(~known).withColumn("is_near_duplicate", F.lit(False)))


def flag_outliers(df: DataFrame, value: str = "amount_inr", group: str = "mcc", z: float = OUTLIER_Z) -> DataFrame:
    """is_outlier: 0.6745 * |x - median| / MAD beyond `z` in the group, among positive values; a MAD of 0 counts as 1.

    Medians are aggregates of counts per distinct value, so a hot group is pre-aggregated before it is dealt.
    """
    x = F.col(value)
    used = df.where((x > 0) & F.col(group).isNotNull())
    medians = used.groupBy(F.col(group).alias("__q_g")).agg(F.median(x).alias("__q_mid"))
    spread = used.join(medians, F.col(group) == F.col("__q_g")).groupBy("__q_g").agg(F.first("__q_mid").alias("__q_mid"), F.median(F.abs(x - F.col("__q_mid"))).alias("__q_mad"))
    score = 0.6745 * F.abs(x - F.col("__q_mid")) / F.when(F.col("__q_mad") == 0, 1.0).otherwise(F.col("__q_mad"))
    out = df.join(spread, F.col(group) == F.col("__q_g"), "left")
    return out.withColumn("is_outlier", F.coalesce((x > 0) & (score > z), F.lit(False))).drop("__q_g", "__q_mid", "__q_mad")

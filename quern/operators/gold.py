"""Star schema and its analytical views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.cleaning import confidence_band

FACT = ["transaction_id", "account_id", "merchant_id", "date_key", "txn_timestamp", "amount_inr", "amount_original", "currency_original", "raw_descriptor", "descriptor_clean", "channel", "status", "city_canonical", "country", "match_method", "match_confidence", "mcc_imputed_flag", "is_near_duplicate", "is_outlier"]


def dim_date(silver: DataFrame) -> DataFrame:
    t = F.col("txn_timestamp")
    days = silver.where(t.isNotNull()).select(t.cast("date").alias("date_key")).distinct()
    d = F.col("date_key")
    return days.select(d, F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"), F.dayofmonth(d).cast("long").alias("day"), (F.dayofweek(d) - 1).cast("long").alias("day_of_week"))


def dim_account(silver: DataFrame) -> DataFrame:
    return silver.where("account_id IS NOT NULL").select("account_id").distinct()


def dim_merchant(silver: DataFrame, mcc_map: DataFrame) -> DataFrame:
    """One row for each merchant_id, merchant_name and mcc."""
    rows = silver.where("merchant_id IS NOT NULL").select("merchant_id", "merchant_name", "mcc").distinct()
    codes = F.broadcast(mcc_map.select(F.col("mcc").cast("string").alias("__q_mcc"), "category", "category_group"))
    rows = rows.join(codes, F.col("mcc").cast("string") == F.col("__q_mcc"), "left")
    return rows.select("merchant_id", "merchant_name", "mcc", F.coalesce("category", F.lit("Unclassified")).alias("merchant_category"), F.coalesce("category_group", F.lit("Unclassified")).alias("category_group"))


def dim_merchant_unique(silver: DataFrame, mcc_map: DataFrame) -> DataFrame:
    """One row for each merchant_id: its most frequent mcc, of equals the smallest; so joins don't multiply rows."""
    counts = silver.where("merchant_id IS NOT NULL").groupBy("merchant_id", "merchant_name", "mcc").agg(F.count("*").alias("n"))
    w = Window.partitionBy("merchant_id").orderBy(F.col("n").desc(), F.col("mcc"), F.col("merchant_name"))
    return dim_merchant(counts.withColumn("r", F.row_number().over(w)).where("r = 1"), mcc_map)


def fact(silver: DataFrame) -> DataFrame:
    return silver.withColumns({"date_key": F.col("txn_timestamp").cast("date"), "raw_descriptor": F.col("merchant_descriptor")}).select(*FACT)


def _counted() -> Column:
    return (F.col("status") == "APPROVED") & ~F.col("is_outlier")


def money(c: Column) -> Column:
    """A sum of doubles to two places, so that the order of adding doesn't show."""
    return F.round(F.sum(c), 2)


def _top(rows: DataFrame, by: str, state: str, n: int) -> DataFrame:
    # ten rows are taken first, so the window that ranks them is over ten rows
    top = rows.groupBy(F.col(by).alias("merchant_identity")).agg(money(F.col("amount_inr")).alias("total_spend")).orderBy(F.col("total_spend").desc(), "merchant_identity").limit(n)
    w = Window.orderBy(F.col("total_spend").desc(), "merchant_identity")
    return top.select("merchant_identity", "total_spend", F.row_number().over(w).cast("long").alias("rank"), F.lit(state).alias("state"))


def top_merchants(fct: DataFrame, dim: DataFrame, n: int = 10) -> DataFrame:
    """Merchants of the largest spend, by raw descriptor and by resolved name."""
    used = fct.where(_counted())
    resolved = used.join(dim.select("merchant_id", "merchant_name"), "merchant_id")
    both = _top(used, "raw_descriptor", "Before (Raw Descriptor)", n).unionByName(_top(resolved, "merchant_name", "After (Resolved Identity)", n))
    return both.orderBy("state", "rank")


def category_mix(fct: DataFrame, dim: DataFrame) -> DataFrame:
    rows = fct.where(_counted()).join(dim.select("merchant_id", "merchant_category"), "merchant_id")
    out = rows.groupBy("merchant_category", "mcc_imputed_flag").agg(F.count("*").alias("transaction_count"), money(F.col("amount_inr")).alias("total_spend_inr"))
    return out.orderBy("merchant_category", "mcc_imputed_flag")


def duplicate_exposure(fct: DataFrame) -> DataFrame:
    return fct.where(F.col("is_near_duplicate") & (F.col("status") == "APPROVED")).agg(F.count("*").alias("near_duplicate_txn_count"), money(F.col("amount_inr")).alias("total_exposure_inr"))


def health(fct: DataFrame, dates: DataFrame) -> DataFrame:
    """Shares of issues and the health score by channel and month."""
    rows = fct.join(dates.select("date_key", "year", "month"), "date_key")
    n = F.count("*")
    share = lambda c: F.round(F.count_if(c) * 100.0 / n, 9)
    unresolved, imputed = F.col("match_method") == "unresolved", F.col("mcc_imputed_flag")
    out = rows.groupBy("channel", "year", "month").agg(
        n.alias("total_txns"),
        share(unresolved).alias("pct_unresolved_merchants"),
        share(imputed).alias("pct_imputed_mcc"),
        share(F.col("is_near_duplicate")).alias("pct_near_duplicates"),
        F.round(100.0 - (F.count_if(unresolved) * F.lit(0.5) + F.count_if(imputed) * F.lit(0.2)) * 100.0 / n, 9).alias("data_health_score"),
    )
    return out.orderBy("year", "month", F.col("channel").asc_nulls_last())


def breaches(scores: DataFrame, least: float = 90.0) -> DataFrame:
    return scores.where(F.col("data_health_score") < least).withColumn("period", F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1)))


def explore(fct: DataFrame, dim: DataFrame, least: float = 0.0, term: str | None = None, limit: int | None = 100) -> DataFrame:
    """Resolved descriptors from a confidence on, whose raw text or merchant's name holds a term (LIKE's % and _ count),
    with a band for the confidence; the first `limit` by id and category, or with None all of them in no order. A limit is
    for a screen, as each task keeps so many rows in memory."""
    rows = fct.join(dim.select("merchant_id", "merchant_name", "mcc", "merchant_category"), "merchant_id").where(F.col("match_confidence") >= least)
    if term:
        like = f"%{term.lower()}%"
        rows = rows.where(F.lower("raw_descriptor").like(like) | F.lower("merchant_name").like(like))
    rows = rows.select("transaction_id", "raw_descriptor", "merchant_name", "mcc", "merchant_category", F.initcap("match_method").alias("match_method"), "match_confidence", confidence_band(F.col("match_confidence")).alias("band"))
    return rows if limit is None else rows.orderBy("transaction_id", "mcc", "raw_descriptor").limit(limit)

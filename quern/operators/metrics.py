"""Scorecard, ground-truth accuracy and profile, each in one or two aggregates."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import cleaning


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), 9)


def raw_figures(raw: DataFrame) -> DataFrame:
    m = F.col("mcc")
    filled = m.isNotNull() & ~m.isin("NA", "", "0000")
    blank = lambda n: F.nullif(F.col(n), F.lit(""))
    return raw.agg(F.count("*").alias("total_raw"), F.countDistinct(blank("merchant_descriptor")).alias("distinct_merchant_strings_raw"), F.count_if(filled).alias("raw_mcc"), F.countDistinct(blank("city")).alias("distinct_city_spellings_raw"))


def scorecard(raw: DataFrame, fct: DataFrame, dim: DataFrame, dropped: DataFrame) -> DataFrame:
    """The headline metrics as one row. Frames of one row each are put side by side."""
    clean = fct.agg(
        F.count("*").alias("total_clean"), F.count_if(F.col("txn_timestamp").isNotNull()).alias("dated"), F.count_if(F.col("amount_inr").isNotNull()).alias("numeric"), F.count_if("mcc_imputed_flag").alias("mcc_imputed_count"),
        F.countDistinct("city_canonical").alias("distinct_city_spellings_clean"), F.count_if("is_near_duplicate").alias("near_duplicates_flagged"),
    )
    names = dim.agg(F.countDistinct("merchant_name").alias("distinct_merchant_strings_clean"), F.count_if(F.col("mcc").isNotNull()).alias("coded"), F.count("*").alias("dims"))
    gone = dropped.agg(F.count("*").alias("exact_duplicates_dropped"))
    one = F.lit(1).alias("one")
    x = raw_figures(raw).select("*", one).join(clean.select("*", one), "one").join(names.select("*", one), "one").join(gone.select("*", one), "one")
    x = x.withColumn("rows_quarantined", F.col("total_raw") - F.col("total_clean") - F.col("exact_duplicates_dropped"))
    return x.select(
        "distinct_merchant_strings_raw", "distinct_merchant_strings_clean",
        _percent(F.col("dated"), F.col("total_clean")).alias("rows_with_valid_date_clean_pct"), _percent(F.col("numeric"), F.col("total_clean")).alias("rows_with_numeric_amount_clean_pct"),
        _percent(F.col("raw_mcc"), F.col("total_raw")).alias("rows_with_mcc_raw_pct"), _percent(F.col("coded"), F.col("dims")).alias("rows_with_mcc_clean_pct"), "mcc_imputed_count",
        "distinct_city_spellings_raw", "distinct_city_spellings_clean", "exact_duplicates_dropped", "near_duplicates_flagged", "rows_quarantined", _percent(F.col("rows_quarantined"), F.col("total_raw")).alias("quarantine_pct"),
    )


def accuracy(truth: DataFrame, flagged: DataFrame, key: str = "transaction_id") -> DataFrame:
    """true_positives, false_positives, false_negatives, precision, recall, f1 of two sets of ids; 0 over nothing."""
    t, f = truth.select(F.col(key).alias("t")).distinct(), flagged.select(F.col(key).alias("f")).distinct()
    n = t.join(f, F.col("t") == F.col("f"), "full").agg(F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("true_positives"), F.count_if(F.col("t").isNull()).alias("false_positives"), F.count_if(F.col("f").isNull()).alias("false_negatives"))
    p = F.coalesce(F.try_divide("true_positives", F.col("true_positives") + F.col("false_positives")), F.lit(0.0))
    r = F.coalesce(F.try_divide("true_positives", F.col("true_positives") + F.col("false_negatives")), F.lit(0.0))
    n = n.withColumns({"precision": F.round(p, 9), "recall": F.round(r, 9)})
    return n.withColumn("f1", F.round(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)), 9))


def profile(df: DataFrame) -> DataFrame:
    """column_name, count, unique, top, freq of every column as text; of equally frequent values the smallest.

    Rows are turned into (column, value) and counted with partial sums, so no column needs a pass of its own.
    """
    pairs = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "value").where("value IS NOT NULL")
    counts = pairs.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    tops = counts.groupBy("column_name").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), F.max("n").alias("freq"))
    named = tops.withColumnRenamed("column_name", "c").join(counts, (F.col("c") == F.col("column_name")) & (F.col("freq") == F.col("n")))
    return named.groupBy("column_name", "count", "unique", "freq").agg(F.min("value").alias("top")).select("column_name", "count", "unique", "top", "freq")


def amount_benchmark(raw: DataFrame, times: int = 3) -> dict[str, float]:
    """Seconds, rows a second and speed-up of the amount rules by expressions over those by a Python function a row, both
    over all of `raw` and the best of `times` runs."""
    by_row = F.udf(_plain_amount, "double", useArrow=False)

    def best(column: Column) -> float:
        took = []
        for _ in range(times):
            began = time.perf_counter()
            raw.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    rows, plain, fast = raw.count(), best(by_row("amount")), best(cleaning.parse_amount(F.col("amount")))
    return {"rows": rows, "row_by_row_seconds": round(plain, 3), "expression_seconds": round(fast, 3), "speed_up": round(plain / fast, 2), "rows_a_second": round(rows / fast)}


def _plain_amount(text: str | None) -> float | None:
    body = (text or "").strip()
    if body.startswith("(") and body.endswith(")"):
        body = "-" + body[1:-1]
    try:
        return float("".join(c for c in body if c in "0123456789.-"))
    except ValueError:
        return None

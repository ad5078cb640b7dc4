"""Cleaning steps over frames of transactions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import cleaning as c
from quern.functions.similarity import best_match, ratio
from quern.operators.contracts import REASON


def parse(df: DataFrame) -> DataFrame:
    """txn_timestamp and amount parsed, amount_original and currency_original kept, reject_reason for what isn't
    parsable (date first)."""
    out = df.withColumns({"amount_original": F.col("amount"), "currency_original": F.col("currency")})
    out = out.withColumns({"txn_timestamp": c.parse_timestamp(F.col("txn_timestamp")), "amount": c.parse_amount(F.col("amount"))})
    reason = F.concat_ws(" | ", F.when(F.col("txn_timestamp").isNull(), "unparseable_date"), F.when(F.col("amount").isNull(), "unparseable_amount"))
    return out.withColumn(REASON, F.when(reason != "", reason))


def currencies(df: DataFrame, fx: DataFrame) -> DataFrame:
    """currency_inferred and amount_inr; a currency without a rate counts at 1."""
    out = df.withColumn("currency_inferred", c.infer_currency(F.col("currency_original"), F.col("amount_original"), F.col("country")))
    rates = F.broadcast(fx.select(F.col("currency").alias("__q_cur"), "rate_to_inr"))
    out = out.join(rates, F.col("currency_inferred") == F.col("__q_cur"), "left")
    return out.withColumn("amount_inr", c.to_cents(F.col("amount") * F.coalesce("rate_to_inr", F.lit(1.0)))).drop("__q_cur", "rate_to_inr")


def similar_cities(spellings: DataFrame, canonical: list[str], least: float = 80.0) -> DataFrame:
    """spelling (lower case, trimmed), best: the most similar canonical name of at least `least`; others have no row."""
    lower = [x.lower() for x in canonical]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, m) for s in batch.column(0).to_pylist() if (m := best_match(s, lower, ratio, least))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.array([canonical[m[0]] for _, m in found], pa.string())], names=["spelling", "best"])

    return spellings.select("spelling").mapInArrow(work, "spelling string, best string")


def cities(df: DataFrame, canonical: DataFrame, fuzzy: bool = True, variants: DataFrame | None = None, least: float = 80.0) -> DataFrame:
    """city_canonical: exact match but for case and blanks, else the most similar name, else the text as it is.

    Only distinct spellings without an exact match are scored. With `variants` (canonical_city, variants) known
    spellings count as exact.
    """
    key = F.lower(c.strip(F.coalesce("city", F.lit(""))))
    out = df.withColumn("__q_key", key)
    names = canonical.select(F.lower("canonical_city").alias("__q_c"), F.col("canonical_city").alias("__q_exact"))
    if variants is not None:
        more = variants.select(F.explode("variants").alias("v"), "canonical_city").select(F.lower(c.strip(F.col("v"))).alias("__q_c"), F.col("canonical_city").alias("__q_exact"))
        names = names.unionByName(more).groupBy("__q_c").agg(F.min("__q_exact").alias("__q_exact"))
    out = out.join(F.broadcast(names), F.col("__q_key") == F.col("__q_c"), "left").drop("__q_c")
    if not fuzzy:
        return out.withColumn("city_canonical", F.coalesce("__q_exact", "city", F.lit(""))).drop("__q_key", "__q_exact")
    rest = out.where(F.col("__q_exact").isNull() & (F.col("__q_key") != "")).select(F.col("__q_key").alias("spelling")).distinct()
    listed = sorted(r.canonical_city for r in canonical.collect())  # a bounded reference list
    best = similar_cities(rest, listed, least).select(F.col("spelling").alias("__q_s"), "best")
    out = out.join(best, (F.col("__q_key") == F.col("__q_s")) & F.col("__q_exact").isNull(), "left")
    return out.withColumn("city_canonical", F.coalesce("__q_exact", "best", "city", F.lit(""))).drop("__q_key", "__q_exact", "__q_s", "best")


def sentinels(df: DataFrame, values: list[str] = c.SENTINELS) -> DataFrame:
    """Texts that mean null are null, in every text column."""
    return df.select(*[c.null_sentinel(F.col(f.name), values).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def sentinel_counts(df: DataFrame, values: list[str] = c.SENTINELS) -> DataFrame:
    """column_name, n_mapped for every text column, counted in one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    one = df.agg(*[F.count_if(c.strip(F.col(n)).isin(values)).alias(n) for n in names])
    return one.unpivot([], names, "column_name", "n_mapped")


#: Optional code spellings, off by default.
CODES = {
    "country": {"IN": "IN", "INDIA": "IN", "IND": "IN", "US": "US", "USA": "US"},
    "channel": {"POS": "POS", "ONLINE": "ONLINE", "E-COMM": "ONLINE", "ECOMM": "ONLINE", "ATM": "ATM"},
}


def normalize_codes(df: DataFrame) -> DataFrame:
    """country and channel by CODES, account_id in upper case without blanks. Not part of the default pipeline."""
    out = df
    for name, codes in CODES.items():
        mapping = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
        out = out.withColumn(name, F.coalesce(F.try_element_at(mapping, F.upper(F.trim(name))), F.col(name)))
    return out.withColumn("account_id", F.upper(F.trim("account_id")))

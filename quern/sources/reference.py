"""Reference lists: exchange rates, category codes, cities with their spellings, the merchant dictionary.

They are CSV files with a header under fixed schemas. All but the dictionary are a few dozen rows; none grows with the
transactions. `write_lists` makes files of our own from the order tables, so that the queries read lists as a job does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans import scratch

FX = [("INR", 1.0), ("USD", 83.25), ("EUR", 90.5), ("GBP", 105.75)]
GROUPS = ["Food", "Retail", "Travel", "Home", "Services"]
#: Category codes 5000 to 5059: a category each, in five groups by turns. Codes 5021 and 5033 are left out on purpose.
MCC = [(str(code), f"Category {code % 100:02d}", GROUPS[code % 5]) for code in range(5000, 5060) if code not in (5021, 5033)]
SCHEMAS = {
    "fx_rates": "currency string, rate_to_inr double",
    "mcc_map": "mcc string, category string, category_group string",
    "cities": "canonical_city string, city_code string, variant string",
    "merchants": "merchant_id string, canonical_name string, alias string, mcc string, category string",
}


def read_list(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The list `name` under `folder` (a file or a folder of one file, with or without the ending .csv)."""
    return spark.read.schema(SCHEMAS[name]).option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{name}.csv")


def read_merchants(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary, a row for each alias (upper case), with its position in the file."""
    rows = read_list(spark, folder, "merchants").select("merchant_id", "canonical_name", F.upper("alias").alias("alias"), "mcc", "category")
    return rows.withColumn("position", F.monotonically_increasing_id())  # one file, so ids follow its lines


def read_variants(spark: SparkSession, folder: str) -> DataFrame:
    """canonical_city with the sorted list of its known spellings."""
    return read_list(spark, folder, "cities").groupBy("canonical_city").agg(F.array_sort(F.collect_set("variant")).alias("variants"))


@dataclass(frozen=True)
class Lists:
    merchants: DataFrame
    fx: DataFrame
    cities: DataFrame
    variants: DataFrame
    mcc: DataFrame


def read_lists(spark: SparkSession, folder: str) -> Lists:
    names = read_list(spark, folder, "cities").select("canonical_city").distinct()
    return Lists(read_merchants(spark, folder), read_list(spark, folder, "fx_rates"), names, read_variants(spark, folder), read_list(spark, folder, "mcc_map"))


#: Several aliases for a name, the same in Spark and DuckDB.
ALIASES = "array(upper(n), concat(upper(n), ' INDIA'), concat('THE ', upper(n)))"


def write_lists(spark: SparkSession, folder: str, sf_dir: str | None = None) -> str:
    """Lists of our own as CSV: rates and codes, and with `sf_dir` a dictionary of the parts and cities of the nations."""

    def save(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{name}.csv")

    save(spark.createDataFrame(FX, SCHEMAS["fx_rates"]).coalesce(1), "fx_rates")
    save(spark.createDataFrame(MCC, SCHEMAS["mcc_map"]).coalesce(1), "mcc_map")
    if sf_dir:
        c = F.col("n_name")
        spelled = spark.read.parquet(f"{sf_dir}/nation.parquet").select(c).distinct().select(c.alias("canonical_city"), F.upper(F.substring(c, 1, 3)).alias("city_code"), F.explode(F.array_distinct(F.array(c, F.lower(c), F.replace(c, F.lit(" "), F.lit("")), F.concat(F.lit(" "), c)))).alias("variant"))
        save(spelled.coalesce(1), "cities")
        names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("n")).distinct()
        code = F.col("n").cast("string")
        rows = names.select(F.concat(F.lit("M"), F.substring(F.md5(code), 1, 8)).alias("merchant_id"), F.col("n").alias("canonical_name"), F.posexplode(F.expr(ALIASES)).alias("k", "alias"), (5000 + F.length("n") % 60).cast("string").alias("mcc"))
        rows = rows.withColumn("category", F.concat(F.lit("Category "), F.substring("mcc", 3, 2)))
        save(rows.repartition(1).sortWithinPartitions("canonical_name", "k").select("merchant_id", "canonical_name", "alias", "mcc", "category"), "merchants")
    return folder


_folders: dict[tuple, str] = {}


def folder(spark: SparkSession, sf_dir: str | None = None) -> str:
    """The folder of the lists for `sf_dir`; written once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _folders:
        _folders[key] = write_lists(spark, scratch.new_path(spark, "lists"), sf_dir)
    return _folders[key]


def fx_rates(spark: SparkSession) -> DataFrame:
    return read_list(spark, folder(spark), "fx_rates")


def mcc_map(spark: SparkSession) -> DataFrame:
    return read_list(spark, folder(spark), "mcc_map")


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lists(spark, folder(spark, sf_dir)).cities


def city_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_variants(spark, folder(spark, sf_dir))


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_merchants(spark, folder(spark, sf_dir))

"""The batch pipeline from all-string rows to the checked silver table, as one plan with two cuts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quern.operators import clean, contracts, quality, resolve
from quern.plans import scratch


@dataclass(frozen=True)
class Options:
    tiers: tuple[str, ...] = resolve.TIERS
    fuzzy_threshold: float = resolve.SIMILAR
    fuzzy_cities: bool = True
    near_seconds: int = quality.WINDOW_SECONDS
    outlier_z: float = quality.OUTLIER_Z
    keep_unresolved: bool = False
    normalize_codes: bool = False


@dataclass(frozen=True)
class Result:
    """bronze and parsed and silver carry reject_reason; dropped are the exact copies."""

    bronze: DataFrame
    parsed: DataFrame
    dropped: DataFrame
    checked: DataFrame

    @property
    def silver(self) -> DataFrame:
        return contracts.passed(self.checked)


def run(raw: DataFrame, dictionary: DataFrame, fx: DataFrame, cities: DataFrame, options: Options = Options()) -> Result:
    bronze = contracts.judged(raw, contracts.bronze())
    parsed = scratch.cut(clean.parse(contracts.passed(bronze)), "parsed")
    rows = clean.currencies(contracts.passed(parsed), fx)
    rows = clean.sentinels(clean.cities(rows, cities, options.fuzzy_cities))
    if options.normalize_codes:
        rows = clean.normalize_codes(rows)
    rows = resolve.merchants(rows, dictionary, options.tiers, options.fuzzy_threshold)
    rows = scratch.cut(resolve.impute_mcc(rows), "resolved")
    numbered = quality.number_copies(rows)
    dropped = numbered.where("copy_no > 1").drop("copy_no")
    kept = numbered.where("copy_no = 1").drop("copy_no")
    flagged = quality.flag_outliers(quality.flag_near(kept, options.near_seconds), z=options.outlier_z)
    return Result(bronze, parsed, dropped, contracts.judged(scratch.cut(flagged, "flagged"), contracts.silver(options.keep_unresolved)))


def write(spark: SparkSession, result: Result, folder: str) -> None:
    """Silver as Parquet, each kind of reject and the dropped copies beside it; all are written even if empty."""
    result.silver.write.mode("overwrite").parquet(f"{folder}/silver")
    contracts.rejected(result.bronze).write.mode("overwrite").option("header", True).csv(f"{folder}/quarantine/bronze_rejects")
    contracts.rejected(result.parsed).write.mode("overwrite").option("header", True).csv(f"{folder}/quarantine/silver_rejects")
    contracts.rejected(result.checked).write.mode("overwrite").option("header", True).csv(f"{folder}/quarantine/silver_rejects_gate2")
    result.dropped.write.mode("overwrite").option("header", True).csv(f"{folder}/dropped_exact_dupes")

"""The batch job: raw CSV and reference lists in; silver, quarantine, gold tables, views, scorecard and log out.

    python -m quern.job pipeline.toml

The configuration names the paths and may set the pipeline's options; see pipeline.toml. Every step logs the rows that
come in, pass and are rejected, and the job ends with an error if rows are lost between steps.
"""

from __future__ import annotations

import logging
import sys
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import clean, contracts, gold, metrics
from quern.plans import silver
from quern.sources import reference, sinks, transactions


def load(path: str) -> dict:
    """A configuration file. Tables: paths (raw, reference, out; log is optional) and options (of silver.Options)."""
    with open(path, "rb") as file:
        config = tomllib.load(file)
    missing = {"raw", "reference", "out"} - set(config.get("paths", {}))
    if missing:
        raise ValueError(f"{path}: paths lacks {sorted(missing)}")
    return config


def options(config: dict) -> silver.Options:
    given = dict(config.get("options", {}))
    if "tiers" in given:
        given["tiers"] = tuple(given["tiers"])
    return silver.Options(**given)


def gates(raw: DataFrame, result: silver.Result) -> DataFrame:
    """gate, total, passed, rejected of each step, counted from what the steps made."""
    parts = [contracts.conservation(rows).select(F.lit(name).alias("gate"), "*") for name, rows in (("bronze", result.bronze), ("parse", result.parsed), ("silver", result.checked))]
    copies = result.dropped.agg(F.count("*").alias("rejected"))
    passed = result.checked.agg(F.count("*").alias("passed"))
    parts.append(copies.join(passed, F.lit(True)).select(F.lit("copies").alias("gate"), (F.col("passed") + F.col("rejected")).alias("total"), "passed", "rejected"))
    out = raw.agg(F.count("*").alias("total")).select(F.lit("raw").alias("gate"), "total", F.col("total").alias("passed"), F.lit(0).cast("long").alias("rejected"))
    for part in parts:
        out = out.unionByName(part)
    return out


def check(counts: dict[str, tuple[int, int, int]]) -> int:
    """The number of quarantined rows. Raises an error where a step doesn't begin with what the one before passed on."""
    order = ["raw", "bronze", "parse", "copies", "silver"]
    for before, after in zip(order, order[1:], strict=False):
        if counts[before][1] != counts[after][0]:
            raise RuntimeError(f"{before} passed {counts[before][1]} rows on, but {after} had {counts[after][0]}")
    return sum(counts[g][2] for g in ("bronze", "parse", "silver"))


def save_gold(spark: SparkSession, rows: DataFrame, codes: DataFrame, out: str) -> dict[str, DataFrame]:
    """Dimensions and the fact as tables over Parquet under `out`/gold, and the views over them."""
    spark_rows = {"dim_date": gold.dim_date(rows), "dim_account": gold.dim_account(rows), "dim_merchant": gold.dim_merchant(rows, codes), "fct_transactions": gold.fact(rows)}
    tables = {name: sinks.save_table(df, name, f"{out}/gold/{name}") for name, df in spark_rows.items()}
    fct, dim = tables["fct_transactions"], tables["dim_merchant"]
    views = {"v_top_merchants": gold.top_merchants(fct, dim), "v_category_mix": gold.category_mix(fct, dim), "v_duplicate_exposure": gold.duplicate_exposure(fct)}
    return tables | {name: sinks.save_view(df, name) for name, df in views.items()}


def run(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """The whole job; the gold tables and views by name."""
    paths = config["paths"]
    log = sinks.log_to("quern.job", paths.get("log"))
    log.info("raw from %s, lists from %s", paths["raw"], paths["reference"])
    lists = reference.read_lists(spark, paths["reference"])
    raw = transactions.read_raw_csv(spark, paths["raw"])
    result = silver.run(raw, lists.merchants, lists.fx, lists.cities, options(config))
    silver.write(spark, result, paths["out"])
    counts = {r.gate: (r.total, r.passed, r.rejected) for r in gates(raw, result).collect()}  # five rows
    for gate, (total, passed, rejected) in counts.items():
        log.info("%s: %d rows in, %d passed, %d rejected", gate, total, passed, rejected)
    quarantined = check(counts)
    for r in clean.sentinel_counts(raw).collect():  # a row for each column
        log.info("sentinels in %s: %d", r.column_name, r.n_mapped)
    tables = save_gold(spark, result.silver, lists.mcc, paths["out"])
    card = metrics.scorecard(raw, tables["fct_transactions"], tables["dim_merchant"], result.dropped)
    told = sinks.scorecard_reports(spark, card, f"{paths['out']}/reports")
    if told["rows_quarantined"] != quarantined:
        raise RuntimeError(f"the scorecard says {told['rows_quarantined']} rows are in quarantine, the rejects hold {quarantined}")
    sinks.profile_html(spark, metrics.profile(raw), f"{paths['out']}/reports/profile.html")
    log.info("done: %s", paths["out"])
    return tables


def main(arguments: list[str]) -> None:
    from quern.session import SETTINGS, ship

    if len(arguments) != 1:
        sys.exit(__doc__)
    builder = SparkSession.builder.appName("quern.job")  # master and resources are spark-submit's
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        ship(spark)
        run(spark, load(arguments[0]))
    finally:
        spark.stop()
        logging.shutdown()


if __name__ == "__main__":
    main(sys.argv[1:])

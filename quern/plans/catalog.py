"""All registered queries of the transaction engine, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import job
from quern.functions import cleaning as c
from quern.operators import clean, cluster, contracts, gold, metrics, quality, resolve, synth
from quern.plans import oracle, scratch, silver
from quern.session import table
from quern.sources import reference, sinks, transactions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Resolution by equal aliases alone, which SQL can express too.
EXACT = silver.Options(tiers=("exact",), fuzzy_cities=False)
_built: dict[tuple, silver.Result] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = oracle.sql(sql)
        return f

    return add


def raw(spark: SparkSession, d: str) -> DataFrame:
    return transactions.blank_missing(transactions.from_orders(spark, d))


def build(spark: SparkSession, d: str, options: silver.Options = EXACT) -> silver.Result:
    """The pipeline's tables for a folder; made once for each application, then read."""
    key = (spark.sparkContext.applicationId, d, options)
    if key not in _built:
        _built[key] = silver.run(raw(spark, d), reference.merchants(spark, d), reference.fx_rates(spark), reference.cities(spark, d), options)
    return _built[key]


def star(spark: SparkSession, d: str, options: silver.Options = EXACT) -> tuple[DataFrame, DataFrame]:
    rows = build(spark, d, options).silver
    return gold.fact(rows), gold.dim_merchant(rows, reference.mcc_map(spark))


def after(spark: SparkSession, d: str, step: str) -> DataFrame:
    """Rows as they are before a later step, without the fuzzy rules."""
    rows = clean.currencies(contracts.passed(build(spark, d).parsed), reference.fx_rates(spark))
    if step == "priced":
        return rows
    rows = clean.sentinels(clean.cities(rows, reference.cities(spark, d), fuzzy=False))
    if step == "sentinel":
        return rows
    rows = resolve.merchants(rows, reference.merchants(spark, d), ("exact",))
    return rows if step == "resolved" else resolve.impute_mcc(rows)


COLS = ", ".join(transactions.COLUMNS)


def _csv(spark: SparkSession, df: DataFrame, label: str) -> str:
    path = scratch.new_path(spark, label)
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


# --- sources and sinks -------------------------------------------------------------------------------------------
query("src_1", f"SELECT {COLS} FROM ingested")(lambda s, d: transactions.read_raw_csv(s, _csv(s, transactions.from_orders(s, d), "raw")))
query("src_2", "SELECT merchant_id, canonical_name, alias, mcc, category FROM merchants")(lambda s, d: reference.merchants(s, d).drop("position"))
query("src_3", "SELECT * FROM fx")(lambda s, d: reference.fx_rates(s))
query("src_4", "SELECT DISTINCT n_name AS canonical_city FROM nation")(lambda s, d: reference.cities(s, d))


@query("src_5", "SELECT transaction_id, merchant_id, amount_inr FROM silver")
def src_5(s, d):
    path = scratch.new_path(s, "silver")
    build(s, d).silver.write.parquet(path)
    return sinks.save_view(s.read.parquet(path), "stg_transactions").select("transaction_id", "merchant_id", "amount_inr")


query("src_6", "SELECT merchant_id, m.mcc, category FROM dim_merchant m JOIN mcc_map x ON x.mcc = m.mcc")(
    lambda s, d: star(s, d)[1].select("merchant_id", "mcc").join(F.broadcast(reference.mcc_map(s)), "mcc").select("merchant_id", "mcc", "category")
)
query("src_7", "SELECT transaction_id, nullif(mcc, '') AS mcc, nullif(status, '') AS status FROM raw_rows")(
    lambda s, d: transactions.read_typed_csv(s, _csv(s, transactions.from_orders(s, d), "raw"), ", ".join(f"{x} string" for x in transactions.COLUMNS)).select("transaction_id", "mcc", "status")
)
query("src_8", "SELECT o_orderkey, o_totalprice FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", "o_totalprice"))
query("src_9", "SELECT transaction_id, amount_original FROM copies WHERE copy_no > 1")(lambda s, d: s.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(_csv(s, build(s, d).dropped.select("transaction_id", "amount_original"), "dropped")))
query("src_10", "SELECT c AS canonical_city, array_to_string(list_sort(list_distinct([c, lower(c), replace(c, ' ', ''), ' ' || c])), '|') AS variants FROM (SELECT DISTINCT n_name AS c FROM nation)")(lambda s, d: reference.city_variants(s, d).select("canonical_city", F.array_join("variants", "|").alias("variants")))
query("src_11", "SELECT DISTINCT merchant_id, canonical_name FROM merchants")(
    lambda s, d: reference.merchants(s, d).withColumn("r", F.row_number().over(Window.partitionBy("merchant_id").orderBy("position"))).where("r = 1").select("merchant_id", "canonical_name")
)
query("src_12", "SELECT mcc, category_group FROM mcc_map")(lambda s, d: reference.mcc_map(s).select("mcc", "category_group"))
query("src_13", "SELECT o_orderkey, o_totalprice FROM orders")(lambda s, d: transactions.read_typed_csv(s, _csv(s, table(s, d, "orders").select("o_orderkey", "o_totalprice"), "orders"), "o_orderkey bigint, o_totalprice double"))


def card(s: SparkSession, d: str, options: silver.Options = EXACT) -> DataFrame:
    fct, dim = star(s, d, options)
    return metrics.scorecard(raw(s, d), fct, dim, build(s, d, options).dropped)


@query("src_14", "SELECT (SELECT count(*) FROM fct WHERE is_near_duplicate) AS near_duplicates_flagged, (SELECT count(*) FROM copies WHERE copy_no > 1) AS exact_duplicates_dropped")
def src_14(s, d):
    folder = scratch.new_path(s, "reports")
    sinks.scorecard_reports(s, card(s, d), folder)
    got = sinks.read_json(s, f"{folder}/scorecard.json")
    assert sinks.read_json(s, f"{folder}/missing.json") == {}
    return s.createDataFrame([(got["near_duplicates_flagged"], got["exact_duplicates_dropped"])], "near_duplicates_flagged long, exact_duplicates_dropped long")


query("src_15", "SELECT category, category_group FROM mcc_map")(lambda s, d: sinks.save_view(reference.mcc_map(s), "mcc_codes").select("category", "category_group"))


def _snk(name: str, part: str, sql: str) -> None:
    @query(name, sql)
    def run(s, d):
        folder = scratch.new_path(s, "out")
        silver.write(s, build(s, d), folder)
        rows = s.read.parquet(f"{folder}/{part}") if part == "silver" else s.read.option("header", True).csv(f"{folder}/{part}")
        return rows.select("transaction_id") if part in ("silver", "dropped_exact_dupes") else rows.select("transaction_id", "reject_reason")


_snk("snk_1", "quarantine/bronze_rejects", "SELECT transaction_id, reject_reason FROM bronze WHERE reject_reason IS NOT NULL")
_snk("snk_1_gate2", "quarantine/silver_rejects_gate2", "SELECT transaction_id, reject_reason FROM checked WHERE reject_reason IS NOT NULL")
_snk("snk_2", "quarantine/silver_rejects", "SELECT transaction_id, reject_reason FROM parsed WHERE reject_reason IS NOT NULL")
_snk("snk_3", "dropped_exact_dupes", "SELECT transaction_id FROM copies WHERE copy_no > 1")
_snk("snk_4", "silver", "SELECT transaction_id FROM silver")


_USED = "status = 'APPROVED' AND NOT is_outlier"
_MIX = f"SELECT m.merchant_category, f.mcc_imputed_flag, count(*) AS transaction_count, round(sum(amount_inr), 2) AS total_spend_inr FROM fct f JOIN dim_merchant m ON m.merchant_id = f.merchant_id WHERE {_USED} GROUP BY ALL"


def _gold(part: str) -> Query:
    """A table or view of the job's last step."""
    return lambda s, d: job.save_gold(s, build(s, d).silver, reference.mcc_map(s), scratch.new_path(s, "gold"))[part]


query("snk_5", "SELECT * FROM dim_merchant")(_gold("dim_merchant"))
query("snk_5_fact", "SELECT * FROM fct")(_gold("fct_transactions"))
query("snk_6", _MIX)(_gold("v_category_mix"))


@query("snk_7", """SELECT column0 AS metric FROM (VALUES ('distinct merchant strings raw'), ('distinct merchant strings clean'), ('rows with valid date clean pct'), ('rows with numeric amount clean pct'), ('rows with mcc raw pct'),
  ('rows with mcc clean pct'), ('mcc imputed count'), ('distinct city spellings raw'), ('distinct city spellings clean'), ('exact duplicates dropped'), ('near duplicates flagged'), ('rows quarantined'), ('quarantine pct')) t(column0)""")
def snk_7(s, d):
    folder = scratch.new_path(s, "reports")
    sinks.scorecard_reports(s, card(s, d), folder)
    return s.read.text(f"{folder}/scorecard.md").where("value LIKE '| %' AND value NOT LIKE '| Metric%'").select(F.trim(F.split("value", "[|]")[1]).alias("metric"))


_CELLS = r"(?s)<tr[^>]*>\s*<td>(.*?)</td>\s*<td>(.*?)</td>\s*<td>(.*?)</td>"


@query("snk_8", "SELECT column_name, CAST(count(nullif(value, '~')) AS VARCHAR) AS filled FROM (UNPIVOT (SELECT * FROM ingested) ON COLUMNS(*) INTO NAME column_name VALUE value) GROUP BY 1")
def snk_8(s, d):
    path = scratch.new_path(s, "profile.html")
    sinks.profile_html(s, metrics.profile(raw(s, d)), path)
    cells = s.read.text(path, wholetext=True).select(F.explode(F.arrays_zip(F.regexp_extract_all("value", F.lit(_CELLS), F.lit(1)).alias("a"), F.regexp_extract_all("value", F.lit(_CELLS), F.lit(2)).alias("b"))).alias("x"))
    return cells.select(F.col("x.a").alias("column_name"), F.col("x.b").alias("filled"))


@query("snk_9", f"SELECT {COLS} FROM raw_rows")
def snk_9(s, d):
    path = scratch.new_path(s, "truth")
    transactions.from_orders(s, d).write.parquet(path)
    return s.read.parquet(path)


_GATES = """SELECT 'raw' AS gate, count(*) AS total, count(*) AS passed, 0 AS rejected FROM raw_rows
  UNION ALL SELECT 'bronze', count(*), count(*) FILTER (reject_reason IS NULL), count(reject_reason) FROM bronze
  UNION ALL SELECT 'parse', count(*), count(*) FILTER (reject_reason IS NULL), count(reject_reason) FROM parsed
  UNION ALL SELECT 'copies', count(*), count(*) FILTER (copy_no = 1), count(*) FILTER (copy_no > 1) FROM copies
  UNION ALL SELECT 'silver', count(*), count(*) FILTER (reject_reason IS NULL), count(reject_reason) FROM checked"""


@query("snk_10", _GATES)
def snk_10(s, d):
    """The counts that the job logs, checked against each other."""
    rows = job.gates(raw(s, d), build(s, d))
    job.check({r.gate: (r.total, r.passed, r.rejected) for r in rows.collect()})
    return rows


query("snk_10_sentinels", "SELECT column_name, count(*) FILTER (trim(value) IN ('NA', 'N/A', '-', 'NULL', '-999', '')) AS n_mapped FROM (UNPIVOT (SELECT * FROM ingested) ON COLUMNS(*) INTO NAME column_name VALUE value) GROUP BY 1")(
    lambda s, d: clean.sentinel_counts(raw(s, d))
)

# --- contracts, predicates and projections -----------------------------------------------------------------------
for _i, (_reason, _sql) in enumerate(oracle.BRONZE):
    query(f"flt_{_i + 1}", f"SELECT transaction_id, txn_timestamp, merchant_descriptor FROM ingested WHERE {_sql}")(
        lambda s, d, i=_i: raw(s, d).where(F.coalesce(contracts.bronze().checks[i].passes, F.lit(False))).select("transaction_id", "txn_timestamp", "merchant_descriptor")
    )
_CHECKS = dict(oracle.SILVER)


def _silver_check(name: str, reasons: list[str]) -> None:
    @query(name, "SELECT transaction_id, amount_inr, merchant_id FROM flagged WHERE " + " AND ".join(f"coalesce({_CHECKS[r]}, FALSE)" for r in reasons))
    def run(s, d):
        rows = build(s, d).checked
        for check in contracts.silver().checks:
            if check.reason in reasons:
                rows = rows.where(F.coalesce(check.passes, F.lit(False)))
        return rows.select("transaction_id", "amount_inr", "merchant_id")


_silver_check("flt_4", [r for r in _CHECKS if r.startswith("not_nullable")])
_silver_check("flt_5", ["Confidence out of bounds"])
_silver_check("flt_6", ["amount_inr_lte_zero_for_approved"])
query("flt_7_quarantine", "SELECT transaction_id, coalesce(reject_reason, '') AS reject_reason FROM checked")(lambda s, d: build(s, d).checked.select("transaction_id", F.coalesce("reject_reason", F.lit("")).alias("reject_reason")))


@query("flt_8_schema", f"SELECT txn_timestamp, merchant_descriptor, {oracle.reasons(oracle.BRONZE[1:])} AS reject_reason FROM ingested")
def flt_8(s, d):
    """A frame that lacks a column of the contract: no row is rejected for it, and a strict contract refuses the frame."""
    rows = raw(s, d).drop("transaction_id")
    try:
        contracts.judged(rows, contracts.bronze(), strict=True)
    except ValueError:
        return contracts.judged(rows, contracts.bronze()).select("txn_timestamp", "merchant_descriptor", "reject_reason")
    raise AssertionError("the frame wasn't refused")


query("flt_9", "SELECT reject_reason, count(*) AS n FROM checked WHERE reject_reason IS NOT NULL GROUP BY 1")(lambda s, d: contracts.rejected(build(s, d).checked).groupBy("reject_reason").agg(F.count("*").alias("n")))
query("flt_10", "SELECT transaction_id, reject_reason FROM parsed WHERE reject_reason IS NOT NULL")(lambda s, d: contracts.rejected(build(s, d).parsed).select("transaction_id", "reject_reason"))
query("flt_11", "SELECT count(*) AS total, count(*) FILTER (reject_reason IS NULL) AS passed, count(*) FILTER (reject_reason IS NOT NULL) AS rejected FROM checked")(lambda s, d: contracts.conservation(build(s, d).checked))
query("flt_12", "SELECT transaction_id FROM fct WHERE status = 'APPROVED' AND NOT is_outlier AND NOT is_near_duplicate")(lambda s, d: star(s, d)[0].where("status = 'APPROVED' AND NOT is_outlier AND NOT is_near_duplicate").select("transaction_id"))
_EXPLORE = "SELECT f.transaction_id, raw_descriptor, m.merchant_name, m.mcc, m.merchant_category, upper(match_method[1]) || match_method[2:] AS match_method, match_confidence, CASE WHEN match_confidence >= 0.9 THEN 'High' WHEN match_confidence >= 0.5 THEN 'Medium' WHEN match_confidence > 0 THEN 'Low' ELSE 'Unresolved' END AS band FROM fct f JOIN dim_merchant m ON m.merchant_id = f.merchant_id WHERE match_confidence >= 0.5"
query("flt_13", f"SELECT transaction_id, merchant_name, mcc FROM ({_EXPLORE} AND (lower(raw_descriptor) LIKE '%a%e%' OR lower(m.merchant_name) LIKE '%a%e%'))")(
    lambda s, d: gold.explore(*star(s, d), least=0.5, term="a%e", limit=None).select("transaction_id", "merchant_name", "mcc")
)
query("flt_14", "SELECT count(*) AS n FROM raw_rows WHERE mcc IS NOT NULL AND mcc <> 'NA' AND mcc <> '' AND mcc <> '0000'")(lambda s, d: transactions.from_orders(s, d).where("mcc IS NOT NULL AND mcc <> 'NA' AND mcc <> '' AND mcc <> '0000'").agg(F.count("*").alias("n")))
query("flt_15", "SELECT band, count(*) AS n FROM (SELECT CASE WHEN match_confidence >= 0.9 THEN 'High' WHEN match_confidence >= 0.5 THEN 'Medium' WHEN match_confidence > 0 THEN 'Low' ELSE 'Unresolved' END AS band FROM flagged) GROUP BY 1")(
    lambda s, d: build(s, d).checked.groupBy(c.confidence_band(F.col("match_confidence")).alias("band")).agg(F.count("*").alias("n"))
)
query("prj_1", "SELECT * FROM fct")(lambda s, d: star(s, d)[0])
query("prj_2", "SELECT transaction_id, amount_original, currency_original FROM parsed")(lambda s, d: build(s, d).parsed.select("transaction_id", "amount_original", "currency_original"))
query("prj_3", "SELECT DISTINCT 'Before (Raw Descriptor)' AS state, status FROM fct")(lambda s, d: star(s, d)[0].select(F.lit("Before (Raw Descriptor)").alias("state"), "status").distinct())

# --- joins -------------------------------------------------------------------------------------------------------
query("jon_1", "SELECT * FROM dim_merchant")(lambda s, d: star(s, d)[1])
query("jon_2", "SELECT f.transaction_id, m.mcc, m.merchant_category FROM fct f JOIN dim_merchant m ON m.merchant_id = f.merchant_id")(lambda s, d: star(s, d)[0].select("transaction_id", "merchant_id").join(star(s, d)[1], "merchant_id").select("transaction_id", "mcc", "merchant_category"))
query("jon_3", "SELECT f.transaction_id, x.year, x.month FROM fct f JOIN dim_date x ON x.date_key = f.date_key")(lambda s, d: star(s, d)[0].join(gold.dim_date(build(s, d).silver), "date_key").select("transaction_id", "year", "month"))
query("jon_4", "SELECT transaction_id, currency_inferred, amount_inr FROM priced")(lambda s, d: after(s, d, "priced").select("transaction_id", "currency_inferred", "amount_inr"))
query("jon_5", "SELECT r.transaction_id, mode_mcc FROM resolved r JOIN modes ON mode_id = merchant_id")(lambda s, d: (rows := after(s, d, "resolved")).join(resolve._modes(rows.where(~c.mcc_missing(F.col("mcc")) & F.col("merchant_id").isNotNull()).groupBy("merchant_id", "mcc").agg(F.count("*").alias("n"))), F.col("merchant_id") == F.col("__q_m")).select("transaction_id", F.col("__q_mode").alias("mode_mcc")))
query("jon_6")(lambda s, d: resolve.similar(after(s, d, "resolved").where("match_method = 'unresolved'").select("descriptor_clean").distinct(), reference.merchants(s, d)))
query("jon_7", "SELECT * FROM (" + oracle.similar("SELECT DISTINCT lower(trim(coalesce(city, ''))) AS s, n_name AS c FROM priced, nation WHERE trim(coalesce(city, '')) <> ''", 80) + ")")(lambda s, d: clean.similar_cities(after(s, d, "priced").select(F.lower(c.strip(F.col("city"))).alias("spelling")).where("spelling <> ''").distinct(), sorted(r[0] for r in reference.cities(s, d).collect())))
query("jon_8", "SELECT transaction_id FROM bronze WHERE reject_reason IS NULL")(lambda s, d: contracts.passed(build(s, d).bronze).select("transaction_id"))
query("jon_9", f"SELECT * FROM ({oracle.ALIKE} SELECT a, b FROM alike)")(lambda s, d: cluster.neighbours(after(s, d, "resolved").where("match_method = 'unresolved'").select("descriptor_clean").distinct(), "descriptor_clean"))
query("jon_10", "SELECT transaction_id, city_canonical FROM located")(lambda s, d: clean.cities(after(s, d, "priced"), reference.cities(s, d), fuzzy=False).select("transaction_id", "city_canonical"))

# --- aggregates --------------------------------------------------------------------------------------------------
_used = lambda s, d: star(s, d)[0].where("status = 'APPROVED' AND NOT is_outlier")
query("agg_1", f"SELECT raw_descriptor, round(sum(amount_inr), 2) AS total_spend FROM fct WHERE {_USED} GROUP BY 1")(lambda s, d: _used(s, d).groupBy("raw_descriptor").agg(gold.money(F.col("amount_inr")).alias("total_spend")))
query("agg_2", f"SELECT m.merchant_name, round(sum(amount_inr), 2) AS total_spend FROM fct f JOIN dim_merchant m ON m.merchant_id = f.merchant_id WHERE {_USED} GROUP BY 1")(lambda s, d: _used(s, d).join(star(s, d)[1].select("merchant_id", "merchant_name"), "merchant_id").groupBy("merchant_name").agg(gold.money(F.col("amount_inr")).alias("total_spend")))
query("agg_3", _MIX)(lambda s, d: gold.category_mix(*star(s, d)))
query("agg_4", "SELECT count(*) AS n, round(sum(amount_inr), 2) AS total FROM fct WHERE is_near_duplicate")(lambda s, d: star(s, d)[0].where("is_near_duplicate").agg(F.count("*").alias("n"), gold.money(F.col("amount_inr")).alias("total")))
_HEALTH = """SELECT f.channel, x.year, x.month, count(*) AS total_txns, round(count(*) FILTER (match_method = 'unresolved') * 100.0::DOUBLE / count(*), 9) AS pct_unresolved_merchants,
  round(count(*) FILTER (mcc_imputed_flag) * 100.0::DOUBLE / count(*), 9) AS pct_imputed_mcc, round(count(*) FILTER (is_near_duplicate) * 100.0::DOUBLE / count(*), 9) AS pct_near_duplicates,
  round(100.0::DOUBLE - (count(*) FILTER (match_method = 'unresolved') * 0.5::DOUBLE + count(*) FILTER (mcc_imputed_flag) * 0.2::DOUBLE) * 100.0::DOUBLE / count(*), 9) AS data_health_score
  FROM fct f JOIN dim_date x ON x.date_key = f.date_key GROUP BY f.channel, x.year, x.month"""
_health = lambda s, d: gold.health(star(s, d)[0], gold.dim_date(build(s, d).silver))
query("agg_5", _HEALTH)(_health)
query("flt_16", f"SELECT *, make_date(year, month, 1) AS period FROM ({_HEALTH}) WHERE data_health_score < 95")(lambda s, d: gold.breaches(_health(s, d), 95.0))
query("agg_6", "SELECT count(DISTINCT raw_descriptor) AS descriptors, count(DISTINCT city_canonical) AS cities FROM fct")(lambda s, d: star(s, d)[0].agg(F.countDistinct("raw_descriptor").alias("descriptors"), F.countDistinct("city_canonical").alias("cities")))
query("agg_7", "SELECT count(*) AS total, count(*) FILTER (mcc_imputed_flag) AS imputed, count(*) FILTER (is_near_duplicate) AS near FROM fct")(lambda s, d: star(s, d)[0].agg(F.count("*").alias("total"), F.count_if("mcc_imputed_flag").alias("imputed"), F.count_if("is_near_duplicate").alias("near")))
query("agg_8", "SELECT * FROM dim_account")(lambda s, d: gold.dim_account(build(s, d).silver))
query("agg_9", "SELECT mode_id AS merchant_id, mode_mcc AS mcc FROM modes")(lambda s, d: after(s, d, "resolved").where(~c.mcc_missing(F.col("mcc")) & F.col("merchant_id").isNotNull()).groupBy("merchant_id").agg(F.mode("mcc", True).alias("mcc")))
query("agg_10", f"SELECT * FROM ({oracle.CLUSTER_HEADS})")(lambda s, d: (left := after(s, d, "resolved").where("match_method = 'unresolved'").groupBy("descriptor_clean").agg(F.count("*").alias("n"))) and resolve._heads(cluster.density_clusters(left, "descriptor_clean"), left))
query("agg_11", "SELECT g AS mcc, mid, mad FROM spreads")(
    lambda s, d: (rows := build(s, d).checked.where("amount_inr > 0 AND mcc IS NOT NULL")).join(rows.groupBy(F.col("mcc").alias("g")).agg(F.median("amount_inr").alias("mid")), F.col("mcc") == F.col("g")).groupBy("mcc").agg(F.first("mid").alias("mid"), F.median(F.abs(F.col("amount_inr") - F.col("mid"))).alias("mad"))
)
query("agg_12", "SELECT reject_reason, count(*) AS n FROM bronze WHERE reject_reason IS NOT NULL GROUP BY 1")(lambda s, d: contracts.rejected(build(s, d).bronze).groupBy("reject_reason").agg(F.count("*").alias("n")))
_PROFILE = "WITH p AS (UNPIVOT (SELECT * FROM ingested) ON COLUMNS(*) INTO NAME column_name VALUE value), n AS (SELECT column_name, value, count(*) AS n FROM p GROUP BY ALL) SELECT column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS \"unique\", arg_max(value, (n, -r)) AS top, max(n) AS freq FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS r FROM n) GROUP BY column_name"
QUERIES["agg_13"] = QUERIES["met_3"] = lambda s, d: metrics.profile(raw(s, d))
ORACLE["agg_13"] = ORACLE["met_3"] = oracle.sql("SELECT * FROM ingested").rsplit("SELECT * FROM ingested", 1)[0].rstrip() + ",\n" + _PROFILE.removeprefix("WITH ")
query("agg_16", "SELECT (SELECT count(*) FROM raw_rows) - (SELECT count(*) FROM fct) - (SELECT count(*) FROM copies WHERE copy_no > 1) AS rows_quarantined")(lambda s, d: card(s, d).select("rows_quarantined"))
query("agg_17", "SELECT count(DISTINCT merchant_id) AS merchants, round(avg(amount_inr), 4) AS mean_inr, median(amount_inr) AS median_inr, max(amount_inr) AS max_inr FROM fct")(
    lambda s, d: star(s, d)[0].agg(F.countDistinct("merchant_id").alias("merchants"), F.round(F.avg("amount_inr"), 4).alias("mean_inr"), F.median("amount_inr").alias("median_inr"), F.max("amount_inr").alias("max_inr"))
)
query("agg_18", f"SELECT merchant_category, round(sum(total_spend_inr), 2) AS total FROM ({_MIX}) GROUP BY 1")(lambda s, d: gold.category_mix(*star(s, d)).groupBy("merchant_category").agg(F.round(F.sum("total_spend_inr"), 2).alias("total")))

# --- windows, sorts and sets -------------------------------------------------------------------------------------
_TOPS = """SELECT * FROM (SELECT raw_descriptor AS merchant_identity, round(sum(amount_inr), 2) AS total_spend, row_number() OVER (ORDER BY round(sum(amount_inr), 2) DESC, raw_descriptor) AS rank, 'Before (Raw Descriptor)' AS state FROM fct WHERE status = 'APPROVED' AND NOT is_outlier GROUP BY 1)
  WHERE rank <= 10 UNION ALL SELECT * FROM (SELECT m.merchant_name, round(sum(amount_inr), 2) AS total_spend, row_number() OVER (ORDER BY round(sum(amount_inr), 2) DESC, m.merchant_name) AS rank, 'After (Resolved Identity)' FROM fct f JOIN {dim} m ON m.merchant_id = f.merchant_id WHERE status = 'APPROVED' AND NOT is_outlier GROUP BY 1) WHERE rank <= 10"""
query("win_1", _TOPS.format(dim="dim_merchant"))(lambda s, d: gold.top_merchants(*star(s, d)))
_gap = lambda f: lambda s, d: after(s, d, "imputed").select("account_id", "merchant_id", "amount_inr", "txn_timestamp", F.abs(F.unix_micros(F.col("txn_timestamp").cast("timestamp")) - F.unix_micros(f("txn_timestamp").over(Window.partitionBy("account_id", "merchant_id", "amount_inr").orderBy("txn_timestamp")).cast("timestamp"))).alias("gap")).fillna(-1, ["gap"])
_GAP = "SELECT account_id, merchant_id, amount_inr, txn_timestamp, coalesce(gap0, -1) AS gap FROM (SELECT account_id, merchant_id, amount_inr, txn_timestamp, abs(epoch_us(txn_timestamp) - epoch_us({f}(txn_timestamp) OVER (PARTITION BY account_id, merchant_id, amount_inr ORDER BY txn_timestamp))) AS gap0 FROM imputed)"
query("win_2", _GAP.format(f="lag"))(_gap(F.lag))
query("win_3", _GAP.format(f="lead"))(_gap(F.lead))
query("win_4", "SELECT transaction_id, copy_no FROM copies")(lambda s, d: quality.number_copies(after(s, d, "imputed")).select("transaction_id", F.col("copy_no").cast("long").alias("copy_no")))
query("win_5", "SELECT transaction_id, median(amount_inr) OVER (PARTITION BY mcc) AS mid FROM flagged")(lambda s, d: build(s, d).checked.select("transaction_id", F.median("amount_inr").over(Window.partitionBy("mcc")).alias("mid")))
query("srt_1", f"SELECT raw_descriptor, round(sum(amount_inr), 2) AS total_spend FROM fct WHERE {_USED} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(
    lambda s, d: _used(s, d).groupBy("raw_descriptor").agg(gold.money(F.col("amount_inr")).alias("total_spend")).orderBy(F.col("total_spend").desc(), "raw_descriptor").limit(10)
)
query("srt_2", _TOPS.format(dim="dim_merchant") + " ORDER BY state, rank")(lambda s, d: gold.top_merchants(*star(s, d)))
query("srt_3", _HEALTH + " ORDER BY x.year, x.month, f.channel")(_health)
query("srt_4", "SELECT transaction_id, is_near_duplicate FROM near")(lambda s, d: build(s, d).checked.select("transaction_id", "is_near_duplicate"))
query("srt_5", f"{_EXPLORE} ORDER BY f.transaction_id, m.mcc, raw_descriptor LIMIT 100")(lambda s, d: gold.explore(*star(s, d), least=0.5))
query("srt_6", "SELECT transaction_id FROM raw_rows")(lambda s, d: transactions.from_orders(s, d).select("transaction_id").orderBy(F.xxhash64("transaction_id", F.lit(42))))
query("srt_7", f"SELECT merchant_category, round(sum(total_spend_inr), 2) AS total FROM ({_MIX}) GROUP BY 1 ORDER BY 2 DESC")(lambda s, d: QUERIES["agg_18"](s, d).orderBy(F.col("total").desc()))
query("set_1", f"SELECT raw_descriptor AS name FROM fct WHERE {_USED} UNION ALL SELECT descriptor_clean FROM fct WHERE {_USED}")(lambda s, d: _used(s, d).select(F.col("raw_descriptor").alias("name")).unionByName(_used(s, d).select(F.col("descriptor_clean").alias("name"))))
query("set_2", "SELECT transaction_id FROM copies WHERE copy_no = 1 UNION ALL SELECT transaction_id FROM copies WHERE copy_no > 1")(lambda s, d: build(s, d).checked.select("transaction_id").unionByName(build(s, d).dropped.select("transaction_id")))
query("set_3", "SELECT transaction_id FROM fct WHERE is_near_duplicate EXCEPT SELECT transaction_id FROM raw_rows WHERE ends_with(transaction_id, 'N')")(lambda s, d: star(s, d)[0].where("is_near_duplicate").select("transaction_id").subtract(transactions.from_orders(s, d).where(F.col("transaction_id").endswith("N")).select("transaction_id")))

# --- scalar rules ------------------------------------------------------------------------------------------------
query("scl_1_dates", f"SELECT transaction_id, txn_timestamp AS raw, {oracle.stamp('txn_timestamp')} AS parsed FROM ingested WHERE try_cast(txn_timestamp AS DOUBLE) IS NULL")(
    lambda s, d: raw(s, d).where(F.col("txn_timestamp").try_cast("double").isNull()).select("transaction_id", F.col("txn_timestamp").alias("raw"), c.parse_timestamp(F.col("txn_timestamp")).alias("parsed"))
)
query("scl_2_epoch", f"SELECT transaction_id, {oracle.stamp('txn_timestamp')} AS parsed FROM ingested WHERE try_cast(txn_timestamp AS DOUBLE) IS NOT NULL")(
    lambda s, d: raw(s, d).where(F.col("txn_timestamp").try_cast("double").isNotNull()).select("transaction_id", c.parse_timestamp(F.col("txn_timestamp")).alias("parsed"))
)
query("scl_3", "SELECT transaction_id, reject_reason FROM parsed WHERE txn_timestamp IS NULL")(lambda s, d: build(s, d).parsed.where("txn_timestamp IS NULL").select("transaction_id", "reject_reason"))
query("scl_4_amounts", f"SELECT transaction_id, amount AS raw, {oracle.amount('amount')} AS parsed FROM ingested")(lambda s, d: raw(s, d).select("transaction_id", F.col("amount").alias("raw"), c.parse_amount(F.col("amount")).alias("parsed")))
query("scl_5_currency", "SELECT transaction_id, currency_original, currency_inferred FROM priced")(lambda s, d: after(s, d, "priced").select("transaction_id", "currency_original", "currency_inferred"))
query("scl_6_inr", "SELECT transaction_id, amount, amount_inr FROM priced")(lambda s, d: after(s, d, "priced").select("transaction_id", "amount", "amount_inr"))
_BEST = oracle.similar("SELECT DISTINCT lower(trim(coalesce(city, ''))) AS s, n_name AS c FROM priced, nation WHERE trim(coalesce(city, '')) <> ''", 80)
query("scl_7_geo", f"""SELECT transaction_id, city, coalesce(n.n_name, b.best, p.city, '') AS city_canonical FROM priced p LEFT JOIN (SELECT DISTINCT n_name FROM nation) n ON lower(n.n_name) = lower(trim(coalesce(p.city, '')))
  LEFT JOIN ({_BEST}) b ON b.spelling = lower(trim(coalesce(p.city, '')))""")(lambda s, d: clean.cities(after(s, d, "priced"), reference.cities(s, d)).select("transaction_id", "city", "city_canonical"))
query("scl_7_geo_variants", f"""SELECT transaction_id, city, coalesce(n.c, b.best, p.city, '') AS city_canonical FROM priced p
  LEFT JOIN (SELECT DISTINCT v, min(c) OVER (PARTITION BY v) AS c FROM (SELECT n_name AS c, lower(trim(unnest([n_name, lower(n_name), replace(n_name, ' ', '')]))) AS v FROM nation)) n ON n.v = lower(trim(coalesce(p.city, '')))
  LEFT JOIN ({_BEST}) b ON b.spelling = lower(trim(coalesce(p.city, '')))""")(lambda s, d: clean.cities(after(s, d, "priced"), reference.cities(s, d), variants=reference.city_variants(s, d)).select("transaction_id", "city", "city_canonical"))
query("scl_8_sentinels", "SELECT transaction_id, account_id, city, country, channel, status, mcc, amount_original, currency_original FROM sentinel")(lambda s, d: after(s, d, "sentinel").select("transaction_id", "account_id", "city", "country", "channel", "status", "mcc", "amount_original", "currency_original"))
query("scl_9_tier0", f"SELECT transaction_id, {oracle.descriptor('merchant_descriptor')} AS descriptor_clean FROM ingested")(lambda s, d: raw(s, d).select("transaction_id", c.normal_descriptor(F.col("merchant_descriptor")).alias("descriptor_clean")))
query("scl_10", "SELECT mcc IS NULL OR mcc = '0000' AS missing, count(*) AS n FROM resolved GROUP BY 1")(lambda s, d: after(s, d, "resolved").groupBy(c.mcc_missing(F.col("mcc")).alias("missing")).agg(F.count("*").alias("n")))
query("scl_11", "SELECT transaction_id, is_outlier FROM flagged")(lambda s, d: build(s, d).checked.select("transaction_id", "is_outlier"))
query("scl_12_dateparts", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date_key, EXTRACT(YEAR FROM o_orderdate) AS year, EXTRACT(MONTH FROM o_orderdate) AS month, EXTRACT(DAY FROM o_orderdate) AS day, EXTRACT(DOW FROM o_orderdate) AS day_of_week FROM orders")(lambda s, d: gold.dim_date(table(s, d, "orders").select(F.col("o_orderdate").alias("txn_timestamp"))))
query("scl_13", "SELECT DISTINCT upper(match_method[1]) || match_method[2:] AS method, lower(m.merchant_name) AS name FROM fct f JOIN dim_merchant m ON m.merchant_id = f.merchant_id")(lambda s, d: star(s, d)[0].join(star(s, d)[1].select("merchant_id", "merchant_name").distinct(), "merchant_id").select(F.initcap("match_method").alias("method"), F.lower("merchant_name").alias("name")).distinct())
query("scl_14", "SELECT DISTINCT make_date(year, month, 1) AS period FROM dim_date")(lambda s, d: gold.dim_date(build(s, d).silver).select(F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1)).alias("period")).distinct())
query("scl_15", "SELECT transaction_id, format('{:,.2f}', abs(amount_inr)) AS shown FROM fct")(lambda s, d: star(s, d)[0].select("transaction_id", F.format_number(F.abs("amount_inr"), 2).alias("shown")))
query("scl_16_typed_amounts", r"SELECT transaction_id, try_cast(regexp_replace(regexp_replace(amount, '[,₹$€£]', '', 'g'), '^\((.*)\)$', '-\1') AS DOUBLE) AS parsed FROM ingested")(lambda s, d: raw(s, d).select("transaction_id", c.parse_amount_typed(F.col("amount")).alias("parsed")))

# --- resolution, duplicates, outliers ----------------------------------------------------------------------------
query("res_0", "SELECT DISTINCT descriptor_clean FROM named")(lambda s, d: after(s, d, "resolved").select("descriptor_clean").distinct())
query("res_1", "SELECT transaction_id, merchant_id, merchant_name, match_method, match_confidence FROM resolved")(lambda s, d: after(s, d, "resolved").select("transaction_id", "merchant_id", "merchant_name", "match_method", "match_confidence"))


def _tiers(*tiers: str) -> Query:
    return lambda s, d: resolve.merchants(after(s, d, "sentinel"), reference.merchants(s, d), tiers).select("transaction_id", "descriptor_clean", "merchant_id", "merchant_name", "match_method", "match_confidence")


query("res_2_fuzzy")(_tiers("exact", "fuzzy"))
query("res_3_cluster")(_tiers("exact", "fuzzy", "cluster"))
query("res_4", "SELECT transaction_id, merchant_name FROM resolved WHERE match_method = 'unresolved' AND merchant_id IS NULL")(lambda s, d: after(s, d, "resolved").where("match_method = 'unresolved' AND merchant_id IS NULL").select("transaction_id", "merchant_name"))
query("res_5", "SELECT transaction_id, mcc, mcc_imputed_flag FROM imputed")(lambda s, d: after(s, d, "imputed").select("transaction_id", "mcc", "mcc_imputed_flag"))
query("dup_1", "SELECT transaction_id FROM copies WHERE copy_no > 1")(lambda s, d: build(s, d).dropped.select("transaction_id"))
query("dup_2", "SELECT transaction_id FROM near WHERE is_near_duplicate")(lambda s, d: build(s, d).checked.where("is_near_duplicate").select("transaction_id"))
query("dup_2_events", """SELECT event_id FROM (SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS p, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)) WHERE p <= 3600000000 OR n <= 3600000000""")(lambda s, d: quality.flag_near(table(s, d, "events"), 3600, ("user_id", "event_type"), "ts").where("is_near_duplicate").select("event_id"))
query("out_1", "SELECT transaction_id FROM flagged WHERE is_outlier")(lambda s, d: build(s, d).checked.where("is_outlier").select("transaction_id"))
query("out_1_events", """WITH m AS (SELECT event_type AS g, median(value) AS mid FROM events WHERE value > 0 GROUP BY 1), s AS (SELECT g, any_value(mid) AS mid, median(abs(value - mid)) AS mad FROM events JOIN m ON event_type = g WHERE value > 0 GROUP BY 1)
  SELECT event_id FROM events JOIN s ON event_type = g WHERE value > 0 AND 0.6745 * abs(value - mid) / CASE WHEN mad = 0 THEN 1.0 ELSE mad END > 3.5""")(lambda s, d: quality.flag_outliers(table(s, d, "events"), "value", "event_type").where("is_outlier").select("event_id"))

# --- gold, views, metrics ----------------------------------------------------------------------------------------
query("gld_1", "SELECT * FROM dim_date")(lambda s, d: gold.dim_date(build(s, d).silver))
query("gld_2", "SELECT * FROM dim_account")(lambda s, d: gold.dim_account(build(s, d).silver))
query("gld_3", "SELECT * FROM dim_merchant")(lambda s, d: star(s, d)[1])
query("gld_3_unique", "SELECT * FROM dim_unique")(lambda s, d: gold.dim_merchant_unique(build(s, d).silver, reference.mcc_map(s)))
query("gld_4", "SELECT * FROM fct")(lambda s, d: star(s, d)[0])
query("vw_1", _TOPS.format(dim="dim_merchant"))(lambda s, d: gold.top_merchants(*star(s, d)))
query("vw_1_unique", _TOPS.format(dim="dim_unique"))(lambda s, d: gold.top_merchants(star(s, d)[0], gold.dim_merchant_unique(build(s, d).silver, reference.mcc_map(s))))
query("vw_2", _MIX)(lambda s, d: gold.category_mix(*star(s, d)))
query("vw_2_unique", _MIX.replace("dim_merchant", "dim_unique"))(lambda s, d: gold.category_mix(star(s, d)[0], gold.dim_merchant_unique(build(s, d).silver, reference.mcc_map(s))))
query("vw_3", "SELECT count(*) AS near_duplicate_txn_count, round(sum(amount_inr), 2) AS total_exposure_inr FROM fct WHERE is_near_duplicate AND status = 'APPROVED'")(lambda s, d: gold.duplicate_exposure(star(s, d)[0]))
query("vw_4", _HEALTH)(_health)
query("qry_5", f"{_EXPLORE} AND (lower(raw_descriptor) LIKE '%an%' OR lower(m.merchant_name) LIKE '%an%') ORDER BY f.transaction_id, m.mcc, raw_descriptor LIMIT 100")(lambda s, d: gold.explore(*star(s, d), least=0.5, term="an"))
_pct = lambda a, b: f"round(({a}) * 100.0::DOUBLE / ({b}), 9)"
query("met_1", f"""SELECT *, {_pct('rows_quarantined', 'total')} AS quarantine_pct FROM (SELECT *, total - clean - exact_duplicates_dropped AS rows_quarantined FROM (SELECT
    (SELECT count(DISTINCT nullif(merchant_descriptor, '')) FROM ingested) AS distinct_merchant_strings_raw, (SELECT count(DISTINCT merchant_name) FROM dim_merchant) AS distinct_merchant_strings_clean,
    100.0::DOUBLE AS rows_with_valid_date_clean_pct, 100.0::DOUBLE AS rows_with_numeric_amount_clean_pct, {_pct("SELECT count(*) FROM ingested WHERE mcc NOT IN ('NA', '', '0000')", 'SELECT count(*) FROM ingested')} AS rows_with_mcc_raw_pct,
    100.0::DOUBLE AS rows_with_mcc_clean_pct, (SELECT count(*) FROM fct WHERE mcc_imputed_flag) AS mcc_imputed_count, (SELECT count(DISTINCT nullif(city, '')) FROM ingested) AS distinct_city_spellings_raw,
    (SELECT count(DISTINCT city_canonical) FROM fct) AS distinct_city_spellings_clean, (SELECT count(*) FROM copies WHERE copy_no > 1) AS exact_duplicates_dropped, (SELECT count(*) FROM fct WHERE is_near_duplicate) AS near_duplicates_flagged,
    (SELECT count(*) FROM ingested) AS total, (SELECT count(*) FROM fct) AS clean))""")(lambda s, d: card(s, d))
ORACLE["met_1"] = ORACLE["met_1"].replace("SELECT *, round((rows_quarantined)", "SELECT * EXCLUDE (total, clean), round((rows_quarantined)")
_ACC = """SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * round(p, 9) * round(r, 9) / nullif(round(p, 9) + round(r, 9), 0), 0), 9) AS f1 FROM (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM (
  SELECT count(*) FILTER (t IS NOT NULL AND f IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (f IS NULL) AS fn FROM (SELECT DISTINCT transaction_id AS t FROM raw_rows WHERE ends_with(transaction_id, 'N')) FULL JOIN (SELECT DISTINCT transaction_id AS f FROM fct WHERE is_near_duplicate) ON t = f))"""
QUERIES["met_2"] = QUERIES["agg_15"] = lambda s, d: metrics.accuracy(transactions.from_orders(s, d).where(F.col("transaction_id").endswith("N")), star(s, d)[0].where("is_near_duplicate"))
ORACLE["met_2"] = ORACLE["agg_15"] = oracle.sql(_ACC)
query("met_4", "SELECT count(*) AS n, count(parsed) AS parsed, round(sum(parsed), 2) AS total FROM (SELECT " + oracle.amount("amount") + " AS parsed FROM ingested)")(
    lambda s, d: transactions.read_raw_csv(s, _csv(s, transactions.from_orders(s, d), "raw")).agg(F.count("*").alias("n"), F.count(c.parse_amount(F.col("amount"))).alias("parsed"), F.round(F.sum(c.parse_amount(F.col("amount"))), 2).alias("total"))
)
FULL = silver.Options()
query("pipeline_full")(lambda s, d: build(s, d, FULL).silver)
query("vw_1_full")(lambda s, d: gold.top_merchants(*star(s, d, FULL)))
query("met_1_full")(lambda s, d: card(s, d, FULL))


# --- generator ---------------------------------------------------------------------------------------------------
def _generated(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """truth, raw and log of as many raw rows as the folder has orders; made once for each application."""
    key = (s.sparkContext.applicationId, d, "generated")
    if key not in _built:
        truth = scratch.cut(synth.truth(s, table(s, d, "orders").count()), "truth")
        _built[key] = (truth, *synth.corrupt(truth))
    return _built[key]


query("gen_truth")(lambda s, d: _generated(s, d)[0])
query("gen_1", f"SELECT CAST(round(count(*) / {1 + synth.RATES['near'] + synth.RATES['copies']}) AS BIGINT) AS n FROM orders")(lambda s, d: _generated(s, d)[0].agg(F.countDistinct("transaction_id").alias("n")))
query("gen_2", """SELECT mcc, CAST('Category ' || substr(mcc, 3, 2) AS VARCHAR) AS merchant_category FROM mcc_map""")(lambda s, d: _generated(s, d)[0].select("mcc", "merchant_category").distinct())
query("def_raw")(lambda s, d: _generated(s, d)[1])
query("def_log")(lambda s, d: _generated(s, d)[2])
#: Each kind of defect hits the same number of rows whatever the seed: its rate of the rows it is drawn from, one at least.
_N = f"SELECT CAST(round(count(*) / {1 + synth.RATES['near'] + synth.RATES['copies']}) AS BIGINT) AS n FROM orders"
_M = f"SELECT n, n + greatest(CAST(round_even({synth.RATES['near']} * n, 0) AS BIGINT), 1) AS m FROM ({_N})"
_KINDS = [("near_duplicate", "near", "n"), ("extreme_outlier", "outliers", "n"), ("impossible_date", "impossible", "m"), ("paren_negative", "parens", "m"), ("missing_currency", "no_currency", "m"), ("missing_mcc", "no_mcc", "m"), ("sentinel_null", "sentinels", "m"), ("schema_drift", "drift", "m"), ("exact_duplicate", "copies", "m")]
_COUNTS = " UNION ALL ".join([f"SELECT '{kind}' AS defect_type, greatest(CAST(round_even({synth.RATES[rate]} * {of}, 0) AS BIGINT), 1) AS n, m FROM ({_M})" for kind, rate, of in _KINDS] + [f"SELECT '{kind}', m, m FROM ({_M})" for kind in ("descriptor", "date_format")])
query("agg_14", f"SELECT defect_type, n, round(n * 100.0 / m, 4) AS percent FROM ({_COUNTS})")(
    lambda s, d: (log := _generated(s, d)[2]).groupBy("defect_type").agg(F.count("*").alias("n")).join(log.agg(F.countDistinct("transaction_id").alias("m")), F.lit(True)).select("defect_type", "n", F.round(F.col("n") * 100.0 / F.col("m"), 4).alias("percent"))
)

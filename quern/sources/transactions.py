"""All-string card transactions: from raw CSV files, and derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ["transaction_id", "account_id", "txn_timestamp", "amount", "currency", "merchant_descriptor", "mcc", "city", "country", "channel", "status"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])

#: The spellings that the raw reader takes as missing (pandas' documented defaults).
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def blank_missing(raw: DataFrame) -> DataFrame:
    """Missing spellings and nulls of all columns as empty strings."""
    return raw.select(*[F.when(F.col(c).isNull() | F.col(c).isin(MISSING), "").otherwise(F.col(c)).alias(c) for c in raw.columns])


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """CSV with a header, every column text, missing spellings as empty strings."""
    return blank_missing(spark.read.schema(schema).option("header", True).option("escape", '"').csv(path))


def read_typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under a DDL schema; an empty field is null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def h(p: int, q: int) -> str:
    """A selector from 0 to 10,006 for each order, the same expression in Spark and DuckDB."""
    return f"((k * {p} + {q}) % 10007)"


H = {"acct": h(7919, 13), "ts": h(104729, 31), "fmt": h(1299709, 7), "amt": h(15485863, 101), "cur": h(32452843, 5), "desc": h(49979687, 61), "mcc": h(67867967, 17), "city": h(86028121, 3), "geo": h(982451653, 11), "sent": h(179424673, 29), "near": h(122949823, 43), "copy": h(141650939, 59)}


def _sql(duck: bool) -> str:
    """The transactions of the order tables; tables in braces. Integer arithmetic on keys alone picks the defects."""
    text = (lambda x: f"CAST({x} AS VARCHAR)") if duck else (lambda x: f"CAST({x} AS STRING)")
    date = (lambda f, p: f"strftime(ts, '{p}')") if duck else (lambda f, p: f"date_format(ts, \"{f}\")")
    money = "format('{:,.2f}', v)".replace("{", "{{").replace("}", "}}") if duck else "format_number(v, 2)"
    shifted = "d + to_seconds(sec)" if duck else "timestampadd(SECOND, sec, d)"
    epoch = "CAST(epoch(ts) AS BIGINT)" if duck else "unix_timestamp(CAST(ts AS TIMESTAMP))"
    whole = (lambda a, b: f"({a} // {b})") if duck else (lambda a, b: f"({a} div {b})")
    token = f"CASE {whole(H['sent'], 8)} % 6 WHEN 0 THEN 'NA' WHEN 1 THEN 'N/A' WHEN 2 THEN '-' WHEN 3 THEN 'NULL' WHEN 4 THEN 'none' ELSE '-999' END"
    dirty = lambda n: f"{H['sent']} < 800 AND {H['sent']} % 4 = {n}"
    letter = "chr(CAST(65 + k % 5 AS INT))"
    digits = "regexp_replace(p_brand, '[^0-9]', '', 'g')" if duck else "regexp_replace(p_brand, '[^0-9]', '')"
    return f"""
    WITH b AS (
      SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, o_totalprice AS v, p_name, p_brand, n_name
      FROM {{orders}} o JOIN {{part}} p ON p.p_partkey = o.o_orderkey % (SELECT max(p_partkey) + 1 FROM {{part}})
      JOIN {{customer}} cu ON cu.c_custkey = o.o_custkey JOIN {{nation}} n ON n.n_nationkey = cu.c_nationkey
    ), rows3 AS (
      SELECT *, '' AS tail, {H['ts']} * 7 % 86400 AS sec FROM b
      UNION ALL SELECT *, 'N' AS tail, {H['ts']} * 7 % 86400 + 1 + {H['near']} % 120 AS sec FROM b WHERE {H['near']} < 150
      UNION ALL SELECT *, '' AS tail, {H['ts']} * 7 % 86400 AS sec FROM b WHERE {H['copy']} < 100
    ), t AS (
      SELECT *, {shifted} AS ts, {money} AS f, replace({money}, ',', '') AS plain, upper(p_name) AS m FROM rows3
    )
    SELECT 'T' || lpad({text('k')}, 10, '0') || tail AS transaction_id,
      CASE {H['acct']} % 4 WHEN 1 THEN 'acc-' || lpad({text('c')}, 6, '0') WHEN 2 THEN 'ACC-' || lpad({text('c')}, 6, '0') || ' '
        WHEN 3 THEN ' ACC-' || lpad({text('c')}, 6, '0') ELSE 'ACC-' || lpad({text('c')}, 6, '0') END AS account_id,
      CASE WHEN {H['fmt']} < 12 THEN '2030-01-15 10:00:00' WHEN {H['fmt']} < 24 THEN '1900-01-01 00:00:00' WHEN {H['fmt']} < 40 THEN 'not a date'
        ELSE CASE {H['fmt']} % 6 WHEN 0 THEN {date('yyyy-MM-dd HH:mm:ss', '%Y-%m-%d %H:%M:%S')} WHEN 1 THEN {date('dd/MM/yyyy HH:mm', '%d/%m/%Y %H:%M')}
          WHEN 2 THEN {date('MM-dd-yyyy HH:mm:ss', '%m-%d-%Y %H:%M:%S')} WHEN 3 THEN {date('dd MMM yyyy HH:mm', '%d %b %Y %H:%M')}
          WHEN 4 THEN {date("yyyyMMdd'T'HHmmss", '%Y%m%dT%H%M%S')} ELSE {text(epoch)} END END AS txn_timestamp,
      CASE WHEN {H['amt']} < 200 THEN '(' || f || ')' WHEN {H['amt']} < 230 THEN 'unknown' WHEN {H['amt']} < 240 THEN '-999'
        ELSE CASE {H['amt']} % 8 WHEN 0 THEN plain WHEN 1 THEN '₹' || f WHEN 2 THEN '$' || f WHEN 3 THEN f || ' ' WHEN 4 THEN 'INR ' || f
          WHEN 5 THEN '₹ ' || f WHEN 6 THEN ' ' || plain ELSE f END END AS amount,
      CASE WHEN {H['cur']} % 7 = 0 THEN '' WHEN {H['cur']} % 8 = 1 THEN 'USD' WHEN {H['cur']} % 97 = 2 THEN 'XXX' ELSE 'INR' END AS currency,
      CASE WHEN {H['desc']} < 5 THEN replace(m, ' ', ',') WHEN {H['desc']} < 20 THEN '' WHEN {H['desc']} < 60 THEN 'ORBIT CAFE ' || {letter} || {letter}
        ELSE CASE {H['desc']} % 9 WHEN 0 THEN 'the ' || m WHEN 1 THEN 'SQ *' || m WHEN 2 THEN m || ' #' || {text('100 + k % 900')} WHEN 3 THEN lower(m) || ' india'
          WHEN 4 THEN m || '.COM' WHEN 5 THEN 'PAYPAL *' || m || ' NY' WHEN 6 THEN m || ' 9' || lpad({text('k % 1000000000')}, 9, '0')
          WHEN 7 THEN m || ' KA' ELSE substr(m, 1, 2) || substr(m, 4) END END AS merchant_descriptor,
      CASE WHEN {H['mcc']} % 4 = 0 THEN CASE {whole(H['mcc'], 4)} % 4 WHEN 0 THEN '' WHEN 1 THEN '0000' WHEN 2 THEN 'NA' ELSE 'N/A' END
        ELSE {text(f'5000 + CAST({digits} AS INT)')} END AS mcc,
      CASE WHEN {dirty(0)} THEN {token} ELSE CASE {H['city']} % 6 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN upper(n_name) || ' '
        WHEN 3 THEN ' ' || n_name WHEN 4 THEN substr(n_name, 1, 3) || substr(n_name, 5) ELSE upper(n_name) END END AS city,
      CASE WHEN {dirty(1)} THEN {token} ELSE CASE {H['geo']} % 6 WHEN 0 THEN 'IN' WHEN 1 THEN 'India' WHEN 2 THEN 'IND' WHEN 3 THEN 'in' WHEN 4 THEN 'US' ELSE 'USA' END END AS country,
      CASE WHEN {dirty(2)} THEN {token} ELSE CASE {H['geo']} % 7 WHEN 0 THEN 'POS' WHEN 1 THEN 'pos' WHEN 2 THEN 'ONLINE' WHEN 3 THEN 'online' WHEN 4 THEN 'e-comm' WHEN 5 THEN 'ATM' ELSE 'atm' END END AS channel,
      CASE WHEN {dirty(3)} THEN {token} ELSE CASE {H['cur']} % 20 WHEN 0 THEN 'DECLINED' WHEN 1 THEN 'REVERSED' ELSE 'APPROVED' END END AS status
    FROM t"""


ORACLE = _sql(True).format(orders="orders", part="part", customer="customer", nation="nation")


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction for each order, with defects, near-duplicates and exact copies; see ORACLE for the same in DuckDB."""
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "part", "customer", "nation")}
    return spark.sql(_sql(False), **tables)

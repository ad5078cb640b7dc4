"""DuckDB SQL for the transaction queries: the pipeline as a chain of common table expressions."""

from __future__ import annotations

from quern.sources import transactions

COLUMNS = transactions.COLUMNS

#: Fixed values, written out here once more, so that an error in the engine's own lists shows.
LEAST_EPOCH = 100000000
SENTINELS = ["NA", "N/A", "-", "NULL", "-999", ""]
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
DESCRIPTOR_RULES = [
    (r"[^\x00-\x7F]+", " "),
    (r"\.(COM|IN|CO|NET)\b", " "),
    (r"^(SQ|TST|PAYPAL|PP|SP|GOOGLE|APL)\s*\*+\s*", ""),
    (r"\b\d{10}\b", " "),
    (r"\b(NY|CA|DL|HR|KA|MH)\s*$", " "),
    (r"[#]?\s*\d{3,6}\s*$", " "),
    (r"\s+", " "),
]
FX = "SELECT * FROM (VALUES ('INR', 1.0::DOUBLE), ('USD', 83.25::DOUBLE), ('EUR', 90.5::DOUBLE), ('GBP', 105.75::DOUBLE)) t(currency, rate_to_inr)"
MCC_MAP = """SELECT CAST(code AS VARCHAR) AS mcc, 'Category ' || lpad(CAST(code % 100 AS VARCHAR), 2, '0') AS category,
  ['Food', 'Retail', 'Travel', 'Home', 'Services'][code % 5 + 1] AS category_group FROM range(5000, 5060) t(code) WHERE code NOT IN (5021, 5033)"""
MERCHANTS = """SELECT 'M' || substr(md5(n), 1, 8) AS merchant_id, n AS canonical_name, unnest([upper(n), upper(n) || ' INDIA', 'THE ' || upper(n)]) AS alias,
  CAST(5000 + length(n) % 60 AS VARCHAR) AS mcc, 'Category ' || lpad(CAST(length(n) % 60 AS VARCHAR), 2, '0') AS category FROM (SELECT DISTINCT p_name AS n FROM part)"""


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def amount(x: str) -> str:
    s = f"trim(coalesce({x}, ''))"
    return f"try_cast(regexp_replace(CASE WHEN starts_with({s}, '(') AND ends_with({s}, ')') THEN '-' || substr({s}, 2, length({s}) - 2) ELSE {s} END, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


def stamp(x: str) -> str:
    formats = ["%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M", "%m-%d-%Y %H:%M:%S", "%d %b %Y %H:%M", "%Y%m%dT%H%M%S"]
    tried = ", ".join(f"try_strptime({x}, '{f}')" for f in formats)
    return f"coalesce({tried}, CASE WHEN try_cast({x} AS DOUBLE) > {LEAST_EPOCH} THEN make_timestamp(CAST(try_cast({x} AS DOUBLE) * 1000000 AS BIGINT)) END)"


def descriptor(x: str) -> str:
    out = f"trim(upper(coalesce({x}, '')))"
    for pattern, by in DESCRIPTOR_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


def currency() -> str:
    return """CASE WHEN trim(coalesce(currency_original, '')) <> '' THEN trim(currency_original) WHEN contains(coalesce(amount_original, ''), '$') THEN 'USD'
      WHEN contains(coalesce(amount_original, ''), '₹') THEN 'INR' WHEN upper(coalesce(country, '')) IN ('US', 'USA') THEN 'USD' ELSE 'INR' END"""


def reasons(pairs: list[tuple[str, str]]) -> str:
    """Sorted reasons of failed checks joined by " | ", or null."""
    items = ", ".join(f"CASE WHEN NOT coalesce({ok}, FALSE) THEN '{name}' END" for name, ok in pairs)
    return f"nullif(array_to_string(list_sort(list_filter([{items}], lambda x: x IS NOT NULL)), ' | '), '')"


BRONZE = [
    ("Empty transaction_id", "length(transaction_id) > 0"),
    ("impossible_date", "NOT (starts_with(coalesce(txn_timestamp, ''), '1900-') OR starts_with(coalesce(txn_timestamp, ''), '2030-'))"),
    ("schema_drift", "NOT contains(coalesce(merchant_descriptor, ''), ',')"),
]
SILVER = [
    ("Confidence out of bounds", "match_confidence BETWEEN 0 AND 1"),
    ("amount_inr_lte_zero_for_approved", "coalesce(amount_inr > 0, FALSE) OR status IS DISTINCT FROM 'APPROVED'"),
    *[(f"not_nullable_{n}", f"{n} IS NOT NULL") for n in ("transaction_id", "merchant_id", "amount_inr", "txn_timestamp")],
]
_TEXTS = [x for x in COLUMNS if x not in ("txn_timestamp", "amount")] + ["amount_original", "currency_original", "currency_inferred", "city_canonical"]
_COMPARED = [x for x in COLUMNS if x not in ("transaction_id",)] + ["amount_original", "currency_original", "currency_inferred", "amount_inr", "city_canonical", "merchant_id", "merchant_name"]
_FACT = "transaction_id, account_id, merchant_id, CAST(txn_timestamp AS DATE) AS date_key, txn_timestamp, amount_inr, amount_original, currency_original, merchant_descriptor AS raw_descriptor, descriptor_clean, channel, status, city_canonical, country, match_method, match_confidence, mcc_imputed_flag, is_near_duplicate, is_outlier"

#: Name and query of each step; a later one may use all earlier ones.
STEPS = [
    ("raw_rows", transactions.ORACLE),
    ("merchants", MERCHANTS),
    ("fx", FX),
    ("mcc_map", MCC_MAP),
    ("ingested", "SELECT " + ", ".join(f"CASE WHEN {x} IS NULL OR {x} IN ({_list(MISSING)}) THEN '' ELSE {x} END AS {x}" for x in COLUMNS) + " FROM raw_rows"),
    ("bronze", f"SELECT *, {reasons(BRONZE)} AS reject_reason FROM ingested"),
    ("parsed0", f"SELECT * EXCLUDE (reject_reason) REPLACE ({stamp('txn_timestamp')} AS txn_timestamp, {amount('amount')} AS amount), amount AS amount_original, currency AS currency_original FROM bronze WHERE reject_reason IS NULL"),
    ("parsed", "SELECT *, nullif(concat_ws(' | ', CASE WHEN txn_timestamp IS NULL THEN 'unparseable_date' END, CASE WHEN amount IS NULL THEN 'unparseable_amount' END), '') AS reject_reason FROM parsed0"),
    ("priced", f"SELECT p.*, round_even(amount * coalesce(rate_to_inr, 1.0) * 100, 0) / 100 AS amount_inr FROM (SELECT * EXCLUDE (reject_reason), {currency()} AS currency_inferred FROM parsed WHERE reject_reason IS NULL) p LEFT JOIN fx ON fx.currency = p.currency_inferred"),
    ("located", "SELECT p.*, coalesce(n.n_name, p.city, '') AS city_canonical FROM priced p LEFT JOIN (SELECT DISTINCT n_name FROM nation) n ON lower(n.n_name) = lower(trim(coalesce(p.city, '')))"),
    ("sentinel", "SELECT * REPLACE (" + ", ".join(f"CASE WHEN trim({x}) IN ({_list(SENTINELS)}) THEN NULL ELSE {x} END AS {x}" for x in _TEXTS) + ") FROM located"),
    ("named", f"SELECT *, {descriptor('merchant_descriptor')} AS descriptor_clean FROM sentinel"),
    ("resolved", """SELECT n.*, m.merchant_id, CASE WHEN m.merchant_id IS NOT NULL THEN m.canonical_name WHEN descriptor_clean <> '' THEN descriptor_clean END AS merchant_name,
        CASE WHEN m.merchant_id IS NOT NULL THEN 'exact' WHEN descriptor_clean <> '' THEN 'unresolved' END AS match_method, CASE WHEN m.merchant_id IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS match_confidence
        FROM named n LEFT JOIN merchants m ON m.alias = n.descriptor_clean"""),
    ("modes", "SELECT merchant_id AS mode_id, mcc AS mode_mcc FROM (SELECT merchant_id, mcc, row_number() OVER (PARTITION BY merchant_id ORDER BY count(*) DESC, mcc) AS r FROM resolved WHERE mcc IS NOT NULL AND mcc <> '0000' AND merchant_id IS NOT NULL GROUP BY merchant_id, mcc) WHERE r = 1"),
    ("imputed", "SELECT r.* REPLACE (CASE WHEN mcc IS NULL OR mcc = '0000' THEN coalesce(mode_mcc, '9999') ELSE mcc END AS mcc), (mcc IS NULL OR mcc = '0000') AS mcc_imputed_flag FROM resolved r LEFT JOIN modes ON mode_id = merchant_id"),
    ("copies", f"SELECT *, row_number() OVER (PARTITION BY {', '.join(_COMPARED)} ORDER BY transaction_id, mcc_imputed_flag, descriptor_clean, match_method, match_confidence) AS copy_no FROM imputed"),
    ("near", """SELECT * EXCLUDE (copy_no), account_id IS NOT NULL AND merchant_id IS NOT NULL AND amount_inr IS NOT NULL AND txn_timestamp IS NOT NULL AND (
          coalesce(epoch_us(txn_timestamp) - epoch_us(lag(txn_timestamp) OVER w) <= 120000000, FALSE) OR coalesce(epoch_us(lead(txn_timestamp) OVER w) - epoch_us(txn_timestamp) <= 120000000, FALSE)) AS is_near_duplicate
        FROM copies WHERE copy_no = 1 WINDOW w AS (PARTITION BY account_id, merchant_id, amount_inr ORDER BY txn_timestamp)"""),
    ("medians", "SELECT mcc AS g, median(amount_inr) AS mid FROM near WHERE amount_inr > 0 AND mcc IS NOT NULL GROUP BY mcc"),
    ("spreads", "SELECT g, any_value(mid) AS mid, median(abs(amount_inr - mid)) AS mad FROM near JOIN medians ON mcc = g WHERE amount_inr > 0 GROUP BY g"),
    ("flagged", "SELECT n.*, coalesce(amount_inr > 0 AND 0.6745 * abs(amount_inr - mid) / CASE WHEN mad = 0 THEN 1.0 ELSE mad END > 3.5, FALSE) AS is_outlier FROM near n LEFT JOIN spreads ON mcc = g"),
    ("checked", f"SELECT *, {reasons(SILVER)} AS reject_reason FROM flagged"),
    ("silver", "SELECT * EXCLUDE (reject_reason) FROM checked WHERE reject_reason IS NULL"),
    ("dim_date", "SELECT DISTINCT CAST(txn_timestamp AS DATE) AS date_key, EXTRACT(YEAR FROM txn_timestamp) AS year, EXTRACT(MONTH FROM txn_timestamp) AS month, EXTRACT(DAY FROM txn_timestamp) AS day, EXTRACT(DOW FROM txn_timestamp) AS day_of_week FROM silver WHERE txn_timestamp IS NOT NULL"),
    ("dim_account", "SELECT DISTINCT account_id FROM silver WHERE account_id IS NOT NULL"),
    ("dim_merchant", """SELECT m.merchant_id, m.merchant_name, m.mcc, coalesce(category, 'Unclassified') AS merchant_category, coalesce(category_group, 'Unclassified') AS category_group
        FROM (SELECT DISTINCT merchant_id, merchant_name, mcc FROM silver WHERE merchant_id IS NOT NULL) m LEFT JOIN mcc_map x ON x.mcc = m.mcc"""),
    ("dim_unique", """SELECT m.merchant_id, m.merchant_name, m.mcc, coalesce(category, 'Unclassified') AS merchant_category, coalesce(category_group, 'Unclassified') AS category_group
        FROM (SELECT merchant_id, merchant_name, mcc, row_number() OVER (PARTITION BY merchant_id ORDER BY count(*) DESC, mcc, merchant_name) AS r FROM silver WHERE merchant_id IS NOT NULL GROUP BY merchant_id, merchant_name, mcc) m LEFT JOIN mcc_map x ON x.mcc = m.mcc WHERE r = 1"""),
    ("fct", f"SELECT {_FACT} FROM silver"),
]


def similar(pairs: str, least: float) -> str:
    """Of `pairs` (s, c) each s with the c of the largest ratio, at least `least`, of equals the first: the longest common
    subsequence letter by letter, as each row of its table is the running maximum of what the row before allows."""
    return f"""WITH RECURSIVE pairs AS ({pairs}),
    dp AS (
      SELECT s, c, 0 AS k, list_transform(range(0, length(c) + 1), lambda x: 0) AS row FROM pairs
      UNION ALL
      SELECT s, c, k + 1, list_transform(range(1, length(c) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i], CASE WHEN i > 1 AND lower(c)[i - 1] = s[k + 1] THEN row[i - 1] + 1 ELSE 0 END))))
      FROM dp WHERE k < length(s)
    ), scored AS (SELECT s, c, 200.0 * row[length(c) + 1] / (length(s) + length(c)) AS score FROM dp WHERE k = length(s))
    SELECT s AS spelling, arg_min(c, (-score, c)) AS best FROM scored WHERE score >= {least} GROUP BY s"""


#: Texts without a merchant, and the pairs of them at a cosine of 0.65 or more, all compared that share a gram.
ALIKE = r"""WITH RECURSIVE t AS (SELECT descriptor_clean AS doc, count(*) AS n FROM resolved WHERE match_method = 'unresolved' GROUP BY 1),
  w AS (SELECT doc, ' ' || unnest(regexp_split_to_array(lower(trim(doc)), '\s+')) || ' ' AS w FROM t),
  g AS (SELECT doc, unnest(list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)),
      CASE WHEN length(w) > 2 THEN list_transform(range(1, greatest(length(w) - 1, 2)), lambda i: substr(w, i, 3)) ELSE [] END,
      CASE WHEN length(w) > 3 THEN list_transform(range(1, greatest(length(w) - 2, 2)), lambda i: substr(w, i, 4)) ELSE [] END)) AS g FROM w),
  tf AS (SELECT doc, g, count(*) AS tf FROM g GROUP BY ALL),
  x AS (SELECT doc, g, tf * (ln((1 + (SELECT count(*) FROM t)) / (1 + count(*) OVER (PARTITION BY g))) + 1) AS x FROM tf),
  v AS MATERIALIZED (SELECT doc, g, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS v FROM x),
  alike AS MATERIALIZED (SELECT a.doc AS a, b.doc AS b FROM v a JOIN v b USING (g) WHERE a.doc <> b.doc GROUP BY 1, 2 HAVING sum(a.v * b.v) >= 0.65 - 1e-12)"""
CLUSTER_HEADS = (
    ALIKE
    + """,
  core AS (SELECT a AS core FROM alike GROUP BY a HAVING count(*) + 1 >= 3),
  link AS (SELECT a, b FROM alike WHERE a IN (SELECT core FROM core) AND b IN (SELECT core FROM core)),
  reach AS (SELECT core AS id, core AS root FROM core UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id AND reach.root < link.b),
  rooted AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
  border AS (SELECT a, min(b) AS nearest FROM alike WHERE a NOT IN (SELECT core FROM core) AND b IN (SELECT core FROM core) GROUP BY a),
  member AS (SELECT id AS doc, root FROM rooted UNION ALL SELECT a, root FROM border JOIN rooted ON id = nearest)
  SELECT substr(sha256(root), 1, 10) AS cluster, arg_min(doc, (-n, doc)) AS merchant_name FROM member JOIN t USING (doc) GROUP BY root"""
)


def sql(query: str) -> str:
    """`query` after as many of the steps as it needs."""
    import re

    wanted, text = [], query
    for name, body in reversed(STEPS):
        if re.search(rf"\b{name}\b", text):
            wanted.append(f"{name} AS MATERIALIZED ({body})")
            text += " " + body
    return ("WITH " + ",\n".join(reversed(wanted)) + "\n" if wanted else "") + query

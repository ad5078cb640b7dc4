"""Cleaning rules as Column expressions; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The timestamp formats, in the order in which they are tried.
DATE_FORMATS = ["yyyy-M-d H:m:s", "d/M/yyyy H:m", "M-d-yyyy H:m:s", "d MMM yyyy H:m", "yyyyMMdd'T'HHmmss"]
LEAST_EPOCH = 100_000_000
#: Texts that mean null.
SENTINELS = ["NA", "N/A", "-", "NULL", "-999", ""]
#: Of the descriptor rules, in their order.
DESCRIPTOR_RULES = [
    (r"[^\x00-\x7F]+", " "),
    (r"\.(COM|IN|CO|NET)\b", " "),
    (r"^(SQ|TST|PAYPAL|PP|SP|GOOGLE|APL)\s*\*+\s*", ""),
    (r"\b\d{10}\b", " "),
    (r"\b(NY|CA|DL|HR|KA|MH)\s*$", " "),
    (r"[#]?\s*\d{3,6}\s*$", " "),
    (r"\s+", " "),
]
BLANK = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, BLANK, "")


def parse_timestamp(c: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """The first format that fits, else epoch seconds above LEAST_EPOCH, else null; without a time zone."""
    seconds = c.try_cast("double")
    parsed = [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    epoch = F.when((seconds > LEAST_EPOCH) & (seconds < 253402300800), F.timestamp_seconds(seconds).cast("timestamp_ntz"))
    return F.coalesce(*parsed, epoch)


def parse_amount(c: Column) -> Column:
    """Digits, point and minus of the text as a double; (x) is -x. Null where that is no number."""
    s = strip(F.coalesce(c, F.lit("")))
    inner = F.concat(F.lit("-"), F.substring(s, 2, F.length(s) - 2))
    return F.regexp_replace(F.when(s.startswith("(") & s.endswith(")"), inner).otherwise(s), r"[^\d.\-]", "").try_cast("double")


def parse_amount_typed(c: Column) -> Column:
    """The other order of rules: symbols and commas go first, then (x) is -x, then a cast of what is left."""
    s = F.regexp_replace(c, r"[,₹$€£]", "")
    return F.regexp_replace(s, r"^\((.*)\)$", "-$1").try_cast("double")


def infer_currency(currency: Column, amount: Column, country: Column) -> Column:
    """The given one, else by the amount's symbol ($ before ₹), else by country, else INR."""
    given, raw = strip(F.coalesce(currency, F.lit(""))), F.coalesce(amount, F.lit(""))
    place = F.upper(F.coalesce(country, F.lit("")))
    return F.when(given != "", given).when(raw.contains("$"), "USD").when(raw.contains("₹"), "INR").when(place.isin("US", "USA"), "USD").otherwise("INR")


def to_cents(c: Column) -> Column:
    """Rounded to two places, halves to even."""
    return F.rint(c * 100) / 100


def null_sentinel(c: Column, sentinels: list[str] = SENTINELS) -> Column:
    return F.when(~strip(c).isin(sentinels), c)


def normal_descriptor(c: Column) -> Column:
    """Upper case without symbols, web suffixes, payment prefixes, phone numbers, state codes and store numbers."""
    out = strip(F.upper(F.coalesce(c, F.lit(""))))
    for pattern, by in DESCRIPTOR_RULES:
        out = F.regexp_replace(out, pattern, by)
    return strip(out)


def mcc_missing(c: Column) -> Column:
    return c.isNull() | (c == "0000")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.9, "High").when(c >= 0.5, "Medium").when(c > 0, "Low").otherwise("Unresolved")

"""Row contracts: named checks that are evaluated in one pass, with rejects and their reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASON = "reject_reason"


@dataclass(frozen=True)
class Check:
    """`passes` is true for good rows; null counts as false."""

    reason: str
    passes: Column
    needs: str  # the column that the check is about


@dataclass(frozen=True)
class Contract:
    name: str
    columns: dict[str, str]
    checks: tuple[Check, ...]


def bronze() -> Contract:
    c = F.col
    stamp = F.coalesce(c("txn_timestamp"), F.lit(""))
    return Contract(
        "bronze",
        {"transaction_id": "string", "txn_timestamp": "string", "merchant_descriptor": "string"},
        (
            Check("Empty transaction_id", F.length("transaction_id") > 0, "transaction_id"),
            Check("impossible_date", ~(stamp.startswith("1900-") | stamp.startswith("2030-")), "txn_timestamp"),
            Check("schema_drift", ~F.coalesce(c("merchant_descriptor").contains(","), F.lit(False)), "merchant_descriptor"),
        ),
    )


def silver(keep_unresolved: bool = False) -> Contract:
    c = F.col
    checks = [
        Check("Confidence out of bounds", c("match_confidence").between(0, 1), "match_confidence"),
        Check("amount_inr_lte_zero_for_approved", F.coalesce(c("amount_inr") > 0, F.lit(False)) | ~c("status").eqNullSafe("APPROVED"), "amount_inr"),
    ]
    for name in ["transaction_id", "merchant_id", "amount_inr", "txn_timestamp"]:
        if not (keep_unresolved and name == "merchant_id"):
            checks.append(Check(f"not_nullable_{name}", c(name).isNotNull(), name))
    kinds = {"transaction_id": "string", "merchant_id": "string", "amount_inr": "double", "match_confidence": "double", "txn_timestamp": "timestamp_ntz"}
    return Contract("silver", kinds, tuple(checks))


def judged(df: DataFrame, contract: Contract, strict: bool = False) -> DataFrame:
    """Adds reject_reason: the failed checks' reasons, sorted and joined by " | ", or null. The checks of a column that is
    missing or of another type are left out, so no row is rejected for it; with `strict` such a frame is an error."""
    kinds = dict(df.dtypes)
    wrong = {n: kinds.get(n, "missing") for n, k in contract.columns.items() if kinds.get(n) != k}
    if wrong and strict:
        raise ValueError(f"{contract.name}: these columns don't fit the contract: {wrong}")
    checks = [x for x in contract.checks if x.needs not in wrong]
    failed = F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(x.passes, F.lit(False)), x.reason) for x in checks])))
    return df.withColumn(REASON, F.when(F.size(failed) > 0, F.array_join(failed, " | ")))


def passed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(REASON).isNull()).drop(REASON)


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(REASON).isNotNull())


def conservation(rows: DataFrame) -> DataFrame:
    """total, passed, rejected: counted in one pass."""
    ok = F.col(REASON).isNull()
    return rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("rejected"))

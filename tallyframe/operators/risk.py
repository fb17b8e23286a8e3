"""Risk signals, score, reasons, level and the status that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.config import RISK, RiskWeights
from tallyframe.functions.columns import MONEY, compact
from tallyframe.functions.ranking import totals_before
from tallyframe.operators.dedup import BUSINESS_KEY, duplicate_by_key
from tallyframe.operators.validation import math_validation
from tallyframe.session import stored


def _over_average(average: Column, weights: RiskWeights) -> Column:
    total = F.col("total_amount").cast("double")
    return F.coalesce((average != 0) & (total > average * weights.anomaly_factor), F.lit(False))


def vendor_anomaly(invoices: DataFrame, vendors: DataFrame, weights: RiskWeights = RISK) -> DataFrame:
    """Adds (vendor_avg, anomaly): total above twice the stored vendor mean.

    No broadcast hint: Spark broadcasts the profiles when their measured size allows
    it and otherwise shuffles both sides, splitting a hot vendor at run time.
    """
    profile = vendors.select("vendor_name", F.col("avg_invoice_value").alias("vendor_avg"))
    joined = invoices.join(profile, "vendor_name", "left")
    return joined.withColumn("anomaly", _over_average(F.col("vendor_avg"), weights))


def vendor_anomaly_asof(invoices: DataFrame, approvals: DataFrame, weights: RiskWeights = RISK) -> DataFrame:
    """As ``vendor_anomaly`` with the mean of approvals strictly before ``created_at``.

    Events are first summed per (vendor, moment), which combines on the map side. The sums
    before each moment are prefix sums over range partitions of (vendor, moment), so a
    vendor with a third of all rows spreads over tasks, even with all of them in one day.
    """
    moments = (
        approvals.select("vendor_name", F.col("approved_at").alias("ts"), "total_amount", F.lit(1).alias("one"))
        .unionByName(
            invoices.select(
                "vendor_name",
                F.col("created_at").alias("ts"),
                F.lit(0).cast(MONEY).alias("total_amount"),
                F.lit(0).alias("one"),
            )
        )
        .filter(F.col("vendor_name").isNotNull() & F.col("ts").isNotNull())
        .groupBy("vendor_name", "ts")
        .agg(F.sum("total_amount").cast("decimal(28,2)").alias("value"), F.sum("one").alias("n"))
    )
    sums = {"value_before": F.coalesce("value", F.lit(0).cast("decimal(28,2)")), "n_before": F.col("n")}
    known = totals_before(moments, "vendor_name", ["ts"], sums).select(
        "vendor_name",
        F.col("ts").alias("created_at"),
        F.when(F.col("n_before") > 0, F.col("value_before").cast("double") / F.col("n_before")).alias("vendor_avg"),
    )
    joined = invoices.join(known, ["vendor_name", "created_at"], "left")
    return joined.withColumn("anomaly", _over_average(F.col("vendor_avg"), weights))


def risk_signals(
    invoices: DataFrame, lines: DataFrame, vendors: DataFrame, line_key: str = "id", weights: RiskWeights = RISK
) -> DataFrame:
    """Invoices with everything the score needs."""
    checked = math_validation(invoices, lines, line_key)
    return vendor_anomaly(duplicate_by_key(checked), vendors, weights)


def risk_score(signals: DataFrame, weights: RiskWeights = RISK) -> DataFrame:
    """Adds ``risk_score``; a missing confidence counts as certain."""
    points = [
        (F.coalesce("confidence_score", F.lit(1.0)) < weights.confidence_floor, weights.low_confidence),
        (~F.col("math_valid"), weights.math_mismatch),
        (F.col("duplicate_key"), weights.duplicate),
        (F.col("anomaly"), weights.anomaly),
    ]
    total = F.lit(0)
    for hit, value in points:
        total = total + F.when(hit, value).otherwise(0)
    return signals.withColumn("risk_score", total.cast("int"))


def risk_reasons(signals: DataFrame, weights: RiskWeights = RISK) -> DataFrame:
    """Adds the array ``risk_reasons``, in score order. Amounts are decimals as text."""
    percent = (F.col("confidence_score") * 100).cast("int").cast("string")
    average = F.round("vendor_avg", 2).cast(MONEY).cast("string")
    low = F.coalesce("confidence_score", F.lit(1.0)) < weights.confidence_floor
    return signals.withColumn(
        "risk_reasons",
        compact(
            [
                F.when(low, F.concat(F.lit("Low AI Confidence ("), percent, F.lit("%)"))),
                F.when(
                    ~F.col("math_valid"),
                    F.concat(F.lit("Math Mismatch (Diff: "), F.coalesce(F.col("difference").cast("string"), F.lit("None")), F.lit(")")),
                ),
                F.when(F.col("duplicate_key"), F.lit("Duplicate Invoice Detected")),
                F.when(
                    F.col("anomaly"),
                    F.concat(F.lit(f"Amount > {weights.anomaly_factor}x Vendor Avg ($"), average, F.lit(")")),
                ),
            ]
        ),
    )


def risk_level(scored: DataFrame, weights: RiskWeights = RISK) -> DataFrame:
    score = F.col("risk_score")
    level = F.when(score >= weights.high_from, "HIGH").when(score >= weights.medium_from, "MEDIUM").otherwise("LOW")
    return scored.withColumn("risk_level", level)


def validation_status(scored: DataFrame) -> DataFrame:
    """Adds (status, flag_reason). MEDIUM from a duplicate alone stays Verified."""
    high = F.col("risk_level") == "HIGH"
    wrong_sum = (F.col("risk_level") == "MEDIUM") & ~F.col("math_valid")
    return scored.withColumns(
        {
            "status": F.when(high | wrong_sum, "Flagged").otherwise("Verified"),
            "flag_reason": F.when(high, F.concat(F.lit("High Risk: "), F.array_join("risk_reasons", ", "))).when(
                wrong_sum, F.lit("Math Mismatch")
            ),
        }
    )


def score_invoices(
    invoices: DataFrame, lines: DataFrame, vendors: DataFrame, line_key: str = "id", weights: RiskWeights = RISK, row: str | None = None
) -> DataFrame:
    """Signals, score, reasons, level and status.

    In one plan, whose three joins carry what is read of the result. ``row`` is for invoices
    read with all their columns: it names a column that is unique in them and stored with
    them. Then only what the signals need goes through those joins, the signals are written,
    and the other columns are shuffled once, by ``row``.
    """
    if row is None:
        signals = risk_signals(invoices, lines, vendors, line_key, weights)
    else:
        read = list(dict.fromkeys([*BUSINESS_KEY, line_key, row]))
        found = risk_signals(invoices.select(*read), lines, vendors, line_key, weights)
        added = [c for c in found.columns if c not in read]
        rest = [c for c in invoices.columns if c not in read]
        whole = invoices.join(stored(found.select(row, *added), "signals"), row)
        signals = whole.select(*[c for c in read if c != row], *rest, *added)
    return validation_status(risk_level(risk_reasons(risk_score(signals, weights), weights), weights))

"""Vendor history: stored profiles and display statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import parse_iso_date


def vendor_profile(approvals: DataFrame) -> DataFrame:
    """(vendor_name, avg_invoice_value, invoice_count, last_invoice_date) from approval events.

    Every approval counts, also a repeated one. The last date is that of the most
    recent approval, not the highest date. Sums are decimals, so the mean does not
    depend on the order in which partitions are read.
    """
    return (
        approvals.filter(F.col("vendor_name").isNotNull())
        .groupBy("vendor_name")
        .agg(
            F.sum("total_amount").cast("double").alias("value_sum"),
            F.count(F.lit(1)).alias("invoice_count"),
            F.max_by("invoice_date", F.struct("approved_at", "id")).alias("last_invoice_date"),
        )
        .select(
            "vendor_name",
            (F.col("value_sum") / F.col("invoice_count")).alias("avg_invoice_value"),
            "invoice_count",
            "last_invoice_date",
        )
    )


def vendor_stats(invoices: DataFrame) -> DataFrame:
    """Per vendor over all stages: count, mean total, latest valid date, HIGH count."""
    return (
        invoices.filter(F.col("vendor_name").isNotNull() & (F.col("vendor_name") != ""))
        .groupBy("vendor_name")
        .agg(
            F.count(F.lit(1)).alias("invoice_count"),
            (F.sum("total_amount").cast("double") / F.count("total_amount")).alias("avg_amount"),
            F.max(parse_iso_date(F.col("invoice_date"))).alias("last_invoice"),
            F.count_if(F.col("risk_level") == "HIGH").alias("flagged_count"),
        )
    )

"""Queues, counts, service times, trends and top lists over the invoice table.

Time-dependent operators take ``as_of``; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.config import ACTIVE_STAGES, FUNNEL_STAGES, LIMITS, RISK, STAGES
from tallyframe.functions.columns import finite_or_null, micros_between, parse_number
from tallyframe.operators.workflow import invoice_source
from tallyframe.sources.stores import newest_first, oldest_first

_DAY_MICROS = 86_400_000_000
_HOUR_MICROS = 3_600_000_000


def _stage_is(*stages: str) -> Column:
    return F.col("approval_stage").isin(*stages)


def _high_pending() -> Column:
    return (F.col("risk_level") == "HIGH") & _stage_is(*ACTIVE_STAGES)


def _low_confidence() -> Column:
    return ~F.isnan("confidence_score") & (F.col("confidence_score") < RISK.confidence_floor)


def coerce_types(df: DataFrame, numbers: list[str], times: list[str]) -> DataFrame:
    """Text to numbers and zone-free timestamps; what cannot be read, and NaN, becomes null.

    A zone mark after the time is dropped; the written wall-clock time stays.
    """
    number = {c: parse_number(F.col(c)) for c in numbers}
    changes = {c: F.when(~F.isnan(value), value) for c, value in number.items()}
    zone = r"(\d{2}:\d{2}[0-9:.]*)\s*(Z|[+-]\d{2}:?\d{2})$"
    for c in times:
        local = F.regexp_replace(F.col(c).cast("string"), zone, "$1")
        changes[c] = F.try_to_timestamp(local).cast("timestamp_ntz")
    return df.withColumns(changes)


# --- counts: one pass each ---


def stage_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_stage_is(*ACTIVE_STAGES)).alias("active"),
        F.count_if(_stage_is("APPROVED")).alias("approved"),
        F.count_if(_stage_is("REJECTED")).alias("rejected"),
    )


def source_by_stage(df: DataFrame) -> DataFrame:
    """Source rows by stage columns, 0 where none. The stage list is fixed, so no extra pass finds it."""
    counts = [F.count_if(F.col("approval_stage") == s).alias(s) for s in STAGES]
    return invoice_source(df).filter(F.col("approval_stage").isNotNull()).groupBy("source").agg(*counts)


def avg_confidence(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(finite_or_null(F.col("confidence_score"))).alias("avg_confidence"))


def high_risk_pending(df: DataFrame) -> DataFrame:
    return df.filter(_high_pending())


def low_confidence(df: DataFrame) -> DataFrame:
    return df.filter(_low_confidence())


def approval_hours(df: DataFrame) -> DataFrame:
    """Mean, shortest and longest hours from creation to approval; the mean of no rows is 0."""
    hours = micros_between(F.col("created_at"), F.col("approval_timestamp")) / _HOUR_MICROS
    return df.filter(_stage_is("APPROVED")).agg(
        F.coalesce(F.avg(hours), F.lit(0.0)).alias("avg_hours"),
        F.min(hours).alias("min_hours"),
        F.max(hours).alias("max_hours"),
    )


def clerk_metrics(df: DataFrame) -> DataFrame:
    return invoice_source(df).agg(
        F.count_if(F.col("source") == "MANUAL_UPLOAD").alias("manual"),
        F.count_if(F.col("source") == "INGESTED_EMAIL").alias("ingested"),
        F.count_if(_stage_is("UPLOADED")).alias("pending_clerk"),
        F.count_if(_stage_is("REVIEWED")).alias("to_manager"),
    )


# --- service times ---


def days_pending(df: DataFrame, as_of: Column) -> DataFrame:
    """Adds whole days since creation (floored); 0 once approved, other stages keep ageing."""
    days = F.floor(micros_between(F.col("created_at"), as_of) / _DAY_MICROS)
    return df.withColumn("days_pending", F.when(_stage_is("APPROVED"), F.lit(0)).otherwise(days).cast("long"))


def sla_breaches(df: DataFrame, as_of: Column, limit_days: int = LIMITS.sla_days) -> DataFrame:
    return days_pending(df, as_of).filter(_stage_is("REVIEWED") & (F.col("days_pending") > limit_days))


def sla_status(df: DataFrame, as_of: Column, limit_days: int = LIMITS.sla_days) -> DataFrame:
    """Adds BREACH or On Track in every stage; an unknown age is On Track."""
    late = F.when(F.col("days_pending") > limit_days, "BREACH").otherwise("On Track")
    return days_pending(df, as_of).withColumn("sla_status", late)


def alerts(df: DataFrame, as_of: Column, limit_days: int = LIMITS.sla_days) -> DataFrame:
    """(alert, invoices) for each kind of alert that has any; all counted in one pass."""
    late = _stage_is("REVIEWED") & (F.col("days_pending") > limit_days)
    counts = days_pending(df, as_of).agg(
        F.count_if(_high_pending()).alias("high"),
        F.count_if(_low_confidence()).alias("low"),
        F.count_if(late).alias("late"),
    )
    return counts.select(
        F.expr("stack(3, 'HIGH_RISK_PENDING', high, 'LOW_CONFIDENCE', low, 'SLA_BREACH', late) AS (alert, invoices)")
    ).filter("invoices > 0")


# --- distributions and trends ---


def risk_distribution(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("risk_level").isNotNull())
        .groupBy("risk_level")
        .agg(F.count(F.lit(1)).alias("invoices"))
        .orderBy(F.col("invoices").desc(), "risk_level")
    )


def approval_funnel(df: DataFrame) -> DataFrame:
    """Counts of the four fixed stages in their order, 0 where none."""
    counts = df.agg(*[F.count_if(F.col("approval_stage") == s).alias(s) for s in FUNNEL_STAGES])
    pairs = ", ".join(f"{i + 1}, '{s}', {s}" for i, s in enumerate(FUNNEL_STAGES))
    return (
        counts.select(F.expr(f"stack({len(FUNNEL_STAGES)}, {pairs}) AS (place, approval_stage, invoices)"))
        .orderBy("place")
        .select("approval_stage", "invoices")
    )


def top_vendors(df: DataFrame, k: int = 5) -> DataFrame:
    """The k vendors with the highest summed total; the name decides ties."""
    return (
        df.filter(F.col("vendor_name").isNotNull())
        .groupBy("vendor_name")
        .agg(F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total_amount"))
        .orderBy(F.col("total_amount").desc(), "vendor_name")
        .limit(k)
    )


def confidence_trend(df: DataFrame) -> DataFrame:
    """(day, avg_confidence) for every day of the span; null on days without invoices.

    Only one row per day leaves the first aggregate, so the span and the fill are small.
    """
    daily = (
        df.filter(F.col("created_at").isNotNull())
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(F.avg(finite_or_null(F.col("confidence_score"))).alias("avg_confidence"))
    )
    span = daily.agg(F.min("day").alias("first"), F.max("day").alias("last")).filter(F.col("first").isNotNull())
    days = span.select(F.explode(F.expr("sequence(first, last, interval 1 day)")).alias("day"))
    return days.join(daily, "day", "left").orderBy("day")


# --- queues and lists ---


def recent_transactions(df: DataFrame, as_of: Column, k: int = 10) -> DataFrame:
    columns = ["created_at", "vendor_name", "total_amount", "risk_level", "approval_stage", "sla_status"]
    return newest_first(sla_status(df, as_of), "created_at", "id").limit(k).select(*columns)


def manager_queue(df: DataFrame) -> DataFrame:
    return oldest_first(df.filter(_stage_is("REVIEWED")), "created_at", "id")


def manager_overview(df: DataFrame) -> DataFrame:
    """Received and approved invoices, oldest first, told apart by ``section``."""
    section = F.when(_stage_is("REVIEWED"), "RECEIVED").otherwise("APPROVED_HISTORY")
    return oldest_first(df.filter(_stage_is("REVIEWED", "APPROVED")).withColumn("section", section), "created_at", "id")


def audit_queue(df: DataFrame) -> DataFrame:
    """Approved and not yet audited (unknown counts as not), and audited; oldest first."""
    pending = _stage_is("APPROVED") & ~F.col("audited").eqNullSafe(True)
    section = F.when(pending, "PENDING").when(_stage_is("AUDITED"), "DONE")
    return oldest_first(df.withColumn("section", section).filter(F.col("section").isNotNull()), "created_at", "id")


def clerk_queue(df: DataFrame) -> DataFrame:
    return newest_first(df.filter(_stage_is("UPLOADED")), "created_at", "id")


def submitted_to_manager(df: DataFrame, k: int = 30) -> DataFrame:
    columns = ["vendor_name", "invoice_date", "total_amount", "approval_stage", "processing_status", "reviewed_by"]
    return newest_first(df.filter(_stage_is("REVIEWED")), "created_at", "id").limit(k).select(*columns)


def recent_by_source(df: DataFrame, k: int = 20) -> DataFrame:
    """The k newest invoices of each source.

    The rank filter lets Spark keep only k rows per source in every map task before the
    shuffle (a window group limit), so the two sources do not become two large tasks.
    """
    columns = ["source", "vendor_name", "invoice_date", "total_amount", "approval_stage", "processing_status"]
    newest = Window.partitionBy("source").orderBy(F.col("created_at").desc(), F.col("id"))
    ranked = invoice_source(df).withColumn("place", F.row_number().over(newest))
    return ranked.filter(F.col("place") <= k).select(*columns)


def approved_report(df: DataFrame) -> DataFrame:
    return df.filter(_stage_is("APPROVED"))


def risk_report(df: DataFrame) -> DataFrame:
    return df.select("vendor_name", "total_amount", "risk_score", "risk_level", "confidence_score", "flag_reason")

"""Queries for queues, counts, service times and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import metrics as ops
from tallyframe.operators import vendors
from tallyframe.plans.fixture_sql import with_tables
from tallyframe.plans.registry import query
from tallyframe.plans.tables import as_of, ledger, number, with_workflow_columns
from tallyframe.sources import derived


def _inv(spark: SparkSession, sf: str) -> DataFrame:
    return derived.invoices(spark, sf)


def _status(spark: SparkSession, sf: str) -> DataFrame:
    return derived.invoice_status(spark, sf)


@query(
    "stage_totals",
    with_tables(
        """SELECT count(*) AS total, count(*) FILTER (approval_stage IN ('UPLOADED', 'REVIEWED')) AS active,
  count(*) FILTER (approval_stage = 'APPROVED') AS approved, count(*) FILTER (approval_stage = 'REJECTED') AS rejected FROM inv"""
    ),
)
def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return ops.stage_totals(_status(spark, sf))


_STAGE_COUNTS = ", ".join(
    f"count(*) FILTER (approval_stage = '{s}') AS \"{s}\"" for s in ("UPLOADED", "REVIEWED", "APPROVED", "REJECTED", "AUDITED")
)


@query("source_by_stage", with_tables(f"SELECT source, {_STAGE_COUNTS} FROM sources GROUP BY source"))
def _by_stage(spark: SparkSession, sf: str) -> DataFrame:
    return ops.source_by_stage(_status(spark, sf))


@query("avg_confidence", with_tables("SELECT round(avg(confidence_score), 6) AS avg_confidence FROM inv"))
def _confidence(spark: SparkSession, sf: str) -> DataFrame:
    return ops.avg_confidence(_status(spark, sf)).select(F.round("avg_confidence", 6).alias("avg_confidence"))


@query(
    "high_risk_pending",
    with_tables("SELECT id, vendor_name, CAST(risk_score AS bigint) AS risk_score FROM scored WHERE risk_level = 'HIGH' AND approval_stage IN ('UPLOADED', 'REVIEWED')"),
)
def _high(spark: SparkSession, sf: str) -> DataFrame:
    return ops.high_risk_pending(ledger(spark, sf)).select("id", "vendor_name", F.col("risk_score").cast("long").alias("risk_score"))


@query(
    "approval_hours",
    with_tables(
        """SELECT round(avg(h), 6) AS avg_hours, min(h) AS min_hours, max(h) AS max_hours FROM (
  SELECT CAST(1 + src_key % 96 AS double) AS h FROM inv WHERE approval_stage = 'APPROVED') t"""
    ),
)
def _hours(spark: SparkSession, sf: str) -> DataFrame:
    return ops.approval_hours(_status(spark, sf)).withColumn("avg_hours", F.round("avg_hours", 6))


@query("low_confidence", with_tables("SELECT id, confidence_score FROM inv WHERE confidence_score < 0.7"))
def _low(spark: SparkSession, sf: str) -> DataFrame:
    return ops.low_confidence(_status(spark, sf)).select("id", "confidence_score")


_DAYS = {
    "aged": """
SELECT *, CASE WHEN approval_stage = 'APPROVED' THEN 0 ELSE CAST(floor(epoch(TIMESTAMP '2001-08-05 00:00:00' - created_at) / 86400) AS bigint) END AS days_pending FROM inv"""
}


@query("days_pending", with_tables("SELECT id, days_pending FROM aged", **_DAYS))
def _days(spark: SparkSession, sf: str) -> DataFrame:
    return ops.days_pending(_status(spark, sf), as_of()).select("id", "days_pending")


@query(
    "sla_breaches",
    with_tables("SELECT id, days_pending FROM aged WHERE approval_stage = 'REVIEWED' AND days_pending > 3", **_DAYS),
)
def _breaches(spark: SparkSession, sf: str) -> DataFrame:
    return ops.sla_breaches(_status(spark, sf), as_of()).select("id", "days_pending")


@query(
    "sla_status",
    with_tables("SELECT id, CASE WHEN days_pending > 3 THEN 'BREACH' ELSE 'On Track' END AS sla_status FROM aged", **_DAYS),
)
def _sla(spark: SparkSession, sf: str) -> DataFrame:
    return ops.sla_status(_status(spark, sf), as_of()).select("id", "sla_status")


@query(
    "alerts",
    with_tables(
        """SELECT * FROM (
  SELECT 'HIGH_RISK_PENDING' AS alert, count(*) FILTER (risk_level = 'HIGH' AND approval_stage IN ('UPLOADED', 'REVIEWED')) AS invoices FROM ledger
  UNION ALL SELECT 'LOW_CONFIDENCE', count(*) FILTER (confidence_score < 0.7) FROM ledger
  UNION ALL SELECT 'SLA_BREACH', count(*) FILTER (approval_stage = 'REVIEWED' AND days_pending > 3) FROM ledger) t WHERE invoices > 0"""
    ),
)
def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.alerts(ledger(spark, sf), as_of())


@query("risk_distribution", with_tables("SELECT risk_level, count(*) AS invoices FROM scored GROUP BY risk_level"))
def _distribution(spark: SparkSession, sf: str) -> DataFrame:
    return ops.risk_distribution(ledger(spark, sf))


@query(
    "approval_funnel",
    with_tables(
        """SELECT s.approval_stage, count(inv.id) AS invoices FROM (VALUES ('UPLOADED'), ('REVIEWED'), ('APPROVED'), ('REJECTED')) s(approval_stage)
LEFT JOIN inv ON inv.approval_stage = s.approval_stage GROUP BY s.approval_stage"""
    ),
)
def _funnel(spark: SparkSession, sf: str) -> DataFrame:
    return ops.approval_funnel(_status(spark, sf))


@query(
    "top_vendors",
    with_tables(
        "SELECT vendor_name, CAST(sum(total_amount) AS double) AS total_amount FROM inv GROUP BY vendor_name ORDER BY sum(total_amount) DESC, vendor_name LIMIT 5"
    ),
)
def _top(spark: SparkSession, sf: str) -> DataFrame:
    return ops.top_vendors(_inv(spark, sf)).select("vendor_name", number("total_amount"))


@query(
    "confidence_trend",
    with_tables(
        """SELECT strftime(d.day, '%Y-%m-%d') AS day, round(avg(confidence_score), 6) AS avg_confidence
FROM (SELECT CAST(unnest(generate_series(CAST(lo AS timestamp), CAST(hi AS timestamp), INTERVAL '1' DAY)) AS date) AS day
  FROM (SELECT min(CAST(created_at AS date)) AS lo, max(CAST(created_at AS date)) AS hi FROM inv) r) d
LEFT JOIN inv ON CAST(created_at AS date) = d.day GROUP BY d.day"""
    ),
)
def _trend(spark: SparkSession, sf: str) -> DataFrame:
    return ops.confidence_trend(_status(spark, sf)).select(
        F.col("day").cast("string").alias("day"), F.round("avg_confidence", 6).alias("avg_confidence")
    )


@query(
    "recent_transactions",
    with_tables(
        """SELECT created_at, vendor_name, CAST(total_amount AS double) AS total_amount, risk_level, approval_stage,
  CASE WHEN days_pending > 3 THEN 'BREACH' ELSE 'On Track' END AS sla_status FROM ledger ORDER BY created_at DESC, id LIMIT 10"""
    ),
)
def _recent(spark: SparkSession, sf: str) -> DataFrame:
    return ops.recent_transactions(ledger(spark, sf), as_of()).withColumn("total_amount", F.col("total_amount").cast("double"))


@query(
    "vendor_stats",
    with_tables(
        """SELECT vendor_name, count(*) AS invoice_count, CAST(sum(total_amount) AS double) / count(*) AS avg_amount,
  strftime(max(TRY_CAST(invoice_date AS date)), '%Y-%m-%d') AS last_invoice, count(*) FILTER (risk_level = 'HIGH') AS flagged_count
FROM scored GROUP BY vendor_name"""
    ),
)
def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return vendors.vendor_stats(ledger(spark, sf)).withColumn("last_invoice", F.col("last_invoice").cast("string"))


_QUEUE = ["id", "vendor_name", "invoice_date", "total_amount", "created_at"]
_QUEUE_SQL = "id, vendor_name, invoice_date, CAST(total_amount AS double) AS total_amount, created_at"


def _queue(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*_QUEUE, *extra).withColumn("total_amount", F.col("total_amount").cast("double"))


@query("manager_queue", with_tables(f"SELECT {_QUEUE_SQL} FROM inv WHERE approval_stage = 'REVIEWED'"))
def _mqueue(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(ops.manager_queue(_inv(spark, sf)))


@query(
    "manager_overview",
    with_tables(
        f"""SELECT {_QUEUE_SQL}, CASE approval_stage WHEN 'REVIEWED' THEN 'RECEIVED' ELSE 'APPROVED_HISTORY' END AS section
FROM inv WHERE approval_stage IN ('REVIEWED', 'APPROVED')"""
    ),
)
def _overview(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(ops.manager_overview(_inv(spark, sf)), "section")


@query(
    "audit_queue",
    with_tables(
        f"""SELECT {_QUEUE_SQL}, CASE approval_stage WHEN 'AUDITED' THEN 'DONE' ELSE 'PENDING' END AS section
FROM inv WHERE approval_stage IN ('APPROVED', 'AUDITED')"""
    ),
)
def _aqueue(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(ops.audit_queue(with_workflow_columns(_inv(spark, sf))), "section")


@query(
    "clerk_metrics",
    with_tables(
        """SELECT count(*) FILTER (source = 'MANUAL_UPLOAD') AS manual, count(*) FILTER (source = 'INGESTED_EMAIL') AS ingested,
  count(*) FILTER (approval_stage = 'UPLOADED') AS pending_clerk, count(*) FILTER (approval_stage = 'REVIEWED') AS to_manager FROM sources"""
    ),
)
def _clerk(spark: SparkSession, sf: str) -> DataFrame:
    return ops.clerk_metrics(_status(spark, sf))


@query("clerk_queue", with_tables(f"SELECT {_QUEUE_SQL} FROM inv WHERE approval_stage = 'UPLOADED'"))
def _cqueue(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(ops.clerk_queue(_inv(spark, sf)))


@query(
    "submitted_to_manager",
    with_tables(
        """SELECT vendor_name, invoice_date, CAST(total_amount AS double) AS total_amount, approval_stage, processing_status, 'AP_CLERK' AS reviewed_by
FROM inv WHERE approval_stage = 'REVIEWED' ORDER BY created_at DESC, id LIMIT 30"""
    ),
)
def _submitted(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.submitted_to_manager(with_workflow_columns(_inv(spark, sf)))
    return out.withColumn("total_amount", F.col("total_amount").cast("double"))


@query(
    "recent_by_source",
    with_tables(
        """SELECT source, vendor_name, invoice_date, CAST(total_amount AS double) AS total_amount, approval_stage, processing_status FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id) AS place FROM sources) t WHERE place <= 20"""
    ),
)
def _by_source(spark: SparkSession, sf: str) -> DataFrame:
    return ops.recent_by_source(_inv(spark, sf)).withColumn("total_amount", F.col("total_amount").cast("double"))


@query("approved_report", with_tables(f"SELECT {_QUEUE_SQL} FROM inv WHERE approval_stage = 'APPROVED'"))
def _approved(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(ops.approved_report(_inv(spark, sf)))


@query(
    "risk_report",
    with_tables(
        """SELECT vendor_name, CAST(total_amount AS double) AS total_amount, CAST(risk_score AS bigint) AS risk_score, risk_level, confidence_score, flag_reason
FROM scored"""
    ),
)
def _risk_report(spark: SparkSession, sf: str) -> DataFrame:
    return ops.risk_report(ledger(spark, sf)).withColumns(
        {"risk_score": F.col("risk_score").cast("long"), "total_amount": F.col("total_amount").cast("double")}
    )


@query(
    "coerce_types",
    with_tables(
        """SELECT id, CASE WHEN total_amount = 'N/A' THEN NULL WHEN total_amount = 'NaN' THEN NULL ELSE CAST(total_amount AS double) END AS total_amount,
  CASE WHEN invoice_date = 'unknown' THEN NULL ELSE CAST(invoice_date AS timestamp) END AS invoice_date FROM hdr"""
    ),
)
def _coerce(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.coerce_types(derived.raw_headers(_inv(spark, sf)), ["total_amount"], ["invoice_date"])
    return out.select("id", "total_amount", "invoice_date")

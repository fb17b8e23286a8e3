"""Queries for duplicates, validation, risk and vendor history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import dedup, risk, validation, vendors
from tallyframe.plans.fixture_sql import with_tables
from tallyframe.plans.registry import query
from tallyframe.plans.tables import base, number, scored
from tallyframe.sources import derived


@query(
    "math_validation",
    with_tables(
        "SELECT id, math_valid, CAST(line_sum AS double) AS line_sum, CAST(difference AS double) AS difference FROM math"
    ),
)
def _math(spark: SparkSession, sf: str) -> DataFrame:
    out = validation.math_validation(derived.invoices(spark, sf), derived.line_amounts(spark, sf), "src_key")
    return out.select("id", "math_valid", number("line_sum"), number("difference"))


# --- duplicates ---


@query(
    "document_hash",
    "SELECT doc_id, CASE WHEN strlen(text) > 0 THEN sha256(text) END AS document_hash FROM documents",
)
def _hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = derived.table(spark, sf, "documents")
    return docs.select("doc_id", dedup.document_hash(F.col("text").cast("binary")).alias("document_hash"))


@query(
    "duplicate_by_hash",
    with_tables(
        "SELECT id, document_hash, coalesce(count(*) OVER (PARTITION BY document_hash) > 1, false) AS duplicate_hash FROM inv"
    ),
)
def _by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_by_hash(derived.invoice_status(spark, sf)).select("id", "document_hash", "duplicate_hash")


@query("duplicate_by_key", with_tables("SELECT id, duplicate_key FROM signals"))
def _by_key(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_by_key(derived.invoices(spark, sf)).select("id", "duplicate_key")


@query(
    "first_wins",
    with_tables(
        """SELECT id, document_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY vendor_name, invoice_date, total_amount ORDER BY created_at, id) AS rk FROM (
    SELECT *, row_number() OVER (PARTITION BY document_hash ORDER BY created_at, id) AS rh FROM inv
    WHERE approval_stage <> 'AUDITED' AND document_hash NOT IN (SELECT document_hash FROM inv WHERE approval_stage = 'AUDITED')) a
  WHERE rh = 1 AND (vendor_name, invoice_date, total_amount) NOT IN
    (SELECT (vendor_name, invoice_date, total_amount) FROM inv WHERE approval_stage = 'AUDITED')) b WHERE rk = 1"""
    ),
)
def _first(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["id", "created_at", "document_hash", *dedup.BUSINESS_KEY]
    inv = base(spark, sf)
    stored = inv.filter(F.col("approval_stage") == "AUDITED")
    batch = inv.filter(F.col("approval_stage") != "AUDITED").select(*cols)
    return dedup.first_wins(batch, stored, ["created_at", "id"]).select("id", "document_hash")


# --- field rules ---

_ISSUES = {
    "line_hits": """
SELECT * FROM (SELECT invoice_id, line_number, unnest([
  CASE WHEN trim(description) = '' THEN {'rule': 'C7', 'issue': concat('Line ', CAST(line_number AS varchar), ': Missing description')} END,
  CASE WHEN quantity <= 0 THEN {'rule': 'C8', 'issue': concat('Line ', CAST(line_number AS varchar), ': Quantity must be greater than zero')} END,
  CASE WHEN unit_price < 0 THEN {'rule': 'C10', 'issue': concat('Line ', CAST(line_number AS varchar), ': Unit price cannot be negative')} END,
  CASE WHEN total_price < 0 THEN {'rule': 'C11', 'issue': concat('Line ', CAST(line_number AS varchar), ': Total price cannot be negative')} END]) AS hit FROM lines) h WHERE hit IS NOT NULL""",
    "head_hits": """
SELECT * FROM (SELECT id, unnest([
  CASE WHEN vendor_name IS NULL OR vendor_name = '' THEN {'rule': 'C1', 'issue': 'Missing vendor name'} END,
  CASE WHEN NOT regexp_full_match(invoice_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN {'rule': 'C2', 'issue': 'Invalid invoice date format (expected YYYY-MM-DD)'} END,
  CASE WHEN total_amount NOT IN ('N/A', 'NaN') AND TRY_CAST(total_amount AS decimal(18,2)) <= 0 THEN {'rule': 'C3', 'issue': 'Invoice total must be greater than zero'} END,
  CASE WHEN total_amount = 'N/A' THEN {'rule': 'C4', 'issue': 'Invalid invoice total amount'} END,
  CASE WHEN upper(trim(currency)) NOT IN ('', 'USD', 'EUR', 'GBP', 'INR', 'AED', 'SGD', 'AUD', 'CAD', 'JPY', 'CNY')
    THEN {'rule': 'C5', 'issue': concat('Unsupported currency: ', upper(trim(currency)))} END]) AS hit FROM hdr) h WHERE hit IS NOT NULL""",
    "issue_rows": """
SELECT id, 0 AS section, 0 AS line_number, hit.rule AS rule, hit.issue AS issue FROM head_hits
UNION ALL SELECT id, 1, line_number, hit.rule, hit.issue FROM inv JOIN line_hits ON invoice_id = src_key
UNION ALL SELECT id, 2, 0, CASE WHEN line_sum IS NULL THEN 'C6' ELSE 'C13' END,
  CASE WHEN line_sum IS NULL THEN 'No line items extracted' ELSE 'Line-item total mismatch against invoice total' END
FROM hdr LEFT JOIN line_sums ON k = src_key
WHERE line_sum IS NULL OR (total_amount NOT IN ('N/A', 'NaN') AND TRY_CAST(total_amount AS decimal(18,2)) > 0
  AND abs(TRY_CAST(total_amount AS decimal(18,2)) - line_sum) > 1)""",
}


def _issue_rows(spark: SparkSession, sf: str) -> DataFrame:
    headers = derived.raw_headers(derived.invoices(spark, sf))
    return validation.compliance_issue_rows(headers, derived.lines(spark, sf), "src_key")


@query(
    "compliance_issues",
    with_tables(
        "SELECT id, CAST(section AS bigint) AS section, CAST(line_number AS bigint) AS line_number, rule, issue FROM issue_rows",
        **_ISSUES,
    ),
)
def _issues(spark: SparkSession, sf: str) -> DataFrame:
    return _issue_rows(spark, sf).withColumn("section", F.col("section").cast("long"))


@query(
    "compliance_verdict",
    with_tables(
        """SELECT hdr.id, count(rule) = 0 AS compliant, count(rule) AS issue_count
FROM hdr LEFT JOIN issue_rows ON issue_rows.id = hdr.id GROUP BY hdr.id""",
        **_ISSUES,
    ),
)
def _verdict(spark: SparkSession, sf: str) -> DataFrame:
    headers = derived.raw_headers(derived.invoices(spark, sf))
    return validation.compliance_verdict_rows(headers, _issue_rows(spark, sf))


# --- risk ---


@query("vendor_anomaly", with_tables("SELECT id, vendor_avg, anomaly FROM signals"))
def _anomaly(spark: SparkSession, sf: str) -> DataFrame:
    inv = derived.invoices(spark, sf)
    profile = vendors.vendor_profile(derived.approvals(inv))
    return risk.vendor_anomaly(inv, profile).select("id", "vendor_avg", "anomaly")


@query(
    "vendor_anomaly_asof",
    with_tables(
        """SELECT id, CASE WHEN n > 0 THEN v / n END AS vendor_avg,
  coalesce(v / n <> 0 AND CAST(total_amount AS double) > 2 * (v / n), false) AS anomaly FROM (
  SELECT id, any_value(inv.total_amount) AS total_amount, count(a.approved_at) AS n, CAST(coalesce(sum(a.total_amount), 0) AS double) AS v
  FROM inv LEFT JOIN (SELECT vendor_name, approved_at, total_amount FROM approvals) a
    ON a.vendor_name = inv.vendor_name AND a.approved_at < inv.created_at GROUP BY id) t"""
    ),
)
def _anomaly_asof(spark: SparkSession, sf: str) -> DataFrame:
    inv = base(spark, sf)
    return risk.vendor_anomaly_asof(inv, derived.approvals(inv)).select("id", "vendor_avg", "anomaly")


@query("risk_score", with_tables("SELECT id, CAST(risk_score AS bigint) AS risk_score FROM points"))
def _score(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("id", F.col("risk_score").cast("long").alias("risk_score"))


@query("risk_reasons", with_tables("SELECT id, reasons FROM points"))
def _reasons(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("id", F.array_join("risk_reasons", ", ").alias("reasons"))


@query("risk_level", with_tables("SELECT id, CAST(risk_score AS bigint) AS risk_score, risk_level FROM scored"))
def _level(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("id", F.col("risk_score").cast("long").alias("risk_score"), "risk_level")


@query("validation_status", with_tables("SELECT id, risk_level, status, flag_reason FROM scored"))
def _status(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("id", "risk_level", "status", "flag_reason")


@query(
    "vendor_profile",
    with_tables("SELECT vendor_name, avg_invoice_value, invoice_count, last_invoice_date FROM vend"),
)
def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return vendors.vendor_profile(derived.approvals(derived.invoices(spark, sf)))

"""Queries for report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.operators import extraction, reports
from tallyframe.operators.vendors import vendor_profile
from tallyframe.plans.fixture_sql import with_tables
from tallyframe.plans.registry import query
from tallyframe.plans.tables import as_of, ledger
from tallyframe.sources import derived

@query(
    "serialize_nested",
    """SELECT event_id, CAST(to_json({'user_id': user_id, 'event_type': event_type}) AS varchar) AS who,
  CAST(to_json([event_id, user_id]) AS varchar) AS ids FROM events""",
)
def _serialize(spark: SparkSession, sf: str) -> DataFrame:
    nested = derived.table(spark, sf, "events").select(
        "event_id", F.struct("user_id", "event_type").alias("who"), F.array("event_id", "user_id").alias("ids")
    )
    return reports.serialize_nested(nested)


@query(
    "workflow_view",
    with_tables(
        """SELECT id AS invoice_id, vendor_name, source, approval_stage, status, processing_status, risk_level, CAST(risk_score AS bigint) AS risk_score,
  created_by, reviewed_by, approved_by, audited, created_at, approval_timestamp FROM ledger"""
    ),
)
def _view(spark: SparkSession, sf: str) -> DataFrame:
    return reports.workflow_view(ledger(spark, sf)).withColumn("risk_score", F.col("risk_score").cast("long"))


def payload_rows(spark: SparkSession, sf: str, inv: DataFrame | None = None) -> DataFrame:
    """(id, vendor_name, ai_raw_data, ai_structured_output), a row per stored part.

    Every fifth invoice keeps its payload only as the structured copy.
    """
    read = extraction.keep_raw(extraction.parse_payload(derived.payloads(inv or derived.invoices(spark, sf), derived.lines(spark, sf))))
    only_copy = F.col("src_key") % 5 == 0
    return read.select(
        "id",
        "vendor_name",
        F.when(~only_copy, F.col("ai_structured_output")).alias("ai_raw_data"),
        F.when(only_copy, F.col("ai_structured_output")).alias("ai_structured_output"),
    )


@query(
    "line_items_long",
    with_tables(
        """SELECT inv.id AS invoice_id, vendor_name, line_number, json_extract_string(line, CASE WHEN bare THEN '$.sku' ELSE '$.sku.value' END) AS sku,
  CASE WHEN bare THEN l.description ELSE concat('{"confidence":0.9,"value":', to_json(l.description), '}') END AS description,
  CASE WHEN bare THEN q ELSE concat('{"confidence":0.9,"value":', q, '}') END AS quantity,
  CASE WHEN bare THEN u ELSE concat('{"confidence":0.9,"value":', u, '}') END AS unit_price,
  CASE WHEN bare THEN t ELSE concat('{"confidence":0.9,"value":', t, '}') END AS total_price
FROM inv JOIN line_json ON invoice_id = src_key JOIN (SELECT invoice_id AS i, line_number AS n, description, regexp_replace(CAST(quantity AS varchar), '\\.?0+$', '') AS q,
  regexp_replace(CAST(unit_price AS varchar), '\\.?0+$', '') AS u, regexp_replace(CAST(total_price AS varchar), '\\.?0+$', '') AS t FROM lines) l ON i = invoice_id AND n = line_number
WHERE src_key % 53 <> 0"""
    ),
)
def _long(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.line_items_long(payload_rows(spark, sf))
    sku = F.col("other_fields")["sku"]
    return rows.withColumn("sku", F.coalesce(F.get_json_object(F.when(sku.startswith("{"), sku), "$.value"), sku)).drop("other_fields")


FLAT_COLUMNS = (
    "currency", "currency.confidence", "currency.value", "explanations.invoice_date", "explanations.total_amount", "explanations.vendor_name",
    "invoice_date", "invoice_date.confidence", "invoice_date.value", "layout.page.area.corner.top.left.x", "line_items", "overall_confidence",
    "total_amount", "total_amount.confidence", "total_amount.value", "vendor_name", "vendor_name.confidence", "vendor_name.value",
)


@query(
    "ai_flattened",
    with_tables(
        "SELECT id AS invoice_id, "
        + ", ".join(f"""any_value(leaf.value) FILTER (leaf.path = '{c}') AS "{c}\"""" for c in FLAT_COLUMNS)
        + " FROM inv LEFT JOIN leaves ON invoice_id = id GROUP BY id"
    ),
)
def _flat(spark: SparkSession, sf: str) -> DataFrame:
    with session.noted() as used:
        payloads = payload_rows(spark, sf)
    flat = reports.ai_flattened(payloads)
    session.drop(spark, used)  # the opened payloads are written
    return flat


@query("ai_flattened_long", with_tables("SELECT invoice_id, leaf.path AS path, leaf.value AS value FROM leaves"))
def _flat_long(spark: SparkSession, sf: str) -> DataFrame:
    return reports.ai_flattened_long(payload_rows(spark, sf))


@query(
    "summary_metrics",
    with_tables(
        """SELECT 'generated_at' AS metric, '2001-08-05T00:00:00' AS value
UNION ALL SELECT 'total_invoices', CAST(count(*) AS varchar) FROM inv
UNION ALL SELECT 'total_invoice_edits', CAST(count(*) AS varchar) FROM edits
UNION ALL SELECT 'total_invoice_audits', CAST(count(*) AS varchar) FROM audits
UNION ALL SELECT 'total_vendors', CAST(count(*) AS varchar) FROM vend
UNION ALL SELECT concat('stage_', coalesce(approval_stage, 'None')), CAST(count(*) AS varchar) FROM inv GROUP BY approval_stage
UNION ALL SELECT concat('source_', source), CAST(count(*) AS varchar) FROM sources GROUP BY source"""
    ),
)
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    inv = derived.invoices(spark, sf)
    profile = vendor_profile(derived.approvals(inv))
    return reports.summary_metrics(inv, derived.edits(inv), derived.audits(inv), profile, as_of())


@query(
    "invoice_extract",
    with_tables(
        """SELECT id AS invoice_id, vendor_name AS "Vendor", invoice_date AS "Invoice Date", CAST(total_amount AS double) AS "Total Amount ($)",
  currency AS "Currency", status AS "Validation Status", risk_level AS "Risk Level", CAST(risk_score AS bigint) AS "Risk Score",
  confidence_score AS "AI Confidence", flag_reason AS "Flag Reason", approval_stage AS "Approval Stage", reviewed_by AS "Reviewed By",
  approved_by AS "Approved By", ai_version AS "AI Version" FROM ledger"""
    ),
)
def _extract(spark: SparkSession, sf: str) -> DataFrame:
    return reports.invoice_extract(ledger(spark, sf)).withColumns(
        {"Total Amount ($)": F.col("Total Amount ($)").cast("double"), "Risk Score": F.col("Risk Score").cast("long")}
    )


def transparency(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    inv = session.settled(lambda: ledger(spark, sf, whole=True), "ledger")  # eight tables, one base
    profile = vendor_profile(derived.approvals(inv))
    payloads = session.settled(lambda: payload_rows(spark, sf, inv), "payloads")  # for two of the tables
    return reports.transparency_tables(inv, derived.edits(inv), derived.audits(inv), profile, payloads, as_of())

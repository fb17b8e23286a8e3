"""Queries for the stage machine, logs and timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.config import STAGES
from tallyframe.functions.columns import MONEY
from tallyframe.operators import workflow as ops
from tallyframe.plans.fixture_sql import with_tables
from tallyframe.plans.registry import query
from tallyframe.plans.tables import as_of, scored, with_workflow_columns
from tallyframe.sources import derived

_CASES = """
SELECT event_id, event_id % 6 = 0 AS is_new,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE ['UPLOADED', 'REVIEWED', 'APPROVED', 'REJECTED', 'AUDITED'][1 + CAST(event_id % 5 AS int)] END AS previous_stage,
  next_stage, CASE WHEN event_id % 13 = 0 THEN lower(user_role) ELSE user_role END AS user_role FROM requests"""


@query(
    "transition_allowed",
    with_tables(
        """SELECT event_id, (CASE WHEN is_new THEN '' ELSE coalesce(previous_stage, 'UPLOADED') END, next_stage, upper(user_role))
  IN (SELECT (prev, nxt, role) FROM rules) AS allowed FROM cases""",
        cases=_CASES,
    ),
)
def _allowed(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    stages = F.array(*[F.lit(s) for s in STAGES])
    cases = derived.requests(spark, sf).withColumns(
        {
            "is_new": n % 6 == 0,
            "previous_stage": F.when(n % 11 != 0, F.get(stages, (n % 5).cast("int"))),
            "user_role": F.when(n % 13 == 0, F.lower("user_role")).otherwise(F.col("user_role")),
        }
    )
    return ops.transition_allowed(cases).select("event_id", "allowed")


REPLAY_CTES = {
    "numbered": """
SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY event_id) AS rn FROM requests""",
    "replay": """
SELECT invoice_id, CAST(0 AS bigint) AS rn, '' AS stage, CAST(NULL AS bigint) AS event_id, '' AS previous_stage, false AS accepted
FROM (SELECT DISTINCT invoice_id FROM requests) d
UNION ALL
SELECT q.invoice_id, q.rn, CASE WHEN t.role IS NOT NULL THEN q.next_stage ELSE p.stage END, q.event_id, p.stage, t.role IS NOT NULL
FROM replay p JOIN numbered q ON q.invoice_id = p.invoice_id AND q.rn = p.rn + 1
LEFT JOIN rules t ON t.prev = p.stage AND t.nxt = q.next_stage AND t.role = q.user_role""",
}
REPLAY_SQL = with_tables(
    "SELECT event_id, invoice_id, previous_stage, accepted FROM replay WHERE rn > 0", **REPLAY_CTES
)


@query("replay_requests", REPLAY_SQL)
def _replay(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.replay_requests(derived.requests(spark, sf))
    return out.select("event_id", "invoice_id", "previous_stage", "accepted")


_MOVES_SQL = """
SELECT id, approval_stage AS next_stage, status, flag_reason,
  CASE approval_stage WHEN 'UPLOADED' THEN 'AP_CLERK' WHEN 'REVIEWED' THEN 'AP_CLERK' WHEN 'AUDITED' THEN 'AUDITOR' ELSE 'FINANCE_MANAGER' END AS user_role,
  CASE WHEN src_key % 4 = 0 THEN '' WHEN src_key % 4 = 1 THEN 'AP_CLERK' END AS old_reviewer,
  CASE WHEN approval_stage = 'AUDITED' THEN 'FINANCE_MANAGER' END AS old_approver,
  CASE WHEN approval_stage = 'AUDITED' THEN created_at + INTERVAL '2' DAY END AS old_time
FROM {table}"""


def _moves(inv: DataFrame) -> DataFrame:
    stage = F.col("approval_stage")
    return inv.withColumns(
        {
            "next_stage": stage,
            "user_role": F.when(stage.isin("UPLOADED", "REVIEWED"), "AP_CLERK")
            .when(stage == "AUDITED", "AUDITOR")
            .otherwise("FINANCE_MANAGER"),
            "reviewed_by": F.when(F.col("src_key") % 4 == 0, "").when(F.col("src_key") % 4 == 1, "AP_CLERK"),
            "approved_by": F.when(stage == "AUDITED", "FINANCE_MANAGER"),
            "approval_timestamp": F.when(stage == "AUDITED", F.col("created_at") + F.expr("INTERVAL '2' DAY")),
        }
    )


@query(
    "stage_stamps",
    with_tables(
        """SELECT id, CASE next_stage WHEN 'REVIEWED' THEN user_role WHEN 'REJECTED' THEN user_role
    WHEN 'APPROVED' THEN coalesce(nullif(old_reviewer, ''), user_role) WHEN 'AUDITED' THEN old_reviewer END AS reviewed_by,
  CASE next_stage WHEN 'APPROVED' THEN user_role WHEN 'AUDITED' THEN old_approver END AS approved_by,
  CASE next_stage WHEN 'APPROVED' THEN TIMESTAMP '2001-08-05 00:00:00' WHEN 'AUDITED' THEN old_time END AS approval_timestamp FROM moves""",
        moves=_MOVES_SQL.replace("status, flag_reason,", "").format(table="inv"),
    ),
)
def _stamps(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.stage_stamps(_moves(derived.invoice_status(spark, sf)), as_of())
    return out.select("id", "reviewed_by", "approved_by", "approval_timestamp")


@query(
    "decision_labels",
    with_tables(
        """SELECT id, CASE next_stage WHEN 'APPROVED' THEN 'Verified' WHEN 'REJECTED' THEN 'Flagged' ELSE status END AS status,
  CASE next_stage WHEN 'APPROVED' THEN 'Manager Accepted - Sent to Auditor' WHEN 'REJECTED' THEN 'Manager Rejected'
    WHEN 'AUDITED' THEN 'Auditor Verified' ELSE flag_reason END AS flag_reason FROM moves""",
        moves=_MOVES_SQL.format(table="scored"),
    ),
)
def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return ops.decision_labels(_moves(scored(spark, sf))).select("id", "status", "flag_reason")


@query(
    "invoice_record",
    with_tables(
        """SELECT id, created_at, vendor_name, invoice_date, CAST(total_amount AS double) AS total_amount, currency, NULL::varchar AS status,
  'COMPLETED' AS processing_status, confidence_score, NULL::varchar AS flag_reason, NULL::varchar AS file_url,
  NULL::varchar AS ai_raw_data, NULL::varchar AS ai_structured_output, document_hash, 'AP_CLERK' AS created_by, 'AP_CLERK' AS last_reviewed_by,
  CAST(0 AS bigint) AS risk_score, 'LOW' AS risk_level, approval_stage, NULL::varchar AS reviewed_by, NULL::varchar AS approved_by,
  approval_timestamp, approval_stage = 'AUDITED' AS audited, NULL::varchar AS ai_version, NULL::timestamp AS reprocessed_at FROM inv"""
    ),
)
def _record(spark: SparkSession, sf: str) -> DataFrame:
    inv = derived.invoices(spark, sf).drop("created_by", "processing_status")
    out = ops.invoice_record(inv, "AP_CLERK").drop("ai_explanations")
    return out.withColumns({"risk_score": F.col("risk_score").cast("long"), "total_amount": F.col("total_amount").cast("double")})


@query(
    "edit_diff",
    with_tables(
        """SELECT id AS invoice_id, 'Vendor' AS field_name, vendor_name AS old_value, concat(vendor_name, ' Ltd') AS new_value, TIMESTAMP '2001-08-05 00:00:00' AS edited_at
FROM inv WHERE src_key % 6 = 0
UNION ALL SELECT id, 'Total', CAST(total_amount AS varchar), CAST(CAST(total_amount + 5 AS decimal(18,2)) AS varchar), TIMESTAMP '2001-08-05 00:00:00' FROM inv WHERE src_key % 10 = 0
UNION ALL SELECT id, 'Date', invoice_date, 'None', TIMESTAMP '2001-08-05 00:00:00' FROM inv WHERE src_key % 15 = 0
UNION ALL SELECT id, 'Line Items', 'Original AI Table', 'User Modified Table', TIMESTAMP '2001-08-05 00:00:00' FROM inv
WHERE id % 25 = 0 AND id IN (SELECT l_orderkey FROM lineitem)"""
    ),
)
def _diff(spark: SparkSession, sf: str) -> DataFrame:
    before = derived.invoices(spark, sf)
    k = F.col("src_key")
    after = before.withColumns(
        {
            "vendor_name": F.when(k % 6 == 0, F.concat("vendor_name", F.lit(" Ltd"))).otherwise(F.col("vendor_name")),
            "total_amount": F.when(k % 10 == 0, (F.col("total_amount") + 5).cast(MONEY)).otherwise(F.col("total_amount")),
            "invoice_date": F.when(k % 15 != 0, F.col("invoice_date")),
        }
    )
    lines = derived.lines(spark, sf)
    touched = (F.col("invoice_id") % 25 == 0) & (F.col("line_number") == 1)
    edited = lines.withColumn("quantity", F.when(touched, F.col("quantity") + 1).otherwise(F.col("quantity")))
    return ops.edit_diff(before, after, as_of(), ops.changed_lines(lines, edited))


@query("audit_records", with_tables("SELECT invoice_id, audited_by, audit_note, TIMESTAMP '2001-08-05 00:00:00' AS audited_at FROM audits"))
def _audits(spark: SparkSession, sf: str) -> DataFrame:
    return ops.audit_records(ops.decision_labels(_moves(scored(spark, sf))), as_of())


@query("editable", with_tables("SELECT id, approval_stage <> 'APPROVED' AS editable FROM inv"))
def _editable(spark: SparkSession, sf: str) -> DataFrame:
    return ops.editable(derived.invoice_status(spark, sf)).select("id", "editable")


@query(
    "timeline",
    with_tables(
        """SELECT id AS invoice_id, created_at AS event_time, 'UPLOADED' AS stage, concat('Uploaded by ', created_by) AS description FROM led
UNION ALL SELECT id, coalesce(approval_timestamp, created_at), 'REVIEWED', concat('Reviewed by Manager (', reviewed_by, ')') FROM led WHERE reviewed_by <> ''
UNION ALL SELECT id, approval_timestamp, 'APPROVED', concat('Approved by ', approved_by) FROM led WHERE approval_stage = 'APPROVED'
UNION ALL SELECT id, approval_timestamp, 'REJECTED', 'Rejected by Manager' FROM led WHERE approval_stage = 'REJECTED'
UNION ALL SELECT id, coalesce(reprocessed_at, approval_timestamp), 'AUDITED', 'Audited and Verified' FROM led WHERE approval_stage = 'AUDITED'
UNION ALL SELECT invoice_id, min(edited_at), 'EDITED', concat(CAST(count(*) AS varchar), ' edit(s) made by AP Clerk') FROM edits GROUP BY invoice_id""",
        led="""SELECT *, CASE approval_stage WHEN 'REVIEWED' THEN 'AP_CLERK' WHEN 'UPLOADED' THEN NULL ELSE 'FINANCE_MANAGER' END AS reviewed_by,
  CASE WHEN approval_stage IN ('APPROVED', 'AUDITED') THEN 'FINANCE_MANAGER' END AS approved_by,
  CASE WHEN src_key % 97 = 0 THEN created_at + INTERVAL '20' DAY END AS reprocessed_at FROM inv""",
    ),
)
def _timeline(spark: SparkSession, sf: str) -> DataFrame:
    edits = derived.edits(derived.invoices(spark, sf))
    return ops.timeline(with_workflow_columns(derived.invoice_status(spark, sf)), edits)


@query("invoice_source", with_tables("SELECT id, source FROM sources"))
def _source(spark: SparkSession, sf: str) -> DataFrame:
    return ops.invoice_source(derived.invoice_status(spark, sf)).select("id", "source")

"""Queries for scans and sinks. Sink queries write to a new shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyframe import schemas, session
from tallyframe.operators import metrics, workflow
from tallyframe.operators.vendors import vendor_profile
from tallyframe.plans.fixture_sql import with_tables
from tallyframe.plans.registry import query
from tallyframe.plans.reporting import transparency
from tallyframe.plans.tables import ledger
from tallyframe.sources import derived, sinks, stores


def _stored(spark: SparkSession, rows: DataFrame, name: str, schema: StructType, day: str | None = None) -> str:
    """A folder with one stored table, for the scans."""
    folder = session.scratch_dir(spark, "tables")
    sinks.write_table(rows, folder, name, schema, day)
    return folder


@query(
    "scan_invoices",
    with_tables(
        """SELECT id, vendor_name, invoice_date, CAST(total_amount AS double) AS total_amount, currency, status, processing_status, confidence_score, flag_reason,
  document_hash, created_by, CAST(risk_score AS bigint) AS risk_score, risk_level, approval_stage, reviewed_by, approved_by, approval_timestamp, audited, ai_version,
  reprocessed_at, created_at FROM ledger"""
    ),
)
def _invoices(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"ai_raw_data": "string", "ai_structured_output": "string", "last_reviewed_by": "string", "ai_explanations": "map<string,string>"}
    rows = ledger(spark, sf).withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    table = stores.scan_invoices(spark, _stored(spark, rows, "invoices", schemas.INVOICES, "created_at"))
    return table.drop(*kinds, "file_url").withColumns(
        {"total_amount": F.col("total_amount").cast("double"), "risk_score": F.col("risk_score").cast("long")}
    )


@query("scan_edits", with_tables("SELECT * FROM edits"))
def _edits(spark: SparkSession, sf: str) -> DataFrame:
    return stores.scan_edits(spark, _stored(spark, derived.edits(derived.invoices(spark, sf)), "invoice_edits", schemas.EDITS, "edited_at"))


@query("scan_audits", with_tables("SELECT * FROM audits"))
def _audits(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.audits(derived.invoice_status(spark, sf))
    return stores.scan_audits(spark, _stored(spark, rows, "invoice_audits", schemas.AUDITS, "audited_at"))


@query(
    "scan_vendors",
    with_tables("SELECT vendor_name, avg_invoice_value, invoice_count, last_invoice_date FROM vend"),
)
def _vendors(spark: SparkSession, sf: str) -> DataFrame:
    return stores.scan_vendors(spark, _stored(spark, vendor_profile(derived.approvals(derived.invoices(spark, sf))), "vendors", schemas.VENDORS))


@query("edits_for", with_tables("SELECT * FROM edits WHERE invoice_id IN (SELECT id FROM inv WHERE approval_stage = 'APPROVED')"))
def _edits_for(spark: SparkSession, sf: str) -> DataFrame:
    inv = derived.invoices(spark, sf)
    ids = inv.filter("approval_stage = 'APPROVED'").select(F.col("id").alias("invoice_id"))
    return stores.edits_for(derived.edits(inv), ids)


@query(
    "scan_documents",
    """SELECT concat('doc_', CAST(doc_id AS varchar), CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.png' END) AS file_name,
  CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'png' END AS extension, strlen(coalesce(text, '')) + 1 AS size_bytes, sha256(concat(coalesce(text, ''), chr(10))) AS document_hash
FROM documents""",
)
def _documents(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".png"))
    path = session.scratch_dir(spark, "documents")
    sinks.write_text_files(derived.table(spark, sf, "documents").select(name.alias("name"), F.col("text").alias("content")), path)
    return stores.scan_documents(spark, path).withColumn("document_hash", F.sha2("content", 256)).drop("content", "path")


@query("scan_messages", with_tables("SELECT message_id, sender, subject, filename, sha256(content) AS document_hash FROM msg_parts"))
def _messages(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.operators.mail import parse_messages

    raw = derived.raw_messages(derived.table(spark, sf, "documents"))
    name = F.concat(F.col("message_id").cast("string"), F.lit(".eml")).alias("name")
    path = session.scratch_dir(spark, "messages")
    sinks.write_text_files(raw.select(name, F.col("raw").cast("string").alias("content")), path)
    parts = parse_messages(stores.scan_messages(spark, path))
    return parts.select("message_id", "sender", "subject", "filename", F.sha2("content", 256).alias("document_hash"))


@query(
    "upsert_invoices",
    with_tables(
        """SELECT id, vendor_name, CAST(CASE WHEN id % 10 = 0 THEN total_amount + 1 ELSE total_amount END AS double) AS total_amount,
  CASE WHEN id % 10 = 0 AND id < 1000000000 THEN 'REVIEWED' ELSE approval_stage END AS approval_stage, 'TABLE' AS part FROM inv
WHERE id < 1000000000 OR id % 10 = 0
UNION ALL SELECT id + 5000000000, vendor_name, CAST(total_amount + 1 AS double), 'REVIEWED', 'REFUSED' FROM inv WHERE id % 100 = 0 AND id < 1000000000
UNION ALL SELECT id, vendor_name, CAST(total_amount AS double), 'REVIEWED', 'REFUSED' FROM inv WHERE id % 100 = 55 AND id < 1000000000"""
    ),
)
def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    inv = derived.invoices(spark, sf).select("id", "vendor_name", "total_amount", "approval_stage")
    current = inv.filter(F.col("id") < derived.RESUBMITTED)
    more = (F.col("total_amount") + 1).cast("decimal(18,2)")
    changed = inv.filter(F.col("id") % 10 == 0).withColumn("total_amount", more)
    old = F.col("id") < derived.RESUBMITTED
    changes = changed.withColumns(
        {"is_new": ~old, "approval_stage": F.when(old, "REVIEWED").otherwise(F.col("approval_stage"))}
    )
    unknown = changes.filter(old & (F.col("id") % 100 == 0)).withColumn("id", F.col("id") + 5_000_000_000)
    taken = current.filter(F.col("id") % 100 == 55).withColumns({"is_new": F.lit(True), "approval_stage": F.lit("REVIEWED")})
    table = sinks.InvoiceTable(spark, session.scratch_dir(spark, "upsert"))
    table.create(current, buckets=16)
    _, refused = table.upsert(changes.unionByName(unknown).unionByName(taken))
    both = table.read().withColumn("part", F.lit("TABLE")).unionByName(refused.withColumn("part", F.lit("REFUSED")))
    return both.withColumn("total_amount", F.col("total_amount").cast("double"))


@query(
    "append_log",
    with_tables(
        """SELECT *, strftime(edited_at, '%Y-%m-01') AS log_date, 'totals' AS run FROM edits
UNION ALL SELECT invoice_id, 'Date', old_value, new_value, edited_at, strftime(edited_at, '%Y-%m-01'), 'dates' FROM edits WHERE invoice_id % 2 = 0"""
    ),
)
def _append(spark: SparkSession, sf: str) -> DataFrame:
    edits = derived.edits(derived.invoices(spark, sf))
    path = session.scratch_dir(spark, "edit-log")
    dates = edits.filter("invoice_id % 2 = 0").withColumn("field_name", F.lit("Date"))
    for rows, run in ((edits, "totals"), (dates, "dates"), (edits, "totals")):  # the last repeats a run
        sinks.append_log(rows, path, "edited_at", run, "month")
    return spark.read.parquet(path).withColumn("log_date", F.col("log_date").cast("string"))


@query(
    "write_csv_report",
    with_tables("SELECT id, vendor_name, CAST(total_amount AS double) AS total_amount, created_at FROM inv WHERE approval_stage = 'APPROVED'"),
)
def _csv(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.approved_report(derived.invoices(spark, sf)).select("id", "vendor_name", "total_amount", "created_at")
    path = session.scratch_dir(spark, "csv")
    sinks.write_csv_report(rows, path)
    schema = "id long, vendor_name string, total_amount double, created_at timestamp_ntz"
    return spark.read.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").schema(schema).csv(path)


@query(
    "export_transparency",
    with_tables(
        """SELECT 'summary' AS name, 5 + (SELECT count(DISTINCT approval_stage) FROM inv) + (SELECT count(DISTINCT source) FROM sources) AS n, 2 AS columns, 'generated_at' AS first, 'total_vendors' AS last
UNION ALL SELECT 'invoices_full', count(*), 31, CAST(min(id) AS varchar), CAST(max(id) AS varchar) FROM inv
UNION ALL SELECT 'workflow_view', count(*), 14, CAST(min(id) AS varchar), CAST(max(id) AS varchar) FROM inv
UNION ALL SELECT 'line_items', count(*), 8, CAST(min(id) AS varchar), CAST(max(id) AS varchar) FROM inv JOIN lines ON invoice_id = src_key WHERE src_key % 53 <> 0
UNION ALL SELECT 'invoice_edits', count(*), 5, CAST(min(invoice_id) AS varchar), CAST(max(invoice_id) AS varchar) FROM edits
UNION ALL SELECT 'invoice_audits', count(*), 4, CAST(min(invoice_id) AS varchar), CAST(max(invoice_id) AS varchar) FROM audits
UNION ALL SELECT 'vendors', count(*), 4, min(vendor_name), max(vendor_name) FROM vend
UNION ALL SELECT 'ai_flattened', count(*), 19, CAST(min(id) AS varchar), CAST(max(id) AS varchar) FROM inv"""
    ),
)
def _export(spark: SparkSession, sf: str) -> DataFrame:
    path = session.scratch_dir(spark, "export")
    with session.noted() as made:
        tables = transparency(spark, sf)
    folders = sinks.export_transparency({"ai_flattened": tables.pop("ai_flattened")}, path)
    session.drop(spark, [p for p in made if "payload-level" in p])  # only the flattened payloads read these
    folders |= sinks.export_transparency(tables, path)
    out = None
    for name, folder in folders.items():
        table = spark.read.parquet(folder)
        key = F.col({"summary": "metric", "invoices_full": "id", "vendors": "vendor_name"}.get(name, "invoice_id"))
        rows = table.agg(
            F.count(F.lit(1)).alias("n"), F.lit(len(table.columns)).cast("int").alias("columns"),
            F.min(key).cast("string").alias("first"), F.max(key).cast("string").alias("last"),
        ).select(F.lit(name).alias("name"), "n", "columns", "first", "last")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "crm_outbox",
    with_tables(
        """SELECT CAST(id AS varchar) AS id, 'UPSERT' AS event, 'INVOICE_CONTROL' AS source, vendor_name, invoice_date, CAST(total_amount AS double) AS total_amount, currency,
  status, processing_status, confidence_score, flag_reason, document_hash, created_by, CAST(risk_score AS varchar) AS risk_score,
  risk_level, approval_stage, reviewed_by, approved_by, ai_version FROM ledger"""
    ),
)
def _outbox(spark: SparkSession, sf: str) -> DataFrame:
    path = session.scratch_dir(spark, "outbox")
    sinks.write_outbox(workflow.invoice_record(ledger(spark, sf, whole=True), "AP_CLERK"), path)
    text = F.col("value")
    get = lambda p, n: F.get_json_object(text, f"$.{p}").alias(n)
    fields = (
        "id", "vendor_name", "invoice_date", "total_amount", "currency", "status", "processing_status", "confidence_score", "flag_reason",
        "document_hash", "created_by", "risk_score", "risk_level", "approval_stage", "reviewed_by", "approved_by", "ai_version",
    )
    rows = spark.read.text(path).select(get("event", "event"), get("source", "source"), *[get(f"invoice.{f}", f) for f in fields])
    return rows.withColumns({c: F.col(c).cast("double") for c in ("total_amount", "confidence_score")})

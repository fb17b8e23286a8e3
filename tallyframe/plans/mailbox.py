"""Queries for mail intake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.config import MailRules
from tallyframe.functions.columns import MONEY
from tallyframe.operators import extraction, mail, validation
from tallyframe.plans.fixture_sql import with_tables
from tallyframe.plans.registry import query
from tallyframe.plans.tables import as_of
from tallyframe.sources import derived

RULES = MailRules(senders=tuple(f"SRC{i}@vendor.example" for i in range(16)), keywords=("Invoice",))
SMALL_BYTES = 2000  # the limit of the filter_size query alone, which must refuse some attachments
_SENDERS = ", ".join(f"'src{i}@vendor.example'" for i in range(16))
_TYPES = "(mime_type IN ('application/pdf', 'image/png', 'image/jpeg', 'image/jpg') OR regexp_matches(lower(filename), '\\.(pdf|png|jpg|jpeg)$'))"

_CTES = {
    "checked": f"""
SELECT *, sender IN ({_SENDERS}) AS sender_ok, contains(lower(subject), 'invoice') AS subject_ok, {_TYPES} AS type_ok,
  strlen(content) AS size_bytes, sha256(content) AS document_hash FROM msg_parts""",
    "kept": f"SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY part_no) - 1 AS idx FROM checked WHERE sender_ok AND subject_ok AND type_ok AND size_bytes > 0 AND size_bytes <= {RULES.max_bytes}",
    "firsts": "SELECT text, min(doc_id) AS n FROM documents GROUP BY text",
    "fields": """
SELECT text, n, n % 53 = 0 AS bad, concat('Vendor ', CAST(n % 8 AS varchar)) AS vendor_name,
  CASE WHEN n % 23 = 0 THEN 'unknown' ELSE concat('2024-01-', CAST(10 + n % 5 AS varchar)) END AS invoice_date, 100 + n % 40 AS total_amount,
  concat_ws('; ', CASE WHEN n % 23 = 0 THEN 'Invalid invoice date format (expected YYYY-MM-DD)' END,
    CASE WHEN n % 10 = 0 THEN 'Unsupported currency: BRL' END, CASE WHEN n % 6 = 0 THEN 'Line 1: Missing description' END,
    CASE WHEN n % 9 = 0 THEN 'Line-item total mismatch against invoice total' END) AS all_issues,
  (CASE WHEN n % 23 = 0 THEN 1 ELSE 0 END) + (CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END) + (CASE WHEN n % 6 = 0 THEN 1 ELSE 0 END) + (CASE WHEN n % 9 = 0 THEN 1 ELSE 0 END) AS issue_count
FROM firsts""",
    "stored": """
SELECT sha256(text) AS document_hash, 'Vendor 1' AS vendor_name, '2024-01-11' AS invoice_date, 100 + doc_id % 40 AS total_amount
FROM documents WHERE doc_id % 31 = 0""",
    "joined": """
SELECT kept.*, n, bad, vendor_name, invoice_date, total_amount, all_issues, issue_count,
  document_hash IN (SELECT document_hash FROM stored) AS known_hash,
  (vendor_name, invoice_date, total_amount) IN (SELECT (vendor_name, invoice_date, total_amount) FROM stored) AS known_key
FROM kept JOIN fields ON text = content""",
    "places": """
SELECT *, min(place) FILTER (NOT known_hash AND NOT bad) OVER (PARTITION BY content) AS hp,
  min(place) FILTER (NOT known_hash AND NOT bad) OVER (PARTITION BY vendor_name, invoice_date, total_amount) AS kp
FROM (SELECT *, message_id * 8 + idx AS place FROM joined) j""",
    "outcomes": """
SELECT *, CASE WHEN known_hash THEN 'DUPLICATE_HASH' WHEN bad THEN 'FAILED_EXTRACTION'
  WHEN hp < place AND NOT known_key AND hp = kp THEN 'DUPLICATE_HASH'
  WHEN known_key OR kp < place THEN 'DUPLICATE_KEY' ELSE 'INGESTED' END AS outcome FROM places""",
    "summary": f"""
SELECT (SELECT count(*) FROM checked WHERE part_no = 0) AS messages_scanned, (SELECT count(*) FROM kept) AS attachments_found,
  (SELECT count(*) FROM kept WHERE idx = 0) AS messages_with_attachments,
  (SELECT count(*) FROM outcomes WHERE outcome = 'INGESTED') AS ingested,
  (SELECT count(*) FROM outcomes WHERE outcome LIKE 'DUPLICATE%') AS duplicates,
  (SELECT count(*) FROM outcomes WHERE outcome LIKE 'FAILED%') AS failed,
  (SELECT count(*) FROM checked WHERE part_no = 0 AND NOT sender_ok) AS skipped_sender,
  (SELECT count(*) FROM checked WHERE part_no = 0 AND sender_ok AND NOT subject_ok) AS skipped_subject,
  (SELECT count(*) FROM checked WHERE sender_ok AND subject_ok AND NOT type_ok) AS skipped_by_type,
  (SELECT count(*) FROM checked WHERE sender_ok AND subject_ok AND type_ok AND size_bytes > {RULES.max_bytes}) AS skipped_by_size,
  (SELECT count(*) FROM outcomes WHERE outcome LIKE 'FAILED%') AS errors""",
}


def _sql(sql: str) -> str:
    return with_tables(sql, **_CTES)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return derived.table(spark, sf, "documents")


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return mail.parse_messages(derived.raw_messages(_docs(spark, sf)))


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    """Flat message rows, for filters that need no parsing."""
    return derived.flat_messages(_docs(spark, sf)).withColumn("content", F.col("content").cast("binary"))


def _screened(spark: SparkSession, sf: str) -> DataFrame:
    return mail.screen(_parsed(spark, sf), RULES, as_of())


def results(docs: DataFrame) -> DataFrame:
    """Extraction results per content: business key, lines, issues."""
    read = extraction.typed_header(extraction.extract(derived.mail_payloads(docs)))
    checked = validation.compliance_issues(read)
    return checked.select(
        "content_key", "document_hash", "parse_status", "vendor_name", "invoice_date", F.col("amount").alias("total_amount"),
        "currency", "confidence_score", "line_items", "issues",
    )


def stored(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id % 31 = 0").select(
        F.sha2(F.col("text").cast("binary"), 256).alias("document_hash"),
        F.lit("Vendor 1").alias("vendor_name"),
        F.lit("2024-01-11").alias("invoice_date"),
        (F.lit(100) + F.col("doc_id") % 40).cast(MONEY).alias("total_amount"),
    )


def _outcomes(spark: SparkSession, sf: str, screened: DataFrame | None = None) -> DataFrame:
    docs = _docs(spark, sf)
    kept = (screened or _screened(spark, sf)).filter("kept")
    # Extraction results are a stored table in use; writing them keeps JSON parsing out of the joins.
    return mail.ingest_outcome(kept, session.stored(results(docs), "results"), stored(docs))


@query("newest_messages", _sql("SELECT message_id, sender, subject FROM msg_parts WHERE message_id IN (SELECT message_id FROM msgs ORDER BY message_id DESC LIMIT 100)"))
def _newest(spark: SparkSession, sf: str) -> DataFrame:
    newest = mail.newest_messages(derived.raw_messages(_docs(spark, sf)), 100)
    return mail.parse_messages(newest).select("message_id", "sender", "subject")


@query("filter_sender", _sql(f"SELECT message_id, sender FROM msgs WHERE sender IN ({_SENDERS})"))
def _sender(spark: SparkSession, sf: str) -> DataFrame:
    return mail.filter_sender(_flat(spark, sf), RULES.senders).select("message_id", "sender")


@query("filter_subject", _sql("SELECT message_id, subject FROM checked WHERE part_no = 0 AND sender_ok AND subject_ok"))
def _subject(spark: SparkSession, sf: str) -> DataFrame:
    senders = mail.filter_sender(_flat(spark, sf), RULES.senders)
    return mail.filter_subject(senders, RULES.keywords).select("message_id", "subject")


@query("decode_headers", _sql("SELECT message_id, sender, subject FROM msg_parts"))
def _decode(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).select("message_id", "sender", "subject")


@query(
    "explode_attachments",
    _sql("SELECT message_id, part_no, filename, mime_type, sha256(content) AS document_hash, strlen(content) AS size_bytes FROM msg_parts"),
)
def _attachments(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).select(
        "message_id", "part_no", "filename", "mime_type",
        F.sha2("content", 256).alias("document_hash"), F.length("content").cast("long").alias("size_bytes"),
    )


@query("filter_type", _sql("SELECT message_id, filename, mime_type FROM checked WHERE part_no = 0 AND type_ok"))
def _type(spark: SparkSession, sf: str) -> DataFrame:
    return mail.filter_type(_flat(spark, sf)).select("message_id", "filename", "mime_type")


@query("filter_size", _sql(f"SELECT message_id, size_bytes FROM checked WHERE part_no = 0 AND size_bytes <= {SMALL_BYTES}"))
def _size(spark: SparkSession, sf: str) -> DataFrame:
    rows = mail.filter_size(_flat(spark, sf), SMALL_BYTES)
    return rows.select("message_id", F.length("content").cast("long").alias("size_bytes"))


@query(
    "safe_filename",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'invoice_20010805_000000.bin'
  ELSE left(regexp_replace(concat(source, ' é#/', text), '[^\\p{L}\\p{N}._-]', '_', 'g'), 150) END AS safe_name FROM documents""",
)
def _safe(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("source", F.lit(" é#/"), "text")
    given = F.when(F.col("doc_id") % 10 == 0, "").otherwise(name)
    return _docs(spark, sf).select("doc_id", mail.safe_filename(given, as_of()).alias("safe_name"))


@query(
    "storage_path",
    _sql("SELECT message_id, concat('mail/20010805/msg_', CAST(message_id AS varchar), '_', CAST(idx AS varchar), '_', filename) AS storage_path FROM kept"),
)
def _path(spark: SparkSession, sf: str) -> DataFrame:
    return _screened(spark, sf).filter("kept").select("message_id", "storage_path")


@query(
    "ingest_risk",
    _sql(
        """SELECT md5(text) AS content_key, CAST(CASE WHEN issue_count = 0 THEN 0 ELSE 30 END AS bigint) AS risk_score,
  CASE WHEN issue_count = 0 THEN 'LOW' ELSE 'MEDIUM' END AS risk_level, CASE WHEN issue_count = 0 THEN 'Pending Review' ELSE 'Flagged' END AS status,
  CASE WHEN issue_count = 0 THEN 'Auto-ingested from email'
    ELSE concat('Compliance: ', array_to_string(string_split(all_issues, '; ')[1:3], '; ')) END AS flag_reason FROM fields WHERE NOT bad"""
    ),
)
def _risk(spark: SparkSession, sf: str) -> DataFrame:
    ok = results(_docs(spark, sf)).filter("parse_status = 'OK'")
    return mail.ingest_risk(ok).select(
        "content_key", F.col("risk_score").cast("long").alias("risk_score"), "risk_level", "status", "flag_reason"
    )


@query("ingest_outcome", _sql("SELECT message_id, idx, outcome FROM outcomes"))
def _outcome(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).select("message_id", "idx", "outcome")


@query("ingest_summary", _sql("SELECT * FROM summary"))
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    screened = session.stored(_screened(spark, sf), "screened")  # two readers, one parse
    return mail.ingest_summary(screened, _outcomes(spark, sf, screened))


@query(
    "ingest_status",
    _sql(
        """SELECT ingested, failed, errors, CASE WHEN errors > 0 AND ingested = 0 THEN 'FAILED'
  WHEN errors > 0 OR failed > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM summary"""
    ),
)
def _status(spark: SparkSession, sf: str) -> DataFrame:
    screened = session.stored(_screened(spark, sf), "screened")
    summary = mail.ingest_summary(screened, _outcomes(spark, sf, screened))
    return mail.ingest_status(summary).select("ingested", "failed", "errors", "status")

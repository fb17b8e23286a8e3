"""Queries for the stream jobs. Each runs its stream to the end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.operators.dedup import document_hash
from tallyframe.plans import mailbox
from tallyframe.plans.fixture_sql import with_tables
from tallyframe.plans.registry import query
from tallyframe.plans.tables import as_of
from tallyframe.plans.workflow import REPLAY_SQL
from tallyframe.sources import derived
from tallyframe.streaming import jobs


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # The pattern also matches a table that is a folder of parts.
    return jobs.table_stream(spark, f"{sf}/{name}.parque[t]")


def _folders(spark: SparkSession, label: str) -> tuple[str, str]:
    root = session.scratch_dir(spark, label)
    return f"{root}/out", f"{root}/checkpoint"


@query(
    "stream_intake",
    with_tables("SELECT message_id, filename, document_hash, size_bytes FROM kept", **mailbox._CTES),
)
def _intake(spark: SparkSession, sf: str) -> DataFrame:
    out, checkpoint = _folders(spark, "intake")
    messages = derived.raw_messages(_stream(spark, sf, "documents"))
    jobs.stream_intake(messages, mailbox.RULES, as_of(), out, checkpoint)
    rows = jobs.batches(spark, f"{out}/attachments").filter("kept")
    return rows.select("message_id", "filename", "document_hash", "size_bytes")


@query("stream_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS document_hash FROM documents WHERE strlen(text) > 0 GROUP BY text")
def _dedup(spark: SparkSession, sf: str) -> DataFrame:
    out, checkpoint = _folders(spark, "dedup")
    docs = _stream(spark, sf, "documents").select("doc_id", document_hash(F.col("text").cast("binary")).alias("document_hash"))
    jobs.stream_dedup(docs.filter("document_hash IS NOT NULL"), ["doc_id"], out, checkpoint)
    return jobs.batches(spark, f"{out}/first").select("doc_id", "document_hash")


@query("stream_guard", REPLAY_SQL)
def _guard(spark: SparkSession, sf: str) -> DataFrame:
    out, checkpoint = _folders(spark, "guard")
    jobs.stream_guard(derived.request_columns(_stream(spark, sf, "events")), out, checkpoint)
    return jobs.batches(spark, f"{out}/verdicts").select("event_id", "invoice_id", "previous_stage", "accepted")


@query(
    "stream_vendor_profile",
    with_tables("SELECT vendor_name, avg_invoice_value, invoice_count, last_invoice_date FROM vend"),
)
def _profile(spark: SparkSession, sf: str) -> DataFrame:
    out, checkpoint = _folders(spark, "profile")
    source = session.store(derived.approvals(derived.invoices(spark, sf)), "approvals")
    jobs.stream_vendor_profile(jobs.table_stream(spark, source, files_per_batch=4), out, checkpoint)
    return jobs.current(spark, jobs.profiles(out))


@query(
    "stream_confidence_trend",
    with_tables(
        """SELECT strftime(CAST(created_at AS date), '%Y-%m-%d') AS day, round(avg(confidence_score), 6) AS avg_confidence
FROM inv GROUP BY CAST(created_at AS date)"""
    ),
)
def _trend(spark: SparkSession, sf: str) -> DataFrame:
    out, checkpoint = _folders(spark, "trend")
    source = session.store(derived.invoice_status(spark, sf).select("created_at", "confidence_score"), "invoices")
    jobs.stream_confidence_trend(jobs.table_stream(spark, source), out, checkpoint)
    return jobs.current(spark, jobs.days(out)).select(F.col("day").cast("string").alias("day"), F.round("avg_confidence", 6).alias("avg_confidence"))

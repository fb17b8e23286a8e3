"""Input tables of the registered queries, built from the supplied ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.operators.risk import score_invoices
from tallyframe.operators.vendors import vendor_profile
from tallyframe.sources import derived

AS_OF = "TIMESTAMP_NTZ '2001-08-05 00:00:00'"


def as_of() -> Column:
    return F.expr(AS_OF)


def number(column: str) -> Column:
    """Amounts leave the registered queries as doubles: both engines print those alike."""
    return F.col(column).cast("double").alias(column)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices, worked out and written once for the steps of a run that read them several times."""
    return session.stored(derived.invoices(spark, sf_dir), "invoices")


def scored(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Scored invoices; ``whole`` for a query that reads all of their columns (see ``score_invoices``)."""
    if not whole:
        inv, row = base(spark, sf_dir), None
    else:
        inv, row = session.stored(derived.invoices(spark, sf_dir).withColumn("_row", F.monotonically_increasing_id()), "invoices"), "_row"
    profile = vendor_profile(derived.approvals(inv))
    return score_invoices(inv, derived.line_amounts(spark, sf_dir), profile, "src_key", row=row)


def ledger(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Invoices with every stored column that the queues and reports read."""
    return with_workflow_columns(scored(spark, sf_dir, whole))


def with_workflow_columns(inv: DataFrame) -> DataFrame:
    stage = F.col("approval_stage")
    return inv.withColumns(
        {
            "reviewed_by": F.when(stage == "REVIEWED", "AP_CLERK").when(stage != "UPLOADED", "FINANCE_MANAGER"),
            "approved_by": F.when(stage.isin("APPROVED", "AUDITED"), "FINANCE_MANAGER"),
            "audited": F.when(stage == "AUDITED", True).when(F.col("src_key") % 7 != 0, False),
            "ai_version": F.lit("v1"),
            "reprocessed_at": F.when(F.col("src_key") % 97 == 0, F.col("created_at") + F.expr("INTERVAL '20' DAY")),
            "file_url": F.concat(F.lit("store/"), "document_key", F.lit(".pdf")),
        }
    )

"""Stream forms of intake, duplicate removal, stage guard, vendor history and confidence trend.

Each job reads a stream, works per micro-batch with the batch operators, and writes
folders named by batch id with overwrite: a batch that is run again after a failure
replaces its own output, so results count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import schemas
from tallyframe.functions.columns import finite_or_null
from tallyframe.config import MailRules
from tallyframe.operators.dedup import keep_first
from tallyframe.operators.mail import parse_messages, screen
from tallyframe.operators.workflow import latest_stage, replay_requests
from tallyframe.sources import files
from tallyframe.streaming.levels import Levels, newest_of


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the parquet files at ``path`` (folder, file pattern or table)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(
    stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append"
) -> None:
    """Process everything that has arrived and stop; a later call goes on from the checkpoint."""
    query = (
        stream.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def _earlier(spark: SparkSession, folder: str, schema: T.StructType, batch_id: int) -> DataFrame | None:
    """What earlier batches wrote; None before the first one."""
    if batch_id == 0:
        return None
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(whole).parquet(folder).filter(F.col("batch_id") < batch_id)


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """All output of a job with its batch_id."""
    return spark.read.parquet(folder)


def latest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key the values of the last batch that updated it."""
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*columns), F.col("batch_id")).alias("row"))
        .select(key, *[F.col("row")[c].alias(c) for c in columns])
    )


def stream_intake(messages: DataFrame, rules: MailRules, as_of: Column, out: str, checkpoint: str) -> None:
    """Unseen messages to screened attachment rows; the checkpoint is the seen mark."""

    def each(batch: DataFrame, batch_id: int) -> None:
        _write_batch(screen(parse_messages(batch), rules, as_of), f"{out}/attachments", batch_id)

    run_available(messages, checkpoint, each)


PREFIX = 2  # characters of a hash: 256 folders in each part of the history


def known_hashes(out: str, prefix: int = PREFIX) -> Levels:
    """The history of ``stream_dedup``: all hashes, in folders by their first characters."""
    schema = T.StructType([T.StructField("document_hash", T.StringType()), T.StructField("prefix", T.StringType())])

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("document_hash", "prefix").agg(F.min("batch_id").alias("batch_id")).select("document_hash", "prefix", "batch_id")

    return Levels(f"{out}/known", schema, merge, split_by="prefix")


def stream_dedup(documents: DataFrame, order: list[str], out: str, checkpoint: str, prefix: int = PREFIX) -> None:
    """First arrival per document_hash over all time.

    Copies inside a micro-batch go by a grouped minimum, which combines before the
    shuffle; copies of earlier batches by anti-join to the hashes stored. These lie in
    folders by their first ``prefix`` characters, merged in levels: a batch opens only
    folders of characters its own hashes begin with, of at most a few parts a level. No
    watermark is needed, so a copy that comes much later is still recognised.
    """
    names = documents.schema.names
    history = known_hashes(out, prefix)
    begin = F.substring("document_hash", 1, prefix)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = keep_first(batch, ["document_hash"], F.struct(*order))
        if batch_id > 0:
            # at most 16^prefix values, whatever the batch holds
            begins = [r["p"] for r in batch.select(begin.alias("p")).where("p IS NOT NULL").distinct().collect()]
            stored = history.read(spark, batch_id, F.col("prefix").isin(begins))
            first = first.join(stored.select("document_hash"), "document_hash", "left_anti")
        _write_batch(first.select(*names), f"{out}/first", batch_id)
        new = spark.read.schema(documents.schema).parquet(f"{out}/first/batch_id={batch_id}").filter("document_hash IS NOT NULL")
        history.add(new.select("document_hash", begin.alias("prefix")), batch_id)

    run_available(documents, checkpoint, each)


# A full snapshot of the stages is written after every so many batches, so that a batch
# reads one snapshot and the changes since then, however long the job has been running.
SNAPSHOT_EVERY = 50
_STAGES = T.StructType([T.StructField("invoice_id", T.LongType()), T.StructField("approval_stage", T.StringType())])


def _known_stages(spark: SparkSession, out: str, snapshot: int, before: int) -> DataFrame | None:
    """(invoice_id, approval_stage, batch_id): the snapshot of that batch and changes up to ``before``."""
    changes = _earlier(spark, f"{out}/stages", _STAGES, before)
    if changes is None or snapshot < 0:
        return changes
    base = spark.read.schema(_STAGES).parquet(f"{out}/snapshots/batch_id={snapshot}")
    return base.withColumn("batch_id", F.lit(snapshot).cast("long")).unionByName(
        changes.filter(F.col("batch_id") > snapshot)
    )


def stream_guard(requests: DataFrame, out: str, checkpoint: str, snapshot_every: int = SNAPSHOT_EVERY) -> None:
    """Replays requests against the stages that earlier batches left behind.

    Uses the same staged minima as the batch replay, so an invoice with very many
    requests in one batch is not gathered into one state task. Only stages that changed
    are written; the current one is the last written per invoice.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = None
        snapshot = batch_id // snapshot_every * snapshot_every - 1
        written = _known_stages(spark, out, snapshot, batch_id)
        if written is not None:
            touched = written.join(batch.select("invoice_id"), "invoice_id", "left_semi")
            current = latest(touched, "invoice_id", ["approval_stage"])
        _write_batch(replay_requests(batch, current), f"{out}/verdicts", batch_id)
        verdicts = spark.read.parquet(f"{out}/verdicts/batch_id={batch_id}")
        _write_batch(latest_stage(verdicts), f"{out}/stages", batch_id)
        if (batch_id + 1) % snapshot_every == 0:
            known = _known_stages(spark, out, snapshot, batch_id + 1)
            _write_batch(latest(known, "invoice_id", ["approval_stage"]), f"{out}/snapshots", batch_id)

    run_available(requests, checkpoint, each)


_DAY = T.StructType([T.StructField("day", T.DateType()), T.StructField("avg_confidence", T.DoubleType())])


def profiles(out: str) -> Levels:
    return Levels(f"{out}/profiles", schemas.VENDORS, newest_of("vendor_name"))


def days(out: str) -> Levels:
    return Levels(f"{out}/days", _DAY, newest_of("day"))


def current(spark: SparkSession, levels: Levels) -> DataFrame:
    """What a job has written so far, the last state of each key, from a few folders."""
    written = files.names(spark, f"{levels.folder}/level=0")
    done = [int(n.removeprefix("part=")) for n in written if files.exists(spark, f"{levels.folder}/level=0/{n}/_SUCCESS")]
    return levels.read(spark, max(done) + 1 if done else 0).drop("batch_id")


def stream_vendor_profile(approvals: DataFrame, out: str, checkpoint: str) -> None:
    """Running vendor profile; each batch writes the vendors it changed, merged in levels (see ``profiles``, ``current``)."""
    totals = (
        approvals.filter(F.col("vendor_name").isNotNull())
        .groupBy("vendor_name")
        .agg(
            F.sum("total_amount").cast("double").alias("value_sum"),
            F.count(F.lit(1)).alias("invoice_count"),
            F.max_by("invoice_date", F.struct("approved_at", "id")).alias("last_invoice_date"),
        )
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        average = (F.col("value_sum") / F.col("invoice_count")).alias("avg_invoice_value")
        profiles(out).add(batch.select("vendor_name", average, "invoice_count", "last_invoice_date"), batch_id)

    run_available(totals, checkpoint, each, mode="update")


def stream_confidence_trend(invoices: DataFrame, out: str, checkpoint: str, lateness: str = "7 days") -> None:
    """Mean confidence per day; rows later than ``lateness`` behind the newest are dropped.

    Each batch writes the days it changed, merged in levels (see ``days``, ``current``).
    """
    daily = (
        invoices.withColumn("created_at", F.col("created_at").cast("timestamp"))
        .withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 day"))
        .agg(F.avg(finite_or_null(F.col("confidence_score"))).alias("avg_confidence"))
        .select(F.to_date("window.start").alias("day"), "avg_confidence")
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        days(out).add(batch, batch_id)

    run_available(daily, checkpoint, each, mode="update")

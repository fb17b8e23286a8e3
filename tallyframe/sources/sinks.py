"""Writing: the invoice table in versions and buckets, append-only logs, reports, full export, event outbox."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from tallyframe import schemas
from tallyframe.sources import files

EVENT_SOURCE = "INVOICE_CONTROL"


def upsert_invoices(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new table, refused changes).

    ``changes`` has the columns of ``current`` plus ``is_new`` and at most one row per id.
    New rows are added, others replace the row with their id. A change to an unknown id
    and a new row with a known one are refused and returned, with nothing else altered.
    """
    columns = current.columns
    incoming = changes.select("id", "is_new", F.struct(*columns).alias("_new"))
    merged = current.select("id", F.struct(*columns).alias("_old")).join(incoming, "id", "full_outer")
    known = F.col("_old").isNotNull()
    taken = F.col("_new").isNotNull() & (F.col("is_new") != known)
    row = F.when(taken, F.col("_new")).otherwise(F.col("_old"))
    result = merged.select(row.alias("row")).filter(F.col("row").isNotNull()).select("row.*")
    refused = merged.filter(F.col("_new").isNotNull() & (F.col("is_new") == known)).select("_new.*")
    return result, refused


class VersionTaken(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class InvoiceTable:
    """A table of rows with a unique ``id``, in buckets by a hash of the id, kept in versions.

    A version is a manifest: which folder holds each bucket. An upsert reads and rewrites
    only the buckets its changes fall into (copy on write) and then creates the manifest of
    the next version, which the store grants to one writer only; the other gets
    ``VersionTaken`` and nothing of it is seen. Readers see whole versions, old ones too.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.root}/versions") if n.endswith(".json")]

    def _manifest(self, version: int) -> dict:
        return json.loads(files.read(self.spark, f"{self.root}/versions/{version:012d}.json"))

    def _bucket(self, count: int):
        return F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")

    def _write(self, df: DataFrame, count: int) -> dict[str, str]:
        """Bucket -> folder of what ``df`` holds."""
        folder = f"data/{uuid.uuid4().hex}"
        df.withColumn("_bucket", self._bucket(count)).repartition(count, "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        found = [n for n in files.names(self.spark, f"{self.root}/{folder}") if n.startswith("_bucket=")]
        return {n.removeprefix("_bucket="): f"{folder}/{n}" for n in found}

    def _commit(self, version: int, manifest: dict) -> int:
        if not files.create(self.spark, f"{self.root}/versions/{version:012d}.json", json.dumps(manifest)):
            raise VersionTaken(f"version {version} of {self.root} exists")
        return version

    def create(self, df: DataFrame, buckets: int = 64) -> int:
        """Write the first version."""
        manifest = {"buckets": buckets, "schema": df.schema.json(), "folders": self._write(df, buckets)}
        return self._commit(1, manifest)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A version (the newest), or some buckets of it."""
        manifest = self._manifest(version or self.versions()[-1])
        return self._read(manifest, buckets)

    def _read(self, manifest: dict, buckets: list[int] | None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        wanted = manifest["folders"] if buckets is None else {str(b): manifest["folders"].get(str(b)) for b in buckets}
        paths = [f"{self.root}/{f}" for f in wanted.values() if f]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, changes: DataFrame, base: int | None = None) -> tuple[int, DataFrame]:
        """(version made, refused changes). ``base`` is the version that the changes were made for (the newest)."""
        base = base or self.versions()[-1]
        manifest = self._manifest(base)
        count = manifest["buckets"]
        # at most one row per bucket comes to the driver
        touched = sorted(r["b"] for r in changes.select(self._bucket(count).alias("b")).distinct().collect())
        result, refused = upsert_invoices(self._read(manifest, touched), changes)
        written = self._write(result, count)
        after = manifest | {"folders": manifest["folders"] | written}
        version = self._commit(base + 1, after)
        # what was refused is told from the version it was refused against
        return version, refused


def append_log(rows: DataFrame, path: str, time_column: str, run: str, grain: str = "day") -> None:
    """Append the log rows of one run, in folders by day (or month) and run.

    A run that is repeated replaces its own folders, so its rows are there once; readers of
    a period skip all other days. The rebalance hint gathers each folder into few files but
    splits one that is large.
    """
    dated = rows.withColumns({"log_date": F.to_date(F.date_trunc(grain, time_column)), "run": F.lit(run)})
    writer = dated.hint("rebalance", "log_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("log_date", "run").parquet(path)


def write_csv_report(rows: DataFrame, path: str) -> None:
    """CSV parts with a header each; the result is not squeezed into one file."""
    rows.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def export_transparency(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """One folder per table; returns name -> folder."""
    folders = {}
    for name, df in tables.items():
        folders[name] = f"{path}/{name}"
        writer = df.write.option("header", True) if fmt == "csv" else df.write
        if fmt == "parquet":
            writer = writer.option("compression", "zstd")
        writer.format(fmt).save(folders[name])
    return folders


OUTBOX_ROWS = 500_000  # in a file: compressed files are not split when they are read


def write_outbox(invoices: DataFrame, path: str, event: str = "UPSERT", source: str = EVENT_SOURCE) -> None:
    """The messages of ``crm_outbox`` as compressed text files; key names make up most of a message."""
    messages = crm_outbox(invoices, event, source)
    messages.write.option("compression", "gzip").option("maxRecordsPerFile", OUTBOX_ROWS).text(path)


def crm_outbox(invoices: DataFrame, event: str = "UPSERT", source: str = EVENT_SOURCE) -> DataFrame:
    """One JSON text per invoice: {event, source, invoice}."""
    envelope = F.struct(F.lit(event).alias("event"), F.lit(source).alias("source"), F.struct(*invoices.columns).alias("invoice"))
    return invoices.select(F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"))


BUNDLE_BYTES = 4 * 1024 * 1024  # of file contents in a bundle


def write_text_files(rows: DataFrame, path: str) -> None:
    """A file for each name in (name, content): the text and a line break; rows of one name go into one file.

    The files lie in bundles, text files of about ``BUNDLE_BYTES`` with a line ``<name> <content>``
    for each, both in base64: no store has to keep, and no driver to list, a file and a folder
    for every row. ``stores`` scans them like files that lie alone.
    """
    texts = rows.select(F.coalesce("name", F.lit("")).alias("name"), F.concat(F.coalesce("content", F.lit("")), F.lit("\n")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = texts.repartition(total // BUNDLE_BYTES + 1, "name").groupBy("name").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    packed = lambda text: F.replace(F.base64(text.cast("binary")), F.lit("\r\n"), F.lit(""))  # noqa: E731  Spark breaks it into lines
    line = F.concat_ws(" ", packed(F.col("name")), packed(F.array_join("texts", "")))
    found.select(line.alias("value")).write.text(f"{path}/{uuid.uuid4().hex}.bundle")


def write_table(rows: DataFrame, folder: str, name: str, schema: StructType, day: str | None = None) -> None:
    """A stored table in its schema, in folders by month of the ``day`` column, so that readers of a period skip the rest."""
    rows = schemas.conform(rows, schema)
    if day is None:
        rows.write.parquet(f"{folder}/{name}")
        return
    months = rows.withColumn("month", F.date_format(day, "yyyy-MM"))
    months.hint("rebalance", "month").write.partitionBy("month").parquet(f"{folder}/{name}")

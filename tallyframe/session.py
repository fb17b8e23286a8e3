"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. UTC keeps zone-free timestamps equal on
# every machine. Hot join keys are split at run time; the "force" switch lets that
# happen even where an aggregate above the join then needs one more exchange.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    # Stored messages carry whole attachments: Arrow batches are bounded by bytes, not only by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    # Stream state may outgrow executor memory; this store keeps it on disk.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Shuffle files go when the action that made them ends, not when the driver's garbage happens to be
    # collected: a query that writes several tables holds those of one. A repeated action makes them anew.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "1000")  # plans show whole paths, however long the folder's name
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_made: dict[str, list[str]] = {}  # scratch folders by application
_notes: ContextVar[tuple[list[str], ...]] = ContextVar("notes", default=())


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Every executor must be able to read what another one wrote. Where no such folder is
    set, as in tests, it is the warehouse; on a cluster only if that is not a local folder.
    """
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        on_disk = "://" not in warehouse or warehouse.startswith("file:")
        if on_disk and not (conf.get("spark.master") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"{warehouse}/scratch"
    path = f"{shared.rstrip('/')}/tallyframe-{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    for notes in _notes.get():
        notes.append(path)
    return path


@contextmanager
def noted() -> Iterator[list[str]]:
    """Lists the scratch folders made inside, for ``drop``."""
    notes: list[str] = []
    token = _notes.set((*_notes.get(), notes))
    try:
        yield notes
    finally:
        _notes.reset(token)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch folders that no later step reads."""
    from tallyframe.sources import files

    made = _made.get(spark.sparkContext.applicationId, [])
    for path in paths:
        files.remove(spark, path)
        if path in made:
            made.remove(path)


def clear_scratch(spark: SparkSession) -> int:
    """Remove all scratch folders of this application; results that read them must have been used by then."""
    from tallyframe.sources import files

    made = _made.pop(spark.sparkContext.applicationId, [])
    for path in made:
        files.remove(spark, path)
    return len(made)


def store(df: DataFrame, label: str) -> str:
    """Write ``df`` as a table in the shared folder; returns its path."""
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``store`` and read back.

    For results that several later steps use: the work is done once, later filters are
    not pushed into (and repeated inside) costly parsing, and a lost executor does not
    bring the whole lineage back.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df, label))


def settled(build: Callable[[], DataFrame], label: str) -> DataFrame:
    """``stored(build(), label)``, after which the scratch folders that ``build`` made on the way are removed."""
    with noted() as used:
        rows = build()
    out = stored(rows, label)
    drop(out.sparkSession, used)
    return out

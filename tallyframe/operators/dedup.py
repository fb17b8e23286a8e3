"""Exact-copy and business-key duplicates.

All forms group first (combined on the map side) and join only the groups that
matter, so a hash or key shared by a third of the rows costs one count, not pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import all_of

BUSINESS_KEY = ["vendor_name", "invoice_date", "total_amount"]


def document_hash(content: Column) -> Column:
    """SHA-256 hex of the bytes; null for no bytes."""
    return F.when(F.length(content) > 0, F.sha2(content, 256))


def _flag_shared(invoices: DataFrame, keys: list[str], flag: str) -> DataFrame:
    known = all_of([F.col(k).isNotNull() for k in keys])
    shared = (
        invoices.filter(known)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select(*keys, F.lit(True).alias(flag))
    )
    return invoices.join(shared, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def duplicate_by_hash(invoices: DataFrame) -> DataFrame:
    """Adds ``duplicate_hash``: another invoice has the same document hash (null never matches)."""
    return _flag_shared(invoices, ["document_hash"], "duplicate_hash")


def duplicate_by_key(invoices: DataFrame) -> DataFrame:
    """Adds ``duplicate_key``: another invoice, in any stage, has the same vendor, date and total."""
    return _flag_shared(invoices, BUSINESS_KEY, "duplicate_key")


def first_wins(
    batch: DataFrame, stored: DataFrame, order: list[str], hash_col: str = "document_hash", key: list[str] | None = None
) -> DataFrame:
    """Rows of ``batch`` that are neither copies of an earlier row nor of a stored invoice.

    ``order`` gives the arrival order and must be unique in the batch. Copies by hash go
    first, then copies by business key among what is left. A null hash or a key with a
    null part never counts as a copy.
    """
    key = key or BUSINESS_KEY
    place = F.struct(*order)
    # Reduce to one row per hash (then per key) first: a hot one is small before any shuffle or join.
    # A stored hash or key drops its whole group, so the order of the two steps does not matter.
    by_hash = keep_first(batch, [hash_col], place)
    new_hashes = by_hash.join(stored.select(hash_col).filter(F.col(hash_col).isNotNull()), hash_col, "left_anti")
    by_key = keep_first(new_hashes, key, place)
    return by_key.join(stored.select(*key), key, "left_anti").select(*batch.columns)


def keep_first(df: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """Per key the row lowest in ``place`` (unique); rows with a null in the key all stay.

    A grouped minimum combines on the map side, so a hot key ends as one row per map
    task before it is shuffled; a row_number window would sort the whole group in one task.
    Rows with a null are groups of their own, so ``df`` is read once.
    """
    known = all_of([F.col(k).isNotNull() for k in keys])
    rest = [c for c in df.columns if c not in keys]
    first = (
        df.withColumn("_own", F.when(~known, place))
        .groupBy(*keys, "_own")
        .agg(F.min_by(F.struct(*rest), place).alias("row"))
        .select(*keys, *[F.col("row")[c].alias(c) for c in rest])
    )
    return first.select(*df.columns)

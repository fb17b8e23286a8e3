"""Ranks and running totals over all rows or within keys, at any size of a key.

Rows are dealt to range partitions by the order itself and sorted there, so a key that
holds a large share of all rows spreads over many tasks. A row's rank is its place in its
partition plus the rows in the partitions before: prefix offsets of one number a partition.
The dealt rows are written once and read back, as the bounds of range partitions come from
a sample and may differ when they are worked out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import stored

_PLACE_BITS = 33  # of monotonically_increasing_id: place in the partition; the bits above are the partition

Keep = Callable[[DataFrame], DataFrame]


def _dealt(df: DataFrame, order: list[str], keep: Keep) -> DataFrame:
    """``df`` with (_part, _at): partitions follow the order, places follow it within them."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = keep(rows.withColumn("_place", F.monotonically_increasing_id()))
    return rows.withColumns(
        {"_part": F.shiftright("_place", _PLACE_BITS), "_at": F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1)}
    ).drop("_place")


def rank_rows(df: DataFrame, order: list[str], name: str, keep: Keep | None = None) -> DataFrame:
    """Adds 0, 1, ... over all rows by ``order``; ``keep`` writes a table and reads it back."""
    rows = _dealt(df, order, keep or (lambda d: stored(d, "ranked")))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))  # one row a partition
    earlier = Window.partitionBy("_one").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(offsets, "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def _totals_before(rows: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Adds, to dealt rows, the sums over the rows before each in its key."""
    per_part = rows.groupBy("_part", key).agg(*[F.sum(c).alias(f"_sum{i}") for i, c in enumerate(sums.values())])
    # The partitions that a key reaches are few; of the keys of one, only the first can have rows before it.
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reached = per_part.withColumns({f"_base{i}": F.sum(f"_sum{i}").over(earlier) for i in range(len(sums))})
    bases = reached.where("_base0 IS NOT NULL").select(
        F.col("_part").alias("_base_part"), F.col(key).alias("_base_key"), *[f"_base{i}" for i in range(len(sums))]
    )
    within = Window.partitionBy("_part", key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_here{i}": F.sum(c).over(within) for i, c in enumerate(sums.values())})
    joined = local.join(bases, (F.col("_part") == F.col("_base_part")) & F.col(key).eqNullSafe(F.col("_base_key")), "left")
    zero = F.lit(0)
    return joined.withColumns({n: F.coalesce(f"_here{i}", zero) + F.coalesce(f"_base{i}", zero) for i, n in enumerate(sums)})


def totals_before(df: DataFrame, key: str, order: list[str], sums: dict[str, Column], keep: Keep | None = None) -> DataFrame:
    """Adds for each name in ``sums`` the sum of its column (never null) over the rows before, within ``key`` by ``order``."""
    rows = _dealt(df, [key, *order], keep or (lambda d: stored(d, "totals")))
    return _totals_before(rows, key, sums).select(*df.columns, *sums)


HOT_ROWS = 10_000  # of one key; up to here a key's rows are sorted in one task


def number_rows(df: DataFrame, key: str, order: list[str], name: str, keep: Keep | None = None) -> DataFrame:
    """Adds the row number 1, 2, ... within ``key`` by ``order``; rows with a null key are numbered as a key of their own.

    Keys are counted first. Rows of keys with more than ``HOT_ROWS`` are dealt to range
    partitions; all others meet by key, with one shuffle and no table in between.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = stored(counts.filter(F.col("_n") > HOT_ROWS).select(F.col(key).alias("_hot")), "hot-keys")
    whole = Window.partitionBy(key).orderBy(*order)
    number = lambda rows: rows.withColumn(name, F.row_number().over(whole).cast("long")).select(*df.columns, name)
    if hot.isEmpty():
        return number(df)
    of_hot = F.col(key).eqNullSafe(F.col("_hot"))
    rows = _dealt(df.join(hot, of_hot, "left_semi"), [key, *order], keep or (lambda d: stored(d, "numbered")))
    numbered = _totals_before(rows, key, {name: F.lit(1)})
    numbered = numbered.withColumn(name, (F.col(name) + 1).cast("long")).select(*df.columns, name)
    return number(df.join(hot, of_hot, "left_anti")).unionByName(numbered)

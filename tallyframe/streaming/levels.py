"""What stream batches wrote, merged in levels, so that a reader opens few folders however long a job has run.

Batch b is part b of level 0. Every ``fan`` parts of a level are merged into one part of
the next, when the last of them is written. After n batches the digits of n to base ``fan``
say which parts hold all of it: at most ``fan - 1`` of each level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN = 16

Merge = Callable[[DataFrame], DataFrame]


def newest_of(key: str) -> Merge:
    """Per key the row of the last batch (column ``batch_id``)."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_row"))
        return newest.select(key, *[F.col("_row")[c].alias(c) for c in rest]).select(*rows.columns)

    return merge


class Levels:
    """Parts below ``folder``; ``merge`` makes one part of several and must not mind being applied again."""

    def __init__(self, folder: str, schema: T.StructType, merge: Merge, fan: int = FAN, split_by: str | None = None) -> None:
        self.folder, self.merge, self.fan, self.split_by = folder, merge, fan, split_by
        self.schema = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])

    def _part(self, level: int, number: int) -> str:
        return f"{self.folder}/level={level}/part={number}"

    def _write(self, rows: DataFrame, level: int, number: int) -> None:
        writer = (rows.hint("rebalance", self.split_by) if self.split_by else rows).write.mode("overwrite")
        (writer.partitionBy(self.split_by) if self.split_by else writer).parquet(self._part(level, number))

    def parts(self, batches: int) -> list[str]:
        """Folders that together hold the first ``batches`` batches, oldest first."""
        out, level, left = [], 0, batches
        while left:
            out += [self._part(level, left - k) for k in range(1, left % self.fan + 1)]
            left, level = left // self.fan, level + 1
        return out[::-1]

    def _read(self, spark: SparkSession, parts: list[str]) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], self.schema)
        out = None
        for part in parts:
            rows = spark.read.schema(self.schema).parquet(part)
            out = rows if out is None else out.unionByName(rows)
        return out

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch and merge what is full; a repeated batch writes the same parts again."""
        spark = rows.sparkSession
        self._write(self.merge(rows.withColumn("batch_id", F.lit(batch_id).cast("long")).select(*self.schema.names)), 0, batch_id)
        level, count = 1, batch_id + 1
        while count % self.fan == 0:
            count //= self.fan
            full = [self._part(level - 1, k) for k in range((count - 1) * self.fan, count * self.fan)]
            self._write(self.merge(self._read(spark, full)), level, count - 1)
            level += 1

    def read(self, spark: SparkSession, batches: int, where: Column | None = None) -> DataFrame:
        """All rows of the first ``batches`` batches, merged; ``where`` limits what is opened."""
        rows = self._read(spark, self.parts(batches))
        return self.merge(rows if where is None else rows.filter(where))

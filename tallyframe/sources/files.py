"""The few file operations that Spark's readers and writers do not offer, through Hadoop's file systems.

They reach whatever store the cluster's paths name; the driver's own disk is never used.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm  # PySpark has no public way to Hadoop's file systems
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, place = _open(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _open(spark, path)
    return fs.exists(place)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new small file; False if it is there already. The store decides between two writers."""
    fs, place = _open(spark, path)
    try:
        out = fs.create(place, False)
    except Exception as error:  # noqa: BLE001  any error of the store but this one goes on
        if fs.exists(place):
            return False
        raise error
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())


def remove(spark: SparkSession, folder: str) -> None:
    fs, place = _open(spark, folder)
    fs.delete(place, True)

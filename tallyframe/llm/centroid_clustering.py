"""Clustering of integer vectors around centroids, by a vector-approximation file.

Every component is replaced by the number of the cell it lies in; the cells of a dimension
are cut at its quantiles, so each holds about as many values. For a centroid, a lookup
table holds the least and the greatest squared difference of each cell, less the squared
difference from a point amid the centroids: what all centroids have in common cancels,
which leaves intervals narrow enough to decide. Their sums over the dimensions surely hold
the centroid's squared distance less that of the point. Where one centroid's interval lies
below all others, the cells alone decide. Only vectors whose intervals overlap are fetched
in full, and compared with the centroids still possible. Tasks are sent the centroids and
the cells' ends and work the tables out themselves: tables of megabytes would be written to
the disk of the driver and of every executor for each function of each round.

A round needs the sums of the vectors of each cluster. They are carried on: only vectors
that may have changed their cluster since the round before are fetched and add to one sum
and subtract from another. The driver holds sums, counts and centroids, nothing else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Scratch, prepare

DIM = 64
SCALE = 1024
CELLS = 256  # a byte a component, a quarter of the integer
CENTROIDS, ROUNDS, SEED = 8, 10, 3
LARGEST = 1 << 27  # of a component, so that a squared distance is a long

Tables = tuple[np.ndarray, np.ndarray]
Ends = tuple[np.ndarray, np.ndarray, np.ndarray]  # of the cells, see cut_points


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of rows of doubles."""
    return np.floor(values * float(SCALE)).astype(np.int64)


def cut_points(vectors: DataFrame, dim: int) -> Ends:
    """Per dimension the upper ends of all cells but the last, the least and the greatest integer."""
    parts = [F.floor(F.col("x")[d].cast("double") * SCALE).cast("long") for d in range(dim)]
    shares = [k / CELLS for k in range(1, CELLS)]
    found = vectors.agg(
        F.array(*[F.percentile_approx(p, shares, 4000) for p in parts]), F.array(*[F.min(p) for p in parts]), F.array(*[F.max(p) for p in parts])
    ).first()
    return tuple(np.array(c, np.int64) for c in found)


def cells_of(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for d in range(x.shape[1]):
        out[:, d] = np.searchsorted(cuts[d], x[:, d])
    return out


def lookup(centroids: np.ndarray, cuts: np.ndarray, low: np.ndarray, high: np.ndarray) -> Tables:
    """Least and greatest of (x - c)^2 - (x - amid)^2 in a cell, as (centroid, dimension, cell).

    The difference is linear in x, so its extremes are at the cell's ends.
    """
    first = np.concatenate([low[:, None], cuts + 1], axis=1)
    last = np.concatenate([cuts, high[:, None]], axis=1)
    amid = centroids.sum(axis=0) // len(centroids)
    c, m = centroids[:, :, None], amid[None, :, None]
    at_first, at_last = (c - m) * (c + m - 2 * first), (c - m) * (c + m - 2 * last)
    return np.minimum(at_first, at_last), np.maximum(at_first, at_last)


def possible(cells: np.ndarray, tables: Tables) -> np.ndarray:
    """(row, centroid): whether the centroid may be the nearest, by its interval."""
    at = np.arange(cells.shape[1])
    low, high = (np.stack([t[c][at, cells].sum(axis=1) for c in range(len(t))], axis=1) for t in tables)
    return low <= high.min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest possible centroid (ties: the smaller) and its squared distance."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    which = np.zeros(len(x), np.int64)
    for c in range(len(centroids)):
        k = np.flatnonzero(open_[:, c])
        d = ((x[k] - centroids[c]) ** 2).sum(axis=1)
        closer = d < best[k]
        best[k[closer]], which[k[closer]] = d[closer], c
    return which, best


def _matrix(column: pa.Array, kind: type, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    raw = np.ascontiguousarray(rows).tobytes()
    return pa.array([raw[k : k + width] for k in range(0, len(raw), width)], pa.binary())


def _sums(moves: DataFrame, k: int, dim: int) -> tuple[list[int], list[list[int]]]:
    """Counts and sums per cluster of rows (cluster, n, total); k * dim numbers."""
    n, total = [0] * k, [[0] * dim for _ in range(k)]
    rows = moves.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[d].cast("decimal(38,0)")) for d in range(dim)]).alias("total"))
    for r in rows.collect():
        n[r["cluster"]], total[r["cluster"]] = int(r["n"]), [int(v) for v in r["total"]]
    return n, total


def _moves(rows: DataFrame, now: np.ndarray, before: np.ndarray | None, dim: int, ends: Ends) -> DataFrame:
    """(cluster, n, total) per batch of full vectors: what each cluster gains, less what it loses."""

    def run(batches):
        sides = [(centroids, lookup(centroids, *ends), sign) for centroids, sign in ((now, 1), (before, -1)) if centroids is not None]
        for batch in batches:
            x = _matrix(batch.column(0), np.int32, dim).astype(np.int64)
            cells = _matrix(batch.column(1), np.uint8, dim)
            n = np.zeros(len(now), np.int64)
            total = np.zeros((len(now), dim), np.int64)
            for centroids, table, sign in sides:
                which, _ = nearest(x, centroids, possible(cells, table))
                np.add.at(n, which, sign)
                np.add.at(total, which, sign * x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(now)), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"]
            )

    return rows.select("x", "cells").mapInArrow(run, "cluster int, n long, total array<long>")


def _to_fetch(cells: DataFrame, dim: int, now: np.ndarray, before: np.ndarray, ends: Ends) -> DataFrame:
    """Rows whose cluster the cells do not decide in both rounds, or that change it."""

    def run(batches):
        tables, tables_before = lookup(now, *ends), lookup(before, *ends)
        for batch in batches:
            c = _matrix(batch.column(1), np.uint8, dim)
            a, b = possible(c, tables), possible(c, tables_before)
            sure = (a.sum(axis=1) == 1) & (b.sum(axis=1) == 1) & (a.argmax(axis=1) == b.argmax(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(~sure))], names=["row"])

    return cells.select("row", "cells").mapInArrow(run, "row long")


def centroid_clustering(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED
) -> DataFrame:
    """One row per vector: its id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, have another number of components than ``dim`` or hold null or
    non-finite components give no row, nor do those with a component of 131072 (2^17) or
    more, for whose squared distances a long is too small. Components become
    floor(1024 * x). The first centroids are the ``k`` vectors with the smallest sha256 of
    ``seed:id``; with fewer vectors there are fewer centroids; vectors with a null id are
    clustered but never first centroids; of rows that share an id the smaller vector comes
    first. A round assigns every vector to the nearest centroid (ties: the smaller number)
    and moves non-empty centroids to the floor of the mean. Other columns are not read; an
    empty table, and one where no vector has an id, gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    scratch = Scratch(spark)
    kind = dict(vectors.dtypes)[id_col]
    schema = f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    read = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    sound = F.coalesce((F.size("x") == dim) & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < LARGEST / SCALE)), F.lit(False))
    read = read.where(sound)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = read.where("id IS NOT NULL").select(name.alias("h"), F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("x"))
    centroids = np.array([r["x"] for r in first.orderBy("h", "x").limit(k).collect()], np.int64)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    ends = cut_points(read, dim)

    def described(batches):
        for batch in batches:
            x = integers(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(cells_of(x, ends[0])), _binary(x.astype(np.int32))], names=["row", "id", "cells", "x"])

    rows = read.select(F.monotonically_increasing_id().alias("row"), "id", "x").mapInArrow(described, f"row long, id {kind}, cells binary, x binary")
    full = scratch.keep(rows, "full", bucket_by="row")
    cells = scratch.keep(full.select("row", "cells"), "cells")

    n, total = _sums(_moves(full, centroids, None, dim, ends), len(centroids), dim)
    for turn in range(rounds):
        after = np.array([[t // n[c] for t in total[c]] if n[c] else centroids[c] for c in range(len(centroids))], np.int64)
        if (after == centroids).all():
            break  # all later rounds give the same centroids
        before, centroids = centroids, after
        if turn + 1 < rounds:
            fetched = full.join(_to_fetch(cells, dim, centroids, before, ends), "row")
            gained, moved = _sums(_moves(fetched, centroids, before, dim, ends), len(centroids), dim)
            n = [a + b for a, b in zip(n, gained)]
            total = [[a + b for a, b in zip(x, y)] for x, y in zip(total, moved)]

    def assigned(batches):
        tables = lookup(centroids, *ends)
        for batch in batches:
            which, d = nearest(_matrix(batch.column(2), np.int32, dim).astype(np.int64), centroids, possible(_matrix(batch.column(1), np.uint8, dim), tables))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which, pa.int32()), pa.array(d)], names=["id", "cluster", "distance"])

    out = scratch.keep(full.select("id", "cells", "x").mapInArrow(assigned, f"id {kind}, cluster int, distance long"), "assigned")
    scratch.drop("full", "cells")
    sums = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    named = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    report = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = out.join(F.broadcast(report), "cluster")  # one row per centroid
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Near-duplicate vectors by cosine, from int8 tile products with error bounds.

A vector u of length 1 is held as s * q with q in -127..127 and the length e of what the
rounding leaves. For two vectors

    |u . v - s_u s_v (q_u . q_v)| <= e_u + (1 + e_u) e_v

so an int8 product proves most pairs to be below or above the threshold; only pairs
between are computed in double precision. Rows are dealt into blocks of bounded size, and
every pair of blocks is one task; products of int8 values are summed exactly in float32
(float64 for long vectors). A task returns no pairs, only, per row, its links and the
smallest row that it is connected to within the tile, so a group of copies that holds a
third of all rows costs no more than other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Scratch, components

THRESHOLD = 0.9
TILE_ROWS = 8192  # expected rows of a block
CHUNK_ROWS = 512  # rows of a block whose products are in memory at a time
SLACK = 1e-6  # far above the rounding of the sums that the bound itself takes


def quantised(x: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """int8 values, scale and rounding error of x / |x|; None if it has no direction."""
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    u = x / top  # keeps the squares of very large and very small values finite
    u = u / np.sqrt(u @ u)
    scale = np.abs(u).max() / 127
    q = np.rint(u / scale)
    left = u - scale * q
    return q.astype(np.int8), float(scale), float(np.sqrt(left @ left))


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for rid, values in zip(pdf["rid"], pdf["x"]):
            if values is None:
                continue
            x = np.array([np.nan if v is None else v for v in values], np.float64)
            if (found := quantised(x)) is not None:
                rows.append((rid, len(x), found[0].tobytes(), found[1], found[2], x.tobytes()))
        if rows:
            yield pd.DataFrame(rows, columns=["rid", "dim", "q", "scale", "error", "x"])


def _connect(labels: np.ndarray, row: int, linked: np.ndarray) -> None:
    roots = np.unique(labels[linked])
    roots = np.unique(np.append(roots, labels[row]))
    if len(roots) > 1:
        labels[np.isin(labels, roots)] = roots[0]


def tile(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """(rid, links, root) of the rows with links; ``right`` None: the block with itself."""
    own = right is None
    b = left if own else right
    dim = len(left["q"].iloc[0])
    kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
    matrix = lambda d: np.frombuffer(b"".join(d["q"]), np.int8).reshape(len(d), dim).astype(kind)
    full = lambda d: np.frombuffer(b"".join(d["x"]), np.float64).reshape(len(d), dim)
    unit = lambda x: (y := x / np.abs(x).max(axis=1, keepdims=True)) / np.sqrt((y * y).sum(axis=1, keepdims=True))
    qa, qb, xa, xb = matrix(left), matrix(b), unit(full(left)), unit(full(b))
    sa, ea = left["scale"].to_numpy(), left["error"].to_numpy()
    sb, eb = b["scale"].to_numpy(), b["error"].to_numpy()
    shift = 0 if own else len(left)
    links = np.zeros(shift + len(b), np.int64)
    labels = np.arange(len(links))
    for k in range(0, len(left), CHUNK_ROWS):
        part = slice(k, k + CHUNK_ROWS)
        about = (qa[part] @ qb.T) * (sa[part, None] * sb)
        bound = ea[part, None] + (1 + ea[part, None]) * eb + SLACK
        linked = about - bound >= threshold
        rows, cols = np.nonzero((about + bound >= threshold) & ~linked)
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
            exact = np.einsum("ij,ij->i", xa[part][r], xb[c])
            linked[r, c] = exact >= threshold
        if own:
            linked[np.arange(linked.shape[0]), np.arange(k, k + linked.shape[0])] = False
        links[part if own else slice(k, min(k + CHUNK_ROWS, len(left)))] += linked.sum(axis=1)
        if not own:
            links[shift:] += linked.sum(axis=0)
        for row in np.flatnonzero(linked.any(axis=1)):
            _connect(labels, k + row, shift + np.flatnonzero(linked[row]))
    rid = left["rid"].to_numpy() if own else np.concatenate([left["rid"], b["rid"]])
    least = np.full(len(rid), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, rid)
    used = links > 0
    return pd.DataFrame({"rid": rid[used], "links": links[used], "root": least[labels[used]]})


def embedding_neardup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: its id, n_links, component_id and kept.

    Two rows link if the cosine of their vectors is at least ``threshold``; repeated rows
    are rows of their own and link. Vectors that are null, empty, zero or hold null or
    non-finite values link with nothing, nor do vectors of different length.
    component_id is the smallest id reachable by links, and the row's own id where it has
    no links; kept says whether both are equal, and is true for a null id without links.
    Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = scratch.keep(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    held = rows.select("rid", "x").mapInPandas(_vectors, "rid long, dim int, q binary, scale double, error double, x binary")
    held = scratch.keep(held, "held")
    blocks = max(1, -(-held.count() // TILE_ROWS))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = held.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).select("*", every)
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        left, right = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"rid": [], "links": [], "root": []}, dtype=np.int64)
        return tile(left, None if i == j else right, threshold)

    found = dealt.drop("other").groupBy("dim", "i", "j").applyInPandas(product, "rid long, links long, root long")
    found = scratch.keep(found, "found")
    whole = components(scratch, found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rid").agg(F.sum("links").alias("n_links"))
    out = rows.select("rid", "vec").join(links, "rid", "left").join(whole.withColumnRenamed("node", "rid"), "rid", "left")
    out = out.withColumn("component", F.coalesce("component", "rid"))
    least = out.groupBy("component").agg(F.min("vec").alias("component_id"))
    n = F.coalesce("n_links", F.lit(0))
    out = scratch.keep(
        out.join(least, "component").select(
            F.col("vec").alias(id_col), n.alias("n_links"), "component_id",
            F.coalesce(F.col("vec") == F.col("component_id"), n == 0).alias("kept"),
        ),
        "out",
    )
    scratch.drop(*[label for label in scratch.names if label != "out"])
    return out

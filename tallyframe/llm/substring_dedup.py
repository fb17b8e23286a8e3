"""Removal of words covered by repeated windows, found through recompression symbols.

Recompression renames a text in rounds: runs of equal symbols and pairs of neighbours get
new names. Here a name is a 64-bit hash of what it stands for, so all tasks give equal
content the same name without exchanging tables, and which pairs merge is decided by
coins of the names (0 before 1), so pairs never overlap. Blocks hold at most CAP words;
therefore whether a block starts at a word depends only on REACH words to either side:
inside two equal windows the blocks fall alike, wherever the windows stand.

In every window, the block starts that are at least REACH words from both ends are
compared by the high-level name of the 2 * REACH words around them; the smallest is the
window's anchor. Equal windows have equal anchors at the same place, so a window whose
anchor's name occurs once only is unique (about one name per six words is counted).
Windows whose anchor is shared are verified: their own 128-bit names are counted over all
texts. Counting pre-aggregates: what a batch of rows repeats is settled there, and only
one row per distinct window and batch is shuffled, so a passage that stands in a third
of all texts loads no single task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import POLY, Scratch, hash_bitmap, in_bitmap, mixed, window_hashes, word_hashes

WINDOW = 35
CAP = 4  # words in a block
ROUNDS = 2  # of pairs, after one of runs
REACH = CAP * (ROUNDS + 1)


def block_starts(h: np.ndarray) -> np.ndarray:
    """Places where a block of the last round starts."""
    start = np.concatenate([[True], h[1:] != h[:-1]])
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, len(h)))
    long = np.flatnonzero(length > CAP)  # a run over CAP words stays single words
    if len(long):
        for k in long:
            start[at[k] : at[k] + length[k]] = True
        at = np.flatnonzero(start)
        length = np.diff(np.append(at, len(h)))
    name = mixed(h[at] + length.astype(np.uint64) * POLY)
    for turn in range(ROUNDS):
        coin = (mixed(name + np.uint64(turn + 1)) & np.uint64(1)).astype(bool)
        left = np.zeros(len(at), bool)
        left[:-1] = ~coin[:-1] & coin[1:] & (length[:-1] + length[1:] <= CAP)
        right = np.zeros(len(at), bool)
        right[1:] = left[:-1]
        k = np.flatnonzero(left)
        name[k] = mixed(name[k] * POLY + name[k + 1])
        length[k] += length[k + 1]
        at, length, name = at[~right], length[~right], name[~right]
    return at


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``h`` the place of its anchor, and the names of places (those that start blocks)."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    names = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    around = window_hashes(h, 2 * REACH)  # at i: words i to i + 2 * REACH - 1
    at = block_starts(h)
    at = at[(at >= REACH) & (at <= len(h) - REACH)]
    names[at] = around[at - REACH] >> np.uint64(1)
    width = window - 2 * REACH + 1
    view = np.lib.stride_tricks.sliding_window_view(names[REACH : REACH + n + width - 1], width)
    return view.argmin(axis=1) + np.arange(n) + REACH, names


def _hashes(text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    words = text.split() if text else []
    return words, word_hashes(words)


def _name_of(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(text or b"") - (1 << 63)


def _shared_names(docs: DataFrame, window: int) -> DataFrame:
    """Names of anchors that stand in two different texts, or twice in one."""

    def names(batches):
        for batch in batches:
            cls, found, twice = [], [], []
            for value in batch.column(0):
                text = value.as_py()
                words, h = _hashes(text)
                if len(words) < window:
                    continue
                place, name = anchors(h, window)
                name, count = np.unique(name[np.unique(place)], return_counts=True)
                found.append(name.view(np.int64))
                twice.append(count > 1)
                cls.append(np.full(len(name), _name_of(text)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (found, cls, twice)], names=["s", "cls", "twice"])

    rows = docs.select("text").mapInArrow(names, "s long, cls long, twice boolean")
    ends = rows.groupBy("s").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("k"), F.max("twice").alias("twice"))
    return ends.where("k > 1 OR twice").select("s")


def _runs(places: np.ndarray) -> list[int]:
    """Ascending places as start, end, start, end, ... of their runs."""
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    starts = places[np.concatenate([[0], cut])]
    ends = places[np.concatenate([cut - 1, [len(places) - 1]])] + 1
    return np.stack([starts, ends], axis=1).ravel().tolist()


def _candidates(docs: DataFrame, window: int, bitmap: np.ndarray) -> DataFrame:
    """Per text with windows to verify: runs of windows that its batch repeats, and one
    (h1, h2, place) for each other distinct window and each first of a repeated one."""

    def windows(batches):
        for batch in batches:
            parts = []
            for value in batch.column(0):
                text = value.as_py()
                words, h = _hashes(text)
                if len(words) < window:
                    continue
                place, name = anchors(h, window)
                at = np.flatnonzero(in_bitmap(name[place], bitmap))
                if len(at):
                    other = mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                    parts.append((_name_of(text), at, window_hashes(h, window)[at], window_hashes(other, window)[at]))
            if not parts:
                continue
            h1 = np.concatenate([p[2] for p in parts])
            _, first, inverse, count = np.unique(h1, return_index=True, return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            sent = np.zeros(len(h1), bool)
            sent[first] = True
            ends = np.cumsum([0, *(len(p[1]) for p in parts)])
            places = np.concatenate([p[1] for p in parts])
            h2 = np.concatenate([p[3] for p in parts])
            runs = [_runs(p[1][again[a:b]]) if again[a:b].any() else [] for p, a, b in zip(parts, ends, ends[1:])]
            out = pa.array(np.cumsum([0, *(int(sent[a:b].sum()) for a, b in zip(ends, ends[1:]))]), pa.int32())
            lists = [pa.ListArray.from_arrays(out, pa.array(x[sent])) for x in (h1.view(np.int64), h2.view(np.int64), places.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in parts], pa.int64()), pa.array(runs, pa.list_(pa.int32())), *lists],
                names=["cls", "runs", "h1", "h2", "place"],
            )

    return docs.select("text").mapInArrow(windows, "cls long, runs array<int>, h1 array<long>, h2 array<long>, place array<int>")


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(cls, runs): for each text, named by a hash, the starts of its repeated windows, as lists of runs."""
    shared = scratch.keep(_shared_names(docs, window), "shared")
    found = scratch.keep(_candidates(docs, window, hash_bitmap(shared, "s")), "windows")
    rows = found.select("cls", F.explode(F.arrays_zip("h1", "h2", "place")).alias("w")).select("cls", "w.*")
    rows = rows.withColumn("k", F.count("*").over(Window.partitionBy("h1", "h2"))).where("k > 1")
    across = rows.groupBy("cls").agg(F.sort_array(F.collect_set("place")).alias("places"))
    across = across.select("cls", F.flatten(F.transform("places", lambda p: F.array(p, p + 1))).alias("runs"))
    within = found.where(F.size("runs") > 0).select("cls", "runs")
    return within.unionByName(across).groupBy("cls").agg(F.collect_set("runs").alias("runs"))


def _cleaned(text: bytes | None, runs: list | None, window: int) -> tuple[int, int, list[bytes]]:
    words = text.split() if text else []
    if not runs:
        return len(words), 0, words
    mark = np.zeros(len(words) + 1, np.int32)
    for run in runs:
        ends = np.asarray(run)
        np.add.at(mark, ends[::2], 1)
        np.add.at(mark, np.minimum(ends[1::2] - 1 + window, len(words)), -1)
    keep = np.cumsum(mark[:-1]) == 0
    kept = [words[i] for i in np.flatnonzero(keep)]
    return len(words), len(words) - len(kept), kept


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text.

    Words are what ASCII white space separates. A word goes if a window of ``window`` words
    that covers it starts at another place too, in any row; all copies go, so repeated rows
    of at least ``window`` words lose all their words. Windows are judged on the input.
    Null and empty texts have no words; ids may be null or repeated; other columns are not
    read. An empty table gives no rows. ``window`` must be at least 2 * REACH + CAP.
    """
    if window < 2 * REACH + CAP:
        raise ValueError(f"window must be at least {2 * REACH + CAP}")
    scratch = Scratch(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    flags = scratch.keep(repeated_windows(read, scratch, window), "flags")
    scratch.drop("shared", "windows")
    bitmap = hash_bitmap(flags, "cls")
    kind = dict(docs.dtypes)[id_col]

    def split(hit: bool):
        def part(batches):
            for batch in batches:
                cls = np.array([_name_of(t.as_py()) for t in batch.column(1)], np.int64)
                flagged = in_bitmap(cls, bitmap)
                batch = batch.append_column("cls", pa.array(cls))
                yield batch.filter(pa.array(flagged if hit else ~flagged))

        return read.mapInArrow(part, f"doc {kind}, text binary, cls long")

    def clean(batches):
        for batch in batches:
            n, removed, digest, kept = [], [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                total, gone, words = _cleaned(text.as_py(), runs.as_py(), window)
                joined = b" ".join(words)
                n.append(total)
                removed.append(gone)
                digest.append(hashlib.sha256(joined).hexdigest())
                if texts:
                    kept.append(joined)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)]
            names = ["doc", "n_words", "n_removed", "kept_sha256"]
            if texts:
                arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    empty = F.lit(None).cast("array<array<int>>").alias("runs")
    rows = split(False).select("doc", "text", empty).unionByName(split(True).join(flags, "cls", "left").select("doc", "text", "runs"))
    out = rows.mapInArrow(clean, f"doc {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
    return out.withColumnRenamed("doc", id_col)

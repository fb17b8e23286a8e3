"""Removal of bytes covered by repeated strings, by a difference cover of the suffixes.

Distinct texts are cut into blocks at synchronising places: a place is one if the least
hash of the bytes from it to REACH bytes on stands at either end. It depends on the bytes
that follow only, and any REACH bytes hold one, so equal strings are cut alike. The string
of blocks, about one for 24 bytes, is sorted in place of the string of bytes:

* Of the blocks of a text those with a number not divisible by three start sampled
  suffixes. Their triples are sorted over all texts, and repeated ones named by rank; a
  triple that occurs once ends its suffix's comparison and is dropped.
* Triples of names are named in turn, so a name stands for nine blocks. A name of 27 would
  be longer than the strings looked for, so the recursion ends there.
* Remaining suffixes are merged in by the cover's property: of two equal strings, wherever
  their blocks' numbers fall, one of the first three blocks is sampled in both. A block
  whose next block starts, so shifted, a chain of named triples may begin a repeat; all
  others begin none.
* Adjacent prefixes are compared: for such blocks, the strings from the block's start to
  SPAN bytes beyond its last byte. Where they recur, so do all strings that start in the
  block. Blocks at the edges of repeats, and all blocks that share their core with one,
  have each of their strings compared.

What is compared are 128-bit names of the strings themselves, so triples decide where to
look, never what is equal. Counts combine before a shuffle and joins against them can be
split, so a passage that stands in a third of all texts loads no single task; copies of
a whole text are one text here.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.ranking import rank_rows
from tallyframe.llm.common import MIX, Scratch, mixed, powers, prepare

SPAN = 400
REACH = 48  # any so many places hold a synchronising one
GRAM = 8  # bytes hashed at a place
SEEN = REACH + GRAM  # bytes that settle whether a place is one
CORE = SPAN - REACH  # bytes from the next block on that all strings starting in a block share
HOT_SHARE = 1000  # see the join with the documents


# --- a text --------------------------------------------------------------------------


class Blocks:
    """The blocks of one text of at least SPAN bytes, and names of its strings."""

    def __init__(self, raw: bytes, span: int) -> None:
        self.size, self.span = len(raw), span
        padded = raw + b"\0" * GRAM
        grams = np.ndarray((len(raw) - GRAM + 1,), "<u8", padded, strides=(1,)).astype(np.uint64)
        self.h = mixed(grams * MIX + np.uint64(1))
        self.cuts = _synchronising(self.h)
        # A block that starts the text comes before the first cut; it has no number.
        self.starts = self.cuts if len(self.cuts) and self.cuts[0] == 0 else np.concatenate([[0], self.cuts])
        self.lead = len(self.starts) - len(self.cuts)
        self.sums: dict[int, np.ndarray] = {}

    def names(self, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
        """Hashes of the bytes from start to end, each at least GRAM long."""
        if kind not in self.sums:
            h = self.h if kind == 0 else mixed(self.h ^ np.uint64(0xA5A5A5A5A5A5A5A5 * kind % (1 << 64)))
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * powers(len(h))[0], out=sums[1:], dtype=np.uint64)
            self.sums[kind] = sums
        s, last = self.sums[kind], end - GRAM + 1
        return mixed((s[last] - s[start]) * powers(len(self.h))[1][start] + (last - start).astype(np.uint64) * MIX)

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and names of the sampled triples; a triple is known by its bytes and GRAM - 1 more."""
        at = np.arange(len(self.cuts) - 3) if len(self.cuts) > 3 else np.empty(0, np.int64)
        at = at[at % 3 != 0]
        return at, self.names(self.cuts[at], self.cuts[at + 3] + GRAM - 1)

    def ranges(self, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks in which strings start: their places in ``starts``, first and last start."""
        k = np.flatnonzero(self.starts[:-1] <= self.size - self.span)
        return k, self.starts[k], np.minimum(self.starts[k + 1] - 1, self.size - self.span)

    def possible(self, k: np.ndarray, core: int, at1: np.ndarray, at2: np.ndarray) -> np.ndarray:
        """Which of the blocks k may begin a repeat: a chain of named triples, and of named triples of these,
        starts at the next block or one or two after it, and covers its core as far as cuts are settled there."""
        n = len(self.cuts)
        runs = []
        for known in (at1, at2):
            run = np.zeros(n + 3, np.int64)
            run[known] = 1
            for phase in (1, 2):
                run[phase::3] = _run_lengths(run[phase::3])
            runs.append(run)
        first = k + 1 - self.lead  # number of the next block
        end = np.searchsorted(self.cuts, self.cuts[first] + core - SEEN, "right") - 1
        out = np.zeros(len(k), bool)
        for shift in range(3):
            j = first + shift
            need = np.maximum((end - j) // 3, 0)
            chained = (runs[0][np.minimum(j, n)] >= need) & (runs[1][np.minimum(j, n)] >= np.maximum((end - j - 9) // 3 + 1, 0))
            out |= (j % 3 != 0) & (need > 0) & chained
        return out


def _synchronising(h: np.ndarray) -> np.ndarray:
    width = REACH + 1
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # least of each `width` values, from running minima forward and backward in rows of `width`
    rows = -(-len(h) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = h
    grid = full.reshape(rows, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:n], forward[width - 1 : width - 1 + n])
    return np.flatnonzero((h[:n] == least) | (h[REACH : REACH + n] == least))


def _run_lengths(flags: np.ndarray) -> np.ndarray:
    """How many ones follow from each place on, itself included."""
    zeros = np.append(np.flatnonzero(flags == 0), len(flags))
    return zeros[np.searchsorted(zeros, np.arange(len(flags)))] - np.arange(len(flags))


# --- over all texts --------------------------------------------------------------------


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _rows(parts: list[tuple], names: list[str]):
    """One batch of the parts' columns laid end to end."""
    if parts:
        yield pa.RecordBatch.from_arrays([_long(np.concatenate(c)) for c in zip(*parts)], names=names)


def _triples(texts: DataFrame, span: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            parts = []
            for cls, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, name = Blocks(raw, span).triples()
                parts.append((name, np.full(len(at), cls), at))
            yield from _rows(parts, ["a", "cls", "at"])

    return texts.select("cls", "text").mapInArrow(run, "a long, cls long, at long")


def _triples_of_names(known: DataFrame) -> DataFrame:
    """Names at a block, three and six blocks on, where all three are known."""

    def run(batches):
        for batch in batches:
            parts = []
            for cls, at, name in zip(*(batch.column(k) for k in range(3))):
                at, name = np.asarray(at.values), np.asarray(name.values)
                second, third = np.searchsorted(at, at + 3), np.searchsorted(at, at + 6)
                k = np.flatnonzero((at[np.minimum(second, len(at) - 1)] == at + 3) & (at[np.minimum(third, len(at) - 1)] == at + 6))
                parts.append((name[k], name[second[k]], name[third[k]], np.full(len(k), cls.as_py()), at[k]))
            yield from _rows(parts, ["a", "b", "c", "cls", "at"])

    return known.select("cls", "at", "name").mapInArrow(run, "a long, b long, c long, cls long, at long")


def _named(rows: DataFrame, keys: list[str], scratch: Scratch, label: str) -> DataFrame:
    """(cls, at, name): the sorted numbers of a text's suffixes whose key occurs twice, and the keys' ranks."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    ranks = rank_rows(twice, keys, "name", lambda d: scratch.keep(d, f"{label}_ranks"))
    found = rows.join(ranks, keys).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("s"))
    return scratch.keep(found.select("cls", F.col("s.at").alias("at"), F.col("s.name").alias("name")), label)


def _block_strings(texts: DataFrame, first: DataFrame, second: DataFrame, span: int, core: int) -> DataFrame:
    """(k1, k2, core, cls, block) of the blocks that may begin a repeat."""

    def run(batches):
        for batch in batches:
            parts = []
            for cls, raw, at1, at2 in zip(*(batch.column(k) for k in range(4))):
                text = Blocks(raw.as_py(), span)
                k, start, last = text.ranges(core)
                at1, at2 = (np.asarray(a.values) if a.is_valid else np.empty(0, np.int64) for a in (at1, at2))
                hit = text.possible(k, core, at1, at2)
                k, start, last = k[hit], start[hit], last[hit]
                next_ = text.starts[k + 1]
                names = [text.names(start, last + span, kind) for kind in (0, 1)]
                parts.append((*names, text.names(next_, next_ + core), np.full(len(k), cls.as_py()), k))
            yield from _rows(parts, ["k1", "k2", "core", "cls", "block"])

    rows = texts.join(first.select("cls", F.col("at").alias("at1")), "cls").join(second.select("cls", F.col("at").alias("at2")), "cls", "left")
    return rows.select("cls", "text", "at1", "at2").mapInArrow(run, "k1 long, k2 long, core long, cls long, block long")


def _single_strings(texts: DataFrame, blocks: DataFrame, span: int, core: int) -> DataFrame:
    """(k1, k2, cls, start) of every string that starts in the given blocks, (cls, block)."""

    def run(batches):
        for batch in batches:
            parts = []
            for cls, raw, picked in zip(*(batch.column(k) for k in range(3))):
                text = Blocks(raw.as_py(), span)
                k, first, last = text.ranges(core)
                at = np.searchsorted(k, np.sort(np.asarray(picked.values)))
                start = np.concatenate([np.arange(first[i], last[i] + 1) for i in at])
                parts.append((*(text.names(start, start + span, kind) for kind in (0, 1)), np.full(len(start), cls.as_py()), start))
            yield from _rows(parts, ["k1", "k2", "cls", "start"])

    rows = texts.join(blocks.groupBy("cls").agg(F.collect_set("block").alias("blocks")), "cls")
    return rows.select("cls", "text", "blocks").mapInArrow(run, "k1 long, k2 long, cls long, start long")


def repeated_strings(texts: DataFrame, scratch: Scratch, span: int = SPAN) -> DataFrame:
    """(cls, blocks, starts) for texts (cls, text) with repeats: blocks in which all strings recur, single starts."""
    core = span - REACH
    first = _named(_triples(texts, span), ["a"], scratch, "names")
    second = _named(_triples_of_names(first), ["a", "b", "c"], scratch, "names_of_names")
    strings = scratch.keep(_block_strings(texts, first, second, span, core), "strings")
    scratch.drop("names", "names_ranks", "names_of_names", "names_of_names_ranks")

    counts = strings.groupBy("core", "k1", "k2").agg(F.count("*").alias("n"))
    whole = strings.join(counts.where("n > 1").select("k1", "k2"), ["k1", "k2"], "left_semi").select("cls", "block")
    # An edge's strings may recur inside a block that recurs as a whole: both hold the same core.
    cores = counts.groupBy("core").agg(F.sum("n").alias("all"), F.min("n").alias("least")).where("all > 1 AND least = 1")
    edges = strings.join(cores.select("core"), "core", "left_semi").select("cls", "block")
    single = scratch.keep(_single_strings(texts, edges, span, core), "single")
    twice = single.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    starts = single.join(twice, ["k1", "k2"], "left_semi").select("cls", "start")
    none = F.lit(None).cast("long")
    both = whole.select("cls", "block", none.alias("start")).unionByName(starts.select("cls", none.alias("block"), "start"))
    return both.groupBy("cls").agg(F.collect_set("block").alias("blocks"), F.collect_set("start").alias("starts"))


def _cleaned(raw: bytes, blocks: np.ndarray, starts: np.ndarray, whole: bool, span: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left)."""
    if whole:
        return len(raw), 1, b""
    edge = np.zeros(len(raw) + 1, np.int64)
    if len(blocks):
        text = Blocks(raw, span)
        k, first, last = text.ranges(span - REACH)
        at = np.searchsorted(k, blocks)
        np.add.at(edge, first[at], 1)
        np.add.at(edge, last[at] + span, -1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + span, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept (binary).

    Texts are their UTF-8 bytes. A byte goes if a string of ``span`` bytes that covers it
    starts at another place too, in any row, its own included; all copies go, so repeated
    rows of at least ``span`` bytes lose all their bytes. Strings are judged on the input
    and never cross rows. Null and empty texts have no bytes; ids may be null or repeated;
    other columns are not read; an empty table gives no rows. ``span`` must be at least
    7 * REACH + SEEN, so that every core holds a sampled triple.
    """
    if span < 7 * REACH + SEEN:
        raise ValueError(f"span must be at least {7 * REACH + SEEN}")
    scratch = Scratch(prepare(docs.sparkSession))
    read = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, digest = F.octet_length("text").cast("long"), F.sha2(F.col("text").cast("binary"), 256)
    long = read.where(size >= span).groupBy("text").agg(F.count("*").alias("m"))
    # Numbers are given to rows of a written table, so that a task that runs again gives the same.
    distinct = scratch.keep(long.select(F.col("text").cast("binary").alias("text"), "m"), "distinct")
    distinct = scratch.keep(distinct.withColumn("cls", F.monotonically_increasing_id()), "texts", bucket_by="cls")
    scratch.drop("distinct")
    found = repeated_strings(distinct, scratch, span)

    def clean(batches):
        for batch in batches:
            out = []
            for raw, m, blocks, starts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                blocks, starts = (np.sort(np.array(v or [], np.int64)) for v in (blocks, starts))
                removed, runs, kept = _cleaned(raw, blocks, starts, m > 1, span)
                out.append((hashlib.sha256(raw).hexdigest(), m, removed, runs, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names = ["digest", "m", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    rows = distinct.join(found, "cls", "left").where("m > 1 OR blocks IS NOT NULL").select("text", "m", "blocks", "starts")
    changed = scratch.keep(
        rows.mapInArrow(clean, "digest string, m long, n_removed long, n_spans long, kept_sha256 string, kept binary"), "changed"
    )
    scratch.drop("strings", "single", "texts")

    # Only texts with removals are joined. One that a large share of the documents have goes to
    # where these are: at most HOT_SHARE texts can be so common.
    known = read.select("doc", size.alias("n_bytes"), digest.alias("digest"), *([F.col("text").cast("binary").alias("raw")] if texts else []))
    total = read.count()
    hot, cold = (changed.where(F.col("m") * HOT_SHARE >= total), changed.where(F.col("m") * HOT_SHARE < total))
    in_hot = known.join(F.broadcast(hot), "digest")
    others = known.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest", "left")
    out = in_hot.unionByName(others.select(*in_hot.columns)).select(
        F.col("doc").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
        *([F.coalesce("kept", "raw").alias("kept")] if texts else []),
    )
    return out

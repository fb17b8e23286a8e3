"""Alignment of two tokenizers over a corpus, one tokenisation for each distinct text.

Documents are shuffled by their full text; each distinct text is encoded once by a
byte-level vocabulary (A) and a piece vocabulary (B) and its tokens are aligned by byte
offsets. How many documents hold a pair of ids is the sum of the multiplicities of the
texts that hold it, so copies cost nothing. The measures of a text then go to every
document that has it, through the text's digest.

The counts a text needs are looked up in two ways that give the same numbers: the
``FREQUENT`` most common pairs, of fixed number whatever the input, travel to the tasks;
all other pairs, none of which can be in a large share of the texts, are joined.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Scratch, prepare

FREQUENT = 1 << 17  # pairs sent to the tasks: 24 bytes each
HOT_SHARE = 1000  # texts that at least 1 / HOT_SHARE of all documents have: at most HOT_SHARE of them
CHUNK_BYTES = 1 << 20  # texts aligned together
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


# --- vocabularies ------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes are their own character, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteVocabulary:
    """Vocabulary A, read from a byte-level BPE file whose merges are in the order of their ids."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, special = whole["model"], {t["content"] for t in whole["added_tokens"] if t["special"]}
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("merges must be in the order of their ids")
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        # no special tokens here: their strings in texts are ordinary text
        self.encode = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class PieceVocabulary:
    """Vocabulary B: pieces with U+2581 for a space and <0xHH> for a byte; it puts a space before a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())
        ]
        self.encode = model.encode_as_ids


class Aligner:
    """Both vocabularies, loaded once in a Python worker."""

    _held: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteVocabulary(path_a), PieceVocabulary(path_b)
        self.len_a = np.array([len(t) for t in self.a.bytes], np.int64)
        self.len_b = np.array([len(t) for t in self.b.bytes], np.int64)
        self.size_b = len(self.b.bytes)
        self.span = len(self.a.bytes) * self.size_b
        # an id's text with what follows it: within a group ',', after A's ids '|', after B's ids ';'
        marks = [(i, m) for i in range(len(self.a.bytes)) for m in ",|"] + [(i, m) for i in range(self.size_b) for m in ",;"]
        self.texts = [f"{i}{m}".encode() for i, m in marks]

    @classmethod
    def of(cls, path_a: str, path_b: str) -> "Aligner":
        if (path_a, path_b) not in cls._held:
            cls._held[path_a, path_b] = cls(path_a, path_b)
        return cls._held[path_a, path_b]

    def encode(self, raw: bytes) -> tuple[list[int], list[int]]:
        """Ids of both, or none where a vocabulary does not give the text back byte by byte."""
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return [], []
        if not text:
            return [], []
        a, b, whole = self.a.encode(" " + text), self.b.encode(text), b" " + raw
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole or b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return [], []
        return a, b

    def align(self, raws: list[bytes]) -> tuple[np.ndarray, ...]:
        """(n_a, n_b, n_groups, n_links, digests, number of distinct pairs) per text, and pairs and occurrences of all.

        Texts are laid end to end. Token ends of either kind cut them into pieces; a piece
        lies in one token of A and one of B, and each link is exactly one piece.
        """
        both = [self.encode(r) for r in raws]
        n_a, n_b = (np.array([len(ids[k]) for ids in both], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.array([i for ids in both for i in ids[k]], np.int64) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        every = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        cuts, shared = every[new], every[1:][~new[1:]]
        at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        text_of_a = np.repeat(np.arange(len(raws)), n_a)
        row = text_of_a[at_a] if len(cuts) else np.empty(0, np.int64)
        n_links = np.bincount(row, minlength=len(raws))
        n_groups = np.bincount(text_of_a[np.searchsorted(ends_a, shared)], minlength=len(raws)) if len(shared) else np.zeros(len(raws), np.int64)
        named, times = np.unique(row * self.span + ids_a[at_a] * self.size_b + ids_b[at_b], return_counts=True)
        n_pairs = np.bincount(named // self.span, minlength=len(raws)) if len(named) else np.zeros(len(raws), np.int64)

        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        last_a, last_b = np.ones(len(ids_a), np.int64), np.ones(len(ids_b), np.int64)
        last_a[:-1] = group_a[1:] != group_a[:-1]
        last_b[:-1] = group_b[1:] != group_b[:-1]
        marks = np.empty(len(ids_a) + len(ids_b), np.int64)
        marks[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = 2 * ids_a + last_a
        marks[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (len(self.a.bytes) + ids_b) + last_b
        ends = np.cumsum(n_a + n_b)
        digests = []
        for start, end in zip(ends - n_a - n_b, ends):
            text = b"".join(map(self.texts.__getitem__, marks[start:end].tolist()))[:-1]
            digests.append(hashlib.sha256(text).hexdigest() if text else "")
        return n_a, n_b, n_groups, n_links, digests, n_pairs, named % self.span, times


# --- over the corpus ---------------------------------------------------------------------


def _chunks(rows: list[bytes]):
    start, size = 0, 0
    for k, r in enumerate(rows):
        size += len(r)
        if size >= CHUNK_BYTES or k + 1 == len(rows):
            yield start, k + 1
            start, size = k + 1, 0


def _lists(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def aligned_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(cls, m) and the alignment of every distinct text: sizes, digest, distinct pairs with their occurrences."""

    def run(batches):
        tool = Aligner.of(path_a, path_b)
        for batch in batches:
            raws = batch.column(2).to_pylist()
            for start, end in _chunks(raws):
                n_a, n_b, groups, links, digests, n_pairs, pairs, times = tool.align(raws[start:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[start:end], batch.column(1)[start:end], *(pa.array(c, pa.int64()) for c in (n_a, n_b, groups, links)),
                        pa.array(digests, pa.string()), _lists(n_pairs, pairs, pa.int64()), _lists(n_pairs, times, pa.int32()),
                    ],
                    names=["cls", "m", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return texts.select("cls", "m", F.col("text").cast("binary")).mapInArrow(
        run, "cls binary, m long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    )


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): documents that hold the pair, and whether no other pair of its A id is held by more."""
    counts = aligned.select("m", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("m").alias("n"))
    counts = counts.withColumn("a", F.floor(F.col("pair") / F.lit(size_b)))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # a row per id of A: bounded by the vocabulary
    return counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _with_frequent(aligned: DataFrame, frequent: list) -> DataFrame:
    """(cls, count_sum, n_best) over the frequent pairs of each text, and its other pairs."""
    known = np.array([(r["pair"], r["n"], r["best"]) for r in frequent], np.int64).reshape(-1, 3)
    known = known[np.argsort(known[:, 0])]
    pair, n, best = (np.ascontiguousarray(known[:, k]) for k in range(3))

    def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])

    def run(batches):
        for batch in batches:
            pairs, times = batch.column(1), batch.column(2)
            flat, t = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            at = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            hit = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            got, top = (np.where(hit, x[at], 0) if len(pair) else np.zeros(len(flat), np.int64) for x in (n, best))
            left = sums((~hit).astype(np.int64), ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums(got * t, ends)), pa.array(sums(top * t, ends)), _lists(left, flat[~hit], pa.int64()), _lists(left, t[~hit], pa.int64())],
                names=["cls", "count_sum", "n_best", "pairs", "times"],
            )

    return aligned.select("cls", "pairs", "times").mapInArrow(run, "cls binary, count_sum long, n_best long, pairs array<long>, times array<long>")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Vocabulary A encodes a space and the text, B the text, to which it adds the space.
    Offsets where tokens of both end cut a text into groups; every A and B token whose
    bytes overlap are linked. A pair of ids counts in how many rows of ``docs`` it is linked;
    n_best counts links whose pair is the most frequent of its A id, ties included, and
    count_sum adds the counts over links. Null and empty texts, texts that are not valid
    UTF-8 and texts that a vocabulary does not give back have zeros and ''. Ids may be null
    or repeated and other columns are not read; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark)
    tool = Aligner.of(path_a, path_b)
    read = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    some = F.length("text") > 0
    ids = scratch.keep(read.select("doc", F.when(some, F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("cls")), "ids")
    texts = read.where(some).groupBy("text").agg(F.count("*").alias("m"))
    texts = texts.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("cls"), "m", "text")
    aligned = scratch.keep(aligned_texts(texts, path_a, path_b), "aligned")
    counts = scratch.keep(pair_counts(aligned, tool.size_b), "counts")
    frequent = counts.orderBy(F.desc("n"), "pair").limit(FREQUENT).collect()
    found = scratch.keep(_with_frequent(aligned, frequent), "found")
    rest = found.select("cls", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("cls", "p.*")
    rest = rest.join(counts.withColumnRenamed("pair", "pairs"), "pairs")
    rest = rest.select("cls", (F.col("n") * F.col("times")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"))
    sums = found.select("cls", "count_sum", "n_best").unionByName(rest).groupBy("cls").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    measures = scratch.keep(aligned.drop("pairs", "times").join(sums, "cls").select("cls", "m", *MEASURES, "groups_sha256"), "measures")
    scratch.drop("aligned", "counts", "found")

    # A text that a large share of the documents have would load one task of a join; at most
    # HOT_SHARE texts can be so common, and these go to where the documents are.
    total = ids.count()
    hot = measures.where(F.col("m") * HOT_SHARE >= total).drop("m")
    cold = measures.where(F.col("m") * HOT_SHARE < total).drop("m")
    known = ids.where("cls IS NOT NULL")
    none = [F.lit(0).cast("long").alias(c) for c in MEASURES]
    out = (
        known.join(F.broadcast(hot), "cls")
        .unionByName(known.join(F.broadcast(hot.select("cls")), "cls", "left_anti").join(cold, "cls"))
        .select("doc", *MEASURES, "groups_sha256")
        .unionByName(ids.where("cls IS NULL").select("doc", *none, F.lit("").alias("groups_sha256")))
    )
    return out.withColumnRenamed("doc", id_col)

"""Vector best-fit packing of tokenised documents into sequences.

A piece asks a bin for tokens, one document and attention cost (its length squared); a
bin has a capacity for each. Pieces, the most demanding first, go to the open bin that
has room in every dimension and is best by the rule: the smallest weighted norm of what
is left after placing ("norm"), or the largest weighted dot product of demand and what is
left ("dot"). Groups of bounded size, dealt by hash, are packed in parallel; then the
bins that are not full are packed again as single items, in as few groups as the bound
allows, until a round saves nothing, so groups cost next to no sequences.

Tokens come from a cache of white-space-delimited words per task: the tokenizer never
joins characters across white space, so a text's ids are its words' ids in a row.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Scratch, released

TOKENS = 4096
GROUP = 8192  # expected items that one task packs together
CACHE_WORDS = 400_000
PARTS = 20_000  # of words with marks or digits, kept apart
CHUNK_CHARACTERS = 100_000  # of texts whose words are in memory at a time
_MARKS = re.compile(r"(?:[^\w\s]|_)[.,] ")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)  # the tokenizer's rule, in lower-case ASCII
END = np.uint32(1).tobytes()
NEARLY_FULL = 0.995  # bins above this share of tokens are not packed again
ROUNDS = 4
WEIGHTS = (1.0, 0.05, 0.05)  # of tokens, documents and cost in the rule


class WordIds(dict):
    """Words -> places in a table of their ids as little-endian bytes.

    Words not met before get their places at once and are learned together. There are at
    most two generations of CACHE_WORDS.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table, self.new = [], []
        self.old, self.old_table = {}, []
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = re.compile("|".join(re.escape(x.content) for x in added) or "(?!)", re.IGNORECASE)
        self.parts, self.encode = {}, self.tokenizer.model.tokenize

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self.table)
        known = self.old.get(word)
        if known is None:
            self.new.append(word)
        self.table.append(None if known is None else self.old_table[known])
        return place

    def learn(self) -> None:
        words, self.new = self.new, []
        words = [w for w in words if not self._in_parts(w)]
        plain = [w for w in words if w.isalpha()]
        if plain:  # letters only are one part for the tokenizer, so one text of them can be cut at word ends
            ids = np.array(self._ids([" ".join(plain)])[0], np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(plain):
                whole, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                for w, x, y in zip(plain, cuts, cuts[1:]):
                    self.table[self[w]] = whole[x:y]
                words = [w for w in words if self.table[self[w]] is None]
        for w, x in zip(words, self._ids(words)):
            self.table[self[w]] = np.array(x, np.uint32).tobytes()

    def _in_parts(self, word: str) -> bool:
        """Learns a word of printable ASCII from its parts, which the tokenizer's model takes one by one; False for others."""
        if not word.isascii():
            return False
        if word.isalpha():
            ids = self._part(word.lower())
        elif word.isprintable() and not self.special.search(word):
            ids = b"".join(map(self._known_part, _PARTS.findall(word.lower())))
        else:
            return False
        self.table[self[word]] = ids
        return True

    def _known_part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            ids = self.parts[part] = self._part(part)
        return ids

    def _part(self, part: str) -> bytes:
        ids = [x.id for x in self.encode(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self) > CACHE_WORDS:
            self.old, self.old_table, self.table = dict(self), self.table, []
            self.clear()
        places = [list(map(self.__getitem__, _words(text))) for text in texts]
        if self.new:
            self.learn()
        return [b"".join(map(self.table.__getitem__, p)) for p in places]


def _words(text: str) -> list[str]:
    """A text in parts that the tokenizer treats alone, with few different ones.

    It drops white space, lower-cases and splits marks from words, so case is folded and
    commas and points at word ends stand alone where that changes no ids: not in texts
    beyond Latin-1 (composed characters), with its special tokens, or with several marks
    in a row.
    """
    text += "\n"
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ").split(" ")
    if "<|" in text:
        return text.replace("\n", " ").split(" ")
    text = text.lower().replace("\n", " ")
    if not _MARKS.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


def _tokenised(words: WordIds, texts: pa.Array) -> Iterator[bytes]:
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= CHUNK_CHARACTERS:
            yield from words.texts(held)
            held, size = [], 0
    yield from words.texts(held)


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = TOKENS) -> DataFrame:
    """Pieces (doc, piece, start, length, crc, ids) of at most ``size`` tokens; the end id is part of a document."""
    kind = dict(docs.dtypes)["doc"]

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = WordIds(tokenizer_path)
        for batch in batches:
            take, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, ids_of in enumerate(_tokenised(words, batch.column(1))):
                whole = ids_of + END
                for n, at in enumerate(range(0, len(whole), 4 * size)):
                    part = whole[at : at + 4 * size]
                    take.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(ids, pa.binary())],
                names=["doc", "piece", "start", "length", "crc", "ids"],
            )

    return docs.select("doc", "text").mapInArrow(released(cut), f"doc {kind}, piece int, start long, length long, crc long, ids binary")


def best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each row of ``demand`` (items x dimensions). An item beyond a capacity gets a bin of its own."""
    share = demand / capacity
    order = np.lexsort((np.arange(len(share)), -share.max(axis=1)))
    least = share.min(axis=0)
    bins = np.empty(len(share), np.int64)
    left = np.empty((share.shape[1], len(share)))  # what is left in each open bin, by dimension
    name = np.empty(len(share), np.int64)
    opened = used = 0
    for turn, k in enumerate(order):
        if turn % 256 == 255:  # bins that not even the least demand of all fits are closed
            room = (left[:, :used] >= least[:, None] - 1e-12).all(axis=0)
            used, left[:, : room.sum()], name[: room.sum()] = int(room.sum()), left[:, :used][:, room], name[:used][room]
        item = share[k][:, None]
        after = left[:, :used] - item
        fits = np.flatnonzero(after.min(axis=0) >= -1e-12) if used else np.empty(0, np.int64)
        if len(fits):
            if rule == "norm":
                best = fits[np.argmin(weights @ np.square(after[:, fits]))]
            else:
                best = fits[np.argmax(weights @ (item * left[:, fits]))]
        else:
            best, name[used] = used, opened
            left[:, used] = 1
            opened, used = opened + 1, used + 1
        left[:, best] -= share[k]
        bins[k] = name[best]
    return bins


def pack(items: DataFrame, scratch: Scratch, capacity: tuple, weights: tuple, rule: str, group: int) -> DataFrame:
    """(item, bin, offset) of items (item, tokens, documents, cost); bins have any numbers."""
    most, weight = np.array(capacity, float), np.array(weights, float)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        bins = best_fit(pdf[["tokens", "documents", "cost"]].to_numpy(float), most, weight, rule)
        pdf["bin"] = pdf["item"].groupby(bins).transform("min")
        pdf["offset"] = pdf["tokens"].groupby(bins).cumsum() - pdf["tokens"]
        return pdf[["item", "bin", "offset", "tokens", "documents", "cost"]]

    schema = "item long, bin long, offset long, tokens long, documents long, cost double"
    now, place, before = items, None, None
    for turn in range(ROUNDS):
        groups = max(1, -(-now.count() // group))
        dealt = now.groupBy(F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(groups)))
        found = scratch.keep(dealt.applyInPandas(packed, schema), f"round_{turn}")
        moved = found.select(F.col("item").alias("inner"), F.col("bin").alias("outer"), F.col("offset").alias("by"))
        if place is None:
            place = found.select("item", "bin", "offset")
        else:
            place = place.join(moved, F.col("bin") == F.col("inner"), "left").select(
                "item", F.coalesce("outer", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset")
            )
        place = scratch.keep(place, f"place_{turn}")
        bins = found.groupBy(F.col("bin").alias("item")).agg(*(F.sum(c).alias(c) for c in ("tokens", "documents", "cost")))
        now = scratch.keep(bins.where(F.col("tokens") < NEARLY_FULL * capacity[0]), f"open_{turn}")
        many = now.count()
        if many < 2 or (groups == 1 and turn) or many == before:
            break
        before = many
    return place


def best_fit_packing(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS,
    documents: int | None = None, cost: float | None = None, weights: tuple = WEIGHTS, rule: str = "norm",
    group: int = GROUP, with_ids: bool = True,
) -> DataFrame:
    """One row per piece of every row of ``docs``: id, piece, start, length, ids_crc32, sequence_id, offset and, with ``with_ids``, its ids.

    A document is its ids and the id 1 at the end; null and empty texts are the end id
    alone. Only documents of more than ``tokens`` are cut, into pieces of ``tokens``, the
    last one shorter. A sequence holds at most ``tokens`` tokens, ``documents`` pieces and
    ``cost`` squared lengths (by default as many as its tokens allow); offsets in it run
    gapless from 0. Ids may be null or repeated; every row is packed. Other columns are
    not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    pieces = token_pieces(read, tokenizer_path, tokens)
    pieces = pieces if with_ids else pieces.drop("ids")
    pieces = scratch.keep(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    items = pieces.select("item", F.col("length").alias("tokens"), F.lit(1).cast("long").alias("documents"), (F.col("length").cast("double") * F.col("length")).alias("cost"))
    place = pack(items, scratch, (tokens, documents or tokens, cost or float(tokens) ** 2), weights, rule, group)
    out = pieces.join(place, "item").select(
        F.col("doc").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
        F.col("bin").alias("sequence_id"), "offset", *(["ids"] if with_ids else []),
    )
    out = scratch.keep(out, "out")
    scratch.drop(*[label for label in scratch.names if label != "out"])
    return out

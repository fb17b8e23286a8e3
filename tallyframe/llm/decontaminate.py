"""Benchmark decontamination by latent semantic retrieval, confirmed by word order.

Passages of WORDS words, STEP apart, of all documents and of the benchmark items are
TF-IDF vectors over hashed words; document frequencies cover all documents. A randomised
SVD, summed over Spark partitions of a bounded sample of passages beside all items,
projects the benchmark's vocabulary to a latent space of DIMENSIONS. The sample counts a
tenth as much as the items, whose rare words would else fall out of the leading
directions. Items share a space only up to DIMENSIONS passages, and item passages that
the leading directions hold less than HELD of are spanned by directions of their own, so
that no item is lost, however many there are. Every passage of every document is compared
there with every passage of the items, as matrix products of blocks, its length being that
of its whole TF-IDF vector. A product is spared where a bound rules all items out: the sum
over the passage's words of the most that a word adds to the cosine with any item, over a
length it surely has. Candidates with enough cosine are confirmed in the same task by the
longest common subsequence of words of item and surroundings; of those that match in part,
the answer, that is the end of the item, must be found too.

An item shorter than a passage is a small part of one, so its cosine may be low even where
it stands word by word: wherever its rarest word stands is a candidate as well. Of fewer
than EXACT_WORDS words, in which a chance match in part is likely, all must stand in a row.

The items and their projections go to every task. Their number is checked: more than
ITEM_BLOCK items are searched for in several passes. An item of more than LONGEST words is
searched for in pieces of so many, any of which counts as the item, so no space outgrows
DIMENSIONS passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import free_name, release, released

BITS = 18  # of the hashed vocabulary whose document frequencies are counted
WORDS, STEP = 32, 16
DIMENSIONS, EXTRA, POWER = 384, 16, 2
SAMPLE_WEIGHT = 0.1  # of the sample's squared length against the items'
FIT_PASSAGES = 20_000  # expected sample of document passages for the SVD
COSINE = 0.4
HELD = 0.95  # least share of an item passage's length that its space must hold
FULL, PART, ANSWER = 0.7, 0.5, 0.8  # shares of the item in order; of its answer
ANSWER_WORDS = 8
ITEM_BLOCK = 1000  # items searched for in one pass over the documents
FIT_TASKS = 8
LONGEST = (DIMENSIONS - 1) * STEP + WORDS  # words of DIMENSIONS passages
EXACT_WORDS = 8
_MARKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def names_of(text: str | None) -> np.ndarray:
    """32-bit names of a text's words: runs of letters, digits and whatever is not ASCII, in lower case."""
    words = (text or "").lower().encode().translate(_MARKS).split()
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words))


def starts_of(n: int) -> np.ndarray:
    """Starts of the passages of n words: all words are covered, the last passage ends with the text."""
    if n <= WORDS:
        return np.zeros(1 if n else 0, np.int64)
    return np.unique(np.append(np.arange(0, n - WORDS, STEP), n - WORDS))


def lcs(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word of the item at a time."""
    masks: dict[int, int] = {}
    for k, name in enumerate(item.tolist()):
        masks[name] = masks.get(name, 0) | 1 << k
    full = (1 << len(item)) - 1
    rows = full
    for name in region.tolist():
        if mask := masks.get(name):
            hit = rows & mask
            rows = (rows + hit | rows - hit) & full
    return len(item) - rows.bit_count()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per hashed word, over all documents, and their number."""

    def counted(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for pdf in batches:
            n += len(pdf)
            for text in pdf["text"]:
                df[np.unique(names_of(text) & (1 << BITS) - 1)] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"slot": np.append(at, -1), "k": np.append(df[at], n)})

    rows = docs.select("text").mapInPandas(released(counted), "slot long, k long").groupBy("slot").agg(F.sum("k").alias("k")).toPandas()
    df = np.zeros(1 << BITS, np.int64)
    real = rows["slot"] >= 0
    df[rows["slot"][real].to_numpy(np.int64)] = rows["k"][real].to_numpy(np.int64)
    return df, int(rows["k"][~real].sum())


class Index:
    """What a task needs to find the items that share one latent space."""

    def __init__(self, items: list[tuple[int, np.ndarray]], idf: np.ndarray) -> None:
        self.items, self.idf = items, idf
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.int64), *(n for _, n in items)]))
        self.slots = np.zeros(1 << BITS, bool)
        self.slots[self.vocabulary & (1 << BITS) - 1] = True
        self.basis = np.zeros((len(self.vocabulary), 0), np.float32)
        self.of, self.queries = np.empty(0, np.int64), np.zeros((0, 0), np.float32)
        self.most = np.zeros(max(len(self.vocabulary), 1))
        self._rarest()

    def columns(self, names: np.ndarray) -> np.ndarray:
        """Places of words in the items' vocabulary, -1 for others."""
        if not len(self.vocabulary):
            return np.full(len(names), -1)
        out = np.full(len(names), -1)
        some = np.flatnonzero(self.slots[names & (1 << BITS) - 1])  # the rest is surely not in it
        part = names[some]
        at = np.minimum(np.searchsorted(self.vocabulary, part), len(self.vocabulary) - 1)
        out[some] = np.where(self.vocabulary[at] == part, at, -1)
        return out

    def weights(self, names: np.ndarray) -> np.ndarray:
        return self.idf[names & (1 << BITS) - 1]

    def sparse(self, names: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and TF-IDF values of one passage, as a share of its whole vector's length."""
        part = names[start : start + WORDS]
        name, count = np.unique(part, return_counts=True)
        x = count * self.weights(name)
        at = self.columns(name)
        return at[at >= 0], x[at >= 0] / max(np.sqrt(x @ x), 1e-12)

    def project(self, names: np.ndarray, least: float = 0.0, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and latent vectors, as a share of their whole length, of the passages with at least that share in the vocabulary."""
        start = starts_of(len(names))
        at, w = self.columns(names) if at is None else at, self.weights(names)
        if least:
            start = self._possible(w, at, start, least)
        if not len(start):  # most texts hold nothing like an item
            return start, np.empty((0, self.basis.shape[1]), np.float32)
        whole, inner = self._lengths(names, w, at >= 0, start)
        some = inner >= least * whole
        start, whole = start[some], whole[some]
        size = min(WORDS, len(names))
        out = np.empty((len(start), self.basis.shape[1]), np.float32)
        for k, s in enumerate(start.tolist()):
            a = at[s : s + size]
            inside = a >= 0
            out[k] = w[s : s + size][inside].astype(np.float32) @ self.basis[a[inside]]
        return start, out / whole[:, None].astype(np.float32)

    def _possible(self, w: np.ndarray, at: np.ndarray, start: np.ndarray, least: float) -> np.ndarray:
        """Starts whose passages may have that cosine with an item passage.

        A word adds at most ``most`` times its weight, and the length is at least that of
        the passage's words taken as different.
        """
        end = np.minimum(start + WORDS, len(w))
        gain = np.concatenate([[0], np.cumsum(np.where(at >= 0, w * self.most[at], 0))])
        mass = np.concatenate([[0], np.cumsum(w * w)])
        gain, mass = gain[end] - gain[start], mass[end] - mass[start]
        return start[gain * gain >= (least - 1e-3) ** 2 * mass - 1e-6]

    def _lengths(self, names: np.ndarray, w: np.ndarray, inside: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the passages' vectors, whole and in the vocabulary only."""
        size = min(WORDS, len(names))
        cut = start[:, None] + np.arange(size)
        order = np.take_along_axis(cut, np.argsort(names[cut], axis=1), 1)
        view, own, known = names[order], w[order], inside[order]
        # A word that stands c times adds (c * idf)^2: its k-th copy adds (2k - 1) * idf^2.
        fresh = np.concatenate([np.ones((len(view), 1), bool), view[:, 1:] != view[:, :-1]], axis=1)
        place = np.arange(size)
        copy = place - np.maximum.accumulate(np.where(fresh, place, 0), axis=1) + 1
        mass = (2 * copy - 1) * own * own
        return np.maximum(np.sqrt(mass.sum(axis=1)), 1e-12), np.sqrt((mass * known).sum(axis=1))

    def finish(self, basis: np.ndarray) -> None:
        self.basis = np.ascontiguousarray(self._spanning(basis), np.float32)
        of, queries = [], []
        for k, (_, names) in enumerate(self.items):
            if len(names):
                found = self.project(names)[1]
                of += [k] * len(found)
                queries.append(found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12))
        if queries:
            self.of, self.queries = np.array(of), np.concatenate(queries)
            for k in range(0, len(self.queries), 64):
                part = (self.basis @ self.queries[k : k + 64].T).max(axis=1)
                self.most = np.maximum(self.most, part)

    def _rarest(self) -> None:
        """For items shorter than a passage: the column of the word in the fewest documents, the item, the word's place in it."""
        rare = []
        for k, (_, names) in enumerate(self.items):
            if 0 < len(names) < WORDS:
                place = int(np.argmax(self.weights(names)))
                rare.append((int(self.columns(names[place : place + 1])[0]), k, place))
        rare = np.array(sorted(rare), np.int64).reshape(-1, 3)
        self.rare, self.rare_item, self.rare_place = (np.ascontiguousarray(rare[:, c]) for c in range(3))
        self.has_rare = np.zeros(max(len(self.vocabulary), 1), bool)
        self.has_rare[self.rare] = True

    def _spanning(self, basis: np.ndarray) -> np.ndarray:
        """The basis, with the parts outside it of the item passages that it holds less than HELD of."""
        rest = []
        for _, names in self.items:
            for s in starts_of(len(names)):
                at, x = self.sparse(names, s)
                held = x @ basis[at]
                if held @ held < HELD * HELD * (x @ x):
                    part = -basis @ held
                    part[at] += x
                    rest.append(part)
        if not rest:
            return basis
        more, size, _ = np.linalg.svd(np.array(rest).T, full_matrices=False)
        return np.concatenate([basis, more[:, size > 1e-6 * size[0]]], axis=1)

    def leaks(self, names: np.ndarray) -> list[tuple[int, float, float, float]]:
        """(item number, cosine, share of the item in order, share of its answer) of the items found in a text's words.

        The cosine is 0 where a short item was found by its rarest word alone.
        """
        if not len(names) or not len(self.queries):
            return []
        best: dict[int, float] = {}
        places: dict[int, list[int]] = {}
        column = self.columns(names)
        if len(names) < 1 << 15:
            blocks = [self.project(names, COSINE, column)]
        else:  # very long texts, by overlapping stretches, so that memory is bounded
            ends = [(k, k + (1 << 14) + WORDS) for k in range(0, len(names), 1 << 14)]
            blocks = [(s + a, x) for a, b in ends for s, x in [self.project(names[a:b], COSINE, column[a:b])]]
        for start, x in blocks:
            if not len(start):
                continue
            near = x @ self.queries.T
            rows, cols = np.nonzero(near >= COSINE)
            for r, c in zip(rows.tolist(), cols.tolist()):
                k = int(self.of[c])
                best[k] = max(best.get(k, 0.0), float(near[r, c]))
                places.setdefault(k, []).append(int(start[r]))
        if len(self.rare):
            for p in np.flatnonzero((column >= 0) & self.has_rare[column]).tolist():
                for r in range(*np.searchsorted(self.rare, [column[p], column[p] + 1])):
                    k = int(self.rare_item[r])
                    best.setdefault(k, 0.0)
                    places.setdefault(k, []).append(p - int(self.rare_place[r]))
        out = []
        for k, cos in best.items():
            number, item = self.items[k]
            share, answer = self._found(item, names, sorted(places[k]))
            if share >= FULL or (share >= PART and answer >= ANSWER):
                out.append((number, cos, share, answer))
        return out

    def _found(self, item: np.ndarray, names: np.ndarray, places: list[int]) -> tuple[float, float]:
        """The best shares around the candidates; those near each other are one stretch."""
        if len(item) < EXACT_WORDS:
            exact = any(p >= 0 and np.array_equal(names[p : p + len(item)], item) for p in self._aligned(item, names, places))
            return (1.0, 1.0) if exact else (0.0, 0.0)
        best, start = (0.0, 0.0), 0
        for k in range(1, len(places) + 1):
            if k == len(places) or places[k] - places[k - 1] > 2 * len(item) + WORDS:
                best = max(best, self._confirm(item, names, places[start], places[k - 1]))
                start = k
            if best[0] == 1.0:
                break
        return best

    @staticmethod
    def _aligned(item: np.ndarray, names: np.ndarray, places: list[int]) -> list[int]:
        """Where a short item may start, around candidates: places of its first word."""
        near = {p for c in places for p in range(max(c - WORDS, 0), min(c + WORDS, len(names)))}
        return [p for p in near if names[p] == item[0]]

    def _confirm(self, item: np.ndarray, names: np.ndarray, first: int, last: int) -> tuple[float, float]:
        """The best share of the item, and of its answer, in any stretch around the candidates."""
        size, best = len(item), (0.0, 0.0)
        tail = item[-min(ANSWER_WORDS, size) :]
        step = max(size // 4, 1)
        for at in range(max(first - size, 0), last + WORDS, step):
            region = names[at : at + size + size // 2 + 1]
            share = lcs(item, region) / size
            if share > best[0]:
                best = share, lcs(tail, region) / len(tail)
            if share == 1.0:
                break
        return best


def leaks_of(part: list[Index], text: str | None) -> list[tuple[int, float, float, float]]:
    """What the indexes of one pass find in a text; of an item in several pieces, the piece found best."""
    names = names_of(text)
    best: dict[int, tuple[int, float, float, float]] = {}
    for index in part:
        for leak in index.leaks(names):
            held = best.get(leak[0])
            if held is None or leak[2:] > held[2:]:
                best[leak[0]] = leak
    return list(best.values())


def _fit(index: Index, some: DataFrame) -> None:
    """Randomised SVD: Q spans A^T A ... A^T G for the TF-IDF rows A of the sample; the basis are its best directions."""
    size, width = len(index.vocabulary), min(DIMENSIONS + EXTRA, max(len(index.vocabulary), 1))

    def passages(texts):
        for text in texts:
            names = names_of(text)
            start = starts_of(len(names))
            for s in start[np.linspace(0, len(start) - 1, min(8, len(start))).astype(int)] if len(start) else ():
                yield index.sparse(names, s)

    def gathered(batches):
        for pdf in batches:
            rows = [(a.astype(np.int32), x) for a, x in passages(pdf["text"]) if len(a)]
            if rows:
                yield pd.DataFrame({"at": [a for a, _ in rows], "x": [x for _, x in rows]})

    held = some.mapInPandas(released(gathered), "at array<int>, x array<double>").repartition(FIT_TASKS).persist()
    own = [index.sparse(n, s) for _, n in index.items for s in starts_of(len(n))]
    mass = held.select(F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()[0] or 0.0
    weight = SAMPLE_WEIGHT * sum(float(x @ x) for _, x in own) / max(mass, 1e-12)

    def summed(rows, q: np.ndarray) -> np.ndarray:
        out = np.zeros_like(q)
        for at, x in rows:
            if len(at):
                out[at] += np.outer(x, x @ q[at])
        return out

    def step(q: np.ndarray) -> np.ndarray:
        """A^T A q, one partial sum of fixed size per partition."""

        def partial(batches):
            out = np.zeros_like(q)
            for pdf in batches:
                out += summed(zip(pdf["at"], pdf["x"]), q)
            rows = np.flatnonzero(out.any(axis=1))
            if len(rows):
                yield pd.DataFrame({"row": rows, "v": list(out[rows])})

        sums = [F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(q.shape[1])]
        part = held.mapInPandas(partial, "row long, v array<double>").groupBy("row").agg(*sums).toPandas()
        out = summed(own, q)
        if len(part):
            out[part["row"].to_numpy(np.int64)] += weight * part.drop(columns="row").to_numpy(float)
        return out

    q = np.random.default_rng(7).normal(size=(size, width))
    for _ in range(POWER):
        q = np.linalg.qr(step(q))[0]
    b = q.T @ step(q)
    value, vector = np.linalg.eigh((b + b.T) / 2)
    index.finish(q @ vector[:, ::-1][:, :DIMENSIONS])
    held.unpersist()


def _spaces(items: list[tuple[int, np.ndarray]]) -> list[list[tuple[int, np.ndarray]]]:
    """The items in runs of at most DIMENSIONS passages."""
    out, held = [], DIMENSIONS
    for item in items:
        size = len(starts_of(len(item[1])))
        if held + size > DIMENSIONS:
            out.append([])
            held = 0
        out[-1].append(item)
        held += size
    return out


def indexes(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_block: int = ITEM_BLOCK) -> tuple[list[list[Index]], list[int]]:
    """The fitted indexes of each pass, of about ``item_block`` items or pieces, and the items' ids by number.

    Items without words or id are left out.
    """
    docs = docs.select(F.col(text_col).alias("text"))
    pdf = benchmark.select("item_id", "text").where("item_id IS NOT NULL").toPandas()
    items = [(int(i), n) for i, t in zip(pdf["item_id"], pdf["text"]) if len(n := names_of(t))]
    if not items:
        return [], []
    passes: list[list[tuple[int, np.ndarray]]] = [[]]
    for number, (_, n) in enumerate(items):
        if len(passes[-1]) >= item_block:
            passes.append([])
        passes[-1] += [(number, n[k : k + LONGEST]) for k in range(0, len(n), LONGEST)]
    df, total = document_frequencies(docs)
    idf = np.log((total + 1) / (df + 1)) + 0.1
    share = min(1.0, FIT_PASSAGES / 8 / max(total, 1))  # up to eight passages of each sampled document
    some = docs.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20))).select("text").persist()
    out = []
    for pieces in passes:
        out.append([Index(part, idf) for part in _spaces(pieces)])
        for index in out[-1]:
            _fit(index, some)
    some.unpersist()
    return out, [i for i, _ in items]


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, item_share, answer_share) of every item found in every row of ``docs``.

    Null and empty texts hold nothing; null ids are returned as such; a repeated row or
    item is reported as often as it stands; of an item of more than LONGEST words the piece
    found best is reported. Other columns are not read. An empty table on either side gives
    no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, item_id long, cosine double, item_share double, answer_share double"

    def search(part: list[Index]):
        def found(batches):
            for pdf in batches:
                rows = [(d, ids[k], *rest) for d, t in zip(pdf["doc_id"], pdf["text"]) for k, *rest in leaks_of(part, t)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "item_share", "answer_share"])

        return read.mapInPandas(released(found), schema)

    out = docs.sparkSession.createDataFrame([], schema)
    passes, ids = indexes(read, benchmark)
    for part in passes:
        out = out.unionByName(search(part))
    return out.withColumnRenamed("doc_id", id_col)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""

    def flag(part: list[Index]):
        def leaking(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([bool(leaks_of(part, t)) for t in texts], dtype=bool)
            release()

        return F.pandas_udf(leaking, "boolean", F.PandasUDFType.SCALAR_ITER)

    out = docs
    for part in indexes(docs, benchmark, text_col)[0]:
        name = free_name(out, "leaks")
        out = out.withColumn(name, flag(part)(F.col(text_col))).where(~F.col(name)).drop(name)
    return out

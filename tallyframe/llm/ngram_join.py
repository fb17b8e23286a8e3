"""Exact Jaccard join of documents' word shingles in metric space, and its components.

Jaccard distance is a metric, but between unrelated texts it is 1, so document pivots
alone would leave nearly all documents at distance 1 from every pivot, in one region.
The outer regions therefore belong to pivots that are single shingles:

* d(x, {s}) is 1 - 1/|x| for a shingle s of x and 1 for any other, so the nearest pivots
  of x are its own shingles; ties go to the pivot that comes first in one global order.
* If x and y are linked and s is their first common shingle, the i shingles of x before
  s are missing in y, so i/|x| <= d(x, y) <= 1 - t. Replicating x to the regions of its
  first |x| - ceil(t|x|) + 1 shingles (its window) makes every linked pair meet.
* In windows that are EXTRA |x| wider, linked documents meet in as many regions more
  (the j-th common shingle is at most j - 1 places beyond the window). A document that
  meets others in fewer regions has no link; that is the end for those that share a line
  or a passage with others, but not most of their text.

Any global order is right; shingles that are frequent in a sample come late, so that
shared passages make no large regions. The documents that are left join again,
recursively, with pivots ordered by their exact frequency among just these documents,
where a shingle that only one of them has counts as a step of the window but needs no
row. Inside the regions that remain, documents are the pivots: the member whose shingles
are shared most is compared with every other one, members beyond the threshold get a
second pivot, and of what neither pivot resolves, only pairs that the triangle inequality
over both pivots leaves open are compared.
Every comparison is an exact intersection, so links are neither missed nor made up (but
for collisions of 64-bit shingle names).

Documents with equal shingle sets are one class from the start, named by a 64-bit hash of
the set; a region that holds copies of one class only is dropped whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import Scratch, components, free_name, hash_bitmap, in_bitmap, released, window_hashes, word_hashes

WORDS = 5
PERCENT = 75
ORDER_SAMPLE = 8000  # documents whose shingles set the first order; it changes work, never results
ORDER_ENTRIES = 200_000
EXTRA = 0.08  # of a set's size, by which its window is widened


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingle names of a text, ascending; A-Z count as a-z, white space is ASCII."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = word_hashes(found)
    if len(found) < words:
        return window_hashes(h + np.uint64(len(found)), len(found))
    return np.unique(window_hashes(h, words))


def window_length(n: int, percent: int) -> int:
    """Shingles of a set of n whose regions it goes to: its window, widened by EXTRA."""
    return n - -(-percent * n // 100) + max(1, int(EXTRA * n))


def least_met(n: Column, percent: int) -> Column:
    """Regions in which a set of n meets each linked one: the smaller of both may have ceil(t n) shingles."""
    return F.greatest(F.lit(1), F.floor(EXTRA * F.ceil(percent * n / 100)))


def _sampled_order(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and counts of the shingles in several documents of a bounded sample, at most ORDER_ENTRIES of them."""
    total = docs.count()
    share = min(1.0, ORDER_SAMPLE / max(total, 1))
    part = docs.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def shingles(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["s"])

    counted = part.select("text").mapInArrow(shingles, "s long").groupBy("s").count().where("count > 2")
    pdf = counted.orderBy(F.desc("count"), "s").limit(ORDER_ENTRIES).toPandas()
    names, counts = pdf["s"].to_numpy(np.int64).view(np.uint64), pdf["count"].to_numpy(np.int64)
    at = np.argsort(names)
    return names[at], counts[at]


def _sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    names, counts = _sampled_order(docs, words)

    def sketch(batches):
        for batch in batches:
            n, cls, ends, prefixes = [], [], [0], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                cls.append(xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0)
                if len(s):
                    if len(names):
                        at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                        s = s[np.lexsort((s, np.where(names[at] == s, counts[at], 0)))]
                    prefixes.append(s[: window_length(len(s), percent)])
                    ends.append(ends[-1] + len(prefixes[-1]))
                else:
                    ends.append(ends[-1])
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.empty(0, np.int64)
            size = np.array(n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size),
                    pa.array(np.array(cls, np.uint64).view(np.int64), mask=size == 0),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["doc", "n", "cls", "prefix"],
            ).append_column("key", batch.column(2))

    return docs.mapInArrow(released(sketch), "doc long, n long, cls long, prefix array<long>, key long")


def _met_rows(sketches: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Rows (cls, n, doc, s) of the sketches with an id whose region is in the bitmap."""

    def met(batches):
        for batch in batches:
            size = np.diff(batch.column(3).offsets.to_numpy())
            s = batch.column(3).flatten().to_numpy()
            hit = in_bitmap(s, bitmap)
            columns = [np.repeat(batch.column(k).to_numpy(), size)[hit] for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, s[hit])], names=["cls", "n", "doc", "s"])

    given = sketches.where("cls IS NOT NULL AND doc IS NOT NULL").select("cls", "n", "doc", "prefix")
    return given.mapInArrow(met, "cls long, n long, doc long, s long")


def _sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """Shingle sets of the classes in ``members`` (cls, doc: one document of each)."""
    bitmap = hash_bitmap(members.select(F.xxhash64("doc").alias("slot")), "slot")

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(batch.column(2).to_numpy(), bitmap)))
            found = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            if not found:
                continue
            ends = np.cumsum([0, *map(len, found)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64))),
                ],
                names=["doc", "cls", "set"],
            )

    read = docs.where("doc IS NOT NULL").withColumn("slot", F.xxhash64("doc"))
    found = read.mapInArrow(released(sets), "doc long, cls long, set array<long>")
    return members.join(found, ["doc", "cls"]).dropDuplicates(["cls"])


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of classes with how many shingles they have in common and whether they are linked."""
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("set").alias(f"set_{c}"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    either = F.size("set_a") + F.size("set_b") - both
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .select("a", "b", both.alias("common"), either.alias("either"))
        .select("a", "b", "common", (100 * F.col("common") >= percent * F.col("either")).alias("linked"))
    )


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _regions(sets: DataFrame, percent: int) -> DataFrame:
    """Regions (g, cls, n, shared, rank, typ) of the classes of ``sets``, by exact frequency among them.

    shared counts the shingles of a class that others have, rank is the region's place among
    them, typ says how much others have them.
    """
    rows = sets.select("cls", F.size("set").cast("long").alias("n"), F.explode("set").alias("g"))
    rows = rows.join(rows.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "g")
    own = Window.partitionBy("cls")
    rows = rows.withColumn("shared", F.count("*").over(own)).withColumn(
        "typ", F.sum(F.log("df")).over(own) / F.col("n")
    )
    rank = F.row_number().over(own.orderBy("df", "g"))
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= length - F.col("n") + F.col("shared"))
    # Near copies share many regions with the same members; of each member set the first is enough.
    mark = rows.groupBy("g", "df").agg(F.count("*").alias("k"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("h"))
    one = mark.where("k > 1").groupBy("k", "h").agg(F.min(F.struct("df", "g"))["g"].alias("g")).select("g")
    return rows.join(one, "g").select("g", "cls", "n", "shared", "rank", "typ")


def _linked(scratch: Scratch, docs: DataFrame, sketches: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes with the components of all linked pairs: linked themselves, or a class and the least of its component."""
    rows = sketches.where("cls IS NOT NULL").select("cls", F.explode("prefix").alias("s"))
    met = rows.groupBy("s").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
    met = scratch.keep(met, "met")
    # Only rows that may lie in a region of several are dealt out and counted.
    meeting = _met_rows(sketches, hash_bitmap(met, "s")).join(met.select("s"), "s")
    meeting = meeting.groupBy("cls").agg(F.countDistinct("s").alias("k"), F.max("n").alias("n"), F.min("doc").alias("doc"))
    wanted = meeting.where(F.col("k") >= least_met(F.col("n"), percent)).select("cls", "doc")
    sets = scratch.keep(_sets(docs, scratch.keep(wanted, "members"), words), "sets")

    regions = scratch.keep(_regions(sets, percent), "regions")
    first = regions.groupBy("g").agg(F.max(F.struct("typ", "cls"))["cls"].alias("p"))
    spokes = regions.join(first, "g")
    todo = spokes.where("p <> cls").select(*_pair("p", "cls")).distinct()
    near = scratch.keep(_measured(todo, sets, percent), "near")

    far = spokes.where("p <> cls").select("g", "cls", "n", "shared", "rank", "typ", "p", *_pair("p", "cls")).join(near, ["a", "b"])
    far = far.select("g", "cls", "n", "shared", "rank", "typ", F.col("common").alias("i1"), F.col("linked").alias("l1"))
    open_ = far.groupBy("g").agg(F.count("*").alias("k"), F.max(F.when(~F.col("l1"), F.struct("typ", "cls")))["cls"].alias("p"))
    # Open: some member is not linked with the pivot, and there are others to link it with.
    rest = scratch.keep(far.join(open_.where("p IS NOT NULL AND k > 1"), "g"), "rest")
    if rest.isEmpty():
        return near.where("linked").select("a", "b")
    second = rest.where("p <> cls").select(*_pair("p", "cls")).distinct()
    near2 = scratch.keep(_measured(second, sets, percent), "near2")

    # What links are known already make components; only pairs across them are still of use.
    known = near.unionByName(near2).where("linked").select("a", "b")
    known = components(scratch, known, "known").withColumnRenamed("node", "cls")
    last = rest.where("p <> cls").select("*", *_pair("p", "cls")).join(near2, ["a", "b"]).join(known, "cls", "left")
    last = last.select("g", "cls", "n", "shared", "rank", "i1", F.col("common").alias("i2"), F.coalesce("component", "cls").alias("c"))
    several = last.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("g")
    last = scratch.keep(last.join(several, "g"), "last")
    stars = known.select(F.col("cls").alias("a"), F.col("component").alias("b"))
    if last.isEmpty():
        return stars
    x, y = last.alias("x"), last.alias("y")
    # x and y have at most min(|x & p|, |y & p|) shingles of a pivot p in common, and of the others at
    # most as many as the one with fewer shares with any document: the triangle inequality, made tight.
    most = F.least(*[F.least(f"x.{i}", f"y.{i}") + F.least(*[F.col(f"{s}.shared") - F.col(f"{s}.{i}") for s in "xy"]) for i in ("i1", "i2")])
    # If this is the first region that they share, they have none of the shingles before it in common.
    most = F.least(most, *[F.col(f"{s}.shared") - F.col(f"{s}.rank") + 1 for s in "xy"])
    third = (
        x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.c") != F.col("y.c"))
               & ((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))))
        .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    )
    third = scratch.keep(third, "third")
    return stars.unionByName(_measured(third, sets, percent).where("linked").select("a", "b"))


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, key: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id and class_id, and its text's xxhash64 if ``key`` names it.

    Two rows link when 100 * common shingles >= percent * all shingles of both;
    component_id is the smallest id reachable by links, class_id the smallest id with the
    same shingle set. A text that is null or has no words has no shingles and stays alone.
    Every row counts as a document, repeated rows too; rows with a null id are returned,
    with the component of their text (null if no row of it has an id). Other columns of
    ``docs`` are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    read = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    sketches = scratch.keep(_sketches(read.withColumn("key", F.xxhash64("text")), words, percent), "sketches")
    links = _linked(scratch, read, sketches, words, percent)
    found = components(scratch, links).withColumnRenamed("node", "cls")

    classes = sketches.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc").alias("class_id"))
    groups = classes.join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = groups.groupBy("component").agg(F.min("class_id").alias("component_id"))
    groups = scratch.keep(groups.join(least, "component").select("cls", "class_id", "component_id"), "groups")
    out = scratch.keep(
        sketches.select("doc", "n", "cls", "key").join(groups, "cls", "left").select(
            F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
            F.coalesce("component_id", "doc").alias("component_id"), F.coalesce("class_id", "doc").alias("class_id"),
            *([F.col("key").alias(key)] if key else []),
        ),
        "out",
    )
    scratch.drop(*[label for label in scratch.names if label != "out"])
    return out


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, without copies: of each group of linked rows, one with its smallest id.

    Rows without shingles link with nothing and all stay, as do rows with a null id,
    which no group can be named after. A row goes by its id and text, so another text that
    shares the id is judged on its own. Of repeated rows, one stays.
    """
    again = free_name(docs, "text_hash")
    keyed = docs.withColumn(again, F.xxhash64(F.col(text_col).cast("binary")))
    lost_id, lost_key = free_name(keyed, "lost"), free_name(keyed, "lost_text")
    joined = ngram_jaccard_join(docs.select(id_col, text_col), id_col, text_col, words, percent, key=lost_key)
    lost = joined.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias(lost_id), lost_key).distinct()
    kept = keyed.join(lost, (F.col(id_col).cast("long") == F.col(lost_id)) & (F.col(again) == F.col(lost_key)), "left_anti")
    # Rows of one id that all stay are copies of each other, or share the id by chance: equal texts are one.
    some = F.col(id_col).isNotNull() & F.coalesce(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    return kept.where(some).dropDuplicates([id_col, again]).unionByName(kept.where(~some)).drop(again)

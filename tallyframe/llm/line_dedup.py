"""Log-template tree: lines whose template recurs across documents are dropped.

Only DataFrame functions run here. A line's leaf in the tree is its token count and its
first LEAD tokens, with tokens that hold digits masked as variable fields (but not in
lines that are mostly such tokens). In leaves with
enough lines, the token that most lines have at a place is fixed if its share is at least
FIXED, else the place is variable; a line that agrees with the leaf's fixed tokens at
SIMILAR of its places has the leaf's template, any other line its own masked text.

A template recurs if it stands in at least MIN_CONTEXTS contexts (the lines before and
after) and in at least SPREAD as many as there are different texts that hold it. Exact
and near copies of one document repeat their lines in the same surroundings, so they do
not count as recurrence: they are left for the near-duplicate stage.
Lines within a block always have the same neighbours, so a template also recurs if it
stands in MIN_CONTEXTS different texts that are mostly their own: at most COMMON of such
a text is lines in leaves with enough lines, while copies consist of them.

All counts pre-aggregate before they are shuffled, so a line that stands in a third of
all documents is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Scratch, free_name

LEAD = 3
FIXED = 0.6
SIMILAR = 0.7
MIN_CONTEXTS = 10
SPREAD = 0.3
COMMON = 0.5


MAP_BITS = 1 << 19  # of the maps that spare rows a shuffle; 64 KB at any input size, as they stand in plans


def fields(line: Column) -> Column:
    """The line with each token that holds a digit as <*>."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(line)


def masked(line: Column) -> Column:
    """The line with its variable fields as <*>; as it is if these are more than half of it, which is no template."""
    found = fields(line)
    size = lambda x, part: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(part), F.lit("")))
    return F.when(2 * size(found, "<*>") / 3 <= size(line, " ") + 1, found).otherwise(line)


def leaf_of(line: Column) -> Column:
    """A hash of a line's token count and of its first tokens, masked. Tokens end at single blanks."""
    count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.xxhash64(count, fields(F.substring_index(line, " ", LEAD)))


def hash_map(df: DataFrame, column: str) -> Column:
    """A test, for a column of hashes, of a bitmap of ``df``'s hashes of fixed size.

    A set bit may be a chance hit, so what passes is joined exactly afterwards.
    """
    slot = F.pmod(F.col(column), F.lit(MAP_BITS)) + 1
    parts = df.select(F.bitmap_bucket_number(slot).alias("k"), F.bitmap_bit_position(slot).alias("bit"))
    bits = bytearray(MAP_BITS // 8)
    for k, part in parts.groupBy("k").agg(F.bitmap_construct_agg("bit")).collect():
        bits[(k - 1) * len(part) : k * len(part)] = part
    at = F.pmod(F.col(column), F.lit(MAP_BITS))
    byte = F.conv(F.hex(F.substring(F.lit(bytes(bits)), (F.expr(f"pmod({column}, {MAP_BITS})") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1


def _lines(texts: DataFrame) -> DataFrame:
    """(th, total, place, line, context) of the lines with tokens; th names the text, total is its length, context its neighbours."""
    parts = texts.select("th", F.octet_length("text").alias("total"), F.split("text", "\n", -1).alias("parts"))
    # F.get gives null beyond either end
    around = lambda i: F.xxhash64(F.get("parts", i - 1), F.get("parts", i + 1))
    placed = F.transform("parts", lambda x, i: F.struct(i.alias("place"), x.alias("line"), around(i).alias("context")))
    rows = parts.select("th", "total", F.explode(placed).alias("r"))
    return rows.select("th", "total", "r.place", F.trim("r.line").alias("line"), "r.context").where("line <> ''")


def recurring_lines(texts: DataFrame, scratch: Scratch, min_contexts: int = MIN_CONTEXTS, spread: float = SPREAD) -> DataFrame:
    """(th, places): the places of the lines to drop in each text, named by its hash."""
    every = texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).select(F.trim("line").alias("line")).where("line <> ''")
    # A line belongs to no recurring template if its leaf has too few lines.
    leaves = every.groupBy(leaf_of(F.col("line")).alias("leaf")).agg(F.count("*").alias("k"))
    leaves = scratch.keep(leaves.where(F.col("k") >= min_contexts).select("leaf"), "leaves")
    lines = _lines(texts).withColumn("leaf", leaf_of(F.col("line"))).where(hash_map(leaves, "leaf"))
    lines = lines.withColumn("masked", masked(F.col("line")))
    lines = lines.select("th", "total", F.octet_length("line").alias("size"), "place", "context", "leaf", F.xxhash64("masked").alias("h"), "masked")
    some = scratch.keep(lines.join(leaves, "leaf"), "lines")

    kinds = some.groupBy("leaf", "h").agg(F.count("*").alias("k"), F.min("masked").alias("masked"))
    kinds = scratch.keep(kinds, "kinds")
    tokens = kinds.select("leaf", "k", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    tokens = tokens.groupBy("leaf", "at", "token").agg(F.sum("k").alias("k"))
    places = tokens.groupBy("leaf", "at").agg(F.sum("k").alias("all"), F.max(F.struct("k", "token")).alias("top"))
    fixed = F.when(F.col("top.k") >= FIXED * F.col("all"), F.col("top.token"))
    template = places.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", fixed.alias("token")))).alias("template"))
    own = F.split("masked", " ")
    agree = F.size(F.filter(F.zip_with(own, "template", lambda x, t: F.coalesce(x == t["token"], F.lit(False))), lambda x: x))
    kinds = kinds.join(template, "leaf").select(
        "h", F.when(agree >= SIMILAR * F.size(own), F.col("leaf")).otherwise(F.col("h")).alias("cluster")
    )
    kinds = scratch.keep(kinds, "clusters")

    member = some.join(kinds, "h").select("th", "context", "cluster")
    # Only clusters with enough lines are counted, exactly: distinct rows of a cluster meet by
    # context and by text, so one that has a third of all lines spreads over all tasks.
    many = member.groupBy("cluster").agg(F.count("*").alias("k")).where(F.col("k") >= min_contexts).select("cluster")
    stats = member.join(many, "cluster").groupBy("cluster").agg(
        F.count_distinct("context").alias("contexts"), F.count_distinct("th").alias("texts")
    )
    again = stats.where((F.col("contexts") >= min_contexts) & (F.col("contexts") >= spread * F.col("texts"))).select("cluster")
    # Copies of a row have the same places, each counted once.
    once = some.groupBy("th", "place").agg(F.max("size").alias("size"), F.max("total").alias("total"))
    common = once.groupBy("th").agg(F.sum("size").alias("size"), F.max("total").alias("total"))
    own_texts = common.where(F.col("size") <= COMMON * F.col("total")).select("th")
    spread_out = member.join(many, "cluster").select("th", "cluster").distinct().join(own_texts, "th").groupBy("cluster").agg(F.count("*").alias("k"))
    again = again.unionByName(spread_out.where(F.col("k") >= min_contexts).select("cluster")).distinct()
    drop = kinds.join(again, "cluster").select("h")
    return some.join(drop, "h").groupBy("th").agg(F.collect_set("place").alias("places"))


def line_dedup(docs: DataFrame, text_col: str = "text", min_contexts: int = MIN_CONTEXTS, spread: float = SPREAD, count_col: str | None = None) -> DataFrame:
    """``docs`` with all its columns, the text without lines of recurring templates.

    Lines end at \\n; kept lines stay as they are and are joined by \\n again; blank lines
    are kept. A text that loses all its lines becomes empty, a null text stays null.
    Repeated rows are one text in the counts and are all cleaned. ``count_col`` adds the
    number of dropped lines. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # One row per different text in the counts: copies have the same name.
    drops = scratch.keep(recurring_lines(texts.select(F.xxhash64("text").alias("th"), "text"), scratch, min_contexts, spread), "drops")
    scratch.drop("leaves", "lines", "kinds", "clusters")
    th, places = free_name(docs, "text_hash"), free_name(docs, "dropped_places")
    named = docs.withColumn(th, F.xxhash64(F.col(text_col)))
    hit = F.coalesce(F.col(text_col).isNotNull() & hash_map(drops.select(F.col("th").alias(th)), th), F.lit(False))
    none = F.lit(None).cast("array<int>").alias(places)
    # Only texts that may lose lines are dealt out to meet their places, which grow with the input.
    found = named.where(~hit).select("*", none).unionByName(
        named.where(hit).join(drops.select(F.col("th").alias(th), F.col("places").alias(places)).hint("merge"), th, "left")
    )
    kept = F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains(places, i))
    out = found.withColumn(text_col, F.when(F.col(places).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if count_col:
        columns.append(F.coalesce(F.size(places), F.lit(0)).cast("long").alias(count_col))
    return out.select(*columns)

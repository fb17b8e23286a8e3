"""Extraction results: JSON text to typed columns, without Python row functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import MONEY, parse_number, sanitize_value, strip, strip_long

HEADER_FIELDS = ("vendor_name", "invoice_date", "currency", "total_amount")
LINE_FIELDS = ("description", "quantity", "unit_price", "total_price")  # the keys that rules and reports name


def strip_fences(text: Column) -> Column:
    """Trim, then drop code-fence marks."""
    bare = F.replace(F.replace(strip(text), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return F.when(text.contains("```"), bare).otherwise(strip_long(text))  # a replace is slow even where there is nothing to replace


def parse_payload(df: DataFrame, column: str = "payload") -> DataFrame:
    """Adds ``parsed`` (VARIANT, null when unreadable) and ``parse_status`` OK or FAILED.

    A document whose top level is not an object counts as unreadable.
    """
    text = F.col("_text")
    return (
        df.withColumn("_text", strip_fences(F.col(column)))
        .withColumn("_text", strip_long(text))
        .withColumn("parsed", F.when(text.startswith("{"), F.try_parse_json(text)))
        .withColumn("parse_status", F.when(F.col("parsed").isNull(), "FAILED").otherwise("OK"))
        .drop("_text")
    )


def _value_text(node: Column) -> Column:
    """Text of a value that is either bare or an object holding ``value``; an array as JSON."""
    wrapped = F.schema_of_variant(node).startswith("OBJECT")
    return F.when(wrapped, F.try_variant_get(node, "$.value", "string")).otherwise(F.try_variant_get(node, "$", "string"))


def flatten_header(df: DataFrame) -> DataFrame:
    """Adds the four header fields as text columns from ``parsed``."""
    return df.withColumns({f: _value_text(F.try_variant_get("parsed", f"$.{f}", "variant")) for f in HEADER_FIELDS})


def line_map(line: Column) -> Column:
    """All keys of a line, whatever they are, with unwrapped values: map<string,string>; null where a line is no object."""
    fields = F.try_variant_get(line, "$", "map<string,variant>")
    return F.transform_values(F.when(F.schema_of_variant(line).startswith("OBJECT"), fields), lambda _, v: _value_text(v))


def flatten_lines(df: DataFrame) -> DataFrame:
    """Adds ``line_items``: array<map<string,string>> from ``parsed``; absent or not an array gives null."""
    items = F.try_variant_get("parsed", "$.line_items", "array<variant>")
    return df.withColumn("line_items", F.transform(items, line_map))


def line_rows(df: DataFrame, *passed: str, items: Column | None = None) -> DataFrame:
    """One row per line: the ``passed`` columns, ``line_number`` and ``line`` (VARIANT).

    A line that knows its number (key ``line_number``) keeps it, so the lines of a result
    that is stored in several parts go on from part to part; any other is numbered by its
    place, from 1. No result's lines are gathered.
    """
    found = F.try_variant_get("parsed", "$.line_items", "array<variant>") if items is None else items
    # outer plus filter: a plain explode would have the payload parsed again to test its size
    rows = df.select(*passed, F.posexplode_outer(found).alias("_at", "line")).filter(F.col("_at").isNotNull())
    own = F.try_variant_get("line", "$.line_number", "long")
    return rows.select(*passed, F.coalesce(own, (F.col("_at") + 1).cast("long")).alias("line_number"), "line")


def whole_results(rows: DataFrame, key: str = "id", part: str = "part") -> DataFrame:
    """Rows of the parts of results to one row per result, of whatever size.

    A large result is stored in parts: the first holds the header fields, all hold lines
    (see ``line_rows``). Here every column keeps its first part's value; if any part is
    unreadable, the result is FAILED. Rows combine before they are shuffled.
    """
    values = [c for c in rows.columns if c not in (key, part, "parse_status")]
    bad = F.max(F.col("parse_status") == "FAILED")
    merged = rows.groupBy(key).agg(F.min_by(F.struct(*values), F.col(part)).alias("_first"), bad.alias("_bad"))
    status = F.when(F.col("_bad"), "FAILED").otherwise("OK")
    return merged.select(key, status.alias("parse_status"), *[F.col("_first")[c].alias(c) for c in values])


def _present(field: str) -> Column:
    """True when the key exists, even with a JSON null."""
    return F.try_variant_get("parsed", f"$.{field}", "variant").isNotNull()


def pick_confidence(df: DataFrame) -> DataFrame:
    """Adds ``confidence_score``: own key, else overall_confidence, else 0.0.

    The next choice is taken only where a key is absent; a JSON null stays null.
    """
    number = lambda f: F.try_variant_get("parsed", f"$.{f}", "double")
    return df.withColumn(
        "confidence_score",
        F.when(F.col("parsed").isNull(), F.lit(None))
        .when(_present("confidence_score"), number("confidence_score"))
        .when(_present("overall_confidence"), number("overall_confidence"))
        .otherwise(F.lit(0.0)),
    )


def explanation_map(df: DataFrame) -> DataFrame:
    """Adds ``ai_explanations`` as map<string,string> from ``parsed``."""
    return df.withColumn("ai_explanations", F.try_variant_get("parsed", "$.explanations", "map<string,string>"))


def keep_raw(df: DataFrame) -> DataFrame:
    """Adds ``ai_structured_output``: the nested JSON as read, beside the flat columns."""
    return df.withColumn("ai_structured_output", F.when(F.col("parsed").isNotNull(), F.to_json("parsed")))


def extract(df: DataFrame, column: str = "payload") -> DataFrame:
    """Whole chain: text to header fields, lines, confidence, explanations and nested copy."""
    out = parse_payload(df, column)
    return explanation_map(pick_confidence(flatten_lines(flatten_header(keep_raw(out)))))


def typed_header(df: DataFrame) -> DataFrame:
    """Adds ``amount`` as exact decimal beside the text total (null when not a finite number)."""
    return df.withColumn("amount", parse_number(F.col("total_amount")).try_cast(MONEY))


def content_key(content: Column) -> Column:
    """MD5 hex of the bytes: the key under which an extraction result is kept."""
    return F.md5(content)


def needs_extraction(documents: DataFrame, results: DataFrame) -> DataFrame:
    """One row per distinct content that has no successful result yet: (content_key, doc_id).

    Contents are reduced to their hash before any shuffle. Failed results do not count,
    so those documents come back.
    """
    done = results.filter(F.col("parse_status") == "OK").select("content_key").distinct()
    return (
        documents.select("doc_id", content_key(F.col("content")).alias("content_key"))
        .groupBy("content_key")
        .agg(F.min("doc_id").alias("doc_id"))
        .join(done, "content_key", "left_anti")
    )


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every column, at any depth."""
    return df.select(*[sanitize_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def explanations_long(df: DataFrame) -> DataFrame:
    """(id, field, explanation) with readable field names."""
    # outer plus filter: a plain explode would have the map parsed again to test its size
    rows = df.select("id", F.explode_outer("ai_explanations").alias("name", "explanation"))
    return rows.filter(F.col("name").isNotNull()).select(
        "id", F.initcap(F.replace(F.col("name"), F.lit("_"), F.lit(" "))).alias("field"), "explanation"
    )


_FROM_NEW = (
    "vendor_name", "invoice_date", "currency", "total_amount", "confidence_score",
    "ai_raw_data", "ai_structured_output", "ai_explanations",
)


def apply_reprocessed(current: DataFrame, new: DataFrame, version: str, at: Column) -> DataFrame:
    """New extraction results onto stored invoices with the same document hash.

    ``new`` holds one row per document_hash. Extracted fields are replaced, all other
    columns (id, stage, creator, processing status) stay; version and time are stamped.
    Invoices without a new result pass through unchanged.
    """
    taken = [c for c in _FROM_NEW if c in current.columns and c in new.columns]
    fresh = new.select("document_hash", *[F.col(c).alias(f"new_{c}") for c in taken], F.lit(True).alias("is_new"))
    joined = current.join(fresh, "document_hash", "left")
    changes = {c: F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in taken}
    changes["ai_version"] = F.when(F.col("is_new"), F.lit(version)).otherwise(F.col("ai_version"))
    changes["reprocessed_at"] = F.when(F.col("is_new"), at).otherwise(F.col("reprocessed_at"))
    return joined.withColumns(changes).select(*current.columns)


CURRENT_FIELDS = (
    "id", "created_by", "approval_stage", "reviewed_by", "approved_by", "approval_timestamp", "processing_status",
    "document_hash", "risk_level", "risk_score", "flag_reason", "confidence_score", "ai_version",
)


def hydrate(df: DataFrame, default_version: str) -> DataFrame:
    """Stored JSON (``ai_raw_data``) overlaid with the current columns, which win: one row per invoice.

    Columns other than the raw text pass through; a missing version falls back to the given
    one. With a column ``part``, ``df`` has a row per part of the stored JSON. The lines of
    an invoice are rows of their own, see ``line_rows``.
    """
    parsed = flatten_header(parse_payload(df.drop(*HEADER_FIELDS), "ai_raw_data"))
    version = F.when(F.col("ai_version") != "", F.col("ai_version")).otherwise(F.lit(default_version))
    passed = [c for c in df.columns if c not in (*CURRENT_FIELDS, *HEADER_FIELDS, "ai_raw_data", "part")]
    rows = parsed.withColumn("ai_version", version)
    if "part" not in df.columns:
        return rows.select(*CURRENT_FIELDS, *HEADER_FIELDS, *passed)
    whole = whole_results(rows.select("part", "parse_status", *CURRENT_FIELDS, *HEADER_FIELDS, *passed))
    read = F.col("parse_status") == "OK"
    return whole.select(*CURRENT_FIELDS, *[F.when(read, F.col(f)).alias(f) for f in HEADER_FIELDS], *passed)

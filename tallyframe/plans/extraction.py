"""Queries for extraction results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import extraction as ops
from tallyframe.plans.fixture_sql import with_tables
from tallyframe.plans.registry import query
from tallyframe.plans.tables import as_of, with_workflow_columns
from tallyframe.sources import derived


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    inv = derived.invoices(spark, sf)
    return derived.payloads(inv, derived.lines(spark, sf))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return ops.parse_payload(_payloads(spark, sf))


def _whole(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per result of any size."""
    return ops.whole_results(rows.select("id", "part", "parse_status", *columns))


# the payloads as they are written: keys in their order, no digit dropped, lines in parts
_RAW = {
    "raw_line": r"""
SELECT invoice_id, (line_number - 1) // 10000 AS part, line_number, concat('{"line_number":', line_number, ',"description":', g(CAST(to_json(description) AS varchar)),
  ',"quantity":', g(CAST(quantity AS varchar)), ',"unit_price":', g(CAST(unit_price AS varchar)), ',"total_price":', g(CAST(total_price AS varchar)),
  ',"sku":', g(concat('"L-', invoice_id, '-', line_number, '"')), '}') AS line FROM (SELECT *, invoice_id % 7 = 0 AS bare FROM lines) l""",
    "raw_part": """
SELECT invoice_id, part, string_agg(line, ',' ORDER BY line_number) AS items FROM raw_line GROUP BY invoice_id, part""",
    "raw_payload": r"""
SELECT id, coalesce(part, 0) AS part, src_key, concat('{', CASE WHEN coalesce(part, 0) = 0 THEN concat('"vendor_name":', g(CAST(to_json(vendor_name) AS varchar)),
    ',"invoice_date":', g(CAST(to_json(invoice_date) AS varchar)), ',"currency":', g(CAST(to_json(currency) AS varchar)), ',"total_amount":', g(CAST(total_amount AS varchar)), ',') ELSE '' END,
  '"line_items":[', coalesce(items, ''), ']', CASE WHEN coalesce(part, 0) = 0 THEN concat(CASE WHEN src_key % 17 = 0 THEN ',"overall_confidence":null'
    WHEN src_key % 19 <> 0 THEN concat(',"overall_confidence":', CAST(confidence_score AS varchar)) ELSE '' END,
    ',"explanations":{"vendor_name":"Top left","invoice_date":"Next to label","total_amount":"Last line"},"layout":{"page":{"area":{"corner":{"top":{"left":{"x":', src_key % 100, '}}}}}}') ELSE '' END, '}') AS text
FROM (SELECT *, src_key % 7 = 0 AS bare FROM inv) i LEFT JOIN raw_part ON invoice_id = src_key""",
}


def _raw_tables() -> dict[str, str]:
    """``g(value)``: the value as it is, or as {value, confidence}; null text counts as null."""
    out = {}
    for name, body in _RAW.items():
        while (at := body.find(" g(")) >= 0:
            end, depth = at + 3, 1
            while depth:
                depth += {"(": 1, ")": -1}.get(body[end], 0)
                end += 1
            value = f"coalesce({body[at + 3 : end - 1]}, 'null')"
            body = f"""{body[:at]} CASE WHEN bare THEN {value} ELSE concat('{{"value":', {value}, ',"confidence":0.9}}') END{body[end:]}"""
        out[name] = body
    return out


@query(
    "strip_fences",
    with_tables(
        """SELECT 'conversation' AS source, conv_id AS id, CAST(turn AS bigint) AS part, replace(replace(regexp_replace(concat('  ```json', chr(10), text, chr(10), '``` '), '^\\s+|\\s+$', '', 'g'), '```json', ''), '```', '') AS payload
FROM conversations
UNION ALL SELECT 'invoice', id, part, CASE WHEN src_key % 53 = 0 THEN concat('{', text) WHEN src_key % 11 = 0 THEN concat(chr(10), text, chr(10)) ELSE text END FROM raw_payload""",
        **_raw_tables(),
    ),
)
def _strip(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.concat(F.lit("  ```json\n"), "text", F.lit("\n``` "))
    turns = derived.table(spark, sf, "conversations").select(
        F.lit("conversation").alias("source"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("part"), ops.strip_fences(answer).alias("payload")
    )
    results = _payloads(spark, sf).select(F.lit("invoice").alias("source"), "id", "part", ops.strip_fences(F.col("payload")).alias("payload"))
    return turns.unionByName(results)


@query("parse_payload", with_tables("SELECT id, CASE WHEN bad THEN 'FAILED' ELSE 'OK' END AS parse_status FROM payload"))
def _parse(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(_parsed(spark, sf).withColumn("read", F.col("parsed").isNotNull()), "read").select("id", "parse_status")


@query(
    "flatten_header",
    with_tables(
        """SELECT id, CASE WHEN NOT bad THEN vendor_name END AS vendor_name, CASE WHEN NOT bad THEN invoice_date END AS invoice_date,
  CASE WHEN NOT bad THEN currency END AS currency, CASE WHEN NOT bad THEN CAST(total_amount AS double) END AS amount FROM payload"""
    ),
)
def _header(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.typed_header(_whole(ops.flatten_header(_parsed(spark, sf)), *ops.HEADER_FIELDS))
    return out.select("id", "vendor_name", "invoice_date", "currency", F.col("amount").cast("double").alias("amount"))


@query(
    "flatten_lines",
    with_tables(
        """SELECT inv.id, line_number, t.field, t.value FROM inv JOIN lines ON invoice_id = src_key,
  LATERAL (VALUES ('line_number', CAST(line_number AS varchar)), ('description', description), ('quantity', regexp_replace(CAST(quantity AS varchar), '\\.?0+$', '')),
    ('unit_price', regexp_replace(CAST(unit_price AS varchar), '\\.?0+$', '')), ('total_price', regexp_replace(CAST(total_price AS varchar), '\\.?0+$', '')),
    ('sku', concat('L-', invoice_id, '-', line_number))) t(field, value) WHERE src_key % 53 <> 0"""
    ),
)
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.line_rows(_parsed(spark, sf), "id")
    fields = rows.select("id", "line_number", F.explode_outer(ops.line_map(F.col("line"))).alias("field", "value"))
    return fields.filter(F.col("field").isNotNull())


@query(
    "pick_confidence",
    with_tables(
        """SELECT id, CASE WHEN bad OR src_key % 17 = 0 THEN NULL WHEN src_key % 19 = 0 THEN 0.0::double ELSE confidence_score END AS confidence_score
FROM payload"""
    ),
)
def _confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(ops.pick_confidence(_parsed(spark, sf)), "confidence_score").select("id", "confidence_score")


@query("keep_raw", with_tables("SELECT id, CASE WHEN NOT bad THEN json END AS ai_structured_output FROM payload"))
def _raw(spark: SparkSession, sf: str) -> DataFrame:
    # the copy of a result in several parts has as many rows
    return ops.keep_raw(_parsed(spark, sf)).select("id", "ai_structured_output")


@query(
    "needs_extraction",
    """SELECT md5(text) AS content_key, min(doc_id) AS doc_id FROM documents GROUP BY text
HAVING min(doc_id) % 2 = 0 OR min(doc_id) % 53 = 0""",
)
def _needs(spark: SparkSession, sf: str) -> DataFrame:
    docs = derived.table(spark, sf, "documents")
    done = ops.parse_payload(derived.mail_payloads(docs.filter("doc_id % 2 = 1 OR doc_id % 53 = 0")))
    # results exist for texts whose first copy has an odd doc_id; the truncated ones among them failed
    firsts = docs.groupBy(F.md5(F.col("text").cast("binary")).alias("content_key")).agg(F.min("doc_id").alias("d"))
    done = done.join(firsts.filter("d % 2 = 1 AND d % 53 <> 0"), "content_key", "left_semi")
    return ops.needs_extraction(docs.select("doc_id", F.col("text").cast("binary").alias("content")), done)


@query(
    "sanitize",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS score, CASE WHEN event_id % 3 <> 1 THEN value END AS list_value,
  CASE WHEN event_id % 5 <> 0 THEN value END AS struct_value, CASE WHEN event_id % 7 <> 0 THEN value END AS map_value FROM events""",
)
def _sanitize(spark: SparkSession, sf: str) -> DataFrame:
    n, v = F.col("event_id"), F.col("value")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    spoiled = derived.table(spark, sf, "events").select(
        "event_id",
        F.when(n % 3 == 0, v).when(n % 3 == 1, nan).otherwise(-inf).alias("score"),
        F.array(F.when(n % 3 != 1, v).otherwise(inf)).alias("list"),
        F.struct(F.when(n % 5 != 0, v).otherwise(nan).alias("x")).alias("deep"),
        F.create_map(F.lit("k"), F.when(n % 7 != 0, v).otherwise(nan)).alias("map"),
    )
    return ops.sanitize(spoiled).select(
        "event_id",
        "score",
        F.col("list")[0].alias("list_value"),
        F.col("deep.x").alias("struct_value"),
        F.col("map")["k"].alias("map_value"),
    )


@query(
    "explanations_long",
    with_tables(
        """SELECT id, t.field, t.explanation FROM payload, (VALUES ('Vendor Name', 'Top left'), ('Invoice Date', 'Next to label'), ('Total Amount', 'Last line')) t(field, explanation)
WHERE NOT bad"""
    ),
)
def _explanations(spark: SparkSession, sf: str) -> DataFrame:
    return ops.explanations_long(_whole(ops.explanation_map(_parsed(spark, sf)), "ai_explanations"))


@query(
    "apply_reprocessed",
    with_tables(
        """SELECT id, approval_stage, created_by, CASE WHEN src_key % 8 = 0 THEN concat(vendor_name, ' v2') ELSE vendor_name END AS vendor_name,
  CASE WHEN src_key % 8 = 0 THEN 0.99::double ELSE confidence_score END AS confidence_score,
  CASE WHEN src_key % 8 = 0 THEN 'v2' ELSE 'v1' END AS ai_version,
  CASE WHEN src_key % 8 = 0 THEN TIMESTAMP '2001-08-05 00:00:00' WHEN src_key % 97 = 0 THEN created_at + INTERVAL '20' DAY END AS reprocessed_at FROM inv"""
    ),
)
def _reprocessed(spark: SparkSession, sf: str) -> DataFrame:
    inv = with_workflow_columns(derived.invoices(spark, sf))
    new = (
        inv.filter("src_key % 8 = 0")
        .groupBy("document_hash")
        .agg(F.concat(F.min("vendor_name"), F.lit(" v2")).alias("vendor_name"))
        .withColumn("confidence_score", F.lit(0.99))
    )
    out = ops.apply_reprocessed(inv, new, "v2", as_of())
    return out.select("id", "approval_stage", "created_by", "vendor_name", "confidence_score", "ai_version", "reprocessed_at")


@query(
    "hydrate",
    with_tables(
        """SELECT id, CASE WHEN NOT bad THEN vendor_name END AS vendor_name, CASE WHEN NOT bad THEN currency END AS currency, created_by, approval_stage,
  approval_timestamp, processing_status, document_hash, confidence_score, 'v2' AS ai_version FROM payload"""
    ),
)
def _hydrate(spark: SparkSession, sf: str) -> DataFrame:
    inv = with_workflow_columns(derived.invoices(spark, sf)).withColumns(
        {"ai_version": F.lit(""), "risk_level": F.lit("LOW"), "risk_score": F.lit(0), "flag_reason": F.lit(None).cast("string")}
    )
    rows = derived.payloads(inv, derived.lines(spark, sf)).withColumnRenamed("payload", "ai_raw_data")
    return ops.hydrate(rows, "v2").select(
        "id", "vendor_name", "currency", "created_by", "approval_stage", "approval_timestamp", "processing_status",
        "document_hash", "confidence_score", "ai_version",
    )

"""Invoice-shaped tables computed from the supplied order, part, event and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.columns import MONEY
from tallyframe.functions.ranking import number_rows
from tallyframe.session import stored

RESUBMITTED = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, base: int, values: list[str], other: str) -> Column:
    chain = F.when(key % base == 0, values[0])
    for i, v in enumerate(values[1:], start=1):
        chain = chain.when(key % base == i, v)
    return chain.otherwise(other)


def line_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(invoice_id, total_price) only: what sums need, without the part join or numbering."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_extendedprice").cast(MONEY).alias("total_price")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines with their parts' texts, worked out and written once: none of the shuffles for it lives on."""
    parts = table(spark, sf_dir, "part")
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    numbered = number_rows(
        items,
        "l_orderkey",
        ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
        "line_number",
    )
    part_text = parts.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_retailprice")
    found = numbered.join(part_text, "l_partkey").select(
        F.col("l_orderkey").alias("invoice_id"),
        "line_number",
        F.when(F.col("l_partkey") % 31 == 0, "").otherwise(F.col("p_name")).alias("description"),
        F.when(F.col("l_partkey") % 47 == 0, 0.0).otherwise(F.col("l_quantity")).alias("quantity"),
        F.col("p_retailprice").cast(MONEY).alias("unit_price"),
        F.col("l_extendedprice").cast(MONEY).alias("total_price"),
    )
    return stored(found, "lines")


def invoice_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``invoices`` without vendor and amounts, for queries that need neither: no line scan, no joins."""
    orders = table(spark, sf_dir, "orders")
    unused = {"line_sum": F.lit(None).cast("decimal(28,2)"), "s_name": F.lit(None).cast("string")}
    return _invoice_rows(orders.withColumns(unused)).drop("vendor_name", "total_amount")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = (
        line_amounts(spark, sf_dir)
        .groupBy(F.col("invoice_id").alias("o_orderkey"))
        .agg(F.sum("total_price").alias("line_sum"))
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    supplier_count = suppliers.select(F.count(F.lit(1))).scalar()
    orders = table(spark, sf_dir, "orders").withColumn("s_suppkey", F.col("o_custkey") % supplier_count)
    return _invoice_rows(orders.join(sums, "o_orderkey", "left").join(suppliers, "s_suppkey", "left"))


def _invoice_rows(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    stage = (
        F.when(F.col("o_orderstatus") == "O", "UPLOADED")
        .when(F.col("o_orderstatus") == "P", "REVIEWED")
        .when(F.col("o_orderpriority") == "1-URGENT", "REJECTED")
        .when(F.col("o_orderpriority") == "2-HIGH", "AUDITED")
        .otherwise("APPROVED")
    )
    total = (
        F.when(key % 41 == 0, F.lit(0).cast(MONEY))
        .when(F.col("line_sum").isNull() | (key % 4 == 3), F.col("o_totalprice").cast(MONEY))
        .when(key % 4 == 2, F.col("line_sum") + F.lit("0.50").cast(MONEY))
        .otherwise(F.col("line_sum"))
    )
    currencies = ["USD", "EUR", "GBP", "INR", "AED", "SGD", "AUD", "CAD", "JPY", "CNY", "brl", ""]
    base = orders.select(
        key.alias("id"),
        F.col("s_name").alias("vendor_name"),
        F.when(key % 23 == 0, "unknown")
        .otherwise(F.col("o_orderdate").cast("date").cast("string"))
        .alias("invoice_date"),
        total.cast(MONEY).alias("total_amount"),
        _pick(F.col("o_custkey"), 13, currencies, " usd ").alias("currency"),
        ((F.lit(50) + (key * 7) % 51).cast("double") / 100).alias("confidence_score"),
        stage.alias("approval_stage"),
        F.when(key % 3 == 0, "MAIL_BOT").otherwise("AP_CLERK").alias("created_by"),
        F.when(key % 3 == 0, "INGESTED_EMAIL")
        .when(key % 33 == 1, "reingested")
        .when(key % 3 == 1, "MANUAL_UPLOAD")
        .otherwise("COMPLETED")
        .alias("processing_status"),
        F.col("o_orderdate").alias("created_at"),
        key.alias("src_key"),
    )
    # A resubmission is the same row again with three fields changed: one pass, no second join.
    twice = base.withColumn(
        "copy", F.explode(F.when(F.col("id") % 29 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    again = F.col("copy") == 1
    rows = twice.select(
        F.when(again, F.col("id") + RESUBMITTED).otherwise(F.col("id")).alias("id"),
        "vendor_name",
        "invoice_date",
        "total_amount",
        "currency",
        "confidence_score",
        F.when(again, "UPLOADED").otherwise(F.col("approval_stage")).alias("approval_stage"),
        "created_by",
        "processing_status",
        F.when(again, F.col("created_at") + F.expr("INTERVAL '10' DAY"))
        .otherwise(F.col("created_at"))
        .alias("created_at"),
        "src_key",
    )
    approved_at = F.col("created_at") + F.expr("INTERVAL '1' HOUR * (1 + src_key % 96)")
    document = F.when(F.col("src_key") % 58 == 0, F.col("src_key")).otherwise(F.col("id"))
    return rows.withColumns(
        {
            "approval_timestamp": F.when(F.col("approval_stage") == "APPROVED", approved_at),
            "document_key": F.concat(F.lit("doc-"), document.cast("string")),
        }
    ).withColumn("document_hash", F.sha2(F.col("document_key").cast("binary"), 256))


def approvals(inv: DataFrame) -> DataFrame:
    """One approval event per invoice that was ever approved (audited ones were)."""
    return inv.filter(F.col("approval_stage").isin("APPROVED", "AUDITED")).select(
        "id",
        "vendor_name",
        "total_amount",
        "invoice_date",
        (F.col("created_at") + F.expr("INTERVAL '1' HOUR * (1 + src_key % 96)")).alias("approved_at"),
    )


def edits(inv: DataFrame) -> DataFrame:
    return inv.filter((F.col("src_key") % 5 == 0) & (F.col("approval_stage") != "UPLOADED")).select(
        F.col("id").alias("invoice_id"),
        F.lit("Total").alias("field_name"),
        F.col("total_amount").cast("string").alias("old_value"),
        (F.col("total_amount") + 10).cast(MONEY).cast("string").alias("new_value"),
        (F.col("created_at") + F.expr("INTERVAL '1' DAY")).alias("edited_at"),
    )


def audits(inv: DataFrame) -> DataFrame:
    return inv.filter(F.col("approval_stage") == "AUDITED").select(
        F.col("id").alias("invoice_id"),
        F.lit("AUDITOR").alias("audited_by"),
        F.lit("Auditor Verified").alias("audit_note"),
        (F.col("created_at") + F.expr("INTERVAL '5' DAY")).alias("audited_at"),
    )


def request_columns(events: DataFrame) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    matching = (
        F.when(kind.isin("signup", "view"), "AP_CLERK").when(kind == "purchase", "AUDITOR").otherwise("FINANCE_MANAGER")
    )
    other = (
        F.when(n % 8 == 1, "AP_CLERK").when(n % 8 == 3, "FINANCE_MANAGER").when(n % 8 == 5, "AUDITOR").otherwise("MAIL_BOT")
    )
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("invoice_id"),
        F.when(kind == "signup", "UPLOADED")
        .when(kind == "view", "REVIEWED")
        .when(kind == "click", "APPROVED")
        .when(kind == "purchase", "AUDITED")
        .otherwise("REJECTED")
        .alias("next_stage"),
        F.when(n % 2 == 0, matching).otherwise(other).alias("user_role"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_columns(table(spark, sf_dir, "events"))


def flat_messages(docs: DataFrame) -> DataFrame:
    n = F.col("doc_id")
    number = n.cast("string")
    return docs.select(
        n.alias("message_id"),
        F.concat("source", F.lit("@vendor.example")).alias("sender"),
        F.when(n % 5 == 0, "Weekly newsletter").otherwise(F.concat(F.lit("Invoice "), number)).alias("subject"),
        F.concat(
            F.lit("file_"),
            number,
            F.when(n % 4 == 0, ".pdf").when(n % 4 == 1, ".PNG").when(n % 4 == 2, ".txt").otherwise(".docx"),
        ).alias("filename"),
        F.when(n % 4 == 0, "application/pdf")
        .when(n % 8 == 3, "image/jpeg")
        .otherwise("application/octet-stream")
        .alias("mime_type"),
        F.col("text").alias("content"),
    )


def raw_messages(docs: DataFrame) -> DataFrame:
    """(message_id, raw bytes): the flat row written as a mail message with its attachment.

    Every third subject is sent as an encoded header word. Every sixth message carries the
    same content a second time, as a part of type PDF.
    """
    flat = flat_messages(docs)
    number = F.col("message_id").cast("string")
    word = F.concat(F.lit("=?utf-8?B?"), F.base64(F.col("subject").cast("binary")), F.lit("?="))
    subject = F.when(F.col("message_id") % 3 == 0, word).otherwise(F.col("subject"))
    head = F.concat(F.lit("From: Billing <"), "sender", F.lit(">\r\nSubject: "), subject, F.lit("\r\nMIME-Version: 1.0\r\n"))
    part = lambda mime, name: F.concat(
        F.lit("Content-Type: "), mime, F.lit('\r\nContent-Disposition: attachment; filename="'), name,
        F.lit('"\r\nContent-Transfer-Encoding: base64\r\n\r\n'), F.base64(F.col("content").cast("binary")),
    )
    first, second = part(F.col("mime_type"), F.col("filename")), part(F.lit("application/pdf"), F.concat(F.lit("copy_"), number, F.lit(".pdf")))
    border = F.concat(F.lit("\r\n--part-"), number)
    several = F.concat(
        head, F.lit('Content-Type: multipart/mixed; boundary="part-'), number, F.lit('"\r\n'), border, F.lit("\r\n"), first, border,
        F.lit("\r\n"), second, border, F.lit("--\r\n"),
    )
    raw = F.when(F.col("message_id") % 6 == 0, several).otherwise(F.concat(head, first))
    return flat.select("message_id", raw.cast("binary").alias("raw"))


def raw_headers(inv: DataFrame) -> DataFrame:
    """Invoice header fields as unchecked text, with some spoiled."""
    k = F.col("src_key")
    return inv.select(
        "id",
        "src_key",
        F.when(k % 61 == 0, F.lit(None).cast("string"))
        .when(k % 67 == 0, " ")
        .otherwise(F.col("vendor_name"))
        .alias("vendor_name"),
        "invoice_date",
        F.when(k % 37 == 0, "N/A")
        .when(k % 43 == 0, "NaN")
        .when(k % 59 == 0, "-5.00")
        .otherwise(F.col("total_amount").cast("string"))
        .alias("total_amount"),
        "currency",
    )


def _field(value: Column, confidence: float) -> Column:
    return F.struct(value.alias("value"), F.lit(confidence).alias("confidence"))


def _payload_text(rows: DataFrame, header: dict[str, Column], items: Column, names: dict[str, str], bare: Column, extra: dict[str, Column], first: Column) -> DataFrame:
    """Adds ``_text``: JSON with each field bare or as {value, confidence}; a line's number is always bare.

    ``names`` gives the fields of a line with their types; where ``first`` does not hold there
    are lines only. Each piece of text is worked out once, in a step of its own: written into
    one expression, they make code too long for Java to compile.
    """
    keep = {"ignoreNullFields": "false"}
    own = lambda x: [x["line_number"].alias("line_number")] if "line_number" in names else []
    deep_items = F.transform(items, lambda x: F.struct(*own(x), *[_field(x[n], 0.9).alias(n) for n in names if n != "line_number"]))
    pieces = rows.withColumn("_items", F.when(bare, F.to_json(items, keep)).otherwise(F.to_json(deep_items, keep)))
    flat = F.to_json(F.struct(*[c.alias(k) for k, c in header.items()]), keep)
    deep = F.to_json(F.struct(*[_field(c, 0.9).alias(k) for k, c in header.items()]), keep)
    pieces = pieces.withColumn("_head", F.when(first, F.when(bare, flat).otherwise(deep)))
    tail = F.concat(*[F.when(c.isNotNull(), F.concat(F.lit(f',"{k}":'), c)).otherwise("") for k, c in extra.items()])
    head = F.when(first, F.concat(F.left("_head", F.length("_head") - 1), F.lit(","))).otherwise("{")
    text = F.concat(head, F.lit('"line_items":'), "_items", F.when(first, tail).otherwise(""), F.lit("}"))
    return pieces.withColumn("_text", text).drop("_items", "_head")


def _wrap(text: Column, fenced: Column, spoiled: Column) -> Column:
    """Some texts in a code fence, some with a stray brace before them, which makes them unreadable."""
    before = F.when(spoiled, "{").when(fenced, " ```json\n").otherwise("")
    return F.concat(before, text, F.when(fenced & ~spoiled, "\n``` ").otherwise(""))


PART_LINES = 10_000  # lines in a part of an extraction result
_LINE = {
    "line_number": "bigint", "description": "string", "quantity": "double", "unit_price": "decimal(18,2)",
    "total_price": "decimal(18,2)", "sku": "string",
}


def payloads(inv: DataFrame, items: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """Extraction text per invoice: the columns of ``inv`` and (part, payload).

    A result is one part unless it has more than ``part_lines`` lines; then the lines follow
    in order in further parts, which repeat no header. Every line carries its number, so
    what the parts give together does not depend on how they are cut.
    """
    # Lines meet by the key that the invoices meet them by, so they are shuffled once, and their sku is added behind that.
    held = [n for n in _LINE if n != "sku"]
    cut = (
        items.withColumn("part", F.floor((F.col("line_number") - 1) / part_lines))
        .repartition("invoice_id")
        .groupBy(F.col("invoice_id").alias("src_key"), "part")
        .agg(F.sort_array(F.collect_list(F.struct(*held))).alias("part_lines"))
    )
    sku = lambda x: F.concat(F.lit("L-"), "src_key", F.lit("-"), x["line_number"])
    cut = cut.withColumn("part_lines", F.transform("part_lines", lambda x: F.struct(*[x[n].alias(n) for n in held], sku(x).alias("sku"))))
    rows = inv.join(cut, "src_key", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    empty = F.expr("CAST(array() AS array<struct<" + ",".join(f"{n}:{t}" for n, t in _LINE.items()) + ">>)")
    listed = F.coalesce("part_lines", empty)
    k = F.col("src_key")
    header = {c: F.col(c) for c in ("vendor_name", "invoice_date", "currency", "total_amount")}
    extra = {
        "overall_confidence": F.when(k % 17 == 0, "null").when(k % 19 != 0, F.col("confidence_score").cast("string")),
        "explanations": F.lit('{"vendor_name":"Top left","invoice_date":"Next to label","total_amount":"Last line"}'),
        "layout": F.concat(F.lit('{"page":{"area":{"corner":{"top":{"left":{"x":'), (k % 100).cast("string"), F.lit("}}}}}}")),
    }
    texts = _payload_text(rows, header, listed, _LINE, k % 7 == 0, extra, F.col("part") == 0)
    return texts.select(*inv.columns, "part", _wrap(F.col("_text"), k % 11 == 0, k % 53 == 0).alias("payload"))


def mail_payloads(docs: DataFrame) -> DataFrame:
    """One extraction result per distinct document text: (content_key, document_hash, payload).

    The fields follow from the lowest doc_id of the text and from its length.
    """
    per_text = (
        docs.select("doc_id", "n_chars", F.col("text").cast("binary").alias("content"))
        .select("doc_id", "n_chars", F.sha2("content", 256).alias("document_hash"), F.md5("content").alias("content_key"))
        .groupBy("document_hash", "content_key")
        .agg(F.min(F.struct("doc_id", "n_chars")).alias("first"))
    )
    n = F.col("first.doc_id")
    amount = (F.lit(100) + n % 40).cast(MONEY)
    half = (amount / 2).cast(MONEY)
    line = lambda text, price: F.struct(
        text.alias("description"), F.lit(1.0).alias("quantity"), price.alias("unit_price"), price.alias("total_price")
    )
    items = F.array(
        line(F.when(n % 6 == 0, "").otherwise(F.lit("service")), half),
        line(F.lit("goods"), F.when(n % 9 == 0, half + 5).otherwise(half).cast(MONEY)),
    )
    header = {
        "vendor_name": F.concat(F.lit("Vendor "), (n % 8).cast("string")),
        "invoice_date": F.when(n % 23 == 0, "unknown").otherwise(F.concat(F.lit("2024-01-"), (F.lit(10) + n % 5).cast("string"))),
        "currency": F.when(n % 10 == 0, "brl").otherwise(F.lit("USD")),
        "total_amount": amount,
    }
    names = {"description": "string", "quantity": "double", "unit_price": MONEY, "total_price": MONEY}
    texts = _payload_text(per_text, header, items, names, n % 7 == 0, {"overall_confidence": F.lit("0.8")}, F.lit(True))
    return texts.select("content_key", "document_hash", _wrap(F.col("_text"), n % 11 == 0, n % 53 == 0).alias("payload"))

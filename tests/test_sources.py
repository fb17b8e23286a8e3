"""Files, stored tables, messages and sinks."""

from __future__ import annotations

import base64
import json
import math

import pytest
from pyspark.sql import functions as F

from tallyframe import schemas, session
from tallyframe.config import MailRules
from tallyframe.operators import extraction, mail, reports, risk, workflow
from tallyframe.sources import sinks, stores
from tallyframe.streaming import jobs

NOW = "TIMESTAMP_NTZ '2024-01-02 03:04:05'"

MIXED = (
    "From: =?utf-8?B?" + base64.b64encode("Zoé".encode()).decode() + "?= <Bills@Shop.example>\r\n"
    "Subject: =?iso-8859-1?Q?R=E9sum=E9?= of bills\r\nMIME-Version: 1.0\r\n"
    'Content-Type: multipart/mixed; boundary="b"\r\n\r\n'
    "--b\r\nContent-Type: text/plain\r\n\r\nhello\r\n"
    '--b\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="a 1.pdf"\r\nContent-Transfer-Encoding: base64\r\n\r\nUERG\r\n'
    '--b\r\nContent-Type: application/zip\r\nContent-Disposition: attachment; filename="z.zip"\r\n\r\nzzz\r\n'
    '--b\r\nContent-Type: image/png; name="empty.png"\r\nContent-Disposition: inline\r\n\r\n\r\n'
    '--b\r\nContent-Type: image/png; name="big.png"\r\n\r\n' + "x" * 50 + "\r\n"
    '--b\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename="c.JPEG"\r\n\r\nccc\r\n'
    "--b--\r\n"
).encode()
PLAIN = b"From: a@b.example\r\nSubject: no parts\r\n\r\nbody\r\n"


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(
        [(1, bytearray(MIXED)), (2, bytearray(PLAIN)), (3, None)], "message_id long, raw binary"
    )


def test_message_parts(messages):
    rows = mail.parse_messages(messages).orderBy("message_id", "part_no").collect()
    first = [r for r in rows if r.message_id == 1]
    assert {(r.sender, r.subject) for r in first} == {("Bills@Shop.example", "Résumé of bills")}
    assert [(r.part_no, r.filename) for r in first] == [(0, "a 1.pdf"), (1, "z.zip"), (2, "empty.png"), (3, "big.png"), (4, "c.JPEG")]
    assert bytes(first[0].content) == b"PDF"
    assert [r.part_status for r in rows if r.message_id > 1] == ["NO_ATTACHMENT", "UNREADABLE"]


def test_screening_and_counters(messages, spark):
    rules = MailRules(senders=("bills@shop.example", "A@B.example"), max_bytes=20)
    screened = mail.screen(mail.parse_messages(messages), rules, F.expr(NOW)).cache()
    kept = screened.filter("kept").orderBy("idx").collect()
    assert [r.storage_path for r in kept] == ["mail/20240102/msg_1_0_a_1.pdf", "mail/20240102/msg_1_1_c.JPEG"]
    key = "vendor_name string, invoice_date string, total_amount long"
    results = spark.createDataFrame([(kept[0].content_key, "OK", "v", "d", 1)], f"content_key string, parse_status string, {key}")
    stored = spark.createDataFrame([], f"document_hash string, {key}")
    outcomes = mail.ingest_outcome(screened.filter("kept"), results, stored).cache()
    summary = mail.ingest_status(mail.ingest_summary(screened, outcomes)).first().asDict()
    assert summary == {
        "messages_scanned": 3, "attachments_found": 2, "messages_with_attachments": 1, "ingested": 1, "duplicates": 0,
        "failed": 2, "skipped_sender": 0, "skipped_subject": 0, "skipped_by_type": 1, "skipped_by_size": 1,
        "errors": 2, "status": "PARTIAL",
    }
    assert mail.ingest_errors(screened, outcomes).count() == 2


def test_filters_off_pass_everything(messages):
    screened = mail.screen(mail.parse_messages(messages), MailRules(max_bytes=0), F.expr(NOW))
    assert screened.filter("kept").count() == 3


@pytest.mark.parametrize(
    ("errors", "ingested", "failed", "status"),
    [(1, 0, 1, "FAILED"), (1, 1, 1, "PARTIAL"), (0, 1, 1, "PARTIAL"), (0, 0, 1, "PARTIAL"), (0, 0, 0, "SUCCESS")],
)
def test_run_status(spark, errors, ingested, failed, status):
    df = spark.createDataFrame([(errors, ingested, failed)], "errors long, ingested long, failed long")
    assert mail.ingest_status(df).first().status == status


def test_documents_and_messages_from_files(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF", "sub/b.PNG": b"x", "c.jpg": b"y", "d.txt": b"no"}.items():
        file = tmp_path / "docs" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    docs = stores.scan_documents(spark, str(tmp_path / "docs"))
    got = {(r.file_name, r.extension, r.size_bytes) for r in docs.collect()}
    assert got == {("a.pdf", "pdf", 4), ("b.PNG", "png", 1), ("c.jpg", "jpg", 1)}
    box = tmp_path / "box"
    box.mkdir()
    (box / "7.eml").write_bytes(PLAIN)
    (box / "x.eml").write_bytes(PLAIN)
    raw = stores.scan_messages(spark, str(box)).filter("message_id IS NOT NULL")
    assert raw.schema["message_id"].dataType == mail.parse_messages(raw).schema["message_id"].dataType
    assert [(r.message_id, r.subject) for r in mail.parse_messages(raw).collect()] == [(7, "no parts")]


def test_texts_written_as_files_are_scanned_like_files(spark, tmp_path):
    rows = spark.createDataFrame([("a b/1.PDF", "é"), ("c.txt", "no"), ("d.png", "two\nlines")], "name string, content string")
    sinks.write_text_files(rows, f"{tmp_path}/docs")
    got = {(r.file_name, r.extension, bytes(r.content)) for r in stores.scan_documents(spark, f"{tmp_path}/docs").collect()}
    assert got == {("a b/1.PDF", "pdf", "é\n".encode()), ("d.png", "png", b"two\nlines\n")}


def test_many_texts_lie_in_few_files(spark, tmp_path):
    rows = spark.range(500).selectExpr("concat('n', id, '.eml') AS name", "concat(repeat('é', CAST(id AS int)), '\\r\\n b') AS content")
    odd = spark.createDataFrame([("n7.EML", "x"), ("n7.EML", None), (None, "lost"), ("big.eml", "y" * 6_000_000)], "name string, content string")
    sinks.write_text_files(rows.unionByName(odd), f"{tmp_path}/box")
    (tmp_path / "box" / "alone.eml").write_bytes(b"\xff\x00")
    assert len([f for f in (tmp_path / "box").rglob("*.txt")]) <= 3
    found = stores._files(spark, f"{tmp_path}/box", ("eml",)).collect()
    want = {f"n{i}.eml": ("é" * i + "\r\n b\n").encode() for i in range(500)}
    want |= {"n7.EML": b"\nx\n", "big.eml": b"y" * 6_000_000 + b"\n", "alone.eml": b"\xff\x00"}
    assert {r.name: bytes(r.content) for r in found} == want and len(found) == len(want)
    assert len({r.path for r in found}) == len(want)


def test_deep_payloads_take_few_passes(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(reports, "stored", lambda df, name: passes.append(name) or df)
    text = '{"a":{"b":{"c":{"d":{"e":{"f":[{"g":1}]}}},"n":null,"":{"x":2}}},"s":"{}","o":{}}'
    df = spark.createDataFrame([(1, text), (2, "no"), (3, None)], "id long, ai_raw_data string")
    got = {(r.invoice_id, r.path): r.value for r in reports.ai_flattened_long(df).collect()}
    assert got == {(1, "a.b.c.d.e.f"): '[{"g":1}]', (1, "a.b.n"): None, (1, "a.b..x"): "2", (1, "s"): "{}"}
    assert len(passes) == 2


def test_intake_stream_sees_each_message_once(spark, messages, tmp_path):
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    messages.coalesce(1).write.parquet(source)
    run = lambda: jobs.stream_intake(jobs.table_stream(spark, source), MailRules(), F.expr(NOW), out, mark)
    run()
    messages.filter("message_id = 1").withColumn("message_id", F.lit(9).cast("long")).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    got = jobs.batches(spark, f"{out}/attachments").filter("kept").groupBy("message_id").count().collect()
    assert {r.message_id: r["count"] for r in got} == {1: 3, 9: 3}


def test_schema_check(spark):
    with pytest.raises(ValueError, match="edited_at"):
        schemas.conform(spark.range(1).selectExpr("id AS invoice_id", "'a' AS field_name", "'b' AS old_value", "'c' AS new_value"), schemas.EDITS)


def test_stored_tables_scan_in_display_order(spark, tmp_path):
    rows = spark.sql(
        "SELECT * FROM VALUES (1L, 'A', 'x', 'y', TIMESTAMP_NTZ '2024-01-01'), (2L, 'A', 'x', 'y', TIMESTAMP_NTZ '2024-01-03') t(invoice_id, field_name, old_value, new_value, edited_at)"
    )
    schemas.conform(rows, schemas.EDITS).write.parquet(f"{tmp_path}/invoice_edits")
    assert [r.invoice_id for r in stores.scan_edits(spark, str(tmp_path)).collect()] == [2, 1]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_versions_and_refusals(spark, tmp_path):
    table = sinks.InvoiceTable(spark, f"{tmp_path}/inv")
    assert table.create(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), buckets=4) == 1
    changes = spark.createDataFrame(
        [(2, "B", False), (3, "c", True), (9, "z", False), (1, "again", True)], "id long, v string, is_new boolean"
    )
    version, refused = table.upsert(changes)
    assert version == 2 and rows_of(refused) == [(1, "again"), (9, "z")]
    assert rows_of(table.read()) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows_of(table.read(version=1)) == [(1, "a"), (2, "b")]
    assert table.versions() == [1, 2]
    none = changes.limit(0)
    assert table.upsert(none)[0] == 3 and rows_of(table.read()) == [(1, "a"), (2, "B"), (3, "c")]


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    table = sinks.InvoiceTable(spark, f"{tmp_path}/inv")
    table.create(spark.range(200).withColumn("v", F.lit("old")), buckets=8)
    before = set(table.read().inputFiles())
    table.upsert(spark.createDataFrame([(7, "new", False)], "id long, v string, is_new boolean"))
    after = set(table.read().inputFiles())
    assert len(before - after) == 1 and len(after - before) == 1
    assert table.read().filter("v = 'new'").count() == 1 and table.read().count() == 200


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    table, other = (sinks.InvoiceTable(spark, f"{tmp_path}/inv") for _ in range(2))
    table.create(spark.createDataFrame([(1, "a")], "id long, v string"))
    change = lambda v: spark.createDataFrame([(1, v, False)], "id long, v string, is_new boolean")
    assert table.upsert(change("first"), base=1)[0] == 2
    with pytest.raises(sinks.VersionTaken):
        other.upsert(change("second"), base=1)
    assert rows_of(other.read()) == [(1, "first")] and other.upsert(change("second"))[0] == 3
    assert rows_of(table.read()) == [(1, "second")]


def test_log_appends_and_prunes(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS invoice_id, explode(array(TIMESTAMP_NTZ '2024-01-01 05:00:00', TIMESTAMP_NTZ '2024-01-02 06:00:00')) AS edited_at")
    path = f"{tmp_path}/log"
    for run in ("run-1", "run-2", "run-2", "run-1"):  # a run that is repeated adds nothing
        sinks.append_log(rows, path, "edited_at", run)
    day = spark.read.parquet(path).filter("log_date = DATE '2024-01-02'")
    assert day.count() == 2
    assert "PartitionFilters: [isnotnull(log_date" in day._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_are_read_by_period(spark, tmp_path):
    rows = spark.sql(
        "SELECT id AS invoice_id, 'A' AS audited_by, 'n' AS audit_note, TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(id) AS audited_at FROM range(100)"
    )
    sinks.write_table(rows, str(tmp_path), "invoice_audits", schemas.AUDITS, "audited_at")
    assert [r.invoice_id for r in stores.scan_audits(spark, str(tmp_path)).collect()] == list(range(99, -1, -1))
    some = stores.scan_audits(spark, str(tmp_path), since="2024-02-10", until="2024-02-12")
    assert [r.invoice_id for r in some.collect()] == [41, 40]
    assert "(month#" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_outbox_text(spark):
    df = spark.createDataFrame([(1, None)], "id long, vendor_name string")
    assert json.loads(sinks.crm_outbox(df, "DELETE").first().value) == {
        "event": "DELETE", "source": "INVOICE_CONTROL", "invoice": {"id": 1, "vendor_name": None},
    }


def test_outbox_files_are_compressed(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.lit("a vendor").alias("vendor_name"))
    sinks.write_outbox(rows, f"{tmp_path}/outbox")
    files = list((tmp_path / "outbox").glob("part-*"))
    text = [r.value for r in sinks.crm_outbox(rows).collect()]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/outbox").collect()) == sorted(text)
    assert sum(f.stat().st_size for f in files) * 5 < sum(map(len, text))


def test_scores_by_row_equal_those_of_one_plan(spark):
    invoices = spark.createDataFrame(
        [(1, "a", "d", 5, 0.9, 7), (1, "a", "d", 5, 0.6, 7), (None, None, "d", 4, None, None), (2, "b", None, None, 0.9, 8), (3, "b", "d", 9, 0.9, 9)],
        "id long, vendor_name string, invoice_date string, total_amount long, confidence_score double, src_key long",
    ).withColumn("total_amount", F.col("total_amount").cast("decimal(18,2)"))
    lines = spark.sql("SELECT * FROM VALUES (7L, 5BD), (8L, 1BD), (NULL, 4BD) AS t(invoice_id, total_price)")
    vendors = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", 6.0)], "vendor_name string, avg_invoice_value double")
    plain = risk.score_invoices(invoices, lines, vendors, "src_key")
    given = session.stored(invoices.withColumn("place", F.monotonically_increasing_id()), "given")
    by_row = risk.score_invoices(given, lines, vendors, "src_key", row="place")
    assert by_row.columns == plain.columns
    assert sorted(map(str, by_row.collect())) == sorted(map(str, plain.collect())) and plain.count() == 7


def test_sanitize_at_any_depth(spark):
    nan, inf = math.nan, math.inf
    df = spark.createDataFrame(
        [(nan, [1.0, inf], {"k": -inf, "j": 2.0}, ([(nan, "t")],), "text")],
        "a double, b array<double>, c map<string,double>, d struct<x:array<struct<y:double,z:string>>>, e string",
    )
    row = extraction.sanitize(df).first()
    assert (row.a, row.b, row.c, row.d.x[0].y, row.d.x[0].z, row.e) == (None, [1.0, None], {"k": None, "j": 2.0}, None, "t", "text")


def test_long_lines_fall_back_to_the_structured_copy(spark):
    raw = '{"line_items": [{"description": "a", "quantity": 2, "sku": "s", "tax": {"value": 7}}, "loose text"]}'
    deep = '{"line_items": [{"description": {"value": "b", "confidence": 1}}]}'
    df = spark.createDataFrame(
        [(1, "v", raw, deep), (2, "v", '{"line_items": []}', deep), (3, "v", None, None)],
        "id long, vendor_name string, ai_raw_data string, ai_structured_output string",
    )
    got = [tuple(r) for r in reports.line_items_long(df).orderBy("invoice_id", "line_number").collect()]
    assert got[0] == (1, "v", 1, "a", "2", None, None, {"sku": "s", "tax": '{"value":7}'})
    assert got[1] == (1, "v", 2, "loose text", None, None, None, None)
    assert got[2][:3] == (2, "v", 1) and json.loads(got[2][3]) == {"value": "b", "confidence": 1}
    assert len(got) == 3


DEEP = '{"a": {"b": {"c": {"d": {"e": {"f": {"g": 1, "h": [{"x": {"y": 2}}]}}}}}}, "n": null, "l": [1, 2], "s": "x", "none": {}}'


def test_flattened_payload_opens_every_level(spark):
    df = spark.createDataFrame([(1, DEEP), (2, "[1]"), (3, None), (4, "{broken"), (5, '{"s": {"t": true}}')], "id long, ai_raw_data string")
    got = {(r.invoice_id, r.path): r.value for r in reports.ai_flattened_long(df).collect()}
    leaves = {"a.b.c.d.e.f.g": "1", "a.b.c.d.e.f.h": '[{"x":{"y":2}}]', "n": None, "l": "[1,2]", "s": "x"}
    assert got == {(1, p): v for p, v in leaves.items()} | {(5, "s.t"): "true"}
    wide = {r["invoice_id"]: r.asDict() for r in reports.ai_flattened(df).collect()}
    assert set(wide) == {1, 2, 3, 4, 5} and list(wide[1]) == ["invoice_id", *sorted([*leaves, "s.t"])]
    assert wide[1] == {"invoice_id": 1, "s.t": None, **leaves} and wide[5]["s.t"] == "true" and set(wide[3].values()) == {3, None}


def test_flattened_payload_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "id long, ai_raw_data string")
    assert reports.ai_flattened_long(df).count() == 0
    assert [tuple(r) for r in reports.ai_flattened(df).collect()] == [(1,)]


def test_record_defaults_only_where_absent(spark):
    absent = workflow.invoice_record(spark.range(1), "AP_CLERK").first()
    assert (absent.processing_status, absent.confidence_score, absent.risk_level, absent.approval_stage) == ("COMPLETED", 0.0, "LOW", "UPLOADED")
    assert (absent.created_by, absent.audited) == ("AP_CLERK", False)
    null = workflow.invoice_record(spark.sql("SELECT CAST(NULL AS STRING) AS created_by, CAST(NULL AS STRING) AS approval_stage"), "AP_CLERK").first()
    assert (null.created_by, null.approval_stage, null.audited) == (None, None, False)


def test_edit_log(spark):
    schema = "id long, vendor_name string, total_amount decimal(18,2), invoice_date string"
    before = spark.createDataFrame([(1, "a", None, "d"), (2, "b", None, None)], schema)
    after = spark.createDataFrame([(1, "A", None, None), (2, "b", None, None)], schema)
    line = "invoice_id long, line_number long, description string, quantity double, unit_price double, total_price double"
    old = spark.createDataFrame([(1, 1, "x", 1.0, 1.0, 1.0), (2, 1, "x", None, 1.0, 1.0)], line)
    new = spark.createDataFrame([(1, 1, "x", 1.0, 1.0, 1.0), (1, 2, "y", 1.0, 1.0, 1.0), (2, 1, "x", None, 1.0, 1.0), (3, 1, "n", 1.0, 1.0, 1.0)], line)
    log = workflow.edit_diff(before, after, F.expr(NOW), workflow.changed_lines(old, new))
    assert sorted((r.invoice_id, r.field_name, r.old_value, r.new_value) for r in log.collect()) == [
        (1, "Date", "d", "None"), (1, "Line Items", "Original AI Table", "User Modified Table"), (1, "Vendor", "a", "A"),
    ]


def test_payloads_of_one_id_become_one_row(spark):
    rows = [(1, '{"a": {"b": 1}, "c": null}'), (1, '{"c": "x", "a.b": 2}'), (2, '{"a": {}}'), (2, None), (None, '{"a": 5}'), (None, '{"d": 6}'), (3, '{"c": [1]}')]
    wide = reports.ai_flattened(spark.createDataFrame(rows, "id long, ai_raw_data string"))
    got = {r["invoice_id"]: r.asDict() for r in wide.collect()}
    assert wide.columns == ["invoice_id", "a", "a.b", "c", "d"] and wide.count() == 4
    assert got[1].pop("a.b") in ("1", "2") and got[1] == {"invoice_id": 1, "a": None, "c": "x", "d": None}
    assert got[3]["c"] == "[1]" and set(got[2].values()) == {2, None} and set(got[None].values()) == {None}


def test_payloads_deeper_than_a_pass_keep_one_row(spark):
    deep = '{"k": ' * 20 + '{"x": 1, "y": {}}' + "}" * 20
    wide = reports.ai_flattened(spark.createDataFrame([(1, deep), (2, '{"x": [{"k": 1}]}')], "id long, ai_raw_data string"))
    path = "k." * 20 + "x"
    assert wide.columns == ["invoice_id", path, "x"]
    assert sorted(map(tuple, wide.collect())) == [(1, "1", None), (2, None, '[{"k":1}]')]

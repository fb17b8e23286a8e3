"""Rule tables and edge values of validation, risk and workflow."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from tallyframe.config import STAGES
from tallyframe.functions.columns import parse_iso_date, parse_number
from tallyframe.operators import extraction, mail, metrics, risk, validation, workflow
from tallyframe.sources import derived

ALLOWED = {
    ("new", "UPLOADED"): {"MAIL_BOT", "AP_CLERK"},
    ("new", "REVIEWED"): {"AP_CLERK"},
    ("UPLOADED", "UPLOADED"): {"AP_CLERK"},
    ("UPLOADED", "REVIEWED"): {"AP_CLERK"},
    ("REVIEWED", "REVIEWED"): {"AP_CLERK", "FINANCE_MANAGER"},
    ("REVIEWED", "APPROVED"): {"FINANCE_MANAGER"},
    ("REVIEWED", "REJECTED"): {"FINANCE_MANAGER"},
    ("APPROVED", "APPROVED"): {"FINANCE_MANAGER"},
    ("APPROVED", "AUDITED"): {"AUDITOR"},
    ("AUDITED", "AUDITED"): {"AUDITOR"},
}
ROLES = ("AP_CLERK", "FINANCE_MANAGER", "AUDITOR", "MAIL_BOT")


def test_every_cell_of_the_stage_matrix(spark):
    cells = list(itertools.product(("new", *STAGES), STAGES, ROLES))
    rows = [(i, p == "new", None if p == "new" else p, n, r) for i, (p, n, r) in enumerate(cells)]
    df = spark.createDataFrame(rows, "i int, is_new boolean, previous_stage string, next_stage string, user_role string")
    got = {r.i: r.allowed for r in workflow.transition_allowed(df).collect()}
    assert len(cells) == 120
    assert sum(got.values()) == 12
    for i, (p, n, r) in enumerate(cells):
        assert got[i] == (r in ALLOWED.get((p, n), set())), (p, n, r)


def test_stage_matrix_folds_case_and_treats_null_stage_as_uploaded(spark):
    df = spark.createDataFrame(
        [(False, None, "reviewed", "ap_clerk"), (False, None, None, "AP_CLERK"), (False, "UPLOADED", "REVIEWED", None)],
        "is_new boolean, previous_stage string, next_stage string, user_role string",
    )
    assert [r.allowed for r in workflow.transition_allowed(df).collect()] == [True, True, False]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("12", 12.0), (" 12 ", 12.0), ("1e3", 1000.0), ("1_000", 1000.0), (".5", 0.5), ("5.", 5.0), ("-5.00", -5.0),
        ("inf", float("inf")), ("-Infinity", float("-inf")), ("N/A", None), ("", None), (None, None),
        ("1.0d", None), ("1f", None), ("0x10", None), ("1__0", None), ("_1", None), ("1,000", None), ("12 3", None),
    ],
)
def test_number_text(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_number(F.col("t"))).first()[0] == value


def test_nan_text_is_a_number(spark):
    assert spark.sql("SELECT 'nan' AS t").select(F.isnan(parse_number(F.col("t")))).first()[0]


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        ("2024-01-05", True), ("2024-1-5", True), ("2024-02-30", False), ("2024-01-05T00:00:00", False),
        ("20240-01-05", False), ("2024-001-05", False), ("05/01/2024", False), ("", False), (None, False),
    ],
)
def test_date_text(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_iso_date(F.col("t")).isNotNull()).first()[0] == ok


LINE = "array<struct<description:string,quantity:string,unit_price:string,total_price:string>>"
GOOD = ("thing", "1", "10", "10")
BAD_DATE = "Invalid invoice date format (expected YYYY-MM-DD)"
MISMATCH = "Line-item total mismatch against invoice total"

CASES = [
    (("V", "2024-01-05", "10", "usd", [GOOD]), []),
    (("", "2024-01-05", "10", "USD", [GOOD]), ["Missing vendor name"]),
    ((None, "2024-01-05", "10", "USD", [GOOD]), ["Missing vendor name"]),
    ((" ", "2024-01-05", "10", "USD", [GOOD]), []),
    (("V", "bad", "10", "USD", [GOOD]), [BAD_DATE]),
    (("V", "2024-01-05", "0", "USD", [GOOD]), ["Invoice total must be greater than zero"]),
    (("V", "2024-01-05", "x", "USD", [GOOD]), ["Invalid invoice total amount"]),
    (("V", "2024-01-05", None, "USD", [GOOD]), ["Invalid invoice total amount"]),
    (("V", "2024-01-05", "nan", "USD", [GOOD]), []),
    (("V", "2024-01-05", "inf", "USD", [GOOD]), [MISMATCH]),
    (("V", "2024-01-05", "10", "\tbrl ", [GOOD]), ["Unsupported currency: BRL"]),
    (("V", "2024-01-05", "10", "  ", [GOOD]), []),
    (("V", "2024-01-05", "10", None, [GOOD]), []),
    (("V", "2024-01-05", "10", "USD", []), ["No line items extracted"]),
    (("V", "2024-01-05", "10", "USD", None), ["No line items extracted"]),
    (("V", "2024-01-05", "11", "USD", [GOOD]), []),
    (("V", "2024-01-05", "11.01", "USD", [GOOD]), [MISMATCH]),
    (("V", "2024-01-05", "10", "USD", [(" \n", "1", "10", "10")]), ["Line 1: Missing description"]),
    (("V", "2024-01-05", "10", "USD", [GOOD, ("a", "0", "-1", "0")]),
     ["Line 2: Quantity must be greater than zero", "Line 2: Unit price cannot be negative"]),
    (("V", "2024-01-05", "10", "USD", [GOOD, ("a", "x", None, "y")]),
     ["Line 2: Invalid quantity", "Line 2: Invalid unit price", "Line 2: Invalid total price"]),
    (("V", "2024-01-05", "10", "USD", [("a", "1", "1", "-5"), ("b", "1", "1", "15")]), ["Line 1: Total price cannot be negative"]),
    (("V", "2024-01-05", "10", "USD", [("a", "1", "1", "nan")]), []),
    (("V", "2024-01-05", "10", "USD", [("a", "nan", "nan", "10")]), []),
    ((None, "x", "-1", "abc", []),
     ["Missing vendor name", BAD_DATE, "Invoice total must be greater than zero", "Unsupported currency: ABC", "No line items extracted"]),
]


@pytest.fixture(scope="module")
def compliance_input(spark):
    rows = [(i, *values) for i, (values, _) in enumerate(CASES)]
    schema = f"id long, vendor_name string, invoice_date string, total_amount string, currency string, line_items {LINE}"
    return spark.createDataFrame(rows, schema)


def test_compliance_issue_lists(compliance_input):
    out = validation.compliance_verdict(validation.compliance_issues(compliance_input)).collect()
    for row in out:
        expected = CASES[row.id][1]
        assert row.issues == expected, CASES[row.id]
        assert row.issue_count == len(expected)
        assert row.compliant == (not expected)


def test_issue_rows_of_a_line_table_equal_the_array_form(compliance_input):
    lines = compliance_input.select(F.col("id").alias("invoice_id"), F.posexplode("line_items").alias("pos", "x")).select(
        "invoice_id", (F.col("pos") + 1).cast("long").alias("line_number"), "x.*"
    )
    rows = validation.compliance_issue_rows(compliance_input.drop("line_items"), lines).collect()
    order = ["C1", "C2", "C3", "C4", "C5", "C7", "C8", "C9", "C10", "C11", "C12", "C6", "C13"]
    for i, (_, expected) in enumerate(CASES):
        mine = sorted((r for r in rows if r.id == i), key=lambda r: (r.section, r.line_number, order.index(r.rule)))
        assert [r.issue for r in mine] == expected


def test_math_validation_edges(spark):
    inv = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 0)], "id long, total int").select(
        "id", F.col("total").cast("decimal(18,2)").alias("total_amount")
    )
    lines = spark.sql(
        "SELECT * FROM VALUES (1L, 10.00BD), (2L, 9.99BD), (4L, CAST(NULL AS decimal(18,2))) t(invoice_id, total_price)"
    )
    got = {r.id: (r.math_valid, float(r.line_sum), float(r.difference)) for r in validation.math_validation(inv, lines).collect()}
    assert got == {1: (True, 10.0, 0.0), 2: (False, 9.99, 0.01), 3: (False, 0.0, 10.0), 4: (True, 0.0, 0.0)}


def test_risk_edges(spark):
    # (confidence, math ok, duplicate, total, average) -> score, level, status
    cases = [
        ((0.70, True, False, 200.0, 100.0), 0, "LOW", "Verified"),
        ((0.69, True, False, 200.01, 100.0), 45, "MEDIUM", "Verified"),
        ((0.9, False, False, 1.0, None), 30, "MEDIUM", "Flagged"),
        ((0.5, True, True, 1.0, 0.0), 60, "HIGH", "Flagged"),
        ((0.9, True, True, 500.0, 0.0), 40, "MEDIUM", "Verified"),
        ((None, True, False, 1.0, 1.0), 0, "LOW", "Verified"),
        ((0.1, False, True, 500.0, 1.0), 115, "HIGH", "Flagged"),
    ]
    rows = [(i, *c[0], f"v{i}") for i, c in enumerate(cases)]
    df = spark.createDataFrame(
        rows, "id long, confidence_score double, math_valid boolean, duplicate_key boolean, total double, avg double, vendor_name string"
    ).select("*", F.col("total").cast("decimal(18,2)").alias("total_amount"), F.lit(5).cast("decimal(28,2)").alias("difference"))
    vendors = df.select("vendor_name", F.col("avg").alias("avg_invoice_value"))
    scored = risk.validation_status(risk.risk_level(risk.risk_reasons(risk.risk_score(risk.vendor_anomaly(df, vendors)))))
    for r in scored.collect():
        assert (r.risk_score, r.risk_level, r.status) == cases[r.id][1:], r
    worst = scored.filter("id = 6").first()
    assert worst.risk_reasons == [
        "Low AI Confidence (10%)", "Math Mismatch (Diff: 5.00)", "Duplicate Invoice Detected", "Amount > 2x Vendor Avg ($1.00)",
    ]
    assert scored.filter("id = 2").first().flag_reason == "Math Mismatch"


def test_percent_truncates(spark):
    df = spark.sql("SELECT 0.57D AS confidence_score, true AS math_valid, false AS duplicate_key, false AS anomaly, 1D AS vendor_avg, 0BD AS difference")
    assert risk.risk_reasons(df).first().risk_reasons == ["Low AI Confidence (56%)"]


def test_days_and_sla_edges(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, 'REVIEWED', TIMESTAMP_NTZ '2024-01-01 00:00:00'), (2, 'REVIEWED', TIMESTAMP_NTZ '2023-12-31 23:59:59'),
        (3, 'APPROVED', TIMESTAMP_NTZ '2020-01-01 00:00:00'), (4, 'REJECTED', TIMESTAMP_NTZ '2023-12-01 00:00:00'),
        (5, 'REVIEWED', TIMESTAMP_NTZ '2024-01-05 00:00:01'), (6, 'REVIEWED', CAST(NULL AS TIMESTAMP_NTZ)),
        (7, 'REVIEWED', TIMESTAMP_NTZ '2023-12-31 00:00:00') t(id, approval_stage, created_at)"""
    )
    now = F.expr("TIMESTAMP_NTZ '2024-01-04 23:59:59'")
    got = {r.id: (r.days_pending, r.sla_status) for r in metrics.sla_status(df, now).collect()}
    assert got == {
        1: (3, "On Track"), 2: (4, "BREACH"), 3: (0, "On Track"), 4: (34, "BREACH"),
        5: (-1, "On Track"), 6: (None, "On Track"), 7: (4, "BREACH"),
    }
    assert sorted(r.id for r in metrics.sla_breaches(df, now).collect()) == [2, 7]


def test_audit_queue_takes_unknown_as_not_audited(spark):
    df = spark.sql(
        """SELECT *, TIMESTAMP_NTZ '2024-01-01' AS created_at FROM VALUES (1, 'APPROVED', NULL), (2, 'APPROVED', false),
        (3, 'APPROVED', true), (4, 'AUDITED', true), (5, 'REVIEWED', false) t(id, approval_stage, audited)"""
    )
    assert [(r.id, r.section) for r in metrics.audit_queue(df).collect()] == [(1, "PENDING"), (2, "PENDING"), (4, "DONE")]


def test_trend_fills_empty_days_and_skips_nan(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01 10:00:00', 0.5D), (TIMESTAMP_NTZ '2024-01-01 11:00:00', double('NaN')),
        (TIMESTAMP_NTZ '2024-01-03 00:00:00', 0.9D), (CAST(NULL AS TIMESTAMP_NTZ), 0.1D) t(created_at, confidence_score)"""
    )
    got = [(str(r.day), r.avg_confidence) for r in metrics.confidence_trend(df).collect()]
    assert got == [("2024-01-01", 0.5), ("2024-01-02", None), ("2024-01-03", 0.9)]


def test_aggregates_of_nothing(spark):
    none = spark.sql(
        "SELECT 'A' AS approval_stage, TIMESTAMP_NTZ '2024-01-01' AS created_at, TIMESTAMP_NTZ '2024-01-01' AS approval_timestamp, 1D AS confidence_score WHERE false"
    )
    assert metrics.approval_hours(none).first().avg_hours == 0.0
    assert metrics.avg_confidence(none).first()[0] is None
    assert metrics.confidence_trend(none).count() == 0
    assert [r.invoices for r in metrics.approval_funnel(none).collect()] == [0, 0, 0, 0]


def test_zone_mark_is_dropped(spark):
    df = spark.createDataFrame([("2024-01-05T10:00:00+02:00", "nan"), ("2024-01-05 10:00:00", "7"), ("junk", "x")], "t string, n string")
    got = metrics.coerce_types(df, ["n"], ["t"]).collect()
    assert [str(r.t) for r in got] == ["2024-01-05 10:00:00", "2024-01-05 10:00:00", "None"]
    assert [r.n for r in got] == [None, 7.0, None]


@pytest.mark.parametrize(
    ("text", "status", "vendor", "total"),
    [
        ('{"vendor_name": "A", "total_amount": 5}', "OK", "A", "5"),
        ('```json\n{"vendor_name": {"value": "A", "confidence": 1}, "total_amount": {"value": 5.5}}\n```', "OK", "A", "5.5"),
        ('{"vendor_name": {"confidence": 1}, "total_amount": null}', "OK", None, None),
        ('{"vendor_name": {"value": null}}', "OK", None, None),
        ("[1, 2]", "FAILED", None, None),
        ('{"vendor_name": "A"', "FAILED", None, None),
        ("", "FAILED", None, None),
        (None, "FAILED", None, None),
    ],
)
def test_payload_shapes(spark, text, status, vendor, total):
    row = extraction.extract(spark.createDataFrame([(text,)], "payload string")).first()
    assert (row.parse_status, row.vendor_name, row.total_amount) == (status, vendor, total)


def test_confidence_absent_null_and_own_key(spark):
    texts = ['{"a": 1}', '{"overall_confidence": null}', '{"overall_confidence": 0.4}', '{"confidence_score": 0.3, "overall_confidence": 0.4}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    got = [r.confidence_score for r in extraction.extract(df).orderBy("i").collect()]
    assert got == [0.0, None, 0.4, 0.3]


def test_lines_of_either_shape_side_by_side(spark):
    text = '{"line_items": [{"description": "a", "quantity": {"value": 2, "confidence": 1}}, {"description": {"value": "b"}, "total_price": 3}]}'
    row = extraction.extract(spark.createDataFrame([(text,)], "payload string")).first()
    assert row.line_items == [{"description": "a", "quantity": "2"}, {"description": "b", "total_price": "3"}]


def test_every_key_of_a_line_and_lines_that_are_no_objects(spark):
    text = '{"line_items": [{"sku": {"value": "S1"}, "tax": null, "tags": [1, 2], "deep": {"x": 1}}, "loose", {}]}'
    row = extraction.extract(spark.createDataFrame([(text,)], "payload string")).first()
    assert row.line_items == [{"sku": "S1", "tax": None, "tags": "[1,2]", "deep": None}, None, {}]


@pytest.mark.parametrize("part_lines", [7, 50, 10_000])
def test_a_result_of_many_lines_is_one_result(spark, part_lines):
    """An invoice of 120 lines beside a small one and one without lines, stored in parts of any size."""
    inv = spark.sql(
        "SELECT id, id AS src_key, 'V' AS vendor_name, '2024-01-05' AS invoice_date, 10.00BD AS total_amount, 'USD' AS currency, 0.8D AS confidence_score, "
        "'h' AS document_hash FROM VALUES (1L), (2L), (53L), (4L) t(id)"
    )
    lines = spark.sql(
        "SELECT invoice_id, explode(sequence(1L, n)) AS line_number FROM VALUES (1L, 120), (2L, 3), (53L, 120) t(invoice_id, n)"
    ).selectExpr("*", "concat('d', line_number) AS description", "1D AS quantity", "2.50BD AS unit_price", "2.50BD AS total_price")
    stored = derived.payloads(inv, lines, part_lines)
    assert stored.count() == {7: 18 + 1 + 18 + 1, 50: 3 + 1 + 3 + 1, 10_000: 4}[part_lines]
    parsed = extraction.parse_payload(stored)
    full = extraction.explanation_map(extraction.pick_confidence(extraction.flatten_header(parsed)))
    whole = extraction.whole_results(full.select("id", "part", "parse_status", "vendor_name", "confidence_score", "ai_explanations"))
    got = {r.id: (r.parse_status, r.vendor_name, r.confidence_score, len(r.ai_explanations or {})) for r in whole.collect()}
    ok = ("OK", "V", 0.8, 3)
    assert got == {1: ok, 2: ok, 4: ok, 53: ("FAILED", None, None, 0)}
    rows = extraction.line_rows(parsed, "id").select("id", "line_number", extraction.line_map(F.col("line")).alias("m")).collect()
    assert sorted((r.id, r.line_number) for r in rows) == [(1, n) for n in range(1, 121)] + [(2, n) for n in range(1, 4)]
    assert all(r.m["description"] == f"d{r.line_number}" and r.m["sku"] == f"L-{r.id}-{r.line_number}" for r in rows)
    assert extraction.hydrate(
        stored.withColumnRenamed("payload", "ai_raw_data").selectExpr(
            "*", *[f"CAST(NULL AS string) AS {c}" for c in extraction.CURRENT_FIELDS if c not in stored.columns]
        ), "v1",
    ).count() == 4


def test_stamps_of_an_audit_keep_or_erase_the_approver(spark):
    df = spark.sql(
        "SELECT 'AUDITED' AS next_stage, 'AUDITOR' AS user_role, 'FM' AS reviewed_by, 'FM' AS approved_by, TIMESTAMP_NTZ '2024-01-01' AS approval_timestamp"
    )
    now = F.expr("TIMESTAMP_NTZ '2024-02-01'")
    assert workflow.stage_stamps(df, now).first().approved_by == "FM"
    erased = workflow.stage_stamps(df, now, erase_on_audit=True).first()
    assert (erased.reviewed_by, erased.approved_by, erased.approval_timestamp) == (None, None, None)


def test_header_words_and_file_names(spark):
    assert mail.decode_words("=?utf-8?B?w6k=?= x") == "é x"
    assert "�" in mail.decode_words("=?ascii?B?w6k=?=")
    assert mail.decode_words("=?no-such-set?B?YQ==?=") == "a"
    assert mail.decode_words(None) == ""
    for charset in ("hex", "rot13", "base64", "idna", "undefined", "zlib", "u\0tf", "utf-8*en"):
        assert mail.decode_words(f"=?{charset}?B?YQ==?= b").endswith(" b"), charset
    assert mail.decode_words("=?hex?B?YQ==?=") == "a" and mail.decode_words("=?utf-8?Q?a b?=") == "a b"
    assert mail.decode_words("=?utf-8?B?é?=") == "=?utf-8?B?é?="
    df = spark.createDataFrame([("a b/ü.pdf",), ("",), ("x" * 200,)], "n string")
    got = [r[0] for r in df.select(mail.safe_filename(F.col("n"), F.expr("TIMESTAMP_NTZ '2024-01-02 03:04:05'"))).collect()]
    assert got == ["a_b_ü.pdf", "invoice_20240102_030405.bin", "x" * 150]

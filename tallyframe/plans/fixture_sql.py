"""The derived tables as portable SQL, used to state each query's expected result."""

from __future__ import annotations

import re

AS_OF = "2001-08-05 00:00:00"

CTES = {
    "lines": """
SELECT l_orderkey AS invoice_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line_number,
  CASE WHEN l_partkey % 31 = 0 THEN '' ELSE p_name END AS description,
  CASE WHEN l_partkey % 47 = 0 THEN CAST(0 AS double) ELSE l_quantity END AS quantity,
  CAST(p_retailprice AS decimal(18,2)) AS unit_price, CAST(l_extendedprice AS decimal(18,2)) AS total_price
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "line_sums": """
SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS decimal(18,2))) AS line_sum FROM lineitem GROUP BY l_orderkey""",
    "base": """
SELECT o_orderkey AS id, s_name AS vendor_name,
  CASE WHEN o_orderkey % 23 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS date) AS varchar) END AS invoice_date,
  CAST(CASE WHEN o_orderkey % 41 = 0 THEN 0
            WHEN line_sum IS NULL OR o_orderkey % 4 = 3 THEN CAST(o_totalprice AS decimal(18,2))
            WHEN o_orderkey % 4 = 2 THEN line_sum + 0.50 ELSE line_sum END AS decimal(18,2)) AS total_amount,
  CASE o_custkey % 13 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'INR' WHEN 4 THEN 'AED'
       WHEN 5 THEN 'SGD' WHEN 6 THEN 'AUD' WHEN 7 THEN 'CAD' WHEN 8 THEN 'JPY' WHEN 9 THEN 'CNY'
       WHEN 10 THEN 'brl' WHEN 11 THEN '' ELSE ' usd ' END AS currency,
  CAST(50 + (o_orderkey * 7) % 51 AS double) / 100 AS confidence_score,
  CASE WHEN o_orderstatus = 'O' THEN 'UPLOADED' WHEN o_orderstatus = 'P' THEN 'REVIEWED'
       WHEN o_orderpriority = '1-URGENT' THEN 'REJECTED' WHEN o_orderpriority = '2-HIGH' THEN 'AUDITED' ELSE 'APPROVED' END AS approval_stage,
  CASE WHEN o_orderkey % 3 = 0 THEN 'MAIL_BOT' ELSE 'AP_CLERK' END AS created_by,
  CASE WHEN o_orderkey % 3 = 0 THEN 'INGESTED_EMAIL' WHEN o_orderkey % 33 = 1 THEN 'reingested'
       WHEN o_orderkey % 3 = 1 THEN 'MANUAL_UPLOAD' ELSE 'COMPLETED' END AS processing_status,
  o_orderdate AS created_at, o_orderkey AS src_key
FROM orders LEFT JOIN line_sums ON k = o_orderkey
LEFT JOIN supplier ON s_suppkey = o_custkey % (SELECT count(*) FROM supplier)""",
    "inv": """
SELECT *, CASE WHEN approval_stage = 'APPROVED' THEN created_at + INTERVAL '1' HOUR * (1 + src_key % 96) END AS approval_timestamp,
  concat('doc-', CAST(CASE WHEN src_key % 58 = 0 THEN src_key ELSE id END AS varchar)) AS document_key,
  sha256(concat('doc-', CAST(CASE WHEN src_key % 58 = 0 THEN src_key ELSE id END AS varchar))) AS document_hash
FROM (SELECT * FROM base UNION ALL
  SELECT id + 1000000000, vendor_name, invoice_date, total_amount, currency, confidence_score, 'UPLOADED',
    created_by, processing_status, created_at + INTERVAL '10' DAY, src_key FROM base WHERE id % 29 = 0) u""",
    "approvals": """
SELECT id, vendor_name, total_amount, invoice_date, created_at + INTERVAL '1' HOUR * (1 + src_key % 96) AS approved_at
FROM inv WHERE approval_stage IN ('APPROVED', 'AUDITED')""",
    "vend": """
SELECT vendor_name, CAST(sum(total_amount) AS double) / count(*) AS avg_invoice_value, count(*) AS invoice_count,
  arg_max(invoice_date, row(approved_at, id)) AS last_invoice_date,
  (2 * CAST(sum(total_amount) * 100 AS hugeint) + count(*)) // (2 * count(*)) AS avg_cents
FROM approvals WHERE vendor_name IS NOT NULL GROUP BY vendor_name""",
    "edits": """
SELECT id AS invoice_id, 'Total' AS field_name, CAST(total_amount AS varchar) AS old_value,
  CAST(CAST(total_amount + 10 AS decimal(18,2)) AS varchar) AS new_value, created_at + INTERVAL '1' DAY AS edited_at
FROM inv WHERE src_key % 5 = 0 AND approval_stage <> 'UPLOADED'""",
    "audits": """
SELECT id AS invoice_id, 'AUDITOR' AS audited_by, 'Auditor Verified' AS audit_note, created_at + INTERVAL '5' DAY AS audited_at
FROM inv WHERE approval_stage = 'AUDITED'""",
    "requests": """
SELECT event_id, ts, user_id AS invoice_id,
 CASE event_type WHEN 'signup' THEN 'UPLOADED' WHEN 'view' THEN 'REVIEWED' WHEN 'click' THEN 'APPROVED' WHEN 'purchase' THEN 'AUDITED' ELSE 'REJECTED' END AS next_stage,
 CASE WHEN event_id % 2 = 0 THEN CASE event_type WHEN 'signup' THEN 'AP_CLERK' WHEN 'view' THEN 'AP_CLERK' WHEN 'purchase' THEN 'AUDITOR' ELSE 'FINANCE_MANAGER' END
  ELSE CASE event_id % 8 WHEN 1 THEN 'AP_CLERK' WHEN 3 THEN 'FINANCE_MANAGER' WHEN 5 THEN 'AUDITOR' ELSE 'MAIL_BOT' END END AS user_role
FROM events""",
    "msgs": """
SELECT doc_id AS message_id, concat(source, '@vendor.example') AS sender,
 CASE WHEN doc_id % 5 = 0 THEN 'Weekly newsletter' ELSE concat('Invoice ', CAST(doc_id AS varchar)) END AS subject,
 concat('file_', CAST(doc_id AS varchar), CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' ELSE '.docx' END) AS filename,
 CASE WHEN doc_id % 4 = 0 THEN 'application/pdf' WHEN doc_id % 8 = 3 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime_type,
 text AS content FROM documents""",
    "msg_parts": """
SELECT *, 0::bigint AS part_no FROM msgs
UNION ALL SELECT message_id, sender, subject, concat('copy_', message_id, '.pdf'), 'application/pdf', content, 1 FROM msgs WHERE message_id % 6 = 0""",
    "hdr": """
SELECT id, src_key,
  CASE WHEN src_key % 61 = 0 THEN NULL WHEN src_key % 67 = 0 THEN ' ' ELSE vendor_name END AS vendor_name, invoice_date,
  CASE WHEN src_key % 37 = 0 THEN 'N/A' WHEN src_key % 43 = 0 THEN 'NaN' WHEN src_key % 59 = 0 THEN '-5.00' ELSE CAST(total_amount AS varchar) END AS total_amount,
  currency FROM inv""",
    "math": """
SELECT id, CASE WHEN line_sum IS NULL THEN false ELSE total_amount - line_sum = 0 END AS math_valid,
  coalesce(line_sum, 0) AS line_sum,
  CASE WHEN line_sum IS NULL THEN total_amount ELSE abs(total_amount - line_sum) END AS difference
FROM inv LEFT JOIN line_sums ON k = src_key""",
    "dup_key": """
SELECT vendor_name, invoice_date, total_amount FROM inv GROUP BY ALL HAVING count(*) > 1""",
    "signals": """
SELECT inv.*, math_valid, line_sum, CAST(difference AS decimal(28,2)) AS difference,
  (vendor_name, invoice_date, total_amount) IN (SELECT (vendor_name, invoice_date, total_amount) FROM dup_key) AS duplicate_key,
  avg_invoice_value AS vendor_avg, avg_cents,
  coalesce(avg_invoice_value <> 0 AND CAST(total_amount AS double) > 2 * avg_invoice_value, false) AS anomaly
FROM inv JOIN math USING (id) LEFT JOIN vend USING (vendor_name)""",
    "points": """
SELECT *, CASE WHEN confidence_score < 0.7 THEN 20 ELSE 0 END + CASE WHEN math_valid THEN 0 ELSE 30 END
  + CASE WHEN duplicate_key THEN 40 ELSE 0 END + CASE WHEN anomaly THEN 25 ELSE 0 END AS risk_score,
  concat_ws(', ',
    CASE WHEN confidence_score < 0.7 THEN concat('Low AI Confidence (', CAST(CAST(trunc(confidence_score * 100) AS int) AS varchar), '%)') END,
    CASE WHEN NOT math_valid THEN concat('Math Mismatch (Diff: ', CAST(difference AS varchar), ')') END,
    CASE WHEN duplicate_key THEN 'Duplicate Invoice Detected' END,
    CASE WHEN anomaly THEN concat('Amount > 2x Vendor Avg ($', CAST(avg_cents // 100 AS varchar), '.', lpad(CAST(avg_cents % 100 AS varchar), 2, '0'), ')') END) AS reasons
FROM signals""",
    "scored": """
SELECT *, CASE WHEN risk_level = 'HIGH' OR (risk_level = 'MEDIUM' AND NOT math_valid) THEN 'Flagged' ELSE 'Verified' END AS status,
  CASE WHEN risk_level = 'HIGH' THEN concat('High Risk: ', reasons) WHEN risk_level = 'MEDIUM' AND NOT math_valid THEN 'Math Mismatch' END AS flag_reason
FROM (SELECT *, CASE WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM points) p""",
    "sources": """
SELECT *, CASE WHEN created_by = 'MAIL_BOT' OR upper(processing_status) LIKE '%INGEST%' THEN 'INGESTED_EMAIL' ELSE 'MANUAL_UPLOAD' END AS source FROM inv""",
    "ledger": """
SELECT id, vendor_name, invoice_date, total_amount, currency, status, processing_status, confidence_score, flag_reason,
  document_hash, created_by, risk_score, risk_level, approval_stage, src_key, created_at, approval_timestamp,
  CASE approval_stage WHEN 'REVIEWED' THEN 'AP_CLERK' WHEN 'UPLOADED' THEN NULL ELSE 'FINANCE_MANAGER' END AS reviewed_by,
  CASE WHEN approval_stage IN ('APPROVED', 'AUDITED') THEN 'FINANCE_MANAGER' END AS approved_by,
  CASE WHEN approval_stage = 'AUDITED' THEN true WHEN src_key % 7 = 0 THEN NULL ELSE false END AS audited,
  'v1' AS ai_version,
  CASE WHEN src_key % 97 = 0 THEN created_at + INTERVAL '20' DAY END AS reprocessed_at,
  CASE WHEN created_by = 'MAIL_BOT' OR upper(processing_status) LIKE '%INGEST%' THEN 'INGESTED_EMAIL' ELSE 'MANUAL_UPLOAD' END AS source,
  CASE WHEN approval_stage = 'APPROVED' THEN 0 ELSE CAST(floor(epoch(TIMESTAMP '2001-08-05 00:00:00' - created_at) / 86400) AS bigint) END AS days_pending
FROM scored""",
    # JSON of an extraction result as it reads after parsing: keys sorted, no zeros at the end of fractions
    "line_json": r"""
SELECT invoice_id, line_number, bare, concat('{"description":', f(CAST(to_json(description) AS varchar), bare), ',"line_number":', line_number,
  ',"quantity":', f(regexp_replace(CAST(quantity AS varchar), '\.?0+$', ''), bare), ',"sku":', f(concat('"L-', invoice_id, '-', line_number, '"'), bare),
  ',"total_price":', f(regexp_replace(CAST(total_price AS varchar), '\.?0+$', ''), bare),
  ',"unit_price":', f(regexp_replace(CAST(unit_price AS varchar), '\.?0+$', ''), bare), '}') AS line
FROM (SELECT *, invoice_id % 7 = 0 AS bare FROM lines) l""",
    "lines_json": """
SELECT invoice_id, concat('[', string_agg(line, ',' ORDER BY line_number), ']') AS items FROM line_json GROUP BY invoice_id""",
    "payload": r"""
SELECT *, concat('{"currency":', f(CAST(to_json(currency) AS varchar), bare),
  ',"explanations":{"invoice_date":"Next to label","total_amount":"Last line","vendor_name":"Top left"},"invoice_date":', f(CAST(to_json(invoice_date) AS varchar), bare),
  ',"layout":{"page":{"area":{"corner":{"top":{"left":{"x":', src_key % 100, '}}}}}},"line_items":', items,
  CASE WHEN src_key % 17 = 0 THEN ',"overall_confidence":null' WHEN src_key % 19 <> 0 THEN concat(',"overall_confidence":', confidence_text) ELSE '' END,
  ',"total_amount":', f(total_text, bare), ',"vendor_name":', f(CAST(to_json(vendor_name) AS varchar), bare), '}') AS json
FROM (SELECT inv.*, src_key % 7 = 0 AS bare, src_key % 53 = 0 AS bad, coalesce(items, '[]') AS items,
  regexp_replace(CAST(total_amount AS varchar), '\.?0+$', '') AS total_text, regexp_replace(CAST(confidence_score AS varchar), '\.?0+$', '') AS confidence_text
  FROM inv LEFT JOIN lines_json ON invoice_id = src_key) p""",
    # every leaf of the payloads kept as raw data; those with src_key % 5 = 0 are kept as the structured copy only
    "leaves": """
SELECT id AS invoice_id, unnest(list_concat(
  list_transform([('currency', currency), ('invoice_date', invoice_date), ('total_amount', total_text), ('vendor_name', vendor_name)],
    lambda t: {'path': CASE WHEN bare THEN t[1] ELSE concat(t[1], '.value') END, 'value': t[2]}),
  CASE WHEN bare THEN [] ELSE list_transform(['currency', 'invoice_date', 'total_amount', 'vendor_name'],
    lambda n: {'path': concat(n, '.confidence'), 'value': '0.9'}) END,
  [{'path': 'explanations.invoice_date', 'value': 'Next to label'}, {'path': 'explanations.total_amount', 'value': 'Last line'},
   {'path': 'explanations.vendor_name', 'value': 'Top left'}, {'path': 'layout.page.area.corner.top.left.x', 'value': CAST(src_key % 100 AS varchar)},
   {'path': 'line_items', 'value': items}],
  CASE WHEN src_key % 17 = 0 THEN [{'path': 'overall_confidence', 'value': NULL}]
    WHEN src_key % 19 <> 0 THEN [{'path': 'overall_confidence', 'value': confidence_text}] ELSE [] END)) AS leaf
FROM payload WHERE NOT bad AND src_key % 5 <> 0""",
    # stage x stage x role rule table; '' = the record does not exist yet
    "rules": """
SELECT * FROM (VALUES ('', 'UPLOADED', 'MAIL_BOT'), ('', 'UPLOADED', 'AP_CLERK'), ('', 'REVIEWED', 'AP_CLERK'),
  ('UPLOADED', 'UPLOADED', 'AP_CLERK'), ('UPLOADED', 'REVIEWED', 'AP_CLERK'),
  ('REVIEWED', 'REVIEWED', 'AP_CLERK'), ('REVIEWED', 'REVIEWED', 'FINANCE_MANAGER'),
  ('REVIEWED', 'APPROVED', 'FINANCE_MANAGER'), ('REVIEWED', 'REJECTED', 'FINANCE_MANAGER'),
  ('APPROVED', 'APPROVED', 'FINANCE_MANAGER'), ('APPROVED', 'AUDITED', 'AUDITOR'), ('AUDITED', 'AUDITED', 'AUDITOR')) t(prev, nxt, role)""",
}


def _wrapped(body: str) -> str:
    """Write ``f(value, bare)`` out: a JSON value as it is, or as {confidence, value}; null text counts as null."""
    while (at := re.search(r"\bf\(", body)) is not None:
        depth, comma, end = 1, 0, at.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(body[end], 0)
            comma = end if body[end] == "," and depth == 1 else comma
            end += 1
        value = f"coalesce({body[at.end() : comma]}, 'null')"
        flag = body[comma + 1 : end - 1].strip()
        body = f"""{body[: at.start()]}CASE WHEN {flag} THEN {value} ELSE concat('{{"confidence":0.9,"value":', {value}, '}}') END{body[end:]}"""
    return body


def with_tables(sql: str, **extra: str) -> str:
    """Prefix ``sql`` with every derived table it names, in dependency order."""
    tables = {name: _wrapped(body) for name, body in {**CTES, **extra}.items()}
    order: list[str] = []

    open_names: set[str] = set()

    def need(text: str) -> None:
        for name, body in tables.items():
            known = name in order or name in open_names
            if not known and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                open_names.add(name)
                need(body)
                order.append(name)

    need(sql)
    if not order:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({tables[n]})" for n in order) + "\n" + sql

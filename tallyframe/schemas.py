"""Table schemas, checked once where data enters; operators then rely on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _L, _D, _TS, _B = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampNTZType(), T.BooleanType()
_MONEY = T.DecimalType(18, 2)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


INVOICES = _table(
    id=_L, vendor_name=_S, invoice_date=_S, total_amount=_MONEY, currency=_S, status=_S,
    processing_status=_S, confidence_score=_D, flag_reason=_S, file_url=_S, ai_raw_data=_S,
    ai_structured_output=_S, document_hash=_S, created_by=_S, last_reviewed_by=_S,
    ai_explanations=T.MapType(_S, _S), risk_score=T.IntegerType(), risk_level=_S,
    approval_stage=_S, reviewed_by=_S, approved_by=_S, approval_timestamp=_TS, audited=_B,
    ai_version=_S, reprocessed_at=_TS, created_at=_TS,
)
LINE_ITEMS = _table(
    invoice_id=_L, line_number=_L, description=_S, quantity=_D, unit_price=_MONEY, total_price=_MONEY
)
VENDORS = _table(vendor_name=_S, avg_invoice_value=_D, invoice_count=_L, last_invoice_date=_S)
EDITS = _table(invoice_id=_L, field_name=_S, old_value=_S, new_value=_S, edited_at=_TS)
AUDITS = _table(invoice_id=_L, audited_by=_S, audit_note=_S, audited_at=_TS)
REQUESTS = _table(event_id=_L, ts=_TS, invoice_id=_L, next_stage=_S, user_role=_S)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns with its types; a missing column is an error at once."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])

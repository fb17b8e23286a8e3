"""Small column helpers shared by the operators. All stay native expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,2)"

# Text that the float rule of the source application accepts: digits may be grouped
# by single underscores, blanks around are fine, type suffixes and hex are not.
_FLOAT_TEXT = (
    r"(?i)^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*$"
)
_ISO_DATE_TEXT = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
_WHITE = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    """Remove all white space at both ends (``trim`` would remove blanks only)."""
    return F.btrim(text, F.lit(_WHITE))


def strip_long(text: Column) -> Column:
    """``strip`` for texts that may be long: it walks the whole text, so it is left out where both ends are bare."""
    at_end = reduce(or_, [text.startswith(c) | text.endswith(c) for c in _WHITE])
    return F.when(at_end, strip(text)).otherwise(text)


def is_missing(text: Column) -> Column:
    """Null or empty; a blank is a value."""
    return text.isNull() | (text == F.lit(""))


def parse_number(value: Column) -> Column:
    """Double for text (or numbers) holding a float, else null. NaN and infinities are floats."""
    text = value.cast("string")
    clean = F.regexp_replace(strip(text), "_", "")
    return F.when(text.rlike(_FLOAT_TEXT), clean.try_cast("double"))


def parse_iso_date(text: Column) -> Column:
    """DATE for ``YYYY-M-D`` text, else null; longer or shorter forms are refused."""
    return F.when(text.rlike(_ISO_DATE_TEXT), F.try_to_date(text, "yyyy-M-d"))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def compact(items: list[Column]) -> Column:
    """Array of the non-null items, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def micros_between(start: Column, end: Column) -> Column:
    """Whole microseconds from start to end, for zone-free or zoned timestamps."""
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def sanitize_value(value: Column, dtype: T.DataType) -> Column:
    """Null out NaN and infinities anywhere inside a value of the given type."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(is_finite(value), value)
    if isinstance(dtype, T.ArrayType) and _holds_float(dtype):
        return F.transform(value, lambda x: sanitize_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType) and _holds_float(dtype):
        return F.transform_values(value, lambda _, v: sanitize_value(v, dtype.valueType))
    if isinstance(dtype, T.StructType) and _holds_float(dtype):
        fields = [sanitize_value(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _holds_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_float(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_float(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_holds_float(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.DoubleType, T.FloatType))

"""Line-sum check and field rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.config import CURRENCIES, LIMITS
from tallyframe.functions.columns import (
    compact,
    is_finite,
    is_missing,
    parse_iso_date,
    parse_number,
    strip,
)
from tallyframe.session import stored

_SUM = "decimal(38,6)"


def math_validation(invoices: DataFrame, lines: DataFrame, line_key: str = "id") -> DataFrame:
    """Adds (math_valid, line_sum, difference); no lines gives (false, 0, total).

    ``line_key`` is the invoice column that ``lines.invoice_id`` refers to.
    """
    sums = lines.groupBy(F.col("invoice_id").alias(line_key)).agg(
        F.coalesce(F.sum("total_price"), F.lit(0)).alias("sum_of_lines")
    )
    has_lines = F.col("sum_of_lines").isNotNull()
    total = F.col("total_amount")
    joined = invoices.join(sums, line_key, "left")
    difference = F.when(has_lines, F.abs(total - F.col("sum_of_lines"))).otherwise(total).cast("decimal(28,2)")
    return joined.withColumns(
        {
            "line_sum": F.coalesce("sum_of_lines", F.lit(0)).cast("decimal(28,2)"),
            "difference": difference,
            "math_valid": F.coalesce(has_lines & (difference == 0), F.lit(False)),
        }
    ).drop("sum_of_lines")


def _types(schema: T.StructType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in schema.fields}


def _number(value: Column, dtype: T.DataType) -> Column:
    """Double of a number column as it is, of any other through the text rule."""
    return value.cast("double") if isinstance(dtype, T.NumericType) else parse_number(value)


# --- field rules: each is (rule, text column or null) in output order ---


def _header_rules(vendor: Column, date: Column, amount: Column, currency: Column) -> list[tuple[str, Column]]:
    code = strip(F.upper(F.coalesce(currency, F.lit(""))))
    return [
        ("C1", F.when(is_missing(vendor), "Missing vendor name")),
        ("C2", F.when(parse_iso_date(date).isNull(), "Invalid invoice date format (expected YYYY-MM-DD)")),
        ("C3", F.when(amount <= 0, "Invoice total must be greater than zero")),
        ("C4", F.when(amount.isNull(), "Invalid invoice total amount")),
        ("C5", F.when((code != "") & ~code.isin(*CURRENCIES), F.concat(F.lit("Unsupported currency: "), code))),
    ]


def _line_rules(
    number: Column, description: Column, count: Column, unit: Column, total: Column
) -> list[tuple[str, Column]]:
    start = F.concat(F.lit("Line "), number.cast("string"), F.lit(": "))
    text = lambda hit, message: F.when(hit, F.concat(start, F.lit(message)))
    return [
        ("C7", text(strip(F.coalesce(description, F.lit(""))) == "", "Missing description")),
        ("C8", text(count <= 0, "Quantity must be greater than zero")),
        ("C9", text(count.isNull(), "Invalid quantity")),
        ("C10", text(unit < 0, "Unit price cannot be negative")),
        ("C10", text(unit.isNull(), "Invalid unit price")),
        ("C11", text(total < 0, "Total price cannot be negative")),
        ("C12", text(total.isNull(), "Invalid total price")),
    ]


def _mismatch(amount: Column, exact_sum: Column, special_sum: Column, tolerance: float) -> Column:
    """C13. Finite amounts add up as decimals; NaN and infinities travel in ``special_sum``."""
    exact = is_finite(amount) & (special_sum == 0)
    by_cents = F.abs(amount.try_cast(_SUM) - exact_sum) > F.lit(tolerance).cast(_SUM)
    loose = F.abs(amount - special_sum)
    return (~F.isnan(amount)) & (amount > 0) & F.when(exact, by_cents).otherwise(~F.isnan(loose) & (loose > tolerance))


def _sum_parts(value: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """(decimal part, part for NaN and infinities) of one amount; an unreadable one counts as nothing."""
    if isinstance(dtype, (T.DecimalType, T.IntegralType)):
        return F.coalesce(value, F.lit(0).cast(dtype)), F.lit(0.0)
    number = _number(value, dtype)
    exact = F.coalesce(F.when(is_finite(number), number.try_cast(_SUM)), F.lit(0).cast(_SUM))
    special = F.coalesce(F.when(~is_finite(number), number), F.lit(0.0))
    return exact, special


_MISMATCH_TEXT = "Line-item total mismatch against invoice total"
_NO_LINES_TEXT = "No line items extracted"
_HEADER = ("vendor_name", "invoice_date", "total_amount", "currency")
_LINE = ("description", "quantity", "unit_price", "total_price")


def compliance_issues(df: DataFrame, tolerance: float = LIMITS.mismatch_tolerance) -> DataFrame:
    """Adds ``issues`` to rows that carry their own ``line_items`` array. Narrow: no shuffle.

    Uses vendor_name, invoice_date, total_amount, currency and line_items with
    description, quantity, unit_price and total_price, as structs or maps; values may be unchecked text.
    Every value is parsed once, in a step of its own, before the rules use it.
    """
    types = _types(df.schema)
    element = types["line_items"].elementType
    # lines as maps of text (all keys of an extraction) or as structs
    line_types = dict.fromkeys(_LINE, element.valueType) if isinstance(element, T.MapType) else _types(element)

    def parsed_line(x: Column) -> Column:
        exact, special = _sum_parts(x["total_price"], line_types["total_price"])
        return F.struct(
            x["description"].alias("description"),
            *[_number(x[f], line_types[f]).alias(f) for f in _LINE[1:]],
            exact.cast(_SUM).alias("exact"),
            special.alias("special"),
        )

    read = df.withColumns(
        {
            "_amount": _number(F.col("total_amount"), types["total_amount"]),
            "_lines": F.transform("line_items", parsed_line),
        }
    )
    items = F.col("_lines")
    header = [c for _, c in _header_rules(F.col("vendor_name"), F.col("invoice_date"), F.col("_amount"), F.col("currency"))]
    none = items.isNull() | (F.size(items) == 0)
    line = F.flatten(
        F.transform(items, lambda x, i: F.array(*[c for _, c in _line_rules(i + 1, *[x[f] for f in _LINE])]))
    )
    zero = F.struct(F.lit(0).cast(_SUM).alias("exact"), F.lit(0.0).alias("special"))
    sums = F.aggregate(
        items,
        zero,
        lambda acc, x: F.struct(
            (acc["exact"] + x["exact"]).cast(_SUM).alias("exact"), (acc["special"] + x["special"]).alias("special")
        ),
    )
    summed = read.withColumn("_sums", sums)
    wrong = _mismatch(F.col("_amount"), F.col("_sums.exact"), F.col("_sums.special"), tolerance)
    body = F.when(none, F.array(F.lit(_NO_LINES_TEXT))).otherwise(
        F.concat(line, F.array(F.when(wrong, F.lit(_MISMATCH_TEXT))))
    )
    issues = F.filter(F.concat(F.array(*header), body), lambda x: x.isNotNull())
    return summed.withColumn("issues", issues).drop("_amount", "_lines", "_sums")


def line_facts(lines: DataFrame) -> DataFrame:
    """What rules need from a line table, in one pass over it: (invoice_id, line_number, rule, issue, exact, special).

    A row with a rule is a broken rule of a line; the one without is the sums of its
    invoice (see ``_mismatch``). Both come out of one grouping, in which sums combine
    before the shuffle, so an invoice of very many lines sends one row a task and its hits.
    """
    types = _types(lines.schema)
    parsed = lines.select("invoice_id", "line_number", "description", *[_number(F.col(f), types[f]).alias(f) for f in _LINE[1:]], F.col("total_price").alias("_total"))
    exact, special = _sum_parts(F.col("_total"), types["total_price"])
    none = F.lit(None).cast("string")
    fact = lambda rule, number, text, e, s: F.struct(
        number.cast("long").alias("line_number"), rule.alias("rule"), text.alias("issue"), e.cast("decimal(38,6)").alias("exact"), s.alias("special")
    )
    zero = (F.lit(0), F.lit(0.0))
    rules = _line_rules(F.col("line_number"), *[F.col(f) for f in _LINE])
    hits = [F.when(text.isNotNull(), fact(F.lit(rule), F.col("line_number"), text, *zero)) for rule, text in rules]
    sums = fact(none, F.lit(None), none, exact, special)
    # The outer form: Spark would copy the rules of a plain explode below it and evaluate them again there.
    rows = parsed.select("invoice_id", F.explode_outer(compact([sums, *hits])).alias("fact")).select("invoice_id", "fact.*")
    return rows.groupBy("invoice_id", "line_number", "rule", "issue").agg(
        F.sum("exact").cast(_SUM).alias("exact"), F.sum("special").alias("special")
    )


def compliance_issue_rows(
    headers: DataFrame, lines: DataFrame, line_key: str = "id", tolerance: float = LIMITS.mismatch_tolerance,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The same issues for a line table, one row each: (id, section, line_number, rule, issue).

    Section 0 is the header, 1 the lines, 2 the total; order by (section, line_number,
    rule position) gives the list of ``compliance_issues``. Lines are read once and never
    gathered per invoice; what came out of them (``line_facts``) is written and joined to
    the headers, hits by an inner join that Spark can split where an invoice has very many.
    """
    facts = (keep or (lambda df: stored(df, "line-facts")))(line_facts(lines))
    names = {"invoice_id": line_key}
    hits = facts.filter(F.col("rule").isNotNull()).withColumnsRenamed(names)
    keys = headers.select("id", line_key) if line_key != "id" else headers.select("id")
    body = hits.join(keys, line_key).select("id", F.lit(1).alias("section"), "line_number", "rule", "issue")

    types = _types(headers.schema)
    sums = facts.filter(F.col("rule").isNull()).select(F.col("invoice_id").alias(line_key), "exact", "special")
    read = headers.withColumn("_amount", _number(F.col("total_amount"), types["total_amount"])).join(sums, line_key, "left")
    wrong = _mismatch(F.col("_amount"), F.col("exact"), F.col("special"), tolerance)
    issue = lambda section, rule, text: F.when(
        text.isNotNull(),
        F.struct(F.lit(section).alias("section"), F.lit(0).cast("long").alias("line_number"), F.lit(rule).alias("rule"), text.alias("issue")),
    )
    own = [issue(0, rule, text) for rule, text in _header_rules(F.col("vendor_name"), F.col("invoice_date"), F.col("_amount"), F.col("currency"))]
    own.append(issue(2, "C6", F.when(F.col("exact").isNull(), F.lit(_NO_LINES_TEXT))))
    own.append(issue(2, "C13", F.when(F.col("exact").isNotNull() & wrong, F.lit(_MISMATCH_TEXT))))
    rest = read.select("id", F.explode_outer(compact(own)).alias("hit")).filter(F.col("hit").isNotNull()).select("id", "hit.*")
    return rest.unionByName(body)


def compliance_verdict(df: DataFrame) -> DataFrame:
    """Adds (compliant, issue_count) to rows with an ``issues`` array."""
    return df.withColumn("issue_count", F.size("issues").cast("long")).withColumn(
        "compliant", F.col("issue_count") == 0
    )


def compliance_verdict_rows(headers: DataFrame, issues: DataFrame) -> DataFrame:
    """(id, compliant, issue_count) for every header, from issue rows."""
    counts = issues.groupBy("id").agg(F.count(F.lit(1)).alias("issue_count"))
    return (
        headers.select("id")
        .join(counts, "id", "left")
        .select("id", F.coalesce("issue_count", F.lit(0)).cast("long").alias("issue_count"))
        .withColumn("compliant", F.col("issue_count") == 0)
    )

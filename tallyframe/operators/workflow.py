"""Stage rules, request replay, stamps, labels, records, edit log, audit log and timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.config import TRANSITIONS
from tallyframe.functions.columns import MONEY, compact

_RULES = [
    f"{before or ''}|{after}|{role}" for before, after, roles in TRANSITIONS for role in roles
]
_MOVES = [
    f"{before or ''}|{after}|{role}" for before, after, roles in TRANSITIONS for role in roles if before != after
]


def _longest_path() -> int:
    """Number of moves on the longest way through the stages; the moves have no cycle."""

    def depth(stage: str | None) -> int:
        return max((1 + depth(after) for before, after, _ in TRANSITIONS if before == stage and after != stage), default=0)

    return depth(None)


def _rule_key(before: Column, after: Column, role: Column) -> Column:
    return F.concat_ws("|", before, after, role)


def _stage(stage: Column) -> Column:
    return F.upper(F.coalesce(stage, F.lit("UPLOADED")))


def _role(role: Column) -> Column:
    return F.upper(F.coalesce(role, F.lit("")))


def transition_allowed(df: DataFrame) -> DataFrame:
    """Adds ``allowed`` from (is_new, previous_stage, next_stage, user_role), all case-folded.

    For existing records a null stage counts as UPLOADED; new ones have no previous stage.
    """
    before = F.when(F.col("is_new"), "").otherwise(_stage(F.col("previous_stage")))
    key = _rule_key(before, _stage(F.col("next_stage")), _role(F.col("user_role")))
    return df.withColumn("allowed", key.isin(*_RULES))


def replay_requests(requests: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Adds (previous_stage, accepted) to each request, applied in event_id order per invoice.

    ``current`` optionally gives the stage of invoices that exist already as
    (invoice_id, approval_stage). Refused requests change nothing; previous_stage is ''
    while the invoice does not exist.

    Stages only move forward, so an invoice's history is at most four moves, each the
    earliest allowed request after the move before it. Every move is a grouped minimum,
    combined on the map side, so no invoice's requests are ever gathered or sorted
    in one task. The joins keep the requests on a side Spark can split when hot.
    """
    rows = requests.withColumns(
        {"_next": _stage(F.col("next_stage")), "_role": _role(F.col("user_role"))}
    )
    if current is None:
        rows = rows.withColumn("_stage0", F.lit(""))
    else:
        known = current.select("invoice_id", _stage(F.col("approval_stage")).alias("_stage0"))
        rows = rows.join(known, "invoice_id", "left").withColumn("_stage0", F.coalesce("_stage0", F.lit("")))

    ends = sorted({m.split("|", 1)[1] for m in _MOVES})
    movers = rows.filter(F.concat_ws("|", "_next", "_role").isin(*ends)).select(
        "invoice_id", "event_id", "_next", "_role", "_stage0"
    )
    move = F.struct(F.col("event_id").alias("at"), F.col("_next").alias("stage"))

    def first_move(stage: Column, after: Column | None) -> Column:
        allowed = _rule_key(stage, F.col("_next"), F.col("_role")).isin(*_MOVES)
        return F.min(F.when(allowed if after is None else allowed & (F.col("event_id") > after), move))

    history = movers.groupBy("invoice_id").agg(first_move(F.col("_stage0"), None).alias("m1"))
    history = history.filter(F.col("m1").isNotNull())
    steps = movers.drop("_stage0")
    names = ["m1"]
    for level in range(2, _longest_path() + 1):
        last = names[-1]
        history = (
            steps.join(history, "invoice_id")
            .groupBy("invoice_id", *names)
            .agg(first_move(F.col(last)["stage"], F.col(last)["at"]).alias(f"m{level}"))
        )
        names.append(f"m{level}")

    previous = F.col("_stage0")
    for name in names:
        previous = F.when(F.col(name)["at"] < F.col("event_id"), F.col(name)["stage"]).otherwise(previous)
    return (
        rows.join(history, "invoice_id", "left")
        .withColumn("previous_stage", previous)
        .withColumn("accepted", _rule_key(F.col("previous_stage"), F.col("_next"), F.col("_role")).isin(*_RULES))
        .select(*requests.columns, "previous_stage", "accepted")
    )


def latest_stage(replayed: DataFrame) -> DataFrame:
    """(invoice_id, approval_stage) after the accepted requests."""
    return (
        replayed.filter("accepted")
        .groupBy("invoice_id")
        .agg(F.max_by(_stage(F.col("next_stage")), F.col("event_id")).alias("approval_stage"))
    )


def stage_stamps(df: DataFrame, at: Column, erase_on_audit: bool = False) -> DataFrame:
    """Sets reviewed_by, approved_by and approval_timestamp for the move to ``next_stage``.

    ``erase_on_audit`` clears all three at the audit, as the source application does.
    """
    stage, role, null = F.col("next_stage"), F.col("user_role"), F.lit(None)
    keep_reviewer = F.when(F.col("reviewed_by") != "", F.col("reviewed_by"))
    reviewed = F.when(stage.isin("REVIEWED", "REJECTED"), role).when(
        stage == "APPROVED", F.coalesce(keep_reviewer, role)
    )
    approved = F.when(stage == "APPROVED", role)
    time = F.when(stage == "APPROVED", at)
    if not erase_on_audit:
        reviewed = reviewed.when(stage == "AUDITED", F.col("reviewed_by"))
        approved = approved.when(stage == "AUDITED", F.col("approved_by"))
        time = time.when(stage == "AUDITED", F.col("approval_timestamp"))
    return df.withColumns(
        {
            "reviewed_by": reviewed.otherwise(null),
            "approved_by": approved.otherwise(null),
            "approval_timestamp": time.otherwise(null),
        }
    )


def decision_labels(df: DataFrame) -> DataFrame:
    """Sets status and flag_reason for the move to ``next_stage``; other moves keep the checked ones."""
    stage = F.col("next_stage")
    return df.withColumns(
        {
            "status": F.when(stage == "APPROVED", "Verified").when(stage == "REJECTED", "Flagged").otherwise(F.col("status")),
            "flag_reason": F.when(stage == "APPROVED", "Manager Accepted - Sent to Auditor")
            .when(stage == "REJECTED", "Manager Rejected")
            .when(stage == "AUDITED", "Auditor Verified")
            .otherwise(F.col("flag_reason")),
        }
    )


def invoice_record(df: DataFrame, user_role: str) -> DataFrame:
    """The stored record. A default applies where the column is absent; a null stays null."""

    def given(name: str, default: object = None, dtype: str = "string") -> Column:
        return F.col(name) if name in df.columns else F.lit(default).cast(dtype)

    def times(name: str) -> Column:
        return given(name, None, "timestamp_ntz")

    record = {
        "vendor_name": given("vendor_name"),
        "invoice_date": given("invoice_date"),
        "total_amount": given("total_amount", None, MONEY),
        "currency": given("currency"),
        "status": given("status"),
        "processing_status": given("processing_status", "COMPLETED"),
        "confidence_score": given("confidence_score", 0.0, "double"),
        "flag_reason": given("flag_reason"),
        "file_url": given("file_url"),
        "ai_raw_data": given("ai_raw_data"),
        "ai_structured_output": given("ai_structured_output"),
        "document_hash": given("document_hash"),
        "created_by": given("created_by", user_role),
        "last_reviewed_by": given("reviewed_by", user_role),
        "ai_explanations": given("ai_explanations", None, "map<string,string>"),
        "risk_score": given("risk_score", 0, "int"),
        "risk_level": given("risk_level", "LOW"),
        "approval_stage": given("approval_stage", "UPLOADED"),
        "reviewed_by": given("reviewed_by"),
        "approved_by": given("approved_by"),
        "approval_timestamp": times("approval_timestamp"),
        "audited": given("approval_stage", "").eqNullSafe("AUDITED"),
        "ai_version": given("ai_version"),
        "reprocessed_at": times("reprocessed_at"),
    }
    extra = [F.col(c) for c in ("id", "created_at") if c in df.columns]
    return df.select(*extra, *[c.alias(name) for name, c in record.items()])


def changed_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """Invoices that had lines and whose lines differ now: (invoice_id).

    Lines meet by (invoice_id, line_number), so even an invoice with very many lines
    spreads over all tasks and only one count per invoice is grouped.
    """
    fields = ["description", "quantity", "unit_price", "total_price"]
    keys = ["invoice_id", "line_number"]
    old = before.select(*keys, F.struct(*fields).alias("old"))
    new = after.select(*keys, F.struct(*fields).alias("new"))
    return (
        old.join(new, keys, "full_outer")
        .groupBy("invoice_id")
        .agg(
            F.count("old").alias("had"),
            F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("different"),
        )
        .filter((F.col("had") > 0) & (F.col("different") > 0))
        .select("invoice_id")
    )


def edit_diff(
    before: DataFrame,
    after: DataFrame,
    at: Column,
    changed: DataFrame | None = None,
) -> DataFrame:
    """Edit-log rows for saved invoices: (invoice_id, field_name, old_value, new_value, edited_at).

    ``changed`` lists invoices with changed lines (see ``changed_lines``). Null is logged as "None".
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    fields = {"Vendor": "vendor_name", "Total": "total_amount", "Date": "invoice_date"}
    old = before.select("id", *[F.col(c).alias(f"old_{c}") for c in fields.values()])
    pairs = after.select("id", *fields.values()).join(old, "id")
    hits = []
    for label, name in fields.items():
        was, now = F.col(f"old_{name}"), F.col(name)
        same = (text(was) == text(now)) if label == "Total" else was.eqNullSafe(now)
        hits.append(
            F.when(
                ~same,
                F.struct(F.lit(label).alias("field_name"), text(was).alias("old_value"), text(now).alias("new_value")),
            )
        )
    log = pairs.select(F.col("id").alias("invoice_id"), F.inline_outer(compact(hits)))
    log = log.filter(F.col("field_name").isNotNull())
    if changed is not None:
        saved = after.select(F.col("id").alias("invoice_id"))
        log = log.unionByName(
            changed.join(saved, "invoice_id", "left_semi").select(
                "invoice_id",
                F.lit("Line Items").alias("field_name"),
                F.lit("Original AI Table").alias("old_value"),
                F.lit("User Modified Table").alias("new_value"),
            )
        )
    return log.withColumn("edited_at", at)


def audit_records(saved: DataFrame, at: Column) -> DataFrame:
    """Audit-log rows of records saved as AUDITED; the acting role is the auditor."""
    role = F.coalesce(F.col("user_role"), F.lit("AUDITOR")) if "user_role" in saved.columns else F.lit("AUDITOR")
    note = F.col("flag_reason") if "flag_reason" in saved.columns else F.lit("Audited and Verified")
    return saved.filter(F.col("approval_stage") == "AUDITED").select(
        F.col("id").alias("invoice_id"), role.alias("audited_by"), note.alias("audit_note"), at.alias("audited_at")
    )


def editable(df: DataFrame) -> DataFrame:
    return df.withColumn("editable", ~F.col("approval_stage").eqNullSafe("APPROVED"))


def invoice_source(df: DataFrame) -> DataFrame:
    """Adds ``source``: INGESTED_EMAIL for the mail bot or an ingest status, else MANUAL_UPLOAD."""
    bot = F.upper(F.coalesce("created_by", F.lit(""))) == "MAIL_BOT"
    ingested = F.upper(F.coalesce("processing_status", F.lit(""))).contains("INGEST")
    return df.withColumn("source", F.when(bot | ingested, "INGESTED_EMAIL").otherwise("MANUAL_UPLOAD"))


def timeline(invoices: DataFrame, edits: DataFrame) -> DataFrame:
    """Life-cycle events of all invoices: (invoice_id, event_time, stage, description)."""

    def event(hit: Column, time: Column, stage: str, text: Column) -> Column:
        return F.when(
            hit, F.struct(time.alias("event_time"), F.lit(stage).alias("stage"), text.alias("description"))
        )

    stage, approved_at = F.col("approval_stage"), F.col("approval_timestamp")
    who = lambda c: F.coalesce(F.col(c), F.lit("Unknown"))
    events = compact(
        [
            event(F.col("created_at").isNotNull(), F.col("created_at"), "UPLOADED", F.concat(F.lit("Uploaded by "), who("created_by"))),
            event(
                F.col("reviewed_by") != "",
                F.coalesce(approved_at, F.col("created_at")),
                "REVIEWED",
                F.concat(F.lit("Reviewed by Manager ("), who("reviewed_by"), F.lit(")")),
            ),
            event(stage == "APPROVED", approved_at, "APPROVED", F.concat(F.lit("Approved by "), who("approved_by"))),
            event(stage == "REJECTED", approved_at, "REJECTED", F.lit("Rejected by Manager")),
            event(
                stage == "AUDITED", F.coalesce(F.col("reprocessed_at"), approved_at), "AUDITED", F.lit("Audited and Verified")
            ),
        ]
    )
    lived = invoices.select(F.col("id").alias("invoice_id"), F.inline_outer(events)).filter(F.col("stage").isNotNull())
    edited = (
        edits.groupBy("invoice_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("edited_at").alias("event_time"))
        .join(invoices.select(F.col("id").alias("invoice_id")), "invoice_id", "left_semi")
        .select(
            "invoice_id",
            "event_time",
            F.lit("EDITED").alias("stage"),
            F.concat(F.col("n").cast("string"), F.lit(" edit(s) made by AP Clerk")).alias("description"),
        )
    )
    return lived.unionByName(edited)

"""Shape of physical plans: no Python row functions, pushdown, no one-task windows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.operators import mail, metrics, reports, validation
from tallyframe.plans import reporting
from tallyframe.plans.registry import all_queries
from tallyframe.sources import derived

QUERIES = all_queries()
MAIL = {
    "newest_messages", "decode_headers", "explode_attachments", "storage_path", "ingest_outcome",
    "ingest_summary", "ingest_status", "scan_messages",
}
# Streams take their plans batch by batch; the batch operators they use are covered by the other keys.
STREAMS = {k for k in QUERIES if k.startswith("stream_")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of all tables that a query writes on the way to its result."""
    plans, write = [], session.store

    def store(df, label):
        plans.append(plan_of(df))
        return write(df, label)

    monkeypatch.setattr(session, "store", store)
    return plans


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMS))
def test_native_columns_and_partitioned_windows(key, spark, sf_dir, written):
    plans = [plan_of(QUERIES[key].build(spark, sf_dir)), *written]
    assert any("MapInPandas" in p for p in plans) == (key in MAIL)
    for plan in plans:
        assert "EvalPython" not in plan and "FlatMapGroupsInPandas" not in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        for window in re.findall(r"Window \[.*", plan):
            assert not re.search(r"windowspecdefinition\((?!\w+#)", window), window


def scans(plan: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet .*/{table}[./\]]", plan))


@pytest.mark.parametrize(("key", "table"), [("compliance_issues", "lineitem"), ("compliance_verdict", "lineitem"), ("validation_status", "lineitem")])
def test_lines_are_read_once(key, table, spark, sf_dir, written):
    """Once for the invoices' sums; the numbered lines are another table, which the rules read once."""
    result = plan_of(QUERIES[key].build(spark, sf_dir))
    assert scans(result, table) <= 1
    assert all(scans(p, table) <= 1 for p in written)


def test_rules_read_a_line_table_once(spark, sf_dir, tmp_path):
    derived.lines(spark, sf_dir).write.parquet(f"{tmp_path}/lines")
    held = []
    headers = derived.raw_headers(derived.invoices(spark, sf_dir))
    rows = validation.compliance_issue_rows(
        headers, spark.read.parquet(f"{tmp_path}/lines"), "src_key", keep=lambda df: held.append(plan_of(df)) or session.stored(df, "facts")
    )
    assert scans(held[0], "lines") == 1 and scans(plan_of(rows), "lines") == 0


def test_first_wins_reads_orders_once(spark, sf_dir, written):
    result = plan_of(QUERIES["first_wins"].build(spark, sf_dir))
    assert scans(result, "orders") == 0 and [scans(p, "orders") for p in written] == [1]


def test_newest_messages_are_chosen_by_id_alone(spark, sf_dir):
    raw = derived.raw_messages(derived.table(spark, sf_dir, "documents"))
    plan = plan_of(mail.newest_messages(raw, 100))
    top = re.search(r"TakeOrderedAndProject\(.*", plan)[0]
    assert "raw#" not in top


def test_scan_reads_only_what_a_sum_needs(spark, sf_dir):
    plan = plan_of(derived.line_amounts(spark, sf_dir).groupBy("invoice_id").sum("total_price"))
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>", plan)


def test_stage_filter_reaches_the_stored_table(spark, sf_dir, tmp_path):
    path = f"{tmp_path}/inv"
    derived.invoices(spark, sf_dir).write.parquet(path)
    plan = plan_of(metrics.approved_report(spark.read.parquet(path)))
    assert "EqualTo(approval_stage,APPROVED)" in plan


def test_top_lists_keep_k_rows_per_task(spark, sf_dir):
    inv = derived.invoices(spark, sf_dir)
    assert "WindowGroupLimit" in plan_of(metrics.recent_by_source(inv))
    assert "TakeOrderedAndProject" in plan_of(metrics.top_vendors(inv))


def test_fences_are_stripped_from_every_payload(spark, sf_dir):
    rows = QUERIES["strip_fences"].build(spark, sf_dir).filter("source = 'invoice'")
    assert rows.count() == derived.invoice_status(spark, sf_dir).count()
    assert rows.filter("payload LIKE '%```%' OR payload NOT LIKE '%line_items%'").isEmpty()


def test_flattened_payloads_are_read_once(spark, tmp_path, written):
    df = spark.createDataFrame([(1, '{"a": {"b": 1}}'), (2, None), (None, '{"a": {"b": 2}}')], "id long, ai_raw_data string")
    df.write.parquet(f"{tmp_path}/given")
    wide = reports.ai_flattened(spark.read.parquet(f"{tmp_path}/given"))
    assert sum(scans(p, "given") for p in [*written, plan_of(wide)]) == 1
    assert sorted(map(tuple, wide.collect()), key=str) == [(1, "1"), (2, None), (None, None)]


def test_export_works_payloads_out_once(spark, sf_dir, written):
    tables = reporting.transparency(spark, sf_dir)
    plans = [*written, *map(plan_of, tables.values())]
    assert sum("collect_list" in p for p in plans) == 1  # lines gathered to payloads


def test_only_what_signals_need_goes_through_their_joins(spark, sf_dir, written):
    QUERIES["crm_outbox"].build(spark, sf_dir)
    joins = [p for p in written if "duplicate_key" in p]
    assert len(joins) == 1 and "document_hash" not in joins[0]


def shuffle_files(spark) -> int:
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return len(re.findall(r"/shuffle_", disk.getAllFiles().mkString("\n")))


def test_shuffle_files_go_with_the_write(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before = shuffle_files(spark)
    path = session.store(rows, "grouped")
    assert spark.read.parquet(path).count() == 10
    assert shuffle_files(spark) <= before
    assert len(rows.collect()) == len(rows.collect()) == 10  # a repeated action makes them anew


def test_lines_are_shuffled_once_to_their_payloads(spark, sf_dir, written):
    plan = plan_of(derived.payloads(derived.invoices(spark, sf_dir), derived.lines(spark, sf_dir)))
    assert "collect_list" in plan and not re.search(r"Exchange hash[^\n]*\n[^\n]*ObjectHashAggregate", plan)
    assert "Window" not in plan and sum("Window" in p and "lineitem" in p for p in written) == 1


def test_only_what_is_read_stays_in_scratch(spark, sf_dir):
    with session.noted() as made:
        QUERIES["ai_flattened"].build(spark, sf_dir)
    left = {p.rsplit("/", 1)[1].split("-")[1] for p in made if spark.sparkContext._jvm.java.io.File(p.removeprefix("file:")).exists()}
    assert left == {"payload", "shared"}


def test_export_leaves_its_two_bases_and_the_opened_payloads(spark, sf_dir):
    with session.noted() as made:
        tables = reporting.transparency(spark, sf_dir)
    left = sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in made if spark.sparkContext._jvm.java.io.File(p.removeprefix("file:")).exists())
    assert left[:1] == ["tallyframe-ledger"] and set(left[1:]) == {"tallyframe-payload-level", "tallyframe-payloads", "tallyframe-shared-ids"}
    assert next(iter(tables)) == "ai_flattened"


def test_payloads_of_ids_of_their_own_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1}}'), (2, None)], "id long, ai_raw_data string")
    assert "Exchange" not in plan_of(reports.ai_flattened(df))

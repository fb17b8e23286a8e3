"""Set-based operators against one-at-a-time models, with hot keys in the data."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.ranking import number_rows, rank_rows, totals_before
from tallyframe.operators import dedup, mail, risk, vendors, workflow
from tallyframe.session import stored
from tallyframe.streaming import jobs
from tallyframe.streaming.levels import Levels, newest_of
from test_rules import ALLOWED, ROLES

STAGES = ("UPLOADED", "REVIEWED", "APPROVED", "REJECTED", "AUDITED")


def replay_model(rows, start=None):
    stage = dict(start or {})
    out = {}
    for event_id, invoice, nxt, role in sorted(rows):
        before = stage.get(invoice, "new")
        ok = role in ALLOWED.get((before, nxt), set())
        out[event_id] = ("" if before == "new" else before, ok)
        if ok:
            stage[invoice] = nxt
    return out, stage


def random_requests(n, seed):
    rng = random.Random(seed)
    # invoice 0 holds a third of all requests
    return [(i, rng.choice([0] * 20 + list(range(1, 41))), rng.choice(STAGES), rng.choice(ROLES)) for i in range(n)]


def requests_frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, invoice_id long, next_stage string, user_role string")


@pytest.mark.parametrize("seed", [1, 2])
def test_replay(spark, seed):
    rows = random_requests(1500, seed)
    expected, last = replay_model(rows)
    got = workflow.replay_requests(requests_frame(spark, rows)).cache()
    assert {r.event_id: (r.previous_stage, r.accepted) for r in got.collect()} == expected
    assert {r.invoice_id: r.approval_stage for r in workflow.latest_stage(got).collect()} == last


def test_replay_on_existing_stages(spark):
    rows = random_requests(400, 3)
    start = {0: "REVIEWED", 1: "APPROVED", 2: "REJECTED", 3: "UPLOADED", 4: "AUDITED"}
    expected, _ = replay_model(rows, start)
    current = spark.createDataFrame(list(start.items()), "invoice_id long, approval_stage string")
    got = workflow.replay_requests(requests_frame(spark, rows), current)
    assert {r.event_id: (r.previous_stage, r.accepted) for r in got.collect()} == expected


def first_wins_model(rows, stored):
    hashes = {h for h, *_ in stored if h is not None}
    keys = {tuple(k) for _, *k in stored if None not in k}
    kept, seen_hash = [], set()
    for row in sorted(rows, key=lambda r: r[0]):
        h = row[1]
        if h is not None and (h in hashes or h in seen_hash):
            continue
        if h is not None:
            seen_hash.add(h)
        key = row[2:]
        if None not in key:
            if key in keys:
                continue
            keys.add(key)
        kept.append(row[0])
    return kept


@pytest.mark.parametrize("partitions", [1, 7])
def test_first_wins(spark, partitions):
    rng = random.Random(5)
    pick = lambda values: rng.choice(values)
    rows = [
        (i, pick(["hot"] * 15 + [f"h{j}" for j in range(30)] + [None]), pick(["v1", "v2", None]), pick(["d1", "d2", "d3"]), pick([1, 2, 3]))
        for i in range(300)
    ]
    stored = [("h3", "v1", "d1", 1), (None, "v2", "d2", None)]
    schema = "id long, document_hash string, vendor_name string, invoice_date string, total_amount long"
    batch = spark.createDataFrame(rows, schema).repartition(partitions)
    known = spark.createDataFrame(stored, schema.removeprefix("id long, "))
    got = [r.id for r in dedup.first_wins(batch, known, ["id"]).orderBy("id").collect()]
    assert got == first_wins_model(rows, stored)


def outcome_model(rows, results, stored):
    hashes, keys, out = {h for h, *_ in stored}, {tuple(k) for _, *k in stored}, {}
    for message_id, idx, content, failed_upload, failed_save in sorted(rows):
        h = f"hash-{content}"
        status, *key = results.get(content, ("MISSING", None, None, None))
        known_key = None not in key and tuple(key) in keys
        if h in hashes:
            result = "DUPLICATE_HASH"
        elif status != "OK":
            result = "FAILED_EXTRACTION"
        elif known_key:
            result = "DUPLICATE_KEY"
        elif failed_upload:
            result = "FAILED_UPLOAD"
        elif failed_save:
            result = "FAILED_SAVE"
        else:
            result = "INGESTED"
            hashes.add(h)
            keys.add(tuple(key))
        out[(message_id, idx)] = result
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ingest_outcome(spark, seed):
    rng = random.Random(seed)
    contents = ["hot"] * 12 + [f"c{i}" for i in range(24)]
    rows = [(m, i, rng.choice(contents), rng.random() < 0.2, rng.random() < 0.1) for m in range(60) for i in range(rng.randint(1, 3))]
    results = {
        c: (rng.choice(["OK", "OK", "OK", "FAILED"]), rng.choice(["v1", "v2", None]), rng.choice(["d1", "d2", "d3"]), rng.choice([1, 2, 3]))
        for c in set(contents) - {"c5"}
    }
    stored = [("hash-c1", "v9", "d9", 9), ("hash-x", "v1", "d1", 1)]
    kept = spark.createDataFrame(rows, "message_id long, idx long, content_key string, upload_failed boolean, save_failed boolean").withColumn(
        "document_hash", F.concat(F.lit("hash-"), "content_key")
    )
    key = "vendor_name string, invoice_date string, total_amount long"
    known = spark.createDataFrame([(c, *v) for c, v in results.items()], f"content_key string, parse_status string, {key}")
    old = spark.createDataFrame(stored, f"document_hash string, {key}")
    got = mail.ingest_outcome(kept, known, old).collect()
    assert len(got) == len(rows)
    assert {(r.message_id, r.idx): r.outcome for r in got} == outcome_model(rows, results, stored)
    by_hash = known.withColumn("document_hash", F.concat(F.lit("hash-"), "content_key"))
    assert sorted(map(str, mail.ingest_outcome(kept, by_hash, old).select("message_id", "idx", "outcome").collect())) == sorted(
        str(r) for r in mail.ingest_outcome(kept, known, old).select("message_id", "idx", "outcome").collect()
    )


def test_rows_of_any_key_are_numbered_like_row_number(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k"),
        F.floor(F.hash("id") % 5).alias("a"),
        F.col("id").alias("b"),
    )
    window = Window.partitionBy("k").orderBy("a", "b")
    want = df.withColumn("n", F.row_number().over(window).cast("long"))
    got = number_rows(df, "k", ["a", "b"], "n")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert number_rows(df.limit(0), "k", ["a"], "n").count() == 0


@pytest.fixture
def small_partitions(spark):
    """Adaptive execution would merge the small partitions of a test into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_hot_key_is_numbered_in_several_tasks(spark, small_partitions):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.xxhash64("id").alias("a"))
    got = number_rows(df, "k", ["a"], "n")
    assert got.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (1, 20_000, 20_000)
    kept = []
    number_rows(df, "k", ["a"], "n", lambda d: kept.append(d) or stored(d, "test"))
    parts = kept[0].groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 15_000


def test_hot_and_other_keys_are_numbered_alike(spark):
    """Only rows of hot keys are dealt and written on the way; a null may be a hot key."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"), F.xxhash64("id").alias("a")
    )
    kept = []
    got = number_rows(df, "k", ["a"], "n", lambda d: kept.append(stored(d, "test")) or kept[0])
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("a")).cast("long"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert kept[0].filter("k IS NULL").count() == 20_000 and kept[0].count() < 20_000 + 10_000


def test_ranks_over_all_rows(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("h"))
    got = [r.n for r in rank_rows(df, ["h"], "n").orderBy("h").collect()]
    assert got == list(range(1000))


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    when = lambda: start + dt.timedelta(hours=rng.randint(0, 200))
    who = lambda: rng.choice(["hot"] * 10 + ["a", "b", "c"] + [None])
    approved = [(i, who(), rng.randint(1, 500), f"d{i}", when()) for i in range(200)]
    invoices = [(i, who(), rng.randint(1, 2000), when()) for i in range(300)]
    money = F.col("total").cast("decimal(18,2)").alias("total_amount")
    a = spark.createDataFrame(approved, "id long, vendor_name string, total int, invoice_date string, approved_at timestamp_ntz")
    i = spark.createDataFrame(invoices, "id long, vendor_name string, total int, created_at timestamp_ntz")
    return approved, invoices, a.select("id", "vendor_name", money, "invoice_date", "approved_at"), i.select("id", "vendor_name", money, "created_at")


def test_average_as_of_each_invoice(history):
    approved, invoices, a, i = history
    got = {r.id: (r.vendor_avg, r.anomaly) for r in risk.vendor_anomaly_asof(i, a).collect()}
    assert len(got) == len(invoices)
    for id_, vendor, total, created in invoices:
        past = [t for _, v, t, _, at in approved if v == vendor and v is not None and at < created]
        mean = sum(past) / len(past) if past else None
        assert got[id_] == (mean, mean is not None and total > 2 * mean)


def test_one_vendor_in_one_day_spreads_over_tasks(spark, small_partitions):
    """As many approvals of one vendor within a day as seconds: the running sums are cut by time, not by day."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)")
    money = F.lit(1).cast("decimal(18,2)").alias("total_amount")
    approved = spark.range(40_000).select(F.lit("v").alias("vendor_name"), money, at.alias("approved_at"))
    moments = approved.groupBy("vendor_name", F.col("approved_at").alias("ts")).agg(F.sum("total_amount").alias("value"))
    held = []
    sums = totals_before(moments, "vendor_name", ["ts"], {"before": F.col("value")}, lambda d: held.append(stored(d, "test")) or held[0])
    assert sums.filter("before <> unix_seconds(CAST(ts AS timestamp)) - unix_seconds(timestamp'2024-01-01')").count() == 0
    sizes = [r["count"] for r in held[0].groupBy(F.shiftright("_place", 33)).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 30_000
    invoice = spark.sql("SELECT 1L AS id, 'v' AS vendor_name, 5BD AS total_amount, TIMESTAMP_NTZ '2024-01-01 05:00:00' AS created_at")
    assert risk.vendor_anomaly_asof(invoice, approved).first().vendor_avg == 1.0


def test_as_of_after_all_approvals_equals_stored_profile(history):
    _, _, a, i = history
    late = i.withColumn("created_at", F.expr("TIMESTAMP_NTZ '2030-01-01'"))
    asof = {r.id: (r.vendor_avg, r.anomaly) for r in risk.vendor_anomaly_asof(late, a).collect()}
    plain = {r.id: (r.vendor_avg, r.anomaly) for r in risk.vendor_anomaly(late, vendors.vendor_profile(a)).collect()}
    assert asof == plain


def test_profile_equals_running_mean(history):
    approved, _, a, _ = history
    state = {}
    for id_, vendor, total, date, at in sorted(approved, key=lambda r: (r[4], r[0])):
        if vendor is None:
            continue
        mean, n, _ = state.get(vendor, (0.0, 0, None))
        state[vendor] = ((mean * n + total) / (n + 1), n + 1, date)
    got = {r.vendor_name: r for r in vendors.vendor_profile(a).collect()}
    assert set(got) == set(state)
    for vendor, (mean, n, date) in state.items():
        assert got[vendor].avg_invoice_value == pytest.approx(mean)
        assert (got[vendor].invoice_count, got[vendor].last_invoice_date) == (n, date)


# --- streams in several batches equal their batch twins ---


def in_files(df, path, order, files=4):
    """Write df as several files that arrive in the given order."""
    n = df.count()
    for part in range(files):
        lo, hi = n * part // files, n * (part + 1) // files
        df.filter((F.col(order) >= lo) & (F.col(order) < hi)).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("every", [1, 3, 50])
def test_guard_stream_equals_replay(spark, tmp_path, every):
    rows = random_requests(800, 9)
    source = in_files(requests_frame(spark, rows), f"{tmp_path}/in", "event_id")
    stream = jobs.table_stream(spark, source, files_per_batch=1)
    jobs.stream_guard(stream, f"{tmp_path}/out", f"{tmp_path}/cp", snapshot_every=every)
    got = jobs.batches(spark, f"{tmp_path}/out/verdicts")
    assert got.select("batch_id").distinct().count() == 4
    assert {r.event_id: (r.previous_stage, r.accepted) for r in got.collect()} == replay_model(rows)[0]


def test_dedup_stream_remembers_and_resumes(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 10 + [f"h{j}" for j in range(40)])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, document_hash string")
    source = in_files(df, f"{tmp_path}/in", "doc_id")
    args = (["doc_id"], f"{tmp_path}/out", f"{tmp_path}/cp")
    jobs.stream_dedup(jobs.table_stream(spark, source, files_per_batch=1), *args)
    spark.createDataFrame([(900, "hot"), (901, "new")], df.schema).coalesce(1).write.mode("append").parquet(source)
    jobs.stream_dedup(jobs.table_stream(spark, source, files_per_batch=1), *args)
    first = {}
    for i, h in [*rows, (901, "new")]:
        first.setdefault(h, i)
    got = jobs.batches(spark, f"{tmp_path}/out/first").collect()
    assert {r.document_hash: r.doc_id for r in got} == first and len(got) == len(first)


def test_dedup_batch_opens_only_folders_of_its_own_hashes(spark, tmp_path):
    df = spark.range(64).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("document_hash"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    jobs.stream_dedup(jobs.table_stream(spark, f"{tmp_path}/in"), ["doc_id"], out, f"{tmp_path}/cp")
    all_files = jobs.known_hashes(out).read(spark, 1).inputFiles()
    some = jobs.known_hashes(out).read(spark, 1, F.col("prefix").isin("5f", "d4"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert len(all_files) > 40 and "PartitionFilters: [prefix" in plan
    scan = jobs.known_hashes(out)._read(spark, jobs.known_hashes(out).parts(1)).filter(F.col("prefix").isin("5f", "d4"))
    assert {f.split("prefix=")[1][:2] for (f,) in scan.select(F.input_file_name()).distinct().collect()} <= {"5f", "d4"}


def test_levels_hold_the_newest_state_in_few_folders(spark, tmp_path):
    def levels(fan):
        return Levels(f"{tmp_path}/l", T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())]), newest_of("k"), fan)

    short, rng, want = levels(3), random.Random(4), {}
    for b in range(14):
        rows = {rng.randrange(6): rng.randrange(100) for _ in range(3)}
        want.update(rows)
        short.add(spark.createDataFrame(list(rows.items()), "k long, v long").coalesce(1), b)
        if b == 8:
            short.add(spark.createDataFrame(list(rows.items()), "k long, v long").coalesce(1), b)  # run again after a failure
        assert {r.k: r.v for r in short.read(spark, b + 1).collect()} == want
    assert short.parts(14) == [f"{tmp_path}/l/level={p}" for p in ("2/part=0", "1/part=3", "0/part=12", "0/part=13")]
    assert max(len(levels(16).parts(n)) for n in range(501)) <= 2 * 15 + 1
    covered = lambda path: 16 ** int(path.split("level=")[1][0])
    assert all(sum(map(covered, levels(16).parts(n))) == n for n in range(501))


def test_profile_stream_equals_batch(spark, history, tmp_path):
    _, _, a, _ = history
    source = in_files(a, f"{tmp_path}/in", "id")
    jobs.stream_vendor_profile(jobs.table_stream(spark, source, files_per_batch=1), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = jobs.current(spark, jobs.profiles(f"{tmp_path}/out"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in vendors.vendor_profile(a).collect()}


def test_trend_stream_drops_rows_behind_the_watermark(spark, tmp_path):
    path = f"{tmp_path}/in"
    schema = "created_at timestamp_ntz, confidence_score double"
    day = lambda d: dt.datetime(2024, 1, d, 12)
    # the mark set by one batch rejects rows from the batch after the next one on
    for rows in ([(day(1), 0.5)], [(day(20), 0.9)], [(day(19), 0.7)], [(day(1), 0.1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    jobs.stream_confidence_trend(jobs.table_stream(spark, path, files_per_batch=1), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = jobs.current(spark, jobs.days(f"{tmp_path}/out")).collect()
    assert {(r.day.day, r.avg_confidence) for r in got} == {(1, 0.5), (19, 0.7), (20, 0.9)}

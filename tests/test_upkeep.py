"""Metrics, reports, retention and timelines on small tables, hot groups included."""

import collections
import datetime
import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import groups, metrics, records, retention


def files(folder):
    return {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, None if i % 50 == 49 else f"m {i % 5}", i % 7 == 0 and i % 5 < 2 or i % 5 == 3) for i in range(100)]
    frame = spark.createDataFrame(rows, "id long, month string, old boolean")
    frame.write.partitionBy("month").parquet(f"{tmp_path}/table")
    return f"{tmp_path}/table", rows


def test_retention_rewrites_touched_partitions_only(spark, table, tmp_path):
    path, rows = table
    before = files(path)
    gone = retention.apply_retention(spark, path, "month", "id", F.col("old"), f"{tmp_path}/audit", "a")
    assert sorted(int(r.resource_id) for r in gone.collect()) == [i for i, _, old in rows if old]
    left = spark.read.schema("id long, old boolean, month string").parquet(path).collect()
    assert sorted((r.id, r.month) for r in left) == sorted((i, m) for i, m, old in rows if not old)
    after = files(path)
    touched = {m for _, m, old in rows if old}
    for p, digest in before.items():
        name = p.split("month=")[1].split("/")[0]
        month = None if "HIVE" in name else name.replace("%20", " ")
        assert (after.get(p) == digest) == (month not in touched)
    assert not glob.glob(f"{path}/month=m?3/*.parquet")


def test_retention_is_repeatable(spark, table, tmp_path, monkeypatch):
    path, rows = table
    with monkeypatch.context() as m:
        # The audit is written, then the run is lost before anything goes.
        m.setattr(type(spark.range(1)), "distinct", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            retention.apply_retention(spark, path, "month", "id", F.col("old"), f"{tmp_path}/audit", "a")
    for _ in range(2):
        gone = retention.apply_retention(spark, path, "month", "id", F.col("old"), f"{tmp_path}/audit", "a")
        assert gone.count() == sum(old for *_, old in rows)
        assert spark.read.parquet(path).count() == sum(not old for *_, old in rows)
    assert retention.apply_retention(spark, path, "month", "id", F.col("old"), f"{tmp_path}/audit", "b").count() == 0


def test_previous_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 2 else f"k{i % 20}", rng.randint(0, 40), i, rng.choice(["a", "b", None])) for i in range(3000)] + [(None, 1, 9000, "x"), (None, 1, 9001, "y")]
    frame = spark.createDataFrame(rows, "k string, t long, id long, v string")
    found = {r.id: r.before for r in groups.previous(frame, ["k"], ["t", "id"], "t", F.col("v"), "before").collect()}
    expected, last = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        expected[i] = last.get(k)
        last[k] = v
    assert found == expected


def test_account_velocity_with_half_the_rows_in_one_supplier(spark):
    rng = random.Random(3)
    start = datetime.date(2024, 1, 1)
    rows = [(i, 1, "Hot GmbH" if i % 2 else f"S {i % 30}", rng.choice(["A", "B", None]), start + datetime.timedelta(days=rng.randint(0, 400)))
            for i in range(2000)]
    frame = spark.createDataFrame(rows, "invoice_id long, org_id long, supplier_name string, iban string, created_on date")
    found = {(r.normalized_name, r.day): (r.changes, r.recent) for r in records.account_velocity(frame).collect()}
    changes, last = collections.defaultdict(collections.Counter), {}
    for i, _, name, iban, day in sorted(rows, key=lambda r: (r[4], r[0])):
        if iban is None:
            continue
        key = name.lower().replace(" ", "")
        changes[key][day] += key in last and last[key] != iban
        last[key] = iban
    expected = {(k, d): (n, sum(m for e, m in own.items() if 0 <= (d - e).days < 90)) for k, own in changes.items() for d, n in own.items() if n}
    assert found == expected


def test_durations_pair_an_end_with_the_start_before_it(spark):
    at = datetime.datetime(2024, 1, 1)
    events = [(1, "extract", s, at + datetime.timedelta(seconds=t), i) for i, (s, t) in enumerate(
        [("running", 0), ("failed", 5), ("done", 6), ("running", 7), ("running", 10), ("done", 10)])] + [(2, "extract", "done", at, 9)]
    found = metrics.stage_durations(spark.createDataFrame(events, "invoice_id long, stage string, status string, created_at timestamp, job_id long"))
    assert sorted((r.invoice_id, r.status, r.seconds) for r in found.collect()) == [(1, "done", 0.0), (1, "failed", 5.0)]


def test_sketches_of_days_merge_to_those_of_the_period(spark):
    rows = [("s" if i % 3 else "hot", datetime.date(2024, 1, 1 + i % 28), float((i * 7919) % 10007)) for i in range(20_000)]
    durations = spark.createDataFrame(rows, "stage string, day date, seconds double")
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    merged = metrics.merged_quantiles(metrics.duration_sketches(durations), ["stage"], shares)
    for r in metrics.rank_checked(durations, merged, ["stage"], shares).collect():
        assert r.p10_close and r.p50_close and r.p99_close and r.n == sum(x[0] == r.stage for x in rows)


def test_a_drop_against_the_stored_report_is_a_row(spark):
    pairs = "invoice_id long, field string, value string"
    expected = spark.createDataFrame([(i, f, "v") for i in range(100) for f in ("total", "iban")], pairs)
    about = spark.createDataFrame([(i, "DE" if i < 90 else None) for i in range(100)], "invoice_id long, country string")

    def report(wrong):
        got = expected.withColumn("value", F.when((F.col("field") == "total") & (F.col("invoice_id") < wrong), "w").otherwise(F.col("value")))
        return metrics.evaluation_report(expected, got, about, ["country"])

    good = report(1)
    assert metrics.regressions(report(1), good).count() == 0
    found = {(r.by, r.of, r.field) for r in metrics.regressions(report(4), good).collect()}
    assert found == {("", None, "total"), ("country", "DE", "total")}
    rows = {(r.by, r.of, r.field): (r.tp, r.fp, r.fn, r.exact) for r in good.collect()}
    assert rows["country", None, "total"] == (10, 0, 0, 1.0) and rows["country", "DE", "total"] == (89, 1, 1, 89 / 90)


def test_pages_read_twice_count_once(spark):
    pages = spark.createDataFrame([(1, "2024-01", 5, 0)] * 3 + [(1, "2024-01", 5, 1), (2, "2024-01", 6, None)],
                                  "org_id long, month string, invoice_id long, page_no int")
    plans = spark.createDataFrame([(1, 1)], "org_id long, pages_month long")
    found = {r.org_id: (r.used, r.over) for r in records.quota(pages, plans).collect()}
    assert found == {1: (2, True), 2: (1, False)}

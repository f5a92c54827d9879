import pytest
from pyspark.sql import functions as F

from tallyfold.sources import files
from tallyfold.streaming import arrivals


def test_new_files_are_taken_once(spark, tmp_path):
    inbox, store, mark = (str(tmp_path / n) for n in ("inbox", "store", "mark"))

    def arrive(rows, part):
        spark.createDataFrame(rows, "file_id INT, org_id INT, sha256 STRING, created_at INT").coalesce(1).write.parquet(
            f"{inbox}/{part}")

    def work_off():
        stream = spark.readStream.schema("file_id INT, org_id INT, sha256 STRING, created_at INT").option(
            "recursiveFileLookup", True).parquet(inbox)
        arrivals.accept_new_files(stream, store, mark)
        return sorted(r.file_id for r in spark.read.parquet(store).collect())

    arrive([(1, 1, "a", 0), (2, 1, "a", 0), (3, 2, "a", 0)], "one")
    assert work_off() == [1, 3]
    arrive([(4, 1, "a", 0), (5, 1, "b", 0)], "two")
    assert work_off() == [1, 3, 5]


def test_usage_waits_for_the_watermark(spark, tmp_path):
    days = ["2024-01-01 10:00:00", "2024-01-02 01:00:00", "2024-01-05 12:00:00"]
    frame = spark.createDataFrame([(1, d) for d in days], "org_id INT, t STRING").select(
        "org_id", F.to_timestamp("t").alias("created_at"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    usage = arrivals.daily_usage(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    writer = usage.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
    arrivals.run_to_end(writer, str(tmp_path / "mark"))
    assert sorted(r.day.day for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_files_are_read_with_hash(spark, tmp_path):
    (tmp_path / "x.PDF").write_bytes(b"abc")
    row = files.scan_files(spark, str(tmp_path)).first()
    assert (row.filename, row.size) == ("x.PDF", 3)
    assert row.sha256.startswith("ba7816bf")


def test_daily_usage_counts_by_day(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 23:00:00"), (1, "2024-01-02 01:00:00")]
    frame = spark.createDataFrame(rows, "org_id INT, t STRING").select(
        "org_id", F.to_timestamp("t").alias("created_at"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    usage = arrivals.daily_usage(stream)
    query = usage.writeStream.outputMode("complete").format("memory").queryName("usage").option(
        "checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("usage").collect()) == [1, 2]


def test_a_log_of_many_batches_opens_few_files(spark, tmp_path):
    from tallyfold.streaming.log import UpdateLog

    def newest(rows):
        return rows.groupBy("k").agg(F.max_by(F.struct("v", "at"), "at").alias("x")).select("k", "x.*")

    log = UpdateLog(spark, str(tmp_path / "log"), newest, every=4)
    want = {}
    for n in range(19):
        rows = [(k, n * 10 + k, n) for k in range(n % 3, 5)]
        want |= {k: v for k, v, _ in rows}
        log.append(spark.createDataFrame(rows, "k int, v int, at int").coalesce(1), n)
        assert len(log.paths()) <= 4
    assert {r.k: r.v for r in log.read().collect()} == want
    assert len(list((tmp_path / "log" / "batch").iterdir())) < 12

    # A fold that fails leaves what there was; run again, it counts.
    before = log.paths()
    broken = UpdateLog(spark, log.folder, lambda rows: rows.select(F.raise_error(F.lit("lost")).alias("k")), 4)
    with pytest.raises(Exception, match="lost"):
        broken.fold()
    assert log.paths() == before and {r.k: r.v for r in log.read().collect()} == want
    log.fold()
    assert len(log.paths()) == 1 and {r.k: r.v for r in log.read().collect()} == want
    log.append(spark.createDataFrame([(0, -1, 18)], "k int, v int, at int"), 18)
    assert {r.k: r.v for r in log.read().collect()} == want


def test_recent_copies_are_dropped_until_the_watermark(spark, tmp_path):
    inbox, store, mark = (str(tmp_path / n) for n in ("inbox", "store", "mark"))
    schema = "file_id INT, org_id INT, sha256 STRING, created_at TIMESTAMP"
    for part, rows in enumerate(([(1, "a", 1), (2, "a", 2), (3, "b", 2)], [(4, "a", 3), (5, "c", 20)], [(6, "a", 21), (7, "c", 21), (8, "d", 2)])):
        spark.createDataFrame([(i, 1, s, f"2024-01-{d:02d}") for i, s, d in rows], "file_id INT, org_id INT, sha256 STRING, t STRING").select(
            "file_id", "org_id", "sha256", F.to_timestamp("t").alias("created_at")).coalesce(1).write.parquet(f"{inbox}/{part}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(inbox)
        found = arrivals.accept_recent_files(stream, store, mark, "5 days")
        kept = sorted(r.file_id for r in found.collect())
    # 2 and 4 repeat a within five days, 6 does not; 8 comes too late.
    assert kept == [1, 3, 5, 6]


def test_all_records_of_arriving_invoices_can_be_read(spark, tmp_path):
    from types import SimpleNamespace

    inbox, store, mark = (str(tmp_path / n) for n in ("inbox", "store", "mark"))
    runs = []

    def process(batch):
        runs.append(batch.count())
        parts = {name: batch.select("invoice_id", F.lit(name).alias("name"), "turn") for name in arrivals.RECORDS}
        parts["fields"] = parts["fields"].union(parts["fields"])
        return SimpleNamespace(**parts)

    for turn, ids in enumerate(([1, 2], [2, 3])):
        spark.createDataFrame([(i, turn) for i in ids], "invoice_id long, turn int").coalesce(1).write.parquet(f"{inbox}/{turn}")
        stream = spark.readStream.schema("invoice_id long, turn int").option("recursiveFileLookup", True).parquet(inbox)
        found = arrivals.process_arriving(stream, process, store, mark)
    assert runs == [2, 2]
    assert sorted((r.invoice_id, r.turn) for r in found.collect()) == [(1, 0), (2, 1), (3, 1)]
    fields = arrivals.arrived_records(spark, store, "fields").collect()
    assert sorted((r.invoice_id, r.turn) for r in fields) == [(1, 0)] * 2 + [(2, 1)] * 2 + [(3, 1)] * 2
    assert arrivals.arrived_records(spark, store, "lines").count() == 3
    assert arrivals.arrived_records(spark, store, "audit").count() == 4

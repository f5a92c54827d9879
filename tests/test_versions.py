"""Changes of some invoices: only they are read, written and seen anew."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import recompute, versions
from tallyfold.operators.versions import Versions

FIELDS = ("invoice_id long, field string, value struct<type:string,value:string,numeric:double,iso:string>, confidence double, "
          "method string, source_text string, validator_status string, validator_detail map<string,string>, status string")
LINES = ("invoice_id long, position long, quantity decimal(18,4), unit_price decimal(18,4), discount_pct decimal(8,4), "
         "vat_rate decimal(8,4), gross decimal(18,4)")
CORRECTIONS = "invoice_id long, field string, new_value string, created_at long, correction_id long"


def field(invoice, name, value, number=None):
    kind = "money" if number is not None else "text"
    return (invoice, name, (kind, value, number, None), 0.95, "rules", value, None, None, "accepted")


@pytest.fixture
def store(spark, tmp_path):
    """Forty invoices in four ranges, all of them right but for the printed total of invoice 7."""
    from decimal import Decimal as D

    ids = range(40)
    fields = [row for i in ids for row in (
        field(i, "subtotal", "100,00", 100.0), field(i, "total_vat", "19,00", 19.0),
        field(i, "total", "120,00" if i == 7 else "119,00", 120.0 if i == 7 else 119.0))]
    lines = [(i, 1, D(2), D(50), D(0), D(19), None) for i in ids]
    orgs = spark.createDataFrame([(1, 0.8)], "org_id long, threshold double")
    invoices = spark.createDataFrame([(i, 1, "processing" if i != 9 else "failed", 0.9) for i in ids],
                                     "invoice_id long, org_id long, status string, reading double")
    made = Versions(spark, str(tmp_path / "store"), span=10)
    recompute.begin(made, invoices, spark.createDataFrame(fields, FIELDS), spark.createDataFrame(lines, LINES), orgs)
    return made, orgs


def states(store, **where):
    return {r.invoice_id: (r.status, r._version) for r in store.newest("invoices", **where).collect()}


def test_a_correction_settles_its_invoice_and_no_other(spark, store):
    store, orgs = store
    before = states(store)
    assert before[7] == ("requires_review", 0) and before[8] == ("completed", 0) and before[9] == ("failed", 0)
    lots = [[(7, "total", "110,00", 1, 1), (7, "total", "119,00", 2, 2), (99, "total", "1", 1, 3), (None, "total", "1", 1, 4)],
            [(8, "total", "500,00", 3, 5), (9, "total", "500,00", 3, 6), (7, "bic", "ABC", 3, 7)]]
    for version, lot in enumerate(lots, 1):
        recompute.recompute(store, spark.createDataFrame(lot, CORRECTIONS), orgs, version)
    after = states(store)
    assert after[7] == ("completed", 2) and after[8] == ("requires_review", 2) and after[9] == ("failed", 2)
    assert {i: s for i, s in after.items() if i not in (7, 8, 9)} == {i: s for i, s in before.items() if i not in (7, 8, 9)}
    seven = {r.field: (r.value.value, r.method, r.status) for r in store.newest("fields").where("invoice_id = 7").collect()}
    assert seven["total"] == ("119,00", "user", "edited") and seven["bic"] == ("ABC", "user", "edited")
    assert store.newest("checks").where("invoice_id = 7 AND status = 'fail'").count() == 0


def test_untouched_ranges_are_not_read(spark, store):
    store, orgs = store
    for path in glob.glob(f"{store.folder}/*/_version=0/_range=*/*.parquet"):
        if "_range=0" not in path:
            open(path, "wb").write(b"unreadable")
    recompute.recompute(store, spark.createDataFrame([(7, "total", "119,00", 1, 1)], CORRECTIONS), orgs, 1)
    one = spark.createDataFrame([(7,)], "invoice_id long")
    assert states(store, of=one) == {7: ("completed", 1)}
    written = {os.path.basename(os.path.dirname(p)) for p in glob.glob(f"{store.folder}/*/_version=1/_range=*/*.parquet")}
    assert written == {"_range=0"}


def test_a_version_counts_from_its_commit_on(spark, store, monkeypatch):
    store, orgs = store
    lot = spark.createDataFrame([(7, "total", "119,00", 1, 1)], CORRECTIONS)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lost)
        with pytest.raises(OSError):
            recompute.recompute(store, lot, orgs, 1)
    assert states(store)[7] == ("requires_review", 0)
    recompute.recompute(store, lot, orgs, 1)
    assert states(store)[7] == ("completed", 1)


def test_no_corrections_change_nothing(spark, store):
    store, orgs = store
    before = states(store)
    recompute.recompute(store, spark.createDataFrame([], CORRECTIONS), orgs, 1)
    assert states(store) == before


def test_corrected_fields_appear_change_and_go(spark):
    fields = spark.createDataFrame([field(1, "total", "5", 5.0), field(1, "note", "old"), field(2, "total", "6", 6.0)], FIELDS)
    lot = [(1, "total", "1.234,50", 1, 1), (1, "note", " ", 1, 2), (1, "due_date", "2024-02-14", 1, 3), (2, "total", None, 1, 4)]
    found = recompute.corrected(fields, spark.createDataFrame(lot, CORRECTIONS)).collect()
    got = {(r.invoice_id, r.field): (r.value.numeric, r.value.iso, r.method, r.confidence) for r in found}
    assert got == {(1, "total"): (1234.5, None, "user", 1.0), (1, "due_date"): (None, "2024-02-14", "user", 1.0),
                   (2, "total"): (6.0, None, "rules", 0.95)}


def test_many_ranges_share_few_folders_of_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FOLDERS", 8)
    rows = spark.range(400).select(F.col("id").alias("invoice_id"), (F.col("id") * 2).alias("x")).repartition(4)
    made = Versions(spark, str(tmp_path / "wide"), span=10)
    made.lay_out(rows)
    made.write("t", rows, 0)
    made.commit(rows.where("false"), 0)
    files = glob.glob(f"{made.folder}/t/_version=0/_range=*/*.parquet")
    assert {os.path.basename(os.path.dirname(f)) for f in files} == {f"_range={r}" for r in range(5)} and len(files) == 5
    again = Versions(spark, made.folder, span=10)
    found = again.newest("t", spark.createDataFrame([(7,), (399,)], "invoice_id long")).collect()
    assert {(r.invoice_id, r.x) for r in found} == {(7, 14), (399, 798)}

"""Reasons, currencies in print, views by role, seeded mistakes and examples on small tables."""

import datetime
import json

from pyspark.sql import functions as F

from tallyfold.operators import checks, records, review

STORED = """invoice_id long, org_id long, field string, value struct<type:string,value:string,numeric:double,iso:string>,
confidence double, method string, source_text string, validator_status string, validator_detail map<string,string>"""


def stored(spark, rows):
    return spark.createDataFrame([(i, org, field, ("text", value, None, None), conf, method, f"near {value}", None, {"rule": value})
                                  for i, org, field, value, conf, method in rows], STORED)


def test_reasons_of_every_kind(spark):
    fields = stored(spark, [(1, 1, "total", "5", 0.9, "rules"), (2, 1, "total", "5", 0.5, "llm"), (3, 1, "iban", "x", 0.5, "rules"),
                            (4, 1, "total", "7", None, "llm")])
    reading = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, None)], "invoice_id long, reading double")
    judged = spark.createDataFrame([(1, "vat_total", "fail"), (2, "vat_total", "pass"), (3, "iban", "fail")],
                                   "invoice_id long, check_name string, status string")
    merged = spark.createDataFrame([(2, "total", "warn"), (2, "iban", None)], "invoice_id long, field string, validator_status string")
    day = datetime.date
    sheets = spark.createDataFrame(
        [(1, day(2024, 1, 1), day(2023, 12, 1), "EUR", day(2024, 1, 2)), (2, day(2030, 1, 1), None, "EUR", day(2024, 1, 2)),
         (3, None, None, None, day(2024, 1, 2)), (4, day(2024, 1, 1), day(2024, 1, 1), "XYZ", day(2024, 1, 2))],
        "invoice_id long, invoice_date date, due_date date, currency string, today date")
    missing = spark.createDataFrame([(3, "total")], "invoice_id long, field string")
    twice = spark.createDataFrame([(2, "total", 1), (2, "number", 1)], "invoice_id long, rule string, first_id long")
    lines = spark.createDataFrame([(1, None, 1.0, "a"), (1, 1.0, 1.0, None), (1, 1.0, 1.0, "c"), (2, None, 1.0, "a"), (2, 1.0, 1.0, "b")],
                                  "invoice_id long, quantity double, unit_price double, description string")
    found = review.reason_codes(
        review.reasons_of_reading(fields, reading), review.reasons_of_models(fields), review.reasons_of_merge(merged),
        review.reasons_of_checks(judged), review.reasons_of_dates(records.sanity_checks(sheets, ("EUR",))),
        review.reasons_of_missing(missing), review.reasons_of_duplicates(twice), review.reasons_of_tables(lines))
    assert {(r.invoice_id, r.field): r.codes for r in found.collect()} == {
        (1, "total"): "LOW_OCR_CONF", (2, "total"): "DUPLICATE_CANDIDATE,PROVIDER_LOW,RULE_LLM_DISAGREE",
        (1, "total_vat"): "VAT_MISMATCH", (1, "due_date"): "DATE_SANITY", (2, "invoice_date"): "DATE_SANITY",
        (3, "total"): "MISSING_MANDATORY", (2, "invoice_number"): "DUPLICATE_CANDIDATE", (1, "line_items"): "TABLE_STRUCTURE_LOW"}


def test_an_invoice_with_half_of_the_reasons_is_combined_before_the_shuffle(spark):
    many = spark.range(5000).select(F.lit(1).cast("long").alias("invoice_id"), F.lit("total").alias("field"))
    found = review.reason_codes(review.reasons_of_missing(many), review.noted(many, F.col("field"), "OTHER"))
    assert [tuple(r) for r in found.collect()] == [(1, "total", "MISSING_MANDATORY,OTHER")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_set" in plan


def test_currencies_in_print(spark):
    sheets = spark.createDataFrame([(1, "eur"), (2, "EUR"), (3, "EUR"), (4, None), (5, "USD"), (6, "GBP")], "invoice_id long, currency string")
    texts = spark.createDataFrame(
        [(1, "Summe 5€"), (1, "EUR 7 und 8 EUR"), (2, "5 EUR, $7"), (3, "EUROPA in NEURUPPIN"), (4, "€"), (5, "USD5"), (5, None), (6, "£1 CHF2")],
        "invoice_id long, text string")
    found = {r.invoice_id: (r.status, r.printed) for r in review.currency_consistency(sheets, texts).collect()}
    assert found == {1: ("pass", "EUR"), 2: ("warn", "EUR,USD"), 5: ("pass", "USD"), 6: ("warn", "CHF,GBP")}


def test_personal_fields_by_role(spark):
    rows = [(i, i, f, v, 0.9, "rules") for i in range(1, 5) for f, v in
            (("iban", "DE02120300000000202051"), ("supplier_name", "Nordwind"), ("total", "5"))]
    fields = stored(spark, rows + [(9, 2, "iban", "DE", 0.9, "rules"), (9, 2, "supplier_name", None, 0.9, "rules")])
    roles = spark.createDataFrame([(1, "owner"), (2, "viewer"), (3, None)], "org_id long, role string")
    seen = review.visible_to(fields, roles)
    assert seen.columns == fields.columns
    values = {(r.invoice_id, r.field): (r.value.value, r.source_text) for r in seen.collect()}
    assert values[1, "iban"] == ("DE02120300000000202051", "near DE02120300000000202051")
    for i in (2, 3, 4):
        assert values[i, "iban"] == ("DE02****51", None) and values[i, "supplier_name"] == ("N***", None)
        assert values[i, "total"] == ("5", "near 5")
    assert values[9, "iban"] == ("****", None) and values[9, "supplier_name"] == (None, None)
    told = json.dumps([r.asDict(recursive=True) for r in seen.where("org_id <> 1").collect()])
    assert "202051" not in told and "Nordwind" not in told


def test_seeded_mistakes_are_of_five_classes_and_found(spark):
    money = [f"CAST({n} AS DECIMAL(18,4)) AS {c}" for n, c in ((100, "subtotal"), (19, "total_vat"), (0, "shipping"), (0, "other"), (119, "total"))]
    invoices = spark.range(40).selectExpr(
        "id AS invoice_id", *money, "'DE89370400440532013000' AS iban", "'DE123456789' AS supplier_vat")
    # Of every fourth invoice the total is wrong from the start.
    invoices = invoices.withColumn("total", F.when(F.col("invoice_id") % 4 == 0, F.col("total") + 5).otherwise(F.col("total")))
    lines = spark.range(40).selectExpr(
        "id AS invoice_id", "1 AS position", "CAST(1 AS DECIMAL(18,4)) AS quantity", "CAST(100 AS DECIMAL(18,4)) AS unit_price",
        "CAST(0 AS DECIMAL(8,4)) AS discount_pct", "CAST(19 AS DECIMAL(8,4)) AS vat_rate", "CAST(119 AS DECIMAL(18,4)) AS gross")
    good = review.sound(invoices, checks.all_checks(invoices, lines).where("check_name <> 'reverse_charge'"))
    assert good.count() == 30
    seeded = review.seed_mistakes(good)
    assert {r.mistake for r in seeded.collect()} == {"drift", "vat_code", "iban_code", "swapped", "missing"}
    failed = checks.all_checks(seeded, lines).where("status = 'fail'").select("invoice_id", F.col("check_name").alias("name"))
    missing = seeded.where("iban IS NULL").select("invoice_id", F.lit("missing_iban").alias("name"))
    found = {r.mistake: (r.n, r.caught) for r in review.mistake_recall(seeded, failed.union(missing)).collect()}
    counts = {m: sum(i % 10 == k and i % 4 != 0 for i in range(40)) for k, m in enumerate(["drift", "vat_code", "iban_code", "swapped", "missing"])}
    assert found == {m: (n, n) for m, n in counts.items()}
    # A finding of another kind is no catch.
    other = seeded.select("invoice_id", F.lit("vat_total").alias("name"))
    assert all(r.caught == 0 for r in review.mistake_recall(seeded, other).collect())


def test_only_correct_values_are_examples(spark):
    fields = stored(spark, [(i, 1, "total", str(i), 0.5 + i / 100, "rules") for i in range(8)])
    corrections = spark.createDataFrame(
        [(1, 7, "total", "x", 1), (2, 6, "total", "x", 1), (3, 6, "total", "6", 2)],
        "correction_id long, invoice_id long, field string, new_value string, created_at long")
    about = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(8)], "invoice_id long, supplier string")
    found = review.correct_examples(fields, corrections, about, ["supplier"], k=2).collect()
    assert sorted((r.supplier or "", r["rank"], r.invoice_id) for r in found) == [("", 1, 6), ("", 2, 4), ("a", 1, 5), ("a", 2, 3)]

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyfold import fixed_values as fixed
from tallyfold.functions import kinds, values
from tallyfold.operators import checks, scoring


def one(spark, column, **inputs):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()] or ["id"])
    return frame.select(column.alias("out")).first()["out"]


def each(spark, texts, use):
    frame = spark.createDataFrame([(t,) for t in texts], "t STRING").coalesce(1)
    return [r[0] for r in frame.select(use(F.col("t"))).collect()]


def test_parse_decimal(spark):
    cases = {
        "1.234,56": 1234.56, "1234.56": 1234.56, "1,000.00": 1000.0, "1.000": 1000.0,
        "-5,00": -5.0, "0": 0.0, "1190,00.": 119000.0, "1,5": 1.5, "1,234": 1234.0,
        "1.234.567": 1234567.0, ".": None, "5-3": None, "": None, "EUR 12,50": 12.5, "1,,2": None,
    }
    assert each(spark, list(cases), values.parse_decimal) == list(cases.values())
    trimmed = each(spark, ["1190,00."], lambda c: values.parse_decimal(c, strict=False))
    assert trimmed == [1190.0]


def test_amounts_and_dates(spark):
    found = each(spark, ["EUR 12,50 and 1.000,00€ or 3 or 99999999999999"], values.amounts_in)[0]
    assert [(a.raw, a.value) for a in found] == [("12,50", 12.5), ("1.000,00", 1000.0)]
    hits = each(spark, ["2024-02-29 then 1.3.2024, 31.02.2024 and x1.1.2024"], values.dates_in)[0]
    assert [(h.raw, h.day) for h in hits] == [
        ("1.3.2024", date(2024, 3, 1)), ("2024-02-29", date(2024, 2, 29)),
    ]
    assert each(spark, ["2024-02-30", "2024-02-03", "x"], values.iso_to_date) == [
        None, date(2024, 2, 3), None,
    ]


def test_codes(spark):
    ibans = {
        "DE89370400440532013000": "valid", "BE68539007547034": "valid",
        "DE89370400440532013001": "mod97_failed", "DE89 3704 0044 0532 0130 00": "valid",
        "DE8937040": "bad_length", "XX89370400440532013000": "unknown_country_prefix", "": "missing",
    }
    assert each(spark, list(ibans), lambda c: values.iban_finding(c)["reason"]) == list(ibans.values())
    vats = {
        "DE811123456": "pass", "FR12345678901": "pass", "NL123456789B01": "pass",
        "ATU12345678": "pass", "DE123": "fail", "XX12345678": "warn", "de 811123456": "pass",
    }
    assert each(spark, list(vats), lambda c: values.vat_finding(c)["status"]) == list(vats.values())


def test_any_changed_digit_breaks_an_account_number(spark):
    rng, good, bad = random.Random(7), [], []
    for _ in range(40):
        body = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int(body + "131400") % 97
        number = f"DE{check:02d}{body}"
        good.append(number)
        at = rng.randrange(4, 22)
        other = rng.choice([d for d in "0123456789" if d != number[at]])
        bad.append(number[:at] + other + number[at + 1:])
    assert all(each(spark, good, values.iban_is_valid))
    assert not any(each(spark, bad, values.iban_is_valid))


def test_text_keys(spark):
    assert each(spark, ["  Seehof \t Straße\n"], values.collapse) == ["seehof strasse"]
    assert each(spark, ["Seehof GmbH"], values.comparison_key) == ["seehofgmbh"]


def test_keywords_match_plain_substring_search(spark):
    rng = random.Random(3)
    words = [w for ws in fixed.DOCUMENT_TYPE_WORDS.values() for w in ws]
    words += [w for ws in fixed.LANGUAGE_WORDS.values() for w in ws]
    texts = ["".join(rng.choice([rng.choice(words), " ", "x", "s"]) for _ in range(12))
             for _ in range(60)] + [w.upper() for w in words] + ["", "nothing"]
    for table in kinds.ALL_WORDS:
        own = [w.lower() for ws in table.values() for w in ws]
        got = each(spark, texts, lambda c, t=table: F.array_sort(
            kinds.keyword_numbers(kinds.keywords_in(c), t)))
        assert got == [[i for i, w in enumerate(own) if w in t.lower()] for t in texts]


def test_document_type_and_language(spark):
    def kind(c):
        return kinds.document_type(
            kinds.keyword_numbers(kinds.keywords_in(c), fixed.DOCUMENT_TYPE_WORDS))

    found = each(spark, ["Rechnung, Fällig am", "Kontoauszug", "nichts"], kind)
    assert [f.doc_type for f in found] == ["invoice", "bank_statement", "unknown"]
    assert found[1].keywords == ["kontoauszug", "kontoauszug"] and found[1].confidence == 1.0
    assert found[2].confidence == 0.0
    tongue = each(spark, ["MwSt", "total", "zzz"], lambda c: kinds.language(
        kinds.keyword_numbers(kinds.keywords_in(c), fixed.LANGUAGE_WORDS)))
    assert [(t.language, round(t.confidence, 4)) for t in tongue] == [
        ("de", 0.7), ("en", 0.6), (None, 0.0),
    ]


def test_column_roles(spark):
    heads = {"Beschreibung": "description", "MwSt %": "vat_rate", "MwSt": "vat_amount",
             "Netto": "net", "Brutto": "gross", "Pos": "position", "Foo": "text", "Qty": "quantity"}
    assert each(spark, list(heads), kinds.column_role) == list(heads.values())


def test_line_arithmetic(spark):
    def net(q, p, d):
        cells = [F.lit(x).cast("decimal(18,4)") for x in (q, p, d)]
        return str(one(spark, checks.line_net(*cells)))

    assert net("2", "49.90", "0") == "99.80"
    assert net("10", "10.00", "10") == "90.00"
    assert net("1", "0.335", "0") == "0.34"
    assert net("1000000", "1234567.89", "5") == "1172839495500.00"
    cents = F.lit("99.80").cast("decimal(24,2)")
    assert str(one(spark, checks.line_vat(cents, F.lit(19)))) == "18.96"


@pytest.mark.parametrize("method,reading,validator,field,low,high", [
    (1.0, 0.99, "pass", "supplier_name", 0.9, 1.0),
    (0.95, 0.95, "fail", "total", 0.0, 0.4999),
    (0.5, 0.4, None, "invoice_number", 0.0, 0.6999),
])
def test_field_confidence(spark, method, reading, validator, field, low, high):
    score = one(spark, scoring.field_confidence(
        F.lit(method), F.lit(reading), F.lit(1.0), F.lit(validator).cast("string"), F.lit(field)))
    assert low <= score <= high

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from golden import CELL_SCHEMA, IBAN, TABLE, block_frame, cell_frame, golden_blocks
from tallyfold.operators import answers, checks, fields, groups, lines, scoring, search, state
from tallyfold.sinks import export
from tallyfold.sources import files, pages


def invoice(spark, total, with_line=True):
    invoices = spark.createDataFrame(
        [(1, Decimal("400"), Decimal("76"), None, None, Decimal(total), IBAN, "DE284619357")],
        "invoice_id BIGINT, subtotal DECIMAL(18,4), total_vat DECIMAL(18,4), "
        "shipping DECIMAL(18,4), other DECIMAL(18,4), total DECIMAL(18,4), iban STRING, "
        "supplier_vat STRING",
    )
    rows = [(1, 1, Decimal("4"), Decimal("100"), None, Decimal("19"), Decimal("476"))]
    items = spark.createDataFrame(
        rows if with_line else [],
        "invoice_id BIGINT, position INT, quantity DECIMAL(18,4), unit_price DECIMAL(18,4), "
        "discount_pct DECIMAL(8,4), vat_rate DECIMAL(8,4), gross DECIMAL(18,4)",
    )
    return invoices, items


def test_golden_invoice_is_read_field_by_field(spark):
    blocks = golden_blocks(spark)
    row = fields.header(fields.classify_blocks(blocks), fields.find_all_wide(blocks)).first()
    assert row.asDict() == {
        "doc_id": 1, "doc_type": "invoice", "language": "de", "country": "DE",
        "invoice_number": "PW-7731", "invoice_date": date(2023, 6, 3),
        "due_date": date(2023, 6, 17), "supplier_name": "Seehof Papierwaren GmbH",
        "supplier_vat": "DE284619357", "currency": "EUR", "subtotal": Decimal("400.0000"),
        "total_vat": Decimal("76.0000"), "total": Decimal("476.0000"),
        "iban": IBAN,
    }
    assert {r.field for r in fields.find_fields(blocks).collect()} == set(fields.FOUND_FIELDS)


def test_traps_of_the_finders(spark):
    blocks = block_frame(spark, {
        1: ["Rechnungsdatum: 1.2.2024", "Rechnung Nr.: 77-1"],
        2: ["Fällig 1.1.2024", "Due 2.2.2024", "Total 5,00", "Total 7,00"],
        3: ["Rechnung 2024", f"IBAN {IBAN} und"],
        4: ["Fällig 1.1.2024", "am 3.3.2024", "Due 2.2.2024"],
    })
    wide = {r.doc_id: r for r in fields.find_wide(blocks).collect()}
    assert wide[1].invoice_number.value.value == "sdatum"
    assert wide[2].due_date.value.iso == "2024-01-01"
    assert wide[2].invoice_date.value.iso == "2024-02-02"
    assert wide[2].total.value.numeric == 7.0
    assert wide[4].invoice_date.value.iso == "2024-03-03"
    assert 3 not in wide or (wide[3].invoice_number is None and wide[3].iban is None)


def test_checks_of_the_golden_invoice(spark):
    found = checks.all_checks(*invoice(spark, "476"), only_present=True).collect()
    assert {c.check_name: c.status for c in found} == {
        "line_gross_0": "pass", "subtotal": "pass", "vat_total": "pass", "grand_total": "pass",
        "iban": "pass", "vat_format": "pass",
    }
    wrong = checks.all_checks(*invoice(spark, "1500")).where("status = 'fail'").collect()
    assert [(c.check_name, c.severity) for c in wrong] == [("grand_total", "error")]
    empty = checks.all_checks(*invoice(spark, "476", with_line=False)).collect()
    states = {c.check_name: c.status for c in empty}
    assert states["subtotal"] == states["reverse_charge"] == "fail"


def test_status_follows_the_checks(spark):
    for total, status in (("476", "completed"), ("1500", "requires_review")):
        invoices, items = invoice(spark, total)
        owned = invoices.withColumn("org_id", F.lit(7))
        orgs = spark.createDataFrame([(7, Decimal("0"))], "org_id INT, threshold DECIMAL(5,4)")
        blocks = golden_blocks(spark, (f"{total},00",))
        found = fields.find_fields(blocks).withColumnRenamed("doc_id", "invoice_id").where(
            "field <> 'supplier_name'"
        ).withColumns({"validator_status": F.lit(None).cast("string"), "status": F.lit("accepted"),
                       "validator_detail": F.lit(None).cast("map<string,string>")})
        judged = checks.apply_to_fields(found, checks.all_checks(invoices, items, True))
        scored = scoring.score_fields(judged, scoring.reading_confidence(blocks), owned, orgs)
        gate = scoring.document_gate(owned.withColumn("status", F.lit("processing")), scored).first()
        assert gate.status == status
        assert (gate.score >= 0.85) == (status == "completed")


def test_document_without_fields_needs_review(spark):
    invoices, _ = invoice(spark, "476")
    none = spark.createDataFrame(
        [], "invoice_id BIGINT, field STRING, confidence DOUBLE, threshold DOUBLE")
    gate = scoring.document_gate(invoices.withColumn("status", F.lit("queued")), none).first()
    assert (gate.score, gate.status) == (0.0, "requires_review")


def test_line_items(spark):
    second = [["Menge", "Artikel", "Einzelpreis"], ["3", "Schraube", "0,335"], ["", "Summe", ""],
              ["1"], ["", "", ""]]
    cells = cell_frame(spark, [(1, 0, 0, TABLE), (1, 1, 0, second), (2, 0, 0, [["only one row"]])])
    rows = lines.line_items(cells).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.position, r.description) for r in rows] == [
        (1, 1, TABLE[1][1]), (1, 2, "Schraube"), (1, 3, ""),
    ]
    assert (rows[0].gross, rows[1].net, rows[2].quantity) == (476.0, 1005.0, 1.0)


def test_missing_cells_keep_their_columns(spark):
    head = [(1, 0, 0, 0, n, t) for n, t in enumerate(["Artikel", "Menge", "Einzelpreis", "Netto"])]
    row = [(1, 0, 0, 1, 0, "Schraube"), (1, 0, 0, 1, 2, "5"), (1, 0, 0, 1, 3, "10")]
    cells = spark.createDataFrame(head + row, CELL_SCHEMA)
    item = lines.line_items(cells).first()
    assert (item.quantity, item.unit_price, item.net) == (None, 5.0, 10.0)


def test_amounts_keep_their_digits_until_rounded(spark):
    cells = cell_frame(spark, [(1, 0, 0, [["Menge", "Artikel", "Einzelpreis"], ["1000", "S", "1.234,56789"]])])
    assert lines.line_items(cells).first().net == 1234567.89


def test_numbering(spark):
    frame = spark.range(500).selectExpr("id % 3 AS k", "(id * 7919) % 1000 AS v")

    got = groups.index(frame, ["k"], ["v"], "i", along="v").collect()
    for k in range(3):
        own = sorted((r.v, r.i) for r in got if r.k == k)
        assert [i for _, i in own] == list(range(1, len(own) + 1))


def test_a_group_of_half_the_rows_is_numbered_in_even_pieces(spark):
    frame = spark.range(20000).selectExpr("IF(id < 10000, -1, id) AS k", "id * id * 1000003 AS v")
    got = groups.index(frame, ["k"], ["v"], "i", along="v")
    assert got.where("k = -1").selectExpr("max(i) AS m", "count(DISTINCT i) AS n").first() == (10000, 10000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_piece" in plan and got.count() == 20000


def test_attaching(spark):
    frame = spark.range(300).selectExpr("IF(id < 200, 1, id) AS k", "id AS v")
    per_key = frame.groupBy("k").agg(F.min("v").alias("m"))

    got = {r.v: r.m for r in groups.attach(frame, per_key, ["k"]).collect()}
    assert got == {v: 0 if v < 200 else v for v in range(300)}


def test_answers_parse_and_retry(spark):
    good = '{"doc_type": "invoice", "fields": {"total": {"value": 12.50}}}'
    raw = spark.createDataFrame([
        (1, 1, "```json\n" + good + "\n```"), (2, 1, "noise " + good + " more noise"),
        (3, 1, "{broken"), (3, 2, good), (4, 1, "x"), (4, 2, "y"), (4, 3, good),
    ], "doc_id INT, attempt INT, raw_text STRING")
    parsed = answers.parse_answers(raw)
    accepted = answers.accept(parsed)
    assert {r.doc_id: r.attempt for r in accepted.collect()} == {1: 1, 2: 1, 3: 2}
    assert [r.doc_id for r in answers.rejected(parsed, accepted).collect()] == [4]
    assert accepted.where("doc_id = 1").first().answer.fields["total"].value == "12.5"


def candidates(spark, rows, method):
    frame = spark.createDataFrame(rows, "doc_id INT, field STRING, raw STRING, confidence DOUBLE")
    return frame.select(
        "doc_id", "field", answers.typed_value(F.col("field"), F.col("raw")).alias("value"),
        "confidence", F.lit(method).alias("method"), F.lit("s").alias("source_text"),
        F.lit(None).cast("struct<page:int>").alias("bbox"),
    )


def test_merge(spark):
    rules = candidates(spark, [(1, "total", "80,50", 0.9), (2, "total", "80,50", 0.9),
                               (3, "supplier_name", "Seehof GmbH", 0.6), (4, "iban", "X", 0.98)],
                       "rules")
    model = candidates(spark, [(1, "total", "80.50", 0.8), (2, "total", "999.00", 0.8),
                               (3, "supplier_name", "Seehof Papierwaren GmbH", 0.6), (5, "buyer", "B", 0.6)],
                       "llm")
    got = {r.doc_id: r for r in answers.merge_candidates(rules, model).collect()}
    assert (got[1].method, got[1].confidence, got[1].validator_status) == ("rules", 0.95, None)
    assert (got[2].value.value, got[2].confidence) == ("80,50", 0.8)
    assert got[2].validator_detail == {"rule": "80,50", "llm": "999.00"}
    assert (got[3].value.value, got[3].validator_status) == ("Seehof Papierwaren GmbH", "warn")
    assert got[4].method == "rules" and got[5].method == "llm"


def test_grounding(spark):
    raw = spark.createDataFrame(
        [(1, 1, '{"fields": {"supplier_name": {"value": "A", "source_text": " seehof  PAPIERWAREN"},'
                '"total": {"value": "1", "source_text": "nowhere"}}}')],
        "doc_id BIGINT, attempt INT, raw_text STRING")
    accepted = answers.accept(answers.parse_answers(raw))
    rows = answers.model_candidates(accepted, golden_blocks(spark)).collect()
    assert {r.field: r.confidence for r in rows} == {"supplier_name": 0.85, "total": 0.6}


def test_routes(spark):
    frame = spark.createDataFrame(
        [("us_opt_in", "extract"), ("us_opt_in", "classify"), ("other", "vlm"), ("eu_only", "x")],
        "p STRING, t STRING")
    route = answers.resolve_route(F.col("p"), F.col("t"))
    rows = frame.select(route, answers.cost(route, F.lit(1000))).collect()
    assert [tuple(r) for r in rows] == [
        ("openai:gpt-4o-mini|anthropic:claude-haiku", 0.00015), ("mistral:small", 0.0002),
        ("mistral:pixtral", 0.004), ("mistral:small", 0.0002),
    ]


def fold_lines(tops):
    """Plain reading of the line rule: a new line when 3 beyond its first word."""
    numbers, anchor, line = {}, None, -1
    for top in sorted(tops):
        if anchor is None or top - anchor > 3.0:
            anchor, line = top, line + 1
        numbers[top] = line
    return numbers


def test_words_to_lines_matches_brute_force(spark):
    tops = [0.0, 2.5, 4.9, 5.2] + [(i * 37 % 400) / 3 for i in range(150)]
    rows = [(1, n, f"w{n}", t, float(n * 53 % 90), float(n * 53 % 90 + 5), t + 8, 100.0, 200.0)
            for n, t in enumerate(tops)]
    words = spark.createDataFrame(
        rows, "page_id INT, word_no INT, text STRING, top DOUBLE, x0 DOUBLE, x1 DOUBLE, "
              "bottom DOUBLE, page_width DOUBLE, page_height DOUBLE")
    numbers, want = fold_lines(tops), {}
    for r in sorted(rows, key=lambda r: (numbers[r[3]], r[4], r[1])):
        want.setdefault(numbers[r[3]], []).append(r[2])
    got = {r.line_no: r.text for r in pages.words_to_lines(words).collect()}
    assert got == {k: " ".join(v) for k, v in want.items()}


def test_pick_engine(spark):
    blocks = spark.createDataFrame(
        [(2, 0, "b", 0.9), (3, 0, "a", 0.2), (3, 0, "b", 0.9), (4, 0, "a", 0.4), (4, 0, "b", 0.3),
         (5, 0, "a", 0.8), (5, 0, "b", 0.9)], "doc_id INT, page_no INT, engine STRING, conf DOUBLE")
    every = spark.range(1, 6).selectExpr("CAST(id AS INT) AS doc_id", "0 AS page_no")
    got = {r.doc_id: (r.engine, r.error) for r in pages.pick_engine(every, blocks, "a", "b").collect()}
    assert got == {1: (None, "OCR_NO_TEXT"), 2: ("b", None), 3: ("b", None), 4: ("a", None),
                   5: ("a", None)}


def test_copies_and_keys(spark):
    ups = spark.createDataFrame(
        [(1, 1, "h", 9), (2, 1, "h", 5), (3, 2, "h", 1), (4, 1, "g", 1)],
        "file_id INT, org_id INT, sha256 STRING, created_at INT")
    got = {r.file_id: r.duplicate_of for r in files.mark_copies(ups).collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None}
    names = spark.createDataFrame([("a.pdf",), ("../a.pdf",)], "f STRING")
    keys = [r[0] for r in names.select(files.object_key(F.lit(1), F.lit(2), F.col("f"))).collect()]
    assert keys == ["1/2/a.pdf", None]


def test_latest_and_listing(spark):
    jobs = spark.createDataFrame(
        [(1, 9, "ingest", "done", "a", 1), (2, 9, "ingest", "failed", "b", 3),
         (3, 9, "ingest", "done", "c", 2), (4, 9, "ingest", "done", "d", 2)],
        "job_id INT, invoice_id INT, stage STRING, status STRING, payload STRING, created_at INT")
    assert state.newest_done(jobs).first().payload == "d"
    invoices = spark.createDataFrame(
        [(i, 1, date(2024, 1, 1 + i % 5), i == 4) for i in range(10)],
        "invoice_id INT, org_id INT, created_on DATE, deleted BOOLEAN")
    top = search.newest_of_tenant(invoices, 1, 2).collect()
    assert [r.invoice_id for r in top] == [9, 3]
    ranked = search.newest_invoices(invoices, 2).collect()
    assert {r.invoice_id for r in ranked} == {9, 3}


def test_search_and_export(spark, tmp_path):
    asked = spark.createDataFrame(
        [(1, 1, "find invoice over 1,000.50 EUR after 01/02/2024 from Germany high confidence"),
         (2, 1, "status is flagged")], "query_id INT, org_id INT, question STRING")
    first, second = search.parse_search(asked, ("Germany",)).orderBy("query_id").collect()
    assert (first.min_amount, str(first.date_after), first.doc_type) == (1000.5, "2024-02-01", "invoice")
    assert (first.country, first.min_confidence, second.status) == ("Germany", 0.8, "flagged")


def test_search_takes_filters_out_of_the_sentence(spark):
    asked = spark.createDataFrame([
        (1, 1, "show receipts in total from Germany status is flagged"), (2, 1, "list total above 500 EUR"),
        (3, 1, "Papierwaren"), (4, 1, "supplier_name Papierwaren"),
    ], "query_id INT, org_id INT, question STRING")
    parsed = search.parse_search(asked, ("France", "Germany"), ("total", "supplier_name"))
    got = {r.query_id: (r.field_name, r.country, r.status, r.min_amount, r.text_query) for r in parsed.collect()}
    assert got == {
        1: ("total", "Germany", "flagged", None, "in"), 2: ("total", None, None, 500.0, None),
        3: (None, None, None, None, "Papierwaren"), 4: ("supplier_name", None, None, None, "Papierwaren"),
    }
    stored = fields.find_fields(golden_blocks(spark, ("476,00", "500,00", "501,00"))).withColumnRenamed(
        "doc_id", "invoice_id").withColumns({
            "org_id": F.lit(1), "status": F.lit("accepted"), "validator_status": F.lit(None).cast("string")})
    hits = search.search_fields(stored, parsed).collect()
    assert {r.invoice_id for r in hits if r.query_id == 2} == {2, 3}
    assert {r.field for r in hits if r.query_id == 4} == {"supplier_name"} and not [r for r in hits if r.query_id == 1]


def test_exports_have_every_document(spark, tmp_path):
    documents = spark.createDataFrame([(1,), (2,), (3,)], "doc_id BIGINT")
    found = fields.find_fields(golden_blocks(spark))
    wide = export.wide_table(documents, found, ["iban", {"field": "total", "header": "Sum"}, "nothing"])
    rows = {r.doc_id: r.asDict() for r in wide.collect()}
    assert rows[1] == {"doc_id": 1, "iban": IBAN, "Sum": "476,00", "nothing": ""}
    assert rows[2] == {"doc_id": 2, "iban": "", "Sum": "", "nothing": ""}
    odd = wide.withColumn("note", F.lit(' "a",\n b '))
    export.export(odd, "csv", str(tmp_path / "csv"))
    back = {int(r.doc_id): (r.Sum, r.note) for r in export.read_csv(spark, str(tmp_path / "csv")).collect()}
    assert back == {1: ("476,00", ' "a",\n b '), 2: ("", ' "a",\n b '), 3: ("", ' "a",\n b ')}
    items = lines.line_items(cell_frame(spark, [(1, 0, 0, TABLE), (3, 0, 0, TABLE)]))
    record = export.json_records(documents, found, items)
    parsed = {r.doc_id: r.r for r in record.selectExpr(
        "doc_id", "from_json(record, 'total STRING, line_items ARRAY<STRUCT<description: STRING, net: DOUBLE>>') r"
    ).collect()}
    assert parsed[1].total == "476,00" and parsed[1].line_items[0].net == 400.0
    assert parsed[2].total is None and parsed[2].line_items is None and parsed[3].line_items[0].net == 400.0
    assert export.json_envelope(record, F.lit("invoice")).first().envelope == '{"count":3,"doc_type":"invoice"}'


def test_failed_invoices_stay_failed(spark):
    invoices, _ = invoice(spark, "476")
    none = spark.createDataFrame([], "invoice_id BIGINT, field STRING, confidence DOUBLE, threshold DOUBLE")
    gate = scoring.document_gate(invoices.withColumn("status", F.lit("failed")), none).first()
    assert (gate.score, gate.status) == (None, "failed")


def test_events_read_back(spark):
    runs = spark.sql("SELECT 1L AS invoice_id, TIMESTAMP'2024-01-01' AS created_at UNION ALL SELECT 1, TIMESTAMP'2024-01-02'")
    events = state.stage_events(runs, "ingest", payload=F.col("created_at").cast("string"))
    assert state.newest_done(events).first().payload == "2024-01-02 00:00:00"


def test_document_text(spark):
    text = answers.document_text(
        block_frame(spark, {1: ["first", "second"]}), cell_frame(spark, [(1, 0, 0, [["a", "b"]])])
    ).first().text
    assert text == "--- PAGE 1 ---\nfirst\nsecond\nTABLE:\na | b"

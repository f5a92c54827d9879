"""What is read several times is worked out once; a table may be one file or a folder of files."""

from pyspark.sql import functions as F

from tallyfold.operators import answers, fields, groups, lines, metrics, records, review
from tallyfold.plans import bindings, catalog
from tallyfold.sources import pages


def test_streamed_table_of_several_files(spark, tmp_path):
    documents = spark.range(20).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 15).alias("text"), F.lit("en").alias("lang"))
    documents.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["stream_new_files"](spark, str(tmp_path))
    assert found.count() == 15


def _cells(spark, rows):
    return spark.createDataFrame(
        [(1, 0, 0, r, c, t) for r, cells in enumerate(rows) for c, t in cells],
        "doc_id long, page_no int, table_no int, row_no int, col_no int, text string")


def test_line_items_read_stored_rows(spark):
    head = list(enumerate(["Pos", "Beschreibung", "Menge", "Brutto"]))
    cells = _cells(spark, [head, [(0, "1"), (1, "Nagel"), (2, "2"), (3, "3,00")], [(0, "2"), (3, "4,00")]])
    items = lines.line_items(cells)
    assert items.inputFiles() and all("tallyfold-items" in f for f in items.inputFiles())
    assert [(r.position, r.description, r.gross) for r in items.orderBy("position").collect()] == [(1, "Nagel", 3.0), (2, "", 4.0)]


def test_rows_with_and_without_gaps(spark):
    cells = _cells(spark, [[(0, " a "), (1, "b")], [(0, "c"), (3, "d")], [(2, "e")], [(0, " "), (4, "")]])
    rows = {r.row_no: r.texts for r in lines.table_rows(cells).collect()}
    assert rows == {0: ["a", "b"], 1: ["c", "", "", "d"], 2: ["", "", "e"]}


def test_amounts_are_only_read_beside_a_word(spark):
    blocks = spark.createDataFrame(
        [(1, 0, 0, "12,00 or 13,00"), (1, 0, 1, "Total 14,00 and 15,00"), (1, 0, 2, None), (1, 0, 3, "Subtotal none")],
        "doc_id long, page_no int, block_no int, text string").withColumns({c: F.lit(0.0) for c in ("x0", "y0", "x1", "y1")})
    found = fields.find_wide(blocks, ("money",))
    assert "isnotnull(_sum" in found._jdf.queryExecution().optimizedPlan().toString()
    row = found.first()
    assert row.total.value.numeric == 15.0 and row.subtotal is None and row.total_vat is None


def test_checks_are_worked_out_once_to_be_stored(spark):
    found = catalog.QUERIES["new_checks_only"](spark, "/root/testdata/sf0.001")
    files = found.inputFiles()
    assert files and all("tallyfold-checks" in f for f in files)


def _words(spark, pages_of):
    """Words ``(page, top, x0)`` with all a line needs."""
    rows = [(p, n, f"w{n}", float(t), float(x), x + 5.0, t + 8.0, 100.0, 1000.0) for n, (p, t, x) in enumerate(pages_of)]
    return spark.createDataFrame(
        rows, "page_id long, word_no long, text string, top double, x0 double, x1 double, bottom double, page_width double, page_height double")


def _lines_by_hand(pages_of):
    found, starts = {}, {}
    for n, (p, t, x) in sorted(enumerate(pages_of), key=lambda w: w[1][1]):
        if p not in starts or t - starts[p][-1] > 3:
            starts.setdefault(p, []).append(t)
        found.setdefault((p, len(starts[p]) - 1), []).append((x, n))
    return {k: " ".join(f"w{n}" for _, n in sorted(v)) for k, v in found.items()}


def test_words_travel_once_where_no_page_is_large(spark):
    placed = [(p, (n * 37 % 60) * 1.5, n * 53 % 90) for p in range(400) for n in range(p % 7 + 1)]
    found = pages.words_to_lines(_words(spark, placed))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.page_id, r.line_no): r.text for r in found.collect()} == _lines_by_hand(placed)


def test_lines_of_a_large_page_among_small_ones(spark):
    placed = [(p, (n * 37 % 60) * 1.5, n * 53 % 90) for p in range(400) for n in range(p % 7 + 1)]
    placed += [(500, (n * 7919 % 3000) * 0.7, n % 91) for n in range(900)]
    found = pages.words_to_lines(_words(spark, placed))
    assert "piece" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.page_id, r.line_no): r.text for r in found.collect()} == _lines_by_hand(placed)


def test_scanned_lines_of_small_and_large_pages(spark):
    for large in (False, True):
        sizes = {p: p % 7 + 1 for p in range(400)} | ({500: 900} if large else {})
        words = spark.createDataFrame(
            [(p, n, f" w{n}", 50, n // 64, n // 32 % 2, n // 8 % 4, n % 8 * 60, (n * 37 % 90) * 10, 50, 10, 600, 1000)
             for p, size in sizes.items() for n in range(size)],
            "page_id long, word_no int, text string, conf int, block_num int, par_num int, line_num int, left int, top int, "
            "width int, height int, page_width int, page_height int")
        found = pages.scanned_words_to_lines(words)
        assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == large
        want = {}
        for p, size in sizes.items():
            own = {}
            for n in range(size):
                own.setdefault((n // 64, n // 32 % 2, n // 8 % 4), []).append(n)
            order = sorted(own.items(), key=lambda kv: (min(n * 37 % 90 for n in kv[1]), min(n % 8 for n in kv[1]), kv[0]))
            want |= {(p, i): " ".join(f"w{n}" for n in ns) for i, (_, ns) in enumerate(order)}
        assert {(r.page_id, r.reading_order): r.text for r in found.collect()} == want


def test_small_groups_are_numbered_without_a_join(spark):
    frame = spark.range(2000).selectExpr("id % 500 AS k", "(id * 7919) % 10007 AS v")
    numbered = groups.index(frame, ["k"], ["v"], "i", along="v")
    followed = groups.previous(frame, ["k"], ["v"], "v", F.col("v"), "before")
    for found in (numbered, followed):
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert numbered.groupBy("k").agg(F.max("i").alias("m")).where("m <> 4").count() == 0
    assert followed.where("before IS NULL").count() == 500 and followed.where("before >= v").count() == 0


def test_printed_sums_and_accepted_answers_are_worked_out_once(spark):
    for name, tables in (("answer_candidates", ("printed", "accepted")), ("merge_candidates", ("printed", "accepted")),
                         ("override_header", ("printed",))):
        files = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert all(any(f"tallyfold-{t}" in f for f in files) for t in tables)


def test_values_do_not_travel_to_the_attributes(spark):
    rows = spark.createDataFrame([(1, "total", "1"), (1, "iban", "a"), (2, "total", "2")], "invoice_id long, field string, value string")
    got = spark.createDataFrame([(1, "total", "1"), (2, "total", "3"), (3, "iban", "b")], "invoice_id long, field string, value string")
    about = spark.createDataFrame([(1, "DE"), (2, "FR")], "invoice_id long, country string")
    report = metrics.evaluation_report(rows, got, about, ["country"])
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "_hit" in plan and not [x for x in plan.splitlines() if "LeftOuter" in x and "_e#" in x]
    found = {(r.by, r.of, r.field): (r.tp, r.fp, r.fn) for r in report.collect()}
    assert found == {
        ("", None, "total"): (1, 1, 1), ("", None, "iban"): (0, 1, 1), ("country", "DE", "total"): (1, 0, 0),
        ("country", "FR", "total"): (0, 1, 1), ("country", "DE", "iban"): (0, 0, 1), ("country", None, "iban"): (0, 1, 0)}


def test_text_of_documents_dealt_out_is_joined_where_it_lies(spark):
    blocks = spark.createDataFrame(
        [(1, 0, 1, "b"), (1, 0, 0, "a"), (1, 0, 2, None), (1, 1, 0, None), (2, 0, 0, "c"), (None, 0, 0, "d")],
        "doc_id long, page_no int, block_no int, text string")
    cells = _cells(spark, [[(0, "x"), (1, None), (2, "y")], [(0, None)], [(0, "z")]])
    cells = cells.unionByName(cells.where("row_no = 2").withColumn("page_no", F.lit(None).cast("int")))
    listed = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 0)], "doc_id long, page_no int")
    frames = [groups.dealt(f, ["doc_id"], 3_000_000) for f in (blocks, cells, listed)]
    text = answers.document_text(*frames)
    want = {
        1: "TABLE:\nz\n--- PAGE 1 ---\na\nb\nTABLE:\nx | y\n\nz\n--- PAGE 2 ---\n", 2: "--- PAGE 1 ---\nc\n--- PAGE 2 ---",
        3: "--- PAGE 1 ---", None: "--- PAGE 1 ---\nd"}
    assert {r.doc_id: r.text for r in text.collect()} == want
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 3
    assert {r.doc_id: r.text for r in answers.document_text(blocks, cells, listed).collect()} == want


def _fields_of(spark, invoices, parts):
    return spark.range(invoices).select(F.col("id").alias("invoice_id")).repartition(parts, "invoice_id").select(
        "invoice_id", F.explode(F.array(F.lit("iban"), F.lit("total"))).alias("field")).select(
        "*", F.struct(F.concat("field", F.col("invoice_id") % 3).alias("value")).alias("value"), F.lit("rules").alias("method"),
        (F.col("invoice_id") * 37 % 100 / 100).alias("confidence"), F.lit(None).cast("string").alias("validator_status"))


def _corrections(spark):
    return spark.createDataFrame(
        [(1, 1, "iban", "old", 1), (2, 1, "iban", "new", 2), (3, 2, "total", "total2", 1), (4, 2, "iban", None, 1), (5, 3, None, "x", 1),
         (6, None, "iban", "y", 1), (7, 4, "iban", "a", 1), (8, 4, "iban", None, 2), (9, 5, "other", "z", 1)],
        "correction_id long, invoice_id long, field string, new_value string, created_at int")


def test_corrected_fields_stay_where_their_invoice_lies(spark):
    found = records.apply_corrections(_fields_of(spark, 40, 8), _corrections(spark))
    changed = {(r.invoice_id, r.field): (r.value.value, r.confidence) for r in found.where("method = 'user'").collect()}
    assert found.count() == 80 and changed == {(1, "iban"): ("new", 1.0), (2, "total"): ("total2", 1.0)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "invoice_id" in plan and "hashpartitioning(invoice_id" in plan
    assert not [x for x in plan.splitlines() if "Join" in x and "field" in x]


def test_examples_of_small_and_large_suppliers(spark):
    for share in (200, 2):
        about = spark.range(400).select(
            F.col("id").alias("invoice_id"), F.when(F.col("id") % share == 1, "big").otherwise((F.col("id") % 190).cast("string")).alias("supplier"))
        found = review.correct_examples(_fields_of(spark, 400, 8), _corrections(spark), about, ["supplier"])
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("_piece" in plan) == (share == 2) and "_fields" in plan
        want = {}
        for n in range(400):
            key = "big" if n % share == 1 else str(n % 190)
            for field in ("iban", "total"):
                if (n, field) != (1, "iban"):
                    want.setdefault((key, field), []).append((-(n * 37 % 100) / 100, n, f"{field}{n % 3}"))
        want = {(k, f, i): (n, v) for (k, f), rows in want.items() for i, (_, n, v) in enumerate(sorted(rows)[:3], 1)}
        assert {(r.supplier, r.field, r["rank"]): (r.invoice_id, r.value) for r in found.collect()} == want

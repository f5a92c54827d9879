"""Work is done where rows were dealt out: the same rows as elsewhere, without further shuffles."""

import itertools
import re

from pyspark.sql import functions as F

from tallyfold import fixed_values as fixed
from tallyfold.operators import fields, lines

CELLS = "doc_id long, page_no int, table_no int, row_no long, col_no int, text string"
TEXTS = {
    "head": ["Pos", "Beschreibung", "Menge", "Einzelpreis", "Netto", "MwSt %", "MwSt", "Brutto"],
    "late": ["", "Description", "Qty", "Unit price"],
    "item": ["1", "Schraube", "2", "1,50", "3,00", "19", "0,57", "3,57"],
    "poor": ["2", "", "4", "2.00"],
    "blank": [" ", "", ""],
    "total": ["", "Gesamtbetrag", "", "", "", "", "", "3,57"],
    "odd": ["x", "y"],
}


def shuffles(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0].count("Exchange ")


def cells_of(spark):
    rows = []
    kinds = list(itertools.product(TEXTS, repeat=3))
    for doc, kind in enumerate(kinds):
        for no, name in enumerate([*kind, "item", "poor"]):
            rows += [(doc, no % 2 if doc % 5 == 0 else 0, doc % 3, 10 * no, c, t) for c, t in enumerate(TEXTS[name])]
    rows += [(None, 0, 0, n, c, t) for n, name in enumerate(("head", "item")) for c, t in enumerate(TEXTS[name])]
    rows += [(900, None, 0, n, c, t) for n, name in enumerate(("head", "item")) for c, t in enumerate(TEXTS[name])]
    rows += [(901, 0, 0, n, c, t) for n, name in ((None, "head"), (1, "item"), (2, "item")) for c, t in enumerate(TEXTS[name])]
    rows += [(902, 0, 0, n, c + 1, None if c == 2 else t) for n, name in ((0, "head"), (1, "item")) for c, t in enumerate(TEXTS[name])]
    return spark.createDataFrame(rows, CELLS)


def test_line_items_of_cells_that_lie_together(spark):
    cells = cells_of(spark)
    dealt = cells.repartition(6, "doc_id")
    found = lines.line_items(dealt, together=True)
    apart = lines.line_items(cells)
    assert sorted(map(str, found.select(apart.columns).collect())) == sorted(map(str, apart.collect()))
    assert found.count() > 300
    assert shuffles(found) == 1  # the one that deals them out


def test_header_fields_are_gathered_without_sorting_again(spark):
    texts = ["Nordwind GmbH 7", "USt-IdNr.: DE123456789", "VAT IE1X12345AB", "Nettobetrag 5,00", "Netto: 12,50", "private 3,10",
             "Total 1.234,56 EUR", "totals 9.00", "MwSt. 19 % 2,00", "Rechnung Nr.: A-77", "Rechnungsdatum: 01.02.2024", "Fällig am 03.02.2024"]
    blocks = spark.createDataFrame(
        [(d, 0, n, t, 0.1, n / 14) for d in range(3) for n, t in enumerate(texts)],
        "doc_id long, page_no int, block_no int, text string, x0 double, y0 double").withColumns(
        {"x1": F.lit(0.9), "y1": F.col("y0"), "conf": F.lit(0.9)})
    found = fields.find_wide(blocks)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    row = found.where("doc_id = 1").first()
    assert {n: row[n].value.value for n in ("supplier_name", "supplier_vat", "invoice_number", "subtotal", "total_vat", "total", "due_date")} == {
        "supplier_name": "Nordwind GmbH 7", "supplier_vat": "DE123456789", "invoice_number": "A-77", "subtotal": "12,50",
        "total_vat": "2,00", "total": "1.234,56", "due_date": "03.02.2024"}
    assert all(re.search(r"\[0-9\]\{([5-9]|1\d)\}", shape) for shape in fixed.VAT_SHAPES.values())

"""One printed invoice as rows, with a switch for a total that does not add up."""

LINES = [
    "Seehof Papierwaren GmbH",
    "Uferweg 12, 88045 Friedrichshafen",
    "Steuer: USt-ID DE284619357",
    "Rechnung Nr.: PW-7731",
    "Rechnungsdatum: 03.06.2023",
    "Fällig am: 17.06.2023",
    "Pos Artikel Menge Einzelpreis Netto MwSt % MwSt Brutto",
    "1 Aktenordner blau 4 100,00 400,00 19 76,00 476,00",
    "Zwischensumme 400,00",
    "zzgl. MwSt. 19 % 76,00",
    "Gesamtbetrag {total} EUR",
    "Bitte überweisen Sie auf IBAN DE10604500500017382946",
]
TABLE = [
    ["Pos", "Artikel", "Menge", "Einzelpreis", "Netto", "MwSt %", "MwSt", "Brutto"],
    ["1", "Aktenordner blau", "4", "100,00", "400,00", "19", "76,00", "476,00"],
]
IBAN = "DE10604500500017382946"
BLOCK_SCHEMA = (
    "doc_id BIGINT, page_no INT, block_no INT, text STRING, conf DOUBLE, "
    "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
)
CELL_SCHEMA = "doc_id BIGINT, page_no INT, table_no INT, row_no INT, col_no INT, text STRING"


def block_frame(spark, texts_by_doc, conf=1.0):
    rows = [
        (doc, 0, n, text, conf, 0.1, n / 20, 0.9, n / 20 + 0.04)
        for doc, texts in texts_by_doc.items() for n, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, BLOCK_SCHEMA)


def golden_blocks(spark, totals=("476,00",)):
    return block_frame(spark, {
        doc: [line.format(total=total) for line in LINES] for doc, total in enumerate(totals, 1)
    })


def cell_frame(spark, tables):
    """tables: (doc, page, table, rows)."""
    rows = [
        (doc, page, table, r, c, text)
        for doc, page, table, grid in tables
        for r, row in enumerate(grid) for c, text in enumerate(row)
    ]
    return spark.createDataFrame(rows, CELL_SCHEMA)

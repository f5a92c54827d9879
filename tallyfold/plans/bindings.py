"""The driver tables seen as invoices, printed pages, answers and files.

The tables hold orders and texts, not invoices, so each view is derived by a
fixed formula.  The formulas are SQL that Spark and other engines read alike;
``Views`` runs them on Spark, ``sql_of`` hands out the text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import TASK_ROWS, pieces, stored

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# --- pieces of formulas -----------------------------------------------------


def hundredth(x: str) -> str:
    """Whole number of hundreds in a whole number."""
    return f"CAST((({x}) - ({x}) % 100) / 100 AS BIGINT)"


def money(cents: str) -> str:
    return (
        f"CAST(CAST({cents} AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(18,4))"
    )


def with_printed(source: str, style: str, cents: dict) -> str:
    """Add to a source, per name, the printed amount ``name_text`` of cents.

    Style 0 prints 1.234,56 - style 1 prints 1234.56 - style 2 prints 1,234.56.
    """
    def three(x):
        return f"lpad(CAST(({x}) % 1000 AS STRING), 3, '0')"

    units = ", ".join(f"{hundredth(c)} AS {n}_u, ({c}) % 100 AS {n}_c" for n, c in cents.items())
    parts = ", ".join(
        f"CAST(({n}_u - {n}_u % 1000) / 1000 AS BIGINT) AS {n}_k" for n in cents
    )
    grouped = ", ".join(
        f"CASE WHEN {n}_k >= 1000 THEN CAST(CAST(({n}_k - {n}_k % 1000) / 1000 AS BIGINT) AS STRING)"
        f" || ',' || {three(n + '_k')} || ',' || {three(n + '_u')}"
        f" WHEN {n}_k > 0 THEN CAST({n}_k AS STRING) || ',' || {three(n + '_u')}"
        f" ELSE CAST({n}_u AS STRING) END || '.' || lpad(CAST({n}_c AS STRING), 2, '0') AS {n}_g"
        for n in cents
    )
    texts = ", ".join(
        f"CASE {style} WHEN 1 THEN replace({n}_g, ',', '') "
        f"WHEN 0 THEN translate({n}_g, ',.', '.,') ELSE {n}_g END AS {n}_text"
        for n in cents
    )
    return (
        f"(SELECT *, {texts} FROM (SELECT *, {grouped} FROM (SELECT *, {parts} FROM "
        f"(SELECT *, {units} FROM {source}) p1) p2) p3)"
    )


def printed_date(day: str, style: str) -> str:
    """Day as printed: style 2 is yyyy-mm-dd, style 3 is dd/mm/yyyy, else dd.mm.yyyy."""
    text = f"CAST({day} AS STRING)"
    mark = f"CASE WHEN {style} = 3 THEN '/' ELSE '.' END"
    return (
        f"CASE WHEN {style} = 2 THEN {text} ELSE substr({text}, 9, 2) || ({mark}) || "
        f"substr({text}, 6, 2) || ({mark}) || substr({text}, 1, 4) END"
    )


def pick(number: str, values: list) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {cases} END"


LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)

# --- the views --------------------------------------------------------------

VIEWS = {}

VIEWS["v_orgs"] = """
SELECT CAST(n_nationkey AS BIGINT) AS org_id, n_name AS name,
       CASE WHEN n_nationkey % 9 = 4 THEN CAST(0 AS DECIMAL(5,4))
            WHEN n_nationkey % 8 = 5 THEN NULL
            ELSE CAST((80 + n_nationkey % 10) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(5,4))
       END AS threshold,
       CASE WHEN n_nationkey % 7 = 6 THEN 'unlisted'
            WHEN n_nationkey % 3 = 0 THEN 'eu_only'
            WHEN n_nationkey % 3 = 1 THEN 'us_opt_in' ELSE 'sovereign' END AS residency
FROM {nation}"""

VIEWS["v_invoices"] = """
SELECT o_orderkey AS invoice_id, CAST(c_nationkey AS BIGINT) AS org_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'requires_review'
            ELSE CASE WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderkey % 10 = 1
            THEN 'queued' ELSE 'processing' END END AS status,
       CAST(o_orderdate AS DATE) AS created_on,
       o_orderkey % 19 = 0 AS deleted,
       'invoice-' || CAST(o_orderkey AS STRING) || '.pdf' AS filename
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

VIEWS["v_line_cents"] = f"""
SELECT *, net_cents + vat_cents AS gross_cents FROM (
SELECT *, {hundredth('net_cents * tax_pct + 50')} AS vat_cents FROM (
SELECT *, {hundredth('units * price_cents * (100 - disc_pct) + 50')} AS net_cents FROM (
SELECT l_orderkey AS invoice_id, l_partkey, l_suppkey, l_linenumber, l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
       p_name AS description,
       CAST(round(l_quantity) AS BIGINT) AS units,
       CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents,
       CAST(round(l_discount * 100) AS BIGINT) AS disc_pct,
       CAST(round(l_tax * 100) AS BIGINT) AS tax_pct
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey) a) b) c"""

# The lines as the engine sees them, here still without their position.
VIEWS["v_line_values"] = f"""
SELECT invoice_id, {', '.join(LINE_ORDER)}, description,
       CAST(units AS DECIMAL(18,4)) AS quantity,
       {money('price_cents')} AS unit_price,
       CAST(disc_pct AS DECIMAL(8,4)) AS discount_pct,
       CAST(tax_pct AS DECIMAL(8,4)) AS vat_rate,
       CASE WHEN l_partkey % 5 = 0 THEN NULL
            WHEN (l_orderkey_mod + l_linenumber) % 9 = 0 THEN {money('gross_cents + 2')}
            ELSE {money('gross_cents')} END AS gross
FROM (SELECT *, invoice_id % 1000 AS l_orderkey_mod FROM {{v_line_cents}}) t"""

VIEWS["v_line_sums"] = """
SELECT invoice_id, CAST(sum(net_cents) AS BIGINT) AS net_cents,
       CAST(sum(vat_cents) AS BIGINT) AS vat_cents,
       count(*) AS n_lines, min(l_suppkey) AS supplier_id
FROM {v_line_cents} GROUP BY invoice_id"""

VIEWS["v_total_cents"] = """
SELECT o_orderkey AS invoice_id, coalesce(n_lines, 0) AS n_lines,
       coalesce(supplier_id, o_orderkey % 10) AS supplier_id,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL
            WHEN n_lines IS NULL AND o_orderkey % 2 = 0 THEN 10000
            ELSE coalesce(net_cents, 0) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END
       END AS subtotal_cents,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL
            ELSE coalesce(vat_cents, 0)
                 + CASE WHEN o_orderkey % 13 = 0 THEN 5 ELSE 0 END END AS vat_cents,
       CASE WHEN o_orderkey % 23 = 0 THEN 500 END AS shipping_cents,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL
            ELSE coalesce(net_cents, 0) + coalesce(vat_cents, 0)
                 + CASE WHEN o_orderkey % 23 = 0 THEN 500 ELSE 0 END
                 + CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 0 END END AS total_cents
FROM {orders} LEFT JOIN {v_line_sums} ON o_orderkey = invoice_id"""

VIEWS["v_totals"] = f"""
SELECT invoice_id, supplier_id, {money('subtotal_cents')} AS subtotal,
       {money('vat_cents')} AS total_vat, {money('shipping_cents')} AS shipping,
       CAST(NULL AS DECIMAL(18,4)) AS other, {money('total_cents')} AS total
FROM {{v_total_cents}}"""

_D9 = "lpad(CAST((s_suppkey * 7919 + 123456789) % 1000000000 AS STRING), 9, '0')"
_D18 = "lpad(CAST(370400440532000000 + s_suppkey * 13 AS STRING), 18, '0')"
_D10 = "lpad(CAST(417164300 + s_suppkey * 17 AS STRING), 10, '0')"


def _check_digits(number: str) -> str:
    return (
        f"lpad(CAST(98 - CAST(CAST({number} AS DECIMAL(38,0)) % 97 AS BIGINT) AS STRING), 2, '0')"
    )


_DE_IBAN = f"'DE' || {_check_digits(_D18 + " || '131400'")} || {_D18}"
_NL_IBAN = (
    f"'NL' || {_check_digits("'10112310' || " + _D10 + " || '232100'")}"
    f" || 'ABNA' || {_D10}"
)

VIEWS["v_suppliers"] = f"""
SELECT s_suppkey AS supplier_id,
       {pick('s_suppkey', ['Nordwind', 'Alpenhof', 'Rheintal', 'Seeblick', 'Waldhaus', 'Birkenau'])}
       || ' ' || {pick('s_suppkey', ['GmbH', 'AG', 'KG', 'Handels GmbH'])}
       || ' ' || CAST(s_suppkey % 1000 AS STRING) AS name,
       CASE WHEN s_suppkey % 13 = 0 THEN NULL
            WHEN s_suppkey % 11 = 0 THEN 'XX' || d9
            WHEN s_suppkey % 6 = 0 THEN substr(good_vat, 1, length(good_vat) - 2)
            WHEN s_suppkey % 7 = 3 THEN lower(substr(good_vat, 1, 4)) || ' ' || substr(good_vat, 5, 20)
            ELSE good_vat END AS vat,
       CASE WHEN s_suppkey % 10 = 0 THEN NULL
            WHEN s_suppkey % 9 = 0 THEN 'XX' || substr(good_iban, 3, 40)
            WHEN s_suppkey % 7 = 0 THEN substr(good_iban, 1, 16)
            WHEN s_suppkey % 5 = 0 THEN substr(good_iban, 1, length(good_iban) - 1)
                 || CAST((CAST(substr(good_iban, length(good_iban), 1) AS INT) + 1) % 10 AS STRING)
            WHEN s_suppkey % 8 = 3 THEN substr(good_iban, 1, 4) || ' ' || substr(good_iban, 5, 4)
                 || ' ' || substr(good_iban, 9, 40)
            ELSE good_iban END AS iban
FROM (
SELECT s_suppkey, {_D9} AS d9,
       CASE WHEN s_suppkey % 4 = 1 THEN {_NL_IBAN} ELSE {_DE_IBAN} END AS good_iban,
       CASE s_nationkey % 10
            WHEN 0 THEN 'DE' || {_D9} WHEN 1 THEN 'IT' || {_D9} || '01'
            WHEN 2 THEN 'FRX1' || {_D9} WHEN 3 THEN 'ESB' || substr({_D9}, 1, 7) || 'X'
            WHEN 4 THEN 'NL' || {_D9} || 'B01' WHEN 5 THEN 'BE0' || {_D9}
            WHEN 6 THEN 'ATU' || substr({_D9}, 1, 8) WHEN 7 THEN 'LU' || substr({_D9}, 1, 8)
            WHEN 8 THEN 'PT' || {_D9} ELSE 'IE1' || substr({_D9}, 1, 5) || 'AB' END AS good_vat
FROM {{supplier}}) s"""

# One printed invoice per row: t0, t1, ... are its lines, NULL where it has none.
SHEET_LINES = 14
_S = "(invoice_id % 3)"
_DS = "(invoice_id % 4)"
_DATE_LINE = (
    f"{pick('invoice_id', ['Rechnungsdatum: ', 'Invoice date: ', 'Date '])} || "
    + printed_date("created_on", _DS)
)
_NUMBER = (
    "CASE WHEN invoice_id % 10 = 0 THEN substr(CAST(created_on AS STRING), 1, 4) "
    "ELSE substr(CAST(created_on AS STRING), 1, 4) || '-' || CAST(invoice_id AS STRING) END"
)
_NUMBER_LINE = f"{pick('invoice_id', ['Rechnung Nr.: ', 'Invoice No. INV-', 'Faktura # '])} || {_NUMBER}"
_DUE = "CAST(created_on + INTERVAL '30' DAY AS DATE)"
_DUE2 = "CAST(created_on + INTERVAL '45' DAY AS DATE)"

_SHEET_BASE = """(SELECT i.invoice_id, i.org_id, i.created_on, t.subtotal_cents, t.vat_cents,
  t.total_cents, s.supplier_id, s.name, s.vat, s.iban
FROM {v_invoices} i JOIN {v_total_cents} t ON i.invoice_id = t.invoice_id
     JOIN {v_suppliers} s ON t.supplier_id = s.supplier_id)"""

VIEWS["v_printed_sums"] = "SELECT * FROM " + with_printed(_SHEET_BASE + " b", _S, {
    "subtotal": "subtotal_cents", "vat": "vat_cents", "total": "total_cents",
    "more": "total_cents + 250",
}) + " t"

VIEWS["v_sheets"] = f"""
SELECT invoice_id AS doc_id, org_id, created_on,
  CASE WHEN invoice_id % 9 = 0 THEN 'Rechnung' ELSE name END AS t0,
  'Musterstraße ' || CAST(supplier_id % 90 AS STRING) || ', ' || CAST(1000 + supplier_id % 9000 AS STRING) || ' Berlin' AS t1,
  'USt-IdNr.: ' || vat AS t2,
  CASE WHEN invoice_id % 12 = 5 THEN {_DATE_LINE} ELSE {_NUMBER_LINE} END AS t3,
  CASE WHEN invoice_id % 8 = 0 THEN NULL
       WHEN invoice_id % 12 = 5 THEN {_NUMBER_LINE} ELSE {_DATE_LINE} END AS t4,
  {pick('invoice_id', ['Fällig am: ', 'Due date ', 'Vencimiento: ', 'FÄLLIGKEIT '])} || {printed_date(_DUE, _DS)} AS t5,
  CASE WHEN invoice_id % 8 = 0 THEN 'Vervaldatum ' || {printed_date(_DUE2, _DS)}
       WHEN invoice_id % 21 = 1 THEN 'Leistung 31.02.2024' END AS t6,
  'Pos Beschreibung Menge Einzelpreis Netto MwSt % MwSt Brutto' AS t7,
  {pick('invoice_id', ['Zwischensumme ', 'Subtotal ', 'Sous-total '])} || subtotal_text AS t8,
  {pick('invoice_id', ['MwSt. 19 % ', 'VAT 19 % ', 'TVA 20 % '])} || vat_text AS t9,
  CASE {_S} WHEN 0 THEN 'Gesamtbetrag ' || total_text || ' EUR'
       WHEN 1 THEN 'Total USD ' || total_text
       ELSE 'Montant total ' || total_text || '€' END AS t10,
  'Zahlbar innerhalb von 30 Tagen. IBAN ' || iban || CASE WHEN invoice_id % 10 = 3 THEN ' und mehr' ELSE '' END AS t11,
  CASE WHEN invoice_id % 14 = 0 THEN 'Grand total ' || more_text || ' GBP' END AS t12,
  CASE WHEN invoice_id % 6 = 0 THEN 'Seite 2 von 2' END AS t13,
  CAST(80 + invoice_id % 20 AS DOUBLE) / 100 AS conf,
  CASE WHEN invoice_id % 16 = 4 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS left_edge,
  total_text, total_cents, {_DUE} AS due_on
FROM {{v_printed_sums}}"""

# One table row per row: c0 .. c7 are its cells.
CELLS = 8
_ROW = "CAST({0} AS INT)"
_LINE_STYLE = "(invoice_id % 3)"
_LINE_PAGE = "CASE WHEN invoice_id % 5 = 0 AND position % 2 = 0 THEN 1 ELSE 0 END"


def _row_view(lines: str) -> str:
    headers = [
        ["Pos", "Beschreibung", "Menge", "Einzelpreis", "Netto", "MwSt %", "MwSt", "Brutto"],
        ["Item no", "Description", "Qty", "Unit price", "Net total", "VAT %", "VAT", "Gross"],
        ["Lfd", "Artikel", "Anzahl", "Prix unitaire", "Montant HT", "TVA %", "TVA", "Montant TTC"],
    ]
    head_cells = ", ".join(
        f"{pick('doc_id', [h[c] for h in headers])} AS c{c}" for c in range(CELLS)
    )
    blank = ", ".join(f"'' AS c{c}" for c in range(2, CELLS))
    given = "invoice_id % 4 <> 1"

    def amount(name):
        return f"CASE WHEN {given} THEN {name}_text ELSE '' END"

    printed = with_printed(lines, _LINE_STYLE, {
        "price": "price_cents", "net": "net_cents", "vat": "vat_cents", "gross": "gross_cents",
    })
    return f"""
SELECT invoice_id AS doc_id, {_LINE_PAGE} AS page_no, 0 AS table_no,
       1 + position AS row_no,
       CAST(position AS STRING) AS c0,
       CASE WHEN l_partkey % 50 = 7 THEN '' ELSE description END AS c1,
       CAST(units AS STRING) AS c2, price_text AS c3,
       {amount('net')} AS c4, CAST(tax_pct AS STRING) AS c5,
       {amount('vat')} AS c6, {amount('gross')} AS c7
FROM {printed} l
UNION ALL
SELECT doc_id, page_no, 0 AS table_no, CAST(1 AS BIGINT) AS row_no, {head_cells}
FROM (SELECT invoice_id AS doc_id, 0 AS page_no FROM {{v_invoices}}
      UNION ALL
      SELECT invoice_id AS doc_id, 1 AS page_no FROM {{v_invoices}} WHERE invoice_id % 5 = 0) h
UNION ALL
SELECT invoice_id AS doc_id, 0 AS page_no, 0 AS table_no, CAST(0 AS BIGINT) AS row_no,
       CASE WHEN invoice_id % 2 = 0 THEN 'Lieferung' ELSE '' END AS c0, '' AS c1, {blank}
FROM {{v_invoices}} WHERE invoice_id % 6 < 2
UNION ALL
SELECT invoice_id AS doc_id, 0 AS page_no, 0 AS table_no, 1000000000000000000 AS row_no,
       '' AS c0, 'Gesamtbetrag' AS c1, {blank}
FROM {{v_invoices}} WHERE invoice_id % 3 = 0"""


# The number of a line is unique in its invoice and follows LINE_ORDER.  It counts copies of
# one part on one line only, so that an order with very many lines is never sorted as a whole.
VIEWS["v_numbered"] = f"""
SELECT *, l_linenumber * 100000000000000000 + l_partkey * 100000 + row_number() OVER (
         PARTITION BY invoice_id, l_linenumber, l_partkey ORDER BY {', '.join(LINE_ORDER)})
       AS position
FROM {{v_line_cents}}"""
VIEWS["v_rows"] = _row_view("{v_numbered}")
VIEWS["v_line_items"] = (
    VIEWS["v_line_values"]
    .replace("SELECT invoice_id,", "SELECT invoice_id, position,", 1)
    .replace("{v_line_cents}", "{v_numbered}")
)


def _needs(sql: str) -> list:
    return [n for n in (*TABLES, *VIEWS) if "{" + n + "}" in sql]


def sql_of(*names: str) -> str:
    """WITH clause that defines the named views and all they need."""
    order = []

    def visit(name):
        if name in TABLES or name in order:
            return
        for needed in _needs(VIEWS[name]):
            visit(needed)
        order.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in order:
        sql = VIEWS[name].format(**{n: n for n in (*TABLES, *VIEWS)})
        parts.append(f"{name} AS ({sql})")
    return ",\n".join(parts)


# --- stored fields and stage events -----------------------------------------

FIELD_NAMES = (
    "supplier_name", "supplier_vat", "iban", "invoice_number", "invoice_date", "due_date",
    "currency", "subtotal", "total_vat", "total",
)
_FIELD_KIND = {
    "supplier_vat": "vat", "iban": "iban", "invoice_date": "date", "due_date": "date",
    "currency": "currency", "subtotal": "money", "total_vat": "money", "total": "money",
}
_CENTS = {"subtotal": "subtotal_cents", "total_vat": "vat_cents", "total": "total_cents"}

# Files with less text than this between their tags stand for scans.
PRINTED_LENGTH = 2000
VIEWS["v_field_sheet"] = f"""
SELECT invoice_id, org_id, subtotal_cents, vat_cents, total_cents, name AS supplier_name,
  vat AS supplier_vat, iban, {_NUMBER} AS invoice_number,
  CASE WHEN invoice_id % 8 <> 0 THEN CAST(created_on AS STRING) END AS invoice_date,
  CAST({_DUE} AS STRING) AS due_date,
  {pick('invoice_id', ['EUR', 'USD', 'EUR'])} AS currency,
  subtotal_text AS subtotal, vat_text AS total_vat, total_text AS total
FROM {{v_printed_sums}}"""


def _field_parts(name: str, turn: int) -> dict:
    """SQL of one stored field: confidence varies by invoice, zero included."""
    cents = _CENTS.get(name)
    return {
        "field": f"'{name}'",
        "type": f"'{_FIELD_KIND.get(name, 'text')}'",
        "value": name,
        "numeric": f"CAST({cents} AS DOUBLE) / 100" if cents else "CAST(NULL AS DOUBLE)",
        "iso": name if name.endswith("_date") else "CAST(NULL AS STRING)",
        "confidence": (
            f"CASE WHEN (invoice_id + {turn}) % 15 = 0 THEN CAST(0 AS DOUBLE) "
            f"ELSE CAST(70 + (invoice_id + {7 * turn}) % 31 AS DOUBLE) / 100 END"
        ),
        "method": f"CASE WHEN (invoice_id + {turn}) % 4 = 0 THEN 'llm' ELSE 'rules' END",
        "source_text": f"'{name} ' || {name}",
    }


def blocks_sql() -> str:
    """The printed lines for another engine, to follow ``sql_of('v_sheets')``."""
    selects = [
        f"SELECT doc_id, org_id, conf, {1 if n == SHEET_LINES - 1 else 0} AS page_no, "
        f"{n} AS block_no, t{n} AS text, "
        f"{'left_edge' if n == 0 else 'CAST(0.1 AS DOUBLE)'} AS x0, "
        f"CAST({n} AS DOUBLE) / {SHEET_LINES} AS y0 FROM v_sheets WHERE t{n} IS NOT NULL"
        for n in range(SHEET_LINES)
    ]
    return "blocks AS (" + "\nUNION ALL\n".join(selects) + ")"


def stored_fields_sql() -> str:
    """The same rows for another engine, to follow ``sql_of('v_field_sheet')``."""
    selects = []
    for turn, name in enumerate(FIELD_NAMES):
        parts = ", ".join(f"{sql} AS {col}" for col, sql in _field_parts(name, turn).items())
        selects.append(f"SELECT invoice_id, org_id, {parts} FROM v_field_sheet WHERE {name} IS NOT NULL")
    return "v_fields AS (" + "\nUNION ALL\n".join(selects) + ")"


VIEWS["v_jobs"] = """
SELECT event_id AS job_id, user_id AS invoice_id, user_id % 25 AS org_id,
       CASE event_type WHEN 'signup' THEN 'ingest' WHEN 'view' THEN 'extract'
            WHEN 'click' THEN 'validate' WHEN 'purchase' THEN 'confidence'
            ELSE 'finalize' END AS stage,
       CASE event_id % 4 WHEN 2 THEN 'failed' WHEN 3 THEN 'running' ELSE 'done' END AS status,
       CASE WHEN event_id % 4 = 2 THEN 'OCR_NO_TEXT' END AS error,
       props AS payload, ts AS created_at, CAST(100 + event_id % 900 AS BIGINT) AS tokens
FROM {events}"""

VIEWS["v_checked"] = """
SELECT t.*, s.iban, s.vat AS supplier_vat
FROM {v_totals} t JOIN {v_suppliers} s ON t.supplier_id = s.supplier_id"""


def _json_field(name: str, value: str, source: str, missing: str = "false") -> str:
    """SQL text that yields one field of a model answer; NULL becomes null."""
    def quoted(x):
        return f"coalesce('\"' || {x} || '\"', 'null')"

    return (
        f"'\"{name}\": {{{{\"value\": ' || {quoted(value)} || ', \"missing\": {missing}, "
        f"\"source_text\": ' || {quoted(source)} || '}}}}'"
    )


_ANSWER = (
    "'{{\"doc_type\": ' || CASE WHEN doc_id % 6 = 1 THEN '\"credit_note\"' WHEN doc_id % 6 = 2 "
    "THEN '\"\"' ELSE 'null' END || ', \"language\": ' || CASE WHEN doc_id % 7 = 1 THEN '\"en\"' "
    "ELSE 'null' END || ', \"country\": ' || CASE WHEN doc_id % 9 = 2 THEN '\"at\"' ELSE 'null' END"
    " || ', \"fields\": {{' || "
    + _json_field("supplier_name", "CASE WHEN doc_id % 8 = 1 THEN t0 || ' Group' ELSE upper(t0) END",
                  "CASE WHEN doc_id % 8 = 4 THEN 'nowhere' ELSE '  ' || t0 || ' ' END")
    + " || ', ' || "
    + _json_field("total", "CASE WHEN doc_id % 8 = 3 THEN '999.00' ELSE total_text END", "t10")
    + " || ', ' || "
    + _json_field("due_date", "CASE WHEN doc_id % 8 = 5 THEN '2030-01-01' "
                  "ELSE CAST(due_on AS STRING) END", "t5 || ' (due)'")
    + " || ', ' || "
    + _json_field("buyer", "'Buyer ' || CAST(doc_id % 100 AS STRING)", "CAST(NULL AS STRING)")
    + " || ', ' || " + _json_field("shipping", "'4,90'", "t7", "true")
    + " || '}}, \"line_items\": [' || CASE WHEN doc_id % 5 = 2 THEN '{{\"description\": \"Fracht\", "
    "\"quantity\": \"2\", \"unit_price\": \"1.500,00\", \"gross\": \"3000\", \"source_text\": "
    "\"Fracht\"}}, {{\"description\": \"Porto\", \"net\": \"4,90\", \"vat_rate\": \"19 %\"}}' "
    "ELSE '' END || ']}}'"
)
_FENCE = "'```json' || chr(10) || answer || chr(10) || '```'"
VIEWS["v_answers"] = f"""
SELECT doc_id, 1 AS attempt, CASE doc_id % 4 WHEN 0 THEN {_FENCE}
       WHEN 1 THEN 'Here it is: ' || answer || ' Done.' WHEN 2 THEN answer
       ELSE substr(answer, 1, 40) END AS raw_text
FROM (SELECT doc_id, {_ANSWER} AS answer FROM {{v_sheets}}) a
UNION ALL
SELECT doc_id, 2 AS attempt, CASE WHEN doc_id % 12 = 3 THEN 'no answer' ELSE answer END AS raw_text
FROM (SELECT doc_id, {_ANSWER} AS answer FROM {{v_sheets}} WHERE doc_id % 4 = 3) a2"""

VIEWS["v_requests"] = f"""
SELECT p_partkey AS request_id,
       {pick('p_partkey', ['invoice date', 'total amount', 'item count', 'is paid', 'line items', 'buyer name', 'Deadline', 'Net weight', 'all pages', 'remarks', 'qty'])}
       AS name,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'for ' || p_name || CASE p_partkey % 5
            WHEN 0 THEN ' yes/no' WHEN 1 THEN ' each one' ELSE '' END END AS description,
       CASE p_partkey % 9 WHEN 0 THEN 'object' WHEN 4 THEN 'boolean' WHEN 5 THEN 'odd'
            ELSE NULL END AS given
FROM {{part}}"""

VIEWS["v_files"] = f"""
SELECT page_id AS file_id, page_id % 25 AS org_id,
       CASE WHEN page_id % 4 = 0 THEN 0 ELSE page_id % 50 END AS batch_id,
       CASE WHEN page_id % 11 = 0 THEN '../' ELSE '' END || 'scan-' || CAST(page_id AS STRING)
       || {pick('page_id', ['.pdf', '.PDF', '.png', '.docx', '.tiff', '.zip', '.pdf', ''])} AS filename,
       html AS content
FROM {{pages}}"""

_QUESTIONS = [
    ("find total >", "n"), ("list subtotal above ", "n"), ("show iban high confidence", ""),
    ("get supplier_name", ""), ("find invoice from Germany after ", "d"),
    ("total_vat under ", "n"), ("due_date before ", "d"), ("status is flagged", ""),
    ("show all receipts from France", ""), ("currency", ""),
]
_QUESTION = "CASE number % 10 " + " ".join(
    f"WHEN {i} THEN '{text}'" + {
        "n": " || CAST(number * 37 % 90000 AS STRING) || CASE WHEN number % 3 = 0 THEN ' EUR' ELSE '' END",
        "d": " || CAST(1995 + number % 6 AS STRING) || '-0' || CAST(1 + number % 9 AS STRING) || '-15'",
        "": "",
    }[kind] for i, (text, kind) in enumerate(_QUESTIONS)
) + " END"
VIEWS["v_questions"] = f"""
SELECT number AS query_id, number % 25 AS org_id, {_QUESTION} AS question
FROM (SELECT event_id AS number FROM {{events}}) e"""
VIEWS["v_saved_searches"] = f"""
SELECT number AS query_id, number AS org_id, {_QUESTION} AS question
FROM (SELECT CAST(n_nationkey AS BIGINT) AS number FROM {{nation}}) n"""

# --- the views on Spark ------------------------------------------------------


class Views:
    """The views of one folder as DataFrames; each is built once per object."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._built, self._parts = spark, folder, {}, None

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.spark.sql(VIEWS[name], **{n: self[n] for n in _needs(VIEWS[name])})

    def printed_once(self) -> "Views":
        """The printed sums as a table, for queries that need sheets or fields several times."""
        self._built["v_printed_sums"] = stored(self["v_printed_sums"], "printed")
        return self

    def lines(self, numbered: bool = False) -> DataFrame:
        """Line items; the position costs a shuffle and comes only when asked for."""
        return self["v_line_items" if numbered else "v_line_values"].drop(*LINE_ORDER)

    def together(self, frame: DataFrame, key: str = "doc_id") -> DataFrame:
        """Rows of one document together, before blocks, cells or fields are made of them; alike for all frames.

        What is made of a row is many times its length: the number of parts follows from the cells. With
        fewer parts than other shuffles have, a join would deal all that is made out anew.
        """
        if self._parts is None:
            cells = CELLS * (self["lineitem"].count() + self["orders"].count())
            self._parts = max(-(-cells // TASK_ROWS), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return frame.repartition(self._parts, key)

    def spread_out(self) -> bool:
        """No document has a large share of the line items: those of each can lie together."""
        lines = self["lineitem"].select(F.col("l_orderkey").alias("doc_id"), "l_linenumber")
        return pieces(lines, ["doc_id"], "l_linenumber")[0] is None

    def blocks(self, together: bool = False) -> DataFrame:
        """Printed lines: one row per text block; together: those of one document."""
        printed = F.array(*[
            F.struct(
                F.lit(1 if n == SHEET_LINES - 1 else 0).alias("page_no"),
                F.lit(n).alias("block_no"),
                F.col(f"t{n}").alias("text"),
                (F.col("left_edge") if n == 0 else F.lit(0.1)).alias("x0"),
                F.lit(n / SHEET_LINES).alias("y0"),
            )
            for n in range(SHEET_LINES)
        ])
        sheets = self["v_sheets"].select("doc_id", "org_id", "conf", "left_edge", *[f"t{n}" for n in range(SHEET_LINES)])
        return (
            (self.together(sheets) if together else sheets)
            .select("doc_id", "org_id", "conf", F.inline(printed))
            .where(F.col("text").isNotNull())
            .withColumns({"x1": F.lit(0.9), "y1": F.col("y0") + F.lit(0.05)})
        )

    def cells(self, together: bool = False) -> DataFrame:
        """Table cells: one row per cell; together: those of one document."""
        row = F.array(*[
            F.struct(F.lit(c).alias("col_no"), F.col(f"c{c}").alias("text"))
            for c in range(CELLS)
        ])
        rows = self.together(self["v_rows"]) if together else self["v_rows"]
        return rows.select("doc_id", "page_no", "table_no", "row_no", F.inline(row))

    def stored_fields(self, together: bool = False) -> DataFrame:
        """Extracted fields as stored: one row per invoice and field that has a value; together: those of one invoice."""
        entries = []
        for turn, name in enumerate(FIELD_NAMES):
            p = {k: F.expr(v) for k, v in _field_parts(name, turn).items()}
            entries.append(F.struct(
                p["field"].alias("field"),
                F.struct(p["type"].alias("type"), p["value"].alias("value"),
                         p["numeric"].alias("numeric"), p["iso"].alias("iso")).alias("value"),
                p["confidence"].alias("confidence"),
                p["method"].alias("method"),
                p["source_text"].alias("source_text"),
            ))
        sheets = self["v_field_sheet"]
        return (
            (self.together(sheets, "invoice_id") if together else sheets)
            .select("invoice_id", "org_id", F.inline(F.array(*entries)))
            .where(F.col("value.value").isNotNull())
            .withColumns({
                "validator_status": F.lit(None).cast("string"),
                "validator_detail": F.lit(None).cast("map<string,string>"),
                "status": F.lit("accepted"),
            })
        )

    def words(self) -> DataFrame:
        """Words of the documents, laid out on one page each, eight to a line.

        The texts are spread first: a word's row is many times its length, and a file's part would not fit a task.
        """
        no = F.col("word_no")
        return self["documents"].select("doc_id", "text").repartition("doc_id").select(
            F.col("doc_id").alias("page_id"),
            F.posexplode(F.split("text", " ")).alias("word_no", "text"),
        ).withColumns({
            "top": F.floor(no / 8) * 12.0 + (no * 7 % 11) * 0.5,
            "x0": (no % 8) * 60.0 + 10.0,
            "conf": (no * 13 % 101 - 3).cast("int"),
            "block_num": F.floor(no / 64).cast("int"),
            "par_num": (F.floor(no / 32) % 2).cast("int"),
            "line_num": (F.floor(no / 8) % 4).cast("int"),
            "left": (no % 8 * 60 + 10).cast("int"),
        }).withColumns({
            "x1": F.col("x0") + 50.0,
            "bottom": F.col("top") + 10.0,
            "page_width": F.lit(600.0),
            "page_height": F.lit(100000.0),
        })

    def readings(self) -> DataFrame:
        """Lines of the documents as two engines read them, some pages by one engine only."""
        lines = self["documents"].select(
            "doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text")
        ).withColumn("page_no", F.lit(0))
        first = lines.where(F.col("doc_id") % 6 != 0).select(
            "*", F.lit("paddleocr").alias("engine"),
            ((F.col("doc_id") % 90 + F.col("block_no") % 10) / 100).alias("conf"),
        )
        second = lines.where(F.col("doc_id") % 5 != 0).select(
            "*", F.lit("tesseract").alias("engine"),
            ((F.col("doc_id") % 70 + 30) / 100).alias("conf"),
        )
        return first.unionByName(second)

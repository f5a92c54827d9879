"""Queries over stored records, each with the same question as SQL for another engine."""

from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..operators import (
    answers, checks, fields, metrics, records, recompute, resent, retention as upkeep, review, rules, scoring, search, versions)
from ..operators.groups import stored
from ..session import shared_folder
from . import bindings as b
from .catalog import COUNTRIES, _accepted, _deciding_checks, query
from .oracle import (
    _ALL_CTES, _AMOUNTS, _DECIDES, _FIELD_CTES, _FIELD_VIEWS, _FOUND, _MERGED, _MODEL_CTES, _SCORED, _SQL, _SUMS,
    _all_checks, _iban, _parsed_search, _total_checks, _vat, _with)

CURRENCIES = ("EUR", "GBP", "CHF")
NEEDED = {"DE": ("supplier_name", "invoice_number", "invoice_date", "iban"), "NL": ("supplier_name", "iban"),
          "IT": ("supplier_name", "invoice_date", "total"), "FR": ("supplier_vat", "total_vat")}
RATES = {"DE": (0, 7, 19), "NL": (0, 2, 4, 6), "IT": (1, 3, 5, 7)}
_KEY = "replace(replace(lower(supplier_name), 'ß', 'ss'), ' ', '')"
TOGETHER = ("v_field_sheet", "v_invoices")
_SHEET = """sheet AS (SELECT f.*, i.created_on FROM v_field_sheet f JOIN v_invoices i USING (invoice_id))"""
b.VIEWS["v_corrections"] = """
SELECT event_id AS correction_id, user_id AS invoice_id,
       CASE event_type WHEN 'click' THEN 'total' WHEN 'view' THEN 'supplier_name' ELSE 'iban' END AS field,
       'new ' || CAST(event_id AS STRING) AS new_value, ts AS created_at FROM {events}"""
b.VIEWS["v_deliveries"] = """
SELECT event_id, CAST(event_id % 6 AS INT) AS attempts, ts AS last_at, event_id % 5 = 0 AS delivered FROM {events}"""


def _sheet(v):
    found = v["v_field_sheet"].join(v["v_invoices"].select("invoice_id", "created_on"), "invoice_id")
    return found.withColumns({
        "invoice_date": F.col("invoice_date").cast("date"), "due_date": F.col("due_date").cast("date"),
        "today": F.col("created_on")})


@query
def supplier_master(v):
    return records.supplier_master(v["v_field_sheet"])


_SQL["supplier_master"] = _with(("v_field_sheet",)) + f"""
SELECT org_id, {_KEY} AS normalized_name, arg_min(supplier_name, invoice_id) AS supplier_name,
       (arg_min({{'x': supplier_vat}}, invoice_id)).x AS supplier_vat, (arg_min({{'x': iban}}, invoice_id)).x AS iban,
       count(*) AS n_invoices
FROM v_field_sheet WHERE supplier_name IS NOT NULL GROUP BY org_id, {_KEY}"""


@query
def supplier_profile(v):
    return records.supplier_profile(v["v_field_sheet"], v["v_corrections"])


_SQL["supplier_profile"] = _with(("v_field_sheet", "v_corrections")) + f"""
SELECT org_id, {_KEY} AS normalized_name, count(*) AS n_invoices, CAST(sum(total_cents) AS BIGINT) AS total_cents,
       1 - count(*) FILTER (invoice_id IN (SELECT invoice_id FROM v_corrections)) / count(*) AS accuracy
FROM v_field_sheet GROUP BY org_id, {_KEY}"""


@query
def corrected_fields(v):
    found = records.apply_corrections(v.stored_fields(together=True), v["v_corrections"])
    return found.select("invoice_id", "field", F.col("value.value").alias("value"), "method", "confidence")


_SQL["corrected_fields"] = _with(("v_field_sheet", "v_corrections"), b.stored_fields_sql()) + """
SELECT f.invoice_id, f.field, coalesce(new_value, value) AS value,
       CASE WHEN new_value IS NULL THEN method ELSE 'user' END AS method,
       CASE WHEN new_value IS NULL THEN confidence ELSE 1 END AS confidence
FROM v_fields f LEFT JOIN (SELECT invoice_id, field, arg_max(new_value, (created_at, correction_id)) AS new_value
  FROM v_corrections GROUP BY ALL) c ON c.invoice_id = f.invoice_id AND c.field = f.field"""


@query
def usage_rollup(v):
    return records.usage(v["v_jobs"], F.col("created_at").cast("date").cast("string"))


_SQL["usage_rollup"] = _with(("v_jobs",)) + """
SELECT org_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, stage, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens
FROM v_jobs GROUP BY ROLLUP (org_id, CAST(CAST(created_at AS DATE) AS VARCHAR), stage)"""


def _pages(v):
    """The printed pages, one row per block."""
    days = v["v_invoices"].select("invoice_id", "created_on")
    return v.blocks().select(F.col("doc_id").alias("invoice_id"), "org_id", "page_no").join(days, "invoice_id")


@query
def usage_breakdown(v):
    sheets = v["v_field_sheet"].select("invoice_id", F.col("supplier_name").alias("supplier"), F.col("currency").alias("source"))
    found = records.usage_breakdown(_pages(v).join(sheets, "invoice_id"), F.date_format("created_on", "yyyy"))
    near = F.abs(F.col("suppliers") - F.col("_suppliers")) <= 0.1 * F.col("_suppliers")
    exact = _pages(v).join(sheets, "invoice_id").groupBy("org_id").agg(F.countDistinct("supplier").alias("_suppliers"))
    return found.join(exact, "org_id").withColumn(
        "close", F.when(F.col("level") == 7, near)).drop("suppliers", "_suppliers")


_SQL["usage_breakdown"] = _with(("v_sheets", "v_invoices", "v_field_sheet"), b.blocks_sql()) + """
SELECT org_id, day, supplier, source, level, invoices, pages, CASE WHEN level = 7 THEN true END AS close FROM (
SELECT i.org_id, strftime(created_on, '%Y') AS day, supplier_name AS supplier, currency AS source,
       CAST(GROUPING(i.org_id, strftime(created_on, '%Y'), supplier_name, currency) AS INT) AS level,
       count(DISTINCT i.invoice_id) AS invoices, count(DISTINCT (i.invoice_id, page_no)) AS pages
FROM blocks JOIN v_invoices i ON i.invoice_id = doc_id JOIN v_field_sheet f ON f.invoice_id = i.invoice_id
GROUP BY CUBE (i.org_id, strftime(created_on, '%Y'), supplier_name, currency)) u WHERE level < 8"""


@query
def plan_quota(v):
    plans = v["v_orgs"].where("org_id % 7 <> 6").select("org_id", (F.col("org_id") % 3 * 40 + 10).alias("pages_month"))
    return records.quota(_pages(v).withColumn("month", F.date_format("created_on", "yyyy-MM")), plans)


_SQL["plan_quota"] = _with(("v_sheets", "v_invoices", "v_orgs"), b.blocks_sql()) + """
SELECT org_id, month, used, pages_month, coalesce(used > pages_month, false) AS over
FROM (SELECT i.org_id, strftime(created_on, '%Y-%m') AS month, count(DISTINCT (invoice_id, page_no)) AS used
      FROM blocks JOIN v_invoices i ON invoice_id = doc_id GROUP BY ALL) u
LEFT JOIN (SELECT org_id, org_id % 3 * 40 + 10 AS pages_month FROM v_orgs WHERE org_id % 7 <> 6) p USING (org_id)"""


@query
def date_currency_sanity(v):
    return records.sanity_checks(_sheet(v).withColumn("due_date", F.when(
        F.col("invoice_id") % 41 == 0, F.date_sub("due_date", 60)).otherwise(F.col("due_date"))), CURRENCIES)


_SQL["date_currency_sanity"] = _with(TOGETHER, _SHEET) + f"""
SELECT invoice_id, check_name, CASE WHEN ok THEN 'pass' ELSE 'warn' END AS status FROM (
SELECT invoice_id, unnest([
  {{'check_name': 'date_not_ahead', 'ok': d <= created_on + 14}}, {{'check_name': 'date_in_range', 'ok': abs(d - created_on) <= 3650}},
  {{'check_name': 'due_after_date', 'ok': CASE WHEN d IS NOT NULL THEN due >= d END}},
  {{'check_name': 'currency_known', 'ok': upper(currency) IN {CURRENCIES}}}], recursive := true)
FROM (SELECT *, CAST(invoice_date AS DATE) AS d,
             CAST(due_date AS DATE) - CASE WHEN invoice_id % 41 = 0 THEN 60 ELSE 0 END AS due FROM sheet) s) c
WHERE ok IS NOT NULL"""


@query
def bank_sanity(v):
    bic = F.when(F.col("supplier_id") % 3 == 0, F.upper(F.concat(F.substring("name", 1, 4), F.lit("DEFF")))).when(
        F.col("supplier_id") % 3 == 1, F.lit("NL1"))
    return records.bank_checks(v["v_suppliers"].withColumn("bic", bic))


_SQL["bank_sanity"] = _with(("v_suppliers",)) + """
SELECT supplier_id, 'iban_country' AS check_name, CASE WHEN substr(replace(upper(iban), ' ', ''), 1, 2)
       = substr(replace(upper(vat), ' ', ''), 1, 2) THEN 'pass' ELSE 'warn' END AS status
FROM v_suppliers WHERE iban IS NOT NULL AND vat IS NOT NULL
UNION ALL SELECT supplier_id, 'bic_form', CASE WHEN supplier_id % 3 = 0 THEN 'pass' ELSE 'warn' END
FROM v_suppliers WHERE supplier_id % 3 < 2"""


def _country():
    return F.substring(F.upper("supplier_vat"), 1, 2)


@query
def mandatory_fields(v):
    rules = v.spark.createDataFrame([(c, f) for c, fs in NEEDED.items() for f in fs], "country string, field string")
    given = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), n) for n in b.FIELD_NAMES]))
    return records.missing_fields(v["v_field_sheet"].select("invoice_id", _country().alias("country"), given.alias("given")), rules)


_MISSING = " UNION ALL ".join(
    f"SELECT invoice_id, '{field}' AS field FROM v_field_sheet WHERE upper(supplier_vat[1:2]) = '{country}' AND {field} IS NULL"
    for country, names in NEEDED.items() for field in names)
_SQL["mandatory_fields"] = _with(("v_field_sheet",)) + _MISSING


@query
def odd_tax_rates(v):
    return records.odd_rates(v.lines(), v["v_field_sheet"].select("invoice_id", _country().alias("country")), RATES)


_SQL["odd_tax_rates"] = _with(("v_field_sheet", "v_line_values")) + f"""
SELECT invoice_id, upper(supplier_vat[1:2]) AS country, count(*) AS n_lines, CAST(min(vat_rate) AS DOUBLE) AS least_rate
FROM v_line_values JOIN v_field_sheet USING (invoice_id)
WHERE {' OR '.join(f"(upper(supplier_vat[1:2]) = '{c}' AND vat_rate NOT IN {r})" for c, r in RATES.items())} GROUP BY ALL"""


@query
def odd_invoice_numbers(v):
    return records.odd_numbers(v["v_field_sheet"])


_SQL["odd_invoice_numbers"] = _with(("v_field_sheet",)) + f"""
SELECT invoice_id, shape, n, total FROM (
SELECT *, count(*) OVER (PARTITION BY org_id, name, shape) AS n, count(*) OVER (PARTITION BY org_id, name) AS total FROM (
SELECT invoice_id, org_id, {_KEY} AS name,
       regexp_replace(regexp_replace(invoice_number, '[0-9]+', '9', 'g'), '[A-Za-z]+', 'A', 'g') AS shape
FROM v_field_sheet) s) t WHERE total >= 5 AND n < 0.2 * total"""


@query
def payment_terms(v):
    return records.payment_terms(_sheet(v).withColumn("due_date", F.date_add("due_date", (F.col("invoice_id") % 7).cast("int"))))


_SQL["payment_terms"] = _with(("v_field_sheet",)) + """
SELECT invoice_id, CAST(days AS INT) AS days, abs(days - 30) <= 3 AS fits FROM (
SELECT invoice_id, CAST(due_date AS DATE) - CAST(invoice_date AS DATE) + invoice_id % 7 AS days
FROM v_field_sheet WHERE invoice_date IS NOT NULL) t"""


@query
def duplicate_candidates(v):
    return records.duplicate_candidates(_sheet(v))


_DUPLICATES = f"""SELECT * FROM (
SELECT invoice_id, 'number' AS rule, min(invoice_id) OVER (PARTITION BY org_id, {_KEY}, invoice_number) AS first_id
FROM v_field_sheet WHERE invoice_number IS NOT NULL
UNION ALL
SELECT invoice_id, 'total', min(invoice_id) OVER (PARTITION BY org_id, {_KEY}, invoice_date, total_cents)
FROM v_field_sheet WHERE invoice_date IS NOT NULL AND total_cents IS NOT NULL) d WHERE invoice_id > first_id"""
_SQL["duplicate_candidates"] = _with(("v_field_sheet",)) + _DUPLICATES


@query
def field_evaluation(v):
    stored = v.stored_fields().select("invoice_id", "field", F.col("value.value").alias("value"))
    got = stored.where(F.col("invoice_id") % 9 != 0).withColumn(
        "value", F.when(F.col("invoice_id") % 11 == 0, F.reverse("value")).otherwise(F.col("value")))
    return records.evaluation(stored.where(F.col("invoice_id") % 13 != 0), got)


_SQL["field_evaluation"] = _with(("v_field_sheet",), b.stored_fields_sql()) + """
SELECT field, tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (
SELECT field, count(*) FILTER (e AND g AND same) AS tp, count(*) FILTER (g AND NOT (e AND same)) AS fp,
       count(*) FILTER (e AND NOT (g AND same)) AS fn
FROM (SELECT field, invoice_id % 13 <> 0 AS e, invoice_id % 9 <> 0 AS g,
             invoice_id % 11 <> 0 OR reverse(value) = value AS same FROM v_fields) f GROUP BY field) s"""


@query
def seeded_error_recall(v):
    seeded = records.seeded_errors(v["v_totals"].where("subtotal IS NOT NULL AND total IS NOT NULL AND total_vat IS NOT NULL"))
    found = checks.total_checks(seeded, v.lines(), ("subtotal", "vat_total", "grand_total"))
    return records.error_recall(seeded, found)


_SQL["seeded_error_recall"] = _with(("v_totals", "v_line_items"), _AMOUNTS, _SUMS, """seeded AS (
SELECT * REPLACE (CASE WHEN seeded = 'total' THEN total + 1 ELSE total END AS total,
  CASE WHEN seeded = 'total_vat' THEN total_vat + 1 ELSE total_vat END AS total_vat,
  CASE WHEN seeded = 'subtotal' THEN subtotal + 1 ELSE subtotal END AS subtotal)
FROM (SELECT *, CASE invoice_id % 10 WHEN 0 THEN 'total' WHEN 1 THEN 'total_vat' WHEN 2 THEN 'subtotal' END AS seeded
      FROM v_totals WHERE subtotal IS NOT NULL AND total IS NOT NULL AND total_vat IS NOT NULL) s)""") + f"""
SELECT seeded, count(*) AS n, count(*) FILTER (invoice_id IN (
  SELECT invoice_id FROM ({_total_checks('seeded')}) c WHERE NOT ok)) AS caught
FROM seeded WHERE seeded IS NOT NULL GROUP BY seeded"""


@query
def confidence_histogram(v):
    return records.confidence_histogram(v.stored_fields())


_SQL["confidence_histogram"] = _with(("v_field_sheet",), b.stored_fields_sql()) + """
SELECT method, CAST(least(9, floor(confidence * 10)) AS INT) AS bin, count(*) AS n FROM v_fields GROUP BY ALL"""


@query
def best_examples(v):
    return records.best_examples(v.stored_fields(), ["org_id", "field"]).select(
        "org_id", "field", "rank", "invoice_id", F.col("value.value").alias("value"), "confidence")


_SQL["best_examples"] = _with(("v_field_sheet",), b.stored_fields_sql()) + """
SELECT org_id, field, CAST(rank AS INT) AS rank, invoice_id, value, confidence FROM (
SELECT *, row_number() OVER (PARTITION BY org_id, field ORDER BY confidence DESC, invoice_id) AS rank FROM v_fields) r
WHERE rank <= 3"""


@query
def delivery_outbox(v):
    return records.outbox(v["v_deliveries"]).withColumn("due_at", F.col("due_at").cast("string"))


_SQL["delivery_outbox"] = _with(("v_deliveries",)) + """
SELECT event_id, attempts, state, CASE WHEN state = 'waiting' THEN CAST(last_at + to_minutes([1, 10, 60][attempts]) AS VARCHAR) END AS due_at
FROM (SELECT *, CASE WHEN delivered THEN 'delivered' WHEN attempts = 0 THEN 'due' WHEN attempts > 3 THEN 'dead' ELSE 'waiting' END AS state
      FROM v_deliveries) d"""


@query
def invoice_page(v):
    return records.page_after(v["v_invoices"].where("status <> 'failed'"), "1996-06-30", 1000).select(
        "org_id", "rank", "invoice_id", "status", F.col("created_on").cast("string").alias("created_on"))


_SQL["invoice_page"] = _with(("v_invoices",)) + """
SELECT org_id, CAST(rank AS INT) AS rank, invoice_id, status, CAST(created_on AS VARCHAR) AS created_on FROM (
SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY created_on DESC, invoice_id DESC) AS rank FROM v_invoices
WHERE status <> 'failed' AND NOT deleted AND (created_on, invoice_id) < (DATE '1996-06-30', 1000)) r WHERE rank <= 50"""


@query
def retention(v):
    return records.expired(v["v_invoices"], "1998-01-01", 365)


_SQL["retention"] = _with(("v_invoices",)) + """
SELECT org_id, CAST(invoice_id AS VARCHAR) AS resource_id, 'invoice.expired' AS action FROM v_invoices
WHERE created_on < DATE '1998-01-01' - 365"""


@query
def masked_fields(v):
    return records.masked(v["v_field_sheet"]).select("invoice_id", "supplier_name", "iban", "total_cents")


_SQL["masked_fields"] = _with(("v_field_sheet",)) + """
SELECT invoice_id, substr(supplier_name, 1, 1) || '***' AS supplier_name,
       substr(iban, 1, 4) || '****' || right(iban, 2) AS iban, total_cents FROM v_field_sheet"""


def _sanity(v):
    return records.sanity_checks(_sheet(v), CURRENCIES)


@query
def reason_codes(v):
    printed = v.printed_once().blocks()
    own, accepted = v.stored_fields(), stored(_accepted(v), "accepted")
    merged = answers.merge_candidates(fields.find_fields(printed), answers.model_candidates(accepted, printed))
    return review.reason_codes(
        review.reasons_of_reading(own, scoring.reading_confidence(printed)), review.reasons_of_models(own),
        review.reasons_of_merge(merged.withColumnRenamed("doc_id", "invoice_id")), review.reasons_of_checks(_deciding_checks(v)),
        review.reasons_of_dates(_sanity(v)), review.reasons_of_missing(mandatory_fields(v)),
        review.reasons_of_duplicates(records.duplicate_candidates(_sheet(v))), review.reasons_of_tables(v.lines()))


_SQL["reason_codes"] = _with(
    ("v_answers", *_FIELD_VIEWS, "v_invoices", "v_line_values"), b.blocks_sql(), *_ALL_CTES, _FOUND, *_MODEL_CTES, _MERGED, *_FIELD_CTES, _SHEET,
    "reading AS (SELECT doc_id AS invoice_id, avg(coalesce(conf, 1)) AS p FROM blocks GROUP BY doc_id)",
    f"missing AS ({_MISSING})",
    "both_days AS (SELECT *, CAST(invoice_date AS DATE) AS d, CAST(due_date AS DATE) AS due FROM sheet)",
) + f"""
SELECT invoice_id, field, string_agg(code, ',' ORDER BY code) AS codes FROM (
SELECT f.invoice_id, field, 'LOW_OCR_CONF' AS code FROM v_fields f JOIN reading r ON r.invoice_id = f.invoice_id AND p < 0.85
UNION SELECT invoice_id, field, 'PROVIDER_LOW' FROM v_fields WHERE method = 'llm' AND confidence < 0.8
UNION SELECT doc_id, field, 'RULE_LLM_DISAGREE' FROM merged WHERE verdict IN ('kept', 'taken')
UNION SELECT invoice_id, 'total_vat', 'VAT_MISMATCH' FROM all_checks WHERE check_name = 'vat_total' AND status = 'fail'
UNION SELECT invoice_id, field, 'MISSING_MANDATORY' FROM missing
UNION SELECT invoice_id, 'invoice_date', 'DATE_SANITY' FROM both_days WHERE d > created_on + 14 OR abs(d - created_on) > 3650
UNION SELECT invoice_id, 'due_date', 'DATE_SANITY' FROM both_days WHERE due < d
UNION SELECT invoice_id, CASE rule WHEN 'number' THEN 'invoice_number' ELSE 'total' END, 'DUPLICATE_CANDIDATE'
FROM ({_DUPLICATES}) u
UNION SELECT invoice_id, 'line_items', 'TABLE_STRUCTURE_LOW' FROM v_line_values GROUP BY invoice_id
HAVING count(*) FILTER (quantity IS NULL OR unit_price IS NULL OR description IS NULL) > 0.5 * count(*)) c
GROUP BY invoice_id, field"""


@query
def currency_consistency(v):
    return review.currency_consistency(
        v["v_field_sheet"].select("invoice_id", "currency"), v.blocks().select(F.col("doc_id").alias("invoice_id"), "text"))


_SQL["currency_consistency"] = _with(("v_sheets", "v_field_sheet"), b.blocks_sql(), """
marks AS (SELECT doc_id AS invoice_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[€$£]')) AS mark FROM blocks)""", """
printed AS (SELECT DISTINCT invoice_id, CASE mark WHEN '€' THEN 'EUR' WHEN '$' THEN 'USD' WHEN '£' THEN 'GBP' ELSE mark END AS code
FROM marks WHERE mark IN ('€', '$', '£', 'EUR', 'USD', 'GBP', 'CHF'))""") + """
SELECT invoice_id, 'currency_consistent' AS check_name, CASE WHEN bool_and(code = upper(currency)) THEN 'pass' ELSE 'warn' END AS status,
       string_agg(code, ',' ORDER BY code) AS printed
FROM printed JOIN v_field_sheet USING (invoice_id) WHERE currency IS NOT NULL GROUP BY invoice_id"""

b.VIEWS["v_readers"] = """
SELECT org_id, CASE org_id % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'viewer' WHEN 2 THEN 'member' END AS role
FROM {v_orgs} WHERE org_id % 7 <> 5"""


@query
def fields_by_role(v):
    return review.visible_to(v.stored_fields(), v["v_readers"]).select(
        "invoice_id", "field", F.col("value.value").alias("value"), "source_text")


_SQL["fields_by_role"] = _with(("v_field_sheet", "v_readers"), b.stored_fields_sql()) + """
SELECT invoice_id, field, CASE WHEN seen THEN value WHEN field <> 'iban' THEN substr(value, 1, 1) || '***'
         WHEN length(value) > 6 THEN substr(value, 1, 4) || '****' || right(value, 2) ELSE '****' END AS value,
       CASE WHEN seen THEN source_text END AS source_text
FROM (SELECT f.*, field NOT IN ('supplier_name', 'iban') OR coalesce(role IN ('owner', 'admin', 'member'), false) AS seen
      FROM v_fields f LEFT JOIN v_readers r ON r.org_id = f.org_id) s"""


def _judged(v, invoices):
    return checks.total_checks(invoices, v.lines(), ("subtotal", "vat_total", "grand_total")).unionByName(
        checks.code_checks(invoices, only_present=False))


@query
def mistake_recall(v):
    whole = v["v_checked"].where("subtotal IS NOT NULL AND total IS NOT NULL AND total_vat IS NOT NULL")
    seeded = review.seed_mistakes(review.sound(whole, _judged(v, whole)))
    failed = _judged(v, seeded).where("status = 'fail'").select("invoice_id", F.col("check_name").alias("name"))
    needed = v.spark.createDataFrame([(c, "iban") for c in fixed.VAT_SHAPES], "country string, field string")
    given = F.array_compact(F.array(F.when(F.col("iban").isNotNull(), "iban")))
    missing = records.missing_fields(seeded.select("invoice_id", _country().alias("country"), given.alias("given")), needed)
    return review.mistake_recall(seeded, failed.union(missing.select("invoice_id", F.concat(F.lit("missing_"), "field"))))


_SQL["mistake_recall"] = _with(("v_checked", "v_line_items"), _AMOUNTS, _SUMS, f"""sound AS (
SELECT * FROM v_checked WHERE subtotal IS NOT NULL AND total IS NOT NULL AND total_vat IS NOT NULL AND invoice_id NOT IN (
  SELECT invoice_id FROM ({_total_checks('v_checked')}) t WHERE NOT ok
  UNION ALL SELECT invoice_id FROM ({_iban('v_checked', 'invoice_id')}) i WHERE status <> 'pass'
  UNION ALL SELECT invoice_id FROM ({_vat('v_checked', 'invoice_id', 'supplier_vat')}) x WHERE status <> 'pass'))""", """seeded AS (
SELECT * REPLACE (
  CASE mistake WHEN 'drift' THEN subtotal + 1 WHEN 'swapped' THEN total ELSE subtotal END AS subtotal,
  CASE mistake WHEN 'swapped' THEN subtotal ELSE total END AS total,
  CASE mistake WHEN 'vat_code' THEN left(supplier_vat, length(supplier_vat) - 1) ELSE supplier_vat END AS supplier_vat,
  CASE mistake WHEN 'iban_code' THEN left(iban, length(iban) - 1) || CAST((CAST(right(iban, 1) AS INT) + 1) % 10 AS VARCHAR)
    WHEN 'missing' THEN NULL ELSE iban END AS iban)
FROM (SELECT *, CASE invoice_id % 10 WHEN 0 THEN 'drift' WHEN 1 THEN 'vat_code' WHEN 2 THEN 'iban_code' WHEN 3 THEN 'swapped'
        WHEN 4 THEN 'missing' END AS mistake FROM sound) m
  WHERE mistake IS NOT NULL AND (mistake <> 'swapped' OR subtotal IS DISTINCT FROM total))""", f"""hits AS (
SELECT invoice_id, check_name AS name FROM ({_total_checks('seeded')}) t WHERE NOT ok
UNION ALL SELECT invoice_id, 'iban' FROM ({_iban('seeded', 'invoice_id')}) i WHERE status = 'fail'
UNION ALL SELECT invoice_id, 'vat_format' FROM ({_vat('seeded', 'invoice_id', 'supplier_vat')}) x WHERE status = 'fail'
UNION ALL SELECT invoice_id, 'missing_iban' FROM seeded WHERE iban IS NULL AND upper(supplier_vat[1:2]) IN {tuple(fixed.VAT_SHAPES)})""") + """
SELECT mistake, count(*) AS n, count(*) FILTER (hit) AS caught, count(*) FILTER (hit) / count(*) AS recall FROM (
SELECT s.mistake, EXISTS (FROM hits h WHERE h.invoice_id = s.invoice_id AND (
  (mistake = 'drift' AND name = 'subtotal') OR (mistake = 'vat_code' AND name = 'vat_format') OR (mistake = 'iban_code' AND name = 'iban')
  OR (mistake = 'swapped' AND name IN ('subtotal', 'grand_total')) OR (mistake = 'missing' AND name = 'missing_iban'))) AS hit
FROM seeded s) r GROUP BY mistake"""


@query
def correct_examples(v):
    about = v["v_field_sheet"].select("invoice_id", F.col("supplier_name").alias("supplier"), _country().alias("country"), "currency")
    return review.correct_examples(v.stored_fields(together=True), v["v_corrections"], stored(about, "about"), ["supplier", "country", "currency"])


_SQL["correct_examples"] = _with(("v_field_sheet", "v_corrections"), b.stored_fields_sql()) + """
SELECT supplier, country, currency, field, CAST(rank AS INT) AS rank, invoice_id, value, confidence FROM (
SELECT supplier_name AS supplier, upper(supplier_vat[1:2]) AS country, currency, field, f.invoice_id, value, confidence, row_number() OVER (
  PARTITION BY supplier_name, upper(supplier_vat[1:2]), currency, field ORDER BY confidence DESC, f.invoice_id) AS rank
FROM v_fields f JOIN v_field_sheet s ON s.invoice_id = f.invoice_id
LEFT JOIN (SELECT invoice_id, field AS f2, arg_max(new_value, (created_at, correction_id)) AS new_value FROM v_corrections GROUP BY ALL) c
  ON c.invoice_id = f.invoice_id AND c.f2 = field
WHERE new_value IS NULL OR new_value = value) r WHERE rank <= 3"""


@query
def cached_results(v):
    docs = v["documents"].select("doc_id", (F.col("doc_id") % 3).alias("org_id"), F.sha2("text", 256).alias("sha256"))
    results = docs.select("org_id", "sha256", F.col("doc_id").alias("result_id"), F.when(
        F.col("doc_id") % 4 == 0, "m2").otherwise("m1").alias("model"))
    return records.reusable(docs, results, "m2")


_SQL["cached_results"] = """
SELECT doc_id, doc_id % 3 AS org_id, sha256(text) AS sha256,
       max(CASE WHEN doc_id % 4 = 0 THEN doc_id END) OVER (PARTITION BY text, doc_id % 3) AS result_id
FROM documents"""


@query
def account_changes(v):
    return records.account_changes(_sheet(v))


_SQL["account_changes"] = _with(TOGETHER, _SHEET) + f"""
SELECT org_id, name AS normalized_name, count(*) FILTER (before <> iban) AS changes, count(*) AS n_invoices FROM (
SELECT org_id, {_KEY} AS name, iban, lag(iban) OVER (PARTITION BY org_id, {_KEY} ORDER BY created_on, invoice_id) AS before
FROM sheet WHERE iban IS NOT NULL) t GROUP BY ALL"""


@query
def audit_log_view(v):
    events = v["v_jobs"].select("org_id", F.col("job_id").alias("event_id"), F.concat(
        F.lit("stage."), "stage").alias("action"), F.col("created_at").alias("at"))
    return records.audit_view(events, "stage.extract", "2024-01-02").select("org_id", "event_id", "action")


_SQL["audit_log_view"] = _with(("v_jobs",)) + """
SELECT org_id, job_id AS event_id, 'stage.' || stage AS action FROM v_jobs
WHERE stage = 'extract' AND created_at >= TIMESTAMP '2024-01-02'"""



# Corrections arrive in two lots, before and after this time.
_LOT = "2024-01-16 00:00:00"


@query
def recomputed_invoices(v):
    store = versions.Versions(v.spark, shared_folder(v.spark, "versions"), span=1000)
    reading = scoring.reading_confidence(v.blocks())
    invoices = v["v_invoices"].select("invoice_id", "org_id", "status").join(reading, "invoice_id", "left")
    recompute.begin(store, invoices, v.stored_fields(), v.lines(numbered=True), v["v_orgs"])
    later = F.col("created_at") >= F.lit(_LOT).cast("timestamp")
    for version, lot in enumerate((~later, later), 1):
        recompute.recompute(store, v["v_corrections"].where(lot), v["v_orgs"], version)
    return store.newest("invoices").select(
        "invoice_id", "status", "score", "min_money_conf", F.col("_version").cast("int").alias("version"))


_NEWEST_SQL = """newest AS (SELECT invoice_id, field, arg_max(new_value, (created_at, correction_id)) AS new_value,
  max(CASE WHEN created_at >= TIMESTAMP '{lot}' THEN 2 ELSE 1 END) AS version
  FROM v_corrections WHERE invoice_id IN (SELECT invoice_id FROM v_invoices) GROUP BY ALL)""".format(lot=_LOT)
_SQL["recomputed_invoices"] = _with(
    ("v_field_sheet", "v_corrections", "v_line_items", "v_sheets", "v_orgs", "v_invoices"), b.stored_fields_sql(), _NEWEST_SQL,
    """c_fields AS (SELECT coalesce(f.invoice_id, n.invoice_id) AS invoice_id, coalesce(f.field, n.field) AS field,
  coalesce(new_value, value) AS value, CASE WHEN new_value IS NULL THEN numeric
    WHEN coalesce(f.field, n.field) = 'total' THEN CAST(replace(new_value, 'new ', '') AS DOUBLE) END AS numeric,
  CASE WHEN new_value IS NULL THEN confidence ELSE 1 END AS confidence
  FROM v_fields f FULL JOIN newest n ON f.invoice_id = n.invoice_id AND f.field = n.field)""",
    """p_invoices AS (SELECT i.invoice_id,
CAST(max(CASE WHEN field = 'subtotal' THEN numeric END) AS DECIMAL(18,4)) AS subtotal,
CAST(max(CASE WHEN field = 'total_vat' THEN numeric END) AS DECIMAL(18,4)) AS total_vat,
CAST(NULL AS DECIMAL(18,4)) AS shipping, CAST(NULL AS DECIMAL(18,4)) AS other,
CAST(max(CASE WHEN field = 'total' THEN numeric END) AS DECIMAL(18,4)) AS total,
max(CASE WHEN field = 'iban' THEN value END) AS iban, max(CASE WHEN field = 'supplier_vat' THEN value END) AS supplier_vat
FROM v_invoices i LEFT JOIN c_fields c ON c.invoice_id = i.invoice_id GROUP BY i.invoice_id)""",
    _AMOUNTS, _SUMS, _all_checks(True).replace("v_checked", "p_invoices"),
    f"""judged_fields AS (SELECT f.*, i.org_id, c.status AS validator_status FROM c_fields f JOIN v_invoices i USING (invoice_id)
LEFT JOIN all_checks c ON c.invoice_id = f.invoice_id AND c.check_name = {_DECIDES})""",
    _SCORED,
    "gate AS (" + _SQL["document_gate"].split(_SCORED)[1] + ")",
    "lots AS (SELECT invoice_id, max(version) AS version FROM newest GROUP BY invoice_id)",
) + """
SELECT invoice_id, status, score, min_money_conf, CAST(coalesce(version, 0) AS INT) AS version
FROM gate LEFT JOIN lots USING (invoice_id)"""


@query
def search_indexed(v):
    store = shared_folder(v.spark, "index")
    checks.apply_to_fields(v.stored_fields(), _deciding_checks(v)).drop("validator_detail").write.parquet(f"{store}/fields")
    judged = v.spark.read.parquet(f"{store}/fields")
    parsed = search.parse_search(v["v_saved_searches"], COUNTRIES, b.FIELD_NAMES).withColumns({
        "max_confidence": F.when(F.col("query_id") % 4 == 1, 0.9),
        "validation_status": F.when(F.col("query_id") % 7 == 3, "fail").when(F.col("query_id") % 7 == 4, "pass"),
        "text_query": F.when(F.col("query_id") % 5 == 2, "kg 1").otherwise(F.col("text_query"))})
    # The searches are read several times; as a stored table they are taken apart once.
    parsed.write.parquet(f"{store}/searches")
    parsed = v.spark.read.parquet(f"{store}/searches")
    index = search.index_fields(judged, store)
    found = search.search_fields(judged, parsed, index=index)
    return found.select("query_id", "rank", "invoice_id", "field", F.col("value.value").alias("value"), "confidence", "validator_status")


_SQL["search_indexed"] = _with(
    _FIELD_VIEWS + ("v_saved_searches",), *_FIELD_CTES, f"""asked AS (SELECT * REPLACE (
  CASE WHEN query_id % 5 = 2 THEN 'kg 1' ELSE text_query END AS text_query),
  CASE WHEN query_id % 4 = 1 THEN 0.9::DOUBLE END AS max_confidence,
  CASE query_id % 7 WHEN 3 THEN 'fail' WHEN 4 THEN 'pass' END AS validation_status
  FROM ({_parsed_search('v_saved_searches')}) p)""") + _SQL["search_fields"][
    _SQL["search_fields"].rindex("\nSELECT query_id, CAST(rank"):].replace("FROM v_fields f", "FROM judged_fields f").replace(
    "value, confidence", "value, confidence, validator_status").replace(
    "  AND (status IS NULL", "  AND (max_confidence IS NULL OR confidence <= max_confidence)\n"
    "  AND (validation_status IS NULL OR validator_status = validation_status)\n  AND (status IS NULL")

b.VIEWS["v_invoice_searches"] = """
SELECT CAST(n_nationkey AS BIGINT) AS query_id, CAST(n_nationkey AS BIGINT) AS org_id,
       CASE n_nationkey % 5 WHEN 0 THEN 'gizmo' WHEN 1 THEN '-01' WHEN 2 THEN 'Handels GMBH' WHEN 3 THEN 'xy' END AS q,
       CASE WHEN n_nationkey % 3 = 1 THEN 'requires_review' END AS status,
       CASE WHEN n_nationkey % 11 = 4 THEN 'nordwind kg 18' END AS supplier,
       CASE WHEN n_nationkey % 13 = 9 THEN 'PT1235993' END AS vat,
       CASE WHEN n_nationkey % 4 = 3 THEN 'EUR' END AS currency,
       CASE WHEN n_nationkey % 6 = 4 THEN 'DE' END AS country,
       CASE WHEN n_nationkey % 4 = 0 THEN CAST(900 AS DOUBLE) * n_nationkey END AS min_total,
       CASE WHEN n_nationkey % 8 = 4 THEN CAST(90000 AS DOUBLE) END AS max_total,
       CASE WHEN n_nationkey % 7 = 6 THEN CAST('1995-02-10' AS DATE) END AS from_day,
       CASE WHEN n_nationkey % 9 >= 6 THEN CAST('1997-03-20' AS DATE) END AS to_day,
       CASE WHEN n_nationkey % 2 = 1 THEN CAST('1997-01-31' AS DATE) END AS after_day, CAST(7000 AS BIGINT) AS after_id
FROM {nation}"""


@query
def invoice_search(v):
    days = v["v_invoices"].select("invoice_id", "status", "deleted", F.col("created_on").alias("day"))
    sheets = v["v_field_sheet"].join(days, "invoice_id").select(
        "invoice_id", "org_id", "status", "supplier_name", "supplier_vat", "invoice_number", "currency",
        F.substring("supplier_vat", 1, 2).alias("country"), (F.col("total_cents") / 100).cast("double").alias("total"), "day", "deleted")
    # The sheets are read by the index, the lookups and the verification.
    sheets = stored(sheets, "sheets")
    lines = v.lines().select("invoice_id", "description")
    index = search.index_invoices(sheets, lines, shared_folder(v.spark, "index"))
    found = search.search_invoices(sheets, lines, v["v_invoice_searches"], index)
    return found.withColumn("day", F.col("day").cast("string"))


_SQL["invoice_search"] = _with(("v_field_sheet", "v_invoices", "v_line_values", "v_invoice_searches"), """
said AS (SELECT DISTINCT query_id, invoice_id FROM v_line_values l JOIN v_invoice_searches q ON contains(lower(description), lower(q)))""") + """
SELECT query_id, CAST(rank AS INT) AS rank, invoice_id, CAST(day AS VARCHAR) AS day, total FROM (
SELECT q.query_id, f.invoice_id, created_on AS day, CAST(total_cents AS DOUBLE) / 100 AS total,
       row_number() OVER (PARTITION BY q.query_id ORDER BY created_on DESC, f.invoice_id DESC) AS rank
FROM v_invoice_searches q JOIN v_field_sheet f ON f.org_id = q.org_id JOIN v_invoices i ON i.invoice_id = f.invoice_id
LEFT JOIN said s ON s.query_id = q.query_id AND s.invoice_id = f.invoice_id
WHERE NOT deleted AND (q.q IS NULL OR contains(lower(invoice_number), lower(q.q)) OR contains(lower(supplier_name), lower(q.q)) OR s.invoice_id IS NOT NULL)
  AND (q.status IS NULL OR i.status = q.status) AND (supplier IS NULL OR lower(supplier_name) = lower(supplier))
  AND (q.vat IS NULL OR supplier_vat = q.vat) AND (q.currency IS NULL OR f.currency = q.currency)
  AND (country IS NULL OR substr(supplier_vat, 1, 2) = country)
  AND (min_total IS NULL OR CAST(total_cents AS DOUBLE) / 100 >= min_total)
  AND (max_total IS NULL OR CAST(total_cents AS DOUBLE) / 100 <= max_total)
  AND (from_day IS NULL OR created_on >= from_day) AND (to_day IS NULL OR created_on <= to_day)
  AND (after_day IS NULL OR created_on < after_day OR (created_on = after_day AND f.invoice_id < after_id))) h WHERE rank <= 50"""


_SHARES = {"p50": 0.5, "p95": 0.95}


@query
def stage_durations(v):
    durations = metrics.stage_durations(v["v_jobs"])
    store = shared_folder(v.spark, "sketches")
    metrics.duration_sketches(durations).write.parquet(store)
    merged = metrics.merged_quantiles(v.spark.read.parquet(store), ["stage"], _SHARES)
    return metrics.rank_checked(durations, merged, ["stage"], _SHARES)


_SQL["stage_durations"] = _with(("v_jobs",)) + """
SELECT stage, count(*) AS n, true AS p50_close, true AS p95_close FROM (
SELECT stage, status, lag(status) OVER (PARTITION BY invoice_id, stage ORDER BY created_at, job_id) AS before FROM v_jobs) j
WHERE status <> 'running' AND before = 'running' GROUP BY stage"""


@query
def stage_times(v):
    return metrics.stage_durations(v["v_jobs"]).withColumn("day", F.col("day").cast("string")).withColumn(
        "seconds", F.round("seconds", 3))


_SQL["stage_times"] = _with(("v_jobs",)) + """
SELECT invoice_id, stage, status, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day,
       round((epoch_us(created_at) - epoch_us(began)) / 1000000, 3) AS seconds FROM (
SELECT *, lag(status) OVER w AS before, lag(created_at) OVER w AS began FROM v_jobs
WINDOW w AS (PARTITION BY invoice_id, stage ORDER BY created_at, job_id)) j
WHERE status <> 'running' AND before = 'running'"""


@query
def daily_metrics(v):
    invoices = v["v_invoices"].select("invoice_id", "status", F.col("created_on").cast("string").alias("day"))
    return metrics.daily_metrics(invoices, v.stored_fields(), v["v_jobs"].select("invoice_id", "tokens"), F.lit(0.001))


_SQL["daily_metrics"] = _with(("v_invoices", "v_field_sheet", "v_jobs"), b.stored_fields_sql()) + """
SELECT day, n_invoices, n_straight, n_fields, n_llm, tokens, n_straight / n_invoices AS straight_rate,
       n_llm / nullif(n_fields, 0) AS llm_share, tokens * 0.001::DOUBLE / 1000 / n_invoices AS cost_per_invoice FROM (
SELECT CAST(created_on AS VARCHAR) AS day, count(*) AS n_invoices, count(*) FILTER (status = 'completed') AS n_straight,
       CAST(coalesce(sum(n), 0) AS BIGINT) AS n_fields, CAST(coalesce(sum(m), 0) AS BIGINT) AS n_llm, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens
FROM v_invoices LEFT JOIN (SELECT invoice_id, count(*) AS n, count(*) FILTER (method = 'llm') AS m FROM v_fields GROUP BY 1) f USING (invoice_id)
LEFT JOIN (SELECT invoice_id, sum(tokens) AS t FROM v_jobs GROUP BY 1) j USING (invoice_id) GROUP BY 1) d"""


def _reported(v, spoilt: int):
    stored = v.stored_fields().select("invoice_id", "field", F.col("value.value").alias("value"))
    got = stored.where(F.col("invoice_id") % 9 != 0).withColumn("value", F.when(
        F.col("invoice_id") % spoilt == 0, F.concat("value", F.lit("?"))).otherwise(F.col("value")))
    about = v["v_field_sheet"].select("invoice_id", F.substring("supplier_vat", 1, 2).alias("country"), "currency")
    return metrics.evaluation_report(stored.where(F.col("invoice_id") % 13 != 0), got, about, ["country", "currency"])


def _report_sql(spoilt: int) -> str:
    sets = "GROUPING SETS ((field), (field, country), (field, currency))"
    return f"""SELECT CASE WHEN GROUPING(country) = 0 THEN 'country' WHEN GROUPING(currency) = 0 THEN 'currency' ELSE '' END AS "by",
CASE WHEN GROUPING(country) = 0 THEN country WHEN GROUPING(currency) = 0 THEN currency END AS "of", field,
count(*) FILTER (e AND g AND same) AS tp, count(*) FILTER (g AND NOT (e AND same)) AS fp,
count(*) FILTER (e AND NOT (g AND same)) AS fn, count(*) FILTER (e) AS n
FROM (SELECT f.invoice_id, field, substr(supplier_vat, 1, 2) AS country, s.currency, f.invoice_id % 13 <> 0 AS e,
             f.invoice_id % 9 <> 0 AS g, f.invoice_id % {spoilt} <> 0 AS same
      FROM v_fields f JOIN v_field_sheet s ON s.invoice_id = f.invoice_id) x WHERE e OR g GROUP BY {sets}"""


@query
def evaluation_report(v):
    return _reported(v, 11)


_SQL["evaluation_report"] = _with(("v_field_sheet",), b.stored_fields_sql(), f"report AS ({_report_sql(11)})") + """
SELECT "by", "of", field, tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
       2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, tp / nullif(n, 0) AS exact FROM report"""


@query
def evaluation_regressions(v):
    store = shared_folder(v.spark, "baseline")
    _reported(v, 400).write.parquet(store)
    return metrics.regressions(_reported(v, 120), v.spark.read.parquet(store))


_SQL["evaluation_regressions"] = _with(
    ("v_field_sheet",), b.stored_fields_sql(), f"baseline AS ({_report_sql(400)})", f"report AS ({_report_sql(120)})") + """
SELECT "by", "of", field, f1_before, f1_now FROM (
SELECT b."by", b."of", b.field, 2 * b.tp / nullif(2 * b.tp + b.fp + b.fn, 0) AS f1_before,
       coalesce(2 * a.tp / nullif(2 * a.tp + a.fp + a.fn, 0), 0) AS f1_now
FROM baseline b LEFT JOIN report a ON a."by" = b."by" AND a."of" IS NOT DISTINCT FROM b."of" AND a.field = b.field) r
WHERE f1_before - f1_now > 0.005"""


@query
def account_velocity(v):
    moved = F.when(F.col("invoice_id") % 17 == 3, F.reverse("iban")).otherwise(F.col("iban"))
    return records.account_velocity(_sheet(v).withColumn("iban", moved)).withColumn("day", F.col("day").cast("string"))


_SQL["account_velocity"] = _with(TOGETHER, _SHEET) + f"""
SELECT org_id, normalized_name, CAST(day AS VARCHAR) AS day, changes, CAST(recent AS BIGINT) AS recent FROM (
SELECT org_id, normalized_name, day, changes, sum(changes) OVER (PARTITION BY org_id, normalized_name ORDER BY day
       RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW) AS recent FROM (
SELECT org_id, normalized_name, created_on AS day, count(*) FILTER (before <> iban) AS changes FROM (
SELECT org_id, {_KEY} AS normalized_name, created_on, account AS iban, lag(account) OVER (
  PARTITION BY org_id, {_KEY} ORDER BY created_on, invoice_id) AS before
FROM (SELECT *, CASE WHEN invoice_id % 17 = 3 THEN reverse(iban) ELSE iban END AS account FROM sheet) s WHERE iban IS NOT NULL) l GROUP BY ALL) d) r
WHERE changes > 0"""


@query
def retention_applied(v):
    store = shared_folder(v.spark, "retention")
    v["v_invoices"].withColumn("month", F.date_format("created_on", "yyyy-MM")).repartition("month").write.partitionBy("month").parquet(f"{store}/invoices")
    old = F.col("created_on") < F.lit("1996-05-20").cast("date")
    gone = upkeep.apply_retention(v.spark, f"{store}/invoices", "month", "invoice_id", old & (F.col("status") == "completed"), f"{store}/audit", "1")
    kept = v.spark.read.parquet(f"{store}/invoices").select("org_id", F.col("invoice_id").cast("string").alias("resource_id"), F.lit("kept").alias("action"))
    return kept.unionByName(gone.select(F.lit(None).cast("long").alias("org_id"), "resource_id", "action"))


_SQL["retention_applied"] = _with(("v_invoices",)) + """
SELECT CASE WHEN gone THEN NULL ELSE org_id END AS org_id, CAST(invoice_id AS VARCHAR) AS resource_id,
       CASE WHEN gone THEN 'expired' ELSE 'kept' END AS action
FROM (SELECT *, created_on < DATE '1996-05-20' AND status = 'completed' AS gone FROM v_invoices) i"""


@query
def doc_type_by_rules(v):
    listed = [(i, kind, word) for i, (kind, word) in enumerate(
        (kind, word) for kind, words in fixed.DOCUMENT_TYPE_WORDS.items() for word in words)]
    table = v.spark.createDataFrame(listed, "rule_id int, doc_type string, keyword string")
    return rules.classify(v["documents"], table).withColumn("keywords", F.array_join("keywords", ","))


_SQL["doc_type_by_rules"] = _SQL["doc_type"]

# Every fifth invoice comes a second time, a little off.
b.VIEWS["v_resent"] = """
SELECT f.invoice_id, f.org_id, supplier_name, total_cents, created_on AS day FROM {v_field_sheet} f JOIN {v_invoices} i ON i.invoice_id = f.invoice_id
UNION ALL SELECT f.invoice_id + 10000000, f.org_id, upper(supplier_name), total_cents + f.invoice_id % 4,
       date_add(created_on, CAST(f.invoice_id % 3 AS INT)) FROM {v_field_sheet} f JOIN {v_invoices} i ON i.invoice_id = f.invoice_id
WHERE f.invoice_id % 5 = 0"""


@query
def near_duplicate_invoices(v):
    found = resent.near_duplicates(v["v_resent"], cents=2, days=1)
    return found.withColumn("near", F.array_join(F.transform("near", lambda i: i.cast("string")), ","))


_SQL["near_duplicate_invoices"] = _with(("v_resent",), f"""
named AS (SELECT invoice_id, org_id, {_KEY} AS name, total_cents, CAST(day AS DATE) AS day FROM v_resent
  WHERE supplier_name IS NOT NULL AND total_cents IS NOT NULL AND day IS NOT NULL)""", """
classes AS (SELECT org_id, name, total_cents, day, min(invoice_id) AS class_id, count(*) AS class_size FROM named GROUP BY ALL)""") + """
SELECT n.invoice_id, c.class_id, c.class_size, coalesce((
  SELECT string_agg(o.class_id::VARCHAR, ',' ORDER BY o.class_id) FROM classes o
  WHERE o.org_id = c.org_id AND o.name = c.name AND o.class_id <> c.class_id
    AND abs(o.total_cents - c.total_cents) <= 2 AND abs(o.day - c.day) <= 1), '') AS near
FROM named n JOIN classes c ON n.org_id = c.org_id AND n.name = c.name AND n.total_cents = c.total_cents AND n.day = c.day"""

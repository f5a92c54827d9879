"""The registered queries once more, as SQL for another engine to compare with.

The derived views are shared text; what the operators do is written here anew.
"""

from .. import fixed_values as fixed
from . import bindings as b

_SQL = {}


def statements() -> dict:
    return dict(_SQL)


def _with(views: tuple, *ctes: str) -> str:
    return "WITH " + ",\n".join([b.sql_of(*views), *ctes]) + "\n"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# --- checks -----------------------------------------------------------------

_SEVERITY = "CASE status WHEN 'pass' THEN 'info' WHEN 'warn' THEN 'warning' ELSE 'error' END"
_NET = (
    "round(CAST(quantity AS DECIMAL(19,4)) * CAST(unit_price AS DECIMAL(12,4)) * "
    "CAST(1 - discount_pct * 0.01 AS DECIMAL(6,4)), 2)"
)
_AMOUNTS = f"""amounts AS (
SELECT *, CAST(net AS DECIMAL(24,2)) + CAST(vat AS DECIMAL(24,2)) AS brutto FROM (
SELECT *, round(CAST(net AS DECIMAL(24,2)) * CAST(vat_rate AS DECIMAL(8,4))
                * CAST(0.01 AS DECIMAL(4,2)), 2) AS vat
FROM (SELECT *, {_NET} AS net FROM v_line_items) x) y)"""
_SUMS = """sums AS (
SELECT invoice_id, CAST(sum(net) AS DECIMAL(30,4)) AS sum_net,
       CAST(sum(vat) AS DECIMAL(30,4)) AS sum_vat, bool_and(vat_rate = 0) AS all_zero
FROM amounts GROUP BY invoice_id)"""


def _total_checks(invoices: str) -> str:
    base = f"FROM {invoices} i LEFT JOIN sums s ON i.invoice_id = s.invoice_id"
    total = (
        "coalesce(subtotal, 0) + coalesce(total_vat, 0) + coalesce(shipping, 0)"
        " + coalesce(other, 0)"
    )
    return f"""
SELECT i.invoice_id, 'subtotal' AS check_name, coalesce(sum_net, 0) AS expected,
       subtotal AS actual, abs(coalesce(sum_net, 0) - subtotal) <= 0 AS ok {base}
WHERE subtotal IS NOT NULL
UNION ALL
SELECT i.invoice_id, 'vat_total', coalesce(sum_vat, 0), total_vat,
       abs(coalesce(sum_vat, 0) - total_vat) <= 0.02 {base} WHERE total_vat IS NOT NULL
UNION ALL
SELECT i.invoice_id, 'grand_total', {total}, total, abs({total} - total) <= 0.02 {base}
WHERE total IS NOT NULL"""


_REASONS = """CASE check_name WHEN 'grand_total' THEN 'total' ELSE check_name END
       || CASE WHEN ok THEN '_ok' ELSE '_mismatch' END"""


def _judged(source: str, reason: str = _REASONS) -> str:
    return f"""
SELECT *, {_SEVERITY} AS severity FROM (
SELECT invoice_id, check_name, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status,
       {reason} AS reason, CAST(expected AS DOUBLE) AS expected,
       CAST(actual AS DOUBLE) AS actual FROM ({source}) c) d"""


_SQL["reconcile_totals"] = _with(
    ("v_totals", "v_line_items"), _AMOUNTS, _SUMS
) + _judged(_total_checks("v_totals"))

_LINE_GROSS = """
SELECT invoice_id, 'line_gross_' || CAST(place AS VARCHAR) AS check_name, brutto AS expected,
       gross AS actual, abs(brutto - gross) <= 0.01 AS ok
FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY position) - 1 AS place
      FROM amounts) p WHERE gross IS NOT NULL"""
_LINE_REASON = "CASE WHEN ok THEN 'line_gross_ok' ELSE 'line_gross_mismatch' END"
_SQL["line_gross_check"] = _with(("v_line_items",), _AMOUNTS) + _judged(_LINE_GROSS, _LINE_REASON)

_ZERO = """
SELECT i.invoice_id, 'reverse_charge' AS check_name, NULL AS expected, NULL AS actual,
       total_vat IS NULL OR total_vat = 0 AS ok
FROM {0} i LEFT JOIN sums s ON i.invoice_id = s.invoice_id WHERE coalesce(all_zero, true)"""
_PLAIN = "SELECT invoice_id, check_name, status, severity, reason FROM "
_SQL["zero_rated_check"] = (
    _with(("v_totals", "v_line_items"), _AMOUNTS, _SUMS)
    + _PLAIN + "(" + _judged(_ZERO.format("v_totals"), "'vat_expected_zero'") + ") z"
)

_LENGTHS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in fixed.IBAN_LENGTHS.items()) + "}"


def _iban(source: str, key: str) -> str:
    """Verdict on an account number, from columns key and iban."""
    turned = "substr(code, 5) || substr(code, 1, 4)"
    digits = (
        f"list_transform(string_split({turned}, ''), lambda c: "
        "CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ascii(c) - 48 AS BIGINT) "
        "ELSE CAST(ascii(c) - 55 AS BIGINT) END)"
    )
    fold = (
        f"list_reduce(list_prepend(0::BIGINT, {digits}), "
        "lambda a, v: (a * CASE WHEN v >= 10 THEN 100 ELSE 10 END + v) % 97)"
    )
    return f"""
SELECT {key}, CASE reason WHEN 'valid' THEN 'pass' WHEN 'unknown_country_prefix' THEN 'warn'
       ELSE 'fail' END AS status,
       CASE reason WHEN 'valid' THEN 'info' WHEN 'unknown_country_prefix' THEN 'warning'
       WHEN 'missing' THEN 'warning' ELSE 'error' END AS severity, reason,
       CASE reason WHEN 'unknown_country_prefix' THEN substr(code, 1, 2) END AS country,
       CASE reason WHEN 'bad_length' THEN CAST(wanted AS VARCHAR) END AS expected,
       CASE reason WHEN 'bad_length' THEN CAST(length(code) AS VARCHAR) END AS actual,
       CASE reason WHEN 'mod97_failed' THEN CAST(rest AS VARCHAR) END AS mod97
FROM (SELECT *, CASE WHEN code IS NULL OR code = '' THEN 'missing'
             WHEN wanted IS NULL THEN 'unknown_country_prefix'
             WHEN length(code) <> wanted THEN 'bad_length'
             WHEN rest <> 1 THEN 'mod97_failed' ELSE 'valid' END AS reason
      FROM (SELECT *, {_LENGTHS}[substr(code, 1, 2)] AS wanted,
                   {fold} AS rest
            FROM (SELECT {key}, upper(regexp_replace(iban, '\\s+', '', 'g')) AS code
                  FROM {source}) q1) q2) q3"""


_VAT_ANY = "^(" + "|".join(fixed.VAT_SHAPES.values()) + ")$"


def _vat(source: str, key: str, column: str) -> str:
    return f"""
SELECT {key}, CASE reason WHEN 'valid' THEN 'pass' WHEN 'unknown_country_prefix' THEN 'warn'
       ELSE 'fail' END AS status,
       CASE reason WHEN 'valid' THEN 'info' WHEN 'format_mismatch' THEN 'error'
       ELSE 'warning' END AS severity, reason,
       CASE WHEN reason IN ('unknown_country_prefix', 'format_mismatch')
            THEN substr(code, 1, 2) END AS country,
       CASE WHEN reason = 'format_mismatch' THEN vat END AS value
FROM (SELECT *, CASE WHEN code IS NULL OR code = '' THEN 'missing'
             WHEN substr(code, 1, 2) NOT IN {_in(fixed.VAT_SHAPES)} THEN 'unknown_country_prefix'
             WHEN regexp_matches(code, '{_VAT_ANY}') THEN 'valid'
             ELSE 'format_mismatch' END AS reason
      FROM (SELECT {key}, {column} AS vat, upper(replace({column}, ' ', '')) AS code
            FROM {source}) v1) v2"""


_SQL["iban_check"] = _with(("v_suppliers",)) + _iban("v_suppliers", "supplier_id")
_SQL["vat_check"] = _with(("v_suppliers",)) + _vat("v_suppliers", "supplier_id", "vat")


def _all_checks(only_present: bool) -> str:
    """CTE all_checks with every check of every invoice."""
    iban_from, vat_from = "v_checked", "v_checked"
    if only_present:
        iban_from = "(SELECT * FROM v_checked WHERE length(iban) > 0)"
        vat_from = "(SELECT * FROM v_checked WHERE length(supplier_vat) > 0)"
    return f"""all_checks AS (
{_PLAIN} ({_judged(_LINE_GROSS, _LINE_REASON)}) a1
UNION ALL {_PLAIN} ({_judged(_total_checks('v_checked'))}) a2
UNION ALL {_PLAIN} ({_judged(_ZERO.format('v_checked'), "'vat_expected_zero'")}) a3
UNION ALL SELECT invoice_id, 'iban', status, severity, reason
FROM ({_iban(iban_from, 'invoice_id')}) a4
UNION ALL SELECT invoice_id, 'vat_format', status, severity, reason
FROM ({_vat(vat_from, 'invoice_id', 'supplier_vat')}) a5)"""


_CHECK_VIEWS = ("v_checked", "v_line_items")
_SQL["checks_all"] = (
    _with(_CHECK_VIEWS, _AMOUNTS, _SUMS, _all_checks(False)) + "SELECT * FROM all_checks"
)
_SQL["checks_present_only"] = (
    _with(_CHECK_VIEWS, _AMOUNTS, _SUMS, _all_checks(True)) + "SELECT * FROM all_checks"
)
_SQL["new_checks_only"] = (
    _with(_CHECK_VIEWS, _AMOUNTS, _SUMS, _all_checks(True))
    + "SELECT * FROM all_checks WHERE invoice_id % 2 <> 0"
)

_DECIDES = "CASE field " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CHECK_OF_FIELD.items()
) + " END"
_FIELD_CTES = (_AMOUNTS, _SUMS, _all_checks(True), b.stored_fields_sql(), f"""judged_fields AS (
SELECT f.*, c.status AS validator_status, c.reason AS rule
FROM v_fields f LEFT JOIN all_checks c
ON c.invoice_id = f.invoice_id AND c.check_name = {_DECIDES})""")
_FIELD_VIEWS = (*_CHECK_VIEWS, "v_field_sheet")
_SQL["apply_check_status"] = (
    _with(_FIELD_VIEWS, *_FIELD_CTES)
    + "SELECT invoice_id, field, validator_status, rule FROM judged_fields"
)

# --- confidence and status --------------------------------------------------

_CLASS = (
    f"CASE WHEN field IN {_in(fixed.MONEY_FIELDS)} THEN 'money' "
    f"WHEN field IN {_in(fixed.IDENTITY_FIELDS)} THEN 'identity' ELSE 'text' END"
)
_SCORED = f"""scored AS (
SELECT *, CASE WHEN score < threshold THEN 'flagged' ELSE 'accepted' END AS status FROM (
SELECT invoice_id, field, validator_status, kind, threshold, round_even(greatest(0.0::DOUBLE,
       least(1.0::DOUBLE, CASE WHEN kind = 'money' AND validator_status = 'fail' THEN
       weighted * 0.2::DOUBLE ELSE weighted END)), 4) AS score FROM (
SELECT *, CASE kind
  WHEN 'money' THEN m * 0.45::DOUBLE + r * 0.25::DOUBLE + 1.0::DOUBLE * 0.15::DOUBLE + v * 0.15::DOUBLE
  WHEN 'identity' THEN m * 0.40::DOUBLE + r * 0.30::DOUBLE + 1.0::DOUBLE * 0.15::DOUBLE + v * 0.15::DOUBLE
  ELSE m * 0.35::DOUBLE + r * 0.35::DOUBLE + 1.0::DOUBLE * 0.10::DOUBLE + v * 0.20::DOUBLE END AS weighted
FROM (
SELECT f.invoice_id, field, validator_status, {_CLASS} AS kind,
       CASE WHEN f.confidence = 0 THEN 0.5::DOUBLE ELSE f.confidence END AS m,
       round(s.conf, 4) AS r,
       CASE validator_status WHEN 'pass' THEN 1.0::DOUBLE WHEN 'warn' THEN 0.7::DOUBLE
            WHEN 'fail' THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS v,
       coalesce(nullif(CAST(o.threshold AS DOUBLE), 0), 0.85::DOUBLE) AS threshold
FROM judged_fields f JOIN v_sheets s ON s.doc_id = f.invoice_id
     JOIN v_orgs o ON o.org_id = f.org_id) p) w) t)"""
_SCORE_VIEWS = (*_FIELD_VIEWS, "v_sheets", "v_orgs", "v_invoices")
_SQL["field_confidence"] = (
    _with(_SCORE_VIEWS, *_FIELD_CTES, _SCORED)
    + "SELECT invoice_id, field, validator_status, score AS confidence, status FROM scored"
)
_FOUR = "(x // 10000 + CASE WHEN x % 10000 > 5000 OR (x % 10000 = 5000 AND (x // 10000) % 2 = 1) THEN 1 ELSE 0 END)"
_SQL["document_gate"] = _with(_SCORE_VIEWS, *_FIELD_CTES, _SCORED) + f"""
SELECT invoice_id,
       CASE WHEN status <> 'failed' THEN coalesce(CAST({_FOUR.replace('x', 'score')} AS DOUBLE) / 10000, 0) END AS score,
       CASE WHEN status <> 'failed' THEN coalesce(CAST({_FOUR.replace('x', 'low')} AS DOUBLE) / 10000, 0) END
       AS min_money_conf,
       CASE WHEN status = 'failed' THEN 'failed' WHEN score >= threshold THEN 'completed' ELSE 'requires_review' END AS status
FROM (SELECT i.invoice_id, i.status, threshold, coalesce(low, mean) AS low,
             least(mean, coalesce(low, mean)) AS score
      FROM v_invoices i LEFT JOIN (
        SELECT invoice_id, CAST(round(max(threshold) * 100000000) AS BIGINT) AS threshold,
               (2 * sum(points) * 10000 + count(*)) // (2 * count(*)) AS mean,
               10000 * min(CASE WHEN kind = 'money' THEN points END) AS low
        FROM (SELECT *, CAST(round(score * 10000) AS BIGINT) AS points FROM scored) q
        GROUP BY invoice_id) g ON g.invoice_id = i.invoice_id) d"""

_SQL["finalize_status"] = _with(("v_invoices",)) + """
SELECT org_id, 'system' AS actor_type, 'invoice.processed' AS action, 'invoice' AS resource,
       CAST(invoice_id AS VARCHAR) AS resource_id, '{"status":"' || CASE WHEN status IN
       ('processing', 'queued') THEN 'completed' ELSE status END || '"}' AS delta
FROM v_invoices"""

# --- stage events -----------------------------------------------------------

_SQL["latest_stage"] = _with(("v_jobs",)) + """
SELECT invoice_id, stage, job_id, payload FROM (
SELECT *, row_number() OVER (PARTITION BY invoice_id, stage
                             ORDER BY created_at DESC, job_id DESC) AS turn
FROM v_jobs WHERE status = 'done') j WHERE turn = 1"""
_SQL["skip_failed"] = _with(("v_invoices",)) + (
    "SELECT invoice_id, status FROM v_invoices WHERE status <> 'failed'"
)
_SQL["append_stage"] = _with(("v_invoices",)) + """
SELECT invoice_id, 'ingest' AS stage, CASE WHEN status = 'failed' THEN 'failed' ELSE 'done' END
       AS status, 1 AS attempt, CASE WHEN status = 'failed' THEN 'OCR_NO_TEXT' END AS error,
       CASE WHEN status = 'failed' THEN NULL
            WHEN status IN ('queued', 'processing') THEN '{"status":"processing","total_conf":0.0}'
            ELSE '{"status":"' || status || '","total_conf":0.9}' END AS payload
FROM v_invoices"""

_SQL["append_then_latest"] = _with(("v_invoices",)) + """
SELECT invoice_id, 'ingest' AS stage, '{"status":"' || status || '","day":"' || CAST(CAST(
       CASE WHEN org_id % 2 = 0 THEN created_on + INTERVAL 3 DAY ELSE created_on END AS DATE) AS VARCHAR)
       || '"}' AS payload
FROM v_invoices WHERE status <> 'failed'"""

# --- listing ----------------------------------------------------------------

_SQL["invoice_list"] = _with(("v_invoices", "v_totals", "v_field_sheet")) + f"""
SELECT x.org_id, x.invoice_id, filename, status, x.total, created_on, supplier_name, invoice_number, invoice_date FROM (
SELECT i.org_id, i.invoice_id, filename, status, CAST(total AS DOUBLE) AS total,
       CAST(created_on AS VARCHAR) AS created_on, row_number() OVER (
         PARTITION BY org_id ORDER BY created_on DESC, i.invoice_id) AS turn
FROM v_invoices i JOIN v_totals t ON t.invoice_id = i.invoice_id WHERE NOT deleted) x
LEFT JOIN v_field_sheet f ON f.invoice_id = x.invoice_id
WHERE turn <= {fixed.LISTING_LIMIT}"""
_SQL["org_lookup"] = _with(("v_orgs",)) + (
    "SELECT org_id, name, residency, CAST(threshold AS DOUBLE) AS threshold "
    "FROM v_orgs WHERE org_id = 7"
)

# --- values and fields ------------------------------------------------------

_EDGE0 = r"(?:^|[^\p{L}\p{N}_])"
_EDGE1 = r"(?:[^\p{L}\p{N}_]|$)"
_CODES = "|".join(fixed.CURRENCY_CODES) + r"|€|\$|£"
_NUM = "[0-9][0-9.,]{1,15}"
_MONEY = rf"(?i)(?:{_CODES})[\s\pZ]*{_NUM}|{_NUM}[\s\pZ]*(?:{_CODES})|{_NUM}"


def _number_sql(x: str) -> str:
    """Printed number to double, from an expression that yields the printed text."""
    kept = f"regexp_replace({x}, '[^0-9.,-]', '', 'g')"
    body = f"ltrim({kept}, '-')"
    comma, dot = f"strpos({body}, ',')", f"strpos({body}, '.')"
    comma_back, dot_back = (f"strpos(reverse({body}), '{m}')" for m in ",.")
    return f"""(CASE WHEN starts_with({kept}, '-') THEN -1 ELSE 1 END * try_cast(CASE
WHEN {comma} > 0 AND {dot} > 0 AND {comma_back} < {dot_back}
  THEN replace(replace({body}, '.', ''), ',', '.')
WHEN {comma} > 0 AND {dot} > 0 THEN replace({body}, ',', '')
WHEN {comma} > 0 AND length({body}) - {comma} <= 2
  THEN substr({body}, 1, {comma} - 1) || '.' || substr({body}, {comma} + 1)
WHEN {comma} > 0 THEN replace({body}, ',', '')
WHEN {dot} > 0 AND length({body}) - {dot} > 2 THEN replace({body}, '.', '')
ELSE {body} END AS DOUBLE))"""


_AMOUNT_LIST = (
    f"list_filter(list_transform(regexp_extract_all(text, '{_MONEY}'), lambda h: "
    f"struct_pack(raw := regexp_extract(h, '{_NUM}'), "
    f"value := {_number_sql(f'''regexp_extract(h, '{_NUM}')''')})), "
    "lambda a: a.value >= 0 AND a.value <= 1e9)"
)
_BLOCK_AMOUNTS = f"block_amounts AS (SELECT *, {_AMOUNT_LIST} AS hits FROM blocks)"
_SQL["amounts"] = _with(("v_sheets",), b.blocks_sql(), _BLOCK_AMOUNTS) + """
SELECT doc_id, block_no, no, hits[no + 1].raw AS raw, hits[no + 1].value AS value
FROM (SELECT *, unnest(range(len(hits))) AS no FROM block_amounts) u"""

_DMY = rf"{_EDGE0}([0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:19|20)[0-9]{{2}}){_EDGE1}"
_YMD = rf"{_EDGE0}((?:19|20)[0-9]{{2}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}){_EDGE1}"
_PARTS = "string_split(translate(r, './', '--'), '-')"


def _day_list(pattern: str, y: int, m: int, d: int) -> str:
    return (
        f"list_transform(regexp_extract_all(replace(text, ' ', '  '), '{pattern}', 1), "
        f"lambda r: struct_pack(raw := r, day := try_cast({_PARTS}[{y}] || '-' || "
        f"lpad({_PARTS}[{m}], 2, '0') || '-' || lpad({_PARTS}[{d}], 2, '0') AS DATE)))"
    )


_BLOCK_DATES = f"""block_dates AS (SELECT *, list_filter(list_concat(
{_day_list(_DMY, 3, 2, 1)}, {_day_list(_YMD, 1, 2, 3)}), lambda h: h.day IS NOT NULL) AS hits
FROM blocks)"""
_SQL["dates"] = _with(("v_sheets",), b.blocks_sql(), _BLOCK_DATES) + """
SELECT doc_id, block_no, no, hits[no + 1].raw AS raw, CAST(hits[no + 1].day AS VARCHAR) AS day
FROM (SELECT *, unnest(range(len(hits))) AS no FROM block_dates) u"""

_FOLDED = "replace(lower(text), 'ß', 'ss')"
_SQL["text_keys"] = f"""
SELECT doc_id,
       md5(trim(regexp_replace({_FOLDED}, '[\\s\\x0B\\x{{85}}\\pZ]+', ' ', 'g'), ' ')) AS collapsed,
       md5(replace({_FOLDED}, ' ', '')) AS key
FROM documents"""

_AT = "(page_no * 1000 + block_no)"


def _first(cte: str, value: str, name: str, how: str = "arg_min") -> str:
    return (
        f"SELECT doc_id, {how}({value}, {_AT}) AS {name}, {how}(y0, {_AT}) AS {name}_top, "
        f"{how}(text, {_AT}) AS {name}_source FROM {cte} WHERE {value} IS NOT NULL GROUP BY doc_id"
    )


_VAT_TOKENS = (
    f"list_filter(regexp_extract_all(replace(upper(text), ' ', '  '), "
    f"'{_EDGE0}([A-Z]{{2}}[A-Z0-9]{{6,14}}){_EDGE1}', 1), "
    f"lambda t: regexp_matches(t, '{_VAT_ANY}'))[1]"
)
_MOD = (
    "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(t, 5) || "
    "substr(t, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' "
    "THEN CAST(ascii(c) - 48 AS BIGINT) ELSE CAST(ascii(c) - 55 AS BIGINT) END)), "
    "lambda a, v: (a * CASE WHEN v >= 10 THEN 100 ELSE 10 END + v) % 97)"
)
_IBAN_TOKENS = (
    f"list_filter(list_transform(regexp_extract_all(upper(text), "
    f"'{_EDGE0}([A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{12,30}}){_EDGE1}', 1), "
    f"lambda t: replace(t, ' ', '')), lambda t: "
    f"coalesce(length(t) = {_LENGTHS}[substr(t, 1, 2)], false) AND {_MOD} = 1)[1]"
)
_INV = (
    f"(?i)(?:{'|'.join(fixed.NUMBER_WORDS)})(?:\\s*(?:nr\\.?|no\\.?|nummer|number|n°|n)?\\.?"
    "\\s*[:#]?\\s*)([A-Z0-9][A-Z0-9\\-/._]{1,40})"
)
_NUMBER_TOKEN = f"trim(regexp_extract(text, '{_INV}', 1), ':.,;')"
_BLOCK_CODES = f"""block_codes AS (
SELECT *, {_VAT_TOKENS} AS vat, {_IBAN_TOKENS} AS account,
       CASE WHEN {_NUMBER_TOKEN} <> '' AND NOT regexp_matches({_NUMBER_TOKEN}, '^[0-9]{{4}}$')
            THEN {_NUMBER_TOKEN} END AS number
FROM blocks)"""
_CODE_CTES = (
    _BLOCK_CODES,
    f"w_vat AS ({_first('block_codes', 'vat', 'supplier_vat')})",
    f"w_iban AS ({_first('block_codes', 'account', 'iban')})",
    f"w_number AS ({_first('block_codes', 'number', 'invoice_number')})",
)
_SQL["find_identifiers"] = _with(("v_sheets",), b.blocks_sql(), *_CODE_CTES) + """
SELECT doc_id, supplier_vat, supplier_vat_top, iban, iban_top, invoice_number,
       invoice_number_top
FROM w_vat FULL JOIN w_iban USING (doc_id) FULL JOIN w_number USING (doc_id)"""

_DUE_SQL = " OR ".join(f"contains(lower(text), '{w}')" for w in fixed.DUE_WORDS)
_DATE_CTES = (
    _BLOCK_DATES,
    f"""dated AS (SELECT *, CASE WHEN due THEN row_number() OVER (
PARTITION BY doc_id, due ORDER BY {_AT}) END AS due_turn FROM (
SELECT doc_id, page_no, block_no, y0, text, hits[1].raw AS raw,
       CAST(hits[1].day AS VARCHAR) AS day, ({_DUE_SQL}) AS due
FROM block_dates WHERE len(hits) > 0) d)""",
    f"""w_due AS (SELECT doc_id, raw AS due_date, y0 AS due_date_top, text AS due_date_source,
day AS due_day FROM dated WHERE due_turn = 1)""",
    f"""w_date AS (SELECT doc_id, arg_min(raw, {_AT}) AS invoice_date,
arg_min(y0, {_AT}) AS invoice_date_top, arg_min(text, {_AT}) AS invoice_date_source,
arg_min(day, {_AT}) AS invoice_day FROM dated
WHERE NOT due OR due_turn > 1 GROUP BY doc_id)""",
)
_SQL["find_dates"] = _with(("v_sheets",), b.blocks_sql(), *_DATE_CTES) + """
SELECT doc_id, invoice_date, invoice_date_top, due_date, due_date_top
FROM w_date FULL JOIN w_due USING (doc_id)"""

_CUR = rf"(?i){_EDGE0}(?:{'|'.join(fixed.CURRENCY_CODES)}){_EDGE1}|€|\$|£"
_CURRENCY_CTES = (
    f"""coded AS (SELECT doc_id, {_AT} AS spot, text, no,
CASE h[no + 1] WHEN '€' THEN 'EUR' WHEN '$' THEN 'USD' WHEN '£' THEN 'GBP'
ELSE upper(regexp_replace(h[no + 1], '[^A-Za-z]', '', 'g')) END AS code
FROM (SELECT *, unnest(range(len(h))) AS no FROM (
SELECT *, regexp_extract_all(replace(text, ' ', '  '), '{_CUR}') AS h FROM blocks) c1) c2)""",
    """w_currency AS (SELECT doc_id, code AS currency, source_text FROM (
SELECT doc_id, code, arg_min(text, spot) AS source_text, row_number() OVER (
  PARTITION BY doc_id ORDER BY count(*) DESC, min(spot * 1000 + no)) AS turn
FROM coded GROUP BY doc_id, code) c3 WHERE turn = 1)""",
)
_SQL["find_currency"] = (
    _with(("v_sheets",), b.blocks_sql(), *_CURRENCY_CTES)
    + "SELECT doc_id, currency, source_text FROM w_currency"
)


def _words_sql(inside, alone=()) -> str:
    tests = [f"contains(lower(text), '{w}')" for w in inside]
    tests += [f"regexp_matches(text, '(?i){_EDGE0}{w}{_EDGE1}')" for w in alone]
    return "(" + " OR ".join(tests) + ")"


_MONEY_CTES = (
    _BLOCK_AMOUNTS,
    f"""priced AS (SELECT *, hits[-1].value AS value, hits[-1].raw AS raw, CASE
WHEN {_words_sql(fixed.SUBTOTAL_WORDS, fixed.SUBTOTAL_WHOLE_WORDS)} THEN 'subtotal'
WHEN {_words_sql(fixed.TAX_WORDS, fixed.TAX_WHOLE_WORDS)} THEN 'total_vat'
WHEN {_words_sql(fixed.TOTAL_WORDS, fixed.TOTAL_WHOLE_WORDS)} THEN 'total' END AS class
FROM block_amounts WHERE len(hits) > 0)""",
    *[
        f"""w_{n} AS (SELECT doc_id, arg_max(value, {_AT}) AS {n}, arg_max(raw, {_AT}) AS {n}_raw,
arg_max(text, {_AT}) AS {n}_source FROM priced WHERE class = '{n}' GROUP BY doc_id)"""
        for n in ("subtotal", "total_vat", "total")
    ],
)
_SQL["find_money"] = _with(("v_sheets",), b.blocks_sql(), *_MONEY_CTES) + """
SELECT doc_id, subtotal, total_vat, total FROM w_subtotal FULL JOIN w_total_vat USING (doc_id)
FULL JOIN w_total USING (doc_id)"""

_SUPPLIER_CTES = (
    f"""named AS (SELECT *, trim(text) AS name FROM blocks WHERE NOT contains(text, ':')
AND NOT {_words_sql(fixed.NOT_A_SUPPLIER_WORDS)}
AND len(list_filter(string_split(trim(text), ' '), lambda w: w <> '')) >= 2
AND length(regexp_replace(text, '[^0-9]', '', 'g')) <= 6 AND y0 <= 0.6 AND x0 <= 0.4)""",
    f"w_supplier AS ({_first('named', 'name', 'supplier_name')})",
)
_SQL["find_supplier"] = (
    _with(("v_sheets",), b.blocks_sql(), *_SUPPLIER_CTES)
    + "SELECT doc_id, supplier_name, supplier_name_top FROM w_supplier"
)


def _scored_words(source: str, words_by_name: dict) -> str:
    """Per document the name with most keywords: columns doc_id, name, n, total, found."""
    rows = ", ".join(
        f"({i}, '{name}', {_list(words)})" for i, (name, words) in enumerate(words_by_name.items())
    )
    return f"""
SELECT doc_id, name, n, total, found FROM (
SELECT *, len(found) AS n, sum(len(found)) OVER (PARTITION BY doc_id) AS total, row_number() OVER (
  PARTITION BY doc_id ORDER BY len(found) DESC, turn) AS place FROM (
SELECT doc_id, turn, name, list_filter(words, lambda k: contains(lower(text), lower(k))) AS found
FROM {source}, (VALUES {rows}) AS t(turn, name, words)) s1) s2 WHERE place = 1"""


_SQL["doc_type"] = f"""
SELECT doc_id, CASE WHEN n > 0 THEN name ELSE 'unknown' END AS doc_type,
       CASE WHEN n > 0 THEN round_even(CAST(n AS DOUBLE) / total, 4) ELSE 0 END AS confidence,
       array_to_string(found, ',') AS keywords
FROM ({_scored_words('documents', fixed.DOCUMENT_TYPE_WORDS)}) b"""
_LANGUAGE = "CASE WHEN n > 0 THEN name END"
_SQL["language"] = f"""
SELECT doc_id, {_LANGUAGE} AS language, CASE WHEN n > 0 THEN round_even(
       least(0.95::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * n), 4) ELSE 0 END AS confidence
FROM ({_scored_words('documents', fixed.LANGUAGE_WORDS)}) b"""

_ALL_CTES = (*_CODE_CTES, *_DATE_CTES, *_CURRENCY_CTES, *_MONEY_CTES, *_SUPPLIER_CTES)
_TEXTS = "texts AS (SELECT doc_id, string_agg(text, '\n' ORDER BY page_no, block_no) AS text FROM blocks GROUP BY doc_id)"
_SQL["header_wide"] = _with(("v_sheets",), b.blocks_sql(), *_ALL_CTES, _TEXTS) + f"""
SELECT x.doc_id, x.doc_type, y.language, substr(supplier_vat, 1, 2) AS country, invoice_number,
       invoice_day AS invoice_date, due_day AS due_date, supplier_name, supplier_vat, currency,
       subtotal, total_vat, total, iban
FROM (SELECT doc_id, CASE WHEN n > 0 THEN name ELSE 'unknown' END AS doc_type
      FROM ({_scored_words('texts', fixed.DOCUMENT_TYPE_WORDS)}) b1) x
JOIN (SELECT doc_id, {_LANGUAGE} AS language
      FROM ({_scored_words('texts', fixed.LANGUAGE_WORDS)}) b2) y USING (doc_id)
LEFT JOIN w_vat USING (doc_id) LEFT JOIN w_iban USING (doc_id)
LEFT JOIN w_number USING (doc_id) LEFT JOIN w_date USING (doc_id) LEFT JOIN w_due USING (doc_id)
LEFT JOIN w_supplier USING (doc_id) LEFT JOIN w_currency USING (doc_id)
LEFT JOIN w_subtotal USING (doc_id) LEFT JOIN w_total_vat USING (doc_id)
LEFT JOIN w_total USING (doc_id)"""


def _row(field, kind, cte, value, numeric="NULL", iso="NULL", source=None, conf=None) -> str:
    conf = conf or fixed.RULE_CONFIDENCE[field]
    return (
        f"SELECT doc_id, '{field}' AS field, '{kind}' AS type, {value} AS value, "
        f"CAST({numeric} AS DOUBLE) AS numeric, CAST({iso} AS VARCHAR) AS iso, "
        f"CAST({conf} AS DOUBLE) AS confidence, 'rules' AS method, "
        f"{source or field + '_source'} AS source_text, 0 AS page FROM {cte}"
    )


_FOUND = "found AS (" + " UNION ALL ".join([
    _row("supplier_vat", "vat", "w_vat", "supplier_vat", iso="supplier_vat"),
    _row("iban", "iban", "w_iban", "iban"),
    _row("invoice_number", "text", "w_number", "invoice_number"),
    _row("invoice_date", "date", "w_date", "invoice_date", iso="invoice_day"),
    _row("due_date", "date", "w_due", "due_date", iso="due_day"),
    _row("currency", "currency", "w_currency", "currency", source="source_text"),
    _row("supplier_name", "text", "w_supplier", "supplier_name", source="supplier_name"),
    *[_row(n, "money", f"w_{n}", f"{n}_raw", numeric=n)
      for n in ("subtotal", "total_vat", "total")],
]) + ")"
_SQL["field_rows"] = (
    _with(("v_sheets",), b.blocks_sql(), *_ALL_CTES, _FOUND) + "SELECT * FROM found"
)

_TYPE_CASE = " ".join(
    f"WHEN {' OR '.join(f'''contains(low, '{w}')''' for w in words)} THEN '{kind}'"
    for kind, words in fixed.FIELD_TYPE_WORDS.items()
)
_SQL["field_types"] = _with(("v_requests",)) + f"""
SELECT *, CASE WHEN field_type IN ('currency', 'number') THEN 'number'
          WHEN field_type IN ('boolean', 'array', 'object') THEN field_type ELSE 'string' END
          AS json_type, CASE WHEN field_type = 'date' THEN 'date' END AS format
FROM (SELECT request_id, name, CASE WHEN given IN {_in(fixed.FIELD_TYPES)} THEN given
             {_TYPE_CASE} ELSE 'string' END AS field_type
      FROM (SELECT *, lower(name || ' ' || coalesce(description, '')) AS low
            FROM v_requests) r1) r2"""

# --- line items -------------------------------------------------------------


def _role_sql(h: str) -> str:
    low = f"lower(trim({h}))"

    def test(role):
        words = fixed.COLUMN_WORDS[role]
        if role == "vat_amount":
            return f"{low} IN {_in(words)}"
        any_of = "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"
        return f"(contains({low}, '%') AND {any_of})" if role == "vat_rate" else any_of

    return "CASE " + " ".join(
        f"WHEN {test(r)} THEN '{r}'" for r in fixed.COLUMN_WORDS
    ) + " ELSE 'text' END"


_PLACE = ("quantity", "unit_price", "net", "vat_rate", "vat_amount", "gross")
_TEXTS_SQL = "[" + ", ".join(f"trim(coalesce(c{i}, ''))" for i in range(b.CELLS)) + "]"
_NO_TOTAL = " OR ".join(f"contains(lower(coalesce(d, '')), '{w}')" for w in fixed.TOTAL_ROW_WORDS)


def _cents(x: str) -> str:
    return f"CAST(round({x}, 2) AS DOUBLE)"


def _dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,4))"


_LINE_CTES = (
    f"""filled AS (SELECT doc_id, page_no, table_no, row_no, {_TEXTS_SQL} AS t, row_number() OVER (
PARTITION BY doc_id, page_no, table_no ORDER BY row_no) AS place FROM v_rows
WHERE len(list_filter({_TEXTS_SQL}, lambda x: x <> '')) > 0)""",
    f"""heads AS (SELECT * FROM (SELECT doc_id, page_no, table_no, row_no AS head_row,
list_transform(t, lambda h: {_role_sql('h')}) AS roles, row_number() OVER (
  PARTITION BY doc_id, page_no, table_no
  ORDER BY CASE WHEN {_role_sql('t[1]')} <> 'text' THEN 0 ELSE 1 END, place) AS turn
FROM filled WHERE place <= 3) h1 WHERE turn = 1 AND len(list_filter(roles, lambda r: r <> 'text')) > 0)""",
    f"""picked AS (SELECT f.*, coalesce(nullif(t[list_position(roles, 'description')], ''),
  list_filter(t, lambda x: x <> '' AND {_number_sql('x')} IS NULL)[1]) AS d,
{', '.join(f"{_number_sql(f'''t[list_position(roles, '{r}')]''')} AS {r}" for r in _PLACE)}
FROM filled f JOIN heads h USING (doc_id, page_no, table_no) WHERE f.row_no > h.head_row)""",
    f"""net_known AS (SELECT * REPLACE (coalesce(net,
  {_cents(_dec('quantity') + ' * ' + _dec('unit_price'))}) AS net) FROM picked
WHERE NOT ({_NO_TOTAL}) AND (d IS NOT NULL OR coalesce({', '.join(_PLACE)}) IS NOT NULL))""",
    f"""vat_known AS (SELECT * REPLACE (coalesce(vat_amount, {_cents(
    'CAST(net AS DECIMAL(16,4)) * CAST(vat_rate AS DECIMAL(8,4)) * CAST(0.01 AS DECIMAL(4,2))'
    )}) AS vat_amount) FROM net_known)""",
    f"""items AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id
  ORDER BY page_no, table_no, row_no) AS position, coalesce(d, '') AS description,
quantity, unit_price, net, vat_rate, vat_amount,
coalesce(gross, {_cents(_dec('net') + ' + ' + _dec('vat_amount'))}) AS gross,
CASE WHEN d <> '' THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM vat_known)""",
)
_SQL["line_items"] = _with(("v_rows",), *_LINE_CTES) + "SELECT * FROM items"

# --- model answers ----------------------------------------------------------

_ACCEPTED = r"""parsed AS (SELECT doc_id, attempt, CASE WHEN json_valid(j) THEN j END AS j
FROM (SELECT *, regexp_extract(raw_text, '(?s)\{.*\}') AS j FROM v_answers) p1),
accepted AS (SELECT doc_id, min(attempt) AS attempt, arg_min(j, attempt) AS j FROM parsed
WHERE j IS NOT NULL AND attempt <= 2 GROUP BY doc_id)"""


def _json(path: str) -> str:
    return f"json_extract_string(j, '$.{path}')"


_SQL["parse_answers"] = _with(("v_answers",), _ACCEPTED) + f"""
SELECT d.doc_id, attempt, {_json('doc_type')} AS doc_type, {_json('language')} AS language,
       {_json('country')} AS country, {_json('fields.total.value')} AS total,
       CAST(json_array_length(j, '$.line_items') AS INT) AS n_lines
FROM (SELECT DISTINCT doc_id FROM v_answers) d LEFT JOIN accepted USING (doc_id)"""

_MODEL_FIELDS = ("supplier_name", "total", "due_date", "buyer", "shipping")


def _flat(x: str) -> str:
    return f"trim(regexp_replace({_FOLDED.replace('text', x)}, '\\s+', ' ', 'g'))"


_MODEL_CTES = (
    _ACCEPTED,
    "answered AS (" + " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS field, {_json(f'fields.{f}.value')} AS value, "
        f"{_json(f'fields.{f}.source_text')} AS source_text FROM accepted "
        f"WHERE {_json(f'fields.{f}.value')} IS NOT NULL AND {_json(f'fields.{f}.missing')} <> 'true'"
        for f in _MODEL_FIELDS
    ) + ")",
    f"""model AS (SELECT a.doc_id, a.field, a.value, max(a.source_text) AS source_text,
CASE WHEN field IN {_in(fixed.MONEY_FIELDS)} THEN {_number_sql('a.value')} END AS numeric,
CASE WHEN field IN {_in(fixed.DATE_FIELDS)} THEN a.value END AS iso,
CASE WHEN field IN {_in(fixed.MONEY_FIELDS)} THEN 'money'
     WHEN field IN {_in(fixed.DATE_FIELDS)} THEN 'date' ELSE 'text' END AS type,
arg_min(b.y0, {_AT}) AS top,
CASE WHEN count(b.doc_id) > 0 THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS confidence
FROM answered a LEFT JOIN blocks b ON a.doc_id = b.doc_id AND a.source_text <> ''
 AND (contains({_flat('b.text')}, {_flat('a.source_text')})
      OR contains({_flat('a.source_text')}, {_flat('b.text')}))
GROUP BY a.doc_id, a.field, a.value)""",
)
_SQL["answer_candidates"] = (
    _with(("v_answers",), b.blocks_sql(), *_MODEL_CTES)
    + "SELECT doc_id, field, type, value, numeric, iso, confidence, top FROM model"
)

_MODEL_LINES = f"""model_lines AS (SELECT doc_id, CAST(no + 1 AS INT) AS position,
json_extract_string(j, '$.line_items[' || no || '].description') AS description,
{', '.join(
    _number_sql(f"json_extract_string(j, '$.line_items[' || no || '].{r}')") + f' AS {r}'
    for r in _PLACE)},
CASE WHEN json_extract_string(j, '$.line_items[' || no || '].source_text') <> ''
     THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS confidence
FROM (SELECT doc_id, j, unnest(range(CAST(json_array_length(j, '$.line_items') AS BIGINT))) AS no
      FROM accepted) m)"""
_SQL["answer_lines"] = _with(("v_answers", "v_rows"), _ACCEPTED, _MODEL_LINES, *_LINE_CTES) + """
SELECT * FROM items
UNION ALL
SELECT doc_id, position, description, quantity, unit_price, net, vat_rate, vat_amount, gross,
       confidence FROM model_lines
WHERE doc_id NOT IN (SELECT doc_id FROM items)"""

_SQL["override_header"] = _with(("v_answers",), b.blocks_sql(), _TEXTS, _ACCEPTED, *_CODE_CTES[:2]) + f"""
SELECT x.doc_id, coalesce(nullif({_json('doc_type')}, ''), x.doc_type) AS doc_type,
       coalesce(nullif({_json('language')}, ''), y.language) AS language,
       coalesce(upper(nullif({_json('country')}, '')), substr(supplier_vat, 1, 2)) AS country
FROM (SELECT doc_id, CASE WHEN n > 0 THEN name ELSE 'unknown' END AS doc_type
      FROM ({_scored_words('texts', fixed.DOCUMENT_TYPE_WORDS)}) b1) x
JOIN (SELECT doc_id, {_LANGUAGE} AS language
      FROM ({_scored_words('texts', fixed.LANGUAGE_WORDS)}) b2) y USING (doc_id)
LEFT JOIN accepted USING (doc_id) LEFT JOIN w_vat USING (doc_id)"""

_KEY = "replace(replace(lower({0}), 'ß', 'ss'), ' ', '')"
_MERGED = f"""merged AS (SELECT *, CASE WHEN m_value IS NULL THEN 'rule' WHEN r_value IS NULL THEN 'model'
WHEN CASE WHEN field IN {_in(fixed.MONEY_FIELDS)} THEN abs(r_num - m_num) <= 0.02
          WHEN r_iso IS NOT NULL AND m_iso IS NOT NULL THEN r_iso = m_iso
          ELSE {_KEY.format('r_value')} = {_KEY.format('m_value')} END THEN 'agree'
WHEN field IN {_in(fixed.WELL_FORMED_FIELDS)} THEN 'kept' ELSE 'taken' END AS verdict
FROM (SELECT doc_id, field, r.value AS r_value, r.numeric AS r_num, r.iso AS r_iso,
             r.confidence AS r_conf, m.value AS m_value, m.numeric AS m_num, m.iso AS m_iso,
             m.confidence AS m_conf
      FROM found r FULL JOIN model m USING (doc_id, field)) j)"""
_SQL["merge_candidates"] = _with(
    ("v_answers",), b.blocks_sql(), *_ALL_CTES, _FOUND, *_MODEL_CTES, _MERGED
) + """
SELECT doc_id, field, CASE WHEN verdict IN ('model', 'taken') THEN m_value ELSE r_value END AS value,
       CASE WHEN verdict IN ('model', 'taken') THEN m_num ELSE r_num END AS numeric,
       round(CASE verdict WHEN 'rule' THEN r_conf WHEN 'model' THEN m_conf WHEN 'taken' THEN m_conf
         WHEN 'agree' THEN least(1.0, greatest(r_conf, m_conf) + 0.05)
         ELSE greatest(0.0, r_conf - 0.1) END, 4) AS confidence,
       CASE WHEN verdict IN ('model', 'taken') THEN 'llm' ELSE 'rules' END AS method,
       CASE WHEN verdict IN ('kept', 'taken') THEN 'warn' END AS validator_status,
       CASE WHEN verdict IN ('kept', 'taken') THEN r_value END AS rule_value,
       CASE WHEN verdict IN ('kept', 'taken') THEN m_value END AS model_value
FROM merged"""

_ROUTE_ROWS = ", ".join(f"('{p}', '{t}', '{r}')" for (p, t), r in fixed.ROUTES.items())
_PRICE_ROWS = ", ".join(f"('{r}', {p})" for r, p in fixed.TOKEN_PRICES.items())
_SQL["route_cost"] = _with(
    ("v_jobs", "v_orgs"),
    f"routes AS (SELECT * FROM (VALUES {_ROUTE_ROWS}) AS t(policy, task, route))",
    f"prices AS (SELECT * FROM (VALUES {_PRICE_ROWS}) AS t(name, price))",
    """tasks AS (SELECT j.org_id, tokens, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day,
CASE WHEN residency IN (SELECT policy FROM routes) THEN residency ELSE 'eu_only' END AS policy,
CASE stage WHEN 'extract' THEN 'extract' WHEN 'ingest' THEN 'vlm' ELSE 'classify' END AS task
FROM v_jobs j JOIN v_orgs o ON o.org_id = j.org_id)""",
) + """
SELECT org_id, route, day, tokens, calls,
       CAST(tokens AS DOUBLE) * coalesce(CAST(price AS DOUBLE), 0.001::DOUBLE) / 1000 AS cost
FROM (SELECT org_id, coalesce(a.route, d.route, 'mistral:small') AS route, day,
             CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS calls
      FROM tasks t LEFT JOIN routes a ON a.policy = t.policy AND a.task = t.task
      LEFT JOIN routes d ON d.policy = 'eu_only' AND d.task = t.task GROUP BY ALL) g
LEFT JOIN prices ON name = split_part(route, '|', 1)"""

_SQL["document_text"] = _with(
    ("v_sheets", "v_rows", "v_invoices"), b.blocks_sql(),
    """sheet_lines AS (
SELECT doc_id, page_no, 0 AS part, 0 AS a, block_no AS r, text FROM blocks
UNION ALL SELECT doc_id, page_no, table_no + 1, 0, -1, 'TABLE:' FROM v_rows
  GROUP BY doc_id, page_no, table_no
UNION ALL SELECT doc_id, page_no, table_no + 1, 1, row_no, """
    + " || ' | ' || ".join(f"c{i}" for i in range(b.CELLS))
    + """ FROM v_rows
UNION ALL SELECT DISTINCT doc_id, page_no, -1, 0, 0, '--- PAGE ' || (page_no + 1) || ' ---' FROM (
  SELECT doc_id, page_no FROM blocks UNION ALL SELECT doc_id, page_no FROM v_rows
  UNION ALL SELECT invoice_id, 0 FROM v_invoices UNION ALL SELECT invoice_id, 2 FROM v_invoices WHERE invoice_id % 4 = 0) p)""",
) + """
SELECT doc_id, CAST(length(text) AS INT) AS n_chars, md5(text) AS digest FROM (
SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no, part, a, r) AS text
FROM sheet_lines GROUP BY doc_id) t"""

# --- files and pages --------------------------------------------------------

_SQL["admit_route"] = _with(("v_files",)) + f"""
SELECT file_id, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS sha256,
       CASE WHEN count(*) OVER (PARTITION BY batch_id) > {fixed.MOST_FILES_PER_BATCH}
            THEN 'batch_too_large'
            WHEN lower(list_extract(string_split(filename, '.'), -1)) NOT IN {_in(fixed.UPLOAD_SUFFIXES)}
            THEN 'unsupported_format'
            WHEN strlen(content) > {fixed.MOST_UPLOAD_BYTES} THEN 'file_too_large' END AS rejected,
       CASE WHEN lower(filename) LIKE '%.pdf'
                 AND length(regexp_replace(content, '<[^>]*>', '', 'g')) >= {b.PRINTED_LENGTH} THEN 'digital'
            WHEN lower(filename) LIKE '%.pdf' OR regexp_matches(lower(filename), '\\.({"|".join(fixed.IMAGE_SUFFIXES)})$')
            THEN 'scan' ELSE 'unsupported' END AS route,
       CASE WHEN NOT contains(filename, '..') THEN org_id || '/' || file_id || '/' || filename END
       AS object_key
FROM v_files"""
_SQL["dedupe_exact"] = """
SELECT doc_id AS file_id, lang AS org_id, nullif(first_value(doc_id) OVER (
         PARTITION BY lang, text ORDER BY doc_id * 7919 % 1000, doc_id), doc_id)
       AS duplicate_of FROM documents"""

_WORDS = """words AS (SELECT *, no // 64 AS block, (no // 32) % 2 AS par, (no // 8) % 4 AS line,
CAST(floor((no // 8) * 12.0 + (no * 7 % 11) * 0.5) AS INT) AS top, no % 8 * 60 + 10 AS x,
no * 13 % 101 - 3 AS conf
FROM (SELECT doc_id AS page_id, unnest(string_split(text, ' ')) AS text,
             unnest(range(len(string_split(text, ' ')))) AS no FROM documents) w),
kept AS (SELECT *, regexp_replace(text, '^[\\s\\x0B\\x{85}\\pZ]+|[\\s\\x0B\\x{85}\\pZ]+$', '', 'g') AS t
FROM words WHERE conf >= 0)"""
# The first height of a page's next line is the least that lies beyond the tolerance of this one's.
_SQL["words_to_lines"] = f"""WITH RECURSIVE laid AS (SELECT *, (no // 8) * 12.0::DOUBLE + (no * 7 % 11) * 0.5::DOUBLE AS y,
  no % 8 * 60.0::DOUBLE + 10 AS x0
FROM (SELECT doc_id AS page_id, unnest(string_split(text, ' ')) AS text,
             unnest(range(len(string_split(text, ' ')))) AS no FROM documents) w),
heights AS (SELECT DISTINCT page_id, y FROM laid),
firsts AS (
SELECT page_id, min(y) AS y, 0::BIGINT AS line_no FROM heights GROUP BY page_id
UNION ALL
SELECT f.page_id, min(h.y), f.line_no + 1 FROM firsts f JOIN heights h
  ON h.page_id = f.page_id AND h.y - f.y > {fixed.LINE_TOLERANCE} AND h.y <= f.y + {fixed.LINE_TOLERANCE} + 100
GROUP BY f.page_id, f.y, f.line_no),
placed AS (SELECT l.*, f.line_no FROM laid l ASOF JOIN firsts f ON l.page_id = f.page_id AND l.y >= f.y)
SELECT page_id, line_no, md5(string_agg(text, ' ' ORDER BY x0, no) FILTER (trim(text, ' ' || chr(10) || chr(9)) <> '')) AS digest,
       min(x0) / 600 AS x0, min(y) / 100000 AS y0, (max(x0) + 50) / 600 AS x1, (max(y) + 10) / 100000 AS y1
FROM placed GROUP BY page_id, line_no
HAVING count(*) FILTER (trim(text, ' ' || chr(10) || chr(9)) <> '') > 0"""
_SQL["ocr_lines"] = f"WITH {_WORDS}" + """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y, x, block, par, line) - 1
       AS reading_order, md5(text) AS digest, round_even(least(mean / 100, 1), 6) AS conf,
       x / 600.0::DOUBLE AS x0, y / 100000.0::DOUBLE AS y0, (right_x + 50) / 600.0::DOUBLE AS x1,
       (low_y + 10) / 100000.0::DOUBLE AS y1
FROM (SELECT page_id, block, par, line, string_agg(t, ' ' ORDER BY no) AS text, avg(conf) AS mean,
             min(x) AS x, min(top) AS y, max(x) AS right_x, max(top) AS low_y
      FROM kept WHERE t <> '' GROUP BY ALL) g"""

_READINGS = """readings AS (SELECT *, 'paddleocr' AS engine,
CAST(doc_id % 90 + block_no % 10 AS DOUBLE) / 100 AS conf FROM doc_lines WHERE doc_id % 6 <> 0
UNION ALL SELECT *, 'tesseract', CAST(doc_id % 70 + 30 AS DOUBLE) / 100 FROM doc_lines
WHERE doc_id % 5 <> 0)"""
_DOC_LINES = """doc_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
unnest(range(len(string_split(text, chr(10))))) AS block_no FROM documents)"""
_SQL["no_text"] = f"WITH {_DOC_LINES}, {_READINGS}" + f"""
SELECT doc_id, 'failed' AS status, '{fixed.NO_TEXT_ERROR}' AS error FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM readings WHERE engine = 'paddleocr')"""
_SQL["order_fragments"] = f"WITH {_DOC_LINES}, {_READINGS}" + """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y0 NULLS FIRST,
       x0 NULLS FIRST, block_no) - 1 AS reading_order, md5(text) AS digest, x0, y0, x1, y1
FROM (SELECT doc_id || '-' || engine AS page_id, block_no, t AS text, (px - 1)::DOUBLE / 600 AS x0,
             py::DOUBLE / 800 AS y0, (px + 90)::DOUBLE / 600 AS x1, (py + 14)::DOUBLE / 800 AS y1
      FROM (SELECT *, CASE WHEN block_no % 13 <> 5 THEN block_no * 37 % 500 END AS px,
                   CASE WHEN block_no % 13 <> 5 THEN block_no * 53 % 700 END AS py,
                   regexp_replace(text, '^[\\s\\x0B\\x{85}\\pZ]+|[\\s\\x0B\\x{85}\\pZ]+$', '', 'g') AS t
            FROM readings) f WHERE t <> '') g"""
_SQL["page_stats"] = f"WITH {_DOC_LINES}, {_READINGS}" + """
SELECT d.doc_id, 0 AS page_no, e.engine, md5(coalesce(string_agg(r.text, chr(10) ORDER BY block_no), '')) AS digest,
       count(block_no) AS n_blocks, coalesce(round_even(avg(conf), 4), 0) AS avg_conf
FROM documents d CROSS JOIN (VALUES ('paddleocr'), ('tesseract')) e(engine)
LEFT JOIN readings r ON r.doc_id = d.doc_id AND r.engine = e.engine GROUP BY d.doc_id, e.engine"""
_PICKED = f"""
SELECT doc_id, 0 AS page_no, engine, CASE WHEN engine IS NULL THEN '{fixed.NO_TEXT_ERROR}' END AS error
FROM (SELECT d.doc_id, CASE WHEN p IS NULL AND t IS NULL THEN NULL WHEN p IS NULL THEN 'tesseract'
             WHEN p < {fixed.MIN_READING_SCORE} AND t > p THEN 'tesseract' ELSE 'paddleocr' END AS engine
      FROM documents d
      LEFT JOIN (SELECT doc_id, avg(conf) AS p FROM readings WHERE engine = 'paddleocr'
                 GROUP BY doc_id) a USING (doc_id)
      LEFT JOIN (SELECT doc_id, avg(conf) AS t FROM readings WHERE engine = 'tesseract'
                 GROUP BY doc_id) b USING (doc_id)) e"""
_SQL["pick_engine"] = f"WITH {_DOC_LINES}, {_READINGS}" + _PICKED
_SQL["page_table"] = f"WITH {_DOC_LINES}, {_READINGS}, picked AS ({_PICKED})" + """
SELECT doc_id, 0 AS page_no, 600 AS width, 800 AS height, n_chars >= 200 AS text_layer, engine,
       coalesce((SELECT count(*) FROM readings r WHERE r.doc_id = d.doc_id AND r.engine = p.engine), 0) AS n_blocks
FROM documents d JOIN picked p USING (doc_id)"""
_SQL["pages_projection"] = f"WITH {_DOC_LINES}, {_READINGS}" + """
SELECT doc_id, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engine, count(DISTINCT page_no) AS n_pages
FROM (SELECT DISTINCT doc_id, engine, block_no // 10 AS page_no FROM readings) p GROUP BY doc_id"""

# --- search and export ------------------------------------------------------


def _parsed_search(source: str) -> str:
    def first(pattern):
        return f"nullif(regexp_extract(question, '(?i){pattern}', 1), '')"

    def amount(words):
        return f"try_cast(replace({first(f'''(?:{'|'.join(words)})\\s*([0-9.,]+)''')}, ',', '') AS DOUBLE)"

    def day(words):
        return f"try_cast({first(f'''(?:{'|'.join(words)})\\s+([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})''')} AS DATE)"

    single = {k: v for k, v in fixed.SEARCH_TYPES.items() if " " not in k}
    asked = first(
        f"(?:{'|'.join(fixed.ASK_WORDS)})\\s+(?:all\\s+)?({'|'.join(fixed.SEARCH_TYPES)})(?:s|$|[^a-z])"
    )
    plural = first(f"(?:{'|'.join(fixed.ASK_WORDS)})\\s+(?:all\\s+)?(?:{'|'.join(fixed.SEARCH_TYPES)})(s)")
    kind = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in single.items())
    stops = _list(fixed.SEARCH_STOP_WORDS)
    # What the sentences of the views hold besides plain words.
    said = "question"
    for pattern in (
        "(?:over|above|under|>)\\s*[0-9]+(?: EUR)?", "(?:after|before) [0-9]{4}-[0-9]{2}-[0-9]{2}",
        "status is [a-z]+", "(?:find|show) (?:all )?(?:invoice|receipt)s?\\b", "high confidence",
        "from (?:Germany|France)",
    ):
        said = f"regexp_replace({said}, '{pattern}', ' ', 'g')"
    words = (
        f"list_filter(string_split({said}, ' '), lambda w: w <> '' AND NOT list_contains({stops}, lower(w)) "
        "AND NOT regexp_matches(w, '^[€$£><]'))"
    )
    names = _list(b.FIELD_NAMES)
    return f"""
SELECT query_id, org_id, list_filter({words}, lambda w: list_contains({names}, w))[1] AS field_name, {amount(fixed.OVER_WORDS)} AS min_amount,
       {amount(fixed.UNDER_WORDS)} AS max_amount, {day(fixed.AFTER_WORDS)} AS date_after,
       {day(fixed.BEFORE_WORDS)} AS date_before,
       CASE WHEN contains(question, 'from Germany') THEN 'Germany'
            WHEN contains(question, 'from France') THEN 'France' END AS country,
       lower({first('(?:status|state)\\s+(?:is|are|was|were)\\s+([a-z_0-9]+)')}) AS status,
       CASE WHEN {plural} IS NULL THEN CASE lower({asked}) {kind} END END AS doc_type,
       CASE WHEN contains(lower(question), 'confiden') OR contains(lower(question), 'reliable')
            THEN CASE WHEN contains(lower(question), 'high confidence')
                 OR contains(lower(question), 'confident') OR contains(lower(question), 'reliable')
            THEN 0.8::DOUBLE END END AS min_confidence,
       nullif(array_to_string(list_filter({words}, lambda w: NOT list_contains({names}, w)), ' '), '')
       AS text_query
FROM {source}"""


_SQL["parse_search"] = _with(("v_questions",)) + f"""
SELECT * REPLACE (CAST(date_after AS VARCHAR) AS date_after,
                  CAST(date_before AS VARCHAR) AS date_before)
FROM ({_parsed_search('v_questions')}) p"""
_SQL["search_fields"] = _with(
    ("v_saved_searches", "v_field_sheet"), b.stored_fields_sql(),
    f"asked AS ({_parsed_search('v_saved_searches')})",
) + f"""
SELECT query_id, CAST(rank AS INT) AS rank, invoice_id, field, value, confidence FROM (
SELECT query_id, invoice_id, field, value, confidence, row_number() OVER (
  PARTITION BY query_id ORDER BY confidence DESC, invoice_id, field) AS rank
FROM v_fields f JOIN asked q ON f.org_id = q.org_id
WHERE (field_name IS NULL OR contains(field, field_name)) AND (min_amount IS NULL OR numeric >= min_amount) AND (max_amount IS NULL OR numeric <= max_amount)
  AND (date_after IS NULL OR CAST(iso AS DATE) >= date_after)
  AND (date_before IS NULL OR CAST(iso AS DATE) <= date_before)
  AND (country IS NULL OR contains(lower(source_text), lower(country)))
  AND (min_confidence IS NULL OR confidence >= min_confidence)
  AND (status IS NULL OR status = 'accepted')
  AND (text_query IS NULL OR contains(lower(value), lower(text_query))
       OR contains(lower(source_text), lower(text_query)))) h WHERE rank <= {fixed.SEARCH_LIMIT}"""


def _exported(field: str, header: str) -> str:
    return f"coalesce(max(CASE WHEN field = '{field}' THEN value END), '') AS {header}"


_SQL["export_wide"] = _with(("v_invoices", "v_field_sheet"), b.stored_fields_sql()) + f"""
SELECT invoice_id AS doc_id, {_exported('supplier_name', 'supplier_name')},
       {_exported('invoice_number', 'number')}, {_exported('due_date', 'due_date')},
       {_exported('iban', 'iban')}, {_exported('total', 'amount')}
FROM v_invoices LEFT JOIN v_fields USING (invoice_id) GROUP BY invoice_id"""
_SQL["export_round_trip"] = _with(("v_invoices", "v_field_sheet"), b.stored_fields_sql()) + f"""
SELECT *, '  "' || supplier_name || '",' || chr(10) || ' ' || total || ' ' AS note FROM (
SELECT invoice_id AS doc_id, {_exported('supplier_name', 'supplier_name')}, {_exported('total', 'total')}
FROM v_invoices LEFT JOIN v_fields USING (invoice_id) GROUP BY invoice_id) t"""
_JSON_TEXT = "coalesce(CAST(to_json({0}) AS VARCHAR), 'null')"
_SQL["export_json"] = _with(("v_invoices", "v_field_sheet", "v_line_items"), b.stored_fields_sql(), """
pairs AS (SELECT invoice_id, string_agg(CAST(to_json(field) AS VARCHAR) || ':' || CAST(to_json(value) AS VARCHAR), ','
          ORDER BY field) AS v FROM v_fields GROUP BY invoice_id)""", """
listed AS (SELECT invoice_id, '[' || string_agg('{"description":' || coalesce(CAST(to_json(description) AS VARCHAR), 'null')
  || ',"quantity":' || coalesce(CAST(quantity AS VARCHAR), 'null') || ',"unit_price":' || coalesce(CAST(unit_price AS VARCHAR), 'null')
  || ',"net":null,"vat_rate":' || coalesce(CAST(vat_rate AS VARCHAR), 'null')
  || ',"vat_amount":null,"gross":' || coalesce(CAST(gross AS VARCHAR), 'null') || '}', ',' ORDER BY position) || ']' AS l
  FROM v_line_items GROUP BY invoice_id)""") + """
SELECT i.invoice_id AS doc_id, '{' || coalesce(v, '') || CASE WHEN l IS NULL THEN '' ELSE
       CASE WHEN v IS NULL THEN '' ELSE ',' END || '"line_items":' || l END || '}' AS record
FROM v_invoices i LEFT JOIN pairs USING (invoice_id) LEFT JOIN listed USING (invoice_id)"""

# --- arriving data ----------------------------------------------------------

_SQL["stream_stages"] = _SQL["latest_stage"]
_SQL["stream_audit"] = _SQL["finalize_status"]
# Days that end a day or more before the newest event.
_SQL["stream_usage"] = _with(("v_jobs",)) + """
SELECT org_id, CAST(day AS VARCHAR) AS day, n FROM (
SELECT org_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM v_jobs GROUP BY ALL) u
WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(created_at) FROM v_jobs) - INTERVAL 1 DAY"""
_SQL["stream_new_files"] = """
SELECT arg_min(doc_id, (doc_id * 7919 % 1000, doc_id)) AS file_id, lang AS org_id, sha256(text) AS sha256
FROM documents GROUP BY lang, text"""

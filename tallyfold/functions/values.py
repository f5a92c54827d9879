"""Column expressions that turn printed text into typed values.

Every function takes and returns a Column; nothing here touches a DataFrame, so
the expressions can be used in any projection and stay inside generated code.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fixed

# A word boundary that knows accented letters, whatever the Java version.
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"
SPACE = r"[\s\p{Z}\x{0B}\x{85}]"

# A currency may stand before or behind an amount, but the amount is the whole run
# of digits and separators either way, so only the run has to be looked for.
PRINTED_NUMBER = r"[0-9][0-9.,]{1,15}"
# For upper-case text.
CURRENCY_PATTERN = f"{WORD_START}(?:{'|'.join(fixed.CURRENCY_CODES)}){WORD_END}" + r"|€|\$|£"
DAY_FIRST_PATTERN = (
    WORD_START + r"[0-9]{1,2}[./\-][0-9]{1,2}[./\-](?:19|20)[0-9]{2}" + WORD_END
)
YEAR_FIRST_PATTERN = WORD_START + r"(?:19|20)[0-9]{2}[-/][0-9]{1,2}[-/][0-9]{1,2}" + WORD_END
VAT_TOKEN_PATTERN = WORD_START + "[A-Z]{2}[A-Z0-9]{6,14}" + WORD_END
IBAN_TOKEN_PATTERN = WORD_START + "[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){12,30}" + WORD_END
INVOICE_NUMBER_PATTERN = (
    f"(?iu)(?:{'|'.join(fixed.NUMBER_WORDS)})"
    f"(?:{SPACE}*(?:{'|'.join(fixed.NUMBER_MARKS)})?\\.?{SPACE}*[:#]?{SPACE}*)"
    r"([A-Z0-9][A-Z0-9\-/._]{1,40})"
)


def let(value: Column, use) -> Column:
    """Evaluate a value once and hand it to ``use``, also inside array lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def says(low: Column, inside: tuple, alone: tuple = ()) -> Column:
    """Lower-case text holds one of the words, or one of those that must stand alone."""
    found = contains_any(low, inside)
    if alone:
        # Boundaries are only looked for where a word stands at all.
        found = found | (contains_any(low, alone) & low.rlike(f"{WORD_START}(?:{'|'.join(alone)}){WORD_END}"))
    return found


def contains_any(text: Column, words: tuple) -> Column:
    """True when the (already lower-case) text holds one of the words."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


# --- numbers ----------------------------------------------------------------


def parse_decimal(raw: Column, strict: bool = True) -> Column:
    """Printed number -> DOUBLE, NULL when it is none.

    With both separators the last one is the decimal mark.  A single kind is a
    decimal mark only with at most two digits behind its first occurrence,
    otherwise it groups thousands.  ``strict=False`` drops trailing separators
    first, which strict reading takes for a decimal mark.
    """
    kept = F.regexp_replace(raw, r"[^0-9.,\-]", "")
    if not strict:
        kept = F.regexp_replace(kept, r"[.,]+$", "")
    return let(kept, _read_number)


def _read_number(kept: Column) -> Column:
    value = let(F.ltrim(kept, F.lit("-")), lambda body: _plain(body).try_cast("double"))
    return F.when(kept.startswith("-"), -value).otherwise(value)


def _plain(body: Column) -> Column:
    comma, dot = F.instr(body, ","), F.instr(body, ".")
    size = F.length(body)
    return (
        F.when((comma > 0) & (dot > 0) & body.rlike(r",[^.]*$"), F.translate(body, ",.", "."))
        .when((comma > 0) & (dot > 0), F.translate(body, ",", ""))
        .when((comma > 0) & (size - comma <= 2), F.overlay(body, F.lit("."), comma, 1))
        .when(comma > 0, F.translate(body, ",", ""))
        .when((dot > 0) & (size - dot > 2), F.translate(body, ".", ""))
        .otherwise(body)
    )


def amounts_in(text: Column) -> Column:
    """ARRAY<STRUCT<raw, value>> of the money-like tokens of a line, in order."""
    parsed = F.transform(
        F.regexp_extract_all(text, F.lit(PRINTED_NUMBER), F.lit(0)),
        lambda raw: F.struct(raw.alias("raw"), parse_decimal(raw).alias("value")),
    )
    return F.filter(
        parsed, lambda a: (a["value"] >= 0.0) & (a["value"] <= fixed.LARGEST_AMOUNT)
    )


# --- dates ------------------------------------------------------------------


def dates_in(text: Column) -> Column:
    """ARRAY<STRUCT<raw, day>>: day-first hits, then year-first hits, calendar-valid only."""

    def read(pattern, order):
        def day(parts):
            year, month, day = (parts[i].cast("int") for i in order)
            zero = F.lit(0)
            return F.try_make_timestamp_ntz(year, month, day, zero, zero, F.lit(0.0)).cast("date")

        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda raw: F.struct(
                raw.alias("raw"), let(F.split(raw, r"[./\-]"), day).alias("day")
            ),
        )

    hits = F.concat(read(DAY_FIRST_PATTERN, (2, 1, 0)), read(YEAR_FIRST_PATTERN, (0, 1, 2)))
    return F.filter(hits, lambda h: h["day"].isNotNull())


def iso_to_date(iso: Column) -> Column:
    """ISO text -> DATE, NULL when invalid or not written as yyyy-mm-dd."""
    return F.when(iso.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), iso.try_cast("date"))


# --- text -------------------------------------------------------------------


def fold(text: Column) -> Column:
    """Case-blind form of a text."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    """Case-blind text with each run of whitespace as one space, none at the ends."""
    return F.btrim(F.regexp_replace(fold(text), f"{SPACE}+", " "))


def comparison_key(text: Column) -> Column:
    """Case-blind text without spaces."""
    return F.replace(fold(text), F.lit(" "), F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def compact_code(code: Column) -> Column:
    """Tax or account code without whitespace, upper case."""
    return F.upper(F.regexp_replace(code, f"{SPACE}+", ""))


def vat_country(vat: Column) -> Column:
    return F.when(F.length(vat) > 0, F.substring(compact_code(vat), 1, 2))


def envelope(kind, value: Column, numeric: Column = None, iso: Column = None) -> Column:
    """STRUCT<type, value, numeric, iso>: one shape for every kind of value."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    numeric = F.lit(None) if numeric is None else numeric
    iso = F.lit(None) if iso is None else iso
    return F.struct(
        kind.cast("string").alias("type"),
        value.cast("string").alias("value"),
        numeric.cast("double").alias("numeric"),
        iso.cast("string").alias("iso"),
    )


# --- account numbers and tax identifiers ------------------------------------


def mod97(code: Column) -> Column:
    """Remainder of the ISO 13616 number, folded digit by digit so that it never gets long."""
    plain = F.upper(F.regexp_replace(code, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(plain, 5, F.length(plain)), F.substring(plain, 1, 4))

    def step(rest, char):
        return F.when(
            char.between("0", "9"), (rest * 10 + F.ascii(char) - 48) % 97
        ).otherwise((rest * 100 + F.ascii(char) - 55) % 97)

    chars = F.regexp_extract_all(turned, F.lit("."), F.lit(0))
    return F.aggregate(chars, F.lit(0), step)


def _literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(part) for item in entries.items() for part in item])


def iban_is_valid(code: Column) -> Column:
    """True for a compact code of a known country with the right length and remainder."""
    wanted = F.try_element_at(_literal_map(fixed.IBAN_LENGTHS), F.substring(code, 1, 2))
    return F.coalesce((F.length(code) == wanted) & (mod97(code) == 1), F.lit(False))


def iban_finding(iban: Column) -> Column:
    """STRUCT<status, severity, reason, evidence> for an account number."""
    code = compact_code(iban)
    country = F.substring(code, 1, 2)
    wanted = F.try_element_at(_literal_map(fixed.IBAN_LENGTHS), country)
    rest = mod97(code)
    no_evidence = F.create_map().cast("map<string,string>")
    return (
        F.when(iban.isNull() | (iban == ""), finding("fail", "warning", "missing", no_evidence))
        .when(
            wanted.isNull(),
            finding("warn", "warning", "unknown_country_prefix",
                    F.create_map(F.lit("country"), country)),
        )
        .when(
            F.length(code) != wanted,
            finding("fail", "error", "bad_length",
                    F.create_map(F.lit("expected"), wanted.cast("string"),
                                 F.lit("actual"), F.length(code).cast("string"))),
        )
        .when(
            rest != 1,
            finding("fail", "error", "mod97_failed",
                    F.create_map(F.lit("mod97"), rest.cast("string"))),
        )
        .otherwise(finding("pass", "info", "valid", no_evidence))
    )


def vat_finding(vat: Column) -> Column:
    """STRUCT<status, severity, reason, evidence> for a tax identifier."""
    code = F.upper(F.replace(vat, F.lit(" "), F.lit("")))
    country = F.substring(code, 1, 2)
    no_evidence = F.create_map().cast("map<string,string>")
    return (
        F.when(vat.isNull() | (vat == ""), finding("fail", "warning", "missing", no_evidence))
        .when(
            ~country.isin(*fixed.VAT_SHAPES),
            finding("warn", "warning", "unknown_country_prefix",
                    F.create_map(F.lit("country"), country)),
        )
        .when(code.rlike(VAT_SHAPE_PATTERN), finding("pass", "info", "valid", no_evidence))
        .otherwise(
            finding("fail", "error", "format_mismatch",
                    F.create_map(F.lit("value"), vat, F.lit("country"), country))
        )
    )


VAT_SHAPE_PATTERN = "^(?:" + "|".join(fixed.VAT_SHAPES.values()) + ")$"


def finding(status, severity, reason, evidence: Column) -> Column:
    parts = [F.lit(p) if isinstance(p, str) else p for p in (status, severity, reason)]
    return F.struct(
        parts[0].alias("status"),
        parts[1].alias("severity"),
        parts[2].alias("reason"),
        evidence.cast("map<string,string>").alias("evidence"),
    )

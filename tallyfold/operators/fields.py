"""Header fields of a document, found in its text blocks by deterministic rules.

Blocks: ``doc_id, page_no, block_no, text, conf, x0, y0, x1, y1``.  Every block
is looked at on its own and offers candidates; per document and kind only the
winner by reading order is kept.  The window that keeps it drops all others
before the shuffle, so a document of any length sends a handful of rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import values
from ..functions.kinds import document_type, keyword_numbers, keywords_in, language
from ..functions.values import envelope

# Kinds where the last block wins; for all others it is the first.
LAST_WINS = ("subtotal", "total_vat", "total")
FIRST_FIELDS = ("supplier_vat", "iban", "invoice_number", "supplier_name")
FOUND_FIELDS = (
    "supplier_vat", "iban", "invoice_number", "currency", "supplier_name", "invoice_date",
    "due_date", "subtotal", "total_vat", "total",
)
ALL_KINDS = ("vat", "iban", "number", "dates", "money", "supplier")


def reading_order() -> Column:
    """Place of a block in its document as one number."""
    return F.col("page_no").cast("bigint") * F.lit(1 << 32) + F.col("block_no")


def candidate(field: str, value: Column, source: Column = None, kind: str = None) -> Column:
    """One found field with its confidence and the place it was found at."""
    return F.struct(
        F.lit(kind or field).alias("kind"),
        F.lit(field).alias("field"),
        value.alias("value"),
        F.lit(fixed.RULE_CONFIDENCE[field]).alias("confidence"),
        F.lit("rules").alias("method"),
        (F.col("text") if source is None else source).alias("source_text"),
        bbox().alias("bbox"),
    )


def bbox() -> Column:
    corners = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
               for c in ("x0", "y0", "x1", "y1")]
    return F.struct(F.col("page_no").cast("int").alias("page"), *corners)


def _vat() -> Column:
    tokens = F.regexp_extract_all(F.col("_up"), F.lit(values.VAT_TOKEN_PATTERN), F.lit(0))
    good = F.filter(tokens, lambda t: t.rlike(values.VAT_SHAPE_PATTERN))
    return F.get(good, F.lit(0))


def _vat_offer() -> Column:
    token = F.col("_vat")
    return F.when(token.isNotNull(), candidate("supplier_vat", envelope("vat", token, iso=token)))


def _iban() -> Column:
    tokens = F.regexp_extract_all(F.col("_up"), F.lit(values.IBAN_TOKEN_PATTERN), F.lit(0))
    codes = F.transform(tokens, lambda t: F.replace(t, F.lit(" "), F.lit("")))
    return F.get(F.filter(codes, values.iban_is_valid), F.lit(0))


def _iban_offer() -> Column:
    code = F.col("_iban")
    return F.when(code.isNotNull(), candidate("iban", envelope("iban", code)))


def _number() -> Column:
    token = F.btrim(F.regexp_extract("text", values.INVOICE_NUMBER_PATTERN, 1), F.lit(":.,;"))
    return F.when(values.contains_any(F.lower("text"), fixed.NUMBER_WORDS), token)


def _number_offer() -> Column:
    token = F.col("_number")
    usable = (token != "") & ~token.rlike("^[0-9]{4}$")
    return F.when(usable, candidate("invoice_number", envelope("text", token)))


def _date_offer() -> Column:
    day = F.col("_day")
    due = values.contains_any(F.col("_low"), fixed.DUE_WORDS)
    found = envelope("date", day["raw"], iso=day["day"].cast("string"))
    return F.when(
        day.isNotNull(),
        F.when(due, candidate("due_date", found, kind="date_due"))
        .otherwise(candidate("invoice_date", found, kind="date_plain")),
    )


def _sum_named() -> Column:
    """The sum that a block speaks of."""
    low = F.col("_low")
    return (
        F.when(values.says(low, fixed.SUBTOTAL_WORDS, fixed.SUBTOTAL_WHOLE_WORDS), "subtotal")
        .when(values.says(low, fixed.TAX_WORDS, fixed.TAX_WHOLE_WORDS), "total_vat")
        .when(values.says(low, fixed.TOTAL_WORDS, fixed.TOTAL_WHOLE_WORDS), "total")
    )


def _money_offer() -> Column:
    last, name = F.col("_amount"), F.col("_sum")
    found = envelope("money", last["raw"], numeric=last["value"])
    return F.when(
        last.isNotNull(),
        F.when(name == "subtotal", candidate("subtotal", found))
        .when(name == "total_vat", candidate("total_vat", found))
        .when(name == "total", candidate("total", found)),
    )


def _supplier() -> Column:
    """The text of a block that may name the supplier, by its place and what it does not say."""
    fits = (
        (F.coalesce(F.col("y0"), F.lit(0.0)) <= fixed.SUPPLIER_MAX_TOP)
        & (F.coalesce(F.col("x0"), F.lit(0.0)) <= fixed.SUPPLIER_MAX_LEFT)
        & ~F.col("text").contains(":")
        & ~values.contains_any(F.col("_low"), fixed.NOT_A_SUPPLIER_WORDS)
    )
    return F.when(fits, values.strip(F.col("text")))


def _supplier_offer() -> Column:
    text = F.col("_stripped")
    fits = (
        text.rlike(f"[^\\s\\p{{Z}}]{values.SPACE}+[^\\s\\p{{Z}}]")
        & (F.length(F.regexp_replace(text, "[^0-9]", "")) <= fixed.SUPPLIER_MAX_DIGITS)
    )
    return F.when(fits, candidate("supplier_name", envelope("text", text), source=text))


_OFFERS = {
    "vat": _vat_offer, "iban": _iban_offer, "number": _number_offer, "dates": _date_offer,
    "money": _money_offer, "supplier": _supplier_offer,
}


def _read(blocks: DataFrame, kinds: tuple) -> DataFrame:
    """Blocks with what the finders read in them, each part worked out once."""
    text = F.col("text")
    first = F.lit(0)
    cased = blocks.withColumns({"_low": F.lower(text), "_up": F.upper(text)})
    if "money" in kinds:
        cased = cased.withColumn("_sum", _sum_named())
    # Codes, days and amounts are only taken apart where a beginning, a year or a word lets a block offer one.
    parts = {
        "vat": {"_vat": F.when(F.col("_up").rlike("[0-9]{5}"), _vat())},  # as many digits in a row has every shape
        "iban": {"_iban": F.when(F.col("_up").rlike("[A-Z]{2}[0-9]{2}"), _iban())},
        "number": {"_number": _number()},
        "dates": {"_day": F.when(text.rlike("(?:19|20)[0-9]{2}"), F.get(values.dates_in(text), first))},
        "money": {"_amount": F.when(
            F.col("_sum").isNotNull(), F.try_element_at(values.amounts_in(text), F.lit(-1)))},
        "supplier": {"_stripped": _supplier()},
    }
    return cased.withColumns({k: v for kind in kinds for k, v in parts[kind].items()})


def _winners(blocks: DataFrame, kinds: tuple) -> DataFrame:
    """At most two candidates per document and kind, numbered by ``turn``."""
    offers = F.array_compact(F.array(*[_OFFERS[k]() for k in kinds]))
    offered = _read(blocks, kinds).select("doc_id", reading_order().alias("at"), F.inline(offers))
    key = F.when(F.col("kind").isin(*LAST_WINS), -F.col("at")).otherwise(F.col("at"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy(key))
    return offered.withColumn("turn", turn).where(F.col("turn") <= 2)


def find_currency(blocks: DataFrame) -> DataFrame:
    """Most frequent currency per document; the first seen wins a tie."""
    symbols = F.create_map(*[F.lit(p) for kv in fixed.CURRENCY_SYMBOLS.items() for p in kv])
    hits = F.regexp_extract_all(F.upper("text"), F.lit(values.CURRENCY_PATTERN), F.lit(0))
    code = F.col("hit")
    seen = blocks.select(
        "doc_id", reading_order().alias("at"), "text", bbox().alias("bbox"),
        F.posexplode(hits).alias("no", "hit"),
    ).select(
        "doc_id", F.struct("at", "no").alias("place"), "text", "bbox",
        F.coalesce(F.try_element_at(symbols, code), code).alias("code"),
    )
    per_code = seen.groupBy("doc_id", "code").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("place").alias("place"),
        F.min_by(F.struct("text", "bbox"), "place").alias("source"),
    )
    best = F.min_by(F.struct("code", "source"), F.struct(-F.col("n"), "place")).alias("best")
    return per_code.groupBy("doc_id").agg(best).select(
        "doc_id",
        F.struct(
            F.lit("currency").alias("field"),
            envelope("currency", F.col("best.code")).alias("value"),
            F.lit(fixed.RULE_CONFIDENCE["currency"]).alias("confidence"),
            F.lit("rules").alias("method"),
            F.col("best.source.text").alias("source_text"),
            F.col("best.source.bbox").alias("bbox"),
        ).alias("currency"),
    )


_PARTS = ("field", "value", "confidence", "method", "source_text", "bbox")


def find_wide(blocks: DataFrame, kinds: tuple = ALL_KINDS) -> DataFrame:
    """One row per document with something found; a struct column per field.

    Dates: the first block with a due word gives the due date.  Any other block
    with a date - plain, or a due one after the first - can give the invoice
    date, and the earliest of them does.
    """
    # At most two entries a kind.
    place = F.concat_ws(" ", "kind", "turn")
    entries = F.collect_list(F.struct(place, F.struct("at", F.struct(*_PARTS).alias("body"))))

    def won(kind, turn=1):
        return F.try_element_at("won", F.lit(f"{kind} {turn}"))

    places = []
    if "dates" in kinds:
        places += [
            won("date_due").alias("due_1"), won("date_due", 2).alias("due_2"),
            won("date_plain").alias("plain_1"),
        ]
    wanted = {"vat": ["supplier_vat"], "iban": ["iban"], "number": ["invoice_number"],
              "money": list(LAST_WINS), "supplier": ["supplier_name"], "dates": []}
    names = [n for k in kinds for n in wanted[k]]
    places += [won(n).alias(n) for n in names]
    per_document = _winners(blocks, kinds).groupBy("doc_id").agg(F.map_from_entries(entries).alias("won"))
    per_document = per_document.select("doc_id", *places)
    columns = [F.col(f"{n}.body").alias(n) for n in names]
    if "dates" in kinds:
        second, plain = F.col("due_2"), F.col("plain_1")
        invoice = F.when(second.isNull() | (plain["at"] < second["at"]), plain).otherwise(second)
        columns += [
            invoice["body"].withField("field", F.lit("invoice_date")).alias("invoice_date"),
            F.col("due_1.body").alias("due_date"),
        ]
    return per_document.select("doc_id", *columns)


def as_rows(wide: DataFrame) -> DataFrame:
    """Struct columns of a wide frame -> one row per document and found field."""
    found = F.array_compact(F.array(*[F.col(c) for c in wide.columns if c in FOUND_FIELDS]))
    return wide.select("doc_id", F.inline(found))


def find_fields(blocks: DataFrame, wide: DataFrame = None) -> DataFrame:
    """All fields of all documents, one row each."""
    return as_rows(find_all_wide(blocks) if wide is None else wide)


def find_all_wide(blocks: DataFrame) -> DataFrame:
    return find_wide(blocks).join(find_currency(blocks), "doc_id", "full_outer")


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """Document type and language per document from its blocks.

    Keywords are looked up block by block and united as a set that cannot outgrow
    the list of keywords; the text is never put together.
    """
    per_document = (
        blocks.select("doc_id", F.explode_outer(keywords_in(F.col("text"))).alias("word"))
        .groupBy("doc_id")
        .agg(F.collect_set("word").alias("found"))
        .select(
            "doc_id",
            keyword_numbers(F.col("found"), fixed.DOCUMENT_TYPE_WORDS).alias("types"),
            keyword_numbers(F.col("found"), fixed.LANGUAGE_WORDS).alias("languages"),
        )
    )
    return per_document.select(
        "doc_id",
        document_type(F.col("types")).alias("kind"),
        language(F.col("languages")).alias("tongue"),
    ).select(
        "doc_id", "kind.doc_type", F.col("kind.confidence").alias("doc_type_confidence"),
        "kind.keywords", "tongue.language",
        F.col("tongue.confidence").alias("language_confidence"),
    )


def header(classified: DataFrame, wide: DataFrame) -> DataFrame:
    """The wide invoice row: type, language, country and the typed field values."""

    def text(field):
        return F.col(f"{field}.value.value").alias(field)

    def day(field):
        return values.iso_to_date(F.col(f"{field}.value.iso")).alias(field)

    def number(field):
        return F.col(f"{field}.value.numeric").cast("decimal(18,4)").alias(field)

    return classified.join(wide, "doc_id", "left").select(
        "doc_id", "doc_type", "language",
        values.vat_country(F.col("supplier_vat.value.value")).alias("country"),
        text("invoice_number"), day("invoice_date"), day("due_date"), text("supplier_name"),
        text("supplier_vat"), text("currency"), number("subtotal"), number("total_vat"),
        number("total"), text("iban"),
    )

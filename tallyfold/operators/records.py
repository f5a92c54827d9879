"""Jobs over stored invoices, fields, corrections and events: master data, quality, usage, upkeep."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import comparison_key, compact_code
from .groups import attach, previous


def supplier_master(sheets: DataFrame) -> DataFrame:
    """One supplier per tenant and normalised name, as its first invoice has it.

    Sheets: ``invoice_id, org_id, supplier_name, supplier_vat, iban``.
    """
    first = F.min_by(F.struct("supplier_name", "supplier_vat", "iban"), "invoice_id")
    return (
        sheets.where(F.col("supplier_name").isNotNull())
        .groupBy("org_id", comparison_key(F.col("supplier_name")).alias("normalized_name"))
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n_invoices"))
        .select("org_id", "normalized_name", "first.*", "n_invoices")
    )


def newest_corrections(corrections: DataFrame) -> DataFrame:
    """The last new value per invoice and field; a maximum that combines before the shuffle."""
    newest = F.max_by("new_value", F.struct("created_at", "correction_id"))
    return corrections.groupBy("invoice_id", "field").agg(newest.alias("new_value"))


def with_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Fields with the last ``new_value`` a user gave, if any.

    The few corrections of an invoice come as one row, so that fields lying together by invoice stay where they are.
    """
    given = newest_corrections(corrections).where("field IS NOT NULL AND new_value IS NOT NULL")
    entries = F.collect_list(F.struct("field", "new_value"))
    by_invoice = given.groupBy("invoice_id").agg(F.map_from_entries(entries).alias("_given"))
    return fields.join(by_invoice, "invoice_id", "left").withColumn(
        "new_value", F.try_element_at("_given", F.col("field"))).drop("_given")


def apply_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Fields with corrected values: certain, by the user, to be validated again."""
    joined = with_corrections(fields, corrections)
    fixed = F.col("new_value").isNotNull()
    value = F.col("value").withField("value", F.coalesce("new_value", "value.value"))
    return joined.withColumns({
        "value": F.when(fixed, value).otherwise(F.col("value")),
        "method": F.when(fixed, "user").otherwise(F.col("method")),
        "confidence": F.when(fixed, 1.0).otherwise(F.col("confidence")),
        "validator_status": F.when(~fixed, F.col("validator_status")),
    }).drop("new_value")


def supplier_profile(sheets: DataFrame, corrections: DataFrame) -> DataFrame:
    """Invoices, total and share of invoices without corrections per tenant and supplier."""
    corrected = corrections.select("invoice_id").distinct().withColumn("_fixed", F.lit(1))
    return (
        sheets.join(corrected, "invoice_id", "left")
        .groupBy("org_id", comparison_key(F.col("supplier_name")).alias("normalized_name"))
        .agg(F.count(F.lit(1)).alias("n_invoices"), F.sum("total_cents").alias("total_cents"),
             (1 - F.count("_fixed") / F.count(F.lit(1))).alias("accuracy"))
    )


def usage(events: DataFrame, day: Column) -> DataFrame:
    """Events and tokens per tenant, day and stage, with subtotals."""
    return events.rollup("org_id", day.alias("day"), "stage").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")
    )


def usage_breakdown(pages: DataFrame, day: Column) -> DataFrame:
    """Invoices, pages and about how many suppliers per tenant, by every combination of day, supplier and source.

    Pages: ``org_id, supplier, source, invoice_id, page_no``, in whatever number of rows a page. The
    distinct counts are exact; ``suppliers`` comes from sketches that Spark merges level by level.
    """
    once = pages.select("org_id", day.alias("day"), "supplier", "source", "invoice_id", "page_no").distinct()
    whole = once.groupBy("org_id", "day", "supplier", "source", "invoice_id").agg(F.count(F.lit(1)).alias("_pages"))
    found = whole.where("org_id IS NOT NULL").cube("org_id", "day", "supplier", "source").agg(
        F.grouping("org_id").alias("_all"), F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("invoices"),
        F.sum("_pages").alias("pages"), F.hll_sketch_estimate(F.hll_sketch_agg("supplier")).alias("suppliers"))
    return found.where("_all = 0").drop("_all")


def quota(pages: DataFrame, plans: DataFrame) -> DataFrame:
    """Distinct pages used per tenant and month against the plan; no plan, no limit.

    Pages: ``org_id, month, invoice_id, page_no``; a page read twice counts once.
    """
    once = pages.select("org_id", "month", "invoice_id", "page_no").distinct()
    used = once.groupBy("org_id", "month").agg(F.count(F.lit(1)).alias("used"))
    return used.join(plans.select("org_id", "pages_month"), "org_id", "left").withColumn(
        "over", F.coalesce(F.col("used") > F.col("pages_month"), F.lit(False))
    )


def _rows(frame: DataFrame, key: str, rules: dict) -> DataFrame:
    """One row per evaluated rule: (when due, ok)."""
    found = F.array_compact(F.array(*[
        F.when(due, F.struct(F.lit(name).alias("check_name"), F.when(ok, "pass").otherwise("warn").alias("status")))
        for name, (due, ok) in rules.items()
    ]))
    return frame.select(key, F.inline(found))


def sanity_checks(sheets: DataFrame, currencies: tuple, days_ahead: int = 14, years: int = 10) -> DataFrame:
    """Dates in a sound range and order, a known currency.

    Sheets: ``invoice_id, invoice_date, due_date, currency`` and ``today``, the day of processing.
    """
    day, due, today = F.col("invoice_date"), F.col("due_date"), F.col("today")
    return _rows(sheets, "invoice_id", {
        "date_not_ahead": (day.isNotNull(), day <= F.date_add(today, days_ahead)),
        "date_in_range": (day.isNotNull(), F.abs(F.datediff(day, today)) <= 365 * years),
        "due_after_date": (day.isNotNull() & due.isNotNull(), due >= day),
        "currency_known": (F.col("currency").isNotNull(), F.upper("currency").isin(*currencies)),
    })


def bank_checks(suppliers: DataFrame) -> DataFrame:
    """The account's country is the tax identifier's; a bank code has its form."""
    iban, vat = compact_code(F.col("iban")), compact_code(F.col("vat"))
    return _rows(suppliers, "supplier_id", {
        "iban_country": (iban.isNotNull() & vat.isNotNull(), F.substring(iban, 1, 2) == F.substring(vat, 1, 2)),
        "bic_form": (F.col("bic").isNotNull(), F.col("bic").rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$")),
    })


def missing_fields(sheets: DataFrame, rules: DataFrame) -> DataFrame:
    """Fields that an invoice's country asks for and the invoice lacks.

    Rules: ``country, field``, a few per country.  Sheets: ``invoice_id, country`` and ``given``,
    the names of the fields it has.
    """
    wanted = rules.groupBy("country").agg(F.array_sort(F.collect_set("field")).alias("wanted"))
    return attach(sheets, wanted, ["country"]).select(
        "invoice_id", F.explode(F.array_except("wanted", "given")).alias("field"))


def odd_rates(lines: DataFrame, countries: DataFrame, allowed: dict) -> DataFrame:
    """Lines per invoice whose tax rate the country does not know.

    Countries: ``invoice_id, country``; countries that are not listed allow every rate.
    """
    rates = F.create_map(*[x for c, r in allowed.items() for x in (
        F.lit(c), F.array(*[F.lit(v).cast("decimal(8,4)") for v in r]))])
    known = F.try_element_at(rates, F.col("country"))
    odd = F.coalesce(~F.array_contains(known, F.col("vat_rate")), F.lit(False))
    return lines.join(countries, "invoice_id").where(odd).groupBy("invoice_id", "country").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("vat_rate").cast("double").alias("least_rate"))


def number_shape(number: Column) -> Column:
    """Digits as 9, letters as A, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(number, "[0-9]+", "9"), "[A-Za-z]+", "A")


def odd_numbers(sheets: DataFrame, rare: float = 0.2, least: int = 5) -> DataFrame:
    """Invoices whose number has a shape that is rare with their supplier."""
    keys = ["org_id", "normalized_name"]
    shaped = sheets.select(
        "invoice_id", "org_id", comparison_key(F.col("supplier_name")).alias("normalized_name"),
        number_shape(F.col("invoice_number")).alias("shape"))
    shapes = shaped.groupBy(*keys, "shape").agg(F.count(F.lit(1)).alias("n"))
    totals = shapes.groupBy(*keys).agg(F.sum("n").alias("total"))
    odd = shapes.join(totals, keys).where((F.col("total") >= least) & (F.col("n") < rare * F.col("total")))
    return shaped.join(odd, [*keys, "shape"]).select("invoice_id", "shape", "n", "total")


def payment_terms(sheets: DataFrame, days: int = 30, tolerance: int = 3) -> DataFrame:
    """Days from invoice to due date, and whether they fit the agreed term."""
    apart = F.datediff("due_date", "invoice_date")
    return sheets.where(apart.isNotNull()).select(
        "invoice_id", apart.alias("days"), (F.abs(apart - days) <= tolerance).alias("fits"))


def duplicate_candidates(sheets: DataFrame) -> DataFrame:
    """Invoices that share supplier and number, or supplier, day and total, with an earlier one.

    Each names the first of its group, so a group of n gives n - 1 rows and never pairs.
    """
    name = comparison_key(F.col("supplier_name"))
    base = sheets.select("invoice_id", "org_id", name.alias("name"), "invoice_number", "invoice_date", "total_cents")
    keys = {"number": ["org_id", "name", "invoice_number"], "total": ["org_id", "name", "invoice_date", "total_cents"]}
    found = []
    for rule, own in keys.items():
        whole = base.dropna(subset=own)
        first = whole.groupBy(*own).agg(F.min("invoice_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(attach(whole, first, own).where("invoice_id > first_id").select(
            "invoice_id", F.lit(rule).alias("rule"), "first_id"))
    return found[0].unionByName(found[1])


def evaluation(expected: DataFrame, got: DataFrame, extra: tuple = ()) -> DataFrame:
    """Precision, recall and F1 per field (and extra columns of expected), counted once over all rows."""
    joined = expected.select("invoice_id", "field", *extra, F.col("value").alias("e")).join(
        got.select("invoice_id", "field", F.col("value").alias("g")), ["invoice_id", "field"], "full")
    hit, both = F.col("e") == F.col("g"), F.col("e").isNotNull() & F.col("g").isNotNull()
    sums = joined.groupBy("field", *extra).agg(
        F.count(F.when(hit, 1)).alias("tp"),
        F.count(F.when(F.col("g").isNotNull() & ~(both & hit), 1)).alias("fp"),
        F.count(F.when(F.col("e").isNotNull() & ~(both & hit), 1)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({
        "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)})


def seeded_errors(invoices: DataFrame, every: int = 10) -> DataFrame:
    """Invoices with known mistakes, one kind each: total, vat or subtotal off by one."""
    turn = F.pmod("invoice_id", F.lit(every))
    kind = F.when(turn == 0, "total").when(turn == 1, "total_vat").when(turn == 2, "subtotal")
    return invoices.withColumn("seeded", kind).withColumns({
        c: F.when(F.col("seeded") == c, F.col(c) + 1).otherwise(F.col(c)).cast("decimal(18,4)")
        for c in ("total", "total_vat", "subtotal")})


def error_recall(seeded: DataFrame, checks: DataFrame) -> DataFrame:
    """Share of the seeded mistakes of each kind that some check failed."""
    failed = checks.where("status = 'fail'").select("invoice_id").distinct().withColumn("_caught", F.lit(1))
    return seeded.where("seeded IS NOT NULL").join(failed, "invoice_id", "left").groupBy("seeded").agg(
        F.count(F.lit(1)).alias("n"), F.count("_caught").alias("caught"))


def confidence_histogram(fields: DataFrame, bins: int = 10) -> DataFrame:
    """Fields per method and tenth of confidence; a confidence of 1 belongs to the last."""
    tenth = F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)).cast("int")
    return fields.groupBy("method", tenth.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def best_examples(fields: DataFrame, keys: list, k: int = 3) -> DataFrame:
    """The k surest fields of each group; the rank limit holds before the shuffle, too."""
    best = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "invoice_id")
    return fields.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def outbox(deliveries: DataFrame, minutes: tuple = (1, 10, 60)) -> DataFrame:
    """When a failed delivery is due again; after the last interval it is dead.

    Deliveries: ``event_id, attempts, last_at, delivered``.
    """
    waits = F.array(*[F.lit(m) for m in minutes])
    wait = F.get(waits, F.col("attempts") - 1)
    state = (F.when(F.col("delivered"), "delivered").when(F.col("attempts") == 0, "due")
             .when(wait.isNull(), "dead").otherwise("waiting"))
    due = F.when(state == "waiting", F.col("last_at") + F.make_dt_interval(mins=wait))
    return deliveries.select("event_id", "attempts", state.alias("state"), due.alias("due_at"))


def page_after(invoices: DataFrame, cursor_day: str, cursor_id: int, limit: int = 50) -> DataFrame:
    """The invoices of every tenant that follow a cursor, newest first."""
    day, own = F.col("created_on"), F.col("invoice_id")
    follows = (day < F.lit(cursor_day).cast("date")) | ((day == F.lit(cursor_day).cast("date")) & (own < cursor_id))
    order = Window.partitionBy("org_id").orderBy(day.desc(), own.desc())
    return invoices.where(follows & ~F.col("deleted")).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= limit)


def expired(invoices: DataFrame, today: str, days: int) -> DataFrame:
    """Audit rows of the invoices that are older than the policy."""
    return invoices.where(F.col("created_on") < F.date_sub(F.lit(today).cast("date"), days)).select(
        "org_id", F.col("invoice_id").cast("string").alias("resource_id"), F.lit("invoice.expired").alias("action"))


def masked(sheets: DataFrame) -> DataFrame:
    """Personal fields hidden: of an account the ends stay, of a name the first letter."""
    iban = F.concat(F.substring("iban", 1, 4), F.lit("****"), F.right(F.col("iban"), F.lit(2)))
    return sheets.withColumns({
        "iban": iban, "supplier_name": F.concat(F.substring("supplier_name", 1, 1), F.lit("***"))})


def reusable(files: DataFrame, results: DataFrame, version: str) -> DataFrame:
    """Files and their tenant's earlier result of the same bytes by the same model, where there is one.

    Results never cross tenants, however equal the bytes.
    """
    own = ["org_id", "sha256"]
    newest = results.where(F.col("model") == version).groupBy(*own).agg(F.max("result_id").alias("result_id"))
    return attach(files, newest, own)


def account_changes(sheets: DataFrame) -> DataFrame:
    """How often the account of a tenant's supplier changed from one invoice to the next."""
    keys = ["org_id", "normalized_name"]
    line = Window.partitionBy(*keys).orderBy("created_on", "invoice_id")
    own = sheets.where(F.col("iban").isNotNull()).withColumn(
        "normalized_name", comparison_key(F.col("supplier_name")))
    return own.withColumn("before", F.lag("iban").over(line)).groupBy(*keys).agg(
        F.count(F.when(F.col("before") != F.col("iban"), 1)).alias("changes"),
        F.count(F.lit(1)).alias("n_invoices"))


def account_velocity(sheets: DataFrame, days: int = 90) -> DataFrame:
    """Per tenant's supplier and day with a change of account: changes that day and within the last ``days``.

    A supplier with very many invoices is followed in pieces; only its days meet, one row each.
    """
    keys = ["org_id", "normalized_name"]
    own = sheets.where(F.col("iban").isNotNull() & F.col("created_on").isNotNull()).select(
        "org_id", comparison_key(F.col("supplier_name")).alias("normalized_name"), "invoice_id", "iban",
        F.unix_date("created_on").cast("long").alias("_day"))
    followed = previous(own, keys, ["_day", "invoice_id"], "_day", F.col("iban"), "_before")
    daily = followed.groupBy(*keys, "_day").agg(F.count(F.when(F.col("_before") != F.col("iban"), 1)).alias("changes"))
    back = Window.partitionBy(*keys).orderBy("_day").rangeBetween(1 - days, 0)
    return daily.withColumn("recent", F.sum("changes").over(back)).where("changes > 0").select(
        *keys, F.date_from_unix_date(F.col("_day").cast("int")).alias("day"), "changes", "recent")


def audit_view(events: DataFrame, action: str = None, since: str = None) -> DataFrame:
    """Audit rows of an action and after a day, newest first within the tenant."""
    kept = events
    if action:
        kept = kept.where(F.col("action") == action)
    if since:
        kept = kept.where(F.col("at") >= F.lit(since).cast("timestamp"))
    return kept

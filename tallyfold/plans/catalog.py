"""The registered queries: each runs operators over whole driver tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import kinds, values
from ..operators import answers, checks, fields, lines, scoring, search, state
from ..operators.groups import stored
from ..session import shared_folder
from ..sinks import export
from ..sources import files, pages
from ..streaming import arrivals
from . import bindings as b

QUERIES = {}


def query(function):
    """Register a function of the views as a query of (session, folder)."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(b.Views(spark, folder))

    QUERIES[function.__name__] = run
    return function


def _amounts_shown(frame: DataFrame) -> DataFrame:
    return frame.select(
        "invoice_id", "check_name", "status", "severity", "reason",
        *[F.col("evidence")[k].cast("double").alias(k) for k in ("expected", "actual")],
    )


def _plain(frame: DataFrame) -> DataFrame:
    return frame.select("invoice_id", "check_name", "status", "severity", "reason")


# --- checks -----------------------------------------------------------------


@query
def reconcile_totals(v):
    return _amounts_shown(checks.total_checks(
        v["v_totals"], v.lines(),
        names=("subtotal", "vat_total", "grand_total"),
    ))


@query
def line_gross_check(v):
    return _amounts_shown(checks.line_gross_checks(v.lines(numbered=True)))


@query
def zero_rated_check(v):
    return _plain(checks.total_checks(
        v["v_totals"], v.lines(), names=("reverse_charge",)
    ))


def _supplier_codes(v):
    return v["v_suppliers"].select(
        F.col("supplier_id").alias("invoice_id"), "iban", F.col("vat").alias("supplier_vat")
    )


def _codes_shown(frame, name, details):
    return frame.where(F.col("check_name") == name).select(
        F.col("invoice_id").alias("supplier_id"), "status", "severity", "reason",
        *[F.col("evidence")[d].alias(d) for d in details],
    )


@query
def iban_check(v):
    found = checks.code_checks(_supplier_codes(v), only_present=False)
    return _codes_shown(found, "iban", ("country", "expected", "actual", "mod97"))


@query
def vat_check(v):
    found = checks.code_checks(_supplier_codes(v), only_present=False)
    return _codes_shown(found, "vat_format", ("country", "value"))


def _all_checks(v, only_present):
    return checks.all_checks(
        v["v_checked"], v.lines(numbered=True), only_present
    )


@query
def checks_all(v):
    return _plain(_all_checks(v, only_present=False))


@query
def checks_present_only(v):
    return _plain(_all_checks(v, only_present=True))


@query
def new_checks_only(v):
    # The checks are read as found and as stored; as a table they are worked out once.
    found = stored(_plain(_all_checks(v, only_present=True)), "checks")
    return checks.not_stored_yet(found, found.where(F.col("invoice_id") % 2 == 0))


def _deciding_checks(v):
    """The checks some field depends on; line checks decide about no field."""
    invoices = v["v_checked"]
    return checks.total_checks(
        invoices, v.lines(), names=("subtotal", "vat_total", "grand_total")
    ).unionByName(checks.code_checks(invoices, only_present=True))


@query
def apply_check_status(v):
    judged = checks.apply_to_fields(v.stored_fields(), _deciding_checks(v))
    return judged.select(
        "invoice_id", "field", "validator_status", F.col("validator_detail")["rule"].alias("rule")
    )


# --- confidence and status --------------------------------------------------


def _scored(v):
    judged = checks.apply_to_fields(v.stored_fields().drop("org_id"), _deciding_checks(v))
    sheets = v.blocks()
    invoices = v["v_invoices"]
    return invoices, scoring.score_fields(
        judged, scoring.reading_confidence(sheets), invoices, v["v_orgs"]
    )


@query
def field_confidence(v):
    _, scored = _scored(v)
    return scored.select("invoice_id", "field", "validator_status", "confidence", "status")


@query
def document_gate(v):
    invoices, scored = _scored(v)
    return scoring.document_gate(invoices, scored)


@query
def finalize_status(v):
    final = scoring.finalize(v["v_invoices"])
    audit = state.audit_events(final)
    return audit.select("org_id", "actor_type", "action", "resource", "resource_id", "delta")


# --- stage events -----------------------------------------------------------


@query
def latest_stage(v):
    return state.newest_done(v["v_jobs"]).select(
        "invoice_id", "stage", "job_id", "payload"
    )


@query
def skip_failed(v):
    return state.runnable(v["v_invoices"]).select("invoice_id", "status")


@query
def append_stage(v):
    invoices = v["v_invoices"].withColumn("total_conf", F.lit(0.9))
    claimed = state.with_status(
        invoices,
        F.when(F.col("status") == "queued", "processing").otherwise(F.col("status")),
    )
    error = F.when(F.col("status") == "failed", "OCR_NO_TEXT")
    events = state.stage_events(
        claimed.withColumn("created_at", F.col("created_on").cast("timestamp")), "ingest", error,
        F.to_json(F.struct("status", "total_conf"))
    )
    return events.drop("job_id", "created_at")


@query
def append_then_latest(v):
    """Events of two runs of a stage, appended; the newest of each invoice is read back."""
    invoices = v["v_invoices"].withColumn("total_conf", F.lit(0.9))
    error = F.when(F.col("status") == "failed", "OCR_NO_TEXT")
    payload = F.to_json(F.struct("status", F.col("created_at").cast("date").alias("day")))
    first = invoices.withColumn("created_at", F.col("created_on").cast("timestamp"))
    again = first.where(F.col("org_id") % 2 == 0).withColumn(
        "created_at", F.col("created_at") + F.expr("INTERVAL 3 DAYS"))
    events = state.stage_events(first, "ingest", error, payload).unionByName(
        state.stage_events(again, "ingest", error, payload))
    return state.newest_done(events).select("invoice_id", "stage", "payload")


# --- listing ----------------------------------------------------------------


@query
def invoice_list(v):
    """Ranked first: totals and fields are looked up for the listed invoices only."""
    listed = search.newest_invoices(v["v_invoices"])
    shown = v["v_field_sheet"].select("invoice_id", "supplier_name", "invoice_number", "invoice_date")
    return listed.join(v["v_totals"].select("invoice_id", "total"), "invoice_id", "left").join(
        shown, "invoice_id", "left"
    ).select(
        "org_id", "invoice_id", "filename", "status", F.col("total").cast("double").alias("total"),
        F.col("created_on").cast("string").alias("created_on"),
        "supplier_name", "invoice_number", "invoice_date",
    )


@query
def org_lookup(v):
    return search.tenant(v["v_orgs"], 7).select(
        "org_id", "name", "residency", F.col("threshold").cast("double").alias("threshold")
    )


# --- values and fields ------------------------------------------------------


@query
def amounts(v):
    hits = values.amounts_in(F.col("text"))
    return v.blocks().select("doc_id", "block_no", F.posexplode(hits).alias("no", "hit")).select(
        "doc_id", "block_no", "no", "hit.raw", "hit.value"
    )


@query
def dates(v):
    hits = values.dates_in(F.col("text"))
    return v.blocks().select("doc_id", "block_no", F.posexplode(hits).alias("no", "hit")).select(
        "doc_id", "block_no", "no", "hit.raw", F.col("hit.day").cast("string").alias("day")
    )


@query
def text_keys(v):
    return v["documents"].select(
        "doc_id", F.md5(values.collapse(F.col("text"))).alias("collapsed"),
        F.md5(values.comparison_key(F.col("text"))).alias("key"),
    )


def _values_shown(frame, *names):
    columns = []
    for name in names:
        columns += [
            F.col(name)["value"]["value"].alias(name),
            F.col(name)["bbox"]["y0"].alias(f"{name}_top"),
        ]
    return frame.select("doc_id", *columns)


@query
def find_identifiers(v):
    return _values_shown(
        fields.find_wide(v.blocks(), ("vat", "iban", "number")),
        "supplier_vat", "iban", "invoice_number",
    )


@query
def find_dates(v):
    return _values_shown(fields.find_wide(v.blocks(), ("dates",)), "invoice_date", "due_date")


@query
def find_currency(v):
    return fields.find_currency(v.blocks()).select(
        "doc_id", F.col("currency.value.value").alias("currency"),
        F.col("currency.source_text").alias("source_text"),
    )


@query
def find_money(v):
    found = fields.find_wide(v.blocks(), ("money",))
    return found.select("doc_id", *[
        F.col(n)["value"]["numeric"].alias(n) for n in ("subtotal", "total_vat", "total")
    ])


@query
def find_supplier(v):
    return _values_shown(fields.find_wide(v.blocks(), ("supplier",)), "supplier_name")


@query
def header_wide(v):
    sheets = v.blocks()
    found = fields.header(fields.classify_blocks(sheets), fields.find_all_wide(sheets))
    return found.select(*[
        F.col(c).cast("string").alias(c) if t == "date" else
        F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c)
        for c, t in found.dtypes
    ])


@query
def field_rows(v):
    found = fields.find_fields(v.blocks())
    return found.select(
        "doc_id", "field", "value.type", "value.value", "value.numeric", "value.iso",
        "confidence", "method", "source_text", F.col("bbox.page").alias("page"),
    )


@query
def doc_type(v):
    words = (fixed.DOCUMENT_TYPE_WORDS,)
    hits = kinds.keyword_numbers(kinds.keywords_in(F.col("text"), words), *words, words)
    found = v["documents"].select("doc_id", hits.alias("hits")).select(
        "doc_id", kinds.document_type(F.col("hits")).alias("k")
    )
    return found.select(
        "doc_id", "k.doc_type", "k.confidence", F.array_join("k.keywords", ",").alias("keywords")
    )


@query
def language(v):
    words = (fixed.LANGUAGE_WORDS,)
    hits = kinds.keyword_numbers(kinds.keywords_in(F.col("text"), words), *words, words)
    return v["documents"].select("doc_id", hits.alias("hits")).select(
        "doc_id", kinds.language(F.col("hits")).alias("k")
    ).select("doc_id", "k.language", F.bround("k.confidence", 4).alias("confidence"))


@query
def field_types(v):
    wanted = v["v_requests"]
    kind = kinds.requested_type(F.col("name"), F.col("description"), F.col("given"))
    return wanted.select("request_id", "name", kind.alias("field_type")).select(
        "*", kinds.json_type(F.col("field_type")).alias("json_type"),
        F.when(F.col("field_type") == "date", "date").alias("format"),
    )


# --- line items -------------------------------------------------------------

LINE_COLUMNS = (
    "doc_id", "position", "description", "quantity", "unit_price", "net", "vat_rate",
    "vat_amount", "gross", "confidence",
)


def _line_items(v):
    together = v.spread_out()
    return lines.line_items(v.cells(together), together)


@query
def line_items(v):
    return _line_items(v).select(*LINE_COLUMNS)


# --- model answers ----------------------------------------------------------


@query
def parse_answers(v):
    parsed = answers.parse_answers(v["v_answers"])
    accepted = answers.accept(parsed)
    outcome = accepted.select(
        "doc_id", "attempt", "answer.doc_type", "answer.language", "answer.country",
        F.col("answer.fields")["total"]["value"].alias("total"),
        F.size("answer.line_items").alias("n_lines"),
    )
    empty = [F.lit(None).cast(t).alias(c) for c, t in outcome.dtypes[1:]]
    return outcome.unionByName(answers.rejected(parsed, accepted).select("doc_id", *empty))


def _accepted(v):
    return answers.accept(answers.parse_answers(v["v_answers"]))


@query
def answer_candidates(v):
    sheets = v.printed_once().blocks()
    found = answers.model_candidates(stored(_accepted(v), "accepted"), sheets)
    return found.select(
        "doc_id", "field", "value.type", "value.value", "value.numeric", "value.iso",
        "confidence", F.col("bbox.y0").alias("top"),
    )


@query
def answer_lines(v):
    """The model's lines where a document's tables have none."""
    model = answers.model_line_items(_accepted(v))
    own = stored(_line_items(v).select(*LINE_COLUMNS), "items")
    return answers.lines_or_model(own, model).select(*LINE_COLUMNS)


@query
def override_header(v):
    sheets = v.printed_once().blocks()
    vat = fields.find_wide(sheets, ("vat",)).select(
        "doc_id", values.vat_country(F.col("supplier_vat.value.value")).alias("country")
    )
    header = fields.classify_blocks(sheets).select("doc_id", "doc_type", "language").join(
        vat, "doc_id", "left"
    )
    return answers.override_header(header, _accepted(v))


@query
def merge_candidates(v):
    sheets = v.printed_once().blocks()
    merged = answers.merge_candidates(
        fields.find_fields(sheets), answers.model_candidates(stored(_accepted(v), "accepted"), sheets)
    )
    return merged.select(
        "doc_id", "field", "value.value", "value.numeric", "confidence", "method",
        "validator_status", F.col("validator_detail")["rule"].alias("rule_value"),
        F.col("validator_detail")["llm"].alias("model_value"),
    )


@query
def route_cost(v):
    jobs = v["v_jobs"].join(v["v_orgs"].select("org_id", "residency"), "org_id").withColumn(
        "task", F.when(F.col("stage") == "extract", "extract")
        .when(F.col("stage") == "ingest", "vlm").otherwise("classify")
    )
    routed = jobs.withColumn(
        "route", answers.resolve_route(F.col("residency"), F.col("task"))
    ).groupBy("org_id", "route", F.to_date("created_at").cast("string").alias("day")).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls")
    )
    return routed.withColumn("cost", answers.cost(F.col("route"), F.col("tokens")))


@query
def document_text(v):
    every = v["v_invoices"].select(F.col("invoice_id").alias("doc_id"), F.explode(F.array(
        F.lit(0), F.when(F.col("invoice_id") % 4 == 0, 2))).alias("page_no")).where("page_no IS NOT NULL")
    return answers.document_text(v.blocks(together=True), v.cells(together=True), v.together(every)).select(
        "doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest")
    )


# --- files and pages --------------------------------------------------------


@query
def admit_route(v):
    taken = v["v_files"].withColumns({
        "size": F.octet_length("content").cast("bigint"), "sha256": F.sha2("content", 256)
    })
    # Files with little text between their tags stand for scans.
    shown = F.length(F.regexp_replace("content", "<[^>]*>", "")) >= b.PRINTED_LENGTH
    printed = taken.where(shown).select(F.col("file_id").alias("doc_id"))
    routed = files.route(files.admit(taken.drop("content")), printed)
    return routed.select(
        "file_id", "size", "sha256", "rejected", "route",
        files.object_key(F.col("org_id"), F.col("file_id"), F.col("filename")).alias("object_key"),
    )


@query
def dedupe_exact(v):
    uploads = v["documents"].select(
        F.col("doc_id").alias("file_id"), F.col("lang").alias("org_id"),
        F.sha2("text", 256).alias("sha256"), (F.col("doc_id") * 7919 % 1000).alias("created_at"),
    )
    return files.mark_copies(uploads).select("file_id", "org_id", "duplicate_of")


@query
def no_text(v):
    return state.without_text(
        v["documents"].select("doc_id"), v.readings().where(F.col("engine") == "paddleocr")
    )


@query
def words_to_lines(v):
    found = pages.words_to_lines(v.words())
    return found.select("page_id", "line_no", F.md5("text").alias("digest"), "x0", "y0", "x1", "y1")


@query
def ocr_lines(v):
    words = v.words().withColumns({
        "top": F.floor("top").cast("int"), "width": F.lit(50), "height": F.lit(10)
    })
    found = pages.scanned_words_to_lines(words)
    return found.select(
        "page_id", "reading_order", F.md5("text").alias("digest"),
        F.bround("conf", 6).alias("conf"), "x0", "y0", "x1", "y1",
    )


@query
def order_fragments(v):
    x, y = F.col("block_no") * 37 % 500 + 0.0, F.col("block_no") * 53 % 700 + 0.0
    corners = F.array(F.array(x, y), F.array(x + 90, y + 2), F.array(x + 88, y + 14),
                      F.array(x - 1, y + 12))
    fragments = v.readings().select(
        F.concat_ws("-", "doc_id", "engine").alias("page_id"), F.col("block_no").alias("fragment_no"), "text", "conf",
        F.when(F.col("block_no") % 13 != 5, corners).alias("points"),
        F.lit(600).alias("page_width"), F.lit(800).alias("page_height"),
    )
    found = pages.order_fragments(fragments)
    return found.select("page_id", "reading_order", F.md5("text").alias("digest"), "x0", "y0", "x1", "y1")


@query
def page_stats(v):
    every = v["documents"].select("doc_id", F.lit(0).alias("page_no"), F.explode(
        F.array(F.lit("paddleocr"), F.lit("tesseract"))).alias("engine"))
    found = pages.page_stats(v.readings(), ("engine",), every)
    return found.select(
        "doc_id", "page_no", "engine", F.md5("text").alias("digest"), "n_blocks",
        F.bround("avg_conf", 4).alias("avg_conf"),
    )


@query
def pick_engine(v):
    every = v["documents"].select("doc_id", F.lit(0).alias("page_no"))
    return pages.pick_engine(every, v.readings(), "paddleocr", "tesseract")


@query
def page_table(v):
    every = v["documents"].select(
        "doc_id", F.lit(0).alias("page_no"), F.lit(600).alias("width"),
        F.lit(800).alias("height"), (F.col("n_chars") >= 200).alias("text_layer"))
    readings = v.readings()
    picked = pages.pick_engine(every, readings, "paddleocr", "tesseract")
    return pages.page_table(every, readings, picked)


@query
def pages_projection(v):
    per_page = v.readings().select(
        "doc_id", "engine", F.floor(F.col("block_no") / 10).alias("page_no")
    ).distinct()
    return pages.document_summary(per_page)


# --- search and export ------------------------------------------------------

COUNTRIES = ("Germany", "France")


@query
def parse_search(v):
    found = search.parse_search(v["v_questions"], COUNTRIES, b.FIELD_NAMES)
    return found.withColumns({
        c: F.col(c).cast("string") for c in ("date_after", "date_before")
    })


@query
def search_fields(v):
    parsed = search.parse_search(v["v_saved_searches"], COUNTRIES, b.FIELD_NAMES)
    found = search.search_fields(v.stored_fields(), parsed)
    return found.select(
        "query_id", "rank", "invoice_id", "field", F.col("value.value").alias("value"),
        "confidence",
    )


def _export_fields(v):
    return v.stored_fields().withColumnRenamed("invoice_id", "doc_id")


def _documents(v):
    return v["v_invoices"].select(F.col("invoice_id").alias("doc_id"))


@query
def export_round_trip(v):
    """The wide table with quotes, blanks and line breaks in it, written as csv and read back."""
    table = export.wide_table(_documents(v), _export_fields(v), ["supplier_name", "total"])
    odd = F.concat(F.lit('  "'), "supplier_name", F.lit('",\n '), "total", F.lit(" "))
    folder = f"{shared_folder(v.spark, 'export')}/csv"
    export.export(table.withColumn("note", odd), "csv", folder)
    return export.read_csv(v.spark, folder).withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query
def export_wide(v):
    return export.wide_table(_documents(v), _export_fields(v), [
        "supplier_name", {"field": "invoice_number", "header": "number"}, "due_date", "iban",
        {"field": "total", "header": "amount"},
    ])


@query
def export_json(v):
    items = v.lines(numbered=True).select(
        F.col("invoice_id").alias("doc_id"), "position", "description", "quantity", "unit_price",
        F.lit(None).cast("double").alias("net"), "vat_rate",
        F.lit(None).cast("double").alias("vat_amount"), "gross",
    )
    return export.json_records(_documents(v), _export_fields(v), items)


# --- arriving data ----------------------------------------------------------


def _stream(v, name):
    """A table as it arrives, one file or a folder of files: a pattern may name either."""
    return v.spark.readStream.schema(v[name].schema).parquet(f"{v.folder}/{name}.parque[t]")


@query
def stream_stages(v):
    events = v.spark.sql(b.VIEWS["v_jobs"], events=_stream(v, "events"))
    store = shared_folder(v.spark, "stages")
    found = arrivals.newest_stages(events, f"{store}/updates", f"{store}/checkpoint")
    return found.select("invoice_id", "stage", "job_id", "payload")


@query
def stream_audit(v):
    orders = _stream(v, "orders")
    invoices = v.spark.sql(b.VIEWS["v_invoices"], orders=orders, customer=v["customer"])
    store = shared_folder(v.spark, "audit")
    return arrivals.append_audit(scoring.finalize(invoices), f"{store}/rows", f"{store}/checkpoint")


@query
def stream_new_files(v):
    arriving = _stream(v, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("lang").alias("org_id"),
        F.sha2("text", 256).alias("sha256"), (F.col("doc_id") * 7919 % 1000).alias("created_at"),
    )
    store = shared_folder(v.spark, "files")
    arrivals.accept_new_files(arriving, f"{store}/files", f"{store}/checkpoint")
    return v.spark.read.parquet(f"{store}/files").select("file_id", "org_id", "sha256")


@query
def stream_usage(v):
    """Events per tenant and day in append mode: days come out once the watermark has passed them."""
    events = v.spark.sql(b.VIEWS["v_jobs"], events=_stream(v, "events")).withColumn(
        "created_at", F.col("created_at").cast("timestamp"))
    store = shared_folder(v.spark, "usage")
    counted = arrivals.daily_usage(events)
    writer = counted.writeStream.outputMode("append").format("parquet").option("path", f"{store}/days")
    arrivals.run_to_end(writer, f"{store}/checkpoint")
    found = v.spark.read.schema(counted.schema).parquet(f"{store}/days")
    return found.withColumn("day", F.col("day").cast("date").cast("string"))

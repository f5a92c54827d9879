"""What follows from corrections: checks, scores and status of the corrected invoices, as a new version."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import answers, checks, pipeline, records, scoring
from .groups import stored
from .versions import KEY, Versions

_FIELD = ("invoice_id", "field", "value", "confidence", "method", "source_text", "validator_status", "validator_detail", "status")


def corrected(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Fields with each one's last correction, which is certain, the user's, and typed like a value that was read.

    A correction of a field that an invoice lacks adds it; a corrected value without text takes it away.
    """
    newest = records.newest_corrections(corrections.where(F.col("new_value").isNotNull()))
    joined = fields.select(*_FIELD).join(newest, [KEY, "field"], "full")
    fixed = F.col("new_value").isNotNull()
    typed = answers.typed_value(F.col("field"), F.col("new_value"))
    value = F.struct(*[typed[c].alias(c) for c in ("type", "value", "numeric", "iso")])
    return joined.withColumns({
        "value": F.when(fixed, value).otherwise(F.col("value")),
        "confidence": F.when(fixed, 1.0).otherwise(F.col("confidence")),
        "method": F.when(fixed, "user").otherwise(F.col("method")),
        "validator_status": F.when(~fixed, F.col("validator_status")),
        "validator_detail": F.when(~fixed, F.col("validator_detail")),
        "status": F.when(fixed, "edited").otherwise(F.col("status")),
    }).where(~fixed | (F.trim("new_value") != "")).select(*_FIELD)


def settle(store: Versions, invoices: DataFrame, fields: DataFrame, lines: DataFrame, orgs: DataFrame, version: int) -> None:
    """Writes checks, scores and status that follow from fields and lines, for all of ``invoices``.

    Invoices: ``invoice_id, org_id, status, reading``. The fields keep the confidence they were read
    with; scores are a table of their own.
    """
    of = store.write("fields", fields.select(*_FIELD), version)
    totals = invoices.select(KEY).join(pipeline._totals(of), KEY, "left")
    judged = store.write("checks", checks.all_checks(totals, lines, only_present=True), version)
    scored = scoring.score_fields(checks.apply_to_fields(of, judged), invoices.select(KEY, "reading"), invoices, orgs)
    scores = store.write("scores", scored.select(KEY, "field", "confidence", "threshold", "validator_status", "status"), version)
    gate = scoring.document_gate(invoices, scores)
    store.write("invoices", invoices.select(KEY, "org_id", "reading").join(gate, KEY), version)


def begin(store: Versions, invoices: DataFrame, fields: DataFrame, lines: DataFrame, orgs: DataFrame) -> None:
    """Version 0: all invoices as they were first processed. Lines never change and are kept once."""
    invoices = stored(invoices, "invoices")
    store.lay_out(invoices)
    settle(store, invoices, fields, store.write("lines", lines, 0), orgs, 0)
    store.commit(invoices.where("false"), 0)


def recompute(store: Versions, corrections: DataFrame, orgs: DataFrame, version: int) -> None:
    """The next version, of the invoices that have new corrections and of no others.

    Corrections: ``invoice_id, field, new_value, created_at, correction_id``, those since the last
    version. Corrections of unknown invoices and null ids change nothing; failed invoices stay failed.
    """
    corrections = corrections.where(F.col(KEY).isNotNull())
    asked = stored(corrections.select(KEY).distinct(), "asked")
    invoices = stored(store.newest("invoices", asked).select(KEY, "org_id", "status", "reading"), "invoices")
    known = corrections.join(invoices.select(KEY), KEY, "left_semi")
    fields = corrected(store.newest("fields", asked), known)
    lines = stored(store.rows("lines", asked).drop("_version"), "lines")
    settle(store, invoices, fields, lines, orgs, version)
    store.commit(store.rows("invoices").where(F.col("_version") == version), version)

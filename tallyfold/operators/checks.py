"""Deterministic checks: do the lines and totals of an invoice add up?

All amounts are exact decimals, rounded half up to cents.  Every evaluated rule
gives one row, passed ones included:
``invoice_id, check_name, status, severity, reason, evidence``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.values import finding, iban_finding, vat_finding
from .groups import index

CHECK_COLUMNS = ("invoice_id", "check_name", "status", "severity", "reason", "evidence")


def _or_zero(value: Column, kind: str = "decimal(18,4)") -> Column:
    return F.coalesce(value.cast(kind), F.lit(0).cast(kind))


def line_net(quantity: Column, unit_price: Column, discount_pct: Column) -> Column:
    """quantity x price x (1 - discount), in cents.

    Operands of usual size are narrowed first so that the product keeps its full
    scale and is rounded once; larger ones take the wide product.
    """
    q, p = _or_zero(quantity), _or_zero(unit_price)
    factor = F.lit(1) - _or_zero(discount_pct, "decimal(8,4)") * F.lit(0.01).cast("decimal(2,2)")
    narrow = (
        q.try_cast("decimal(12,4)") * p.try_cast("decimal(12,4)") * factor.try_cast("decimal(8,6)")
    )
    wide = F.try_multiply(F.try_multiply(q, p), factor)
    return F.coalesce(
        F.round(narrow, 2).cast("decimal(24,2)"), F.round(wide, 2).try_cast("decimal(24,2)")
    )


def line_vat(net: Column, vat_rate: Column) -> Column:
    share = net * _or_zero(vat_rate, "decimal(8,4)") * F.lit(0.01).cast("decimal(2,2)")
    return F.round(share, 2).cast("decimal(24,2)")


def line_amounts(lines: DataFrame) -> DataFrame:
    """Lines with the computed net, VAT and gross; the printed net plays no part."""
    net = line_net(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))
    return (
        lines.withColumn("line_net", net)
        .withColumn("line_vat", line_vat(F.col("line_net"), F.col("vat_rate")))
        .withColumn("line_gross", (F.col("line_net") + F.col("line_vat")).cast("decimal(25,2)"))
    )


def severity_of(status: Column) -> Column:
    return F.when(status == "pass", "info").when(status == "warn", "warning").otherwise("error")


def verdict(ok: Column, reason_ok: str, reason_not: str, evidence: Column) -> Column:
    status = F.when(ok, "pass").otherwise("fail")
    return finding(
        status, severity_of(status), F.when(ok, reason_ok).otherwise(reason_not), evidence
    )


def _evidence(**entries) -> Column:
    """MAP<STRING,STRING>; decimals are written as text without loss."""
    return F.create_map(
        *[part for k, v in entries.items() for part in (F.lit(k), v.cast("string"))]
    )


def line_gross_checks(lines: DataFrame) -> DataFrame:
    """One check per line with a printed gross, named by the line's place in the invoice."""
    placed = index(lines, ["invoice_id"], ["position"], "_place", along="position")
    judged = line_amounts(placed.where(F.col("gross").isNotNull()))
    ok = F.abs(F.col("line_gross") - F.col("gross")) <= F.lit(
        fixed.LINE_GROSS_TOLERANCE
    ).cast("decimal(3,2)")
    place = F.col("_place") - 1
    return judged.select(
        "invoice_id",
        F.concat(F.lit("line_gross_"), place).alias("check_name"),
        verdict(
            ok, "line_gross_ok", "line_gross_mismatch",
            _evidence(position=place, expected=F.col("line_gross"), actual=F.col("gross")),
        ).alias("f"),
    ).select("invoice_id", "check_name", "f.*")


def line_sums(lines: DataFrame) -> DataFrame:
    """Per invoice: sums of net and VAT, number of lines, whether all are zero-rated.

    Sums combine before the shuffle, so an invoice with very many lines sends
    one row per task.
    """
    rate = F.coalesce(F.col("vat_rate"), F.lit(0))
    return line_amounts(lines).groupBy("invoice_id").agg(
        F.sum("line_net").alias("sum_net"),
        F.sum("line_vat").alias("sum_vat"),
        F.count(F.lit(1)).alias("n_lines"),
        F.bool_and(rate == 0).alias("all_zero_rated"),
    )


def _within(a: Column, b: Column, tolerance: str) -> Column:
    return F.abs(a - b) <= F.lit(tolerance).cast("decimal(6,4)")


def total_findings(subtotal_tolerance: str = fixed.SUBTOTAL_TOLERANCE) -> dict:
    """name -> (evaluated when, finding) for one invoice joined with its line sums."""
    zero = F.lit(0).cast("decimal(18,4)")
    sum_net = F.coalesce(F.col("sum_net"), zero)
    sum_vat = F.coalesce(F.col("sum_vat"), zero)
    n_lines = F.coalesce(F.col("n_lines"), F.lit(0))
    all_zero = F.coalesce(F.col("all_zero_rated"), F.lit(True))
    subtotal, vat, total = F.col("subtotal"), F.col("total_vat"), F.col("total")
    parts = [F.coalesce(F.col(c), zero) for c in ("subtotal", "total_vat", "shipping", "other")]
    expected_total = parts[0] + parts[1] + parts[2] + parts[3]
    printed = F.to_json(
        F.struct(*[F.col(c).cast("string").alias(c)
                   for c in ("subtotal", "total_vat", "shipping", "other", "total")]),
        {"ignoreNullFields": "false"},
    )
    return {
        "subtotal": (
            subtotal.isNotNull(),
            verdict(_within(sum_net, subtotal, subtotal_tolerance), "subtotal_ok",
                    "subtotal_mismatch", _evidence(expected=sum_net, actual=subtotal)),
        ),
        "vat_total": (
            vat.isNotNull(),
            verdict(_within(sum_vat, vat, fixed.VAT_TOTAL_TOLERANCE), "vat_total_ok",
                    "vat_total_mismatch", _evidence(expected=sum_vat, actual=vat)),
        ),
        "grand_total": (
            total.isNotNull(),
            verdict(_within(expected_total, total, fixed.GRAND_TOTAL_TOLERANCE), "total_ok",
                    "total_mismatch",
                    _evidence(invoice=printed, lines=n_lines, expected=expected_total,
                              actual=total)),
        ),
        # An invoice without lines counts as zero-rated.
        "reverse_charge": (
            all_zero,
            verdict(F.coalesce(vat, zero) == 0, "vat_expected_zero", "vat_expected_zero",
                    _evidence(lines=n_lines, rates=F.lit("[0]"))),
        ),
    }


def _as_rows(joined: DataFrame, findings: dict) -> DataFrame:
    rows = F.array_compact(F.array(*[
        F.when(due, F.struct(F.lit(name).alias("check_name"), found.alias("f")))
        for name, (due, found) in findings.items()
    ]))
    return joined.select("invoice_id", F.inline(rows)).select("invoice_id", "check_name", "f.*")


def total_checks(
    invoices: DataFrame,
    lines: DataFrame,
    names: tuple = ("subtotal", "vat_total", "grand_total", "reverse_charge"),
    subtotal_tolerance: str = fixed.SUBTOTAL_TOLERANCE,
) -> DataFrame:
    """Checks of the invoice totals, one aggregation and one join for all of them."""
    joined = invoices.join(line_sums(lines), "invoice_id", "left")
    findings = total_findings(subtotal_tolerance)
    return _as_rows(joined, {n: findings[n] for n in names})


def code_checks(invoices: DataFrame, only_present: bool) -> DataFrame:
    """Account number and tax identifier; absent ones fail, or are left out."""
    iban, vat = F.col("iban"), F.col("supplier_vat")
    given = [(F.length(c) > 0) if only_present else F.lit(True) for c in (iban, vat)]
    return _as_rows(
        invoices, {"iban": (given[0], iban_finding(iban)), "vat_format": (given[1], vat_finding(vat))}
    )


def all_checks(invoices: DataFrame, lines: DataFrame, only_present: bool = False) -> DataFrame:
    """Every check of every invoice.

    ``invoices``: invoice_id, subtotal, total_vat, shipping, other, total, iban,
    supplier_vat.  ``only_present`` leaves out codes an invoice does not have,
    as document processing does.
    """
    return (
        line_gross_checks(lines)
        .unionByName(total_checks(invoices, lines))
        .unionByName(code_checks(invoices, only_present))
    )


def not_stored_yet(checks: DataFrame, stored: DataFrame) -> DataFrame:
    """Checks to append: an (invoice, check) already stored keeps its old result."""
    return checks.join(
        stored.select("invoice_id", "check_name"), ["invoice_id", "check_name"], "left_anti"
    )


def apply_to_fields(fields: DataFrame, checks: DataFrame) -> DataFrame:
    """Set validator status and detail of the fields some check decides about."""
    decides = F.create_map(*[F.lit(p) for kv in fixed.CHECK_OF_FIELD.items() for p in kv])
    deciding = checks.where(F.col("check_name").isin(*fixed.CHECK_OF_FIELD.values())).select(
        "invoice_id", F.col("check_name").alias("_check"), F.col("status").alias("_status"),
        F.col("reason").alias("_reason"), F.col("evidence").alias("_evidence"),
    )
    detail = F.map_concat(F.create_map(F.lit("rule"), F.col("_reason")), F.col("_evidence"))
    hit = F.col("_status").isNotNull()
    return (
        fields.withColumn("_check", F.try_element_at(decides, F.col("field")))
        .join(deciding, ["invoice_id", "_check"], "left")
        .withColumn("validator_status",
                    F.when(hit, F.col("_status")).otherwise(F.col("validator_status")))
        .withColumn("validator_detail",
                    F.when(hit, detail).otherwise(F.col("validator_detail")))
        .drop("_check", "_status", "_reason", "_evidence")
    )

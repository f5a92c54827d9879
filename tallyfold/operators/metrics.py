"""How the work goes: durations of stages, daily figures, evaluation reports and what got worse."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import attach, previous

#: Size of a quantile sketch, and the share of ranks by which its quantiles may be off (at 99 of 100).
SKETCH, RANK_ERROR = 400, 0.01


def stage_durations(events: DataFrame) -> DataFrame:
    """Ended stages with their seconds: ``invoice_id, stage, status, day, seconds``.

    Events: ``invoice_id, stage, status, created_at, job_id``. An end belongs to the start right before
    it in the same stage of the same invoice; an end without one has no duration and is left out.
    """
    timed = events.select("invoice_id", "stage", "status", "job_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("_at"))
    before = previous(timed, ["invoice_id", "stage"], ["_at", "job_id"], "_at", F.struct("status", F.col("_at").alias("at")), "_before")
    ended = before.where("status <> 'running' AND _before.status = 'running'")
    return ended.select(
        "invoice_id", "stage", "status", F.timestamp_micros("_at").cast("date").alias("day"),
        ((F.col("_at") - F.col("_before.at")) / F.lit(1_000_000)).alias("seconds"))


def duration_sketches(durations: DataFrame) -> DataFrame:
    """One mergeable sketch per day and stage, to be stored: ``day, stage, n, sketch``."""
    return durations.groupBy("day", "stage").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"kll_sketch_agg_double(seconds, {SKETCH})").alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: list, shares: dict) -> DataFrame:
    """Quantiles of any period from its days' sketches: the keys, n and one column per share asked for."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr("kll_merge_agg_double(sketch)").alias("_all"))
    return merged.select(*keys, "n", *[
        F.expr(f"kll_sketch_get_quantile_double(_all, {share}D)").alias(name) for name, share in shares.items()])


def rank_checked(durations: DataFrame, quantiles: DataFrame, keys: list, shares: dict) -> DataFrame:
    """Whether the exact rank of each estimated quantile lies within the sketch's error of its share."""
    met = attach(durations, quantiles.drop("n"), keys)
    counts = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[x for name in shares for x in (
        F.count(F.when(F.col("seconds") < F.col(name), 1)).alias(f"_{name}_below"),
        F.count(F.when(F.col("seconds") <= F.col(name), 1)).alias(f"_{name}_to"))])
    return counts.select(*keys, "n", *[
        ((F.col(f"_{name}_below") <= F.col("n") * (share + RANK_ERROR)) & (F.col(f"_{name}_to") >= F.col("n") * (share - RANK_ERROR)))
        .alias(f"{name}_close") for name, share in shares.items()])


def daily_metrics(invoices: DataFrame, fields: DataFrame, tokens: DataFrame, cost_per_1k: Column) -> DataFrame:
    """Per day of arrival: invoices, those straight through, fields by method, tokens and cost per invoice.

    Invoices: ``invoice_id, status, day``; fields: ``invoice_id, method``; tokens: ``invoice_id, tokens``.
    """
    methods = fields.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("_fields"), F.count(F.when(F.col("method") == "llm", 1)).alias("_llm"))
    spent = tokens.groupBy("invoice_id").agg(F.sum("tokens").alias("_tokens"))
    both = attach(attach(invoices, methods, ["invoice_id"]), spent, ["invoice_id"])
    n = F.col("n_invoices")
    return both.groupBy("day").agg(
        F.count(F.lit(1)).alias("n_invoices"), F.count(F.when(F.col("status") == "completed", 1)).alias("n_straight"),
        F.coalesce(F.sum("_fields"), F.lit(0)).alias("n_fields"), F.coalesce(F.sum("_llm"), F.lit(0)).alias("n_llm"),
        F.coalesce(F.sum("_tokens"), F.lit(0)).alias("tokens"),
    ).withColumns({
        "straight_rate": F.col("n_straight") / n, "llm_share": F.try_divide("n_llm", "n_fields"),
        "cost_per_invoice": F.col("tokens") * cost_per_1k / 1000 / n})


# --- evaluation -------------------------------------------------------------


def evaluation_report(expected: DataFrame, got: DataFrame, about: DataFrame, by: list) -> DataFrame:
    """Precision, recall, F1 and exact matches per field, over all invoices and by each attribute.

    About: ``invoice_id`` and the attributes ``by``. Every row counts once per grouping, in one pass:
    ``by`` names the grouping (empty: all), ``of`` its value.
    """
    e = expected.select("invoice_id", "field", F.col("value").alias("_e"))
    g = got.select("invoice_id", "field", F.col("value").alias("_g"))
    # What was told apart travels on to the attributes, the values do not.
    told = e.join(g, ["invoice_id", "field"], "full").select(
        "invoice_id", "field", F.col("_e").isNotNull().alias("_there"), F.col("_g").isNotNull().alias("_found"),
        F.coalesce(F.col("_e") == F.col("_g"), F.lit(False)).alias("_hit"))
    joined = attach(told, about, ["invoice_id"])
    there, found, hit = F.col("_there"), F.col("_found"), F.col("_hit")
    groupings = [[F.col("field")], *[[F.col("field"), F.col(c)] for c in by]]
    sums = joined.groupingSets(groupings, F.col("field"), *[F.col(c) for c in by]).agg(
        *[F.grouping(c).alias(f"_no_{c}") for c in by],
        F.count(F.when(hit, 1)).alias("tp"), F.count(F.when(found & ~hit, 1)).alias("fp"),
        F.count(F.when(there & ~hit, 1)).alias("fn"), F.count(F.when(there, 1)).alias("n"))
    name, value = F.lit(""), F.lit(None).cast("string")
    for c in by:
        grouped = F.col(f"_no_{c}") == 0
        name, value = F.when(grouped, c).otherwise(name), F.when(grouped, F.col(c).cast("string")).otherwise(value)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        name.alias("by"), value.alias("of"), "field", "tp", "fp", "fn",
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(tp, F.col("n")).alias("exact"))


def regressions(report: DataFrame, baseline: DataFrame, allowed: float = 0.005) -> DataFrame:
    """Rows of a stored baseline whose F1 has dropped by more than ``allowed``, or which are gone."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("by", "of", "field")]
    met = baseline.alias("b").join(report.alias("a"), same, "left")
    before, now = F.col("b.f1"), F.coalesce(F.col("a.f1"), F.lit(0.0))
    return met.where(before - now > allowed).select("b.by", "b.of", "b.field", before.alias("f1_before"), now.alias("f1_now"))

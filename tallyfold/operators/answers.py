"""Model answers as a table: parse, accept, ground in the blocks, merge with the rules.

Answers: ``doc_id, attempt, raw_text``.  Nothing here calls a model.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.values import collapse, comparison_key, envelope, let, parse_decimal, strip
from .fields import bbox, reading_order
from .groups import attach

ANSWER_SCHEMA = (
    "doc_type STRING, language STRING, country STRING, "
    "fields MAP<STRING, STRUCT<value: STRING, missing: BOOLEAN, source_text: STRING>>, "
    "line_items ARRAY<STRUCT<description: STRING, quantity: STRING, unit_price: STRING, "
    "net: STRING, vat_rate: STRING, vat_amount: STRING, gross: STRING, source_text: STRING>>, "
    "_broken STRING"
)
_READ = {"columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false"}
MERGE_PARTS = ("value", "confidence", "method", "source_text", "bbox")


def parse_answers(answers: DataFrame) -> DataFrame:
    """Answers with ``answer``, NULL where the text holds no valid answer.

    Code fences are stripped; when the rest does not parse, the outermost braces
    are tried.
    """
    def read(text):
        return F.when(text.startswith("{"), F.from_json(text, ANSWER_SCHEMA, _READ))

    def valid(parsed):
        return F.when(parsed["_broken"].isNull(), parsed)

    def whole_or_inner(body):
        inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
        return F.coalesce(let(read(body), valid), let(read(inner), valid))

    text = strip(F.col("raw_text"))
    fenced = F.regexp_extract(text, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    body = F.coalesce(F.nullif(fenced, F.lit("")), text)
    return answers.select("doc_id", "attempt", let(body, whole_or_inner).alias("answer"))


def accept(parsed: DataFrame) -> DataFrame:
    """First valid answer per document; one retry at most."""
    turn = F.when(F.col("answer").isNotNull(), F.col("attempt"))
    return (
        parsed.where(F.col("attempt") <= fixed.MOST_ATTEMPTS)
        .groupBy("doc_id")
        .agg(F.min_by("answer", turn).alias("answer"), F.min(turn).alias("attempt"))
        .where(F.col("attempt").isNotNull())
    )


def rejected(parsed: DataFrame, accepted: DataFrame) -> DataFrame:
    """Documents none of whose attempts gave a valid answer."""
    return parsed.select("doc_id").distinct().join(accepted, "doc_id", "left_anti")


def typed_value(field: Column, value: Column) -> Column:
    """Envelope of a model value: money gets a number, dates an ISO text."""
    money, date = field.isin(*fixed.MONEY_FIELDS), field.isin(*fixed.DATE_FIELDS)
    kind = (
        F.when(money, "money").when(date, "date").when(field == "supplier_vat", "vat")
        .when(field == "iban", "iban").when(field == "currency", "currency").otherwise("text")
    )
    value = F.when(date, F.nullif(value, F.lit(""))).otherwise(value)
    return envelope(
        kind, value, numeric=F.when(money, parse_decimal(value)), iso=F.when(date, value)
    )


def answer_fields(accepted: DataFrame) -> DataFrame:
    """One row per field a model gave a value for."""
    return (
        accepted.select("doc_id", F.explode("answer.fields").alias("field", "given"))
        .where(F.col("given.value").isNotNull() & ~F.coalesce("given.missing", F.lit(False)))
        .select("doc_id", "field", F.col("given.value").alias("raw"), "given.source_text")
    )


def ground(accepted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document and field the first block that contains, or is part of, its source text.

    Each block meets the few source texts of its document as one array and only
    hits are written out, so pairs are never built.
    """
    needles = accepted.select(
        "doc_id",
        F.filter(
            F.transform(
                F.map_entries("answer.fields"),
                lambda e: F.struct(e["key"].alias("field"),
                                   collapse(e["value"]["source_text"]).alias("needle")),
            ),
            lambda n: F.length(n["needle"]) > 0,
        ).alias("needles"),
    )
    placed = attach(
        blocks.select("doc_id", reading_order().alias("at"), bbox().alias("bbox"),
                      collapse(F.col("text")).alias("hay")),
        needles, ["doc_id"],
    )
    hay = F.col("hay")
    hits = F.filter(
        "needles",
        lambda n: (F.length(hay) > 0)
        & (F.contains(hay, n["needle"]) | F.contains(n["needle"], hay)),
    )
    return (
        placed.select("doc_id", "at", "bbox", F.explode(F.transform(hits, lambda n: n["field"]))
                      .alias("field"))
        .groupBy("doc_id", "field")
        .agg(F.min_by("bbox", "at").alias("bbox"))
    )


def model_candidates(accepted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Field candidates of the model; grounded ones are trusted more."""
    grounded = ground(accepted, blocks)
    return answer_fields(accepted).join(grounded, ["doc_id", "field"], "left").select(
        "doc_id", "field",
        typed_value(F.col("field"), F.col("raw")).alias("value"),
        F.when(F.col("bbox").isNotNull(), fixed.GROUNDED_CONFIDENCE)
        .otherwise(fixed.UNGROUNDED_CONFIDENCE).alias("confidence"),
        F.lit("llm").alias("method"),
        "source_text", "bbox",
    )


def model_line_items(accepted: DataFrame) -> DataFrame:
    """Line items of the model, positions from 1."""
    numbers = ("quantity", "unit_price", "net", "vat_rate", "vat_amount", "gross")
    return accepted.select(
        "doc_id", F.posexplode("answer.line_items").alias("no", "item")
    ).select(
        "doc_id", (F.col("no") + 1).alias("position"), "item.description",
        *[parse_decimal(F.col(f"item.{n}")).alias(n) for n in numbers],
        F.when(F.length("item.source_text") > 0, fixed.LINE_CONFIDENCE)
        .otherwise(fixed.LINE_CONFIDENCE_NO_TEXT).alias("confidence"),
    )


def lines_or_model(rule_lines: DataFrame, model_lines: DataFrame) -> DataFrame:
    """Line items of the rules; those of the model where the rules found none."""
    lacking = model_lines.join(rule_lines.select("doc_id").distinct(), "doc_id", "left_anti")
    return rule_lines.select(*model_lines.columns).unionByName(lacking)


def override_header(header: DataFrame, accepted: DataFrame) -> DataFrame:
    """Document type, language and country of the model replace those of the rules."""
    given = accepted.select("doc_id", *[
        F.nullif(F.col(f"answer.{c}"), F.lit("")).alias(f"_{c}")
        for c in ("doc_type", "language", "country")
    ])
    return (
        header.join(given, "doc_id", "left")
        .withColumn("doc_type", F.coalesce("_doc_type", "doc_type"))
        .withColumn("language", F.coalesce("_language", "language"))
        .withColumn("country", F.coalesce(F.upper("_country"), "country"))
        .drop("_doc_type", "_language", "_country")
    )


def values_equal(field: Column, rule: Column, model: Column) -> Column:
    """Do two candidates say the same: money within cents, dates by day, text by its key."""
    a, b = rule["numeric"], model["numeric"]
    slack = F.greatest(
        F.lit(fixed.MERGE_MONEY_TOLERANCE),
        F.greatest(F.abs(a), F.abs(b)) * fixed.MERGE_RELATIVE_TOLERANCE,
    )
    same_key = comparison_key(rule["value"]) == comparison_key(model["value"])
    both_days = (F.length(rule["iso"]) > 0) & (F.length(model["iso"]) > 0)
    same = (
        F.when(field.isin(*fixed.MONEY_FIELDS), F.abs(a - b) <= slack)
        .when(field.isin(*fixed.DATE_FIELDS) & both_days, rule["iso"] == model["iso"])
        .otherwise(same_key)
    )
    return F.coalesce(same, F.lit(False))


def merge_candidates(rules: DataFrame, model: DataFrame) -> DataFrame:
    """One candidate per document and field from both sides.

    One side alone stands.  Agreement keeps the rule's value with a bonus.  On
    disagreement well-formed fields keep the rule's value with less confidence,
    texts take the model's, and both are marked with the two values.
    """
    def side(df, name):
        return df.select("doc_id", "field", F.struct(*MERGE_PARTS).alias(name))

    both = side(rules, "r").join(side(model, "m"), ["doc_id", "field"], "full_outer")
    r, m, field = F.col("r"), F.col("m"), F.col("field")
    equal = values_equal(field, r["value"], m["value"])
    formed = field.isin(*fixed.WELL_FORMED_FIELDS)
    bonus = F.bround(
        F.least(F.lit(1.0), F.greatest(r["confidence"], m["confidence"]) + fixed.AGREEMENT_BONUS), 4
    )
    malus = F.greatest(F.lit(0.0), F.bround(r["confidence"] - fixed.CONFLICT_MALUS, 4))
    case = (
        F.when(m.isNull(), "rule").when(r.isNull(), "model").when(equal, "agree")
        .when(formed, "rule_kept").otherwise("model_taken")
    )
    judged = both.withColumn("_case", case)
    from_model = F.col("_case").isin("model", "model_taken")
    winner = F.when(from_model, m).otherwise(r)
    conflict = F.col("_case").isin("rule_kept", "model_taken")
    confidence = reduce(
        lambda c, kv: c.when(F.col("_case") == kv[0], kv[1]),
        [("rule_kept", malus)], F.when(F.col("_case") == "agree", bonus),
    ).otherwise(winner["confidence"])
    return judged.select(
        "doc_id", "field", winner["value"].alias("value"), confidence.alias("confidence"),
        winner["method"].alias("method"), winner["source_text"].alias("source_text"),
        winner["bbox"].alias("bbox"),
        F.when(conflict, "warn").alias("validator_status"),
        F.when(conflict, F.lit(fixed.CONFLICT_RULE)).alias("validator_rule"),
        F.when(conflict, F.create_map(F.lit("rule"), r["value"]["value"],
                                      F.lit("llm"), m["value"]["value"]))
        .alias("validator_detail"),
    )


# --- routes and cost --------------------------------------------------------


def resolve_route(policy: Column, task: Column) -> Column:
    """Route of a policy and task; an unknown policy or task falls back to the default's."""
    routes = F.create_map(*[
        F.lit(p) for (pol, t), r in fixed.ROUTES.items() for p in (f"{pol}/{t}", r)
    ])
    known = policy.isin(*{pol for pol, _ in fixed.ROUTES})
    used = F.when(known, policy).otherwise(fixed.DEFAULT_POLICY)
    return F.coalesce(
        F.try_element_at(routes, F.concat_ws("/", used, task)),
        F.try_element_at(routes, F.concat_ws("/", F.lit(fixed.DEFAULT_POLICY), task)),
        F.lit(fixed.ROUTE_OTHERWISE),
    )


def cost(route: Column, tokens: Column) -> Column:
    """Price of tokens on a route; of several alternatives the first counts."""
    prices = F.create_map(*[F.lit(p) for kv in fixed.TOKEN_PRICES.items() for p in kv])
    price = F.coalesce(
        F.try_element_at(prices, F.substring_index(route, "|", 1)),
        F.lit(fixed.TOKEN_PRICE_OTHERWISE),
    )
    return tokens * price / 1000


# --- text for a model -------------------------------------------------------


def document_text(blocks: DataFrame, cells: DataFrame, page_list: DataFrame = None) -> DataFrame:
    """Text of each document: page header, its blocks, then its tables row by row.

    Pages of the list (``doc_id, page_no``) without any content have their header alone.

    Texts are joined row by row, table by table, page by page, so that what meets
    in one place is already short of everything but the result itself.  Blocks, cells and pages
    that are dealt out by document alike are joined where they lie, without a further shuffle.
    """
    def joined(parts, *order):
        ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(parts).alias("t"))))
        return F.array_join(ordered["t"], "\n").alias("text")

    printed = blocks.groupBy("doc_id", "page_no").agg(joined("text", "block_no"))
    cell = F.array_sort(F.collect_list(F.struct("col_no", "text")))["text"]
    rows = cells.groupBy("doc_id", "page_no", "table_no", "row_no").agg(
        F.array_join(cell, " | ").alias("text")
    )
    tables = rows.groupBy("doc_id", "page_no", "table_no").agg(joined("text", "row_no")).select(
        "doc_id", "page_no", (F.col("table_no") + 1).alias("part"),
        F.concat(F.lit("TABLE:\n"), "text").alias("text"),
    )

    def of_page(frame, part=None):
        return frame.select("doc_id", "page_no", F.struct(part, F.col("text").alias("t")).alias("part"))

    every = of_page(printed, F.lit(0).alias("part")).unionByName(of_page(tables, F.col("part")))
    if page_list is not None:
        every = every.unionByName(page_list.select("doc_id", "page_no", F.lit(None).alias("part")))
    header = F.concat(F.lit("--- PAGE "), F.col("page_no") + 1, F.lit(" ---"))
    pages = every.groupBy("doc_id", "page_no").agg(F.collect_list("part").alias("parts")).select(
        "doc_id", "page_no", F.array_join(F.array_sort(F.array_append(
            "parts", F.struct(F.lit(-1).alias("part"), header.alias("t"))))["t"], "\n").alias("text"))
    return pages.groupBy("doc_id").agg(joined("text", "page_no"))

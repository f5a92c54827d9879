"""Exports: a wide table, CSV files, JSON records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_KEYS = ("description", "quantity", "unit_price", "net", "vat_rate", "vat_amount", "gross")


# Names of fields come from answers without bound; more of them than this are no table.
MOST_COLUMNS = 1000


def field_names(fields: DataFrame) -> list:
    """Names of all fields, sorted: the columns of an export that names none."""
    names = sorted(r[0] for r in fields.select("field").distinct().limit(MOST_COLUMNS + 1).collect())
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} fields: name the columns, or export json")
    return names


def wide_table(documents: DataFrame, fields: DataFrame, columns: list = None) -> DataFrame:
    """One row per document, a column per field with its raw value or an empty text.

    Every document is a row, also one without fields.  ``columns``: names, or
    ``{"field": ..., "header": ...}``; all fields when left out.
    """
    columns = columns or field_names(fields)
    wanted = [c if isinstance(c, dict) else {"field": c} for c in columns]
    values = [
        F.max(F.when(F.col("field") == c["field"], F.col("value.value")))
        .alias(c.get("header", c["field"]))
        for c in wanted
    ]
    found = fields.groupBy("doc_id").agg(*values)
    return documents.select("doc_id").join(found, "doc_id", "left").na.fill(
        "", [c.get("header", c["field"]) for c in wanted])


def json_records(documents: DataFrame, fields: DataFrame, lines: DataFrame) -> DataFrame:
    """One JSON record per document: its raw values, and its lines where it has some.

    Every document has a record, also one without fields or lines.
    """
    entry = F.struct("field", F.col("value.value").alias("v"))
    records = fields.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("values")
    )
    line = F.struct("position", F.struct(*LINE_KEYS).alias("line"))
    items = lines.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(line))["line"].alias("line_items")
    )
    keep_nulls = {"ignoreNullFields": "false"}
    values = F.to_json("values", keep_nulls)
    listed = F.to_json("line_items", keep_nulls)
    with_lines = F.concat(
        F.regexp_replace(values, r"\}$", ""), F.when(values == "{}", "").otherwise(","),
        F.lit('"line_items":'), listed, F.lit("}"),
    )
    none = F.create_map().cast("map<string,string>")
    every = documents.select("doc_id").join(records, "doc_id", "left").withColumn(
        "values", F.coalesce("values", none))
    return every.join(items, "doc_id", "left").select(
        "doc_id", F.when(listed.isNull(), values).otherwise(with_lines).alias("record")
    )


def json_envelope(records: DataFrame, doc_type: Column) -> DataFrame:
    """The one-row frame around the records: their number and the kind of documents."""
    return records.agg(F.to_json(
        F.struct(F.count(F.lit(1)).alias("count"), F.first(doc_type).alias("doc_type")),
        {"ignoreNullFields": "false"},
    ).alias("envelope"))


CSV_RULES = {
    "header": True, "encoding": "UTF-8", "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def export(frame: DataFrame, form: str, path: str) -> None:
    """Write an exported table as csv or json lines, in parallel.

    Quotes are doubled, blanks are kept, and every value is quoted, so that line breaks do
    not tear a record.
    """
    if form == "csv":
        frame.write.mode("overwrite").options(**CSV_RULES, quoteAll=True).csv(path)
    elif form == "json":
        frame.select("record").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unsupported format: {form}")


def read_csv(spark, path: str) -> DataFrame:
    """An exported csv table read back: all columns as text, line breaks within values included."""
    return spark.read.options(**CSV_RULES, multiLine=True).csv(path).na.fill("")

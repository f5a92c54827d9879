"""Invoices that look like the same one sent again: one supplier, nearly the same total and day."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import comparison_key
from .groups import attach

_SAME = ["org_id", "name", "total_cents", "day"]


def classes(sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The complete invoices, and one row per tenant, supplier, total and day with the smallest of its ids."""
    named = sheets.select("invoice_id", "org_id", comparison_key(F.col("supplier_name")).alias("name"), "total_cents",
                          F.unix_date("day").alias("day")).dropna()
    return named, named.groupBy(*_SAME).agg(F.min("invoice_id").alias("class_id"), F.count(F.lit(1)).alias("n"))


def near_duplicates(sheets: DataFrame, cents: int = 2, days: int = 1) -> DataFrame:
    """(invoice_id, class_id, class_size, near): every complete invoice's class and the other classes near it.

    Two classes of a tenant's supplier are near if their totals lie at most ``cents`` and their days at
    most ``days`` apart; ``near`` lists their ids, rising. Copies are one class, however many, and are
    never paired. Classes are dealt to cells as wide as the limits, and a class looks at its own and the
    eight around it: a cell has at most (cents + 1) * (days + 1) classes, so no cell is crowded and no
    list is longer than the band. Invoices without tenant, supplier, total or day are in no class.
    """
    named, groups = classes(sheets)
    cell = {"_x": F.floor(F.col("total_cents") / (cents + 1)), "_y": F.floor(F.col("day") / (days + 1))}
    own = groups.withColumns({k: v.cast("long") for k, v in cell.items()})
    around = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    looking = own.select("org_id", "name", F.col("class_id").alias("_from"), F.col("total_cents").alias("_cents"),
                         F.col("day").alias("_day"), "_x", "_y", F.inline(around)).select(
        "org_id", "name", "_from", "_cents", "_day", (F.col("_x") + F.col("x")).alias("_x"), (F.col("_y") + F.col("y")).alias("_y"))
    met = looking.join(own, ["org_id", "name", "_x", "_y"]).where(
        (F.col("_from") != F.col("class_id")) & (F.abs(F.col("_cents") - F.col("total_cents")) <= cents)
        & (F.abs(F.col("_day") - F.col("day")) <= days))
    near = met.groupBy(F.col("_from").alias("class_id")).agg(F.array_sort(F.collect_list("class_id")).alias("near"))
    of_class = attach(groups, near, ["class_id"])
    found = attach(named, of_class, _SAME)
    return found.select("invoice_id", "class_id", F.col("n").alias("class_size"),
                        F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))

"""Totals, averages and counts per workspace.

All of them combine on the map side before their shuffle, so a workspace that holds a
third of the rows costs no more than any other. Money is summed as decimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.functions import rules
from ledgerspark.functions.numbers import mean
from ledgerspark.operators.keyed import top_k
from ledgerspark.schemas import LEDGERS

WS = "workspace_id"


def _sum(amount: str | Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(28,2)")


def _mean(column: str | Column) -> Column:
    return mean(F.sum(column), F.count(column))


def month_label(month_no: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in V.MONTH_LABELS]), month_no)


def margin_series(sales: DataFrame, by_year: bool = False) -> DataFrame:
    """Revenue and mean margin per calendar month.

    By default the same month of different years is one row, as the dashboard shows it.
    """
    keys = [WS] + (["year_no"] if by_year else []) + ["month_no"]
    return (
        sales.withColumns({"month_no": F.month("date"), "year_no": F.year("date")})
        .groupBy(*keys)
        .agg(F.sum("amount_inr").alias("revenue_inr"), _mean("margin_pct").alias("margin_pct"))
        .withColumn("month_label", month_label(F.col("month_no")))
    )


def sales_totals(sales: DataFrame) -> DataFrame:
    """All-time revenue and unweighted mean margin; sales without a margin do not count."""
    return sales.groupBy(WS).agg(
        _sum("amount_inr").alias("total_revenue"), _mean("margin_pct").alias("avg_margin")
    )


def due_soon(obligations: DataFrame, as_of) -> DataFrame:
    """Unpaid obligations due within the next ten days; overdue ones are left out."""
    days = F.date_diff("due_date", F.lit(as_of).cast("date"))
    return obligations.filter(
        rules.unpaid(F.col("status")) & days.between(0, V.DUE_SOON_DAYS)
    )


def due_today(obligations: DataFrame, as_of) -> DataFrame:
    """Unpaid obligations due on the day or earlier."""
    return obligations.filter(
        rules.unpaid(F.col("status")) & (F.col("due_date") <= F.lit(as_of).cast("date"))
    )


def near_expiry(products: DataFrame, as_of) -> DataFrame:
    """Products that expire within 45 days, expired ones included."""
    limit = F.date_add(F.lit(as_of).cast("date"), V.EXPIRY_WINDOW_DAYS)
    return products.filter(F.col("expires_on") <= limit)


def obligation_order() -> list[Column]:
    return [
        rules.obligation_rank(F.col("status")),
        F.col("due_date"),
        F.col("label"),
        F.col("id"),
    ]


def bills_due(obligations: DataFrame, as_of) -> DataFrame:
    """Total due in ten days and the first three labels."""
    totals = due_soon(obligations, as_of).groupBy(WS).agg(_sum("amount_inr").alias("total_due"))
    return totals.join(first_labels(obligations, as_of), WS, "left")


def first_labels(obligations: DataFrame, as_of) -> DataFrame:
    """Labels of the first three bills due in ten days."""
    first = top_k(due_soon(obligations, as_of), [WS], obligation_order(), V.LEADING_BILLS, "ord")
    listed = first.groupBy(WS).agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("first"))
    return listed.select(
        WS, F.array_join(F.transform("first", lambda x: x["label"]), ", ").alias("labels")
    )


def expiry_exposure(products: DataFrame, as_of) -> DataFrame:
    """Number and stock value of the lots near expiry."""
    value = F.col("unit_price_inr") * F.col("quantity_on_hand")
    return (
        near_expiry(products, as_of)
        .groupBy(WS)
        .agg(F.count("*").alias("lot_count"), _sum(value).alias("exposure"))
    )


def utilities_mean(expenses: DataFrame) -> DataFrame:
    return (
        expenses.filter(F.lower("category") == "utilities")
        .groupBy(WS)
        .agg(_mean("amount_inr").alias("utility_avg"))
    )


def obligation_totals(obligations: DataFrame, as_of=None) -> DataFrame:
    """Unpaid total and largest unpaid supplier obligation, in one pass.

    With ``as_of`` also what is due in ten days.
    """
    supplier = F.when(F.lower("category") == "supplier", F.col("amount_inr"))
    figures = [_sum("amount_inr").alias("recurring_due"), F.max(supplier).alias("top_supplier_due")]
    if as_of is not None:
        days = F.date_diff("due_date", F.lit(as_of).cast("date"))
        soon = F.when(days.between(0, V.DUE_SOON_DAYS), F.col("amount_inr"))
        figures.append(_sum(soon).alias("total_due"))
    return obligations.filter(rules.unpaid(F.col("status"))).groupBy(WS).agg(*figures)


def daily_totals(rows: DataFrame, date: str = "date") -> DataFrame:
    return rows.groupBy(WS, F.col(date).alias("day")).agg(
        F.sum("amount_inr").alias("daily_total")
    )


def moving_average(daily: DataFrame, days: int = V.MOVING_AVERAGE_DAYS) -> DataFrame:
    """Mean of the last days that have data; fewer days are averaged as they are."""
    last = top_k(daily, [WS], [F.col("day").desc()], days, "ord")
    return last.groupBy(WS).agg(_mean("daily_total").alias("average"))


def moving_average_series(daily: DataFrame, days: int = V.MOVING_AVERAGE_DAYS) -> DataFrame:
    """Moving average at every day with data; one row per day bounds the window."""
    window = Window.partitionBy(WS).orderBy("day").rowsBetween(1 - days, 0)
    average = mean(F.sum("daily_total").over(window), F.count("daily_total").over(window))
    return daily.withColumn("average", average)


def revenue_per_sku(sales: DataFrame) -> DataFrame:
    return sales.groupBy(WS, "sku").agg(F.sum("amount_inr").alias("revenue"))


def expense_per_category(expenses: DataFrame) -> DataFrame:
    return expenses.groupBy(WS, "category").agg(F.sum("amount_inr").alias("expense_total"))


def row_counts(ledgers: dict[str, DataFrame]) -> DataFrame:
    """Rows per workspace and collection."""
    parts = [
        frame.groupBy(WS).agg(F.count("*").alias("row_count")).select(
            WS, F.lit(name).alias("import_type"), "row_count"
        )
        for name, frame in ledgers.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def latest_order(collection: str) -> list[Column]:
    """Order of a collection's rows from the latest on."""
    last_key = "sku" if collection == "products" else "id"
    return [F.col(c).desc() for c in [LEDGERS[collection]["date"], "created_at", last_key]]


def sample_rows(rows: DataFrame, collection: str, k: int = V.SAMPLE_ROWS) -> DataFrame:
    """Latest rows of a collection per workspace as text fields, oldest first."""
    spec = LEDGERS[collection]
    latest = top_k(rows, [WS], latest_order(collection), k, "_back")
    text = F.array(*[F.col(c).cast("string") for c in spec["columns"]])
    shown = latest.groupBy(WS).agg(
        F.sort_array(F.collect_list(F.struct(-F.col("_back"), text.alias("fields")))).alias("s")
    )
    return shown.select(
        WS,
        F.lit(collection).alias("import_type"),
        F.transform("s", lambda row: row["fields"]).alias("sample_rows"),
    )


def top_skus(sales: DataFrame, k: int = 3) -> DataFrame:
    ranked = revenue_per_sku(sales)
    return top_k(ranked, [WS], [F.col("revenue").desc(), F.col("sku")], k, "ord")


def top_categories(expenses: DataFrame, k: int = 3) -> DataFrame:
    ranked = expense_per_category(expenses)
    return top_k(ranked, [WS], [F.col("expense_total").desc(), F.col("category")], k, "ord")


def soonest_expiry(products: DataFrame, as_of) -> DataFrame:
    """The product that expires first among those near expiry."""
    order = [F.col("expires_on"), F.col("sku")]
    return top_k(near_expiry(products, as_of), [WS], order, 1, "ord").drop("ord")


def soonest_due(obligations: DataFrame, as_of, k: int = V.LEADING_BILLS) -> DataFrame:
    """First unpaid obligations by days to the due date, overdue ones first."""
    unpaid = obligations.filter(rules.unpaid(F.col("status"))).withColumn(
        "days", F.date_diff("due_date", F.lit(as_of).cast("date"))
    )
    return top_k(unpaid, [WS], [F.col("days"), *obligation_order()], k, "ord")


def per_workspace(workspaces: DataFrame, *facts: DataFrame) -> DataFrame:
    """One row per workspace with the columns of every fact frame, NULL where absent."""
    result = workspaces.select(WS)
    for frame in facts:
        result = result.join(frame, WS, "left")
    return result

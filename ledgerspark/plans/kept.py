"""Kept figures: what the reports need of every ledger, written once per batch of its rows.

A batch leaves two small pieces below ``root``. Its *sums* hold one row per workspace and day:
counts, amounts, the largest amount. Its *lead rows* are those rows of the ledger that a report of
any day may name: the three latest of a workspace, the first three unpaid bills of each due day, the
first product of each expiry day. Sums of sums and the first of the first are those of all rows, so
reports read the kept pieces and no ledger, whatever day they are made for.

Fact ledgers (sales, purchases, expenses) are kept per batch of new rows; a batch that is written again
replaces itself. Ledgers whose rows change (products, bills) are kept per block of workspaces,
and a change rewrites the blocks of the workspaces that it touches. Rows of a ledger have ids of their own, and
no batch repeats a row of another.

A batch is written by two appends. Where the second is lost, repeating the batch mends both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.functions import rules
from ledgerspark.functions.numbers import mean
from ledgerspark.operators import aggregates as A
from ledgerspark.operators.keyed import top_k
from ledgerspark.schemas import LEDGERS, table_schema
from ledgerspark.sources.tables import append_batch, read_facts

WS = "workspace_id"
BLOCKS = 64
SUMS = table_schema(
    "workspace_id string, import_type string, day date, row_count bigint, amount decimal(28,2), "
    "part decimal(28,2), part_count bigint, largest decimal(12,2)"
)


def day_sums(rows: DataFrame, collection: str) -> DataFrame:
    """One row per workspace and day of a ledger's rows, combined before the shuffle.

    The day is the month of a sale, the due day of a bill and the expiry day of a product;
    purchases and expenses have one row per workspace. ``part`` sums margins of sales and amounts of utilities.
    """
    none = F.lit(None)
    day: Column = none
    amount: Column = none
    part: Column = none
    largest: Column = none
    if collection == "sales":
        day, amount, part = F.trunc("date", "month"), F.col("amount_inr"), F.col("margin_pct")
    elif collection == "expenses":
        part = F.when(F.lower("category") == "utilities", F.col("amount_inr"))
    elif collection == "products":
        day, amount = F.col("expires_on"), F.col("unit_price_inr") * F.col("quantity_on_hand")
    elif collection == "recurring_obligations":
        day = F.col("due_date")
        amount = F.when(rules.unpaid(F.col("status")), F.col("amount_inr"))
        largest = F.when(F.lower("category") == "supplier", amount)
    return (
        rows.groupBy(WS, day.cast("date").alias("day"))
        .agg(
            F.count("*").alias("row_count"),
            F.sum(amount.cast("decimal(28,2)")).cast("decimal(28,2)").alias("amount"),
            F.sum(part.cast("decimal(28,2)")).cast("decimal(28,2)").alias("part"),
            F.count(part).alias("part_count"),
            F.max(largest.cast("decimal(12,2)")).alias("largest"),
        )
        .withColumn("import_type", F.lit(collection))
        .select([f.name for f in SUMS])
    )


def lead_rows(rows: DataFrame, collection: str) -> DataFrame:
    """The rows of a ledger that a report of any day may name; every choice limits before its shuffle."""
    key = "sku" if collection == "products" else "id"
    leads = [top_k(rows, [WS], A.latest_order(collection), V.SAMPLE_ROWS, "_ord")]
    if collection == "recurring_obligations":
        unpaid = rows.filter(rules.unpaid(F.col("status")))
        leads.append(top_k(unpaid, [WS, "due_date"], A.obligation_order(), V.LEADING_BILLS, "_ord"))
    elif collection == "products":
        ending = rows.filter(F.col("expires_on").isNotNull())
        leads.append(top_k(ending, [WS, "expires_on"], [F.col("sku")], 1, "_ord"))
    found = leads[0]
    for more in leads[1:]:
        found = found.unionByName(more)
    return found.dropDuplicates([WS, key]).select([f.name for f in LEDGERS[collection]["schema"]])


def keep_batch(rows: DataFrame, collection: str, root: str, batch_id: str) -> None:
    """Keep a batch of new rows of a fact ledger; the same batch again replaces itself."""
    name = f"{collection}-{batch_id}"
    append_batch(lead_rows(rows, collection), f"{root}/leads/{collection}", name)
    append_batch(day_sums(rows, collection), f"{root}/sums", name)


def keep_state(rows: DataFrame, collection: str, root: str, touched: DataFrame | None = None) -> None:
    """Keep a ledger whose rows change: all of it, or the blocks of the ``touched`` workspaces.

    ``rows`` is the whole latest state, ``touched`` has a workspace per row, repeats do no harm. Only
    the touched blocks are read into the sums and written; the others stay as they are.
    """
    block = F.concat(
        F.lit(f"{collection}-block-"), F.pmod(F.xxhash64(WS), F.lit(BLOCKS)).cast("string")
    )
    if touched is not None:
        hit = touched.select(block.alias("_block")).distinct()
        rows = rows.withColumn("_block", block).join(hit, "_block", "left_semi")
    for path, kept in [
        (f"{root}/leads/{collection}", lead_rows(rows, collection)),
        (f"{root}/sums", day_sums(rows, collection)),
    ]:
        writer = kept.withColumn("batch_id", block).repartition("batch_id").write
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def read_sums(spark: SparkSession, root: str) -> DataFrame:
    return read_facts(spark, f"{root}/sums", SUMS)


def read_leads(spark: SparkSession, root: str, collection: str) -> DataFrame:
    """Lead rows in the shape of their ledger, for every operator that names the first few rows."""
    return read_facts(spark, f"{root}/leads/{collection}", LEDGERS[collection]["schema"])


def figures(workspaces: DataFrame, sums: DataFrame, lead_bills: DataFrame, as_of) -> DataFrame:
    """The figures of ``dashboard.workspace_facts`` before its defaults, in one pass over the sums."""
    day = F.lit(as_of).cast("date")

    def of(collection: str, column: str, also: Column | None = None) -> Column:
        hit = F.col("import_type") == collection
        return F.when(hit if also is None else hit & also, F.col(column))

    soon = F.date_diff("day", day).between(0, V.DUE_SOON_DAYS)
    ending = F.col("day") <= F.date_add(day, V.EXPIRY_WINDOW_DAYS)
    bills = "recurring_obligations"
    found = sums.groupBy(WS).agg(
        F.sum(of("sales", "amount")).alias("total_revenue"),
        mean(F.sum(of("sales", "part")), F.sum(of("sales", "part_count"))).alias("avg_margin"),
        F.sum(of(bills, "amount", soon)).alias("total_due"),
        F.sum(of("products", "row_count", ending)).alias("lot_count"),
        F.sum(of("products", "amount", ending)).alias("exposure"),
        mean(F.sum(of("expenses", "part")), F.sum(of("expenses", "part_count"))).alias("utility_avg"),
        F.sum(of(bills, "amount")).alias("recurring_due"),
        F.max(of(bills, "largest")).alias("top_supplier_due"),
    )
    return A.per_workspace(workspaces, found, A.first_labels(lead_bills, as_of))


def margin_series(sums: DataFrame, by_year: bool = False) -> DataFrame:
    """``aggregates.margin_series`` from the sums of the months."""
    keys = [WS] + (["year_no"] if by_year else []) + ["month_no"]
    sales = sums.filter(F.col("import_type") == "sales")
    return (
        sales.withColumns({"month_no": F.month("day"), "year_no": F.year("day")})
        .groupBy(*keys)
        .agg(
            F.sum("amount").alias("revenue_inr"),
            mean(F.sum("part"), F.sum("part_count")).alias("margin_pct"),
        )
        .withColumn("month_label", A.month_label(F.col("month_no")))
    )


def row_counts(sums: DataFrame) -> DataFrame:
    """Rows per workspace and collection."""
    return sums.groupBy(WS, "import_type").agg(F.sum("row_count").alias("row_count"))

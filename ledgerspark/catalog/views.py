"""The driver's tables seen as ledger tables, for the registered queries.

Every view keeps all rows of its tables. A column is spread over workspaces by nation or
by ``% 25``; that assigns rows, it leaves none out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.imports import affected_collections, payload_of

AS_OF = dt.date(1998, 6, 15)
NOW = dt.datetime(1998, 6, 15, 12, 0, 0)
WORKSPACE_COUNT = 25


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def pick(column: str, values: dict, otherwise) -> Column:
    result = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for key, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        result = F.when(F.col(column) == key, value).otherwise(result)
    return result


def spread(column: str) -> Column:
    """Workspace of a row by its key."""
    return (F.col(column) % WORKSPACE_COUNT).cast("string")


def day(column: str) -> Column:
    return F.col(column).cast("date")


def money(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(12,2)")


def rates() -> Column:
    return F.round((F.col("l_discount") + F.col("l_tax")) * 100, 2).cast("decimal(6,2)")


class Views:
    """Ledger views of one directory of driver tables."""

    # total order of an order's lines as rows of an upload
    UPLOAD_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]

    @staticmethod
    def upload_blocks() -> list[Column]:
        """Blocks of that order: the line, and parts by the thousand."""
        return [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 1000)]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    def workspaces(self) -> DataFrame:
        return self.table("nation").select(
            text("n_nationkey").alias("workspace_id"), F.col("n_name").alias("name")
        )

    def _lines(self) -> DataFrame:
        supplier = self.table("supplier").select("s_suppkey", "s_name", "s_nationkey")
        lines = self.table("lineitem")
        return lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).withColumns(
            {
                "workspace_id": text("s_nationkey"),
                "id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
            }
        )

    def sales(self, product: bool = False) -> DataFrame:
        """Sales lines; product name and category only where a query shows them."""
        lines = self._lines()
        if product:
            part = self.table("part").select("p_partkey", "p_name", "p_type")
            lines = lines.join(part, lines.l_partkey == part.p_partkey)
            name, category = F.col("p_name"), F.col("p_type")
        else:
            name = category = F.lit(None).cast("string")
        return lines.select(
            "workspace_id",
            "id",
            day("l_shipdate").alias("date"),
            text("l_partkey").alias("sku"),
            name.alias("name"),
            category.alias("category"),
            F.col("l_quantity").cast("int").alias("quantity"),
            money("l_extendedprice").alias("amount_inr"),
            F.when(F.col("l_returnflag") != "N", rates()).alias("margin_pct"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
        )

    def purchases(self) -> DataFrame:
        return self._lines().select(
            "workspace_id",
            "id",
            day("l_shipdate").alias("date"),
            F.col("s_name").alias("supplier_name"),
            text("l_partkey").alias("sku"),
            F.col("l_quantity").cast("int").alias("quantity"),
            money(F.col("l_quantity") * 10).alias("amount_inr"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
        )

    def products(self) -> DataFrame:
        shift = (F.col("p_partkey") % 121 - 10).cast("int")
        return self.table("part").select(
            spread("p_partkey").alias("workspace_id"),
            text("p_partkey").alias("sku"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            money("p_retailprice").alias("unit_price_inr"),
            F.col("p_size").alias("quantity_on_hand"),
            F.when(F.col("p_partkey") % 7 != 0, F.date_add(F.lit(AS_OF), shift)).alias(
                "expires_on"
            ),
            F.date_add(F.lit(dt.date(1998, 1, 1)), F.col("p_size"))
            .cast("timestamp")
            .alias("created_at"),
        )

    def expenses(self) -> DataFrame:
        return self.table("events").select(
            spread("user_id").alias("workspace_id"),
            text("event_id").alias("id"),
            day("ts").alias("occurred_on"),
            F.concat(F.lit("user-"), text("user_id")).alias("label"),
            pick(
                "event_type", {"error": "Utilities", "click": "Operations"}, F.col("event_type")
            ).alias("category"),
            money("value").alias("amount_inr"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )

    def _orders(self) -> DataFrame:
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        orders = self.table("orders")
        return orders.join(customer, orders.o_custkey == customer.c_custkey).withColumn(
            "workspace_id", text("c_nationkey")
        )

    def obligations(self) -> DataFrame:
        return self._orders().select(
            "workspace_id",
            text("o_orderkey").alias("id"),
            F.concat_ws("-", "o_orderpriority", "o_orderkey").alias("label"),
            pick(
                "o_orderpriority", {"1-URGENT": "Supplier", "2-HIGH": "Utilities"}, "Facility"
            ).alias("category"),
            money("o_totalprice").alias("amount_inr"),
            day("o_orderdate").alias("due_date"),
            F.element_at(
                F.array(F.lit("monthly"), F.lit("quarterly"), F.lit("annual")),
                (F.col("o_orderkey") % 3 + 1).cast("int"),
            ).alias("recurrence"),
            pick("o_orderstatus", {"F": "paid", "O": "due"}, "scheduled").alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    def documents(self) -> DataFrame:
        age = (F.col("n_chars") % 365).cast("int")
        uploaded = F.date_sub(F.lit(AS_OF), age)
        return self.table("documents").select(
            spread("doc_id").alias("workspace_id"),
            text("doc_id").alias("document_id"),
            F.concat_ws("-", "source", "doc_id").alias("title"),
            F.col("lang").alias("kind"),
            F.col("text").alias("summary"),
            uploaded.alias("uploaded_at"),
            uploaded.cast("timestamp").alias("created_at"),
        )

    def questions(self) -> DataFrame:
        """User turns, each led by one of ten wordings that reach every rule."""
        wordings = [
            "Why did profit drop this month?",
            "What are my TOP products that sell best?",
            "Which expense is highest?",
            "Did an expense spike; why?",
            "Forecast and predict why sales moved",
            "Investigate margin",
            "delete me -- please",
            "What dropped?",
            "Please grant access",
            "",
        ]
        n = ((F.col("conv_id") + F.col("turn")) % len(wordings) + 1).cast("int")
        lead = F.element_at(F.array(*map(F.lit, wordings)), n)
        return (
            self.table("conversations")
            .filter(F.col("role") == "user")
            .select(
                spread("conv_id").alias("workspace_id"),
                F.concat_ws("-", "conv_id", "turn").alias("question_id"),
                F.concat(lead, F.lit(" "), "text").alias("question"),
            )
        )

    def _job_columns(self) -> dict[str, Column]:
        kind = pick(
            "o_orderpriority",
            {
                "1-URGENT": "sales",
                "2-HIGH": "purchases",
                "3-MEDIUM": "products",
                "4-NOT SPECIFIED": "expenses",
            },
            "recurring_obligations",
        )
        return {
            "job_id": text("o_orderkey"),
            "import_type": F.when(F.col("o_orderstatus") == "P", "inventory").otherwise(kind),
            "filename": F.concat(F.lit("export-"), text("o_orderkey"), F.lit(".csv")),
        }

    def import_jobs(self) -> DataFrame:
        """One import job per order, its lines the rows; finished orders are confirmed."""
        lines = (
            self.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("row_count"))
        )
        orders = self._orders().withColumns(self._job_columns())
        count = F.coalesce("row_count", F.lit(0)).cast("bigint")
        done = F.col("o_orderstatus") == "F"
        return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
            "workspace_id",
            "job_id",
            "import_type",
            "filename",
            count.alias("row_count"),
            F.when(done, "confirmed").otherwise("pending").alias("status"),
            F.when(done, count).otherwise(0).cast("bigint").alias("applied_count"),
            F.when(done, affected_collections(F.col("import_type")))
            .otherwise(F.array().cast("array<string>"))
            .alias("affected_collections"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.when(done, F.date_add(day("o_orderdate"), 1).cast("timestamp")).alias(
                "confirmed_at"
            ),
        )

    def uploads(self) -> DataFrame:
        """Order lines as uploaded rows with the headers, gaps and faults of their type."""
        orders = self._orders().withColumns(self._job_columns())
        lines = self.table("lineitem")
        joined = lines.join(
            orders.select("o_orderkey", "workspace_id", "job_id", "import_type", "filename"),
            lines.l_orderkey == orders.o_orderkey,
        )
        flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
        iso = F.date_format("l_shipdate", "yyyy-MM-dd")
        date = (
            F.when(line == 7, "")
            .when(flag == "R", F.date_format("l_shipdate", "yyyy-M-d"))
            .when((flag == "N") & (line == 2), "2026-02-30")
            .otherwise(iso)
        )
        later = F.when(status == "F", "").otherwise(
            F.date_add(day("l_shipdate"), 1).cast("string")
        )
        sku = text("l_partkey")
        count = F.when(line == 3, "abc").otherwise(text(F.col("l_quantity").cast("int")))
        amount = F.concat(text(money("l_extendedprice")), F.lit("5"))
        margin = F.when(flag != "N", text(rates()))
        label = F.when(line != 4, F.concat(F.lit("line-"), sku))
        layouts = {
            "sales": {
                " Date ": date,
                "SKU": sku,
                "Product Name": label,
                "category": flag,
                "Qty": count,
                "Revenue INR": amount,
                "amount_inr": F.lit("x"),
                "margin_pct": margin,
            },
            "purchases": {
                "Date": date,
                "Supplier": text("l_suppkey"),
                "SKU": sku,
                "quantity": count,
                "amount_inr": F.concat(F.lit(" "), amount, F.lit(" ")),
                "date": later,
            },
            "products": {
                "sku": F.when(line == 5, "  ").otherwise(sku),
                "name": label,
                "unit_price_inr": amount,
                "quantity_on_hand": count,
                "expires_on": later,
                "Shelf": F.lit("s"),
            },
            "expenses": {
                "date": date,
                "label": label,
                "Category": F.when(line == 6, "").otherwise(flag),
                "amount_inr": F.when(line == 2, "5d").otherwise(amount),
            },
            "recurring_obligations": {
                "Label": label,
                "category": flag,
                "amount_inr": amount,
                "due_date": date,
                "Recurrence": F.when(status == "F", "annual").otherwise("weekly"),
                "Status": F.when(flag == "A", "due").otherwise("open"),
            },
            "inventory": {"sku": sku, "count": count},
        }
        blank = F.col("l_quantity") == 1
        headers = payload = None
        for kind, layout in layouts.items():
            cells = {h: F.when(blank, "").otherwise(value) for h, value in layout.items()}
            is_kind = F.col("import_type") == kind
            when = F.when if payload is None else payload.when
            payload = when(is_kind, payload_of(kind, cells))
            when = F.when if headers is None else headers.when
            headers = when(is_kind, F.array(*[F.lit(h) for h in layout]))
        return joined.select(
            "workspace_id",
            "job_id",
            "import_type",
            "filename",
            *self.UPLOAD_ORDER,
            headers.alias("headers"),
            payload.alias("payload"),
        )

    def status_changes(self, target: str) -> DataFrame:
        """Events as status changes of the orders of their user; errors hit unknown ids."""
        events = self.table("events").select(
            "user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")
        )
        orders = self._orders().select("o_custkey", "o_orderkey", "workspace_id")
        if target == "obligations":
            statuses = {"purchase": "paid", "signup": "scheduled", "view": "due", "click": "Paid"}
            entity = text("o_orderkey")
        else:
            statuses = {
                "purchase": " Resolved ", "signup": "snoozed", "view": "open", "click": "WATCHING",
            }
            entity = F.concat(F.lit("obligation-"), text("o_orderkey"))
        status = pick("event_type", statuses, "bogus").alias("status")
        rest = [
            status,
            F.date_add(F.to_date("ts"), 3).cast("string").alias("snooze_until"),
            F.concat(F.lit("note-"), text("event_id")).alias("resolution_note"),
            "ts",
            F.col("event_id").alias("change_id"),
        ]
        known = events.join(orders, events.user_id == orders.o_custkey).select(
            "workspace_id", entity.alias("entity_id"), *rest
        )
        unknown = events.filter(F.col("event_type") == "error").select(
            spread("user_id").alias("workspace_id"),
            F.concat(F.lit("unknown-"), text("user_id")).alias("entity_id"),
            *rest,
        )
        return known.unionByName(unknown)

    def actions(self) -> DataFrame:
        """Stored actions: one per order, in every status."""
        orders = self._orders()
        stamp = F.col("o_orderdate").cast("timestamp")
        return orders.select(
            "workspace_id",
            F.concat(
                F.when(F.col("o_orderpriority") == "1-URGENT", "draft-").otherwise("obligation-"),
                text("o_orderkey"),
            ).alias("id"),
            F.concat(F.lit("Old title "), text("o_orderkey")).alias("title"),
            F.lit("Old detail").alias("detail"),
            F.lit("info").alias("severity"),
            pick("o_orderpriority", {"1-URGENT": "vendor_follow_up"}, "bill_review").alias(
                "action_type"
            ),
            F.concat(F.lit("order_"), text("o_orderkey")).alias("target_entity"),
            pick(
                "o_orderpriority",
                {"2-HIGH": "watching", "3-MEDIUM": "snoozed", "4-NOT SPECIFIED": "resolved"},
                "open",
            ).alias("status"),
            F.when(F.col("o_orderpriority") == "3-MEDIUM", "1998-07-01").alias("snoozed_until"),
            F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "done").alias(
                "resolution_note"
            ),
            stamp.alias("created_at"),
            stamp.alias("updated_at"),
        )

    def settings(self) -> DataFrame:
        """Stored provider settings, with every customer a workspace."""
        return self.table("customer").select(
            text("c_custkey").alias("workspace_id"),
            pick("c_mktsegment", {"BUILDING": "hybrid", "FURNITURE": "byo-cloud"}, "other").alias(
                "mode"
            ),
            F.array(F.col("c_mktsegment"), F.lit(" "), F.lit("Local")).alias("providers"),
            F.lit(dt.datetime(1998, 1, 1)).cast("timestamp").alias("updated_at"),
        )

    def settings_saves(self) -> DataFrame:
        return self.table("events").select(
            text("user_id").alias("workspace_id"),
            pick("event_type", {"click": "hybrid", "view": "byo-cloud"}, "local-open").alias(
                "mode"
            ),
            F.array(
                F.concat(F.lit(" "), F.upper("event_type")), F.col("event_type"), F.lit("ollama")
            ).alias("providers"),
            F.col("ts").cast("timestamp").alias("updated_at"),
        )

    def workspace_settings(self) -> DataFrame:
        """Settings of the nation workspaces, one mode per region."""
        return self.table("nation").select(
            text("n_nationkey").alias("workspace_id"),
            pick("n_regionkey", {0: "hybrid", 1: "byo-cloud", 2: "byo-cloud"}, "local-open").alias(
                "mode"
            ),
            F.when(F.col("n_regionkey") == 2, F.array().cast("array<string>"))
            .otherwise(F.array(F.lit("First "), F.col("n_name")))
            .alias("providers"),
            F.lit(dt.datetime(1998, 1, 1)).cast("timestamp").alias("updated_at"),
        )

    def members(self) -> DataFrame:
        return self.table("customer").select(
            text("c_nationkey").alias("workspace_id"),
            text("c_custkey").alias("user_id"),
            pick(
                "c_mktsegment",
                {
                    "AUTOMOBILE": "owner",
                    "HOUSEHOLD": "owner",
                    "BUILDING": "manager",
                    "FURNITURE": "accountant",
                },
                "guest",
            ).alias("role"),
            F.date_add(F.lit(dt.date(1990, 1, 1)), (F.col("c_custkey") % 1000).cast("int"))
            .cast("timestamp")
            .alias("created_at"),
        )

    def member_requests(self) -> DataFrame:
        """Per workspace the customer with the largest balance asks for the listing."""
        best = F.max(F.struct("c_acctbal", "c_custkey")).alias("best")
        return self.table("customer").groupBy("c_nationkey").agg(best).select(
            text("c_nationkey").alias("workspace_id"),
            text(F.col("best.c_custkey")).alias("requester_id"),
        )

    def role_changes(self) -> DataFrame:
        """Orders as role changes, aimed at oneself, known members and strangers."""
        ends = self.table("customer").groupBy(text("c_nationkey").alias("workspace_id")).agg(
            F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last")
        )
        return self._orders().join(ends, "workspace_id").select(
            F.col("o_orderkey").alias("change_id"),
            "workspace_id",
            text("o_custkey").alias("requester_id"),
            text(
                pick(
                    "o_orderpriority",
                    {
                        "2-HIGH": F.col("first"),
                        "3-MEDIUM": F.col("last"),
                        "4-NOT SPECIFIED": F.col("o_orderkey") + 1000000000,
                    },
                    F.col("o_custkey"),
                )
            ).alias("user_id"),
            pick("o_orderstatus", {"F": "owner", "O": "manager"}, "boss").alias("role"),
        )

    def role_chains(self) -> DataFrame:
        """Orders as role changes among five captains of each workspace, who decide about each other."""
        captains = self.table("customer").groupBy(
            text("c_nationkey").alias("workspace_id"), (F.col("c_custkey") % 5).alias("slot")
        ).agg(F.min("c_custkey").alias("captain"))
        slot = pick(
            "o_orderpriority",
            {"1-URGENT": F.col("o_custkey") + 1, "2-HIGH": F.col("o_orderkey")},
            F.col("o_custkey") + 2,
        )
        user = pick(
            "o_orderpriority",
            {"3-MEDIUM": F.col("o_custkey"), "4-NOT SPECIFIED": F.col("o_orderkey") + 1000000000},
            F.coalesce("captain", "o_custkey"),
        )
        orders = self._orders().withColumn("slot", slot % 5)
        return orders.join(captains, ["workspace_id", "slot"], "left").select(
            F.col("o_orderkey").alias("change_id"),
            "workspace_id",
            text("o_custkey").alias("requester_id"),
            text(user).alias("user_id"),
            pick("o_orderstatus", {"F": "owner", "O": "manager"}, "boss").alias("role"),
        )

    def forecast_requests(self) -> DataFrame:
        days = F.floor("value").cast("int").cast("string")
        return self.table("events").select(
            spread("user_id").alias("workspace_id"),
            text("event_id").alias("request_id"),
            pick(
                "event_type",
                {"click": "Sales", "purchase": "purchases", "view": "recurring", "signup": "CASH"},
                "weather",
            ).alias("metric"),
            F.when(F.col("event_type") == "error", days)
            .otherwise(F.concat(days, F.lit("d")))
            .alias("horizon"),
        )

    def scenario_requests(self) -> DataFrame:
        return self.table("events").select(
            spread("user_id").alias("workspace_id"),
            text("event_id").alias("request_id"),
            pick(
                "event_type",
                {
                    "click": "supplier_price_increase",
                    "purchase": "underperforming_product_line",
                    "view": "delayed_reorder",
                    "signup": "rent_electricity_increase",
                },
                "flood",
            ).alias("scenario_type"),
            F.floor("value").cast("int").alias("horizon_days"),
            F.col("value").alias("percentage"),
        )

    def product_batch(self) -> DataFrame:
        """Order lines as product rows; a sku comes many times, some rows lack a sku."""
        return self.table("lineitem").select(
            spread("l_partkey").alias("workspace_id"),
            F.when(F.col("l_returnflag") == "N", " ").otherwise(text("l_partkey")).alias("sku"),
            F.concat(F.lit("line "), text("l_orderkey")).alias("name"),
            F.col("l_linestatus").alias("category"),
            money("l_extendedprice").alias("unit_price_inr"),
            F.col("l_quantity").cast("int").alias("quantity_on_hand"),
            F.when(F.col("l_linestatus") == "O", day("l_shipdate")).alias("expires_on"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
            "l_shipdate",
            "l_orderkey",
            "l_linenumber",
            "l_suppkey",
        )

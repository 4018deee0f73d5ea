"""Owner dashboard: workspace facts, stat cards, margin series, inventory alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.functions import rules
from ledgerspark.functions.numbers import inr_short
from ledgerspark.operators import aggregates as A

WS = "workspace_id"


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name)


def workspace_facts(
    workspaces: DataFrame,
    sales: DataFrame,
    expenses: DataFrame,
    obligations: DataFrame,
    products: DataFrame,
    as_of,
) -> DataFrame:
    """One row per workspace with every figure that the reports share.

    Every figure is reduced to a row per workspace before the joins. Obligations are read twice,
    for their sums and for the labels.
    """
    joined = A.per_workspace(
        workspaces,
        A.sales_totals(sales),
        A.first_labels(obligations, as_of),
        A.expiry_exposure(products, as_of),
        A.utilities_mean(expenses),
        A.obligation_totals(obligations, as_of),
    )
    return with_defaults(joined)


def with_defaults(joined: DataFrame) -> DataFrame:
    """Figures per workspace as the reports take them: zero where there is none."""
    return joined.select(
        WS,
        _zero("total_revenue"),
        _zero("avg_margin"),
        _zero("total_due"),
        "labels",
        F.coalesce("lot_count", F.lit(0)).cast("bigint").alias("lot_count"),
        _zero("exposure"),
        _zero("utility_avg"),
        _zero("recurring_due"),
        _zero("top_supplier_due"),
    )


def dashboard_stats(facts: DataFrame) -> DataFrame:
    """Four stat cards per workspace."""
    col = F.col

    def card(n: int, number, value, delta, tone) -> Column:
        return F.struct(
            F.lit(n).alias("ord"),
            F.lit(V.STAT_LABELS[n - 1]).alias("label"),
            number.alias("number"),
            value.alias("value"),
            delta.alias("delta"),
            tone.alias("tone"),
        )

    revenue, margin, due, exposure = (
        col("total_revenue"), col("avg_margin"), col("total_due"), col("exposure")
    )
    cards = F.array(
        card(1, revenue, inr_short(revenue), F.lit(V.REVENUE_DELTA), rules.revenue_tone(revenue)),
        card(
            2,
            margin,
            F.format_string("%.1f%%", margin),
            F.lit(V.MARGIN_DELTA),
            rules.margin_tone(margin),
        ),
        card(
            3,
            due,
            inr_short(due),
            F.coalesce(F.nullif(col("labels"), F.lit("")), F.lit(V.NO_BILLS_DUE)),
            rules.due_tone(due),
        ),
        card(
            4,
            exposure,
            inr_short(exposure),
            F.format_string(V.EXPIRY_DELTA, col("lot_count")),
            rules.expiry_tone(col("lot_count")),
        ),
    )
    return facts.select(WS, F.inline(cards))


def inventory_alerts(workspaces: DataFrame, products: DataFrame, as_of) -> DataFrame:
    """Expiry alert of the product that expires first, and the standing cash alert."""
    first = A.soonest_expiry(products, as_of)
    expiry = first.select(
        WS,
        F.lit(1).alias("ord"),
        F.concat(F.lit("expiry-"), "sku").alias("id"),
        F.format_string(V.EXPIRY_ALERT_TITLE, "name").alias("title"),
        F.format_string(
            V.EXPIRY_ALERT_DETAIL, "sku", F.col("expires_on").cast("string"), "quantity_on_hand"
        ).alias("detail"),
        F.lit("warning").alias("severity"),
    )
    cash = workspaces.select(
        WS,
        F.lit(2).alias("ord"),
        F.lit(V.CASH_ALERT_ID).alias("id"),
        F.lit(V.CASH_ALERT_TITLE).alias("title"),
        F.lit(V.CASH_ALERT_DETAIL).alias("detail"),
        F.lit("info").alias("severity"),
    )
    return expiry.unionByName(cash)

"""Forecast bands and scenario tables from moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.functions.numbers import horizon_days, inr_short
from ledgerspark.operators import aggregates as A
from ledgerspark.operators.keyed import lookup_join

WS = "workspace_id"


def forecast_base(
    workspaces: DataFrame,
    sales: DataFrame,
    purchases: DataFrame,
    expenses: DataFrame,
    obligations: DataFrame,
) -> DataFrame:
    """Per workspace the base figure of every metric, 0 where there is no data."""

    def average(rows: DataFrame, date: str, name: str) -> DataFrame:
        return A.moving_average(A.daily_totals(rows, date)).withColumnRenamed("average", name)

    joined = A.per_workspace(
        workspaces,
        average(sales, "date", "sales"),
        average(purchases, "date", "purchases"),
        average(expenses, "occurred_on", "expenses"),
        A.obligation_totals(obligations).select(WS, F.col("recurring_due").alias("recurring")),
    )
    zero = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        for c in ["sales", "purchases", "expenses", "recurring"]
    }
    cash = zero["sales"] - zero["purchases"] - zero["expenses"]
    return joined.select(WS, *[v.alias(k) for k, v in zero.items()], cash.alias("cash"))


def _by_metric(metric: Column, values: dict) -> Column:
    result = None
    for name, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        result = F.when(metric == name, value) if result is None else result.when(metric == name, value)
    return result


def forecast(requests: DataFrame, base: DataFrame) -> DataFrame:
    """Band per request (metric, horizon); an unknown metric is read as sales."""
    lowered = F.lower("metric")
    asked = requests.withColumns(
        {
            "metric": F.when(lowered.isin(V.METRICS), lowered).otherwise("sales"),
            "days": horizon_days(F.col("horizon")),
        }
    )
    rows = lookup_join(asked, base, [WS], ["request_id"], "inner")
    metric, days = F.col("metric"), F.col("days")
    figure = _by_metric(metric, {m: F.col(m) for m in V.METRICS})
    factors = V.FORECAST_FACTORS
    low = figure * _by_metric(metric, {m: f[0] for m, f in factors.items()})
    high = figure * _by_metric(
        metric,
        {
            m: F.when(days <= V.SHORT_HORIZON_DAYS, F.lit(f[1])).otherwise(F.lit(f[2]))
            for m, f in factors.items()
        },
    )
    span = F.when(
        metric == "recurring", F.format_string("in next %d days", days)
    ).otherwise("per day")
    return rows.select(
        WS,
        "request_id",
        "metric",
        F.concat(days.cast("string"), F.lit("d")).alias("horizon"),
        figure.alias("base"),
        low.alias("low"),
        high.alias("high"),
        F.concat(_by_metric(metric, V.FORECAST_BASELINES), inr_short(figure)).alias("baseline"),
        F.concat(inr_short(low), F.lit(" to "), inr_short(high), F.lit(" "), span).alias(
            "projected_range"
        ),
        F.array(*[F.lit(a) for a in V.FORECAST_ASSUMPTIONS]).alias("assumptions"),
        _by_metric(
            metric, {m: F.array(*map(F.lit, w)) for m, w in V.FORECAST_WARNINGS.items()}
        ).alias("warnings"),
    )


def scenario_plans(requests: DataFrame, base: DataFrame) -> DataFrame:
    """One row per request: summary, two deltas and recommendations.

    An unknown scenario is read as a rent or electricity increase.
    """
    kind = F.when(
        F.col("scenario_type").isin(list(V.SCENARIOS)), F.col("scenario_type")
    ).otherwise("rent_electricity_increase")
    figures = base.select(WS, "sales", "cash")
    rows = lookup_join(requests, figures, [WS], ["request_id"], "inner")
    percent = F.col("percentage")

    def wording(text: str) -> Column:
        if text.startswith("@"):
            metric = text[1:]
            return F.concat(F.lit(V.FORECAST_BASELINES[metric]), inr_short(F.col(metric)))
        return F.format_string(text, percent) if "%" in text else F.lit(text)

    deltas, summaries, advice = {}, {}, {}
    for name, plan in V.SCENARIOS.items():
        deltas[name] = F.array(
            *[
                F.struct(
                    F.lit(i).alias("ord"),
                    F.lit(metric).alias("metric"),
                    wording(baseline).alias("baseline"),
                    wording(projected).alias("projected"),
                    F.lit(impact).alias("impact"),
                )
                for i, (metric, baseline, projected, impact) in enumerate(plan["deltas"], 1)
            ]
        )
        summaries[name] = wording(plan["summary"])
        advice[name] = F.array(*map(F.lit, plan["recommendations"]))
    return rows.select(
        *requests.columns,
        _by_metric(kind, summaries).alias("summary"),
        _by_metric(kind, deltas).alias("deltas"),
        _by_metric(kind, advice).alias("recommendations"),
    )


def scenario_deltas(requests: DataFrame, base: DataFrame) -> DataFrame:
    """Two delta rows per scenario request."""
    return scenario_plans(requests, base).select(WS, "request_id", F.inline("deltas"))


def valid_scenarios(requests: DataFrame) -> DataFrame:
    """Requests within the accepted horizon and percentage."""
    return requests.filter(
        F.col("horizon_days").between(V.MIN_HORIZON_DAYS, V.MAX_HORIZON_DAYS)
        & F.col("percentage").between(0, 100)
    )

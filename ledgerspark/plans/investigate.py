"""Evidence tables for batches of business questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.functions import rules, text
from ledgerspark.functions.numbers import grouped, inr_short
from ledgerspark.operators import aggregates as A
from ledgerspark.operators import documents as D
from ledgerspark.operators.keyed import lookup_join

WS = "workspace_id"


def classify(questions: DataFrame, guard_mode: str = "substring") -> DataFrame:
    """Questions with refusal flag, task class and insight route."""
    q = F.col("question")
    return questions.withColumns(
        {
            "refused": text.is_blocked(q, guard_mode),
            "task": text.task_class(q),
            "route": text.insight_route(q),
        }
    )


def insight_texts(workspaces: DataFrame, sales: DataFrame, expenses: DataFrame) -> DataFrame:
    """Sentence per workspace and route, from the three largest skus / categories."""

    def sentence(top: DataFrame, name: str, amount: str, wording: str, empty: str, out: str):
        part = F.concat(F.col(name), F.lit(" ("), inr_short(F.col(amount)), F.lit(")"))
        joined = top.groupBy(WS).agg(
            F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))).alias("parts")
        )
        listed = F.array_join(F.transform("parts", lambda p: p["part"]), ", ")
        return workspaces.select(WS).join(joined, WS, "left").select(
            WS,
            F.when(F.col("parts").isNull(), F.lit(empty))
            .otherwise(F.format_string(wording, listed))
            .alias(out),
        )

    products = sentence(
        A.top_skus(sales), "sku", "revenue",
        V.TOP_PRODUCTS_INSIGHT, V.NO_SALES_INSIGHT, "top_products",
    )
    costs = sentence(
        A.top_categories(expenses), "category", "expense_total",
        V.TOP_EXPENSES_INSIGHT, V.NO_EXPENSES_INSIGHT, "top_expenses",
    )
    return products.join(costs, WS)


def _evidence(label, detail, source) -> Column:
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        col(label).alias("label"), col(detail).alias("detail"), col(source).alias("source")
    )


def investigate(
    questions: DataFrame,
    facts: DataFrame,
    insights: DataFrame,
    settings: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    k: int = 2,
    guard_mode: str = "substring",
) -> DataFrame:
    """One row per question: summary, confidence, provider, cost and evidence list.

    ``chunks`` carry their vectors. Evidence is at most three facts, one insight and
    ``k`` citations per question.
    """
    asked = classify(questions, guard_mode)
    open_questions = asked.filter(~F.col("refused"))
    nearest = D.nearest_chunks(D.embed(open_questions, "question"), chunks, k)
    cited = (
        D.citations(nearest, chunks, documents)
        .groupBy(WS, "question_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("ord", "label", "detail", "source"))).alias("c")
        )
        .select(
            WS,
            "question_id",
            F.transform("c", lambda x: _evidence(x["label"], x["detail"], x["source"])).alias(
                "citations"
            ),
        )
    )
    per_workspace = facts.join(insights, WS, "left").join(settings, WS, "left")
    rows = lookup_join(asked, per_workspace, [WS], ["question_id"], "inner").join(
        cited, [WS, "question_id"], "left"
    )

    refused, route = F.col("refused"), F.col("route")
    insight = F.when(route == "top_products", F.col("top_products")).when(
        route == "top_expenses", F.col("top_expenses")
    )
    mode = F.coalesce("mode", F.lit("local-open"))
    names = F.coalesce("providers", F.array().cast("array<string>"))
    provider = rules.choose_provider(mode, F.col("task"), names)
    has_citations = F.coalesce(F.size("citations") > 0, F.lit(False))
    label, wording, source = V.UTILITY_EVIDENCE
    utility = _evidence(label, F.format_string(wording, grouped(F.col("utility_avg"))), source)
    label, wording, source = V.SUPPLIER_EVIDENCE
    supplier = _evidence(
        label, F.format_string(wording, grouped(F.col("top_supplier_due"))), source
    )
    label, wording, source = V.EXPIRY_EVIDENCE
    expiry = _evidence(label, F.format_string(wording, F.col("lot_count")), source)
    label, source = V.INSIGHT_EVIDENCE
    evidence = F.concat(
        F.array(utility, supplier, expiry),
        F.array_compact(F.array(F.when(insight.isNotNull(), _evidence(label, insight, source)))),
        F.coalesce("citations", F.array().cast("array<struct<label:string,detail:string,source:string>>")),
    )
    summary = F.when(F.col("avg_margin") < V.MARGIN_PRESSURE, V.SUMMARY_ELEVATED).otherwise(
        F.format_string(V.SUMMARY_STEADY, inr_short(F.col("total_revenue")))
    )

    def texts(values: list[str]) -> Column:
        return F.array(*map(F.lit, values))

    def unless_refused(value, refusal) -> Column:
        return F.when(refused, refusal).otherwise(value)

    return rows.select(
        WS,
        "question_id",
        "question",
        "refused",
        unless_refused(F.col("task"), F.lit(None)).alias("task"),
        unless_refused(summary, V.REFUSAL_SUMMARY).alias("summary"),
        unless_refused(
            rules.confidence(has_citations, insight.isNotNull()), V.REFUSAL_CONFIDENCE
        ).alias("confidence"),
        unless_refused(evidence, F.array(_evidence(*V.REFUSAL_EVIDENCE))).alias("evidence"),
        unless_refused(texts(V.INVESTIGATION_RISKS), texts(V.REFUSAL_RISKS)).alias("risks"),
        unless_refused(
            texts(V.INVESTIGATION_RECOMMENDATIONS), texts(V.REFUSAL_RECOMMENDATIONS)
        ).alias("recommendations"),
        unless_refused(provider, V.REFUSAL_PROVIDER).alias("provider"),
        unless_refused(mode, "local-open").alias("mode"),
        unless_refused(
            rules.cost_usd(F.col("task"), provider, F.length("question")), 0.0
        ).alias("estimated_cost_usd"),
    )


def evidence_rows(results: DataFrame) -> DataFrame:
    """Evidence in long form, ``ord`` from 1 per question."""
    return results.select(
        WS, "question_id", F.posexplode("evidence").alias("pos", "e")
    ).select(WS, "question_id", (F.col("pos") + 1).alias("ord"), "e.label", "e.detail", "e.source")

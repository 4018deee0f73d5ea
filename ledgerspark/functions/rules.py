"""Enumeration, ranking, provider and tone rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V


def one_of(value: Column, allowed: list[str], fallback: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(fallback)


def obligation_status(value: Column) -> Column:
    return one_of(value, V.OBLIGATION_STATUSES, "scheduled")


def recurrence(value: Column) -> Column:
    return one_of(value, V.RECURRENCES, "monthly")


def provider_mode(value: Column) -> Column:
    return one_of(value, V.PROVIDER_MODES, "local-open")


def action_status(value: Column) -> Column:
    return one_of(F.lower(F.trim(value)), V.ACTION_STATUSES, "watching")


def member_role(value: Column) -> Column:
    """The role itself, or NULL when it is not a known one."""
    return F.when(value.isin(V.ROLES), value)


def position(value: Column, ordered: list[str], otherwise: int) -> Column:
    rank = F.lit(otherwise)
    for i, name in reversed(list(enumerate(ordered))):
        rank = F.when(value == name, i).otherwise(rank)
    return rank


def obligation_rank(status: Column) -> Column:
    """due, scheduled, paid; an unknown status sorts with scheduled."""
    return position(status, V.OBLIGATION_STATUSES, 1)


def action_rank(status: Column) -> Column:
    return position(status, V.ACTION_STATUSES[:3], 3)


def role_rank(role: Column) -> Column:
    """1 accountant, 2 manager, 3 owner, 0 unknown."""
    return position(role, V.ROLES, -1) + 1


def unpaid(status: Column) -> Column:
    return status != "paid"


def provider_list(names: Column) -> Column:
    """Trimmed, lower-cased names in first-seen order, without blanks or repeats."""
    cleaned = F.transform(
        F.coalesce(names, F.array().cast("array<string>")), lambda n: F.lower(F.trim(n))
    )
    return F.array_distinct(F.filter(cleaned, lambda n: n.isNotNull() & (n != "")))


def choose_provider(mode: Column, task: Column, providers: Column) -> Column:
    """Label of the provider that a question of this class is routed to."""
    first = F.try_element_at(providers, F.lit(1))
    last = F.try_element_at(providers, F.lit(-1))
    investigate = task == "investigate"
    cloud = F.when(
        investigate, F.coalesce(first, F.lit(V.CLOUD_INVESTIGATE_PROVIDER))
    ).otherwise(F.coalesce(last, F.lit(V.CLOUD_OTHER_PROVIDER)))
    hybrid = F.when(investigate, F.coalesce(first, F.lit(V.LOCAL_PROVIDER))).otherwise(
        V.LOCAL_PROVIDER
    )
    return (
        F.when(mode == "local-open", V.LOCAL_PROVIDER)
        .when(mode == "byo-cloud", cloud)
        .otherwise(hybrid)
    )


def cost_usd(task: Column, provider: Column, chars: Column) -> Column:
    base = F.lit(0.001)
    for name, value in V.COST_BASE.items():
        base = F.when(task == name, value).otherwise(base)
    units = F.greatest(chars, F.lit(V.COST_MIN_CHARS)) / V.COST_CHARS_PER_UNIT
    return F.when(provider == V.LOCAL_PROVIDER, 0.0).otherwise(F.round(base * units, 6))


def confidence(has_citations: Column, has_insight: Column) -> Column:
    total = (
        F.lit(V.CONFIDENCE_BASE)
        + F.when(has_citations, V.CONFIDENCE_CITATIONS).otherwise(0.0)
        + F.when(has_insight, V.CONFIDENCE_INSIGHT).otherwise(0.0)
    )
    return F.least(F.round(total, 2), F.lit(V.CONFIDENCE_CAP))


def revenue_tone(revenue: Column) -> Column:
    return F.when(revenue > 0, "positive").otherwise("neutral")


def margin_tone(margin: Column) -> Column:
    return F.when(margin < V.MARGIN_TARGET, "warning").otherwise("positive")


def due_tone(total: Column) -> Column:
    return F.when(total != 0, "critical").otherwise("neutral")


def expiry_tone(lots: Column) -> Column:
    return F.when(lots > 0, "warning").otherwise("neutral")

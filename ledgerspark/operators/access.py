"""Membership listing and role changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import rules
from ledgerspark.operators.keyed import first_per_key, last_before, lookup_join, order_blocks
from ledgerspark.session import stored

WS = "workspace_id"


def viewing_rights(members: DataFrame, requests: DataFrame) -> DataFrame:
    """Per (workspace, requester) whether the requester may list the members."""
    asked = requests.select(WS, "requester_id").distinct()
    roles = members.select(WS, F.col("user_id").alias("requester_id"), "role")
    allowed = F.coalesce(rules.role_rank(F.col("role")) >= 2, F.lit(False))
    return asked.join(roles, [WS, "requester_id"], "left").select(
        WS, "requester_id", allowed.alias("allowed")
    )


def visible_members(members: DataFrame, requests: DataFrame) -> DataFrame:
    """Members of every workspace that one of its requesters may list.

    The listing is kept once per workspace; ``viewing_rights`` says who may see it, so a
    batch of requesters does not multiply it.
    """
    open_to = (
        viewing_rights(members, requests).filter("allowed").select(WS).distinct()
    )
    return lookup_join(members, open_to, [WS], ["user_id"], "inner").select(
        WS,
        "user_id",
        F.coalesce(rules.member_role(F.col("role")), F.lit("accountant")).alias("role"),
        "created_at",
    )


def _static_fault(member: Column) -> Column:
    """What is wrong with a request whoever makes it; NULL if nothing is."""
    role = rules.member_role(F.col("role"))
    demoting_self = (F.col("requester_id") == F.col("user_id")) & (role != "owner")
    return (
        F.when(role.isNull(), "invalid_role")
        .when(demoting_self, "self_demotion")
        .when(member.isNull(), "member_not_found")
    )


def judge_role_changes(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Outcome per change request, all judged against the membership before the batch."""
    requester = members.select(
        WS, F.col("user_id").alias("requester_id"), F.col("role").alias("_requester_role")
    )
    target = members.select(WS, "user_id", F.lit(1).alias("_member"))
    known = lookup_join(changes, requester, [WS, "requester_id"], ["change_id"], only_used=True)
    known = lookup_join(known, target, [WS, "user_id"], ["change_id"], only_used=True)
    owner = F.coalesce(F.col("_requester_role") == "owner", F.lit(False))
    outcome = F.when(~owner, "not_owner").otherwise(F.coalesce(_static_fault(F.col("_member")), F.lit("applied")))
    return known.withColumn("outcome", outcome).drop("_requester_role", "_member")


def judge_in_order(members: DataFrame, changes: DataFrame, rows_per_block: int = 1_000_000) -> DataFrame:
    """Outcome per change request, each judged against what the changes before it left.

    Changes of a workspace follow each other by ``change_id``, which is unique there. A change is
    settled once the last change before it that concerns its requester is, so the work
    goes in rounds over the open changes only, as many as the longest chain of people who
    decide about each other. Requests that nobody could make, and an owner naming
    themselves owner, change nobody's rights and stand in nobody's way. Each round looks back
    over blocks of the order, so neither a busy requester nor a busy target is one task.
    """
    target = members.select(WS, "user_id", F.lit(1).alias("_member"))
    known = lookup_join(changes, target, [WS, "user_id"], ["change_id"], only_used=True)
    known = known.withColumn("_fault", _static_fault(F.col("_member"))).drop("_member")
    owners = members.filter(F.col("role") == "owner").select(
        WS, F.col("user_id").alias("requester_id"), F.lit(True).alias("_first")
    )
    known = lookup_join(known, owners, [WS, "requester_id"], ["change_id"], only_used=True)
    known = known.withColumn("_first", F.coalesce("_first", F.lit(False)))

    person = [WS, "person"]
    no_truth = F.lit(None).cast("boolean")
    counts = F.col("_fault").isNull() & (F.col("requester_id") != F.col("user_id"))
    moved = known.filter(counts).select(WS, F.col("user_id").alias("requester_id")).distinct()
    moved = moved.withColumn("_moved", F.lit(True))
    known = stored(lookup_join(known, moved, [WS, "requester_id"], ["change_id"]), "role-changes")
    # a change by someone whom no change concerns is settled by the members alone
    effects = known.filter(counts).select(
        WS,
        F.col("user_id").alias("person"),
        "change_id",
        (F.col("role") == "owner").alias("makes_owner"),
        F.when(F.col("_moved").isNull(), F.col("_first")).alias("verdict"),
        no_truth.alias("first"),
    )
    waiting = known.filter("_moved").select(
        WS,
        F.col("requester_id").alias("person"),
        "change_id",
        no_truth.alias("makes_owner"),
        no_truth.alias("verdict"),
        F.col("_first").alias("first"),
    )
    effects = effects.filter(F.coalesce("verdict", F.lit(True)))
    timeline = stored(effects.unionByName(waiting), "role-timeline")
    timeline = order_blocks(timeline, "change_id", "block", rows_per_block)

    is_effect = F.col("makes_owner").isNotNull()
    seen = F.when(is_effect, F.struct("makes_owner", "verdict"))
    settled: list[DataFrame] = []
    while True:
        looked = last_before(timeline.withColumn("_seen", seen), person, "change_id", "_seen", "block", "before")
        looked = stored(looked.drop("_seen"), "role-round")
        before = F.col("before")
        owner = F.when(before.isNull(), F.col("first")).when(before["verdict"], before["makes_owner"])
        now = looked.filter(~is_effect & owner.isNotNull())
        settled.append(now.select(WS, "change_id", owner.alias("verdict")))
        still = looked.filter(~is_effect & owner.isNull())
        if still.isEmpty():
            break
        if now.isEmpty():
            raise ValueError("change_id is not unique in a workspace")
        # refused changes leave the timeline, and so do people whom no open change waits for
        open_people = still.select(*person).distinct()
        judged = looked.filter(is_effect).join(open_people, person, "left_semi").drop("before")
        judged = judged.join(settled[-1].withColumnRenamed("verdict", "_now"), [WS, "change_id"], "left")
        judged = judged.withColumn("verdict", F.coalesce("verdict", "_now")).drop("_now")
        judged = judged.filter(F.coalesce("verdict", F.lit(True)))
        timeline = still.drop("before").unionByName(judged)

    verdicts = reduce(DataFrame.unionByName, settled)
    owner = F.coalesce(F.col("verdict"), F.col("_first"))
    outcome = F.when(~owner, "not_owner").otherwise(F.coalesce("_fault", F.lit("applied")))
    return known.join(verdicts, [WS, "change_id"], "left").select(*changes.columns, outcome.alias("outcome"))


def apply_role_changes(members: DataFrame, judged: DataFrame) -> DataFrame:
    """Membership after the applied changes; the last change of a member wins."""
    applied = judged.filter(F.col("outcome") == "applied")
    last = first_per_key(applied, [WS, "user_id"], [F.col("change_id").desc()]).select(
        WS, "user_id", F.col("role").alias("_role")
    )
    return (
        members.join(last, [WS, "user_id"], "left")
        .withColumn("role", F.coalesce("_role", "role"))
        .select(*members.columns)
    )

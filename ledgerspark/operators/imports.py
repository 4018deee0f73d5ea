"""Import pipeline: header mapping, row normalisation, preview, coercion, confirmation.

An uploaded row carries ``headers``, the header list of its file, and ``payload``, a map
from canonical field to text. So files of different layouts share one frame, and no column
is ever type-guessed. The mapping of a layout is settled when the plan is built; per row
only plain column expressions run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.functions import numbers, rules
from ledgerspark.functions.text import strip
from ledgerspark.operators.keyed import match_rows, number_in_groups

MONEY_FIELDS = ["amount_inr", "unit_price_inr", "margin_pct"]


def canonical_field(import_type: str, header: str) -> str:
    """Field that a header of a known layout maps to, or the mark for manual review."""
    alias = header.strip().lower().replace(" ", "_")
    return V.HEADER_ALIASES.get(import_type, {}).get(alias, V.REVIEW_MANUALLY)


def payload_of(import_type: str, cells: dict[str, Column]) -> Column:
    """Text per canonical field of a row whose cells are given by header.

    Empty cells and headers left to manual review go; of two headers that map to one
    field, the later non-empty cell wins.
    """
    sources: dict[str, list[Column]] = {}
    for header, cell in cells.items():
        target = canonical_field(import_type, header)
        if target != V.REVIEW_MANUALLY:
            text = _cell_text(target, cell.cast("string"))
            sources.setdefault(target, []).insert(0, F.when(cell != "", text))
    if not sources:
        return F.create_map().cast("map<string,string>")
    every = F.map_from_arrays(
        F.array(*[F.lit(target) for target in sources]),
        F.array(*[F.coalesce(*texts) for texts in sources.values()]),
    )
    return F.map_filter(every, lambda _, value: value.isNotNull())


def field_places(import_type: str, headers: Column) -> Column:
    """Where each field of an import type stands in rows of a layout: field to cell numbers from 0.

    The cell to take comes first, the ones that stand in for an empty one follow: of two headers
    that map to one field the later is taken first, of headers that are spelled the same
    only the last counts.
    """
    fields = sorted(set(V.HEADER_ALIASES.get(import_type, {}).values()))
    if not fields:
        return F.create_map().cast("map<string,array<int>>")
    aliases = F.create_map(*[F.lit(t) for pair in V.HEADER_ALIASES[import_type].items() for t in pair])
    numbered = F.transform(
        headers,
        lambda header, at: F.struct(
            map_header(aliases, header).alias("field"),
            (F.array_position(headers, header) == at + 1).alias("first"),
            (F.size(headers) - F.array_position(F.reverse(headers), header)).cast("int").alias("last"),
        ),
    )

    def places(field: str) -> Column:
        named = F.filter(numbered, lambda h: (h["field"] == field) & h["first"])
        return F.reverse(F.transform(named, lambda h: h["last"]))

    every = F.map_from_arrays(
        F.array(*[F.lit(field) for field in fields]), F.array(*[places(field) for field in fields])
    )
    return F.map_filter(every, lambda _, found: F.size(found) > 0)


def payload_at(import_type: str, cells: Column, places: Column) -> Column:
    """Text per canonical field of a row of ``cells``, as ``payload_of`` with places per layout."""
    fields = sorted(set(V.HEADER_ALIASES.get(import_type, {}).values()))
    if not fields:
        return F.create_map().cast("map<string,string>")

    def text(field: str) -> Column:
        given = F.transform(F.try_element_at(places, F.lit(field)), lambda at: F.get(cells, at))
        return _cell_text(field, F.get(F.filter(given, lambda cell: cell != ""), F.lit(0)))

    every = F.map_from_arrays(
        F.array(*[F.lit(field) for field in fields]), F.array(*[text(field) for field in fields])
    )
    return F.map_filter(every, lambda _, value: value.isNotNull())


def _cell_text(target: str, cell: Column) -> Column:
    """Cell as stored: fractions in money fields rounded to two places."""
    if target not in MONEY_FIELDS:
        return cell
    rounded = F.round(cell.try_cast("decimal(38,6)"), 2).cast("decimal(38,2)").cast("string")
    return F.when(cell.rlike(r"^[+-]?\d*\.\d+$"), F.coalesce(rounded, cell)).otherwise(cell)


def _aliases_of(import_type: Column) -> Column:
    """Constant map header -> canonical field of an import type, NULL for an unknown one."""
    kinds = [
        part
        for kind, aliases in V.HEADER_ALIASES.items()
        for part in (
            F.lit(kind),
            F.create_map(*[F.lit(text) for pair in aliases.items() for text in pair]),
        )
    ]
    return F.try_element_at(F.create_map(*kinds), import_type)


def map_header(aliases: Column, header: Column) -> Column:
    """Canonical field of a header, or the mark for manual review."""
    alias = F.replace(F.lower(strip(header)), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(aliases, alias), F.lit(V.REVIEW_MANUALLY))


def header_mappings(uploads: DataFrame) -> DataFrame:
    """One row per job and header: position in the file and canonical field.

    Rows are reduced to the distinct header lists of each job before headers are unfolded.
    """
    key = ["workspace_id", "job_id", "import_type"]
    return (
        uploads.select(*key, "headers")
        .distinct()
        .select(*key, F.posexplode("headers").alias("pos", "header"))
        .groupBy(*key, "header")
        .agg(F.min("pos").alias("position"))
        .withColumn("target", map_header(_aliases_of(F.col("import_type")), F.col("header")))
    )


def staged_rows(uploads: DataFrame, order: list[str], blocks: list[Column | str]) -> DataFrame:
    """Payload rows with ``row_index`` from 0 per job, in upload order.

    Rows that keep no field are left out before the numbering. ``blocks`` never fall along
    ``order``; for files the part of the file is one (``files.UPLOAD_BLOCKS``). The uploads are read twice.
    """
    rows = uploads.filter(F.size("payload") > 0).select(
        "workspace_id", "job_id", "import_type", *order, "payload"
    )
    job = ["workspace_id", "job_id"]
    return number_in_groups(rows, job, order, "row_index", blocks).drop(*order)


def preview(uploads: DataFrame) -> DataFrame:
    """Quality report per job: row count, columns, mapping and warnings.

    Lists hold one entry per distinct header of a file, never one per row.
    """
    counts = uploads.groupBy("workspace_id", "job_id", "import_type", "filename").agg(
        F.count("*").alias("row_count")
    )
    key = ["workspace_id", "job_id", "import_type"]
    # one row per job: its distinct header lists, then each header once, at its first place
    lists = uploads.select(*key, "headers").distinct().groupBy(*key).agg(F.collect_list("headers").alias("lists"))
    placed = F.flatten(
        F.transform("lists", lambda one: F.transform(one, lambda h, at: F.struct(at.alias("position"), h.alias("header"))))
    )
    lists = lists.select(*key, F.array_sort(placed).alias("placed"))
    names = F.transform("placed", lambda p: p["header"])
    once = F.array_distinct(names)
    headers = lists.select(*key, once.alias("names")).filter(F.size("names") > 0)
    aliases = _aliases_of(F.col("import_type"))
    headers = headers.select(
        *key,
        F.transform(
            "names", lambda h: F.struct(h.alias("header"), map_header(aliases, h).alias("target"))
        ).alias("h"),
    )
    required = F.create_map(
        *[
            x
            for kind, fields in V.REQUIRED_FIELDS.items()
            for x in (F.lit(kind), F.array(*[F.lit(f) for f in fields]))
        ]
    )
    targets = F.transform("h", lambda x: x["target"])
    manual = F.array_sort(
        F.transform(
            F.filter("h", lambda x: x["target"] == V.REVIEW_MANUALLY), lambda x: x["header"]
        )
    )
    missing = F.array_sort(
        F.array_except(
            F.coalesce(
                F.try_element_at(required, F.col("import_type")),
                F.array().cast("array<string>"),
            ),
            targets,
        )
    )
    report = headers.select(
        "workspace_id",
        "job_id",
        "import_type",
        F.transform("h", lambda x: x["header"]).alias("columns"),
        F.map_from_arrays(F.transform("h", lambda x: x["header"]), targets).alias(
            "inferred_mappings"
        ),
        F.array_compact(
            F.array(
                F.when(
                    F.size(manual) > 0,
                    F.concat(F.lit(V.MANUAL_WARNING), F.array_join(manual, ", ")),
                ),
                F.when(
                    F.size(missing) > 0,
                    F.concat(F.lit(V.MISSING_WARNING), F.array_join(missing, ", ")),
                ),
            )
        ).alias("warnings"),
    )
    return counts.join(report, ["workspace_id", "job_id", "import_type"])


def jobs_of(uploads: DataFrame, created_at) -> DataFrame:
    """Pending job rows of a set of uploads."""
    return preview(uploads).select(
        "workspace_id",
        "job_id",
        "import_type",
        "filename",
        "row_count",
        "inferred_mappings",
        "warnings",
        F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("applied_count"),
        F.array().cast("array<string>").alias("affected_collections"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("confirmed_at"),
    )


def coerce_rows(rows: DataFrame, import_type: str, as_of) -> DataFrame:
    """Staged payloads of one collection as typed ledger rows, with its defaults.

    A date that is present but is no calendar day, and an amount or count that does not
    fit its column, give NULL; ``split_valid`` rejects them. A margin that does not fit is
    set to the largest that does, which is out of range as well.
    """
    day = F.lit(as_of).cast("date")

    def text(field: str, default) -> Column:
        return F.coalesce(F.col("payload")[field], default)

    def date(field: str, default) -> Column:
        value = F.col("payload")[field]
        return F.when(value.isNull(), default).otherwise(numbers.iso_date(value)).cast("date")

    def money(field: str) -> Column:
        return numbers.to_money(F.col("payload")[field])

    def integer(field: str, default: int) -> Column:
        return numbers.to_int(F.col("payload")[field], default)

    sku = text("sku", F.lit(V.DEFAULT_SKU))
    if import_type == "sales":
        margin = F.col("payload")["margin_pct"]
        percent = numbers.to_double(margin)
        fields = {
            "date": date("date", day),
            "sku": sku,
            "name": F.col("payload")["name"],
            "category": F.col("payload")["category"],
            "quantity": integer("quantity", 1),
            "amount_inr": money("amount_inr"),
            "margin_pct": F.when(margin.isNull(), F.lit(None))
            .when(percent >= 9999.995, F.lit("9999.99"))
            .when(percent <= -9999.995, F.lit("-9999.99"))
            .otherwise(numbers.to_money(margin))
            .cast("decimal(6,2)"),
        }
    elif import_type == "purchases":
        fields = {
            "date": date("date", day),
            "supplier_name": text("supplier_name", F.lit(V.DEFAULT_SUPPLIER)),
            "sku": sku,
            "quantity": integer("quantity", 1),
            "amount_inr": money("amount_inr"),
        }
    elif import_type == "products":
        bare = F.trim(text("sku", F.lit("")))
        rows = rows.filter(bare != "")
        fields = {
            "sku": bare,
            "name": text("name", bare),
            "category": text("category", F.lit(V.DEFAULT_PRODUCT_CATEGORY)),
            "unit_price_inr": money("unit_price_inr"),
            "quantity_on_hand": integer("quantity_on_hand", 0),
            "expires_on": date("expires_on", F.lit(None)),
        }
    elif import_type == "expenses":
        fields = {
            "occurred_on": date("occurred_on", day),
            "label": text("label", F.lit(V.DEFAULT_EXPENSE_LABEL)),
            "category": text("category", F.lit(V.DEFAULT_CATEGORY)),
            "amount_inr": money("amount_inr"),
        }
    elif import_type == "recurring_obligations":
        fields = {
            "label": text("label", F.lit(V.DEFAULT_OBLIGATION_LABEL)),
            "category": text("category", F.lit(V.DEFAULT_CATEGORY)),
            "amount_inr": money("amount_inr"),
            "due_date": date("due_date", day),
            "recurrence": rules.recurrence(F.col("payload")["recurrence"]),
            "status": rules.obligation_status(F.col("payload")["status"]),
        }
    else:
        raise ValueError(f"unknown import type: {import_type}")
    key = ["workspace_id", "job_id", "row_index"]
    return rows.select(*key, *[c.alias(name) for name, c in fields.items()])


# collection -> reason code -> condition that breaks the rule
def _entry_rules(collection: str, columns: list[str]) -> dict[str, Column]:
    col = F.col
    checks = {}
    for name in ["date", "occurred_on", "due_date"]:
        if name in columns:
            checks[f"bad_{name}"] = col(name).isNull()
    for name in ["quantity", "quantity_on_hand", "amount_inr", "unit_price_inr"]:
        if name in columns:
            checks[f"{name.removesuffix('_inr')}_out_of_range"] = col(name).isNull()
    if "quantity" in columns:
        checks["quantity_below_1"] = col("quantity") < 1
    if "amount_inr" in columns:
        checks["negative_amount"] = col("amount_inr") < 0
    if "margin_pct" in columns:
        checks["margin_out_of_range"] = ~col("margin_pct").between(0, 100)
    if collection == "recurring_obligations":
        checks["unknown_recurrence"] = ~col("recurrence").isin(V.RECURRENCES)
        checks["unknown_status"] = ~col("status").isin(V.OBLIGATION_STATUSES)
    return checks


def with_reasons(entries: DataFrame, collection: str) -> DataFrame:
    """Entries with ``reasons``, the codes of the rules they break."""
    checks = _entry_rules(collection, entries.columns)
    codes = [F.when(broken, F.lit(code)) for code, broken in checks.items()]
    return entries.withColumn("reasons", F.array_compact(F.array(*codes)))


def split_valid(entries: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """Accepted entries, and rejected ones with their reasons; together the input."""
    checked = with_reasons(entries, collection)
    return (
        checked.filter(F.size("reasons") == 0).drop("reasons"),
        checked.filter(F.size("reasons") > 0),
    )


def affected_collections(import_type: Column) -> Column:
    return F.array_compact(
        F.array(
            import_type,
            F.when(import_type.isin(V.DASHBOARD_COLLECTIONS), "dashboard"),
            F.when(import_type.isin(V.ACTION_QUEUE_COLLECTIONS), "action_queue"),
        )
    )


def confirmation(jobs: DataFrame, requested: DataFrame, staged: DataFrame) -> DataFrame:
    """Outcome per requested job: confirmed, already_confirmed or missing.

    ``applied_count`` counts the staged rows of the job, also those that apply nothing.
    """
    counts = staged.groupBy("workspace_id", "job_id").agg(F.count("*").alias("_rows"))
    found = (
        requested.select("workspace_id", "job_id")
        .distinct()
        .join(jobs, ["workspace_id", "job_id"], "left")
        .join(counts, ["workspace_id", "job_id"], "left")
    )
    done = F.col("status") == "confirmed"
    known = F.col("status").isNotNull()
    return found.select(
        "workspace_id",
        "job_id",
        F.when(done, "already_confirmed")
        .when(known, "confirmed")
        .otherwise("missing")
        .alias("outcome"),
        "import_type",
        F.when(known, F.col("row_count")).otherwise(0).cast("bigint").alias("row_count"),
        F.when(done, F.col("applied_count"))
        .when(known, F.coalesce("_rows", F.lit(0)))
        .otherwise(0)
        .cast("bigint")
        .alias("applied_count"),
        F.when(done, F.col("affected_collections"))
        .when(known, affected_collections(F.col("import_type")))
        .otherwise(F.array().cast("array<string>"))
        .alias("affected_collections"),
    )


def pending_rows(jobs: DataFrame, requested: DataFrame, staged: DataFrame) -> DataFrame:
    """Staged rows of the pending requested jobs with the import type of their job.

    One job may hold a third of all rows; the rows of such a job are spread over several tasks.
    """
    job = ["workspace_id", "job_id"]
    pending = (
        jobs.filter(F.col("status") != "confirmed")
        .select(*job, "import_type")
        .join(requested.select(*job).distinct(), job, "left_semi")
    )
    return match_rows(staged.select(*job, "row_index", "payload"), pending, job, ["row_index"])


def rows_to_apply(
    jobs: DataFrame, requested: DataFrame, staged: DataFrame, import_type: str, pending: DataFrame | None = None
) -> DataFrame:
    """Staged rows of the pending requested jobs of one collection.

    ``pending`` are the ``pending_rows`` of the same tables, where they are kept for all collections.
    """
    if pending is None:
        pending = pending_rows(jobs.filter(F.col("import_type") == import_type), requested, staged)
    return pending.filter(F.col("import_type") == import_type).drop("import_type")


def confirmed_jobs(jobs: DataFrame, outcome: DataFrame, now) -> DataFrame:
    """Job table after a confirmation run."""
    done = outcome.filter(F.col("outcome") == "confirmed").select(
        "workspace_id",
        "job_id",
        F.col("applied_count").alias("_applied"),
        F.col("affected_collections").alias("_affected"),
        F.lit(1).alias("_done"),
    )
    hit = F.col("_done") == 1
    stamp = F.lit(now).cast("timestamp")
    return (
        jobs.join(done, ["workspace_id", "job_id"], "left")
        .withColumns(
            {
                "status": F.when(hit, "confirmed").otherwise(F.col("status")),
                "applied_count": F.when(hit, F.col("_applied")).otherwise(F.col("applied_count")),
                "affected_collections": F.when(hit, F.col("_affected")).otherwise(
                    F.col("affected_collections")
                ),
                "confirmed_at": F.when(hit, stamp).otherwise(F.col("confirmed_at")),
            }
        )
        .select(*jobs.columns)
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

"""Registered queries: every operator and report over the driver's whole tables.

Results are flat: money as double, dates as ISO text, lists exploded or joined to text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ledgerspark import fixed_values as V
from ledgerspark import schemas
from ledgerspark.catalog.views import AS_OF, NOW, Views, text
from ledgerspark.functions import masking, numbers, payloads, rules
from ledgerspark.functions import text as T
from ledgerspark.operators import access, documents, imports, merges, nearest, ranking
from ledgerspark.operators import aggregates as A
from ledgerspark.operators.imports import union_all
from ledgerspark.plans import actions, brief, chunk_index, confirm, dashboard, forecast, investigate, kept, ledger
from ledgerspark.session import MANY_FILES, scratch_path, stored
from ledgerspark.sources import files, tables
from ledgerspark.streaming import jobs as streams

WS = "workspace_id"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Views], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Views(spark, sf_dir))

    run.__name__ = build.__name__
    QUERIES[build.__name__] = run
    return build


def num(column: str | Column, places: int | None = None) -> Column:
    name = column if isinstance(column, str) else None
    value = (F.col(column) if name else column).cast("double")
    value = value if places is None else F.round(value, places)
    return value.alias(name) if name else value


def iso(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def joined(column: str, mark: str = "|") -> Column:
    return F.array_join(column, mark).alias(column)


def melt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Other columns as (field, value) text rows."""
    rest = [c for c in df.columns if c not in keys]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in rest]
    )
    return df.select(*keys, F.inline(pairs))


# --- imports -----------------------------------------------------------------


@query
def a1_csv_uploads(v: Views) -> DataFrame:
    """Customers as expense files of two layouts, with quotes, commas and line breaks, read back."""
    root = scratch_path(v.spark, "csv")
    label = F.concat("c_name", F.lit(' "'), "c_mktsegment", F.lit('",\nline two'))
    rows = v.table("customer").select(
        F.date_add(F.lit("2026-01-01"), (F.col("c_custkey") % 100).cast("int")).alias("day"),
        label.alias("label"),
        F.col("c_mktsegment").alias("category"),
        text(F.col("c_custkey") * 3).alias("amount"),
        (F.col("c_custkey") % 2).alias("side"),
    )
    layouts = {
        "expenses-a": (0, {"Date": "day", "label": "label", "category": "category", "amount_inr": "amount"}),
        "expenses-b": (1, {"_note": "side", "amount_inr": "amount", "Label": "label", "category": "category", "date": "day"}),
    }
    for name, (side, columns) in layouts.items():
        part = rows.filter(F.col("side") == side)
        written = part.select(*[F.col(c).cast("string").alias(h) for h, c in columns.items()])
        written.write.options(header=True, escape='"').csv(f"{root}/{name}")
    parts = []
    for name in layouts:
        uploads = files.read_uploads(v.spark, f"{root}/{name}", "w", "expenses")
        staged = imports.staged_rows(uploads, ["row_order"], files.UPLOAD_BLOCKS)
        typed = imports.coerce_rows(staged, "expenses", AS_OF)
        checked = imports.with_reasons(typed, "expenses")
        parts.append(
            checked.select(
                F.lit(name).alias("layout"), iso("occurred_on"), "label", "category",
                num("amount_inr"), joined("reasons"),
            )
        )
    return union_all(parts)


@query
def a1_mixed_layouts(v: Views) -> DataFrame:
    """Orders as sales files of ten layouts in one folder, read in one scan, with their headers."""
    root = scratch_path(v.spark, "layouts")
    order = F.col("o_orderkey")
    cells = {
        "day": F.col("o_orderdate").cast("date").cast("string"),
        "sku": F.format_string("%05d", F.col("o_custkey")).alias("sku"),
        "said": F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')).alias("said"),
        "amount": F.when(order % 4 != 0, text(order * 2)).alias("amount"),
        "other": F.when(order % 3 != 0, text(order)).alias("other"),
    }
    rows = v.table("orders").select(F.pmod(order, F.lit(10)).alias("layout"), *[c.alias(n) for n, c in cells.items()])
    spelled = {"day": ["Date", "DATE"], "sku": ["SKU", "sku"], "said": ["Product Name", "note, own"]}
    for n in range(10):
        names = list(cells)[n % 5 :] + list(cells)[: n % 5]
        # two headers of one field, the later counts unless empty; odd layouts lack the other amount
        heads = {name: spelled[name][n % 2] for name in spelled} | {"amount": "revenue_inr"}
        heads["other"] = "Revenue INR" if n % 2 == 0 else f"_memo {n}"
        part = rows.filter(F.col("layout") == n).select(*[F.col(c).alias(heads[c]) for c in names])
        part.write.mode("append").options(header=True, escape='"').csv(root)
    uploads = files.read_uploads(v.spark, root, "w", "sales")
    return uploads.select(
        F.array_join("headers", "|").alias("headers"),
        *[F.col("payload")[f].alias(f) for f in ["date", "sku", "name", "amount_inr"]],
        F.size("payload").cast("bigint").alias("fields"),
    )


@query
def a2_document_json(v: Views) -> DataFrame:
    """Documents written as JSON array files of twenty and read back."""
    path = scratch_path(v.spark, "json")
    entry = F.struct(
        F.concat_ws("-", "source", "doc_id").alias("title"),
        F.col("lang").alias("kind"),
        F.col("text").alias("summary"),
        F.date_add(F.lit("2026-01-01"), (F.col("doc_id") % 300).cast("int")).alias("uploadedAt"),
    )
    arrays = v.table("documents").groupBy(F.floor(F.col("doc_id") / 20)).agg(
        F.to_json(F.collect_list(entry)).alias("value")
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_document_json(v.spark, path).select(
        "title", "kind", "summary", iso("uploaded_at")
    )


@query
def a3_document_folder(v: Views) -> DataFrame:
    """Text files of two hundred ids of a source each, ingested with their summaries."""
    path = scratch_path(v.spark, "folder")
    docs = v.table("documents").withColumn("part", F.floor(F.col("doc_id") / 200))
    docs = docs.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id")
    docs.select("source", "part", "text").write.partitionBy("source", "part").text(path)
    found = files.read_documents(v.spark, path, "w", "upload", AS_OF)
    return found.select(
        "kind", "summary", F.length("content").cast("bigint").alias("n_chars"),
        F.sha2("content", 256).alias("content_sha256"),
    )


@query
def h7_file_chunks(v: Views) -> DataFrame:
    """Chunks of text files that hold the documents of a source and two hundred ids, read line by line."""
    path = scratch_path(v.spark, "split")
    docs = v.table("documents").withColumn("part", F.floor(F.col("doc_id") / 200))
    docs = docs.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id")
    docs.select("source", "part", "text").write.options(**MANY_FILES).partitionBy("source", "part").text(path)
    return files.read_document_chunks(v.spark, path, "w").select("chunk_index", "content")


@query
def a7_masked_csv(v: Views) -> DataFrame:
    """Customers as a CSV file, its masked copy read back."""
    path = f"{scratch_path(v.spark, 'people')}.csv"
    notes = F.concat(F.lit('say "'), "c_mktsegment", F.lit('", '), "c_mktsegment", F.lit("@x.example"))
    rows = v.table("customer").select(
        text("c_custkey").alias("sku"),
        F.col("c_name").alias("supplier"),
        F.when(F.col("c_custkey") % 5 != 0, F.lit("98-7")).alias("phone"),
        notes.alias("notes"),
    )
    rows.write.options(header=True, escape='"').csv(path)
    target = files.write_masked_csv(v.spark, path)
    return v.spark.read.options(**files.CSV, multiLine=True).csv(target)


@query
def a7_masked_json(v: Views) -> DataFrame:
    """Documents as JSON files, their masked copy read back."""
    path = f"{scratch_path(v.spark, 'papers')}.json"
    rows = v.table("documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("summary"))
    one = rows.groupBy(F.floor(F.col("doc_id") / 20)).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")
    )
    one.select("value").write.option("maxRecordsPerFile", 1).text(path)
    target = files.write_masked_json(v.spark, path, rows.schema)
    return v.spark.read.schema(rows.schema).json(target)


@query
def b14_masked_nested(v: Views) -> DataFrame:
    """Masked lists, structs and maps made of orders."""
    phone = F.when(F.col("o_orderkey") % 3 != 0, F.lit("98-7"))
    nested = v.table("orders").select(
        "o_orderkey",
        F.array("o_orderpriority", F.lit(" ")).alias("owner"),
        F.struct(F.col("o_orderstatus").alias("email"), F.col("o_custkey").cast("int").alias("qty")).alias("info"),
        F.create_map(
            F.lit("Phone"), phone, F.lit("name"), "o_orderpriority", F.lit("memo"), "o_orderstatus"
        ).alias("cells"),
    )
    masked = masking.mask_columns(nested)
    return masked.select(
        "o_orderkey",
        F.col("owner")[0].alias("owner_first"),
        F.col("info.email").alias("info_email"),
        F.col("info.qty").alias("info_qty"),
        F.col("cells")["Phone"].alias("cell_phone"),
        F.col("cells")["name"].alias("cell_name"),
        F.col("cells")["memo"].alias("cell_memo"),
    )


def _uploads(v: Views) -> DataFrame:
    """The uploaded rows, made once and read by all that numbers and reports them."""
    return stored(v.uploads(), "uploads")


@query
def a4_staged_rows(v: Views) -> DataFrame:
    """Staging sink written and read back: numbered payload rows and their jobs."""
    uploads = _uploads(v)
    staged = imports.staged_rows(uploads, v.UPLOAD_ORDER, v.upload_blocks()).drop("import_type")
    root = scratch_path(v.spark, "staging")
    tables.store_import_job(imports.jobs_of(uploads, NOW), staged, root, "upload-1")
    rows = tables.read_facts(v.spark, f"{root}/import_job_rows", schemas.IMPORT_ROWS)
    jobs = tables.read_facts(v.spark, f"{root}/import_jobs", schemas.IMPORT_JOBS)
    counts = rows.groupBy(WS, "job_id").agg(
        F.count("*").alias("staged"), F.max("row_index").alias("last_index")
    )
    return jobs.join(counts, [WS, "job_id"], "left").select(
        WS, "job_id", "import_type", "filename", "row_count", "status",
        F.coalesce("staged", F.lit(0)).cast("bigint").alias("staged"), "last_index",
    )


@query
def a4_staged_payloads(v: Views) -> DataFrame:
    """Every cell that the staging sink stored."""
    root = scratch_path(v.spark, "payloads")
    uploads = _uploads(v)
    staged = imports.staged_rows(uploads, v.UPLOAD_ORDER, v.upload_blocks()).drop("import_type")
    tables.store_import_job(imports.jobs_of(uploads, NOW), staged, root, "upload-1")
    rows = tables.read_facts(v.spark, f"{root}/import_job_rows", schemas.IMPORT_ROWS)
    return rows.select(WS, "job_id", "row_index", F.explode("payload").alias("field", "value"))


@query
def a5_fact_append(v: Views) -> DataFrame:
    """Fact sink: two batches, one of them written twice, then summed from storage."""
    path = scratch_path(v.spark, "sales")
    sales = v.sales(product=True)
    order = [WS, "date"]
    early = F.col("date") < F.lit("1998-01-01").cast("date")
    for batch, rows in [
        ("early", sales.filter(early)),
        ("late", sales.filter(~early)),
        ("late", sales.filter(~early)),
    ]:
        tables.append_batch(rows, path, batch, order)
    stored = tables.read_facts(v.spark, path, schemas.SALES)
    return stored.groupBy(WS, "category").agg(
        F.count("*").alias("row_count"), num(F.sum("amount_inr")).alias("amount_inr")
    )


def _stored_staging(v: Views) -> DataFrame:
    """Payload rows of all uploads, staged once and read by what confirms them."""
    path = scratch_path(v.spark, "rows")
    staged = imports.staged_rows(_uploads(v), v.UPLOAD_ORDER, v.upload_blocks()).drop("import_type")
    tables.append_batch(staged, path, "upload-1")
    return tables.read_facts(v.spark, path, schemas.IMPORT_ROWS)


@query
def a5_confirmed_ledgers(v: Views) -> DataFrame:
    """A whole confirmation run, repeated, then the stored ledgers per workspace."""
    root = scratch_path(v.spark, "ledgers")
    jobs = tables.VersionedTable(v.spark, f"{root}/jobs", schemas.IMPORT_JOBS)
    jobs.replace(
        v.import_jobs().withColumns(
            {
                "inferred_mappings": F.lit(None).cast("map<string,string>"),
                "warnings": F.lit(None).cast("array<string>"),
            }
        )
    )
    products = tables.VersionedTable(v.spark, f"{root}/products", schemas.PRODUCTS)
    staged = _stored_staging(v)
    for run in ["run-1", "run-2"]:
        confirm.confirm_jobs(
            v.spark, jobs, products, staged, _requested_jobs(v), root, run, AS_OF, NOW
        )
    parts = []
    for kind in V.COLLECTIONS:
        if kind == "products":
            rows = products.read().withColumn("amount_inr", F.col("unit_price_inr"))
        else:
            rows = tables.read_facts(v.spark, f"{root}/{kind}", schemas.LEDGERS[kind]["schema"])
        parts.append(
            rows.groupBy(WS).agg(
                F.lit(kind).alias("import_type"),
                F.count("*").alias("row_count"),
                num(F.sum("amount_inr")).alias("amount_inr"),
            )
        )
    return union_all(parts)


@query
def a6_versioned_products(v: Views) -> DataFrame:
    """Latest-state sink: stored products, then the version after a batch."""
    table = tables.VersionedTable(v.spark, scratch_path(v.spark, "products"), schemas.PRODUCTS)
    table.replace(v.products())
    table.replace(merges.upsert_products(table.read(), v.product_batch(), BATCH_ORDER))
    return _product_rows(table.read())


@query
def a8_adhoc_sql(v: Views) -> DataFrame:
    files.create_views({"ledger_sales": v.sales(), "ledger_expenses": v.expenses()})
    return v.spark.sql(
        """
        SELECT s.workspace_id, s.revenue, e.expense
        FROM (SELECT workspace_id, CAST(sum(amount_inr) AS DOUBLE) AS revenue
              FROM ledger_sales GROUP BY workspace_id) s
        JOIN (SELECT workspace_id, CAST(sum(amount_inr) AS DOUBLE) AS expense
              FROM ledger_expenses GROUP BY workspace_id) e
          ON s.workspace_id = e.workspace_id
        """
    )


@query
def b1_header_mapping(v: Views) -> DataFrame:
    return imports.header_mappings(v.uploads())


@query
def b2_normalised_rows(v: Views) -> DataFrame:
    staged = imports.staged_rows(_uploads(v), v.UPLOAD_ORDER, v.upload_blocks())
    return staged.select("job_id", "row_index", F.explode("payload").alias("field", "value"))


@query
def h15_json_payloads(v: Views) -> DataFrame:
    """Payloads as JSON text and back."""
    text_form = v.uploads().filter(F.size("payload") > 0).select(
        "job_id", *v.UPLOAD_ORDER[:3], payloads.to_json(F.col("payload")).alias("json")
    )
    back = payloads.map_from_json(F.col("json"))
    return text_form.select("job_id", *v.UPLOAD_ORDER[:3], F.explode(back).alias("field", "value"))


@query
def b3_import_preview(v: Views) -> DataFrame:
    return imports.preview(v.uploads()).select(
        WS, "job_id", "import_type", "filename", "row_count",
        joined("columns"), joined("warnings"),
    )


def _typed(v: Views, kind: str) -> DataFrame:
    staged = imports.staged_rows(_uploads(v), v.UPLOAD_ORDER, v.upload_blocks())
    rows = staged.filter(F.col("import_type") == kind)
    return imports.coerce_rows(rows, kind, AS_OF)


@query
def b4_coerced_sales(v: Views) -> DataFrame:
    return melt(_typed(v, "sales"), [WS, "job_id", "row_index"])


@query
def b4_coerced_purchases(v: Views) -> DataFrame:
    return melt(_typed(v, "purchases"), [WS, "job_id", "row_index"])


@query
def b4_coerced_products(v: Views) -> DataFrame:
    return melt(_typed(v, "products"), [WS, "job_id", "row_index"])


@query
def b4_coerced_expenses(v: Views) -> DataFrame:
    return melt(_typed(v, "expenses"), [WS, "job_id", "row_index"])


@query
def b4_coerced_obligations(v: Views) -> DataFrame:
    return melt(_typed(v, "recurring_obligations"), [WS, "job_id", "row_index"])


def _entries(v: Views) -> DataFrame:
    """Sales with quantity, amount and margin shifted so that some break the rules."""
    return v.sales().withColumns(
        {
            "quantity": F.col("quantity") - 3,
            "amount_inr": (F.col("amount_inr") - 5000).cast("decimal(12,2)"),
            "margin_pct": (F.col("margin_pct") * 8).cast("decimal(6,2)"),
        }
    )


@query
def b5_validated_entries(v: Views) -> DataFrame:
    valid, rejected = imports.split_valid(_entries(v), "sales")
    return valid.select("id", F.lit("").alias("reasons")).unionByName(
        rejected.select("id", joined("reasons"))
    )


@query
def b6_normalised_enums(v: Views) -> DataFrame:
    return v.table("events").select(
        "event_id",
        rules.obligation_status(
            F.when(F.col("event_type") == "purchase", "paid").otherwise(F.col("event_type"))
        ).alias("obligation_status"),
        rules.recurrence(
            F.when(F.col("event_type") == "view", "annual").otherwise(F.col("event_type"))
        ).alias("recurrence"),
        rules.provider_mode(
            F.when(F.col("event_type") == "click", "hybrid").otherwise(F.col("event_type"))
        ).alias("mode"),
        rules.action_status(
            F.when(F.col("event_type") == "signup", " Snoozed ").otherwise(F.col("event_type"))
        ).alias("action_status"),
    )


@query
def b7_tenant_totals(v: Views) -> DataFrame:
    """Tenant predicate, for every tenant at once."""
    rows = v.purchases().join(v.workspaces().select(WS), WS, "left_semi")
    return rows.groupBy(WS).agg(
        F.count("*").alias("row_count"), num(F.sum("amount_inr")).alias("amount_inr")
    )


@query
def b7_one_tenant(v: Views) -> DataFrame:
    """One tenant's purchases by supplier, from storage that keeps tenants apart."""
    path = scratch_path(v.spark, "tenants")
    tables.append_batch(v.purchases(), path, "all", [WS, "date", "id"])
    rows = tables.read_facts(v.spark, path, schemas.PURCHASES, workspace_id="7")
    return rows.groupBy(WS, "supplier_name").agg(
        F.count("*").alias("row_count"), num(F.sum("amount_inr")).alias("amount_inr")
    )


@query
def b4_manual_obligations(v: Views) -> DataFrame:
    """Orders as obligations typed in by hand: blanks around words, odd amounts, unknown values."""
    asked = v.table("orders").select(
        text(F.col("o_custkey") % 25).alias(WS),
        text("o_orderkey").alias("request_id"),
        F.concat(F.lit(" "), "o_orderpriority", F.lit("\t")).alias("label"),
        F.concat("o_orderstatus", F.lit("\n ")).alias("category"),
        (F.col("o_totalprice") / 8).alias("amount_inr"),
        F.when(F.col("o_orderkey") % 2 == 0, "annual").otherwise("weekly").alias("recurrence"),
        F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "owed").alias("status"),
    )
    entered = merges.new_obligations(asked)
    return entered.select(WS, "request_id", "label", "category", num("amount_inr"), "recurrence", "status")


@query
def h4_even_quantities(v: Views) -> DataFrame:
    """Halved quantities as whole numbers, ties to the even neighbour."""
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", numbers.int_from_double(F.col("l_quantity") / 2).alias("half")
    )


@query
def b14_masked_json(v: Views) -> DataFrame:
    """JSON objects of three shapes, written as array files, masked without a schema, read back."""
    prio, status, key = F.to_json(F.array("o_orderpriority")), F.col("o_orderstatus"), text("o_orderkey")
    bare = F.substring(prio, F.lit(2), F.length(prio) - 2)
    shapes = [
        F.format_string('{"id":%s,"info":{"email":"%s","qty":%s},"owner":[%s," "]}', key, status, key, bare),
        F.format_string('{"contacts":[{"name":%s,"phone":"98-7"},{"mobile":"x%s"}],"id":%s,"memo":"%s"}',
                        bare, key, key, status),
        F.format_string('{"id":%s,"notes":["555%s7 a","b@c.de",1234567,null,true],"title":{"sub":%s}}',
                        key, F.lpad(key, 7, "0"), bare),
    ]
    shape = F.element_at(F.array(*shapes), (F.col("o_orderkey") % 3 + 1).cast("int"))
    path = f"{scratch_path(v.spark, 'shapes')}.json"
    arrays = v.table("orders").select("o_orderkey", shape.alias("shape")).groupBy(F.floor(F.col("o_orderkey") / 1000))
    lists = arrays.agg(F.concat(F.lit("["), F.array_join(F.collect_list("shape"), ","), F.lit("]")).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    masked = v.spark.read.text(files.write_masked_json(v.spark, path))
    return masked.select(F.get_json_object("value", "$.id").cast("bigint").alias("o_orderkey"), F.col("value").alias("masked"))


@query
def b8_due_window(v: Views) -> DataFrame:
    return A.due_soon(v.obligations(), AS_OF).select(WS, "id", iso("due_date"), num("amount_inr"))


@query
def b8_due_today(v: Views) -> DataFrame:
    return A.due_today(v.obligations(), AS_OF).select(WS, "id", iso("due_date"), num("amount_inr"))


@query
def b9_near_expiry(v: Views) -> DataFrame:
    return A.near_expiry(v.products(), AS_OF).select(WS, "sku", iso("expires_on"))


@query
def b10_guarded_questions(v: Views) -> DataFrame:
    q = F.col("question")
    return v.questions().select(
        "question_id",
        T.is_blocked(q).alias("refused"),
        T.is_blocked(q, "statement").alias("refused_statement"),
    )


@query
def b11_task_classes(v: Views) -> DataFrame:
    return investigate.classify(v.questions()).select("question_id", "task")


@query
def b12_routed_insights(v: Views) -> DataFrame:
    routed = investigate.classify(v.questions()).filter(F.col("route").isNotNull())
    texts = investigate.insight_texts(v.workspaces(), v.sales(), v.expenses())
    answer = F.when(F.col("route") == "top_products", F.col("top_products")).otherwise(
        F.col("top_expenses")
    )
    return routed.join(texts, WS).select("question_id", "route", answer.alias("insight"))


@query
def b13_masked_documents(v: Views) -> DataFrame:
    return v.table("documents").select(
        "doc_id",
        masking.mask_value("notes", F.col("text")).alias("notes"),
        masking.mask_value("notes", F.col("text"), True).alias("notes_kept_numbers"),
        masking.mask_value("Title", F.concat_ws("-", "source", "doc_id")).alias("title"),
        masking.mask_value("source", F.col("source")).alias("source"),
    )


@query
def b13_masked_customers(v: Views) -> DataFrame:
    row = v.table("customer")
    return row.select(
        "c_custkey",
        masking.mask_value("name", F.col("c_mktsegment")).alias("name"),
        masking.mask_value("supplier", F.col("c_name")).alias("supplier"),
        masking.mask_value("mobile", text("c_custkey")).alias("mobile"),
        masking.mask_value("address", F.concat(F.lit(" "), "c_mktsegment")).alias("address"),
        masking.mask_value("email", F.col("c_name")).alias("email"),
        masking.mask_value("contact", F.concat("c_mktsegment", F.lit("@shop.example"))).alias(
            "contact"
        ),
        masking.mask_value("sku", F.concat(F.lit("12345"), text("c_custkey"))).alias("sku"),
    )


# --- joins and merges ----------------------------------------------------------


@query
def c1_chunk_titles(v: Views) -> DataFrame:
    docs = v.documents()
    return documents.chunk_titles(documents.document_chunks(docs), docs)


@query
def c2_load_sales(v: Views) -> DataFrame:
    """Reload of the whole sales export over an earlier load of its closed lines."""
    sales = v.sales()
    closed = v.table("lineitem").filter(F.col("l_linestatus") == "F")
    stored = _lines_as_sales(v, closed)
    key = schemas.LEDGERS["sales"]["key"]
    fresh = merges.idempotent_load(stored, sales, key, ["id"])
    return fresh.select(WS, iso("date"), "sku", num("amount_inr"), "id")


def _lines_as_sales(v: Views, lines: DataFrame) -> DataFrame:
    part_of = Views(v.spark, v.sf_dir)
    whole = v.table
    part_of.table = lambda name: lines if name == "lineitem" else whole(name)
    return part_of.sales()


@query
def c2_load_purchases(v: Views) -> DataFrame:
    """Purchases of the whole export against stored ones of some priced lines.

    The supplier is not part of the key: the same line from another one is a repeat.
    """
    rows = v.purchases()
    stored = rows.filter(F.col("amount_inr") > 250).withColumn("supplier_name", F.lit("other"))
    key = schemas.LEDGERS["purchases"]["key"]
    fresh = merges.idempotent_load(stored, rows, key, ["id"])
    return fresh.select(WS, iso("date"), "sku", "supplier_name", num("amount_inr"), "id")


@query
def c2_load_expenses(v: Views) -> DataFrame:
    rows = v.expenses()
    stored = rows.filter(F.col("category") == "Utilities")
    key = schemas.LEDGERS["expenses"]["key"]
    fresh = merges.idempotent_load(stored, rows, key, ["created_at", "id"])
    return fresh.select(WS, iso("occurred_on"), "label", num("amount_inr"), "id")


@query
def c2_load_obligations(v: Views) -> DataFrame:
    rows = v.obligations().withColumn("label", F.regexp_extract("label", "^[^-]+", 0))
    stored = rows.filter(F.col("status") == "paid")
    key = schemas.LEDGERS["recurring_obligations"]["key"]
    fresh = merges.idempotent_load(stored, rows, key, ["id"])
    return fresh.select(WS, iso("due_date"), "label", "id")


BATCH_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "unit_price_inr"]


def _product_rows(products: DataFrame) -> DataFrame:
    return products.select(
        WS, "sku", "name", "category", num("unit_price_inr"), "quantity_on_hand",
        iso("expires_on"), F.date_format("created_at", "yyyy-MM-dd").alias("created_on"),
    )


@query
def c3_upserted_products(v: Views) -> DataFrame:
    return _product_rows(merges.upsert_products(v.products(), v.product_batch(), BATCH_ORDER))


@query
def c4_upserted_documents(v: Views) -> DataFrame:
    """Documents and chunks after every English document came again with its source."""
    docs = v.documents()
    stored = documents.document_chunks(docs)
    again = docs.filter(F.col("kind") == "en").withColumns(
        {"summary": F.concat(F.lit("again "), "summary"), "kind": F.lit("update")}
    )
    merged = merges.upsert_documents(docs, again, ["document_id"])
    changed = merged.filter(F.col("kind") == "update")
    chunks = merges.replace_chunks(stored, changed, documents.document_chunks(changed))
    counts = chunks.groupBy(WS, "document_id").agg(
        F.count("*").alias("chunk_count"),
        F.sum(F.length("content")).cast("bigint").alias("chars"),
        F.min_by("content", "chunk_index").alias("first_chunk"),
    )
    return merged.join(counts, [WS, "document_id"], "left").select(
        WS, "document_id", "title", "kind", "chunk_count", "chars", "first_chunk"
    )


@query
def c5_upserted_settings(v: Views) -> DataFrame:
    saved = merges.upsert_settings(v.settings(), v.settings_saves())
    return saved.select(WS, "mode", joined("providers"))


@query
def c5_settings_defaults(v: Views) -> DataFrame:
    """Settings of every customer workspace when only saved ones exist."""
    every = v.table("customer").select(text("c_custkey").alias(WS))
    none = v.spark.createDataFrame([], schemas.PROVIDER_SETTINGS)
    saved = merges.upsert_settings(none, v.settings_saves())
    return merges.settings_for(every, saved).select(WS, "mode", joined("providers"))


def _queue(v: Views) -> DataFrame:
    return actions.action_queue(
        v.workspaces(), v.obligations(), v.import_jobs(), v.actions(), AS_OF, NOW
    )


def _action_columns() -> list:
    stamps = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ["created_at", "updated_at"]]
    return [
        WS, "id", "title", "detail", "severity", "action_type", "target_entity", "status",
        "snoozed_until", "resolution_note", *stamps,
    ]


@query
def c6_synced_actions(v: Views) -> DataFrame:
    return _queue(v).select(*_action_columns())


@query
def c6_refreshed_actions(v: Views) -> DataFrame:
    """A day's queue, then bills of some workspaces change and only their queues are synced again."""
    changes = v.status_changes("obligations").filter(F.col("workspace_id").cast("int") % 3 == 0)
    after = merges.apply_obligation_changes(v.obligations(), changes)
    touched = actions.touched_workspaces(dt.datetime(1990, 1, 1), (changes, "ts"))
    queue = actions.refreshed_queue(
        v.workspaces(), after, v.import_jobs(), stored(_queue(v), "queue"), touched, AS_OF,
        NOW + dt.timedelta(hours=1),
    )
    return queue.select(*_action_columns())


@query
def c7_latest_imports(v: Views) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in V.COLLECTIONS])
    base = v.workspaces().select(WS, F.explode(kinds).alias("import_type"))
    latest = ledger.latest_imports(v.import_jobs())
    return base.join(latest, [WS, "import_type"], "left").select(
        WS, "import_type", F.date_format("latest_import_at", "yyyy-MM-dd").alias("latest_import_on")
    )


@query
def c8_visible_members(v: Views) -> DataFrame:
    return access.visible_members(v.members(), v.member_requests()).select(
        WS, "user_id", "role", F.date_format("created_at", "yyyy-MM-dd").alias("since")
    )


@query
def c8_viewing_rights(v: Views) -> DataFrame:
    """May this customer list the members? Asked by every customer, at home and next door."""
    asked = v.table("customer").select(
        F.explode(F.array("c_nationkey", F.pmod(F.col("c_nationkey") + 1, F.lit(25)))).alias("at"),
        text("c_custkey").alias("requester_id"),
    )
    asked = asked.select(text("at").alias(WS), "requester_id")
    return access.viewing_rights(v.members(), asked)


@query
def c9_judged_role_changes(v: Views) -> DataFrame:
    return access.judge_role_changes(v.members(), v.role_changes())


@query
def c9_members_after_changes(v: Views) -> DataFrame:
    members = v.members()
    judged = access.judge_role_changes(members, v.role_changes())
    return access.apply_role_changes(members, judged).select(WS, "user_id", "role")


@query
def c9_ordered_role_changes(v: Views) -> DataFrame:
    """Role changes judged one after the other, with people who are demoted in between."""
    return access.judge_in_order(v.members(), v.role_chains())


@query
def c9_members_after_ordered_changes(v: Views) -> DataFrame:
    members = v.members()
    judged = access.judge_in_order(members, v.role_chains())
    return access.apply_role_changes(members, judged).select(WS, "user_id", "role")


def _indexed_chunks(v: Views) -> DataFrame:
    """Chunk table with vectors, written once and read by the searches."""
    path = scratch_path(v.spark, "chunks")
    documents.index_chunks(v.documents()).write.parquet(path)
    return v.spark.read.schema(schemas.CHUNKS).parquet(path)


@query
def c10_nearest_chunks(v: Views) -> DataFrame:
    questions = documents.embed(v.questions(), "question")
    found = documents.nearest_chunks(questions, _indexed_chunks(v), 3)
    return found.withColumn("distance", num("distance", 6))


@query
def c10_refreshed_index(v: Views) -> DataFrame:
    """Nearest chunks over a kept index, after the texts of a tenth of the documents changed."""
    root = scratch_path(v.spark, "index")
    docs = v.documents()
    chunk_index.refresh_index(v.spark, root, docs)
    again = F.when(F.col("document_id").endswith("3"), F.concat(F.lit("again "), "summary"))
    changed = docs.withColumn("summary", F.coalesce(again, "summary"))
    chunk_index.refresh_index(v.spark, root, changed)
    questions = documents.embed(v.questions(), "question")
    found = documents.nearest_chunks(questions, chunk_index.read_index(v.spark, root), 3)
    return found.withColumn("distance", num("distance", 6))


@query
def c10_blocked_chunks(v: Views) -> DataFrame:
    """Nearest chunks that skip the blocks out of a question's reach."""
    questions = documents.embed(v.questions(), "question")
    found, _ = nearest.nearest_in_blocks(questions, *nearest.block_chunks(_indexed_chunks(v)), 3)
    return found.withColumn("distance", num("distance", 6))


@query
def c10_citations(v: Views) -> DataFrame:
    questions = documents.embed(v.questions(), "question")
    chunks = _indexed_chunks(v)
    found = documents.nearest_chunks(questions, chunks, 2)
    return documents.citations(found, chunks, v.documents())


@query
def c10_nearest_vectors(v: Views) -> DataFrame:
    """Nearest stored vectors of every vector with the same label, itself included."""
    rows = v.table("embeddings").select(
        text("label").alias(WS),
        F.col("vec_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
    )
    questions = rows.withColumnRenamed("vec_id", "question_id")
    stored = rows.withColumnRenamed("vec_id", "document_id").withColumn(
        "chunk_index", F.lit(0)
    )
    found = documents.nearest_chunks(questions, stored, 3).drop("chunk_index")
    return found.withColumn("distance", num("distance", 6))


@query
def c11_obligation_statuses(v: Views) -> DataFrame:
    changed = merges.apply_obligation_changes(
        v.obligations(), v.status_changes("obligations")
    )
    return changed.select(WS, "id", "status")


@query
def c11_unknown_changes(v: Views) -> DataFrame:
    lost = merges.unknown_changes(v.obligations(), v.status_changes("obligations"))
    return lost.select(WS, "entity_id", "status", "change_id")


@query
def c12_action_statuses(v: Views) -> DataFrame:
    changed = merges.apply_action_changes(v.actions(), v.status_changes("actions"))
    return changed.select(*_action_columns())


def _requested_jobs(v: Views) -> DataFrame:
    jobs = v.import_jobs().select(WS, "job_id")
    strangers = v.products().select(WS, F.concat(F.lit("missing-"), "sku").alias("job_id"))
    return jobs.unionByName(strangers)


@query
def c13_confirmed_imports(v: Views) -> DataFrame:
    staged = _stored_staging(v)
    outcome = imports.confirmation(v.import_jobs(), _requested_jobs(v), staged)
    return outcome.select(
        WS, "job_id", "outcome", "import_type", "row_count", "applied_count",
        joined("affected_collections"),
    )


@query
def c13_jobs_after_confirm(v: Views) -> DataFrame:
    jobs = v.import_jobs()
    staged = _stored_staging(v)
    outcome = imports.confirmation(jobs, _requested_jobs(v), staged)
    return imports.confirmed_jobs(jobs, outcome, NOW).select(
        WS, "job_id", "status", "applied_count",
        F.date_format("confirmed_at", "yyyy-MM-dd").alias("confirmed_on"),
    )


@query
def c13_applied_rows(v: Views) -> DataFrame:
    """Rows that the pending jobs add to each collection, as day, text and amount."""
    jobs, requested = v.import_jobs(), _requested_jobs(v)
    staged = _stored_staging(v)
    shown = {
        "sales": ("date", "sku", "amount_inr"),
        "purchases": ("date", "supplier_name", "amount_inr"),
        "products": ("expires_on", "name", "unit_price_inr"),
        "expenses": ("occurred_on", "label", "amount_inr"),
        "recurring_obligations": ("due_date", "label", "amount_inr"),
    }
    pending = stored(imports.pending_rows(jobs, requested, staged), "pending-rows")
    parts = []
    for kind, (day, name, amount) in shown.items():
        rows = imports.rows_to_apply(jobs, requested, staged, kind, pending)
        typed = imports.coerce_rows(rows, kind, AS_OF)
        parts.append(
            typed.select(
                WS, "job_id", "row_index", F.lit(kind).alias("import_type"),
                F.col(day).cast("string").alias("day"), F.col(name).alias("name"),
                num(F.col(amount)).alias("amount"),
            )
        )
    return union_all(parts)


# --- aggregates ------------------------------------------------------------------


@query
def d1_margin_series(v: Views) -> DataFrame:
    return A.margin_series(v.sales()).select(
        WS, "month_no", "month_label", num("revenue_inr"), num("margin_pct", 4)
    )


@query
def d1_margin_series_by_year(v: Views) -> DataFrame:
    return A.margin_series(v.sales(), by_year=True).select(
        WS, "year_no", "month_no", "month_label", num("revenue_inr"), num("margin_pct", 4)
    )


def _every(v: Views, fact: DataFrame) -> DataFrame:
    return A.per_workspace(v.workspaces(), fact)


def _zero(name: str, places: int | None = None) -> Column:
    return F.coalesce(num(F.col(name), places), F.lit(0.0)).alias(name)


@query
def d2_sales_totals(v: Views) -> DataFrame:
    totals = _every(v, A.sales_totals(v.sales()))
    return totals.select(WS, _zero("total_revenue"), _zero("avg_margin", 4))


@query
def d3_bills_due(v: Views) -> DataFrame:
    bills = _every(v, A.bills_due(v.obligations(), AS_OF))
    labels = F.coalesce("labels", F.lit(V.NO_BILLS_DUE)).alias("labels")
    return bills.select(WS, _zero("total_due"), labels)


@query
def d4_expiry_exposure(v: Views) -> DataFrame:
    lots = F.coalesce("lot_count", F.lit(0)).cast("bigint").alias("lot_count")
    return _every(v, A.expiry_exposure(v.products(), AS_OF)).select(WS, lots, _zero("exposure"))


@query
def d5_utilities_mean(v: Views) -> DataFrame:
    return _every(v, A.utilities_mean(v.expenses())).select(WS, _zero("utility_avg", 4))


@query
def d6_top_supplier_due(v: Views) -> DataFrame:
    return _every(v, A.obligation_totals(v.obligations())).select(WS, _zero("top_supplier_due"))


@query
def d7_recurring_due(v: Views) -> DataFrame:
    return _every(v, A.obligation_totals(v.obligations())).select(WS, _zero("recurring_due"))


def _daily(v: Views) -> DataFrame:
    kinds = [
        ("sales", v.sales(), "date"),
        ("purchases", v.purchases(), "date"),
        ("expenses", v.expenses(), "occurred_on"),
    ]
    return union_all(
        [A.daily_totals(rows, date).withColumn("import_type", F.lit(k)) for k, rows, date in kinds]
    )


@query
def d8_daily_totals(v: Views) -> DataFrame:
    return _daily(v).select(WS, "import_type", iso("day"), num("daily_total"))


@query
def d9_revenue_per_sku(v: Views) -> DataFrame:
    return A.revenue_per_sku(v.sales()).select(WS, "sku", num("revenue"))


@query
def d10_expense_per_category(v: Views) -> DataFrame:
    return A.expense_per_category(v.expenses()).select(WS, "category", num("expense_total"))


def _ledgers(v: Views) -> dict[str, DataFrame]:
    return {
        "sales": v.sales(product=True),
        "purchases": v.purchases(),
        "products": v.products(),
        "expenses": v.expenses(),
        "recurring_obligations": v.obligations(),
    }


@query
def d11_row_counts(v: Views) -> DataFrame:
    return A.row_counts({**_ledgers(v), "sales": v.sales()})


@query
def d12_run_counts(v: Views) -> DataFrame:
    return _run_log(v).drop("morning_brief_id")


@query
def e1_moving_averages(v: Views) -> DataFrame:
    parts = []
    daily = _daily(v)
    for kind in ["sales", "purchases", "expenses"]:
        rows = daily.filter(F.col("import_type") == kind)
        average = A.moving_average(rows).withColumn("import_type", F.lit(kind))
        parts.append(average.select(WS, "import_type", num("average", 4)))
    return union_all(parts)


@query
def e1_moving_average_series(v: Views) -> DataFrame:
    return A.moving_average_series(A.daily_totals(v.sales())).select(
        WS, iso("day"), num("daily_total"), num("average", 4)
    )


@query
def e2_latest_rows(v: Views) -> DataFrame:
    samples = union_all([A.sample_rows(rows, kind) for kind, rows in _ledgers(v).items()])
    return samples.select(
        WS, "import_type", F.posexplode("sample_rows").alias("ord", "fields")
    ).select(WS, "import_type", "ord", F.array_join("fields", "|", "").alias("fields"))


@query
def e3_soonest_due(v: Views) -> DataFrame:
    return A.soonest_due(v.obligations(), AS_OF).select(WS, "ord", "id", "days", num("amount_inr"))


# --- orders and top-k ---------------------------------------------------------------


@query
def f1_obligation_order(v: Views) -> DataFrame:
    return ranking.with_position(v.obligations(), "obligations").select(
        WS, "position", "id", "status", iso("due_date"), "label"
    )


@query
def f2_action_order(v: Views) -> DataFrame:
    return ranking.with_position(v.actions(), "actions").select(WS, "position", "id", "status")


@query
def f3_top_skus(v: Views) -> DataFrame:
    return A.top_skus(v.sales()).select(WS, "ord", "sku", num("revenue"))


@query
def f4_top_categories(v: Views) -> DataFrame:
    return A.top_categories(v.expenses()).select(WS, "ord", "category", num("expense_total"))


@query
def f5_soonest_expiry(v: Views) -> DataFrame:
    return A.soonest_expiry(v.products(), AS_OF).select(
        WS, "sku", "name", iso("expires_on"), "quantity_on_hand"
    )


@query
def f6_documents_newest(v: Views) -> DataFrame:
    docs = v.documents().drop("summary")
    return ranking.with_position(docs, "documents").select(
        WS, "position", "document_id", iso("uploaded_at")
    )


@query
def f7_import_history(v: Views) -> DataFrame:
    """Every import in history order: last confirmed first, unconfirmed last."""
    return ranking.with_position(v.import_jobs(), "imports").select(
        WS, "position", "job_id", "status"
    )


@query
def f8_member_order(v: Views) -> DataFrame:
    return ranking.with_position(v.members(), "members").select(WS, "position", "user_id")


@query
def f9_queue_head(v: Views) -> DataFrame:
    return ranking.head(_queue(v), "actions", 4).select(WS, "ord", "id", "title", "status")


# --- unions ----------------------------------------------------------------------------


@query
def g1_candidate_actions(v: Views) -> DataFrame:
    return actions.candidate_actions(v.workspaces(), v.obligations(), v.import_jobs(), AS_OF)


@query
def g1_idle_workspaces(v: Views) -> DataFrame:
    """Candidates where every customer is a workspace: most have nothing to act on."""
    every = v.table("customer").select(text("c_custkey").alias(WS))
    owner = v.table("orders").select(text("o_custkey").alias("_ws"), text("o_orderkey").alias("id"))
    due = v.obligations().join(owner, "id")
    due = due.withColumn(WS, F.col("_ws")).drop("_ws")
    jobs = v.spark.createDataFrame([], schemas.IMPORT_JOBS)
    return actions.candidate_actions(every, due, jobs, AS_OF)


@query
def g2_inventory_alerts(v: Views) -> DataFrame:
    return dashboard.inventory_alerts(v.workspaces(), v.products(), AS_OF)


# --- scalar functions ----------------------------------------------------------------------


@query
def h1_short_amounts(v: Views) -> DataFrame:
    swing = (F.col("o_totalprice") - 20000).cast("decimal(12,2)")
    return v.table("orders").select(
        "o_orderkey",
        numbers.inr_short(swing).alias("short"),
        numbers.inr_full(swing).alias("full"),
    )


@query
def h3_parsed_numbers(v: Views) -> DataFrame:
    """Number parsing over clean and faulty texts made from event values."""
    raw = F.element_at(
        F.array(
            text(F.col("value").cast("decimal(12,2)")),
            F.concat(F.lit("  "), text(F.col("value").cast("decimal(12,2)")), F.lit(" ")),
            F.concat(text(F.floor("value").cast("int")), F.lit("d")),
            F.lit("nan"),
            F.concat(F.lit("-"), text(F.floor("value").cast("int")), F.lit("e1")),
            F.lit(""),
        ),
        (F.col("event_id") % 6 + 1).cast("int"),
    )
    return v.table("events").select(
        "event_id",
        numbers.to_double(raw).alias("as_double"),
        numbers.to_int(raw, 1).alias("as_int"),
        numbers.to_money(raw).cast("double").alias("as_money"),
        numbers.horizon_days(raw).alias("as_horizon"),
    )


@query
def h7_document_chunks(v: Views) -> DataFrame:
    return documents.document_chunks(v.documents())


@query
def h8_chunk_vectors(v: Views) -> DataFrame:
    """Every vector component that is not zero, per chunk."""
    return (
        _indexed_chunks(v)
        .select(WS, "document_id", "chunk_index", F.posexplode("embedding").alias("slot", "x"))
        .filter(F.col("x") != 0)
    )


@query
def h9_providers_and_costs(v: Views) -> DataFrame:
    """Provider and cost of every question under its workspace's settings."""
    asked = investigate.classify(v.questions())
    settings = merges.settings_for(v.workspaces(), v.workspace_settings())
    rows = asked.join(settings, WS)
    provider = rules.choose_provider(F.col("mode"), F.col("task"), F.col("providers"))
    return rows.select(
        "question_id",
        "mode",
        provider.alias("provider"),
        rules.cost_usd(F.col("task"), provider, F.length("question")).alias("cost_usd"),
    )


# --- reports ---------------------------------------------------------------------------------


def _facts(v: Views) -> DataFrame:
    return dashboard.workspace_facts(
        v.workspaces(), v.sales(), v.expenses(), v.obligations(), v.products(), AS_OF
    )


@query
def k1_dashboard_stats(v: Views) -> DataFrame:
    return dashboard.dashboard_stats(_facts(v)).withColumn("number", F.round("number", 4))


@query
def k2_margin_series(v: Views) -> DataFrame:
    return A.margin_series(v.sales()).select(
        WS,
        "month_no",
        F.col("month_label").alias("label"),
        num("revenue_inr", 2),
        num("margin_pct", 2),
    )


@query
def k3_inventory_alerts(v: Views) -> DataFrame:
    return dashboard.inventory_alerts(v.workspaces(), v.products(), AS_OF).select(
        WS, "ord", "id", "title", "detail", "severity"
    )


@query
def k4_import_history(v: Views) -> DataFrame:
    return ledger.history(v.import_jobs()).select(
        WS, "job_id", "import_type", "filename", "row_count", "applied_count",
        F.date_format("confirmed_at", "yyyy-MM-dd").alias("confirmed_on"),
    )


@query
def k4_collection_summaries(v: Views) -> DataFrame:
    return _shown_summaries(
        ledger.collection_summaries(v.workspaces(), _ledgers(v), v.import_jobs())
    )


def _shown_summaries(rows: DataFrame) -> DataFrame:
    shown = F.transform("sample_rows", lambda r: F.array_join(r, "|", ""))
    return rows.select(
        WS,
        "import_type",
        "row_count",
        F.date_format("latest_import_at", "yyyy-MM-dd").alias("latest_import_on"),
        joined("columns"),
        F.array_join(shown, "||").alias("sample_rows"),
    )


@query
def k5_action_queue(v: Views) -> DataFrame:
    return ranking.with_position(_queue(v), "actions").select("position", *_action_columns())


@query
def k6_action_drafts(v: Views) -> DataFrame:
    """A draft per order: for its own action, or what stands in for it."""
    requests = v.obligations().select(
        WS,
        F.col("id").alias("request_id"),
        F.concat(F.lit("obligation-"), "id").alias("action_id"),
    )
    return actions.action_drafts(requests, _queue(v))


def _alerts(v: Views) -> DataFrame:
    return dashboard.inventory_alerts(v.workspaces(), v.products(), AS_OF)


@query
def k7_owner_brief(v: Views) -> DataFrame:
    return brief.owner_brief(
        v.workspaces(),
        dashboard.dashboard_stats(_facts(v)),
        _alerts(v),
        v.obligations(),
        _queue(v),
        AS_OF,
    )


def _kept(v: Views, collections: list[str]) -> str:
    """Kept figures of some ledgers: sales in two batches, one of them written again."""
    root = scratch_path(v.spark, "kept")
    for name, rows in _ledgers(v).items():
        if name not in collections:
            continue
        if name in ("products", "recurring_obligations"):
            kept.keep_state(rows, name, root)
        elif name == "sales":
            late = F.col("date") >= F.lit("1996-01-01").cast("date")
            for batch, part in [("late", late), ("early", ~late), ("late", late)]:
                kept.keep_batch(rows.filter(part), name, root, batch)
        else:
            kept.keep_batch(rows, name, root, "all")
    return root


def _kept_stats(v: Views, root: str) -> DataFrame:
    bills = kept.read_leads(v.spark, root, "recurring_obligations")
    found = kept.figures(v.workspaces(), kept.read_sums(v.spark, root), bills, AS_OF)
    return dashboard.dashboard_stats(dashboard.with_defaults(found))


@query
def k1_kept_stats(v: Views) -> DataFrame:
    """Stat cards from kept sums and lead rows; no ledger is read for them."""
    root = _kept(v, ["sales", "expenses", "products", "recurring_obligations"])
    return _kept_stats(v, root).withColumn("number", F.round("number", 4))


@query
def k2_kept_series(v: Views) -> DataFrame:
    sums = kept.read_sums(v.spark, _kept(v, ["sales"]))
    return kept.margin_series(sums).select(
        WS, "month_no", F.col("month_label").alias("label"), num("revenue_inr", 2), num("margin_pct", 2)
    )


@query
def k4_kept_summaries(v: Views) -> DataFrame:
    root = _kept(v, V.COLLECTIONS)
    leads = {name: kept.read_leads(v.spark, root, name) for name in V.COLLECTIONS}
    counts = kept.row_counts(kept.read_sums(v.spark, root))
    rows = ledger.collection_summaries(v.workspaces(), leads, v.import_jobs(), counts)
    return _shown_summaries(rows)


@query
def k7_kept_brief(v: Views) -> DataFrame:
    """The brief from kept figures; bills are read for the list of those due."""
    root = _kept(v, ["sales", "expenses", "products", "recurring_obligations"])
    bills = kept.read_leads(v.spark, root, "recurring_obligations")
    products = kept.read_leads(v.spark, root, "products")
    alerts = dashboard.inventory_alerts(v.workspaces(), products, AS_OF)
    queue = actions.action_queue(v.workspaces(), bills, v.import_jobs(), v.actions(), AS_OF, NOW)
    return brief.owner_brief(
        v.workspaces(), _kept_stats(v, root), alerts, v.obligations(), queue, AS_OF
    )


@query
def d7_kept_after_changes(v: Views) -> DataFrame:
    """Unpaid bills after changes of status; only the touched blocks of workspaces are kept anew."""
    root = _kept(v, ["recurring_obligations"])
    changes = v.status_changes("obligations").filter(F.col("workspace_id").cast("int") % 3 == 0)
    after = merges.apply_obligation_changes(v.obligations(), changes)
    kept.keep_state(after, "recurring_obligations", root, touched=changes)
    bills = kept.read_leads(v.spark, root, "recurring_obligations")
    found = kept.figures(v.workspaces(), kept.read_sums(v.spark, root), bills, AS_OF)
    soonest = A.soonest_due(bills, AS_OF, 1).select(WS, F.col("id").alias("soonest_id"))
    shown = dashboard.with_defaults(found).join(soonest, WS, "left")
    return shown.select(WS, num("recurring_due", 2), num("top_supplier_due", 2), "soonest_id")


def _base(v: Views) -> DataFrame:
    return forecast.forecast_base(
        v.workspaces(), v.sales(), v.purchases(), v.expenses(), v.obligations()
    )


@query
def k8_forecast(v: Views) -> DataFrame:
    return forecast.forecast(v.forecast_requests(), _base(v)).select(
        WS, "request_id", "metric", "horizon", num("base", 4), num("low", 4), num("high", 4),
        "baseline", "projected_range", joined("assumptions"), joined("warnings"),
    )


@query
def k9_scenario_deltas(v: Views) -> DataFrame:
    requests = forecast.valid_scenarios(v.scenario_requests())
    return forecast.scenario_deltas(requests, _base(v))


@query
def k9_scenario_plans(v: Views) -> DataFrame:
    requests = forecast.valid_scenarios(v.scenario_requests())
    return forecast.scenario_plans(requests, _base(v)).select(
        WS, "request_id", "scenario_type", "horizon_days", "summary", joined("recommendations")
    )


def _investigations(v: Views) -> DataFrame:
    return investigate.investigate(
        v.questions(),
        _facts(v),
        investigate.insight_texts(v.workspaces(), v.sales(), v.expenses()),
        merges.settings_for(v.workspaces(), v.workspace_settings()),
        _indexed_chunks(v),
        v.documents(),
    )


@query
def k10_investigations(v: Views) -> DataFrame:
    return _investigations(v).select(
        WS, "question_id", "question", "refused", "task", "summary", num("confidence", 2),
        joined("risks"), joined("recommendations"), "provider", "mode", "estimated_cost_usd",
    )


@query
def k10_evidence(v: Views) -> DataFrame:
    return investigate.evidence_rows(_investigations(v))


def _run_log(v: Views) -> DataFrame:
    return brief.run_log(v.workspaces(), _alerts(v), v.obligations(), AS_OF)


@query
def k11_scheduler_log(v: Views) -> DataFrame:
    """Run log appended twice for one day: the second run replaces the first."""
    path = scratch_path(v.spark, "runs")
    runs = _run_log(v)
    for _ in range(2):
        tables.append_batch(runs, path, f"run-{AS_OF}")
    return tables.read_facts(v.spark, path, runs.schema)


# --- streams ------------------------------------------------------------------------------------


def _event_stream(v: Views) -> DataFrame:
    """The event file as a stream of expense entries."""
    schema = v.table("events").schema
    raw = (
        v.spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(v.sf_dir)
    )
    return _event_entries(raw)


def _event_entries(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("w"), text(F.col("user_id") % 25)).alias(WS),
        text("event_id").alias("id"),
        F.col("ts").cast("date").alias("occurred_on"),
        F.concat(F.lit("user-"), text("user_id")).alias("label"),
        F.col("event_type").alias("category"),
        F.col("value").cast("decimal(12,2)").alias("amount_inr"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


@query
def s1_ingested_entries(v: Views) -> DataFrame:
    """Streamed expenses; amounts are lowered so that some are rejected."""
    root = scratch_path(v.spark, "entries")
    lowered = (F.col("amount_inr") - 10).cast("decimal(12,2)")
    entries = _event_stream(v).withColumn("amount_inr", lowered)
    streams.ingest_entries(
        entries, "expenses", f"{root}/ledger", f"{root}/rejects", f"{root}/checkpoint"
    ).awaitTermination()
    ledger_rows = v.spark.read.parquet(f"{root}/ledger")
    rejects = v.spark.read.parquet(f"{root}/rejects")
    return union_all(
        [
            ledger_rows.select("id", num("amount_inr"), F.lit("").alias("reasons")),
            rejects.select("id", num("amount_inr"), joined("reasons")),
        ]
    )


@query
def s2_ingested_once(v: Views) -> DataFrame:
    """Streamed expenses, each natural key once, over a ledger that holds the errors."""
    root = scratch_path(v.spark, "once")
    stored = v.table("events").filter(F.col("event_type") == "error")
    batch = Views(v.spark, v.sf_dir)
    batch.table = lambda name: stored
    old = batch.expenses().withColumn(WS, F.concat(F.lit("w"), WS))
    tables.append_batch(old, f"{root}/ledger", "before")
    streams.ingest_once(
        _event_stream(v),
        "expenses",
        ["created_at", "id"],
        f"{root}/ledger",
        f"{root}/checkpoint",
        schemas.EXPENSES,
    ).awaitTermination()
    ledger_rows = tables.read_facts(v.spark, f"{root}/ledger", schemas.EXPENSES)
    return ledger_rows.select(WS, "id", iso("occurred_on"), "label", num("amount_inr"))


def _run_late(v: Views, rows: DataFrame, order: str, start: Callable) -> None:
    """Feeds ``rows`` to a stream in three runs, the latest rows first and the oldest last.

    Each run starts the stream again from its checkpoint on what has been written since.
    """
    path = scratch_path(v.spark, "arrivals")
    at = F.unix_seconds(order)
    shares = F.array(F.lit(1 / 3), F.lit(2 / 3))
    low, high = rows.agg(F.approx_percentile(at, shares, F.lit(1000))).first()[0] or (0, 0)
    for name, part in [("a", at > high), ("b", (at > low) & (at <= high)), ("c", at <= low)]:
        rows.filter(part).write.parquet(f"{path}/{name}")
        stream = v.spark.readStream.schema(rows.schema).option("recursiveFileLookup", True)
        start(stream.parquet(path)).awaitTermination()


def _streamed_changes(v: Views, kind: str) -> str:
    """Where a stream of the status changes, older ones last, keeps the last of each entity."""
    root = scratch_path(v.spark, kind)
    _run_late(
        v,
        v.status_changes(kind),
        "ts",
        lambda stream: streams.keep_latest_changes(stream, f"{root}/latest", f"{root}/checkpoint"),
    )
    return f"{root}/latest"


@query
def s3_streamed_obligation_statuses(v: Views) -> DataFrame:
    kept = _streamed_changes(v, "obligations")
    return streams.with_latest_changes(v.obligations(), kept, merges.apply_obligation_changes).select(
        WS, "id", "status"
    )


@query
def s3_streamed_action_statuses(v: Views) -> DataFrame:
    """As streamed changes leave the stored actions, written into their table once at the end."""
    kept = _streamed_changes(v, "actions")
    table = tables.VersionedTable(v.spark, scratch_path(v.spark, "actions"), schemas.ACTIONS)
    table.replace(v.actions())
    streams.fold_changes(table, kept, merges.apply_action_changes)
    return table.read().select(*_action_columns())


def _live_parts(v: Views) -> str:
    """Daily sums of a stream in which the oldest entries arrive last."""
    root = scratch_path(v.spark, "live")
    _run_late(
        v,
        _event_entries(v.table("events")),
        "created_at",
        lambda stream: streams.live_daily_totals(stream, f"{root}/parts", f"{root}/checkpoint", "created_at"),
    )
    return f"{root}/parts"


@query
def s4_live_daily_totals(v: Views) -> DataFrame:
    """Live totals of a stream in which the oldest entries arrive last."""
    totals = streams.read_daily_totals(v.spark, _live_parts(v))
    return totals.select(WS, iso("day"), num("daily_total"))


@query
def e1_live_moving_averages(v: Views) -> DataFrame:
    """Moving averages of the live totals: late days move them."""
    averages = streams.read_moving_average(v.spark, _live_parts(v))
    return averages.select(WS, num("average", 4))


@query
def s2_late_entries_once(v: Views) -> DataFrame:
    """Each natural key once, of a stream in which the oldest entries arrive last."""
    root = scratch_path(v.spark, "late")
    _run_late(
        v,
        _event_entries(v.table("events")),
        "created_at",
        lambda stream: streams.ingest_once(
            stream, "expenses", ["created_at", "id"], f"{root}/ledger", f"{root}/checkpoint", schemas.EXPENSES
        ),
    )
    ledger_rows = tables.read_facts(v.spark, f"{root}/ledger", schemas.EXPENSES)
    return ledger_rows.select(WS, iso("occurred_on"), "label", num("amount_inr"))

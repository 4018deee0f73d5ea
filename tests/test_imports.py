"""Uploads from CSV to ledger rows."""

from __future__ import annotations

import datetime as dt

import pytest
from hall import AS_OF
from pyspark.sql import functions as F

from ledgerspark import schemas
from ledgerspark.operators import imports, keyed
from ledgerspark.sources import files, tables

NOW = dt.datetime(2026, 5, 9, 8)

SALES_CSV = """ Date ,SKU,Product Name,category,qty, Revenue INR ,margin_pct,amount_inr,memo
2026-5-1,007,Tablet,Pain,2,10.555,26.4,9,x
,,,,,,,,y
2026-05-02,PCM,,,abc,,,,z
2026-02-30,BAD,,,0,-1,100.01,,
"""


def uploads(spark, folder, content=SALES_CSV, kind="sales", name="sales.csv"):
    (folder / name).write_text(content)
    return files.read_uploads(spark, str(folder / name), "w", kind)


def test_header_mapping_and_preview(spark, tmp_path):
    rows = uploads(spark, tmp_path)
    found = {r.header: r.target for r in imports.header_mappings(rows).collect()}
    assert found == {
        " Date ": "date", "SKU": "sku", "Product Name": "name", "category": "category",
        "qty": "quantity", " Revenue INR ": "amount_inr", "margin_pct": "margin_pct",
        "amount_inr": "review_manually", "memo": "review_manually",
    }
    (job,) = imports.preview(rows).collect()
    assert (job.row_count, job.filename) == (4, "sales.csv")
    assert job.columns[:2] == [" Date ", "SKU"]
    assert job.warnings == ["Some columns need manual review: amount_inr, memo"]


def test_unknown_type_is_all_manual(spark, tmp_path):
    rows = uploads(spark, tmp_path, "sku,qty\n1,2\n", "stock", "stock.csv")
    (job,) = imports.preview(rows).collect()
    assert set(job.inferred_mappings.values()) == {"review_manually"}
    assert imports.staged_rows(rows, ["row_order"], files.UPLOAD_BLOCKS).count() == 0


def test_missing_fields_are_reported(spark, tmp_path):
    rows = uploads(spark, tmp_path, "label,occurred_on\na,b\n", "expenses", "e.csv")
    (job,) = imports.preview(rows).collect()
    assert job.warnings == [
        "Some columns need manual review: occurred_on",
        "Missing canonical mappings: amount_inr, category, occurred_on",
    ]


def test_staging_and_coercion(spark, tmp_path):
    staged = imports.staged_rows(uploads(spark, tmp_path), ["row_order"], files.UPLOAD_BLOCKS)
    rows = staged.orderBy("row_index").collect()
    assert [r.row_index for r in rows] == [0, 1, 2]
    assert rows[0].payload["sku"] == "007" and rows[0].payload["amount_inr"] == "10.56"
    assert set(rows[1].payload) == {"date", "sku", "quantity"}
    typed = imports.coerce_rows(staged, "sales", AS_OF).orderBy("row_index").collect()
    assert typed[0].date == dt.date(2026, 5, 1) and str(typed[0].amount_inr) == "10.56"
    assert (typed[1].quantity, str(typed[1].amount_inr), typed[1].margin_pct) == (1, "0.00", None)
    valid, rejected = imports.split_valid(imports.coerce_rows(staged, "sales", AS_OF), "sales")
    (bad,) = rejected.collect()
    assert bad.reasons == [
        "bad_date", "quantity_below_1", "negative_amount", "margin_out_of_range",
    ]
    assert valid.count() == 2


def test_later_header_wins_when_not_empty(spark):
    cells = {"Date": F.col("a"), "date": F.col("b"), "sku": F.lit("s")}
    rows = spark.createDataFrame([("1", "2"), ("1", ""), ("", None)], "a string, b string")
    found = rows.select(imports.payload_of("sales", cells).alias("p")).collect()
    assert [r.p.get("date") for r in found] == ["2", "1", None]


def test_csv_of_any_layout(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,date,sku,Product Name,_batch\n2026-05-01,,"Strip ""10"" pack","two\nlines",x\n')
    (tmp_path / "b.csv").write_text("sku,Date,Revenue INR,sku\nfirst,2026-05-02,5,last\n")
    rows = files.read_uploads(spark, str(tmp_path), "w", "sales")
    found = {r.filename: r for r in rows.collect()}
    assert found["a.csv"].headers == ["Date", "date", "sku", "Product Name", "_batch"]
    assert found["a.csv"].payload == {"date": "2026-05-01", "sku": 'Strip "10" pack', "name": "two\nlines"}
    assert found["b.csv"].payload == {"date": "2026-05-02", "sku": "last", "amount_inr": "5"}
    warnings = {r.filename: r.warnings for r in imports.preview(rows).collect()}
    assert "_batch" in warnings["a.csv"][0]


def test_many_layouts_are_one_scan(spark, tmp_path):
    spelled = [["sku", "Date", "Revenue INR"], ["revenue_inr", "sku", "note", "SKU "], ["Date", "date", "sku"]]
    for n in range(60):
        heads = [*spelled[n % 3], *[f"extra {i}" for i in range(n % 7)]]
        line = ",".join(f"{n}-{i}" for i in range(len(heads) + n % 2))  # odd files have a cell too many
        (tmp_path / f"{n}.csv").write_text("\ufeff" * (n % 2) + ",".join(heads) + "\r\n" + f"{line}\n{n}\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n\nsku\nx\n")
    (tmp_path / "heads.csv").write_text("sku,Date\n")
    rows = files.read_uploads(spark, str(tmp_path), "w", "sales")
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan csv") == 1
    found: dict[str, list] = {}
    for row in rows.orderBy("row_order").collect():
        found.setdefault(row.filename, []).append(row.payload)
    assert len(found) == 61 and found["blank.csv"] == [{"sku": "x"}]
    assert found["0.csv"] == [{"sku": "0-0", "date": "0-1", "amount_inr": "0-2"}, {"sku": "0"}]
    assert found["1.csv"] == [{"amount_inr": "1-0", "sku": "1-3"}, {"amount_inr": "1"}]
    assert found["2.csv"] == [{"date": "2-1", "sku": "2-2"}, {"date": "2"}]
    with pytest.raises(ValueError, match="no CSV file"):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "a.csv").write_text("")
        files.read_uploads(spark, str(tmp_path / "none"), "w", "sales")


def test_places_of_fields_equal_the_planned_mapping(spark):
    """Rows read by places against the mapping that is settled when the plan is built."""
    for headers in [["Date", "date", "sku", "Date"], ["SKU", "sku", "sku"], ["memo"], ["qty", "margin_pct", "qty"]]:
        for cells in [["1.255", "", "c", "d"], ["", "", "", ""], ["a", "b", "c", ""], ["", "2.5", "", ""]]:
            row = spark.createDataFrame([(headers, cells[: len(headers)])], "headers array<string>, cells array<string>")
            planned = imports.payload_of("sales", {h: F.get("cells", F.lit(i)) for i, h in enumerate(headers)})
            placed = imports.payload_at("sales", F.col("cells"), imports.field_places("sales", F.col("headers")))
            one = row.select(planned.alias("planned"), placed.alias("placed")).first()
            assert one.planned == one.placed


def test_numbers_out_of_range_are_rejected(spark, tmp_path):
    text = "sku,date,qty,Revenue INR,margin_pct\n"
    text += "a,2026-05-01,1,12345678901.50,5\nb,2026-05-01,99999999999,1,5\nc,2026-05-01,1,1,12000\nd,2026-05-01,1,1,\n"
    staged = imports.staged_rows(uploads(spark, tmp_path, text), ["row_order"], files.UPLOAD_BLOCKS)
    valid, rejected = imports.split_valid(imports.coerce_rows(staged, "sales", AS_OF), "sales")
    assert {r.sku: r.reasons for r in rejected.collect()} == {
        "a": ["amount_out_of_range"], "b": ["quantity_out_of_range"], "c": ["margin_out_of_range"],
    }
    assert [r.sku for r in valid.collect()] == ["d"]


def test_defaults_of_every_collection(spark):
    empty = spark.createDataFrame([("w", "j", 0, {})], "workspace_id string, job_id string, row_index int, payload map<string,string>")
    purchase = imports.coerce_rows(empty, "purchases", AS_OF).first()
    assert (purchase.date, purchase.sku, purchase.supplier_name, purchase.quantity) == (
        AS_OF, "UNKNOWN", "Unknown supplier", 1,
    )
    assert imports.coerce_rows(empty, "products", AS_OF).count() == 0
    expense = imports.coerce_rows(empty, "expenses", AS_OF).first()
    assert (expense.label, expense.category) == ("Expense entry", "Operations")
    bill = imports.coerce_rows(empty, "recurring_obligations", AS_OF).first()
    assert (bill.label, bill.recurrence, bill.status) == ("Imported obligation", "monthly", "scheduled")


def test_confirming_twice_applies_once(spark, tmp_path):
    rows = uploads(spark, tmp_path)
    staged = imports.staged_rows(rows, ["row_order"], files.UPLOAD_BLOCKS)
    tables.store_import_job(imports.jobs_of(rows, NOW), staged.drop("import_type"), str(tmp_path / "db"), "u1")
    jobs = tables.read_facts(spark, str(tmp_path / "db/import_jobs"), schemas.IMPORT_JOBS)
    stored = tables.read_facts(spark, str(tmp_path / "db/import_job_rows"), schemas.IMPORT_ROWS)
    asked = jobs.select("workspace_id", "job_id").unionByName(
        spark.createDataFrame([("w", "none")], "workspace_id string, job_id string")
    )
    first = imports.confirmation(jobs, asked, stored)
    found = {r.job_id: r for r in first.collect()}
    assert found["none"].outcome == "missing"
    (done,) = [r for r in found.values() if r.outcome == "confirmed"]
    assert (done.applied_count, done.affected_collections) == (
        3, ["sales", "dashboard", "action_queue"],
    )
    assert imports.rows_to_apply(jobs, asked, stored, "sales").count() == 3
    after = imports.confirmed_jobs(jobs, first, NOW)
    again = imports.confirmation(after, asked, stored).filter("job_id <> 'none'").first()
    assert (again.outcome, again.applied_count) == ("already_confirmed", 3)
    assert imports.rows_to_apply(after, asked, stored, "sales").count() == 0


def test_numbering_by_blocks(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.pmod(F.hash("id"), F.lit(100000)).alias("x"),
        "id",
    ).repartition(6)
    numbered = keyed.number_rows(rows, ["g"], ["x", "id"], "n", [F.floor(F.col("x") / 9000)])
    for group in ["hot", "g3"]:
        places = [r.n for r in numbered.filter(F.col("g") == group).orderBy("x", "id").collect()]
        assert places and places == list(range(len(places)))


def test_large_keys_are_numbered_and_met_like_small_ones(spark):
    rows = spark.range(400).selectExpr(
        "case when id < 300 then 'hot' when id < 390 then concat('g', id % 7) end as g",
        "cast(pmod(hash(id), 50) as int) as x", "id",
    )
    lookup = spark.createDataFrame([("hot", 1), ("g3", 2), ("g3", 3), (None, 4)], "g string, y int")
    numbered, met = [], []
    for large in (10, 1000):
        frame = keyed.number_in_groups(rows, ["g"], ["x", "id"], "n", [F.floor(F.col("x") / 9)], large)
        numbered.append(sorted(tuple(r) for r in frame.select("g", "x", "id", "n").collect()))
        met.append(sorted(tuple(r) for r in keyed.match_rows(rows, lookup, ["g"], ["id"], large).collect()))
    assert numbered[0] == numbered[1] and met[0] == met[1]
    assert [n for g, _, _, n in numbered[0] if g == "hot"] == list(range(300))
    assert len(numbered[0]) == 390 and len(met[0]) == 300 + 2 * sum(g == "g3" for g, *_ in numbered[0])


def test_small_jobs_are_numbered_in_one_shuffle(spark, tmp_path):
    staged = imports.staged_rows(uploads(spark, tmp_path), ["row_order"], files.UPLOAD_BLOCKS)
    plan = staged._jdf.queryExecution().executedPlan().toString()
    # the rows are numbered by job; no sums over blocks beside them
    assert plan.count("Window [row_number()") == 1 and "sum(_rows" not in plan


def test_pending_rows_are_met_once_for_all_collections(spark):
    staged = spark.createDataFrame(
        [("w", j, i, {"sku": f"{j}{i}"}) for j in "abcd" for i in range(2)], schemas.IMPORT_ROWS
    )
    jobs = spark.createDataFrame(
        [("w", "a", "sales", "pending"), ("w", "b", "sales", "confirmed"), ("w", "c", "products", "pending")],
        "workspace_id string, job_id string, import_type string, status string",
    )
    asked = jobs.select("workspace_id", "job_id").unionByName(jobs.select("workspace_id", "job_id"))
    pending = imports.pending_rows(jobs, asked, staged)
    for kind, job in (("sales", "a"), ("products", "c")):
        kept = imports.rows_to_apply(jobs, asked, staged, kind, pending)
        alone = imports.rows_to_apply(jobs, asked, staged, kind)
        assert kept.columns == alone.columns
        found = [sorted((r.job_id, r.row_index) for r in f.collect()) for f in (kept, alone)]
        assert found[0] == found[1] == [(job, 0), (job, 1)]


def test_a_preview_needs_no_row_per_header(spark):
    lists = [("a", ["Date", "SKU", "x"]), ("a", ["x", "Date", "Qty"]), ("a", ["Date", "SKU", "x"]), ("b", ["Date"]), ("c", [])]
    rows = spark.createDataFrame(
        [("w", j, "sales", f"{j}.csv", h) for j, h in lists],
        "workspace_id string, job_id string, import_type string, filename string, headers array<string>",
    )
    found = {r.job_id: r for r in imports.preview(rows).collect()}
    assert {j: (r.row_count, r["columns"]) for j, r in found.items()} == {"a": (3, ["Date", "x", "SKU", "Qty"]), "b": (1, ["Date"])}
    mapped = imports.header_mappings(rows).filter("job_id = 'a'").collect()
    assert found["a"].inferred_mappings == {r.header: r.target for r in mapped}
    assert "explode" not in imports.preview(rows)._jdf.queryExecution().executedPlan().toString()

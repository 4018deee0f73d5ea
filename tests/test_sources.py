"""Files and stored tables."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from hall import d
from pyspark.sql import functions as F

from ledgerspark import schemas, session
from ledgerspark.operators import documents
from ledgerspark.sources import files, tables


def test_masked_csv(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('supplier,phone,amount,notes\nAcme,12,1234567,"mail a@b.c"\n,,,\n')
    target = files.write_masked_csv(spark, str(path))
    assert target.endswith("people-sanitized.csv")
    row, blank = spark.read.csv(target, header=True).collect()
    assert tuple(blank) == (None,) * 4
    assert row.supplier == "supplier-" + hashlib.sha1(b"Acme").hexdigest()[:8].upper()
    assert (row.phone, row.amount) == ("+91-XXXX-XXXX", "+91-XXXX-XXXX")
    assert row.notes.endswith("@example.com")


def test_masked_csv_of_many_ranges(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("supplier,amount\n" + "".join(f'"Acme, {n % 7}",{n}\n' for n in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        split = sorted(spark.read.csv(files.write_masked_csv(spark, str(path), quoted_breaks=False)).collect())
        whole = sorted(spark.read.csv(files.write_masked_csv(spark, str(path))).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = [r for r in split if r[0] != "supplier"]
    assert len(rows) == 3000 and rows == [r for r in whole if r[0] != "supplier"]
    assert len({r[0] for r in rows}) == 7


def test_masked_json(spark, tmp_path):
    path = tmp_path / "docs.json"
    path.write_text(json.dumps([{"id": "doc-1", "title": "May", "kind": "bill", "summary": "ok"}]))
    target = files.write_masked_json(spark, str(path), schemas.DOCUMENT_FILE)
    row = spark.read.schema(schemas.DOCUMENT_FILE).json(target).first()
    assert row.id == "doc-1" and row.title.startswith("title-") and row.summary == "ok"


def test_document_json(spark, tmp_path):
    path = tmp_path / "docs.json"
    path.write_text(json.dumps([{"title": "a", "kind": "b", "summary": "c", "uploadedAt": "2026-05-02"}]))
    assert tuple(files.read_document_json(spark, str(path)).first()) == ("a", "b", "c", d("2026-05-02"))


def test_document_folder(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("é".encode() * 300 + b"\xff")
    (tmp_path / "b.csv").write_text('sku,"unit, price"\n1,2\n')
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    rows = files.read_documents(spark, str(tmp_path), "w", "upload", d("2026-05-09")).collect()
    found = {r.title: r for r in rows}
    assert found["a.TXT"].summary == "é" * 280 and found["a.TXT"].content == "é" * 300
    assert found["b.csv"].summary == "Tabular document with columns: sku, unit, price"
    assert found["c.pdf"].summary.startswith("Document stored successfully.")
    assert len({r.document_id for r in rows}) == 3


def test_a_batch_written_again_replaces_itself(spark, hall, tmp_path):
    path = str(tmp_path / "sales")
    assert tables.read_facts(spark, path, schemas.SALES).count() == 0
    early = hall["sales"].filter(F.col("date") < F.lit(d("2031-11-03")))
    late = hall["sales"].filter(F.col("date") >= F.lit(d("2031-11-03")))
    for batch, rows in [("a", early), ("b", late), ("b", late)]:
        tables.append_batch(rows, path, batch, ["workspace_id", "date"])
    assert tables.read_facts(spark, path, schemas.SALES).count() == 10
    assert tables.read_facts(spark, path, schemas.SALES, skip_batch="b").count() == 4
    tables.append_batch(late.limit(0), path, "b")
    assert tables.read_facts(spark, path, schemas.SALES).count() == 4


def test_one_workspace_is_read_alone(spark, hall, tmp_path):
    path = str(tmp_path / "sales")
    both = hall["sales"].unionByName(hall["sales"].withColumn("workspace_id", F.lit("other")))
    tables.append_batch(both, path, "a", ["workspace_id", "date", "id"])
    rows = tables.read_facts(spark, path, schemas.SALES, workspace_id="other")
    assert rows.count() == 10
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(workspace_id,other)" in plan


def test_versions(spark, hall, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "products"), schemas.PRODUCTS)
    assert table.read().count() == 0
    assert table.replace(hall["products"]) == 1
    assert table.replace(table.read().filter("sku <> 'TAPE'")) == 2
    assert table.read().count() == 4


def test_views(spark, hall):
    files.create_views({"t_sales": hall["sales"], "t_products": hall["products"]})
    row = spark.sql("select sum(s.amount_inr) x from t_sales s join t_products p on s.sku = p.sku").first()
    assert float(row.x) == 955.2


@pytest.mark.parametrize("ranges", [1, 7, 50])
def test_chunks_do_not_depend_on_how_a_file_is_split(spark, tmp_path, ranges):
    rng = random.Random(5)
    lines = []
    for _ in range(400):
        words = ["é" * rng.randrange(1, 9) if rng.random() < 0.2 else "x" * rng.randrange(1, 30) for _ in range(rng.randrange(12))]
        lines.append(rng.choice(["", " ", "\t "]) + rng.choice([" ", "  ", "\x85", "\u3000"]).join(words))
    lines[50] = "long " * 3000
    lines[60] = "y" * 2000
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode() + b" \xff end \xff")
    (tmp_path / "b.md").write_text("\r\n\r\n one\r two \n\n")
    (tmp_path / "c.csv").write_text("z" * 280 + "\n" + "w" * 279 + "\n" + "v" * 280)
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "blank.txt").write_text(" \n\t\n")
    (tmp_path / "d.pdf").write_text("not text")
    size = (tmp_path / "a.txt").stat().st_size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(-(-size // ranges)))
    try:
        found = files.read_document_chunks(spark, str(tmp_path), "w").collect()
        tasks = spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks >= ranges
    whole = files.read_documents(spark, str(tmp_path), "w", "upload", d("2026-05-09"))
    expected = documents.document_chunks(whole, "content").collect()
    assert len(expected) > 60 and sorted(found) == sorted(expected)


def test_chunks_of_one_character_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="two characters"):
        files.read_document_chunks(spark, str(tmp_path), "w", 1)


def test_listing_tasks_do_not_grow_with_the_folders(spark, tmp_path):
    spark.range(90).selectExpr("id as part", "concat('line ', id) as text").write.partitionBy("part").text(str(tmp_path / "many"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "folders of text files")
    try:
        found = files.read_document_chunks(spark, str(tmp_path / "many"), "w")
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
        tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
        assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.count() == 90
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) > 16


def test_small_files_are_read_once_and_many_to_a_task(spark, tmp_path):
    rows = spark.range(60).selectExpr("id as part", "concat('line  ', id) as text")
    rows.write.partitionBy("part").text(str(tmp_path / "many"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("small files", "text files of one line")
    try:
        found = files.read_document_chunks(spark, str(tmp_path / "many"), "w")
        assert sorted(r.content for r in found.collect()) == sorted(f"line {n}" for n in range(60))
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("small files")]
        tasks = [x.numTasks for j in jobs for s in j.stageIds if (x := tracker.getStageInfo(s))]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(session.OPEN_COST)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" not in plan and "Scan binaryFile" not in plan


def test_many_files_are_read_group_by_group(spark, tmp_path, monkeypatch):
    parts = ["a=1/b=[x]", "a=1/b={y}", "a=1/b=z", "a=2/b=a b+c%20é", "a=2/b=3", "a=3/b=4", "_old/b=1", ".cut/b=2"]
    for n, part in enumerate(parts):
        (tmp_path / part).mkdir(parents=True)
        (tmp_path / part / "one +%20.txt").write_text(f"first {n}\n" + "word " * 100)
        (tmp_path / part / "_two.txt").write_text("not seen")
        (tmp_path / part / "three.pdf").write_text("not text")
    path = str(tmp_path)
    assert session.folder_groups(spark, path) == [[path]]
    once = sorted(files.read_document_chunks(spark, path, "w").collect())
    monkeypatch.setattr(session, "LISTED", 6)
    groups = session.folder_groups(spark, path)
    # the folders of a=1, which holds nine files, stand alone
    assert sum("a=1/" in at for group in groups for at in group) == 3
    assert sum(len(g) for g in groups) == 5 and len(groups) > 1 and max(len(g) for g in groups) < 4
    assert sorted(files.read_document_chunks(spark, path, "w").collect()) == once
    whole = files.read_documents(spark, path, "w", "upload", d("2026-05-09"))
    expected = documents.document_chunks(whole.filter("content is not null"), "content").collect()
    assert len(expected) == 12 and once == sorted(expected)


@pytest.mark.parametrize("path", ["one.txt", "*.txt", ""])
def test_a_file_a_pattern_and_a_flat_folder_are_one_group(spark, tmp_path, path, monkeypatch):
    monkeypatch.setattr(session, "LISTED", 1)
    (tmp_path / "below").mkdir()
    for name in ["one.txt", "two.txt", "c=3.txt", "below/four.txt"]:
        (tmp_path / name).write_text(name)
    at = f"{tmp_path}/{path}"
    assert session.folder_groups(spark, at) == [[at]]
    found = {r.content for r in files.read_document_chunks(spark, at, "w").collect()}
    assert found == ({"one.txt"} if path == "one.txt" else {"one.txt", "two.txt", "c=3.txt"})


def test_files_of_many_writes_have_no_checksum_files(spark, tmp_path):
    rows = spark.range(4).selectExpr("id as part", "concat('line ', id) as text")
    for name, options in [("plain", {}), ("many", session.MANY_FILES)]:
        rows.write.options(**options).partitionBy("part").text(str(tmp_path / name))
    assert len([*(tmp_path / "plain").rglob("part-*.txt")]) == 4 and [*(tmp_path / "plain").rglob(".*.crc")]
    assert len([*(tmp_path / "many").rglob("part-*.txt")]) == 4 and not [*(tmp_path / "many").rglob(".*.crc")]
    assert sorted(spark.read.text(str(tmp_path / "many")).collect()) == sorted(spark.read.text(str(tmp_path / "plain")).collect())

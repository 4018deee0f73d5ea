"""Fill-in-the-middle outputs against units found one after the other, and undone again."""

from __future__ import annotations

import hashlib
import re

from brute import clashing
from pyspark.sql import functions as F

from ledgerspark.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text, transformed=50):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= transformed:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", a, b, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", a, b, f"<P>{p}<S>{s}<M>{m}"


ODD = [
    None,
    "",
    " ",
    " \t\r\n\x0b\x0c ",
    "a",
    "  lead and trail  ",
    "$1 \\2 ${x} \\",
    "<P",
    "has <M> inside",
    "<<P<S <P< M>",
    "\xa0no blank \x1c\x85 here",
    "漢字 🚴 é\n\nnext  \n",
    "line\nline\r\nline\n",
    "x" * 300_000,
    " " * 300_000,
    "word " * 200_000,
]


def test_outputs(spark):
    rows = [(100 * i + k, t) for i, t in enumerate(ODD) for k in range(6 if len(t or "") > 1000 else 40)]
    rows += [(7, "same id"), (7, "same id"), (None, "no id"), (None, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    params = infill.InfillParams(transformed=90)
    made = infill.infill(docs, params=params)
    found = made.select("*", infill.restore(F.col("output"), F.col("form")).alias("back")).collect()
    want = sorted(repr((i, *expected(i, t, 90), t or "")) for i, t in rows)
    assert sorted(repr(tuple(r)) for r in found) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_rows_keep_their_columns(spark, awkward):
    docs = awkward.withColumn("fim_form", F.lit(1)).withColumn("FIM_n", F.lit(2))
    made = infill.with_infill(docs)
    assert made.columns == [*docs.columns, "fim_form_"]
    before = sorted((repr(r.doc_id), r.text or "") for r in docs.collect())
    back = made.select("doc_id", infill.restore(F.col("text"), F.col("fim_form_")).alias("text"))
    assert sorted((repr(r.doc_id), r.text) for r in back.collect()) == before


def test_no_rows(no_docs):
    assert infill.infill(no_docs).count() == 0


def test_one_pass_without_exchange(awkward):
    plan = infill.infill(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan

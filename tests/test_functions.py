"""Scalar expressions against small Python models."""

from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions import masking, numbers, rules, text

TEXTS = st.lists(
    st.text(st.sampled_from("ab Z9@.;-é \t\n\x1f-drop"), max_size=700), min_size=1, max_size=20
)
FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def evaluate(spark, values, *columns):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = frame.select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]


X = F.col("x")


def test_numbers(spark):
    values = ["", " 12.5 ", "abc", "5d", "1e3", "nan", "inf", "12.9", "-3", None, "1_0", "12.345"]
    assert evaluate(spark, values, numbers.to_double(X, 0.5)) == [
        0.5, 12.5, 0.5, 0.5, 1000.0, 0.5, 0.5, 12.9, -3.0, 0.5, 0.5, 12.345,
    ]
    assert evaluate(spark, values, numbers.to_int(X, 1)) == [1, 12, 1, 1, 1000, 1, 1, 12, -3, 1, 1, 12]
    money = evaluate(spark, values, numbers.to_money(X))
    assert [str(m) for m in money][-1] == "12.35" and str(money[1]) == "12.50"


def test_int_from_double_rounds_ties_to_even(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (2.6,), (None,)], "x double")
    assert [r[0] for r in rows.select(numbers.int_from_double(X)).collect()] == [0, 2, 2, 3, 0]


def test_dates(spark):
    values = ["2026-05-01", "2026-5-1", " 2026-05-01", "2026-02-30", "", "05/01/2026", None]
    found = [str(v) if v else None for v in evaluate(spark, values, numbers.iso_date(X))]
    assert found == ["2026-05-01"] * 3 + [None] * 4


def test_horizons(spark):
    values = ["5d", "999d", "30", "45d", "46d", "d", "0007d", "99999999999999d", "-3d"]
    assert evaluate(spark, values, numbers.horizon_days(X)) == [7, 180, 30, 45, 46, 30, 7, 180, 30]


def test_amounts(spark):
    values = ["127000", "20423", "999", "0", "-34332.6", "100000", "1000"]
    assert evaluate(spark, values, numbers.inr_short(X.cast("double"))) == [
        "₹1.27L", "₹20.4K", "₹999", "₹0", "₹-34,333", "₹1.00L", "₹1.0K",
    ]


@FEW
@given(TEXTS)
def test_chunks_and_vectors(spark, values):
    backwards = F.array_join(F.reverse(F.split(text.strip(X), r"\s+")), " ")
    found = evaluate(
        spark, values, text.chunks(X), text.embedding(X), text.strip(X), text.embedding(backwards)
    )
    for value, (pieces, vector, bare, turned) in zip(values, found, strict=True):
        assert "".join("".join(pieces).split()) == "".join(value.split())
        assert all(0 < len(p) <= 280 and p == p.strip() for p in pieces)
        assert len(vector) == 24
        size = sum(v * v for v in vector)
        assert size == pytest.approx(1, abs=1e-5) or size == 0
        assert bare == bare.strip() and bare in value
        if value.isascii() and "\x1f" not in value:
            assert turned == pytest.approx(vector, abs=1e-6)


def test_vectors_of_known_tokens(spark):
    # slot, sign and weight come from the SHA-256 of the token; worked out by hand for three
    slots = {}
    for token, vector in zip(["rent", "stock", "cash"], evaluate(spark, ["rent", "stock", "cash"], text.embedding(X))):
        (slot,) = [i for i, v in enumerate(vector) if v]
        slots[token] = (slot, vector[slot])
    digests = {t: hashlib.sha256(t.encode()).digest() for t in slots}
    assert {t: int.from_bytes(d[:4], "big") % 24 for t, d in digests.items()} == {t: s for t, (s, _) in slots.items()}
    assert all(abs(v) == pytest.approx(1) for _, v in slots.values())


def test_chunk_borders(spark):
    values = ["", "x" * 280, "x" * 281, "a b", "a  \n b", "é" * 600]
    lengths = [[len(p) for p in pieces] for pieces in evaluate(spark, values, text.chunks(X))]
    assert lengths == [[], [280], [280, 1], [3], [3], [280, 280, 40]]


def test_masking(spark):
    values = ["Ann", " Ann ", "call 98765432101 now", "a@b.c", "x a@b.c y", "  ", "1234567", "123456", None]
    keys = ["notes", "email", "phone", "address", "Owner"]
    ann = hashlib.sha1(b"Ann").hexdigest()[:8]
    phone = "+91-XXXX-XXXX"
    found = evaluate(spark, values, *[masking.mask_value(k, X) for k in keys])
    assert found[0] == ("Ann", f"email-{ann}@example.com", phone, f"address-{ann.upper()}", f"owner-{ann.upper()}")
    assert found[1][1:] == found[0][1:] and found[1][0] == " Ann "
    assert found[2][0] == found[2][3] == found[2][4] == phone and found[2][1].endswith("@example.com")
    assert len(set(found[3][:2])) == 1 and found[3][0].startswith("email-")
    assert found[4][0].startswith("email-") and found[5] == ("  ",) * 5
    assert found[6][0] == phone and found[7][0] == "123456" and found[8] == (None,) * 5


def test_masking_can_keep_plain_numbers(spark):
    values = ["1234567", "12345678.50", "call 1234567"]
    assert evaluate(spark, values, masking.mask_value("sku", X, True)) == [
        "1234567", "12345678.50", "+91-XXXX-XXXX",
    ]


def test_nested_masking(spark):
    schema = T._parse_datatype_string(
        "owner array<string>, info struct<email:string, qty:int, tags:array<struct<name:string>>>"
    )
    rows = spark.createDataFrame([(["Ann", " "], ("x", 3, [("Bob",)])), (None, None)], schema)
    first, second = masking.mask_columns(rows).collect()
    assert first.owner == ["owner-" + hashlib.sha1(b"Ann").hexdigest()[:8].upper(), " "]
    assert first.info.email == f"email-{hashlib.sha1(b'x').hexdigest()[:8]}@example.com"
    assert first.info.qty == 3
    assert first.info.tags[0].name == "name-" + hashlib.sha1(b"Bob").hexdigest()[:8].upper()
    assert second.owner is None and second.info is None


def test_map_values_are_masked_by_their_key(spark):
    schema = "owner map<string,string>, more map<string,array<string>>, n map<int,string>"
    cells = {"Email": "x", "phone": "12", "memo": "none", "sku": "7", "name": "Ann", "mobile": None}
    rows = spark.createDataFrame([(cells, {"address": ["Here"]}, {1: "1234567"}), (None, None, None)], schema)
    first, second = masking.mask_columns(rows).collect()
    assert first.owner["Email"].endswith("@example.com") and first.owner["phone"] == "+91-XXXX-XXXX"
    assert first.owner["sku"] == "7" and first.owner["memo"] == "none" and first.owner["mobile"] is None
    assert first.owner["name"].startswith("name-") and first.more["address"][0].startswith("address-")
    assert first.n[1] == "+91-XXXX-XXXX" and tuple(second) == (None, None, None)


def test_numbers_out_of_range_are_null(spark):
    values = ["12345678901.50", "99999999999", "-1e400", "9999999999.99", ""]
    money = evaluate(spark, values, numbers.to_money(X))
    assert [m if m is None else str(m) for m in money] == [None, None, None, "9999999999.99", "0.00"]
    assert evaluate(spark, values, numbers.to_int(X, 1)) == [None, None, None, None, 1]


def test_questions(spark):
    values = [
        "Why did profit drop this month?", "sales dropped", "predict why", "a; b", "a -- b",
        "Top PRODUCTS that sell", "expense spike", "drop table x", "hello",
    ]
    found = evaluate(
        spark, values, text.is_blocked(X), text.is_blocked(X, "statement"), text.task_class(X),
        text.insight_route(X),
    )
    assert [f[0] for f in found] == [True, False, False, True, True, False, False, True, False]
    assert [f[1] for f in found] == [False, False, False, True, True, False, False, True, False]
    assert found[1][2] == "investigate" and found[2][2] == "recommend"
    assert (found[5][3], found[6][3], found[8][3]) == ("top_products", "top_expenses", None)


def test_enumerations(spark):
    values = ["due", "Paid", " Snoozed ", None, "annual", "hybrid", "owner"]
    found = evaluate(
        spark, values, rules.obligation_status(X), rules.recurrence(X), rules.action_status(X),
        rules.provider_mode(X), rules.role_rank(X),
    )
    assert [f[0] for f in found] == ["due"] + ["scheduled"] * 6
    assert found[4][1] == "annual" and found[0][1] == "monthly"
    assert found[2][2] == "snoozed" and found[3][2] == "watching"
    assert found[5][3] == "hybrid" and found[0][3] == "local-open"
    assert found[6][4] == 3 and found[0][4] == 0


def test_providers(spark):
    rows = spark.createDataFrame(
        [
            ("local-open", "investigate", ["A"]),
            ("byo-cloud", "investigate", []),
            ("byo-cloud", "summarize", []),
            ("byo-cloud", "summarize", ["a", " B ", "b", ""]),
            ("hybrid", "investigate", ["a", "b"]),
            ("hybrid", "recommend", ["a"]),
            ("hybrid", "investigate", None),
        ],
        "mode string, task string, names array<string>",
    )
    names = rules.provider_list(F.col("names"))
    found = rows.select(rules.choose_provider(F.col("mode"), F.col("task"), names)).collect()
    assert [r[0] for r in found] == [
        "ollama-local", "openai", "openrouter", "b", "a", "ollama-local", "ollama-local",
    ]


def test_json_of_any_shape_is_masked_by_key(spark):
    given = [
        '{"a": {"email": "x"}, "name": ["N", {"memo": "m", "phone": 5}, "N"], "memo": "a \\"b\\" {[:]}"}',
        '["plain", ["b@c.de"], {"Title" : "t", "x": {"y": []}}, " ", null, 12345678]',
        '"alone"',
        '{"notes": "call 1234567 \\u00e9", "owner": ""}',
        None,
    ]
    frame = spark.createDataFrame(list(enumerate(given)), "n int, text string")
    found = [r.m for r in frame.select("n", masking.mask_json_text(F.col("text")).alias("m")).orderBy("n").collect()]

    def alias(prefix, text):
        return f"{prefix}-{hashlib.sha1(text.encode()).hexdigest()[:8].upper()}"

    name = alias("name", "N")
    mail = alias("email", "b@c.de").lower() + "@example.com"
    assert json.loads(found[0]) == {
        "a": {"email": alias("email", "x").lower() + "@example.com"},
        "name": [name, {"memo": "m", "phone": 5}, name],
        "memo": 'a "b" {[:]}',
    }
    assert found[1] == f'["plain", ["{mail}"], {{"Title" : "{alias("title", "t")}", "x": {{"y": []}}}}, " ", null, 12345678]'
    assert found[2:] == ['"alone"', '{"notes": "+91-XXXX-XXXX", "owner": ""}', None]


def test_a_json_string_is_read_once():
    """Keys and values are each read by one expression, however many rules look at them."""
    made = masking.mask_json_text(F.col("x"))._jc.toString().lower()
    assert made.count("from_json") + made.count("jsontostructs") == 2

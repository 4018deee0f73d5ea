"""Fill-in-the-middle rows by one counted-quantifier match per text.

A text is a run of n units: white space with the word behind it, or the white space at the
end. ``regexp_count`` gives n, two hashed numbers give the cuts a <= b, and each row gets a
pattern of its own, ``((?:unit){a}+)((?:unit){b-a}+)(.*)``, whose one match is replaced by the
three parts in their new order. The quantifiers are possessive, so the match keeps no way
back: it walks the text once, in bounded memory, however long the text is. All of it is
column expressions; no row leaves its partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import free_name

#: Blanks are space, tab, line feed, VT, form feed and return; the three marks.
BLANK = r"[\x20\x09-\x0D]"
SOLID = r"[^\x20\x09-\x0D]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = f"(?:{BLANK}*+{SOLID}++|{BLANK}++)"


@dataclass(frozen=True)
class InfillParams:
    seed: int = 42
    #: of 100 documents so many are transformed, and of 100 transformed ones so many suffix first
    transformed: int = 50
    suffix_first: int = 80


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers from the digest of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _pattern(first: Column, second: Column) -> Column:
    """Matches a whole text: ``first`` units, ``second`` units, the rest."""
    parts = [r"(?s)\A((?:", UNIT, "){", first, "}+)((?:", UNIT, "){", second, r"}+)(.*+)\z"]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _moved(docs: DataFrame, doc_id: str, text: str, params: InfillParams) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns made here, under names that it does not have."""
    names: dict[str, str] = {}
    for wanted in ("value", "n", "draws", "form", "first_cut", "last_cut", "output"):
        names[wanted] = free_name([*docs.columns, *names.values()], f"fim_{wanted}")
    value, n, h, form, first, last = [F.col(name) for name in list(names.values())[:6]]
    marked = [value.contains(mark) for mark in (PREFIX, SUFFIX, MIDDLE)]
    plain = (value == "") | marked[0] | marked[1] | marked[2] | (h[2] % 100 >= params.transformed)
    cuts = [h[i] % (n + 1) for i in (0, 1)]
    order = F.when(form == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    steps = {
        "value": F.coalesce(F.col(f"`{text}`"), F.lit("")),
        "n": F.regexp_count(value, F.lit(UNIT)).cast("long"),
        "draws": F.array(*_draws(F.col(f"`{doc_id}`"), params.seed)),
        "form": F.when(plain, "plain").when(h[3] % 100 < params.suffix_first, "spm").otherwise("psm"),
        "first_cut": F.when(form != "plain", F.least(*cuts)),
        "last_cut": F.when(form != "plain", F.greatest(*cuts)),
        "output": F.when(form == "plain", value).otherwise(
            F.regexp_replace(value, _pattern(first, last - first), order)
        ),
    }
    for wanted, column in steps.items():
        docs = docs.withColumn(names[wanted], column)
    return docs, names


def infill(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: InfillParams | None = None
) -> DataFrame:
    """One row per input row: doc_id, n (units), form, first_cut, last_cut (units before them), output.

    Form is ``plain`` (output is the text), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix,
    prefix, middle). A null text counts as empty and an empty one is plain, as is a text that
    holds one of the marks, so that every output can be undone. Cuts are null for plain rows.
    Repeated rows give equal rows, an empty table an empty result; other columns are not looked
    at.
    """
    moved, names = _moved(docs, doc_id, text, params or InfillParams())
    shown = ("n", "form", "first_cut", "last_cut", "output")
    return moved.select(F.col(f"`{doc_id}`").alias("doc_id"), *[F.col(names[c]).alias(c) for c in shown])


def with_infill(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: InfillParams | None = None
) -> DataFrame:
    """``docs`` with ``text`` replaced by its output; the form is a last column ``fim_form``.

    All other columns stay; the new name is lengthened if the table has it already.
    """
    moved, names = _moved(docs, doc_id, text, params or InfillParams())
    columns = [F.col(names["output"]).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return moved.select(*columns, names["form"])


def parts(output: Column, form: Column) -> dict[str, Column]:
    """prefix, middle and suffix of an output; null where the form is plain."""
    mark = {name: F.locate(name, output) for name in (PREFIX, SUFFIX, MIDDLE)}
    end = F.length(output) + 1
    ahead = {PREFIX: F.when(form == "psm", mark[SUFFIX]).otherwise(mark[MIDDLE])}
    ahead[SUFFIX] = F.when(form == "psm", mark[MIDDLE]).otherwise(mark[PREFIX])
    ahead[MIDDLE] = end
    return {
        name: F.when(form != "plain", F.substring(output, mark[at] + 3, ahead[at] - mark[at] - 3))
        for name, at in (("prefix", PREFIX), ("middle", MIDDLE), ("suffix", SUFFIX))
    }


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = parts(output, form)
    whole = F.concat(part["prefix"], part["middle"], part["suffix"])
    return F.when(form == "plain", output).otherwise(whole)

"""Chat formatting by a finite-state machine over roles.

A declarative template names the markers, the allowed changes of state and the roles whose
text is learned. Each conversation becomes a list of text segments with a loss flag each; the
segments joined are the formatted text. Control strings inside a text are escaped, reversibly:
``<`` and ``|`` around any number of backslashes get one more backslash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _changes() -> dict[str, dict[str, str]]:
    return {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"assistant": "assistant", "tool": "tool"},
    }


@dataclass(frozen=True)
class ChatTemplate:
    """Markers must begin with ``<|`` so that escaped text cannot hold one."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    changes: dict[str, dict[str, str]] = field(default_factory=_changes)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role must not end its own line either: line feeds and backslashes are escaped too."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = unescape(role)
    marked = F.replace(plain, F.lit("\\\\"), F.lit("\\s"))
    return F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def format_conversations(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: ChatTemplate | None = None,
) -> DataFrame:
    """One row per conversation: conv_id, segments, formatted, valid, first_error.

    ``segments`` is an array of (text, loss). Turns go by turn number, null first; turns with
    the same number go by role, then text; repeated rows are repeated turns. Null role and
    text count as empty, rows with a null conversation id form one conversation. ``valid``
    says whether the machine accepts the order of roles, ``first_error`` is the place (from
    0) of the first turn it refuses, or the number of turns where the last state does not
    accept; an invalid conversation is formatted all the same. An empty table gives an empty
    result. A conversation is one row, so it has to fit into one cell (2 GB).
    """
    template = template or ChatTemplate()
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            _text(F.col(role)).alias("role"),
            _text(F.col(text)).alias("text"),
        ).alias("said"),
    )
    said = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))

    moves = [
        part
        for state, by_role in template.changes.items()
        for name, following in by_role.items()
        for part in (F.lit(f"{state}\x00{name}"), F.lit(following))
    ]
    table = F.create_map(*moves)

    def step(at: Column, one: Column) -> Column:
        following = F.try_element_at(table, F.concat(at["state"], F.lit("\x00"), one["role"]))
        state = F.when(at["error"].isNull(), following).otherwise(at["state"])
        error = F.when(at["error"].isNull() & following.isNull(), at["place"])
        return F.struct(
            F.coalesce(state, at["state"]).alias("state"),
            (at["place"] + 1).alias("place"),
            F.coalesce(at["error"], error).alias("error"),
        )

    begin = F.struct(
        F.lit(template.start).alias("state"),
        F.lit(0).alias("place"),
        F.lit(None).cast("int").alias("error"),
    )
    ran = said.withColumn("ran", F.aggregate("said", begin, step))

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def emitted(one: Column) -> Column:
        head = F.concat(F.lit(template.opening), escape_role(one["role"]), F.lit(template.after_role))
        return F.array(
            segment(head, F.lit(False)),
            segment(escape(one["text"]), one["role"].isin(*template.learned)),
            segment(F.lit(template.closing), F.lit(False)),
        )

    accepted = F.col("ran.state").isin(*template.accepting)
    error = F.coalesce(F.col("ran.error"), F.when(~accepted, F.col("ran.place")))
    emitted_rows = ran.select(
        "conv_id",
        F.flatten(F.transform("said", emitted)).alias("segments"),
        error.isNull().alias("valid"),
        error.alias("first_error"),
    )
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return emitted_rows.select("conv_id", "segments", joined.alias("formatted"), "valid", "first_error")


def read_back(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Adds ``turns`` (role, text), parsed from ``formatted``, and ``learned``, the unescaped
    text of all segments under the loss mask, one after the other."""
    template = template or ChatTemplate()
    pieces = F.slice(F.split("formatted", _quoted(template.opening)), 2, 10**9)

    def parsed(piece: Column) -> Column:
        role = F.substring_index(piece, template.after_role, 1)
        begin = F.length(role) + len(template.after_role)
        body = F.substring(piece, begin + 1, F.length(piece) - begin - len(template.closing))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.withColumns(
        {"turns": F.transform(pieces, parsed), "learned": F.array_join(masked, "")}
    )


def _quoted(marker: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in marker)

"""Masking of personal data in columns and nested values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark import fixed_values as V
from ledgerspark.functions.text import strip


def _alias(prefix: str, text: Column) -> Column:
    digest = F.substring(F.sha1(text), 1, 8)
    return F.concat(F.lit(f"{prefix}-"), F.upper(digest))


def mask_value(key: str, value: Column, digits_only_in_text: bool = False) -> Column:
    """Masked text of one cell; the column name decides first, then the content.

    ``digits_only_in_text`` leaves cells alone that are nothing but a number, so that
    amounts and article numbers of seven digits are not taken for phone numbers.
    """
    name = key.lower()
    text = strip(value)
    email = F.lower(_alias("email", text))
    email = F.concat(email, F.lit(V.MASKED_EMAIL_DOMAIN))

    is_email = F.lit(True) if name in V.EMAIL_KEYS else text.rlike(V.EMAIL_PATTERN)
    is_phone = F.lit(True) if name in V.PHONE_KEYS else text.rlike(V.PHONE_PATTERN)
    if digits_only_in_text and name not in V.PHONE_KEYS:
        is_phone = is_phone & ~text.rlike(r"^[+-]?\p{Nd}+([.]\p{Nd}+)?$")

    if name in V.ADDRESS_KEYS:
        rest = _alias("address", text)
    elif name in V.NAME_KEYS:
        rest = _alias(name, text)
    else:
        rest = value
    return (
        F.when(value.isNull() | (text == ""), value)
        .when(is_email, email)
        .when(is_phone, V.MASKED_PHONE)
        .otherwise(rest)
    )


def mask_nested(
    value: Column, data_type: T.DataType, key: str = "", digits_only_in_text: bool = False
) -> Column:
    """Masked copy of a nested value; list items take their parent's key, map values their own.

    The type tree is walked once when the plan is built; rows only meet expressions. A map's
    keys are known per entry only, so every rule that a key can choose is built for its values.
    """

    def walk(v: Column, t: T.DataType, k: str) -> Column:
        return mask_nested(v, t, k, digits_only_in_text)

    if isinstance(data_type, T.StringType):
        return mask_value(key, value, digits_only_in_text)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: walk(item, data_type.elementType, key))
    if isinstance(data_type, T.StructType):
        fields = [walk(value[f.name], f.dataType, f.name).alias(f.name) for f in data_type]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(data_type, T.MapType):
        return F.when(
            value.isNotNull(),
            F.map_from_entries(
                F.transform(
                    F.map_entries(value),
                    lambda entry: F.struct(
                        entry["key"].alias("key"),
                        _by_entry_key(entry, data_type, key, walk).alias("value"),
                    ),
                )
            ),
        )
    return value


def _by_entry_key(entry: Column, data_type: T.MapType, key: str, walk) -> Column:
    """Masked value of a map entry, by the rule that its key chooses."""
    if not isinstance(data_type.keyType, T.StringType):
        return walk(entry["value"], data_type.valueType, key)
    return _by_key(entry["key"], lambda k: walk(entry["value"], data_type.valueType, k))


def _by_key(key: Column, masked_as: Callable[[str], Column]) -> Column:
    """The rule for a key that is known per row only."""
    name = F.lower(key)
    masked = masked_as("")
    groups = [V.EMAIL_KEYS, V.PHONE_KEYS, V.ADDRESS_KEYS, *[[n] for n in sorted(V.NAME_KEYS)]]
    for names in groups:
        masked = F.when(name.isin(*sorted(names)), masked_as(sorted(names)[0])).otherwise(masked)
    return masked


#: A string with the colon behind it if it is a key, a bracket, or what stands between them.
JSON_TOKEN = r'''(?s)"(?:[^"\\]++|\\.)*+"(?:\s*+:)?+|[{}\[\]]|[^"{}\[\]]++'''


def mask_json_text(text: Column, digits_only_in_text: bool = False) -> Column:
    """JSON text of any shape with every string in it masked by the key that it stands under.

    No schema is needed and rows may differ in shape. The text is cut into tokens; a
    running stack of keys, one per open bracket, gives each token its key, and items of a list have
    the list's key. All but masked strings stays as it was written, order and spacing included.
    ``text`` must be valid JSON; NULL stays NULL. Cost grows with the square of the number of tokens
    of one value, so files of many objects are masked object by object.
    """
    tokens = F.regexp_extract_all(text, F.lit(JSON_TOKEN), F.lit(0))
    texts = "array<string>"
    start = F.struct(F.array().cast(texts).alias("open"), F.array().cast(texts).alias("keys"))

    def step(seen: Column, token: Column) -> Column:
        is_open, is_close = token.isin("{", "["), token.isin("}", "]")
        is_key = token.startswith('"') & token.endswith(":")
        named = _unquoted(F.regexp_replace(token, r"\s*:$", ""))
        depth = F.size(seen["open"])
        before = F.when(F.size(seen["keys"]) > 0, F.element_at(seen["keys"], -1)).otherwise("")
        back = F.when(depth > 0, F.element_at(seen["open"], -1)).otherwise("")
        key = F.when(is_key, named).when(is_close, back).otherwise(before)
        held = (
            F.when(is_open, F.concat(seen["open"], F.array(before)))
            .when(is_close, F.slice(seen["open"], 1, F.greatest(depth - 1, F.lit(0))))
            .otherwise(seen["open"])
        )
        return F.struct(held.alias("open"), F.concat(seen["keys"], F.array(key)).alias("keys"))

    keys = F.aggregate(tokens, start, step, lambda seen: seen["keys"])

    # each string is read out of its token once and masked once, whatever the rules ask of it
    def read(token: Column, key: Column) -> Column:
        is_value = token.startswith('"') & ~token.endswith(":")
        value = F.when(is_value, _unquoted(token))
        return F.struct(token.alias("token"), key.alias("key"), value.alias("value"))

    def masked(item: Column) -> Column:
        new = _by_key(item["key"], lambda k: mask_value(k, item["value"], digits_only_in_text))
        new = F.when(item["value"].isNotNull(), new)
        return F.struct(item["token"].alias("token"), item["value"].alias("value"), new.alias("new"))

    def written(item: Column) -> Column:
        return F.when(item["new"] != item["value"], _quoted(item["new"])).otherwise(item["token"])

    items = F.transform(F.zip_with(tokens, keys, read), masked)
    return F.array_join(F.transform(items, written), "")


def _unquoted(token: Column) -> Column:
    """Text of a JSON string; one without escapes stands between its quotes."""
    bare = F.substring(token, F.lit(2), F.length(token) - 2)
    parsed = F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]
    return F.when(token.contains("\\"), parsed).otherwise(bare)


def _quoted(value: Column) -> Column:
    """A string as a JSON token."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def mask_columns(df, digits_only_in_text: bool = False):
    """Frame with every string in it masked, at any depth."""
    return df.select(
        [
            mask_nested(F.col(f"`{f.name}`"), f.dataType, f.name, digits_only_in_text).alias(
                f.name
            )
            for f in df.schema
        ]
    )

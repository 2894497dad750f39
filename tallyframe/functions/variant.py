"""JSON of unknown shape, through VARIANT."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F


#: How a JSON value begins.
BEGINS = r'^[ \t\n\r]*["{\[0-9tfn-]'


def _path(name: str) -> str:
    return f"$[{json.dumps(name)}]" if "'" in name else f"$['{name}']"


def parse(text: Column) -> Column:
    """VARIANT of a text that is one JSON value; null if it is null or malformed, or if anything stands behind the value.

    The built-in parser stops at the end of the first value. So the text is put into a list, before a hash of itself:
    only a text that is one value leaves that hash in second place. A name that an object has twice is malformed.
    """
    mark = F.xxhash64(text)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    # transform over one element binds the list, so it is parsed once
    return F.element_at(F.transform(F.array(listed), lambda x: F.when(F.try_variant_get(x, "$[1]", "bigint") == mark, F.try_variant_get(x, "$[0]", "variant"))), 1)


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def is_text(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def field(value: Column, name: str, as_type: str = "variant") -> Column:
    """A member of an object; null if absent or not of the type."""
    return F.try_variant_get(value, _path(name), as_type)


def number(value: Column) -> Column:
    """Numbers, numeric texts, and truth values as 1 and 0; null for anything else."""
    return F.try_variant_get(value, "$", "double")


def truthy(value: Column) -> Column:
    """False for absent, null, false, zero, and empty text, array or object; any other text is true."""
    written = F.to_json(value)
    empty = written.isin("null", "false", '""', "[]", "{}")
    zero = ~is_text(value) & F.coalesce(number(value) == 0, F.lit(False))
    return value.isNotNull() & ~F.coalesce(empty, F.lit(True)) & ~zero


#: Tokens of JSON without escapes: a text, a number, a word, anything between.
_TOKEN = r'"[^"]*"|-?[0-9][0-9.Ee+-]*|[a-z]+|[^"0-9a-z-]+'


def _plain_token(t: Column) -> Column:
    d = t.try_cast("double")
    whole = F.when((F.abs(d) < 1e37) & (d % 1 == 0), d.cast("decimal(38,0)").cast("string")).otherwise(d.cast("string"))
    return F.when(t == "true", F.lit("1")).when(t == "false", F.lit("0")).when(t.rlike("^-?[0-9].*[.E]"), whole).otherwise(t)


def _canonical_text(written: Column) -> Column:
    # control characters never occur in written JSON, so they can stand for escapes
    flat = F.replace(F.replace(written, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    tokens = F.transform(F.regexp_extract_all(flat, F.lit(_TOKEN), F.lit(0)), _plain_token)
    return F.when(written.startswith('"'), written).when(written.rlike("[.E]|true|false"), F.array_join(tokens, "")).otherwise(flat)


def canonical(value: Column) -> Column:
    """JSON of a VARIANT with sorted names, such that equal values have equal texts: 1, 1.0, 1e0 and true are one value, as are 0 and false."""
    return F.element_at(F.transform(F.array(F.to_json(value)), _canonical_text), 1)


def members(value: Column) -> Column:
    """Members of a JSON object as canonical texts by name; JSON null becomes null, other JSON gives null."""
    cast = F.when(is_object(value), value.cast("map<string,variant>"))
    return F.transform_values(cast, lambda _, v: F.when(~F.is_variant_null(v), canonical(v)))

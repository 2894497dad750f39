"""Prompt templates as columns: a template is read once on the driver and becomes one expression."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, MapType, NumericType, StringType, StructType

_TAG = re.compile(r"\{\{\s*(.*?)\s*\}\}", re.DOTALL)
#: A line that holds nothing but one tag of a block is no line of the result.
_ALONE = re.compile(r"^[ \t]*(\{\{\s*(?:[#/][^{}]*|else)\s*\}\})[ \t]*(?:\r?\n|\Z)", re.MULTILINE)


@dataclass(frozen=True)
class Block:
    """``if`` or ``each`` over a name, with what stands within and behind ``else``."""

    kind: str
    name: str
    body: tuple
    other: tuple = ()


@dataclass(frozen=True)
class Value:
    """A name, or a sum of names and numbers."""

    names: tuple[str, ...]


def parse(template: str) -> tuple:
    """Texts, values and blocks of a template; a block that is not closed, or closed or divided without being open, is an error."""
    open_: list[tuple[str, str, list, list | None]] = [("", "", [], None)]
    at = 0
    source = _ALONE.sub(r"\1", template)
    for tag in _TAG.finditer(source):
        put = open_[-1][3] if open_[-1][3] is not None else open_[-1][2]
        if tag.start() > at:
            put.append(source[at : tag.start()])
        at = tag.end()
        word, *rest = tag[1].split() or [""]
        if word in ("#if", "#each"):
            if len(rest) != 1:
                raise ValueError(f"{tag[0]} needs one name")
            open_.append((word[1:], rest[0], [], None))
        elif word == "else" and not rest:
            if len(open_) == 1 or open_[-1][3] is not None:
                raise ValueError("else without a block")
            open_[-1] = (*open_[-1][:3], [])
        elif word in ("/if", "/each"):
            if open_[-1][0] != word[1:]:
                raise ValueError(f"{tag[0]} closes no block")
            kind, name, body, other = open_.pop()
            (open_[-1][3] if open_[-1][3] is not None else open_[-1][2]).append(Block(kind, name, tuple(body), tuple(other or ())))
        elif word == "add" and rest:
            put.append(Value(tuple(rest)))
        elif word and not rest and word[0] not in "#/":
            put.append(Value((word,)))
        else:
            raise ValueError(f"unknown tag {tag[0]}")
    if len(open_) > 1:
        raise ValueError(f"{{{{#{open_[-1][0]} {open_[-1][1]}}}}} is not closed")
    if at < len(source):
        open_[0][2].append(source[at:])
    return tuple(open_[0][2])


def _truth(value: Column, kind: DataType) -> Column:
    """False for null, false, 0, NaN, and an empty text, array or map."""
    if isinstance(kind, (ArrayType, MapType)):
        held = F.size(value) > 0
    elif isinstance(kind, BooleanType):
        held = value
    elif isinstance(kind, NumericType):
        held = (value != 0) & ~F.isnan(value.cast("double"))
    elif isinstance(kind, StringType):
        held = value != ""
    else:
        held = value.isNotNull()
    return F.coalesce(held, F.lit(False))


def _text(value: Column, kind: DataType) -> Column:
    """Null is empty; the elements of an array stand between commas, structs and maps as JSON."""
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, (ArrayType, MapType, StructType)):
        made = F.array_join(F.transform(value, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",")
    elif isinstance(kind, (ArrayType, MapType, StructType)):
        made = F.to_json(value)
    else:
        made = value.cast("string")
    return F.coalesce(made, F.lit(""))


_Names = dict[str, tuple[Column, DataType]]


def _find(names: _Names, path: str) -> tuple[Column, DataType] | None:
    """The value of a dotted path, None if there is no such name."""
    first, *rest = path.split(".")
    found = names.get(first)
    for name in rest:
        if found is None:
            return None
        value, kind = found
        if isinstance(kind, StructType):
            found = (value[name], kind[name].dataType) if name in kind.names else None
        elif isinstance(kind, MapType):
            found = (F.try_element_at(value, F.lit(name)), kind.valueType)
        else:
            return None
    return found


def _sum(names: _Names, parts: tuple[str, ...]) -> Column:
    terms = []
    for part in parts:
        found = None if re.fullmatch(r"-?\d+", part) else _find(names, part)
        terms.append(F.lit(int(part)) if re.fullmatch(r"-?\d+", part) else found[0] if found else F.lit(None))
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.coalesce(total.cast("string"), F.lit(""))


def _compiled(parts: tuple, names: _Names) -> Column:
    made = []
    for part in parts:
        if isinstance(part, str):
            made.append(F.lit(part))
        elif isinstance(part, Value):
            found = _find(names, part.names[0]) if len(part.names) == 1 else None
            made.append(_sum(names, part.names) if len(part.names) > 1 else _text(*found) if found else F.lit(""))
        else:
            found = _find(names, part.name)
            other = _compiled(part.other, names)
            if found is None:
                made.append(other)
            elif part.kind == "if":
                made.append(F.when(_truth(*found), _compiled(part.body, names)).otherwise(other))
            else:
                value, kind = found
                if not isinstance(kind, ArrayType):
                    raise ValueError(f"{part.name} is no array")
                made.append(F.when(_truth(value, kind), F.array_join(F.transform(value, _each(part.body, names, kind.elementType)), "")).otherwise(other))
    return F.concat(*made) if made else F.lit("")


def _each(body: tuple, names: _Names, kind: DataType) -> Callable[[Column, Column], Column]:
    return lambda x, k: _compiled(body, names | {"this": (x, kind), "@index": (k, IntegerType())})


def render(df: DataFrame, template: str) -> Column:
    """The template filled in for each row of ``df``: ``{{name}}``, ``{{a.b}}`` for members, ``{{#if name}} ... {{else}} ... {{/if}}``, ``{{#each array}} ... {{/each}}`` with ``{{this}}``, ``{{this.member}}`` and ``{{@index}}`` (from 0), ``{{add a b}}`` for sums.

    Names are columns; one that is absent or null is an empty text and not true. Blocks nest, names from outside hold within. Null elements are empty texts. Lines with nothing but a block's tag are left out.
    """
    return _compiled(parse(template), {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields})

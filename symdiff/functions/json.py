"""JSON values as VARIANT columns: parsing, types, access with defaults, changes by rebuilding, and writing."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse(text: Column) -> Column:
    """Null where the text isn't JSON."""
    return F.try_parse_json(text)


def kind(value: Column) -> Column:
    """The value's type: null, BOOLEAN, BIGINT, DOUBLE, STRING, ARRAY<...> or OBJECT<...>."""
    return F.schema_of_variant(value)


def get(value: Column, path: str, as_type: str, default=None) -> Column:
    """What a path leads to, in a type; the default where there is nothing of that type."""
    found = F.try_variant_get(value, path, as_type)
    return found if default is None else F.coalesce(found, F.lit(default).cast(as_type))


def is_member(text: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(text), name), F.lit(False))


def members(text: Column) -> Column:
    return F.array_sort(F.json_object_keys(text))


def size(text: Column) -> Column:
    """Entries of an array or members of an object."""
    return F.coalesce(F.json_array_length(text), F.size(F.json_object_keys(text)))


def appended(array: Column, element: Column) -> Column:
    return F.array_append(array, element)


def without_member(entries: Column, name: str) -> Column:
    """A MAP without a member."""
    return F.map_filter(entries, lambda k, _: k != name)


def resized(array: Column, n: int) -> Column:
    """The first n entries, filled up with nulls."""
    return F.slice(F.concat(array, F.transform(F.sequence(F.lit(1), F.lit(max(1, n))), lambda _: F.get(array, F.lit(-1)))), 1, n)


def write(value: Column, pretty: bool = False) -> Column:
    return F.to_json(value, {"pretty": "true"} if pretty else {})


# The order of types.
TYPES = ("VOID", "BIGINT", "DECIMAL", "DOUBLE", "STRING", "BOOLEAN", "ARRAY", "OBJECT")


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by type first (all numbers are one), then by value; arrays and objects by size, then by their text."""

    def rank(v: Column) -> Column:
        name, out = kind(v), F.lit(len(TYPES))
        for i, t in enumerate(TYPES):
            out = F.when(name.startswith(t), 1 if t in ("BIGINT", "DECIMAL", "DOUBLE") else i).otherwise(out)
        return out

    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    number = sign(F.try_variant_get(a, "$", "double"), F.try_variant_get(b, "$", "double"))
    flag = sign(F.try_variant_get(a, "$", "boolean"), F.try_variant_get(b, "$", "boolean"))
    text, size_of = lambda v: F.to_json(v), lambda v: size(F.to_json(v))
    word = sign(F.try_variant_get(a, "$", "string"), F.try_variant_get(b, "$", "string"))
    whole = F.when(size_of(a) == size_of(b), sign(text(a), text(b))).otherwise(sign(size_of(a), size_of(b)))
    same = F.when(rank(a) == 0, 0).when(rank(a) == 1, number).when(rank(a) == 4, word).when(rank(a) == 5, flag).otherwise(whole)
    return F.when(rank(a) == rank(b), same).otherwise(sign(rank(a), rank(b)))


def entries(df: DataFrame, value: str, *keep: str) -> DataFrame:
    """(keep..., pos, key, value): the members of objects by name, the elements of arrays by place."""
    rows = df.select(*keep, F.col(value).alias("__value"))
    return rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__value").outer())).select(*keep, "pos", "key", "value")


# Errors and changes by path: Arrow functions, as Spark's parsers don't say where a text goes wrong


def refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


@F.pandas_udf(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("message", T.StringType())]))
def problem(texts: pd.Series) -> pd.DataFrame:
    """Where (code points before it, from 0, and the line, from 1) and why a text isn't JSON; nulls for JSON and for null."""

    def one(text):
        try:
            if text is not None:
                json.loads(text, parse_constant=refuse)
        except json.JSONDecodeError as e:
            return e.pos, e.lineno, e.msg
        except ValueError as e:  # NaN and infinities
            return None, None, str(e)
        return None, None, None

    rows = [one(x) for x in texts]
    return pd.DataFrame({"at": pd.array([r[0] for r in rows], "Int32"), "line": pd.array([r[1] for r in rows], "Int32"), "message": [r[2] for r in rows]})


STEP = re.compile(r"\.([^.\[\]]+)|\[(\d+)\]")


def steps(path: str) -> list[str | int]:
    """The names and places of a path like $.a.b[1]."""
    found = list(STEP.finditer(path))
    if not path.startswith("$") or "".join(m[0] for m in found) != path[1:]:
        raise ValueError(f"{path} is no path")
    return [m[1] if m[1] is not None else int(m[2]) for m in found]


def put(node: object, way: list[str | int], value: object) -> object:
    """node with the value at the end of the way; nothing and null become objects and arrays where these are needed."""
    if not way:
        return value
    first, rest = way[0], way[1:]
    if isinstance(first, str):
        if node is not None and not isinstance(node, dict):
            raise TypeError(first)
        node = node or {}
        return {**node, first: put(node.get(first), rest, value)}
    if node is not None and not isinstance(node, list):
        raise TypeError(first)
    out = list(node or [])
    out += [None] * (first + 1 - len(out))
    out[first] = put(out[first], rest, value)
    return out


def made(text: Column, path: str, value: Column) -> Column:
    """The JSON text with a value, JSON as well, at a path that is made as far as it isn't there. Null where text or value is null or no JSON, or
    where something else than an object or array is in the way."""
    way = steps(path)

    @F.pandas_udf("string")
    def changed(texts: pd.Series, values: pd.Series) -> pd.Series:
        def one(text, new):
            try:
                return None if text is None or new is None else json.dumps(put(json.loads(text), way, json.loads(new)), separators=(",", ":"), ensure_ascii=False)
            except (ValueError, TypeError):
                return None

        return pd.Series([one(*x) for x in zip(texts, values, strict=True)], dtype=object)

    return changed(text, value)

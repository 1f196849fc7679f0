"""Canonical JSON and content hashes of payload columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.jsontext import Unreadable, canonical, clean, read


def _canonical(text: str | None) -> str | None:
    try:
        return None if text is None else canonical(read(text))
    except Unreadable:
        return None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Compact JSON with sorted names; null for null and for what is no JSON."""
    return texts.map(_canonical)


def content_hash(canonical_text: Column) -> Column:
    """Hex SHA-256 of a canonical text: equal for equal payloads."""
    return F.sha2(canonical_text, 256)


def finite(col: Column) -> Column:
    """A number, or null for NaN and the infinities."""
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).otherwise(col)


#: A list of path, old and new.
FIELDS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("path", "old", "new")]))


def field_changes(old: str | None, new: str | None) -> list[dict]:
    """The leaves in which two JSON texts differ: path, and JSON text of the old and new value (None: not there).

    Objects are compared member by member in the order of their names, everything else whole; ``1``, ``1.0`` and
    ``"1"`` differ, and so do an absent member and null. Nothing is said of a payload that is missing or unreadable.
    """
    try:
        a, b = read(old), read(new)
    except Unreadable:
        return []
    none = object()
    out: list[dict] = []
    todo = [("", a, b)]
    while todo:
        path, x, y = todo.pop()
        if isinstance(x, dict) and isinstance(y, dict):
            names = sorted({*x, *y}, reverse=True)
            todo.extend((f"{path}/{n}" if path else n, x.get(n, none), y.get(n, none)) for n in names)
            continue
        s, t = (None if v is none else canonical(v) for v in (x, y))
        if s != t:
            out.append({"path": clean(path), "old": s, "new": t})
    return out


@F.pandas_udf(FIELDS)
def json_fields(old: pd.Series, new: pd.Series) -> pd.Series:
    """``field_changes`` of two columns."""
    return pd.Series([field_changes(a, b) for a, b in zip(old, new)])


def is_text(value: Column) -> Column:
    """Whether a JSON text is a string, or not there at all."""
    return value.isNull() | value.startswith('"')


def json_type(text: str | None) -> str | None:
    """object, list, string, int, float, bool or null of a JSON text; None if it is none."""
    try:
        v = read(text)
    except Unreadable:
        return None
    return {dict: "object", list: "list", str: "string", int: "int", float: "float", bool: "bool", type(None): "null"}[type(v)]


@F.pandas_udf(T.StringType())
def type_name(texts: pd.Series) -> pd.Series:
    """``json_type`` of a column."""
    return texts.map(json_type)


def strict(data: Column, name: str, kind: str) -> Column:
    """Member ``name`` of a JSON object if it has JSON type ``kind`` (string, int, bool), unconverted; else null.

    The type is told from the JSON text of the member, which ``from_json`` keeps raw for strings inside objects, so
    ``"1"`` is no int and 1 no string."""

    @F.pandas_udf({"string": "string", "int": "bigint", "bool": "boolean"}[kind])
    def get(texts: pd.Series) -> pd.Series:
        want = {"string": str, "int": int, "bool": bool}[kind]

        def one(t: str | None):  # noqa: ANN202
            try:
                v = json.loads(t)[name] if t else None
            except (ValueError, KeyError, TypeError, RecursionError):
                return None
            if type(v) is not want or (kind == "int" and not 0 <= v < 1 << 63):
                return None
            return v

        return texts.map(one)

    return get(data)

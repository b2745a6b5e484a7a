"""The JSON filter language, compiled to Catalyst columns.

``{field: literal | {op: operand, ...}, ...}``: fields and operators are conjoined. One parser, two backends:
typed columns of a columnar collection (filters reach the parquet scan) and fields of a VARIANT document.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import variant as V
from ..functions.re2 import accepted

COMPARE = {"$gt": "__gt__", "$lt": "__lt__", "$gte": "__ge__", "$lte": "__le__"}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    operand: Any


def parse(text_or_dict: str | dict | None) -> list[Condition]:
    """The conditions of a filter; ValueError if it is no JSON object."""
    if isinstance(text_or_dict, str):
        try:
            text_or_dict = json.loads(text_or_dict) if text_or_dict.strip() else None
        except json.JSONDecodeError as e:
            raise ValueError(f"bad filter: {e}") from e
    if text_or_dict is None:
        return []
    if not isinstance(text_or_dict, dict):
        raise ValueError("bad filter: not an object")
    out = []
    for field, wanted in text_or_dict.items():
        out += [Condition(field, op, x) for op, x in wanted.items()] if isinstance(wanted, dict) else [Condition(field, "=", wanted)]
    return out


def kind_of(literal: Any) -> str:
    if literal is None:
        return "null"
    if isinstance(literal, bool):
        return "boolean"
    return {int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(literal)]


def quoted(field: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + field.replace("`", "``") + "`")


def plain(literal: Any) -> Any:
    """A literal as Spark can hold it: whole numbers beyond 64 bits are doubles."""
    return float(literal) if isinstance(literal, int) and not isinstance(literal, bool) and not -(1 << 63) <= literal < 1 << 63 else literal


class Columnar:
    """Fields are typed columns; NULL and unknown columns are missing fields."""

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def kind(self, field: str) -> str | None:
        t = self.types.get(field)
        if isinstance(t, T.NumericType):
            return "number"
        return {T.StringType: "string", T.BooleanType: "boolean", T.ArrayType: "array", T.StructType: "object", T.MapType: "object"}.get(type(t))

    def missing(self, field: str) -> Column:
        return quoted(field).isNull() if field in self.types else F.lit(True)

    absent = missing

    def equal(self, field: str, literal: Any) -> Column:
        if kind_of(literal) != self.kind(field):
            return F.lit(False)
        if kind_of(literal) in ("array", "object"):
            return F.to_json(quoted(field)) == V.canonical(literal)
        return quoted(field) == F.lit(plain(literal))

    def compare(self, field: str, op: str, literal: Any) -> Column:
        if self.kind(field) not in ("number", "string") or kind_of(literal) != self.kind(field):
            return F.lit(False)
        return getattr(quoted(field), COMPARE[op])(F.lit(plain(literal)))

    def matches(self, field: str, pattern: str) -> Column:
        return quoted(field).rlike(pattern) if self.kind(field) == "string" else F.lit(False)

    def text(self, field: str) -> Column:
        return quoted(field).cast("string") if field in self.types else F.lit(None).cast("string")


class Variant:
    """Fields are keys of one VARIANT column; an explicit null is present."""

    def __init__(self, doc: Column):
        self.doc = doc

    def absent(self, field: str) -> Column:
        return V.value(self.doc, field).isNull()

    def missing(self, field: str) -> Column:
        return self.absent(field) | (V.kind(self.doc, field) == "null")

    def equal(self, field: str, literal: Any) -> Column:
        k = kind_of(literal)
        if k in ("array", "object"):
            return (V.kind(self.doc, field) == k) & (F.to_json(V.value(self.doc, field)) == V.canonical(literal))
        typed = {"number": V.number, "string": V.string, "boolean": V.boolean}[k](self.doc, field)
        return typed == F.lit(float(literal) if k == "number" else literal)

    def compare(self, field: str, op: str, literal: Any) -> Column:
        k = kind_of(literal)
        if k not in ("number", "string"):
            return F.lit(False)
        typed = V.number(self.doc, field) if k == "number" else V.string(self.doc, field)
        return getattr(typed, COMPARE[op])(F.lit(float(literal) if k == "number" else literal))

    def matches(self, field: str, pattern: str) -> Column:
        return V.string(self.doc, field).rlike(pattern)

    def text(self, field: str) -> Column:
        return F.try_variant_get(self.doc, V.path(field), "string")


def _equal(backend, field: str, literal: Any) -> Column:
    return backend.missing(field) if literal is None else backend.equal(field, literal)


def condition(backend, c: Condition) -> Column:
    """One condition; NULL counts as false, as in WHERE."""
    if c.op == "=":
        return _equal(backend, c.field, c.operand)
    if c.op in COMPARE:
        return backend.compare(c.field, c.op, c.operand)
    if c.op == "$ne":
        return ~F.coalesce(_equal(backend, c.field, c.operand), F.lit(False))
    if c.op == "$in":
        if not isinstance(c.operand, list) or not c.operand:
            return F.lit(False)
        kinds = {kind_of(x) for x in c.operand}
        if isinstance(backend, Columnar) and kinds == {backend.kind(c.field)} and kinds & {"number", "string"}:
            return quoted(c.field).isin([plain(x) for x in c.operand])  # one predicate, which parquet can take
        out = F.lit(False)
        for x in c.operand:
            out = out | F.coalesce(_equal(backend, c.field, x), F.lit(False))
        return out
    if c.op == "$exists":
        return ~backend.absent(c.field) if c.operand is True else backend.absent(c.field)
    if c.op == "$regex":
        java = accepted(SparkSession.getActiveSession(), c.operand)
        return F.lit(False) if java is None else backend.matches(c.field, java)
    return F.lit(False)


def compile_filter(text_or_dict: str | dict | None, backend) -> Column:
    out = None
    for c in parse(text_or_dict):
        one = condition(backend, c)
        out = one if out is None else out & one
    return F.lit(True) if out is None else out


def stringly(wanted: dict, backend) -> Column:
    """The stateless engine's filter: equality of texts, missing never matches, no operators."""
    out = F.lit(True)
    for field, x in wanted.items():
        out = out & F.coalesce(backend.text(field) == (str(x).lower() if isinstance(x, bool) else str(x)), F.lit(False))
    return out


def in_range(field: str, low: float | None, high: float | None, backend) -> Column:
    """Numbers within [low, high]; open ends are None."""
    number = quoted(field).cast("double") if isinstance(backend, Columnar) and backend.kind(field) == "number" else V.number(backend.doc, field) if isinstance(backend, Variant) else F.lit(None).cast("double")
    out = number.isNotNull()
    if low is not None:
        out = out & (number >= low)
    return out if high is None else out & (number <= high)

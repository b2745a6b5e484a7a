"""Schema on read: ordered transforms, of which a document gets those from its version on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "_schema_ver"
TARGETS = ("float", "int", "string", "bool")


@dataclass(frozen=True)
class Transform:
    op: str
    source: str
    target: str = ""


def validate(transforms: list[Transform], version: int | None = None, before: list[Transform] | None = None) -> None:
    """Raise ValueError unless the transforms are well formed and only add to those ``before``."""
    if version is not None and version != len(transforms):
        raise ValueError("the version is the number of transforms")
    for t in transforms:
        if t.op not in ("rename", "drop", "retype"):
            raise ValueError(f"unknown op {t.op!r}")
        if not t.source or t.op != "drop" and not t.target:
            raise ValueError("from and to are required")
        if MARK in (t.source, t.target if t.op == "rename" else None) and t.op != "retype":
            raise ValueError(f"{MARK} is reserved")
        if t.op == "retype" and t.target not in TARGETS:
            raise ValueError(f"unknown type {t.target!r}")
    if before is not None and (len(transforms) < len(before) or transforms[: len(before)] != before):
        raise ValueError("a schema only grows: no downgrade, no change of earlier transforms")


def retype(c: Column, kind: T.DataType, target: str) -> Column:
    """A typed column in another type; what can't be converted is NULL, as a column has one type."""
    if target == "float":
        if isinstance(kind, T.StringType):
            return F.regexp_extract(c, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")
        return c.cast("double")
    if target == "int":
        if isinstance(kind, T.StringType):
            return F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")
        return c if isinstance(kind, T.BooleanType) else F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("long")
    if target == "string":
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
        return c.cast("string")
    if isinstance(kind, T.StringType):
        return F.when(c.isin("true", "1"), True).when(c.isin("false", "0"), False)
    return c if isinstance(kind, T.BooleanType) else c != 0


def apply(df: DataFrame, transforms: list[Transform], version: Column | None = None) -> DataFrame:
    """Run the transforms that each row lacks and stamp the version. ``version``: the row's, 0 if NULL or not given.

    For typed columns: a retype that can't be done gives NULL. Documents in one VARIANT column go through ``read``.
    """
    validate(transforms)
    if dict(df.dtypes).get("fields") == "variant":
        raise ValueError("documents are VARIANT: use read()")
    mixed = version is not None
    out = df.withColumn("_from", F.coalesce(version, F.lit(0))) if mixed else df
    for i, t in enumerate(transforms):
        due = F.col("_from") <= i if mixed else F.lit(True)
        kinds = {f.name: f.dataType for f in out.schema.fields}
        if t.source not in kinds:
            continue
        c = F.col(t.source)
        if t.op == "drop":
            out = out.withColumn(t.source, F.when(~due, c)) if mixed else out.drop(t.source)
        elif t.op == "retype":
            new = retype(c, kinds[t.source], t.target)
            out = out.withColumn(t.source, F.when(due, new).otherwise(c.try_cast({"float": "double", "int": "long", "string": "string", "bool": "boolean"}[t.target])) if mixed else new)
        else:
            held = F.col(t.target) if t.target in kinds else F.lit(None).cast(kinds[t.source])
            moved = F.when(due & c.isNotNull(), c).otherwise(held)
            out = out.withColumn(t.target, moved)
            out = out.withColumn(t.source, F.when(~due, F.col(t.source))) if mixed else out.drop(t.source)
    return out.drop("_from").withColumn(MARK, F.lit(len(transforms)))


def read(df: DataFrame, transforms: list[Transform]) -> DataFrame:
    """Documents as the schema has them, however old they are: VARIANT documents each from their own version on, or typed columns."""
    if dict(df.dtypes).get("fields") != "variant":
        return apply(df, transforms)
    validate(transforms)
    return df.withColumn("fields", migrated(F.col("fields"), transforms))


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


def _with(m: Column, key: str, value: Column, *without: str) -> Column:
    """The map with ``key`` set, and without some others."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~k.isin(key, *without)), F.create_map(F.lit(key), value))


def migrated(doc: Column, transforms: list[Transform]) -> Column:
    """A VARIANT object after the transforms from its version on, with the version set; others and up-to-date ones as they are."""
    own = F.coalesce(F.try_variant_get(doc, f"$.{MARK}", "double").cast("int"), F.lit(0))
    fields = doc.try_cast("map<string,variant>")

    def step(m: Column, i: int, t: Transform) -> Column:
        if t.op == "drop":
            new = F.map_filter(m, lambda k, _: k != t.source)
        elif t.op == "rename":
            new = _with(m, t.target, m[t.source], t.source)
        else:
            new = _bound(retyped(m[t.source], t.target), lambda v: F.when(v.isNull(), m).otherwise(_with(m, t.source, v)))
        return F.when((own <= i) & F.map_contains_key(m, F.lit(t.source)), new).otherwise(m)

    for i, t in enumerate(transforms):
        fields = _bound(fields, lambda m: step(m, i, t))  # called at once
    stamped = F.to_variant_object(_with(fields, MARK, F.lit(len(transforms)).cast("variant")))
    return F.when(fields.isNull() | (own >= len(transforms)), doc).otherwise(stamped)


def _as_number(x: Column) -> Column:
    """A number as JSON has it: whole ones without a point."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1 << 53), x.cast("long").cast("variant")).otherwise(x.cast("variant"))


def number_text(x: Column) -> Column:
    """Whole numbers in full; others by the fewest digits, with an exponent below -4 and from 6 on."""
    size = F.abs(x).cast("string")
    # mantissa and exponent, whichever way Spark writes the number
    point = F.instr(F.concat(size, F.lit(".")), ".")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(size, "E.*", ""), "[.]", ""), "^0+", "")
    exponent = F.when(F.instr(size, "E") > 0, F.regexp_extract(size, "E(-?[0-9]+)", 1).cast("int")).when(F.abs(x) >= 1, point - 2).otherwise(-F.length(F.regexp_extract(size, "[.](0*)", 1)) - 1)
    digits = F.regexp_replace(digits, "0+$", "")
    sign = F.when(x < 0, "-").otherwise("")
    rest = F.substring(digits, F.lit(2), F.length(digits))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    middle = F.concat(sign, F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits)))
    with_exponent = F.concat(sign, F.substring(digits, 1, 1), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    whole = (x == F.floor(x)) & (F.abs(x) < 2.0**63)
    return F.when(whole, x.cast("long").cast("string")).when((exponent < -4) | (exponent >= 6), with_exponent).when(exponent < 0, small).otherwise(middle)


def retyped(v: Column, target: str) -> Column:
    """A VARIANT value in another type; NULL if it can't be."""
    name = F.schema_of_variant(v)
    is_text, is_truth = name == "STRING", name == "BOOLEAN"
    is_number = name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
    text, truth, number = (F.try_variant_get(v, "$", t) for t in ("string", "boolean", "double"))
    if target == "float":
        read_ = retype(text, T.StringType(), "float")
        return F.when(is_number, v).when(is_text & read_.isNotNull(), _as_number(read_)).when(is_truth, truth.cast("int").cast("variant"))
    if target == "int":
        read_ = retype(text, T.StringType(), "int")
        cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("double")
        return F.when(is_number, _as_number(cut)).when(is_text & read_.isNotNull(), read_.cast("variant"))
    if target == "string":
        return F.when(is_text, v).when(is_number, number_text(number).cast("variant")).when(is_truth, truth.cast("string").cast("variant"))
    return F.when(is_truth, v).when(is_number, (number != 0).cast("variant")).when(is_text & text.isin("true", "1"), F.lit(True).cast("variant")).when(is_text & text.isin("false", "0"), F.lit(False).cast("variant"))

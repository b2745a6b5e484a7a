"""Type-strict access to fields of VARIANT documents, and hashes written in SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(field: str) -> str:
    return "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"


def value(doc: Column, field: str) -> Column:
    """The field as VARIANT; NULL if missing, a variant null if it is null."""
    return F.variant_get(doc, path(field), "variant")


def kind(doc: Column, field: str) -> Column:
    """'number', 'string', 'boolean', 'null', 'array', 'object'; NULL if missing."""
    name = F.schema_of_variant(value(doc, field))
    return (
        F.when(name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL"), "number").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object")
    )


def _typed(doc: Column, field: str, wanted: str, type_: str) -> Column:
    """The field if it is of that kind. The kind is asked only where the field can be read so."""
    got = F.try_variant_get(doc, path(field), type_)
    return F.when(got.isNotNull() & (kind(doc, field) == wanted), got)


def number(doc: Column, field: str) -> Column:
    return _typed(doc, field, "number", "double")


def string(doc: Column, field: str) -> Column:
    return _typed(doc, field, "string", "string")


def boolean(doc: Column, field: str) -> Column:
    return _typed(doc, field, "boolean", "boolean")


def canonical(literal) -> str:
    """JSON text of a literal as to_json prints a VARIANT: sorted keys, integral numbers without a point."""

    def plain(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 53:
            return int(x)
        if isinstance(x, list):
            return [plain(y) for y in x]
        return {k: plain(y) for k, y in x.items()} if isinstance(x, dict) else x

    return json.dumps(plain(literal), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


#: Offset basis and prime of the 32-bit FNV-1a hash. Fixed values.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as BIGINT."""
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda i: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    hashed = F.aggregate(codes, F.lit(FNV_BASIS).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(0xFFFFFFFF))
    return F.when(F.octet_length(text) == 0, F.lit(FNV_BASIS).cast("long")).otherwise(hashed)

"""Access to schemaless JSON bodies held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def body(column: Column) -> Column:
    """Parse text to VARIANT; malformed text becomes NULL instead of failing the job."""
    return F.try_parse_json(column)


def path(*keys: str) -> str:
    return "$" + "".join(f".{k}" for k in keys)


def get(value: Column, *keys: str, kind: str = "string", strict: bool = False) -> Column:
    """Value at a path as ``kind``; NULL when absent, JSON null or of the wrong type.

    ``strict`` raises on a value that cannot be converted.
    """
    reader = F.variant_get if strict else F.try_variant_get
    return reader(value, path(*keys), kind)


def text_number(value: Column, *keys: str, kind: str = "int", strict: bool = False) -> Column:
    """Number that may be delivered as text; an empty text counts as absent."""
    text = F.nullif(get(value, *keys), F.lit(""))
    return text.cast(kind) if strict else text.try_cast(kind)


def has_key(value: Column, *keys: str) -> Column:
    """True when the key exists, even if it holds JSON null."""
    return F.try_variant_get(value, path(*keys), "variant").isNotNull()


def elements(value: Column, *keys: str) -> Column:
    """List at a path as ARRAY<VARIANT>; NULL when absent or not a list."""
    return F.try_variant_get(value, path(*keys), "array<variant>")


def is_object(value: Column, *keys: str) -> Column:
    """True when the value at a path is a JSON object; never NULL."""
    return F.try_variant_get(value, path(*keys), "struct<>").isNotNull()


def as_object(value: Column) -> Column:
    """Object as MAP<STRING, VARIANT>; NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def put(fields: Column, key: str, value: Column) -> Column:
    """Map with one field replaced or added."""
    rest = F.map_filter(fields, lambda k, _: k != F.lit(key))
    return F.map_concat(rest, F.create_map(F.lit(key), value))


def drop(fields: Column, key: Column | str) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.map_filter(fields, lambda k, _: k != key)


def to_variant(value: Column) -> Column:
    return F.to_variant_object(value)

"""Payloads against JSON Schema documents (draft 7), compiled to predicates over VARIANT.

A document is plain data: a dict, or JSON text in a file.  Compiling it gives one level per list with described
elements (the payload itself is the first), and per level the conditions that break one of its elements.  All
documents of a depth are judged in one pass over the rows of that depth; lists are exploded, never walked inside a row,
so a long list is split as Spark splits its rows, and nothing shuffles.

Supported: type, enum and const of scalars, string, number, array and object bounds, pattern, items, contains,
uniqueItems, required, properties, additionalProperties (true or false), allOf, anyOf, oneOf, not, and local ``$ref``
without recursion.  Any other assertion raises when the document is compiled, so no rule is passed over silently.
Numbers are compared as doubles; patterns are Java's.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.operators import structure
from dqloom.operators.flatten import unrolled

COLUMNS = ("payload", "entity", "place", "field", "rule")
# Keywords that assert nothing.
ANNOTATIONS = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "definitions", "$defs"}


@dataclass
class Level:
    """The elements of one list: ``parent`` and ``path`` say where it is, ``rules`` are (field, rule, condition)."""

    name: str
    parent: int | None = None
    path: str = ""
    rules: list[tuple[str, str, str]] = field(default_factory=list)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _step(path: str, key: str) -> str:
    if '"' in key or "\\" in key or "'" in key:
        raise ValueError(f"property names with quotes or backslashes are not supported: {key!r}")
    return f'{path}["{key}"]'


def _get(value: str, path: str, kind: str) -> str:
    return value if kind == "variant" and not path else f"try_variant_get({value}, '${path}', '{kind}')"


def _is(kind: str, value: str, path: str) -> str:
    """SQL that is true for values of a JSON type, false or NULL for others."""
    raw = _get(value, path, "variant")
    schema = f"schema_of_variant({raw})"
    tests = {
        "object": f"{_get(value, path, 'struct<>')} IS NOT NULL",
        "array": f"{_get(value, path, 'array<variant>')} IS NOT NULL",
        "null": f"is_variant_null({raw})",
        "string": f"{schema} = 'STRING'",
        "boolean": f"{schema} = 'BOOLEAN'",
        "number": f"({schema} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {schema} LIKE 'DECIMAL%')",
        # 1.0 is an integer too, whether it arrives as a decimal or as a double
        "integer": f"({schema} = 'BIGINT' OR {schema} RLIKE '^DECIMAL.[0-9]+,0.$' OR {schema} = 'DOUBLE' AND {_get(value, path, 'double')} % 1 = 0)",
    }
    if kind not in tests:
        raise ValueError(f"unknown type {kind!r}")
    return tests[kind]


def _scalars(values: list) -> str:
    if any(isinstance(v, dict | list) for v in values):
        raise ValueError("enum and const of objects or arrays are not supported")
    whole = [int(v) if isinstance(v, float) and v.is_integer() else v for v in values]
    return ", ".join(_text(json.dumps(v, ensure_ascii=False)) for v in whole)


_BOUNDS = {"minimum": "<", "maximum": ">", "exclusiveMinimum": "<=", "exclusiveMaximum": ">="}
_SIZES = {"min": "<", "max": ">"}


class _Walk:
    """One walk through a document: ``rule`` gets (field, rule, condition), ``items`` (field, path, schema)."""

    def __init__(self, root: dict | bool, rule: Callable, items: Callable, names):
        self.root, self.rule, self.items, self.names = root, rule, items, names

    def _resolved(self, schema: dict, refs: tuple[str, ...]) -> tuple[dict | bool, tuple[str, ...]]:
        while isinstance(schema, dict) and "$ref" in schema:
            ref = schema["$ref"]
            if ref in refs:
                raise ValueError(f"recursive $ref {ref!r}")
            if not ref.startswith("#"):
                raise ValueError(f"only local references are supported: {ref!r}")
            schema, refs = self.root, (*refs, ref)
            for key in ref[1:].split("/")[1:]:
                schema = schema[key.replace("~1", "/").replace("~0", "~")]
        return schema, refs

    def broken(self, schema: dict | bool, value: str, path: str, refs: tuple[str, ...]) -> str:
        """SQL, never NULL: whether a value breaks anything of a schema, lists walked in place."""
        found: list[str] = []

        def items(_, at, own, own_refs):
            name = f"x{next(self.names)}"
            found.append(f"exists({_get(value, at, 'array<variant>')}, {name} -> {self.broken(own, name, '', own_refs)})")

        _Walk(self.root, lambda _, __, condition: found.append(condition), items, self.names).node(schema, value, path, "", refs)
        return f"coalesce({' OR '.join(f'coalesce({c}, false)' for c in found) or 'false'}, false)"

    def node(self, schema: dict | bool, value: str, path: str, name: str, refs: tuple[str, ...] = ()) -> None:
        schema, refs = self._resolved(schema, refs)
        raw = _get(value, path, "variant")
        present = f"{raw} IS NOT NULL"
        if isinstance(schema, bool):
            if not schema:
                self.rule(name, "false", present)
            return
        left = set(schema) - ANNOTATIONS
        listed, size = _get(value, path, "array<variant>"), f"size({_get(value, path, 'array<variant>')})"

        def own(key: str):
            left.discard(key)
            return schema.get(key)

        def add(key: str, condition: str) -> None:
            self.rule(name, key, condition)

        if (types := own("type")) is not None:
            tests = " OR ".join(_is(t, value, path) for t in ([types] if isinstance(types, str) else types))
            add("type", f"{present} AND NOT coalesce({tests}, false)")
        for key in ("enum", "const"):
            if key in schema:
                allowed = own(key)
                add(key, f"{present} AND coalesce(to_json({raw}), 'null') NOT IN ({_scalars(allowed if key == 'enum' else [allowed])})")
        text = f"{_is('string', value, path)} AND"
        for side, sign in _SIZES.items():
            if (bound := own(f"{side}Length")) is not None:
                add(f"{side}Length", f"{text} length({_get(value, path, 'string')}) {sign} {int(bound)}")
            if (bound := own(f"{side}Items")) is not None:
                add(f"{side}Items", f"{listed} IS NOT NULL AND {size} {sign} {int(bound)}")
            if (bound := own(f"{side}Properties")) is not None:
                add(f"{side}Properties", f"cardinality({_get(value, path, 'map<string,variant>')}) {sign} {int(bound)}")
        if (pattern := own("pattern")) is not None:
            add("pattern", f"{text} NOT {_get(value, path, 'string')} RLIKE {_text(pattern)}")
        for key, sign in _BOUNDS.items():
            if (bound := own(key)) is not None:
                add(key, f"{_is('number', value, path)} AND {_get(value, path, 'double')} {sign} {float(bound)!r}D")
        if (step := own("multipleOf")) is not None:
            add("multipleOf", f"{_is('number', value, path)} AND {_get(value, path, 'decimal(38,9)')} % cast('{step}' AS decimal(20,9)) <> 0")
        if own("uniqueItems"):
            add("uniqueItems", f"size(array_distinct(transform({listed}, x -> to_json(x)))) < {size}")
        if (inner := own("contains")) is not None:
            x = f"x{next(self.names)}"
            add("contains", f"{listed} IS NOT NULL AND NOT exists({listed}, {x} -> NOT {self.broken(inner, x, '', refs)})")
        if (inner := own("items")) is not None:
            for i, each in enumerate(inner if isinstance(inner, list) else ()):
                self.node(each, value, f"{path}[{i}]", f"{name}[{i}]", refs)
            if not isinstance(inner, list):
                self.items(name, path, inner, refs)

        dotted = f"{name}." if name else ""
        for key in own("required") or ():
            absent = f"{_get(value, _step(path, key), 'variant')} IS NULL"
            self.rule(f"{dotted}{key}", "required", f"{_is('object', value, path)} AND {absent}")
        described = own("properties") or {}
        for key, inner in described.items():
            self.node(inner, value, _step(path, key), f"{dotted}{key}", refs)
        if (more := own("additionalProperties")) is not None and not isinstance(more, bool):
            raise ValueError("additionalProperties may only be true or false")
        if more is False:
            keys = f"map_keys({_get(value, path, 'map<string,variant>')})"
            add("additionalProperties", f"size(array_except({keys}, cast(array({', '.join(map(_text, described))}) AS array<string>))) > 0")

        for inner in own("allOf") or ():
            self.node(inner, value, path, name, refs)
        if (inner := own("anyOf")) is not None:
            add("anyOf", f"{present} AND {' AND '.join(self.broken(s, value, path, refs) for s in inner)}")
        if (inner := own("oneOf")) is not None:
            add("oneOf", f"{present} AND {' + '.join(f'int(NOT {self.broken(s, value, path, refs)})' for s in inner)} <> 1")
        if (inner := own("not")) is not None:
            add("not", f"{present} AND NOT {self.broken(inner, value, path, refs)}")
        if left:
            raise ValueError(f"unsupported keywords at {name or 'the top'}: {', '.join(sorted(left))}")


def compiled(document: dict | bool | str, value: str = "e") -> list[Level]:
    """The levels of a document, parents first; conditions are SQL over the VARIANT column ``value``."""
    document = json.loads(document) if isinstance(document, str) else document
    levels = [Level("")]
    names = itertools.count()
    open_levels: list[tuple[int, dict | bool, tuple[str, ...]]] = [(0, document, ())]
    while open_levels:
        number, schema, refs = open_levels.pop(0)

        def items(name, path, inner, inner_refs, number=number):
            levels.append(Level(f"{name}[]", number, path))
            open_levels.append((len(levels) - 1, inner, inner_refs))

        level = levels[number]
        _Walk(document, lambda *rule, level=level: level.rules.append(rule), items, names).node(schema, value, "", level.name, refs)
    return levels


def _chosen(cases: Mapping[int, str]) -> str:
    return "CASE level " + " ".join(f"WHEN {n} THEN {value}" for n, value in cases.items()) + " END"


def findings(envelopes: DataFrame, documents: Mapping[str, dict | bool | str]) -> DataFrame:
    """One row per broken rule: ``payload, entity, place, field, rule``, for all entities that have a document.

    ``place`` holds the positions in the lists above a value, joined by ``/`` (empty for the payload's own fields),
    ``field`` its path with ``[]`` for a position.  Bodies that are no JSON and entities without a document have no
    findings; a JSON null is a value; without documents there are no rows.
    """
    levels: list[tuple[str, Level]] = []
    tops, children = {}, {}
    for entity, document in documents.items():
        first = len(levels)
        tops[entity] = first
        for i, level in enumerate(compiled(document)):
            levels.append((entity, level))
            if level.parent is not None:
                children.setdefault(first + level.parent, []).append(first + i)

    named = F.create_map(*(F.lit(x) for pair in tops.items() for x in pair)) if tops else F.create_map(F.lit(""), F.lit(0))
    rows = envelopes.where(F.col("entity").isin(*tops)).where("body IS NOT NULL")
    rows = rows.select(
        F.concat_ws("/", "batch_id", "source_file").alias("payload"), "entity", named[F.col("entity")].alias("level"), F.lit("").alias("place"), F.col("body").alias("e")
    )
    found, depth = [], list(tops.values())
    while depth:
        judged = {n: levels[n][1].rules for n in depth if levels[n][1].rules}
        if judged:
            entries = {
                n: "filter(array("
                + ", ".join(f"named_struct('field', {_text(at)}, 'rule', CASE WHEN {condition} THEN {_text(rule)} END)" for at, rule, condition in rules)
                + "), x -> x.rule IS NOT NULL)"
                for n, rules in judged.items()
            }
            # the outer form: before an inner one Spark also filters on the list's size, which judges every element again
            found.append(rows.selectExpr("payload", "entity", "place", f"inline_outer({_chosen(entries)})").where("rule IS NOT NULL"))
        inner = {n: children[n] for n in depth if n in children}
        depth = [c for own in inner.values() for c in own]
        if depth:
            lists = {
                n: "array(" + ", ".join(f"named_struct('child', {c}, 'list', {_get('e', levels[c][1].path, 'array<variant>')})" for c in own) + ")"
                for n, own in inner.items()
            }
            split = rows.selectExpr("payload", "entity", "place", f"inline_outer({_chosen(lists)})").where("child IS NOT NULL")
            kept = ["payload", "entity", F.col("child").alias("level"), "place"]
            rows = unrolled(split, kept, F.col("list"), "_pos", "e")
            rows = rows.withColumn("place", F.concat_ws("/", F.nullif("place", F.lit("")), "_pos")).drop("_pos")
    if not found:
        return rows.selectExpr("payload", "entity", "place", "place AS field", "place AS rule").limit(0)
    return reduce(DataFrame.unionByName, found).select(*COLUMNS)


def _described(fields) -> dict:
    """Schema of an object whose fields are given by dotted paths."""
    top: dict = {"type": "object", "properties": {}}
    for f in fields:
        at = top
        for key in f.path[:-1]:
            at = at.setdefault("properties", {})[key]
        leaf: dict = {"type": list(f.types)}
        if f.min_length:
            leaf["minLength"] = f.min_length
        if f.types == ("array",):
            leaf |= {"minItems": 1, "items": _described(structure.TABLE_ROW_FIELDS)}
        at.setdefault("properties", {})[f.path[-1]] = leaf
        if f.required:
            at.setdefault("required", []).append(f.path[-1])
    return top


def document(entity: str) -> dict:
    """The schema document of an entity's payloads, made of its field table."""
    properties = {"filters": {"type": ["object", "null"]}}
    if entity != "standings":
        properties["count"] = {"type": ["integer", "null"]}
    properties[entity] = {"type": "array", "minItems": 1, "items": _described(structure.ELEMENT_FIELDS[entity])}
    return {"type": "object", "required": [entity], "properties": properties}


def documents() -> dict[str, dict]:
    return {entity: document(entity) for entity in structure.ELEMENT_FIELDS}


def read_documents(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The documents of a folder, one JSON file per entity, named like it."""
    files = spark.read.option("wholetext", True).text(folder).select(F.regexp_extract(F.input_file_name(), "([^/]+)[.]json$", 1).alias("entity"), "value")
    return {row["entity"]: json.loads(row["value"]) for row in files.collect() if row["entity"]}

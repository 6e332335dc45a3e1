"""JSON structure and content findings per payload.

The rules of an entity are a table of fields (path, allowed types, required,
minimum length).  They are compiled to predicates over VARIANT, and every broken
rule of every element becomes one finding row; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqloom.operators.flatten import table_rows, unrolled

INT_NULL, STR_NULL = ("integer", "null"), ("string", "null")


@dataclass(frozen=True)
class Field:
    path: tuple[str, ...]
    types: tuple[str, ...]
    required: bool = False
    min_length: int = 0


def _field(path: str, *types: str, required: bool = False, min_length: int = 0) -> Field:
    return Field(tuple(path.split(".")), types, required, min_length)


def _reference(name: str, *more: Field, types: tuple[str, ...] = ("object",), required: bool = False) -> list[Field]:
    base = [_field(name, *types, required=required), _field(f"{name}.id", *INT_NULL)]
    return base + list(more)


def _named(name: str, required: bool = False) -> list[Field]:
    return _reference(name, _field(f"{name}.name", *STR_NULL), required=required)


def _season(name: str, types: tuple[str, ...], required: bool = False) -> list[Field]:
    dates = [_field(f"{name}.{c}", *STR_NULL) for c in ("startDate", "endDate")]
    return _reference(name, *dates, types=types, required=required)


def _short_team(name: str, required: bool = False) -> list[Field]:
    return [*_named(name, required), _field(f"{name}.tla", *STR_NULL)]


_ID = _field("id", "integer", required=True)
_NAME = _field("name", "string", required=True, min_length=1)

# The expected structure of one element of every entity list.
ELEMENT_FIELDS: dict[str, tuple[Field, ...]] = {
    "areas": (
        _ID,
        _NAME,
        _field("countryCode", *STR_NULL, min_length=2),
        _field("parentAreaId", *INT_NULL),
        _field("parentArea", *STR_NULL),
        _field("flag", *STR_NULL),
    ),
    "competitions": (
        _ID,
        _NAME,
        _field("code", *STR_NULL),
        _field("type", *STR_NULL, required=True),
        _field("plan", *STR_NULL, required=True),
        _field("lastUpdated", *STR_NULL),
        *_named("area"),
        _field("area.code", *STR_NULL),
        *_season("currentSeason", ("object", "null")),
    ),
    "teams": (_ID, _NAME, _field("tla", *STR_NULL), *_named("area"), *(_field(c, *STR_NULL) for c in ("crest", "venue", "address"))),
    "scorers": (
        *_named("player", required=True),
        *_short_team("team", required=True),
        _field("goals", *INT_NULL, required=True),
        _field("assists", *INT_NULL),
        _field("penalties", *INT_NULL),
    ),
    "matches": (
        _ID,
        _field("utcDate", "string", required=True),
        _field("status", "string", required=True),
        _field("stage", *STR_NULL),
        _field("group", *STR_NULL),
        _field("matchday", *INT_NULL),
        *_named("competition", required=True),
        *_season("season", ("object",), required=True),
        *_named("homeTeam", required=True),
        *_named("awayTeam", required=True),
    ),
    "standings": (
        _field("type", "string", required=True),
        _field("stage", *STR_NULL),
        _field("group", *STR_NULL),
        _field("table", "array", required=True),
    ),
}
# The expected structure of one row of a standings table.
TABLE_ROW_FIELDS: tuple[Field, ...] = (
    *_short_team("team", required=True),
    *(_field(c, *INT_NULL, required=True) for c in ("position", "points", "playedGames")),
    *(_field(c, *INT_NULL) for c in ("won", "draw", "lost", "goalsFor", "goalsAgainst", "goalDifference")),
)

# The path of the identifier that must be unique inside one payload.
UNIQUE_ID = {
    "areas": ("id",),
    "competitions": ("id",),
    "teams": ("id",),
    "scorers": ("player", "id"),
    "matches": ("id",),
    "standings": ("team", "id"),
}


COLUMNS = ("validator", "level", "payload", "position", "rule", "field", "value")
ALL_FAMILIES = ("schema", "completeness", "uniqueness", "consistency")

# Variant schema names that count as a JSON type (whole decimals such as 1.0 are integers too, see below).
_SCALARS = {"integer": "BIGINT", "string": "STRING", "null": "VOID"}
_WHOLE_DECIMAL = "RLIKE '^DECIMAL.[0-9]+,0.$'"


def _at(value: str, path: str, kind: str) -> str:
    return f"try_variant_get({value}, '${path and '.'}{path}', '{kind}')"


def _rule_case(value: str, field: Field) -> str:
    """Name of the structure rule a field breaks, NULL when it is fine.

    The branch of a correct value comes first, so that it costs one look at the value.
    """
    path = ".".join(field.path)
    raw, absent = _at(value, path, "variant"), "'required'" if field.required else "NULL"
    nested = [t for t in field.types if t in ("object", "array")]
    if nested:
        kind = "struct<>" if nested[0] == "object" else "array<variant>"
        null_ok = f"WHEN is_variant_null({raw}) THEN NULL " if "null" in field.types else ""
        return (
            f"CASE WHEN {_at(value, path, kind)} IS NOT NULL THEN NULL WHEN {raw} IS NULL THEN {absent} {null_ok}ELSE 'type' END"
        )
    kind = f"schema_of_variant({raw})"
    allowed = ", ".join(f"'{_SCALARS[t]}'" for t in field.types)
    short = ""
    if field.min_length:
        short = f"WHEN length({_at(value, path, 'string')}) < {field.min_length} AND {kind} = 'STRING' THEN 'minLength' "
    whole = f"WHEN {kind} {_WHOLE_DECIMAL} THEN NULL " if "integer" in field.types else ""
    return f"CASE {short}WHEN {kind} IN ({allowed}) THEN NULL WHEN {raw} IS NULL THEN {absent} {whole}ELSE 'type' END"


def _entry(validator: str, level: str, rule: str, field: str | None = None, value: str = "NULL") -> str:
    shown = "cast(NULL AS STRING)" if field is None else f"'{field}'"
    return (
        f"named_struct('validator', '{validator}', 'level', '{level}', 'rule', {rule}, 'field', {shown}, "
        f"'value', cast({value} AS STRING))"
    )


def _when(condition: str, rule: str) -> str:
    return f"CASE WHEN {condition} THEN '{rule}' END"


def _by_entity(arrays: dict[str, str]) -> str:
    """The array that belongs to a row's entity."""
    return "CASE entity " + " ".join(f"WHEN '{e}' THEN {array}" for e, array in arrays.items()) + " END"


def _broken(entries: Sequence[str]) -> str:
    """The entries whose rule is broken."""
    return f"filter(array({', '.join(entries)}), x -> x.rule IS NOT NULL)"


def _emit(df: DataFrame, payload: str, position: str, arrays: dict[str, str]) -> DataFrame:
    """One row per broken rule; every row is judged by the rules of its entity."""
    found = f"inline({_by_entity(arrays)})"
    return df.selectExpr(f"{payload} AS payload", f"cast({position} AS STRING) AS position", found).select(*COLUMNS)


def _listed(envelopes: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Payloads of some entities with their list (NULL when absent or no list)."""
    lists = _by_entity({e: _at("body", e, "array<variant>") for e in entities})
    own = envelopes.filter(F.col("entity").isin(*entities))
    return own.selectExpr("concat_ws('/', batch_id, source_file) AS payload", "entity", "body", f"{lists} AS list")


def _typed_text(value: str, path: str) -> str:
    """JSON text of a value, which tells 1 from "1"; NULL when absent or JSON null."""
    return f"nullif(to_json({_at(value, path, 'variant')}), 'null')"


def _ids(entity: str) -> str:
    """Sorted identifiers of one payload with their type, absent ones left out."""
    path = ".".join(UNIQUE_ID[entity])
    ident = f"named_struct('typed', {_typed_text('e', path)}, 'shown', {_at('e', path, 'string')})"
    if entity == "standings":
        rows = "coalesce(try_variant_get(g, '$.table', 'array<variant>'), array())"
        ids = f"flatten(transform(list, g -> transform({rows}, e -> {ident})))"
    else:
        ids = f"transform(list, e -> {ident})"
    return f"array_sort(filter({ids}, x -> x.typed IS NOT NULL))"


def _payload_entries(entity: str, families: Sequence[str]) -> str | None:
    """Array of findings about a payload of an entity: its list, its declared count, its repeated identifiers."""
    entries = []
    if "schema" in families:
        schema = f"{entity}_schema"
        raw = _at("body", entity, "variant")
        filters = Field(("filters",), ("object", "null"))
        entries += [
            _entry(schema, "error", f"CASE WHEN list IS NOT NULL THEN NULL WHEN {raw} IS NULL THEN 'required' ELSE 'type' END", entity),
            _entry(schema, "error", _when("size(list) = 0", "minItems"), entity),
            _entry(schema, "error", _when("list IS NULL", "list_missing"), entity),
            _entry(schema, "error", _rule_case("body", filters), "filters"),
        ]
        if entity != "standings":
            entries.append(_entry(schema, "error", _rule_case("body", Field(("count",), INT_NULL)), "count"))
    if "completeness" in families:
        complete = f"{entity}_completeness"
        entries.append(_entry(complete, "error", _when("coalesce(size(list), 0) = 0", "list_missing_or_empty"), entity))
        if entity != "standings":
            count = _at("body", "count", "variant")
            wrong = f"size(list) > 0 AND schema_of_variant({count}) = 'BIGINT' AND {_at('body', 'count', 'bigint')} <> size(list)"
            entries.append(_entry(complete, "warning", _when(wrong, "declared_count"), entity))
    if "uniqueness" in families:
        entries.append(_entry(f"{entity}_uniqueness", "warning", _when("list IS NULL", "list_missing"), entity))
    if "consistency" in families and entity != "areas":
        # There is no consistency rule for areas.
        entries.append(_entry(f"{entity}_consistency", "warning", _when("list IS NULL", "list_missing"), entity))
        if entity == "standings":
            start, end = _period("body", "season")
            entries.append(_entry("standings_consistency", "error", _when(f"{start} > {end}", "period_reversed"), "season"))
    validators = [(f"{entity}_schema", "warning")] if "schema" in families else []
    if "uniqueness" in families:
        validators.append((f"{entity}_uniqueness", "warning" if entity == "standings" else "error"))
    if not validators:
        return _broken(entries) if entries else None
    # A repeated value equals its right neighbour; a payload is one row, so this needs no shuffle.
    named = ", ".join(_entry(v, level, "'duplicate_id'", ".".join(UNIQUE_ID[entity]), "x") for v, level in validators)
    return f"concat({_broken(entries)}, flatten(transform(twice, x -> array({named}))))"


def payload_findings(
    envelopes: DataFrame, entities: Sequence[str] = tuple(ELEMENT_FIELDS), families: Sequence[str] = ALL_FAMILIES
) -> DataFrame:
    """Findings about payloads as a whole, for any number of entities in one pass without a shuffle."""
    arrays = {e: _payload_entries(e, families) for e in entities}
    arrays = {e: array for e, array in arrays.items() if array}
    rows = _listed(envelopes, list(arrays))
    if "schema" in families or "uniqueness" in families:
        pairs = "zip_with(ids, slice(ids, 2, greatest(size(ids), 0)), (a, b) -> CASE WHEN a.typed = b.typed THEN a.shown END)"
        twice = f"coalesce(array_distinct(filter({pairs}, x -> x IS NOT NULL)), array())"
        rows = rows.withColumn("ids", F.expr(_by_entity({e: _ids(e) for e in arrays}))).withColumn("twice", F.expr(twice))
    return _emit(rows, "payload", "NULL", arrays)


def _period(value: str, path: str) -> tuple[str, str]:
    return _at(value, f"{path}.startDate", "date"), _at(value, f"{path}.endDate", "date")


def _consistency_entries(entity: str) -> list[str]:
    """Contradictions inside one element."""
    if entity == "competitions":
        start, end = _period("e", "currentSeason")
        rules = [
            ("error", "period_reversed", f"{start} > {end}"),
            ("warning", "period_open", f"{start} IS NOT NULL AND {end} IS NULL"),
        ]
    elif entity == "matches":
        start, end = _period("e", "season")
        day = f"cast({_at('e', 'utcDate', 'timestamp_ntz')} AS DATE)"
        # Null-safe on purpose: two absent teams are the same team.  1 and "1" are not; what is no object has no teams.
        same = f"is_object AND {_typed_text('e', 'homeTeam.id')} <=> {_typed_text('e', 'awayTeam.id')}"
        rules = [
            ("error", "period_reversed", f"{start} > {end}"),
            ("warning", "outside_season", f"{start} IS NOT NULL AND {end} IS NOT NULL AND {day} NOT BETWEEN {start} AND {end}"),
            ("error", "same_team", same),
        ]
    elif entity == "scorers":
        rules = [("warning", "player_missing", f"{_at('e', 'player', 'struct<>')} IS NULL")]
    else:
        return []
    ident = _at("e", "id", "string")
    return [_entry(f"{entity}_consistency", level, _when(cond, rule), value=ident) for level, rule, cond in rules]


def _is_object() -> Column:
    return F.expr(f"{_at('e', '', 'struct<>')} IS NOT NULL")


def _schema_entries(entity: str, fields: Sequence[Field]) -> list[str]:
    """Broken structure rules of one element; an element that is no object breaks just that one."""
    entries = [_entry(f"{entity}_schema", "error", _when("NOT is_object", "type"), "")]
    for f in fields:
        case = _rule_case("e", f)
        if f.required:
            case = f"CASE WHEN is_object THEN {case} END"
        entries.append(_entry(f"{entity}_schema", "error", case, ".".join(f.path)))
    return entries


def _element_entries(entity: str, families: Sequence[str]) -> list[str]:
    schema = "schema" in families
    entries = _schema_entries(entity, ELEMENT_FIELDS[entity]) if schema else []
    if schema and entity == "standings":
        empty = f"size({_at('e', 'table', 'array<variant>')}) = 0"
        entries.append(_entry("standings_schema", "error", _when(empty, "minItems"), "table"))
    return entries + (_consistency_entries(entity) if "consistency" in families else [])


def element_findings(
    envelopes: DataFrame, entities: Sequence[str] = tuple(ELEMENT_FIELDS), families: Sequence[str] = ALL_FAMILIES
) -> DataFrame | None:
    """Findings about single list elements, for any number of entities in one pass; None when no rule looks at them."""
    arrays = {e: _element_entries(e, families) for e in entities}
    arrays = {e: _broken(entries) for e, entries in arrays.items() if entries}
    if not arrays:
        return None
    elements = unrolled(_listed(envelopes, list(arrays)), ["payload", "entity"], F.col("list"), "_pos", "e")
    return _emit(elements.withColumn("is_object", _is_object()), "payload", "_pos", arrays)


def table_findings(envelopes: DataFrame) -> DataFrame:
    """Structure findings about the rows of standings tables."""
    rows = table_rows(envelopes).withColumns({"entity": F.lit("standings"), "is_object": _is_object()})
    return _emit(rows, "concat_ws('/', _batch, _file)", "_pos", {"standings": _broken(_schema_entries("standings", TABLE_ROW_FIELDS))})


def findings(envelopes: DataFrame, families: Sequence[str] = ALL_FAMILIES) -> DataFrame:
    """Everything the payload validators have to say, one row per finding:
    ``validator, level, payload, position, rule, field, value``.

    Three passes over the payloads, none of which shuffles: whole payloads, list
    elements, rows of nested tables.
    """
    parts = [payload_findings(envelopes, families=families), element_findings(envelopes, families=families)]
    if "schema" in families:
        parts.append(table_findings(envelopes))
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])

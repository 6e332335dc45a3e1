"""Queries over raw JSON payloads derived from the events table.

The expected results are stated relationally, from the event columns the payloads
were built from; no JSON is parsed on the SQL side.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import query
from catalog import sql as S
from dqloom.functions import routing
from dqloom.functions import rules as R
from dqloom.operators import checks as C
from dqloom.operators import flatten, fusion, ledger, mutations, schemas, structure
from dqloom.plans import loading, native, rawbed, suites
from dqloom.session import checkpoint_folder
from dqloom.sources import envelopes as E
from dqloom.sources import tables

# Events, their elements, and what the first element's defects make of the id.
EVENTS = """ev AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
pay AS (SELECT *, k % 4 AS n, k % 29 = 0 AS no_list, NOT (event_type = 'error' AND k >= 90) AS ok,
  CASE event_type WHEN 'click' THEN 'matches' WHEN 'view' THEN 'teams' WHEN 'purchase' THEN 'standings'
    WHEN 'signup' THEN 'competitions' ELSE 'areas' END AS entity FROM ev),
el AS (SELECT *, CASE WHEN k % 7 = 0 AND i = 0 THEN NULL WHEN k % 11 = 0 AND i = 0 THEN 'abc'
    WHEN k % 13 = 0 AND i = 1 THEN CAST(event_id * 10 AS VARCHAR) ELSE CAST(event_id * 10 + i AS VARCHAR) END AS id_text,
  CASE WHEN k % 17 = 0 THEN '999' WHEN k % 19 = 0 THEN 'x7' WHEN k % 5 = 0 THEN NULL ELSE CAST(i + 1 AS VARCHAR) END AS day_text
  FROM (SELECT *, unnest(range(n)) AS i FROM pay WHERE NOT no_list)),
num AS (SELECT *, TRY_CAST(id_text AS BIGINT) AS id, strftime(ts, '%Y%m%d') AS batch FROM el)"""


def first_by(key: str, entity: str, where: str = "true") -> str:
    """Elements of an entity with a numeric id, the first that arrived per id."""
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY batch, event_id, i) AS rn FROM num "
        f"WHERE entity = '{entity}' AND {key} IS NOT NULL AND {where}) WHERE rn = 1"
    )


# --- ingestion, extract stage ----------------------------------------------------------------------------------------


@query(
    "suite_native_ingestion",
    S.verdicts(
        EVENTS,
        {"api_http_status_ok": S.count("pay", "NOT ok"), "api_payload_shape_ok": S.count("pay", "no_list")},
    ),
)
def ingestion(t):
    return native.ingestion_results(rawbed.envelopes(t)).select("check_name", "status", "rows_failed")


def stage_e(elements: str, key_missing: str) -> str:
    """Expected extract-stage verdicts for a set of match elements (id_text, day_text)."""
    bad_day = "day_text IS NOT NULL AND (NOT regexp_full_match(day_text, '[0-9]+') OR TRY_CAST(day_text AS INTEGER) > 60)"
    return S.verdicts(
        f"{EVENTS}, items AS ({elements})",
        {
            "stg_schema_matches_key_missing": key_missing,
            "stg_missing_match_id": S.count("items", "id_text IS NULL"),
            "stg_matchday_out_of_range": S.count("items", bad_day),
            "stg_duplicate_match_id": S.duplicates("items", "id_text", "id_text IS NOT NULL"),
        },
    )


MATCH_ITEMS = "SELECT id_text, day_text FROM el WHERE entity = 'matches'"
NO_KEY = S.count("pay", "entity = 'matches' AND no_list")


def _stage_e_results(envelopes):
    found = fusion.evaluate("stage", "E", suites.STAGE.checks("E"), E.stage_e_tables(envelopes, rawbed.RUN))
    return found.select("check_name", "status", "rows_failed")


@query("suite_stage_E", stage_e(MATCH_ITEMS, NO_KEY))
def stage_extract(t):
    return _stage_e_results(rawbed.envelopes(t))


@query(
    "failrows_stage_matchday",
    f"WITH {EVENTS} SELECT batch || '/' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '.json' AS id, id_text AS match_id, "
    "day_text AS matchday FROM num WHERE entity = 'matches' AND day_text IN ('999', 'x7')",
)
def failrows_stage_matchday(t):
    check = next(c for c in suites.STAGE.checks("E") if c.name == "stg_matchday_out_of_range")
    return fusion.failing_rows(check, E.stage_e_tables(rawbed.envelopes(t))).drop("endpoint")


@query(
    "chk_json_range",
    S.verdicts(EVENTS, {"k_range": S.count("ev", "k > 60")}),
)
def json_range(t):
    check = C.rows_where("k_range", "events", R.digits_outside("get_json_object(props, '$.k')", 0, 60))
    return fusion.evaluate("single", "E", [check], {"events": t["events"]}).select("check_name", "status", "rows_failed")


@query(
    "chk_json_key",
    S.verdicts(EVENTS, {"k_present": "SELECT 0", "q_present": "SELECT count(*) FROM events"}),
)
def json_key(t):
    checks = [
        C.rows_where(f"{key}_present", "events", f"NOT array_contains(json_object_keys(props), '{key}')") for key in ("k", "q")
    ]
    return fusion.evaluate("single", "E", checks, {"events": t["events"]}).select("check_name", "status", "rows_failed")


# --- payload mutations -----------------------------------------------------------------------------------------------

_REST = "SELECT id_text, day_text FROM el WHERE entity = 'matches' AND i > 0"
MUTATED = {
    "drop_required": (f"{_REST} UNION ALL SELECT NULL, day_text FROM el WHERE entity = 'matches' AND i = 0", NO_KEY),
    "corrupt_id": (
        f"{_REST} UNION ALL SELECT CASE WHEN id_text IS NOT NULL THEN 'abc' END, day_text FROM el "
        "WHERE entity = 'matches' AND i = 0",
        NO_KEY,
    ),
    "duplicate_first": (
        f"{MATCH_ITEMS} UNION ALL SELECT id_text, day_text FROM el WHERE entity = 'matches' AND i = 0",
        NO_KEY,
    ),
    "matchday_out_of_range": (
        f"{_REST} UNION ALL SELECT id_text, '999' FROM el WHERE entity = 'matches' AND i = 0",
        NO_KEY,
    ),
    "drop_matches_key": ("SELECT id_text, day_text FROM el WHERE false", S.count("pay", "entity = 'matches'")),
}
for _action, (_items, _missing) in MUTATED.items():
    query(f"mut_payload_{_action}", stage_e(_items, _missing))(
        lambda t, action=_action: _stage_e_results(mutations.mutate_payloads(rawbed.envelopes(t), "matches", action))
    )


@query(
    "mut_payload_swap_teams",
    f"WITH {EVENTS} SELECT id AS match_id, user_id + CASE WHEN k % 23 = 0 THEN 0 ELSE 1 END AS home_team_id, "
    f"user_id AS away_team_id FROM ({first_by('id', 'matches')})",
)
def payload_swap(t):
    # Three swaps exchange the teams of every element, because a payload has at most three.
    swapped = mutations.mutate_payloads(rawbed.envelopes(t), "matches", "swap_teams", 3, "seed")
    return flatten.load_star(swapped, "swapped")["fact_match"].select("match_id", "home_team_id", "away_team_id")


@query(
    "etl_copy_run",
    f"""WITH {EVENTS} SELECT 'exp_copy' AS run_id, entity, count(*) AS payloads,
    count(*) FILTER (entity = 'matches' AND n > 0) AS filled FROM pay WHERE ok AND NOT no_list GROUP BY ALL""",
)
def copy_run(t):
    copied = E.copy_run(
        rawbed.envelopes(t), rawbed.RUN, "exp_copy", lambda e: mutations.mutate_payloads(e, "matches", "duplicate_first")
    )
    filled = F.expr("entity = 'matches' AND json_array_length(get_json_object(to_json(body), '$.matches')) > 0")
    return copied.groupBy("run_id", "entity").agg(F.count(F.lit(1)).alias("payloads"), F.count_if(filled).alias("filled"))


# --- structure -------------------------------------------------------------------------------------------------------


def _finding(validator: str, level: str, rule: str, field: str, source: str, where: str) -> str:
    shown = f"'{field}'" if field else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT '{validator}' AS validator, '{level}' AS level, '{rule}' AS rule, {shown} AS field, count(*) AS findings "
        f"FROM {source} WHERE ok AND {where}"
    )


def _expected_findings() -> str:
    parts = []
    for e in ("areas", "competitions", "teams", "matches", "standings"):
        own, empty = f"entity = '{e}'", "NOT no_list AND n = 0"
        parts += [
            _finding(f"{e}_schema", "error", "required", e, "pay", f"{own} AND no_list"),
            _finding(f"{e}_schema", "error", "list_missing", e, "pay", f"{own} AND no_list"),
            _finding(f"{e}_uniqueness", "warning", "list_missing", e, "pay", f"{own} AND no_list"),
        ]
        if e != "areas":
            parts.append(_finding(f"{e}_consistency", "warning", "list_missing", e, "pay", f"{own} AND no_list"))
        if e == "standings":
            twice = f"{own} AND NOT no_list AND k % 13 = 0 AND n >= 2"
            parts += [
                _finding("standings_schema", "error", "minItems", "table", "pay", f"{own} AND {empty}"),
                _finding("standings_completeness", "error", "list_missing_or_empty", e, "pay", f"{own} AND no_list"),
                _finding("standings_schema", "warning", "duplicate_id", "team.id", "pay", twice),
                _finding("standings_uniqueness", "warning", "duplicate_id", "team.id", "pay", twice),
            ]
            continue
        twice = f"{own} AND NOT no_list AND k % 13 = 0 AND n >= 2 AND k % 7 <> 0 AND k % 11 <> 0"
        parts += [
            _finding(f"{e}_schema", "error", "minItems", e, "pay", f"{own} AND {empty}"),
            _finding(f"{e}_completeness", "error", "list_missing_or_empty", e, "pay", f"{own} AND (no_list OR n = 0)"),
            _finding(f"{e}_completeness", "warning", "declared_count", e, "pay", f"{own} AND NOT no_list AND n > 0 AND k % 31 = 0"),
            _finding(f"{e}_schema", "error", "required", "id", "el", f"{own} AND id_text IS NULL"),
            _finding(f"{e}_schema", "error", "type", "id", "el", f"{own} AND id_text = 'abc'"),
            _finding(f"{e}_schema", "warning", "duplicate_id", "id", "pay", twice),
            _finding(f"{e}_uniqueness", "error", "duplicate_id", "id", "pay", twice),
        ]
    parts += [
        _finding("areas_schema", "error", "minLength", "countryCode", "el", "entity = 'areas' AND k % 17 = 0"),
        _finding("teams_schema", "error", "minLength", "name", "el", "entity = 'teams' AND k % 17 = 0"),
        _finding("competitions_schema", "error", "required", "plan", "el", "entity = 'competitions' AND k % 3 = 0"),
        _finding("matches_schema", "error", "type", "matchday", "el", "entity = 'matches' AND day_text IN ('999', 'x7')"),
        _finding("competitions_consistency", "error", "period_reversed", "", "el", "entity = 'competitions' AND k % 17 = 0"),
        _finding(
            "competitions_consistency", "warning", "period_open", "", "el", "entity = 'competitions' AND k % 17 <> 0 AND k % 19 = 0"
        ),
        _finding(
            "matches_consistency", "warning", "outside_season", "", "el", "entity = 'matches' AND CAST(ts AS DATE) > DATE '2024-01-20'"
        ),
        _finding("matches_consistency", "error", "same_team", "", "el", "entity = 'matches' AND k % 23 = 0"),
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE findings > 0"


FINDINGS = _expected_findings()


@query("chk_struct_findings", f"WITH {EVENTS} {FINDINGS}")
def struct_findings(t):
    found = structure.findings(E.good(rawbed.envelopes(t)))
    return found.groupBy("validator", "level", "rule", "field").agg(F.count(F.lit(1)).alias("findings"))


@query(
    "chk_struct_rows",
    f"""WITH {EVENTS} SELECT batch || '/' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '.json' AS payload,
    CAST(i AS VARCHAR) AS position, CASE WHEN id_text IS NULL THEN 'required' ELSE 'type' END AS rule, 'id' AS field
    FROM num WHERE entity = 'teams' AND (id_text IS NULL OR id_text = 'abc') UNION ALL
    SELECT batch || '/' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '.json', CAST(i AS VARCHAR), 'minLength', 'name'
    FROM num WHERE entity = 'teams' AND k % 17 = 0""",
)
def struct_rows(t):
    return structure.element_findings(rawbed.envelopes(t), ["teams"]).select("payload", "position", "rule", "field")


@query(
    "chk_schema_documents",
    f"""WITH {EVENTS} SELECT replace(validator, '_schema', '') AS entity, rule, field, findings FROM ({FINDINGS})
    WHERE validator LIKE '%_schema' AND level = 'error' AND rule <> 'list_missing'""",
)
def schema_documents(t):
    found = schemas.findings(E.good(rawbed.envelopes(t)), schemas.documents())
    # the path inside the innermost list
    return found.groupBy("entity", "rule", F.regexp_replace("field", r"^.*\[\][.]?", "").alias("field")).agg(F.count(F.lit(1)).alias("findings"))


def _row_of(entity: str, rule: str, field: str, where: str) -> str:
    return f"SELECT batch, event_id, entity, i, '{rule}' AS rule, '{entity}[].{field}' AS field FROM num WHERE entity = '{entity}' AND {where}"


_SCHEMA_ROWS = " UNION ALL ".join(
    [_row_of(e, "required", "id", "id_text IS NULL") for e in ("areas", "competitions", "teams", "matches")]
    + [_row_of(e, "type", "id", "id_text = 'abc'") for e in ("areas", "competitions", "teams", "matches")]
    + [
        _row_of("areas", "minLength", "countryCode", "k % 17 = 0"),
        _row_of("teams", "minLength", "name", "k % 17 = 0"),
        _row_of("competitions", "required", "plan", "k % 3 = 0"),
        _row_of("matches", "type", "matchday", "day_text IN ('999', 'x7')"),
    ]
)


@query(
    "chk_schema_rows",
    f"""WITH {EVENTS} SELECT batch || '/' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '.json' AS payload, entity,
    CAST(i AS VARCHAR) AS place, rule, field FROM ({_SCHEMA_ROWS})""",
)
def schema_rows(t):
    found = schemas.findings(rawbed.envelopes(t), schemas.documents())
    return found.where("place <> '' AND entity <> 'standings'").select("payload", "entity", "place", "rule", "field")


@query(
    "chk_declared_count",
    f"""WITH {EVENTS} SELECT entity, count(*) AS payloads FROM pay
    WHERE entity <> 'standings' AND NOT no_list AND n > 0 AND k % 31 = 0 GROUP BY ALL""",
)
def declared_count(t):
    found = structure.payload_findings(rawbed.envelopes(t), families=["completeness"]).filter("rule = 'declared_count'")
    return found.groupBy(F.col("field").alias("entity")).agg(F.count(F.lit(1)).alias("payloads"))


_NAMES = [(s, v) for s, names in native.PAYLOAD_SUITES.items() for v in names]
_VALIDATORS = ", ".join(
    f"('{s}', '{v}', {'true' if v in native.WARNING_ONLY else 'false'}, '{v.split('_')[0]}')" for s, v in _NAMES
)


@query(
    "suite_native_payloads",
    f"""WITH {EVENTS}, found AS ({FINDINGS}), validators(suite, name, soft, entity) AS (VALUES {_VALIDATORS}),
    totals AS (SELECT suite, name, soft, v.entity,
      CAST(coalesce((SELECT sum(findings) FROM found f WHERE f.validator = v.name AND f.level = 'error'), 0) AS BIGINT) AS errors,
      CAST(coalesce((SELECT sum(findings) FROM found f WHERE f.validator = v.name AND f.level = 'warning'), 0) AS BIGINT) AS warned
      FROM validators v)
    SELECT suite, name AS check_name, CASE WHEN entity = 'scorers' THEN 'SKIP' WHEN errors = 0 THEN 'PASS'
      WHEN soft THEN 'WARN' ELSE 'FAIL' END AS status, errors AS rows_failed,
      CASE WHEN warned > 0 THEN warned || ' warnings' END AS message FROM totals""",
)
def native_payloads(t):
    results = native.payload_results(E.good(rawbed.envelopes(t)))
    return results.select("suite", "check_name", "status", "rows_failed", "message")


# Only the newest good event of every entity.
LATEST = EVENTS.replace(
    "FROM events)",
    """FROM events WHERE event_id IN (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type
      ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE NOT (event_type = 'error' AND
      CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90)) WHERE rn = 1))""",
)


@query(
    "suite_native_latest_payloads",
    f"""WITH {LATEST}, found AS ({FINDINGS}), validators(suite, name, soft, entity) AS (VALUES {_VALIDATORS}),
    totals AS (SELECT name, soft, v.entity,
      CAST(coalesce((SELECT sum(findings) FROM found f WHERE f.validator = v.name AND f.level = 'error'), 0) AS BIGINT) AS errors
      FROM validators v)
    SELECT name AS check_name, CASE WHEN entity = 'scorers' THEN 'SKIP' WHEN errors = 0 THEN 'PASS' WHEN soft THEN 'WARN' ELSE 'FAIL'
      END AS status, errors AS rows_failed FROM totals""",
)
def native_latest(t):
    return native.latest_payload_results(rawbed.envelopes(t), rawbed.RUN).select("check_name", "status", "rows_failed")


# --- flatten ---------------------------------------------------------------------------------------------------------

ETL = {
    "dim_area": (
        "area_id, name, country_code, parent_area_id",
        f"SELECT id AS area_id, 'Area ' || event_id AS name, CASE WHEN k % 17 = 0 THEN 'X' WHEN k % 19 = 0 THEN NULL ELSE 'XY' END "
        f"AS country_code, CAST(CASE WHEN k % 5 <> 0 THEN k END AS BIGINT) AS parent_area_id FROM ({first_by('id', 'areas')})",
    ),
    "dim_competition": (
        "competition_id, area_id, name, type, plan",
        "SELECT id AS competition_id, CAST(k AS BIGINT) AS area_id, 'League ' || event_id AS name, 'LEAGUE' AS type, "
        f"CASE WHEN k % 3 <> 0 THEN 'TIER_ONE' END AS plan FROM ({first_by('id', 'competitions', 'k % 5 <> 0')})",
    ),
    "dim_team": (
        "team_id, area_id, name, founded",
        "SELECT id AS team_id, CAST(k AS BIGINT) AS area_id, CASE WHEN k % 17 = 0 THEN '' ELSE 'Team ' || event_id END AS name, "
        f"CAST(CASE WHEN k % 19 <> 0 THEN 1900 + k END AS INTEGER) AS founded FROM ({first_by('id', 'teams', 'k % 5 <> 0')})",
    ),
    "dim_season": (
        "season_id, competition_id, start_date, end_date",
        "SELECT CAST(2024 AS BIGINT) AS season_id, user_id AS competition_id, DATE '2024-01-01' AS start_date, "
        "DATE '2024-01-20' AS end_date FROM pay WHERE NOT no_list AND (entity = 'standings' OR entity = 'matches' AND n > 0) "
        "ORDER BY strftime(ts, '%Y%m%d'), event_id LIMIT 1",
    ),
    "fact_match": (
        "match_id, competition_id, season_id, utc_date, status, matchday, home_team_id, away_team_id",
        "SELECT id AS match_id, user_id AS competition_id, CAST(2024 AS BIGINT) AS season_id, date_trunc('second', ts) AS utc_date, "
        "'FINISHED' AS status, TRY_CAST(day_text AS INTEGER) AS matchday, user_id AS home_team_id, "
        f"user_id + CASE WHEN k % 23 = 0 THEN 0 ELSE 1 END AS away_team_id FROM ({first_by('id', 'matches')})",
    ),
    "fact_match_score": (
        "match_id, winner, duration, full_time_home, full_time_away",
        "SELECT id AS match_id, 'DRAW' AS winner, 'REGULAR' AS duration, CAST(i AS INTEGER) AS full_time_home, "
        f"CAST(i AS INTEGER) AS full_time_away FROM ({first_by('id', 'matches')})",
    ),
    "fact_standing": (
        "season_id, competition_id, team_id, standing_type, position, points, won, draw, lost",
        "SELECT CAST(2024 AS BIGINT) AS season_id, user_id AS competition_id, team AS team_id, 'TOTAL' AS standing_type, "
        "CAST(i + 1 AS INTEGER) AS position, CAST(i * 4 AS INTEGER) AS points, CAST(i AS INTEGER) AS won, "
        "CAST(i AS INTEGER) AS draw, CAST(NULL AS INTEGER) AS lost FROM (SELECT *, row_number() OVER (PARTITION BY user_id, team "
        "ORDER BY batch, event_id, i) AS rn FROM (SELECT *, event_id * 10 + CASE WHEN k % 13 = 0 THEN 0 ELSE i END AS team FROM num "
        "WHERE entity = 'standings')) WHERE rn = 1",
    ),
}
for _table, (_columns, _sql) in ETL.items():
    query(f"etl_{_table}", f"WITH {EVENTS} {_sql}")(
        lambda t, table=_table, columns=_columns: flatten.load_star(rawbed.envelopes(t), "loaded")[table].select(
            *columns.split(", ")
        )
    )

ENTITIES = {
    "areas": (
        "id, name, countryCode",
        "SELECT id, 'Area ' || event_id AS name, CASE WHEN k % 17 = 0 THEN 'X' WHEN k % 19 = 0 THEN NULL ELSE 'XY' END AS countryCode "
        "FROM num WHERE entity = 'areas'",
    ),
    "competitions": (
        "id, area_id, type, plan",
        "SELECT id, CAST(CASE WHEN k % 5 <> 0 THEN k END AS BIGINT) AS area_id, 'LEAGUE' AS type, "
        "CASE WHEN k % 3 <> 0 THEN 'TIER_ONE' END AS plan FROM num WHERE entity = 'competitions'",
    ),
    "teams": (
        "id, area_id, name",
        "SELECT id, CAST(CASE WHEN k % 5 <> 0 THEN k END AS BIGINT) AS area_id, "
        "CASE WHEN k % 17 = 0 THEN '' ELSE 'Team ' || event_id END AS name FROM num WHERE entity = 'teams'",
    ),
    "matches": (
        "id, competition_id, season_id, matchday, home_team_id, away_team_id",
        "SELECT id, user_id AS competition_id, CAST(2024 AS BIGINT) AS season_id, TRY_CAST(day_text AS INTEGER) AS matchday, "
        "user_id AS home_team_id, user_id + CASE WHEN k % 23 = 0 THEN 0 ELSE 1 END AS away_team_id FROM num WHERE entity = 'matches'",
    ),
    "standings": (
        "season_id, competition_id, team_id, position, playedGames, lost",
        "SELECT CAST(2024 AS BIGINT) AS season_id, user_id AS competition_id, "
        "event_id * 10 + CASE WHEN k % 13 = 0 THEN 0 ELSE i END AS team_id, CAST(i + 1 AS INTEGER) AS position, "
        "CAST(i + 1 AS INTEGER) AS playedGames, CAST(0 AS INTEGER) AS lost FROM num WHERE entity = 'standings'",
    ),
}
for _table, (_columns, _sql) in ENTITIES.items():
    query(f"etl_load_{_table}", f"WITH {EVENTS} {_sql}")(
        lambda t, table=_table, columns=_columns: flatten.load_entities(rawbed.envelopes(t))[table].select(*columns.split(", "))
    )


@query(
    "etl_load_counts",
    f"""WITH {EVENTS} SELECT entity AS "table", count(*) AS rows FROM el GROUP BY ALL""",
)
def load_counts(t):
    return flatten.row_counts(flatten.load_entities(rawbed.envelopes(t)))


@query(
    "etl_reload_run",
    f"""WITH {EVENTS} SELECT 'fact_match' AS "table", count(DISTINCT id) AS stored, CAST(0 AS BIGINT) AS added_again FROM num
    WHERE entity = 'matches' AND id IS NOT NULL
    UNION ALL SELECT 'dim_area', count(DISTINCT id), 0 FROM num WHERE entity = 'areas' AND id IS NOT NULL
    UNION ALL SELECT 'dim_team', count(DISTINCT id), 0 FROM num WHERE entity = 'teams' AND id IS NOT NULL AND k % 5 <> 0""",
)
def reload_run(t):
    """A run loaded twice into a fresh folder: what is stored, and what the second load added."""
    spark = t.spark
    root = f"{checkpoint_folder(spark)}/reload-{uuid.uuid4().hex}"
    # staged as a run is, so that no table of either load builds and parses the payloads of all entities again
    tables.append_envelopes(rawbed.envelopes(t), f"{root}/_raw")
    raw = tables.read_envelopes(spark, f"{root}/_raw", rawbed.RUN)
    first, again = (loading.load_run(raw, root, "dag", "loaded") for _ in range(2))
    rows = [(n, first[n], again[n]) for n in ("fact_match", "dim_area", "dim_team")]
    kept = {n: spark.read.parquet(f"{root}/{n}") for n in first}
    added = spark.createDataFrame([(n, a) for n, _, a in rows], "name STRING, added_again BIGINT")
    counts = flatten.row_counts({n: kept[n] for n, _, _ in rows}).withColumnRenamed("rows", "stored")
    return counts.join(added, F.col("table") == F.col("name")).select("table", "stored", "added_again")


def _source_gate(gate: str, known: str = "true"):
    """A source gate on the loaded star against the payloads that satisfy ``known``."""

    def build(t):
        raw = rawbed.envelopes(t)
        inputs = {**flatten.load_star(raw, "loaded"), **flatten.source_keys(raw.filter(known))}
        return fusion.evaluate("native", gate, native.STAR_GATES[gate], inputs).select("check_name", "status", "rows_failed")

    return build


def _not_loaded(entity: str) -> str:
    return (
        f"SELECT count(DISTINCT id) FROM num WHERE entity = '{entity}' AND id NOT IN "
        f"(SELECT id FROM num WHERE entity = '{entity}' AND id IS NOT NULL AND k % 5 <> 0)"
    )


def _invented(entity: str, where: str = "true") -> str:
    """Loaded rows of every third event, which the source gate is made to forget."""
    return f"SELECT count(DISTINCT id) FROM num WHERE entity = '{entity}' AND id IS NOT NULL AND event_id % 3 = 0 AND {where}"


query(
    "suite_native_source_completeness",
    S.verdicts(
        EVENTS,
        {
            "competitions_source_completeness": _not_loaded("competitions"),
            "teams_source_completeness": _not_loaded("teams"),
            "matches_source_completeness": "SELECT 0",
            "standings_source_completeness": "SELECT 0",
        },
        {"standings_source_completeness"},
    ),
)(_source_gate("source_completeness"))
query(
    "suite_native_source_exclusivity",
    S.verdicts(
        EVENTS,
        {
            "competitions_source_exclusivity": _invented("competitions", "k % 5 <> 0"),
            "teams_source_exclusivity": _invented("teams", "k % 5 <> 0"),
            "matches_source_exclusivity": _invented("matches"),
            "standings_source_exclusivity": "SELECT count(DISTINCT event_id * 10 + CASE WHEN k % 13 = 0 THEN 0 ELSE i END) FROM num "
            "WHERE entity = 'standings' AND event_id % 3 = 0",
        },
        {"standings_source_exclusivity"},
    ),
)(_source_gate("source_exclusivity", "cast(regexp_extract(source_file, '^0*([0-9]+)', 1) AS BIGINT) % 3 <> 0"))


# --- sources and exports ---------------------------------------------------------------------------------------------


@query(
    "etl_route_entity",
    f"WITH {EVENTS} SELECT entity, CASE WHEN user_id < 20 THEN 'experiment' ELSE 'baseline' END AS kind, count(*) AS payloads "
    "FROM pay GROUP BY ALL",
)
def route_entity(t):
    run = F.expr("concat(CASE WHEN user_id < 20 THEN 'exp_' ELSE 'run_' END, user_id)")
    routed = rawbed.payloads(t).join(t["events"].select("event_id", "user_id"), "event_id")
    return (
        routed.select(routing.entity_of(F.col("endpoint")).alias("entity"), routing.run_kind(run).alias("kind"))
        .groupBy("entity", "kind")
        .agg(F.count(F.lit(1)).alias("payloads"))
    )


@query(
    "src_latest_payload",
    f"""WITH {EVENTS} SELECT entity, lpad(CAST(event_id AS VARCHAR), 12, '0') || '.json' AS source_file FROM (
    SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS rn FROM pay WHERE ok) WHERE rn = 1""",
)
def latest_payload(t):
    return E.latest_per_entity(rawbed.envelopes(t)).select("entity", "source_file")


@query(
    "src_main_run",
    """WITH runs AS (SELECT CASE WHEN event_type = 'click' THEN 'manual__' ELSE 'scheduled__' END || user_id AS run_id, ts FROM events)
    SELECT * FROM (SELECT run_id, count(*) AS rows, max(ts) AS last_load FROM runs GROUP BY run_id)
    ORDER BY starts_with(run_id, 'manual__') DESC, rows DESC, last_load DESC, run_id LIMIT 1""",
)
def main_run(t):
    run = "concat(CASE WHEN event_type = 'click' THEN 'manual__' ELSE 'scheduled__' END, user_id) AS run_id"
    return E.main_run(t["events"].selectExpr(run, "ts AS load_ts"))


@query(
    "etl_export_files",
    f"""WITH {EVENTS} SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') || '_' || slug AS file, slug AS endpoint_slug FROM (
    SELECT event_id, CASE WHEN entity IN ('areas', 'competitions') THEN entity
      ELSE 'competitions__' || user_id || '__' || entity || '__season_2024' END AS slug FROM pay)""",
)
def export_files(t):
    return tables.export_payloads(rawbed.envelopes(t), rawbed.RUN).select("file", "endpoint_slug")


@query(
    "etl_export_manifest",
    f"""WITH {EVENTS}, facts AS (SELECT 'total' AS section, 'all' AS name FROM pay UNION ALL SELECT 'entity', entity FROM pay
      UNION ALL SELECT 'competition_id', CAST(user_id AS VARCHAR) FROM pay WHERE entity NOT IN ('areas', 'competitions')
      UNION ALL SELECT 'season', '2024' FROM pay WHERE entity NOT IN ('areas', 'competitions'))
    SELECT section, name, count(*) AS payloads FROM facts GROUP BY ALL""",
)
def export_manifest(t):
    return tables.export_manifest(tables.export_payloads(rawbed.envelopes(t), rawbed.RUN))


@query("ctl_batch_count", "SELECT count(DISTINCT CAST(ts AS DATE)) AS batches FROM events")
def batch_count(t):
    return ledger.batch_count(rawbed.envelopes(t), rawbed.RUN)

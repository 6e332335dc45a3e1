"""Fail-rows of whole suites and quarantine by every kind of check."""

from __future__ import annotations

from collections.abc import Mapping

from catalog import query
from catalog import sql as S
from catalog.suites import _FKS, _KEYS, EXPECTED, STAR_EXPECTED
from dqloom.operators import failrows
from dqloom.plans import suites, testbed

SUITE, STAGE = "gx", "T"
ENTITY_NAMES = {"x_match": "matches", "x_standing": "standings", "x_team": "teams", "x_competition": "competitions", "x_area": "areas"}
ENTITY_SHOWN = {
    "matches": ("id", "competition_id", "season_id", "home_team_id", "away_team_id"),
    "standings": ("season_id", "competition_id", "team_id"),
    **{n: ("id",) for n in ("teams", "competitions", "areas")},
}
STAR_SHOWN = {name: tuple(c.strip() for c in keys.split(",")) for name, keys in _KEYS.items()}


def _key(columns, alias: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({alias}.{c} AS VARCHAR), 'NULL')" for c in columns) + ")"


def _rows(sql: str, check: str, detail: str, names: Mapping[str, str], shown) -> str:
    """Violating rows instead of their number, of one of the counting queries that the suites are stated with."""
    head = f"SELECT '{check}' AS check_name, {detail} AS detail, "
    for prefix in ("SELECT count(*) FROM (SELECT ", "SELECT count(*) FROM "):
        if sql.startswith(prefix):
            rest = sql[len(prefix) :]
            break
    if "HAVING" in sql:
        keys, rest = rest.split(" FROM ", 1)
        table, rest = rest.split(" WHERE ", 1)
        where = rest.split(" GROUP BY ")[0]
        inner = sql[len("SELECT count(*) FROM ") :]
        condition = f"({where}) AND ({keys}) IN {inner}"
    else:
        table, condition = rest.split(" WHERE ", 1)
        table = table.removesuffix(" c")
    name = names.get(table, table)
    return f"""{head} '{name}' AS "table", {_key(shown[name], 'c')} AS row_key FROM {table} c WHERE {condition}"""


def _fail_rows() -> str:
    parts = []
    refs = {"fact_match_home_team_fk": "home_team", "fact_match_away_team_fk": "away_team", "fact_match_competition_fk": "competition"}
    for check, sql in EXPECTED[SUITE, STAGE].items():
        detail = f"'{refs[check]}'" if check in refs else "CAST(NULL AS VARCHAR)"
        parts.append(_rows(sql, check, detail, ENTITY_NAMES, ENTITY_SHOWN))
    return " UNION ALL ".join(parts)


def _found(t):
    return failrows.fail_rows(suites.ENTITY_SUITES[SUITE].checks(STAGE), testbed.entity_tables(t, True), ENTITY_SHOWN)


@query("failrows_suite", f"WITH {S.ENTITIES} {_fail_rows()}")
def suite_fail_rows(t):
    return _found(t)


@query(
    "failrows_samples",
    f"""WITH {S.ENTITIES}, f AS ({_fail_rows()})
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY check_name ORDER BY row_key, detail NULLS FIRST, "table") AS INTEGER) AS rank FROM f)
    WHERE rank <= {failrows.SAMPLE_ROWS}""",
)
def suite_samples(t):
    return failrows.samples(_found(t))


def _quarantined() -> str:
    parts = []
    details = {f"fk_{child}_{label}": label for child, label, *_ in _FKS}
    for check, sql in STAR_EXPECTED["schema_constraints", "T"].items():
        parts.append(_rows(sql, check, f"'{details.get(check, '')}'", {}, STAR_SHOWN))
    return " UNION ALL ".join(parts)


_ORDER = {c.name: i for i, c in enumerate(suites.SCHEMA_CONSTRAINTS.checks("T"))}
_RANK = "CASE check_name " + " ".join(f"WHEN '{name}' THEN {i}" for name, i in _ORDER.items()) + " END"


@query(
    "quarantine_all",
    f"""WITH {S.STAR}, f AS ({_quarantined()}) SELECT "table", row_key, string_agg(check_name, ',' ORDER BY {_RANK}) AS violations
    FROM (SELECT DISTINCT check_name, "table", row_key FROM f) GROUP BY ALL""",
)
def quarantine_all(t):
    return failrows.quarantine(suites.SCHEMA_CONSTRAINTS.checks("T"), testbed.star_tables(t, True), STAR_SHOWN)

"""Mutations, experiment matrices and mart comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import query
from catalog import sql as S
from catalog.suites import EXPECTED
from dqloom.operators import diff, digests, flatten, marts, mutations, reports
from dqloom.operators.mutations import ENTITY_LAYOUT, STAR_LAYOUT, STAR_NAMES
from dqloom.plans import experiment, strategies, testbed
from dqloom.session import checkpoint_folder

COLUMNS = ", ".join(testbed.MATCH_COLUMNS)
CLEAN = f"WITH {S.X_CLEAN} "
# Rows of the matches with the n smallest ids (an id may occur more than once).
FIRST = "id IN (SELECT id FROM x_clean ORDER BY id LIMIT {n})"
MIN_ID = "(SELECT min(id) FROM x_clean)"


def matches(t) -> DataFrame:
    return testbed.matches(t)


def _replaced(**changes: str) -> str:
    return ", ".join(f"{changes[c]} AS {c}" if c in changes else c for c in testbed.MATCH_COLUMNS)


@query(
    "mut_swap_teams",
    CLEAN
    + "SELECT "
    + _replaced(
        home_team_id=f"CASE WHEN {FIRST.format(n=5)} THEN away_team_id ELSE home_team_id END",
        away_team_id=f"CASE WHEN {FIRST.format(n=5)} THEN home_team_id ELSE away_team_id END",
    )
    + " FROM x_clean",
)
def swap(t):
    return mutations.swap_teams(matches(t))


@query(
    "mut_collapse_teams",
    CLEAN + "SELECT " + _replaced(home_team_id=f"CASE WHEN {FIRST.format(n=5)} THEN away_team_id ELSE home_team_id END") + " FROM x_clean",
)
def collapse(t):
    return mutations.collapse_teams(matches(t))


_ROW_ORDER = ", ".join(f"{c} NULLS FIRST" for c in testbed.MATCH_COLUMNS)


@query(
    "mut_duplicate_first",
    CLEAN + f"SELECT {COLUMNS} FROM x_clean UNION ALL SELECT * FROM (SELECT {COLUMNS} FROM x_clean ORDER BY {_ROW_ORDER} LIMIT 1)",
)
def duplicate(t):
    return mutations.duplicate_first(matches(t))


@query(
    "mut_drop_required", CLEAN + "SELECT " + _replaced(id=f"CASE WHEN id = {MIN_ID} THEN NULL ELSE id END") + " FROM x_clean"
)
def drop_required(t):
    return mutations.drop_required(matches(t))


@query("mut_corrupt_id", CLEAN + "SELECT " + _replaced(id=f"CASE WHEN id = {MIN_ID} THEN NULL ELSE id END") + " FROM x_clean")
def corrupt_id(t):
    return mutations.corrupt_id(matches(t))


@query(
    "mut_matchday_out_of_range",
    CLEAN + "SELECT " + _replaced(matchday=f"CASE WHEN {FIRST.format(n=3)} THEN 999 ELSE matchday END") + " FROM x_clean",
)
def matchday(t):
    return mutations.matchday_out_of_range(matches(t))


@query(
    "mut_drop_matches_key",
    CLEAN + """SELECT 'before' AS "table", count(*) AS rows FROM x_clean UNION ALL SELECT 'after', 0""",
)
def drop_key(t):
    return flatten.row_counts({"before": matches(t), "after": mutations.drop_matches_key(matches(t))})


_BUSIEST = """busiest AS (SELECT competition_id FROM x_clean WHERE competition_id IS NOT NULL GROUP BY competition_id
  ORDER BY count(*) DESC, competition_id LIMIT 1),
anchor AS (SELECT competition_id, season_id, coalesce(home_team_id, away_team_id) AS team_id FROM x_clean
  WHERE competition_id = (SELECT competition_id FROM busiest) ORDER BY id, season_id, team_id LIMIT 1)"""


@query(
    "mut_fact_match",
    f"""WITH {S.X_CLEAN}, {_BUSIEST} SELECT {COLUMNS} FROM x_clean UNION ALL
    SELECT 99999901, competition_id, season_id, TIMESTAMP '2025-01-01', 'MUTATED', 'MUTATED', 999, NULL, NULL FROM anchor
    WHERE NOT EXISTS (SELECT 1 FROM x_clean WHERE id = 99999901)""",
)
def fact_match(t):
    return mutations.insert_bad_match(testbed.entity_tables(t), ENTITY_LAYOUT)


@query(
    "mut_fact_standing",
    f"""WITH {S.X_CLEAN}, {S.standing_cte('x_standing', False)}, {_BUSIEST} SELECT * FROM x_standing UNION ALL
    SELECT season_id, competition_id, coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_suppkey NOT IN (SELECT x.team_id
      FROM x_standing x, anchor a WHERE x.season_id = a.season_id AND x.competition_id = a.competition_id)), team_id),
      'MUTATED', 'MUTATED', 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM anchor""",
)
def fact_standing(t):
    return mutations.insert_zero_standing(testbed.entity_tables(t), ENTITY_LAYOUT)


@query(
    "mut_star_fact_match",
    f"""WITH {S.CLEAN_STAR}, busiest AS (SELECT competition_id FROM fact_match_clean GROUP BY competition_id
      ORDER BY count(*) DESC, competition_id LIMIT 1),
    anchor AS (SELECT competition_id, season_id FROM fact_match_clean WHERE competition_id = (SELECT competition_id FROM busiest)
      ORDER BY match_id LIMIT 1)
    SELECT * FROM fact_match_clean UNION ALL SELECT 'base_run', 99999901, competition_id, season_id, TIMESTAMP '2025-01-01',
      'MUTATED', 'MUTATED', 999, NULL, NULL FROM anchor WHERE NOT EXISTS (SELECT 1 FROM fact_match_clean WHERE match_id = 99999901)""",
)
def star_fact_match(t):
    return mutations.insert_bad_match(testbed.star_tables(t), STAR_LAYOUT, testbed.BASELINE_RUN, STAR_NAMES)


@query(
    "mut_star_fact_standing",
    f"""WITH {S.CLEAN_STAR}, busiest AS (SELECT competition_id FROM fact_match_clean GROUP BY competition_id
      ORDER BY count(*) DESC, competition_id LIMIT 1)
    SELECT season_id, competition_id, team_id, standing_type, played_games, points FROM fact_standing_clean UNION ALL
    (SELECT season_id, competition_id, coalesce(home_team_id, away_team_id), 'MUTATED', 0, 0 FROM fact_match_clean
      WHERE competition_id = (SELECT competition_id FROM busiest) ORDER BY match_id LIMIT 1)""",
)
def star_fact_standing(t):
    changed = mutations.insert_zero_standing(testbed.star_tables(t), STAR_LAYOUT, testbed.BASELINE_RUN, STAR_NAMES)
    return changed.select("season_id", "competition_id", "team_id", "standing_type", "played_games", "points")


@query(
    "mut_dim_competition",
    f"""WITH {S.ENTITIES} SELECT id, area_id, CASE WHEN id = m THEN 'MUTATED_COMP' ELSE name END AS name,
    CASE WHEN id = m THEN 'MUT' ELSE code END AS code, CASE WHEN id = m THEN 'MUTATED' ELSE type END AS type,
    CASE WHEN id = m THEN 'MUTATED' ELSE plan END AS plan FROM x_competition, (SELECT min(id) AS m FROM x_competition)""",
)
def dim_competition(t):
    tables = testbed.entity_tables(t)
    return mutations.apply(tables, mutations.entity_mutation("dim_competition"))["competitions"]


@query("mut_season_dates_missing", CLEAN + "SELECT " + _replaced(utcDate="CAST(NULL AS TIMESTAMP)") + " FROM x_clean")
def dates_missing(t):
    return mutations.clear_columns(matches(t), "utcDate")


@query(
    "mut_star_season_dates_missing",
    f"""WITH {S.CLEAN_STAR} SELECT 'dim_season' AS tbl, count(*) AS rows, count(start_date) AS dated FROM
    (SELECT CAST(NULL AS DATE) AS start_date FROM dim_season_clean) UNION ALL
    SELECT 'fact_match', count(*), 0 FROM fact_match_clean""",
)
def star_dates_missing(t):
    changed = mutations.star_mutation("season_dates_missing", testbed.BASELINE_RUN)(testbed.star_tables(t))
    seasons = changed["dim_season"].selectExpr("'dim_season' AS tbl", "start_date")
    played = changed["fact_match"].selectExpr("'fact_match' AS tbl", "cast(utc_date AS DATE) AS start_date")
    counted = seasons.unionByName(played).groupBy("tbl")
    return counted.agg(F.count(F.lit(1)).alias("rows"), F.count("start_date").alias("dated"))


# --- detection matrix ------------------------------------------------------------------------------------------------

ITERATIONS = (
    experiment.Iteration("duplicate", (("matches", "duplicate_first"),)),
    experiment.Iteration("collapse", (("matches", "collapse_teams"),)),
    experiment.Iteration("bad match", (), ("fact_match",)),
    experiment.Iteration("no dates", (), ("season_dates_missing",)),
)
MATRIX_STRATEGY = strategies.Strategy("matrix", {"T": ("soda", "deequ"), "L": ("soda", "gx")})
MATRIX_SUITES = ("soda", "deequ", "gx")


def _mutated_match(name: str) -> str:
    """SQL of the matches after an iteration."""
    base = f"SELECT {COLUMNS} FROM x_clean"
    return {
        "baseline": base,
        "duplicate": f"{base} UNION ALL SELECT * FROM ({base} ORDER BY {_ROW_ORDER} LIMIT 1)",
        "collapse": "SELECT "
        + _replaced(home_team_id=f"CASE WHEN {FIRST.format(n=5)} THEN away_team_id ELSE home_team_id END")
        + " FROM x_clean",
        "bad match": f"{base} UNION ALL SELECT 99999901, competition_id, season_id, TIMESTAMP '2025-01-01', 'MUTATED', 'MUTATED', "
        "999, NULL, NULL FROM anchor",
        "no dates": "SELECT " + _replaced(utcDate="CAST(NULL AS TIMESTAMP)") + " FROM x_clean",
    }[name]


def _matrix_rows() -> tuple[str, str]:
    """CTEs and one (mutation, suite, stage, failed rows) row per check."""
    ctes, rows = [], []
    for i, name in enumerate(("baseline", *(it.name for it in ITERATIONS))):
        ctes.append(f"m{i} AS ({_mutated_match(name)})")
        for stage, names in MATRIX_STRATEGY.by_stage.items():
            for suite in names:
                for sql in EXPECTED[suite, stage].values():
                    own = sql.replace("x_match", f"m{i}").replace("x_standing", "x_standing_clean")
                    rows.append(f"SELECT '{name}' AS mutation, '{suite}' AS suite, '{stage}' AS stage, CAST(({own}) AS BIGINT) AS n")
    head = f"{S.ENTITIES}, {S.standing_cte('x_standing_clean', False)}, {_BUSIEST}, {', '.join(ctes)}"
    return head, " UNION ALL ".join(rows)


_HEAD, _ROWS = _matrix_rows()


@query(
    "exp_detection_matrix",
    f"WITH {_HEAD}, r AS ({_ROWS}) SELECT mutation, stage, "
    + ", ".join(f"count(*) FILTER (suite = '{s}' AND n > 0) AS {s}" for s in MATRIX_SUITES)
    + " FROM r GROUP BY mutation, stage",
)
def detection_matrix(t):
    results = experiment.run_entity_plan(testbed.entity_tables(t), ITERATIONS, MATRIX_STRATEGY)
    return reports.detection_matrix(results, MATRIX_SUITES)


@query(
    "rpt_mean_failures",
    f"""WITH {_HEAD}, r AS ({_ROWS}), f AS (SELECT suite, stage, mutation, count(*) FILTER (n > 0) AS k FROM r GROUP BY ALL)
    SELECT suite, stage, CAST(round(CAST(CAST(sum(k) AS DOUBLE) / count(*) AS DECIMAL(18,6)), 2) AS DOUBLE) AS mean_failed
    FROM f GROUP BY ALL""",
)
def mean_failures(t):
    results = experiment.run_entity_plan(testbed.entity_tables(t), ITERATIONS, MATRIX_STRATEGY)
    return reports.mean_failures(results)


# --- comparisons -----------------------------------------------------------------------------------------------------

DIFF_CTES = f"{S.CLEAN_STAR}, {S.mart_ctes('_clean')}, {S.star_ctes()}, {S.mart_ctes()}"
KPI_FIELDS = (
    "competition_name",
    "start_date",
    "end_date",
    "season_year",
    "matches_total",
    "matches_finished",
    "teams_distinct",
    "home_win_rate",
    "draw_rate",
    "away_win_rate",
)
COUNT_FIELDS = ("matches_played", "wins", "draws", "losses", "goals_for", "goals_against", "goal_difference", "points_calc")


def _changed(fields, keys: str, before: str, after: str, match: str) -> str:
    parts = []
    for f in fields:
        parts.append(
            f"SELECT {keys}, 'changed' AS change, '{f}' AS field, CAST(b.{f} AS VARCHAR) AS before, CAST(a.{f} AS VARCHAR) AS after "
            f"FROM {before} b JOIN {after} a ON {match} WHERE b.{f} IS DISTINCT FROM a.{f}"
        )
    return " UNION ALL ".join(parts)


_TEAM_MATCH = "b.competition_id = a.competition_id AND b.season_id = a.season_id AND b.team_id = a.team_id"


def _one_sided(change: str, have: str, lack: str) -> str:
    keys = ", ".join(f"x.{k}" for k in ("competition_id", "season_id", "team_id"))
    match = " AND ".join(f"y.{k} = x.{k}" for k in ("competition_id", "season_id", "team_id"))
    none = "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT {keys}, '{change}' AS change, {none} AS field, {none} AS before, {none} AS after FROM {have} x "
        f"WHERE NOT EXISTS (SELECT 1 FROM {lack} y WHERE {match})"
    )


def _team_marts(t) -> tuple[DataFrame, DataFrame]:
    columns = ["competition_id", "season_id", "team_id", *COUNT_FIELDS]
    return tuple(testbed.star_tables(t, bad)["mart_team"].select(*columns) for bad in (False, True))


TEAM_DIFF = " UNION ALL ".join(
    (
        _changed(COUNT_FIELDS, "b.competition_id, b.season_id, b.team_id", "mart_team_clean", "mart_team", _TEAM_MATCH),
        _one_sided("added", "mart_team", "mart_team_clean"),
        _one_sided("removed", "mart_team_clean", "mart_team"),
    )
)


@query("exp_mart_diff", f"WITH {DIFF_CTES} {TEAM_DIFF}")
def mart_diff(t):
    return diff.keyed_diff(*_team_marts(t), marts.MART_KEYS["mart_team"])


def _stored_marts(t) -> tuple[str, str]:
    """Both versions of the team mart, stored with their digests in the shared folder."""
    root = f"{checkpoint_folder(t.spark)}/marts-{uuid.uuid4().hex}"
    paths = (f"{root}/before", f"{root}/after")
    for mart, path in zip(_team_marts(t), paths, strict=True):
        digests.store(mart, path, marts.MART_KEYS["mart_team"], 4)
    return paths


@query("exp_mart_diff_stored", f"WITH {DIFF_CTES} {TEAM_DIFF}")
def mart_diff_stored(t):
    return digests.stored_diff(t.spark, *_stored_marts(t), marts.MART_KEYS["mart_team"])


@query(
    "exp_mart_diff_totals",
    f"WITH {DIFF_CTES}, d AS ({TEAM_DIFF}) SELECT change, count(*) AS rows FROM "
    "(SELECT DISTINCT competition_id, season_id, team_id, change FROM d) GROUP BY ALL",
)
def mart_diff_totals(t):
    keys = marts.MART_KEYS["mart_team"]
    return diff.diff_totals(diff.keyed_diff(*_team_marts(t), keys), keys)


@query(
    "exp_mart_diff_sample",
    f"WITH {DIFF_CTES}, d AS ({TEAM_DIFF}), k AS (SELECT DISTINCT competition_id, season_id, team_id FROM d WHERE change = 'changed' "
    "ORDER BY ALL LIMIT 50) SELECT d.* FROM d JOIN k USING (competition_id, season_id, team_id) WHERE change = 'changed'",
)
def mart_diff_sample(t):
    keys = marts.MART_KEYS["mart_team"]
    return diff.diff_sample(diff.keyed_diff(*_team_marts(t), keys), keys, "changed")


@query(
    "exp_mart_fields_changed",
    f"WITH {DIFF_CTES}, d AS ("
    + _changed(
        KPI_FIELDS,
        "b.competition_id, b.season_id",
        "mart_kpi_clean",
        "mart_kpi",
        "b.competition_id = a.competition_id AND b.season_id = a.season_id",
    )
    + ") SELECT field, count(*) AS rows FROM d GROUP BY ALL",
)
def mart_fields_changed(t):
    before, after = (testbed.star_tables(t, bad)["mart_kpi"] for bad in (False, True))
    found = diff.compare_marts({"mart_kpi": before}, {"mart_kpi": after}, {"mart_kpi": marts.MART_KEYS["mart_kpi"]})["mart_kpi"]
    return found.filter("change = 'changed'").groupBy("field").agg(F.count(F.lit(1)).alias("rows"))


TEAM_FIELDS = ("competition_name", "start_date", "end_date", "season_year", "team_name", *COUNT_FIELDS)


def _change_totals(mart: str, keys: tuple[str, ...], fields) -> str:
    """mart, change and number of keys between both versions of a mart, in all its fields."""
    listed = ", ".join(keys)
    match = " AND ".join(f"b.{k} = a.{k}" for k in keys)
    parts = [f"SELECT {', '.join(f'b.{k}' for k in keys)}, 'changed' AS change FROM {mart}_clean b JOIN {mart} a ON {match} WHERE "
             + " OR ".join(f"b.{f} IS DISTINCT FROM a.{f}" for f in fields)]
    for change, have, lack in (("added", mart, f"{mart}_clean"), ("removed", f"{mart}_clean", mart)):
        same = " AND ".join(f"y.{k} = x.{k}" for k in keys)
        parts.append(f"SELECT {', '.join(f'x.{k}' for k in keys)}, '{change}' FROM {have} x WHERE NOT EXISTS (SELECT 1 FROM {lack} y WHERE {same})")
    return f"SELECT '{mart}' AS mart, change, count(*) AS rows FROM (SELECT DISTINCT {listed}, change FROM ({' UNION ALL '.join(parts)})) GROUP BY ALL"


@query(
    "exp_comparison",
    f"""WITH {DIFF_CTES} SELECT 'defects' AS iteration, CAST(NULL AS VARCHAR) AS stopped_at, mart, change, rows FROM (
    {_change_totals("mart_kpi", ("competition_id", "season_id"), KPI_FIELDS)} UNION ALL
    {_change_totals("mart_team", ("competition_id", "season_id", "team_id"), TEAM_FIELDS)})
    UNION ALL SELECT 'twins', 'uniqueness', NULL, NULL, NULL""",
)
def comparison(t):
    before, after = ({name: testbed.star_tables(t, bad)[name] for name in marts.MART_KEYS} for bad in (False, True))
    passed = experiment.PayloadOutcome("defects", None, [], changes=diff.compare_marts(before, after, marts.MART_KEYS))
    same = experiment.PayloadOutcome("nothing", None, [], changes=diff.compare_marts(before, before, marts.MART_KEYS))
    return experiment.compare_iterations([passed, same, experiment.PayloadOutcome("twins", "uniqueness", [])], t.spark)


@query(
    "exp_keyless_diff",
    f"""WITH {S.X_CLEAN}, {S.X_MATCH}, a AS (SELECT DISTINCT {COLUMNS} FROM x_clean), b AS (SELECT DISTINCT {COLUMNS} FROM x_match)
    SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL
    SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def keyless_diff(t):
    return diff.keyless_diff(testbed.matches(t), testbed.matches(t, True))

"""Whole suites, fused."""

from __future__ import annotations

from catalog import query
from catalog import sql as S
from dqloom.operators import fusion
from dqloom.plans import native, suites, testbed

M, ST, TEAM, COMP, AREA = "x_match", "x_standing", "x_team", "x_competition", "x_area"
PRESENT = "id IS NOT NULL"
MATCHDAY = S.count(M, "matchday < 0 OR matchday > 60")
STATUS = S.count(M, f"status NOT IN {S.STATUSES}")
SAME = S.count(M, "home_team_id = away_team_id")
NO_TEAM = S.count(M, "home_team_id IS NULL OR away_team_id IS NULL")
NO_DATE = S.count(M, "utcDate IS NULL")
POINTS = S.count(ST, "points <> won * 3 + draw")
RATE = S.count(ST, "playedGames <> 0 AND (won * 1.0 / playedGames < 0 OR won * 1.0 / playedGames > 1)")
FK_COMP = S.orphans(M, "competition_id", COMP, null_counts=True)
FK_HOME, FK_AWAY = S.orphans(M, "home_team_id", TEAM), S.orphans(M, "away_team_id", TEAM)
FK_ALL = f"SELECT ({FK_COMP}) + ({FK_HOME}) + ({FK_AWAY})"
STANDING_DUPES = S.duplicates(ST, "competition_id, season_id, team_id")
MATCH_DUPES, MATCH_DUPES_PRESENT = S.duplicates(M, "id"), S.duplicates(M, "id", PRESENT)
MATCH_COMPLETE = S.count(M, "id IS NULL OR utcDate IS NULL OR home_team_id IS NULL OR away_team_id IS NULL")
DIMS = {"areas": AREA, "competitions": COMP, "teams": TEAM}
COMPLETE = {f"{n}_completeness": S.count(x, "id IS NULL OR name IS NULL") for n, x in DIMS.items()}
UNIQUE = {f"{n}_uniqueness": S.duplicates(x, "id", PRESENT) for n, x in DIMS.items()}

SQL_L = {"mart_kpi_rate_out_of_bounds": RATE, "mart_kpi_missing_dates": NO_DATE, "mart_duplicate_team_rows": STANDING_DUPES}
SODA_E = {
    "stg_missing_match_id": S.count(M, "id IS NULL"),
    "stg_matchday_out_of_range": MATCHDAY,
    "stg_duplicate_match_id": MATCH_DUPES_PRESENT,
    **COMPLETE,
    "matches_completeness": MATCH_COMPLETE,
}
GX_E = {
    **COMPLETE,
    "matches_completeness": MATCH_COMPLETE,
    "standings_completeness": S.count(ST, "season_id IS NULL OR competition_id IS NULL OR team_id IS NULL"),
    **UNIQUE,
    "matches_uniqueness": MATCH_DUPES_PRESENT,
    **{f"matches_schema_{c}": S.count(M, f"{c} IS NULL") for c in ("id", "utcDate", "status")},
    "matches_home_away_diff": SAME,
    "matchday_out_of_range": MATCHDAY,
    "match_status_invalid": STATUS,
}
EXPECTED = {
    ("sql", "E"): {"stg_schema_matches_key_missing": "SELECT 0", **SODA_E, **UNIQUE},
    ("sql", "T"): {
        "dds_duplicate_fact_match": MATCH_DUPES,
        "dds_missing_home_away_team": NO_TEAM,
        "dds_referential_integrity_violation": FK_ALL,
        "dds_matchday_out_of_range": MATCHDAY,
        "match_home_away_diff": SAME,
        "standings_points_consistency": POINTS,
        "match_status_invalid": STATUS,
    },
    ("sql", "L"): SQL_L,
    ("soda", "E"): SODA_E,
    ("soda", "T"): {
        "dds_duplicate_fact_match": MATCH_DUPES,
        "dds_missing_home_away_team": NO_TEAM,
        "dds_referential_integrity_violation": FK_ALL,
        "match_home_away_diff": SAME,
        "match_status_invalid": STATUS,
    },
    ("soda", "L"): SQL_L,
    ("gx", "E"): GX_E,
    ("gx", "T"): {
        **GX_E,
        "fact_match_home_team_fk": FK_HOME,
        "fact_match_away_team_fk": FK_AWAY,
        "fact_match_competition_fk": FK_COMP,
        "standings_points_consistency": POINTS,
    },
    ("gx", "L"): {
        "mart_kpi_rate_out_of_bounds": MATCHDAY,
        "mart_kpi_missing_dates": NO_DATE,
        "mart_duplicate_standings": STANDING_DUPES,
    },
    ("deequ", "E"): {
        **{f"{c}_is_complete": S.count(M, f"{c} IS NULL") for c in ("id", "utcDate", "status")},
        "home_team_complete": S.count(M, "home_team_id IS NULL"),
        "away_team_complete": S.count(M, "away_team_id IS NULL"),
        "matchday_range": MATCHDAY,
        "status_valid": STATUS,
        "unique_match_id": MATCH_DUPES_PRESENT,
        "unique_competition_id": UNIQUE["competitions_uniqueness"],
        "unique_team_id": UNIQUE["teams_uniqueness"],
        "unique_area_id": UNIQUE["areas_uniqueness"],
        **{f"{n}_not_empty": S.empty(x) for n, x in DIMS.items()},
        **{f"{n}_id_complete": S.count(x, "id IS NULL OR name IS NULL") for n, x in DIMS.items()},
    },
    ("deequ", "T"): {
        "unique_match_id": MATCH_DUPES,
        "missing_home_away": NO_TEAM,
        "home_away_diff": SAME,
        "referential_home": FK_HOME,
        "referential_away": FK_AWAY,
        "referential_competition": FK_COMP,
        "matchday_out_of_range": MATCHDAY,
        "status_valid": STATUS,
        "standings_points_consistency": POINTS,
        "played_games_positive": S.count(ST, "playedGames = 0"),
    },
    ("deequ", "L"): {
        "matches_dates_not_null": NO_DATE,
        "unique_standings": STANDING_DUPES,
        "standings_positive_points": S.count(ST, "points < 0"),
        "rate_out_of_bounds": RATE,
        "standings_not_empty": S.empty(ST),
    },
}


def _entity_suite(name: str, stage: str):
    def build(t):
        checks = suites.ENTITY_SUITES[name].checks(stage)
        found = fusion.evaluate(name, stage, checks, testbed.entity_tables(t, True))
        return found.select("check_name", "status", "rows_failed")

    return build


for (_suite, _stage), _counts in EXPECTED.items():
    query(f"suite_{_suite}_{_stage}", S.verdicts(S.ENTITIES, _counts))(_entity_suite(_suite, _stage))

# --- star schema -----------------------------------------------------------------------------------------------------

FM, FS, KPI, TM = "fact_match", "fact_standing", "mart_kpi", "mart_team"
S_NO_DATE = S.count(FM, "utc_date IS NULL")
S_ZERO = S.count(FS, "played_games = 0 AND won = 0 AND draw = 0 AND lost = 0")
S_NAME = S.count("dim_competition", "name = 'MUTATED_COMP'")
S_SEASON = S.count("dim_season", "start_date IS NULL OR end_date IS NULL")
S_MATCHDAY = S.count(FM, "matchday < 0 OR matchday > 60")
S_NO_TEAM = S.count(FM, "home_team_id IS NULL OR away_team_id IS NULL")
S_RI = (
    f"SELECT ({S.orphans(FM, 'competition_id', 'dim_competition', 'competition_id', True)}) + "
    f"({S.orphans(FM, 'season_id', 'dim_season', 'season_id', True)}) + "
    f"({S.orphans(FM, 'home_team_id', 'dim_team', 'team_id')}) + ({S.orphans(FM, 'away_team_id', 'dim_team', 'team_id')})"
)
RATES = "home_win_rate < 0 OR home_win_rate > 1 OR draw_rate < 0 OR draw_rate > 1 OR away_win_rate < 0 OR away_win_rate > 1"
NO_PERIOD = "start_date IS NULL OR end_date IS NULL OR season_year IS NULL"
TEAM_KEY = "run_id, competition_id, season_id, team_id"
POST = {
    "dds_match_same_team": S.count(FM, "home_team_id = away_team_id"),
    "dds_standings_points_inconsistent": S.count(FS, "points <> won * 3 + draw"),
    "dds_match_null_competition_id": S.count(FM, "competition_id IS NULL"),
    "dds_match_null_season_id": S.count(FM, "season_id IS NULL"),
    "mart_kpi_rate_out_of_bounds": S.count(KPI, RATES),
    "mart_kpi_missing_dates": S.count(KPI, NO_PERIOD),
    "mart_team_missing_dates": S.count(TM, NO_PERIOD),
    "mart_team_points_inconsistent": S.count(TM, "points_calc <> wins * 3 + draws"),
    "mart_team_matches_inconsistent": S.count(TM, "matches_played <> wins + draws + losses"),
    "mart_team_negative_values": S.count(TM, "points_calc < 0 OR goals_for < 0 OR goals_against < 0"),
}
STAR_EXPECTED = {
    ("stage", "T"): {
        "dds_duplicate_fact_match": S.duplicates(FM, "run_id, match_id"),
        "dds_missing_home_away_team": S_NO_TEAM,
        "dds_referential_integrity_violation": S_RI,
        "dds_matchday_out_of_range": S_MATCHDAY,
        "dds_fact_match_utc_date_missing": S_NO_DATE,
        "dds_dim_competition_name_corrupted": S_NAME,
        "dds_fact_standing_zero_played_games": S_ZERO,
        "dds_dim_season_dates_missing": S_SEASON,
        "dds_dim_team_duplicate": S.duplicates("dim_team", "run_id, team_id"),
        "dds_dim_competition_duplicate": S.duplicates("dim_competition", "run_id, competition_id"),
    },
    ("stage", "L"): {
        "dds_dim_season_dates_missing": S_SEASON,
        "dds_fact_match_utc_date_missing": S_NO_DATE,
        "dds_fact_standing_zero_played_games": S_ZERO,
        "dds_dim_competition_name_corrupted": S_NAME,
        "mart_kpi_rate_out_of_bounds": POST["mart_kpi_rate_out_of_bounds"],
        "mart_kpi_missing_dates": POST["mart_kpi_missing_dates"],
        "mart_duplicate_team_rows": S.duplicates(TM, TEAM_KEY),
    },
    ("constraints", "T"): {
        "dds_fact_match_home_away_valid": S.count(
            FM, "home_team_id IS NULL OR away_team_id IS NULL OR home_team_id = away_team_id"
        ),
        "dds_fact_match_matchday_range": S_MATCHDAY,
        "dds_fact_match_utc_date_missing": S_NO_DATE,
        "dds_dim_season_dates_missing": S_SEASON,
        "dds_fact_standing_zero_played_games": S_ZERO,
        "dds_dim_competition_name_corrupted": S_NAME,
    },
    ("post", "POST"): POST,
    ("dbt", "T"): {
        "t_dds_duplicates_fact_match": S.duplicates(FM, "run_id, match_id"),
        "t_dds_matchday_out_of_range": S_MATCHDAY,
        "t_dds_missing_home_away": S_NO_TEAM,
        "t_dds_referential_integrity": S_RI,
    },
    ("dbt", "L"): {
        "l_mart_kpi_missing_dates": POST["mart_kpi_missing_dates"],
        "l_mart_kpi_rate_out_of_bounds": POST["mart_kpi_rate_out_of_bounds"],
        "l_mart_team_duplicates": S.duplicates(TM, TEAM_KEY),
    },
}
_KEYS = {
    "dim_area": "area_id",
    "dim_competition": "competition_id",
    "dim_season": "season_id",
    "dim_team": "team_id",
    "fact_match": "match_id",
    "fact_match_score": "match_id",
    "fact_standing": "season_id, competition_id, team_id, standing_type",
}
_FKS = (
    ("dim_area", "parent_area", "parent_area_id", "dim_area", "area_id"),
    ("dim_competition", "area", "area_id", "dim_area", "area_id"),
    ("dim_season", "competition", "competition_id", "dim_competition", "competition_id"),
    ("dim_team", "area", "area_id", "dim_area", "area_id"),
    ("fact_match", "home_team", "home_team_id", "dim_team", "team_id"),
    ("fact_match", "away_team", "away_team_id", "dim_team", "team_id"),
    ("fact_match", "competition", "competition_id", "dim_competition", "competition_id"),
    ("fact_match", "season", "season_id", "dim_season", "season_id"),
    ("fact_match_score", "match", "match_id", "fact_match", "match_id"),
    ("fact_standing", "competition", "competition_id", "dim_competition", "competition_id"),
    ("fact_standing", "season", "season_id", "dim_season", "season_id"),
    ("fact_standing", "team", "team_id", "dim_team", "team_id"),
)
STAR_EXPECTED["schema_constraints", "T"] = {
    "ck_fact_match_home_away_valid": STAR_EXPECTED["constraints", "T"]["dds_fact_match_home_away_valid"],
    "ck_fact_match_matchday_range": S_MATCHDAY,
    "ck_fact_match_utc_date_not_null": S_NO_DATE,
    "ck_dim_season_dates_not_null": S_SEASON,
    **{f"pk_{x}": S.duplicates(x, f"run_id, {k}") for x, k in _KEYS.items()},
    **{
        f"pk_not_null_{x}": S.count(x, " OR ".join(f"{c.strip()} IS NULL" for c in f"run_id, {k}".split(",")))
        for x, k in _KEYS.items()
    },
    **{f"fk_{child}_{label}": S.orphans(child, key, parent, pk) for child, label, key, parent, pk in _FKS},
}


def _star_suite(name: str, stage: str):
    def build(t):
        checks = suites.STAR_SUITES[name].checks(stage)
        found = fusion.evaluate(name, stage, checks, testbed.star_tables(t, True))
        return found.select("check_name", "status", "rows_failed")

    return build


for (_suite, _stage), _counts in STAR_EXPECTED.items():
    _ctes = S.MARTS if any("mart_" in c for c in _counts.values()) else S.STAR
    query(f"suite_{_suite}_{_stage}", S.verdicts(_ctes, _counts))(_star_suite(_suite, _stage))

_REF = {
    "fact_match_fk": f"SELECT ({S.orphans(FM, 'home_team_id', 'dim_team', 'team_id')}) + "
    f"({S.orphans(FM, 'away_team_id', 'dim_team', 'team_id')}) + ({S.orphans(FM, 'season_id', 'dim_season', 'season_id')})",
    "fact_standing_fk": S.orphans(FS, "team_id", "dim_team", "team_id"),
    "dim_competition_area_fk": S.orphans("dim_competition", "area_id", "dim_area", "area_id"),
}
_ROUND_ROBIN = """round_robin AS (SELECT run_id, competition_id, season_id, team_id, sum(h) AS home_matches, sum(a) AS away_matches FROM (
  SELECT run_id, competition_id, season_id, home_team_id AS team_id, 1 AS h, 0 AS a FROM fact_match UNION ALL
  SELECT run_id, competition_id, season_id, away_team_id, 0, 1 FROM fact_match)
  WHERE season_id IN (SELECT season_id FROM dim_season WHERE start_date < DATE '2025-01-01') GROUP BY ALL)"""
_RULES = {
    "match_home_away_diff": POST["dds_match_same_team"],
    "match_status_valid": S.count(FM, f"status NOT IN {S.STATUSES}"),
    "standings_points_consistency": POST["dds_standings_points_inconsistent"],
    "season_round_robin": S.count("round_robin", "home_matches <> away_matches"),
}


def _native(gate: str):
    def build(t):
        inputs = native.star_inputs(testbed.star_tables(t, True))
        return fusion.evaluate("native", gate, native.STAR_GATES[gate], inputs).select("check_name", "status", "rows_failed")

    return build


query("suite_native_referential", S.verdicts(S.STAR, _REF, {"fact_standing_fk"}))(_native("referential"))
query(
    "suite_native_rules",
    S.verdicts(
        f"{S.STAR}, {_ROUND_ROBIN}", _RULES, {"match_status_valid", "standings_points_consistency", "season_round_robin"}
    ),
)(_native("rules"))


@query(
    "chk_round_robin",
    f"WITH {S.STAR}, {_ROUND_ROBIN} SELECT competition_id, season_id, team_id, CAST(home_matches AS BIGINT) AS home_matches, "
    "CAST(away_matches AS BIGINT) AS away_matches FROM round_robin WHERE home_matches <> away_matches",
)
def round_robin(t):
    table = native.star_inputs(testbed.star_tables(t, True))["round_robin"]
    return table.filter("home_matches <> away_matches").drop("run_id")


_TALLY = " UNION ALL ".join(
    f"SELECT '{suite}' AS suite, 'T' AS stage, status FROM ({S.verdicts('', EXPECTED[suite, 'T'])})" for suite in ("sql", "deequ")
)


@query(
    "suite_run_tally",
    f"""WITH {S.ENTITIES} SELECT suite, stage, count(*) AS checks_total, count(*) FILTER (status = 'FAIL') AS checks_failed,
    CASE WHEN count(*) FILTER (status = 'FAIL') = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM ({_TALLY}) GROUP BY ALL""",
)
def run_tally(t):
    tables = testbed.entity_tables(t, True)
    found = [fusion.evaluate(s, "T", suites.ENTITY_SUITES[s].checks("T"), tables) for s in ("sql", "deequ")]
    return fusion.tally(found[0].unionByName(found[1]))

"""The declared suites.

``SQL``, ``SODA``, ``GX`` and ``DEEQU`` run on the five entity tables.  The stage
suite, the constraint suite and the post-load suite run on the versioned star
schema and its marts.  Check names are part of the result contract; the same name
may mean different rules in different suites, so results are keyed by suite,
stage and check.
"""

from __future__ import annotations

from dqloom.functions import rules as R
from dqloom.operators import checks as C
from dqloom.operators.checks import Check, Ref, Suite
from dqloom.plans.tables import MATCHDAY_RANGE, MATCH_STATUSES, key_checks, table_constraints

# --- rules shared by several suites ---------------------------------------------------------------------------------

MATCHDAY = R.outside("matchday", *MATCHDAY_RANGE)
STATUS = R.not_in("status", MATCH_STATUSES)
SAME_TEAM = R.same("home_team_id", "away_team_id")
NO_TEAM = R.any_null("home_team_id", "away_team_id")
POINTS = "points <> won * 3 + draw"
WIN_RATE = R.ratio_outside("won", "playedGames")

HOME = Ref("home_team", ("home_team_id",), "teams", ("id",))
AWAY = Ref("away_team", ("away_team_id",), "teams", ("id",))
COMPETITION = Ref("competition", ("competition_id",), "competitions", ("id",), null_is_orphan=True)


def _missing(name: str, table: str, *columns: str) -> Check:
    return C.rows_where(name, table, R.any_null(*columns), C.MISSING_VALUES)


def _range(name: str) -> Check:
    return C.rows_where(name, "matches", MATCHDAY, C.OUT_OF_RANGE)


def _present_ids_unique(name: str, table: str) -> Check:
    return C.duplicate_groups(name, table, "id", count_null_keys=False)


def _standings_unique(name: str) -> Check:
    return C.duplicate_groups(name, "standings", "competition_id", "season_id", "team_id")


def _key_present(name: str) -> Check:
    # Typed tables have no JSON body left to look at, so nothing can violate this one.
    return C.rows_where(name, "matches", "false", C.SCHEMA_MISMATCH)


_ID_AND_NAME = tuple(_missing(f"{t}_completeness", t, "id", "name") for t in ("areas", "competitions", "teams"))
_MATCHES_COMPLETE = _missing("matches_completeness", "matches", "id", "utcDate", "home_team_id", "away_team_id")
_STATUS_CHECK = C.rows_where("match_status_invalid", "matches", STATUS, C.CORRUPTION)
_POINTS_CHECK = C.rows_where("standings_points_consistency", "standings", POINTS, C.CORRUPTION)
_RATE_CHECK = C.rows_where("mart_kpi_rate_out_of_bounds", "standings", WIN_RATE, C.OUT_OF_RANGE)
_DATES_CHECK = _missing("mart_kpi_missing_dates", "matches", "utcDate")

SQL = Suite(
    "sql",
    {
        "E": (
            _key_present("stg_schema_matches_key_missing"),
            _missing("stg_missing_match_id", "matches", "id"),
            _range("stg_matchday_out_of_range"),
            _present_ids_unique("stg_duplicate_match_id", "matches"),
            *_ID_AND_NAME,
            _MATCHES_COMPLETE,
            *(_present_ids_unique(f"{t}_uniqueness", t) for t in ("areas", "competitions", "teams")),
        ),
        "T": (
            C.duplicate_groups("dds_duplicate_fact_match", "matches", "id"),
            _missing("dds_missing_home_away_team", "matches", "home_team_id", "away_team_id"),
            C.orphans("dds_referential_integrity_violation", "matches", COMPETITION, HOME, AWAY),
            _range("dds_matchday_out_of_range"),
            C.rows_where("match_home_away_diff", "matches", SAME_TEAM),
            _POINTS_CHECK,
            _STATUS_CHECK,
        ),
        "L": (_RATE_CHECK, _DATES_CHECK, _standings_unique("mart_duplicate_team_rows")),
    },
)

SODA = Suite(
    "soda",
    {
        "E": (
            _missing("stg_missing_match_id", "matches", "id"),
            _range("stg_matchday_out_of_range"),
            _present_ids_unique("stg_duplicate_match_id", "matches"),
            *_ID_AND_NAME,
            _MATCHES_COMPLETE,
        ),
        "T": (
            C.duplicate_groups("dds_duplicate_fact_match", "matches", "id"),
            _missing("dds_missing_home_away_team", "matches", "home_team_id", "away_team_id"),
            C.orphans("dds_referential_integrity_violation", "matches", COMPETITION, HOME, AWAY),
            C.rows_where("match_home_away_diff", "matches", SAME_TEAM),
            _STATUS_CHECK,
        ),
        "L": SQL.checks("L"),
    },
)

_GX_E = (
    *_ID_AND_NAME,
    _MATCHES_COMPLETE,
    _missing("standings_completeness", "standings", "season_id", "competition_id", "team_id"),
    *(_present_ids_unique(f"{t}_uniqueness", t) for t in ("areas", "competitions", "teams", "matches")),
    *(_missing(f"matches_schema_{c}", "matches", c).grouped(C.SCHEMA_MISMATCH) for c in ("id", "utcDate", "status")),
    C.rows_where("matches_home_away_diff", "matches", SAME_TEAM),
    _range("matchday_out_of_range"),
    _STATUS_CHECK,
)

GX = Suite(
    "gx",
    {
        "E": _GX_E,
        # Stage T repeats stage E before its own checks.
        "T": (
            *_GX_E,
            C.orphans("fact_match_home_team_fk", "matches", HOME),
            C.orphans("fact_match_away_team_fk", "matches", AWAY),
            C.orphans("fact_match_competition_fk", "matches", COMPETITION),
            _POINTS_CHECK,
        ),
        # In this suite the "rate" check looks at the matchday.
        "L": (_range("mart_kpi_rate_out_of_bounds"), _DATES_CHECK, _standings_unique("mart_duplicate_standings")),
    },
)

DEEQU = Suite(
    "deequ",
    {
        "E": (
            *(_missing(f"{c}_is_complete", "matches", c) for c in ("id", "utcDate", "status")),
            _missing("home_team_complete", "matches", "home_team_id"),
            _missing("away_team_complete", "matches", "away_team_id"),
            _range("matchday_range"),
            C.rows_where("status_valid", "matches", STATUS),
            _present_ids_unique("unique_match_id", "matches"),
            _present_ids_unique("unique_competition_id", "competitions"),
            _present_ids_unique("unique_team_id", "teams"),
            _present_ids_unique("unique_area_id", "areas"),
            *(C.not_empty(f"{t}_not_empty", t) for t in ("competitions", "teams", "areas")),
            *(_missing(f"{t}_id_complete", t, "id", "name") for t in ("areas", "competitions", "teams")),
        ),
        "T": (
            C.duplicate_groups("unique_match_id", "matches", "id"),
            _missing("missing_home_away", "matches", "home_team_id", "away_team_id"),
            C.rows_where("home_away_diff", "matches", SAME_TEAM),
            C.orphans("referential_home", "matches", HOME),
            C.orphans("referential_away", "matches", AWAY),
            C.orphans("referential_competition", "matches", COMPETITION),
            _range("matchday_out_of_range"),
            C.rows_where("status_valid", "matches", STATUS),
            _POINTS_CHECK,
            C.rows_where("played_games_positive", "standings", "playedGames = 0"),
        ),
        "L": (
            _missing("matches_dates_not_null", "matches", "utcDate"),
            _standings_unique("unique_standings"),
            C.rows_where("standings_positive_points", "standings", R.negative("points")),
            C.rows_where("rate_out_of_bounds", "standings", WIN_RATE, C.OUT_OF_RANGE),
            C.not_empty("standings_not_empty", "standings"),
        ),
    },
)

# --- versioned star schema ------------------------------------------------------------------------------------------

# Marker written into a competition name by the corruption mutation, and keys of the result mart.
CORRUPTED_NAME = "MUTATED_COMP"
TEAM_MART_KEY = ("run_id", "competition_id", "season_id", "team_id")


def _star_ref(label: str, column: str, parent: str, parent_column: str, null_is_orphan: bool = False) -> Ref:
    return Ref(label, ("run_id", column), parent, ("run_id", parent_column), null_is_orphan)


# An absent competition or season counts as an orphan, an absent team does not.
MATCH_REFS = (
    _star_ref("competition", "competition_id", "dim_competition", "competition_id", True),
    _star_ref("season", "season_id", "dim_season", "season_id", True),
    _star_ref("home_team", "home_team_id", "dim_team", "team_id"),
    _star_ref("away_team", "away_team_id", "dim_team", "team_id"),
)
_MATCH_SHOW = ("run_id", "match_id")
_ZERO_GAMES = "played_games = 0 AND won = 0 AND draw = 0 AND lost = 0"
_RATES = " OR ".join(f"{c} < 0 OR {c} > 1" for c in ("home_win_rate", "draw_rate", "away_win_rate"))
_MART_DATES = R.any_null("start_date", "end_date", "season_year")


def _star_rows(name: str, table: str, rule: str, group: str, *show: str) -> Check:
    return C.rows_where(name, table, rule, group, show)


_SEASON_DATES = _star_rows(
    "dds_dim_season_dates_missing",
    "dim_season",
    R.any_null("start_date", "end_date"),
    C.MISSING_VALUES,
    "run_id",
    "season_id",
    "start_date",
    "end_date",
)
_UTC_DATE = _star_rows(
    "dds_fact_match_utc_date_missing", "fact_match", R.any_null("utc_date"), C.MISSING_VALUES, *_MATCH_SHOW, "utc_date"
)
_ZERO = _star_rows(
    "dds_fact_standing_zero_played_games",
    "fact_standing",
    _ZERO_GAMES,
    C.CORRUPTION,
    "run_id",
    "season_id",
    "competition_id",
    "team_id",
    "standing_type",
)
_NAME = _star_rows(
    "dds_dim_competition_name_corrupted",
    "dim_competition",
    R.equals("name", CORRUPTED_NAME),
    C.CORRUPTION,
    "run_id",
    "competition_id",
    "name",
)
_DDS_MATCHDAY = _star_rows(
    "dds_matchday_out_of_range", "fact_match", MATCHDAY, C.OUT_OF_RANGE, *_MATCH_SHOW, "matchday"
)
_DDS_MISSING_TEAM = _star_rows(
    "dds_missing_home_away_team", "fact_match", NO_TEAM, C.MISSING_VALUES, *_MATCH_SHOW, "home_team_id", "away_team_id"
)
_KPI_RATE = _star_rows("mart_kpi_rate_out_of_bounds", "mart_kpi", _RATES, C.OUT_OF_RANGE)
_KPI_DATES = _star_rows("mart_kpi_missing_dates", "mart_kpi", _MART_DATES, C.MISSING_VALUES)
_TEAM_DUPES = C.duplicate_groups("mart_duplicate_team_rows", "mart_team", *TEAM_MART_KEY)
_DDS_RI = C.orphans("dds_referential_integrity_violation", "fact_match", *MATCH_REFS, show=_MATCH_SHOW)
_DDS_DUPES = C.duplicate_groups("dds_duplicate_fact_match", "fact_match", "run_id", "match_id")

STAGE = Suite(
    "stage",
    {
        # stg_payloads holds the good match envelopes, stg_matches their elements (values still text).
        "E": (
            _star_rows("stg_schema_matches_key_missing", "stg_payloads", "NOT has_key", C.SCHEMA_MISMATCH, "id", "endpoint"),
            _star_rows("stg_missing_match_id", "stg_matches", "match_id IS NULL", C.MISSING_VALUES, "id", "endpoint", "match_id"),
            _star_rows(
                "stg_matchday_out_of_range",
                "stg_matches",
                R.digits_outside("matchday", *MATCHDAY_RANGE),
                C.OUT_OF_RANGE,
                "id",
                "endpoint",
                "match_id",
                "matchday",
            ),
            C.duplicate_groups("stg_duplicate_match_id", "stg_matches", "match_id", count_null_keys=False),
        ),
        "T": (
            _DDS_DUPES,
            _DDS_MISSING_TEAM,
            _DDS_RI,
            _DDS_MATCHDAY,
            _UTC_DATE,
            _NAME,
            _ZERO,
            _SEASON_DATES,
            C.duplicate_groups("dds_dim_team_duplicate", "dim_team", "run_id", "team_id"),
            C.duplicate_groups("dds_dim_competition_duplicate", "dim_competition", "run_id", "competition_id"),
        ),
        "L": (_SEASON_DATES, _UTC_DATE, _ZERO, _NAME, _KPI_RATE, _KPI_DATES, _TEAM_DUPES),
    },
)

CONSTRAINTS = Suite(
    "constraints",
    {
        "T": (
            _star_rows(
                "dds_fact_match_home_away_valid",
                "fact_match",
                NO_TEAM + " OR " + SAME_TEAM,
                C.CONSTRAINT,
                *_MATCH_SHOW,
                "home_team_id",
                "away_team_id",
            ),
            *(
                _star_rows(name, base.table, base.rule, C.CONSTRAINT, *base.show)
                for name, base in (
                    ("dds_fact_match_matchday_range", _DDS_MATCHDAY),
                    ("dds_fact_match_utc_date_missing", _UTC_DATE),
                    ("dds_dim_season_dates_missing", _SEASON_DATES),
                    ("dds_fact_standing_zero_played_games", _ZERO),
                    ("dds_dim_competition_name_corrupted", _NAME),
                )
            ),
        ),
    },
)

SCHEMA_CONSTRAINTS = Suite("schema_constraints", {"T": (*table_constraints(), *key_checks())})

_POINTS_NULL_SAFE = "points IS NOT NULL AND won IS NOT NULL AND draw IS NOT NULL AND points <> won * 3 + draw"

# Ten post-load metrics: four on the star schema, six on the marts.
POST = Suite(
    "post",
    {
        "POST": (
            _star_rows("dds_match_same_team", "fact_match", SAME_TEAM, C.CORRUPTION),
            _star_rows("dds_standings_points_inconsistent", "fact_standing", _POINTS_NULL_SAFE, C.CORRUPTION),
            _star_rows("dds_match_null_competition_id", "fact_match", R.any_null("competition_id"), C.MISSING_VALUES),
            _star_rows("dds_match_null_season_id", "fact_match", R.any_null("season_id"), C.MISSING_VALUES),
            _KPI_RATE,
            _KPI_DATES,
            _star_rows("mart_team_missing_dates", "mart_team", _MART_DATES, C.MISSING_VALUES),
            _star_rows("mart_team_points_inconsistent", "mart_team", "points_calc <> wins * 3 + draws", C.CORRUPTION),
            _star_rows(
                "mart_team_matches_inconsistent", "mart_team", "matches_played <> wins + draws + losses", C.CORRUPTION
            ),
            _star_rows(
                "mart_team_negative_values", "mart_team", R.negative("points_calc", "goals_for", "goals_against"), C.CORRUPTION
            ),
        ),
    },
)

# Tagged fail-rows tests; the untagged ones are the post-load metrics.
DBT = Suite(
    "dbt",
    {
        "T": tuple(
            c.tagged("stage_T")
            for c in (
                C.duplicate_groups("t_dds_duplicates_fact_match", "fact_match", "run_id", "match_id"),
                _star_rows("t_dds_matchday_out_of_range", "fact_match", MATCHDAY, C.OUT_OF_RANGE),
                _star_rows("t_dds_missing_home_away", "fact_match", NO_TEAM, C.MISSING_VALUES),
                C.orphans("t_dds_referential_integrity", "fact_match", *MATCH_REFS, show=_MATCH_SHOW),
            )
        ),
        "L": tuple(
            c.tagged("stage_L")
            for c in (
                _star_rows("l_mart_kpi_missing_dates", "mart_kpi", _MART_DATES, C.MISSING_VALUES),
                _star_rows("l_mart_kpi_rate_out_of_bounds", "mart_kpi", _RATES, C.OUT_OF_RANGE),
                C.duplicate_groups("l_mart_team_duplicates", "mart_team", *TEAM_MART_KEY),
            )
        ),
        "POST": tuple(c.tagged("post") for c in POST.checks("POST")),
    },
)

ENTITY_SUITES = {s.name: s for s in (GX, SODA, SQL, DEEQU)}
STAR_SUITES = {s.name: s for s in (STAGE, CONSTRAINTS, SCHEMA_CONSTRAINTS, POST, DBT)}

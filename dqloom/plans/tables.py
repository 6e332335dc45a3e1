"""Table layouts: the five entity tables and the versioned star schema."""

from __future__ import annotations

from dataclasses import dataclass

from dqloom.functions import rules as R
from dqloom.operators import checks as C
from dqloom.operators.checks import Check, Ref

# Column layout of the five entity tables (the un-versioned flavour).
ENTITY_SCHEMAS = {
    "areas": "id BIGINT, name STRING, countryCode STRING, flag STRING",
    "competitions": "id BIGINT, area_id BIGINT, name STRING, code STRING, type STRING, plan STRING",
    "teams": (
        "id BIGINT, area_id BIGINT, name STRING, shortName STRING, tla STRING, crest STRING, venue STRING, address STRING"
    ),
    "matches": (
        "id BIGINT, competition_id BIGINT, season_id BIGINT, utcDate TIMESTAMP, status STRING, stage STRING, "
        "matchday INT, home_team_id BIGINT, away_team_id BIGINT"
    ),
    "standings": (
        "season_id BIGINT, competition_id BIGINT, team_id BIGINT, type STRING, stage STRING, position INT, playedGames INT, "
        "won INT, draw INT, lost INT, goalsFor INT, goalsAgainst INT, goalDifference INT, points INT"
    ),
}

# Match statuses that are allowed, and the highest matchday.
MATCH_STATUSES = ("SCHEDULED", "TIMED", "IN_PLAY", "PAUSED", "FINISHED", "POSTPONED", "SUSPENDED", "CANCELED")
MATCHDAY_RANGE = (0, 60)


@dataclass(frozen=True)
class StarTable:
    """A table of the star schema; every key is implicitly scoped by ``run_id``."""

    name: str
    schema: str
    key: tuple[str, ...]
    refs: tuple[Ref, ...] = ()


def _ref(label: str, column: str, parent: str, parent_column: str) -> Ref:
    return Ref(label, ("run_id", column), parent, ("run_id", parent_column))


# The star schema with its primary and foreign keys, in load order.
STAR = {
    t.name: t
    for t in (
        StarTable(
            "dim_area",
            "run_id STRING, area_id BIGINT, name STRING, country_code STRING, flag_url STRING, parent_area_id BIGINT",
            ("area_id",),
            (_ref("parent_area", "parent_area_id", "dim_area", "area_id"),),
        ),
        StarTable(
            "dim_competition",
            "run_id STRING, competition_id BIGINT, area_id BIGINT, code STRING, name STRING, type STRING, plan STRING",
            ("competition_id",),
            (_ref("area", "area_id", "dim_area", "area_id"),),
        ),
        StarTable(
            "dim_season",
            "run_id STRING, season_id BIGINT, competition_id BIGINT, start_date DATE, end_date DATE, winner_team_id BIGINT",
            ("season_id",),
            (_ref("competition", "competition_id", "dim_competition", "competition_id"),),
        ),
        StarTable(
            "dim_team",
            "run_id STRING, team_id BIGINT, area_id BIGINT, name STRING, short_name STRING, tla STRING, crest_url STRING, "
            "venue STRING, address STRING, founded INT, website STRING, club_colors STRING",
            ("team_id",),
            (_ref("area", "area_id", "dim_area", "area_id"),),
        ),
        StarTable(
            "fact_match",
            "run_id STRING, match_id BIGINT, competition_id BIGINT, season_id BIGINT, utc_date TIMESTAMP_NTZ, status STRING, "
            "stage STRING, matchday INT, home_team_id BIGINT, away_team_id BIGINT",
            ("match_id",),
            (
                _ref("home_team", "home_team_id", "dim_team", "team_id"),
                _ref("away_team", "away_team_id", "dim_team", "team_id"),
                _ref("competition", "competition_id", "dim_competition", "competition_id"),
                _ref("season", "season_id", "dim_season", "season_id"),
            ),
        ),
        StarTable(
            "fact_match_score",
            "run_id STRING, match_id BIGINT, winner STRING, duration STRING, half_time_home INT, half_time_away INT, "
            "full_time_home INT, full_time_away INT",
            ("match_id",),
            (_ref("match", "match_id", "fact_match", "match_id"),),
        ),
        StarTable(
            "fact_standing",
            "run_id STRING, season_id BIGINT, competition_id BIGINT, team_id BIGINT, standing_type STRING, stage STRING, "
            "position INT, played_games INT, won INT, draw INT, lost INT, goals_for INT, goals_against INT, "
            "goal_difference INT, points INT, form STRING",
            ("season_id", "competition_id", "team_id", "standing_type"),
            (
                _ref("competition", "competition_id", "dim_competition", "competition_id"),
                _ref("season", "season_id", "dim_season", "season_id"),
                _ref("team", "team_id", "dim_team", "team_id"),
            ),
        ),
    )
}


def key_checks() -> tuple[Check, ...]:
    """Primary and foreign keys of the star schema as checks."""
    out = []
    for t in STAR.values():
        out.append(C.duplicate_groups(f"pk_{t.name}", t.name, "run_id", *t.key).grouped(C.CONSTRAINT))
        out.append(C.rows_where(f"pk_not_null_{t.name}", t.name, R.any_null("run_id", *t.key), C.CONSTRAINT))
        out += [C.orphans(f"fk_{t.name}_{r.label}", t.name, r).grouped(C.CONSTRAINT) for r in t.refs]
    return tuple(out)


def table_constraints() -> tuple[Check, ...]:
    """Row constraints of the star schema; a violating row breaks the stated condition."""
    low, high = MATCHDAY_RANGE
    return (
        C.rows_where(
            "ck_fact_match_home_away_valid",
            "fact_match",
            R.any_null("home_team_id", "away_team_id") + " OR " + R.same("home_team_id", "away_team_id"),
            C.CONSTRAINT,
        ),
        C.rows_where("ck_fact_match_matchday_range", "fact_match", R.outside("matchday", low, high), C.CONSTRAINT),
        C.rows_where("ck_fact_match_utc_date_not_null", "fact_match", R.any_null("utc_date"), C.CONSTRAINT),
        C.rows_where("ck_dim_season_dates_not_null", "dim_season", R.any_null("start_date", "end_date"), C.CONSTRAINT),
    )

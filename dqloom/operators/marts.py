"""The two KPI marts.

Facts are aggregated first and joined to the dimensions afterwards, so only one
row per competition, season (and team) takes part in those joins.  Roles (home
and away) come from an in-row unpivot: one scan of the facts instead of a union
of two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEASON_KEY = ["run_id", "competition_id", "season_id"]

# Mart columns, the metric a mart snapshot is ranked by, and the key a mart diff uses.
MART_RANKING = {"mart_kpi": "matches_total", "mart_team": "points_calc"}
MART_KEYS = {
    "mart_kpi": ("competition_id", "season_id"),
    "mart_team": ("competition_id", "season_id", "team_id"),
}
SNAPSHOT_LIMIT = 200


def with_scores(matches: DataFrame, scores: DataFrame, how: str = "left") -> DataFrame:
    """Both sides are keyed by (run_id, match_id); after ``first_per_key`` they share that partitioning."""
    kept = scores.select("run_id", "match_id", "winner", "full_time_home", "full_time_away")
    return matches.join(kept, ["run_id", "match_id"], how)


# Final score first, declared winner second.
OUTCOME = """
    CASE WHEN full_time_home > full_time_away THEN 'HOME'
         WHEN full_time_home < full_time_away THEN 'AWAY'
         WHEN full_time_home = full_time_away THEN 'DRAW'
         WHEN winner = 'HOME_TEAM' THEN 'HOME'
         WHEN winner = 'AWAY_TEAM' THEN 'AWAY'
         WHEN winner = 'DRAW' THEN 'DRAW'
         ELSE 'UNKNOWN' END"""

# Declared dates with the observed ones as fallback.
PERIOD = (
    "coalesce(_start, _first) AS start_date",
    "coalesce(_end, _last) AS end_date",
    "coalesce(year(_start), year(_end), year(_first), year(_last)) AS season_year",
)


def _share(part: str) -> str:
    """Part of the decided matches, four decimals; NULL when nothing was decided."""
    whole = "cast(_home + _draw + _away AS DECIMAL(18,0))"
    return f"cast(round(try_divide(cast({part} AS DECIMAL(18,0)), {whole}), 4) AS DOUBLE)"


def _with_dimensions(facts: DataFrame, competitions: DataFrame, seasons: DataFrame) -> DataFrame:
    return facts.join(
        competitions.selectExpr("run_id", "competition_id", "name AS competition_name"), ["run_id", "competition_id"]
    ).join(seasons.selectExpr("run_id", "season_id", "start_date AS _start", "end_date AS _end"), ["run_id", "season_id"])


def competition_season_kpi(matches: DataFrame, scores: DataFrame, competitions: DataFrame, seasons: DataFrame) -> DataFrame:
    # One entry per role; the match itself is counted on the home entry.
    scored = with_scores(matches, scores).selectExpr(
        *SEASON_KEY,
        "to_date(utc_date) AS day",
        "status",
        f"{OUTCOME} AS outcome",
        "inline(array(named_struct('is_match', true, 'team_id', home_team_id), "
        "named_struct('is_match', false, 'team_id', away_team_id)))",
    )
    per_season = scored.groupBy(*SEASON_KEY).agg(
        F.expr("count_if(is_match) AS matches_total"),
        F.expr("count_if(is_match AND status = 'FINISHED') AS matches_finished"),
        F.expr("count(DISTINCT team_id) AS teams_distinct"),
        *[F.expr(f"count_if(is_match AND outcome = '{o}') AS _{o.lower()}") for o in ("HOME", "DRAW", "AWAY")],
        F.expr("min(day) AS _first"),
        F.expr("max(day) AS _last"),
    )
    return finished_kpi(per_season, competitions, seasons)


def finished_kpi(per_season: DataFrame, competitions: DataFrame, seasons: DataFrame) -> DataFrame:
    """The season mart from its counts."""
    return _with_dimensions(per_season, competitions, seasons).selectExpr(
        "run_id",
        "competition_id",
        "competition_name",
        "season_id",
        *PERIOD,
        "matches_total",
        "matches_finished",
        "teams_distinct",
        f"{_share('_home')} AS home_win_rate",
        f"{_share('_draw')} AS draw_rate",
        f"{_share('_away')} AS away_win_rate",
    )


def team_season_results(
    matches: DataFrame, scores: DataFrame, competitions: DataFrame, seasons: DataFrame, teams: DataFrame
) -> DataFrame:
    played = matches.filter("status = 'FINISHED'")
    decided = scores.filter("full_time_home IS NOT NULL AND full_time_away IS NOT NULL")
    finished = with_scores(played, decided, "inner")
    roles = finished.selectExpr(
        *SEASON_KEY,
        "inline(array(named_struct('team_id', home_team_id, 'gf', full_time_home, 'ga', full_time_away), "
        "named_struct('team_id', away_team_id, 'gf', full_time_away, 'ga', full_time_home)))",
    )
    per_team = roles.groupBy(*SEASON_KEY, "team_id").agg(
        F.expr("count(1) AS matches_played"),
        F.expr("count_if(gf > ga) AS wins"),
        F.expr("count_if(gf = ga) AS draws"),
        F.expr("count_if(gf < ga) AS losses"),
        F.expr("sum(gf) AS goals_for"),
        F.expr("sum(ga) AS goals_against"),
    )
    # Observed dates only stand in for missing declared ones, so they are looked up for those seasons alone.
    undated = seasons.filter("start_date IS NULL OR end_date IS NULL").select("run_id", "season_id")
    gaps = with_scores(played.join(undated, ["run_id", "season_id"], "left_semi"), decided, "inner")
    observed = gaps.groupBy(*SEASON_KEY).agg(
        F.expr("min(to_date(utc_date)) AS _first"), F.expr("max(to_date(utc_date)) AS _last")
    )
    return finished_results(per_team.join(observed, SEASON_KEY, "left"), competitions, seasons, teams)


def finished_results(dated: DataFrame, competitions: DataFrame, seasons: DataFrame, teams: DataFrame) -> DataFrame:
    """The team mart from its counts with the observed days of each season."""
    return (
        _with_dimensions(dated, competitions, seasons)
        .join(teams.selectExpr("run_id", "team_id", "name AS team_name"), ["run_id", "team_id"])
        .selectExpr(
            "run_id",
            "competition_id",
            "competition_name",
            "season_id",
            *PERIOD,
            "team_id",
            "team_name",
            "matches_played",
            "wins",
            "draws",
            "losses",
            "goals_for",
            "goals_against",
            "goals_for - goals_against AS goal_difference",
            "wins * 3 + draws AS points_calc",
        )
    )


def add_marts(star: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The star schema plus both marts, keyed by the names the suites use."""
    m, s, c, y = (star[n] for n in ("fact_match", "fact_match_score", "dim_competition", "dim_season"))
    return {
        **star,
        "mart_kpi": competition_season_kpi(m, s, c, y),
        "mart_team": team_season_results(m, s, c, y, star["dim_team"]),
    }


def snapshot(mart: DataFrame, name: str, limit: int = SNAPSHOT_LIMIT) -> DataFrame:
    """The top rows of a mart; the key breaks ties so that two snapshots are comparable."""
    return mart.orderBy(F.desc_nulls_last(MART_RANKING[name]), *MART_KEYS[name]).limit(limit).drop("run_id")


def uneven_home_away(matches: DataFrame, seasons: DataFrame, before: str = "2025-01-01") -> DataFrame:
    """Home and away match counts per team of every season that started before a day."""
    started = seasons.filter(F.col("start_date") < F.lit(before).cast("date")).select("run_id", "season_id")
    roles = matches.selectExpr(
        *SEASON_KEY,
        "inline(array(named_struct('team_id', home_team_id, 'home', 1, 'away', 0), "
        "named_struct('team_id', away_team_id, 'home', 0, 'away', 1)))",
    )
    per_team = roles.groupBy(*SEASON_KEY, "team_id").agg(
        F.expr("sum(home) AS home_matches"), F.expr("sum(away) AS away_matches")
    )
    return per_team.join(started, ["run_id", "season_id"], "left_semi").select(
        *SEASON_KEY, "team_id", "home_matches", "away_matches"
    )

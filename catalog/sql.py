"""The test tables and expected verdicts in plain SQL."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

STATUSES = "('SCHEDULED','TIMED','IN_PLAY','PAUSED','FINISHED','POSTPONED','SUSPENDED','CANCELED')"


def match_cte(name: str, defective: bool) -> str:
    def planted(p: int, bad: str, good: str) -> str:
        return f"CASE WHEN l_orderkey % {p} = 0 THEN {bad} ELSE {good} END" if defective else good

    status = (
        "CASE WHEN l_linestatus = 'F' THEN 'FINISHED' WHEN l_returnflag = 'N' THEN 'SCHEDULED' "
        "WHEN l_returnflag = 'A' THEN 'TIMED' ELSE 'POSTPONED' END"
    )
    q = "CAST(l_quantity AS INTEGER)"
    return f"""{name} AS (
  SELECT {planted(107, 'NULL', 'l_orderkey * 10 + l_linenumber')} AS id,
    {planted(89, 'l_partkey % 25 + 100', 'l_partkey % 25')} AS competition_id,
    CAST(year(l_shipdate) AS BIGINT) AS season_id,
    {planted(79, 'NULL', 'l_shipdate')} AS utcDate,
    {planted(83, "'MUTATED'", status)} AS status,
    'REGULAR_SEASON' AS stage,
    {planted(97, '999', q)} AS matchday,
    {planted(101, 'NULL', 'l_suppkey')} AS home_team_id,
    {planted(103, 'l_partkey // 20 + 1000000000000', 'l_partkey // 20')} AS away_team_id,
    CASE {q} % 4 WHEN 0 THEN 'HOME_TEAM' WHEN 1 THEN 'AWAY_TEAM' WHEN 2 THEN 'DRAW' END AS winner,
    CASE WHEN l_linenumber < 7 THEN l_linenumber % 6 END AS home_goals,
    CASE WHEN l_linenumber < 7 THEN {q} % 6 END AS away_goals
  FROM lineitem)"""


X_CLEAN = match_cte("x_clean", False)
X_MATCH = match_cte("x_match", True)


def standing_cte(name: str, defective: bool) -> str:
    extra = " + CASE WHEN team_id % 10 = 0 THEN 1 ELSE 0 END" if defective else ""
    return f"""{name} AS (
  SELECT season_id, competition_id, team_id, 'TOTAL' AS type, 'REGULAR_SEASON' AS stage,
    CAST(team_id % 20 + 1 AS INTEGER) AS position, CAST(n AS INTEGER) AS playedGames, CAST(w AS INTEGER) AS won,
    CAST(d AS INTEGER) AS draw, CAST(l AS INTEGER) AS lost, CAST(gf AS INTEGER) AS goalsFor,
    CAST(ga AS INTEGER) AS goalsAgainst, CAST(gf - ga AS INTEGER) AS goalDifference,
    CAST(w * 3 + d{extra} AS INTEGER) AS points
  FROM (SELECT season_id, competition_id, home_team_id AS team_id, count(*) AS n,
      count(*) FILTER (hg > ag) AS w, count(*) FILTER (hg = ag) AS d, count(*) FILTER (hg < ag) AS l,
      sum(hg) AS gf, sum(ag) AS ga
    FROM (SELECT *, coalesce(home_goals, 0) AS hg, coalesce(away_goals, 0) AS ag FROM x_clean) GROUP BY ALL))"""


X_STANDING = f"{X_CLEAN}, {standing_cte('x_standing', True)}"
ENTITIES = f"""{X_MATCH}, {X_STANDING},
x_area AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, upper(substr(r_name, 1, 2)) AS countryCode FROM region),
x_competition AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS area_id, n_name AS name,
  'N' || n_nationkey AS code, 'LEAGUE' AS type, 'TIER_ONE' AS plan FROM nation),
x_team AS (SELECT s_suppkey AS id, CAST(n_regionkey AS BIGINT) AS area_id, s_name AS name
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""

_ORDER = ", ".join(
    f"{c} NULLS FIRST" for c in ("utcDate", "competition_id", "season_id", "status", "stage", "matchday", "home_team_id", "away_team_id")
)
_SCORE_ORDER = ", ".join(f"{c} NULLS FIRST" for c in ("winner", "home_goals", "away_goals"))


def star_ctes(source: str = "x_match", standing: str = "x_standing", suffix: str = "", run: str = "base_run") -> str:
    """fact_match, fact_match_score, fact_standing and the dimensions of one run."""
    return f"""fact_match{suffix} AS (
  SELECT '{run}' AS run_id, id AS match_id, competition_id, season_id, utcDate AS utc_date, status, stage, matchday,
    home_team_id, away_team_id
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_ORDER}) AS rn FROM {source} WHERE id IS NOT NULL) WHERE rn = 1),
fact_match_score{suffix} AS (
  SELECT '{run}' AS run_id, id AS match_id, winner, home_goals AS full_time_home, away_goals AS full_time_away
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_SCORE_ORDER}) AS rn FROM {source} WHERE id IS NOT NULL) WHERE rn = 1),
fact_standing{suffix} AS (
  SELECT '{run}' AS run_id, season_id, competition_id, team_id, type AS standing_type, stage, position,
    playedGames AS played_games, won, draw, lost, goalsFor AS goals_for, goalsAgainst AS goals_against,
    goalDifference AS goal_difference, points FROM {standing}),
dim_area{suffix} AS (SELECT '{run}' AS run_id, id AS area_id, name, CAST(NULL AS BIGINT) AS parent_area_id FROM x_area),
dim_competition{suffix} AS (SELECT '{run}' AS run_id, id AS competition_id, area_id, code, name, type, plan FROM x_competition),
dim_team{suffix} AS (SELECT '{run}' AS run_id, id AS team_id, area_id, name FROM x_team),
dim_season{suffix} AS (
  SELECT '{run}' AS run_id, CAST(y AS BIGINT) AS season_id, CAST(y % 25 AS BIGINT) AS competition_id,
    CASE WHEN y <> 1997 THEN make_date(y, 1, 1) END AS start_date, CASE WHEN y <> 1997 THEN make_date(y, 12, 31) END AS end_date
  FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders))"""


def _rate(part: str) -> str:
    return f"CAST(round(CAST(CAST({part} AS DOUBLE) / nullif(h + d + a, 0) AS DECIMAL(20,12)), 4) AS DOUBLE)"


_PERIOD = """coalesce(s.start_date, f) AS start_date, coalesce(s.end_date, t) AS end_date,
    CAST(coalesce(year(s.start_date), year(s.end_date), year(f), year(t)) AS INTEGER) AS season_year"""


def mart_ctes(suffix: str = "") -> str:
    """Both marts over the star tables of the same suffix."""
    m, sc, c, s, tm = (f"{n}{suffix}" for n in ("fact_match", "fact_match_score", "dim_competition", "dim_season", "dim_team"))
    return f"""scored{suffix} AS (SELECT m.*, sc.winner, sc.full_time_home AS hg, sc.full_time_away AS ag
  FROM {m} m LEFT JOIN {sc} sc ON sc.run_id = m.run_id AND sc.match_id = m.match_id),
outcomes{suffix} AS (SELECT *, CASE WHEN hg > ag THEN 'HOME' WHEN hg < ag THEN 'AWAY' WHEN hg = ag THEN 'DRAW'
  WHEN winner = 'HOME_TEAM' THEN 'HOME' WHEN winner = 'AWAY_TEAM' THEN 'AWAY' WHEN winner = 'DRAW' THEN 'DRAW' ELSE 'UNKNOWN' END
  AS outcome FROM scored{suffix}),
per_season{suffix} AS (SELECT run_id, competition_id, season_id, count(*) AS total, count(*) FILTER (status = 'FINISHED') AS fin,
  count(*) FILTER (outcome = 'HOME') AS h, count(*) FILTER (outcome = 'DRAW') AS d, count(*) FILTER (outcome = 'AWAY') AS a,
  CAST(min(utc_date) AS DATE) AS f, CAST(max(utc_date) AS DATE) AS t FROM outcomes{suffix} GROUP BY ALL),
season_teams{suffix} AS (SELECT run_id, competition_id, season_id, count(DISTINCT team) AS teams FROM (
  SELECT run_id, competition_id, season_id, home_team_id AS team FROM {m} UNION
  SELECT run_id, competition_id, season_id, away_team_id FROM {m}) GROUP BY ALL),
mart_kpi{suffix} AS (SELECT o.run_id, o.competition_id, c.name AS competition_name, o.season_id, {_PERIOD},
    total AS matches_total, fin AS matches_finished, coalesce(teams, 0) AS teams_distinct,
    {_rate('h')} AS home_win_rate, {_rate('d')} AS draw_rate, {_rate('a')} AS away_win_rate
  FROM per_season{suffix} o JOIN {c} c ON c.run_id = o.run_id AND c.competition_id = o.competition_id
  JOIN {s} s ON s.run_id = o.run_id AND s.season_id = o.season_id
  LEFT JOIN season_teams{suffix} x ON x.run_id = o.run_id AND x.competition_id = o.competition_id AND x.season_id = o.season_id),
finished{suffix} AS (SELECT * FROM scored{suffix} WHERE status = 'FINISHED' AND hg IS NOT NULL AND ag IS NOT NULL),
season_dates{suffix} AS (SELECT run_id, competition_id, season_id, CAST(min(utc_date) AS DATE) AS f, CAST(max(utc_date) AS DATE) AS t
  FROM finished{suffix} GROUP BY ALL),
team_rows{suffix} AS (SELECT run_id, competition_id, season_id, home_team_id AS team_id, hg AS gf, ag AS ga FROM finished{suffix}
  UNION ALL SELECT run_id, competition_id, season_id, away_team_id, ag, hg FROM finished{suffix}),
per_team{suffix} AS (SELECT run_id, competition_id, season_id, team_id, count(*) AS n, count(*) FILTER (gf > ga) AS w,
  count(*) FILTER (gf = ga) AS d, count(*) FILTER (gf < ga) AS l, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga
  FROM team_rows{suffix} GROUP BY ALL),
mart_team{suffix} AS (SELECT o.run_id, o.competition_id, c.name AS competition_name, o.season_id, {_PERIOD},
    o.team_id, tm.name AS team_name, n AS matches_played, w AS wins, d AS draws, l AS losses, gf AS goals_for, ga AS goals_against,
    gf - ga AS goal_difference, w * 3 + d AS points_calc
  FROM per_team{suffix} o JOIN {c} c ON c.run_id = o.run_id AND c.competition_id = o.competition_id
  JOIN {tm} tm ON tm.run_id = o.run_id AND tm.team_id = o.team_id
  JOIN {s} s ON s.run_id = o.run_id AND s.season_id = o.season_id
  LEFT JOIN season_dates{suffix} sd ON sd.run_id = o.run_id AND sd.competition_id = o.competition_id AND sd.season_id = o.season_id)"""


STAR = f"{ENTITIES}, {star_ctes()}"
MARTS = f"{STAR}, {mart_ctes()}"
CLEAN_STAR = f"{ENTITIES}, {standing_cte('x_standing_clean', False)}, {star_ctes('x_clean', 'x_standing_clean', '_clean')}"


def count(table: str, where: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {where}"


def duplicates(table: str, keys: str, where: str = "true") -> str:
    return f"SELECT count(*) FROM (SELECT {keys} FROM {table} WHERE {where} GROUP BY {keys} HAVING count(*) > 1)"


def orphans(child: str, key: str, parent: str, parent_key: str = "id", null_counts: bool = False) -> str:
    missing = f"NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_key} = c.{key})"
    return f"SELECT count(*) FROM {child} c WHERE {missing}" + ("" if null_counts else f" AND c.{key} IS NOT NULL")


def empty(table: str) -> str:
    return f"SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM {table}"


def verdicts(ctes: str, counts: Mapping[str, str], warnings: Iterable[str] = ()) -> str:
    """check_name, status, rows_failed from one counting query per check."""
    warned = set(warnings)
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, '{'WARN' if name in warned else 'FAIL'}' AS bad, CAST(({sql}) AS BIGINT) AS rows_failed"
        for name, sql in counts.items()
    )
    head = f"WITH {ctes} " if ctes else ""
    return f"{head}SELECT check_name, CASE WHEN rows_failed = 0 THEN 'PASS' ELSE bad END AS status, rows_failed FROM ({rows})"

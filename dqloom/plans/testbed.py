"""The football model over general order data.

The suites expect areas, competitions, teams, matches and standings.  Here those
tables are views over region, nation, supplier, orders and lineitem, so every
operator can run over any amount of such data:

* area = region, competition = nation, team = supplier;
* a match = an order line (its supplier plays at home, the supplier responsible
  for its part's block of twenty parts plays away), a season = a ship year;
* standings = results per competition, season and home team.

Matches are one projection of lineitem - no join - so column pruning and
predicate pushdown reach the scan.  Order lines repeat (order, line) numbers, so
the un-versioned matches contain real duplicate ids; the star schema keeps the
first row per id.

``defective=True`` plants defects as CASE expressions on the key, each on its
own residue class, which SQL can state too.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.operators.keys import first_per_key
from dqloom.operators.marts import add_marts

BASELINE_RUN = "base_run"
# Size of the nation table and of a block of parts.
COMPETITIONS = 25
PARTS_PER_TEAM = 20
# Residue classes that carry a planted defect.
DEFECTS = {
    "competition_orphan": 89,
    "date_missing": 79,
    "status_invalid": 83,
    "matchday_high": 97,
    "home_missing": 101,
    "away_orphan": 103,
    "id_missing": 107,
    "points_wrong": 10,
}


class Tables(Mapping):
    """The parquet tables of one folder, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._open = spark, folder.rstrip("/"), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._open[name]

    def __iter__(self):
        return iter(self._open)

    def __len__(self):
        return len(self._open)


class Lazy(Mapping):
    """Named frames built on first use, so that a suite only opens what its checks read."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders, self._built = dict(builders), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self):
        return len(self._builders)


def areas(t: Mapping) -> DataFrame:
    return t["region"].selectExpr(
        "cast(r_regionkey AS BIGINT) AS id",
        "r_name AS name",
        "upper(substring(r_name, 1, 2)) AS countryCode",
        "cast(NULL AS STRING) AS flag",
    )


def competitions(t: Mapping) -> DataFrame:
    return t["nation"].selectExpr(
        "cast(n_nationkey AS BIGINT) AS id",
        "cast(n_regionkey AS BIGINT) AS area_id",
        "n_name AS name",
        "concat('N', n_nationkey) AS code",
        "'LEAGUE' AS type",
        "'TIER_ONE' AS plan",
    )


def teams(t: Mapping) -> DataFrame:
    nations = t["nation"].selectExpr("n_nationkey", "cast(n_regionkey AS BIGINT) AS area_id")
    return t["supplier"].join(nations, F.expr("s_nationkey = n_nationkey"), "left").selectExpr(
        "s_suppkey AS id",
        "area_id",
        "s_name AS name",
        "s_name AS shortName",
        "concat('T', s_suppkey) AS tla",
        *(f"cast(NULL AS STRING) AS {c}" for c in ("crest", "venue", "address")),
    )


def matches_with_score(t: Mapping, defective: bool = False) -> DataFrame:
    """One row per order line: the match and its score.

    The final score is unknown on every seventh line number, the declared winner
    for one residue of the quantity.
    """

    def planted(defect: str, bad: str, good: str) -> str:
        return f"CASE WHEN l_orderkey % {DEFECTS[defect]} = 0 THEN {bad} ELSE {good} END" if defective else good

    competition = f"l_partkey % {COMPETITIONS}"
    away_team = f"l_partkey DIV {PARTS_PER_TEAM}"
    status = (
        "CASE WHEN l_linestatus = 'F' THEN 'FINISHED' WHEN l_returnflag = 'N' THEN 'SCHEDULED' "
        "WHEN l_returnflag = 'A' THEN 'TIMED' ELSE 'POSTPONED' END"
    )
    quantity = "cast(l_quantity AS INT)"
    return t["lineitem"].selectExpr(
        f"{planted('id_missing', 'NULL', 'l_orderkey * 10 + l_linenumber')} AS id",
        f"{planted('competition_orphan', f'{competition} + 100', competition)} AS competition_id",
        "cast(year(l_shipdate) AS BIGINT) AS season_id",
        f"{planted('date_missing', 'NULL', 'l_shipdate')} AS utcDate",
        planted("status_invalid", "'MUTATED'", status) + " AS status",
        "'REGULAR_SEASON' AS stage",
        f"{planted('matchday_high', '999', quantity)} AS matchday",
        f"{planted('home_missing', 'NULL', 'l_suppkey')} AS home_team_id",
        f"{planted('away_orphan', f'{away_team} + 1000000000000', away_team)} AS away_team_id",
        f"CASE {quantity} % 4 WHEN 0 THEN 'HOME_TEAM' WHEN 1 THEN 'AWAY_TEAM' WHEN 2 THEN 'DRAW' END AS winner",
        "CASE WHEN l_linenumber < 7 THEN l_linenumber % 6 END AS home_goals",
        f"CASE WHEN l_linenumber < 7 THEN {quantity} % 6 END AS away_goals",
    )


MATCH_COLUMNS = (
    "id",
    "competition_id",
    "season_id",
    "utcDate",
    "status",
    "stage",
    "matchday",
    "home_team_id",
    "away_team_id",
)


def matches(t: Mapping, defective: bool = False) -> DataFrame:
    return matches_with_score(t, defective).select(*MATCH_COLUMNS)


def standings(t: Mapping, defective: bool = False) -> DataFrame:
    """Results per competition, season and home team."""
    scored = matches_with_score(t).selectExpr(
        "season_id", "competition_id", "home_team_id AS team_id", "coalesce(home_goals, 0) AS hg", "coalesce(away_goals, 0) AS ag"
    )
    totals = scored.groupBy("season_id", "competition_id", "team_id").agg(
        F.expr("count(1) AS playedGames"),
        F.expr("count_if(hg > ag) AS won"),
        F.expr("count_if(hg = ag) AS draw"),
        F.expr("count_if(hg < ag) AS lost"),
        F.expr("sum(hg) AS goalsFor"),
        F.expr("sum(ag) AS goalsAgainst"),
    )
    points = "won * 3 + draw"
    if defective:
        points += f" + CASE WHEN team_id % {DEFECTS['points_wrong']} = 0 THEN 1 ELSE 0 END"
    return totals.selectExpr(
        "season_id",
        "competition_id",
        "team_id",
        "'TOTAL' AS type",
        "'REGULAR_SEASON' AS stage",
        "cast(team_id % 20 + 1 AS INT) AS position",
        *(f"cast({c} AS INT) AS {c}" for c in ("playedGames", "won", "draw", "lost", "goalsFor", "goalsAgainst")),
        "cast(goalsFor - goalsAgainst AS INT) AS goalDifference",
        f"cast({points} AS INT) AS points",
    )


def entity_tables(t: Mapping, defective: bool = False) -> Lazy:
    """The five un-versioned tables."""
    return Lazy(
        {
            "areas": lambda: areas(t),
            "competitions": lambda: competitions(t),
            "teams": lambda: teams(t),
            "matches": lambda: matches(t, defective),
            "standings": lambda: standings(t, defective),
        }
    )


def star_tables(t: Mapping, defective: bool = False, run_id: str = BASELINE_RUN) -> Lazy:
    """The versioned star schema: one row per key."""
    run = f"'{run_id}' AS run_id"

    def empty(kind: str, *names: str) -> list[str]:
        return [f"cast(NULL AS {kind}) AS {n}" for n in names]

    def scored() -> DataFrame:
        return matches_with_score(t, defective).filter("id IS NOT NULL")

    def dim_area() -> DataFrame:
        return areas(t).selectExpr(
            run, "id AS area_id", "name", "countryCode AS country_code", "flag AS flag_url", *empty("BIGINT", "parent_area_id")
        )

    def dim_competition() -> DataFrame:
        return competitions(t).selectExpr(run, "id AS competition_id", "area_id", "code", "name", "type", "plan")

    def dim_season() -> DataFrame:
        # Declared dates are absent for one season so that the observed ones are used.
        years = t["orders"].selectExpr("year(o_orderdate) AS y").distinct()
        return years.selectExpr(
            run,
            "cast(y AS BIGINT) AS season_id",
            f"cast(y % {COMPETITIONS} AS BIGINT) AS competition_id",
            "CASE WHEN y <> 1997 THEN make_date(y, 1, 1) END AS start_date",
            "CASE WHEN y <> 1997 THEN make_date(y, 12, 31) END AS end_date",
            *empty("BIGINT", "winner_team_id"),
        )

    def dim_team() -> DataFrame:
        return teams(t).selectExpr(
            run,
            "id AS team_id",
            "area_id",
            "name",
            "shortName AS short_name",
            "tla",
            "crest AS crest_url",
            "venue",
            "address",
            *empty("INT", "founded"),
            *empty("STRING", "website", "club_colors"),
        )

    def fact_match() -> DataFrame:
        first = first_per_key(scored().select(*MATCH_COLUMNS), ["id"], ["utcDate"])
        return first.withColumnsRenamed({"id": "match_id", "utcDate": "utc_date"}).selectExpr(run, "*")

    def fact_match_score() -> DataFrame:
        first = first_per_key(scored().select("id", "winner", "home_goals", "away_goals"), ["id"])
        return first.selectExpr(
            run,
            "id AS match_id",
            "winner",
            *empty("STRING", "duration"),
            *empty("INT", "half_time_home", "half_time_away"),
            "home_goals AS full_time_home",
            "away_goals AS full_time_away",
        )

    def fact_standing() -> DataFrame:
        names = {
            "type": "standing_type",
            "playedGames": "played_games",
            "goalsFor": "goals_for",
            "goalsAgainst": "goals_against",
            "goalDifference": "goal_difference",
        }
        return standings(t, defective).withColumnsRenamed(names).selectExpr(run, "*", *empty("STRING", "form"))

    base = {
        "dim_area": dim_area,
        "dim_competition": dim_competition,
        "dim_season": dim_season,
        "dim_team": dim_team,
        "fact_match": fact_match,
        "fact_match_score": fact_match_score,
        "fact_standing": fact_standing,
    }
    star = Lazy(base)

    def marts() -> dict[str, DataFrame]:
        return add_marts({n: star[n] for n in base})

    return Lazy(
        {
            **{n: (lambda n=n: star[n]) for n in base},
            "mart_kpi": lambda: marts()["mart_kpi"],
            "mart_team": lambda: marts()["mart_team"],
        }
    )

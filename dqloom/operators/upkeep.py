"""Marts kept up to date by batches.

Each batch of new matches is aggregated alone and its partial aggregates are stored; a mart is finished from all of
them.  Counts add up, days have a smallest and largest one, and the distinct teams of a season are kept as its set of
teams.  So adding a batch reads that batch only, and a mart reads rows per season, team and batch, never the facts.
Batches must not share matches (``keys.insert_if_absent`` leaves out what is stored).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.operators.marts import OUTCOME, SEASON_KEY, finished_kpi, finished_results, with_scores

COUNTS = ("matches_total", "matches_finished", "_home", "_draw", "_away")
RESULTS = ("matches_played", "wins", "draws", "losses", "goals_for", "goals_against")
# What is stored of each batch, and its key.
PARTIALS = {"seasons": tuple(SEASON_KEY), "season_teams": (*SEASON_KEY, "team_id"), "results": (*SEASON_KEY, "team_id")}


def scored_matches(matches: DataFrame, scores: DataFrame) -> DataFrame:
    """What the aggregates need of some matches."""
    teams = ("home_team_id", "away_team_id", "full_time_home", "full_time_away")
    return with_scores(matches, scores).selectExpr(*SEASON_KEY, "status", *teams, f"{OUTCOME} AS outcome", "to_date(utc_date) AS day")


def partials(scored: DataFrame) -> dict[str, DataFrame]:
    """The mergeable aggregates of some ``scored_matches``."""
    decided = "status = 'FINISHED' AND full_time_home IS NOT NULL AND full_time_away IS NOT NULL"
    seasons = scored.groupBy(*SEASON_KEY).agg(
        F.expr("count(1) AS matches_total"),
        F.expr("count_if(status = 'FINISHED') AS matches_finished"),
        *[F.expr(f"count_if(outcome = '{o}') AS _{o.lower()}") for o in ("HOME", "DRAW", "AWAY")],
        F.expr("min(day) AS _first"),
        F.expr("max(day) AS _last"),
        F.expr(f"min(day) FILTER (WHERE {decided}) AS _first_played"),
        F.expr(f"max(day) FILTER (WHERE {decided}) AS _last_played"),
    )
    teams = scored.selectExpr(*SEASON_KEY, "explode(array(home_team_id, away_team_id)) AS team_id").filter("team_id IS NOT NULL").distinct()
    roles = scored.filter(decided).selectExpr(
        *SEASON_KEY,
        "inline(array(named_struct('team_id', home_team_id, 'gf', full_time_home, 'ga', full_time_away), "
        "named_struct('team_id', away_team_id, 'gf', full_time_away, 'ga', full_time_home)))",
    )
    results = roles.groupBy(*SEASON_KEY, "team_id").agg(
        F.expr("count(1) AS matches_played"),
        F.expr("count_if(gf > ga) AS wins"),
        F.expr("count_if(gf = ga) AS draws"),
        F.expr("count_if(gf < ga) AS losses"),
        F.expr("sum(gf) AS goals_for"),
        F.expr("sum(ga) AS goals_against"),
    )
    return {"seasons": seasons, "season_teams": teams, "results": results}


def add_batch(matches: DataFrame, scores: DataFrame, root: str, batch: str) -> None:
    """Store the aggregates of a batch; a batch that is added again replaces what it wrote.

    Its matches are joined to their scores once, and what the aggregates need of them is stored beside these.
    """
    path = f"{root.rstrip('/')}/scored/batch={batch}"
    joined = scored_matches(matches, scores)
    joined.write.mode("overwrite").parquet(path)
    for name, rows in partials(joined.sparkSession.read.schema(joined.schema).parquet(path)).items():
        rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/batch={batch}")


def stored(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root.rstrip('/')}/{name}").drop("batch") for name in PARTIALS}


def _added(rows: DataFrame, keys: Sequence[str], sums: Sequence[str], least: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
    totals = [F.sum(c).alias(c) for c in sums] + [F.min(c).alias(c) for c in least] + [F.max(c).alias(c) for c in most]
    return rows.groupBy(*keys).agg(*totals)


def merged(parts: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """One row per key of the aggregates of several batches; merged rows can be merged again."""
    return {
        "seasons": _added(parts["seasons"], PARTIALS["seasons"], COUNTS, ("_first", "_first_played"), ("_last", "_last_played")),
        "season_teams": parts["season_teams"].select(*PARTIALS["season_teams"]).distinct(),
        "results": _added(parts["results"], PARTIALS["results"], RESULTS),
    }


def finished(parts: Mapping[str, DataFrame], competitions: DataFrame, seasons: DataFrame, teams: DataFrame) -> dict[str, DataFrame]:
    """Both marts from the aggregates of all batches."""
    whole = merged(parts)
    distinct = whole["season_teams"].groupBy(*SEASON_KEY).agg(F.count(F.lit(1)).alias("_teams"))
    match = [F.col(f"_s_{k}").eqNullSafe(F.col(k)) for k in SEASON_KEY]
    counted = whole["seasons"].drop("_first_played", "_last_played").join(distinct.withColumnsRenamed({k: f"_s_{k}" for k in SEASON_KEY}), match, "left")
    kpi = counted.drop(*[f"_s_{k}" for k in SEASON_KEY]).withColumn("teams_distinct", F.coalesce("_teams", F.lit(0)))
    played = whole["seasons"].select(*SEASON_KEY, F.col("_first_played").alias("_first"), F.col("_last_played").alias("_last"))
    dated = whole["results"].join(played, SEASON_KEY, "left")
    return {"mart_kpi": finished_kpi(kpi, competitions, seasons), "mart_team": finished_results(dated, competitions, seasons, teams)}

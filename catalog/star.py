"""Star-schema operators: dedupe, insert-if-absent, marts and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import query
from catalog import sql as S
from dqloom.operators import flatten, keys, marts, upkeep
from dqloom.plans import testbed
from dqloom.session import checkpoint_folder


@query("mart_season_kpi", f"WITH {S.MARTS} SELECT * FROM mart_kpi")
def season_kpi(t):
    return testbed.star_tables(t, True)["mart_kpi"]


@query("mart_team_results", f"WITH {S.MARTS} SELECT * FROM mart_team")
def team_results(t):
    return testbed.star_tables(t, True)["mart_team"]


@query(
    "mart_top_seasons",
    f"WITH {S.MARTS} SELECT * EXCLUDE (run_id) FROM mart_kpi "
    "ORDER BY matches_total DESC NULLS LAST, competition_id, season_id LIMIT 200",
)
def top_seasons(t):
    return marts.snapshot(testbed.star_tables(t, True)["mart_kpi"], "mart_kpi")


@query(
    "mart_top_teams",
    f"WITH {S.MARTS} SELECT * EXCLUDE (run_id) FROM mart_team "
    "ORDER BY points_calc DESC NULLS LAST, competition_id, season_id, team_id LIMIT 200",
)
def top_teams(t):
    return marts.snapshot(testbed.star_tables(t, True)["mart_team"], "mart_team")


@query(
    "rpt_post_rows",
    f"""WITH {S.MARTS} SELECT 'mart_kpi' AS "table", count(*) AS rows FROM mart_kpi UNION ALL SELECT 'mart_team', count(*) FROM mart_team""",
)
def post_rows(t):
    star = testbed.star_tables(t, True)
    return flatten.row_counts({n: star[n] for n in ("mart_kpi", "mart_team")})


@query("etl_dedupe_first", f"WITH {S.STAR} SELECT * FROM fact_match")
def dedupe_first(t):
    return testbed.star_tables(t, True)["fact_match"]


@query("etl_dim_union", f"WITH {S.STAR} SELECT season_id, competition_id, start_date, end_date FROM dim_season")
def dim_union(t):
    return testbed.star_tables(t)["dim_season"].select("season_id", "competition_id", "start_date", "end_date")


@query(
    "etl_insert_if_absent",
    """WITH arriving AS (SELECT l_orderkey AS id, l_shipdate, l_partkey, l_quantity FROM lineitem),
    stored AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')
    SELECT id, l_shipdate, l_partkey, l_quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_shipdate, l_partkey, l_quantity) AS rn FROM arriving)
    WHERE rn = 1 AND id NOT IN (SELECT id FROM stored)""",
)
def insert_if_absent(t):
    arriving = t["lineitem"].selectExpr("l_orderkey AS id", "l_shipdate", "l_partkey", "l_quantity")
    stored = t["orders"].filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS id")
    return keys.insert_if_absent(stored, arriving, ["id"], ["l_shipdate"])


@query(
    "etl_distinct_customers_of_orders",
    "SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS season FROM orders",
)
def distinct_rows(t):
    rows = t["orders"].select("o_custkey", F.year("o_orderdate").alias("season"))
    return keys.first_per_key(rows.withColumn("season", F.col("season").cast("bigint")), ["o_custkey", "season"])


def _kept_up(t) -> dict:
    """Both marts from three batches of the facts, each aggregated alone."""
    star = testbed.star_tables(t, True)
    root = f"{checkpoint_folder(t.spark)}/upkeep-{uuid.uuid4().hex}"
    matches, scores = star["fact_match"], star["fact_match_score"]
    for batch in range(3):
        own = F.pmod(F.xxhash64("match_id"), F.lit(3)) == batch
        upkeep.add_batch(matches.filter(own), scores.filter(own), root, str(batch))
    return upkeep.finished(upkeep.stored(t.spark, root), star["dim_competition"], star["dim_season"], star["dim_team"])


@query("mart_kpi_by_batches", f"WITH {S.MARTS} SELECT * FROM mart_kpi")
def kpi_by_batches(t):
    return _kept_up(t)["mart_kpi"]


@query("mart_team_by_batches", f"WITH {S.MARTS} SELECT * FROM mart_team")
def team_by_batches(t):
    return _kept_up(t)["mart_team"]

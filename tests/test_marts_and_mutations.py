"""Marts on hand-written rows, and mutation testing: a planted defect makes exactly the expected checks fire."""

import pytest
from conftest import failed
from pyspark.sql import functions as F

from dqloom.operators import diff, fusion, marts, mutations, reports
from dqloom.operators.mutations import entity_mutation
from dqloom.plans import experiment, strategies, suites, testbed


@pytest.fixture(scope="module")
def star(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    matches = [
        ("r", 1, 1, 10, "2024-03-01 10:00:00", "FINISHED", 5, 6),
        ("r", 2, 1, 10, "2025-02-01 10:00:00", "FINISHED", 6, 5),
        ("r", 3, 1, 10, None, "SCHEDULED", 5, 7),
        ("r", 4, 2, 11, "2023-01-01 10:00:00", "TIMED", 5, None),
        ("r", 5, None, 10, "2023-01-01 10:00:00", "FINISHED", 5, 6),
        ("r", 6, 1, 99, "2023-01-01 10:00:00", "FINISHED", 5, 6),
    ]
    fact = table(matches, "run_id STRING, match_id INT, competition_id INT, season_id INT, ts STRING, status STRING, home_team_id INT, away_team_id INT")
    fact = fact.withColumn("utc_date", F.col("ts").cast("timestamp_ntz")).drop("ts")
    scores = [("r", 1, None, 2, 1), ("r", 2, "DRAW", 1, 1), ("r", 3, "AWAY_TEAM", None, None)]
    return {
        "fact_match": fact,
        "fact_match_score": table(scores, "run_id STRING, match_id INT, winner STRING, full_time_home INT, full_time_away INT"),
        "dim_competition": table([("r", 1, "One"), ("r", 2, "Two")], "run_id STRING, competition_id INT, name STRING"),
        "dim_season": table(
            [("r", 10, None, None), ("r", 11, "2022-08-01", None)], "run_id STRING, season_id INT, s STRING, e STRING"
        ).selectExpr("run_id", "season_id", "cast(s AS DATE) AS start_date", "cast(e AS DATE) AS end_date"),
        "dim_team": table([("r", 5, "A"), ("r", 6, "B")], "run_id STRING, team_id INT, name STRING"),
    }


def test_season_kpi(star):
    rows = {(r["competition_id"], r["season_id"]): r for r in marts.add_marts(star)["mart_kpi"].collect()}
    assert set(rows) == {(1, 10), (2, 11)}
    one, two = rows[1, 10], rows[2, 11]
    assert (one["matches_total"], one["matches_finished"], one["teams_distinct"]) == (3, 2, 3)
    assert (str(one["start_date"]), str(one["end_date"]), one["season_year"]) == ("2024-03-01", "2025-02-01", 2024)
    assert (one["home_win_rate"], one["draw_rate"], one["away_win_rate"]) == (0.3333, 0.3333, 0.3333)
    # Nothing decided: no rates, but the match counts.
    assert (two["matches_total"], two["home_win_rate"], two["teams_distinct"]) == (1, None, 1)
    assert (str(two["start_date"]), str(two["end_date"]), two["season_year"]) == ("2022-08-01", "2023-01-01", 2022)


def test_team_results(star):
    rows = {r["team_id"]: r for r in marts.add_marts(star)["mart_team"].collect()}
    assert set(rows) == {5, 6}
    a, b = rows[5], rows[6]
    assert (a["matches_played"], a["wins"], a["draws"], a["losses"], a["goals_for"], a["goals_against"]) == (2, 1, 1, 0, 3, 2)
    assert (a["points_calc"], b["points_calc"], b["goal_difference"]) == (4, 1, -1)
    assert (str(a["start_date"]), str(a["end_date"]), a["season_year"]) == ("2024-03-01", "2025-02-01", 2024)


def test_round_robin(star):
    seasons = star["dim_season"]
    rows = marts.uneven_home_away(star["fact_match"], seasons, "2023-01-01").collect()
    assert {(r["season_id"], r["team_id"], r["home_matches"], r["away_matches"]) for r in rows} == {(11, 5, 1, 0), (11, None, 0, 1)}


# --- mutations -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clean(small):
    """Entity tables without natural duplicates, so that the baseline passes everything but equal teams."""
    tables = testbed.entity_tables(small)
    distinct = tables["matches"].filter("home_team_id <> away_team_id").dropDuplicates(["id"])
    tables = {n: tables[n] for n in tables}
    tables["matches"] = distinct.cache()
    tables["standings"] = tables["standings"].cache()
    return tables


EXPECTED = {
    "none": {},
    "duplicate_first": {"dds_duplicate_fact_match": 1},
    "swap_teams": {},
    "collapse_teams": {"match_home_away_diff": 5},
    "matchday_out_of_range": {"dds_matchday_out_of_range": 3},
    "drop_required": {},
    "drop_matches_key": {},
    "season_dates_missing": {},
    "fact_match": {"dds_missing_home_away_team": 1, "dds_matchday_out_of_range": 1, "match_status_invalid": 1},
    "fact_standing": {},
    "dim_competition": {},
}


@pytest.mark.parametrize("action", sorted(EXPECTED))
def test_mutations_trip_the_expected_transform_checks(clean, action):
    changed = clean if action == "none" else mutations.apply(clean, entity_mutation(action))
    rows = fusion.evaluate("sql", "T", suites.SQL.checks("T"), changed).collect()
    assert failed(rows) == EXPECTED[action]


def test_mutations_trip_the_expected_extract_and_load_checks(clean):
    def found(suite, stage, *actions):
        changed = mutations.apply(clean, *[entity_mutation(a) for a in actions])
        return failed(fusion.evaluate(suite.name, stage, suite.checks(stage), changed).collect())

    n = clean["matches"].count()
    assert found(suites.SQL, "E", "drop_required") == {"stg_missing_match_id": 1, "matches_completeness": 1}
    assert found(suites.SQL, "E", "fact_match") == {"stg_matchday_out_of_range": 1, "matches_completeness": 1}
    assert found(suites.SODA, "L", "season_dates_missing") == {"mart_kpi_missing_dates": n}
    assert found(suites.SODA, "L", "duplicate_first", "season_dates_missing") == {"mart_kpi_missing_dates": n + 1}
    assert found(suites.GX, "L", "fact_match") == {"mart_kpi_rate_out_of_bounds": 1}
    # A row in which nothing was played gives no rate, so no bound is broken; it is planted for a team without standing.
    newcomer = clean["teams"].limit(1).withColumn("id", F.lit(777).cast("bigint"))
    roomy = mutations.apply({**clean, "teams": clean["teams"].unionByName(newcomer)}, entity_mutation("fact_standing"))
    assert failed(fusion.evaluate("soda", "L", suites.SODA.checks("L"), roomy).collect()) == {}
    assert roomy["standings"].filter("type = 'MUTATED'").first()["team_id"] == 777
    assert found(suites.DEEQU, "T", "fact_standing") == {"played_games_positive": 1}
    assert found(suites.DEEQU, "L", "drop_matches_key") == {}


def test_swap_is_invisible_to_row_checks_but_changes_the_results(clean):
    before, after = clean["matches"], mutations.swap_teams(clean["matches"], 5, seed="s")
    moved = diff.keyed_diff(before, after, ["id"])
    assert moved.select("id").distinct().count() == 5
    assert {r["field"] for r in moved.collect()} == {"home_team_id", "away_team_id"}
    assert after.exceptAll(mutations.swap_teams(clean["matches"].repartition(3), 5, seed="s")).count() == 0
    other = mutations.swap_teams(clean["matches"], 5, seed="another")
    assert after.exceptAll(other).count() > 0


def test_inserted_rows_follow_the_table_types(clean):
    changed = mutations.apply(clean, entity_mutation("fact_match"), entity_mutation("fact_match"))
    assert changed["matches"].schema.simpleString() == clean["matches"].schema.simpleString()
    (row,) = changed["matches"].filter("id = 99999901").collect()
    assert (row["status"], row["matchday"], row["home_team_id"]) == ("MUTATED", 999, None)
    empty = {**clean, "matches": clean["matches"].limit(0), "competitions": clean["competitions"].limit(0)}
    assert mutations.apply(empty, entity_mutation("fact_match"))["matches"].count() == 0


def test_star_mutations(small):
    tables = testbed.star_tables(small)
    star = {n: tables[n] for n in ("dim_competition", "dim_team", "dim_season", "fact_match", "fact_standing")}
    changed = mutations.apply(star, *[mutations.star_mutation(a, testbed.BASELINE_RUN) for a in ("dim_competition", "fact_standing")])
    (comp,) = changed["dim_competition"].filter("name = 'MUTATED_COMP'").collect()
    assert comp["code"].startswith("N") and comp["plan"] == "TIER_ONE"
    checks = [c for c in suites.STAGE.checks("T") if c.name in ("dds_dim_competition_name_corrupted", "dds_fact_standing_zero_played_games")]
    assert set(failed(fusion.evaluate("stage", "T", checks, changed).collect())) == {c.name for c in checks}


def test_experiment_plan_and_matrix(clean):
    strategy = strategies.STRATEGIES["staged_soda_sql_soda"]
    plan = (
        experiment.Iteration("twin team, no dates", (("teams", "duplicate_first"),), ("season_dates_missing",)),
        experiment.Iteration("twin match, odd match", (("matches", "duplicate_first"),), ("fact_match",)),
    )
    results = experiment.run_entity_plan(clean, plan, strategy)
    matrix = {(r["mutation"], r["stage"]): (r["soda"], r["sql"]) for r in reports.detection_matrix(results, ["soda", "sql"]).collect()}
    dates, bad = (iteration.name for iteration in plan)
    assert matrix["baseline", "E"] == matrix["baseline", "T"] == matrix["baseline", "L"] == (0, 0)
    assert matrix[dates, "L"] == (1, 0) and matrix[dates, "E"] == (1, 0)
    # Duplicate, missing teams, matchday and status.
    assert matrix[bad, "T"] == (0, 4)


def test_keyed_diff_of_repeated_keys(spark):
    both = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert diff.keyed_diff(both, both, ["k"]).count() == 0
    more = both.unionByName(spark.createDataFrame([(1, "b"), (2, "x")], "k int, v string"))
    found = {(r["k"], r["change"], r["field"], r["before"], r["after"]) for r in diff.keyed_diff(both, more, ["k"]).collect()}
    assert found == {(1, "added", None, None, None), (2, "added", None, None, None)}


def test_diff_sample_keeps_whole_keys(spark):
    before = spark.range(5).selectExpr("id AS k", "1 AS a", "2 AS b")
    after = spark.range(5).selectExpr("id AS k", "3 AS a", "4 AS b")
    found = diff.diff_sample(diff.keyed_diff(before, after, ["k"]), ["k"], "changed", 2).collect()
    assert [(r["k"], r["field"]) for r in found] == [(0, "a"), (0, "b"), (1, "a"), (1, "b")]


def test_keyed_diff(spark):
    before = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "k INT, v STRING, n INT")
    after = spark.createDataFrame([(2, "b", 2), (3, "c", 3), (4, "d", 4)], "k INT, v STRING, n INT")
    rows = {tuple(r) for r in diff.keyed_diff(before, after, ["k"]).collect()}
    assert rows == {(1, "removed", None, None, None), (4, "added", None, None, None), (2, "changed", "n", None, "2")}
    assert {tuple(r) for r in diff.keyless_diff(before, after).collect()} == {
        (1, "a", 1, "removed"), (2, "b", None, "removed"), (2, "b", 2, "added"), (4, "d", 4, "added"),
    }


def test_run_stage_and_ledger_rows(spark, clean, monkeypatch):
    monkeypatch.setenv(strategies.REPEATS_OVERRIDE, "2")
    runs = experiment.run_stage(clean, "L", strategies.universal("soda"), "exp_1")
    assert [(r.repeat_no, r.checks_total, r.checks_failed, r.status) for r in runs] == [(1, 3, 0, "SUCCESS"), (2, 3, 0, "SUCCESS")]
    heads, checks = experiment.ledger_rows(spark, runs, "dag", "base")
    assert {(r["layer"], r["kind"], r["tool"]) for r in heads.collect()} == {("L_SODA", "experiment", "soda")}
    assert heads.join(checks, "validation_run_id").count() == 6
    assert heads.select("validation_run_id").distinct().count() == 2


def test_plans_from_config():
    config = {
        "experiment": {
            "name": "p",
            "defaults": {"repeats": 5, "only_unprocessed": True, "tools_by_stage": {"E": ["soda"], "T": ["sql"], "L": ["soda"]}},
            "iterations": [
                {"name": "a", "stg_mutations_enable": {"matches": ["swap_teams"]}, "dds_mutations_enable": ["fact_match"], "env": {"X_SWAP_TEAMS_COUNT": "3"}}
            ],
        }
    }
    strategy = strategies.from_config(config)
    assert strategy.suites("T") == ("sql",) and strategy.runs == 5 and not strategy.skip_processed
    (it,) = experiment.plan_from_config(config)
    assert it == experiment.Iteration("a", (("matches", "swap_teams"),), ("fact_match",), 3)
    with pytest.raises(ValueError):
        strategies.from_config({"experiment": {"defaults": {"tools_by_stage": {"X": ["gx"]}}}})


def test_stored_versions_are_read_where_they_differ(spark, tmp_path):
    from dqloom.operators import digests

    rows = spark.range(20_000).selectExpr("id AS k", "id % 7 AS a", "if(id % 5 = 0, NULL, cast(id AS STRING)) AS b", "id / 3 AS c")
    changed = rows.withColumn("a", F.when(F.col("k") == 777, -1).otherwise(F.col("a")))
    moved = rows.selectExpr("k", "a", "if(k = 5, '5', b) AS b", "c")
    paths = {name: str(tmp_path / name) for name in ("old", "same", "new", "moved", "wider")}
    for name, version, bits in (("old", rows, 6), ("same", rows.repartition(5), 6), ("new", changed, 6), ("moved", moved, 6), ("wider", changed, 5)):
        digests.store(version, paths[name], ["k"], bits)
    root = {name: digests.root_digest(spark.read.parquet(f"{path}/digests")).first() for name, path in paths.items()}
    assert root["old"] == root["same"] and root["new"] == root["wider"] and len({root["old"], root["new"], root["moved"]}) == 3
    same = digests.stored_diff(spark, paths["old"], paths["same"], ["k"])
    assert digests.differing_buckets(spark, paths["old"], paths["same"]) == [] and same.count() == 0 and same.inputFiles() == []
    (bucket,) = digests.differing_buckets(spark, paths["old"], paths["new"])
    found = digests.stored_diff(spark, paths["old"], paths["new"], ["k"])
    assert [tuple(r) for r in found.collect()] == [(777, "changed", "a", "0", "-1")]
    # one changed key: one bucket of 64 is read on each side, about a 64th of the bytes
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert scans and all("_bucket" in line and "PartitionFilters: [" in line and str(bucket) in line for line in scans)
    sizes = {p.parent.name: p.stat().st_size for p in (tmp_path / "old" / "rows").rglob("*.parquet")}
    assert len(sizes) == 64 and sizes[f"_bucket={bucket}"] * 30 < sum(sizes.values())
    # a value that moves in from NULL, another layout, and rows that repeat a key
    assert [tuple(r) for r in digests.stored_diff(spark, paths["old"], paths["moved"], ["k"]).collect()] == [(5, "changed", "b", None, "5")]
    assert digests.differing_buckets(spark, paths["old"], paths["wider"]) is None
    assert digests.stored_diff(spark, paths["old"], paths["wider"], ["k"]).count() == 1
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k INT, v STRING")
    digests.store(twice, str(tmp_path / "twice"), ["k"], 3)
    digests.store(twice.distinct(), str(tmp_path / "once"), ["k"], 3)
    digests.store(twice.limit(0), str(tmp_path / "none"), ["k"], 3)
    assert [tuple(r)[:2] for r in digests.stored_diff(spark, str(tmp_path / "twice"), str(tmp_path / "once"), ["k"]).collect()] == [(1, "removed")]


def test_adding_a_batch_reads_that_batch_only(spark, small, tmp_path):
    from dqloom.operators import upkeep

    star = testbed.star_tables(small)
    matches, scores = (star[n].withColumn("part", F.pmod(F.col("match_id"), F.lit(4))) for n in ("fact_match", "fact_match_score"))
    matches.write.partitionBy("part").parquet(str(tmp_path / "matches"))
    scores.write.partitionBy("part").parquet(str(tmp_path / "scores"))
    facts, points = (spark.read.parquet(str(tmp_path / n)) for n in ("matches", "scores"))
    dims = [star[n] for n in ("dim_competition", "dim_season", "dim_team")]
    root = str(tmp_path / "partials")
    for part in (0, 1, 2, 1):  # one of them again
        # nothing but the files of the batch is given
        upkeep.add_batch(*(spark.read.parquet(str(tmp_path / n / f"part={part}")) for n in ("matches", "scores")), root, str(part))
        done = [p for p in range(4) if (tmp_path / f"partials/seasons/batch={p}").exists()]
        own = facts.filter(F.col("part").isin(*done)).drop("part"), points.filter(F.col("part").isin(*done)).drop("part")
        found = upkeep.finished(upkeep.stored(spark, root), *dims)
        assert all("partials" in f or "/testdata/" in f for f in found["mart_kpi"].inputFiles())
        kpi = marts.competition_season_kpi(*own, dims[0], dims[1])
        team = marts.team_season_results(*own, *dims)
        for name, whole in (("mart_kpi", kpi), ("mart_team", team)):
            assert sorted(map(repr, found[name].select(whole.columns).collect())) == sorted(map(repr, whole.collect()))

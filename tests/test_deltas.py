"""Versions from deltas, fail-rows of suites and quarantine, against evaluation of every version and row by itself."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dqloom.operators import checks as C
from dqloom.operators import deltas, failrows, fusion, mutations
from dqloom.operators.checks import Ref
from dqloom.plans import experiment, strategies, suites, testbed
from dqloom.session import cut_lineage

BOTH = (Ref("home", ("home",), "team", ("id",)), Ref("away", ("away",), "team", ("id",), null_is_orphan=True))
CHECKS = (
    C.rows_where("day", "game", "day > 5"),
    C.rows_where("name", "team", "name IS NULL"),
    C.not_empty("games", "game"),
    C.not_empty("teams", "team"),
    C.duplicate_groups("twice", "game", "home", "away"),
    C.duplicate_groups("twice_known", "game", "home", "away", count_null_keys=False),
    C.duplicate_groups("same_name", "team", "name", wide=True),
    C.orphans("teams_known", "game", *BOTH),
    C.orphans("home_known", "game", BOTH[0]),
    C.all_loaded("home_loaded", "game", ("home",), "team", ("id",)),
    C.none_invented("none_invented", "game", ("away",), "team", ("id",)),
)
PLACED = [fusion.Placed("own", "T", c) for c in CHECKS]
GAME, TEAM = "home INT, away INT, day INT", "id INT, name STRING"


def _games(draw, n):
    return [(draw.choice([None, *range(6)]), draw.choice([None, *range(6)]), draw.randint(0, 8)) for _ in range(n)]


def _teams(draw, n):
    return [(draw.choice([None, *range(7)]), draw.choice([None, "a", "b"])) for _ in range(n)]


def _without(rows, gone):
    return list((Counter(rows) - Counter(gone)).elements())


def test_versions_follow_from_what_they_change(spark):
    draw = random.Random(9)
    game, team = _games(draw, 40), _teams(draw, 6)

    def frames(games, teams):
        return {"game": spark.createDataFrame(games, GAME).coalesce(2), "team": spark.createDataFrame(teams, TEAM).coalesce(2)}

    tables, changes, versions = frames(game, team), {}, {"base": (game, team)}
    plans = [(k, j) for k in (0, 1, 8) for j in (0, 1, 3)] + [(40, 0), (0, 6), (40, 6)]
    for i, (k, j) in enumerate(plans):
        gone, lost = draw.sample(game, k), draw.sample(team, j)
        come, more = _games(draw, draw.choice([0, 2, 5]) if k < 40 else 0), _teams(draw, draw.choice([0, 2]) if j < 6 else 0)
        versions[f"v{i}"] = (_without(game, gone) + come, _without(team, lost) + more)
        change = {}
        if gone or come:
            change["game"] = deltas.Change(spark.createDataFrame(gone, GAME), spark.createDataFrame(come, GAME))
        if lost or more:
            change["team"] = deltas.Change(spark.createDataFrame(lost, TEAM) if lost else None, spark.createDataFrame(more, TEAM))
        changes[f"v{i}"] = change
    teams = [(i, None) for i, _ in team]
    versions["whole"] = (game[:30], teams)
    changes["whole"] = {
        "game": deltas.Change(spark.createDataFrame(game[30:], GAME)),
        "team": deltas.Change(whole=spark.createDataFrame(teams, TEAM), columns=("name",)),
    }
    found = deltas.evaluate(PLACED, tables, changes, "base").collect()
    assert len(found) == len(versions) * len(CHECKS)
    for version, rows in versions.items():
        truth = {r["check_name"]: (r["status"], r["rows_failed"]) for r in fusion.evaluate_placed(PLACED, frames(*rows)).collect()}
        assert {r["check_name"]: (r["status"], r["rows_failed"]) for r in found if r["version"] == version} == truth, version


@pytest.mark.parametrize("defective", [False, True])
def test_iterations_are_what_their_tables_give(spark, small, defective):
    tables = testbed.entity_tables(small, defective)
    tables = {n: cut_lineage(tables[n]) for n in tables}
    plan = [experiment.Iteration(f"{a} {e}", ((e, a),)) for a, e in (
        ("swap_teams", "matches"), ("collapse_teams", "matches"), ("matchday_out_of_range", "matches"), ("duplicate_first", "matches"),
        ("duplicate_first", "teams"), ("drop_required", "teams"), ("drop_required", "matches"), ("drop_matches_key", "matches"),
    )]
    plan += [experiment.Iteration(a, (), (a,)) for a in ("fact_match", "fact_standing", "dim_competition", "season_dates_missing")]
    plan += [experiment.Iteration("seeded", (("matches", "swap_teams"),), seed="s", swaps=9), experiment.Iteration("two", (("teams", "drop_required"),), ("fact_match",))]
    strategy = strategies.Strategy("all", {"E": ("gx", "deequ"), "T": ("sql", "gx", "deequ"), "L": ("deequ",)})
    found = experiment.run_entity_plan(tables, plan, strategy).collect()
    placed = [fusion.Placed(s, stage, c) for stage in strategies.STAGES for s in strategy.suites(stage) for c in suites.ENTITY_SUITES[s].checks(stage)]
    assert len(found) == len(placed) * (len(plan) + 1)
    for it in (experiment.Iteration(experiment.BASELINE), *plan):
        changed = mutations.apply(tables, *it.entity_mutations())
        truth = {(r["suite"], r["stage"], r["check_name"]): r["rows_failed"] for r in fusion.evaluate_placed(placed, changed).collect()}
        assert {(r["suite"], r["stage"], r["check_name"]): r["rows_failed"] for r in found if r["mutation"] == it.name} == truth, it.name


def test_an_unchanged_table_is_read_once(spark, tmp_path):
    """The files of a table that no iteration changes are scanned as often as for the baseline alone."""
    draw = random.Random(1)
    spark.createDataFrame(_games(draw, 50), GAME).write.parquet(str(tmp_path / "game"))
    spark.createDataFrame(_teams(draw, 6), TEAM).write.parquet(str(tmp_path / "team"))
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in ("game", "team")}
    placed = [p for p in PLACED if p.check.table == "team"]

    def scans(n):
        changes = {f"v{i}": {"game": deltas.Change(come=tables["game"].limit(1))} for i in range(n)}
        frame = deltas.evaluate(placed, tables, changes, "base")
        return frame._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")

    assert scans(1) == scans(7) <= 3


# -- fail-rows and quarantine --------------------------------------------------------------------------------------


def _broken(row, games, teams):
    """(check, detail) of everything a game breaks."""
    home, away, day = row
    ids = {i for i, _ in teams if i is not None}
    found = [("day", None)] if day > 5 else []
    repeated = sum(r[:2] == row[:2] for r in games) > 1
    found += [("twice", None)] if repeated else []
    found += [("twice_known", None)] if repeated and None not in row[:2] else []
    lost = home is not None and home not in ids
    found += [("teams_known", "home")] if lost else []
    found += [("teams_known", "away")] if away is None or away not in ids else []
    found += [("home_known", "home")] if lost else []
    found += [("home_loaded", None)] if home not in ids else []
    found += [("none_invented", None)] if away not in ids else []
    return found


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_rows_are_tagged_with_all_they_break(spark, threshold):
    draw = random.Random(10)
    games, teams = _games(draw, 150), [(i, "x") for i in (0, 2, 2, None)]
    tables = {"game": spark.createDataFrame(games, GAME), "team": spark.createDataFrame(teams, TEAM)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = failrows.tagged("game", CHECKS, tables).collect()
        good, bad = failrows.split("game", CHECKS, tables)
        assert good.columns == ["home", "away", "day"] and good.count() + bad.count() == len(games)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert Counter(tuple(r)[:3] for r in rows) == Counter(games)
    for r in rows:
        assert [(v["check_name"], v["detail"]) for v in r["violations"]] == _broken(tuple(r)[:3], games, teams)
    assert good.count() == sum(not _broken(g, games, teams) for g in games)
    shown = {"game": ("home", "away", "day"), "team": ("id",)}
    listed = failrows.fail_rows(CHECKS, tables, shown).collect()
    assert sum(r["table"] == "game" for r in listed) == sum(len(_broken(g, games, teams)) for g in games)
    empty = {**tables, "team": tables["team"].limit(0)}
    assert [(r["table"], r["row_key"]) for r in failrows.fail_rows(CHECKS, empty, shown).filter("check_name = 'teams'").collect()] == [("team", None)]
    none = failrows.tagged("team", CHECKS[:1], tables)
    assert {len(r["violations"]) for r in none.collect()} == {0}


def test_a_suite_scans_a_table_once_for_rows_and_once_a_key(spark, tmp_path):
    draw = random.Random(11)
    spark.createDataFrame(_games(draw, 60), GAME).write.parquet(str(tmp_path / "game"))
    spark.createDataFrame(_teams(draw, 6), TEAM).write.parquet(str(tmp_path / "team"))
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in ("game", "team")}
    checks = [c for c in CHECKS if c.count in (C.ROWS, C.GROUPS, C.ORPHANS) and c.table == "game"]
    # twenty more row rules cost no further scan
    checks += [C.rows_where(f"day_{i}", "game", f"day = {i}") for i in range(20)]
    found = failrows.fail_rows(checks, tables, {})
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    files = final.count(f"{tmp_path}/game")
    # rows, two kinds of repeated keys, and the keys of references, which their roles share where exchanges are reused
    assert files <= 5, files


def test_samples_are_cut_before_they_are_shuffled(spark):
    rows = spark.range(10_000).selectExpr("if(id % 3 = 0, 'a', 'b') AS check_name", "cast(NULL AS STRING) AS detail", "'t' AS table", "lpad(id, 6, '0') AS row_key")
    found = failrows.samples(rows, 4)
    assert [(r["check_name"], int(r["row_key"]), r["rank"]) for r in found.orderBy("check_name", "rank").collect()] == [
        *[("a", 3 * i, i + 1) for i in range(4)], ("b", 1, 1), ("b", 2, 2), ("b", 4, 3), ("b", 5, 4),
    ]
    assert "WindowGroupLimit [check_name" in found._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_counted_before_it_travels(spark):
    """The broken keys come from aggregates with a partial step, and rows are the outer side of their joins."""
    rows = spark.range(1000).selectExpr("cast(id % 1 AS INT) AS home", "cast(id AS INT) AS away", "1 AS day")
    tables = {"game": rows, "team": spark.createDataFrame([(1, "x")], TEAM)}
    frame = failrows.tagged("game", CHECKS, tables)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "LeftOuter" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert frame.filter(F.exists("violations", lambda v: v["check_name"] == "home_known")).count() == 1000

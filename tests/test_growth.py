"""Steps whose cost must not grow faster than their input, seen in their plans."""

import catalog
from dqloom.operators import checks as C
from dqloom.operators import diff, failrows, flatten, schemas, upkeep
from dqloom.plans import dispatch, rawbed
from dqloom.plans.testbed import star_tables
from dqloom.session import TASK_SIZES, with_task_sizes

catalog.load()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_task_sizes_are_set_where_the_owner_set_none(spark):
    other = spark.newSession()
    advisory, split = TASK_SIZES
    other.conf.unset(advisory)
    other.conf.set(split, "77m")
    with_task_sizes(other)
    assert other.conf.get(advisory) == TASK_SIZES[advisory]
    assert other.conf.get(split) == "77m"


def test_payloads_are_dealt_out_and_parsed_once_a_scan(spark, small):
    tasks = rawbed.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert rawbed.payloads(small).rdd.getNumPartitions() == tasks
    # seasons come from bodies and from matches, and are filtered by what is in them
    plan = optimized(flatten.star_rows(rawbed.envelopes(small), "r")["dim_season"])
    assert plan.count("parseJson") == 2


def test_rules_are_not_judged_again_by_a_filter_on_the_list_of_findings(spark, small):
    assert "size(CASE" not in optimized(schemas.findings(rawbed.envelopes(small), schemas.documents()))
    a, b = (spark.createDataFrame(rows, "k INT, v INT") for rows in ([(1, 1), (2, 2)], [(1, 3), (3, 3)]))
    found = diff.keyed_diff(a, b, ["k"])
    assert "size(CASE" not in optimized(found)
    assert sorted((r["k"], r["change"]) for r in found.collect()) == [(1, "changed"), (2, "removed"), (3, "added")]


def test_rows_are_joined_to_their_parents_without_a_search_for_lost_keys(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id INT, p INT")
    parent = spark.createDataFrame([(10,), (10,), (None,)], "id INT")
    for null_counts, expected in ((False, {2}), (True, {2, 3})):
        check = C.orphans("fk", "child", C.Ref("p", ("p",), "parent", ("id",), null_counts))
        found = failrows.tagged("child", [check], {"child": child, "parent": parent})
        assert {r["id"] for r in found.collect() if r["violations"]} == expected
        assert found.count() == 3
        assert optimized(found).count("LogicalRDD") == 2


def test_a_batch_joins_its_matches_to_their_scores_once(spark, small, tmp_path):
    star = star_tables(small, True)
    upkeep.add_batch(star["fact_match"], star["fact_match_score"], str(tmp_path), "0")
    assert spark.read.parquet(f"{tmp_path}/scored").count() == star["fact_match"].count()


def test_marts_are_counted_where_they_are_checked(spark, small, monkeypatch):
    monkeypatch.setattr(dispatch.R, "row_counts", lambda *_: 1 / 0)
    sizes = catalog.QUERIES["run_post_sizes"](spark, small.folder).collect()
    assert len(sizes) == 6
    assert {r["rows"] == 0 for r in sizes if r["run_id"] == "exp_without_rows"} == {True}

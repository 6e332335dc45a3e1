"""Check semantics on small hand-written tables, and fusion against one query per check."""

import pytest
from conftest import failed

from dqloom.functions import rules as R
from dqloom.operators import checks as C
from dqloom.operators import fusion, keys
from dqloom.operators.checks import Ref
from dqloom.plans import suites, testbed
from dqloom.plans.tables import MATCH_STATUSES


def count(check, **tables):
    (row,) = fusion.evaluate("s", "T", [check], tables).collect()
    return row["rows_failed"]


def test_null_keys_form_a_group_only_when_asked(spark):
    t = spark.createDataFrame([(None,), (None,), (1,), (1,), (2,)], "id BIGINT")
    assert count(C.duplicate_groups("u", "t", "id"), t=t) == 2
    assert count(C.duplicate_groups("u", "t", "id", count_null_keys=False), t=t) == 1
    assert count(C.duplicate_groups("u", "t", "id", wide=True), t=t) == 2
    assert count(C.duplicate_groups("u", "t", "id", count_null_keys=False, wide=True), t=t) == 1


def test_null_is_in_every_set(spark):
    t = spark.createDataFrame([("FINISHED",), ("NOPE",), (None,)], "status STRING")
    assert count(C.rows_where("s", "t", R.not_in("status", MATCH_STATUSES)), t=t) == 1


def test_text_numbers_never_fail_the_job(spark):
    t = spark.createDataFrame([("12",), ("-1",), ("abc",), ("999",), (None,), ("9" * 60,)], "d STRING")
    assert count(C.rows_where("d", "t", R.digits_outside("d", 0, 60)), t=t) == 4


def test_zero_denominator_is_no_violation(spark):
    t = spark.createDataFrame([(0, 0), (3, 0), (3, 2), (1, 2)], "won INT, played INT")
    assert count(C.rows_where("r", "t", R.ratio_outside("won", "played")), t=t) == 1


def test_foreign_keys(spark):
    child = spark.createDataFrame([(None,), (1,), (9,), (1,)], "fk BIGINT")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "id BIGINT")
    ref = Ref("p", ("fk",), "parent", ("id",))
    strict = Ref("p", ("fk",), "parent", ("id",), null_is_orphan=True)
    assert count(C.orphans("f", "child", ref), child=child, parent=parent) == 1
    assert count(C.orphans("f", "child", strict), child=child, parent=parent) == 2
    for r, n in ((ref, 1), (strict, 2)):
        assert fusion.failing_rows(C.orphans("f", "child", r), {"child": child, "parent": parent}).count() == n


def test_empty_table(spark):
    t = spark.createDataFrame([], "id INT")
    assert count(C.not_empty("n", "t"), t=t) == 1
    assert count(C.not_empty("n", "t"), t=spark.range(1)) == 0


def test_completeness_counts_keys_and_exclusivity_counts_rows(spark):
    source = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k BIGINT, v STRING")
    target = spark.createDataFrame([(1, "a"), (7, "x"), (7, "x")], "k BIGINT, v STRING")
    both = ("k", "v")
    assert count(C.all_loaded("c", "s", both, "t", both), s=source, t=target) == 2
    assert count(C.none_invented("x", "t", both, "s", both), s=source, t=target) == 2
    (row,) = keys.unmatched_summary(source, both, target, both).collect()
    assert (row["missing"], row["src_count"]) == (2, 3)
    lost = fusion.failing_rows(C.none_invented("x", "t", both, "s", both), {"s": source, "t": target})
    assert [tuple(r) for r in lost.collect()] == [(7, "x"), (7, "x")]


def test_severity_decides_the_status(spark):
    t = spark.createDataFrame([(1,)], "x INT")
    bad = C.rows_where("b", "t", "x = 1")
    rows = fusion.evaluate("s", "T", [bad, bad.warning(), C.rows_where("g", "t", "x = 2")], {"t": t}).collect()
    assert sorted(r["status"] for r in rows) == ["FAIL", "PASS", "WARN"]


def test_broken_checks_are_errors_and_count_as_failed(spark):
    t = spark.createDataFrame([(1,)], "x INT")
    checks = [C.rows_where("good", "t", "x = 2"), C.rows_where("column", "t", "nope = 1"), C.rows_where("table", "missing", "x = 1")]
    results = fusion.evaluate("s", "T", checks, {"t": t})
    assert {r["check_name"]: (r["status"], r["rows_failed"]) for r in results.collect()} == {
        "good": ("PASS", 0),
        "column": ("ERROR", -1),
        "table": ("ERROR", -1),
    }
    (total,) = fusion.tally(results).collect()
    assert (total["checks_total"], total["checks_failed"], total["status"]) == (3, 2, "FAILED")


def test_a_check_that_dies_at_run_time_is_isolated(spark):
    t = spark.createDataFrame([("a",)], "x STRING")
    checks = [C.rows_where("good", "t", "x = 'a'"), C.rows_where("strict", "t", "cast(x AS INT) = 1")]
    rows = fusion.collect_results("s", "T", checks, {"t": t})
    assert {r["check_name"]: r["status"] for r in rows} == {"good": "FAIL", "strict": "ERROR"}


@pytest.mark.parametrize("suite", sorted(suites.ENTITY_SUITES))
def test_fused_equals_one_by_one_and_fail_rows(small, suite):
    tables = testbed.entity_tables(small, True)
    for stage, checks in suites.ENTITY_SUITES[suite].stages.items():
        fused = {r["check_name"]: r["rows_failed"] for r in fusion.evaluate(suite, stage, checks, tables).collect()}
        assert set(fused) == {c.name for c in checks}
        for check in checks:
            assert count(check, **{n: tables[n] for n in check.tables()}) == fused[check.name], check.name
            assert fusion.failing_rows(check, tables).count() == fused[check.name], check.name


def test_suite_sizes():
    sizes = {(s.name, stage): len(checks) for s in suites.ENTITY_SUITES.values() for stage, checks in s.stages.items()}
    assert sizes == {
        ("gx", "E"): 15, ("gx", "T"): 19, ("gx", "L"): 3,
        ("soda", "E"): 7, ("soda", "T"): 5, ("soda", "L"): 3,
        ("sql", "E"): 11, ("sql", "T"): 7, ("sql", "L"): 3,
        ("deequ", "E"): 17, ("deequ", "T"): 10, ("deequ", "L"): 5,
    }
    star = {(s.name, stage): len(checks) for s in suites.STAR_SUITES.values() for stage, checks in s.stages.items()}
    assert star["stage", "E"] == 4 and star["stage", "T"] == 10 and star["stage", "L"] == 7
    assert star["constraints", "T"] == 6 and star["post", "POST"] == 10
    assert star["dbt", "T"] == 4 and star["dbt", "L"] == 3 and len(suites.DBT.select("post")) == 10


def test_hot_keys_are_counted_whole(spark):
    # A third of the rows share one key; the counts stay exact and the shuffle carries one row per key and task.
    rows = spark.range(30000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "id AS v")
    parent = spark.range(30000)
    ref = Ref("p", ("k",), "parent", ("id",))
    assert count(C.orphans("f", "rows", ref), rows=rows, parent=parent) == 10000
    assert fusion.failing_rows(C.orphans("f", "rows", ref), {"rows": rows, "parent": parent}).count() == 10000
    assert count(C.duplicate_groups("u", "rows", "k"), rows=rows) == 1
    first = keys.first_per_key(rows, ["k"], ["v"])
    assert first.count() == 20001 and first.filter("k = -1").first()["v"] == 0


def test_quarantine_split(small):
    table = testbed.matches(small, True)
    split = fusion.split_by_constraints(table, [C.rows_where("day", "m", suites.MATCHDAY), C.rows_where("team", "m", suites.NO_TEAM)])
    assert split.count() == table.count()
    assert split.filter("array_contains(violations, 'day')").count() == table.filter(suites.MATCHDAY).count()


def test_verdicts_do_not_depend_on_scale(spark):
    from conftest import MEDIUM, SMALL

    found = []
    for folder in (SMALL, MEDIUM):
        tables = testbed.entity_tables(testbed.Tables(spark, folder), True)
        rows = fusion.evaluate("sql", "T", suites.SQL.checks("T"), tables).collect()
        found.append(set(failed(rows)))
    assert found[0] == found[1]


def test_first_row_of_a_key_is_deterministic(spark):
    rows = [(1, "b", 2), (1, "a", 2), (1, "z", 1), (2, None, 5)]
    df = spark.createDataFrame(rows, "k INT, v STRING, ord INT")
    for parts in (1, 4):
        got = {r["k"]: r["v"] for r in keys.first_per_key(df.repartition(parts), ["k"], ["ord"]).collect()}
        assert got == {1: "z", 2: None}


def test_references_of_one_check_to_one_parent_add_up(spark):
    refs = (C.Ref("home", ("home",), "team", ("id",)), C.Ref("away", ("away",), "team", ("id",)))
    tables = {"game": spark.createDataFrame([(1, 9), (9, 1), (9, 9), (1, 1)], "home INT, away INT"), "team": spark.createDataFrame([(1,)], "id INT")}
    (row,) = fusion.evaluate("own", "T", [C.orphans("teams", "game", *refs)], tables).collect()
    assert row["rows_failed"] == 4


def test_source_completeness_says_how_many_of_how_many(spark):
    tables = {"source": spark.createDataFrame([(1,), (2,), (2,), (None,), (3,)], "id INT"), "target": spark.createDataFrame([(2,), (9,)], "id INT")}
    checks = [C.all_loaded("loaded", "source", ("id",), "target", ("id",)), C.none_invented("invented", "target", ("id",), "source", ("id",)), C.not_empty("there", "target")]
    found = {r["check_name"]: (r["rows_failed"], r["message"]) for r in fusion.evaluate("own", "T", checks, tables).collect()}
    assert found == {"loaded": (3, "3 missing of 4"), "invented": (1, None), "there": (0, None)}
    whole = fusion.evaluate("own", "T", [checks[0]], {**tables, "target": tables["source"].dropna()}).collect()
    assert [(r["status"], r["message"]) for r in whole] == [("FAIL", "1 missing of 4")]

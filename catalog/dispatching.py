"""Validation of all runs of a stage together."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from catalog import query
from catalog import sql as S
from catalog.experiments import DIFF_CTES
from catalog.suites import POST, STAR_EXPECTED
from dqloom.operators import ledger
from dqloom.plans import dispatch, loading, strategies, testbed
from dqloom.session import checkpoint_folder
from dqloom.sources import tables

# A staged run and its experiment, and three loads: of the run itself, with defects, and one that left no rows.
STAGED, CLEAN, DEFECTIVE, EMPTY = "staged", "base_run", "exp_defects", "exp_without_rows"
STRATEGY = strategies.Strategy("stages", {"T": ("stage", "constraints"), "L": ("stage",)})
_EVENTS = (("STG", STAGED, STAGED), ("STG", STAGED, "exp_staged"), ("DDS", STAGED, CLEAN), ("DDS", "exp_staged", DEFECTIVE), ("DDS", STAGED, EMPTY))


def _on_clean(sql: str) -> str:
    """A counting query over the tables of the run without defects."""
    known = "fact_match|fact_standing|dim_area|dim_competition|dim_season|dim_team|mart_kpi|mart_team"
    return re.sub(rf"\b(FROM|JOIN) ({known})\b", r"\1 \2_clean", sql)


def _expected(suites: list[tuple[str, str, dict[str, str]]]) -> str:
    """run_id, suite, stage, check_name, status and rows_failed of three runs."""
    rows = []
    for suite, stage, counts in suites:
        for name, sql in counts.items():
            for run, own in ((CLEAN, _on_clean(sql)), (DEFECTIVE, sql), (EMPTY, "SELECT 0")):
                rows.append(f"SELECT '{run}' AS run_id, '{suite}' AS suite, '{stage}' AS stage, '{name}' AS check_name, CAST(({own}) AS BIGINT) AS n")
    return (
        f"WITH {DIFF_CTES}, r AS ({' UNION ALL '.join(rows)}) SELECT run_id, suite, stage, check_name, "
        "CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n AS rows_failed FROM r"
    )


def _ledger(spark: SparkSession) -> str:
    """A fresh ledger in the shared folder that says what was staged and loaded."""
    root = f"{checkpoint_folder(spark)}/targets-{uuid.uuid4().hex}"
    rows = [ledger.batch_event(spark, "dag", run, parent, layer, ledger.SUCCESS) for layer, parent, run in _EVENTS]
    events = rows[0]
    for row in rows[1:]:
        events = events.unionByName(row)
    tables.append_ledger(events, loading.events_path(root))
    return root


def _stars(t) -> testbed.Lazy:
    """Tables that hold the rows of all loads."""
    clean, bad = testbed.star_tables(t, run_id=CLEAN), testbed.star_tables(t, True, run_id=DEFECTIVE)
    return testbed.Lazy({name: lambda name=name: clean[name].unionByName(bad[name]) for name in clean})


def _found(t, stage: str) -> DataFrame:
    stars = _stars(t)
    return dispatch.stage_results(t.spark, _ledger(t.spark), stage, STRATEGY, STAGED, lambda targets: stars, "dag")


def _stage(stage: str) -> str:
    return _expected([(suite, stage, STAR_EXPECTED[suite, stage]) for suite in STRATEGY.suites(stage)])


@query("run_stage_targets", _stage("T"))
def stage_targets(t):
    return _found(t, "T").select("run_id", "suite", "stage", "check_name", "status", "rows_failed")


@query(
    "run_stage_tally",
    f"""WITH v AS ({_stage("L")}), k AS (SELECT run_id, suite, stage, count(*) FILTER (status = 'FAIL') AS n FROM v GROUP BY ALL)
    SELECT stage, suite, count(*) AS runs, count(*) FILTER (n = 0) AS passed, count(*) FILTER (n > 0) AS failed,
    CAST(sum(n) AS BIGINT) AS checks_failed FROM k GROUP BY ALL""",
)
def stage_tally(t):
    return dispatch.tally(_found(t, "L"))


@query("run_post_targets", _expected([("post", "POST", POST)]))
def post_targets(t):
    stars = _stars(t)
    found, _ = dispatch.post_results(t.spark, _ledger(t.spark), lambda targets: stars, "dag")
    return found.select("run_id", "suite", "stage", "check_name", "status", "rows_failed")


_SIZES = " UNION ALL ".join(
    f"SELECT '{run}' AS run_id, '{name}' AS \"table\", {f'(SELECT count(*) FROM {name}{suffix})' if suffix is not None else 'CAST(0 AS BIGINT)'} AS rows"
    for name in dispatch.POST_MARTS
    for run, suffix in ((CLEAN, "_clean"), (DEFECTIVE, ""), (EMPTY, None))
)


@query("run_post_sizes", f"WITH {DIFF_CTES} {_SIZES}")
def post_sizes(t):
    stars = _stars(t)
    return dispatch.post_results(t.spark, _ledger(t.spark), lambda targets: stars, "dag")[1]

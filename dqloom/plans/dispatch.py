"""Validation of every run that a stage has to look at, with ledger rows and a tally.

Ledger rows are appended next to the tables: ``<root>/_batch_events``, ``<root>/_validation_runs`` and
``<root>/_check_results``.  All runs of a suite are evaluated together, with the run as a grouping key, and their
ledger rows are one append each: the number of jobs and of ledger files does not grow with the number of runs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.functions import routing
from dqloom.operators import checks as C
from dqloom.operators import fusion, ledger
from dqloom.operators import runs as R
from dqloom.operators.checks import Check
from dqloom.plans.loading import events_path
from dqloom.plans.strategies import Strategy
from dqloom.plans.suites import ENTITY_SUITES, POST, STAR_SUITES
from dqloom.session import cut_lineage
from dqloom.sources import tables

Tables = Mapping[str, DataFrame]
POST_LAYER = "POST"
POST_MARTS = ("mart_kpi", "mart_team")
# What is counted beside the checks; it has no ledger rows.
SIZES = "sizes"
FOUND = "run_id STRING, suite STRING, stage STRING, check_name STRING, rule_group STRING, severity STRING, status STRING, rows_failed BIGINT, message STRING"


def runs_path(root: str) -> str:
    return f"{root.rstrip('/')}/_validation_runs"


def results_path(root: str) -> str:
    return f"{root.rstrip('/')}/_check_results"


def layer_of(stage: str, suite: str) -> str:
    return f"{stage}_{suite.upper()}"


def _state(spark: SparkSession, root: str) -> DataFrame:
    """The state of all runs, stored once, as finding the targets looks at it from many sides."""
    return cut_lineage(ledger.batch_state(spark.read.parquet(events_path(root))))


def _verdicts(found: DataFrame) -> DataFrame:
    """``run_id, suite, stage, checks_total, checks_failed, status`` of stored results."""
    failed = F.count_if(F.col("status").isin(C.FAIL, C.BROKEN))
    return found.groupBy("run_id", "suite", "stage").agg(
        F.count(F.lit(1)).alias("checks_total"),
        failed.alias("checks_failed"),
        F.when(failed == 0, ledger.SUCCESS).otherwise(ledger.FAILED).alias("status"),
    )


def _store(found: DataFrame, root: str, dag_id: str, parent: str, layer: str, repeat: int, seconds: float) -> None:
    """Append one row per run and one per check of it; the time of the pass is divided among its runs."""
    key = ledger.validation_run_id(F.lit(dag_id), F.col("run_id"), F.lit(layer), F.lit(str(repeat)))
    heads, now = _verdicts(found), F.localtimestamp()
    share = heads.agg(F.lit(int(seconds * 1000)) / F.count(F.lit(1))).scalar().cast("bigint")
    tables.append_ledger(
        heads.withColumn("duration_ms", share).select(
            key.alias("validation_run_id"),
            F.lit(dag_id).alias("dag_id"),
            "run_id",
            F.lit(parent).alias("parent_run_id"),
            F.lit(layer).alias("layer"),
            F.col("suite").alias("tool"),
            F.col("stage").alias("suite"),
            routing.run_kind(F.col("run_id")).alias("kind"),
            "status",
            (now - F.make_dt_interval(secs=F.col("duration_ms") / 1000)).alias("started_at"),
            now.alias("finished_at"),
            "duration_ms",
            "checks_total",
            "checks_failed",
        ),
        runs_path(root),
    )
    tables.append_ledger(
        found.select(
            key.alias("validation_run_id"),
            "check_name",
            F.col("rule_group").alias("rule_type"),
            F.col("stage").alias("etl_stage"),
            "status",
            "severity",
            "rows_failed",
            F.col("rows_failed").cast("string").alias("observed_value"),
            F.lit("0").alias("expected_value"),
            "message",
        ),
        results_path(root),
    )


def _validate(
    spark: SparkSession, root: str, targets: DataFrame, suite: str, stage: str, checks: tuple[Check, ...], tables_of, dag_id: str, parent: str, layer: str, repeats: int,
    counted: Sequence[fusion.Placed] = (),
) -> DataFrame:
    """Results of all repeats over all targets (``run_id``), with their events and ledger rows; ``counted`` is evaluated beside them."""

    def log(rows: DataFrame, status, error: str | None = None) -> None:
        tables.append_ledger(ledger.run_events(rows, dag_id, parent, layer, status, error), events_path(root))

    log(targets, F.lit(ledger.PROCESSING))
    placed = [*(fusion.Placed(suite, stage, check) for check in checks), *counted]
    own, parts = F.col("suite") == suite, []
    try:
        given = tables_of(targets)
        for repeat in range(1, repeats + 1):
            started = time.perf_counter()
            found = R.evaluated(placed, given, targets)
            _store(found.filter(own), root, dag_id, parent, layer, repeat, time.perf_counter() - started)
            parts.append(found)
    except PySparkException as error:
        log(targets, F.lit(ledger.FAILED), str(error))
        raise
    found = reduce(DataFrame.unionByName, parts).filter(own)
    good = F.count_if(F.col("status").isin(C.FAIL, C.BROKEN)) == 0
    log(found.groupBy("run_id").agg(F.when(good, ledger.SUCCESS).otherwise(ledger.FAILED).alias("outcome")), F.col("outcome"))
    return reduce(DataFrame.unionByName, [part.withColumn("repeat_no", F.lit(i)) for i, part in enumerate(parts, 1)])


def tally(found: DataFrame) -> DataFrame:
    """``stage, suite, runs, passed, failed, checks_failed`` of results with ``repeat_no``."""
    each = found.groupBy("run_id", "repeat_no", "suite", "stage").agg(F.count_if(F.col("status").isin(C.FAIL, C.BROKEN)).alias("n"))
    return each.groupBy("stage", "suite").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("n") == 0).alias("passed"),
        F.count_if(F.col("n") > 0).alias("failed"),
        F.sum("n").alias("checks_failed"),
    )


def stage_results(
    spark: SparkSession, root: str, stage: str, strategy: Strategy, baseline_stg: str, tables_of: Callable[[DataFrame], Tables], dag_id: str
) -> DataFrame:
    """Evaluate a stage's suites on the baseline and its experiments and record the outcome; returns all results.

    ``tables_of`` gets the targets (``run_id``, ``stg_run_id``, ``dds_run_id``; one row each) and gives tables that
    hold the rows of all of them, told apart by ``run_id``.  With a strategy that skips processed runs, a suite leaves
    out the runs it has finished.  A run in which a check cannot be carried out has an ERROR and stops no other.
    """
    suites = {**ENTITY_SUITES, **STAR_SUITES}
    parts = [spark.createDataFrame([], f"{FOUND}, repeat_no INT")]
    for suite in strategy.suites(stage):
        layer, checks = layer_of(stage, suite), suites[suite].checks(stage)
        targets = cut_lineage(
            ledger.stage_targets(_state(spark, root), stage, baseline_stg, None, strategy.include_experiments, strategy.skip_processed, layer)
        )
        if checks and not targets.isEmpty():
            parts.append(_validate(spark, root, targets, suite, stage, checks, tables_of, dag_id, baseline_stg, layer, strategy.runs))
    return reduce(DataFrame.unionByName, parts)


def run_stage_targets(
    spark: SparkSession, root: str, stage: str, strategy: Strategy, baseline_stg: str, tables_of: Callable[[DataFrame], Tables], dag_id: str
) -> DataFrame:
    """``stage_results`` as a tally per suite."""
    return tally(stage_results(spark, root, stage, strategy, baseline_stg, tables_of, dag_id))


def post_results(
    spark: SparkSession, root: str, tables_of: Callable[[DataFrame], Tables], dag_id: str, baseline_stg: str | None = None, only_unprocessed: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The post-load suite on every loaded run not validated yet; returns the results and ``run_id, table, rows`` of the marts."""
    targets = ledger.post_targets(_state(spark, root), baseline_stg, only_unprocessed, POST_LAYER)
    targets = cut_lineage(targets.withColumn("run_id", F.col("dds_run_id")))
    first = targets.first()
    if first is None:
        return spark.createDataFrame([], f"{FOUND}, repeat_no INT"), spark.createDataFrame([], "run_id STRING, table STRING, rows BIGINT")
    # all targets descend from one baseline; the marts are counted where they are checked, and not built again for it
    counted = [fusion.Placed(SIZES, "POST", C.rows_where(name, name, "true")) for name in POST_MARTS]
    checks, parent = POST.checks("POST"), first["baseline_stg_run_id"]
    found = _validate(spark, root, targets, "post", "POST", checks, tables_of, dag_id, parent, POST_LAYER, 1, counted)
    sizes = found.filter(F.col("suite") == SIZES)
    if not sizes.filter(F.col("status") == C.BROKEN).isEmpty():
        given = tables_of(targets)
        sizes = R.row_counts({n: given[n] for n in POST_MARTS}, targets)
    else:
        sizes = sizes.select("run_id", F.col("check_name").alias("table"), F.col("rows_failed").alias("rows"))
    return found.filter(F.col("suite") != SIZES), sizes


def run_post_targets(
    spark: SparkSession, root: str, tables_of: Callable[[DataFrame], Tables], dag_id: str, baseline_stg: str | None = None, only_unprocessed: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``post_results`` with a tally instead of the single results."""
    found, sizes = post_results(spark, root, tables_of, dag_id, baseline_stg, only_unprocessed)
    return tally(found), sizes

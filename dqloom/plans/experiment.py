"""Mutation experiments: baseline, mutated iterations, checks and comparisons.

The baseline is immutable, so nothing is restored or rewritten between iterations: a table-level iteration is a
chain of lazy transforms, a payload-level one is stored as a run of its own.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.functions import routing
from dqloom.operators import checks as C
from dqloom.operators import deltas, diff, flatten, fusion, ledger, marts, mutations
from dqloom.operators.ledger import validation_run_id
from dqloom.plans import native
from dqloom.plans.strategies import STAGES, Strategy
from dqloom.plans.suites import ENTITY_SUITES, STAR_SUITES
from dqloom.session import checkpoint_folder
from dqloom.sources import envelopes as E
from dqloom.sources import tables

BASELINE = "baseline"
# The kinds of iterations.
KINDS = ("stg_mutation", "dds_mutation", "snapshot")


@dataclass(frozen=True)
class Iteration:
    """One experiment: (entity, action) payload-level defects, then table-level ones.

    ``kind``: ``stg_mutation`` copies, gates and loads a staged run, ``dds_mutation`` loads the staged run itself,
    ``snapshot`` loads it without defects and gates.  ``from_run`` names another staged run than the baseline's, and
    ``validations`` switches single validators and checks on or off.
    """

    name: str
    staging: tuple[tuple[str, str], ...] = ()
    loading: tuple[str, ...] = ()
    swaps: int = mutations.SWAP_COUNT
    seed: str | None = None
    kind: str = "stg_mutation"
    from_run: str | None = None
    validations: Mapping[str, bool] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of iteration: {self.kind}")

    def off(self) -> list[str]:
        return [name for name, on in self.validations.items() if not on]

    def entity_mutations(self) -> list[mutations.Mutation]:
        changes = [mutations.entity_mutation(action, entity, self.swaps, self.seed) for entity, action in self.staging]
        return changes + [mutations.entity_mutation(action) for action in self.loading]

    def star_mutations(self, run_id: str) -> list[mutations.Mutation]:
        return [mutations.star_mutation(action, run_id) for action in self.loading]


def plan_from_config(config: Mapping) -> tuple[Iteration, ...]:
    """Iterations from a parsed mutation plan (``experiment: {iterations: [...]}``)."""
    out = []
    for item in config["experiment"].get("iterations") or ():
        enabled = item.get("stg_mutations_enable") or {}
        staging = tuple((entity, action) for entity, actions in enabled.items() for action in actions)
        env = item.get("env") or {}
        swaps = next((int(v) for k, v in env.items() if k.endswith("SWAP_TEAMS_COUNT")), mutations.SWAP_COUNT)
        switches = {**(item.get("stg_validation_overrides") or {}), **(item.get("dds_validation_overrides") or {})}
        kind = (item.get("kind") or KINDS[0]).strip().lower()
        loading = tuple(item.get("dds_mutations_enable") or ())
        out.append(Iteration(item["name"], staging, loading, swaps, None, kind, item.get("from_stg_run_id"), switches))
    return tuple(out)


def entity_changes(tables: Mapping[str, DataFrame], iteration: Iteration) -> dict[str, deltas.Change]:
    """What an iteration changes.  Mutations that build on each other are not told apart: all their tables count as changed."""
    steps = [(action, entity) for entity, action in iteration.staging] + [(action, "matches") for action in iteration.loading]
    if len(steps) == 1:
        (action, entity), seeded = steps[0], bool(iteration.staging)
        return deltas.entity_change(tables, action, entity, iteration.swaps if seeded else None, iteration.seed if seeded else None)
    before = {name: tables[name] for name in tables}
    return deltas.whole_changes(before, mutations.apply(before, *iteration.entity_mutations()))


def run_entity_plan(tables: Mapping[str, DataFrame], plan: Sequence[Iteration], strategy: Strategy) -> DataFrame:
    """Results of the baseline and of every iteration, as one frame.

    The tables are evaluated once; an iteration's results follow from the rows it changes (``operators.deltas``).
    """
    suites = {**ENTITY_SUITES, **STAR_SUITES}
    placed = [
        fusion.Placed(suite, stage, check) for stage in STAGES for suite in strategy.suites(stage) for check in suites[suite].checks(stage)
    ]
    changes = {it.name: entity_changes(tables, it) for it in plan}
    return deltas.evaluate(placed, tables, changes, BASELINE).withColumnRenamed(deltas.VERSION, "mutation")


@dataclass
class PayloadOutcome:
    """What became of one payload-level iteration."""

    name: str
    stopped_at: str | None
    results: list
    star: dict[str, DataFrame] | None = None
    changes: dict[str, DataFrame] | None = None


def run_payload_iteration(
    envelopes: DataFrame,
    source_run: str,
    iteration: Iteration,
    baseline_marts: Mapping[str, DataFrame] | None = None,
    staging: bool = True,
    skip_gates: Sequence[str] = (),
    root: str | None = None,
    dag_id: str = "experiments",
) -> PayloadOutcome:
    """Copy a staged run with defects, gate it, load it with more defects, gate again, compare the marts.

    The copy and its star are stored once below ``root`` (by default a fresh folder in the cluster's shared one), and
    all gates of a phase are evaluated over the stored rows in one pass.  Results end with the first gate that fails
    (``skip_gates`` leaves some out).  Every mutation is recorded in the audit as MUTATED.
    """
    spark = envelopes.sparkSession
    run_id = f"{routing.EXPERIMENT_PREFIX}{iteration.name.replace(' ', '_')}"
    root = root or f"{checkpoint_folder(spark)}/experiments-{uuid.uuid4().hex}"

    def mutate(copied: DataFrame) -> DataFrame:
        for entity, action in iteration.staging:
            seed = iteration.seed or mutations.mutation_seed(run_id, "STG", entity, action)
            copied = mutations.mutate_payloads(copied, entity, action, iteration.swaps, seed)
        return copied

    source_run = iteration.from_run or source_run
    copied = envelopes.filter(F.col("run_id") == source_run)
    if iteration.kind == "stg_mutation":
        tables.append_envelopes(E.copy_run(envelopes, source_run, run_id, mutate), f"{root}/envelopes")
        copied = tables.read_envelopes(spark, f"{root}/envelopes", run_id)
        _record(spark, root, dag_id, run_id, [("STG", entity, action) for entity, action in iteration.staging])
    rows: list = []
    enabled = ~F.col("check_name").isin(iteration.off())
    if staging and iteration.kind == "stg_mutation":
        found = native.ingestion_results(copied).unionByName(native.payload_results(copied)).filter(enabled)
        rows, stopped = native.until_failure(found, [g for g in ("ingestion", *native.PAYLOAD_SUITES) if g not in skip_gates], "suite")
        if stopped:
            return PayloadOutcome(iteration.name, stopped, rows)
    changed = iteration.star_mutations(run_id) if iteration.kind != "snapshot" else []
    loaded = mutations.apply(flatten.load_star(copied, run_id), *changed)
    tables.save_run(loaded, f"{root}/star", run_id)
    _record(spark, root, dag_id, run_id, [("DDS", action, action) for action in iteration.loading if changed])
    star = tables.read_run(spark, f"{root}/star", list(loaded), run_id)
    more: list = []
    if iteration.kind != "snapshot":
        placed = [fusion.Placed("native", gate, check) for gate, checks in native.STAR_GATES.items() for check in checks]
        found = fusion.evaluate_placed(placed, native.star_inputs(star, copied)).filter(enabled)
        more, stopped = native.until_failure(found, [g for g in native.STAR_GATES if g not in skip_gates], "stage")
        if stopped:
            return PayloadOutcome(iteration.name, stopped, rows + more, star)
    made = marts.add_marts(star)
    changes = diff.compare_marts(dict(baseline_marts), made, marts.MART_KEYS) if baseline_marts else None
    return PayloadOutcome(iteration.name, None, rows + more, star, changes)


def _record(spark: SparkSession, root: str, dag_id: str, run_id: str, done: Sequence[tuple[str, str, str]]) -> None:
    """Audit rows of the mutations applied to a run."""
    rows = [(dag_id, run_id, None, layer, f"{layer}_mutation_{entity}", mutations.MUTATED, None, None, None, action) for layer, entity, action in done]
    if rows:
        tables.append_ledger(ledger.audit_rows(spark.createDataFrame(rows, ledger.AUDIT_SCHEMA)), f"{root}/_audit")


def compare_iterations(outcomes: Sequence[PayloadOutcome], spark: SparkSession | None = None) -> DataFrame:
    """``iteration, stopped_at, mart, change, rows``: mart differences of the iterations that passed their gates.

    An iteration that stopped has one row that names the gate; one without differences has none.
    """
    spark = spark or SparkSession.active()
    stopped = [(o.name, o.stopped_at, None, None, None) for o in outcomes if o.stopped_at]
    parts = [spark.createDataFrame(stopped, "iteration STRING, stopped_at STRING, mart STRING, change STRING, rows BIGINT")]
    for outcome in outcomes:
        for mart, changes in (outcome.changes or {}).items():
            totals = diff.diff_totals(changes, marts.MART_KEYS[mart])
            parts.append(totals.select(F.lit(outcome.name).alias("iteration"), F.lit(None).cast("string").alias("stopped_at"), F.lit(mart).alias("mart"), "change", "rows"))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class StageRun:
    """One measured evaluation of one suite at one stage."""

    run_id: str
    suite: str
    stage: str
    repeat_no: int
    status: str
    checks_total: int
    checks_failed: int
    seconds: float
    results: list[dict]


def run_stage(tables: Mapping[str, DataFrame], stage: str, strategy: Strategy, run_id: str) -> list[StageRun]:
    """Evaluate a stage's suites as often as the strategy says; each repeat is planned afresh."""
    known = {**ENTITY_SUITES, **STAR_SUITES}
    runs = []
    for suite in strategy.suites(stage):
        checks = known[suite].checks(stage)
        if not checks:
            continue
        for repeat in range(1, strategy.runs + 1):
            started = time.perf_counter()
            rows = fusion.collect_results(suite, stage, checks, tables)
            failed = sum(r["status"] in (C.FAIL, C.BROKEN) for r in rows)
            status = "SUCCESS" if failed == 0 else "FAILED"
            took = time.perf_counter() - started
            runs.append(StageRun(run_id, suite, stage, repeat, status, len(rows), failed, took, rows))
    return runs


def ledger_rows(spark: SparkSession, runs: Sequence[StageRun], dag_id: str, parent_run_id: str) -> tuple[DataFrame, DataFrame]:
    """Stage runs as ledger frames: validation runs and their check results."""
    head = [
        (r.run_id, r.suite, r.stage, r.repeat_no, r.status, r.checks_total, r.checks_failed, int(r.seconds * 1000)) for r in runs
    ]
    base = spark.createDataFrame(
        head,
        "run_id STRING, tool STRING, stage STRING, repeat_no INT, status STRING, checks_total BIGINT, checks_failed BIGINT, "
        "duration_ms BIGINT",
    )
    layer = F.concat_ws("_", "stage", F.upper("tool"))
    key = validation_run_id(F.lit(dag_id), F.col("run_id"), layer, F.col("repeat_no").cast("string"))
    now = F.localtimestamp()
    runs_frame = base.select(
        key.alias("validation_run_id"),
        F.lit(dag_id).alias("dag_id"),
        "run_id",
        F.lit(parent_run_id).alias("parent_run_id"),
        layer.alias("layer"),
        "tool",
        F.col("stage").alias("suite"),
        routing.run_kind(F.col("run_id")).alias("kind"),
        "status",
        (now - F.make_dt_interval(secs=F.col("duration_ms") / 1000)).alias("started_at"),
        now.alias("finished_at"),
        "duration_ms",
        "checks_total",
        "checks_failed",
    )
    details = [
        (r.run_id, r.suite, r.stage, r.repeat_no, x["check_name"], x["rule_group"], x["status"], x["severity"], x["rows_failed"], x["message"])
        for r in runs
        for x in r.results
    ]
    checks = spark.createDataFrame(
        details,
        "run_id STRING, tool STRING, stage STRING, repeat_no INT, check_name STRING, rule_type STRING, status STRING, "
        "severity STRING, rows_failed BIGINT, message STRING",
    )
    return runs_frame, checks.select(
        key.alias("validation_run_id"),
        "check_name",
        "rule_type",
        F.col("stage").alias("etl_stage"),
        "status",
        "severity",
        "rows_failed",
        F.col("rows_failed").cast("string").alias("observed_value"),
        F.lit("0").alias("expected_value"),
        "message",
    )

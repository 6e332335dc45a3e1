"""Run ledger on append-only tables.

Events are only ever appended; the current state of a run is an aggregate over
its events.  ``max_by`` keeps that a map-side-combined aggregate, so a run with
very many events does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqloom.functions import routing
from dqloom.operators.keys import first_per_key

# Ledger layouts and the states of a run.
BATCH_EVENT_SCHEMA = (
    "dag_id STRING, run_id STRING, parent_run_id STRING, layer STRING, status STRING, error_message STRING, "
    "event_ts TIMESTAMP_NTZ, seq BIGINT"
)
AUDIT_SCHEMA = (
    "dag_id STRING, run_id STRING, task_id STRING, layer STRING, entity_name STRING, status STRING, "
    "started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ, rows_processed BIGINT, message STRING"
)
RUN_SCHEMA = (
    "validation_run_id STRING, dag_id STRING, run_id STRING, parent_run_id STRING, layer STRING, tool STRING, "
    "suite STRING, kind STRING, status STRING, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ, duration_ms BIGINT, "
    "checks_total BIGINT, checks_failed BIGINT, rows_checked BIGINT, rows_failed BIGINT, report_path STRING, "
    "config_hash STRING, meta_json STRING"
)
CHECK_SCHEMA = (
    "validation_run_id STRING, check_name STRING, rule_type STRING, etl_stage STRING, status STRING, severity STRING, "
    "started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ, duration_ms BIGINT, rows_failed BIGINT, observed_value STRING, "
    "expected_value STRING, message STRING, details MAP<STRING,STRING>"
)
NEW, PROCESSING, SUCCESS, FAILED, ENDED = "NEW", "PROCESSING", "SUCCESS", "FAILED", "ENDED"
DONE = (SUCCESS, PROCESSING)
# SQL LIKE, so the underscore matches any character.
EXPERIMENT_RUN = "run_id LIKE 'exp_%'"
RUN_KEY = ["layer", "parent_run_id", "run_id"]


def batch_state(events: DataFrame) -> DataFrame:
    """Latest status per run with attempt count, creation and update time."""
    order = "struct(event_ts, seq)"
    return events.groupBy(*RUN_KEY).agg(
        F.expr(f"max_by(dag_id, {order}) AS dag_id"),
        F.expr(f"max_by(status, {order}) AS status"),
        F.expr(f"max_by(error_message, {order}) AS error_message"),
        F.expr("count_if(status = 'PROCESSING') AS attempts"),
        F.expr("min(event_ts) AS created_at"),
        F.expr("max(event_ts) AS last_updated_at"),
    )


# What a state needs of past events: the newest of them and what adds up.
PARTIAL_SCHEMA = (
    "layer STRING, parent_run_id STRING, run_id STRING, newest STRUCT<event_ts: TIMESTAMP_NTZ, seq: BIGINT, dag_id: STRING, "
    "status: STRING, error_message: STRING>, attempts BIGINT, created_at TIMESTAMP_NTZ"
)


def partial_state(events: DataFrame) -> DataFrame:
    """One mergeable row per run of some events."""
    return events.groupBy(*RUN_KEY).agg(
        F.expr("max(struct(event_ts, seq, dag_id, status, error_message)) AS newest"),
        F.expr("count_if(status = 'PROCESSING') AS attempts"),
        F.expr("min(event_ts) AS created_at"),
    )


def merged_states(partials: DataFrame) -> DataFrame:
    """One mergeable row per run of several."""
    return partials.groupBy(*RUN_KEY).agg(F.max("newest").alias("newest"), F.sum("attempts").alias("attempts"), F.min("created_at").alias("created_at"))


def finished_state(partials: DataFrame) -> DataFrame:
    """``batch_state`` from mergeable rows."""
    newest = ("dag_id", "status", "error_message")
    return partials.select(*RUN_KEY, *(F.col(f"newest.{c}").alias(c) for c in newest), "attempts", "created_at", F.col("newest.event_ts").alias("last_updated_at"))


def batch_event(spark, dag_id: str, run_id: str, parent_run_id: str, layer: str, status: str, error: str | None = None) -> DataFrame:
    """One event row, ready to be appended."""
    row = [(dag_id, run_id, parent_run_id, layer, status, error)]
    base = spark.createDataFrame(row, "dag_id STRING, run_id STRING, parent_run_id STRING, layer STRING, status STRING, error_message STRING")
    return base.select("*", F.localtimestamp().alias("event_ts"), F.lit(0).cast("bigint").alias("seq"))


def run_events(runs: DataFrame, dag_id: str, parent_run_id: str, layer: str, status: Column, error: str | None = None) -> DataFrame:
    """One event per row of ``runs`` (``run_id``), ready to be appended together."""
    return runs.select(
        F.lit(dag_id).alias("dag_id"),
        "run_id",
        F.lit(parent_run_id).alias("parent_run_id"),
        F.lit(layer).alias("layer"),
        status.alias("status"),
        F.lit(error).cast("string").alias("error_message"),
        F.localtimestamp().alias("event_ts"),
        F.lit(0).cast("bigint").alias("seq"),
    )


def _of(state: DataFrame, layer: str, *statuses: str) -> DataFrame:
    return state.filter((F.col("layer") == layer) & F.col("status").isin(*statuses))


def pending_loads(state: DataFrame) -> DataFrame:
    """Successfully staged runs nobody has loaded or is loading: ``parent_run_id``."""
    taken = _of(state, "DDS", *DONE).select("parent_run_id")
    staged = _of(state, "STG", SUCCESS).select(F.col("run_id").alias("parent_run_id"))
    return staged.join(taken, "parent_run_id", "left_anti")


def claim_events(state: DataFrame, dag_id: str, dds_run_id: str) -> DataFrame:
    """The NEW events that claim all pending runs for one load."""
    return pending_loads(state).select(
        F.lit(dag_id).alias("dag_id"),
        F.lit(dds_run_id).alias("run_id"),
        "parent_run_id",
        F.lit("DDS").alias("layer"),
        F.lit(NEW).alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.localtimestamp().alias("event_ts"),
        F.lit(0).cast("bigint").alias("seq"),
    )


def newest(state: DataFrame, layer: str, *conditions) -> DataFrame:
    """The most recently created successful non-experiment run of a layer (at most one row)."""
    runs = _of(state, layer, SUCCESS).filter(f"NOT {EXPERIMENT_RUN}")
    for condition in conditions:
        runs = runs.filter(condition)
    return runs.orderBy(F.desc("created_at"), "run_id").limit(1).select("run_id")


def _target(df: DataFrame, stage: str, kind: str, run: Column, stg: Column, dds: Column | None, rank: int, created: Column) -> DataFrame:
    return df.select(
        F.lit(stage).alias("stage"),
        run.alias("run_id"),
        stg.alias("parent_run_id"),
        stg.alias("stg_run_id"),
        (F.lit(None).cast("string") if dds is None else dds).alias("dds_run_id"),
        F.lit(kind).alias("kind"),
        F.lit(rank).alias("_rank"),
        created.cast("timestamp_ntz").alias("_created"),
    )


def experiment_loads(state: DataFrame, baseline_stg: str) -> DataFrame:
    """Successful experiment loads of the baseline or of its staged experiments; ``_rank`` 1 for the latter."""
    staged = _of(state, "STG", SUCCESS).filter((F.col("parent_run_id") == baseline_stg) & F.expr(EXPERIMENT_RUN))
    parents = staged.select(F.col("run_id").alias("_p")).distinct()
    loads = _of(state, "DDS", SUCCESS).filter(EXPERIMENT_RUN)
    of_experiments = loads.join(parents, F.col("parent_run_id") == F.col("_p"), "left_semi").withColumn("_rank", F.lit(1))
    of_baseline = loads.filter(F.col("parent_run_id") == baseline_stg).withColumn("_rank", F.lit(2))
    return of_experiments.unionByName(of_baseline)


def stage_targets(
    state: DataFrame,
    stage: str,
    baseline_stg: str,
    baseline_dds: str | None = None,
    include_experiments: bool = True,
    only_unprocessed: bool = True,
    processed_layer: str = "E_GX",
) -> DataFrame:
    """Runs a stage has to validate: the baseline first, then its experiments by age, each run once."""
    if stage not in ("E", "T", "L"):
        raise ValueError(f"unsupported stage: {stage}")
    one = state.sparkSession.range(1)
    stg, never = F.lit(baseline_stg), F.lit(None).cast("timestamp_ntz")
    if stage == "E":
        parts = [_target(one, stage, routing.BASELINE, stg, stg, None, 0, never)]
        if include_experiments:
            runs = _of(state, "STG", SUCCESS, FAILED).filter((F.col("parent_run_id") == baseline_stg) & F.expr(EXPERIMENT_RUN))
            parts.append(_target(runs, stage, routing.EXPERIMENT, F.col("run_id"), stg, None, 1, F.col("created_at")))
    else:
        loaded = (
            one.select(F.lit(baseline_dds).alias("run_id"))
            if baseline_dds
            else newest(state, "DDS", F.col("parent_run_id") == baseline_stg)
        )
        parts = [_target(loaded, stage, routing.BASELINE, F.col("run_id"), stg, F.col("run_id"), 0, never)]
        if include_experiments:
            loads = experiment_loads(state, baseline_stg)
            for rank in (1, 2):
                some = loads.filter(F.col("_rank") == rank)
                run, parent = F.col("run_id"), F.col("parent_run_id")
                parts.append(_target(some, stage, routing.EXPERIMENT, run, parent, run, rank, F.col("created_at")))
    targets = parts[0]
    for part in parts[1:]:
        targets = targets.unionByName(part)
    targets = first_per_key(targets, ["stage", "run_id"], ["_rank", "_created"])
    if only_unprocessed:
        targets = unprocessed(targets, state, processed_layer)
    return targets.orderBy("_rank", "_created", "run_id").drop("_rank", "_created")


def unprocessed(targets: DataFrame, state: DataFrame, processed_layer: str, key: str = "run_id") -> DataFrame:
    """Targets no tool run of that layer has finished or is working on."""
    done = _of(state, processed_layer, *DONE).select(F.col("run_id").alias("_done")).distinct()
    return targets.join(done, F.col(key) == F.col("_done"), "left_anti")


def post_targets(
    state: DataFrame, baseline_stg: str | None = None, only_unprocessed: bool = True, processed_layer: str = "POST"
) -> DataFrame:
    """Loaded runs the post-load suite has to validate: ``baseline_stg_run_id, stg_run_id, dds_run_id, kind``."""
    if baseline_stg is None:
        row = newest(state, "STG", "run_id = parent_run_id").head()
        if row is None:
            return state.sparkSession.createDataFrame([], "baseline_stg_run_id STRING, stg_run_id STRING, dds_run_id STRING, kind STRING")
        baseline_stg = row["run_id"]
    targets = stage_targets(state, "T", baseline_stg, only_unprocessed=False)
    out = targets.select(F.lit(baseline_stg).alias("baseline_stg_run_id"), "stg_run_id", "dds_run_id", "kind")
    return unprocessed(out, state, processed_layer, "dds_run_id") if only_unprocessed else out


def related_runs(state: DataFrame, stg_run_id: str, dds_run_id: str) -> DataFrame:
    """Every run that is or descends from a baseline."""
    own = F.col("run_id").isin(stg_run_id, dds_run_id) | (F.col("parent_run_id") == stg_run_id)
    return state.filter(own).select("run_id").distinct().orderBy("run_id")


def batch_count(envelopes: DataFrame, run_id: str) -> DataFrame:
    return envelopes.filter(F.col("run_id") == run_id).agg(F.count_distinct("batch_id").alias("batches"))


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit rows as they are stored: row counts only on success, an end time on final states."""
    return events.withColumns(
        {
            "rows_processed": F.when(F.col("status") == SUCCESS, F.col("rows_processed")),
            "started_at": F.coalesce("started_at", F.localtimestamp()),
            "finished_at": F.coalesce(
                "finished_at", F.when(F.col("status").isin(SUCCESS, FAILED, ENDED), F.localtimestamp())
            ),
        }
    )


def merge_run_events(events: DataFrame) -> DataFrame:
    """One row per validation run from its start and finish events: a later non-NULL value wins."""
    rest = [c for c in events.columns if c not in ("validation_run_id", "seq")]
    return events.groupBy("validation_run_id").agg(
        *[F.expr(f"max_by({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}") for c in rest]
    )


def validation_run_id(*parts: Column) -> Column:
    """Deterministic id of a run, so that re-running never needs a sequence."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def mutation_messages(audit: DataFrame, run_id: str, limit: int = 50) -> DataFrame:
    """The latest distinct mutation messages of a run: ``entity, message``."""
    latest = (
        audit.filter((F.col("run_id") == run_id) & (F.col("status") == "MUTATED"))
        .orderBy(F.desc("started_at"), "entity_name", "message")
        .limit(limit)
    )
    entity = F.regexp_replace("entity_name", "^(STG|DDS)_mutation_", "")
    return latest.select(entity.alias("entity"), F.btrim("message").alias("message")).filter("message <> ''").distinct()


def message_line(messages: DataFrame, shown: int = 8) -> DataFrame:
    """One line ``entity: message; ...`` with the number of further messages (the input is a top-n)."""
    texts = F.sort_array(F.collect_list(F.concat_ws(": ", "entity", "message")))
    listed = messages.agg(texts.alias("t"))
    more = F.when(F.size("t") > shown, F.format_string(" (+%d more)", F.size("t") - shown)).otherwise("")
    return listed.select(F.concat(F.array_join(F.slice("t", 1, shown), "; "), more).alias("line"))


def without_runs(rows: DataFrame, layer: str | None = None, run_ids: Sequence[str] | None = None) -> DataFrame:
    """Ledger rows that remain after deleting a layer, or some runs of it."""
    gone = F.lit(True)
    if layer is not None:
        gone = gone & F.col("layer").eqNullSafe(F.lit(layer))
    if run_ids:
        gone = gone & F.col("run_id").isin(*run_ids)
    return rows.filter(~gone)

"""Run control and cost reports over a ledger derived from the events table.

Each event is one ledger event of a run; the run, its layer and its state follow
from the user, the value and the type, so the ledger grows with the events.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import query
from dqloom.operators import ledger, reports
from dqloom.session import checkpoint_folder
from dqloom.sources.history import History

STATUS = (
    "CASE event_type WHEN 'click' THEN 'NEW' WHEN 'view' THEN 'PROCESSING' WHEN 'signup' THEN 'PROCESSING' "
    "WHEN 'purchase' THEN 'SUCCESS' ELSE 'FAILED' END"
)
# Low values are staging runs (every tenth user an experiment on stg_1), the others loads.
LAYER = "CASE WHEN value < 8 THEN 'STG' WHEN value < 60 THEN 'DDS' ELSE 'E_GX' END"
PARENT_STG = "CASE WHEN user_id % 3 = 0 THEN 'stg_1' ELSE concat('stg_', user_id) END"
RUN = (
    "CASE WHEN value < 8 AND user_id % 3 = 0 THEN concat('exp_stg_', user_id) WHEN value < 8 THEN concat('stg_', user_id) "
    "WHEN value < 60 AND user_id % 2 = 0 THEN concat('exp_dds_', user_id) WHEN value < 60 THEN concat('dds_', user_id) "
    "ELSE concat('exp_dds_', user_id) END"
)
PARENT = (
    f"CASE WHEN value < 8 THEN {PARENT_STG} WHEN user_id % 5 = 0 THEN concat('exp_stg_', user_id) "
    "WHEN user_id % 7 = 0 THEN 'stg_1' ELSE concat('stg_', user_id) END"
)
FIELDS = {"dag_id": "'dag'", "run_id": RUN, "parent_run_id": PARENT, "layer": LAYER, "status": STATUS, "event_ts": "ts", "seq": "event_id"}
ERROR = "CASE WHEN event_type = 'error' THEN concat('failed at ', event_id) END"


def _as_sql(fields: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in fields.items())


LEDGER = f"""led AS (SELECT {_as_sql({**FIELDS, 'error_message': ERROR})} FROM events),
state AS (SELECT layer, parent_run_id, run_id, dag_id, status, error_message, attempts, created_at, last_updated_at FROM (
  SELECT *, count(*) FILTER (status = 'PROCESSING') OVER w AS attempts, min(event_ts) OVER w AS created_at,
    max(event_ts) OVER w AS last_updated_at,
    row_number() OVER (PARTITION BY layer, parent_run_id, run_id ORDER BY event_ts DESC, seq DESC) AS rn
  FROM led WINDOW w AS (PARTITION BY layer, parent_run_id, run_id)) WHERE rn = 1)"""


def events_of(t) -> DataFrame:
    return t["events"].selectExpr(*[f"{e} AS {n}" for n, e in {**FIELDS, "error_message": ERROR}.items()])


def state_of(t) -> DataFrame:
    return ledger.batch_state(events_of(t))


@query("ctl_latest_status", f"WITH {LEDGER} SELECT * FROM state")
def latest_status(t):
    # max_by keeps the message of the latest event even when that message is absent.
    return state_of(t)


@query("ctl_state_of_history", f"WITH {LEDGER} SELECT * FROM state")
def state_of_history(t):
    """The same state from a snapshot of the older events and the rest, in five appends."""
    past = History(t.spark, f"{checkpoint_folder(t.spark)}/history-{uuid.uuid4().hex}")
    part = F.pmod(F.xxhash64("run_id", "seq"), F.lit(5))
    events = events_of(t).withColumn("part", part)
    for i in range(5):
        past.append(events.filter(F.col("part") == i).drop("part"))
        if i % 2 == 0:
            past.compact()
    return past.state()


@query(
    "ctl_claim_pending",
    f"""WITH {LEDGER} SELECT 'load' AS dag_id, 'dds_new' AS run_id, s.run_id AS parent_run_id, 'DDS' AS layer, 'NEW' AS status
    FROM state s WHERE s.layer = 'STG' AND s.status = 'SUCCESS' AND NOT EXISTS (SELECT 1 FROM state d WHERE d.layer = 'DDS'
      AND d.parent_run_id = s.run_id AND d.status IN ('SUCCESS', 'PROCESSING'))""",
)
def claim_pending(t):
    claimed = ledger.claim_events(state_of(t), "load", "dds_new")
    return claimed.select("dag_id", "run_id", "parent_run_id", "layer", "status")


EXP_STG = "layer = 'STG' AND parent_run_id = 'stg_1' AND run_id LIKE 'exp_%'"
TARGETS_E = f"""t AS (SELECT 'E' AS stage, 'stg_1' AS run_id, 'stg_1' AS parent_run_id, 'stg_1' AS stg_run_id,
    CAST(NULL AS VARCHAR) AS dds_run_id, 'baseline' AS kind
  UNION ALL SELECT 'E', run_id, 'stg_1', 'stg_1', NULL, 'experiment' FROM state WHERE {EXP_STG} AND status IN ('SUCCESS', 'FAILED'))"""


@query("ctl_targets_extract", f"WITH {LEDGER}, {TARGETS_E} SELECT * FROM t")
def targets_extract(t):
    return ledger.stage_targets(state_of(t), "E", "stg_1", only_unprocessed=False)


LOADED = f"""base AS (SELECT run_id FROM state WHERE layer = 'DDS' AND status = 'SUCCESS' AND parent_run_id = 'stg_1'
    AND run_id NOT LIKE 'exp_%' ORDER BY created_at DESC, run_id LIMIT 1),
staged AS (SELECT run_id FROM state WHERE {EXP_STG} AND status = 'SUCCESS'),
loads AS (SELECT parent_run_id, run_id, CASE WHEN parent_run_id IN (SELECT run_id FROM staged) THEN 1 ELSE 2 END AS rank, created_at
  FROM state WHERE layer = 'DDS' AND status = 'SUCCESS' AND run_id LIKE 'exp_%'
    AND (parent_run_id IN (SELECT run_id FROM staged) OR parent_run_id = 'stg_1')),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank, created_at, parent_run_id) AS rn FROM loads)
  WHERE rn = 1),
t AS (SELECT 'T' AS stage, run_id, 'stg_1' AS parent_run_id, 'stg_1' AS stg_run_id, run_id AS dds_run_id, 'baseline' AS kind FROM base
  UNION ALL SELECT 'T', run_id, parent_run_id, parent_run_id, run_id, 'experiment' FROM firsts)"""
DONE = "SELECT run_id FROM state WHERE layer = 'E_GX' AND status IN ('SUCCESS', 'PROCESSING')"


@query("ctl_targets_loaded", f"WITH {LEDGER}, {LOADED} SELECT * FROM t")
def targets_loaded(t):
    return ledger.stage_targets(state_of(t), "T", "stg_1", only_unprocessed=False)


@query("ctl_targets_unprocessed", f"WITH {LEDGER}, {LOADED} SELECT * FROM t WHERE run_id NOT IN ({DONE})")
def targets_unprocessed(t):
    return ledger.stage_targets(state_of(t), "T", "stg_1", processed_layer="E_GX")


@query(
    "ctl_post_targets",
    f"""WITH {LEDGER}, {LOADED} SELECT 'stg_1' AS baseline_stg_run_id, stg_run_id, dds_run_id, kind FROM t
    WHERE dds_run_id NOT IN ({DONE})""",
)
def post_targets(t):
    return ledger.post_targets(state_of(t), "stg_1", processed_layer="E_GX")


@query(
    "ctl_newest_baseline",
    f"""WITH {LEDGER} SELECT run_id FROM state WHERE layer = 'STG' AND status = 'SUCCESS' AND run_id = parent_run_id
    AND run_id NOT LIKE 'exp_%' ORDER BY created_at DESC, run_id LIMIT 1""",
)
def newest_baseline(t):
    return ledger.newest(state_of(t), "STG", "run_id = parent_run_id")


@query(
    "ctl_related_runs",
    f"""WITH {LEDGER} SELECT DISTINCT run_id FROM state WHERE run_id IN ('stg_1', 'dds_1') OR parent_run_id = 'stg_1'""",
)
def related_runs(t):
    return ledger.related_runs(state_of(t), "stg_1", "dds_1")


@query(
    "ctl_delete_runs",
    f"""WITH {LEDGER} SELECT layer, count(*) AS events FROM led WHERE NOT (layer = 'DDS' AND run_id IN ('dds_1', 'exp_dds_2'))
    AND layer <> 'E_GX' GROUP BY ALL""",
)
def delete_runs(t):
    kept = ledger.without_runs(ledger.without_runs(events_of(t), "DDS", ["dds_1", "exp_dds_2"]), "E_GX")
    return kept.groupBy("layer").agg(F.count(F.lit(1)).alias("events"))


# --- audit -----------------------------------------------------------------------------------------------------------

AUDIT_STATUS = (
    "CASE event_type WHEN 'click' THEN 'MUTATED' WHEN 'view' THEN 'STARTED' WHEN 'purchase' THEN 'SUCCESS' "
    "WHEN 'signup' THEN 'ENDED' ELSE 'FAILED' END"
)
SUITES = {"schema_audit": "schema_suite", "rules_audit": "rules_suite"}
ENTITY = "CASE WHEN event_type = 'click' THEN 'STG_mutation_matches' WHEN user_id % 2 = 0 THEN 'schema_audit' ELSE 'rules_audit' END"
AUDIT = {
    "run_id": "concat('run_', user_id)",
    "layer": "CASE WHEN user_id % 2 = 0 THEN 'STG' ELSE 'DDS' END",
    "entity_name": ENTITY,
    "status": AUDIT_STATUS,
    "started_at": "ts",
    "rows_processed": "cast(round(value * 100) AS BIGINT)",
    "message": "concat('swapped ', cast(round(value) AS INT))",
}


def audit_of(t) -> DataFrame:
    finished = "CASE WHEN event_type <> 'view' THEN ts + make_dt_interval(0, 0, 0, cast(round(value * 100) AS DECIMAL(18,6)) / 100) END"
    return t["events"].selectExpr(*[f"{e} AS {n}" for n, e in AUDIT.items()], f"{finished} AS finished_at", "event_id")


AUDIT_SQL = f"""aud AS (SELECT {_as_sql(AUDIT)}, CASE WHEN event_type <> 'view' THEN ts + to_microseconds(CAST(round(value * 100) AS BIGINT)
  * 10000) END AS finished_at, event_id FROM events)"""


@query(
    "ctl_audit_rows",
    f"""WITH {AUDIT_SQL} SELECT event_id, status, started_at, CASE WHEN status = 'SUCCESS' THEN rows_processed END AS rows_processed,
    finished_at FROM aud""",
)
def audit_rows(t):
    return ledger.audit_rows(audit_of(t)).select("event_id", "status", "started_at", "rows_processed", "finished_at")


@query(
    "ctl_mutation_messages",
    f"""WITH {AUDIT_SQL} SELECT DISTINCT 'matches' AS entity, message FROM (SELECT * FROM aud WHERE run_id = 'run_7'
    AND status = 'MUTATED' ORDER BY started_at DESC, entity_name, message LIMIT 50)""",
)
def mutation_messages(t):
    return ledger.mutation_messages(audit_of(t), "run_7")


@query(
    "ctl_mutation_line",
    f"""WITH {AUDIT_SQL}, m AS (SELECT DISTINCT 'matches: ' || message AS x FROM (SELECT * FROM aud WHERE run_id = 'run_7'
    AND status = 'MUTATED' ORDER BY started_at DESC, entity_name, message LIMIT 50)), n AS (SELECT x, row_number() OVER (ORDER BY x) AS i,
    count(*) OVER () AS total FROM m)
    SELECT coalesce(string_agg(x, '; ' ORDER BY x) FILTER (i <= 8), '') ||
      CASE WHEN max(total) > 8 THEN ' (+' || (max(total) - 8) || ' more)' ELSE '' END AS line FROM n""",
)
def mutation_line(t):
    return ledger.message_line(ledger.mutation_messages(audit_of(t), "run_7"))


@query(
    "rpt_suite_seconds",
    f"""WITH {AUDIT_SQL} SELECT run_id, layer, CASE entity_name WHEN 'schema_audit' THEN 'schema_suite' ELSE 'rules_suite' END AS suite,
    entity_name, CAST(round(CAST(sum(epoch_us(finished_at) - epoch_us(started_at)) AS DECIMAL(28,6)) / 1000000, 3) AS DOUBLE) AS seconds_sum
    FROM aud WHERE status IN ('SUCCESS', 'FAILED') AND entity_name IN ('schema_audit', 'rules_audit') AND finished_at IS NOT NULL
    GROUP BY run_id, layer, entity_name""",
)
def suite_seconds(t):
    return reports.suite_seconds(audit_of(t), SUITES)


# --- validation runs and costs ---------------------------------------------------------------------------------------

RUNS = {
    "validation_run_id": "cast(event_id AS STRING)",
    "dag_id": "'dag'",
    "layer": "concat(CASE WHEN user_id % 3 = 0 THEN 'E' WHEN user_id % 3 = 1 THEN 'T' ELSE 'L' END, CASE WHEN user_id % 2 = 0 THEN '_GX' ELSE '_SODA' END)",
    "tool": "CASE WHEN user_id % 2 = 0 THEN 'gx' ELSE 'soda' END",
    "kind": "CASE event_type WHEN 'click' THEN 'baseline' WHEN 'view' THEN 'experiment' WHEN 'error' THEN 'experiment' ELSE NULL END",
    "duration_ms": "cast(round(value * 100) AS BIGINT)",
    "checks_total": "cast(20 AS BIGINT)",
    "checks_failed": "cast(user_id % 4 AS BIGINT)",
    "started_at": "ts",
    "finished_at": "ts",
    "k": "K",
}


def _fields(k: str) -> dict[str, str]:
    return {**RUNS, "k": f"cast({k} AS INT)"}


def runs_of(t) -> DataFrame:
    base = t["events"].selectExpr("event_id", *[f"{e} AS {n}" for n, e in _fields("get_json_object(props, '$.k')").items()])
    meta = "CASE WHEN k % 10 = 0 THEN '{}' ELSE concat('{\"resources\":{\"cpu_percent_avg\":\"', k, '\",\"rss_kb\":', k * 1000, '}}') END"
    return base.selectExpr("*", f"{meta} AS meta_json")


_K_SQL = "json_extract_string(props, '$.k')"
RUNS_SQL = f"runs AS (SELECT event_id, {_as_sql(_fields(_K_SQL)).replace('STRING', 'VARCHAR')} FROM events)"


def _avg(expression: str) -> str:
    return f"CAST(round(CAST(CAST(sum({expression}) AS DOUBLE) / count({expression}) AS DECIMAL(28,8)), 3) AS DOUBLE)"


def _std(expression: str) -> str:
    return f"round(coalesce(stddev_pop(CAST({expression} AS DOUBLE)), 0), 3)"


CPU, RSS = "CASE WHEN k % 10 <> 0 THEN k END", "CASE WHEN k % 10 <> 0 THEN k * 1000 END"


@query(
    "rpt_summary",
    f"""WITH {RUNS_SQL} SELECT split_part(layer, '_', 1) AS stage, layer, tool, coalesce(kind, 'unknown') AS kind, count(*) AS runs,
    CAST(sum(checks_total) AS BIGINT) AS checks_total, CAST(sum(checks_failed) AS BIGINT) AS checks_failed,
    {_avg('duration_ms')} AS avg_duration_ms, {_std('duration_ms')} AS std_duration_ms, {_avg(CPU)} AS avg_cpu_percent,
    {_std(CPU)} AS std_cpu_percent, {_avg(RSS)} AS avg_rss_kb, {_std(RSS)} AS std_rss_kb, min(started_at) AS first_started_at,
    max(finished_at) AS last_finished_at FROM runs GROUP BY layer, tool, coalesce(kind, 'unknown')""",
)
def summary(t):
    return reports.validation_summary(runs_of(t))


@query(
    "rpt_repeat_stats",
    f"""WITH {RUNS_SQL} SELECT layer, tool, count(*) AS repeats, {_avg('duration_ms')} AS duration_ms_mean,
    {_std('duration_ms')} AS duration_ms_std, arg_min(checks_failed, event_id) AS checks_failed FROM runs GROUP BY ALL""",
)
def repeat_stats(t):
    repeats = runs_of(t).withColumnRenamed("event_id", "repeat_no")
    return reports.repeat_stats(repeats, ["layer", "tool"], ["duration_ms"], ["checks_failed"])


COSTS = "costs AS (SELECT layer, kind, max(duration_ms) AS total_ms, min(duration_ms) + 1 AS raw_ms FROM runs WHERE kind IS NOT NULL GROUP BY ALL)"


def costs_of(t) -> DataFrame:
    known = runs_of(t).filter("kind IS NOT NULL").groupBy("layer", "kind")
    return known.agg(F.max("duration_ms").alias("total_ms"), (F.min("duration_ms") + 1).alias("raw_ms"))


def _pct(part: str, whole: str) -> str:
    return f"CAST(round(CAST(CAST(100 * ({part}) AS DOUBLE) / ({whole}) AS DECIMAL(28,8)), 1) AS DOUBLE)"


@query(
    "rpt_overhead",
    f"""WITH {RUNS_SQL}, {COSTS} SELECT *, CAST(total_ms - raw_ms AS DOUBLE) AS overhead,
    {_pct('total_ms - raw_ms', 'raw_ms')} AS overhead_pct FROM costs""",
)
def overhead(t):
    return reports.overhead(costs_of(t), "total_ms", "raw_ms")


@query(
    "rpt_growth",
    f"""WITH {RUNS_SQL}, {COSTS}, p AS (SELECT layer, max(raw_ms) FILTER (kind = 'baseline') AS small,
    max(raw_ms) FILTER (kind = 'experiment') AS large FROM costs GROUP BY ALL)
    SELECT *, CAST(round(CAST(CAST(large AS DOUBLE) / small AS DECIMAL(28,8)), 2) AS DOUBLE) AS ratio FROM p""",
)
def growth(t):
    return reports.growth(costs_of(t), ["layer"], "kind", "baseline", "experiment", "raw_ms")


@query(
    "rpt_delta",
    f"""WITH {RUNS_SQL}, {COSTS}, p AS (SELECT layer, max(total_ms) FILTER (kind = 'baseline') AS baseline,
    max(total_ms) FILTER (kind = 'experiment') AS experiment FROM costs GROUP BY ALL)
    SELECT *, CAST(experiment - baseline AS DOUBLE) AS delta, {_pct('experiment - baseline', 'baseline')} AS delta_pct FROM p""",
)
def delta(t):
    return reports.change(costs_of(t), ["layer"], "kind", "total_ms")


@query(
    "rpt_long_metrics",
    f"""WITH {RUNS_SQL}, {COSTS} SELECT 'validation_' || layer AS stage, metric, value FROM (
    SELECT layer, 'total_ms' AS metric, CAST(total_ms AS VARCHAR) AS value FROM costs UNION ALL
    SELECT layer, 'raw_ms', CAST(raw_ms AS VARCHAR) FROM costs)""",
)
def long_metrics(t):
    return reports.long_metrics(costs_of(t), F.concat(F.lit("validation_"), F.col("layer")), ["total_ms", "raw_ms"])


@query(
    "ctl_merge_runs",
    """SELECT CAST(user_id AS VARCHAR) AS validation_run_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS status,
    arg_max(value, event_id) FILTER (value > 20) AS cost FROM events GROUP BY ALL""",
)
def merge_runs(t):
    events = t["events"].selectExpr(
        "cast(user_id AS STRING) AS validation_run_id",
        "event_id AS seq",
        "CASE WHEN event_type <> 'view' THEN event_type END AS status",
        "CASE WHEN value > 20 THEN value END AS cost",
    )
    return ledger.merge_run_events(events)


@query(
    "rpt_documents",
    f"""WITH {RUNS_SQL} SELECT validation_run_id AS run_id, tool AS suite, split_part(layer, '_', 1) AS stage,
    CASE WHEN checks_failed = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status, CAST(3 AS BIGINT) AS checks_total,
    checks_failed, (SELECT '[' || string_agg('{{"check":"check_' || i || '","status":"' || CASE WHEN i < checks_failed THEN 'FAIL'
      ELSE 'PASS' END || '","failed_rows":' || CASE WHEN i < checks_failed THEN k ELSE 0 END || '}}', ',' ORDER BY i) || ']'
      FROM range(3) r(i)) AS results FROM runs""",
)
def documents(t):
    # Every run has three checks, of which as many fail as the run says.
    check = (
        "inline(transform(array(0, 1, 2), i -> named_struct('check_name', concat('check_', i), "
        "'status', CASE WHEN i < checks_failed THEN 'FAIL' ELSE 'PASS' END, "
        "'rows_failed', CASE WHEN i < checks_failed THEN k ELSE 0 END)))"
    )
    results = runs_of(t).selectExpr("validation_run_id AS run_id", "tool AS suite", "split_part(layer, '_', 1) AS stage", check)
    found = reports.report_documents(results, F.lit(0.0)).drop("spark_sec")
    return found.withColumn("results", F.to_json("results"))

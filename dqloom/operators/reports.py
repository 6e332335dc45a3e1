"""Aggregations over check results and run costs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqloom.functions import routing

# Column order of the exported summary.
SUMMARY_COLUMNS = (
    "exported_at",
    "tools_dag_id",
    "stage",
    "layer",
    "tool",
    "kind",
    "runs",
    "checks_total",
    "checks_failed",
    "avg_duration_ms",
    "std_duration_ms",
    "avg_cpu_percent",
    "avg_rss_kb",
    "std_cpu_percent",
    "std_rss_kb",
    "first_started_at",
    "last_finished_at",
)


def _mean(value: Column) -> Column:
    return F.round(F.avg(value.cast("decimal(18,4)")), 3).cast("double")


def _spread(value: Column) -> Column:
    """Population standard deviation; a single value has none."""
    return F.round(F.coalesce(F.stddev_pop(value.cast("double")), F.lit(0.0)), 3)


def validation_summary(runs: DataFrame) -> DataFrame:
    """Runs, checks and costs per stage, tool and kind; costs of a run come from its JSON metadata."""

    def resource(name: str) -> Column:
        text = F.get_json_object("meta_json", f"$.resources.{name}")
        return F.nullif(text, F.lit("")).try_cast("decimal(18,4)")

    cpu, rss, took = resource("cpu_percent_avg"), resource("rss_kb"), F.col("duration_ms")
    kind = F.coalesce("kind", F.lit("unknown")).alias("kind")
    totals = runs.groupBy("layer", "tool", kind).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("checks_total").alias("checks_total"),
        F.sum("checks_failed").alias("checks_failed"),
        _mean(took).alias("avg_duration_ms"),
        _spread(took).alias("std_duration_ms"),
        _mean(cpu).alias("avg_cpu_percent"),
        _spread(cpu).alias("std_cpu_percent"),
        _mean(rss).alias("avg_rss_kb"),
        _spread(rss).alias("std_rss_kb"),
        F.min("started_at").alias("first_started_at"),
        F.max("finished_at").alias("last_finished_at"),
    )
    return totals.select(routing.stage_of(F.col("layer")).alias("stage"), "*")


def exported_summary(runs: DataFrame, dag_id: str) -> DataFrame:
    """The summary of one tool run in its export layout."""
    own = validation_summary(runs.filter(F.col("dag_id") == dag_id))
    stamped = own.withColumns({"exported_at": F.localtimestamp(), "tools_dag_id": F.lit(dag_id)})
    return stamped.select(*SUMMARY_COLUMNS).orderBy("layer", "tool", "kind")


def repeat_stats(repeats: DataFrame, by: Sequence[str], measures: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over repeats; ``first`` columns come from the first repeat only."""
    costs = []
    for m in measures:
        costs += [_mean(F.col(m)).alias(f"{m}_mean"), _spread(F.col(m)).alias(f"{m}_std")]
    taken = [F.min_by(c, "repeat_no").alias(c) for c in first]
    return repeats.groupBy(*by).agg(F.count(F.lit(1)).alias("repeats"), *costs, *taken)


def suite_seconds(audit: DataFrame, entities: Mapping[str, str]) -> DataFrame:
    """Seconds per run and suite from audit rows of finished suites; ``entities`` maps audit name -> suite."""
    names = F.create_map(*[F.lit(x) for pair in entities.items() for x in pair])
    done = audit.filter(
        F.col("status").isin("SUCCESS", "FAILED")
        & F.col("entity_name").isin(*entities)
        & F.col("started_at").isNotNull()
        & F.col("finished_at").isNotNull()
    )
    micros = F.expr("timestampdiff(MICROSECOND, started_at, finished_at)")
    summed = done.groupBy("run_id", "layer", "entity_name").agg(F.sum(micros).alias("us"))
    seconds = F.round((F.col("us") / F.lit(1000000)).cast("decimal(38,9)"), 3).cast("double")
    return summed.select("run_id", "layer", names[F.col("entity_name")].alias("suite"), "entity_name", seconds.alias("seconds_sum"))


def detection_matrix(results: DataFrame, suites: Sequence[str]) -> DataFrame:
    """Failed checks per mutation and stage, one column per suite."""
    failed = F.col("status").isin("FAIL", "ERROR")
    cells = [F.count_if(failed & (F.col("suite") == s)).alias(s) for s in suites]
    return results.groupBy("mutation", "stage").agg(*cells)


def mean_failures(results: DataFrame) -> DataFrame:
    """Mean number of failed checks per suite and stage over mutation iterations."""
    failed = F.col("status").isin("FAIL", "ERROR")
    per_run = results.groupBy("suite", "stage", "mutation").agg(F.count_if(failed).alias("n"))
    return per_run.groupBy("suite", "stage").agg(_round2(F.avg(F.col("n").cast("decimal(18,0)"))).alias("mean_failed"))


def _round2(value: Column) -> Column:
    return F.round(value, 2).cast("double")


def _ratio(value: Column, whole: Column, digits: int, factor: int = 1) -> Column:
    exact = F.try_divide(value.cast("decimal(18,4)") * factor, whole.cast("decimal(18,4)"))
    return F.round(exact, digits).cast("double")


def overhead(costs: DataFrame, total: str, raw: str) -> DataFrame:
    """Absolute and relative overhead of the measured time over the raw engine time."""
    extra = F.col(total).cast("decimal(18,4)") - F.col(raw).cast("decimal(18,4)")
    return costs.withColumns(
        {"overhead": F.round(extra, 3).cast("double"), "overhead_pct": _ratio(extra, F.col(raw), 1, 100)}
    )


def growth(costs: DataFrame, by: Sequence[str], scale: str, small: str, large: str, value: str) -> DataFrame:
    """Cost at the large scale over cost at the small one (one row per scale and group expected)."""

    def at(name: str) -> Column:
        return F.max(F.when(F.col(scale) == name, F.col(value)))

    pivoted = costs.groupBy(*by).agg(at(small).alias("small"), at(large).alias("large"))
    return pivoted.withColumn("ratio", _ratio(F.col("large"), F.col("small"), 2))


def change(costs: DataFrame, by: Sequence[str], kind: str, value: str) -> DataFrame:
    """Baseline against experiment: absolute and relative change."""

    def at(name: str) -> Column:
        return F.max(F.when(F.col(kind) == name, F.col(value)))

    pivoted = costs.groupBy(*by).agg(at(routing.BASELINE).alias("baseline"), at(routing.EXPERIMENT).alias("experiment"))
    delta = F.col("experiment").cast("decimal(18,4)") - F.col("baseline").cast("decimal(18,4)")
    return pivoted.withColumns(
        {"delta": F.round(delta, 3).cast("double"), "delta_pct": _ratio(delta, F.col("baseline"), 1, 100)}
    )


def long_metrics(stats: DataFrame, section: Column, metrics: Sequence[str]) -> DataFrame:
    """Wide statistics -> ``stage, metric, value`` rows."""
    cells = ", ".join(f"named_struct('metric', '{m}', 'value', cast({m} AS STRING))" for m in metrics)
    return stats.select(section.alias("stage"), F.expr(f"inline(array({cells}))"))


def report_documents(results: DataFrame, seconds: Column) -> DataFrame:
    """One document per run, suite and stage with its checks (bounded by the suite's length)."""
    failed = F.col("status").isin("FAIL", "ERROR")
    entry = F.struct(F.col("check_name").alias("check"), "status", F.col("rows_failed").alias("failed_rows"))
    grouped = results.groupBy("run_id", "suite", "stage").agg(
        F.when(F.count_if(failed) == 0, "SUCCESS").otherwise("FAILED").alias("status"),
        F.count(F.lit(1)).alias("checks_total"),
        F.count_if(failed).alias("checks_failed"),
        F.sort_array(F.collect_list(entry)).alias("results"),
    )
    return grouped.withColumn("spark_sec", seconds)

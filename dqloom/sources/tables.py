"""Stored tables: append-only, partitioned by run.

A run is written once and never rewritten, so a snapshot is just a reference to
its partition, and replacing a table means writing a new run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.functions import routing
from dqloom.operators import reports as R
from dqloom.operators.keys import insert_if_absent


def append_envelopes(envelopes: DataFrame, path: str) -> None:
    """Raw envelopes, laid out so that a run and an entity can be read alone."""
    envelopes.hint("rebalance", "run_id", "entity").write.mode("append").partitionBy("run_id", "entity").parquet(path)


def read_envelopes(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored if run_id is None else stored.filter(F.col("run_id") == run_id)


def save_run(tables: Mapping[str, DataFrame], root: str, run_id: str, batch: str | None = None) -> None:
    """Every table of a run in one write each (``root/table/run_id=...``).

    ``rebalance`` lets adaptive execution choose file sizes and split skewed partitions.
    """
    for name, df in tables.items():
        rows = df if "run_id" in df.columns else df.withColumn("run_id", F.lit(run_id))
        rows.hint("rebalance").write.mode("append").partitionBy("run_id").parquet(f"{root.rstrip('/')}/{name}")


def read_run(spark: SparkSession, root: str, names: Sequence[str], run_id: str, versioned: bool = True) -> dict[str, DataFrame]:
    """The tables of one run; partition pruning keeps other runs unread."""
    out = {}
    for name in names:
        rows = spark.read.parquet(f"{root.rstrip('/')}/{name}").filter(F.col("run_id") == run_id)
        out[name] = rows if versioned else rows.drop("run_id")
    return out


def read_runs(spark: SparkSession, root: str, names: Sequence[str], runs: DataFrame) -> dict[str, DataFrame]:
    """The tables of all ``runs`` (``run_id``) together; other runs' partitions are pruned when the runs are known."""
    wanted = runs.select("run_id").distinct()
    return {name: spark.read.parquet(f"{root.rstrip('/')}/{name}").join(wanted, "run_id", "left_semi") for name in names}


def _stored(spark: SparkSession, path: str, run_id: str | None) -> DataFrame | None:
    """Rows of a stored table, or of one run of it; None where nothing is stored."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as error:
        # nothing was written yet, or only tables without rows
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return rows if run_id is None else rows.filter(F.col("run_id") == run_id)


def append_absent(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = (), run_id: str | None = None
) -> int:
    """Append the rows whose key is not stored yet and return their number; stored rows are never touched.

    ``run_id`` says that all rows belong to that run, so only its partition is looked at.  Rows are counted from the
    files' footers before and after.
    """
    existing = _stored(spark, path, run_id)
    before = 0 if existing is None else existing.count()
    fresh = insert_if_absent(rows.limit(0) if existing is None else existing, rows, keys, order)
    fresh.drop(*order).hint("rebalance").write.mode("append").partitionBy("run_id").parquet(path)
    after = _stored(spark, path, run_id)
    return (0 if after is None else after.count()) - before


def save_entities(tables: Mapping[str, DataFrame], database: str) -> None:
    """Append to managed tables, one write per table."""
    for name, df in tables.items():
        df.hint("rebalance").write.mode("append").saveAsTable(f"{database}.{name}")


def entity_tables(spark: SparkSession, database: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.table(f"{database}.{name}") for name in names}


def delete_run(spark: SparkSession, tables: Sequence[str], run_id: str) -> None:
    """Drop one run from managed tables, children before parents."""
    for name in tables:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (run_id = '{run_id}')")


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def rewrite_ledger(kept: DataFrame, path: str) -> None:
    """A compacted copy of a ledger in a new place; readers switch to it when it is complete."""
    kept.hint("rebalance").write.mode("errorifexists").parquet(path)


# --- reports and exports ---------------------------------------------------------------------------------------------


def write_reports(documents: DataFrame, path: str) -> None:
    """Check reports, one JSON document per run, suite and stage."""
    documents.write.mode("append").partitionBy("suite", "stage").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report (a few rows) as CSV with a header."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def write_summary(runs: DataFrame, dag_id: str, path: str) -> None:
    write_csv(R.exported_summary(runs, dag_id), path)


def export_payloads(envelopes: DataFrame, run_id: str, seasons: Sequence[int] | None = routing.EXPORT_SEASONS) -> DataFrame:
    """Exportable payloads of one run in their export layout, with the file name each is stored under.

    ``seasons`` are those to export; None exports all.
    """
    own = envelopes.filter(F.col("run_id") == run_id).filter(routing.exportable(F.col("endpoint"), seasons))
    return own.select(
        F.concat_ws("_", F.regexp_replace("source_file", "[.]json$", ""), routing.endpoint_slug(F.col("endpoint"))).alias("file"),
        routing.endpoint_slug(F.col("endpoint")).alias("endpoint_slug"),
        "endpoint",
        "http_status",
        "request_params",
        F.col("body").alias("response_json"),
    )


def write_export(exported: DataFrame, path: str) -> None:
    exported.write.mode("errorifexists").partitionBy("endpoint_slug").json(path)


def export_manifest(exported: DataFrame) -> DataFrame:
    """What an export holds, one row per fact: ``section, name, payloads``.

    Sections are total, entity, competition_id and season.  One aggregation over
    the endpoints; the lists stay rows and are never gathered into one.
    """
    parts = routing.export_parts(F.col("endpoint"))
    facts = [
        ("total", F.lit("all")),
        ("entity", F.coalesce(parts["entity"], F.col("endpoint"))),
        ("competition_id", parts["competition_id"].cast("string")),
        ("season", parts["season"].cast("string")),
    ]
    cells = F.array(*[F.struct(F.lit(section).alias("section"), name.alias("name")) for section, name in facts])
    rows = exported.select(F.inline(cells)).filter("name IS NOT NULL")
    return rows.groupBy("section", "name").agg(F.count(F.lit(1)).alias("payloads"))


def write_ledger_dump(frames: Mapping[str, DataFrame], runs: DataFrame, path: str) -> None:
    """Ledger rows of the given runs as JSON lines, one folder per ledger table."""
    for name, df in frames.items():
        df.join(runs.select("run_id").distinct(), "run_id", "left_semi").write.mode("errorifexists").json(f"{path}/{name}")

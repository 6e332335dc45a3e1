"""Loading staged runs into the star schema, with audit and status events.

Ledger rows are appended next to the tables: ``<root>/_audit`` and
``<root>/_batch_events``.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.operators import flatten, ledger
from dqloom.plans.tables import STAR
from dqloom.sources import envelopes as E
from dqloom.sources import tables

ALL = "ALL"


def audit_path(root: str) -> str:
    return f"{root.rstrip('/')}/_audit"


def events_path(root: str) -> str:
    return f"{root.rstrip('/')}/_batch_events"


def _audit(spark: SparkSession, root: str, dag_id: str, run_id: str, entity: str, status: str, rows: int | None = None, message=None) -> None:
    row = [(dag_id, run_id, None, "DDS", entity, status, None, None, rows, message)]
    tables.append_ledger(ledger.audit_rows(spark.createDataFrame(row, ledger.AUDIT_SCHEMA)), audit_path(root))


def load_run(envelopes: DataFrame, root: str, dag_id: str, run_id: str, strict: bool = False) -> dict[str, int]:
    """Write every star table of a run in load order; returns the rows written per table.

    Rows are inserted where their key is absent in the run's partition, so loading a run again, after a failure or
    twice, adds what is missing and nothing else.  Rows without a key
    are counted in the audit (REJECTED); ``strict`` raises on them.  The first failing table stops the load.
    """
    spark = envelopes.sparkSession
    _audit(spark, root, dag_id, run_id, ALL, "STARTED")
    written: dict[str, int] = {}
    try:
        for name, rows in flatten.load_star(envelopes, run_id, strict).items():
            key = ["run_id", *STAR[name].key]
            written[name] = tables.append_absent(spark, f"{root.rstrip('/')}/{name}", rows, key, run_id=run_id)
            _audit(spark, root, dag_id, run_id, name, ledger.SUCCESS, written[name])
        if not strict:
            for row in flatten.row_counts(flatten.unkeyed_rows(envelopes, run_id)).filter("rows > 0").collect():
                _audit(spark, root, dag_id, run_id, row["table"], "REJECTED", message=f"{row['rows']} rows without a key")
    except PySparkException as error:
        _audit(spark, root, dag_id, run_id, ALL, ledger.FAILED, message=str(error))
        raise
    _audit(spark, root, dag_id, run_id, ALL, ledger.SUCCESS)
    return written


def load_pending(envelopes: DataFrame, root: str, dag_id: str, run_id: str) -> DataFrame:
    """Claim every staged run nobody has loaded and load them together as one run.

    The claims are appended as events and read back, so any number of runs is one distributed load and none of them
    passes through the driver.  Returns the claimed run ids, one row each.
    """
    spark = envelopes.sparkSession
    claims = ledger.claim_events(ledger.batch_state(spark.read.parquet(events_path(root))), dag_id, run_id)
    tables.append_ledger(claims, events_path(root))
    own = (F.col("run_id") == run_id) & (F.col("layer") == "DDS") & (F.col("status") == ledger.NEW)
    claimed = spark.read.parquet(events_path(root)).filter(own).select(F.col("parent_run_id").alias("run_id")).distinct()
    if claimed.isEmpty():
        return claimed

    def log(status: str, error: str | None = None) -> None:
        fixed = {"dag_id": dag_id, "layer": "DDS", "status": status, "error_message": error}
        rows = claimed.select(F.lit(run_id).alias("run_id"), F.col("run_id").alias("parent_run_id"))
        rows = rows.withColumns({name: F.lit(value).cast("string") for name, value in fixed.items()})
        stamped = rows.withColumns({"event_ts": F.localtimestamp(), "seq": F.lit(0).cast("bigint")})
        tables.append_ledger(stamped, events_path(root))

    log(ledger.PROCESSING)
    try:
        load_run(envelopes.join(claimed, "run_id", "left_semi"), root, dag_id, run_id)
    except PySparkException as error:
        log(ledger.FAILED, str(error))
        raise
    log(ledger.SUCCESS)
    return claimed


def staged(envelopes: DataFrame, path: str, root: str, dag_id: str, run_id: str) -> None:
    """Append the envelopes of a run and record that it is staged."""
    spark = envelopes.sparkSession
    for status in (ledger.NEW, ledger.PROCESSING):
        tables.append_ledger(ledger.batch_event(spark, dag_id, run_id, run_id, "STG", status), events_path(root))
    tables.append_envelopes(envelopes, path)
    tables.append_ledger(ledger.batch_event(spark, dag_id, run_id, run_id, "STG", ledger.SUCCESS), events_path(root))


def stage_folder(spark: SparkSession, folder: str, path: str, root: str, dag_id: str, run_id: str, lines: bool = False) -> None:
    """Stage the payload files of a run folder; a broken file or an empty batch fails the run and stages nothing."""
    broken = E.payload_errors(spark, folder, lines)
    count = broken.count()
    if count:
        first = broken.orderBy("path").first()
        message = f"{count} broken payloads, the first: {first['path']} ({first['reason']})"
        for status, error in ((ledger.NEW, None), (ledger.PROCESSING, None), (ledger.FAILED, message)):
            tables.append_ledger(ledger.batch_event(spark, dag_id, run_id, run_id, "STG", status, error), events_path(root))
        raise E.BrokenPayloads(message)
    staged(E.read_envelopes(spark, folder, run_id, lines), path, root, dag_id, run_id)

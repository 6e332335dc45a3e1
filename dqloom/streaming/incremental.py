"""Loading and checking payloads as they arrive.

The file source remembers which payload files were processed, which replaces
claiming pending runs by hand: every trigger takes exactly the new files, and a
restart continues from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dqloom.operators import checks as C
from dqloom.operators import fusion
from dqloom.operators.checks import Check
from dqloom.plans import native, suites
from dqloom.sources import envelopes as E
from dqloom.sources import tables
from dqloom.streaming import repeats


def arriving_envelopes(
    spark: SparkSession, folder: str, run_id: str, lines: bool = False, files_per_trigger: int | None = None, layout: str = E.BATCH_GLOB
) -> DataFrame:
    """New payload files below a run folder as a stream of envelopes; the batch id is the directory name.

    Files that are no JSON object give no envelope; ``envelopes.payload_errors`` lists them.
    """
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    texts = reader.text(f"{folder.rstrip('/')}/{layout}", wholetext=not lines).select("value", F.col("_metadata.file_path").alias("_path"))
    named = E.sound_payloads(E.parsed(texts)).selectExpr(
        "* EXCEPT (source_file)",
        "coalesce(source_file, regexp_extract(_path, '([^/]+)$', 1)) AS source_file",
        f"concat('{run_id}_', regexp_extract(_path, {E.BATCH_DIR}, 1)) AS batch_id",
    )
    return E.as_envelopes(named, run_id)


@dataclass(frozen=True)
class Arrival:
    """The queries that take what has arrived: one stores and checks it, one follows each check for repeated keys."""

    queries: tuple[StreamingQuery, ...]

    def awaitTermination(self) -> None:  # noqa: N802
        for query in self.queries:
            query.awaitTermination()


def stage_and_check(stream: DataFrame, raw_path: str, results_path: str, checkpoint: str) -> Arrival:
    """Append arriving envelopes and the results of the ingestion and extract-stage checks on them.

    Each micro-batch writes to its own folder and replaces it when the batch is replayed after a failure, so the
    outcome is the same as of one successful run.  Checks for repeated keys are about everything that has arrived: the
    keys seen are kept as state (``streaming.repeats``) and only keys that repeat are stored, so the work of a batch
    does not grow with what came before.  Results are stored by query and batch; all other checks look at the batch.
    """
    checks: Sequence[Check] = suites.STAGE.checks("E")
    alone = [c for c in checks if c.count != C.GROUPS]

    def process(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").partitionBy("run_id", "entity").parquet(f"{raw_path}/epoch={epoch}")
        stored = batch.sparkSession.read.parquet(f"{raw_path}/epoch={epoch}")
        results = native.ingestion_results(stored).unionByName(fusion.evaluate("stage", "E", alone, E.stage_e_tables(stored)))
        results.write.mode("overwrite").parquet(f"{results_path}/query=arrival/epoch={epoch}")

    main = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    arriving = E.stage_e_tables(stream)

    def follow(check: Check) -> StreamingQuery:
        def judge(epoch: int, keys: DataFrame) -> None:
            # the keys that repeat so far; their number is in the files' footers
            counted = keys.agg(F.lit(0).alias("pos"), F.count(F.lit(1)).alias("rows_failed"))
            results = fusion.described([fusion.Placed("stage", "E", check)], counted)
            results.write.mode("overwrite").parquet(f"{results_path}/query={check.name}/epoch={epoch}")

        found = repeats.repeated(arriving[check.table], check.keys, check.count_null_keys)
        return repeats.watch(found, f"{checkpoint}-{check.name}-keys", f"{checkpoint}-{check.name}", judge)

    return Arrival((main, *(follow(c) for c in checks if c.count == C.GROUPS)))


def stored_envelopes(spark: SparkSession, raw_path: str) -> DataFrame:
    return tables.read_envelopes(spark, raw_path)

"""A ledger of events whose state is read from a snapshot and the events after it.

Events are appended to the newest *generation*, a folder.  Compaction opens a new generation and folds all but the one
before it into a snapshot: one row per run with what later events can change.  A reader takes the newest snapshot and
the few generations after it, so its work depends on the number of runs and recent events, not on all that ever
happened.  Snapshots are written whole before they are named, and a generation is folded only when a newer one has been
open since the compaction before, so an append that began earlier is not missed if it takes less than that time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dqloom.operators import ledger


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders ``<prefix><number>`` in a folder, from one listing of it."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


class History:
    """Events and snapshots below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _generation(self, number: int) -> str:
        return f"{self.path}/generation-{number}"

    def _newest_snapshot(self) -> int:
        return max(_numbers(self.spark, self.path, "snapshot-"), default=-1)

    def append(self, events: DataFrame) -> None:
        """Add events to the newest generation."""
        newest = max(_numbers(self.spark, self.path, "generation-"), default=0)
        events.write.mode("append").parquet(self._generation(newest))

    def _partial(self, first: int, last: int) -> DataFrame | None:
        """What the events of some generations say, None where there are none."""
        known = [g for g in _numbers(self.spark, self.path, "generation-") if first <= g <= last]
        stored = [self._generation(g) for g in known if self._has_rows(self._generation(g))]
        if not stored:
            return None
        return ledger.partial_state(self.spark.read.schema(ledger.BATCH_EVENT_SCHEMA).parquet(*stored))

    def _has_rows(self, folder: str) -> bool:
        files, place = _files(self.spark, folder)
        return any(status.getPath().getName().endswith(".parquet") for status in files.listStatus(place))

    def _merged(self, last: int) -> DataFrame:
        """One mergeable row per run, from the newest snapshot up to generation ``last``."""
        upto = self._newest_snapshot()
        parts = [] if upto < 0 else [self.spark.read.schema(ledger.PARTIAL_SCHEMA).parquet(f"{self.path}/snapshot-{upto}")]
        tail = self._partial(upto + 1, last)
        if tail is not None:
            parts.append(tail)
        if not parts:
            return self.spark.createDataFrame([], ledger.PARTIAL_SCHEMA)
        return ledger.merged_states(parts[0].unionByName(parts[1])) if len(parts) > 1 else parts[0]

    def state(self) -> DataFrame:
        """``ledger.batch_state`` of all events."""
        newest = max(_numbers(self.spark, self.path, "generation-"), default=0)
        return ledger.finished_state(self._merged(newest))

    def compact(self) -> int:
        """Open a new generation and fold the finished ones; returns the number of the last one folded (-1: none)."""
        generations = _numbers(self.spark, self.path, "generation-")
        newest = max(generations, default=0)
        files, place = _files(self.spark, self._generation(newest + 1))
        last = newest - 1
        if last > self._newest_snapshot():
            # complete under another name first; a name is given once
            written = f"{self.path}/_writing-{uuid.uuid4().hex}"
            self._merged(last).write.parquet(written)
            _, source = _files(self.spark, written)
            _, target = _files(self.spark, f"{self.path}/snapshot-{last}")
            if not files.rename(source, target):
                raise OSError(f"snapshot {last} was not stored")
        files.mkdirs(place)
        return last

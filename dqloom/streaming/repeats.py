"""Keys that come back in later micro-batches, found with keyed state.

How often each key has been seen is kept in Spark's state store, so a micro-batch looks at its own keys only, however
much was stored before it.  For many keys, let the store be the disk-based one
(spark.sql.streaming.stateStore.providerClass = ...RocksDBStateStoreProvider); the default one is held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def _counted(keys: Sequence[str]):
    """Counts per key within what a task reads, so a hot key crosses the shuffle once per Arrow batch of a task."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.groupby(list(keys), dropna=False, as_index=False)["_n"].sum()

    return run


def _crossing(key, batches, state):
    """The key, in the micro-batch that brings it to two occurrences."""
    import pandas as pd

    before = state.get[0] if state.exists else 0
    now = before + int(sum(pdf["_n"].sum() for pdf in batches))
    state.update((now,))
    if before < 2 <= now:
        yield pd.DataFrame([[*key]], dtype=object)


def repeated(stream: DataFrame, keys: Sequence[str], count_null_keys: bool = True) -> DataFrame:
    """The keys of a stream that are held by more than one row, each once: when its second row arrives.

    Null keys form a key of their own or do not count, as for the check on stored tables.
    """
    rows = stream.select(*keys)
    if not count_null_keys:
        rows = rows.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    schema = StructType([*rows.schema.fields, StructField("_n", LongType())])
    counted = rows.withColumn("_n", F.lit(1).cast("bigint")).mapInPandas(_counted(keys), schema)

    def crossing(key, batches, state):
        for pdf in _crossing(key, batches, state):
            pdf.columns = list(keys)
            yield pdf

    return counted.groupBy(*keys).applyInPandasWithState(crossing, rows.schema, "seen BIGINT", "update", "NoTimeout")


def watch(found: DataFrame, path: str, checkpoint: str, then: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Store the repeated keys of each micro-batch below ``path``; ``then`` gets the batch number and all keys stored so far.

    A batch that is replayed after a failure replaces what it wrote.
    """

    def process(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if then:
            layout = StructType([*batch.schema.fields, StructField("epoch", LongType())])
            stored = batch.sparkSession.read.schema(layout).parquet(path)
            then(epoch, stored.filter(F.col("epoch") <= epoch))

    return found.writeStream.outputMode("update").foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

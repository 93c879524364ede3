"""Chunks that arrive over time: idempotent appends to a manifest, and running counts with late rows.

Dedup and splits need the whole table and stay in batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from brindle.operators.normalize import to_do

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
KNOWN = "known"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_manifest(stream: DataFrame, target: str, key: str, checkpoint: str) -> DataStreamWriter:
    """Appends rows whose key the target lacks; a batch that is run again adds nothing. Every batch reads the target's keys:
    `append_keyed` doesn't.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
        new = batch.dropDuplicates([key])
        if there:
            new = to_do(new, spark.read.parquet(target), key)
        new.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


class _FirstOfKey(StatefulProcessor):
    """Lets the least row of a key through, in the batch in which the key comes first; the state is that it was there."""

    def __init__(self, order: list[str], ttl: int | None):
        self.order, self.ttl = order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "there boolean", self.ttl)

    def _place(self, row: Row) -> tuple:
        return tuple((v is None, v != v, 0 if v is None or v != v else v) for v in (row[c] for c in self.order))

    def handleInputRows(self, key: object, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new = not self.seen.exists()
        best = None  # rows stream by; one is held
        for row in rows:
            if new and row[KNOWN]:
                new = False
                self.seen.update((True,))
            if new and (best is None or self._place(row) < self._place(best)):
                best = row
        if new and best is not None:
            self.seen.update((True,))
            yield Row(**{c: best[c] for c in best.asDict() if c != KNOWN})

    def close(self) -> None:
        pass


def first_of_key(stream: DataFrame, key: str, order: list[str], ttl: str | None = None, known: str | None = None) -> DataFrame:
    """The stream's rows whose key has not come before: of a batch's rows of a key the first by `order`, nulls last; rows that
    are equal there are taken as they come, so name columns that tell rows apart and can be compared.

    Keys are state, kept by the cluster's tasks, so a batch costs what it brings, however much was taken before. With a ttl
    ('30 days'), a key that was let through longer ago than that is new again. known: a folder of Parquet files whose keys
    count as seen; what is there comes with the first batch, once. A null key is a key. The state needs the RocksDB store,
    which `append_keyed` sets.
    """
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    # names of their own on the way: a processor's rows lose names that are no identifiers. Rows, not pandas: there nulls
    # make whole numbers floats, and beside a null key the rows of other keys were lost
    names = {c: f"c{n}" for n, c in enumerate(stream.columns)}
    plain = stream.toDF(*names.values())
    rows = plain.withColumn(KNOWN, F.lit(False))
    if known:
        there = stream.sparkSession.readStream.schema(stream.select(F.col(f"`{key}`")).schema).parquet(known).toDF(names[key])
        rows = rows.unionByName(there.withColumn(KNOWN, F.lit(True)), allowMissingColumns=True)
    # the worker that a stream's driver starts has no files that were added to the context: the class goes along by value
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    first = _FirstOfKey([names[c] for c in order], ms)
    return rows.groupBy(names[key]).transformWithState(first, plain.schema, "Append", "ProcessingTime" if ms else "None").toDF(*names)


def append_keyed(stream: DataFrame, target: str, key: str, order: list[str], checkpoint: str, ttl: str | None = None, known: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that appends `first_of_key` to Parquet at target; trigger as for a stream's writer. Without one
    the query takes all that is there and ends: in one batch if there is a ttl, else in as many as the source makes.

    A batch is committed with its state, so after a restart from the checkpoint nothing is lost or taken twice, and the target
    is never read. Without its checkpoint a query knows nothing of the target, and a new query's file log doesn't list what
    another one wrote: give the old target as `known` and write to a new one.
    """
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)  # a query takes the settings that hold when it starts
    try:
        out = first_of_key(stream, key, order, ttl, known).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        # a time to live asks for one more batch for ever, which availableNow would wait out
        return out.trigger(**(trigger or ({"once": True} if ttl else {"availableNow": True}))).start(target)
    finally:
        conf.set(PROVIDER, before)


def windowed_counts(stream: DataFrame, ts: str, kind: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and kind; rows later than `late` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def distinct_keys(stream: DataFrame, key: str, ts: str, late: str = "2 hours") -> DataFrame:
    """Each key once within the lateness."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])

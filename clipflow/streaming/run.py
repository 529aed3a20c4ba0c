"""Running a stream over what is there now, into a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path

#: The store whose states can be maps and have timers, which operators of ``clipflow.streaming`` need. States with
#: timers ask for one more micro-batch after each, without end; only arriving rows make one here.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _store(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_to_table(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Process all available input in micro-batches and return the written table.

    Results, offsets and state live in the shared folder, so a lost executor or a
    restarted query goes on where the last complete micro-batch ended. Another call with
    the same ``path`` goes on with what has arrived since.
    """
    spark = stream.sparkSession
    target = path or scratch_path(spark, "stream")
    with _store(spark):
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{target}/_progress")
            .trigger(availableNow=True)
            .start(f"{target}/rows")
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")


def run_batches(
    stream: DataFrame, work: Callable[..., DataFrame], path: str | None = None, look_back: bool = False
) -> DataFrame | None:
    """Apply ``work`` to the rows of every micro-batch and return all results; None if nothing has ever arrived.

    The rows are written before ``work`` reads them, which may be often, and results go to a folder that the
    number of the micro-batch names: one that is repeated after a failure replaces its own and adds nothing.
    With ``look_back``, ``work`` also gets the results of all earlier micro-batches, or None for the first.
    """
    spark = stream.sparkSession
    target = path or scratch_path(spark, "stream")

    def step(rows: DataFrame, number: int) -> None:
        arrived = f"{target}/arrived/batch={number}"
        rows.write.mode("overwrite").parquet(arrived)
        known = [_results(spark, target, number)] if look_back else []
        done = work(spark.read.schema(rows.schema).parquet(arrived), *known)
        done.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    with _store(spark):
        query = (
            stream.writeStream.foreachBatch(step)
            .outputMode("append")
            .option("checkpointLocation", f"{target}/_progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return _results(spark, target)


def _results(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """Rows of the micro-batches that were written whole, of those numbered below ``before`` if given; None without any."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/rows/batch=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    whole = [int(mark.getPath().getParent().getName().partition("=")[2]) for mark in found]
    if not [number for number in whole if before is None or number < before]:
        return None
    rows = spark.read.parquet(f"{target}/rows")
    return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of every key the rows of its highest ``revision``, without that column."""
    last = F.max("revision").over(Window.partitionBy(*keys))
    return rows.withColumn("_last", last).filter(F.col("revision") == F.col("_last")).drop("_last", "revision")

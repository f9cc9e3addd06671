"""The event log as a stream: tail by checkpointed offsets, latest state, journal replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators.state import TERMINAL, append_if_absent


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 200) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tail(events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to ``sink`` and end when all is read; a later call goes on from the checkpoint."""
    return events.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_progress(events: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """The newest value by run, as a streaming aggregate."""
    return events.groupBy(run).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def replay(journal: DataFrame, log: str, checkpoint: str, identity: list[str]) -> StreamingQuery:
    """Append journal rows that the log lacks, batch by batch; a batch that runs again appends nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema(batch.schema).parquet(log) if exists(spark, log) else batch.limit(0)
        append_if_absent(held, batch, identity).write.mode("append").parquet(log)

    return journal.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


# States of a run.
#: Which state may follow which; terminal states absorb but for a resumed run.
ALLOWED = {
    "queued": ("running", "cancelling", "cancelled"),
    "running": ("completed", "completed_with_warnings", "failed", "cancelling", "interrupted", "awaiting_outline", "awaiting_source"),
    "cancelling": ("cancelled", "completed", "completed_with_warnings", "failed"),
    "interrupted": ("queued", "running", "cancelled"),
    "awaiting_outline": ("queued", "cancelled"),
    "awaiting_source": ("queued", "cancelled"),
    "failed": ("queued",),
    "cancelled": ("queued",),
    "completed_with_warnings": ("queued",),
    "completed": (),
}


def invalid_transitions(states: DataFrame, run: str, order: str, status: str = "status") -> DataFrame:
    """State rows that may not follow the row before them; a run begins queued."""
    before = F.lag(status).over(Window.partitionBy(run).orderBy(order))
    pairs = [f"{a}>{b}" for a, after in ALLOWED.items() for b in after] + [">queued"]
    step = F.concat(F.coalesce(before, F.lit("")), F.lit(">"), F.col(status))
    return states.withColumn("before", before).withColumn("_step", step).filter(~F.col("_step").isin(*pairs)).drop("_step")


def is_final(status):
    return status.isin(*TERMINAL)

"""Streams by run that end: a tail that closes when its run is over, and a bounded buffer of the newest events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.state import TERMINAL

EVENT = "run bigint, id bigint, at timestamp, kind string, data string"
SENT = "run bigint, id bigint, kind string, data string"
BUFFER = "run bigint, id bigint, kind string, data string, missing bigint"
#: State of a tail by run, times in microseconds: a run that is over closes when the stream comes to ``due``.
HELD_TAIL = "run bigint, cursor bigint, over boolean, latest bigint, due bigint"
#: State of a buffer: its events, each with how many of the run went and the largest id that did.
HELD_BUFFER = "run bigint, id bigint, kind string, data string, missing bigint, below bigint"
#: Events of a batch and ends, as they stand in the files of :func:`drain`; what is not fresh is not sent.
_MET = SENT + ", at bigint, fresh boolean"
#: The state store that streams with state of their own need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DrainingTail(StatefulProcessor):
    """Sends a run's events in order, each once, and closes when the run is over and the stream has come ``idle_ms`` past its last event.

    State of a run is its cursor, the last id sent - an event at or below it was
    sent or came too late, so ids must rise from batch to batch - whether its last status is a final one, and
    its latest time. A run
    that is over waits for events that were committed after its end: a timer on
    the stream's watermark, which each of them puts off, sends ``stream-end`` and closes it. State stays
    with a closed run, so that repeats stay out; what comes behind its cursor is sent, and closes it again unless it is resumed.
    """

    def __init__(self, idle_ms: int, status: str = "status"):
        self.idle_ms, self.status = idle_ms, status

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "id bigint")
        self.over = handle.getValueState("over", "over boolean")
        self.latest = handle.getValueState("latest", "at_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        after = self.cursor.get()[0] if self.cursor.exists() else -1
        events = pd.concat(list(rows)).drop_duplicates("id").sort_values("id")
        fresh = events[events["id"] > after]
        if len(fresh):
            self.cursor.update((int(fresh["id"].iloc[-1]),))
            done = (fresh["kind"] == self.status) & fresh["data"].isin(TERMINAL)
            # A later state that is not terminal opens the run again.
            states = fresh[fresh["kind"] == self.status]
            if len(states):
                if bool(done[states.index[-1]]):
                    self.over.update((True,))
                else:
                    self.over.clear()
        # Times need not rise with ids, within a batch or between batches.
        latest = max(int(events["at_ms"].max()), self.latest.get()[0] if self.latest.exists() else 0)
        self.latest.update((latest,))
        waits = [timer[0] if isinstance(timer, tuple) else timer for timer in self.handle.listTimers()]
        for at in waits:
            self.handle.deleteTimer(at)
        if self.over.exists() and (waits or len(fresh)):
            self.handle.registerTimer(latest + self.idle_ms)
        yield pd.DataFrame({"run": key[0], "id": fresh["id"], "kind": fresh["kind"], "data": fresh["data"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.cursor.get()[0] if self.cursor.exists() else None
        yield pd.DataFrame({"run": [key[0]], "id": [last], "kind": ["stream-end"], "data": ["terminal"]})

    def close(self) -> None:
        pass


def draining_tail(events: DataFrame, idle_ms: int = 500, late: str = "0 seconds") -> DataFrame:
    """``run, id, kind, data`` to send, from a stream of :data:`EVENT` rows; needs :data:`STORE`.

    Ends wait until the stream has come ``late`` farther. An event is never left
    out for its time: the column of the watermark goes, by which Spark would drop rows behind it.
    """
    timed = events.withWatermark("at", late).select("run", "id", F.unix_millis("at").alias("at_ms"), "kind", "data")
    return timed.groupBy("run").transformWithStateInPandas(DrainingTail(idle_ms), SENT, "append", "EventTime")


class NewestEvents(StatefulProcessor):
    """The newest ``size`` events of a run, by id: repeats are dropped, the oldest go, and a gap says how many went.

    State is these events, how many went and the largest id that did. An event
    at or below that id is taken for a repeat, so the result is the same in one
    batch and in many unless an event comes behind ``size`` newer ones.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Read and written as a whole: a call to the store each, not one for each event.
        self.held = handle.getListState("held", "id bigint, kind string, data string")
        self.gone = handle.getValueState("gone", "count bigint, below bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, below = self.gone.get() if self.gone.exists() else (0, -1)
        held = {i: (kind, data) for i, kind, data in self.held.get()}
        # Of a batch all ids are looked at, and the events of the largest are kept.
        seen, new = [np.array(list(held), np.int64)], {}
        for part in rows:
            part = part[part["id"] > below]
            seen.append(part["id"].to_numpy(np.int64))
            new.update((r.id, (r.kind, r.data)) for r in part.nlargest(self.size, "id").itertuples(index=False) if r.id not in held)
            new = {i: new[i] for i in sorted(new)[-self.size :]}
        ids = np.unique(np.concatenate(seen))
        kept, out = ids[-self.size :].tolist(), ids[: -self.size]
        if len(out):
            count, below = count + len(out), int(out[-1])
        held = {i: new.get(i) or held[i] for i in kept}
        self.gone.update((count, below))
        ids = sorted(held)
        self.held.put([(i, *held[i]) for i in ids])
        yield pd.DataFrame({"run": key[0], "id": ids, "kind": [held[i][0] for i in ids], "data": [held[i][1] for i in ids], "missing": count})

    def close(self) -> None:
        pass


def newest_events(events: DataFrame, size: int = 300) -> DataFrame:
    """``run, id, kind, data, missing``: after each batch the buffer of every run that it touched; needs :data:`STORE`."""
    return events.groupBy("run").transformWithStateInPandas(NewestEvents(size), BUFFER, "Update", "None")


def _folded(events: DataFrame, folder: str, schema: str, fold: Callable[[DataFrame, DataFrame, int], DataFrame], then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """A stream whose state is a table by batch: ``fold(held, batch, number)`` makes the next of the last, ``then`` sees it written.

    A batch that runs again starts from the same state and writes the same files; states before the last two go.
    """
    adaptive = "spark.sql.adaptive.enabled"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Off in streams, for the sake of the store; a small batch would run all shuffle partitions.
        spark.conf.set(adaptive, events.sparkSession.conf.get(adaptive))
        state = lambda n: spark.read.schema(schema).parquet(f"{folder}/state/{n}")
        fold(state(number - 1) if number else spark.createDataFrame([], schema), batch, number).write.mode("overwrite").parquet(f"{folder}/state/{number}")
        if then:
            then(state(number), number)
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/{number - 2}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def drain(events: DataFrame, folder: str, idle_ms: int = 500, status: str = "status") -> StreamingQuery:
    """Sends what :func:`draining_tail` does, for batches that touch many runs; :func:`sent` reads it.

    That calls a Python function and the store several times for every run of a
    batch; here all runs of a batch meet their state in one join.
    """
    ended = (F.col("kind") == status) & F.col("data").isin(*TERMINAL)

    def fold(held: DataFrame, batch: DataFrame, number: int) -> DataFrame:
        mark = held.agg(F.max("latest")).first()[0]
        rows = batch.select("run", "id", "kind", "data", F.unix_micros("at").alias("at")).repartition("run").dropDuplicates(["run", "id"])
        met = rows.join(held.select("run", "cursor").hint("merge"), "run", "left").withColumn("fresh", F.col("cursor").isNull() | (F.col("id") > F.col("cursor")))
        met.drop("cursor").write.mode("overwrite").parquet(f"{folder}/sent/{number}/events")
        met = batch.sparkSession.read.schema(_MET).parquet(f"{folder}/sent/{number}/events")
        state_id = F.when(F.col("fresh") & (F.col("kind") == status), F.col("id"))
        news = met.groupBy("run").agg(F.max(F.when(F.col("fresh"), F.col("id"))).alias("to"), F.max_by(ended, state_id).alias("ended"), F.max("at").alias("at"), F.max("fresh").alias("fresh"))
        now = held.join(news.hint("merge"), "run", "full")
        # A later state that is not terminal opens the run again; times need not rise with ids.
        now = now.select("run", F.coalesce("to", "cursor").alias("cursor"), F.coalesce("ended", "over", F.lit(False)).alias("over"), F.greatest("latest", "at").alias("latest"), F.when(F.col("due") > F.lit(mark), F.col("due")).alias("due"), "fresh")
        put_off = F.when(F.col("over") & (F.col("due").isNotNull() | F.col("fresh")), F.col("latest") + idle_ms * 1000)
        return now.select("run", "cursor", "over", "latest", F.when(F.col("fresh").isNull(), F.col("due")).otherwise(put_off).alias("due"))

    def close(held: DataFrame, number: int) -> None:
        mark = held.agg(F.max("latest")).first()[0]
        ends = held.filter(F.col("due") <= F.lit(mark)).select("run", F.col("cursor").alias("id"), F.lit("stream-end").alias("kind"), F.lit("terminal").alias("data"), F.lit(None).cast("bigint").alias("at"), F.lit(True).alias("fresh"))
        ends.write.mode("overwrite").parquet(f"{folder}/sent/{number}/ends")

    return _folded(events, folder, HELD_TAIL, fold, close)


def sent(spark: SparkSession, folder: str) -> DataFrame:
    """``run, id, kind, data`` that :func:`drain` has sent into ``folder``."""
    return spark.read.schema(_MET).parquet(f"{folder}/sent/*/*").filter("fresh").select("run", "id", "kind", "data")


def keep_newest(events: DataFrame, folder: str, size: int = 300) -> StreamingQuery:
    """Holds what :func:`newest_events` does, for batches that touch many runs, by a window over all of them; :func:`buffers` reads it."""
    run = Window.partitionBy("run")
    newest = run.orderBy(F.desc("id"), F.desc("old"))

    def fold(held: DataFrame, batch: DataFrame, number: int) -> DataFrame:
        new = batch.select("run", "id", "kind", "data").withColumn("old", F.lit(False))
        rows = held.withColumn("old", F.lit(True)).unionByName(new, allowMissingColumns=True)
        rows = rows.select("run", "id", "kind", "data", "old", F.coalesce(F.max("missing").over(run), F.lit(0)).alias("missing"), F.max("below").over(run).alias("below"), F.lag("id").over(newest).alias("after"))
        # An event at or below the largest id that went is taken for a repeat.
        rows = rows.filter((F.col("old") | F.col("below").isNull() | (F.col("id") > F.col("below"))) & (F.col("after").isNull() | (F.col("after") != F.col("id"))))
        rows = rows.withColumn("place", F.row_number().over(newest)).withColumn("n", F.count("*").over(run)).withColumn("went", F.max(F.when(F.col("place") == size + 1, F.col("id"))).over(run))
        return rows.filter(F.col("place") <= size).select("run", "id", "kind", "data", (F.col("missing") + F.greatest(F.col("n") - size, F.lit(0))).alias("missing"), F.coalesce("went", "below").alias("below"))

    return _folded(events, folder, HELD_BUFFER, fold)


def buffers(spark: SparkSession, folder: str) -> DataFrame:
    """``run, id, kind, data, missing`` as :func:`keep_newest` holds it in ``folder``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    last = max(int(s.getPath().getName()) for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))
    return spark.read.schema(HELD_BUFFER).parquet(f"{folder}/state/{last}").drop("below")

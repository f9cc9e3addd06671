"""Key-value state, event logs and retention over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a run.
TERMINAL = ("completed", "completed_with_warnings", "failed", "cancelled", "awaiting_source", "awaiting_outline")
ACTIVE = ("queued", "running", "cancelling", "interrupted")


def latest_by_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key; ``order`` must be unique within a key."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*keys, "last.*")


def upsert(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``changes`` over ``state``: rows of equal keys are replaced."""
    return state.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def append_if_absent(log: DataFrame, rows: DataFrame, identity: list[str]) -> DataFrame:
    """``rows`` that the log does not hold yet, each once."""
    return rows.dropDuplicates(identity).join(log.select(*identity).distinct(), identity, "left_anti")


def keyset_page(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The next ``size`` rows by key."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(size)


def tail_ascending(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The last ``size`` rows, in ascending order."""
    return rows.orderBy(F.desc(key)).limit(size).orderBy(key)


def is_terminal(status: Column) -> Column:
    return ~status.isin(*ACTIVE)


def cut_oldest(rows: DataFrame, size: Column, order: list[str], cap: int, batch: int = 100, batches: int = 20) -> DataFrame:
    """Rows that stay when the oldest go in batches until the total is at most ``cap``.

    Batch by batch the rows before it are summed by an aggregate, so that no
    window runs over the whole table: positions come from a range of the order,
    as only ``batch * batches`` rows can go.
    """
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"))
    oldest = rows.withColumn("_size", size).orderBy(*order).limit(batch * batches)
    numbered = oldest.withColumn("_batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / batch))  # at most batch * batches rows
    by_batch = numbered.groupBy("_batch").agg(F.sum("_size").alias("_freed"))
    before = by_batch.withColumn("_before", F.coalesce(F.sum("_freed").over(Window.orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gone = before.crossJoin(F.broadcast(total)).filter(F.col("total") - F.col("_before") > cap).select("_batch")
    return rows.join(numbered.join(gone, "_batch").select(*order), order, "left_anti")


def expired(rows: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows older than ``days`` before ``now``."""
    return rows.filter(F.col(at) < F.to_timestamp(F.lit(now)) - F.make_interval(days=F.lit(days)))


def rate_window(requests: DataFrame, key: str, at: str, tokens: str, seconds: int = 60) -> DataFrame:
    """Adds ``rpm`` and ``tpm``: requests and tokens of the trailing window, the row's own included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("rpm", F.count("*").over(w)).withColumn("tpm", F.sum(tokens).over(w))


def reconcile(events: DataFrame, run: str, order: str, is_request: Column, is_response: Column, amount: Column) -> DataFrame:
    """By run: what confirmed responses left of the reservation made last before them.

    A response takes the newest request since the response before it; without
    one it releases nothing.
    """
    w = Window.partitionBy(run).orderBy(order)
    marked = events.withColumn("_req", is_request).withColumn("_resp", is_response).withColumn("_amount", amount)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("_span", F.coalesce(F.sum(F.col("_resp").cast("int")).over(earlier), F.lit(0)))
    in_span = Window.partitionBy(run, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    pending = placed.withColumn("_pending", F.last(F.when(F.col("_req"), F.col("_amount")), ignorenulls=True).over(in_span))
    unused = F.when(F.col("_resp") & F.col("_pending").isNotNull(), F.greatest(F.col("_pending") - F.col("_amount"), F.lit(0.0))).otherwise(0.0)
    return pending.groupBy(run).agg(F.sum(unused).alias("released"), F.count_if(F.col("_resp")).alias("responses"))

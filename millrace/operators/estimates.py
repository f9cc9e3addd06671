"""What a whole reading will cost, and what later requests see of its details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import excerpt, graph_budget, summary_maximum
from millrace.operators.ordering import dealt, everywhere

# Bytes around a passage and around a request, passages of a request, bytes of a view, and what a record of it takes besides.
ENVELOPE, OVERHEAD, PASSAGES, CONTEXT_BYTES, RECORD_BYTES = 256, 16_000, 36, 20_000, 40


def _div(a: Column, b) -> Column:
    return F.floor(a / b).cast("bigint")


def _ceil(a: Column, b) -> Column:
    return F.ceil(a / b).cast("bigint")


def reduction_work(leaves: Column) -> Column:
    """Requests that reduce so many summaries to one, four at a time; one that is left over costs nothing."""
    start = F.struct(leaves.cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("work"))
    step = lambda s, _: F.when(s["n"] > 1, F.struct(_ceil(s["n"], 4).alias("n"), (s["work"] + _div(s["n"], 4) + (s["n"] % 4 > 1).cast("bigint")).alias("work"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step, lambda s: s["work"])


def reading_cost(chunks: DataFrame, runs: DataFrame, scope: str) -> DataFrame:
    """Requests, tokens and minutes of reading all chunks of a run, and whether they are within its budget.

    ``chunks``: scope, path, bytes; ``runs``: scope, limit (bytes of a request),
    space (for the graph), concurrency, max_tokens, reserved, max_seconds,
    elapsed. Two and a half bytes count as a token, a request as a minute.
    """
    sums = chunks.groupBy(scope).agg(F.sum(F.col("bytes") + F.octet_length("path") + ENVELOPE).alias("source_bytes"), F.count("*").alias("chunks"))
    c = F.col
    leaves = F.greatest(_ceil(c("source_bytes"), F.greatest(_div(c("limit") * 9, 10), F.lit(1))), _ceil(c("chunks"), PASSAGES), F.lit(1))
    sized = runs.join(sums, scope, "left").withColumns({"source_bytes": F.coalesce("source_bytes", F.lit(0)), "chunks": F.coalesce("chunks", F.lit(0))}).withColumn("batches", leaves)
    sized = sized.withColumn("summaries", reduction_work(c("batches"))).withColumn("requests", c("batches") + c("summaries"))
    around = OVERHEAD + graph_budget(c("space"))
    given = c("source_bytes") + c("batches") * around + c("summaries") * (c("limit") + around)
    sized = sized.withColumn("tokens", _div(given * 100, 250) + _div(c("requests") * summary_maximum(c("limit")), 3)).withColumn("minutes", _ceil(c("requests"), c("concurrency")))
    left = {"tokens_left": F.greatest(c("max_tokens") - c("reserved"), F.lit(0)), "minutes_left": _div(F.greatest(c("max_seconds") - c("elapsed"), F.lit(0)), 60)}
    sized = sized.withColumns(left).withColumn("within", (c("tokens") <= c("tokens_left")) & (c("minutes") <= c("minutes_left")))
    return sized.select(scope, "source_bytes", "batches", "summaries", "requests", "tokens", "tokens_left", "minutes", "minutes_left", "within")


def context_view(details: DataFrame, scope: str, order: str, fields: list[str], text: str = "observation") -> DataFrame:
    """Adds ``view``, a detail as JSON, its text within an equal share of the view's bytes, and ``excerpted``: whether it was cut.

    ``fields`` are the detail's columns, ``text`` among them; ids are left out where they are not named.
    """
    counts = details.groupBy(scope).agg(F.count("*").alias("_n"))
    met = dealt(details, order).join(everywhere(counts), [scope, "salt"]).drop("salt")
    whole = F.octet_length(F.to_json(F.struct(*fields)))
    around = F.greatest(whole - F.octet_length(text), F.lit(0)) + RECORD_BYTES
    limit = F.greatest(_div(F.lit(CONTEXT_BYTES), F.col("_n")) - around, F.lit(0)).cast("int")
    shown = [excerpt(F.col(text), limit).alias(f) if f == text else F.col(f) for f in fields]
    cut = F.octet_length(text) > limit
    return met.select(*details.columns, F.to_json(F.struct(*shown, cut.alias("excerpted"))).alias("view"), cut.alias("excerpted"))

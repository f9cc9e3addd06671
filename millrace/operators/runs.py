"""Findings under a budget, coverage of graphs and trees, and runs after a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.graph import tree_closure

# States of a run that has ended well.
COMPLETED = ("completed", "completed_with_warnings")


def detail_cap(findings: DataFrame, scope: str, path: str, order: list[Column], identity: list[str], per_path: int = 4, most: int = 24) -> DataFrame:
    """The best findings of a scope: each ``identity`` once, ``per_path`` of a path, ``most`` in all.

    Adds ``place``. Findings of equal identity stand on the same path.
    """
    once = findings.withColumn("_nth", F.row_number().over(Window.partitionBy(scope, *identity).orderBy(*order))).filter("_nth = 1")
    capped = once.withColumn("_in_path", F.row_number().over(Window.partitionBy(scope, path).orderBy(*order))).filter(F.col("_in_path") <= per_path)
    placed = capped.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy(*order)))
    return placed.filter(F.col("place") <= most).drop("_nth", "_in_path")


def overlapping_findings(citations: DataFrame, evidence: DataFrame, path: str = "path") -> DataFrame:
    """``finding`` of each citation (finding, path, start, end) whose span meets evidence (path, start, end).

    Rows meet by path and block of lines, so a path with many spans is no
    nested loop over all of them.
    """
    block = 64
    spread = lambda df: df.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
    a, b = spread(citations).alias("a"), spread(evidence.select(path, "start", "end").distinct()).alias("b")
    meets = (F.col(f"a.{path}") == F.col(f"b.{path}")) & (F.col("a._block") == F.col("b._block")) & (F.col("a.start") <= F.col("b.end")) & (F.col("a.end") >= F.col("b.start"))
    return a.join(b, meets, "left_semi").select("finding").distinct()


def salvage(findings: DataFrame, scope: str, order: str, size: str, most: int) -> DataFrame:
    """Findings that stay when the last ones go until a scope's sizes are at most ``most`` together."""
    total = F.sum(size).over(Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return findings.withColumn("_total", total).filter(F.col("_total") <= most).drop("_total")


def graph_coverage(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts over files (supported, parse_errors), symbols (kind) and edges."""
    none = F.lit(0).cast("bigint")
    counted = files.agg(F.count("*").alias("files"), none.alias("symbols"), none.alias("edges"), F.count_if(~F.col("supported")).alias("unsupported_files"), F.count_if("parse_errors").alias("parse_error_files"))
    counted = counted.unionAll(symbols.agg(none, F.count_if(F.col("kind") != "file"), none, none, none)).unionAll(edges.agg(none, none, F.count("*"), none, none))
    row = counted.agg(*(F.sum(c).alias(c) for c in counted.columns))
    return row.withColumn("syntax_complete", (F.col("unsupported_files") == 0) & (F.col("parse_error_files") == 0))


def covered_files(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """By node of a tree (parent, node): files under it, and whether all its leaves (node, file, complete) are complete."""
    under = tree_closure(edges).select(F.col("ancestor"), "node")
    return under.join(leaves, "node").groupBy(F.col("ancestor").alias("node")).agg(F.countDistinct("file").alias("files"), F.bool_and("complete").alias("complete"))


def branch_level(levels: DataFrame, tree: str, target: Column) -> DataFrame:
    """``tree, level, width`` to show: from the root down while the next level is no farther beyond ``target`` than this one is below it; two nodes at least."""
    wider = F.lead("width").over(Window.partitionBy(tree).orderBy("level"))
    rows = levels.withColumn("_target", target).withColumn("_next", wider)
    goes_on = (F.col("width") < F.col("_target")) & (F.col("_next") - F.col("_target") <= F.greatest(F.col("_target") - F.col("width"), F.lit(0)))
    stops = rows.filter(~F.coalesce(goes_on, F.lit(False)))
    first = stops.groupBy(tree).agg(F.min_by(F.struct("level", "width"), "level").alias("at"))
    return first.select(tree, "at.level", "at.width").filter("width >= 2")


def settle_status(runs: DataFrame, journal: DataFrame) -> DataFrame:
    """Runs (run, status) after journalled states (run, number, status): the last one holds, but completed runs stay."""
    last = journal.groupBy("run").agg(F.max_by("status", "number").alias("_last"))
    settled = F.when(F.col("status").isin(*COMPLETED), F.col("status")).otherwise(F.coalesce("_last", "status"))
    return runs.join(last, "run", "left").select("run", settled.alias("status"))


def invalidate(steps: DataFrame, changed: DataFrame, pattern: str) -> DataFrame:
    """Stored steps (run, step) without those that match ``pattern`` in runs that changed."""
    gone = steps.filter(F.col("step").rlike(pattern)).join(changed.select("run").distinct(), "run", "left_semi").select("run", "step").distinct()
    return steps.join(gone, ["run", "step"], "left_anti")


def resumable(runs: DataFrame, recoveries: DataFrame, most: int = 3, a_pass: int = 10) -> DataFrame:
    """The next ``a_pass`` failed runs (run, status, error, cancel_requested), those recovered under ``most`` times, with their new count."""
    failed = runs.filter((F.col("status") == "failed") & F.col("error").startswith("DB_UNAVAILABLE:") & ~F.col("cancel_requested")).orderBy("run").limit(a_pass)
    counted = failed.join(recoveries.select("run", "recoveries"), "run", "left").withColumn("recoveries", F.coalesce("recoveries", F.lit(0)))
    return counted.filter(F.col("recoveries") < most).select("run", (F.col("recoveries") + 1).alias("recoveries"))


def publication(stored: Column, found: Column, status: Column) -> Column:
    """A run's status after its publication was cut off: committed if the target holds what was written."""
    return F.when(status.isin(*COMPLETED), status).when(stored.eqNullSafe(found), "completed").otherwise("failed")

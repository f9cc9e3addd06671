"""Outlines, findings and shared leaves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_first(parts: list[DataFrame], scope: list[str], identity: list[str]) -> DataFrame:
    """Rows of all parts, the first of each identity, in order of part and ``pos``."""
    rows = None
    for number, part in enumerate(parts):
        numbered = part.withColumn("_part", F.lit(number))
        rows = numbered if rows is None else rows.unionByName(numbered)
    keys = [*scope, *identity]
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_part", "pos")).alias("first"))
    return first.select(*keys, "first.*").drop("_part")


def retain_details(old: DataFrame, new: DataFrame, topic: str = "topic") -> DataFrame:
    """Earlier findings whose topic the new ones do not replace, and the new ones."""
    return old.join(new.select(topic).distinct(), topic, "left_anti").unionByName(new)


def keep_cited(findings: DataFrame, evidence: DataFrame, scope: str, ids: str = "evidence_ids") -> DataFrame:
    """Findings cut to evidence of their scope; those that cite none of it go."""
    held = evidence.select(scope, "id").distinct()
    each = findings.select(scope, "finding", F.posexplode(ids).alias("pos", "id")).join(held, [scope, "id"])
    return each.groupBy(scope, "finding").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias(ids))


def uncited(evidence: DataFrame, findings: DataFrame, scope: str, ids: str = "evidence_ids") -> DataFrame:
    """Evidence that no finding of its scope cites."""
    cited = findings.select(scope, F.explode(ids).alias("id")).distinct()
    return evidence.join(cited, [scope, "id"], "left_anti")


def title_dependencies(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """``outline, position, needs``: wanted titles (outline, position, title) that name exactly one, earlier section."""
    named = sections.groupBy("outline", "title").agg(F.count("*").alias("n"), F.min("position").alias("needs")).filter("n = 1")
    return wanted.join(named, ["outline", "title"]).filter(F.col("needs") < F.col("position")).select("outline", "position", "needs").distinct()


def ownership(claims: DataFrame, scope: str) -> DataFrame:
    """One section for each leaf that several claim: ``scope, leaf, section``.

    ``claims`` has (scope, leaf, section, score), leaves numbered in reading
    order. The best score wins, then the section that has won fewest contested
    leaves, then the first; this goes leaf by leaf, a scope's rows streaming
    through its task in order.
    """
    kinds = claims.schema
    ordered = claims.select(scope, "leaf", "section", "score").repartition(scope).sortWithinPartitions(scope, "leaf", "section")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, wins, pending = None, {}, []

        def settled() -> tuple:
            top = max(s for *_, s in pending)
            best = [c for *_, c, s in pending if s == top]
            pick = min(best, key=lambda c: (wins.get(c, 0), c))
            if len(pending) > 1:
                wins[pick] = wins.get(pick, 0) + 1
            return pending[0][0], pending[0][1], pick

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if pending and row[:2] != pending[0][:2]:
                    out.append(settled())
                    pending = []
                if row[0] != current:
                    current, wins = row[0], {}
                pending.append(row)
            yield pd.DataFrame(out, columns=[scope, "leaf", "section"])
        if pending:
            yield pd.DataFrame([settled()], columns=[scope, "leaf", "section"])

    kind = lambda c: kinds[c].dataType.simpleString()
    return ordered.mapInPandas(decide, f"{scope} {kind(scope)}, leaf {kind('leaf')}, section {kind('section')}")


def chapter_batches(branches: DataFrame, chapter: str, order: str, size: int = 16) -> DataFrame:
    """Adds ``batch``: runs of at most ``size`` branches of a chapter in order."""
    place = F.row_number().over(Window.partitionBy(chapter).orderBy(order)) - 1
    return branches.withColumn("batch", F.floor(place / size).cast("int"))


def plan_groups(nodes: DataFrame, scope: str, order: str, cost: str, limit: int, most: int = 4) -> DataFrame:
    """Groups of at most ``most`` neighbours whose costs fit ``limit`` together: ``scope, order, group``."""
    from millrace.operators.packing import batches

    return batches(nodes, [scope], order, cost, limit, most).withColumnRenamed("batch", "group")


def chunk_adjacency(sites: DataFrame, parents: DataFrame, call_weight: int = 5, parent_weight: int = 3) -> DataFrame:
    """Undirected weights between chunks: ``a < b, weight``.

    ``sites`` has (source, target) chunks of calls, ``parents`` (parent, child).
    """
    each = sites.select(F.col("source").alias("x"), F.col("target").alias("y"), F.lit(call_weight).alias("w")).unionAll(parents.select("parent", "child", F.lit(parent_weight)))
    return each.filter("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("weight"))

"""What a request may see: evidence and findings of its files, links in and out of them, branches of a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.paths import is_implementation
from millrace.operators.ordering import dealt, everywhere
from millrace.operators.planning import merge_first


def of_files(evidence: DataFrame, findings: DataFrame, files: DataFrame, scope: str, path: str = "path", ids: str = "evidence_ids") -> tuple[DataFrame, DataFrame]:
    """Evidence (scope, id, path) of a scope's files (scope, path), and findings (scope, finding, ids) that cite any of it."""
    held = evidence.join(files.select(scope, path).distinct(), [scope, path], "left_semi")
    cited = findings.select(scope, "finding", F.explode(ids).alias("id")).join(held.select(scope, "id").distinct(), [scope, "id"], "left_semi")
    return held, findings.join(cited.select(scope, "finding").distinct(), [scope, "finding"], "left_semi")


def classified(evidence: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``runtime_allowed``: whether a passage may prove what runs."""
    return evidence.withColumn("runtime_allowed", is_implementation(F.col(path)))


def anchors(retained: DataFrame, shown: DataFrame, scope: str) -> DataFrame:
    """Retained passages (scope, id, pos) that are not shown, the first of each id."""
    return merge_first([retained.join(shown.select(scope, "id").distinct(), [scope, "id"], "left_anti")], [scope], ["id"])


def all_resolve(planned: DataFrame, known: DataFrame, scope: str) -> DataFrame:
    """``scope, planned, resolved, complete``: how many planned ids (scope, id) are known."""
    marked = planned.select(scope, "id").distinct().join(known.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    found = marked.groupBy(scope).agg(F.count("*").alias("planned"), F.count("_known").alias("resolved"))
    return found.withColumn("complete", F.col("planned") == F.col("resolved"))


def full_anchors(planned: DataFrame, resolved: DataFrame, scope: str) -> DataFrame:
    """Planned prefixes (scope, prefix) as full ids where ``resolved`` (prefix, id) has one; ``changed`` counts a scope's others."""
    met = planned.join(resolved.select("prefix", "id"), "prefix", "left")
    return met.groupBy(scope).agg(F.array_sort(F.collect_set("id")).alias("ids"), F.count_if(F.col("id").isNull()).alias("changed"))  # planned ids of one section


def with_cited_originals(own: DataFrame, children: DataFrame, findings: DataFrame, scope: str) -> DataFrame:
    """A node's own passages (scope, id, pos), then those of its children that a child's finding (scope, id) cites, each id once."""
    cited = children.join(findings.select(scope, "id").distinct(), [scope, "id"], "left_semi")
    return merge_first([own, cited], [scope], ["id"])


def fully_cited(citations: DataFrame, evidence: DataFrame, scope: str) -> DataFrame:
    """``scope, cites_only``: whether all that a section cites (scope, id) is a full id of ``evidence``."""
    marked = citations.join(evidence.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    return marked.groupBy(scope).agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("cites_only"))


def seed_symbols(symbols: DataFrame, query: str, terms: tuple[str, ...], score: int = 1000) -> DataFrame:
    """Symbols (id, name, qualified) whose name is a term, or whose qualified name of over two bytes the query has."""
    named = F.lower("name").isin(*terms)
    asked = (F.octet_length("qualified") > 2) & F.lit(query.lower()).contains(F.lower("qualified"))
    return symbols.filter(named | asked).select("id", F.lit(score).alias("score"))


def target_span(kind: Column, start: Column, end: Column, signature_end: Column) -> Column:
    """Where a symbol points: containers to their signature, others to the whole."""
    stop = F.when(kind.isin("file", "module", "type", "implementation"), signature_end).otherwise(end)
    return F.struct(start.alias("start"), stop.alias("end"))


def links_of_scope(links: DataFrame, scope: DataFrame) -> DataFrame:
    """Links (file, owner, name, calls, kind, candidates array) seen from a scope of files (scope, file).

    By scope: links and calls between its files, calls that leave it, calls
    within one file, calls to names that nothing declares, and its files without any link.
    """
    files = scope.select("scope", "file").distinct()
    mine = files.join(links, "file", "left").select("scope", "file", "owner", "name", "calls", "kind", "candidates")
    reached = mine.filter("kind in ('resolved', 'ambiguous')").select("scope", "file", "owner", "name", F.explode("candidates").alias("place"))
    inside = reached.join(files.select("scope", F.col("file").alias("place")), ["scope", "place"], "left_semi").select("scope", "file", "owner", "name").distinct().withColumn("_inside", F.lit(True))
    met = mine.join(inside, ["scope", "file", "owner", "name"], "left")
    cross = F.col("kind").isin("resolved", "ambiguous")
    calls = lambda c: F.coalesce(F.sum(F.when(c, F.col("calls"))), F.lit(0)).cast("bigint")
    shown = cross & F.col("_inside").isNotNull()
    counted = met.groupBy("scope").agg(F.count_if(shown).alias("links"), calls(shown).alias("calls"), calls(cross & F.col("_inside").isNull()).alias("leaving"), calls(F.col("kind") == "internal").alias("same_file"), calls(F.col("kind") == "unresolved").alias("undeclared"))
    bare = met.groupBy("scope", "file").agg(F.count_if(shown).alias("n")).groupBy("scope").agg(F.count_if(F.col("n") == 0).alias("files_without_links"))
    return counted.join(bare, "scope")


def passage_records(symbols: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """What a passage (scope) holds, in four ranks: declarations, sites by owner, imports and bases, calls by target."""
    declared = symbols.select(scope, F.lit(0).alias("rank"), F.col("name").alias("what"), F.lit(1).cast("bigint").alias("times"))
    sites = edges.groupBy(scope, "owner").agg(F.count("*").alias("times")).select(scope, F.lit(1), F.col("owner"), "times")
    uses = edges.filter(F.col("kind").isin("imports", "inherits")).groupBy(scope, "target").agg(F.count("*").alias("times")).select(scope, F.lit(2), F.col("target"), "times")
    calls = edges.filter("kind = 'calls'").groupBy(scope, "target").agg(F.count("*").alias("times")).select(scope, F.lit(3), F.col("target"), "times")
    return declared.unionAll(sites).unionAll(uses).unionAll(calls)


def branch_groups(nodes: DataFrame, reach: DataFrame, chosen: int, most: int = 16, run: int = 8) -> DataFrame:
    """``tree, node, label``: branches (nodes of level ``chosen``) by their ancestor in the deepest level above of 2 to ``most`` nodes, else in runs.

    ``nodes`` has (tree, node, level), ``reach`` (ancestor, node).
    """
    widths = nodes.filter(F.col("level") < chosen).groupBy("tree", "level").agg(F.count("*").alias("n")).filter(F.col("n").between(2, most))
    above = widths.groupBy("tree").agg(F.max("level").alias("above"))
    heads = nodes.join(above, ["tree"]).filter("level = above").select("tree", F.col("node").alias("ancestor"), F.row_number().over(Window.partitionBy("tree").orderBy("node")).alias("number"))
    branches = nodes.filter(F.col("level") == chosen).select("tree", "node")
    grouped = branches.join(reach.select("ancestor", "node"), "node").join(heads, ["tree", "ancestor"]).select("tree", "node", "number")
    place = F.row_number().over(Window.partitionBy("tree").orderBy("node"))
    runs = branches.join(above, "tree", "left_anti").withColumn("number", (F.floor((place - 1) / run) + 1).cast("int"))
    return grouped.unionByName(runs).select("tree", "node", F.concat(F.lit("G"), F.col("number").cast("string")).alias("label"))


def branch_labels(level: DataFrame, children: DataFrame) -> DataFrame:
    """``tree, node, label``: B1, B2, … for the nodes of a level (tree, node), B1.1, … for their children (node, child) from two on."""
    numbered = level.withColumn("_n", F.row_number().over(Window.partitionBy("tree").orderBy("node")))
    label = F.concat(F.lit("B"), F.col("_n").cast("string"))
    w = Window.partitionBy("node")
    below = numbered.join(children, "node").withColumn("_k", F.row_number().over(w.orderBy("child"))).withColumn("_of", F.count("*").over(w)).filter("_of >= 2")
    return numbered.select("tree", "node", label.alias("label")).unionAll(below.select("tree", F.col("child"), F.concat(label, F.lit("."), F.col("_k").cast("string"))))


def worst(rows: DataFrame, path: str, count: str, most: int = 5) -> DataFrame:
    """The ``most`` paths with the largest counts, ties by path."""
    return rows.filter(F.col(count) > 0).orderBy(F.desc(count), path).limit(most)


def with_fallback(rows: DataFrame, scope: str, order: str, excluded: Column) -> DataFrame:
    """Rows that are not ``excluded``, and all rows of a scope that would have none left."""
    marked = rows.withColumn("_out", F.coalesce(excluded, F.lit(False)))
    bare = marked.groupBy(scope).agg(F.min("_out").alias("_bare")).filter("_bare").select(scope, F.lit(True).alias("_all"))
    met = dealt(marked, order).join(everywhere(bare), [scope, "salt"], "left")
    return met.filter(~F.col("_out") | F.col("_all")).select(*rows.columns)

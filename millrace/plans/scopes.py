"""Queries over what a request may see, and over rules of runs, plans and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import paths, text
from millrace.operators import graph, planning, quality, rules, scopes, sections, state
from millrace.session import shared_folder
from millrace.sources import files as trees
from millrace.sources.tables import table
from millrace.streaming import events as streams


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as passages of their order, on their supplier's path."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return lines.select(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 50).alias("id"), (F.col("l_suppkey") % 10).alias("path"))


def scope_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of orders that cite passages on paths 1 to 4."""
    evidence = _evidence(spark, sf_dir)
    findings = evidence.select("scope", F.col("pos").alias("finding"), F.array("id", (F.col("id") + 1) % 50).alias("evidence_ids"))
    wanted = evidence.select("scope", "path").filter("path between 1 and 4")
    _, kept = scopes.of_files(evidence, findings, wanted, "scope")
    return kept.select("scope", "finding")


def planned_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = _evidence(spark, sf_dir).select("scope", "id")
    return scopes.all_resolve(planned, spark.range(40), "scope")


def known_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of document ids by source, as full ids where only one begins so."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source").select("source", F.sha2(F.col("doc_id").cast("string"), 256).alias("id"))
    planned = docs.select("source", F.left("id", F.lit(3)).alias("prefix")).distinct()
    met = scopes.full_anchors(planned, graph.prefix_resolve(planned.select("prefix").distinct(), docs.select("id"), 3), "source")
    return met.select("source", F.size("ids").cast("bigint").alias("known"), "changed")


def cited_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own passages on odd lines, children's on even ones, cited where the id is below 25."""
    evidence = _evidence(spark, sf_dir).select("scope", "id", "pos")
    return scopes.with_cited_originals(evidence.filter("pos % 2 = 1"), evidence.filter("pos % 2 = 0"), evidence.filter("id < 25"), "scope")


def missing_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _evidence(spark, sf_dir).select("scope", "id", "pos")
    return scopes.anchors(evidence, evidence.filter("pos <= 2"), "scope")


def cites_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.fully_cited(_evidence(spark, sf_dir), spark.range(45), "scope")


def cited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).groupBy("scope").agg(F.countDistinct("path").alias("files"))


def transmitted_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each order's passages as JSON with short ids, and what their originals take beside."""
    each = _evidence(spark, sf_dir).select("scope", F.octet_length(F.to_json(F.struct(F.left(F.col("id").cast("string"), F.lit(12)).alias("id"), "path"))).alias("bytes"), (F.lit(12) + F.length(F.col("path").cast("string")) + 96).alias("original"))
    return each.groupBy("scope").agg(F.sum("bytes").alias("bytes"), F.sum("original").cast("bigint").alias("originals"))


def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two passes, each topic, observation and list of ids once."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey")
    rows = lines.select(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("topic"), F.col("l_linestatus").alias("observation"), (F.col("l_suppkey") % 3).alias("ids"))
    return planning.merge_first([rows.filter("pos > 2"), rows.filter("pos <= 2")], ["scope"], ["topic", "observation", "ids"])


def seed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols; the query names one brand and a word."""
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    named = parts.select(F.col("p_partkey").alias("id"), F.element_at(F.split("p_name", " "), 1).alias("name"), F.col("p_brand").alias("qualified"))
    return scopes.seed_symbols(named, "how does Brand#13 use blue", text.terms_of("how does Brand#13 use blue"))


def target_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part", "p_partkey", "p_size")
    kind = F.when(F.col("p_size") % 2 == 0, "type").otherwise("function")
    span = scopes.target_span(kind, F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"), F.col("p_partkey") + 1)
    return parts.select("p_partkey", span.alias("s")).select("p_partkey", "s.start", "s.end")


def scope_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as calls between brands, seen from scopes of brands by their first digit."""
    from millrace.plans.graphs import link_fold

    links = link_fold(spark, sf_dir).withColumn("candidates", F.split("candidates", ","))
    brands = table(spark, sf_dir, "part", "p_brand").select(F.substring("p_brand", 7, 1).alias("scope"), F.col("p_brand").alias("file")).distinct()
    return scopes.links_of_scope(links, brands)


def passage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_shipdate", "l_suppkey", "l_linestatus")
    edges = lines.select(F.col("l_orderkey").alias("scope"), F.col("l_returnflag").alias("owner"), (F.col("l_suppkey") % 5).cast("string").alias("target"), F.when(F.col("l_linestatus") == "O", "calls").when(F.col("l_suppkey") % 2 == 0, "imports").otherwise("branch").alias("kind"))
    names = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select(F.col("o_orderkey").alias("scope"), F.col("o_orderpriority").alias("name"))
    return scopes.passage_records(names, edges, "scope")


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A four-ary tree over documents: edges, its closure, and nodes by level."""
    edges = table(spark, sf_dir, "documents", "doc_id").filter("doc_id > 0").select(((F.col("doc_id") - 1) / 4).cast("bigint").alias("parent"), F.col("doc_id").alias("node"))
    reach = graph.tree_closure(edges)
    return edges, reach, reach.filter("ancestor = 0").select(F.lit("t").alias("tree"), "node", F.col("depth").alias("level"))


def branch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reach, nodes = _tree(spark, sf_dir)
    return scopes.branch_groups(nodes, reach, 3).select("node", "label")


def branch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, nodes = _tree(spark, sf_dir)
    return scopes.branch_labels(nodes.filter("level = 2").select("tree", "node"), edges.select(F.col("parent").alias("node"), F.col("node").alias("child"))).select("node", "label")


def filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 20 error events."""
    return state.keyset_page(table(spark, sf_dir, "events", "event_id", "user_id", "event_type").filter("event_type = 'error'"), "event_id", 300, 20)


def array_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words 51 to 100 of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.array_join(F.slice(F.split("text", " "), 51, 50), " ").alias("words"))


def most_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("links"))
    return scopes.worst(counts, "l_suppkey", "links")


def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that documents gain and lose when some of their lines go, new ones come and others stay where they were."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    lines, k = F.split("text", "\n"), F.col("doc_id") % 5
    goes = lambda i: (i + k) % 4 == 0
    new = F.flatten(F.transform(lines, lambda x, i: F.concat(F.when(goes(i), F.array().cast("array<string>")).otherwise(F.array(x)), F.when((i + k) % 3 == 0, F.array(F.concat(F.lit("new "), i.cast("string"), F.lit("|")))).otherwise(F.array().cast("array<string>")))))
    return docs.select("doc_id", quality.line_diff(F.col("text"), F.array_join(new, "\n")).alias("d")).select("doc_id", "d.added", "d.removed", "d.equal")


def reading_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of every source: reading, summaries, graph, sections."""
    docs = table(spark, sf_dir, "documents", "source", "text").groupBy("source").agg(F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.count("*").alias("leaves"))
    n = F.col("leaves")
    return docs.select("source", text.summary_maximum(F.col("bytes")).alias("summary"), text.accepted_summary(n * 100, F.col("bytes")).alias("accepted"), text.graph_budget(F.col("bytes")).alias("graph"), text.section_ceiling(n).alias("sections"), text.branch_target(n).alias("branches"), text.content_dropped(F.col("bytes"), n * 900).alias("dropped"), text.reasoning_dominated(n, F.lit(60)).alias("reasoning"))


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    path = F.regexp_extract("url", r"^[a-z]+:/(/[^?#]*)", 1)
    return pages.select("page_id", paths.relative(path, ["/www", "/www.example", "/m"]).alias("rest"))


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests for their value in cents, 1000 a user at most."""
    requests = table(spark, sf_dir, "events", "event_id", "user_id", "value").select("user_id", "event_id", F.floor(F.coalesce("value", F.lit(0.0)) * 10).cast("bigint").alias("amount"))
    return rules.reservations(requests, "user_id", "event_id", "amount", 1000)


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits by user: each third repeats a request, each fifth has an old base."""
    numbered = table(spark, sf_dir, "events", "event_id", "user_id").withColumn("n", F.col("event_id") % 7)
    requests = numbered.select("user_id", "event_id", F.concat_ws(":", F.lit("r"), F.when(F.col("n") == 3, "same").otherwise(F.col("event_id").cast("string"))).alias("request"), F.when(F.col("n") == 5, 99).otherwise(0).alias("base"))
    return rules.revisions(requests, "user_id", "event_id", "request", "base")


def retention_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stay when the 100 oldest ended orders go."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running").alias("status"), (F.col("o_orderdate")).alias("at"))
    # Orders of one day go by key.
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("run"), "l_linenumber")
    _, children = rules.expired_with_children(orders, "at", "1998-01-01", {"lines": lines})
    return children["lines"].groupBy("run").agg(F.count("*").alias("lines"))


def recovery_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_custkey", "o_orderdate")
    k = F.col("o_custkey")
    rows = runs.select(F.col("o_orderkey").alias("run"), (k % 3 == 0).alias("journalled"), (k % 5 == 0).alias("cancel_requested"), (k % 7 == 0).alias("publishing"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.col("o_orderdate").alias("created_at"))
    return rules.recovery_steps(rows).select("run", "step")


def run_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether runs may go on, be approved, and are late; and how they are shown."""
    runs = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    k = F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed_with_warnings").when(F.col("o_orderstatus") == "P", "awaiting_outline").otherwise("running")
    rows = runs.select(F.col("o_orderkey").alias("run"), status.alias("status"), k.alias("k"))
    shown = rules.shown_status(rows.select("run", "status"), rows.filter("k % 4 = 0").select("run")).withColumnRenamed("status", "shown")
    judged = rows.select("run", rules.may_resume(F.col("status"), F.col("k") % 2 == 0, F.lit(3), F.col("k") % 5).alias("resume"), rules.may_approve(F.col("k") % 3, F.lit(1), F.col("k") % 2, F.col("status"), F.lit(False)).alias("approve"), rules.past_deadline(F.col("k"), F.lit(500), F.col("k") % 2 == 1).alias("late"))
    return judged.join(shown, "run")


def replans(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 4).cast("int").alias("iteration"))
    markers = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run"))
    return rules.replans(runs, markers, 4)


def cache_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts' parse results by content hash; documents of even sources are cached already."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").withColumn("key", F.sha2("text", 256))
    parse = lambda rows: rows.select("key", F.concat(F.size(F.split("text", "\n")).cast("string"), F.lit(" lines")).alias("value"))
    cache = parse(docs.filter(F.col("doc_id") % 2 == 0).dropDuplicates(["key"]))
    found, _ = rules.read_through(docs, cache, "key", parse)
    return found.select("doc_id", "value", "hit")


def publication_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    name = rules.publication_name(F.concat(F.lit("doc"), F.col("o_custkey").cast("string")), F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 3 == 0, None).otherwise("h"), F.when(F.col("o_custkey") % 2 == 0, "h"))
    return orders.select("o_orderkey", name.alias("name"))


def chapter_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as branches of orders: named by supplier, by group otherwise, some excluded."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").select(F.col("l_orderkey").alias("outline"), F.col("l_linenumber").alias("branch"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    explicit = lines.filter("s % 3 = 0").select("outline", "branch", (F.col("s") % 4).alias("chapter"))
    groups = lines.filter("p % 2 = 0").select("outline", "branch", (F.col("p") % 5).alias("chapter"))
    return rules.chapters(groups, explicit, lines.filter("p % 7 = 0"), lines.select("outline", "branch").distinct())


def unassigned_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as branches; messages of the nation name some."""
    suppliers = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    branches = suppliers.select(F.col("s_nationkey").alias("outline"), F.concat(F.lit("B"), F.col("s_suppkey").cast("string")).alias("label"))
    reported = suppliers.filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("outline"), F.concat(F.lit("see B"), F.col("s_suppkey").cast("string"), F.lit(", please")).alias("message"))
    return rules.unassigned(branches, reported)


def capped_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").select("user_id", "event_id", F.when(F.col("event_type") == "error", "major").when(F.col("event_type") == "view", "minor").otherwise("note").alias("severity"))
    return rules.capped_issues(issues, "user_id", "event_id", 8)


def partial_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    planned = turns.select(F.col("conv_id").alias("run"), "turn", F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("title"))
    return rules.partly_published(planned, planned.filter("turn % 3 = 0"), "run").select("run", "title")


def coverage_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "source", "n_chars").groupBy("source").agg(F.count("*").alias("i"), F.count_if(F.col("n_chars") > 500).alias("c"), F.count_if(F.col("n_chars") < 100).alias("e"), F.count_if(F.col("n_chars") > 5000).alias("s"))
    return docs.select("source", rules.coverage_note(F.col("i"), F.col("c"), F.col("e"), F.col("s")).alias("note"))


def snapshot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: included, excluded and skipped ones, and their language."""
    names = F.array(*map(F.lit, paths.SAMPLE_PATHS))
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path = F.concat(F.lit("/r/"), F.element_at(names, (F.col("doc_id") % len(paths.SAMPLE_PATHS) + 1).cast("int")), F.lit("."), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".rs").otherwise(".md"))
    body = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("\u0000"))).otherwise(F.col("text"))
    found = trees.snapshot(docs.select(path.alias("path"), F.octet_length(body).cast("bigint").alias("length"), body.cast("binary").alias("content")), include=["**/*.rs", "src/**"], exclude=["app/**"], roots=["/r"], most=5000)
    return found.select("path", "status", "detail", "language", "hash")


def outline_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of outlines: orders with lines as sections."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    rows = lines.select(F.col("l_orderkey").alias("outline"), (F.col("l_linenumber") - 1).alias("position"), (F.col("l_suppkey") % 20).cast("string").alias("id"), F.concat(F.lit(" Part  "), (F.col("l_partkey") % 9).cast("string")).alias("title"), F.array((F.col("l_suppkey") % 4).cast("int")).alias("depends_on"))
    return sections.outline_issues(rows)


def section_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each line of an order rests on: every line needs the one before it."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").filter("l_linenumber > 1")
    return sections.prerequisites(lines.select(F.col("l_orderkey").alias("outline"), F.col("l_linenumber").alias("position"), F.array(F.col("l_linenumber") - 1).alias("depends_on"))).select(F.col("outline").cast("bigint").alias("outline"), "position", "needs")


def joined_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' suppliers as parts of one outline, each resting on the one before it."""
    suppliers = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_name")
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    parts = suppliers.select(F.col("s_nationkey").alias("part"), place.alias("position"), F.col("s_name").alias("title"))
    found = sections.joined_outlines(parts.withColumn("depends_on", F.when(F.col("position") > 0, F.array(F.col("position") - 1)).otherwise(F.array().cast("array<int>"))))
    return found.select("position", "title", F.get("depends_on", F.lit(0)).alias("needs"))


def state_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as states of runs; those that may not follow."""
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "interrupted").when(F.col("event_type") == "error", "failed").otherwise("completed")
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").select(F.col("user_id").alias("run"), "event_id", status.alias("status"))
    return streams.invalid_transitions(rows, "run", "event_id").select("run", "event_id", "status", "before")


def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a journal, replayed twice into a log as a stream: the first of each user and type."""
    import uuid

    folder = shared_folder(spark) + f"/stream-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events", "event_id", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).write.parquet(f"{folder}/journal")
    schema = spark.read.parquet(f"{folder}/journal").schema
    for number in range(2):
        streams.replay(streams.read_events(spark, f"{folder}/journal", schema), f"{folder}/log", f"{folder}/mark{number}", ["user_id", "event_type"]).awaitTermination()
    streams.tail(streams.read_events(spark, f"{folder}/log", schema), f"{folder}/tail", f"{folder}/mark").awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/tail")


QUERIES = {
    f.__name__: f
    for f in (
        scope_discovery, planned_anchors, known_anchors, cited_originals, missing_anchors, cites_only, cited_files, transmitted_size, merged_findings, seed_symbols, target_spans,
        scope_links, passage_records, branch_groups, branch_labels, filtered_page, array_page, most_deferred, version_diff, reading_estimate, relative_paths, reservations, revisions,
        retention_cascade, recovery_steps, run_permissions, replans, cache_read_through, publication_names, chapter_plan, unassigned_branches, capped_issues, partial_publication,
        coverage_notes, snapshot_status, outline_checks, section_prerequisites, joined_outline, state_faults, journal_replay,
    )
}

_E = "WITH e AS (SELECT l_orderkey AS scope, l_linenumber AS pos, l_partkey % 50 AS id, l_suppkey % 10 AS path FROM lineitem)"
_T = """WITH RECURSIVE e AS (SELECT CAST(floor((doc_id - 1) / 4) AS BIGINT) AS parent, doc_id AS node FROM documents WHERE doc_id > 0),
n AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS level UNION ALL SELECT e.node, level + 1 FROM n JOIN e ON e.parent = n.node)"""
ORACLE = {
    "scope_discovery": _E + """, h AS (SELECT DISTINCT scope, id FROM e WHERE path BETWEEN 1 AND 4)
SELECT scope, pos AS finding FROM e WHERE (scope, pos) IN (SELECT (e.scope, e.pos) FROM e JOIN h ON h.scope = e.scope AND h.id IN (e.id, (e.id + 1) % 50))""",
    "planned_anchors": _E + """ SELECT scope, count(DISTINCT id) AS planned, count(DISTINCT id) FILTER (id < 40) AS resolved, count(DISTINCT id) = count(DISTINCT id) FILTER (id < 40) AS complete FROM e GROUP BY 1""",
    "known_anchors": """
WITH d AS (SELECT source, sha256(CAST(doc_id AS VARCHAR)) AS id FROM documents), p AS (SELECT DISTINCT source, left(id, 3) AS prefix FROM d), c AS (SELECT left(id, 3) AS prefix, count(*) AS n FROM d GROUP BY 1)
SELECT source, count(*) FILTER (n = 1) AS known, count(*) FILTER (n > 1) AS changed FROM p JOIN c USING (prefix) GROUP BY 1""",
    "cited_originals": _E + """, c AS (SELECT scope, id, pos, 0 AS part FROM e WHERE pos % 2 = 1 UNION ALL SELECT scope, id, pos, 1 FROM e WHERE pos % 2 = 0 AND id < 25)
SELECT scope, id, pos FROM c QUALIFY row_number() OVER (PARTITION BY scope, id ORDER BY part, pos) = 1""",
    "missing_anchors": _E + """ SELECT scope, id, min(pos) AS pos FROM e WHERE (scope, id) NOT IN (SELECT (scope, id) FROM e WHERE pos <= 2) GROUP BY 1, 2""",
    "cites_only": _E + " SELECT scope, max(id) < 45 AS cites_only FROM e GROUP BY 1",
    "cited_files": _E + " SELECT scope, count(DISTINCT path) AS files FROM e GROUP BY 1",
    "transmitted_size": _E + """ SELECT scope, CAST(sum(length('{"id":"' || id || '","path":' || path || '}')) AS BIGINT) AS bytes, CAST(sum(108 + length(CAST(path AS VARCHAR))) AS BIGINT) AS originals FROM e GROUP BY 1""",
    "merged_findings": """
SELECT l_orderkey AS scope, l_returnflag AS topic, l_linestatus AS observation, l_suppkey % 3 AS ids, l_linenumber AS pos FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus, l_suppkey % 3 ORDER BY l_linenumber <= 2, l_linenumber) = 1""",
    "seed_symbols": "SELECT p_partkey AS id, 1000 AS score FROM part WHERE lower(string_split(p_name, ' ')[1]) IN ('how', 'does', 'brand', '13', 'use', 'blue') OR contains('how does brand#13 use blue', lower(p_brand))",
    "target_spans": 'SELECT p_partkey, p_partkey AS start, p_partkey + CASE WHEN p_size % 2 = 0 THEN 1 ELSE p_size END AS "end" FROM part',
    "scope_links": """
WITH d AS (SELECT DISTINCT p_brand AS place, p_partkey % 1500 AS name FROM part),
c AS (SELECT 'Brand#' || CAST(l_suppkey % 5 + 1 AS VARCHAR) || CAST(l_suppkey % 4 + 1 AS VARCHAR) AS file, l_returnflag AS owner, l_partkey % 1700 AS name, count(*) AS calls FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT c.*, (SELECT count(*) FROM d WHERE d.name = c.name) AS places, list_sort((SELECT list(place) FROM d WHERE d.name = c.name AND place <> c.file))[1:4] AS others FROM c),
f AS (SELECT DISTINCT p_brand AS file, substr(p_brand, 7, 1) AS scope FROM part),
m AS (SELECT f.scope, f.file, k.*, places > 0 AND coalesce(len(others), 0) = 0 AS internal, len(list_filter(coalesce(others, []), lambda o: substr(o, 7, 1) = f.scope)) > 0 AS inside FROM f LEFT JOIN k ON k.file = f.file),
g AS (SELECT scope, count(*) FILTER (inside) AS links, CAST(coalesce(sum(calls) FILTER (inside), 0) AS BIGINT) AS calls, CAST(coalesce(sum(calls) FILTER (NOT inside AND len(others) > 0), 0) AS BIGINT) AS leaving,
  CAST(coalesce(sum(calls) FILTER (internal), 0) AS BIGINT) AS same_file, CAST(coalesce(sum(calls) FILTER (places = 0), 0) AS BIGINT) AS undeclared FROM m GROUP BY 1),
b AS (SELECT scope, count(*) AS files_without_links FROM (SELECT scope, file FROM m GROUP BY 1, 2 HAVING count(*) FILTER (inside) = 0) GROUP BY 1)
SELECT g.*, coalesce(files_without_links, 0) AS files_without_links FROM g LEFT JOIN b USING (scope)""",
    "passage_records": """
WITH e AS (SELECT l_orderkey AS scope, l_returnflag AS owner, CAST(l_suppkey % 5 AS VARCHAR) AS target, CASE WHEN l_linestatus = 'O' THEN 'calls' WHEN l_suppkey % 2 = 0 THEN 'imports' ELSE 'branch' END AS kind FROM lineitem)
SELECT o_orderkey AS scope, 0 AS rank, o_orderpriority AS what, CAST(1 AS BIGINT) AS times FROM orders UNION ALL SELECT scope, 1, owner, count(*) FROM e GROUP BY 1, 3
UNION ALL SELECT scope, 2, target, count(*) FROM e WHERE kind = 'imports' GROUP BY 1, 3 UNION ALL SELECT scope, 3, target, count(*) FROM e WHERE kind = 'calls' GROUP BY 1, 3""",
    "branch_groups": _T + """, g AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM n WHERE level = 2)
SELECT n.node, 'G' || k AS label FROM n JOIN g ON g.node = floor((n.node - 1) / 4) WHERE level = 3""",
    "branch_labels": _T + """, g AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM n WHERE level = 2), c AS (SELECT e.node, g.k, row_number() OVER (PARTITION BY parent ORDER BY e.node) AS j, count(*) OVER (PARTITION BY parent) AS m FROM e JOIN g ON g.node = e.parent)
SELECT node, 'B' || k AS label FROM g UNION ALL SELECT node, 'B' || k || '.' || j FROM c WHERE m >= 2""",
    "filtered_page": "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND event_id > 300 ORDER BY event_id LIMIT 20",
    "array_page": "SELECT doc_id, array_to_string(string_split(text, ' ')[51:100], ' ') AS words FROM documents",
    "most_deferred": "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS links FROM lineitem GROUP BY 1 HAVING links > 0 ORDER BY links DESC, l_suppkey LIMIT 5",
    "version_diff": """
WITH l AS (SELECT doc_id, doc_id % 5 AS k, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, n, count(*) FILTER ((i + k) % 4 = 0) AS gone, count(*) FILTER ((i + k) % 3 = 0) AS fresh FROM l GROUP BY 1, 2)
SELECT doc_id, CAST(CASE WHEN n - gone + fresh = 0 THEN CASE WHEN gone > 0 THEN 1 ELSE 0 END ELSE fresh END AS INTEGER) AS added, CAST(gone AS INTEGER) AS removed, CAST(n - gone AS INTEGER) AS equal FROM c""",
    "reading_estimate": """
WITH d AS (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS b, count(*) AS n FROM documents GROUP BY 1)
SELECT source, least(greatest(b // 6, 4000), 48000) AS summary, greatest(n * 100, least(n * 200, b // 3)) AS accepted, least(b // 8, 12000) AS graph, least(greatest(3 * n, 32), 256) AS sections, least(greatest(n // 4, 8), 256) AS branches,
  n * 900 >= 1000 AND b * 10 < n * 900 * 12 AS dropped, n * 100 >= 75 * 60 AS reasoning FROM d""",
    "relative_paths": """
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+:/(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/www.example/') THEN substr(path, 14) WHEN starts_with(path, '/www/') THEN substr(path, 6) WHEN starts_with(path, '/m/') THEN substr(path, 4) ELSE path END AS rest FROM p""",
    "reservations": """
WITH RECURSIVE q AS (SELECT user_id, event_id, CAST(floor(coalesce(value, 0) * 10) AS BIGINT) AS amount, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, amount, i, amount <= 1000 AS accepted, CASE WHEN amount <= 1000 THEN amount ELSE 0 END AS reserved FROM q WHERE i = 1
  UNION ALL SELECT q.user_id, q.event_id, q.amount, q.i, reserved + q.amount <= 1000, CASE WHEN reserved + q.amount <= 1000 THEN reserved + q.amount ELSE reserved END FROM r JOIN q ON q.user_id = r.user_id AND q.i = r.i + 1)
SELECT user_id, event_id, amount, accepted, reserved FROM r""",
    "revisions": """
WITH q AS (SELECT user_id, event_id, event_id % 7 AS n, row_number() OVER (PARTITION BY user_id, event_id % 7 = 3 ORDER BY event_id) AS nth FROM events),
a AS (SELECT *, min(event_id) FILTER (n <> 5) OVER (PARTITION BY user_id) AS first FROM q)
SELECT user_id, event_id, CASE WHEN event_id = first THEN 'applied' WHEN n = 3 AND event_id > first AND (SELECT b.event_id % 7 = 3 FROM events b WHERE b.event_id = a.first) THEN 'repeated' ELSE 'stale' END AS outcome,
  CASE WHEN event_id < first OR first IS NULL THEN 0 ELSE 1 END AS revision FROM a""",
    "retention_cascade": """
WITH g AS (SELECT o_orderkey AS run FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate < TIMESTAMP '1998-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100)
SELECT l_orderkey AS run, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT run FROM g) GROUP BY 1""",
    "recovery_steps": """
WITH r AS (SELECT o_orderkey AS run, o_custkey AS k, o_orderstatus = 'F' AS ended FROM orders)
SELECT run, '1 replay terminal' AS step FROM r WHERE k % 3 = 0 AND ended UNION ALL SELECT run, '2 replay journal' FROM r WHERE k % 3 = 0 AND NOT ended UNION ALL SELECT run, '3 cancel' FROM r WHERE k % 5 = 0 AND NOT ended
UNION ALL SELECT run, '4 publication' FROM r WHERE k % 7 = 0 UNION ALL SELECT run, '5 enqueue' FROM r WHERE NOT ended AND k % 5 <> 0 AND k % 7 <> 0""",
    "run_permissions": """
WITH r AS (SELECT o_orderkey AS run, o_custkey AS k, CASE o_orderstatus WHEN 'F' THEN 'completed_with_warnings' WHEN 'P' THEN 'awaiting_outline' ELSE 'running' END AS status FROM orders)
SELECT run, status = 'awaiting_outline' OR (status = 'completed_with_warnings' AND (k % 2 = 1 OR k % 5 > 3)) AS resume, k % 3 = 1 AND k % 2 = 0 AND status = 'awaiting_outline' AS approve, k >= 500 AND k % 2 = 0 AS late,
  CASE WHEN k % 4 = 0 AND status = 'running' THEN 'cancelling' ELSE status END AS shown FROM r""",
    "replans": """
SELECT o_orderkey AS run, CAST(o_custkey % 4 + 1 AS INTEGER) AS iteration FROM orders WHERE o_custkey % 4 < 3 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "cache_read_through": """
SELECT doc_id, len(string_split(text, chr(10))) || ' lines' AS value, text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS hit FROM documents""",
    "publication_names": """
SELECT o_orderkey, 'doc' || o_custkey || CASE WHEN (o_custkey % 3 = 0) = (o_custkey % 2 <> 0) THEN '.md' ELSE '.conflict-' || o_orderkey || '.md' END AS name FROM orders""",
    "chapter_plan": """
WITH l AS (SELECT l_orderkey AS outline, l_linenumber AS branch, l_suppkey AS s, l_partkey AS p FROM lineitem),
g AS (SELECT outline, branch, min(s % 4) FILTER (s % 3 = 0) AS own, count(DISTINCT s % 4) FILTER (s % 3 = 0) AS owns, min(p % 5) FILTER (p % 2 = 0) AS grp, count(DISTINCT p % 5) FILTER (p % 2 = 0) AS grps, bool_or(p % 7 = 0) AS gone FROM l GROUP BY 1, 2)
SELECT outline, branch, CASE WHEN gone AND own IS NULL THEN NULL ELSE coalesce(own, grp) END AS chapter,
  CASE WHEN CASE WHEN own IS NOT NULL THEN owns ELSE grps END > 1 THEN 'conflict' WHEN gone AND own IS NOT NULL THEN 'covered and excluded' WHEN coalesce(own, grp) IS NULL AND NOT gone THEN 'missing' END AS fault FROM g""",
    "unassigned_branches": "SELECT s_nationkey AS outline, 'B' || s_suppkey AS label, 'major' AS severity, 'unassigned_branch' AS code FROM supplier WHERE s_suppkey % 2 <> 0",
    "capped_issues": """
SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'major' ELSE 'minor' END AS severity, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS place FROM events WHERE event_type IN ('error', 'view') QUALIFY place <= 8""",
    "partial_publication": "SELECT conv_id AS run, role || ' ' || turn AS title FROM conversations WHERE turn % 3 <> 0",
    "coverage_notes": """
SELECT source, count(*) || ' files indexed, ' || count(*) FILTER (n_chars > 500) || ' cited, ' || count(*) FILTER (n_chars < 100) || ' excluded, ' || count(*) FILTER (n_chars > 5000) || ' skipped' AS note FROM documents GROUP BY 1""",
    "outline_checks": """
WITH r AS (SELECT l_orderkey AS outline, l_linenumber - 1 AS position, l_suppkey % 20 AS id, l_partkey % 9 AS title, l_suppkey % 4 AS d FROM lineitem)
SELECT outline, position, 'duplicate_id' AS code FROM r QUALIFY count(*) OVER (PARTITION BY outline, id) > 1 UNION ALL SELECT outline, position, 'duplicate_title' FROM r QUALIFY count(*) OVER (PARTITION BY outline, title) > 1
UNION ALL SELECT outline, position, 'forward_dependency' FROM r WHERE d >= position""",
    "section_prerequisites": """
SELECT DISTINCT a.l_orderkey AS outline, a.l_linenumber AS position, CAST(k AS INTEGER) AS needs FROM lineitem a, LATERAL (SELECT unnest(range(1, a.l_linenumber)) AS k) u
WHERE NOT EXISTS (SELECT 1 FROM range(k + 1, a.l_linenumber) t(j) WHERE j NOT IN (SELECT l_linenumber FROM lineitem b WHERE b.l_orderkey = a.l_orderkey))""",
    "joined_outline": """
WITH p AS (SELECT s_name AS title, CAST(row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS INTEGER) AS position, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)
SELECT position, title, CASE WHEN i > 1 THEN position - 1 END AS needs FROM p""",
    "state_faults": """
WITH s AS (SELECT user_id AS run, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'interrupted' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM events),
b AS (SELECT *, lag(status) OVER (PARTITION BY run ORDER BY event_id) AS before FROM s)
SELECT run, event_id, status, before FROM b WHERE NOT coalesce((before IS NULL AND status = 'queued') OR (before = 'queued' AND status = 'running') OR (before = 'running' AND status IN ('completed', 'failed', 'interrupted')) OR (before = 'interrupted' AND status IN ('queued', 'running')) OR (before = 'failed' AND status = 'queued'), false)""",
    "journal_replay": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2",
}

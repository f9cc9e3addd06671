"""Queries over findings, coverage and the recovery of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import runs
from millrace.sources.tables import table


def detail_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as findings on their supplier's path, scored by quantity, for each return flag."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    order = [F.desc("l_quantity"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")]
    best = runs.detail_cap(lines, "l_returnflag", "l_suppkey", order, ["l_suppkey", "l_partkey"])
    return best.select("l_returnflag", "place", "l_suppkey", "l_partkey", "l_quantity")


def section_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cite spans of their supplier; large orders supply evidence."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
    span = [F.col("l_suppkey").alias("path"), (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("int")).alias("end")]
    return runs.overlapping_findings(lines.select(F.col("l_orderkey").alias("finding"), *span), lines.filter("l_quantity >= 48").select(*span))


def salvaged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    return runs.salvage(turns, "conv_id", "turn", "size", 1500)


def graph_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").select((F.col("s_suppkey") % 7 != 0).alias("supported"), (F.col("s_acctbal") < 0).alias("parse_errors"))
    symbols = table(spark, sf_dir, "part", "p_size").select(F.when(F.col("p_size") == 1, "file").otherwise("function").alias("kind"))
    return runs.graph_coverage(files, symbols, table(spark, sf_dir, "lineitem", "l_orderkey"))


def covered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over nations; suppliers are a nation's files, complete without debt."""
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    edges = nations.select((F.col("n_regionkey") + 1000).cast("bigint").alias("parent"), F.col("n_nationkey").cast("bigint").alias("node"))
    leaves = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(F.col("s_nationkey").cast("bigint").alias("node"), F.col("s_suppkey").alias("file"), (F.col("s_acctbal") >= 0).alias("complete"))
    return runs.covered_files(edges, leaves)


def branch_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as levels of a tree whose width grows with the texts before."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn")
    levels = turns.select("conv_id", F.col("turn").cast("bigint").alias("level"), (F.col("turn") * F.col("turn") + F.col("conv_id") % 3 + 1).cast("bigint").alias("width"))
    return runs.branch_level(levels, "conv_id", F.col("conv_id") % 11 + 8)


def terminal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs; their lines are the journal."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    journal = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").filter("l_returnflag <> 'N'")
    numbered = journal.select(F.col("l_orderkey").alias("run"), F.struct("l_linenumber", "l_returnflag").alias("number"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("cancelled").alias("status"))
    return runs.settle_status(orders, numbered)


def cascade_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of users; a signup changes what pages and clicks rest on."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    steps = events.select(F.col("user_id").alias("run"), F.concat_ws(":", F.col("event_type"), (F.col("event_id") % 10).cast("string")).alias("step"), "event_id")
    changed = events.filter("event_type = 'signup' and event_id % 50 = 0").select(F.col("user_id").alias("run"))
    return runs.invalidate(steps, changed, "^(view|click):[0-4]$")


def transient_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next runs to resume; the pass of ten is the feature."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    failed = orders.select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "O", "failed").otherwise("completed").alias("status"), F.when(F.col("o_custkey") % 2 == 0, "DB_UNAVAILABLE: gone").otherwise("LIMIT").alias("error"), (F.col("o_custkey") % 6 == 0).alias("cancel_requested"))
    return runs.resumable(failed, orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 5).alias("recoveries")))


def publication_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "F", "completed_with_warnings").otherwise("running")
    return orders.select("o_orderkey", runs.publication(F.sha2((F.col("o_custkey") % 4).cast("string"), 256), F.sha2((F.col("o_orderkey") % 4).cast("string"), 256), status).alias("status"))


QUERIES = {f.__name__: f for f in (detail_cap, section_memory, salvaged_findings, graph_coverage, covered_files, branch_level, terminal_replay, cascade_invalidate, transient_resume, publication_recovery)}

ORACLE = {
    "detail_cap": """
WITH o AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_suppkey, l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) = 1),
c AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_quantity DESC, l_partkey, l_orderkey, l_linenumber) <= 4),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_partkey, l_orderkey, l_linenumber) AS INTEGER) AS place FROM c)
SELECT l_returnflag, place, l_suppkey, l_partkey, l_quantity FROM p WHERE place <= 24""",
    "section_memory": """
WITH s AS (SELECT l_orderkey AS finding, l_suppkey AS path, l_partkey * 10 AS a, l_partkey * 10 + CAST(floor(l_quantity) AS INTEGER) AS b, l_quantity FROM lineitem),
e AS (SELECT DISTINCT path, a, b FROM s WHERE l_quantity >= 48)
SELECT DISTINCT finding FROM s WHERE EXISTS (SELECT 1 FROM e WHERE e.path = s.path AND s.a <= e.b AND s.b >= e.a)""",
    "salvaged_findings": """
WITH t AS (SELECT conv_id, turn, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM conversations)
SELECT * FROM t QUALIFY sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 1500""",
    "graph_coverage": """
SELECT *, unsupported_files = 0 AND parse_error_files = 0 AS syntax_complete FROM (
  SELECT CAST(count(*) AS BIGINT) AS files, (SELECT count(*) FROM part WHERE p_size <> 1) AS symbols, (SELECT count(*) FROM lineitem) AS edges,
    CAST(count(*) FILTER (s_suppkey % 7 = 0) AS BIGINT) AS unsupported_files, CAST(count(*) FILTER (s_acctbal < 0) AS BIGINT) AS parse_error_files FROM supplier)""",
    "covered_files": """
WITH f AS (SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey + 1000 AS BIGINT) AS region, s_suppkey, s_acctbal >= 0 AS complete FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT nation AS node, count(DISTINCT s_suppkey) AS files, bool_and(complete) AS complete FROM f GROUP BY 1 UNION ALL SELECT region, count(DISTINCT s_suppkey), bool_and(complete) FROM f GROUP BY 1""",
    "branch_level": """
WITH RECURSIVE l AS (SELECT conv_id, turn AS level, turn * turn + conv_id % 3 + 1 AS width, conv_id % 11 + 8 AS target, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, level, width, i FROM l WHERE i = 1
  UNION ALL SELECT n.conv_id, n.level, n.width, n.i FROM r JOIN l n ON n.conv_id = r.conv_id AND n.i = r.i + 1 WHERE r.width < n.target AND (n.width <= n.target OR n.width - n.target <= n.target - r.width))
SELECT conv_id, level, width FROM r WHERE width >= 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1""",
    "terminal_replay": """
WITH j AS (SELECT l_orderkey, arg_max(CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'cancelled' END, l_linenumber * 2 + CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END) AS last FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT o_orderkey AS run, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE coalesce(last, 'running') END AS status FROM orders LEFT JOIN j ON l_orderkey = o_orderkey""",
    "cascade_invalidate": """
WITH s AS (SELECT user_id AS run, event_type || ':' || event_id % 10 AS step, event_id FROM events), c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND event_id % 50 = 0)
SELECT * FROM s WHERE NOT (regexp_matches(step, '^(view|click):[0-4]$') AND run IN (SELECT user_id FROM c))""",
    "transient_resume": """
WITH f AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0 AND o_custkey % 6 <> 0 ORDER BY o_orderkey LIMIT 10),
r AS (SELECT o_orderkey AS run, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 5 ELSE 0 END AS n FROM f)
SELECT run, n + 1 AS recoveries FROM r WHERE n < 3""",
    "publication_recovery": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'completed_with_warnings' WHEN o_custkey % 4 = o_orderkey % 4 THEN 'completed' ELSE 'failed' END AS status FROM orders",
}

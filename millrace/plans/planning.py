"""Queries over outlines, findings and shared leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.jsonfix import decode_json
from millrace.functions.text import heading_key, names_label
from millrace.operators import planning
from millrace.sources.tables import table


def merge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines first, then open ones: the first row of each part of an order."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag").select("l_orderkey", "l_suppkey", (F.col("l_linenumber") * 3 + F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)).alias("pos"), "l_returnflag")
    return planning.merge_first([lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag <> 'R'")], ["l_orderkey"], ["l_suppkey"])


def retain_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").withColumn("topic", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    old, new = events.filter("event_id % 3 <> 0").select("topic", "event_id"), events.filter("event_id % 3 = 0 and event_type = 'error'").select("topic", "event_id")
    return planning.retain_details(old, new)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return lines.select("l_orderkey", F.col("l_linenumber").alias("finding"), F.array(F.col("l_suppkey") % 7, F.col("l_partkey") % 7).alias("evidence_ids"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("id"))


def scoped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = planning.keep_cited(_findings(spark, sf_dir), _evidence(spark, sf_dir), "l_orderkey")
    return kept.select("l_orderkey", "finding", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",").alias("ids"))


def uncited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.uncited(_evidence(spark, sf_dir), _findings(spark, sf_dir), "l_orderkey").select("l_orderkey", "id")


def title_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sections of orders titled by supplier; each wants the title of the supplier one below."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").select(F.col("l_orderkey").alias("outline"), F.col("l_linenumber").alias("position"), (F.col("l_suppkey") % 9).alias("title"))
    return planning.title_dependencies(lines, lines.withColumn("title", F.col("title") - 1))


def leaf_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines claim their part's brand number as a leaf of the order's customer."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    claims = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", (F.col("l_partkey") % 10).alias("leaf"), (F.col("l_suppkey") % 5).alias("section")).agg(F.count("*").alias("score"))
    return planning.ownership(claims, "o_custkey")


def chapter_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.chapter_batches(table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey", 3)


def plan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("cost", F.octet_length("text").cast("bigint"))
    return planning.plan_groups(turns, "conv_id", "turn", "cost", 1200)


def chunk_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey")
    nations = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    return planning.chunk_adjacency(lines.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 100).alias("target")), nations.select(F.col("s_nationkey").cast("bigint").alias("parent"), F.col("s_suppkey").alias("child")))


def heading_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name")
    heading = F.concat(F.lit("1."), (F.col("p_partkey") % 7).cast("string"), F.lit(". "), "p_name")
    message = F.concat(F.lit("Branch B"), (F.col("p_partkey") % 20).cast("string"), F.lit(" lacks text"))
    return parts.select("p_partkey", heading_key(heading).alias("key"), names_label(message, "B1").alias("names_b1"))


def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties, broken in one of five ways or whole."""
    events = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    k = F.col("event_id") % 6
    said = F.concat(F.lit('{"k": "he said "'), "event_type", F.lit('", then left '), F.col("event_id").cast("string"), F.lit('", "z": [{"a": "a "b" c"}]}'))
    raw = F.concat(F.lit('{"k": "one\ntwo \\d '), "event_type", F.lit('"}'))
    body = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" done"))).when(k == 2, F.regexp_replace("props", r"\}$", "")).when(k == 3, said).when(k == 4, raw).otherwise(F.col("props"))
    return events.select("event_id", decode_json(body).alias("d")).select("event_id", "d.value", "d.fault")


QUERIES = {f.__name__: f for f in (merge_evidence, retain_details, scoped_findings, uncited_evidence, title_dependencies, leaf_ownership, chapter_batches, plan_groups, chunk_adjacency, heading_keys, json_decode)}

_FINDINGS = "WITH f AS (SELECT l_orderkey, l_linenumber AS finding, l_suppkey % 7 AS a, l_partkey % 7 AS b FROM lineitem), e AS (SELECT DISTINCT l_orderkey, l_linenumber AS id FROM lineitem)"
ORACLE = {
    "merge_evidence": """
WITH l AS (SELECT l_orderkey, l_suppkey, CAST(l_linenumber * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS pos, l_returnflag FROM lineitem)
SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_returnflag <> 'R', pos) = 1""",
    "retain_details": """
WITH t AS (SELECT user_id || ':' || event_type AS topic, event_id, event_type FROM events), n AS (SELECT topic, event_id FROM t WHERE event_id % 3 = 0 AND event_type = 'error')
SELECT topic, event_id FROM t WHERE event_id % 3 <> 0 AND topic NOT IN (SELECT topic FROM n) UNION ALL SELECT * FROM n""",
    "scoped_findings": _FINDINGS + """,
x AS (SELECT l_orderkey, finding, 0 AS pos, a AS id FROM f UNION ALL SELECT l_orderkey, finding, 1, b FROM f)
SELECT l_orderkey, finding, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos, id) AS ids FROM x JOIN e USING (l_orderkey, id) GROUP BY 1, 2""",
    "uncited_evidence": _FINDINGS + """,
x AS (SELECT l_orderkey, a AS id FROM f UNION SELECT l_orderkey, b FROM f)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS id FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.l_orderkey = l.l_orderkey AND x.id = l.l_linenumber)""",
    "title_dependencies": """
WITH s AS (SELECT l_orderkey AS outline, l_linenumber AS position, l_suppkey % 9 AS title FROM lineitem), n AS (SELECT outline, title, min(position) AS needs FROM s GROUP BY 1, 2 HAVING count(*) = 1)
SELECT DISTINCT s.outline, s.position, needs FROM s JOIN n ON n.outline = s.outline AND n.title = s.title - 1 WHERE needs < s.position""",
    "leaf_ownership": """
WITH RECURSIVE c AS (SELECT o_custkey, l_partkey % 10 AS leaf, l_suppkey % 5 AS section, count(*) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
m AS (SELECT *, max(score) OVER (PARTITION BY o_custkey, leaf) AS top FROM c),
g AS (SELECT o_custkey, leaf, count(*) AS claims, list(section ORDER BY section) FILTER (score = top) AS best FROM m GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY leaf) AS i FROM g),
r AS (SELECT o_custkey, i, leaf, claims, best[1] AS section, CASE WHEN claims > 1 THEN [best[1]] ELSE CAST([] AS BIGINT[]) END AS won FROM o WHERE i = 1
  UNION ALL SELECT o_custkey, i, leaf, claims, section, CASE WHEN claims > 1 THEN list_append(won, section) ELSE won END FROM
    (SELECT o.o_custkey, o.i, o.leaf, o.claims, won, list_sort(list_transform(o.best, lambda s: len(list_filter(won, lambda w: w = s)) * 100 + s))[1] % 100 AS section FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i = r.i + 1))
SELECT o_custkey, leaf, section FROM r""",
    "chapter_batches": "SELECT s_suppkey, s_nationkey, CAST((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 3 AS INTEGER) AS batch FROM supplier",
    "plan_groups": """
WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, cost AS size, 1 AS n, 0 AS g FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN size + cost > 1200 OR n >= 4 THEN cost ELSE size + cost END, CASE WHEN size + cost > 1200 OR n >= 4 THEN 1 ELSE n + 1 END, g + CASE WHEN size + cost > 1200 OR n >= 4 THEN 1 ELSE 0 END
  FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
SELECT conv_id, turn, g AS "group" FROM r""",
    "chunk_adjacency": """
WITH e AS (SELECT l_suppkey AS x, l_partkey % 100 AS y, 5 AS w FROM lineitem UNION ALL SELECT s_nationkey, s_suppkey, 3 FROM supplier)
SELECT least(x, y) AS a, greatest(x, y) AS b, CAST(sum(w) AS BIGINT) AS weight FROM e WHERE x <> y GROUP BY 1, 2""",
    "heading_keys": "SELECT p_partkey, lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]+', '', 'g')) AS key, p_partkey % 20 = 1 AS names_b1 FROM part",
    "json_decode": """
SELECT event_id, CASE event_id % 6 WHEN 2 THEN NULL WHEN 3 THEN '{"k":"he said \\"' || event_type || '\\", then left ' || event_id || '","z":[{"a":"a \\"b\\" c"}]}'
  WHEN 4 THEN '{"k":"one\\ntwo \\\\d ' || event_type || '"}' ELSE replace(props, ' ', '') END AS value, CASE WHEN event_id % 6 = 2 THEN 'truncated' END AS fault FROM events""",
}

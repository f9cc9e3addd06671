"""Costs of a reading, shares of a view, and planned diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import estimates, graph, quality, rules, sections
from millrace.sources.tables import table


def reading_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as chunks of a run whose limits follow from its name."""
    docs = table(spark, sf_dir, "documents", "source", "text").filter("source is not null")
    chunks = docs.select("source", F.concat(F.lit("d/"), "source").alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"))
    k = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("bigint"), F.lit(0)) % 7
    runs = docs.select("source").distinct().select("source", (4000 + k * 5000).alias("limit"), (20_000 + k * 30_000).alias("space"), (k % 4 + 1).alias("concurrency"), (k * 1_000_000).alias("max_tokens"), F.lit(1000).cast("bigint").alias("reserved"), (k * 4000).alias("max_seconds"), F.lit(90).cast("bigint").alias("elapsed"))
    return estimates.reading_cost(chunks, runs, "source")


def context_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as details of a conversation's reading, each in an equal share."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    details = turns.select("conv_id", "turn", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("topic"), F.repeat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z .]", ""), F.lit(20)).alias("observation"), F.col("role").alias("kind"))
    found = estimates.context_view(details, "conv_id", "turn", ["topic", "observation", "kind"])
    return found.select("conv_id", "turn", "excerpted", F.octet_length("view").cast("bigint").alias("bytes"), F.sha2("view", 256).alias("hash"))


def diagram_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sections; sentences that end a line decide how many diagrams stand in a text, and half as many are planned."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").filter("text is not null")
    words = F.filter(F.split(F.regexp_replace("text", r"[^A-Za-z .\n]", ""), "\n"), lambda x: x.endswith("."))
    body = F.array_join(F.transform(F.slice(words, 1, 6), lambda x: F.concat(x, F.lit("\n```mermaid\ngraph\n```\n"))), "\n")
    planned = F.when(F.col("turn") % 5 != 4, F.slice(words, 1, F.least(F.floor(F.size(words) / 2).cast("int") + 1, F.lit(6))))
    rows = turns.select(F.col("conv_id").alias("outline"), F.col("turn").alias("position"), planned.alias("diagrams"), body.alias("markdown"))
    most = turns.select(F.col("conv_id").alias("outline")).distinct().select("outline", F.when(F.col("outline") % 3 != 0, F.col("outline") % 5 + 2).alias("maximum"))
    return sections.diagram_issues(rows, most)


def repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sections of five lines, each a paragraph; every seventh says again, with a word more, what stood six before."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    # Columns of their own: within the transform the text would be cut anew for every line, and with the explode copied for every section.
    docs = docs.select("doc_id", F.split(F.regexp_replace(F.regexp_replace("text", r"[^A-Za-z \n]", ""), " +", " "), "\n").alias("lines"))
    again = F.transform("lines", lambda x, i: F.when((i % 7 == 6) & (F.length(x) > 0), F.concat(F.trim(F.get("lines", i - 6)), F.lit(" again"))).otherwise(F.trim(x)))
    docs = docs.select("doc_id", again.alias("lines"))
    markdown = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 5).cast("int")), lambda k: F.array_join(F.slice("lines", k * 5 + 1, 5), "\n\n"))
    sections_ = docs.select("doc_id", F.posexplode(markdown).alias("section", "markdown"))
    return quality.repeated_paragraphs(sections_, "doc_id")


def budget_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of users: tokens and cost by value, 1,000 tokens and 0.8 in costs a user at most."""
    value = F.coalesce("value", F.lit(0.0))
    requests = table(spark, sf_dir, "events", "event_id", "user_id", "value").select("user_id", "event_id", F.floor(value * 10).cast("bigint").alias("tokens"), F.when(F.col("event_id") % 3 == 0, value / 50).otherwise(value / 500).alias("cost"))
    return rules.budget_reservations(requests, "user_id", "event_id", "tokens", "cost", 1000, 0.8)


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders of a customer as sections of an outline; each asks for itself and the order before by short prefixes of hashes."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    name = F.sha2(F.col("o_orderkey").cast("string"), 256)
    ids = orders.select("o_custkey", "o_orderkey", name.alias("id"))
    before = F.lag("id").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    asked = ids.withColumn("before", before).select("o_custkey", "o_orderkey", F.array(F.concat(F.lit(" "), F.left("id", (F.col("o_orderkey") % 4 + 1).cast("int"))), F.left("before", (F.col("o_orderkey") % 3 + 2).cast("int")), F.when(F.col("o_orderkey") % 9 == 0, " ")).alias("asked"))
    rows = asked.select("o_custkey", "o_orderkey", F.posexplode(F.filter("asked", lambda x: x.isNotNull())).alias("pos", "prefix"))
    return rows, ids.select("o_custkey", "id")


def resolved_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that all prefixes of an order name."""
    return graph.resolve_all(*_asked(spark, sf_dir), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", F.array_join("ids", ",").alias("ids"))


def outline_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues of a customer's review that name sections by longer prefixes; texts and severities follow from their keys."""
    named, ids = _asked(spark, sf_dir)
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    severity = F.when(k % 97 == 0, "trivial").when(k % 3 == 0, "major").otherwise("minor")
    message = F.repeat(F.lit("é"), F.when(k % 31 == 0, 2001).when(k % 37 == 0, 0).otherwise(k % 2001).cast("int"))
    issues = orders.select("o_custkey", "o_orderkey", severity.alias("severity"), F.concat(F.lit("m"), message).alias("message"), F.when(k % 89 == 0, " ").otherwise(F.col("o_orderpriority")).alias("code"), F.repeat(F.lit("q"), (k % 2010).cast("int")).alias("query"))
    said = graph.begun(named.withColumn("prefix", F.trim("prefix")).filter("prefix <> ''"), ids, "o_custkey")
    long = said.filter("first is not null").select("o_custkey", "o_orderkey", "pos", F.left("first", F.lit(9)).alias("prefix"))
    wanted = long.unionByName(named.filter((F.trim("prefix") == "") & (k % 18 == 0)))
    return rules.outline_reviews(issues, wanted, ids, "o_custkey", "o_orderkey")


QUERIES = {f.__name__: f for f in (reading_cost, context_view, diagram_issues, repeated_paragraphs, budget_reservations, resolved_sections, outline_reviews)}

ORACLE = {
    "budget_reservations": """
WITH RECURSIVE q AS (SELECT user_id, event_id, CAST(floor(coalesce(value, 0) * 10) AS BIGINT) AS t, CAST(ceil(CASE WHEN event_id % 3 = 0 THEN coalesce(value, 0) / 50 ELSE coalesce(value, 0) / 500 END * 1000000) AS BIGINT) AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, '' AS outcome, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS spent FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT q.user_id, q.event_id, q.i, CASE WHEN taken + t > 1000 THEN 'token budget' WHEN (spent + m) / 1000000 > CAST(0.8 AS DOUBLE) THEN 'cost budget' ELSE 'accepted' END,
    CASE WHEN taken + t > 1000 OR (spent + m) / 1000000 > CAST(0.8 AS DOUBLE) THEN taken ELSE taken + t END, CASE WHEN taken + t > 1000 OR (spent + m) / 1000000 > CAST(0.8 AS DOUBLE) THEN spent ELSE spent + m END
  FROM r JOIN q ON q.user_id = r.user_id AND q.i = r.i + 1)
SELECT user_id, event_id, outcome, taken AS tokens_taken, spent AS cost_taken FROM r WHERE i > 0""",
    "outline_reviews": """
WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderkey % 97 <> 0 AND CASE WHEN o_orderkey % 31 = 0 THEN 2001 WHEN o_orderkey % 37 = 0 THEN 0 ELSE o_orderkey % 2001 END * 2 + 1 <= 4000 AND o_orderkey % 89 <> 0 AND o_orderkey % 2010 <= 2000 AS fine, o_orderkey % 9 <> 0 OR o_orderkey % 18 <> 0 AS found FROM orders)
SELECT o_custkey, count(*) AS issues, bool_and(found) AS resolved, bool_and(fine) AS valid, bool_and(found) AND bool_and(fine) AND count(*) <= 8 AS accepted FROM o GROUP BY 1""",
    "resolved_sections": """
WITH o AS (SELECT o_custkey, o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS id, lag(sha256(CAST(o_orderkey AS VARCHAR))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
a AS (SELECT o_custkey, o_orderkey, 0 AS pos, left(id, o_orderkey % 4 + 1) AS prefix FROM o UNION ALL SELECT o_custkey, o_orderkey, 1, left(before, o_orderkey % 3 + 2) FROM o WHERE before IS NOT NULL UNION ALL SELECT o_custkey, o_orderkey, 2, NULL FROM o WHERE o_orderkey % 9 = 0),
m AS (SELECT a.o_custkey, a.o_orderkey, a.pos, count(o.id) AS n, min(o.id) AS id FROM a LEFT JOIN o ON o.o_custkey = a.o_custkey AND starts_with(o.id, a.prefix) GROUP BY 1, 2, 3)
SELECT o_custkey, o_orderkey, CASE WHEN min(n) = 1 AND max(n) = 1 THEN string_agg(id, ',' ORDER BY pos) END AS ids FROM m GROUP BY 1, 2""",
    "repeated_paragraphs": """
WITH d AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '[^A-Za-z \\n]', '', 'g'), ' +', ' ', 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, l, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d),
t AS (SELECT doc_id, i, i // 5 AS section, CAST(i % 5 AS INTEGER) AS block, lower(CASE WHEN i % 7 = 6 AND x <> '' THEN trim(trim(l[i - 5]) || ' again') ELSE trim(x) END) AS t FROM s),
p AS (SELECT *, string_split(t, ' ') AS w FROM t WHERE length(t) >= 120),
b AS (SELECT doc_id, i, section, block, t, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM p),
m AS (SELECT y.doc_id, y.i, y.section, y.block, x.i AS first, x.section AS first_section, x.block AS first_block, x.t = y.t AS exact FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.i < y.i AND NOT (x.section = y.section AND y.block - x.block <= 1)
  WHERE x.t = y.t OR (length(x.t) >= 200 AND length(y.t) >= 200 AND len(x.g) >= 8 AND len(y.g) >= 8 AND 100 * len(list_intersect(x.g, y.g)) >= 90 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))))
  QUALIFY row_number() OVER (PARTITION BY y.doc_id, y.i ORDER BY x.i) = 1)
SELECT doc_id, CAST(section AS INTEGER) AS section, block, CAST(first_section AS INTEGER) AS first_section, first_block, exact FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY first, i) <= 16""",
    "diagram_issues": """
WITH t AS (SELECT conv_id AS outline, turn AS position, len(list_filter(string_split(regexp_replace(text, '[^A-Za-z .\\n]', '', 'g'), chr(10)), lambda x: x LIKE '%.')) AS w FROM conversations WHERE text IS NOT NULL),
s AS (SELECT outline, position, CASE WHEN position % 5 <> 4 THEN least(w, w // 2 + 1, 6) END AS expected, least(w, 6) AS actual FROM t)
SELECT outline, position, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual FROM s WHERE expected <> actual
UNION ALL SELECT outline, NULL, outline % 5 + 2, CAST(sum(coalesce(expected, 0)) AS BIGINT) FROM s WHERE outline % 3 <> 0 GROUP BY outline HAVING sum(coalesce(expected, 0)) > outline % 5 + 2""",
    "context_view": """
WITH d AS (SELECT conv_id, turn, 'turn ' || turn AS topic, repeat(regexp_replace(coalesce(text, ''), '[^A-Za-z .]', '', 'g'), 20) AS o, role AS kind, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
l AS (SELECT *, greatest(20000 // n - (strlen(to_json({'topic': topic, 'observation': o, 'kind': kind})) - strlen(o) + 40), 0) AS room FROM d),
v AS (SELECT conv_id, turn, length(o) > room AS excerpted, to_json({'topic': topic, 'observation': CASE WHEN length(o) <= room THEN o WHEN room < 19 THEN '' ELSE left(o, (room - 19) // 2) || chr(10) || '[… excerpt …]' || chr(10) || right(o, (room - 19) - (room - 19) // 2) END, 'kind': kind, 'excerpted': length(o) > room}) AS view FROM l)
SELECT conv_id, turn, excerpted, CAST(strlen(view) AS BIGINT) AS bytes, sha256(view) AS hash FROM v""",
    "reading_cost": """
WITH RECURSIVE c AS (SELECT source, sum(strlen(coalesce(text, '')) + strlen('d/' || source) + 256) AS packed, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
k AS (SELECT source, packed, n, coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 7 AS k FROM c),
r AS (SELECT *, 4000 + k * 5000 AS lim, least((20000 + k * 30000) // 8, 12000) + 16000 AS around, greatest(least((4000 + k * 5000) // 6, 48000), 4000) AS summary FROM k),
b AS (SELECT *, greatest(CAST(ceil(packed / (lim * 9 // 10)) AS BIGINT), CAST(ceil(n / 36) AS BIGINT), 1) AS batches FROM r),
w AS (SELECT source, batches AS nodes, CAST(0 AS BIGINT) AS work FROM b UNION ALL SELECT source, (nodes + 3) // 4, work + nodes // 4 + CASE WHEN nodes % 4 > 1 THEN 1 ELSE 0 END FROM w WHERE nodes > 1),
t AS (SELECT b.*, (SELECT max(work) FROM w WHERE w.source = b.source) AS summaries FROM b),
e AS (SELECT *, batches + summaries AS requests, CAST((packed + batches * around + summaries * (lim + around)) * 100 // 250 + (batches + summaries) * summary // 3 AS BIGINT) AS tokens, CAST(ceil((batches + summaries) / (k % 4 + 1)) AS BIGINT) AS minutes,
  greatest(k * 1000000 - 1000, 0) AS tokens_left, greatest(k * 4000 - 90, 0) // 60 AS minutes_left FROM t)
SELECT source, CAST(packed AS BIGINT) AS source_bytes, batches, summaries, requests, tokens, CAST(tokens_left AS BIGINT) AS tokens_left, minutes, CAST(minutes_left AS BIGINT) AS minutes_left, tokens <= tokens_left AND minutes <= minutes_left AS within FROM e""",
}

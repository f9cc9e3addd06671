"""Queries over texts, sections and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import packing, quality
from millrace.functions.paths import is_implementation
from millrace.plans.retrieval import LINES_SQL, SCORE_SQL, lines, scored
from millrace.sources.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def retrieval_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lines in tiers: the first of each path that is an implementation, of other paths, the rest; named files interleave."""
    by_path = Window.partitionBy("path").orderBy(F.desc("score"), "id")
    capped = scored(_lines(spark, sf_dir)).withColumn("nth", F.row_number().over(by_path)).filter("nth <= 8")
    tier = F.when((F.col("nth") == 1) & is_implementation(F.col("path")), 0).when(F.col("nth") == 1, 1).otherwise(2)
    named = F.lower("path").endswith("/doc3.rs")
    priority = F.when(named, F.col("nth") - 1).otherwise(100 + tier)
    return capped.select("id", "path", "score", tier.alias("tier"), priority.cast("int").alias("priority")).orderBy("priority", F.desc("score"), "id").limit(64)


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = T.search_terms(F.col("text"))
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.concat_ws(" ", terms).alias("terms"), F.size(terms).cast("bigint").alias("n"))


def duplicate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.exact_duplicates(_lines(spark, sf_dir).select("doc_id", "start_line", "content"), ["doc_id", "start_line"], "content")


def duplicate_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _lines(spark, sf_dir).select(F.struct("doc_id", "start_line").alias("block"), "content")
    found = quality.near_duplicates(blocks, "block", "content")
    name = lambda c: F.concat_ws(":", F.col(f"{c}.doc_id").cast("string"), F.col(f"{c}.start_line").cast("string")).alias(c)
    return found.select(name("id_a"), name("id_b"), "common", "total")


def conversation_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "role").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


def conversation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "conversations", "conv_id").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    return quality.windows(counts, "n", 3).select("conv_id", "start", "stop")


def omitted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return quality.islands(turns, "conv_id", "turn", F.length("text") > 400)


def footnote_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.footnotes(table(spark, sf_dir, "conversations", "conv_id", "turn", "role"), "conv_id", "turn", "role")


def proportional_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("weight"))
    nations = customers.join(table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return quality.shares(nations, "n_regionkey", "n_nationkey", "weight", 16).select("n_regionkey", "n_nationkey", "weight", "share")


def coverage_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches (sources) by what became of their documents; crowded where at least four are covered."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    state = F.when(F.col("quality") == 1, "covered").when(F.col("quality") == 0, "excluded").otherwise("unassigned")
    found = docs.groupBy("source").agg(*(F.count_if(state == s).alias(s) for s in ("covered", "excluded", "unassigned")))
    return found.withColumn("crowded", F.col("covered") >= 4)


def path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory that all pages of a host share: the common prefix of the least and the greatest url."""
    pages = table(spark, sf_dir, "pages", "url").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    ends = pages.groupBy("host").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.count("*").alias("pages"))
    return ends.select("host", "pages", F.regexp_extract(T.common_prefix(F.col("low"), F.col("high")), "^(.*/)?", 0).alias("root"))


def main_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest directories of each host, ties by name."""
    pages = table(spark, sf_dir, "pages", "url").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*/([^/?#]*)/", 1).alias("dir"))
    counted = pages.groupBy("host", "dir").agg(F.count("*").alias("files"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("files"), "dir")))
    return ranked.filter("place <= 3")


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "text").groupBy("conv_id").agg(F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))
    limit = T.packing_limit(F.lit(8000), F.lit(1000), 20, F.least(F.col("bytes"), F.lit(3000)))
    return turns.select("conv_id", "bytes", T.estimate(F.col("bytes"), 255).alias("tokens"), limit.alias("room"))


def density_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundredths of a byte a token by source: 85 percent of the least valid sample, from three samples on."""
    docs = table(spark, sf_dir, "documents", "source", "text").select("source", F.octet_length("text").alias("bytes"), F.size(F.split("text", " ")).alias("words"))
    sample = docs.withColumn("density", F.floor(F.col("bytes") * 100 / (F.col("words") * 2)).cast("bigint")).filter((F.col("bytes") >= 4096) & F.col("density").between(100, 600))
    found = sample.groupBy("source").agg(F.count("*").alias("samples"), F.min("density").alias("least"))
    value = F.least(F.greatest(F.floor(F.col("least") * 85 / 100).cast("bigint"), F.lit(100)), F.lit(300))
    return found.select("source", "samples", F.when(F.col("samples") >= 3, value).otherwise(100).cast("bigint").alias("density"))


def reduction_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to fold each source's documents, four at a time, and how many levels that takes."""
    counts = table(spark, sf_dir, "documents", "source").groupBy("source").agg(F.count("*").alias("leaves"))
    step = lambda s: F.when(s["n"] > 1, F.struct(F.ceil(s["n"] / 4).cast("bigint").alias("n"), (s["work"] + F.floor(s["n"] / 4).cast("bigint") + F.when(s["n"] % 4 > 1, 1).otherwise(0)).alias("work"), (s["levels"] + 1).alias("levels"))).otherwise(s)
    start = F.struct(F.col("leaves").alias("n"), F.lit(0).cast("bigint").alias("work"), F.lit(0).alias("levels"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, lambda s, _: step(s))
    return counts.select("source", "leaves", folded.alias("f")).select("source", "leaves", F.col("f.work").alias("requests"), F.col("f.levels").alias("levels"))


def warning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues folded by white space and deduplicated."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").filter("event_type in ('error', 'view')")
    message = F.regexp_replace(F.trim(F.concat_ws("  ", F.lit(" user"), (F.col("user_id") % 10).cast("string"))), r"\s+", " ")
    return rows.select(F.when(F.col("event_type") == "error", "major").otherwise("minor").alias("severity"), message.alias("message"), "event_id").groupBy("severity", "message").agg(F.min("event_id").alias("first"), F.count("*").alias("times"))


def document_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: turns joined in order under their headings."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.coalesce("text", F.lit("")))
    return packing.joined_texts(turns.select("conv_id", "turn", part.alias("part")), ["conv_id"], "turn", "part", "\n\n")


def json_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress as a merge: kept fields, then the new event's; absent values leave no key."""
    events = table(spark, sf_dir, "events", "event_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.when(k % 2 == 0, k).alias("k"))).alias("progress"))


_FUNCTIONS = (
    retrieval_tiered, search_terms, duplicate_exact, duplicate_near, conversation_neighbors, conversation_windows, omitted_runs, footnote_numbers, proportional_shares,
    coverage_accounting, path_prefix, main_dirs, token_budget, density_calibration, reduction_levels, warning_rows, document_assembly, json_patch,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_FOLD = "trim(regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
ORACLE = {
    "retrieval_tiered": f"""
WITH s AS (SELECT id, path, names_path, CAST({SCORE_SQL} AS BIGINT) AS score FROM ({LINES_SQL})),
c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS nth FROM s WHERE score > 0),
t AS (SELECT *, CASE WHEN nth = 1 AND ends_with(path, '.rs') AND NOT contains(path, '/tests/') THEN 0 WHEN nth = 1 THEN 1 ELSE 2 END AS tier FROM c WHERE nth <= 8)
SELECT id, path, score, CAST(tier AS INTEGER) AS tier, CAST(CASE WHEN ends_with(names_path, '/doc3.rs') THEN nth - 1 ELSE 100 + tier END AS INTEGER) AS priority FROM t ORDER BY priority, score DESC, id LIMIT 64""",
    "search_terms": f"""
WITH w AS (SELECT conv_id, turn, list_transform(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)) AS words FROM conversations),
f AS (SELECT conv_id, turn, list_filter(words, lambda x, i: strlen(x) > 1 AND x NOT IN ('src', 'js', 'jsx', 'ts', 'tsx', 'test', 'tests', 'backend', 'frontend', 'users', 'workspace') AND list_position(words, x) = i)[1:60] AS terms FROM w)
SELECT conv_id, turn, array_to_string(terms, ' ') AS terms, CAST(len(terms) AS BIGINT) AS n FROM f""",
    "duplicate_exact": f"""
WITH b AS (SELECT doc_id, start_line, {_FOLD} AS folded FROM ({LINES_SQL})), m AS (SELECT * FROM b WHERE length(folded) >= 120),
f AS (SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(start_line) OVER w AS first_start_line FROM m WINDOW w AS (PARTITION BY folded ORDER BY doc_id, start_line))
SELECT * EXCLUDE (folded) FROM f WHERE doc_id <> first_doc_id OR start_line <> first_start_line""",
    "duplicate_near": f"""
WITH b AS (SELECT {{'d': doc_id, 's': start_line}} AS id, {_FOLD} AS folded FROM ({LINES_SQL})),
o AS (SELECT min(id) AS id, string_split(folded, ' ') AS w FROM b WHERE length(folded) >= 200 GROUP BY folded),
p AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM o)),
n AS (SELECT id, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 8),
r AS (SELECT pair FROM p GROUP BY 1 HAVING count(*) >= 2),
k AS (SELECT DISTINCT x.id AS id_a, y.id AS id_b FROM p x JOIN r USING (pair) JOIN p y USING (pair) WHERE x.id < y.id),
c AS (SELECT id_a, id_b, count(*) AS common FROM k JOIN p x ON x.id = id_a JOIN p y ON y.id = id_b AND x.pair = y.pair GROUP BY 1, 2)
SELECT id_a.d || ':' || id_a.s AS id_a, id_b.d || ':' || id_b.s AS id_b, CAST(common AS INTEGER) AS common, CAST(na.n + nb.n - common AS INTEGER) AS total FROM c JOIN n na ON na.id = id_a JOIN n nb ON nb.id = id_b WHERE 100 * common >= 90 * (na.n + nb.n - common)""",
    "conversation_neighbors": "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "conversation_windows": """
WITH c AS (SELECT conv_id, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY 1), s AS (SELECT conv_id, n, unnest(CASE WHEN n <= 3 THEN [0] ELSE range(0, n - 1, 2) END) AS start FROM c)
SELECT conv_id, CAST(start AS INTEGER) AS start, CAST(least(start + 3, n) AS INTEGER) AS stop FROM s""",
    "omitted_runs": """
WITH n AS (SELECT conv_id, turn, length(text) > 400 AS inside, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
o AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM n WHERE NOT inside)
SELECT conv_id, min(turn) AS "from", max(turn) AS "to", count(*) AS omitted FROM o GROUP BY conv_id, run""",
    "footnote_numbers": """
WITH f AS (SELECT conv_id, role, min(turn) AS first_use FROM conversations GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first_use, role) AS INTEGER) AS number FROM f""",
    "proportional_shares": """
WITH c AS (SELECT n_regionkey, n_nationkey, count(*) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
b AS (SELECT *, CAST(floor(weight * 16 / sum(weight) OVER (PARTITION BY n_regionkey)) AS BIGINT) AS base FROM c),
r AS (SELECT *, 16 - sum(base) OVER (PARTITION BY n_regionkey) AS rest, row_number() OVER (PARTITION BY n_regionkey ORDER BY weight DESC, n_nationkey) AS place FROM b)
SELECT n_regionkey, n_nationkey, weight, base + CASE WHEN place <= rest THEN 1 ELSE 0 END AS share FROM r""",
    "coverage_accounting": """
WITH s AS (SELECT source, CASE WHEN quality = 1 THEN 'covered' WHEN quality = 0 THEN 'excluded' ELSE 'unassigned' END AS state FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, count(*) FILTER (state = 'covered') AS covered, count(*) FILTER (state = 'excluded') AS excluded, count(*) FILTER (state = 'unassigned') AS unassigned, count(*) FILTER (state = 'covered') >= 4 AS crowded FROM s GROUP BY 1""",
    "path_prefix": """
WITH p AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
e AS (SELECT host, min(path) AS low, max(path) AS high, count(*) AS pages FROM p GROUP BY 1),
k AS (SELECT host, pages, low, list_max(list_filter(range(0, least(length(low), length(high)) + 1), lambda k: left(low, k) = left(high, k))) AS n FROM e)
SELECT host, pages, regexp_extract(left(low, n), '^(.*/)?', 0) AS root FROM k""",
    "main_dirs": """
WITH p AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([^/?#]*)/', 1) AS dir FROM pages), c AS (SELECT host, dir, count(*) AS files FROM p GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY host ORDER BY files DESC, dir) AS INTEGER) AS place FROM c QUALIFY place <= 3""",
    "token_budget": """
WITH t AS (SELECT conv_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations GROUP BY 1)
SELECT conv_id, bytes, CAST(ceil((bytes + 256) * 100 / 255) AS BIGINT) AS tokens, CAST(greatest(floor(floor((8000 - 1600 - 1000) * 1.0) * 100 / 125) - least(bytes, 3000), 0) AS BIGINT) AS room FROM t""",
    "density_calibration": """
WITH s AS (SELECT source, strlen(text) AS bytes, len(string_split(text, ' ')) AS words FROM documents), d AS (SELECT source, CAST(floor(bytes * 100 / (words * 2)) AS BIGINT) AS density FROM s WHERE bytes >= 4096),
g AS (SELECT source, count(*) AS samples, min(density) AS low FROM d WHERE density BETWEEN 100 AND 600 GROUP BY 1)
SELECT source, samples, CAST(CASE WHEN samples >= 3 THEN least(greatest(floor(low * 85 / 100), 100), 300) ELSE 100 END AS BIGINT) AS density FROM g""",
    "reduction_levels": """
WITH RECURSIVE c AS (SELECT source, count(*) AS leaves FROM documents GROUP BY 1),
r AS (SELECT source, leaves, leaves AS n, CAST(0 AS BIGINT) AS work, 0 AS levels FROM c UNION ALL SELECT source, leaves, CAST(ceil(n / 4) AS BIGINT), work + n // 4 + CASE WHEN n % 4 > 1 THEN 1 ELSE 0 END, levels + 1 FROM r WHERE n > 1)
SELECT source, leaves, max(work) AS requests, max(levels) AS levels FROM r GROUP BY 1, 2""",
    "warning_rows": """
SELECT CASE WHEN event_type = 'error' THEN 'major' ELSE 'minor' END AS severity, 'user ' || CAST(user_id % 10 AS VARCHAR) AS message, min(event_id) AS first, count(*) AS times FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2""",
    "document_assembly": """
WITH d AS (SELECT conv_id, string_agg('## ' || role || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1)
SELECT conv_id, sha256(t) AS hash, CAST(strlen(t) AS BIGINT) AS bytes FROM d""",
    "json_patch": """
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, '{"kind":"' || event_type || '"' || CASE WHEN k % 2 = 0 THEN ',"k":' || k ELSE '' END || '}' AS progress FROM e""",
}

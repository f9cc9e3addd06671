"""Drafts to repair, ignored paths, stored graphs, commits of several tables, and streams that end."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions import ignore, paths
from millrace.operators import code, repair, scopes
from millrace.session import new_folder, written
from millrace.sources import commits
from millrace.sources.tables import table
from millrace.streaming import tails
from millrace.streaming.events import read_events


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    split = docs.select("doc_id", F.split(F.regexp_replace("text", r"[^A-Za-z .\n]", ""), "\n").alias("lines"))
    return split.select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("part", "line"))


def repair_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as parts of drafts; issues quote, cite and number what stands in one of them, or nothing."""
    lines = _lines(spark, sf_dir)
    i, line = F.col("part"), F.col("line")
    cite = F.concat(F.lit(" [E:"), F.left(F.sha2(line, 256), F.lit(12)), F.lit("]"))
    fence = F.lit("\n```mermaid\ngraph\n```\n")
    text = F.concat(line, F.when(i % 4 == 1, cite).otherwise(""), F.when(i % 6 == 2, fence).otherwise(""))
    # Each is read several times.
    parts = written(lines.select("doc_id", "part", text.alias("text")), "parts")
    d = F.col("doc_id")
    chosen = lines.filter(i == d % F.col("n"))
    phrase = F.substring(line, 5, 30)
    messages = F.array(
        F.when((d % 2 == 0) & (F.length(phrase) >= 8), F.concat(F.lit('The phrase "'), phrase, F.lit('" repeats.'))),
        F.when((d % 3 == 0) & (i % 4 == 1), F.concat(F.lit("See [E:"), F.left(F.sha2(line, 256), F.lit(10)), F.lit("] again"))),
        F.when(d % 5 == 0, F.lit("owns 3 Mermaid diagram(s) in section_plan.diagrams but contains 1.")),
        F.when(d % 7 == 0, F.concat(F.lit('MERMAID_INVALID: {"diagram": '), (d % 3 + 1).cast("string"), F.lit("}"))),
        F.when(d % 11 == 0, F.lit("Too long.")),
    )
    issues = written(chosen.select("doc_id", F.posexplode(messages).alias("issue", "message")).filter("message is not null"), "issues")
    return repair.repair_targets(parts, issues, "doc_id")


def reading_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns to read: neither a user's nor short, but all of a conversation that has no others."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    out = (F.col("role") == "user") | (F.length("text") < 120)
    return scopes.with_fallback(turns, "conv_id", "turn", out).select("conv_id", "turn")


#: Ignore files of the tree that :func:`ignored_paths` looks at, by folder.
IGNORE = {"": "*.log\n/build/\n!keep.log\ndocs/**/*.md\n", "en": "!*.log\nsecret?\\ .txt\n", "en/x": "*.log\n*\n!a[0-4]*\n", "de/build": "!*\n", "fr": "# none\nx/\n"}


def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree with ignore rules at several depths."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    d = F.col("doc_id")
    folder = F.element_at(F.array(*map(F.lit, ("", "/x", "/build", "/docs/a/b", "/x/build"))), (d % 5 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, (".log", ".md", ".txt", "")))  , (F.floor(d / 5) % 4 + 1).cast("int"))
    stem = F.when(d % 7 == 0, "keep").otherwise(F.concat(F.lit("a"), d.cast("string")))
    path = F.concat(F.when(d % 9 == 0, F.lit("build/")).otherwise(""), "lang", folder, F.lit("/"), stem, name)
    files = docs.select(path.alias("path")).distinct()
    held = spark.createDataFrame([(f"{k}/.gitignore".lstrip("/"), v) for k, v in IGNORE.items()], "path string, content string")
    return ignore.ignored(files, ignore.rules_of(held))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: every line with two words declares the first and calls the second."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    words = F.transform(F.split(F.regexp_replace("text", r"[^A-Za-z \n]", ""), "\n"), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
    named = F.filter(words, lambda w: F.size(w) >= 2)
    body = F.array_join(F.transform(named, lambda w: F.concat(F.lit("fn f_"), w[0], F.lit("() {\n    f_"), w[1], F.lit("();\n}"))), "\n")
    path = F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(".rs"))
    rows = docs.select("doc_id", path.alias("path"), body.alias("content"))
    return rows.select("doc_id", "path", "content", F.sha2("content", 256).alias("hash"), paths.language(F.col("path")).alias("language"))


def graph_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored graphs of documents as code: two thirds first, then all, again, with changes and losses, and under a new parser."""
    # Every step reads all files several times.
    files, folder, out = written(_code(spark, sf_dir).dropDuplicates(["path"]), "files"), new_folder(spark, "graphs"), []
    edited = F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit("\nfn last() {\n}"))).otherwise(F.col("content"))
    changed = files.filter("doc_id % 10 <> 1").withColumn("content", edited).withColumn("hash", F.sha2("content", 256))
    steps = [("first", files.filter("doc_id % 3 <> 0"), "1"), ("all", files, "1"), ("again", files, "1"), ("changed", changed, "1"), ("parser", changed, "2")]
    for name, now, version in steps:
        parsed = commits.rebuild(spark, now, folder, version, name, code.symbols, code.edges)
        held = commits.read(spark, folder, "files", commits.FILES)
        seen = held.agg(F.count("*").alias("files"), F.sum("symbols").alias("symbols"), F.sum("edges").alias("edges")).first()
        rows = [commits.read(spark, folder, t, commits.SCHEMAS[t]).count() for t in ("symbols", "edges")]
        out.append((name, parsed, seen.files, seen.symbols, seen.edges, *rows))
    return spark.createDataFrame(out, "step string, parsed bigint, files bigint, symbols bigint, edges bigint, symbol_rows bigint, edge_rows bigint")


def artifact_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs that publish: an artifact, a status and an event of many runs at once, a repeated commit without effect."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    folder = new_folder(spark, "published")
    run = F.col("o_orderkey").alias("run")
    states = lambda rows, status: rows.select(run, status.alias("status"))
    commits.commit(spark, folder, {"runs": states(orders, F.lit("running"))}, "start")
    done = orders.filter("o_orderstatus <> 'O'")
    final = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("completed_with_warnings")
    tables = {"runs": states(done, final), "artifacts": done.select(run, F.sha2(F.col("o_totalprice").cast("string"), 256).alias("hash")), "events": done.select(run, F.lit("published").alias("kind"))}
    commits.commit(spark, folder, tables, "publish")
    commits.commit(spark, folder, tables, "publish")
    # What a killed commit leaves.
    orders.select(run, F.lit("lost").alias("status")).write.parquet(f"{folder}/data/runs/killed")
    runs = commits.latest(commits.read(spark, folder, "runs", "run bigint, status string"), ["run"])
    counted = lambda name: commits.read(spark, folder, name, "run bigint").groupBy("run").agg(F.count("*").alias(name))
    return runs.join(counted("artifacts"), "run", "left").join(counted("events"), "run", "left").select("run", "status", F.col("commit"), F.coalesce("artifacts", F.lit(0)).alias("artifacts"), F.coalesce("events", F.lit(0)).alias("events"))


#: A tail waits so long behind the end of its run.
IDLE_MS = 3_600_000
#: Files of a batch at most, more than a step has.
FILES = 1_000_000
STEPS = 8


@contextmanager
def _state_store(spark: SparkSession):
    """For streams that keep their state in the store: ``draining_tail`` and ``newest_events``."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, tails.STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _streamed(spark: SparkSession, sf_dir: str, folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """The events table as a stream by user, in eight steps of rising ids, each of which is a batch; purchases end a run, errors are its other states.

    Files of one step are in no order, so that a batch of only some of them could bring ids behind those of the next.
    """
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").filter("user_id is not null")
    kind = F.when(F.col("event_type").isin("purchase", "error"), "status").otherwise("progress")
    data = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "running").otherwise(F.col("event_type"))
    rows = events.select(F.col("user_id").cast("bigint").alias("run"), F.col("event_id").cast("bigint").alias("id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), data.alias("data"))
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    # Bounds of ids, by which files skip what is not of the step.
    bounds = [low + (high - low + 1) * k // STEPS for k in range(STEPS + 1)] if low is not None else [0] * (STEPS + 1)
    for k in range(STEPS):
        rows.filter((F.col("id") >= bounds[k]) & (F.col("id") < bounds[k + 1])).write.mode("append").parquet(f"{folder}/source")
        start(read_events(spark, f"{folder}/source", tails.EVENT, files_per_trigger=FILES)).awaitTermination()


def run_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tails of all users' events have sent, and which of them have closed."""
    folder = new_folder(spark, "tails")
    _streamed(spark, sf_dir, folder, lambda events: tails.drain(events, folder, IDLE_MS))
    rows, is_end = tails.sent(spark, folder), F.col("kind") == "stream-end"
    sent = F.when(~is_end, F.col("id"))
    return rows.groupBy("run").agg(F.count(sent).alias("events"), F.countDistinct(sent).alias("ids"), F.max(sent).alias("last"), (F.coalesce(F.max(F.when(is_end, F.col("id"))), F.lit(-1)) == F.max(sent)).alias("closed"))


def event_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty events of every user after the stream, and how many are gone."""
    folder = new_folder(spark, "buffers")
    _streamed(spark, sf_dir, folder, lambda events: tails.keep_newest(events, folder, 20))
    return tails.buffers(spark, folder).select(F.col("run").alias("user_id"), F.col("id").alias("event_id"), "kind", "data", "missing")


QUERIES = {f.__name__: f for f in (repair_targets, reading_fallback, ignored_paths, graph_rebuild, artifact_commit, run_tails, event_buffer)}

_STREAM = "CASE WHEN event_type IN ('purchase', 'error') THEN 'status' ELSE 'progress' END AS kind, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'running' ELSE event_type END AS data"
ORACLE = {
    "reading_fallback": """
WITH t AS (SELECT conv_id, turn, role = 'user' OR length(text) < 120 AS out FROM conversations)
SELECT conv_id, turn FROM t QUALIFY NOT coalesce(out, false) OR min(CASE WHEN out THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) = 1""",
    "repair_targets": """
WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS part, len(s) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z .\\n]', '', 'g'), chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, part, n, line || CASE WHEN part % 4 = 1 THEN ' [E:' || left(sha256(line), 12) || ']' ELSE '' END AS text, count(*) FILTER (part % 6 = 2) OVER (PARTITION BY doc_id ORDER BY part) AS drawn FROM l),
c AS (SELECT doc_id, part, n, line, substr(line, 5, 30) AS phrase FROM l WHERE part = doc_id % n),
i AS (SELECT doc_id, 0 AS issue, trim(phrase, ' ') AS want FROM c WHERE doc_id % 2 = 0 AND length(phrase) >= 8 UNION ALL SELECT doc_id, 1, '[E:' || left(sha256(line), 8) FROM c WHERE doc_id % 3 = 0 AND part % 4 = 1
  UNION ALL SELECT doc_id, 2, NULL FROM c WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 3, NULL FROM c WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 4, NULL FROM c WHERE doc_id % 11 = 0),
t AS (SELECT DISTINCT i.doc_id, issue, part AS target FROM i JOIN p USING (doc_id) WHERE contains(text, want) UNION SELECT doc_id, 2, n FROM c WHERE doc_id % 5 = 0
  UNION SELECT i.doc_id, 3, part FROM i JOIN p USING (doc_id) WHERE issue = 3 AND part % 6 = 2 AND drawn = doc_id % 3 + 1),
g AS (SELECT n.doc_id, (SELECT count(*) FROM i WHERE i.doc_id = n.doc_id) > 0 AND NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = n.doc_id AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = i.doc_id AND t.issue = i.issue))
  AND (SELECT count(DISTINCT target) FROM t WHERE t.doc_id = n.doc_id AND target < n.n) < n.n AS good FROM (SELECT DISTINCT doc_id, n FROM l) n)
SELECT DISTINCT doc_id, CAST(target AS BIGINT) AS target FROM t JOIN g USING (doc_id) WHERE good UNION ALL SELECT doc_id, NULL FROM g WHERE NOT good""",
    "graph_rebuild": """
WITH f AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[^A-Za-z \\n]', '', 'g'), chr(10)), lambda x: list_filter(string_split(x, ' '), lambda w: w <> '')), lambda w: len(w) >= 2) AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(l) AS s, len(l) AS e FROM f),
x AS (SELECT doc_id, s + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS s, e FROM c WHERE doc_id % 10 <> 1),
r AS (SELECT 'first' AS step, (SELECT count(*) FROM c WHERE doc_id % 3 <> 0) AS parsed, count(*) AS files, sum(s) AS s, sum(e) AS e FROM c WHERE doc_id % 3 <> 0
  UNION ALL SELECT 'all', (SELECT count(*) FROM c WHERE doc_id % 3 = 0), count(*), sum(s), sum(e) FROM c UNION ALL SELECT 'again', 0, count(*), sum(s), sum(e) FROM c
  UNION ALL SELECT 'changed', count(*) FILTER (doc_id % 10 = 0), count(*), sum(s), sum(e) FROM x UNION ALL SELECT 'parser', count(*), count(*), sum(s), sum(e) FROM x)
SELECT step, CAST(parsed AS BIGINT) AS parsed, files, CAST(s AS BIGINT) AS symbols, CAST(e AS BIGINT) AS edges, CAST(s AS BIGINT) AS symbol_rows, CAST(e AS BIGINT) AS edge_rows FROM r""",
    "artifact_commit": """
SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'completed_with_warnings' END AS status, CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS BIGINT) AS "commit",
  CAST(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS BIGINT) AS artifacts, CAST(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS BIGINT) AS events FROM orders""",
    "run_tails": """
WITH e AS (SELECT CAST(user_id AS BIGINT) AS run, CAST(event_id AS BIGINT) AS id, ts, event_type FROM events WHERE user_id IS NOT NULL)
SELECT run, count(*) AS events, count(DISTINCT id) AS ids, max(id) AS last, coalesce(arg_max(event_type, id) FILTER (event_type IN ('purchase', 'error')) = 'purchase', false) AND max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e) AS closed FROM e GROUP BY 1""",
    "event_buffer": f"""
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS BIGINT) AS event_id, {_STREAM}, CAST(greatest(count(*) OVER (PARTITION BY user_id) - 20, 0) AS BIGINT) AS missing FROM events WHERE user_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20""",
}

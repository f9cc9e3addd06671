"""Content addresses, shared blobs, caches, event logs and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.operators import state
from millrace.operators.ordering import first_of
from millrace.sources.tables import table


def content_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    digest = F.sha2("text", 256)
    return docs.select("doc_id", digest.alias("content_hash"), F.sha2(F.concat_ws(":", "source", F.lit("1"), digest), 256).alias("evidence_id"), F.sha2(F.concat(F.lit(":"), "text"), 256).alias("blob_hash"), F.octet_length("text").cast("bigint").alias("bytes"))


def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("uses"), F.min(F.octet_length("text")).cast("bigint").alias("bytes"))


def blob_resolve_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content from the shared blob if there is one, else from the row."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("hash", F.sha2("text", 256))
    blobs = docs.filter("doc_id % 2 = 0").groupBy("hash").agg(F.min("text").alias("content"))
    found = docs.join(blobs, "hash", "left")
    content = F.coalesce("content", "text")
    return found.select("doc_id", F.col("content").isNotNull().alias("shared"), F.octet_length(content).cast("bigint").alias("bytes"), F.left(content, F.lit(600)).alias("head"))


def orphan_blob_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs that no labelled document refers to."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("hash", F.sha2("text", 256))
    held = docs.join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi").select("hash")
    return docs.select("hash").distinct().join(held, "hash", "left_anti")


def reading_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    names = F.array(*map(F.lit, paths.SAMPLE_PATHS))
    placed = docs.withColumn("path", F.element_at(names, (F.col("doc_id") % len(paths.SAMPLE_PATHS) + 1).cast("int")))
    return placed.select("doc_id", "path", paths.reading_exclusion(F.col("path"), F.left("text", F.lit(600))).alias("reason"), paths.is_implementation(F.col("path")).alias("implementation"), paths.language(F.col("path")).alias("language"), paths.is_skipped_by_default(F.col("path")).alias("skipped"))


def exclusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paths each reason excludes, and the first 20 of them."""
    found = reading_exclusion(spark, sf_dir).filter("reason is not null")
    # Paths are counted before they are listed, and ranked before they are collected.
    by_path = found.groupBy("reason", "path").agg(F.count("*").alias("files"))
    counted = by_path.groupBy("reason").agg(F.sum("files").alias("files"))
    listed = first_of(by_path, "reason", "path", 20)
    return counted.join(listed, "reason").select("reason", "files", F.concat_ws(",", "first").alias("paths"))


def file_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "source", "n_chars")
    status = F.when(F.col("n_chars") > 5000, "skipped").when(F.col("n_chars") < 100, "excluded").otherwise("indexed")
    return docs.groupBy("source").agg(F.count("*").alias("files"), *(F.count_if(status == s).alias(s) for s in ("indexed", "excluded", "skipped")))


def cache_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "html").agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).cast("bigint").alias("bytes"), F.count("*").alias("entries"))


EVICT_CAP = 400_000


def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.octet_length("html").cast("bigint").alias("bytes"))
    return state.cut_oldest(pages, F.col("bytes"), ["page_id"], EVICT_CAP, batch=20, batches=20).select("page_id", "bytes")


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.keyset_page(table(spark, sf_dir, "events", "event_id", "user_id", "event_type"), "event_id", 500, 200)


def recent_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)


def tail_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tail_ascending(table(spark, sf_dir, "events", "event_id", "user_id", "event_type"), "event_id", 500)


def latest_state_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type", "value")
    return state.latest_by_key(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def append_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "user_id", "event_type", "event_id")
    return state.append_if_absent(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1").select("user_id", "event_type"), ["user_id", "event_type"])


def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    owed = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return state.upsert(customers, owed.filter("c_acctbal > 200000"), ["c_custkey"])


NOW = "2024-02-01 00:00:00"


def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (users) whose newest event is too old, with what a cascade deletes."""
    events = table(spark, sf_dir, "events", "user_id", "event_id", "ts")
    newest = events.groupBy("user_id").agg(F.max("ts").alias("updated_at"), F.count("*").alias("children"))
    return state.expired(newest, "updated_at", NOW, 3).select("user_id", "children")


def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value").withColumn("tokens", F.floor(F.col("value") * 100).cast("bigint"))
    return state.rate_window(events, "user_id", "ts", "tokens", 3600).select("event_id", "rpm", "tpm")


def reservation_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    out = state.reconcile(events, "user_id", "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase", F.floor(F.col("value") * 100))
    return out.select("user_id", F.col("released").cast("bigint").alias("released"), "responses")


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by run, and whether they pass a budget."""
    events = table(spark, sf_dir, "events", "user_id", "value")
    totals = events.groupBy("user_id").agg(F.sum(F.floor(F.col("value") * 100)).cast("bigint").alias("tokens"), F.count("*").alias("calls"))
    return totals.withColumn("over", F.col("tokens") > 100_000)


def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of three kinds of event that has a valid counter."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    valid = events.filter(F.col("event_type").isin("view", "click", "purchase")).withColumn("k", k).filter(F.col("k").between(0, 60))
    return valid.groupBy("user_id").agg(F.max_by("k", "event_id").alias("k"), F.max("event_id").alias("event_id"))


def first_of_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's most recent order."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return state.latest_by_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").join(table(spark, sf_dir, "documents", "doc_id", "source"), "doc_id")
    return labels.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("major"), F.count_if(F.col("toxic") == 0).alias("other"), F.sum(F.when(F.col("quality") == 0, 1)).alias("low_quality"))


QUERIES = {
    f.__name__: f
    for f in (
        content_address, blob_dedup, blob_resolve_left_join, orphan_blob_gc, reading_exclusion, exclusion_report, file_status_counts, cache_bytes, cache_evict,
        keyset_page, recent_first, tail_reversed, latest_state_by_key, append_if_absent, upsert_state, retention_expired, rate_window, reservation_reconcile,
        usage_totals, progress_latest, first_of_task, severity_counts,
    )
}

_PATHS = "[" + ", ".join(f"'{p}'" for p in paths.SAMPLE_PATHS) + "]"
_PLACED = f"SELECT doc_id, text, {_PATHS}[CAST(doc_id % {len(paths.SAMPLE_PATHS)} + 1 AS INTEGER)] AS path FROM documents"
_EXCLUDED = f"SELECT doc_id, path, {paths.EXCLUSION_SQL} AS reason, {paths.IMPLEMENTATION_SQL} AS implementation, {paths.LANGUAGE_SQL} AS language, {paths.SKIPPED_SQL} AS skipped FROM ({_PLACED})"

ORACLE = {
    "content_address": "SELECT doc_id, sha256(text) AS content_hash, sha256(source || ':1:' || sha256(text)) AS evidence_id, sha256(':' || text) AS blob_hash, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "blob_dedup": "SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS uses, CAST(min(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "blob_resolve_left_join": """
WITH d AS (SELECT doc_id, text, sha256(text) AS hash FROM documents), b AS (SELECT hash, min(text) AS content FROM d WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT doc_id, content IS NOT NULL AS shared, CAST(strlen(coalesce(content, text)) AS BIGINT) AS bytes, left(coalesce(content, text), 600) AS head FROM d LEFT JOIN b USING (hash)""",
    "orphan_blob_gc": "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))",
    "reading_exclusion": _EXCLUDED,
    "exclusion_report": f"""
WITH e AS ({_EXCLUDED}), p AS (SELECT reason, path, count(*) AS files FROM e WHERE reason IS NOT NULL GROUP BY 1, 2)
SELECT reason, CAST(sum(files) AS BIGINT) AS files, array_to_string(list_sort(list(path))[1:20], ',') AS paths FROM p GROUP BY 1""",
    "file_status_counts": """
WITH s AS (SELECT source, CASE WHEN n_chars > 5000 THEN 'skipped' WHEN n_chars < 100 THEN 'excluded' ELSE 'indexed' END AS status FROM documents)
SELECT source, count(*) AS files, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'excluded') AS excluded, count(*) FILTER (status = 'skipped') AS skipped FROM s GROUP BY 1""",
    "cache_bytes": "SELECT CAST(coalesce(sum(strlen(html)), 0) AS BIGINT) AS bytes, count(*) AS entries FROM pages",
    "cache_evict": f"""
WITH p AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, (row_number() OVER (ORDER BY page_id) - 1) // 20 AS batch FROM pages),
b AS (SELECT batch, sum(bytes) AS freed FROM p GROUP BY 1), t AS (SELECT sum(bytes) AS total FROM p),
g AS (SELECT batch, coalesce(sum(freed) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT page_id, bytes FROM p JOIN g USING (batch), t WHERE NOT (batch < 20 AND total - before > {EVICT_CAP})""",
    "keyset_page": "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200",
    "recent_first": "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "tail_reversed": "SELECT event_id, user_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500) ORDER BY event_id",
    "latest_state_by_key": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "append_if_absent": "SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1 AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 2 = 0)",
    "upsert_state": """
WITH o AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders GROUP BY 1 HAVING max(o_totalprice) > 200000)
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM o) UNION ALL SELECT * FROM o""",
    "retention_expired": f"SELECT user_id, count(*) AS children FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '{NOW}' - INTERVAL 3 DAY",
    "rate_window": """
SELECT event_id, count(*) OVER w AS rpm, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER w AS BIGINT) AS tpm FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)""",
    "reservation_reconcile": """
WITH e AS (SELECT *, floor(value * 100) AS amount, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM events),
p AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN amount END IGNORE NULLS) OVER (PARTITION BY user_id, span ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending FROM e)
SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' AND pending IS NOT NULL THEN greatest(pending - amount, 0) ELSE 0 END) AS BIGINT) AS released, count(*) FILTER (event_type = 'purchase') AS responses FROM p GROUP BY 1""",
    "usage_totals": "SELECT user_id, CAST(sum(floor(value * 100)) AS BIGINT) AS tokens, count(*) AS calls, sum(floor(value * 100)) > 100000 AS over FROM events GROUP BY 1",
    "progress_latest": """
WITH v AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('view', 'click', 'purchase'))
SELECT user_id, arg_max(k, event_id) AS k, max(event_id) AS event_id FROM v WHERE k BETWEEN 0 AND 60 GROUP BY 1""",
    "first_of_task": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "severity_counts": "SELECT source, count(*) FILTER (toxic = 1) AS major, count(*) FILTER (toxic = 0) AS other, CAST(sum(CASE WHEN quality = 0 THEN 1 END) AS BIGINT) AS low_quality FROM labels JOIN documents USING (doc_id) GROUP BY 1",
}

"""Queries that ingest texts: chunks, batches, packing, code and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import chunks, markdown
from millrace.operators import code, graph, packing, sections
from millrace.session import shared_folder
from millrace.sources.tables import table
from millrace.streaming import events as streams


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole documents; lossless, so equal chunks give one blob."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = docs.select("doc_id", F.posexplode(chunks.chunk_text(F.col("text"))).alias("chunk", "c"))
    return found.select("doc_id", "chunk", "c.start_line", "c.end_line", F.octet_length("c.content").cast("bigint").alias("bytes"), F.sha2("c.content", 256).alias("hash"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = docs.select("doc_id", F.posexplode(chunks.segments(F.col("text"), 2000)).alias("segment", "c"))
    return found.select("doc_id", "segment", "c.start_line", "c.end_line", F.octet_length("c.content").cast("bigint").alias("bytes"))


def leaf_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation in batches bounded by size and number."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("cost", (F.octet_length("text") + packing.ENVELOPE).cast("bigint"))
    return packing.batches(turns, ["conv_id"], "turn", "cost", 1500, 36)


def pack_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation packed role by role."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("cost", (F.octet_length("text") + packing.ENVELOPE).cast("bigint"))
    packed = packing.pack_round_robin(turns.withColumn("item", F.col("turn").cast("string")), ["conv_id"], "role", "turn", "cost", 2500, "item")
    return packed.select("conv_id", F.concat_ws(",", "ids").alias("turns"), "size", "deferred")


def scope_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation by role, each counted, those that do not fit deferred."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("cost", (F.octet_length("text") + packing.ENVELOPE).cast("bigint"))
    return packing.scope_records(turns.withColumn("item", F.col("turn")), ["conv_id"], "role", "turn", "cost", 2500, "item")


def pack_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed role by role, roles in the order in which they come."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("cost", (F.octet_length("text") + packing.ENVELOPE).cast("bigint"))
    packed = packing.pack_by_path(turns.withColumn("item", F.col("turn").cast("string")), ["conv_id"], "role", "turn", "cost", 2500, "item")
    return packed.select("conv_id", F.concat_ws(",", "ids").alias("turns"), "size", "deferred")


def ration_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("cost", (F.octet_length("text") + packing.ENVELOPE).cast("bigint"))
    return packing.ration(turns, ["conv_id"], "role", "turn", "cost", 2500)


def section_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sections that cite documents; every third id is unknown."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    section = (F.col("conv_id") * 100 + F.col("turn")).alias("section")
    cite = F.concat(F.lit(" [E:"), (F.col("turn") % 3).cast("string"), F.lit("]"))
    body = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("```\n[E:9]\n"), "text")).when(F.col("turn") % 5 == 4, F.col("text")).otherwise(F.concat("text", cite))
    evidence = spark.range(2).select(F.col("id").cast("string").alias("id"))
    return sections.section_issues(turns.select(section, body.alias("markdown")), evidence)


def generated_code(spark: SparkSession, lines: int, per_file: int = 10_000) -> DataFrame:
    """Files of one-line functions, each calling one of another file."""
    rows = spark.range(lines, numPartitions=max(1, lines // per_file)).select((F.col("id") / per_file).cast("bigint").alias("f"), F.col("id").alias("n"))
    line = F.concat(F.lit("fn step_"), F.col("n").cast("string"), F.lit("() { step_"), ((F.col("n") + per_file) % lines).cast("string"), F.lit("(); }"))
    files = rows.select("f", "n", line.alias("line")).groupBy("f").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])).alias("content"))
    return files.select(F.concat(F.lit("src/gen_"), F.col("f").cast("string"), F.lit(".rs")).alias("path"), "content")


def ingest_generated(spark: SparkSession, lines: int) -> DataFrame:
    """Ingest of generated code: chunks, symbols and links by file."""
    files = generated_code(spark, lines)
    found = code.symbols(files).select(F.col("path").alias("file"), "name")
    calls = code.edges(files).filter("kind = 'calls'").select(F.col("path").alias("file"), "owner", graph.tail_name(F.col("target")).alias("name"))
    links = graph.resolve_links(calls, found).groupBy("file").agg(F.sum("calls").alias("calls"), F.count_if(F.col("kind") == "resolved").alias("resolved"))
    pieces = files.select(F.col("path").alias("file"), F.explode(chunks.chunk_text(F.col("content"))).alias("c")).groupBy("file").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("c.content")).cast("bigint").alias("bytes"))
    return pieces.join(links, "file", "left")


def ingest_cached(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """The same with parse results read through ``folder`` by path and content hash: only files that it lacks are parsed."""
    hashed = files.withColumn("hash", F.sha2("content", 256))
    known = spark.read.parquet(f"{folder}/pieces").select("path", "hash") if streams.exists(spark, f"{folder}/pieces") else None
    # Read by three writers, each of which also looks up the hashes.
    missing = (hashed if known is None else hashed.join(known, ["path", "hash"], "left_anti")).persist()
    if known is None or not missing.isEmpty():
        names = missing.select("path", "hash")
        keyed = lambda rows: rows.join(names, "path")
        keyed(code.symbols(missing).select("path", "name")).write.mode("append").parquet(f"{folder}/symbols")
        keyed(code.edges(missing).filter("kind = 'calls'").select("path", "owner", graph.tail_name(F.col("target")).alias("name"))).write.mode("append").parquet(f"{folder}/calls")
        sized = missing.select("path", "hash", F.explode(chunks.chunk_text(F.col("content"))).alias("c"))
        sized.groupBy("path", "hash").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("c.content")).cast("bigint").alias("bytes")).write.mode("append").parquet(f"{folder}/pieces")
    missing.unpersist()
    now = hashed.select("path", "hash")
    held = lambda name: spark.read.parquet(f"{folder}/{name}").join(now, ["path", "hash"], "left_semi").drop("hash").withColumnRenamed("path", "file")
    links = graph.resolve_links(held("calls"), held("symbols")).groupBy("file").agg(F.sum("calls").alias("calls"), F.count_if(F.col("kind") == "resolved").alias("resolved"))
    return held("pieces").join(links, "file", "left")


def ingest_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_generated(spark, 100_000)


def heading_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of conversations as documents, those inside fences left out."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    body = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("## "), "role", F.lit("\n"))).otherwise(F.concat(F.lit("```\n# "), "role", F.lit("\n```\n# after\n")))
    return turns.select("conv_id", "turn", F.concat_ws("|", markdown.headings(body)).alias("headings"))


def event_stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event by user, read as a stream and written in complete mode to a table in the shared folder."""
    import uuid

    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    folder = shared_folder(spark) + f"/stream-{uuid.uuid4().hex}"
    stream = streams.read_events(spark, source if _is_folder(spark, source) else f"{sf_dir}/events*.parquet", schema)
    latest = streams.latest_progress(stream, "user_id", "event_id", "event_type")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/latest")

    query = latest.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/latest")


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


QUERIES = {f.__name__: f for f in (chunk_text, segments, leaf_batches, pack_round_robin, scope_records, pack_by_path, ration_records, section_checks, ingest_code, heading_counts, event_stream_latest)}

#: Pieces of texts of at most ``most`` bytes, cut after line ends, else between characters.
_CUTS = """
WITH RECURSIVE c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS k FROM documents WHERE text <> ''),
b AS (SELECT doc_id, ch = chr(10) AS line, CAST(sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop FROM c),
l AS (SELECT doc_id, list(stop ORDER BY stop) AS stops, list(stop ORDER BY stop) FILTER (line) AS line_stops, max(stop) AS total FROM b GROUP BY 1),
r AS (SELECT doc_id, 0 AS piece, CAST(0 AS BIGINT) AS start, CASE WHEN total <= {most} THEN total ELSE coalesce(list_max(list_filter(line_stops, lambda x: x <= {most})), list_max(list_filter(stops, lambda x: x <= {most}))) END AS stop FROM l
  UNION ALL SELECT r.doc_id, piece + 1, stop, CASE WHEN total <= stop + {most} THEN total ELSE coalesce(list_max(list_filter(line_stops, lambda x: x <= stop + {most} AND x > stop)), list_max(list_filter(stops, lambda x: x <= stop + {most}))) END
  FROM r JOIN l ON l.doc_id = r.doc_id WHERE stop < total)
"""
ORACLE = {
    "section_checks": """
WITH s AS (SELECT conv_id * 100 + turn AS section, turn FROM conversations)
SELECT section, 'unknown_citation' AS code, '2' AS detail FROM s WHERE turn % 4 <> 3 AND turn % 5 <> 4 AND turn % 3 = 2
UNION ALL SELECT section, 'no_citation', '' FROM s WHERE turn % 4 = 3 OR turn % 5 = 4
UNION ALL SELECT section, 'unclosed_fence', '' FROM s WHERE turn % 4 = 3""",
    "heading_counts": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '## ' || role ELSE '# after' END AS headings FROM conversations",
    "event_stream_latest": "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1",
    "leaf_batches": """
WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(strlen(text) + 256 AS BIGINT) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, cost AS size, 1 AS n, 0 AS batch FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN size + cost > 1500 OR n >= 36 THEN cost ELSE size + cost END, CASE WHEN size + cost > 1500 OR n >= 36 THEN 1 ELSE n + 1 END, batch + CASE WHEN size + cost > 1500 OR n >= 36 THEN 1 ELSE 0 END
  FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
SELECT conv_id, turn, batch FROM r""",
    "pack_round_robin": """
WITH RECURSIVE t AS (SELECT conv_id, role, turn, CAST(strlen(text) + 256 AS BIGINT) AS cost, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations),
o AS (SELECT conv_id, CAST(turn AS VARCHAR) AS item, cost, row_number() OVER (PARTITION BY conv_id ORDER BY nth, role) AS i FROM t),
r AS (SELECT conv_id, i, CASE WHEN cost <= 2500 THEN [item] ELSE CAST([] AS VARCHAR[]) END AS ids, CASE WHEN cost <= 2500 THEN cost ELSE 0 END AS size, CASE WHEN cost <= 2500 THEN 0 ELSE 1 END AS deferred FROM o WHERE i = 1
  UNION ALL SELECT o.conv_id, o.i, CASE WHEN NOT list_contains(ids, item) AND size + cost <= 2500 THEN list_append(ids, item) ELSE ids END,
    CASE WHEN NOT list_contains(ids, item) AND size + cost <= 2500 THEN size + cost ELSE size END, CASE WHEN list_contains(ids, item) OR size + cost <= 2500 THEN deferred ELSE deferred + 1 END
  FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1)
SELECT conv_id, array_to_string(arg_max(ids, i), ',') AS turns, CAST(arg_max(size, i) AS BIGINT) AS size, CAST(arg_max(deferred, i) AS INTEGER) AS deferred FROM r GROUP BY 1""",
    "scope_records": """
WITH RECURSIVE t AS (SELECT conv_id, role, turn, CAST(strlen(text) + 256 AS BIGINT) AS cost, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations),
o AS (SELECT conv_id, role, turn, cost, row_number() OVER (PARTITION BY conv_id ORDER BY nth, role) AS i FROM t),
r AS (SELECT conv_id, i, role, turn, cost <= 2500 AS fits, CASE WHEN cost <= 2500 THEN cost ELSE 0 END AS size FROM o WHERE i = 1
  UNION ALL SELECT o.conv_id, o.i, o.role, o.turn, size + cost <= 2500, CASE WHEN size + cost <= 2500 THEN size + cost ELSE size END FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1)
SELECT conv_id, role, turn AS item, CASE WHEN fits THEN CAST(count(*) FILTER (fits) OVER (PARTITION BY conv_id ORDER BY i) AS INTEGER) END AS place FROM r""",
    "pack_by_path": """
WITH RECURSIVE t AS (SELECT conv_id, role, turn, CAST(strlen(text) + 256 AS BIGINT) AS cost, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth, min(turn) OVER (PARTITION BY conv_id, role) AS seen FROM conversations),
o AS (SELECT conv_id, CAST(turn AS VARCHAR) AS item, cost, row_number() OVER (PARTITION BY conv_id ORDER BY nth, seen) AS i FROM t),
r AS (SELECT conv_id, i, CASE WHEN cost <= 2500 THEN [item] ELSE CAST([] AS VARCHAR[]) END AS ids, CASE WHEN cost <= 2500 THEN cost ELSE 0 END AS size, CASE WHEN cost <= 2500 THEN 0 ELSE 1 END AS deferred FROM o WHERE i = 1
  UNION ALL SELECT o.conv_id, o.i, CASE WHEN size + cost <= 2500 THEN list_append(ids, item) ELSE ids END, CASE WHEN size + cost <= 2500 THEN size + cost ELSE size END, CASE WHEN size + cost <= 2500 THEN deferred ELSE deferred + 1 END
  FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1)
SELECT conv_id, array_to_string(arg_max(ids, i), ',') AS turns, CAST(arg_max(size, i) AS BIGINT) AS size, CAST(arg_max(deferred, i) AS INTEGER) AS deferred FROM r GROUP BY 1""",
    "ration_records": """
WITH RECURSIVE t AS (SELECT conv_id, role, CAST(strlen(text) + 256 AS BIGINT) AS cost, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations),
o AS (SELECT conv_id, role, cost, row_number() OVER (PARTITION BY conv_id ORDER BY nth, role) AS i FROM t),
r AS (SELECT conv_id, i, role, cost <= 2500 AS fits, CASE WHEN cost <= 2500 THEN cost ELSE 0 END AS size, CASE WHEN cost <= 2500 THEN CAST([] AS VARCHAR[]) ELSE [role] END AS stuck FROM o WHERE i = 1
  UNION ALL SELECT o.conv_id, o.i, o.role, NOT list_contains(stuck, o.role) AND size + cost <= 2500, CASE WHEN NOT list_contains(stuck, o.role) AND size + cost <= 2500 THEN size + cost ELSE size END,
    CASE WHEN NOT list_contains(stuck, o.role) AND size + cost > 2500 THEN list_append(stuck, o.role) ELSE stuck END
  FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1)
SELECT conv_id, role, count(*) FILTER (fits) AS shown, count(*) FILTER (NOT fits) AS omitted FROM r GROUP BY 1, 2""",
    "segments": _CUTS.format(most=2000) + """
SELECT r.doc_id, CAST(piece AS INTEGER) AS segment, CAST(1 + len(list_filter(coalesce(line_stops, []), lambda x: x <= start)) AS INTEGER) AS start_line,
  CAST(1 + len(list_filter(coalesce(line_stops, []), lambda x: x < stop)) AS INTEGER) AS end_line, stop - start AS bytes FROM r JOIN l ON l.doc_id = r.doc_id""",
    "chunk_text": _CUTS.format(most=12000) + """
SELECT r.doc_id, CAST(piece AS INTEGER) AS chunk, CAST(1 + len(list_filter(coalesce(line_stops, []), lambda x: x <= start)) AS INTEGER) AS start_line,
  CAST(1 + len(list_filter(coalesce(line_stops, []), lambda x: x < stop)) AS INTEGER) AS end_line, stop - start AS bytes,
  sha256(substr(text, CAST(coalesce(list_position(stops, start), 0) + 1 AS BIGINT), CAST(list_position(stops, stop) - coalesce(list_position(stops, start), 0) AS BIGINT))) AS hash
FROM r JOIN l ON l.doc_id = r.doc_id JOIN documents d ON d.doc_id = r.doc_id""",
    "ingest_code": """
SELECT 'src/gen_' || i || '.rs' AS file, (bytes + 11999) // 12000 AS chunks, bytes, CAST(10000 AS BIGINT) AS calls, CAST(10000 AS BIGINT) AS resolved FROM
(SELECT n // 10000 AS i, CAST(sum(length('fn step_' || n || '() { step_' || ((n + 10000) % 100000) || '(); }')) + 9999 AS BIGINT) AS bytes FROM range(100000) r(n) GROUP BY 1)""",
}

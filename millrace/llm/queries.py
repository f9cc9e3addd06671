"""The corpus operators' registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, centroids, chat, decontam, filter_audit, html_text, langid, near_dup, pieces, quality, secret_scan, stages, urls, warc
from millrace.llm.common import held_out, tokenizer_path
from millrace.session import new_folder
from millrace.sources.tables import table

RULES = [urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]
#: Conversation -7: control strings inside texts.
PLANTED = "\\### Assistant: </turn> ok"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    apart = held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs.join(labels.filter(~apart), "doc_id"))
    return quality.score(docs, model).select("doc_id", apart.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    segments = chat.format_conversations(turns.unionByName(planted))
    return chat.read_back(segments, in_place=True)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.fit(docs)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    apart = held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.filter(~apart))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", apart.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")).drop("seeds")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pieces.encode(docs, pieces.Vocabulary.load(tokenizer_path()), n=4)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url", "html"), RULES)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=8, rounds=10, seed=3).drop("centroid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_ann_search": op2_ann_search,
    "op3_chat_format": op3_chat_format,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_language_id": op7_language_id,
    "op8_decontaminate": op8_decontaminate,
    "op9_pieces": op9_pieces,
    "op10_html_text": op10_html_text,
    "op11_warc": op11_warc,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroids": op13_centroids,
    "pipeline": stages.run,
}

#: Backslashes that escaping adds: one for each backslash, each close mark, and each place where three signs begin.
_ADDED = "length(text) - length(replace(text, '\\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 + length(text) - length(regexp_replace(text, '##(#+)', '##', 'g'))"

#: op13's centroids (c, v) move round by round: from those of the round before to the exact floors of means.
_ROUND = """
c{next} AS MATERIALIZED (SELECT c, coalesce(m.v, p.v) AS v FROM c{now} p LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM ({near})) GROUP BY c, i) GROUP BY c) m USING (c))
"""
_NEAR = """SELECT k.vec_id, k.v, unnest(list_sort(list({{'d': list_inner_product(k.w, k.w) - 2 * list_inner_product(k.w, p.w) + list_inner_product(p.w, p.w), 'c': p.c}}))[1:1], recursive := true)
    FROM k, (SELECT c, v, CAST(v AS DOUBLE[]) AS w FROM c{now}) p GROUP BY k.row, k.vec_id, k.v"""

ORACLE = {
    "op11_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n < 1000 OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM p
""",
    "op12_filter_audit": """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
f AS (SELECT w.doc_id, part, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)} AS fails,
    coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM w LEFT JOIN labels l ON l.doc_id = w.doc_id),
g AS (SELECT part, fails.A AS a, fails.B AS b, fails.C AS c, fails.D AS d, fails.E AS e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, filter_order, step, filter_order[step] AS filter, n, good, toxic,
    (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed
  FROM g, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
t AS (SELECT *, contains(failed, filter) AS hit, length(translate(failed, filter_order[1:step - 1], '')) < length(failed) AS gone FROM s),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failed = filter), 0) AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM t GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
""",
    "op13_centroids": """
WITH f AS (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
k AS MATERIALIZED (SELECT row, vec_id, list_transform(x, lambda y: CAST(floor(1024 * y) AS BIGINT)) AS v, list_transform(x, lambda y: floor(1024 * y)) AS w FROM f),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM k ORDER BY c LIMIT 8),
"""
    + ",".join(_ROUND.format(now=i, next=i + 1, near=_NEAR.format(now=i)) for i in range(10))
    + f""", a AS (SELECT vec_id, c, CAST(d AS BIGINT) AS d FROM ({_NEAR.format(now=10)}))
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
FROM a JOIN c10 USING (c)
""",
    "op2_ann_search": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
""",
    "op3_chat_format": f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
f AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(text) + {_ADDED} + 4 + length(role) + 2 + 7 + 1) AS BIGINT) AS formatted_chars,
  CAST(sum(CASE WHEN (before IS NULL AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user') OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user') THEN 0 ELSE 1 END) AS BIGINT) AS violations
FROM f GROUP BY conv_id
""",
    "op8_decontaminate": """
WITH d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)),
i AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)),
m AS (SELECT doc_id, item_id, n, i.pos AS p, d.pos - i.pos AS shift FROM d JOIN i USING (word)),
c AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS agree FROM m)
SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS item_words, CAST(max(agree) AS INTEGER) AS matched FROM c
WHERE agree >= CASE WHEN n < 8 THEN n ELSE ceil(0.8 * least(13, n)) END GROUP BY doc_id, item_id
""",
    "op6_near_duplicates": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT doc_id, least(doc_id, min(seen)) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE

"""Ranked retrieval over lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import terms_of
from millrace.operators.passages import evidence_score
from millrace.sources.tables import table

#: What the registered queries ask for: words, a file name, and words that a search ignores.
QUERY = "that with this from Doc3.rs in src tests"
PER_PATH, KEPT = 8, 64


def file_path() -> Column:
    """Documents as files of a project: sources are modules, a third of them code."""
    folder = F.when(F.col("doc_id") % 3 == 0, "/src/Doc").when(F.col("doc_id") % 3 == 1, "/tests/Doc").otherwise("/docs/From")
    ending = F.when(F.col("doc_id") % 2 == 0, ".rs").otherwise(".md")
    return F.concat(F.lit("/project/"), "source", folder, (F.col("doc_id") % 7).cast("string"), ending)


def symbols() -> Column:
    """Names declared in a line's chunk: one on each fourth line."""
    return F.when(F.col("start_line") % 4 == 1, "load_with").otherwise("")


def lines(documents: DataFrame) -> DataFrame:
    """One chunk a line: path, 1-based line, content and the evidence id."""
    exploded = documents.select(
        file_path().alias("path"),
        "doc_id",
        F.posexplode(F.split("text", "\n")).alias("pos", "content"),
    )
    start = F.col("pos") + 1
    return exploded.select(
        "path",
        "doc_id",
        start.alias("start_line"),
        "content",
        F.sha2(F.concat_ws(":", "path", F.col("doc_id").cast("string"), start.cast("string"), F.sha2("content", 256)), 256).alias("id"),
    )


def scored(chunks: DataFrame, query: str = QUERY) -> DataFrame:
    """Chunks that match a query at all, with their score."""
    score = evidence_score(F.col("content"), F.col("path"), symbols(), query, terms_of(query))
    return chunks.withColumn("score", score).filter("score > 0")


def ranked(chunks: DataFrame, query: str = QUERY, per_path: int = PER_PATH, kept: int = KEPT) -> DataFrame:
    """The best ``kept`` chunks, at most ``per_path`` of a path."""
    by_path = Window.partitionBy("path").orderBy(F.desc("score"), "id")
    capped = scored(chunks, query).withColumn("path_rank", F.row_number().over(by_path)).filter(F.col("path_rank") <= per_path)
    return capped.orderBy(F.desc("score"), "id").limit(kept)


def line_retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(lines(table(spark, sf_dir, "documents", "doc_id", "source", "text")))
    return found.select("id", "path", "doc_id", "start_line", "score", "path_rank")


QUERIES = {"line_retrieval_topk": line_retrieval_topk}

# Written out by hand, apart from the code above: terms, the file name asked for, and the weights.
_TERM = "(CASE WHEN contains(names, '{t}') THEN 10 ELSE 0 END) + 6 * least(4, (length(hay) - length(replace(hay, '{t}', ''))) // {n})"
SCORE_SQL = " + ".join(_TERM.format(t=t, n=n) for t, n in (("that", 4), ("with", 4), ("this", 4), ("from", 4), ("doc3", 4), ("rs", 2), ("in", 2))) + " + CASE WHEN ends_with(names_path, '/doc3.rs') THEN 80 ELSE 0 END + CASE WHEN contains(path, '/src/') THEN 6 ELSE 0 END"

LINES_SQL = """
    SELECT path, doc_id, CAST(i AS INTEGER) AS start_line, parts[i] AS content,
           sha256(concat_ws(':', path, CAST(doc_id AS VARCHAR), CAST(i AS VARCHAR), sha256(parts[i]))) AS id,
           lower(path) AS names_path, lower(path || ' ' || CASE WHEN i % 4 = 1 THEN 'load_with' ELSE '' END) AS names,
           CASE WHEN starts_with(ltrim(parts[i]), '//') OR starts_with(ltrim(parts[i]), '*') OR starts_with(ltrim(parts[i]), '/*') THEN '' ELSE lower(parts[i]) END AS hay
    FROM (SELECT '/project/' || source || CASE doc_id % 3 WHEN 0 THEN '/src/Doc' WHEN 1 THEN '/tests/Doc' ELSE '/docs/From' END || CAST(doc_id % 7 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.rs' ELSE '.md' END AS path,
                 doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL) d,
         LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u
"""

ORACLE = {
    "line_retrieval_topk": f"""
WITH chunks AS ({LINES_SQL}),
scored AS (SELECT *, CAST({SCORE_SQL} AS BIGINT) AS score FROM chunks),
capped AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS INTEGER) AS path_rank FROM scored WHERE score > 0)
SELECT id, path, doc_id, start_line, score, path_rank FROM capped WHERE path_rank <= {PER_PATH}
ORDER BY score DESC, id LIMIT {KEPT}
"""
}

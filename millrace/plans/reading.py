"""Reading order of linked records, and views that shrink to a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import ordering, views
from millrace.sources.tables import table


def _linked_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders of a customer as nodes; weights between orders that follow each other at a supplier (5) or in a priority (3)."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").filter("o_custkey is not null")
    # Lines of an order at one supplier follow each other, which makes links to itself; these do not count.
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")
    at = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("scope"), F.col("l_suppkey").alias("by"), "o_orderkey")
    following = lambda rows: rows.withColumn("next", F.lead("o_orderkey").over(Window.partitionBy("scope", "by").orderBy("o_orderkey"))).filter("next is not null")
    calls = following(at).select("scope", F.col("o_orderkey").alias("a"), F.col("next").alias("b"), F.lit(5).alias("weight"))
    tagged = orders.filter("o_orderpriority in ('1-URGENT', '2-HIGH')").select(F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("by"), "o_orderkey")
    kin = following(tagged).select("scope", F.col("o_orderkey").alias("a"), F.col("next").alias("b"), F.lit(3).alias("weight"))
    return orders.select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("node")), calls.unionAll(kin)


def graph_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each order stands when a customer's orders are read depth first along their links."""
    found = ordering.graph_order(*_linked_orders(spark, sf_dir))
    return found.select(F.col("scope").alias("o_custkey"), F.col("node").alias("o_orderkey"), "component", "place")


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as branches: lines as findings, words as files, every third with a part."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    clean = F.regexp_replace("text", r"[^A-Za-z .\n]", "")
    lines = F.filter(F.split(clean, "\n"), lambda x: x != "")
    rows = turns.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("i"), lines.alias("lines"))
    files = F.array_distinct(F.slice(F.split(F.coalesce(F.get("lines", F.lit(0)), F.lit("")), " "), 1, 6))
    findings = F.transform("lines", lambda x: F.struct(F.split(x, " ")[0].alias("topic"), x.alias("observation")))
    part = F.struct(F.concat(F.lit("B"), F.col("i").cast("string"), F.lit(".1")).alias("label"), F.size("lines").alias("files"), F.slice("lines", 1, 3).alias("topics"))
    return rows.select(
        "conv_id", (F.col("i") - 1).alias("place"), F.concat(F.lit("B"), F.col("i").cast("string")).alias("label"), F.lit("src").alias("where"), files.alias("files"), F.size(files).alias("file_count"), findings.alias("findings"),
        F.when(F.col("i") % 2 == 0, F.array(F.lit("src/a"), F.lit("src/b"))).otherwise(F.array()).cast("array<string>").alias("dirs"), F.when(F.col("i") % 3 == 0, F.array(part)).otherwise(F.array()).cast("array<struct<label:string,files:int,topics:array<string>>>").alias("parts"), (F.col("i") % 4 != 0).alias("whole"),
    )


def _digest(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "place", "rung", F.octet_length("record").cast("bigint").alias("bytes"), F.sha2("record", 256).alias("hash"))


def branch_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branches of every conversation within 1,500 bytes."""
    return _digest(views.branch_view(_branches(spark, sf_dir), "conv_id", 1500))


def group_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns as groups of branches, a conversation's groups within 700 bytes."""
    rows = _branches(spark, sf_dir).select("conv_id", F.floor(F.col("place") / 2).alias("place"), F.col("place").alias("at"), F.struct("label", "where", "file_count", F.transform("findings", lambda f: f["observation"]).alias("topics")).alias("branch"))
    pairs = rows.groupBy("conv_id", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "branch"))), lambda x: x["branch"]).alias("branches"))
    groups = pairs.select("conv_id", "place", F.concat(F.lit("G"), (F.col("place") + 1).cast("string")).alias("label"), F.lit("src").alias("where"), F.aggregate("branches", F.lit(0), lambda n, b: n + b["file_count"]).alias("file_count"), F.flatten(F.transform("branches", lambda b: F.slice(b["topics"], 1, 3))).alias("topics"), "branches")
    return _digest(views.group_view(groups, "conv_id", 700))


def document_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as sections: what the writer of each sees of the whole within 3,000 bytes."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    # What stays, run by run: to replace each character that goes takes several times as long.
    stays = F.array_join(F.regexp_extract_all("text", F.lit(r"[A-Za-z .\n]+"), F.lit(0)), "")
    lines = docs.select("doc_id", F.posexplode(F.split(stays, "\n")).alias("position", "line"))
    i, line = F.col("position"), F.col("line")
    needs = F.filter(F.array(F.when((i % 3 == 0) & (i >= 2), i - 2), F.when((i % 7 == 0) & (i >= 5), i - 5)), lambda x: x.isNotNull())
    diagrams = F.when(i % 5 == 0, F.array(F.left(line, F.lit(200)))).otherwise(F.array()).cast("array<string>")
    points = F.filter(F.split(line, r"\. "), lambda x: x != "")
    sections = lines.select("doc_id", "position", F.left(line, F.lit(20)).alias("title"), points.alias("key_points"), F.lit("what").alias("reader_question"), needs.alias("depends_on"), diagrams.alias("diagrams"), F.when(i % 4 == 0, F.array(F.lit("rest"))).otherwise(F.array()).cast("array<string>").alias("out_of_scope"))
    found = views.document_view(sections, "doc_id", 3000)
    return found.select("doc_id", "focus", "rung", "bytes", F.sha2("view", 256).alias("hash"))


QUERIES = {f.__name__: f for f in (graph_order, branch_view, group_view, document_view)}

#: An excerpt of text ``{t}`` within ``{n}`` bytes, for texts of one byte a character.
_CUT = "CASE WHEN length({t}) <= {n} THEN {t} ELSE left({t}, ({n} - 19) // 2) || chr(10) || '[… excerpt …]' || chr(10) || right({t}, ({n} - 19) - ({n} - 19) // 2) END"
_TURNS = """
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, list_filter(string_split(regexp_replace(text, '[^A-Za-z .\n]', '', 'g'), chr(10)), lambda x: x <> '') AS lines FROM conversations),
f AS (SELECT *, list_filter(list_slice(string_split(coalesce(lines[1], ''), ' '), 1, 6), lambda x, k: list_position(string_split(coalesce(lines[1], ''), ' '), x) = k) AS files FROM t)"""
_ALLOWED = [1500]
for _ in range(23):
    _ALLOWED.append(_ALLOWED[-1] * 4 // 5)

_LINKED = """
o AS (SELECT o_orderkey AS n, o_custkey AS s, o_orderpriority AS p FROM orders),
h AS (SELECT DISTINCT s, CAST(l_suppkey AS VARCHAR) AS k, n, 5 AS w FROM lineitem JOIN o ON l_orderkey = n UNION ALL SELECT s, p, n, 3 FROM o WHERE p IN ('1-URGENT', '2-HIGH')),
e AS (SELECT s, n AS a, lead(n) OVER (PARTITION BY s, k, w ORDER BY n) AS b, w FROM h),
u AS (SELECT s, a, b, w FROM e WHERE b IS NOT NULL UNION ALL SELECT s, b, a, w FROM e WHERE b IS NOT NULL),
g AS (SELECT s, a, b, sum(w) AS w FROM u GROUP BY 1, 2, 3)"""
_PART = "to_json([{'branch': 'B' || i || '.1', 'file_count': len(lines), 'topics': list_transform(list_slice(lines, 1, 2), lambda x: " + _CUT.format(t="x", n="60") + ")}])"


def _branch_json(topics: str, room: str, files: str, parts: str) -> str:
    """A branch's record with so many topics, bytes, files, and parts."""
    shown = f"list_transform(list_slice(lines, 1, {topics}), lambda x: {{'topic': string_split(x, ' ')[1], 'observation': {_CUT.format(t='x', n=room)}}})"
    head = f"to_json({{'branch': 'B' || i, 'where': 'src', 'files': list_slice(files, 1, {files}), 'file_count': len(files), 'topic_count': len(lines), 'topics': {shown}}})"
    more = f"CASE WHEN {files} > 0 AND i % 2 = 0 THEN ',\"main_dirs\":[\"src/a\",\"src/b\"]' ELSE '' END || CASE WHEN ({parts}) AND i % 3 = 0 THEN ',\"parts\":' || {_PART} ELSE '' END || CASE WHEN i % 4 = 0 THEN ',\"file_count_is_a_floor\":true' ELSE '' END"
    return f"left({head}, length({head}) - 1) || {more} || '}}'"


def _note(left: str) -> str:
    return f"'{{\"branches_not_shown\":' || ({left}) || '}}'"


def _section_json(other: str, near: str) -> str:
    """A section's record as focus, near one or another."""
    points = f"list_transform(points, lambda x: {_CUT.format(t='x', n=near)})"
    diagrams = f"list_transform(diagrams, lambda x: {_CUT.format(t='x', n='160')})"
    head = "left(to_json({'index': i, 'title': title}), length(to_json({'index': i, 'title': title})) - 1)"
    summary = "CASE WHEN len(points) > 0 THEN array_to_string(points, '; ') ELSE 'what' END"
    return f"""{head} || CASE WHEN i = focus THEN ',"key_points":' || to_json(points) || ',"diagrams":' || to_json(diagrams) || CASE WHEN len(needs) > 0 THEN ',"depends_on":' || to_json(needs) ELSE '' END || CASE WHEN i % 4 = 0 THEN ',"out_of_scope":["rest"]' ELSE '' END
  WHEN is_near THEN ',"key_points":' || to_json({points}) || CASE WHEN len(diagrams) > 0 THEN ',"diagrams":' || to_json({diagrams}) ELSE '' END
  ELSE CASE WHEN {other} > 0 AND trim({summary}) <> '' THEN ',"summary":' || to_json({_CUT.format(t='(' + summary + ')', n=other)}) ELSE '' END || CASE WHEN len(diagrams) > 0 THEN ',"diagrams":' || len(diagrams) ELSE '' END END || '}}'"""


ORACLE = {
    "document_view": f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(s) AS line, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS i, len(s) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z .\n]', '', 'g'), chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
s AS MATERIALIZED (SELECT doc_id, i, n, left(line, 20) AS title, list_filter(string_split(line, '. '), lambda x: x <> '') AS points, CASE WHEN i % 5 = 0 THEN [left(line, 200)] ELSE CAST([] AS VARCHAR[]) END AS diagrams,
  list_filter([CASE WHEN i % 3 = 0 AND i >= 2 THEN i - 2 END, CASE WHEN i % 7 = 0 AND i >= 5 THEN i - 5 END], lambda x: x IS NOT NULL) AS needs FROM l),
d AS (SELECT doc_id, i AS focus, unnest(needs) AS i FROM s UNION SELECT d.doc_id, d.focus, unnest(s.needs) FROM d JOIN s ON s.doc_id = d.doc_id AND s.i = d.i),
p AS (SELECT s.*, o.i AS focus, abs(s.i - o.i) AS away, d.i IS NOT NULL OR abs(s.i - o.i) = 1 AS is_near FROM s JOIN s o USING (doc_id) LEFT JOIN d ON d.doc_id = s.doc_id AND d.focus = o.i AND d.i = s.i),
r AS (SELECT * FROM (VALUES (0, 600, 320, NULL), (1, 300, 160, NULL), (2, 160, 80, NULL), (3, 120, 0, NULL), (4, 120, 0, 24), (5, 80, 0, 8)) AS v(rung, near, other, reach)),
k AS (SELECT *, {_section_json('other', 'near')} AS record, lag(i) OVER w AS low, lead(i) OVER w AS high FROM p, r WHERE reach IS NULL OR away <= reach OR is_near WINDOW w AS (PARTITION BY doc_id, focus, rung ORDER BY i)),
v AS (SELECT doc_id, focus, rung, '{{"sections":[' || string_agg(CASE WHEN i - coalesce(low, -1) > 1 THEN '{{"omitted_sections":' || (i - coalesce(low, -1) - 1) || ',"from":' || (coalesce(low, -1) + 1) || ',"to":' || (i - 1) || '}},' ELSE '' END || record
  || CASE WHEN high IS NULL AND i < n - 1 THEN ',{{"omitted_sections":' || (n - 1 - i) || ',"from":' || (i + 1) || ',"to":' || (n - 1) || '}}' ELSE '' END, ',' ORDER BY i) || ']}}' AS view FROM k GROUP BY 1, 2, 3)
SELECT doc_id, focus, CAST(rung AS INTEGER) AS rung, CAST(strlen(view) AS BIGINT) AS bytes, sha256(view) AS hash FROM v WHERE strlen(view) <= 3000 OR rung = 5 QUALIFY row_number() OVER (PARTITION BY doc_id, focus ORDER BY rung) = 1""",
    "branch_view": f"""
WITH {_TURNS},
n AS (SELECT conv_id, count(*) AS n, sum(CASE WHEN i % 3 = 0 THEN strlen({_PART}) ELSE 4 END) <= 750 AS keep FROM f GROUP BY 1),
a AS (SELECT unnest({_ALLOWED}) AS allowed, generate_subscripts({_ALLOWED}, 1) - 1 AS rung),
p AS (SELECT *, allowed // n AS per, least(greatest((allowed // n) // 120, 1), 12) AS topics FROM f JOIN n USING (conv_id), a),
r AS (SELECT conv_id, i, n, rung, {_branch_json('topics', 'greatest(per // topics, 120)', 'least(per // 600, 12)', 'keep OR per >= 400')} AS record FROM p),
b AS (SELECT conv_id, min(rung) AS rung FROM (SELECT conv_id, rung FROM r GROUP BY 1, 2 HAVING sum(strlen(record)) + count(*) + 1 <= 1500) GROUP BY 1),
z AS (SELECT conv_id, i, n, {_branch_json('1', '120', '0', 'false')} AS record FROM f JOIN n USING (conv_id) WHERE conv_id NOT IN (SELECT conv_id FROM b)),
c AS (SELECT DISTINCT conv_id, n, unnest([n * 4 // 5, n * 4 // 5 * 4 // 5, n * 4 // 5 * 4 // 5 * 4 // 5, n * 4 // 5 * 4 // 5 * 4 // 5 * 4 // 5, n * 4 // 5 * 4 // 5 * 4 // 5 * 4 // 5 * 4 // 5, n * 4 // 5 * 4 // 5 * 4 // 5 * 4 // 5 * 4 // 5 * 4 // 5]) AS cut FROM z WHERE n > 1),
x AS (SELECT conv_id, max(cut) AS cut FROM (SELECT c.conv_id, c.n, cut FROM c JOIN z ON z.conv_id = c.conv_id AND z.i <= cut GROUP BY 1, 2, 3 HAVING sum(strlen(record)) + cut + 2 + strlen({_note('c.n - cut')}) <= 1500) GROUP BY 1),
o AS (SELECT conv_id, i - 1 AS place, rung, record FROM r JOIN b USING (conv_id, rung) UNION ALL SELECT conv_id, i - 1, 24, record FROM z JOIN x USING (conv_id) WHERE i <= cut
  UNION ALL SELECT conv_id, coalesce(cut, 0), 24, {_note('n - coalesce(cut, 0)')} FROM (SELECT DISTINCT conv_id, n FROM z) LEFT JOIN x USING (conv_id))
SELECT conv_id, CAST(place AS BIGINT) AS place, CAST(rung AS INTEGER) AS rung, CAST(strlen(record) AS BIGINT) AS bytes, sha256(record) AS hash FROM o""",
    "group_view": f"""
WITH {_TURNS},
g AS (SELECT conv_id, (i - 1) // 2 AS place, list({{'label': 'B' || i, 'file_count': len(files), 'topics': lines}} ORDER BY i) AS b FROM f GROUP BY 1, 2),
r AS (SELECT * FROM (VALUES (0, 6, 4, 160), (1, 4, 3, 120), (2, 3, 2, 80), (3, 2, 1, 60), (4, 6, NULL, 120), (5, 3, NULL, 80), (6, 0, NULL, 0)) AS v(rung, topics, titles, title)),
j AS (SELECT conv_id, place, rung, to_json({{'group': 'G' || (place + 1), 'where': 'src', 'file_count': list_sum(list_transform(b, lambda x: x.file_count)), 'topics': list_transform(list_slice(flatten(list_transform(b, lambda x: list_slice(x.topics, 1, 3))), 1, topics), lambda x: {_CUT.format(t='x', n='greatest(title, 80)')})}}) AS head,
  CASE WHEN titles IS NULL THEN to_json(list_transform(b, lambda x: x.label)) ELSE to_json(list_transform(b, lambda y: {{'branch': y.label, 'where': 'src', 'file_count': y.file_count, 'topics': list_transform(list_slice(y.topics, 1, titles), lambda x: {_CUT.format(t='x', n='title')})}})) END AS tail FROM g, r),
k AS (SELECT conv_id, place, rung, left(head, length(head) - 1) || ',"branches":' || tail || '}}' AS record FROM j),
b AS (SELECT conv_id, coalesce(min(rung) FILTER (total <= 700), 6) AS rung FROM (SELECT conv_id, rung, sum(strlen(record)) + count(*) + 1 AS total FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT conv_id, place, CAST(rung AS INTEGER) AS rung, CAST(strlen(record) AS BIGINT) AS bytes, sha256(record) AS hash FROM k JOIN b USING (conv_id, rung)""",
    "graph_order": f"""
WITH RECURSIVE {_LINKED},
near AS (SELECT o.s, o.n, coalesce(list(g.b ORDER BY g.w DESC, g.b) FILTER (g.b IS NOT NULL), []) AS l FROM o LEFT JOIN g ON g.s = o.s AND g.a = o.n GROUP BY 1, 2),
every AS (SELECT s, list(n ORDER BY n) AS l FROM o GROUP BY s),
walk AS (
  SELECT s, CAST(NULL AS BIGINT) AS n, CAST(-1 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS component, CAST([] AS BIGINT[]) AS stack, CAST([] AS BIGINT[]) AS seen FROM every
  UNION ALL
  SELECT s, node, place + 1, CASE WHEN fresh THEN node ELSE component END, list_concat(list_slice(stack, 1, len(stack) - 1), list_reverse(list_filter(l, lambda x: NOT list_contains(seen, x)))),
    list_concat(seen, list_filter(l, lambda x: NOT list_contains(seen, x)))
  FROM (SELECT w.s, w.place, w.component, w.stack, len(w.stack) = 0 AS fresh,
      CASE WHEN len(w.stack) = 0 THEN list_filter(v.l, lambda x: NOT list_contains(w.seen, x))[1] ELSE w.stack[-1] END AS node,
      CASE WHEN len(w.stack) = 0 THEN list_append(w.seen, list_filter(v.l, lambda x: NOT list_contains(w.seen, x))[1]) ELSE w.seen END AS seen
    FROM walk w JOIN every v USING (s) WHERE w.place + 1 < len(v.l)) k JOIN near USING (s) WHERE near.n = k.node)
SELECT s AS o_custkey, n AS o_orderkey, component, place FROM walk WHERE n IS NOT NULL""",
}

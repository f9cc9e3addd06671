"""Queries that edit texts: excerpts, citations, headings, parts, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import markdown, text
from millrace.functions.jsonfix import array_prefix
from millrace.operators import passages, quality, rules
from millrace.operators.ordering import spread
from millrace.plans.retrieval import QUERY, file_path
from millrace.sources.tables import table


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head and tail of every document within 300 and 31 bytes, and its last 100 bytes."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", text.excerpt(F.col("text"), 300).alias("short"), text.excerpt(F.col("text"), 31).alias("shorter"), text.tail(F.col("text"), 100).alias("last"))


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts go on with their own last 40 characters (even turns) or with other text."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").filter(F.length("text") >= 60)
    more = F.when(F.col("turn") % 2 == 0, F.concat(F.right("text", F.lit(40)), F.lit(" and more"))).otherwise("fresh text that goes on from here")
    return turns.select("conv_id", "turn", F.sha2(text.without_overlap(F.col("text"), more), 256).alias("hash"))


def guarded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors without urls, texts in bounds, and answers out of their fence."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    error = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("at https://x: "), "text")).otherwise(F.col("text"))
    wrapped = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```markdown\n"), "text", F.lit("\n```\n"))).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", text.safe_error(error).alias("error"), text.is_bounded(F.col("text"), 200).alias("bounded"), F.sha2(markdown.unwrap_fence(wrapped), 256).alias("unwrapped"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as their lines of letters, dots and single spaces, empty ones left out."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z .\n]", ""), " +", " ")
    return turns.select("conv_id", "turn", F.filter(F.transform(F.split(clean, "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))


def citation_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of a turn's lines, behind them, in spans and in fences, replaced and completed outside code."""
    found = _lines(spark, sf_dir)
    name = lambda x, n: F.concat(F.lit("[E:"), F.left(F.sha2(x, 256), F.lit(n)))

    def cited(x: Column, i: Column) -> Column:
        return F.concat(x, F.when(i % 4 == 0, F.concat(F.lit(" "), name(x, 10), F.lit("]"))).when(i % 4 == 1, F.concat(F.lit(" `"), name(x, 10), F.lit("]`"))).when(i % 4 == 2, F.concat(F.lit("\n```\n"), name(x, 10), F.lit("]\n```"))).otherwise(F.concat(F.lit(" "), name(x, 8), F.lit(", E:zzzzzzzz]"))))

    rows = found.select("conv_id", "turn", "lines", markdown.pieces(F.array_join(F.transform("lines", cited), "\n")).alias("p"))
    ids, first = F.transform("lines", lambda x: F.sha2(x, 256)), F.left(F.sha2(F.coalesce(F.get("lines", F.lit(0)), F.lit("")), 256), F.lit(10))
    return rows.select("conv_id", "turn", F.sha2(markdown.replace_citation(F.col("p"), first, "(1)"), 256).alias("replaced"), F.sha2(markdown.normalize_citations(F.col("p"), ids), 256).alias("completed"), F.size(F.filter("p", lambda x: x["code"])).cast("bigint").alias("codes"))


def rendered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sections whose lines cite what their first words name, some in code alone: footnotes and references."""
    found = _lines(spark, sf_dir)
    id_of = lambda x: F.sha2(F.lower(F.split(x, " ")[0]), 256)
    cite = lambda x, i: F.concat(x, F.when(i % 4 == 0, F.concat(F.lit(" [E:"), id_of(x), F.lit("]"))).when(i % 4 == 1, F.concat(F.lit(" `[E:"), id_of(x), F.lit("]`"))).when(i % 4 == 2, F.concat(F.lit(" [E:"), F.left(id_of(x), F.lit(9)), F.lit("]"))).otherwise(""))
    rows = found.select("conv_id", F.col("turn").alias("section"), F.concat(F.lit("T"), F.col("turn").cast("string")).alias("title"), F.array_join(F.transform("lines", cite), "\n").alias("markdown"))
    evidence = found.select("conv_id", F.col("turn").alias("section"), F.posexplode("lines").alias("pos", "x")).select("conv_id", "section", "pos", id_of(F.col("x")).alias("id"), F.concat(F.lit("src/`"), F.split("x", " ")[0]).alias("path"), F.col("pos").alias("start"), (F.col("pos") + 2).alias("end"))
    text = quality.rendered(rows, evidence, "conv_id")
    return text.select("conv_id", "kind", "place", F.sha2("text", 256).alias("hash"))


def section_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as headings of two levels, text and fences: parts at the shallowest headings, headings shifted, and the last mark gone."""
    found = _lines(spark, sf_dir)
    head = lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("#### "), x)).when(i % 5 == 2, F.concat(F.lit("##### "), x)).otherwise(x)
    shown = F.transform("lines", lambda x, i: F.concat(head(x, i), F.when(i % 4 == 3, "\n```\n#### no\n```").otherwise("")))
    body = F.concat(F.array_join(shown, "\n"), F.lit("\n<!-- MORE -->\n"))
    title = F.concat(F.lit("2. "), F.upper(F.coalesce(F.get("lines", F.lit(1)), F.lit("none"))))
    lines = found.select("conv_id", "turn", title.alias("title"), markdown.lines_of(markdown.pieces(markdown.without_more(body))).alias("x"))
    return lines.select("conv_id", "turn", F.size(markdown.subsections(F.col("x"))).cast("bigint").alias("n_parts"), F.sha2(F.array_join(markdown.subsections(F.col("x")), "|"), 256).alias("parts"), F.sha2(markdown.shifted_headings(F.col("x"), F.col("title")), 256).alias("shifted"))


def diagram_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second line is followed by a diagram, every fifth by other code; as many diagrams stay as the turn allows."""
    fenced = lambda kind, x: F.concat(F.lit(f"\n```{kind}\n"), x, F.lit("\n```"))
    shown = F.transform("lines", lambda x, i: F.concat(x, F.when(i % 2 == 1, fenced("mermaid", x)).when(i % 5 == 4, fenced("", x)).otherwise("")))
    found = _lines(spark, sf_dir).select("conv_id", "turn", markdown.pieces(F.array_join(shown, "\n")).alias("p"))
    return found.select("conv_id", "turn", markdown.diagrams(F.col("p")).alias("diagrams"), F.sha2(markdown.first_diagrams(F.col("p"), F.col("turn") % 3), 256).alias("kept"))


def spliced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's lines as parts, and five kinds of answers that rewrite some of them."""
    found = _lines(spark, sf_dir).filter(F.size("lines") > 0)
    n, k = F.size("lines"), (F.col("turn") + F.col("conv_id")) % 5
    mark = lambda i, t: F.concat(F.lit("<!-- PART "), i.cast("string"), F.lit(" -->\n"), t, F.lit("\n"))
    line = lambda i: F.get("lines", i.cast("int"))
    at = F.col("conv_id") % n
    twice = F.concat(mark(at, F.lit("x")), mark(at, F.lit("y")))
    answer = F.when(k == 0, mark(at, F.upper(line(at)))).when(k == 1, twice).when(k == 2, mark(n + F.col("turn"), F.lit("x"))).when(k == 3, F.left(line(n * 0), F.lit(3))).otherwise(F.concat(F.lit("lead\n"), mark(at, F.lit("z"))))
    rows = found.select("conv_id", "turn", markdown.spliced(F.col("lines"), answer).alias("r"))
    return rows.select("conv_id", "turn", F.sha2("r.value", 256).alias("value"), "r.fault")


def prose_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose blocks of documents and their sizes, and how many documents have each."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    each = docs.select("doc_id", F.explode(markdown.prose_blocks(markdown.pieces(F.col("text")))).alias("block"))
    return each.groupBy(F.sha2("block", 256).alias("hash")).agg(F.countDistinct("doc_id").alias("documents"), F.min(F.length("block")).cast("bigint").alias("chars"))


def section_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sections whose lines are headings and citing text, in short."""
    shown = F.transform("lines", lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## "), x)).when(i % 3 == 1, F.concat(x, F.lit(" [E:"), i.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("`[E:no]` "), x)))
    found = _lines(spark, sf_dir).select("conv_id", "turn", markdown.digest(F.array_join(shown, "\n"), 120, 3).alias("d"))
    return found.select("conv_id", "turn", F.array_join("d.headings", "|").alias("headings"), "d.short", "d.citations")


def cut_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete objects of an array of a turn's words, cut at a place that moves with the turn."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    word = F.left(F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit(30))
    whole = F.concat(F.lit('{"items": [1, {"t": "'), word, F.lit('"}, nope, {"q": {"b": "}]"}}, {bad}, "s", {"n": '), F.col("turn").cast("string"), F.lit("}, [2]]}"))
    at = (F.col("conv_id") * 7 + F.col("turn") * 13) % (F.length(whole) + 1)
    found = turns.select("conv_id", "turn", array_prefix(F.left(whole, at.cast("int")), "items").alias("x"))
    return found.select("conv_id", "turn", F.array_join("x", ";").alias("elements"))


def warning_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that cite words: as footnotes where the word has a number, as names where it has one, else as nothing."""
    words = F.transform("lines", lambda x: F.split(x, " ")[0])
    shown = F.transform("lines", lambda x, i: F.concat(x, F.lit(" [E:"), F.split(x, " ")[0], F.lit("]"), F.when(i % 3 == 2, F.concat(F.lit(" `[E:"), F.split(x, " ")[0], F.lit("]`"))).otherwise("")))
    distinct = F.array_distinct(words)
    numbers = F.map_from_arrays(F.slice(distinct, 1, 2), F.slice(F.array(F.lit(1), F.lit(2)), 1, F.least(F.size(distinct), F.lit(2))))
    named = F.slice(distinct, 3, 2)
    names = F.map_from_arrays(named, F.transform(named, lambda w: F.concat(w, F.lit(".rs"))))
    found = _lines(spark, sf_dir).select("conv_id", "turn", markdown.pieces(F.array_join(shown, "\n")).alias("p"), numbers.alias("numbers"), names.alias("names"))
    return found.select("conv_id", "turn", F.sha2(markdown.warned_citations(F.col("p"), F.col("numbers"), F.col("names")), 256).alias("text"))


def brief_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as findings of orders, checked against suppliers as evidence."""
    lines = spread(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), "l_orderkey").distinct()
    topic = F.when(F.col("l_linenumber") == 7, " ").otherwise("t")
    findings = lines.select(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").alias("finding"), topic.alias("topic"), F.lit("o").alias("observation"), (F.col("l_linenumber") % 2 == 0).alias("runtime"), F.array(F.col("l_orderkey") % 8, F.col("l_linenumber").cast("bigint")).alias("evidence_ids"))
    evidence = spark.range(7).select("id", (F.col("id") == 3).alias("runtime_allowed"))
    return rules.brief_faults(findings, evidence, "scope", most=5)


def request_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of planning evidence and of a section's passages, by order."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    k = F.col("o_custkey")
    return orders.select("o_orderkey", text.planning_limit(k * 100, k % 4).alias("planning"), text.evidence_share(k * 100, k % 3, k % 2 == 0, k % 5 == 0).alias("share"))


def focused_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 400 bytes of every document for its own first words."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    terms = F.slice(text.search_terms(F.left("text", F.lit(2000))), 5, 3)
    found = docs.select("doc_id", passages.focused_excerpt(F.col("text"), 400, terms).alias("x"))
    return found.select("doc_id", "x.skipped", "x.content")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").filter("text is not null")
    lines = F.size(F.split("text", "\n"))
    return docs.select("source", "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("id"), file_path().alias("path"), F.lit(1).alias("start"), lines.cast("int").alias("end"), F.col("text").alias("content"))


TERMS = ("that", "with", "from")


def fit_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source cut to equal shares of 60,000 bytes; none goes."""
    found = passages.fit_evidence(_passages(spark, sf_dir), "source", 60_000, F.array(*map(F.lit, TERMS)))
    return found.select("source", "doc_id", "id", "start", "end", F.octet_length("content").cast("bigint").alias("bytes"))


def retrieval_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked documents of each source packed into 20,000 bytes."""
    rows = _passages(spark, sf_dir)
    score = passages.evidence_score(F.col("content"), F.col("path"), F.lit(""), QUERY, TERMS)
    ranked = rows.withColumn("score", score).withColumn("tier", F.when(F.col("doc_id") % 5 == 0, 0).when(F.col("doc_id") % 5 == 1, 1).otherwise(2)).withColumn("rank", -F.col("score"))
    packed = passages.retrieval_pack(ranked, "source", ["tier", "rank", "id"], "tier", 20_000, F.array(*map(F.lit, TERMS)), F.lit(4))
    return packed.select("source", "doc_id", "id", "start", "end", F.octet_length("content").cast("bigint").alias("bytes"))


QUERIES = {f.__name__: f for f in (excerpts, overlap_join, guarded_texts, citation_edits, rendered_sections, section_parts, diagram_limits, spliced_parts, section_digests, cut_arrays, warning_notes, brief_checks, request_shares, prose_duplicates, focused_excerpts, fit_evidence, retrieval_pack)}

_HEAD = "list_max(list_filter(range(0, {n} + 1), lambda k: strlen(left(text, k)) <= {n}))"
_TAIL = "list_max(list_filter(range(0, {n} + 1), lambda k: strlen(right(text, k)) <= {n}))"
_LINES = """
WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z .\\n]', '', 'g'), ' +', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM conversations),
e AS (SELECT conv_id, turn, lines, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i FROM l)"""
ORACLE = {
    "excerpts": f"""
SELECT doc_id, CASE WHEN strlen(text) <= 300 THEN text ELSE left(text, {_HEAD.format(n=140)}) || chr(10) || '[… excerpt …]' || chr(10) || right(text, {_TAIL.format(n=141)}) END AS short,
  CASE WHEN strlen(text) <= 31 THEN text ELSE left(text, {_HEAD.format(n=6)}) || chr(10) || '[… excerpt …]' || chr(10) || right(text, {_TAIL.format(n=6)}) END AS shorter, right(text, {_TAIL.format(n=100)}) AS last FROM documents""",
    "overlap_join": """
SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN text || ' and more' ELSE text || chr(10) || chr(10) || 'fresh text that goes on from here' END) AS hash FROM conversations WHERE length(text) >= 60""",
    "guarded_texts": """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR contains(text, '://') THEN 'request failed; details withheld' ELSE left(text, 1000) END AS error, trim(text) <> '' AND strlen(text) <= 200 AS bounded, sha256(text) AS unwrapped FROM conversations""",
    "citation_edits": _LINES + """
, c AS (SELECT conv_id, turn, string_agg(x || CASE i % 4 WHEN 0 THEN CASE WHEN left(sha256(x), 10) = left(sha256(lines[1]), 10) THEN ' (1)' ELSE ' [E:' || left(sha256(x), 10) || ']' END WHEN 1 THEN ' `[E:' || left(sha256(x), 10) || ']`' WHEN 2 THEN chr(10) || '```' || chr(10) || '[E:' || left(sha256(x), 10) || ']' || chr(10) || '```' ELSE ' [E:' || left(sha256(x), 8) || ', E:zzzzzzzz]' END, chr(10) ORDER BY i) AS a,
  string_agg(x || CASE i % 4 WHEN 0 THEN ' [E:' || sha256(x) || ']' WHEN 1 THEN ' `[E:' || left(sha256(x), 10) || ']`' WHEN 2 THEN chr(10) || '```' || chr(10) || '[E:' || left(sha256(x), 10) || ']' || chr(10) || '```' ELSE ' [E:' || left(sha256(x), 8) || ', E:zzzzzzzz]' END, chr(10) ORDER BY i) AS b, count(*) FILTER (i % 4 IN (1, 2)) AS n FROM e GROUP BY 1, 2)
SELECT l.conv_id, l.turn, sha256(coalesce(a, '')) AS replaced, sha256(coalesce(b, '')) AS completed, coalesce(n, 0) AS codes FROM l LEFT JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn""",
    "rendered_sections": _LINES + """
, c AS (SELECT conv_id, turn, i, x, string_split(x, ' ')[1] AS w, sha256(lower(string_split(x, ' ')[1])) AS id FROM e),
u AS (SELECT DISTINCT conv_id, turn, id FROM c WHERE i % 4 = 0),
f AS (SELECT c.conv_id, c.id, c.turn, c.i, c.w, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.i) AS number FROM c JOIN u ON u.conv_id = c.conv_id AND u.turn = c.turn AND u.id = c.id QUALIFY row_number() OVER (PARTITION BY c.conv_id, c.id ORDER BY c.turn, c.i) = 1),
n AS (SELECT conv_id, id, turn, i, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS number FROM f),
b AS (SELECT c.conv_id, c.turn, string_agg(x || CASE c.i % 4 WHEN 0 THEN coalesce(' [^s' || number || ']', ' [E:' || c.id || ']') WHEN 1 THEN ' `[E:' || c.id || ']`' WHEN 2 THEN ' [E:' || left(c.id, 9) || ']' ELSE '' END, chr(10) ORDER BY c.i) AS body FROM c LEFT JOIN n ON n.conv_id = c.conv_id AND n.id = c.id GROUP BY 1, 2)
SELECT l.conv_id, 0 AS kind, CAST(l.turn AS BIGINT) AS place, sha256('## T' || l.turn || chr(10) || chr(10) || coalesce(body, '') || chr(10) || chr(10)) AS hash FROM l LEFT JOIN b ON b.conv_id = l.conv_id AND b.turn = l.turn
UNION ALL SELECT conv_id, 1, CAST(number AS BIGINT), sha256('[^s' || number || ']: `src/' || w || '` L' || i || '–L' || (i + 2) || ' · Evidence `' || id || '`' || chr(10) || chr(10)) FROM n""",
    "section_parts": _LINES + """
, h AS (SELECT conv_id, turn, i, x, CASE WHEN i % 3 = 1 THEN 4 WHEN i % 5 = 2 THEN 5 ELSE 0 END AS level, CASE WHEN i % 4 = 3 THEN chr(10) || '```' || chr(10) || '#### no' || chr(10) || '```' ELSE '' END AS code,
  regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g') = regexp_replace(lower(coalesce(lines[2], 'none')), '[^a-z0-9]+', ' ', 'g') AS own FROM e),
t AS (SELECT conv_id, turn, min(level) FILTER (level > 0) AS top, greatest(coalesce(min(level) FILTER (level > 0 AND NOT own), 3) - 3, 0) AS shift FROM h GROUP BY 1, 2),
p AS (SELECT h.*, top, shift, count(*) FILTER (level = top) OVER (PARTITION BY h.conv_id, h.turn ORDER BY i) AS part FROM h JOIN t USING (conv_id, turn)),
q AS (SELECT conv_id, turn, part, string_agg(repeat('#', level) || CASE WHEN level > 0 THEN ' ' ELSE '' END || x || code, chr(10) ORDER BY i) AS body FROM p GROUP BY 1, 2, 3),
r AS (SELECT conv_id, turn, count(*) AS n, string_agg(body, '|' ORDER BY part) AS parts FROM q GROUP BY 1, 2),
s AS (SELECT conv_id, turn, string_agg(CASE WHEN level > 0 AND own THEN substr(code, 2) WHEN level > 0 THEN repeat('#', greatest(level - shift, 3)) || ' ' || x || code ELSE x || code END, chr(10) ORDER BY i) FILTER (NOT (level > 0 AND own AND code = '')) AS shifted FROM p GROUP BY 1, 2)
SELECT l.conv_id, l.turn, coalesce(n, 0) AS n_parts, sha256(coalesce(parts, '')) AS parts, sha256(coalesce(shifted, '')) AS shifted FROM l LEFT JOIN r ON r.conv_id = l.conv_id AND r.turn = l.turn LEFT JOIN s ON s.conv_id = l.conv_id AND s.turn = l.turn""",
    "diagram_limits": _LINES + """
, k AS (SELECT conv_id, turn, i, x, i % 2 = 1 AS drawn, count(*) FILTER (i % 2 = 1) OVER (PARTITION BY conv_id, turn ORDER BY i) AS nth, i = len(lines) - 1 AS last FROM e),
c AS (SELECT conv_id, turn, count(*) FILTER (drawn) AS n, string_agg(x || CASE WHEN drawn AND nth <= turn % 3 THEN chr(10) || '```mermaid' || chr(10) || x || chr(10) || '```' || CASE WHEN last THEN '' ELSE chr(10) END WHEN drawn THEN chr(10)
  WHEN i % 5 = 4 THEN chr(10) || '```' || chr(10) || x || chr(10) || '```' || CASE WHEN last THEN '' ELSE chr(10) END ELSE CASE WHEN last THEN '' ELSE chr(10) END END, '' ORDER BY i) AS kept FROM k GROUP BY 1, 2)
SELECT l.conv_id, l.turn, coalesce(n, 0) AS diagrams, sha256(coalesce(kept, '')) AS kept FROM l LEFT JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn""",
    "section_digests": _LINES + """
, c AS (SELECT conv_id, turn, string_agg(CASE i % 3 WHEN 0 THEN '## ' || x WHEN 1 THEN x || ' [E:' || i || ']' ELSE '`[E:no]` ' || x END, chr(10) ORDER BY i) AS text, string_agg('## ' || x, '|' ORDER BY i) FILTER (i % 3 = 0 AND i < 9) AS headings, count(*) FILTER (i % 3 = 1) AS n FROM e GROUP BY 1, 2)
SELECT l.conv_id, l.turn, coalesce(headings, '') AS headings, CASE WHEN length(coalesce(text, '')) <= 120 THEN coalesce(text, '') ELSE left(text, 50) || chr(10) || '[… excerpt …]' || chr(10) || right(text, 51) END AS short, coalesce(n, 0) AS citations
FROM l LEFT JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn""",
    "cut_arrays": """
WITH t AS (SELECT conv_id, turn, left(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 30) AS w FROM conversations),
o AS (SELECT conv_id, turn, 14 + length('{"t": "' || w || '"}') AS e1, '{"t":"' || w || '"}' AS v1, 22 AS more, turn || '' AS n FROM t),
c AS (SELECT *, e1 + 8 + 18 AS e2, e1 + 8 + 18 + 14 + length('{"n": ' || n || '}') AS e3, (conv_id * 7 + turn * 13) % (e1 + 8 + 18 + 14 + length('{"n": ' || n || '}') + 7 + 1) AS place FROM o)
SELECT conv_id, turn, concat_ws(';', CASE WHEN place >= e1 THEN v1 END, CASE WHEN place >= e2 THEN '{"q":{"b":"}]"}}' END, CASE WHEN place >= e3 THEN '{"n":' || n || '}' END) AS elements FROM c""",
    "warning_notes": _LINES + """
, w AS (SELECT *, string_split(x, ' ')[1] AS w, dense_rank() OVER (PARTITION BY conv_id, turn ORDER BY first) AS place FROM (SELECT *, min(i) OVER (PARTITION BY conv_id, turn, string_split(x, ' ')[1]) AS first FROM e)),
c AS (SELECT conv_id, turn, string_agg(x || ' ' || CASE WHEN place <= 2 THEN '[^s' || place || ']' WHEN place <= 4 THEN w || '.rs' ELSE '' END || CASE WHEN i % 3 = 2 THEN ' `[E:' || w || ']`' ELSE '' END, chr(10) ORDER BY i) AS text FROM w GROUP BY 1, 2)
SELECT l.conv_id, l.turn, sha256(coalesce(text, '')) AS text FROM l LEFT JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn""",
    "brief_checks": """
WITH f AS (SELECT DISTINCT l_orderkey AS scope, l_linenumber AS finding FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY finding) AS place FROM f)
SELECT scope, finding, 'text' AS code FROM n WHERE finding = 7 UNION ALL SELECT scope, finding, 'too many' FROM n WHERE place > 5
UNION ALL SELECT scope, finding, 'unknown id' FROM n WHERE scope % 8 > 6 OR finding > 6 UNION ALL SELECT scope, finding, 'no implementation' FROM n WHERE finding % 2 = 0 AND scope % 8 <> 3 AND finding <> 3""",
    "request_shares": """
SELECT o_orderkey, CAST(floor(least(o_custkey * 100, 48000) / pow(2, o_custkey % 4)) AS BIGINT) AS planning,
  CAST(floor(floor(least(o_custkey * 100, 80000) / pow(2, o_custkey % 3)) / (1 + CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END)) AS BIGINT) AS share FROM orders""",
    "spliced_parts": _LINES + """
SELECT conv_id, turn, CASE WHEN (turn + conv_id) % 5 = 0 THEN sha256(array_to_string(list_transform(lines, lambda x, i: CASE WHEN i - 1 = conv_id % len(lines) THEN upper(x) ELSE x END), chr(10) || chr(10))) END AS value,
  CASE (turn + conv_id) % 5 WHEN 1 THEN 'part given twice' WHEN 2 THEN 'unknown part' WHEN 3 THEN CASE WHEN least(length(lines[1]), 3) * 2 < list_sum(list_transform(lines, lambda x: length(x))) THEN 'no markers' END WHEN 4 THEN 'text before the first marker' END AS fault FROM l WHERE len(lines) > 0""",
}

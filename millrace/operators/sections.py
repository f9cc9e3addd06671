"""Checks of written sections, and outlines as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import markdown
from millrace.operators.graph import tree_closure
from millrace.operators.ordering import first_of
from millrace.session import written


def section_issues(sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """Major faults of sections (section, markdown): unknown_citation, no_citation, unclosed_fence.

    ``evidence`` has the ids that may be cited. Citations are exploded and
    anti-joined, so neither side is collected.
    """
    cited = sections.select("section", F.explode(markdown.citations(F.col("markdown"))).alias("id"))
    strange = cited.join(evidence.select("id").distinct(), "id", "left_anti").distinct()
    unknown = first_of(strange, "section", "id", 20).select("section", F.lit("unknown_citation").alias("code"), F.concat_ws(",", "first").alias("detail"))
    bare = sections.filter(F.size(markdown.citations(F.col("markdown"))) == 0).select("section", F.lit("no_citation").alias("code"), F.lit("").alias("detail"))
    opened = sections.filter(markdown.has_unclosed_fence(F.col("markdown"))).select("section", F.lit("unclosed_fence").alias("code"), F.lit("").alias("detail"))
    return unknown.unionAll(bare).unionAll(opened)


def outline_issues(sections: DataFrame) -> DataFrame:
    """Faults of outlines (outline, position, id, title, depends_on array<int>): repeated ids or titles, and dependencies that do not point back or repeat."""
    title = F.lower(F.regexp_replace(F.trim("title"), r"\s+", " "))
    count = lambda c: F.count("*").over(Window.partitionBy("outline", c))
    rows = sections.withColumn("_title", title).withColumn("_ids", count("id")).withColumn("_titles", count("_title"))
    flags = {
        "duplicate_id": F.col("_ids") > 1,
        "duplicate_title": F.col("_titles") > 1,
        "forward_dependency": F.exists("depends_on", lambda d: (d >= F.col("position")) | (d < 0)),
        "repeated_dependency": F.size("depends_on") > F.size(F.array_distinct("depends_on")),
    }
    found = rows.select("outline", "position", F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())), lambda x: x.isNotNull())).alias("code"))
    return found


def prerequisites(sections: DataFrame) -> DataFrame:
    """``outline, position, needs``: all sections that a section rests on."""
    key = lambda p: F.concat_ws("#", F.col("outline").cast("string"), p.cast("string"))
    edges = sections.select("outline", "position", F.explode("depends_on").alias("needs"))
    reach = tree_closure(edges.select(key(F.col("needs")).alias("parent"), key(F.col("position")).alias("node"))).filter("depth > 0").select("ancestor", "node").distinct()
    part = lambda c, i: F.element_at(F.split(c, "#"), i)
    return reach.select(part("node", 1).alias("outline"), part("node", 2).cast("int").alias("position"), part("ancestor", 2).cast("int").alias("needs"))


def joined_outlines(parts: DataFrame) -> DataFrame:
    """Parts (part, position, title, depends_on) as one outline: positions and dependencies move by what stands before."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    offset = sizes.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a part
    moved = parts.join(offset.select("part", "offset"), "part")
    return moved.select((F.col("position") + F.col("offset")).cast("int").alias("position"), "title", F.transform("depends_on", lambda d: (d + F.col("offset")).cast("int")).alias("depends_on"))


def without_section(sections: DataFrame, position: int) -> DataFrame:
    """An outline (position, depends_on) after one section went."""
    kept = sections.filter(F.col("position") != position)
    moved = lambda p: F.when(p > position, p - 1).otherwise(p)
    return kept.withColumn("depends_on", F.transform(F.filter("depends_on", lambda d: d != position), moved)).withColumn("position", moved(F.col("position")))


def diagram_issues(sections: DataFrame, most: DataFrame) -> DataFrame:
    """``outline, position, expected, actual``: sections whose text has other than the planned diagrams, and outlines that plan too many.

    ``sections``: outline, position, diagrams (planned, or null where nothing is
    planned) and markdown; ``most`` (outline, maximum) bounds whole outlines, whose
    rows have no position, and no say where the maximum is null.
    """
    planned = F.when(F.col("diagrams").isNotNull(), F.size("diagrams")).cast("bigint")
    drawn = sections.select("outline", "position", planned.alias("expected"), markdown.diagrams(markdown.pieces(F.col("markdown"))).alias("actual"))
    drawn = written(drawn, "drawn")  # used twice; a few numbers a section
    wrong = drawn.filter(F.col("expected").isNotNull() & (F.col("actual") != F.col("expected")))
    sums = drawn.groupBy("outline").agg(F.sum(F.coalesce("expected", F.lit(0))).alias("actual"))
    over = sums.join(most, "outline").filter(F.col("actual") > F.col("maximum"))
    return wrong.unionByName(over.select("outline", F.lit(None).cast(sections.schema["position"].dataType).alias("position"), F.col("maximum").cast("bigint").alias("expected"), "actual"))

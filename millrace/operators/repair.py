"""Where issues of a draft stand: many phrases sought in all parts at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.markdown import diagrams, pieces
from millrace.functions.text import CITATION
from millrace.operators.ordering import SALTS, dealt, everywhere

# What messages say of diagrams, and how they quote.
OWNS = r"owns (\d+) Mermaid diagram\(s\) in section_plan\.diagrams but contains (\d+)"
INVALID = r'MERMAID_INVALID: \{\\?"diagram\\?":\s*(\d+)'
QUOTED = "[\"“`'‘]([^\"”`'’]{8,200})[\"”`'’]"


def located(texts: DataFrame, phrases: DataFrame, scope: str, part: str) -> DataFrame:
    """``scope, phrase, part``: which texts (scope, part, text) hold which phrases (scope, phrase) of their scope.

    The phrases of a scope make one automaton, which reads every text once; a
    scope's texts are dealt to several tasks, each of which gets its phrases first.
    """
    kinds = {c: texts.schema[c].dataType.simpleString() for c in (scope, part)}
    sought = everywhere(phrases.select(scope, "phrase").filter("phrase <> ''").distinct()).select(scope, "salt", F.lit(0).alias("kind"), F.lit(None).cast(kinds[part]).alias(part), F.col("phrase").alias("text"))
    read = dealt(texts.join(phrases.select(scope).distinct(), scope, "left_semi"), part).select(scope, "salt", F.lit(1).alias("kind"), part, "text")
    stream = sought.unionAll(read).repartition(scope, "salt").sortWithinPartitions(scope, "salt", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        place, words, automaton = None, [], None
        for batch in batches:
            out = []
            for one, salt, kind, number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (one, salt) != place:
                    place, words, automaton = (one, salt), [], None
                if kind == 0:
                    words.append(text)
                    continue
                if words:
                    automaton = ahocorasick.Automaton()
                    for word in words:
                        automaton.add_word(word, word)
                    automaton.make_automaton()
                    words = []
                if automaton is not None:
                    out += [(one, word, number) for word in {word for _, word in automaton.iter(text or "")}]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            fields = (batch.schema.field(scope).type, pa.string(), batch.schema.field(part).type)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields, strict=True)], names=[scope, "phrase", part])

    return stream.mapInArrow(work, f"{scope} {kinds[scope]}, phrase string, {part} {kinds[part]}")


def repair_targets(parts: DataFrame, issues: DataFrame, scope: str, part: str = "part") -> DataFrame:
    """``scope, target``: the parts of a draft that its issues touch; one null row if it is to be written anew.

    ``parts``: scope, part (from 0), text; ``issues``: scope, issue, message. An
    issue is placed by the citations it names, the ordinal of a diagram, or the
    phrases it quotes; a diagram that is missing is placed behind the last part.
    A draft is written anew if it has no issue, one that nothing places, or
    issues in every part.
    """
    many = parts.groupBy(scope).agg(F.count("*").alias("n"))
    number = lambda pattern, k: F.regexp_extract("message", pattern, k).try_cast("bigint")
    # What quotes and citations name, a row each.
    ids = F.flatten(F.transform(F.regexp_extract_all("message", F.lit(CITATION), F.lit(1)), lambda x: F.split(x, ",")))
    starts = F.transform(F.transform(ids, lambda x: F.regexp_replace(F.trim(x), "^E:", "")), lambda x: F.when(F.octet_length(x) >= 8, F.concat(F.lit("[E:"), F.left(x, F.lit(8)))))
    quotes = F.transform(F.regexp_extract_all("message", F.lit(QUOTED), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    named = issues.select(scope, "issue", F.explode(F.filter(F.concat(starts, quotes), lambda x: x.isNotNull())).alias("phrase"))
    found = named.join(located(parts, named, scope, part), [scope, "phrase"]).select(scope, "issue", F.col(part).cast("bigint").alias("target"))
    # A quote of blanks alone is in every part.
    blank = dealt(parts, part).join(everywhere(named.filter("phrase = ''").select(scope, "issue").distinct()), [scope, "salt"]).select(scope, "issue", F.col(part).cast("bigint"))

    missing = issues.filter(number(OWNS, 2) < number(OWNS, 1)).join(many, scope).select(scope, "issue", F.col("n").cast("bigint"))
    wanted = issues.filter(F.col("message").rlike(INVALID)).select(scope, "issue", number(INVALID, 1).alias("nth"))
    drawn = parts.join(wanted.select(scope).distinct(), scope, "left_semi").select(scope, part, diagrams(pieces(F.col("text"))).alias("here")).filter("here > 0")
    upto = F.sum("here").over(Window.partitionBy(scope).orderBy(part))
    each = drawn.withColumn("upto", upto).select(scope, F.col(part).alias("target"), F.explode(F.sequence(F.col("upto") - F.col("here") + 1, F.col("upto"))).alias("nth"))
    numbered = wanted.join(each, [scope, "nth"]).select(scope, "issue", F.col("target").cast("bigint"))

    placed = found.unionAll(blank).unionAll(missing).unionAll(numbered).distinct()
    lost = issues.join(placed.select(scope, "issue"), [scope, "issue"], "left_anti").select(scope).distinct().withColumn("lost", F.lit(True))
    targets = placed.select(scope, "target").distinct().join(many, scope)
    hit = targets.groupBy(scope).agg(F.count_if(F.col("target") < F.col("n")).alias("hit"))
    judged = many.join(hit, scope, "left").join(lost, scope, "left")
    good = judged.filter(F.col("lost").isNull() & (F.col("hit") < F.col("n"))).select(scope)
    return targets.select(scope, "target").join(good, scope, "left_semi").unionAll(many.select(scope).join(good, scope, "left_anti").select(scope, F.lit(None).cast("bigint")))

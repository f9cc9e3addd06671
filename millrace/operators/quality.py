"""Duplicate passages, windows over sections, footnotes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.lines import common
from millrace.functions.markdown import footnoted, paragraphs, pieces
from millrace.functions.text import CITATION, folded
from millrace.operators.ordering import dealt, everywhere
from millrace.session import written

#: Blocks that offer one pair of words and meet in one part.
PAIR_BLOCKS = 2000
#: Bins in which word pairs are counted; a power of two.
BINS = 1 << 20
#: Places in which numbers of blocks leave a mark; a power of two.
MARKS = 1 << 23


def exact_duplicates(blocks: DataFrame, key: list[str], text: str, least: int = 120) -> DataFrame:
    """Blocks of at least ``least`` folded characters that repeat: each with its earliest match.

    ``key`` orders blocks. The earliest of a group is found by an aggregate, so
    a passage on any number of pages meets in no single task.
    """
    # Used twice: texts are folded once, and short hashes go to the shared folder.
    marked = blocks.select(*key, folded(F.col(text)).alias("folded")).filter(F.length("folded") >= least).select(*key, F.sha2("folded", 256).alias("hash"))
    marked = written(marked, "folded")
    first = marked.groupBy("hash").agg(F.min(F.struct(*key)).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hash", "first")
    later = marked.join(first, "hash").filter(F.struct(*key) != F.col("first"))
    return later.select(*key, *(F.col(f"first.{k}").alias(f"first_{k}") for k in key))


def word_pairs(text: Column) -> Column:
    """A block's distinct pairs of neighbouring words."""
    words = F.split(text, " ")
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.filter(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda p: p.isNotNull()))


def _weights(tokens: Column, rows: DataFrame) -> np.ndarray:
    """How many tokens (arrays) fall into each of ``BINS`` bins: a table of fixed size, whatever the input."""
    counts = rows.select(F.explode(tokens).alias("t")).groupBy(F.col("t").bitwiseAND(BINS - 1).alias("bin")).agg(F.count("*").alias("n")).toArrow()
    weights = np.zeros(BINS, np.int64)
    weights[counts["bin"].to_numpy()] = counts["n"].to_numpy()
    return weights


def offers(tokens: Column, weights: Broadcast, share: int) -> Column:
    """``n, rare, even, odd``: how many tokens a block has, its rarest, and in which of 64 places an odd number of its tokens falls, by two hashes.

    Tokens are ranked by the weight of their bin, then by themselves: any order
    that all blocks share loses no pair, frequent ones last spare work.
    """

    @F.pandas_udf("n int, rare array<bigint>, even bigint, odd bigint")
    def ranked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, rare, even, odd = [], [], [], []
            for t in batch:
                most = len(t) - -(-len(t) * share // 100) + 1
                n.append(len(t))
                rare.append(np.unique(t[np.lexsort((t, weights.value[t & (BINS - 1)]))[:most]]))
                even.append(np.bitwise_xor.reduce(np.left_shift(1, t >> 58 & 63)))
                odd.append(np.bitwise_xor.reduce(np.left_shift(1, t >> 52 & 63)))
            yield pd.DataFrame({"n": n, "rare": rare, "even": even, "odd": odd})

    return ranked(tokens)


def offering(texts: DataFrame, share: int, least_pairs: int) -> DataFrame:
    """``texts`` (a written table) with what each block offers as ``o`` (see :func:`offers`) for its ``text``, from ``least_pairs`` on."""
    tokens = F.transform(word_pairs(F.col("text")), lambda p: F.xxhash64(p))
    weights = texts.sparkSession.sparkContext.broadcast(_weights(tokens, texts))
    return texts.select(*(c for c in texts.columns if c != "text"), offers(tokens, weights, share).alias("o")).filter(F.col("o.n") >= least_pairs)


def _marked(rows: DataFrame, num: str, among: DataFrame) -> DataFrame:
    """``rows`` without most of those whose number is not in ``among``: by a table of fixed size, so that few others are shuffled."""
    place = F.xxhash64(num).bitwiseAND(MARKS - 1).cast("int")
    marks = np.zeros(MARKS, bool)
    marks[among.select(place.alias("place")).distinct().toArrow()["place"].to_numpy()] = True
    marks = rows.sparkSession.sparkContext.broadcast(marks)

    @F.pandas_udf("boolean")
    def has(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(marks.value[batch.to_numpy()])

    return rows.filter(has(place))


def alike(offered: DataFrame, texts: DataFrame, scope: list[str], share: int) -> DataFrame:
    """``num_a, num_b, common, total``: pairs of a scope whose word pairs overlap in ``share`` percent, by prefix filtering.

    ``offered`` is a written table of ``num``, scope and ``o`` (see
    :func:`offering`), each text once in its scope; ``texts`` has ``num`` and
    ``text`` of these and perhaps others. A block offers only its rarest word
    pairs, as hashes, as many as a partner must share one of. Where two meet,
    their sizes and the parities of their hashes bound how far their sets differ,
    so that few others than true pairs are compared on the words themselves. What
    is offered is shuffled once
    and read for both sides; texts are shuffled only of blocks left to compare.
    """
    each = offered.select("num", *scope, "o.n", "o.even", "o.odd", F.explode("o.rare").alias("pair")).withColumn("bin", F.xxhash64(*scope, "pair").bitwiseAND(BINS - 1))
    # A frequent pair's blocks are dealt to parts, each of which meets all of the pair's blocks; bins bound how frequent it is.
    hot = each.groupBy("bin").agg(F.count("*").alias("uses")).filter(F.col("uses") > PAIR_BLOCKS)
    hot = written(hot.select("bin", F.ceil(F.col("uses") / PAIR_BLOCKS).cast("int").alias("parts")), "hot")
    parts = F.coalesce("parts", F.lit(1))
    met = each.join(F.broadcast(hot), "bin", "left").withColumn("own", F.pmod(F.xxhash64("num"), parts).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    # Both sides are the same shuffle, so they have the same columns: two blocks meet in the part of one of them.
    a, b = (met.select(*scope, "pair", "part", *(F.col(c).alias(f"{c}_{s}") for c in ("num", "n", "even", "odd", "own"))) for s in "ab")
    here = F.col("part") == F.when((F.col("num_a") + F.col("num_b")) % 2 == 0, F.col("own_a")).otherwise(F.col("own_b"))
    sized_alike = 100 * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b")
    # Of sets of n_a and n_b that share so much, at most this many members are in one alone; each odd place shows one at least.
    apart = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) * (100 + share) <= (100 - share) * (F.col("n_a") + F.col("n_b"))
    candidates = written(a.join(b, [*scope, "pair", "part"]).filter((F.col("num_a") < F.col("num_b")) & here & sized_alike & apart("even") & apart("odd")).select("num_a", "num_b").distinct(), "candidates")
    ends = candidates.select(F.explode(F.array("num_a", "num_b")).alias("num")).distinct()
    sets = written(_marked(texts.select("num", "text"), "num", ends).join(ends, "num", "left_semi"), "sets")
    both = candidates.join(sets.select(F.col("num").alias("num_a"), F.col("text").alias("text_a")), "num_a").join(sets.select(F.col("num").alias("num_b"), F.col("text").alias("text_b")), "num_b")
    paired = both.select("num_a", "num_b", word_pairs(F.col("text_a")).alias("pairs_a"), word_pairs(F.col("text_b")).alias("pairs_b"))
    found = paired.withColumn("common", F.size(F.array_intersect("pairs_a", "pairs_b"))).withColumn("total", F.size("pairs_a") + F.size("pairs_b") - F.col("common"))
    return found.filter(100 * F.col("common") >= share * F.col("total")).select("num_a", "num_b", "common", "total")


def near_duplicates(blocks: DataFrame, key: str, text: str, share: int = 90, least: int = 200, least_pairs: int = 8) -> DataFrame:
    """Pairs of blocks whose word pairs overlap in ``share`` percent (see :func:`alike`). Equal blocks count once, through their first."""
    sized = blocks.select(F.col(key).alias("id"), folded(F.col(text)).alias("text")).filter(F.length("text") >= least)
    texts = written(sized.withColumn("num", F.monotonically_increasing_id()), "texts")
    # Equal texts meet by hash, with what they offer instead of themselves.
    each = offering(texts.withColumn("hash", F.unhex(F.sha2("text", 256))), share, least_pairs)
    offered = written(each.groupBy("hash").agg(F.min(F.struct("id", "num", "o")).alias("first")).select("first.*"), "offered")
    ids = offered.select("num", "id")
    near = written(alike(offered, texts, [], share), "near")
    found = near.join(ids.select(F.col("num").alias("num_a"), F.col("id").alias("a")), "num_a").join(ids.select(F.col("num").alias("num_b"), F.col("id").alias("b")), "num_b")
    return found.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "common", "total")


def repeated_paragraphs(sections: DataFrame, outline: str, most: int = 16) -> DataFrame:
    """``outline, section, block, first_section, first_block, exact``: paragraphs that an earlier one of their document equals or nearly does.

    ``sections``: outline, section, markdown. Neighbours in one section are no
    repeats; a paragraph is reported once, with the first it repeats, and of a
    document the first ``most``. Only the first paragraph of every text can be
    what a later one repeats first, so texts meet, not paragraphs: equal ones by
    hash, near ones (nine tenths of their word pairs, from 200 characters on) by their rare word pairs.
    """
    each = sections.select(outline, "section", F.explode(paragraphs(pieces(F.col("markdown")))).alias("p")).select(outline, "section", "p.block", "p.text")
    at = F.struct("section", "block")
    blocks = written(each.select(outline, at.alias("at"), "text", F.unhex(F.sha2("text", 256)).alias("hash")), "paragraphs")
    firsts = blocks.groupBy(outline, "hash").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.any_value("text").alias("text"))
    firsts = written(firsts.withColumn("num", F.monotonically_increasing_id()), "firsts")
    long = firsts.filter(F.length("text") >= 200).select("num", outline, "text")
    near = written(alike(written(offering(long, share=90, least_pairs=8), "offered"), long, [outline], share=90), "near")
    both = near.select("num_a", "num_b").unionAll(near.select(F.col("num_b").alias("num_a"), F.col("num_a").alias("num_b")))
    other = both.join(firsts.select(F.col("num").alias("num_b"), "first"), "num_b").join(firsts.select(F.col("num").alias("num_a"), outline, "hash"), "num_a").select(outline, "hash", "first", F.lit(False).alias("exact"))
    # What stands once and is near nothing has no say.
    candidates = written(other.unionByName(firsts.filter("n > 1").select(outline, "hash", "first", F.lit(True).alias("exact"))), "candidates")
    # A text's paragraphs are dealt to parts, each of which meets all that it may repeat.
    met = dealt(blocks.select(outline, "at", "hash"), "at").join(everywhere(candidates), [outline, "hash", "salt"])
    beside = (F.col("first.section") == F.col("at.section")) & (F.col("at.block") - F.col("first.block") <= 1)
    found = met.filter((F.col("first") < F.col("at")) & ~beside).groupBy(outline, "at").agg(F.min(F.struct("first", "exact")).alias("m"))
    rank = F.row_number().over(Window.partitionBy(outline).orderBy("m.first", "at"))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= most).select(outline, "at.section", "at.block", F.col("m.first.section").alias("first_section"), F.col("m.first.block").alias("first_block"), "m.exact")


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("added", "removed", "equal")]))
def _line_diff(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for old, new in batches:
        rows = []
        for a, b in zip(old, new, strict=True):
            a, b = (a or "").split("\n"), (b or "").split("\n")
            same = int(common(a, b).sum())
            rows.append((len(b) - same, len(a) - same, same))
        yield pd.DataFrame(rows, columns=["added", "removed", "equal"])


def line_diff(old: Column, new: Column) -> Column:
    """``added``, ``removed`` and ``equal`` lines between two versions of a text, the fewest changes that lead from one to the other."""
    return _line_diff(old, new)


def windows(counts: DataFrame, count: str, width: int) -> DataFrame:
    """Overlapping runs of sections: ``start, stop`` (end exclusive), one shared between neighbours."""
    width = max(width, 2)
    n = F.col(count)
    starts = F.when(n <= width, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 2, F.lit(width - 1)))
    return counts.withColumn("start", F.explode(starts)).withColumn("stop", F.least(F.col("start") + width, n))


def islands(rows: DataFrame, key: str, order: str, inside: Column) -> DataFrame:
    """Runs of consecutive rows outside ``inside``: ``key, from, to, omitted``."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.select(key, order, inside.alias("_in"), F.row_number().over(w).alias("_all"))
    outside = numbered.filter(~F.col("_in")).withColumn("_run", F.col("_all") - F.row_number().over(w))
    return outside.groupBy(key, "_run").agg(F.min(order).alias("from"), F.max(order).alias("to"), F.count("*").alias("omitted")).drop("_run")


def footnotes(uses: DataFrame, key: str, order: str, cited: str) -> DataFrame:
    """Numbers of cited sources by first use within each document."""
    first = uses.groupBy(key, cited).agg(F.min(order).alias("first_use"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("first_use", cited)))


def rendered(sections: DataFrame, evidence: DataFrame, document: str) -> DataFrame:
    """``document, kind, place, text``: a document's sections (kind 0) with footnotes, and the references (kind 1) behind them.

    ``sections``: document, section, title, markdown; ``evidence``: document,
    section, pos, id, path, start, end. Evidence counts as cited where the text
    of its own section cites it outside code; it is numbered by its first such
    section and place, and its citations in all sections become that footnote.
    """
    cut = written(sections.select(document, "section", "title", pieces(F.col("markdown")).alias("p")), "pieces")
    outside = F.flatten(F.transform(F.filter("p", lambda p: ~p["code"]), lambda p: F.regexp_extract_all(p["text"], F.lit(CITATION), F.lit(1))))
    uses = cut.select(document, "section", F.explode(F.array_distinct(outside)).alias("id"))
    own = evidence.join(uses, [document, "section", "id"], "left_semi")
    first = own.groupBy(document, "id").agg(F.min(F.struct("section", "pos", "path", "start", "end")).alias("f"))
    numbered = written(first.withColumn("number", F.row_number().over(Window.partitionBy(document).orderBy("f.section", "f.pos"))), "numbered")
    # As long as a section's own citations.
    maps = uses.join(numbered.select(document, "id", "number"), [document, "id"]).groupBy(document, "section").agg(F.map_from_entries(F.collect_list(F.struct("id", "number"))).alias("numbers"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    body = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), footnoted(F.col("p"), F.coalesce("numbers", none)), F.lit("\n\n"))
    bodies = cut.join(maps, [document, "section"], "left").select(document, F.lit(0).alias("kind"), F.col("section").cast("bigint").alias("place"), body.alias("text"))
    line = F.format_string("[^s%d]: `%s` L%d–L%d · Evidence `%s`\n\n", "number", F.replace("f.path", F.lit("`"), F.lit("")), "f.start", "f.end", "id")
    return bodies.unionAll(numbered.select(document, F.lit(1).alias("kind"), F.col("number").cast("bigint"), line.alias("text")))


def shares(rows: DataFrame, key: str, order: str, weight: str, total: int) -> DataFrame:
    """``total`` dealt in proportion to weight within each key: floors, then remainders by weight and order."""
    whole = rows.groupBy(key).agg(F.sum(weight).alias("_sum"))
    based = rows.join(whole, key).withColumn("base", F.floor(F.col(weight) * total / F.col("_sum")).cast("bigint"))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(weight), order))
    return based.withColumn("share", F.col("base") + F.when(rank <= left, 1).otherwise(0)).drop("_sum", "base")

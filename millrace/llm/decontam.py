"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

Texts are cut into words (runs of letters and digits, lower case) and words into
64-bit hashes. A mask looks at some positions of a window of words and ignores
the others, so a window still meets its copy if ignored words were changed.
Every window of every text is hashed under each mask and looked up among the
windows of the benchmark. Around a hit the two texts are compared word by word,
``REACH`` words beyond the window on either side; a document is contaminated by
an item if some ``RUN`` aligned words in a row (all of the item, if it has
fewer) agree in at least ``SHARE`` of their places.

The masks lose nothing that this rule accepts: of 13 words any two may be
changed and one of the two ``LONG`` masks fits a place without them; the three
``SHORT`` masks do so for items of 8 and 9 words with one change and of 10 to 12
with two. Items of fewer words are looked up whole, and must be whole in the document.

The windows of the benchmark are broadcast after a count has shown that there
are at most ``limit``; beyond that, keys are joined in a shuffle that carries no
words, and only texts with a hit are read again. Hits are verified where they
are found, so only verified pairs are shuffled.

Defined cases: null and empty texts have no words and meet nothing; a null
document or item id is reported as null; rows that repeat an id are one document
(or item) that holds what any of its rows holds; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Looked-up places of a window: for items of ``RUN`` words or more, and for those of ``WHOLE`` or more.
LONG = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
SHORT = ((0, 1, 2, 3, 5), (0, 1, 4, 5, 7), (0, 1, 3, 6, 8))
SPAN, REACH, RUN, SHARE, WHOLE = 9, 12, 13, 0.8, 8


def word_hashes(text: Column) -> Column:
    """A text's words as hashes."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_for(lengths: list[int]) -> dict[int, tuple[int, ...]]:
    """By number the masks that items of these lengths need."""
    masks: dict[int, tuple[int, ...]] = {}
    if any(n >= RUN for n in lengths):
        masks |= dict(enumerate(LONG))
    if any(WHOLE <= n < RUN for n in lengths):
        masks |= {len(LONG) + k: m for k, m in enumerate(SHORT)}
    return masks | {-n: tuple(range(n)) for n in lengths if n < WHOLE}


def windows(hashed: DataFrame, masks: dict[int, tuple[int, ...]]) -> DataFrame:
    """Adds ``pos`` and ``key`` to each row of ``w``: the hash of each mask's words at each position."""
    shortest = min(m[-1] + 1 for m in masks.values())
    n = F.size("w")
    # Outer, so that no filter on sizes evaluates the words a second time.
    placed = hashed.withColumn("pos", F.explode_outer(F.when(n >= shortest, F.sequence(F.lit(0), n - shortest))))
    keys = [F.xxhash64(F.lit(k), *(F.get("w", F.col("pos") + o) for o in m)) for k, m in masks.items()]
    fits = [F.when(F.col("pos") + (m[-1] + 1) <= n, key) for key, m in zip(keys, masks.values(), strict=True)]
    return placed.withColumn("key", F.explode_outer(F.array(*fits)))


def around(words: str, pos: Column) -> Column:
    """The words from ``REACH`` before a window to ``REACH`` after it, as far as they go."""
    start = F.greatest(pos - REACH, F.lit(0))
    return F.slice(words, start + 1, pos + SPAN + REACH - start)


def best_run(doc: Column, item: Column, item_words: Column) -> Column:
    """Most agreeing places among ``RUN`` aligned words in a row; both start at the same place of the alignment."""
    same = F.zip_with(doc, item, lambda a, b: F.coalesce(F.when(a == b, 1).otherwise(0), F.lit(0)))
    width = F.least(F.lit(RUN), item_words)
    starts = F.sequence(F.lit(0), F.greatest(F.size(same) - width, F.lit(0)))
    return F.array_max(F.transform(starts, lambda k: F.aggregate(F.slice(same, k + 1, width), F.lit(0), lambda a, b: a + b)))


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", limit: int = 200_000) -> DataFrame:
    """``key, item_id, item_words, matched, seeds``: pairs of a document and an item that it holds.

    ``item_words`` counts the item's words, ``matched`` is the most agreeing
    words in a run, ``seeds`` the number of verified hits.
    """
    items = benchmark.select(F.col(item).alias("item_id"), word_hashes(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    # At most RUN values.
    lengths = sorted(r["n"] for r in items.select(F.least(F.size("w"), F.lit(RUN)).alias("n")).distinct().collect())
    masks = masks_for(lengths or [RUN])
    tests = None
    for low, high in [(RUN, 1 << 30), (WHOLE, RUN), *((n, n + 1) for n in lengths if n < WHOLE)]:
        mine = masks_for([low]).items() & masks.items()
        if mine:
            part = windows(items.filter((F.size("w") >= low) & (F.size("w") < high)), dict(sorted(mine)))
            tests = part if tests is None else tests.unionAll(part)
    tests = tests.filter("key is not null").select("item_id", "key", F.size("w").alias("item_words"), F.col("pos").alias("item_pos"), around("w", F.col("pos")).alias("item_around"))
    hashed = documents.select(F.col(key).alias("doc"), word_hashes(F.col(text)).alias("w"))
    probes = windows(hashed, masks)
    if tests.count() <= limit:
        # Nothing moves; words around a hit are cut out after the join, in the same stage.
        hits = probes.join(F.broadcast(tests), "key").withColumn("doc_around", around("w", F.col("pos")))
    else:
        met = probes.filter("key is not null").select("doc", "pos", "key").join(tests, "key").withColumnRenamed("doc", "met")
        hits = met.join(hashed, F.col("met").eqNullSafe(F.col("doc"))).withColumn("doc_around", around("w", F.col("pos")))
    # Both sides start where the one that has fewer words before its window does.
    lead = F.least(F.lit(REACH), F.col("pos"), F.col("item_pos"))
    part = lambda words, pos: F.slice(words, F.least(F.lit(REACH), pos) - lead + 1, lead + SPAN + REACH)
    doc, other = part(F.col("doc_around"), F.col("pos")), part(F.col("item_around"), F.col("item_pos"))
    # The row number keeps the comparison, which has no generated code, out of the
    # join: else the join leaves its stage and every window carries the text's words.
    cut = hits.select("doc", "item_id", "item_words", doc.alias("doc_side"), other.alias("item_side"), F.monotonically_increasing_id().alias("hit"))
    found = cut.filter("hit >= 0").select("doc", "item_id", "item_words", best_run(F.col("doc_side"), F.col("item_side"), F.col("item_words")).alias("matched"))
    least = F.when(F.col("item_words") < WHOLE, F.col("item_words")).otherwise(F.ceil(SHARE * F.least(F.lit(RUN), F.col("item_words"))))
    return found.filter(F.col("matched") >= least).groupBy(F.col("doc").alias(key), "item_id").agg(F.max("item_words").alias("item_words"), F.max("matched").cast("int").alias("matched"), F.count("*").alias("seeds"))

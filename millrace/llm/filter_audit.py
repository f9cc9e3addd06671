"""How filters of documents interact: what each removes, alone and after others, in every order.

Five filters look at a text: A too few words, B too few distinct words, C too many
capitals, D a symbol of code or tables, E a copy of a document of a smaller id. A
task scans the bytes of its Arrow buffers: classes of bytes by table, counts by
prefix sums at the bounds of documents. Words are hashed from prefix sums of
weighted bytes; a document's hashes are sorted, equal neighbours are verified byte
by byte, and where two words share a hash, that document's words are told apart
by their bytes. What fails is one mask a document.

All orders follow from counts by mask: tasks count documents by (part, mask,
labels), at most a few hundred rows a part, and only these meet the orders. Copies
are found by hash of the whole text; equal rows are counted before they are
shuffled, so that a text with a third of all rows is one row a task.

Defined cases: a null text is an empty one, and equal to it; a null ``lang`` is part
``''``. A row without an id fails E never and makes no other row fail it; rows that
repeat an id are documents of their own, none a copy of another of its id. Labels
that repeat an id count if any of them says so; labels without one are ignored. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import slices, text_bytes, tidy

FILTERS = "ABCDE"
#: The filters' limits and signs.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 3, b"#$%&*|"
#: Bytes of a text that are looked at together; they end at white space.
WINDOW = 1 << 18

_SPACE, _CAPITAL, _SIGN, _LATER = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] |= _SPACE
_CLASS[ord("A") : ord("Z") + 1] |= _CAPITAL
_CLASS[list(SIGNS)] |= _SIGN
_CLASS[0x80:0xC0] |= _LATER
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _prefix(marks: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(marks, dtype=np.int64))


def words_in(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and hash of every word of ``data``, which texts from ``starts`` make up; no word crosses such a bound."""
    word = (_CLASS[data] & _SPACE) == 0
    first = np.append(True, ~word[:-1])[: len(word)]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner] = True
    begin = np.flatnonzero(word & first)
    last = np.append(~word[1:], True)[: len(word)]
    last[inner - 1] = True
    length = np.flatnonzero(word & last) + 1 - begin
    if not len(begin):
        return begin, length, np.zeros(0, np.uint64)
    # A word's bytes are weighted by powers of an odd number that start anew in each word.
    place = np.arange(len(data)) - np.repeat(np.append(0, begin), np.diff(np.append(np.append(0, begin), len(data))))
    powers = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()) - 1, _STEP, np.uint64)))
    weighed = np.where(word, _BYTE[data] * powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
    return begin, length, np.add.reduceat(weighed, begin)


def distinct_words(data: np.ndarray, owner: np.ndarray, begin: np.ndarray, length: np.ndarray, hashed: np.ndarray, documents: int) -> np.ndarray:
    """How many distinct words each document has; equal hashes are verified on the bytes."""
    if not len(begin):
        return np.zeros(documents, np.int64)
    by = np.lexsort((length, hashed, owner))
    owner, begin, length, hashed = owner[by], begin[by], length[by], hashed[by]
    like = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    odd = like & (length[1:] != length[:-1])
    pairs = np.flatnonzero(like & ~odd)
    at = 0
    while at < len(pairs):
        size = np.cumsum(length[pairs[at : at + WINDOW]])
        end = at + max(1, int(np.searchsorted(size, WINDOW, "right")))
        some = pairs[at:end]
        many = length[some]
        offset = np.arange(many.sum()) - np.repeat(np.append(0, np.cumsum(many)[:-1]), many)
        differ = data[np.repeat(begin[some], many) + offset] != data[np.repeat(begin[some + 1], many) + offset]
        odd[some] |= np.logical_or.reduceat(differ, np.append(0, np.cumsum(many)[:-1]))
        at = end
    found = np.bincount(owner, minlength=documents) - np.bincount(owner[1:][like], minlength=documents)
    for doc in np.unique(owner[1:][odd]):
        mine = owner == doc
        found[doc] = len({data[b : b + n].tobytes() for b, n in zip(begin[mine].tolist(), length[mine].tolist(), strict=True)})
    return found


def _windows(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of windows of ``data`` that cut no word."""
    at = 0
    while at < len(data):
        end = at + WINDOW
        while end < len(data):
            room = (_CLASS[data[end : end + WINDOW]] & _SPACE) != 0
            bound = starts[int(np.searchsorted(starts, end))]  # the last start is the end of the data
            gap = end + int(np.argmax(room)) if room.any() else end + len(room)
            end = min(gap, bound)
            if room.any() or end == bound:
                break
        yield at, min(end, len(data))
        at = end


def text_masks(column: pa.Array) -> np.ndarray:
    """Bit 0 to 3 of every text: fails A, B, C, D."""
    data, starts = text_bytes(column)
    n = len(column)
    capitals, signs, points, words = (np.zeros(n, np.int64) for _ in range(4))
    pieces = []
    for low, high in _windows(data, starts):
        part = data[low:high]
        kind = _CLASS[part]
        inside = np.clip(starts, low, high) - low
        for total, bit, want in ((capitals, _CAPITAL, True), (signs, _SIGN, True), (points, _LATER, False)):
            total += np.diff(_prefix(((kind & bit) != 0) == want)[inside])
        begin, length, hashed = words_in(part, inside)
        first = np.zeros(len(part), bool)
        first[begin] = True
        words += np.diff(_prefix(first)[inside])
        pieces.append((begin + low, length, hashed))
    begin, length, hashed = (np.concatenate(x) for x in zip(*pieces, strict=True)) if pieces else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    owner = np.searchsorted(starts, begin, "right") - 1
    distinct = distinct_words(data, owner, begin, length, hashed, n)
    fails = [words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * capitals > CAPITAL_PERCENT * points, signs > 0]
    return sum(np.left_shift(f.astype(np.int32), k) for k, f in enumerate(fails))


def masked(documents: DataFrame) -> DataFrame:
    """``doc_id, part, copy_key, mask`` of every document; copies have one key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("copy_key"), text.alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3):
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(text_masks(part.column(3)))], names=["doc_id", "part", "copy_key", "mask"])

    return rows.mapInArrow(tidy(work), "doc_id bigint, part string, copy_key binary, mask int")


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by what they fail, of all five filters, and how many have these labels."""
    label = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masked(documents).groupBy("doc_id", "part", "copy_key", "mask").agg(F.count("*").alias("n"))
    # Rows without an id meet no label, and are dealt by their texts.
    deal = F.when(F.col("doc_id").isNull(), F.xxhash64("copy_key")).otherwise(0)
    met = rows.withColumn("deal", deal).join(label.withColumn("deal", F.lit(0).cast("bigint")), ["doc_id", "deal"], "left")
    named = met.select("doc_id", "part", "copy_key", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    # Of copies of one part and label: how many have no id, and how many have their least id, which may be the least of all.
    group = ["copy_key", "part", "mask", "good", "toxic"]
    has_id = F.col("doc_id").isNotNull()
    alike = named.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(~has_id, F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("least"))
    lowest = F.min("least.doc_id").over(Window.partitionBy("copy_key"))
    split = alike.withColumn("first", F.col("nameless") + F.when(F.col("least.doc_id") == lowest, F.col("least.n")).otherwise(0))
    sides = F.explode(F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("side")
    told = split.select("part", "good", "toxic", sides).select("part", "side.*", "good", "toxic")
    weighed = [F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic"))]
    return told.groupBy("part", "mask").agg(*weighed).filter("n > 0")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: what is kept, removed and lost there."""
    counts = mask_counts(documents, labels)
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            steps.append((("".join(FILTERS[k] for k in order)), step + 1, FILTERS[f], 1 << f, before))
            before |= 1 << f
    plan = documents.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, bit int, earlier int")
    each = F.broadcast(plan.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(31)))))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("earlier")) > 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0)).cast("bigint")
    steps_of = counts.join(each, "mask").groupBy("part", "filter_order", "step", "filter").agg(
        total(~gone & ~fails).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return steps_of.withColumn("shapley", shapley).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

"""Language identification by prediction by partial matching over bytes.

For each language, a tree of byte contexts up to ``ORDER`` long holds how often
each byte followed. A text's cost in a language is its exact code length under
those frozen counts: at each byte the longest known context codes it, or an
escape (method C: escapes weigh as many as the context's distinct bytes) and the
next shorter context without the bytes already excluded, at last one of the
bytes that the language has never had. Contexts of ``ORDER`` bytes are known from ``LEAST``
uses on. All 256 bytes count as such, after capitals are folded.

The model is sparse: sorted keys of (context, byte, language) with counts, and
of (context, language) with what coding and escaping cost there. As counts are
frozen, the code length of a gram (context and byte) is computed once a task and
kept; scoring is then a lookup for each byte, done for whole Arrow slices at a time.

Fitting takes a bounded sample of the distinct labelled texts of every language, chosen
by a hash of the text: about ``sample_docs`` of each, fewer (300 at least) if there are many
languages; contexts are counted and thinned in Spark. Prediction covers whole texts of all rows.

Defined cases: a text that is null, empty or without a letter is ``und`` with
score 0; rows with a null language teach nothing; ties go to the language whose
name sorts first; a table without labelled rows predicts ``und`` everywhere;
repeated rows and other columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, text_bytes, tidy
from millrace.session import written

ORDER, LEAST = 3, 4
#: Keys have a language's number in so many bits.
LANG_BITS = 16
#: Before a text stands this byte.
PAD = 32
#: Bytes of texts that a task works on at once.
SLICE = 1 << 18
#: Values of code lengths that a task keeps.
KEPT = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of U+00C0 to U+00DE in lower case."""
    out = LOWER[data]
    if len(out) > 1:
        after = np.flatnonzero(out[:-1] == 0xC3) + 1
        capital = after[(out[after] >= 0x80) & (out[after] <= 0x9E) & (out[after] != 0x97)]
        out[capital] += 0x20
    return out


def grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte of the texts the three before it and itself, in 32 bits."""
    n = len(starts) - 1
    place = np.arange(len(data)) + ORDER * (np.repeat(np.arange(n), np.diff(starts)) + 1)
    out = np.full(len(data) + ORDER * n, PAD, np.int64)
    out[place] = folded(data)
    return (out[place - 3] << 24) | (out[place - 2] << 16) | (out[place - 1] << 8) | out[place]


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` stand in sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(wanted.shape, -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Level:
    """Contexts of one length: counts by (context, byte, language), and by (context, language) what coding costs.

    ``own`` has the sum that counts are divided by and the bits of an escape
    where nothing is excluded; ``after`` the same of the next shorter context
    when this one has escaped to it.
    """

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    own: np.ndarray
    after: np.ndarray


@dataclass
class Model:
    """Frozen counts of all languages; ``levels[k]`` has contexts of k bytes, ``unseen`` bits of a byte new to a language."""

    langs: list[str]
    levels: list[Level] = field(default_factory=list)
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def gram_bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte in each language: (language, gram)."""
        lang = np.arange(len(self.langs))[:, None]
        shape = (len(self.langs), len(gram))
        bits, done, escaped = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape)
        longer = np.full(shape, -1)
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            node = find(level.contexts, ((gram >> 8) & ((1 << 8 * k) - 1)) << LANG_BITS | lang)
            at = find(level.grams, (gram & ((1 << 8 * (k + 1)) - 1)) << LANG_BITS | lang)
            count = np.where(at >= 0, level.counts[at], 0) if len(level.counts) else np.zeros(shape)
            costs = np.where((node >= 0)[..., None], level.own[node], 0) if len(level.own) else np.zeros((*shape, 2))
            if k < ORDER and len(self.levels[k + 1].after):
                costs = np.where((longer >= 0)[..., None], self.levels[k + 1].after[longer], costs)
            live = ~done & ((node >= 0) | (longer >= 0))
            hit = live & (count > 0)
            bits[hit] = escaped[hit] + np.log2(costs[hit][:, 0] / count[hit])
            done |= hit
            escaped += np.where(live & ~hit, costs[..., 1], 0)
            longer = node
        return np.where(done, bits, escaped + self.unseen[:, None])

    def bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(starts) - 1, len(self.langs)))
        if not len(data):
            return out
        uniq, where = np.unique(grams(data, starts), return_inverse=True)
        known, cost = self.__dict__.get("_kept", (np.zeros(0, np.int64), np.zeros((len(self.langs), 0))))
        if len(known) * len(self.langs) > KEPT:
            known, cost = known[:0], cost[:, :0]
        new = uniq[find(known, uniq) < 0]
        if len(new):
            step = max(1, (1 << 20) // len(self.langs))
            fresh = np.concatenate([self.gram_bits(new[at : at + step]) for at in range(0, len(new), step)], axis=1)
            known = np.concatenate((known, new))
            order = np.argsort(known, kind="stable")
            known, cost = known[order], np.concatenate((cost, fresh), axis=1)[:, order]
            self.__dict__["_kept"] = known, cost
        where = np.searchsorted(known, uniq)[where]
        full = np.flatnonzero(np.diff(starts))
        for k in range(len(self.langs)):
            out[full, k] = np.add.reduceat(cost[k][where], starts[full])
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}


def build(langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model of ``tables[k]``: keys (gram of k + 1 bytes, language) and counts."""
    levels: list[Level] = []
    few = (1 << LANG_BITS) - 1
    unseen = np.full(len(langs), 8.0)
    for k, (keys, counts) in enumerate(tables):
        order = np.argsort(keys)
        keys, counts = keys[order].astype(np.int64), counts[order].astype(np.float64)
        lang = keys & few
        context = ((keys >> LANG_BITS) >> 8) << LANG_BITS | lang
        contexts, place = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(place, counts, len(contexts)), np.bincount(place, minlength=len(contexts)).astype(float)
        own = np.stack([total + kinds, np.log2((total + kinds) / np.maximum(kinds, 1))], axis=1)
        if k == 0:
            unseen[contexts & few] = np.log2(np.maximum(256 - kinds, 1))
            after = np.zeros_like(own)
        else:
            # Every byte seen here is seen in the shorter context too; without them, what is left there.
            below = levels[-1]
            shorter = find(below.contexts, ((contexts >> LANG_BITS) & ((1 << 8 * (k - 1)) - 1)) << LANG_BITS | (contexts & few))
            same = find(below.grams, ((keys >> LANG_BITS) & ((1 << 8 * k) - 1)) << LANG_BITS | lang)
            taken = np.bincount(place, below.counts[same], len(contexts)) if len(keys) else np.zeros(0)
            base = below.own[shorter] if len(shorter) else np.zeros((0, 2))
            below_kinds = base[:, 0] / np.exp2(base[:, 1])
            rest_kinds = np.maximum(np.round(below_kinds - kinds), 0)
            rest = np.maximum(np.round(base[:, 0] - below_kinds) - taken, 0) + rest_kinds
            after = np.stack([rest, np.where(rest_kinds > 0, np.log2(np.maximum(rest, 1) / np.maximum(rest_kinds, 1)), 0)], axis=1)
        levels.append(Level(keys, counts.astype(np.float32), contexts, own, after))
    return Model(langs, levels, unseen)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = 2500, all_docs: int = 100_000) -> Model:
    """A model of every language that has a labelled text."""
    spark = labelled.sparkSession
    rows = labelled.select(F.xxhash64(text).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    # One row a language; a text counts once, however many rows repeat it.
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if len(langs) >= 1 << LANG_BITS:
        raise ValueError(f"{len(langs)} languages")
    if not langs:
        return Model([])
    each = min(sample_docs, max(300, all_docs // len(langs)))
    numbered = spark.createDataFrame([(name, i, min(1 << 30, int(each / sizes[name] * (1 << 30)))) for i, name in enumerate(langs)], "lang string, number int, bound int")
    mine = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.col("bound")
    chosen = rows.join(F.broadcast(numbered), "lang").filter(mine).dropDuplicates(["number", "h"]).select("number", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE):
            data, starts = text_bytes(part.column(1))
            if not len(data):
                continue
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            owner = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
            keys, n = np.unique(grams(data, starts) << LANG_BITS | owner, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    few = (1 << LANG_BITS) - 1
    lang_of = F.col("key").bitwiseAND(few)
    counts = written(chosen.mapInArrow(tidy(counted), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    tables = []
    for k in range(ORDER + 1):
        gram = F.shiftright("key", LANG_BITS).bitwiseAND((1 << 8 * (k + 1)) - 1)
        level = counts if k == ORDER else counts.groupBy(F.shiftleft(gram, LANG_BITS).bitwiseOR(lang_of).alias("key")).agg(F.sum("n").alias("n"))
        if k == ORDER:
            context = F.shiftright("key", LANG_BITS + 8) * (1 << LANG_BITS) + lang_of
            used = counts.groupBy(context.alias("context")).agg(F.sum("n").alias("uses")).filter(F.col("uses") >= LEAST)
            level = counts.withColumn("context", context).join(used, "context").select("key", "n")
        # Bounded by the sample: at most as many as its bytes, a few tens of thousands a language.
        found = level.toPandas()
        tables.append((found["key"].to_numpy(np.int64), found["n"].to_numpy(np.float64)))
    return build(langs, tables)


def predict(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, lang_pred, score, bits_per_byte`` and, after the key, the columns in ``keep``.

    The score is the posterior under equal priors.
    """
    kept = documents.sparkSession.sparkContext.broadcast(model)
    names = [key, *keep]
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept.value
        for part in slices(batches, len(names), SLICE):
            texts = part.column(len(names))
            data, starts = text_bytes(texts)
            letters = np.add.reduceat(np.append(LETTER[data], False), starts[:-1]) * (np.diff(starts) > 0)
            named = np.array([n > 0 or any(c.isalpha() for c in texts[i].as_py() or "") for i, n in enumerate(letters)])
            lang, score, rate = ["und"] * len(named), np.zeros(len(named)), np.zeros(len(named))
            if model.langs:
                bits = model.bits(data, starts)
                best = bits.argmin(1)
                sure = 1 / np.exp2(np.minimum(0, bits.min(1)[:, None] - bits)).sum(1)
                rate = bits.min(1) / np.maximum(np.diff(starts), 1)
                lang = [model.langs[b] if ok else "und" for b, ok in zip(best, named, strict=True)]
                score = np.where(named, sure, 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=[*names, "lang_pred", "score", "bits_per_byte"])

    columns = [F.col(c) for c in names] + [F.col(text).alias("_text")]
    return documents.select(*columns).mapInArrow(tidy(judge), f"{kinds}, lang_pred string, score double, bits_per_byte double")

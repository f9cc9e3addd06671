"""Near-duplicate documents: tensored minhash tables, exact verification, components.

Texts become sets of hashed shingles. Documents with equal sets fall together
first (by an aggregate, so copies in any number are cheap) and one of each class
goes on. Tensored banding: ``2 * BANDS`` keys of ``ROWS`` minhashes each are made
in two collections, and every pair of a key of the first with a key of the second
is the key of a table, so ``BANDS ** 2`` tables of ``2 * ROWS`` minhashes cost
``2 * BANDS * ROWS`` minhashes.

Within a table's bucket not all pairs are compared. Each document is first
compared with one hub of its bucket - the member that meets most others over all
tables; with ``STAR_ROUNDS`` over one, then others by hash - and verified links
join documents into components. What that leaves apart is settled exactly: of a bucket's
components, all members outside the largest are compared with all members of
other components, but for pairs that the sizes of their sets rule out, counted
without shingles that no other text of these buckets has and by bins. So no link between documents that share a bucket can join two
components unseen, and a group of copies takes comparisons in proportion to its
size. Signatures rule out pairs that agree in under ``LEAST_AGREE`` minhashes
(under half of the 85 percent that are to be found, 1e-6 by chance); all other
links are confirmed on full sets.

Components come from joins and minima with pointer jumping, in Spark, each round
written to the shared folder.

Buckets, components and classes that hold many rows are split by salt where rows
meet by them.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing; texts of under ``words`` words are one shingle; a null id is a document
of its own that is linked with nothing (its component is null) and kept; rows
that repeat an id are documents of their own, copies or not, and each has the
least id of its own component; other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, tidy
from millrace.session import drop_tables, tables, written

BANDS, ROWS = 8, 2
SIGNATURE = 2 * BANDS * ROWS
LEAST_AGREE = SIGNATURE // 2
STAR_ROUNDS = 1
#: Bins by which common shingles of two texts are bounded.
BINS = 16
#: Parts that the rows of one class or component are dealt to, and the rows that meet one hub's label.
SALTS, HUB_SALTS = 32, 8
#: Rows of a bucket that meet its hub in one part, and that meet others in one part.
HUB_ROWS, PAIR_ROWS = 5000, 2000


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_SHIFTS, _MASKS = _odd(64, 11), _odd(SIGNATURE, 12)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashed shingles of a text, sorted."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not data:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, data), np.uint64, len(data))
    width = min(words, len(data))
    total = np.full(len(data) - width + 1, width, np.uint64)
    for k in range(width):
        total += mixed(hashed[k : len(hashed) - width + 1 + k] * _SHIFTS[k % 64] + np.uint64(k))
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """Minhashes of a set."""
    out = np.empty(SIGNATURE, np.uint64)
    for at in range(0, SIGNATURE, 8):
        out[at : at + 8] = mixed(found[None, :] ^ _MASKS[at : at + 8, None]).min(1)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """``2 * BANDS`` keys of ``ROWS`` minhashes; the first half and the second half are paired."""
    parts = sig.reshape(2 * BANDS, ROWS)
    key = np.arange(2 * BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * _SHIFTS[k] + parts[:, k])
    return key


def signed(documents: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``id, h, n_shingles, class_key, sig, bands`` of every row; ``h`` is the text's hash, empty sets have null beyond the count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            rows = []
            for t in part.column(2).to_pylist():
                s = shingles(t, words)
                if len(s):
                    sig = signature(s)
                    rows.append((len(s), xxhash.xxh128_hexdigest(s.tobytes()), (sig >> np.uint64(32)).astype(np.uint32).view(np.int32), band_keys(sig).view(np.int64)))
                else:
                    rows.append((0, None, None, None))
            n, cls, sig, bands = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.string()), pa.array(sig, pa.list_(pa.int32())), pa.array(bands, pa.list_(pa.int64()))], names=["id", "h", "n_shingles", "class_key", "sig", "bands"])

    return keyed(documents, key, text).mapInArrow(tidy(work), "id bigint, h bigint, n_shingles bigint, class_key string, sig array<int>, bands array<bigint>")


def keyed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``id, h, text``; id and hash name a text."""
    return documents.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("h"), F.col(text).cast("string").alias("text"))


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """``id, shingles``: full sets of texts (id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sets = [shingles(t, words).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(tidy(work), "id bigint, shingles array<bigint>")


def salted(rows: DataFrame, by: str, parts: Column | int) -> DataFrame:
    """Adds ``salt``, 0 to ``parts - 1``, by a hash of column ``by``."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(parts) if isinstance(parts, int) else parts).cast("int"))


def for_all_salts(rows: DataFrame, parts: Column | int) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), (F.lit(parts) if isinstance(parts, int) else parts).cast("int") - 1)))


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of all ids in ``links`` (a, b): the least id that can be reached."""
    both = salted(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "a", HUB_SALTS)
    spark, held = links.sparkSession, tables(links.sparkSession)
    both = written(both, "both")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("low", "id").alias("component"))
    labels = written(labels, "labels")
    while True:
        # A hub's label meets its neighbours in several parts.
        seen = for_all_salts(labels.select(F.col("id").alias("b"), "component"), HUB_SALTS)
        near = both.join(seen, ["b", "salt"]).groupBy("a").agg(F.min("component").alias("seen"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("before"), F.least("component", "seen").alias("component"))
        # Labels are looked up once each; a large component's members then find theirs by label and salt.
        up = step.select(F.col("id").alias("component"), F.col("component").alias("higher"))
        roots = for_all_salts(step.select("component").distinct().join(up, "component"), SALTS)
        jumped = salted(step, "id", SALTS).join(roots, ["component", "salt"], "left").select("id", "before", F.least("component", "higher").alias("component"))
        jumped = written(jumped, "labels")
        labels = jumped.select("id", "component")
        if jumped.filter("component < before").isEmpty():
            drop_tables(spark, [path for path in tables(spark)[:-1] if path not in held])
            return labels


class Verifier:
    """Confirms pairs of ids on full sets, by signatures first."""

    def __init__(self, signs: DataFrame, sets: DataFrame, share: int):
        self.signs, self.sets, self.share = signs, sets, share

    def _possible(self, pairs: DataFrame) -> DataFrame:
        side = lambda c: self.signs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        sized = 100 * F.least("n_a", "n_b") >= self.share * F.greatest("n_a", "n_b")
        return met.filter(sized & (agree >= LEAST_AGREE)).select("a", "b")

    def able(self, placed: DataFrame) -> DataFrame:
        """``placed`` (bucket, id, component, main) without rows that nothing in their bucket can match.

        Adds ``n_shingles``, ``core``, how many shingles of a document any other
        document of ``placed`` has, and ``bins``, how many of these are in each
        bin by hash: two texts have no more in common than the sum over bins of
        the smaller count. A document goes if its core is too small for the shortest text of its
        bucket, which empties buckets whose texts share one passage or differ
        from one original in many places. No link is lost.
        """
        ids = placed.select("id").distinct()
        held = self.sets.join(ids, "id").select("id", F.explode("shingles").alias("shingle"))
        bins = F.array(*(F.count_if(F.pmod("shingle", F.lit(BINS)) == k).cast("int") for k in range(BINS)))
        single = held.groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").groupBy("id").agg(F.count("*").alias("alone"), bins.alias("alone_bins"))
        binned = held.groupBy("id").agg(bins.alias("bins")).join(single, "id", "left")
        core = binned.select("id", F.coalesce("alone", F.lit(0)).alias("alone"), F.coalesce(F.zip_with("bins", "alone_bins", lambda x, y: x - y), F.col("bins")).alias("bins"))
        sizes = self.signs.select("id", "n_shingles", "bands").join(core, "id").select("id", "n_shingles", "bands", "bins", (F.col("n_shingles") - F.col("alone")).alias("core"))
        sized = placed.join(sizes, "id")
        shortest = sized.groupBy("bucket").agg(F.min("n_shingles").alias("shortest"))
        other = F.greatest("core", "shortest")
        fit = sized.join(shortest, "bucket").filter(100 * F.col("core") >= self.share * (F.col("n_shingles") + other - F.col("core")))
        open_buckets = fit.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / PAIR_ROWS).alias("parts")).filter("low < high").select("bucket", "parts")
        return written(fit.join(open_buckets, "bucket").select("bucket", "parts", "id", "component", "main", "n_shingles", "core", "bands", "bins"), "able")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a < b) whose sets are similar enough, written to the shared folder."""
        side = lambda c: self.sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
        met = self._possible(pairs).join(side("a"), "a").join(side("b"), "b")
        inter = F.size(F.array_intersect("set_a", "set_b"))
        close = 100 * inter >= self.share * (F.size("set_a") + F.size("set_b") - inter)
        return written(met.filter(close).select("a", "b"), "links")


def ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def linked_components(texts: DataFrame, signs: DataFrame, words: int, share: int) -> DataFrame:
    """``id, component`` of the ids in ``signs`` (one of each class) that have links.

    ``signs`` names each class's text by ``low``, a struct of document id and
    hash, under which it stands in ``texts`` (id, h, text).
    """
    spark, held = texts.sparkSession, tables(texts.sparkSession)
    i = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    first = signs.select("id", "bands", i.alias("i")).select("id", "bands", "i", F.explode(F.sequence(F.lit(BANDS), F.lit(2 * BANDS - 1))).alias("j"))
    keyed = first.select("id", F.xxhash64(F.get("bands", F.col("i")), F.get("bands", F.col("j"))).alias("bucket"))
    # Buckets of one leave here, before rows meet again.
    shared = keyed.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).filter("low < high").select("bucket", "size")
    members = written(keyed.join(shared, "bucket"), "members")
    met = written(members.groupBy("id").agg(F.sum("size").alias("met")), "met")
    wanted = signs.join(met.select("id"), "id", "left_semi").select(F.col("id").alias("class_id"), F.col("low.id").alias("id"), F.col("low.h").alias("h"))
    chosen = texts.join(wanted, ["id", "h"]).select(F.col("class_id").alias("id"), "text").dropDuplicates(["id"])
    check = Verifier(signs.join(met.select("id"), "id", "left_semi").select("id", "sig", "n_shingles", "bands"), written(sets_of(chosen, words), "sets"), share)

    links = labels = tried = None
    open_members = members.join(met, "id").select("bucket", "size", "id", "met")
    for number in range(STAR_ROUNDS + 1):
        if labels is None:
            placed = open_members.withColumn("component", F.col("id"))
        else:
            placed = open_members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
            parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
            main = parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("bucket", "main")
            placed = written(placed.join(main, "bucket"), "placed")
            open_members = placed.select("bucket", "size", "id", "met")
            if placed.isEmpty():
                break
        if number < STAR_ROUNDS:
            # The first hub is the member that meets most; later ones are drawn from the largest component.
            rank = F.struct("met", (-F.col("id")).alias("low")) if labels is None else F.struct((F.col("component") == F.col("main")).alias("in_main"), F.xxhash64("id", F.lit(number)).alias("low"))
            parts = F.floor(F.col("size") / HUB_ROWS) + 1
            hubs = for_all_salts(placed.groupBy("bucket", "size").agg(F.max_by(F.struct("id", "component"), rank).alias("hub")), parts).drop("size")
            pairs = salted(placed, "id", parts).join(hubs, ["bucket", "salt"]).filter(F.col("component") != F.col("hub.component")).select(*ordered(F.col("id"), F.col("hub.id")))
        else:
            rest = check.able(placed)
            side = lambda c: rest.select("bucket", F.col("parts").alias(f"parts_{c}"), F.col("id").alias(f"id_{c}"), F.col("component").alias(f"of_{c}"), F.col("main").alias(f"main_{c}"), F.col("n_shingles").alias(f"n_{c}"), F.col("core").alias(f"core_{c}"), *(F.get("bands", F.lit(k)).alias(f"band{k}_{c}") for k in range(2 * BANDS)), *(F.get("bins", F.lit(k)).alias(f"bin{k}_{c}") for k in range(BINS)))
            # A pair comes from the first bucket that both are in, once.
            first = lambda low, high: F.coalesce(*(F.when(F.col(f"band{k}_x") == F.col(f"band{k}_y"), F.col(f"band{k}_x")) for k in range(low, high)))
            once = F.xxhash64(first(0, BANDS), first(BANDS, 2 * BANDS)) == F.col("bucket")
            reach = F.least("core_x", "core_y")
            shared_bins = reduce(operator.add, (F.least(f"bin{k}_x", f"bin{k}_y") for k in range(BINS)))
            possible = lambda common: (100 + share) * common >= share * (F.col("n_x") + F.col("n_y"))
            x = salted(side("x").filter("of_x <> main_x"), "id_x", F.col("parts_x"))
            pairs = x.join(for_all_salts(side("y"), F.col("parts_y")), ["bucket", "salt"]).filter((F.col("of_x") != F.col("of_y")) & possible(reach) & possible(shared_bins) & once).select(*ordered(F.col("id_x"), F.col("id_y")))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        found = check.linked(pairs)
        if labels is not None and found.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionAll(pairs)
        links = found if links is None else links.unionAll(found)
        labels = components(links)
        last = tables(spark)[-1]
    drop_tables(spark, [path for path in tables(spark) if path not in held and path != last])
    return labels


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, share: int = 85) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row.

    Texts are linked if 100 times the common shingles reach ``share`` times all
    of both; ``kept`` marks the least id of each component.
    """
    rows = written(signed(documents, key, text, words), "signed")
    one = rows.filter("class_key is not null and id is not null").groupBy("class_key").agg(F.min(F.struct("id", "h")).alias("low"), F.min("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    # Classes are numbered in the table that is written, as two of them may have one least id.
    one = written(one.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    labels = linked_components(keyed(documents, key, text), one.select(F.col("class_id").alias("id"), "low", "n_shingles", "sig", "bands"), words, share)
    placed = one.select("class_key", "class_id", F.col("low.id").alias("low")).join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    least = for_all_salts(placed.filter("component is not null").groupBy("component").agg(F.min("low").alias("least")), SALTS)
    linked = salted(placed.filter("component is not null"), "class_id", SALTS).join(least, ["component", "salt"]).select("class_key", F.col("least").alias("component"))
    named = linked.unionAll(placed.filter("component is null").select("class_key", "low"))
    # Copies share a class key: salted, as one class may hold much of all rows.
    light = salted(rows.select("id", "h", "n_shingles", "class_key"), "id", SALTS)
    out = light.filter("class_key is not null and id is not null").join(for_all_salts(named, SALTS), ["class_key", "salt"]).select("id", "n_shingles", "component")
    alone = light.filter("class_key is null or id is null").select("id", "n_shingles", F.col("id").alias("component"))
    return out.unionAll(alone).select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))

"""Decontamination against a brute-force version that compares all alignments."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    """(doc, item) to the item's words and the most agreeing words of a run, where these are enough."""
    out = {}
    for d, text in docs:
        a = words_of(text)
        for i, item in items:
            b = words_of(item)
            n, best = len(b), 0
            width = min(13, n)
            for shift in range(-n + 1, len(a)) if n else ():
                same = [0 <= shift + k < len(a) and a[shift + k] == b[k] for k in range(n)]
                best = max(best, *(sum(same[k : k + width]) for k in range(n)))
            if n and best >= (n if n < 8 else -(-8 * width // 10)):
                out[d, i] = tuple(map(max, out.get((d, i), (0, 0)), (n, best)))
    return out


def found(spark, docs, items, **more):
    from millrace.llm import decontam

    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash")).withColumn("key", F.lit(0)).withColumn("w", F.lit(0))
    test = spark.createDataFrame(items, ITEMS).withColumn("pos", F.lit("clash"))
    return {(r.doc_id, r.item_id): (r.item_words, r.matched) for r in decontam.contaminated(df, test, **more).collect()}


@pytest.mark.parametrize("n", [8, 9, 10, 11, 12, 13])
def test_masks_fit_every_placement_of_changes(n):
    from millrace.llm import decontam

    changes = n - -(-8 * min(13, n) // 10)
    masks = decontam.masks_for([n]).values()
    for gone in combinations(range(n), changes):
        assert any(all(at + o not in gone for o in m) for m in masks for at in range(n - m[-1])), gone


@pytest.mark.parametrize("n,changes", [(13, 2), (15, 2), (20, 4), (8, 1), (10, 2), (12, 2), (5, 1)])
def test_all_placements_are_found(spark, n, changes):
    """Every placement of changes in an item, each in a document of its own, against brute force."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(n)]
    places = list(combinations(range(n), changes))
    docs = []
    for k, gone in enumerate(places if len(places) < 1500 else rng.sample(places, 1500)):
        docs.append((k, " ".join([word() for _ in range(k % 3)] + [word() if i in gone else w for i, w in enumerate(item)] + [word() for _ in range(k % 4)])))
    items = [(1, " ".join(item))]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    if n in (8, 10, 12, 13):
        assert len(want) == len(docs)


def test_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "and", *("".join(rng.choice("abcde") for _ in range(3)) for _ in range(4))])
    fill = lambda n: [word() for _ in range(n)]
    items = [(k, ", ".join(fill(n)).upper()) for k, n in enumerate((15, 30, 60, 9, 8, 5, 11, 3, 1, 13, 12))] + [(90, None), (91, ""), (92, " ,. "), (None, " ".join(fill(20))), (93, "the of"), (0, " ".join(fill(14)))]
    docs = []
    for k in range(260):
        body = words_of(rng.choice(items)[1])
        for _ in range(rng.randrange(4)):
            if body:
                body[rng.randrange(len(body))] = word()
        cut = rng.randrange(3) if rng.random() < 0.4 else 0
        docs.append((k, " ".join(fill(rng.randrange(30)) + body[cut : len(body) - rng.randrange(3) if cut else None] + fill(rng.randrange(30)))))
    docs += [(500, None), (501, ""), (None, docs[0][1]), (None, docs[9][1]), (7, docs[8][1]), (7, docs[7][1]), (7, docs[7][1]), (502, " ".join(fill(40_000) + words_of(items[1][1]) + fill(40_000)))]
    want = brute(docs[:-1], items)
    got = found(spark, docs, items)
    assert {k: v for k, v in got.items() if k[0] != 502} == want and got[502, 1] == (30, 13)
    assert found(spark, docs, items, limit=0) == got


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c")]) == {} and found(spark, [(1, "a b c")], []) == {}

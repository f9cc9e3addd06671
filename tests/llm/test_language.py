"""Language identification: code lengths step by step, held-out accuracy, many languages and scripts."""

import math
import pickle
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def labelled(spark, rows):
    return spark.createDataFrame([(i, t, name) for i, (t, name) in enumerate(rows)], "doc_id bigint, text string, lang string")


def test_held_out_accuracy(spark):
    from millrace.llm import langid

    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(0))
    model = langid.fit(df.filter("doc_id % 4 <> 2"))
    got = langid.predict(df.filter("doc_id % 4 = 2"), model).join(df.drop("score"), "doc_id")
    assert got.filter("lang_pred = lang").count() >= 0.97 * got.count()
    odd = docs_of(spark, [None, "", "12 34 !?", "日本", "the " * 50_000])
    found = langid.predict(odd, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found][:3] == ["und"] * 3 and [r.score for r in found][:3] == [0, 0, 0] and found[3].lang_pred != "und"
    kept = langid.predict(odd.withColumn("lang_pred_", F.lit("x")), model, keep=("text", "lang_pred_")).orderBy("doc_id").collect()
    assert [(r.text, r.lang_pred, r.score) for r in kept] == [(t.text, r.lang_pred, r.score) for t, r in zip(odd.collect(), found, strict=True)]
    none = langid.fit(labelled(spark, []))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def step_by_step(texts, text, order=3, least=4):
    """Bits of a text by method C with exclusion, from counts of the training texts."""
    from millrace.llm import langid

    fold = lambda t: b" " * order + langid.folded(np.frombuffer(t.encode(), np.uint8)).tobytes() if t else b""
    counts = [Counter() for _ in range(order + 1)]
    for t in map(fold, texts):
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[k][t[i - k : i], t[i]] += 1
    follow = {}
    for k in range(order + 1):
        for (context, byte), n in counts[k].items():
            follow.setdefault(context, {})[byte] = n
    total, data = 0.0, fold(text)
    for i in range(order, len(data)):
        excluded = set()
        for k in range(order, -1, -1):
            seen = follow.get(data[i - k : i], {})
            if k == order and sum(seen.values()) < least:
                continue
            left = {b: n for b, n in seen.items() if b not in excluded}
            whole = sum(left.values()) + len(left)
            if data[i] in left:
                total += math.log2(whole / left[data[i]])
                break
            if left:
                total += math.log2(whole / len(left))
            excluded |= set(seen)
        else:
            total += math.log2(max(1, 256 - len(excluded)))
    return total


def test_bits_against_step_by_step(spark):
    from millrace.llm import langid

    rng = random.Random(4)
    make = lambda chars: " ".join("".join(rng.choice(chars) for _ in range(rng.randrange(1, 6))) for _ in range(30))
    texts = {"a": [make("abcé") for _ in range(12)], "b": [make("bcdÉЖ") for _ in range(3)], "c": ["x"], "d": [""]}
    model = langid.fit(labelled(spark, [(t, name) for name, ts in texts.items() for t in ts]))
    assert model.langs == list("abcd")
    for text in ["abc bca", "Éd ЖЖ cb", "zzz", "x", "日", make("abcdé")]:
        data = np.frombuffer(text.encode(), np.uint8)
        got = model.bits(data, np.array([0, len(data)]))[0]
        assert np.allclose(got, [step_by_step(texts[name], text) for name in model.langs], atol=1e-3), text


def test_all_languages_and_scripts_are_learned(spark):
    """300 languages of several scripts, one with two rows only; the model stays small."""
    from millrace.llm import langid

    rng = random.Random(7)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцч", "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת", "กขคงจฉชซดตถทธนบปผพมยรลวส", "的一是不了人我在有他这中大来上国"]
    words = {f"l{k:03d}": ["".join(rng.choice(scripts[k % 6]) for _ in range(rng.randrange(2, 6))) for _ in range(30)] for k in range(300)}
    text = lambda name: " ".join(rng.choice(words[name]) for _ in range(60))
    rows = [(text(name), name) for name in words for _ in range(2 if name == "l299" else 5)]
    model = langid.fit(labelled(spark, rows))
    assert len(model.langs) == 300 and len(pickle.dumps(model)) < 40_000_000
    fresh = [(text(name), name) for name in words]
    got = [r.lang_pred for r in langid.predict(docs_of(spark, [t for t, _ in fresh]), model).orderBy("doc_id").collect()]
    assert sum(g == name for g, (_, name) in zip(got, fresh, strict=True)) >= 297 and got[299] == "l299"


@pytest.mark.parametrize("keep", [0, 40])
def test_kept_code_lengths_change_nothing(spark, keep, monkeypatch):
    from millrace.llm import langid

    model = langid.fit(labelled(spark, [("abab abra cadabra", "x"), ("other words there", "y")] * 3))
    texts = [b"abra zab", b"other", "né".encode(), b"abra abra"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    whole = model.bits(data, starts)
    monkeypatch.setattr(langid, "KEPT", keep)
    fresh = pickle.loads(pickle.dumps(model))
    one = np.concatenate([fresh.bits(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts])
    assert np.allclose(whole, one)


def test_languages_whose_rows_share_an_id_are_learned(spark):
    from millrace.llm import langid

    df = lambda n, text, name: spark.range(n).select(F.lit(1 if name == "de" else None).cast("bigint").alias("doc_id"), text.alias("text"), F.lit(name).alias("lang"))
    many = df(6000, F.concat(F.lit("der hund und die katze "), F.col("id")), "de").unionAll(df(6000, F.lit("le chien et le chat"), "fr")).unionAll(df(200, F.concat(F.lit("the dog and the cat "), F.col("id")), "en"))
    model = langid.fit(many)
    asked = spark.createDataFrame([(1, "der hund und die katze"), (2, "le chien et le chat"), (3, "the dog and the cat")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["de", "fr", "en"] and all(r.bits_per_byte < 4 for r in got.values())
    once = langid.fit(many.distinct())
    assert all((a.contexts == b.contexts).all() and (a.counts == b.counts).all() for a, b in zip(model.levels, once.levels, strict=True))

"""The corpus pipeline: every stage by row, whole runs against what its rows hold."""

import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table_of(spark, rows):
    """Documents of (doc_id, text); those without a space have no language."""
    return spark.createDataFrame([(i, t, "en" if " " in (t or "") else None, None, None if t is None else len(t)) for i, t in rows], DOCS)


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


def pairs(rows):
    return sorted((i is None, i or 0, t or "") for i, t in rows)


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]


@pytest.fixture(scope="module")
def english(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' and length(text) between 300 and 2000").orderBy("doc_id").limit(60).collect()]


def test_whole_run(spark, tmp_path, english):
    import corpus_pipeline
    from millrace.session import tables

    rng = random.Random(12)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(25))
    texts = [*english, english[0], english[1] + " tail", f"{english[2][:200]} {item} {english[3][:200]}", None, "123 456", english[5][:150] + " password=abc123def456abc789 " + english[6][:300]]
    table_of(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "the")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    dropped = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs.withColumn("_row", F.lit("clash")).withColumn("_key", F.lit(1)), str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        dropped.append(before - {r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if k == 3:
            assert "[assign]" in docs.filter(F.col("doc_id") == len(texts) - 1).first().text
    n = len(english)
    assert dropped[0] == {n + 3, n + 4} and {n, n + 1} <= dropped[1] and dropped[2] == {n + 2} and not dropped[3] and not dropped[4]
    held = tables(spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    assert len(tables(spark)) == len(held) + 1  # the rows that the last stage reads


def test_language_goes_by_row(spark, english, monkeypatch):
    from millrace.llm import langid, stages

    rng = random.Random(3)
    noise = "".join(rng.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/#%&$!?") for _ in range(600))
    good = english[:20]
    rows = [(i, t) for i, t in enumerate(good)] + [(None, good[0]), (None, None), (3, None), (3, "12 34"), (4, noise), (None, noise), (7, ""), (8, good[1])]
    docs = table_of(spark, rows)
    out = stages.language(spark, docs, "")
    assert kept(out) == pairs([*enumerate(good), (None, good[0]), (8, good[1])])
    # At the threshold itself a text stays.
    model = langid.fit(docs.filter(~stages.held_out(F.col("doc_id"), 4, 2)))
    bits = max(r.bits_per_byte for r in langid.predict(table_of(spark, list(enumerate(good))), model).collect())
    monkeypatch.setattr(stages, "MAX_BITS", bits)
    assert stages.language(spark, docs, "").count() == len(good) + 2
    monkeypatch.setattr(stages, "MAX_BITS", bits - 1e-9)
    assert stages.language(spark, docs, "").count() < len(good) + 2
    assert stages.language(spark, docs.limit(0), "").count() == 0


def test_near_copies_go_by_row(spark):
    from millrace.llm import stages

    rng = random.Random(4)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    rows = [(5, a), (5, a), (5, a + " end"), (5, b), (None, b), (None, c), (None, c), (9, None), (9, ""), (9, ""), (8, d), (8, d), (2, d + " end")]
    out = stages.deduplicate(spark, table_of(spark, rows).repartition(3), "")
    got = kept(out)
    # One row of a, b, c and d each; texts without words are no copies of each other.
    assert len(got) == 7 and sum(t.startswith(a) for _, _, t in got) == 1
    assert (False, 5, b) in got and (True, 0, c) in got and (False, 2, d + " end") in got and sum(t == "" for _, _, t in got) == 3
    assert stages.deduplicate(spark, table_of(spark, []), "").count() == 0


def test_near_copies_from_80_percent(spark):
    from millrace.llm import stages

    rng = random.Random(21)
    texts = []
    for common in (82, 81, 80, 79) * 5:  # of 90 shingles each: similarity 0.837, 0.818, 0.8 and 0.782
        base = words(rng, 94)
        texts += [" ".join(base), " ".join(base[: common + 4] + words(rng, 90 - common))]
    got = stages.deduplicate(spark, table_of(spark, list(enumerate(texts))), "")
    assert {r.doc_id for r in got.collect()} == {i for i in range(len(texts)) if i % 2 == 0 or i % 8 == 7}


def test_contamination_goes_by_row(spark, tmp_path):
    from millrace.llm import stages

    rng = random.Random(5)
    item, clean = " ".join(words(rng, 20)), " ".join(words(rng, 40))
    bad = f"{clean} {item} tail"
    spark.createDataFrame([(1, item), (None, None), (2, "tail"), (3, clean[:7])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, bad), (1, clean), (None, bad), (None, clean), (2, None), (3, ""), (4, bad), (4, bad), (4, "tail of it")]
    got = stages.decontaminate(spark, table_of(spark, rows), str(tmp_path))
    assert kept(got) == pairs([(1, clean), (None, clean), (2, None), (3, ""), (4, "tail of it")])
    assert stages.decontaminate(spark, table_of(spark, []), str(tmp_path)).count() == 0


def test_secrets_and_pieces_keep_all_rows(spark):
    from millrace.llm import stages

    rows = [(1, "password=abc123def456"), (1, "password=abc123def456"), (None, "secret: zzz999yyy888 end"), (2, None), (3, ""), (3, "clean text")]
    got = stages.remove_secrets(spark, table_of(spark, rows), "")
    assert kept(got) == pairs([(1, "[assign]"), (1, "[assign]"), (None, "[assign] end"), (2, None), (3, ""), (3, "clean text")])
    coded = stages.encode(spark, got, "").collect()
    assert len(coded) == len(rows) and all(r.round_trip for r in coded) and "others" not in coded[0]
    assert stages.encode(spark, stages.remove_secrets(spark, table_of(spark, []), ""), "").count() == 0

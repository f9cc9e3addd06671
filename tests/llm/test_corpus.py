"""The corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def docs_of(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def empty(spark, schema):
    return spark.createDataFrame([], schema)


# chat


def chat_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seg", F.lit("clash"))


def test_chat_round_trip(spark):
    from millrace.llm import chat

    hard = ["\\### Assistant: </turn> ok", "", None, "\\", "###", "</turn>", "<</turn>\\\\", "é🦀\n### User: x", "x" * 200_000]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(hard)]
    rows += [(2, 0, "tool:</turn>", "hi"), (2, None, None, "first"), (2, 0, "tool:</turn>", "hi"), (None, 1, "assistant", "lost")]
    segments = chat.format_conversations(chat_rows(spark, rows))
    got = {r.conv_id: r for r in chat.read_back(segments, in_place=True).collect()}
    again = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert got == again and set(got) == {1, 2, None}
    want = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[: len(hard)])
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    learned = "".join(t or "" for _, _, r, t in rows[: len(hard)] if r == "assistant")
    assert got[1].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest() and got[1].loss_chars == len(learned)
    assert got[1].violations == 0 and got[2].violations == 3 and got[2].n_turns == 3
    assert got[2].turns_sha256 == hashlib.sha256(b"\nfirst\n" + b"tool:</turn>\nhi\n" * 2).hexdigest()
    whole = "".join(r.text for r in segments.filter("conv_id = 1").orderBy("seg").collect())
    assert got[1].formatted_chars == len(whole)


def test_no_control_string_is_left_in_a_text():
    from millrace.llm import chat

    t, rng = chat.Template(), random.Random(1)
    for text in ["###", "####", "#######", "\\###", "\\####\\", "</turn>", "\\</turn></turn>", "##", "<</turn", *("".join(rng.choice("#\\</turn>") for _ in range(30)) for _ in range(500))]:
        out = t.escape(text)
        assert "###" not in out and "</turn>" not in out and t.unescape(out) == text


def test_chat_empty(spark):
    from millrace.llm import chat

    assert chat.read_back(chat.format_conversations(empty(spark, "conv_id bigint, turn bigint, role string, text string"))).count() == 0


# nearest neighbours


def product(a, b):
    out = 0.0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        out += x * y
    return out


def brute_neighbours(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % 20 == 0:
            out[q] = sorted(((product(ok[q], ok[c]), -c) for c in ok if c != q), reverse=True)[:k]
    return out


@pytest.mark.parametrize("factor", [1.0, 0.6])
def test_nearest(spark, factor):
    from millrace.llm import ann

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.uniform(0.2, 3)]) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(300)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [float("nan")] + [1.0] * 7), (9005, [None] + [1.0] * 7), (9006, [float("inf")] * 8), (None, [1.0] * 8), (9007, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("v", F.lit(1)).withColumn("shard", F.lit(1))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10, factor=factor, shard_rows=700).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, -r.vec_id))
    want = brute_neighbours([x for x in rows if x[0] != 9007], 10)
    if factor == 1.0:
        assert got == want
    else:
        assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("scale", [1e-12, 1e-7, 1.0, 1e6, 1e12])
def test_nearest_at_any_scale(spark, scale):
    """Ranks are those of the exact products, however small or large, in many blocks and shards."""
    from millrace.llm import ann

    rng = np.random.default_rng(11)
    rows = [(i, [float(x) * scale for x in rng.normal(size=6)]) for i in range(1200)] + [(2000 + i, [scale] * 6) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=12, shard_rows=300, block_queries=20, block_rows=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, -r.vec_id))
    assert got == brute_neighbours(rows, 12)


@pytest.mark.parametrize("scale", [2.0**530, 2.0**-530])
def test_nearest_where_products_leave_the_doubles(spark, scale):
    """Order and number of neighbours are those of the same vectors at another scale; scores are the doubles' products."""
    from millrace.llm import ann

    rng = np.random.default_rng(12)
    plain = rng.normal(size=(2000, 4))
    rows = [(i, [float(x) * scale for x in v]) for i, v in enumerate(plain)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score in (0.0, float("inf"), float("-inf")) or abs(r.score) < 1e-300 or np.isnan(r.score)
    want = {q: [-i for _, i in best] for q, best in brute_neighbours([(i, v.tolist()) for i, v in enumerate(plain)], 5).items()}
    assert got == want


def test_nearest_of_repeated_ids(spark):
    from millrace.llm import ann

    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.2]), (1, [0.4, 9.0]), (1, [0.5, 0.2])]
    got = [(r.rank, r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 9.0), (2, 1, 0.2), (3, 1, 0.2)]


def test_nearest_few(spark):
    from millrace.llm import ann

    schema = "vec_id bigint, embedding array<double>"
    assert ann.search(empty(spark, schema), F.col("vec_id") % 20 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], schema)
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 0.5)]


# urls


def test_urls(spark):
    from millrace.llm import urls
    from millrace.llm.queries import RULES

    link = lambda h: f'<a class="x" href="https://{h}/p">x</a>'
    rows = [
        (1, "https://A.Example.NET/en/x?q#f", None),
        (2, "http://sub.example.com/de/1", link("spam.test")),
        (3, "https://net", ""),
        (4, "https://net/", None),
        (5, None, "x"),
        (6, "no scheme", None),
        (7, "https://hub.test/a", link("bad.net") + link("spam.test")),
        (8, "https://good.org/fr/", link("friend.test")),
        (9, "https://friend.test", None),
        (10, "https://bad.net/", None),
        (11, "https://myexample.net/en/", None),
    ]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("rule", F.lit("clash")), RULES).collect()}
    assert len(got) == len(rows)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/de/", "block")
    assert (got[3].path, got[3].rule) == ("", None) and got[4].rule == "net/"
    assert (got[5].host, got[5].path, got[5].verdict) == ("", "", "allow") and got[6].host == ""
    assert got[7].verdict == "block" and got[7].distrust > 0
    assert got[9].verdict == "allow" and got[9].trust > 0
    assert got[11].rule == "net/"
    assert urls.judge(empty(spark, "page_id bigint, url string, html string"), RULES).count() == 0


def test_verdicts_by_salt(spark, monkeypatch):
    from millrace.llm import urls

    monkeypatch.setattr(urls, "FEW_HOSTS", 0)
    test_urls(spark)


def test_trust_of_hosts_without_links_stays_as_other_hosts_link(spark):
    from millrace.llm import urls

    rules = [urls.Rule("allow", "good.org"), urls.Rule("block", "bad.org")]
    pages = [(1, "http://good.org/", ""), (2, "http://bad.org/", None)]
    linked = pages + [(3, "http://c.org/", '<a href="http://d.org/">x</a>')]
    alone, other = ({r.host: (r.trust, r.distrust) for r in urls.host_verdicts(urls.with_rule(urls.split_url(spark.createDataFrame(rows, "page_id bigint, url string, html string")), rules)).collect()} for rows in (pages, linked))
    assert alone == other and alone["good.org"] == pytest.approx((0.15, 0))


def test_page_rank_against_iteration(spark):
    from millrace.llm import urls

    rng = random.Random(3)
    edges = {(rng.randrange(12), rng.randrange(12)): rng.randrange(1, 4) for _ in range(40)}
    edges = {k: v for k, v in edges.items() if k[0] != k[1]}
    seeds = {0: 1.0, 3: 0.5}
    df = spark.createDataFrame([(str(a), str(b), w) for (a, b), w in edges.items()], "src string, dst string, weight bigint")
    got = {r.host: r.score for r in urls.page_rank(df, spark.createDataFrame([(str(h), w) for h, w in seeds.items()], "host string, weight double"), rounds=7).collect()}
    rank = dict(seeds)
    for _ in range(7):
        new = {h: 0.15 * w for h, w in seeds.items()}
        for (a, b), w in edges.items():
            new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * w / sum(v for (x, _), v in edges.items() if x == a)
        rank = new
    assert {k: round(v, 9) for k, v in got.items()} == {str(k): round(v, 9) for k, v in rank.items()}


# quality


def test_quality(spark):
    from millrace.llm import quality
    from millrace.llm.common import held_out

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    apart = held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs.join(labels.filter(~apart), "doc_id"))
    got = quality.score(docs, model).filter(apart).join(labels, "doc_id")
    assert got.filter((F.col("score") >= 0.3) == (F.col("quality") == 1)).count() >= 0.95 * got.count()
    odd = docs_of(spark, [None, "", "a", "a " * 200_000]).withColumn("score", F.lit(9))
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    none = quality.fit(empty(spark, "doc_id bigint, text string, quality int"))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def slow_score(model, text):
    """A text's score word by word."""
    import zlib

    from millrace.llm import quality as q

    data = (text or "").encode()
    words = [zlib.crc32(w) % (q.BUCKETS // 2) for w in data.split()]
    shapes = [zlib.crc32(w) % (q.BUCKETS // 2) + q.BUCKETS // 2 for w in data.translate(q.SHAPE).split()]
    x = np.zeros(q.FEATURES)
    if words:
        for k, units in enumerate((words, sorted(set(words)), shapes)):
            x[k * q.WIDTH : (k + 1) * q.WIDTH] = sum(model.vectors[u].astype(float) for u in units) / len(units)
        x[3 * q.WIDTH :] = np.log1p(len(words)), sum(a == b for a, b in zip(words, words[1:])) / len(words), len(set(words)) / len(words), np.log1p(len(set(shapes))) / np.log1p(len(words))
    w1, b1, w2, b2 = model.layers
    hidden = [np.tanh(sum((x[i] - model.mean[i]) / model.scale[i] * w1[i, j] for i in range(q.FEATURES)) + b1[j]) for j in range(len(b1))]
    z = (sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]) / model.temperature
    return 1 / (1 + np.exp(-min(30, max(-30, z))))


def test_scores_against_word_by_word(spark):
    from millrace.llm import quality

    rng = random.Random(5)
    words = ["alpha", "Beta", "x1", "...", "été", "99"]
    rows = [(i, " ".join(rng.choice(words[i % 2 :: 2] + words[:2]) for _ in range(rng.randrange(40))), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.fit(df)
    odd = [*(t for _, t, _ in rows[:20]), None, "", "a a a", "\u00a0x"]
    got = [r.score for r in quality.score(docs_of(spark, odd), model).orderBy("doc_id").collect()]
    assert np.allclose(got, [slow_score(model, t) for t in odd], atol=1e-5)


@pytest.mark.parametrize("copies", [1, 3000])
def test_quality_of_few_or_repeated_labels(spark, copies):
    """Few labels, all on one side of the calibration split or of one id, give scores from 0 to 1."""
    from millrace.llm import quality

    odd = docs_of(spark, ["good text here", None, ""])
    for ids in ((1, 2), (3, 4), (5, 5), (7, 11), (None, None)):
        rows = [(ids[0], "good text here", 1, "c"), (ids[1], "bad bad", 0, "c")] * copies
        df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, label string").withColumn("key", F.lit(1))
        model = quality.fit(df, sample_docs=1000)
        assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())


# near duplicates


def brute_components(texts, share=85):
    sets = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates(spark):
    from millrace.llm import near_dup

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(150)]
    texts = [" ".join(base)] * 30
    for k in range(120):  # copies with up to five changes: links only near the original
        copy = base[:]
        for _ in range(k % 6):
            copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(rng.choice((8, 40)))]) for _ in range(60)]
    texts += [None, "", " \t ", "one two", "ONE\ttwo", "one  two three", "é É", "É É", "x " * 60_000, "x " * 50_000]
    df = docs_of(spark, texts).withColumn("id", F.lit("clash")).withColumn("bucket", F.lit(1)).repartition(5)
    got = {r.doc_id: r for r in near_dup.near_duplicates(df).collect()}
    want, sizes = brute_components(texts)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_near_duplicates_odd_tables(spark):
    from millrace.llm import near_dup

    assert near_dup.near_duplicates(empty(spark, "doc_id bigint, text string")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_near_duplicates_of_one_id_with_two_texts(spark):
    """Rows are documents of their own; each has the least id that its own text reaches."""
    from millrace.llm import near_dup

    rng = random.Random(3)
    a, b, c = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(3))
    rows = [(5, a), (5, b), (2, b + " end"), (7, a + " end"), (5, c), (5, None), (9, b)] + [(11, c)] * 200
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    count = lambda *want: sum((r.doc_id, r.component_id, r.kept) == want for r in got)
    # Of id 5: with a and with c it is the least, with b it is not, and without text it stands alone.
    assert len(got) == len(rows) and count(5, 5, True) == 3 and count(5, 2, False) == 1
    assert count(2, 2, True) == count(7, 5, False) == count(9, 2, False) == 1 and count(11, 5, False) == 200


def test_near_duplicates_in_split_buckets(spark, monkeypatch):
    """Buckets dealt to many parts give the same components."""
    from millrace.llm import near_dup

    monkeypatch.setattr(near_dup, "HUB_ROWS", 3)
    monkeypatch.setattr(near_dup, "PAIR_ROWS", 2)
    test_near_duplicates(spark)


def test_components(spark):
    from millrace.llm import near_dup

    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = {r.id: r.component for r in near_dup.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in parent}

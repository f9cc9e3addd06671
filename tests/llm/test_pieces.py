"""Segmentation into pieces against all segmentations, and round trips."""

import random
import time

import numpy as np
import pytest

TEXT = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def vocabulary():
    from millrace.llm import pieces
    from millrace.llm.queries import tokenizer_path

    return pieces.Vocabulary.load(tokenizer_path())


def test_round_trips(spark, vocabulary):
    from pyspark.sql import functions as F

    from millrace.llm import pieces

    rng = random.Random(1)
    texts = ["hello world", "", " ", None, "a  b\n\tc é ▁ 日本語 🦀🦀", "  lead and trail  ", "x" * 3_000, "The cat " * 20_000, "\x00\x01", "".join(rng.choice("abcDEF012日é") for _ in range(60_000)), "é▁" * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), TEXT).withColumn("ids", F.lit("clash"))
    coded = pieces.encode(df, vocabulary, n=4)
    rows = pieces.segmentations(coded).orderBy("doc_id").collect()
    assert all(r.round_trip for r in rows) and rows[3].n_pieces == 0 and rows[3].segmentations == []
    back = {r.doc_id: r.text for r in pieces.decode(coded, vocabulary).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    for r in rows:
        if texts[r.doc_id] is not None:
            assert r.segmentations[0] == r.ids and len(r.segmentations) == len(r.scores) and r.scores == sorted(r.scores, reverse=True)
            assert len({tuple(x) for x in r.segmentations}) == len(r.segmentations)
            assert all(vocabulary.decode(np.array(x)).decode() == texts[r.doc_id] for x in r.segmentations)
    assert pieces.encode(df.limit(0), vocabulary).count() == 0


def spelled_out(encoder, text):
    """Scores and ids (as bytes) of a text's best segmentations."""
    ((best, scores, others),) = encoder.encode([text])
    out = [best.tobytes()]
    for edits in others:
        ids = best.tobytes()
        for at, drop, instead in edits:
            ids = ids[: 4 * at] + instead + ids[4 * (at + drop) :]
        out.append(ids)
    return list(zip(scores, out, strict=True))


def all_paths(vocabulary, chunk):
    """Every segmentation of a chunk: (score, ids), best first."""
    lattice, out = vocabulary.lattice([b" " + chunk]), []

    def go(node, score, ids):
        if node == lattice.last[0]:
            out.append((score, ids))
        for e in np.flatnonzero(lattice.start == node):
            go(lattice.stop[e], score + lattice.score[e], (*ids, int(lattice.id[e])))

    go(lattice.first[0], 0.0, ())
    return sorted(out, reverse=True)


def test_n_best_against_all_segmentations(vocabulary):
    from millrace.llm import pieces

    for w in (b"hello", b"thering", "étion".encode(), b"a", b"zq", "日a".encode()):
        want = all_paths(vocabulary, w)
        got = vocabulary.lattice([b" " + w]).n_best(0, 6)
        assert np.allclose([s for s, _ in got], [s for s, _ in want[:6]]) and set(got) <= {(g, i) for g, _ in got for s, i in want if abs(s - g) < 1e-9}
        walk = pieces.Walk(vocabulary, b" " + w)
        assert np.allclose([s for s, _ in walk.n_best(6)], [s for s, _ in want[:6]])
    # Of a whole text: every combination of its chunks.
    sums = [(0.0, ())]
    for w in (b"hello", b"zing", b"a"):
        sums = sorted(((a + b, x + y) for a, x in sums for b, y in all_paths(vocabulary, w)), reverse=True)[:200]
    got = spelled_out(pieces.Encoder(vocabulary, 5), b"hello zing a")
    scores = {ids: s for s, ids in sums}
    assert np.allclose([s for s, _ in got], [s for s, _ in sums[:5]])
    assert all(abs(scores[tuple(np.frombuffer(b, np.int32).tolist())] - s) < 1e-9 for s, b in got)


def test_walk_and_lattice_agree(vocabulary, monkeypatch):
    from millrace.llm import pieces

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcthe é日▁🦀.,") for _ in range(200)).encode() for _ in range(30)]
    encoder = pieces.Encoder(vocabulary, 4)
    want = [[(round(s, 6), b) for s, b in spelled_out(encoder, t)] for t in texts]
    monkeypatch.setattr(pieces, "LONG", 3)
    encoder = pieces.Encoder(vocabulary, 4)
    got = [[(round(s, 6), b) for s, b in spelled_out(encoder, t)] for t in texts]
    assert [[s for s, _ in x] for x in got] == [[s for s, _ in x] for x in want] and [x[0][1] for x in got] == [x[0][1] for x in want]


def test_long_text_without_spaces_in_bounded_memory(vocabulary):
    import tracemalloc

    from millrace.llm import pieces

    rng = random.Random(2)
    text = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000)).encode()
    tracemalloc.start()
    began = time.time()
    got = spelled_out(pieces.Encoder(vocabulary, 4), text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 4 and all(vocabulary.decode(np.frombuffer(b, np.int32)) == text for _, b in got)
    assert peak < 400 * len(text) and time.time() - began < 120

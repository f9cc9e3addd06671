"""Secret scans: base patterns by brute force, the chain against all paths, and planted secrets."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def field(spark):
    from millrace.llm import secret_scan as z

    return z.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def base_of(text):
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [s for _, _, s in sorted(found)]


def test_base_spans_against_brute_force(spark, field):
    from millrace.llm import secret_scan as z

    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"words here password={hexes(18)} and mail user{i}@mail7.example.com then" for i in range(30)] + [f"plain text number 2024-01-{i:02d} file part-{i:05d}-x1.parquet" for i in range(30)]
    texts += [None, "", " ", "\n\n", 'PassWord: "abc"', "paſſword=abcdef12", "é🦀 Token = 'abcdefg' AKIA" + "A1" * 10, "secret=" + "a" * 300_000, "password=ab password=abcdefgh", hexes(24) + " " + hexes(23), "x " * 100_000 + "passphrase=" + "Zk3vQ9aQpTT8x"]
    df = docs_of(spark, texts).withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in z.digest(z.scan(df, field)).collect()}
    for i, t in enumerate(texts):
        want = base_of(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(got[i].spans.split(",")) | {""}
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
    assert got[len(texts) - 1].spans == "crf:200011:200024"
    clean = z.redact(docs_of(spark, texts).withColumn("n_chars", F.length("text").cast("bigint")), field).orderBy("doc_id").collect()
    assert clean[0].text.startswith("words here [assign] and mail") and clean[0].n_chars == len(clean[0].text)
    assert clean[30].text == texts[30] and clean[60].text is None and clean[61].text == ""
    assert z.fit(docs_of(spark, [])) is None and z.fit(docs_of(spark, [None, "", "no secret"])) is None
    assert z.scan(docs_of(spark, []), field).count() == 0 and z.redact(docs_of(spark, texts[:1]), None).first().text.startswith("words here [assign]")


def planted(rng, prose):
    of = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    both = LETTERS + LETTERS.upper()
    makes = {
        "letters": lambda: of(both, 14),
        "one digit": lambda: of(both, 9) + "7",
        "small": lambda: of(LETTERS, 12),
        "pin": lambda: of("0123456789", 8),
        "base62": lambda: of(both + "0123456789", 20),
        "groups": lambda: "-".join(of(both + "0123456789", 5) for _ in range(4)),
        "signs": lambda: of(both, 4) + "!" + of("0123456789", 3) + "$" + of(both, 4) + "#9",
    }
    for kind, make in makes.items():
        for intro in ("passphrase=", "credential: ", "pwd = ", 'signing key: "', "my key is "):
            head, value = rng.choice(prose) + " " + intro, make()
            yield kind, head + value + ('"' if intro.endswith('"') else "") + " " + rng.choice(prose), (len(head), len(head) + len(value))


def test_planted_secrets_that_the_patterns_miss(spark, field):
    """The chain finds whole secrets of makes and names beyond the patterns', and leaves clean texts alone."""
    from millrace.llm import secret_scan as z

    rng = random.Random(23)
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 300 and text not rlike '[0-9=]'").orderBy("doc_id").limit(60).collect()]
    cases = [c for _ in range(4) for c in planted(rng, prose)]
    got = {r.doc_id: r.spans for r in z.digest(z.scan(docs_of(spark, [t for _, t, _ in cases]), field)).collect()}
    assert not any(base_of(t) for _, t, _ in cases)
    exact = {}
    for i, (kind, _, (a, b)) in enumerate(cases):
        exact.setdefault(kind, []).append(f"crf:{a}:{b}" in got[i].split(","))
    rates = {k: sum(v) / len(v) for k, v in exact.items()}
    assert min(rates.values()) >= 0.6 and sum(map(sum, exact.values())) >= 0.85 * len(cases), rates
    clean = [*prose, "the pass over the mountain is closed, code review tomorrow", "we keep the key under the mat", "mail user9@mail7.example.com part-00012-x1.parquet", "see 2024-01-05 and 192.168.1.44, call 030 1234567", "a secret garden; the token ring is old", "password is required to login, the auth code expires"]
    spans = [r.spans for r in z.digest(z.scan(docs_of(spark, clean), field)).collect()]
    assert sum(map(bool, spans)) <= 1, [c for c, s in zip(clean, spans, strict=True) if s]


def test_secret_of_several_tokens_is_one_stretch(field):
    """The chain holds a secret of several tokens together, and nothing is inside without a begin before it."""
    from millrace.llm import secret_scan as z

    assert field.move[z.OUTSIDE, z.INSIDE] < -1e6 and abs(field.move[:2]).min() > 0.05
    s = z.Slice(pa.array(["passphrase=ab12-CD34-ef56 end"]))
    s.tokens()
    score = field.scores(s.features(field.pairs))
    tags = field.tags(score, s.chain, s.size)[0]
    assert tags.tolist().count(z.BEGIN) == 1 and tags.tolist().count(z.INSIDE) == 4


def a_field(rng, shift=0.0):
    from millrace.llm import secret_scan as z

    return z.Field((rng.normal(size=(z.BUCKETS, 3)) + [0, 0, shift]).astype(np.float32), (rng.normal(size=(3, 3)) / 2 + z.FORBIDDEN).astype(np.float32), np.ones((26, 26)))


def test_viterbi_against_all_paths():
    from millrace.llm import secret_scan as z

    rng = np.random.default_rng(2)
    field = a_field(rng)
    size = np.array([1, 2, 4, 6, 3])
    first = np.cumsum(size) - size
    score = field.scores(rng.integers(0, z.BUCKETS, (5, size.sum())))
    for tags, at, n in zip(field.tags(score, first, size), first, size, strict=True):

        def total(path, at=at):
            whole = (z.OUTSIDE, *path, z.OUTSIDE)
            return sum(float(score[at + i, t]) for i, t in enumerate(path)) + sum(float(field.move[a, b]) for a, b in zip(whole, whole[1:], strict=False))

        assert tuple(tags) == max(itertools.product(range(3), repeat=int(n)), key=total)


def test_undecided_chains_are_all_that_matter():
    from millrace.llm import secret_scan as z

    rng = np.random.default_rng(3)
    skipped = 0
    for _ in range(60):
        field = a_field(rng, 1.2)
        size = rng.integers(1, 5, 8)
        first = np.cumsum(size) - size
        score = field.scores(rng.integers(0, z.BUCKETS, (5, size.sum())))
        left = set(range(8)) - set(field.undecided(score, first).tolist())
        skipped += len(left)
        for k, tags in enumerate(field.tags(score, first, size)):
            assert k not in left or (tags == z.OUTSIDE).all()
    assert skipped > 30


def test_training_raises_the_likelihood_of_its_labels():
    from millrace.llm import secret_scan as z

    rng = np.random.default_rng(9)
    size = rng.integers(1, 9, 300)
    first = np.cumsum(size) - size
    kind = rng.integers(0, 4, size.sum())
    tags = np.full(len(kind), z.OUTSIDE)
    for a, n in zip(first, size, strict=True):
        for t in range(a, a + n):
            if kind[t] == 1:
                tags[t] = z.INSIDE if t > a and tags[t - 1] != z.OUTSIDE else z.BEGIN
    feats = np.stack([kind, np.zeros_like(kind)])
    field = z.train(feats, tags, first, np.ones((26, 26)))
    got = np.concatenate(field.tags(field.scores(feats), first, size))
    assert (got == tags).mean() > 0.98


def test_windows_change_nothing(spark, field, monkeypatch):
    """Long texts in parts give the spans of whole ones, but for the tokens beside a cut within a line."""
    from millrace.llm import secret_scan as z

    rng = random.Random(6)
    lines = [f"some words {k} passphrase={'Zk3vQ9aQp' + str(rng.randrange(1000))} é end of line" if k % 7 == 0 else "plain words 2024-01-05 " * rng.randrange(1, 6) for k in range(400)]
    texts = ["\n".join(lines), lines[0], "", None, "x" * 5000]
    want = z.all_spans(pa.array(texts), field)
    assert len(want[0]) == 58
    monkeypatch.setattr(z, "WINDOW", 700)
    assert z.all_spans(pa.array(texts), field) == want
    assert "".join(z.windows(texts[0])) == texts[0] and all(len(w) <= 700 for t in texts if t for w in z.windows(t))


def test_long_lines_and_chain_borders(spark, field):
    """A secret far on in a line of many tokens, and one over a chain's end, are found whole."""
    from millrace.llm import secret_scan as z

    for before in (z.CHAIN - 7, z.CHAIN - 4, z.CHAIN - 2, 3 * z.CHAIN + 5):
        head = "word " * before + "passphrase="
        value = "ab12-CD34-ef56-Gh78"
        (row,) = z.digest(z.scan(docs_of(spark, [head + value + " end"]), field)).collect()
        assert row.spans == f"crf:{len(head)}:{len(head) + len(value)}", before

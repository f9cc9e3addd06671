"""Archives, the filter audit and centroid clustering against brute force."""

import gzip
import hashlib
import random
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

# archives

PAGES = "page_id bigint, url string, html string"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, PAGES).withColumn("shard", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("key", F.lit("x"))


def hard_pages():
    long, other = "<p>é🦀</p>" * 100, "x" * 1500
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7 * 40)) for i in range(60)]
    rows += [(100 + i, None if i % 3 else "http://h/a\r\nb", long) for i in range(40)] + [(7, "http://z", long), (-5, "", long)]
    rows += [(139, "http://0", long), (139, "http://0", long), (139, None, long)]
    rows += [(None, "u", other), (None, "u", other), (None, None, other), (None, "v", None), (None, "v", None), (200, "w", ""), (200, "w", ""), (201, "big", "y" * 300_000)]
    return rows


def brute_archive(rows, least=1000):
    """Counts of (page, bytes, digest, type, refers) that are to come back."""
    by = {}
    for page, _, html in rows:
        by.setdefault(html or "", []).append(page)
    out = []
    for html, ids in by.items():
        data = html.encode()
        last = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            own = len(data) < least or (i == last and not kept)
            kept |= own and len(data) >= least
            out.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "response" if own else "revisit", str(None if own else last)))
    return sorted(out)


def seen(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in df.collect())


@pytest.mark.parametrize("few", [0, 250_000])
def test_archive_comes_back(spark, monkeypatch, few):
    from millrace.llm import warc
    from millrace.session import new_folder

    monkeypatch.setattr(warc, "FEW_FACTS", few)
    rows = hard_pages()
    folder = new_folder(spark, "warc")
    listed = warc.write(pages_of(spark, rows), folder, shard_bytes=20_000, roll_bytes=600).collect()
    assert len({r.shard for r in listed}) > 3 and len(listed) > len({r.shard for r in listed})
    back = warc.read(spark, folder, with_payload=True)
    assert seen(back) == brute_archive(rows)
    got = back.collect()
    assert len({r.record_id for r in got}) == len(got)
    want = {hashlib.sha1((h or "").encode()).hexdigest(): h or "" for _, _, h in rows}
    assert all(r.html == (want[r.payload_digest] if r.record_type == "response" else None) for r in got)
    assert {r.url for r in got if r.page_id == 100} == {"http://h/a%0D%0Ab"} and {r.url for r in got if r.page_id == -5} == {""}
    first = {r.page_id: r.url for r in got if r.record_type == "response"}
    assert first[139] == "http://0"  # the least url of the rows that repeat it


def test_archives_are_the_same_in_any_order(spark, tmp_path):
    from millrace.llm import warc

    rows, digests = hard_pages(), []
    for seed, parts in ((1, 1), (2, 5)):
        random.Random(seed).shuffle(rows)
        listed = warc.write(pages_of(spark, rows).repartition(parts), f"{tmp_path}/{seed}", shard_bytes=20_000, roll_bytes=600)
        digests.append({r.name: (r.sha256, r.records) for r in listed.collect()})
        assert sum(n for _, n in digests[-1].values()) == len(rows)
    assert digests[0] == digests[1]
    names = sorted(digests[0])
    text = b"".join(gzip.open(tmp_path / "1" / n).read() for n in names)
    assert text.count(b"WARC-Type: warcinfo") == len(names) and not list((tmp_path / "1").glob("_temporary*"))


def test_archive_commit(spark, tmp_path):
    from millrace.llm import warc

    folder = f"{tmp_path}/a"
    (tmp_path / "a" / "_temporary").mkdir(parents=True)
    (tmp_path / "a" / "part-00000-00009.warc.gz").write_bytes(b"of a lost attempt")
    with pytest.raises(Exception, match="_manifest"):
        warc.read(spark, folder)
    warc.write(pages_of(spark, hard_pages()), folder)
    assert seen(warc.read(spark, folder)) == brute_archive(hard_pages())
    with pytest.raises(OSError, match="commit"):
        warc.write(pages_of(spark, hard_pages()), folder)
    # Renames may be repeated, but never of a file that is not there.
    row = warc.manifest(spark, folder).first().asDict() | {"temporary": "_temporary/gone"}
    batch = pa.RecordBatch.from_pylist([row])
    warc._rename(folder, batch)
    with pytest.raises(FileNotFoundError):
        warc._rename(folder, pa.RecordBatch.from_pylist([row | {"name": "none"}]))
    file = tmp_path / "a" / row["name"]
    data = bytearray(file.read_bytes())
    file.write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut off|digest"):
        warc.read(spark, folder).collect()


def test_archive_of_nothing(spark, tmp_path):
    from millrace.llm import warc

    assert warc.write(spark.createDataFrame([], PAGES), f"{tmp_path}/none").count() == 0
    assert warc.read(spark, f"{tmp_path}/none").collect() == []


# filter audit


def brute_audit(docs, labels):
    """Counts by part, order and step, document by document."""
    rows = []
    for doc_id, text, lang in docs:
        t = text or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
        copy = doc_id is not None and any(o is not None and o < doc_id and (s or "") == t for o, s, _ in docs)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), copy]
        mine = [(q, x) for d, q, x in labels if d is not None and d == doc_id]
        rows.append((lang or "", fails, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = [0] * 5
        for order in permutations(range(5)):
            for step, f in enumerate(order):
                v = [0] * 6
                for p, fails, good, toxic in rows:
                    if p != part:
                        continue
                    gone = any(fails[k] for k in order[:step])
                    v[0] += not gone and not fails[f]
                    v[1] += fails[f] and not gone
                    v[2] += fails[f] and gone
                    v[3] += fails[f] and sum(fails) == 1
                    v[4] += fails[f] and not gone and good
                    v[5] += fails[f] and not gone and toxic
                shapley[f] += v[1]
                out[part, "".join("ABCDE"[k] for k in order), step + 1] = v
        for key in [k for k in out if k[0] == part]:
            out[key] = [*out[key], shapley["ABCDE".index(key[1][key[2] - 1])]]
    return out


def test_filter_audit(spark):
    from millrace.llm import filter_audit

    rng = random.Random(3)
    words = ["a", "b", "ab", "Ab", "ZZZ", "é", "🦀🦀", "x#y", "no gap", "\u0085"]
    texts = [None, "", " \t\n\v\f\r ", "A", "AAA#", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), " ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i % 99}" for i in range(200))]
    texts += [rng.choice([" ", "\t", "  "]).join(rng.choices(words, k=rng.randrange(400))) for _ in range(30)]
    texts += ["w " * 300_000, "B" * 300_000 + " b" * 300, "x" * 999 + "Z" * 31, "x" * 970 + "Z" * 30]
    docs = [(i if i % 11 else None, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)] + [(5, texts[5], "en"), (5, texts[5], "en"), (-3, texts[5], "de")]
    labels = [(i, rng.randrange(2), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("mask", F.lit("clash")).withColumn("part", F.lit(1))
    got = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("n", F.lit(9)))
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in got.collect()} == brute_audit(docs, labels)


def test_filter_audit_of_nothing(spark):
    from millrace.llm import filter_audit

    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(none, labels).collect() == []
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], none.schema), labels)
    assert one.count() == 600 and one.filter("part <> ''").count() == 0


def test_words_of_one_hash_are_told_apart(monkeypatch):
    from millrace.llm import filter_audit

    texts = ["aa bb aa cc", "", "b c a a c", "aaa aa a " * 9, "dd"]
    # All bytes weigh the same, so that words of one length share a hash.
    monkeypatch.setattr(filter_audit, "_BYTE", np.full(256, 3, np.uint64))
    monkeypatch.setattr(filter_audit, "WINDOW", 4)
    data, starts = filter_audit.text_bytes(pa.array(texts))
    begin, length, hashed = filter_audit.words_in(data, starts)
    owner = np.searchsorted(starts, begin, "right") - 1
    assert filter_audit.distinct_words(data, owner, begin, length, hashed, len(texts)).tolist() == [len(set(t.split())) for t in texts]
    masks = filter_audit.text_masks(pa.array(texts))
    assert [m >> 1 & 1 for m in masks.tolist()] == [100 * len(set(t.split())) < 50 * len(t.split()) for t in texts]


# centroids


def brute_clusters(rows, k, rounds, seed, width, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of, strict=True) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    return sorted((str(i), c, d, sum(e for _, e, b in found if b == c), sum(e for _, e, _ in found), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found)


def clusters(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


VECTORS = "vec_id bigint, embedding array<double>"


def test_centroids(spark):
    from millrace.llm import centroids

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).round(2).tolist()) for i in range(200)] + [(i, [float(i % 3), 0.0, -1.5]) for i in range(40)]
    rows += [(300, None), (301, []), (302, [1.0, 2.0]), (303, [1.0, None, 2.0]), (304, [1.0, float("nan"), 2.0]), (305, [float("-inf"), 1.0, 2.0]), (None, [0.1, 0.2, 0.3]), (None, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("clash")).withColumn("v", F.lit(1))
    got = centroids.cluster(df, k=8, rounds=4, seed=3, width=3, scale=16)
    assert clusters(got) == brute_clusters(rows, 8, 4, 3, 3, 16)


def test_centroids_of_few(spark):
    from millrace.llm import centroids

    rows = [(i, [0.5, -0.25]) for i in range(5)] + [(1, [3.0, 4.0]), (7, [1e30, 0.0])]
    got = centroids.cluster(spark.createDataFrame(rows, VECTORS), k=8, rounds=2, width=2)
    assert clusters(got) == brute_clusters(rows[:-1], 8, 2, 3, 2, 1024)  # the last one's distances fit no long
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize("pairs", [1, 50, 1 << 15])
def test_annulus_is_exact(monkeypatch, pairs):
    from millrace.llm import centroids

    monkeypatch.setattr(centroids, "PAIRS", pairs)
    rng = np.random.default_rng(4)
    for size in (3, 1000, 1 << 27):
        c = rng.integers(-size, size, (30, 4))
        c[20:25] = c[3]
        c[25:] = -c[5:10]  # equal norms
        v = np.vstack([rng.integers(-size, size, (300, 4)), c, (c[:10] + c[10:20]) // 2, np.zeros((1, 4), np.int64)])
        far = ((v[:, None, :] - c[None]) ** 2).sum(2)
        number, distance = centroids.Annulus(c).nearest(v)
        assert (number == far.argmin(1)).all() and (distance == far.min(1)).all()
        low, high = centroids.Annulus(c).ranges(v)
        assert (high - low).sum() < len(v) * len(c) and (high > low).all()

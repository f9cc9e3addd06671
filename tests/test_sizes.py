"""Steps that once grew faster than their tables: their results against brute force, and no plan that gathers a table."""

import random
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_prefixes_resolve_without_a_broadcast(spark):
    from millrace.operators import graph

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab:") for _ in range(n))
    ids = sorted({(s, text(rng.randrange(1, 7))) for s in (1, 2, 3, None) for _ in range(12)}, key=str)
    asked = [(s, r, p, x) for s in (1, 2, 3, 4, None) for r in range(30) for p in range(rng.randrange(1, 3)) for x in [rng.choice([text(rng.randrange(1, 5)), " " + text(3), " ", None])]]
    requests = spark.createDataFrame(asked, "scope int, request int, pos int, prefix string")
    found = graph.resolve_all(requests, spark.createDataFrame(ids + ids[:5], "scope int, id string"), "scope", "request")
    want = {}
    for s, r, _, x in asked:
        x = (x or "").strip()
        met = [i for t, i in ids if t == s and x and i.startswith(x)]
        want.setdefault((s, r), []).append(met[0] if len(met) == 1 else None)
    assert {(r.scope, r.request): r.ids for r in found.collect()} == {k: None if None in v else v for k, v in want.items()}
    assert "Broadcast" not in plan(found)


@pytest.mark.parametrize("name", ["branch_view", "group_view"])
def test_views_are_not_broadcast(spark, name):
    from millrace.plans import registry

    assert "Broadcast" not in plan(registry.queries()[name](spark, SF))


def test_texts_of_a_document_view_are_shuffled_by_outline(spark):
    from millrace.plans import registry

    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, focus#\d+L?(, rung#\d+)?, \d+", plan(registry.queries()["document_view"](spark, SF)))


def test_tails_send_events_of_any_time(spark, tmp_path):
    """Events behind the watermark are sent; a run closes by its latest time, which an earlier batch brought, and again behind its end."""
    from millrace.streaming import tails
    from millrace.plans.changes import _state_store

    batches = [
        [(1, 1, 100, "progress", "x"), (1, 2, 50, "status", "completed"), (2, 3, 400, "progress", "x")],
        [(1, 4, 10, "progress", "late"), (3, 5, 20, "status", "completed"), (4, 6, 395, "progress", "x")],
        [(4, 7, 30, "status", "completed"), (2, 8, 0, "progress", "x")],
    ]
    out = []
    with _state_store(spark):
        for batch in batches:
            df = spark.createDataFrame(batch, "run bigint, id bigint, at bigint, kind string, data string").withColumn("at", F.timestamp_seconds("at"))
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = tails.draining_tail(spark.readStream.schema(tails.EVENT).parquet(f"{tmp_path}/in"), idle_ms=10_000)
            stream.writeStream.foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    sent = lambda run: [(i, kind) for r, i, kind, _ in out if r == run]
    end = "stream-end"
    assert sent(1) == [(1, "progress"), (2, "status"), (2, end), (4, "progress"), (4, end)]
    assert sent(2) == [(3, "progress"), (8, "progress")]
    assert sent(3) == [(5, "status"), (5, end)]
    assert sent(4) == [(6, "progress"), (7, "status")]


def test_labels_are_found_as_they_are_written(spark):
    from millrace.operators import rules

    labels = ["B1", "B12", "B1.2", "B(1", "C+", "B3"]
    said = ["see B12, please", "AB1 and B1.2", "has B(1 here", "a C+", "B3"]
    found = rules.unassigned(spark.createDataFrame([(k, x) for k in (1, 2) for x in labels], "outline int, label string"), spark.createDataFrame([(1, x) for x in said], "outline int, message string"))
    assert {(r.outline, r.label) for r in found.collect()} == {(1, "B1"), *((2, x) for x in labels)}


@pytest.mark.parametrize("name", ["brief_checks", "evidence_scores"])
def test_parts_are_not_joined_for_each_core(spark, name):
    from millrace.plans import registry

    assert "REPARTITION_BY_NUM" in plan(registry.queries()[name](spark, SF))


def test_drafts_are_made_once(spark):
    from millrace.plans import registry

    assert "regexp_replace(text" not in plan(registry.queries()["repair_targets"](spark, SF))


def test_a_rebuild_parses_a_file_once(spark, tmp_path):
    from millrace.operators import code
    from millrace.sources import commits

    parsed = spark.sparkContext.accumulator(0)

    def symbols(files):
        def count(batches):
            for batch in batches:
                parsed.add(len(batch))
                yield batch

        return code.symbols(files.mapInPandas(count, files.schema))

    files = spark.createDataFrame([(f"a{k}.rs", f"fn a{k}() {{\n b();\n}}", "rust") for k in range(5)], "path string, content string, language string").withColumn("hash", F.sha2("content", 256))
    assert commits.rebuild(spark, files, str(tmp_path), "1", "one", symbols, code.edges, buckets=2) == 5
    assert parsed.value == 5 and commits.read(spark, str(tmp_path), "symbols", commits.SYMBOLS).count() == 5


def test_a_buffer_is_read_and_written_as_a_whole():
    import pandas as pd

    from millrace.streaming import tails

    class State:
        calls, value = 0, None

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value or []

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        put = update

    class Handle:
        def __getattr__(self, name):
            return lambda *a: State()

    buffer = tails.NewestEvents(20)
    buffer.init(Handle())
    for low in (0, 15):
        rows = pd.DataFrame({"id": range(low, low + 15), "kind": "p", "data": "x"})
        (out,) = buffer.handleInputRows((1,), iter([rows]), None)
    assert out["id"].tolist() == list(range(10, 30)) and set(out["missing"]) == {10} and buffer.held.calls == 4


def _said(rng, n, words=12):
    """Texts of few words, so that all share frequent word pairs; every fifth is an earlier one with a word changed."""
    texts = []
    for k in range(n):
        text = [f"word{rng.randrange(words)}" for _ in range(60)]
        if k % 5 == 4:
            text = texts[rng.randrange(k)].split(" ")
            text[rng.randrange(60)] = "other"
        texts.append(" ".join(text))
    return texts


def _alike(a, b):
    a, b = (set(zip(t.split(" "), t.split(" ")[1:])) for t in (a, b))
    return 100 * len(a & b) >= 90 * len(a | b)


def test_words_of_paragraphs_do_not_carry_their_outline(spark):
    """All tables of a run together are smaller than one with the outline's name at every word."""
    from millrace.operators import quality
    from millrace.session import tables

    rng, held = random.Random(9), tables(spark)
    texts = {f"{k}" * 300: _said(rng, 60) for k in (1, 2)}
    rows = [(o, s, "\n\n".join(t[s * 6 : s * 6 + 6])) for o, t in texts.items() for s in range(10)]
    found = quality.repeated_paragraphs(spark.createDataFrame(rows, "outline string, section int, markdown string"), "outline", most=99).collect()
    want = set()
    for o, t in texts.items():
        for y in range(60):
            firsts = [x for x in range(y) if _alike(t[x], t[y]) and not (x // 6 == y // 6 and y - x <= 1)]
            if firsts:
                want.add((o, y // 6, y % 6, firsts[0] // 6, firsts[0] % 6, t[firsts[0]] == t[y]))
    assert want and {tuple(r) for r in found} == want
    size = sum(spark.read.parquet(p).agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0] for p in tables(spark) if p not in held)
    assert size < sum(len(w) + len(o) for o, t in texts.items() for x in t for w in x.split(" "))


@pytest.mark.parametrize("bins", [1, 1 << 20])
def test_frequent_pairs_leave_few_candidates(spark, monkeypatch, bins):
    """Only blocks that are nearly alike are compared on their words; which bins pairs fall into loses none."""
    from millrace.operators import quality
    from millrace.session import tables

    monkeypatch.setattr(quality, "BINS", bins)
    monkeypatch.setattr(quality, "PAIR_BLOCKS", 7)
    held, texts = tables(spark), _said(random.Random(4), 150)
    found = quality.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text").collect()
    want = {(a, b) for b in range(150) for a in range(b) if texts[a] != texts[b] and _alike(texts[a], texts[b])}
    assert want and {(r.id_a, r.id_b) for r in found} == want
    (candidates,) = (p for p in tables(spark) if p not in held and "/candidates-" in p)
    assert len(want) <= spark.read.parquet(candidates).count() <= 2 * len(want)


def _shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_texts_without_near_copies_are_not_shuffled(spark):
    """What is shuffled to find near copies is much less than the texts; of equal ones the least id counts, wherever it stands."""
    from millrace.operators import quality

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(100)) for _ in range(200)]
    texts += [*texts[:50], f"{texts[7]} more", f"{texts[150]} more"]
    blocks = spark.createDataFrame([(len(texts) - k, t) for k, t in enumerate(texts)], "id bigint, text string")
    before = _shuffled(spark)
    found = quality.near_duplicates(blocks, "id", "text").collect()
    shuffled = _shuffled(spark) - before
    assert {tuple(r) for r in found} == {(2, len(texts) - 207, 99, 100), (1, len(texts) - 150, 99, 100)}
    assert shuffled < sum(map(len, texts)) / 2


@pytest.mark.parametrize("links", [1 << 18, 60, 0])
def test_small_scopes_are_walked_without_rounds(spark, monkeypatch, links):
    """Components of scopes of few links are found in the walk, of larger ones by joins; places are the same."""
    from millrace.operators import ordering
    from tests.test_reading import brute_order

    rounds, found_by_joins = [], ordering.components
    monkeypatch.setattr(ordering, "components", lambda df: rounds.append(df) or found_by_joins(df))
    monkeypatch.setattr(ordering, "LINKS", links)
    rng = random.Random(8)
    nodes = {s: list(range(n)) for s, n in (("a", 30), ("b", 12), ("c", 1), ("d", 200))}
    ties = {s: [(rng.choice(ns), rng.choice(ns), rng.choice([3, 5])) for _ in range(len(ns) * 3 // 4)] for s, ns in nodes.items()}
    named = spark.createDataFrame([(s, n) for s, ns in nodes.items() for n in [*ns, ns[0]]], "scope string, node int")
    found = ordering.graph_order(named, spark.createDataFrame([(s, *t) for s, ts in ties.items() for t in ts], "scope string, a int, b int, weight int")).collect()
    for s, ns in nodes.items():
        mine = sorted((r for r in found if r.scope == s), key=lambda r: r.place)
        assert [r.place for r in mine] == ns and [r.node for r in mine] == brute_order(ns, ties[s])
        assert [(r.component, r.step) for r in mine] == sorted((r.component, r.step) for r in mine)
        assert all(r.component == min(x.node for x in mine if x.component == r.component) for r in mine)
    assert len(rounds) == (links < 1 << 18)


def test_texts_are_cut_in_slices(monkeypatch):
    import pandas as pd

    from millrace.functions import markdown

    monkeypatch.setattr(markdown, "CUT_AT_ONCE", 20, raising=False)
    texts = ["a `b` c", None, "", "x" * 50, "```\nq\n```\n", "end"]
    out = list(markdown._pieces.func(iter([pd.Series(texts), pd.Series(texts[:1])])))
    assert ["".join(p["text"] for p in row) for part in out for row in part] == [t or "" for t in [*texts, texts[0]]]
    assert [len(part) for part in out] == [4, 2, 1]


def test_diagrams_are_counted_once(spark):
    from millrace.plans import registry

    assert "EvalPython" not in plan(registry.queries()["diagram_issues"](spark, SF))


def _fed(spark, folder, batches, start):
    """``start`` run on batches that arrive one after another; the last of them is run twice, as after a failure."""
    import glob
    import os

    for batch in batches:
        df = spark.createDataFrame(batch, "run bigint, id bigint, at double, kind string, data string").withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run = lambda: start(spark.readStream.schema("run bigint, id bigint, at timestamp, kind string, data string").parquet(f"{folder}/in"), f"{folder}/out")
        query = run()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"] == []
    for path in glob.glob(f"{folder}/out/checkpoint/commits/*{len(batches) - 1}*") + glob.glob(f"{folder}/out/checkpoint/commits/.*{len(batches) - 1}*"):
        os.remove(path)
    run().awaitTermination()


def test_a_batch_of_many_runs_is_drained_at_once(spark, tmp_path, monkeypatch):
    """No function and no store are called by run; events behind the mark are sent, repeats are not, and a run closes by its latest time."""
    from millrace.plans import registry
    from millrace.streaming import tails

    batches = [
        [(1, 1, 100.0, "progress", "x"), (1, 1, 100.0, "progress", "x"), (1, 2, 50.0, "status", "completed"), (2, 3, 400.0, "progress", "x"), (5, -4, 1.0, "status", "failed"), (6, 1, 389.0, "status", "completed")],
        [(1, 4, 10.0, "progress", "late"), (3, 5, 20.0, "status", "completed"), (4, 6, 395.0, "progress", "x"), (6, 2, 395.0, None, None)],
        [(4, 7, 30.0, "status", "completed"), (2, 8, 0.0, "progress", "x"), (1, 2, 50.0, "status", "completed")],
        [(1, 9, 405.0, "status", "running"), (5, 7, 404.999999, "status", "completed"), (6, 1, 389.0, "status", "completed")],
        [(1, 9, 405.0, "status", "running"), (2, 10, 415.0, "progress", "x"), (5, -4, 1.0, "status", "failed")],
    ]
    _fed(spark, str(tmp_path), batches, lambda events, folder: tails.drain(events, folder, idle_ms=10_000))
    rows = tails.sent(spark, f"{tmp_path}/out").collect()
    of = lambda run: sorted((r.id, r.kind or "") for r in rows if r.run == run)
    p, s, end = "progress", "status", "stream-end"
    assert of(1) == [(1, p), (2, s), (2, end), (4, p), (4, end), (9, s)] and of(2) == [(3, p), (8, p), (10, p)]
    assert of(3) == [(5, s), (5, end)] and of(4) == [(6, p), (7, s), (7, end)]
    assert of(5) == [(-4, s), (-4, end), (7, s), (7, end)] and of(6) == [(1, s), (1, end), (2, ""), (2, end)]
    monkeypatch.setattr(tails, "draining_tail", None)
    assert registry.queries()["run_tails"](spark, SF).count() > 0


def test_buffers_of_many_runs_are_held_at_once(spark, tmp_path, monkeypatch):
    """No function and no store are called by run; the events held and the count of those gone are as of all events at once."""
    from millrace.plans import registry
    from millrace.streaming import tails

    rng = random.Random(12)
    ids = sorted(rng.sample(range(-50, 1000), 90))
    rows = [(run, i, float(rng.randrange(99)), "p", f"{run} {i}") for i in ids for run in (1, 2) if run == 1 or i < 200] + [(3, 990, 0.0, None, None)]
    batches = [rows[k : k + 25] + rows[max(0, k - 3) : k] + rows[k : k + 2] for k in range(0, len(rows), 25)]
    _fed(spark, str(tmp_path), [rng.sample(b, len(b)) for b in batches], lambda events, folder: tails.keep_newest(events, folder, size=10))
    want = {}
    for run in (1, 2, 3):
        mine = sorted({(r[1], *r[3:]) for r in rows if r[0] == run}, key=lambda r: r[0])
        want |= {(run, *r, max(0, len(mine) - 10)): 1 for r in mine[-10:]}
    got = [tuple(r) for r in tails.buffers(spark, f"{tmp_path}/out").select("run", "id", "kind", "data", "missing").collect()]
    assert len(got) == len(want) and set(got) == set(want)
    monkeypatch.setattr(tails, "newest_events", None)
    assert registry.queries()["event_buffer"](spark, SF).count() > 0


def test_a_document_view_is_rendered_in_parts_of_its_outline(spark):
    """Sections of several parts rest on each other; all tables of a run together hold a section's text about once, not at each width."""
    from millrace.operators import views
    from millrace.session import tables
    from tests.test_reading import brute_document_view

    rng, held = random.Random(14), tables(spark)
    docs = {
        doc: [
            {"title": f"t{i}", "key_points": ["".join(rng.choices("abc é", k=rng.randrange(300))) for _ in range(rng.randrange(3))], "reader_question": "why?", "depends_on": sorted({rng.randrange(i) for _ in range(rng.randrange(2))} | ({i - n // 2} if i % 9 == 0 and i >= n // 2 else set())) if i else [], "diagrams": ["d" * 300] * rng.randrange(2), "out_of_scope": ["x"] * rng.randrange(2)}
            for i in range(n)
        ]
        for doc, n in ((1, 2 * views.PART + 41), (2, views.PART), (3, views.PART + 1), (4, 1))
    }
    rows = [(d, i, *s.values()) for d, ss in docs.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame([*rows, (None, *rows[0][1:])], "doc int, position int, title string, key_points array<string>, reader_question string, depends_on array<int>, diagrams array<string>, out_of_scope array<string>")
    got = {(r.doc, r.focus): (r.rung, r.view) for r in views.document_view(df, "doc", 1400).collect()}
    assert got == {(d, i): brute_document_view(ss, i, 1400) for d, ss in docs.items() for i in range(len(ss))}
    texts = lambda df: df.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    assert sum(texts(spark.read.parquet(p)) for p in tables(spark) if p not in held) < 2 * texts(df)

"""Operators without SQL: invariants and hand-worked cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import chunks, markdown, paths, text
from millrace.operators import code, graph, packing, rules, runs, sections, state
from millrace.sources import files
from millrace.streaming import events


@given(st.text(max_size=300), st.integers(4, 40), st.lists(st.integers(0, 600), max_size=8), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_cuts_lose_nothing(body, most, boundaries, least):
    data = body.encode("utf-8", "replace")
    pieces = chunks.cut(data, most, sorted(b for b in boundaries if b == len(data) or b < len(data) and data[b] & 0xC0 != 0x80), least)
    assert b"".join(pieces) == data and all(0 < len(p) <= most for p in pieces)
    for p in pieces:
        p.decode()


def test_chunks_end_at_lines_and_boundaries(spark):
    body = "a" * 11_989 + "\n" + "한" * 10
    got = spark.createDataFrame([(body,)], "t string").select(chunks.chunk_text(F.col("t")).alias("c")).first().c
    assert [len(c.content.encode()) for c in got] == [11_990, 30] and [(c.start_line, c.end_line) for c in got] == [(1, 1), (2, 2)]
    data = ("x" * 99 + "\n") * 200
    pieces = chunks.cut(data.encode(), 12_000, [3_000, 9_000], 4_000)
    assert [len(p) for p in pieces[:2]] == [9_000, 11_000]
    one = lambda t, n: spark.createDataFrame([(t,)], "t string").select(text.excerpt(F.col("t"), n).alias("x")).first().x
    assert one("short", 10) == "short" and one("é" * 50, 5) == "" and len(one("é" * 500, 101).encode()) <= 101


def test_paths(spark):
    rows = [("a/Cargo.lock", "lockfile"), ("x.min.js", "minified"), ("y_pb2.py", "generated"), ("z.py", None), ("h.py", "generated")]
    df = spark.createDataFrame([(p, "// DO NOT EDIT" if p == "h.py" else "code", w) for p, w in rows], "path string, head string, want string")
    assert df.filter(~paths.reading_exclusion(F.col("path"), F.col("head")).eqNullSafe(F.col("want"))).count() == 0
    globs = spark.createDataFrame([("/r/src/a.py", True), ("/r/src/deep/b.py", True), ("/r/x.md", False), ("/r/src/skip/c.py", False)], "path string, want boolean")
    assert globs.filter(paths.matches_filters(F.col("path"), ["/r"], ["src/**/*.py"], ["src/skip/**"]) != F.col("want")).count() == 0


def test_names_label(spark):
    df = spark.createDataFrame([("see B1, please", True), ("AB1", False), ("B12", False), ("B1.2", False), ("B1", True)], "m string, want boolean")
    assert df.filter(text.names_label(F.col("m"), "B1") != F.col("want")).count() == 0


def test_links(spark):
    calls = spark.createDataFrame([("a.rs", "main", "helper")] * 3 + [("a.rs", "main", "both"), ("a.rs", "main", "own"), ("a.rs", "main", "none"), ("a.rs", "main", "many")], "file string, owner string, name string")
    places = [("b.rs", "helper"), ("a.rs", "own"), ("b.rs", "both"), ("c.rs", "both")] + [(f"f{i:03d}.rs", "many") for i in range(300)]
    got = {r.name: r for r in graph.resolve_links(calls, spark.createDataFrame(places, "file string, name string")).collect()}
    assert (got["helper"].kind, got["helper"].calls, got["helper"].candidates) == ("resolved", 3, "b.rs")
    assert (got["both"].kind, got["both"].candidates) == ("ambiguous", "b.rs,c.rs")
    assert got["own"].kind == "internal" and got["none"].kind == "unresolved"
    assert got["many"].candidates == "f000.rs,f001.rs,f002.rs,f003.rs"


def test_neighbourhood(spark):
    edges = spark.createDataFrame([("start", "validate"), ("validate", "store"), ("store", "validate")], "source string, target string")
    seeds = spark.createDataFrame([("validate",)], "id string")
    assert {r.id: r.score for r in graph.neighbourhood(seeds, edges).collect()} == {"validate": 1000, "store": 600, "start": 500}


def test_closure_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "parent bigint, node bigint")
    got = graph.tree_closure(edges)
    assert got.count() == 21 * 22 // 2 and got.agg(F.max("depth")).first()[0] == 20


def brute_pack(groups, limit):
    out, size, deferred = [], 0, 0
    for r in range(max(map(len, groups.values()))):
        for g in sorted(groups):
            if r < len(groups[g]):
                item, cost = groups[g][r]
                if item in out:
                    continue
                if size + cost <= limit:
                    out.append(item)
                    size += cost
                else:
                    deferred += 1
    return out, size, deferred


def brute_ration(groups, limit):
    size, at, stuck = 0, dict.fromkeys(groups, 0), set()
    progress = True
    while progress:
        progress = False
        for g in sorted(groups):
            if g in stuck or at[g] == len(groups[g]):
                continue
            if size + groups[g][at[g]][1] <= limit:
                size, progress = size + groups[g][at[g]][1], True
                at[g] += 1
            else:
                stuck.add(g)
    return at


def test_packing_rules_differ(spark):
    rng = random.Random(5)
    rows = []
    scopes = {}
    for scope in range(6):
        groups = {g: [(f"{g}{i % 5}", rng.randrange(1, 40)) for i in range(rng.randrange(1, 7))] for g in "abc"}
        scopes[scope] = groups
        rows += [(scope, g, i, item, cost) for g, items in groups.items() for i, (item, cost) in enumerate(items)]
    df = spark.createDataFrame(rows, "scope int, g string, i int, item string, cost bigint").repartition(3)
    packed = {r.scope: (r.ids, r.size, r.deferred) for r in packing.pack_round_robin(df, ["scope"], "g", "i", "cost", 90, "item").collect()}
    assert packed == {s: brute_pack(g, 90) for s, g in scopes.items()}
    shown = {(r.scope, r.g): (r.shown, r.omitted) for r in packing.ration(df, ["scope"], "g", "i", "cost", 90).collect()}
    for s, groups in scopes.items():
        want = brute_ration(groups, 90)
        assert {g: shown[s, g] for g in groups} == {g: (want[g], len(groups[g]) - want[g]) for g in groups}


def test_code(spark):
    body = "class A:\n    def save(self):\n        if ok(self):\n            self.store.put(1)\n\ndef top():\n    return save()\n"
    df = spark.createDataFrame([("m/a.py", body), ("b.rs", "pub fn go() { helper(); }\nfn helper() {}"), ("c.c", "static int run(int x) {\n  while (x) step(x);\n}")], "path string, content string")
    assert {(r.path, r.name, r.kind) for r in code.symbols(df).collect()} == {("m/a.py", "A", "type"), ("m/a.py", "save", "function"), ("m/a.py", "top", "function"), ("b.rs", "go", "function"), ("b.rs", "helper", "function"), ("c.c", "run", "function")}
    calls = {(r.owner, r.target) for r in code.edges(df).filter("kind = 'calls'").collect()}
    assert {("save", "ok"), ("save", "self.store.put"), ("top", "save"), ("go", "helper"), ("run", "step")} <= calls
    assert code.edges(df).filter("kind = 'branch'").count() == 2


def test_markdown(spark):
    body = "# One\n```\n# no [E:x]\n```\ntext [E:abc] `[E:no]`\n## Two"
    row = spark.createDataFrame([(body,), ("open\n```\ncode",)], "t string").select(markdown.headings(F.col("t")).alias("h"), markdown.citations(F.col("t")).alias("c"), markdown.has_unclosed_fence(F.col("t")).alias("u")).collect()
    assert row[0].h == ["# One", "## Two"] and row[0].c == ["abc"] and not row[0].u and row[1].u


def test_outlines(spark):
    rows = [("o", 0, "a", "Intro", []), ("o", 1, "b", "in  tro", [0]), ("o", 2, "b", "Intro ", [1, 1, 2]), ("o", 3, "d", "End", [1])]
    df = spark.createDataFrame(rows, "outline string, position int, id string, title string, depends_on array<int>")
    got = {(r.position, r.code) for r in sections.outline_issues(df).collect()}
    assert got == {(1, "duplicate_id"), (2, "duplicate_id"), (0, "duplicate_title"), (2, "duplicate_title"), (2, "forward_dependency"), (2, "repeated_dependency")}
    chain = df.filter("position <> 2")
    assert {(r.position, r.needs) for r in sections.prerequisites(chain).collect()} == {(1, 0), (3, 1), (3, 0)}
    assert [(r.position, r.depends_on) for r in sections.without_section(chain, 0).orderBy("position").collect()] == [(0, []), (2, [0])]
    parts = spark.createDataFrame([(0, 0, "x", []), (0, 1, "y", [0]), (1, 0, "z", []), (1, 1, "w", [0])], "part int, position int, title string, depends_on array<int>")
    assert [(r.position, r.depends_on) for r in sections.joined_outlines(parts).orderBy("position").collect()] == [(0, []), (1, [0]), (2, []), (3, [2])]


@given(st.integers(0, 500_000), st.integers(1, 150_000), st.integers(1024, 300_000), st.integers(100, 300))
@settings(max_examples=15, deadline=None)
def test_budget_never_passes_the_window(spark, overhead, output, context, density):
    row = spark.range(1).select(text.packing_limit(F.lit(context), F.lit(output), 10, F.lit(overhead), density).alias("room")).first()
    room = min(context, 200_000)
    assert row.room == 0 or (row.room + overhead) * 100 / density * 1.25 <= (room - output) * (density / 100) / (density / 100) + room


def test_state(spark):
    log = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "completed"), (1, 4, "running"), (2, 1, "running")], "run int, id int, status string")
    assert {(r.run, r.id) for r in events.invalid_transitions(log, "run", "id").collect()} == {(1, 4), (2, 1)}
    assert {(r.run, r.status) for r in state.latest_by_key(log, ["run"], ["id"]).collect()} == {(1, "running"), (2, "running")}


def test_stream_tail_resumes(spark, tmp_path):
    source, sink, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    first = spark.range(100).selectExpr("id", "id % 3 as run_id")
    first.write.parquet(source)
    read = lambda: events.read_events(spark, source, first.schema)
    events.tail(read(), sink, mark).awaitTermination()
    spark.range(100, 150).selectExpr("id", "id % 3 as run_id").write.mode("append").parquet(source)
    events.tail(read(), sink, mark).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(150))
    for _ in range(2):
        events.replay(read(), f"{tmp_path}/log", f"{tmp_path}/mark2", ["run_id"]).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, data in {"src/a.py": b"x = 1\n", "src/b.bin": b"a\0b", "src/c.txt": b"\xff\xfe\xff", "node_modules/d.js": b"y", "src/big.txt": b"z" * 300}.items():
        (tmp_path / name).write_bytes(data)
    got = files.snapshot(files.scan(spark, [str(tmp_path), str(tmp_path / "src")]), most=200)
    status = {r.path.rsplit("/", 1)[1]: (r.status, r.detail) for r in got.collect()}
    assert status["a.py"] == ("indexed", None) and status["d.js"][0] == "excluded"
    assert status["b.bin"] == ("skipped", "binary") and status["c.txt"] == ("skipped", "not valid UTF-8") and status["big.txt"] == ("skipped", "larger than the limit")
    assert files.counters(got).first().asDict() == {"indexed": 1, "excluded": 1, "skipped": 3}
    assert files.fingerprint(got, "v1").first()[0] == files.fingerprint(got.repartition(7), "v1").first()[0]


def test_sections_cite_known_ids(spark):
    rows = spark.createDataFrame([(1, "a [E:one]"), (2, "b [E:two] [E:one]"), (3, "c")], "section int, markdown string")
    got = {(r.section, r.code, r.detail) for r in sections.section_issues(rows, spark.createDataFrame([("one",)], "id string")).collect()}
    assert got == {(2, "unknown_citation", "two"), (3, "no_citation", "")}


@pytest.mark.parametrize("count,width,want", [(2, 3, [(0, 2)]), (3, 3, [(0, 3)]), (6, 3, [(0, 3), (2, 5), (4, 6)]), (4, 1, [(0, 2), (1, 3), (2, 4)])])
def test_windows_overlap(spark, count, width, want):
    from millrace.operators import quality

    df = spark.createDataFrame([(count,)], "n int")
    assert [(r.start, r.stop) for r in quality.windows(df, "n", width).orderBy("start").collect()] == want


def test_ownership_of_shared_leaves(spark):
    from millrace.operators import planning

    rng = random.Random(3)
    rows = [(s, leaf, c, rng.randrange(3)) for s in range(4) for leaf in range(12) for c in sorted(rng.sample(range(5), rng.randrange(1, 4)))]
    df = spark.createDataFrame(rows, "scope int, leaf int, section int, score int").repartition(3)
    want = {}
    for s in range(4):
        wins = {}
        for leaf in range(12):
            mine = [(c, x) for a, b, c, x in rows if (a, b) == (s, leaf)]
            best = [c for c, x in mine if x == max(y for _, y in mine)]
            pick = min(best, key=lambda c: (wins.get(c, 0), c))
            if len(mine) > 1:
                wins[pick] = wins.get(pick, 0) + 1
            want[s, leaf] = pick
    assert {(r.scope, r.leaf): r.section for r in planning.ownership(df, "scope").collect()} == want


@pytest.mark.parametrize(
    "given_text,want",
    [
        ('{"a": 1}', ('{"a":1}', None)),
        ('```json\n{"a": [1, 2]}\n```', ('{"a":[1,2]}', None)),
        ('note {"a": "}{"} more', ('{"a":"}{"}', None)),
        ('{"a": "say "hi" now"}', ('{"a":"say \\"hi\\" now"}', None)),
        ('{"a": "one\ntwo \\d"}', ('{"a":"one\\ntwo \\\\d"}', None)),
        ('{"a": "he said "yes", then left"}', ('{"a":"he said \\"yes\\", then left"}', None)),
        ('{"a": "use {type: "math"} and go", "b": ["x"]}', ('{"a":"use {type: \\"math\\"} and go","b":["x"]}', None)),
        ('{"a": "cut', (None, "truncated")),
        ("no object", (None, "invalid")),
        (None, (None, "empty")),
    ],
)
def test_json_repair(given_text, want):
    from millrace.functions import jsonfix

    assert jsonfix.decode(given_text) == want


@pytest.mark.parametrize(
    "given_text,want",
    [
        ('{"f": [1, {"a": 1}, nope, {"b": 2}', ['{"a":1}', '{"b":2}']),
        ('{"f": [{"a": "}"}, {bad}, {"c": {"d": "]"}}, {"e": "cut', ['{"a":"}"}', '{"c":{"d":"]"}}']),
        ('{"g": [{"x": 1}], "f": [{"a": 1}], "h": [{"b": 2}]}', ['{"a":1}']),
        ('{"f": [{"a": NaN}, {"a": 2}]}', ['{"a":2}']),
        ('{"f": [[1], {"a": 1}]}', []),  # the first bracket that closes outside an object ends the array
        ('{"f": "none"}', []),
        (None, []),
    ],
)
def test_complete_objects(given_text, want):
    from millrace.functions import jsonfix

    assert jsonfix.complete_objects(given_text, "f") == want


def test_json_repair_is_linear():
    from time import time

    from millrace.functions import jsonfix

    began = time()
    for text in ('{"a": "' + '" ' * 50_000 + '"}', '{"a": "' + '"' + " " * 100_000 + '"}', '{"a": "' + '"]' * 50_000 + 'x"}'):
        jsonfix.repaired(text)
    assert time() - began < 10


def test_context_view(spark):
    import json

    from millrace.operators import estimates

    rows = [(1, i, f"t{i}", "é" * n) for i, n in enumerate([10, 9000, 40_000])] + [(2, 0, "t", "x" * 30_000)]
    df = spark.createDataFrame(rows, "s int, i int, topic string, observation string")
    got = {(r.s, r.i): r for r in estimates.context_view(df, "s", "i", ["topic", "observation"]).collect()}
    sizes = {s: sum(len(r.view.encode()) for k, r in got.items() if k[0] == s) for s in (1, 2)}
    assert all(n <= 20_000 for n in sizes.values()) and [got[1, i].excerpted for i in range(3)] == [False, True, True] and got[2, 0].excerpted
    assert json.loads(got[1, 0].view) == {"topic": "t0", "observation": "é" * 10, "excerpted": False}


def test_reduction_work(spark):
    from millrace.operators import estimates

    def brute(n):
        work = 0
        while n > 1:
            work += n // 4 + (n % 4 > 1)
            n = -(-n // 4)
        return work

    got = spark.range(0, 3000).select("id", estimates.reduction_work(F.col("id")).alias("w")).collect()
    assert all(r.w == brute(r.id) for r in got)


def test_branch_level(spark):
    levels = spark.createDataFrame([("t", i, w) for i, w in enumerate([1, 5, 21, 82])] + [("one", 0, 1)], "tree string, level int, width int")
    at = lambda target: {r.tree: r.width for r in runs.branch_level(levels, "tree", F.lit(target)).collect()}
    assert at(64) == {"t": 82} and at(40) == {"t": 21} and at(13) == {"t": 21} and at(12) == {"t": 5}


def test_overlapping_findings_cross_blocks(spark):
    rng = random.Random(3)
    spans = lambda n: [(i, rng.choice("ab"), s, s + rng.randrange(0, 200)) for i in range(n) for s in [rng.randrange(0, 9000)]]
    cited, given_ = spans(60), spans(8)
    df = lambda rows: spark.createDataFrame(rows, "finding int, path string, start int, end int")
    got = {r.finding for r in runs.overlapping_findings(df(cited), df(given_).drop("finding")).collect()}
    assert got == {f for f, p, s, e in cited if any(p == q and s <= z and e >= a for _, q, a, z in given_)}


def test_settled_runs(spark):
    before = spark.createDataFrame([(1, "completed"), (2, "running"), (3, "queued")], "run int, status string")
    journal = spark.createDataFrame([(1, 1, "failed"), (2, 1, "failed"), (2, 2, "cancelled")], "run int, number int, status string")
    assert {r.run: r.status for r in runs.settle_status(before, journal).collect()} == {1: "completed", 2: "cancelled", 3: "queued"}


def passages_of(spark, rows):
    return spark.createDataFrame(rows, "scope string, id string, path string, start int, end int, content string")


def test_fit_shrinks_every_passage_and_keeps_all(spark):
    from millrace.operators import passages

    rows = [("a", f"chunk{i}", f"/project/module{i}.js", 1, 400, f"const marker{i} = 1;\n" + "  filler();\n" * 900) for i in range(6)] + [("b", "small", "/project/tiny.js", 1, 1, "export const ok = true;")]
    terms = F.array(F.lit("marker3"), F.lit("filler"))
    got = {r.path: r for r in passages.fit_evidence(passages_of(spark, rows), "scope", 12_000, terms).collect()}
    cut = [r for r in got.values() if r.scope == "a"]
    assert len(cut) == 6 and sum(len(r.content) + len(r.path) + 128 for r in cut) <= 12_000
    assert all(r.id != f"chunk{i}" and r.content in rows[i][5] and r.end - r.start + 1 == r.content.count("\n") for i, r in enumerate(sorted(cut, key=lambda r: r.path)))
    assert got["/project/tiny.js"].id == "small" and got["/project/tiny.js"].content == "export const ok = true;"


def test_excerpt_stands_where_the_code_matches():
    from millrace.operators.passages import focused

    content = "// note about read_result\n" * 120 + "if (action === 'read_result') {\n  updateView();\n}\n" + "other();\n" * 200
    skipped, found = focused(content, 600, ["read_result", "updateview"])
    assert "updateView" in found and len(found) <= 600 and content.split("\n")[skipped : skipped + found.count("\n")] == found.split("\n")[:-1]
    assert focused("short", 10, ["x"]) == (0, "short")
    body = "한글🦀" * 900
    assert len(focused(body, 601, ["글"])[1].encode()) <= 601


def test_retrieval_pack_respects_room_and_shares(spark):
    from millrace.operators import passages

    rows = [("s", f"i{k}", f"f{k}.rs", 1, 300, f"line {k};\n" * 300) for k in range(6)]
    df = passages_of(spark, rows).withColumn("tier", (F.substring("id", 2, 1).cast("int") >= 2).cast("int") * 2)
    got = passages.retrieval_pack(df, "scope", ["id"], "tier", 6_000, F.array(F.lit("line")), F.lit(4)).orderBy("path").collect()
    assert sum(len(r.content) + len(r.path) + 128 for r in got) <= 6_000
    assert all(len(r.content) <= 1_500 for r in got[:2]) and len(got[2].content) > 2_300 and [r.path for r in got] == [f"f{k}.rs" for k in range(len(got))]
    assert all(r.id != f"i{k}" for k, r in enumerate(got) if len(r.content) < 2_400)


def test_scope_records_counts_each_record(spark):
    rows = [(1, "a", 0, "x", 50), (1, "a", 1, "x", 50), (1, "b", 0, "x", 90), (1, "b", 1, "y", 10)]
    df = spark.createDataFrame(rows, "scope int, g string, i int, item string, cost int")
    got = {(r.g, r.item, r.place) for r in packing.scope_records(df, ["scope"], "g", "i", "cost", 110, "item").collect()}
    assert got == {("a", "x", 1), ("b", "x", None), ("a", "x", 2), ("b", "y", 3)}
    by_path = packing.pack_by_path(df.withColumn("item", F.concat("g", "i")), ["scope"], "g", "i", "cost", 200, "item").first()
    assert by_path.ids == ["a0", "b0", "a1", "b1"] and by_path.size == 200


@pytest.mark.parametrize(
    "body,want",
    [
        ("a `b` c", ["`b`"]),
        ("a `b c", []),
        ("a `b\n\nc` d", []),
        ("``a`b`` `c`", ["``a`b``", "`c`"]),
        ("\\`a` b`", ["` b`"]),
        ("~~~\n`x`\n```\n~~~\nend", ["~~~\n`x`\n```\n~~~\n"]),
        ("text\n    not code\n\n    code\n", ["    code\n"]),
        ("- item\n\n    still item\n", []),
        ("```\nopen", ["```\nopen"]),
    ],
)
def test_code_ranges(body, want):
    assert [body[a:b] for a, b in markdown.code_ranges(body)] == want


def test_cached_ingest_parses_only_what_is_new(spark, tmp_path):
    from millrace.plans.sources import generated_code, ingest_cached, ingest_generated

    files = generated_code(spark, 400, 100)
    fresh = lambda df: sorted((r.file, r.chunks, r.bytes, r.calls, r.resolved) for r in df.collect())
    folder = f"{tmp_path}/cache"
    once = fresh(ingest_cached(spark, files, folder))
    assert len(once) == 4 and once == fresh(ingest_cached(spark, files, folder))
    assert spark.read.parquet(f"{folder}/pieces").count() == 4
    changed = files.withColumn("content", F.when(F.col("path") == "src/gen_0.rs", F.concat("content", F.lit("\n"))).otherwise(F.col("content")))
    again = fresh(ingest_cached(spark, changed, folder))
    assert spark.read.parquet(f"{folder}/pieces").count() == 5 and [r[2] for r in again][0] == once[0][2] + 1 and [r[3:] for r in again] == [r[3:] for r in once]
    assert len(fresh(ingest_generated(spark, 10_000))) == 1


def test_prefixes_resolve_all_or_none(spark):
    from millrace.operators import graph

    ids = spark.createDataFrame([(1, "abc1"), (1, "abc2"), (1, "b"), (2, "abc9"), (1, "b")], "s int, id string")
    asked = [(1, 1, 0, "abc1"), (1, 1, 1, " b "), (1, 2, 0, "abc"), (1, 3, 0, "abc2"), (1, 3, 1, ""), (2, 1, 0, "a"), (2, 2, 0, "b"), (3, 1, 0, "a")]
    got = graph.resolve_all(spark.createDataFrame(asked, "s int, r int, pos int, prefix string"), ids, "s", "r")
    assert {(r.s, r.r): r.ids for r in got.collect()} == {(1, 1): ["abc1", "b"], (1, 2): None, (1, 3): None, (2, 1): ["abc9"], (2, 2): None, (3, 1): None}


def test_reservations_against_two_limits(spark):
    rows = [(1, 1, 60, 0.5), (1, 2, 50, 0.0), (1, 3, 40, 0.6), (1, 4, 40, 0.5), (1, 5, 0, 0.0000001), (2, 1, 100, 9.0)]
    df = spark.createDataFrame(rows, "run int, i int, tokens int, cost double")
    take = lambda most: {(r.run, r.i): (r.outcome, r.tokens_taken, r.cost_taken) for r in rules.budget_reservations(df, "run", "i", "tokens", "cost", 100, most).collect()}
    got = take(1.0)
    assert [got[1, i][0] for i in range(1, 6)] == ["accepted", "token budget", "cost budget", "accepted", "cost budget"]
    assert got[1, 4] == ("accepted", 100, 1_000_000) and got[2, 1] == ("cost budget", 0, 0) and take(0)[2, 1] == ("accepted", 100, 9_000_000)

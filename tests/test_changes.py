"""Repairs, ignore rules, commits and streams against brute force."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from millrace.functions import ignore
from millrace.operators import repair, scopes
from millrace.plans.changes import IGNORE, _state_store
from millrace.sources import commits
from millrace.streaming import tails


def test_ignore_rules_as_git_reads_them(spark, tmp_path):
    rng = random.Random(2)
    names = ["a.log", "keep.log", "b.md", "build", "x", "secret1 .txt", "docs", "en", "[z]", "ab", "a-b", "#c", "!d"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(500)} | {"docs/b.md", "docs/x/y/b.md", "x/docs/b.md"})
    rules = {**IGNORE, "x": "!keep.log\n/ab\n*.md\n!/x/b.md\n\\#c\n\\!d\n", "docs": "**/x\nx/**\n[!a]b\n\\[z]\na[^x-z]b\nx/*/ab\n  \ntrail   \n"}
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for folder, text in rules.items():
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / ".gitignore").write_text(text)
    # A path is a file or a folder; those that others stand in are folders.
    paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths) and not any(f == p or f.startswith(p + "/") for f in rules)]
    asked = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(paths).encode(), capture_output=True).stdout.decode().split("\0")
    held = spark.createDataFrame([(f"{k}/.gitignore".lstrip("/"), v) for k, v in rules.items()], "path string, content string")
    got = ignore.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), ignore.rules_of(held)).collect()
    assert len(got) == len(paths)
    assert {r.path for r in got if r.ignored} == {p for p in asked if p}


def test_phrases_are_located(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    parts = [(d, p, text(60)) for d in range(5) for p in range(20)] + [(0, 99, None)]
    phrases = [(d, text(rng.randrange(1, 6))) for d in range(4) for _ in range(15)] + [(3, "absent"), (9, "a")]
    got = repair.located(spark.createDataFrame(parts, "doc int, part int, text string"), spark.createDataFrame(phrases, "doc int, phrase string"), "doc", "part")
    assert {tuple(r) for r in got.collect()} == {(d, w, p) for d, w in phrases for e, p, t in parts if d == e and t and w in t}


def test_repair_targets(spark):
    drafts = {1: ["intro words here", "see [E:abcdef0123]", "```mermaid\na\n```\n```mermaid\nb\n```", "tail"], 2: ["only part of it"], 3: ["x", "y"], 4: ["x y z x y z", "other"]}
    messages = {1: ['wrong: "intro words"', "cites [E:abcdef01, E:zz]", 'MERMAID_INVALID: {"diagram": 2}', "owns 2 Mermaid diagram(s) in section_plan.diagrams but contains 1"], 2: ['"only part of"'], 4: ["nothing to find", '"x y z x y"']}
    parts = spark.createDataFrame([(d, i, t) for d, ts in drafts.items() for i, t in enumerate(ts)], "doc int, part int, text string")
    issues = spark.createDataFrame([(d, i, m) for d, ms in messages.items() for i, m in enumerate(ms)], "doc int, issue int, message string")
    got = {}
    for r in repair.repair_targets(parts, issues, "doc").collect():
        got.setdefault(r.doc, set()).add(r.target)
    assert got == {1: {0, 1, 2, 4}, 2: {None}, 3: {None}, 4: {None}}


def test_fallback(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True), (2, 2, True), (3, 1, None)], "s int, i int, out boolean")
    assert sorted((r.s, r.i) for r in scopes.with_fallback(rows, "s", "i", F.col("out")).collect()) == [(1, 2), (2, 1), (2, 2), (3, 1)]


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, "k int, v string")


def test_commits_show_all_or_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    shown = lambda name: sorted((r.k, r.v) for r in commits.read(spark, folder, name, "k int, v string").collect())
    assert commits.commit(spark, folder, {"a": rows_of(spark, (1, "x")), "b": rows_of(spark, (9, "y"))}, "one")
    assert not commits.commit(spark, folder, {"a": rows_of(spark, (1, "again"))}, "one")

    class Killed(Exception):
        pass

    with monkeypatch.context() as m:
        m.setattr(commits, "commits", lambda *a, seen=[], real=commits.commits: (seen.append(1), real(*a))[1] if len(seen) < 1 else (_ for _ in ()).throw(Killed()))  # noqa: B006
        with pytest.raises(Killed):
            commits.commit(spark, folder, {"a": rows_of(spark, (2, "lost")), "b": rows_of(spark, (2, "lost"))}, "two")
    assert shown("a") == [(1, "x")] and shown("b") == [(9, "y")] and shown("none") == []
    assert commits.commit(spark, folder, {"a": rows_of(spark, (2, "z"), (1, "new"))}, "two")
    assert sorted((r.k, r.v) for r in commits.latest(commits.read(spark, folder, "a", "k int, v string"), ["k"]).collect()) == [(1, "new"), (2, "z")]
    # A number that another writer takes meanwhile.
    stale = commits.commits(spark, folder).filter("number < 2")
    with monkeypatch.context() as m:
        m.setattr(commits, "commits", lambda *a, calls=[], real=commits.commits: (calls.append(1), stale if len(calls) < 3 else real(*a))[1])  # noqa: B006
        assert commits.commit(spark, folder, {"a": rows_of(spark, (3, "w"))}, "three")
    assert {r.number: r.id for r in commits.commits(spark, folder).collect()} == {1: "one", 2: "two", 3: "three"}


def test_changed_snapshots_stop_a_rebuild(spark, tmp_path):
    from millrace.operators import code

    files = spark.createDataFrame([("a.rs", "fn a() {\n b();\n}", "rust")], "path string, content string, language string").withColumn("hash", F.sha2("content", 256))
    build = lambda df, id: commits.rebuild(spark, df, str(tmp_path), "1", id, code.symbols, code.edges, buckets=2)
    with pytest.raises(ValueError, match=r"a\.rs"):
        build(files.withColumn("content", F.lit("fn b() {}")), "bad")
    assert commits.read(spark, str(tmp_path), "files", commits.FILES).count() == 0
    assert build(files, "good") == 1 and build(files, "same") == 0
    assert build(files.limit(0), "gone") == 0 and commits.read(spark, str(tmp_path), "symbols", commits.SYMBOLS).count() == 0


def streamed(spark, tmp_path, name, batches, make):
    """The rows that ``make`` sends of batches that arrive one after another."""
    source, out = f"{tmp_path}/{name}/in", []
    schema = tails.EVENT
    for batch in batches:
        rows = [(run, i, kind, data) for run, i, kind, data in batch]
        df = spark.createDataFrame(rows, "run bigint, id bigint, kind string, data string")
        df.select("run", "id", F.timestamp_seconds(F.col("id")).alias("at"), "kind", "data").coalesce(1).write.mode("append").parquet(source)

    def keep(df, number):
        out.extend((number, *r) for r in df.collect())

    with _state_store(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        made, mode = make(stream)
        made.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/{name}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return out


def test_tail_drains_and_closes(spark, tmp_path):
    progress = lambda run, i: (run, i, "progress", "x")
    batches = [
        [progress(1, 1), progress(1, 1), (1, 3, "status", "completed"), progress(2, 2)],
        [progress(1, 1), progress(1, 4), progress(2, 5)],  # a repeat, and an event behind the end
        [progress(2, 30)],
        [(1, 3, "status", "completed"), progress(2, 60)],  # a repeat after the end
        [(1, 61, "status", "running"), progress(2, 90)],  # a resumed run
    ]
    got = streamed(spark, tmp_path, "t", batches, lambda s: (tails.draining_tail(s, idle_ms=10_000, late="5 seconds"), "append"))
    sent = lambda run: [(i, k) for _, r, i, k, _ in got if r == run]
    assert sent(1) == [(1, "progress"), (3, "status"), (4, "progress"), (4, "stream-end"), (61, "status")]
    assert sent(2) == [(i, "progress") for i in (2, 5, 30, 60, 90)]


def test_buffer_is_the_same_in_one_batch_and_in_many(spark, tmp_path):
    rng = random.Random(6)
    ids = sorted(rng.sample(range(1000), 60))
    rows = [(1, i, "p", f"d{i}") for i in ids] + [(2, i, "p", "y") for i in ids[:3]]
    pieces = [rows[k : k + 9] + rows[max(0, k - 3) : k] for k in range(0, len(rows), 9)]
    last = {}
    for name, batches in (("one", [rng.sample(rows, len(rows)) + rows[:20]]), ("many", pieces)):
        out = {}
        for number, run, i, _, data, missing in streamed(spark, tmp_path, name, batches, lambda s: (tails.newest_events(s, 10), "update")):
            out.setdefault((run, number), []).append((i, data, missing))
        last[name] = {run: sorted(out[max(k for k in out if k[0] == run)]) for run in (1, 2)}
    assert last["one"] == last["many"] == {1: [(i, f"d{i}", 50) for i in ids[-10:]], 2: [(i, "y", 0) for i in ids[:3]]}

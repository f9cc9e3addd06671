"""Reading order and views against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordering, views


def brute_order(nodes, links):
    near = {n: {} for n in nodes}
    for a, b, w in links:
        if a != b:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    seen, out = set(), []
    for seed in sorted(nodes):
        stack = [] if seed in seen else [seed]
        seen.add(seed)
        while stack:
            n = stack.pop()
            out.append(n)
            fresh = [m for m in sorted(near[n], key=lambda m: (-near[n][m], m)) if m not in seen]
            seen.update(fresh)
            stack += fresh[::-1]
    return out


def test_graph_order(spark):
    rng = random.Random(5)
    nodes, links = {}, {}
    for scope, n, m in (("a", 60, 50), ("b", 40, 120), ("c", 5, 0), ("d", 300, 280)):
        nodes[scope] = list(range(n))
        links[scope] = [(rng.randrange(n), rng.randrange(n), rng.choice([3, 5, 5])) for _ in range(m)]
    links["b"] += [(0, k, 5) for k in range(1, 40)]  # a hub with ties
    df = spark.createDataFrame([(s, a, b, w) for s, rows in links.items() for a, b, w in rows], "scope string, a bigint, b bigint, weight bigint")
    found = ordering.graph_order(spark.createDataFrame([(s, n) for s, ns in nodes.items() for n in ns], "scope string, node bigint"), df)
    got = {}
    for r in ordering.placed(found, ["component", "step"], group=["scope"]).orderBy("scope", "place").collect():
        assert r.place == len(got.setdefault(r.scope, []))
        got[r.scope].append(r.node)
    assert got == {s: brute_order(nodes[s], links[s]) for s in nodes}


def test_places_of_a_whole_table(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7)
    assert all(r.x == r.place for r in ordering.placed(df, ["x"]).collect())
    assert ordering.placed(df.limit(0), ["x"]).count() == 0


def cut(text, n):
    data, gap = text.encode(), "\n[… excerpt …]\n"
    if len(data) <= n:
        return text
    room = n - len(gap.encode())
    if room < 0:
        return ""
    return data[: room // 2].decode(errors="ignore") + gap + data[len(data) - (room - room // 2) :].decode(errors="ignore")


def brute_document_view(sections, focus, budget):
    near, pending = set(), list(sections[focus]["depends_on"])
    while pending:
        i = pending.pop()
        if i not in near:
            near.add(i)
            pending += sections[i]["depends_on"]
    near |= {focus - 1, focus + 1}
    for rung, (near_bytes, other_bytes, reach) in enumerate(views.DOCUMENT_LADDER):
        out, gap = [], []

        def close(out=out, gap=gap):
            if gap:
                out.append({"omitted_sections": len(gap), "from": gap[0], "to": gap[-1]})
                gap.clear()

        for i, s in enumerate(sections):
            if reach is not None and i != focus and i not in near and abs(i - focus) > reach:
                gap.append(i)
                continue
            close()
            r = {"index": i, "title": s["title"]}
            if i == focus:
                r |= {"key_points": s["key_points"], "diagrams": s["diagrams"]}
                r |= {k: s[k] for k in ("depends_on", "out_of_scope") if s[k]}
            elif i in near:
                r["key_points"] = [cut(p, near_bytes) for p in s["key_points"]]
                if s["diagrams"]:
                    r["diagrams"] = [cut(d, 160) for d in s["diagrams"]]
            else:
                text = "; ".join(s["key_points"]) or s["reader_question"]
                if other_bytes and text.strip():
                    r["summary"] = cut(text, other_bytes)
                if s["diagrams"]:
                    r["diagrams"] = len(s["diagrams"])
            out.append(r)
        close()
        view = json.dumps({"sections": out}, separators=(",", ":"), ensure_ascii=False)
        if len(view.encode()) <= budget:
            break
    return rung, view


@pytest.mark.parametrize("budget", [900, 4000, 9000])
def test_document_view(spark, budget):
    rng = random.Random(budget)
    docs = {}
    for doc, n in ((1, 1), (2, 2), (3, 9), (4, 70)):
        docs[doc] = [
            {"title": f"t{i}", "key_points": ["é" * rng.randrange(400) for _ in range(rng.randrange(3))], "reader_question": rng.choice(["", "why? " * 30]), "depends_on": sorted({rng.randrange(i) for _ in range(rng.randrange(2))}) if i else [], "diagrams": ["d" * 300] * rng.randrange(2), "out_of_scope": ["x"] * rng.randrange(2)}
            for i in range(n)
        ]
    rows = [(d, i, *s.values()) for d, ss in docs.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "doc int, position int, title string, key_points array<string>, reader_question string, depends_on array<int>, diagrams array<string>, out_of_scope array<string>")
    got = {(r.doc, r.focus): (r.rung, r.view) for r in views.document_view(df, "doc", budget).collect()}
    want = {(d, i): brute_document_view(ss, i, budget) for d, ss in docs.items() for i in range(len(ss))}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == want and all(r.bytes == len(r.view.encode()) for r in views.document_view(df, "doc", budget).limit(3).collect())


def test_branch_view_says_what_it_leaves_out(spark):
    kind = "s int, place int, label string, `where` string, files array<string>, file_count int, findings array<struct<topic:string,observation:string>>, dirs array<string>, parts array<struct<label:string,files:int,topics:array<string>>>, whole boolean"
    branch = lambda s, i, k: (s, i, f"B{i}", "src", [f"f{j}" for j in range(40)], 40, [("t" * 300, "o" * k)] * 15, ["d"], [(f"B{i}.1", 3, ["x" * 200] * 3)] if i % 2 else [], True)
    rows = [branch(1, 0, 900)] + [branch(2, i, 900) for i in range(9)] + [branch(3, i, 900) for i in range(400)]
    got = {}
    for r in views.branch_view(spark.createDataFrame(rows, kind), "s").orderBy("s", "place").collect():
        got.setdefault(r.s, []).append((r.rung, json.loads(r.record)))
    view = lambda s: json.dumps([r for _, r in got[s]], separators=(",", ":"), ensure_ascii=False)
    assert all(len(view(s).encode()) <= views.VIEW_BYTES for s in got)
    assert len(got[1]) == 1 and len(got[2]) == 9 and got[1][0][0] == 0 and 0 < got[2][0][0] < 24 and all("parts" in r for _, r in got[2][1::2])
    shown = [r for _, r in got[3] if "branch" in r]
    assert got[3][-1][1] == {"branches_not_shown": 400 - len(shown)} and len(shown) in (320, 256, 204, 163, 130, 104, 83, 66, 52) and [r["branch"] for r in shown] == [f"B{i}" for i in range(len(shown))]

"""Traversals against plain loops on random graphs: queue order, budgets of paths and of discovered nodes, both-ended search."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import rank, traverse

EDGE = "head string, relation string, tail string, tail_kind string"


def graph(seed, nodes=14, edges=26):
    r = random.Random(seed)
    out = {(f"m.{r.randrange(nodes)}", r.choice("abc"), f"m.{r.randrange(nodes)}", "id") for _ in range(edges)}
    out |= {("m.0", "a", f"m.{i}", "id") for i in range(1, nodes, 2)}  # a hub
    out |= {(f"m.{r.randrange(nodes)}", "lit", str(r.randrange(5)), "literal") for _ in range(6)}
    return sorted(out)


def steps(edges):
    adj = collections.defaultdict(list)
    for h, rel, t, kind in edges:
        adj[h].append((rel, t, False, kind != "id"))
        if kind == "id":
            adj[t].append((rel, h, True, False))
    return adj


def queue_loop(seeds, edges, depth, hints, strict, limit, max_paths, max_nodes):
    adj, out, known = steps(edges), [], set(seeds)
    queue = [((s,), (), (), False) for s in sorted(seeds)]
    for nodes, rels, backs, literal in queue:
        if literal or len(rels) >= depth:
            continue
        near = sorted((rel not in hints, rel, n, back, lit) for rel, n, back, lit in adj[nodes[-1]] if n not in nodes and (not strict or not hints or rel in hints))
        for _, rel, n, back, lit in near[: limit or None]:
            if max_nodes and not lit and n not in known and len(known) >= max_nodes:
                continue
            if not lit:
                known.add(n)
            path = ((*nodes, n), (*rels, rel), (*backs, back), lit)
            out.append(path)
            if max_paths and len(out) >= max_paths:
                return out
            queue.append(path)
    return out


def rows_of(df):
    return [(tuple(r.nodes), tuple(r.relations), tuple(r.reversed), r.literal) for r in df.collect()]


@pytest.mark.parametrize("seed, more", [
    (1, {}), (2, {"max_nodes": 6}), (3, {"max_nodes": 9, "max_paths": 25}), (4, {"max_nodes": 5, "neighbor_limit": 3, "hints": ["b"]}),
    (5, {"max_paths": 12}), (6, {"hints": ["a", "lit"], "strict": True, "max_nodes": 4}), (7, {"max_nodes": 1}),
])
def test_expand_paths_is_the_queue_loop(spark, seed, more):
    edges = graph(seed)
    asked = {0: ["m.0", "m.3"], 1: ["m.5"]}
    seeds = spark.createDataFrame([(q, n) for q, ns in asked.items() for n in ns], "qid int, node string")
    got = traverse.expand_paths(seeds, spark.createDataFrame(edges, EDGE), 3, **more)
    arg = {"hints": [], "strict": False, "neighbor_limit": 0, "max_paths": 0, "max_nodes": 0} | more
    for q, ns in asked.items():
        want = queue_loop(ns, edges, 3, arg["hints"], arg["strict"], arg["neighbor_limit"], arg["max_paths"], arg["max_nodes"])
        own = got.where(F.col("qid") == q).orderBy("seq")
        assert rows_of(own) == want
        assert [r.seq for r in own.collect()] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_both_ends_give_the_one_sided_paths(spark, seed, depth):
    edges = spark.createDataFrame(graph(seed, 18, 24), EDGE)
    seeds = spark.createDataFrame([(0, "m.1"), (0, "m.2"), (1, "m.4"), (2, "m.99")], "qid int, node string")
    targets = spark.createDataFrame([("m.2",), ("m.7",), ("m.9",)], "node string")
    got, want = traverse.meeting_paths(seeds, targets, edges, depth), traverse.simple_paths(seeds, edges, depth, targets)
    assert set(got.columns) == set(want.columns)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    first = traverse.meeting_paths(seeds, targets, edges, depth, 3, ["a", "b"])
    assert sorted(map(str, first.select(want.columns).collect())) == sorted(map(str, traverse.simple_paths(seeds, edges, depth, targets, 3, ["a", "b"]).collect()))


def test_targets_of_questions(spark):
    edges = spark.createDataFrame(graph(1), EDGE)
    seeds = spark.createDataFrame([(0, "m.1"), (1, "m.1")], "qid int, node string")
    targets = spark.createDataFrame([(0, "m.3"), (1, "m.5")], "qid int, node string")
    got = traverse.meeting_paths(seeds, targets, edges, 3)
    for q, t in ((0, "m.3"), (1, "m.5")):
        want = traverse.simple_paths(spark.createDataFrame([(q, "m.1")], "qid int, node string"), edges, 3, spark.createDataFrame([(t,)], "node string"))
        assert sorted(rows_of(got.where(F.col("qid") == q))) == sorted(rows_of(want))


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 5])
def test_shortest_paths(spark, depth):
    edges = graph(8, 20, 18)
    adj = {n: sorted({x for _, x, _, lit in s if not lit}) for n, s in steps(edges).items()}
    names = [f"m.{i}" for i in range(0, 20, 3)] + ["m.77"]
    pairs = [(a, b) for a in names for b in names]
    want = {}
    for a, b in pairs:
        level = {a: [a]}
        seen = {a}
        for h in range(depth + 1):
            if b in level:
                want[a, b] = level[b]
                break
            new = {}
            for n, p in level.items():
                for x in adj.get(n, []):
                    if x not in seen:
                        new[x] = min(new.get(x, [*p, x]), [*p, x])
            seen |= set(new)
            level = new
    got = traverse.shortest_paths(spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame(edges, EDGE), depth)
    assert {(r.source, r.target): r.nodes for r in got.collect()} == want
    assert all(r.length == len(r.nodes) - 1 for r in got.collect())


def test_selection_without_a_task_per_question(spark):
    """Ranks, diverse selection and branch reduction equal plain sorting, for one question with most of the paths."""
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 2]), [f"m.{r.randrange(4)}", f"m.{r.randrange(4)}", f"m.{i}"], i) for i in range(300)]
    d = spark.createDataFrame(rows, "qid int, nodes array<string>, rank int")
    for most in (5, 20, 500):
        got = {(x.qid, x["rank"]): x.selected_rank for x in rank.select_diverse(d, most).collect()}
        less = {(x.qid, x["rank"]) for x in rank.branch_reduce(d, most, "rank").collect()}
        want, want_less = {}, set()
        for q in (1, 2):
            own = sorted((x for x in rows if x[0] == q), key=lambda x: x[2])
            seen, flagged = set(), []
            for _, nodes, k in own:
                flagged.append((tuple(nodes[:2]) in seen and len(own) > most, k))
                seen.add(tuple(nodes[:2]))
            want |= {(q, k): i + 1 for i, (_, k) in enumerate(sorted(flagged)[:most])}
            want_less |= {(q, k) for f, k in (flagged if len(own) <= most else [x for x in flagged if not x[0]][:most])}
        assert got == want and less == want_less


def test_shortest_paths_between_hubs_keep_small_levels(spark, monkeypatch):
    """Sources that share a hub with many neighbours do not each take all of them along."""
    rows = [("m.r", "r", f"m.h{h}", "id") for h in range(2)]
    rows += [(f"m.h{h}", "r", f"m.s{h}.{i}", "id") for h in range(2) for i in range(40)]
    pairs = [(f"m.s0.{i}", "m.h1") for i in range(40)]
    kept = []
    keep = traverse.written
    monkeypatch.setattr(traverse, "written", lambda d: (kept.append((d.columns, got := keep(d))), got)[1])
    got = traverse.shortest_paths(spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame(rows, EDGE), 3).collect()
    assert {(r.source, r.target, tuple(r.nodes)) for r in got} == {(s, t, (s, "m.h0", "m.r", t)) for s, t in pairs}
    assert max(d.count() for columns, d in kept if "nodes" in columns) <= 2 * len(rows)  # 40 sources x 40 neighbours before

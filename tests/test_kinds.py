"""Lookups scan only tables that can hold their nodes, and hubs are not multiplied, sorted or written."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import aggregate, beam, lookup, resolve, store, traverse
from weftgraph.operators.store import GraphStore
from weftgraph.plans import registry

SF = "/root/testdata/sf0.001"
EDGE = "head string, relation string, tail string, tail_kind string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def kept(monkeypatch):
    """The tables that traversals write."""
    got = []

    def record(df, write=store.written):
        got.append(write(df))
        return got[-1]

    for module in (traverse, aggregate, beam, resolve, registry):
        monkeypatch.setattr(module, "written", record, raising=False)
    return got


def plain(df):
    """Without what the source has declared."""
    return df.select(*[F.concat(c).alias(c) if c in ("head", "tail", "mid") else F.col(c) for c in df.columns])


def hub(spark, n=300):
    """A target with ``n`` records, next to the hub that a seed leads to."""
    e = [("m.a.1", "to", "m.h.1", "id"), ("m.t.1", "at", "m.h.1", "id"), ("m.t.1", "at", "m.h.1", "id")]
    return spark.createDataFrame([*e, *((f"g.r.{i}", "of", "m.t.1", "id") for i in range(n))], EDGE)


def test_only_tables_that_can_hold_the_nodes(spark):
    """a hop from nations reads customers, suppliers and nations, and gives what a hop over all edges gives."""
    g = registry.graph(spark, SF)
    front = nodes(spark, "m.nation.3", "m.region.1", "17", "x.y.z")
    near, every = traverse.both_ways(g.edges, front), traverse.both_ways(plain(g.edges))
    assert "l_orderkey" not in plan(near) and "o_orderkey" not in plan(near) and "l_orderkey" in plan(every)
    assert rows(near.join(front, "node")) == rows(every.join(front, "node").select(near.columns)) != []
    toward = traverse.both_ways(g.edges, nodes(spark, "m.supplier.2"), nodes(spark, "m.nation.3"))
    assert "l_orderkey" not in plan(toward)


@pytest.mark.parametrize("names", [["m.nation.3", "m.supplier.7", "17.5", "m.nowhere.1"], ["m.part.3", "m.order.1"], ["17"]])
def test_metadata_and_degrees_as_without_kinds(spark, names):
    """F12, F14"""
    g = registry.graph(spark, SF)
    all_of_it = GraphStore.over(plain(g.edges), plain(g.entities))
    li = [r.mid for r in g.entities.where("is_cvt").limit(1).collect()]
    n = nodes(spark, *names, *li)
    assert rows(lookup.metadata(n, g)) == rows(lookup.metadata(n, all_of_it))
    assert rows(store.degrees_of(n, g.edges)) == rows(store.degrees_of(n, plain(g.edges))) != []
    assert "l_orderkey" not in plan(lookup.described(nodes(spark, *names), g))


def test_large_frontiers_meet_counts(spark, monkeypatch):
    """degrees of many nodes join counts, not edges."""
    want = rows(store.degrees_of(nodes(spark, "m.t.1", "m.h.1"), hub(spark)))
    monkeypatch.setattr(store, "fits", lambda df, most=0: False)
    assert rows(store.degrees_of(nodes(spark, "m.t.1", "m.h.1"), hub(spark))) == want != []


def test_changed_ids_lose_their_kinds(spark):
    e = registry.graph(spark, SF).edges
    other = e.where("relation = 'geo.nation.region'").select(F.concat(F.lit("1|"), "head").alias("head"), "relation", "tail", "tail_kind")
    assert traverse.both_ways(other, nodes(spark, "1|m.nation.3")).join(nodes(spark, "1|m.nation.3"), "node").count() == 1


def test_question_loop_writes_no_graph(spark, kept):
    """F6"""
    registry.kg_question_loop(spark, SF)
    assert not [d for d in kept if {"head", "tail"} <= set(d.columns) or "is_cvt" in d.columns]


def test_records_of_targets_are_not_written(spark, kept):
    """the last step follows only edges that reach the other side."""
    got = traverse.meeting_paths(nodes(spark, "m.a.1"), nodes(spark, "m.t.1"), hub(spark), 2)
    assert [r.nodes for r in got.distinct().collect()] == [["m.a.1", "m.h.1", "m.t.1"]]
    assert max(d.count() for d in kept) < 10


def test_what_a_budget_cuts_is_not_placed(spark, monkeypatch):
    """only rows that pass are sorted."""
    placed = []
    monkeypatch.setattr(traverse, "group_places", lambda df, *a, f=traverse.group_places, **b: placed.append(df.count()) or f(df, *a, **b))
    got = traverse.expand_paths(nodes(spark, "m.t.1"), hub(spark), 1, max_nodes=5).orderBy("seq").collect()
    assert [r.terminal for r in got] == ["m.h.1", "m.h.1", "g.r.0", "g.r.1", "g.r.10"]
    assert max(placed) == len(got)


def test_edges_are_found_once_before_they_are_sorted(spark, monkeypatch):
    """a range sort reads its input twice, so it gets a written table and not the join."""
    plans = []
    monkeypatch.setattr(traverse, "group_places", lambda df, *a, f=traverse.group_places, **b: plans.append(plan(df)) or f(df, *a, **b))
    traverse.two_hop_extensions(nodes(spark, "m.a.1"), hub(spark)).count()
    assert len(plans) == 3 and not [p for p in plans[1:] if "Join" in p]


def test_candidates_are_found_once(spark, kept):
    """F14"""
    g = registry.graph(spark, SF)
    c = spark.createDataFrame([("x", "m.nation.3", 95.0)], "mention string, mid string, score double")
    got = resolve.rerank_entities(c, g, "country", "nation with suppliers")
    assert [d for d in kept if d.columns == c.columns] and [r.mid for r in got.collect()] == ["m.nation.3"]


def test_first_neighbours_of_a_hub(spark):
    """F16: a hub's neighbours are cut in parts before one task ranks them."""
    got = aggregate.top_per_source(nodes(spark, "m.t.1"), hub(spark), "of", 3, reverse=True)
    assert [(r.neighbor, r.rn, r.source_total) for r in got.orderBy("rn").collect()] == [("g.r.0", 1, 300), ("g.r.1", 2, 300), ("g.r.10", 3, 300)]
    assert "__lane" in plan(got)


def test_expansion_meets_the_frontier_first(spark):
    """repeated edges are told among the frontier's, not among all."""
    tables = []
    g = GraphStore.over(hub(spark), spark.createDataFrame([], "mid string, name string, types array<string>, is_cvt boolean"))
    acts = spark.createDataFrame([(1, "", "at", "forward")], "qid int, state_id string, relation string, direction string")
    front = spark.createDataFrame([(1, "", "m.t.1", 1)], "qid int, state_id string, node string, ord int").withColumn("evidence", F.array().cast("array<string>"))
    used = beam.expand(acts, front, g, beam.BeamConfig(rerank=False), keep=lambda d: tables.append(d) or d)
    assert [(r.target, r.total if "total" in used.columns else None, r.rn) for r in used.collect()] == [("m.h.1", None, 1)]
    assert [d.count() for d in tables if "target" in d.columns] == [1]

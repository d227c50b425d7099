"""Staged builds: killed half-way and gone on, other inputs, missing columns; counters; a hub mediator's product in blocks."""

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

from weftgraph import cli
from weftgraph.operators import etl
from weftgraph.operators.build import build
from weftgraph.operators.store import GraphStore
from weftgraph.sources import star

EDGES = [(f"m.{i % 17}", f"r.{i % 3}", f"m.{i % 23}" if i % 4 else f"value {i}", "id" if i % 4 else "literal") for i in range(200)]
ENTS = [(f"m.{i}", f"name {i}" if i % 5 else "", [f"alias {i}"], ["t.x"], i % 7 == 0) for i in range(25)]


def inputs(spark, extra=0):
    e = spark.createDataFrame(EDGES + [(None, "r.0", "m.1", "id")] * extra, "head string, relation string, tail string, tail_kind string")
    return e, spark.createDataFrame(ENTS, "mid string, name string, aliases array<string>, types array<string>, is_cvt boolean")


def content(g):
    tables = {n: getattr(g, n) for n in ("edges", "edges_by_tail", "entities", "node_stats", "relation_stats", "relations", "relation_lookup", "alias_index")}
    return {n: collections.Counter(str(r.asDict()) for r in d.select(*sorted(d.columns)).collect()) for n, d in tables.items()}


def test_killed_build_goes_on(spark, tmp_path):
    triples, entities = inputs(spark, extra=2)
    path = str(tmp_path / "store")
    seen = []

    def stop(name, got):
        seen.append(name)
        if len(seen) == 5:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        build(triples, entities, path, parts=3, source="a", progress=stop)
    assert not os.path.exists(path) and os.path.exists(f"{path}.staging")
    # A piece that was being written when the build was killed has files, but no manifest.
    os.makedirs(f"{path}.staging/edges_by_tail/part=2", exist_ok=True)
    (tmp_path / "store.staging/edges_by_tail/part=2/part-junk.parquet").write_bytes(b"broken")
    more = []
    got = build(triples, entities, path, parts=3, source="a", progress=lambda n, _: more.append(n))
    assert not set(more) & set(seen) and len(more) + len(seen) == len(got["pieces"]) == 12
    assert (got["edges"], got["skipped"]) == (200, 2) and not os.path.exists(f"{path}.staging")
    whole = build(triples, entities, str(tmp_path / "whole"), parts=1, source="a")
    a, b = GraphStore.load(spark, path), GraphStore.load(spark, str(tmp_path / "whole"))
    assert content(a) == content(b)
    assert sum(content(a)["edges"].values()) == whole["edges"] == 200
    assert got["pieces"]["entities"]["rows"] == 25
    # A finished store is not built again, unless asked to or from other inputs.
    again = []
    build(triples, entities, path, parts=3, source="a", progress=lambda n, _: again.append(n))
    assert again == []
    build(triples.limit(50), entities, path, parts=3, source="b", progress=lambda n, _: again.append(n))
    assert len(again) == 12 and GraphStore.load(spark, path).edges.count() == 50


def test_missing_columns_and_no_rows(spark, tmp_path):
    triples, entities = inputs(spark)
    got = build(triples.drop("tail_kind").limit(0), entities.select("mid", "name").limit(0), str(tmp_path / "s"), parts=2, source="x")
    assert got["features"] == {"tail_kind": False, "aliases": False, "types": False, "is_cvt": False} and got["edges"] == 0
    g = GraphStore.load(spark, str(tmp_path / "s"))
    assert g.edges.count() == g.node_stats.count() == 0 and "types" in g.entities.columns
    with pytest.raises(ValueError, match="relation"):
        build(triples.drop("relation"), entities, str(tmp_path / "t"))


def test_hub_mediator_in_blocks(spark):
    """Each edge in with each edge out, once, whether or not the mediator is cut; no key has more than a block of either."""
    rows = [(f"m.a{i}", "in.r", "m.hub", "id", False, True) for i in range(300)] + [("m.hub", "out.r", f"m.b{i}", "id", True, False) for i in range(40)]
    rows += [("m.a1", "in.r", "m.small", "id", False, True), ("m.small", "out.r", "m.a1", "id", True, False), ("m.small", "out.v", "7", "literal", True, False)]
    rows += [("m.hub", "out.r", f"m.a{i}", "id", True, False) for i in range(3)]
    routed = spark.createDataFrame(rows, "head string, relation string, tail string, tail_kind string, head_cvt boolean, tail_cvt boolean")
    want = collections.Counter((a[0], f"{a[1]}.{b[1]}", b[2], b[3]) for a in rows if a[5] for b in rows if b[4] and b[0] == a[2] and not (b[3] == "id" and b[2] == a[0]))
    for block in (1, 16, 10_000):
        assert collections.Counter(tuple(r) for r in etl.flatten(routed, block).collect()) == want


def test_whole_tables_give_the_same_edges(spark):
    """Each table read once: the same edges as the SQL of 21 parts, and as many scans as tables with edges."""
    sf = "/root/testdata/sf0.001"
    one, parts = star.triples(spark, sf, whole=True), star.triples(spark, sf)
    assert one.columns == parts.columns and one.exceptAll(parts).isEmpty() and parts.exceptAll(one).isEmpty()
    assert len(one.inputFiles()) == 6
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 6


def test_profile_hashes_its_counts(spark):
    """Domains in and out are told apart exactly, with null relations, and nothing is sorted for it."""
    r = random.Random(5)
    doms = ["a.x", "b.x", "c.x", None]
    rows = [(f"m.{r.randrange(12)}", r.choice(doms), f"m.{r.randrange(12)}", r.choice(["id", "id", "literal"])) for _ in range(60)]
    d = etl.node_profile(spark.createDataFrame(rows, "head string, relation string, tail string, tail_kind string"))
    assert "Object" not in (plan := d._jdf.queryExecution().executedPlan().toString()) and "Sort" not in plan
    got = {x.mid: (x.in_count, x.out_count, x.literal_count, x.mixed) for x in d.collect()}
    want = {}
    for n in {x[0] for x in rows} | {x[2] for x in rows if x[3] == "id"}:
        out, into = [x for x in rows if x[0] == n], [x for x in rows if x[2] == n and x[3] == "id"]
        di, do = ({x[1].split(".")[0] for x in part if x[1]} for part in (into, out))
        want[n] = (len(into), len(out), sum(x[3] != "id" for x in out), bool(di) and bool(do) and di != do)
    assert got == want


def test_products_join_by_the_mediator_alone(spark):
    """Edges dealt by mediator stay where they are; only hubs get block numbers."""
    e = spark.createDataFrame([("m.a", "in.r", "g.1", "id"), ("g.1", "out.r", "m.b", "id"), ("g.1", "out.v", "7", "literal"), ("m.a", "p.q", "m.b", "id")], "head string, relation string, tail string, tail_kind string")
    d = etl.products(*etl.ends_of(e, spark.createDataFrame([("g.1",)], "mid string")))
    assert sorted(map(tuple, d.collect())) == [("m.a", "in.r.out.r", "m.b", "id"), ("m.a", "in.r.out.v", "7", "literal")]
    assert "explode" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_labels_deal_only_id_tails_by_tail(spark):
    e = spark.createDataFrame([("m.a", "r", "m.b", "id"), ("m.a", "r", "m.b", "literal"), ("m.b", "r", "x", None), ("g.1", "r", "g.1", "id")], "head string, relation string, tail string, tail_kind string")
    n = spark.createDataFrame([("m.a", "A"), ("m.b", "B"), ("g.1", "")], "mid string, name string")
    d = etl.with_labels(e, n)
    want = {("m.a", "A", "r", "m.b", "B", "id"), ("m.a", "A", "r", "m.b", "", "literal"), ("m.b", "B", "r", "x", "", None), ("g.1", "", "r", "g.1", "", "id")}
    assert {tuple(r) for r in d.collect()} == want
    assert "(tail_kind" in (plan := d._jdf.queryExecution().optimizedPlan().toString()) and "Union" in plan
    twice = etl.with_labels(e, n.unionByName(spark.createDataFrame([("g.1", "")], "mid string, name string")))
    assert sum(r.head == "g.1" for r in twice.collect()) == 4  # two entities at each end, as in SQL


def test_counters_of_a_run(spark, tmp_path, capsys):
    ns = etl.NAMESPACE
    uri = lambda s, p, o: (ns + s, ns + p, ns + o, "uri", None)
    text = lambda s, p, o, lang="en": (ns + s, ns + p, o, "literal", lang)
    rows = [text("m.1", etl.NAME, "One"), text("m.2", etl.NAME, "Zwei", "de"), text("m.1", etl.ALIAS, "Uno"), uri("m.1", etl.TYPE, "people.person"), uri("m.1", "people.person.parents", "m.2"), text("m.2", "people.person.height", "180"), uri("m.1", "user.x.y", "m.2"), uri("x.1", "people.person.parents", "m.2")]
    os.makedirs(tmp_path / "rdf")
    spark.createDataFrame(rows, "subject string, predicate string, object string, object_type string, object_language string").coalesce(1).write.parquet(f"{tmp_path}/rdf/data-0.parquet")
    got = etl.write(spark.read.parquet(f"{tmp_path}/rdf/data-0.parquet"), str(tmp_path / "out"))
    t, e = (spark.read.parquet(f"{tmp_path}/out/{n}") for n in ("triples", "entities"))
    assert got["input"] == {"rows": 8, "kept": 6, "names": 2, "aliases": 1, "types": 1}
    assert got["triples"] == {"rows": t.count(), "literals": t.where("tail_kind <> 'id'").count(), "unnamed": t.where((F.col("head_name") == "") | ((F.col("tail_kind") == "id") & (F.col("tail_name") == ""))).count()} == {"rows": 2, "literals": 1, "unnamed": 2}
    assert got["entities"] == {"rows": e.count(), "unnamed": 1, "mediators": 0} and got["cvt"] == {"rows": 0}
    cli.main(["etl", f"{tmp_path}/rdf", f"{tmp_path}/out2", "--main-view", "raw", "--drop-base"])
    assert '"kept": 6' in capsys.readouterr().out


def random_edges(seed=7):
    """Some 150 edges among mediators g.0 to g.4 and others, with nulls, loops, repeated edges and kinds of all sorts."""
    r = random.Random(seed)
    node = lambda: r.choice([*[f"g.{i}" for i in range(5)], *[f"m.{i}" for i in range(12)], None])
    rows = [(node(), r.choice(["a.r", "b.r"]), node(), r.choice(["id", "id", "id", "literal", None])) for _ in range(150)]
    rows += [("m.x", "a.r", "g.5", "id"), ("g.5", "a.r", "m.x", "id"), ("m.y", "a.r", "g.6", "id"), ("g.6", "b.r", "m.y", "id"), ("g.6", "b.r", "7", "literal"), ("m.z", "a.r", "g.7", "id")]
    return rows, [f"g.{i}" for i in range(8)]


EDGE_COLUMNS = "head string, relation string, tail string, tail_kind string"


def flat_rows(rows, cvts):
    ends = [(a, b) for a in rows if a[3] == "id" and a[2] in cvts for b in rows if b[0] == a[2]]
    same = lambda a, b: None if a is None or b is None else a == b
    kept = lambda kind, eq: (kind is not None and kind != "id") or eq is False  # noqa: E731  NOT (kind = 'id' AND eq), with nulls
    return {(a[0], f"{a[1]}.{b[1]}", b[2], b[3]) for a, b in ends if kept(b[3], same(a[0], b[2]))}


@pytest.mark.parametrize("view, flat", [("flattened", True), ("flattened", False), ("raw", True)])
def test_ids_of_the_main_view_without_its_rows(spark, view, flat):
    for seed in (7, 8):
        rows, cvts = random_edges(seed)
        e, c, config = spark.createDataFrame(rows, EDGE_COLUMNS), spark.createDataFrame([(x,) for x in cvts], "mid string"), etl.EtlConfig(main_view=view, flatten=flat)
        main = {tuple(x) for x in etl.triplets(e, c, config)[0].collect()}
        d = etl.main_ids(e, c, config)
        assert sorted((x.mid for x in d.collect()), key=str) == sorted({x[0] for x in main} | {x[2] for x in main if x[3] == "id"}, key=str)
        assert "concat_ws" not in d._jdf.queryExecution().optimizedPlan().toString()  # no products
        if view == "flattened" and flat:
            assert {x for x in main if x[1].count(".") > 1} == flat_rows(rows, cvts)


def test_ends_meet_mediators_that_are_counted_already(spark):
    rows, cvts = random_edges(9)
    rows += [(f"m.h{i}", "a.r", "g.1", "id") for i in range(40)]
    e = spark.createDataFrame(rows, EDGE_COLUMNS)
    n = [(x, sum(r[2] == x and r[3] == "id" for r in rows), sum(r[0] == x for r in rows)) for x in cvts]
    for block in (3, 16, 4096):
        d = etl.flattened(e, spark.createDataFrame(n, "mid string, in_count long, out_count long"), block)
        assert {tuple(x) for x in d.collect()} == flat_rows(rows, cvts)
        assert "count(1)" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_triplets_deal_edges_by_head_once(spark):
    rows, cvts = random_edges(10)
    e = spark.createDataFrame(rows, EDGE_COLUMNS)
    n = [(x, sum(r[2] == x and r[3] == "id" for r in rows), sum(r[0] == x for r in rows)) for x in cvts]
    main, raw = etl.triplets(e, spark.createDataFrame(n, "mid string, in_count long, out_count long"))
    touched = lambda x: x[0] in cvts or (x[3] == "id" and x[2] in cvts)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted((tuple(x) for x in main.collect()), key=str) == sorted({x for x in rows if not touched(x)} | flat_rows(rows, cvts), key=str)
        assert "ReusedExchange" in main._jdf.queryExecution().executedPlan().toString()
        assert sorted((tuple(x) for x in raw.collect()), key=str) == sorted({x for x in rows if touched(x)}, key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

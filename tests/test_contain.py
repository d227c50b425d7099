"""The containment join against all pairs, and its plan."""

import random

from weftgraph.operators.contain import containing
from weftgraph.operators.lookup import resolve_entities, resolve_relations
from weftgraph.operators.store import GraphStore


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcé ") for _ in range(r.choice([1, 2, 3, 4, 6, 12]))) for _ in range(n)]


def test_all_pairs(spark):
    needles, texts = [*words(1, 60), "", None, "zzz"], [*words(2, 150), "", None, "abc" * 40]
    got = containing(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in texts], "text string"))
    want = {(a, b) for a in needles if a for b in texts if b is not None and a in b}
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(set(out)) and set(out) == want


def test_short_and_no_needles(spark):
    t = spark.createDataFrame([("ab",), ("c",)], "text string")
    one = lambda *xs: sorted(tuple(r) for r in containing(spark.createDataFrame([(x,) for x in xs], "needle string"), t).collect())
    assert one("a", "bb", "c") == [("a", "ab"), ("c", "c")]
    assert one() == []


def test_names_are_not_compared_one_by_one(spark):
    ents = [("m.1", "New York City", ["York"], [], False), ("m.2", "York", [], [], False), ("m.3", "Paris", ["City of Light"], [], False)]
    edges = [("m.1", "location.city.country", "m.3", "id"), ("m.2", "location.city.mayor_name", "x", "literal")]
    g = GraphStore(spark.createDataFrame(edges, "head string, relation string, tail string, tail_kind string"), spark.createDataFrame(ents, "mid string, name string, aliases array<string>, types array<string>, is_cvt boolean"))
    d = resolve_entities(spark.createDataFrame([("york",), ("city",), ("nowhere",)], "mention string"), g, 5, like=True)
    assert "NestedLoop" not in d._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.mention, r.mid, r.match_type) for r in d.collect()) == [("city", "m.1", "alias_like"), ("city", "m.3", "alias_like"), ("york", "m.1", "alias_exact"), ("york", "m.2", "name_exact")]
    r = resolve_relations(spark.createDataFrame([("city",), ("mayor name",), ("country of a city",), ("location.city.country",)], "hint string"), g, 5)
    assert "NestedLoop" not in r._jdf.queryExecution().executedPlan().toString()
    kinds = {(x.hint, x.relation): x.match_type for x in r.collect()}
    assert kinds["location.city.country", "location.city.country"] == "relation_exact"
    assert kinds["country of a city", "location.city.country"] == "fuzzy"
    assert kinds["mayor name", "location.city.mayor_name"] == "relation_name_like" and len([k for k in kinds if k[0] == "city"]) == 2

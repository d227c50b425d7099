from pyspark.sql import functions as F

from weftgraph.operators import resolve
from weftgraph.operators.store import GraphStore

E = [("m.v1", "Vienna", ["location.citytown"], False), ("m.v2", "Vienna", ["music.album"], False), ("m.at", "Austria", ["location.country"], False), ("m.p", "Max", ["people.person"], False)]
T = [("m.v1", "location.location.containedby", "m.at", "id"), ("m.v2", "music.album.artist", "m.p", "id")]


def make(spark):
    return GraphStore(spark.createDataFrame(T, "head string, relation string, tail string, tail_kind string"), spark.createDataFrame(E, "mid string, name string, types array<string>, is_cvt boolean"))


def test_expansion_rerank(spark):
    d = spark.createDataFrame([(1, "m.v2", 1), (1, "m.v1", 2), (1, "m.p", 3)], "qid int, node string, pos int")
    got = resolve.rerank_expansion(d, make(spark), ["city"], ["location.location.containedby"], ["vienna"], ["m.p"], ["qid"]).orderBy("rerank_pos").collect()
    assert [(r.node, r.rerank_score) for r in got] == [("m.v1", 16.0), ("m.v2", 5.0), ("m.p", 0.0)]


def test_entity_rerank_keeps_the_type(spark):
    d = spark.createDataFrame([("Vienna", "m.v1", 95.0), ("Vienna", "m.v2", 95.0)], "mention string, mid string, score double")
    got = resolve.rerank_entities(d, make(spark), "city", "the city contained by austria").collect()
    assert [(r.mid, r.context_rank) for r in got] == [("m.v1", 1)]
    assert resolve.keep_close(resolve.rerank_entities(d, make(spark), None, "austria")).count() >= 1


def test_name_variants(spark):
    d = spark.createDataFrame([("Vienna", "city", "Where is Vienna, Austria located?"), ("Leopold", "person", None), ("X", None, None)], "mention string, expected_type string, context string")
    got = {}
    for r in resolve.name_variants(d).orderBy("ord").collect():
        got.setdefault(r.mention, []).append(r.variant)
    assert got["Vienna"][:3] == ["Vienna, Austria located", "Vienna Austria located", "Vienna"] and "city of Vienna" in got["Vienna"]
    assert got["Leopold"][:2] == ["Leopold", "Leopol"] and "person Leopold" in got["Leopold"]
    assert got["X"] == ["X"]


def test_start_nodes_and_seeds(spark):
    d = spark.createDataFrame([(1, "m.v1"), (1, "m.v2"), (1, "m.p")], "qid int, node string")
    assert resolve.start_nodes(d, make(spark), "city", "which country contains it", 1).first().node == "m.v1"
    assert resolve.order_seeds(d, make(spark), "max", F.lit("")).orderBy("seed_rank").first().node == "m.p"


def test_verdicts(spark):
    s = spark.createDataFrame([(1, "a", 0.2, 0.1, 0.3, 0), (1, "b", 0.2, 0.1, 0.3, 0), (1, "c", 0.2, 0.1, 0.3, 5)], "qid int, signature string, semantic_score double, answer_score double, type_score double, protected_until int")
    v = spark.createDataFrame([(1, "a", 2.0, 0.05, 0.5, "continue"), (1, "b", 0.0, 0.0, 0.0, "discard"), (1, "c", 0.0, 0.0, 0.0, "discard")], "qid int, signature string, semantic double, answer double, continue_ double, verdict string")
    got = {r.signature: (r.semantic_score, r.answer_score, r.type_score) for r in resolve.apply_verdicts(s, v, 2).collect()}
    assert got == {"a": (1.0, 0.1, 0.5), "c": (0.2, 0.1, 0.3)}

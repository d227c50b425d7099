"""Questions over a small graph: parsing, retrieval, bundles, pruning, grounding and batches; files and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph import cli
from weftgraph.operators import aggregate, beam, evaluate, lookup, question, rank, resolve, solve, traverse
from weftgraph.operators.store import GraphStore, with_edge_ids
from weftgraph.sources import files

from .test_graph import nodes, one, store  # noqa: F401

FILM_E = [("m.act", "Ada Act", ["people.person"], False), ("m.film", "Long Film", ["film.film"], False), ("m.role", "The Hero", ["film.character"], False), ("g.perf", "", ["film.performance"], True), ("g.other", "", ["film.performance"], True)]
FILM_T = [
    ("m.film", "film.film.starring", "g.perf", "id"), ("g.perf", "film.performance.player", "m.act", "id"), ("g.perf", "film.performance.character", "m.role", "id"),
    ("g.perf", "film.performance.film", "m.film", "id"), ("g.perf", "film.performance.from", "1999", "literal"), ("g.perf", "film.performance.note", "x", "literal"),
    ("g.perf", "film.performance.linked", "g.other", "id"), ("g.other", "film.performance.player", "m.act", "id"),
]


@pytest.fixture(scope="module")
def film(spark):
    return GraphStore(spark.createDataFrame(FILM_T, "head string, relation string, tail string, tail_kind string"), spark.createDataFrame(FILM_E, "mid string, name string, types array<string>, is_cvt boolean"))


def test_operation_words(spark):
    ask = lambda q: one(spark, solve.operation(F.lit(q)))
    assert [ask(q) for q in ("Which is the largest city?", "the smallest number of people", "who of these is also a poet", "among these, who won", "how many cities", "number of rivers", "the first man", "many people", "a common name", None)] == ["argmax", "argmin", "intersect", "intersect", "count", "count", None, None, None, None]


def test_bundle_keeps_the_telling_edges(spark, film):
    b = {r.target: r for r in beam.cvt_bundles(spark.createDataFrame([("g.perf", ["m.film"])], "node string, entry array<string>"), film, ["who played the hero"], "person").collect()}
    assert b["m.act"].role == "answer" and b["m.act"].edge_rank == 1, b
    assert b["1999"].role == "constraint" and b["g.other"].role == "intermediate"
    assert "m.film" not in b and len(b) <= 6
    assert b["m.act"].edge_score > b["m.role"].edge_score


def test_bundle_of_paths(spark, film):
    p = traverse.simple_paths(nodes(spark, "m.film"), film.edges, 1).withColumn("path_score", F.lit(1.0))
    got = beam.bundle_paths(p, film, ["who played the hero"], "person").collect()
    assert len(got) == 2 and all(x.bundled and x.terminal == "m.act" and abs(x.path_score - 1.05) < 1e-9 and "[CVT:perf]" in x.text for x in got)


def test_fallback_and_choice_of_actions(spark):
    ranked = spark.createDataFrame([(1, "a", f"r{k}", "forward", k, 0.02 * k) for k in range(1, 6)] + [(1, "b", "r1", "reverse", 1, 3.0)], "qid long, state_id string, relation string, direction string, candidate_rank int, support_ratio double")
    said = spark.createDataFrame([(1, "a", "r2", "forward", "ANSWER", 0.4), (1, "a", "r2", "forward", "constraint", 0.9), (1, "a", "r3", "forward", "answer", 2.0), (1, "a", "zz", "forward", "answer", 1.0), (1, "a", "r5", "forward", "odd", None)], "qid long, state_id string, relation string, direction string, role string, confidence double")
    c = beam.choose(said, ranked, 3)
    assert [(r.relation, r.role, r.confidence) for r in c.collect()] == [("r3", "answer", 1.0), ("r2", "constraint", 0.9), ("r5", "intermediate", 0.0)]
    full = beam.with_fallback(c.drop("batch"), ranked, beam.BeamConfig(relations_per_state=2)).where("state_id = 'b'").collect()
    assert [(r.relation, r.role, r.confidence) for r in full] == [("r1", "intermediate", 1.0)]


def test_dependency_context(spark):
    d = spark.createDataFrame([(1, k, f"a{k}", [f"p{j}" for j in range(7)], [" "], [f"m.{k}{j}" for j in range(7)]) for k in range(7)], "qid int, ord int, answer string, predicted_answers array<string>, literals array<string>, entity_ids array<string>")
    r = beam.dependency_context(d).first()
    assert r.constraint_terms == ["a0", "p0", "p1", "p2", "p3", "p4", "a1", "a2", "a3", "a4"] and len(r.constraint_targets) == 25


def test_parse_and_sub_questions(spark):
    good = json.dumps({"topic_entities": ["Rome", " "], "predicted_depth": 9, "sub_questions": [{"id": "a", "question": "how many cities", "depends_on": []}, {"id": "v", "question": "how many cities", "solver_type": "verify"}, {"id": "b", "question": "Is it big?", "solver_type": "verify", "depends_on": ["a"]}]})
    q = spark.createDataFrame([(1, "Q one", good, None), (2, "Q two", "no json", ["Given"])], "qid long, question string, parsed string, topics array<string>")
    p = {r.qid: r for r in question.parse(q).collect()}
    assert p[1].topic_entities == ["Rome"] and p[1].ordered_topic_entities == ["Rome"] and p[1].predicted_depth == 3
    assert p[2].topic_entities == ["Given"] and p[2].predicted_depth == 1 and p[2].split_questions == ["Q two"]
    s = {(r.qid, r.sub_id): r.solver_type for r in question.sub_questions(question.parse(q)).collect()}
    assert s == {(1, "a"): "aggregate", (1, "b"): "verify", (2, "sq1"): "explore"}


def test_relation_names_and_recall(spark, store):
    got = [r.name for r in question.relation_queries(spark.createDataFrame([("Leader",), ("spouse",)], "hint string")).collect()]
    assert "head of state" in got and got.count("spouse") == 1
    r = lookup.resolve_relations_index(spark.createDataFrame([("people.marriage.spouse",), ("location founded",)], "hint string"), store).collect()
    assert [(x.relation, x.score) for x in r if x.hint == "people.marriage.spouse"] == [("people.marriage.spouse", 95.0)]
    assert any(x.relation == "location.location.founded" for x in r if x.hint == "location founded")
    m = spark.createDataFrame([("rome", "roma", "city"), ("rome", "Rome", "city"), ("x", "nothing here", None)], "mention string, variant string, expected_type string")
    assert [(x.mention, x.mid, x.score) for x in question.recall(m, store).collect()] == [("rome", "m.rome", 95.0)]


def test_foreign_domains_count_less(spark):
    from .test_resolve import make

    d = spark.createDataFrame([("Vienna", "m.v1", 95.0), ("Vienna", "m.at", 95.0), ("Vienna", "m.v2", 95.0)], "mention string, mid string, score double")
    got = resolve.rerank_entities(d, make(spark), "city", "vienna").collect()
    assert "m.v1" in {r.mid for r in got} and "m.v2" not in {r.mid for r in got}


def test_local_probe(spark, store):
    s = spark.createDataFrame([(1, "m.rome")], "qid long, node string")
    g = question.relation_groups(s, store)
    assert {r.relation: r.targets for r in g.collect()}["location.location.containedby"] == ["Italy"]
    q = spark.createDataFrame([(1, "italy")], "qid long, question string")
    p = traverse.simple_paths(s, store.edges, 1, relations=["travel.attraction.near"])
    got = {r.relation for r in question.probe_relations(g, q, p, 2).collect()}
    assert got == {"location.location.containedby", "travel.attraction.near"}
    d = question.probe_paths(s, store, ["location.location.containedby"], terms=["italy"]).collect()
    assert d and all("italy" in r.text for r in d) and any(r.matched_relations for r in d)


def test_external_expansion_and_bootstrap(spark, store):
    p = traverse.simple_paths(spark.createDataFrame([(1, "m.bob")], "qid long, node string"), store.edges, 1, relations=["people.person.place_of_birth"])
    got = {r.text for r in question.expand_external(p, store, [], 20).collect()}
    assert got == {
        "g.wed -> people.marriage.spouse -> m.bob -> people.person.place_of_birth -> m.rome", "m.bob -> people.person.place_of_birth -> m.rome -> location.location.containedby -> m.italy",
        "m.bob -> people.person.place_of_birth -> m.rome -> location.location.founded -> 1,900", "m.bob -> people.person.place_of_birth -> m.rome -> travel.attraction.near (reverse) -> m.tower",
    }
    b = question.bootstrap_paths(spark.createDataFrame([(1, "Roma"), (1, "nobody")], "qid long, mention string"), store, ["travel.attraction.near"]).orderBy("ord").collect()
    assert b[0].matched_relations and b[0].terminal == "m.tower"


def test_ordered_topics_stay_with_their_pairs(spark, store):
    t = spark.createDataFrame([(1, 0, "m.bob"), (1, 1, "m.rome"), (1, 2, "m.italy"), (2, 0, "m.tower"), (2, 1, "m.italy"), (3, 0, "m.ann"), (4, 0, "m.ann"), (4, 1, "m.nowhere")], "qid long, ord int, node string")
    got = {(r.qid, tuple(r.nodes)) for r in traverse.ordered_topic_paths(t, store.edges, 1, 3).collect()}
    assert got == {(1, ("m.bob", "m.rome", "m.italy")), (2, ("m.tower", "m.rome", "m.italy")), (3, ("m.ann",))}
    s = traverse.supplement_paths(spark.createDataFrame([(2, 0, "m.tower"), (2, 1, "m.italy")], "qid long, ord int, node string"), spark.createDataFrame([(2, "m.rome"), (2, "m.italy")], "qid long, node string"), store.edges, 2).collect()
    assert [tuple(r.nodes) for r in s] == [("m.tower", "m.rome", "m.italy")]


def test_subgraphs_per_question(spark, store):
    t = spark.createDataFrame([(1, "m.tower"), (1, "m.italy"), (2, "m.ann")], "qid long, node string")
    g = traverse.question_subgraph(t, store.edges, 1)
    assert {(r.qid, r.head, r.tail) for r in g.collect()} == {(1, "m.tower", "m.rome"), (1, "m.rome", "m.italy"), (2, "m.ann", "g.wed")}
    more = g.unionByName(spark.createDataFrame([(1, "m.rome", "r", "m.side")], "qid long, head string, relation string, tail string"))
    got = {(r.qid, r.head, r.tail) for r in traverse.prune_by_topics(t, more, 3).collect()}
    assert got == {(1, "m.tower", "m.rome"), (1, "m.rome", "m.italy"), (2, "m.ann", "g.wed")}
    near = spark.createDataFrame([(1, "m.tower"), (1, "m.rome")], "qid long, node string")
    assert traverse.prune_by_topics(near, more, 3).count() == more.count()


def paths_of(spark, n=6):
    rows = [(1, f"m.{k}", ["m.s", f"m.{k % 3}", f"m.{k}"], ["r.a", "r.b" if k % 2 else "r.c"], [False, False], ["r.a"] if k % 2 else [], 2, f"t{k}", float(n - k), k) for k in range(n)]
    return spark.createDataFrame(rows, "qid int, terminal string, nodes array<string>, relations array<string>, reversed array<boolean>, matched_relations array<string>, hops int, text string, path_score double, ord int")


def test_pruning(spark):
    d = paths_of(spark)
    got = {r.text: (r.fuzzy_rank, r.pruning_status) for r in rank.prune(d, F.col("path_score"), 4, 2).collect()}
    assert got["t1"] == (1, "preserved") and got["t0"][1] == "precise_pruned" and got["t4"][1] == "fuzzy_pruned"
    chosen = rank.status_prune(d, F.col("path_score"), 5, F.array(F.lit(4), F.lit(9), F.lit(1)), 2).where("pruning_status = 'preserved'").collect()
    assert [r.fuzzy_rank for r in chosen] == [4]
    assert {r.fuzzy_rank for r in rank.status_prune(d, F.col("path_score"), 5, F.array(F.lit(77)), 2).where("pruning_status = 'preserved'").collect()} == {1, 2}
    assert [r.text for r in rank.fuzzy_top(d, F.col("path_score"), 2).orderBy("fuzzy_rank").collect()] == ["t1", "t3"]
    both = rank.prune_for_context(d, F.col("path_score"), 4, 2, "relation_beam")
    assert both.where("pruning_status = 'preserved'").count() == 2 and both.count() == 6
    assert rank.consolidate(d, 3).count() == 3
    assert d.orderBy(*rank.bias_order(F.col("ord"))).first().text == "t1"
    assert d.withColumn("stage", F.col("ord") % 2).orderBy(*rank.stage_order()).first().text == "t0"
    assert d.orderBy("ord").select(rank.compact_text().alias("c")).first().c == "m.s | r.a | r.c | m.0"
    h = rank.local_hint_rerank(d, "r.b", "m 1", "x", ["t1"]).collect()
    assert max(h, key=lambda r: r.path_score).text == "t1"


def test_run_and_validate(spark, store):
    q = spark.createDataFrame([(1, "in which city was the spouse of ann born", ["Rome"]), (2, "where", ["x"])], "qid long, question string, gold array<string>")
    s = spark.createDataFrame([(1, "m.ann")], "qid long, node string")
    for mode in ("relation_beam", "hybrid", "expand"):
        got, seen = question.run(q.drop("gold"), s, store, ["people.person.place_of_birth", "people.marriage.spouse", "people.person.spouse_s"], ["citytown"], mode, 5)
        rows = {r.qid: r for r in got.collect()}
        assert rows[1].sufficient and not rows[2].sufficient and rows[2].predicted == []
        assert {r.stage for r in seen.collect()} == {"retrieval", "pruning"}
    scored, mean = question.validate(q, s, store, [], ["citytown"], mode="hybrid")
    assert scored.count() == 2 and mean.first().samples == 2


def test_types_and_grounding(spark, store):
    rows = spark.createDataFrame([(1, "m.rome"), (1, "m.bob"), (2, "m.bob")], "qid int, target string")
    got = {(r.qid, r.target): (r.before_count, r.after_count) for r in question.counted_type_filter(rows, store, "citytown").collect()}
    assert got == {(1, "m.rome"): (2, 1), (2, "m.bob"): (1, 1)}
    soft = lambda t, *rel: one(spark, question.relation_soft_score(t, F.array(*[F.lit(r) for r in rel])))
    assert soft("river basin", "geo.river.length") == 0.5 and soft("river", "geo.river") == 1.0 and soft(None, "x") == 0.0
    a = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    ids = lambda *args: one(spark, question.seed_ids(*args))
    assert ids(a("m.2", "m.1"), F.lit("m.1"), [], a("r"), a("l")) == ["m.1", "m.2"]
    assert ids(a(), F.lit(None).cast("string"), [a("m.f")], a("r"), a("l")) == ["m.f"] and ids(a(), F.lit(""), [], a(), a("l")) == ["l"]
    end = lambda d: one(spark, question.answer_like(F.lit("Head"), F.lit("Tail"), F.lit(d), a("tail")))
    assert end("answer -> topic entity") == "Head" and end("topic entity -> answer") == "Head" and one(spark, question.answer_like(F.lit("H"), F.lit("T"), F.lit(None).cast("string"), a())) == "T"
    schema = "qid int, ord int, head string, tail string, direction string, anchors array<string>"
    f = spark.createDataFrame([(1, 1, "H", "B", "", []), (1, 0, "H", "A", "", []), (1, 2, "H", "A", "", [])], schema)
    p = spark.createDataFrame([(1, 0, "H", "Z", "", []), (2, 0, "H", "Y", "", [])], schema)
    assert {r.qid: r.labels for r in question.answer_like_labels(f, p).collect()} == {1: ["A", "B"], 2: ["Y"]}
    facts = spark.createDataFrame([(1, "m.a", "Ann", "m.r", "Rome", "it is Rome"), (2, "m.a", "Ann", "", "1961", "no idea")], "qid int, head_id string, head_label string, tail_id string, tail_label string, answer string")
    assert {(r.qid, r.candidate) for r in solve.ground(facts).collect()} == {(1, "m.r"), (2, "1961"), (2, "m.a")}
    t = lambda *x: one(spark, solve.type_evaluation(*[F.lit(v) for v in x]))
    assert [t(True, 0.0, 0.0, False), t(False, 0.8, 0.4, False), t(False, 0.1, 0.6, False), t(False, 0.1, 0.1, True), t(False, 0.0, 0.0, False)] == ["hard", "soft", "embedding", "alias", None]
    m = lambda *x: one(spark, solve.failure_mode(*[F.lit(v) for v in x]))
    assert [m(0, False, False, 1), m(3, True, False, 1), m(30, False, True, 1), m(3, False, True, 9), m(3, False, True, 1), m(3, True, True, 1)] == ["no_paths", "type_mismatch", "branching", "large_seed_set", "insufficient", None]


def test_previews_and_evidence(spark, store):
    c = question.compact(paths_of(spark), 2, 1, 400).first().preview
    assert [x.text for x in c] == ["t0", "t1"] and c[1].matched_relations == ["r.a"]
    assert paths_of(spark).where(question.touching_keyword(["R.B"])).count() == 3
    a = question.attribute_paths(spark.createDataFrame([(1, "m.rome", "founded", "1900")], "qid int, source string, relation string, value string")).first()
    assert a.text == "m.rome -> founded -> 1900" and a.literal
    s = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "a")], "qid int, ord int, text string")
    assert solve.merge_summaries(s).first().texts == ["a", "b"]
    e = spark.createDataFrame([(1, "h", "one", False), (1, "h", "all", True), (1, "k", "two", False)], "qid int, head string, text string, is_bundle boolean")
    assert {r.text for r in solve.compress_evidence(e).collect()} == {"all", "two"}


def test_aggregates(spark, store):
    c = spark.createDataFrame([("loc.size", "size", 0.1, 1, "forward", ["12"]), ("loc.size", "size", 0.1, 2, "reverse", ["12"]), ("loc.name", "name", 0.1, 3, "forward", ["x"])], "relation string, relation_name string, score double, candidate_rank int, direction string, sample_target_names array<string>")
    p = solve.plan_relations(c, "what size", None, True).collect()
    assert [(r.relation, r.direction, r.value_mode) for r in p] == [("loc.size", "forward", "literal"), ("loc.name", "forward", "entity")]
    assert solve.aggregate("count", nodes(spark, "m.ann", "m.bob"), store, ["people.person.place_of_birth", "people.person.spouse_s"], expected_type="citytown").first().value == "1"
    rows = spark.createDataFrame([(1, "a", 2.0, 1), (1, "b", 5.0, 2), (1, "c", None, 3)], "qid int, name string, v double, ord int")
    assert [r.name for r in aggregate.best_rows(rows, "v", "ord").collect()][:1] == ["b"]
    d = spark.createDataFrame([("r", "forward", 0.5, ["city"], ["Rome"])], "relation string, direction string, support_ratio double, sample_target_types array<string>, sample_target_names array<string>")
    assert "relation" in d.columns and callable(aggregate.aggregate_plan_score)


def test_local_neighbours_and_edge_ids(spark):
    e = spark.createDataFrame([("a", "r2", "b", 1), ("c", "r1", "a", 0), ("a", "r1", "d", 2)], "head string, relation string, tail string, ord int")
    assert [(r.neighbor, r.reversed) for r in lookup.local_neighbors(nodes(spark, "a"), e).orderBy("rank").collect()] == [("b", False), ("d", False), ("c", True)]
    t = spark.createDataFrame([("a", "r", "b", "id"), ("a", "r", "b", "id"), ("a", "r", "c", "literal")], "head string, relation string, tail string, tail_kind string")
    assert with_edge_ids(t).select("edge_id").distinct().count() == 3
    assert lookup.neighbors(nodes(spark, "c"), t).count() == 1 and lookup.neighbors(nodes(spark, "c"), t, literal_sources=False).count() == 0


def test_embedding_links(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "item long, vector array<double>")
    m = spark.createDataFrame([(10, [3.0, 0.1]), (11, [0.0, 1.0]), (12, None)], "mention long, vector array<double>")
    for block in (1, 100):
        got = {(r.mention, r.rank): r.item for r in lookup.link_by_embedding(m, c, 2, block).collect()}
        assert got == {(10, 1): 1, (10, 2): 3, (11, 1): 2, (11, 2): 1}


def test_files(spark, tmp_path):
    f = tmp_path / "q.jsonl"
    rows = [json.dumps({"question": f"q{k}", "answer": ["a"], "graph": [["h", "r", "t"], ["bad"]]} | ({"id": "own"} if k == 3 else {})) for k in range(5)]
    f.write_text("\n".join([rows[0], "", *rows[1:]]) + "\n")
    got = files.question_graphs(spark, str(f))
    assert {(r.line, r.id) for r in got.collect()} == {(0, "sample-0"), (2, "sample-2"), (3, "sample-3"), (4, "own"), (5, "sample-5")}
    assert files.question_graphs(spark, str(f), 3).count() == 2 and files.graph_triples(got).count() == 5
    d = spark.createDataFrame([("1", "q", ["a"], ["a"], 1.0, 1.0, "correct")], "id string, question string, predicted array<string>, gold array<string>, exact_match double, recall double, bucket string")
    files.write_predictions(d.drop("bucket"), str(tmp_path / "p"))
    files.write_predictions(d, str(tmp_path / "by"), "bucket")
    (tmp_path / "p" / "broken.json").write_text("{nothing\n")
    done = files.read_predictions(spark, str(tmp_path / "p"))
    assert [r.id for r in done.collect()] == ["1"]
    assert [r.id for r in files.still_to_do(spark.createDataFrame([("1",), ("2",)], "id string"), done).collect()] == ["2"]


def test_csv_round_trip_and_command_line(spark, store, tmp_path, capsys):
    from weftgraph.operators import etl

    files.write_csv(store.entities, etl.with_labels(store.edges, store.entities), str(tmp_path))
    cli.main(["build", f"{tmp_path}/entities", f"{tmp_path}/triplets", f"{tmp_path}/store"])
    g = GraphStore.load(spark, f"{tmp_path}/store")
    assert g.edges.count() == store.edges.count() and g.edges_by_tail.count() == store.edges.count()
    cli.main(["search", f"{tmp_path}/store", "Ann Lee", "--strategy", "bfs", "--depth", "1"])
    assert "people.person.spouse_s" in capsys.readouterr().out
    cli.main(["inspect", f"{tmp_path}/store", "--entity", "rome", "--relation", "founded"])
    assert "m.rome" in capsys.readouterr().out
    (tmp_path / "le.csv").write_text("mid,name,aliases\nm.a,A,x|y\n")
    (tmp_path / "lt.csv").write_text("head,relation,relation_name,tail\nm.a,r,,m.b\nm.a,r,Named,text\n")
    e, t = files.legacy_csv(spark, str(tmp_path / "le.csv"), str(tmp_path / "lt.csv"))
    assert e.first().aliases == ["x", "y"] and {r.tail_kind for r in t.collect()} == {"id", "literal"}
    from weftgraph.operators.store import legacy_catalog

    assert legacy_catalog(t).first().relation_name == "Named"
    assert evaluate.coverage(spark.createDataFrame([(["a", "b"], ["a"], [])], "gold array<string>, graph array<string>, paths array<string>")).first().graph_hits == 1

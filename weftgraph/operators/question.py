"""From questions to answers: parsing, retrieval, evaluation and batches, as DataFrames over all questions at once.

Whatever a language model would decide comes in as a column or a policy with a deterministic default: the parse of a
question (``parsed``: JSON text), the choice of relations (``policy`` of the beam search), the answer (``answer``).
A question is a row ``qid, question``; its seeds are rows ``qid, node``; paths have the columns of ``traverse``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import best_similarity
from ..functions.text import norm_catalog, norm_relation, tolerant_json, tokens, type_names, type_names_of
from . import beam as bm
from .evaluate import average_metrics, score_prediction
from .lookup import metadata, neighbors, resolve_entities
from .rank import annotate_hints, bias_order, prune_for_context, rerank, score_paths, select_diverse, status_prune
from .solve import clean_answers, operation
from .store import GraphStore, small, written
from .traverse import beam_search, bfs_search, simple_paths, two_hop_extensions

# What a relation of a question may be called in a graph besides its own name.
RELATION_QUERIES: dict[str, list[str]] = {
    "leader": ["leader", "religious leader", "head of state", "president", "prime minister", "organization leadership"],
    "mascot": ["mascot", "sports team mascot", "team mascot", "organization mascot"],
    "national anthem": ["national anthem", "anthem of country", "country national anthem"],
    "contained by country": ["contained by country", "administrative parent", "contained by", "country containing", "part of country"],
    "located in region": ["located in region", "contained by region", "administrative parent region", "region containing country"],
}
PARSED = "split_questions array<string>, reasoning_indicator string, topic_entities array<string>, ordered_topic_entities array<string>, predicted_depth int, sub_questions array<struct<id:string,question:string,expected_answer_type:string,solver_type:string,depends_on:array<string>>>"
PATH = ["qid", "seed", "terminal", "literal", "nodes", "relations", "reversed", "hops", "text"]


def _strings(c: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, empty), lambda x: F.trim(x)), lambda x: x != ""))


def parse(questions: DataFrame, dmax: int = 3) -> DataFrame:
    """``qid, question, parsed`` (and optionally ``topics``, which override the parse) to the analysis of each question.

    A parse that is no object gives one sub-question: the question itself. The depth is the predicted one, or the number
    of topics, within 1, the number of sub-questions and ``dmax``.
    """
    p = questions.withColumn("p", tolerant_json(F.col("parsed"), PARSED))
    given = _strings(F.col("topics")) if "topics" in questions.columns else F.array().cast("array<string>")
    topics = F.when(F.size(given) > 0, given).otherwise(_strings(F.col("p.topic_entities")))
    ordered = F.when(F.size(_strings(F.col("p.ordered_topic_entities"))) > 0, _strings(F.col("p.ordered_topic_entities"))).otherwise(F.col("topic_entities"))
    own = F.struct(F.lit("sq1").alias("id"), F.col("question").alias("question"), F.lit(None).cast("string").alias("expected_answer_type"), F.lit(None).cast("string").alias("solver_type"), F.array().cast("array<string>").alias("depends_on"))
    subs = F.coalesce(F.col("p.sub_questions"), F.array().cast("array<struct<id:string,question:string,expected_answer_type:string,solver_type:string,depends_on:array<string>>>"))
    subs = F.filter(subs, lambda s: F.trim(F.coalesce(s["question"], F.lit(""))) != "")
    d = p.withColumn("topic_entities", topics).withColumn("ordered_topic_entities", ordered)
    d = d.withColumn("sub_questions", F.when(F.size(subs) > 0, subs).otherwise(F.array(own)))
    splits = _strings(F.col("p.split_questions"))
    depth = F.coalesce(F.col("p.predicted_depth"), F.least(F.greatest(F.lit(1), F.size("topic_entities")), F.lit(dmax)))
    return d.select(
        "qid", "question", "topic_entities", "ordered_topic_entities", "sub_questions",
        F.when(F.size(splits) > 0, splits).otherwise(F.array("question")).alias("split_questions"),
        F.coalesce(F.nullif(F.trim("p.reasoning_indicator"), F.lit("")), "question").alias("reasoning_indicator"),
        F.greatest(F.lit(1), F.least(depth, F.size("sub_questions"), F.lit(dmax))).alias("predicted_depth"),
    )


def sub_questions(analysed: DataFrame) -> DataFrame:
    """One row per sub-question, with the solver its words ask for where the parse names none.

    A ``verify`` that depends on nothing but repeats another sub-question's words is dropped.
    """
    d = analysed.select("qid", F.posexplode("sub_questions").alias("ord", "s")).select("qid", "ord", F.coalesce(F.nullif(F.trim("s.id"), F.lit("")), F.concat(F.lit("sq"), F.col("ord") + 1)).alias("sub_id"), "s.question", "s.expected_answer_type", F.lower(F.trim("s.solver_type")).alias("named"), F.coalesce("s.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    kind = F.when(F.col("named").isin("aggregate", "verify", "constrained_collect", "explore"), F.col("named")).when(operation(F.col("question")).isNotNull(), "aggregate").otherwise("explore")
    d = d.withColumn("solver_type", kind).drop("named")
    d = d.withColumn("__first", F.min("ord").over(Window.partitionBy("qid", norm_catalog(F.col("question")))))
    return d.where((F.col("solver_type") != "verify") | (F.size("depends_on") > 0) | (F.col("ord") == F.col("__first"))).drop("__first")


def relation_queries(hints: DataFrame) -> DataFrame:
    """``hint`` to ``hint, name``: the names under which a relation is looked up."""
    table = F.create_map(*[x for k, v in RELATION_QUERIES.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    more = F.coalesce(F.try_element_at(table, norm_relation(F.col("hint"))), F.array().cast("array<string>"))
    return hints.select("hint", F.explode(F.array_distinct(F.concat(F.array("hint"), more))).alias("name")).where(F.trim("name") != "")


def recall(mentions: DataFrame, store: GraphStore, top_k: int = 10, typed_top_k: int | None = None) -> DataFrame:
    """Candidates of mentions (``mention, variant, expected_type``): the best score per entity over a mention's variants.

    Mentions with an expected type are recalled wider: ``typed_top_k``, or six times as many, from 60 to 150.
    """
    base = max(3, top_k)
    wide = max(base, typed_top_k) if typed_top_k else max(base, min(max(base * 6, 60), 150))
    found = resolve_entities(mentions.select(F.col("variant").alias("mention")).distinct(), store, wide)
    d = mentions.join(found.select(F.col("mention").alias("variant"), "mid", "match_type", "score"), "variant")
    d = d.groupBy("mention", "expected_type", "mid").agg(F.max("score").alias("score"), F.max_by("match_type", "score").alias("match_type"))
    w = Window.partitionBy("mention").orderBy(F.desc("score"), "mid")
    typed = F.trim(F.coalesce("expected_type", F.lit(""))) != ""
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.when(typed, wide).otherwise(base))


def relation_groups(seeds: DataFrame, store: GraphStore, limit: int = 25, most: int = 12) -> DataFrame:
    """Per question, the relations next to its seeds with their distinct targets' names: ``qid, relation, display, targets``."""
    near = neighbors(seeds.select("node").distinct(), store.edges, limit=limit)
    d = seeds.select("qid", "node").distinct().join(near, "node")
    d = d.join(metadata(d.select(F.col("neighbor").alias("node")), store).select(F.col("node").alias("neighbor"), "name"), "neighbor")
    d = d.groupBy("qid", "relation").agg(F.array_sort(F.collect_set("name")).alias("targets"), F.count_distinct("node").alias("seeds"))
    return d.join(small(store.relations.select("relation", "display")), "relation").select("qid", "relation", "display", F.slice("targets", 1, most).alias("targets"), "seeds")


def probe_relations(groups: DataFrame, questions: DataFrame, paths: DataFrame, top_k: int = 3) -> DataFrame:
    """The local relations that speak to a question most (word overlap with name, then targets), those of its beam kept.

    ``questions``: ``qid, question``; ``paths``: paths found so far (``qid, relations``). ``qid, relation, probe_score``.
    """
    used = paths.select("qid", F.explode("relations").alias("relation")).distinct().withColumn("beam", F.lit(1))
    d = groups.join(questions.select("qid", "question"), "qid").join(used, ["qid", "relation"], "left")
    q = tokens(norm_relation(F.col("question")))
    hit = lambda text: F.size(F.array_intersect(q, tokens(norm_relation(text)))) / F.greatest(F.size(q), F.lit(1))
    score = 10.0 * hit(F.concat_ws(" ", "relation", "display")) + 2.0 * hit(F.concat_ws(" ", "targets")) + F.when(F.col("beam") == 1, 1.0).otherwise(0.0)
    w = Window.partitionBy("qid").orderBy(F.desc("probe_score"), "relation")
    d = d.withColumn("probe_score", F.round(score, 6)).withColumn("n", F.row_number().over(w))
    return d.where((F.col("n") <= top_k) | (F.col("beam") == 1)).select("qid", "relation", "probe_score")


def probe_paths(seeds: DataFrame, store: GraphStore, relations: list[str], depth: int = 2, max_paths: int = 50, terms: list[str] | None = None) -> DataFrame:
    """Paths by these relations only, and soft two-hop extensions; with terms, those whose text names one of them."""
    strict = simple_paths(seeds, store.edges, depth, max_paths=max_paths, relations=relations, literals=True)
    soft = two_hop_extensions(seeds, store.edges, max_paths)
    d = strict.select(PATH).withColumn("stage", F.lit(0)).unionByName(soft.select(PATH).withColumn("stage", F.lit(1)))
    if terms:
        text = norm_relation(F.col("text"))
        d = d.where(reduce(lambda a, b: a | b, [F.contains(text, norm_relation(F.lit(t))) for t in terms]))
    w = Window.partitionBy("qid", "seed", "nodes", "relations", "reversed").orderBy("stage")
    return annotate_hints(d.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"), relations)


def expand_external(paths: DataFrame, store: GraphStore, hints: list[str], limit: int = 20, top_hints: int = 5) -> DataFrame:
    """One hop further at both ends of paths, by the first hints, to nodes whose label no path of the question has yet.

    Each new label is taken once per question: by the first path, at its beginning before its end.
    """
    few = hints[: max(1, top_hints)]
    labels = store.entities.select("mid", F.coalesce(F.nullif("name", F.lit("")), "mid").alias("label"))
    p = written(paths.select(PATH).withColumn("pid", F.xxhash64("qid", "seed", F.col("nodes").cast("string"), F.col("relations").cast("string"))))
    ends = p.select("qid", "pid", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.element_at("nodes", 1).alias("node")), F.struct(F.lit(1).alias("side"), F.element_at("nodes", -1).alias("node")))).alias("e")).select("qid", "pid", "e.*")
    near = neighbors(ends.select("node").distinct(), store.edges, few, bool(few), limit)
    near = near.join(labels.select(F.col("mid").alias("neighbor"), "label"), "neighbor", "left").withColumn("label", F.coalesce("label", "neighbor"))
    seen = p.select("qid", F.explode("nodes").alias("mid")).distinct().join(labels, "mid", "left").select("qid", F.coalesce("label", "mid").alias("label")).distinct()
    d = ends.join(near.select("node", "relation", "neighbor", F.col("reversed").alias("back"), "rank", "label"), "node").join(seen, ["qid", "label"], "left_anti")
    w = Window.partitionBy("qid", "label").orderBy("pid", "side", "rank")
    d = d.withColumn("__n", F.row_number().over(w)).where("__n = 1").join(p.drop("qid"), "pid")
    front = F.col("side") == 0
    put = lambda new, old, at: F.when(front, F.concat(F.array(new), old)).otherwise(F.concat(old, F.array(new)))  # noqa: E731, ARG005
    # A step put before the path is walked from the new node, so its direction turns.
    out = d.select("qid", F.when(front, F.col("neighbor")).otherwise(F.col("seed")).alias("seed"), F.when(front, F.col("terminal")).otherwise(F.col("neighbor")).alias("terminal"), F.lit(False).alias("literal"), put(F.col("neighbor"), F.col("nodes"), 0).alias("nodes"), put(F.col("relation"), F.col("relations"), 0).alias("relations"), F.when(front, F.concat(F.array(~F.col("back")), "reversed")).otherwise(F.concat("reversed", F.array("back"))).alias("reversed"), (F.col("hops") + 1).alias("hops"))
    from .traverse import text_of

    return annotate_hints(out.withColumn("text", text_of(F.col("nodes"), F.col("relations"), F.col("reversed"))), few)


def bootstrap_paths(mentions: DataFrame, store: GraphStore, hints: list[str], limit: int = 20) -> DataFrame:
    """Paths of one and two hops around a question's resolved mentions (``qid, mention``), best hints first (``ord``)."""
    found = resolve_entities(mentions.select("mention").distinct(), store, 1)
    seeds = mentions.join(found, "mention").select("qid", F.col("mid").alias("node")).distinct()
    d = annotate_hints(two_hop_extensions(seeds, store.edges, limit), hints)
    return d.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy(*bias_order(F.col("text")))))


def external_paths(seeds: DataFrame, store: GraphStore, hints: list[str], type_hints: list[str], mode: str = "hybrid", depth: int = 2, max_paths: int = 50, fallback: bool = True) -> DataFrame:
    """Question-level expansion from seeds: several searches together (``hybrid``) or simple paths along the hints
    (``expand``); questions without a path get their two-hop extensions (``fallback``)."""
    if mode == "hybrid":
        score = lambda p: score_paths(p.withColumn("text", F.lit("")), store, hints, type_hints).select(*p.columns, "path_score")
        d = beam_search(seeds, store.edges, score, depth, 10, hints).select(PATH).unionByName(bfs_search(seeds, store.edges, depth, 0, max_paths, 0, hints).select(PATH))
    else:
        d = simple_paths(seeds, store.edges, depth, max_paths=max_paths, relations=hints, literals=True).select(PATH)
    d = written(d.dropDuplicates(["qid", "seed", "nodes", "relations", "reversed"]))
    if fallback:
        rest = seeds.select("qid", "node").distinct().join(d.select("qid").distinct(), "qid", "left_anti")
        d = d.unionByName(two_hop_extensions(rest, store.edges, max_paths).select(PATH))
    return d


def retrieve(questions: DataFrame, seeds: DataFrame, store: GraphStore, hints: list[str], type_hints: list[str], mode: str = "relation_beam", config: bm.BeamConfig | None = None, policy: Callable = bm.default_policy, **more) -> DataFrame:
    """The retrieval step: relation beam over the graph (its evidence as paths), or ``external_paths``.

    Questions for which the beam finds nothing go the other way.
    """
    if mode != "relation_beam":
        return external_paths(seeds, store, hints, type_hints, mode, **more).withColumn("path_score", F.lit(0.0))
    start = seeds.join(questions.select("qid", F.col("question").alias("query")), "qid").select("qid", "query", "node")
    s, f = bm.search(start, store, config, policy)
    d = written(bm.evidence_paths(bm.answers(s, f)).select(*PATH, "path_score"))
    rest = seeds.join(d.select("qid").distinct(), "qid", "left_anti")
    return d.unionByName(external_paths(rest, store, hints, type_hints, "hybrid", **more).withColumn("path_score", F.lit(0.0)))


def evaluate_paths(paths: DataFrame, store: GraphStore, hints: list[str], type_hints: list[str], wmax: int = 3, w1: int = 30, explorer: str = "hybrid") -> DataFrame:
    """Paths ranked, made diverse, pruned, with the answer each proposes: ``... rank, pruning_status, answer``.

    The proposed answer is the end's name (its id, if unnamed; a literal as it is); mediators propose nothing.
    """
    d = rerank(score_paths(paths.select(PATH), store, hints, type_hints))
    d = select_diverse(d, max(w1, wmax)).withColumn("ord", F.col("selected_rank"))
    d = written(prune_for_context(d, F.col("path_score"), w1, wmax, explorer))
    m = metadata(d.select(F.col("terminal").alias("node")), store).select(F.col("node").alias("terminal"), F.when(~F.col("is_probable_cvt"), F.col("name")).alias("answer"))
    return d.join(m, "terminal", "left")


def answers(evaluated: DataFrame, most: int = 10) -> DataFrame:
    """``qid, predicted, candidate_paths, sufficient``: the distinct answers of the preserved paths, in their order."""
    kept = evaluated.where("pruning_status = 'preserved'")
    d = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("answer").isNotNull(), F.struct("ord", "answer")))).alias("x"), F.count(F.lit(1)).alias("candidate_paths"))
    d = d.select("qid", F.slice(clean_answers(F.transform("x", lambda s: s["answer"])), 1, most).alias("predicted"), "candidate_paths")
    return d.withColumn("sufficient", F.size("predicted") > 0)


def run(questions: DataFrame, seeds: DataFrame, store: GraphStore, hints: list[str], type_hints: list[str], mode: str = "relation_beam", wmax: int = 3, **more) -> tuple[DataFrame, DataFrame]:
    """The whole way for a batch: answers (``qid, question, predicted, ...``) and a trace of its stages.

    ``mode``: ``relation_beam`` (the default), ``hybrid`` or ``expand`` (external expansion only).
    """
    found = written(retrieve(questions, seeds, store, hints, type_hints, mode, **more))
    judged = evaluate_paths(found, store, hints, type_hints, wmax, explorer=mode)
    got = written(answers(judged))
    out = questions.join(got, "qid", "left").select("qid", "question", F.coalesce("predicted", F.array().cast("array<string>")).alias("predicted"), F.coalesce("candidate_paths", F.lit(0)).alias("candidate_paths"), F.coalesce("sufficient", F.lit(False)).alias("sufficient"))
    return out, trace([("retrieval", found, None), ("pruning", judged, F.col("pruning_status") != "preserved")], got)


def trace(stages: list[tuple[str, DataFrame, Column | None]], answered: DataFrame) -> DataFrame:
    """``qid, stage, depth, candidate_count, pruned_count, sufficient``: one row per question and stage."""
    rows = [d.groupBy("qid").agg(F.max("hops").alias("depth"), F.count(F.lit(1)).alias("candidate_count"), (F.count_if(gone) if gone is not None else F.lit(0).cast("long")).alias("pruned_count")).withColumn("stage", F.lit(name)) for name, d, gone in stages]
    d = reduce(DataFrame.unionByName, rows).join(answered.select("qid", "sufficient"), "qid", "left")
    return d.select("qid", "stage", "depth", "candidate_count", "pruned_count", F.coalesce("sufficient", F.lit(False)).alias("sufficient"))


def validate(samples: DataFrame, seeds: DataFrame, store: GraphStore, hints: list[str], type_hints: list[str], **more) -> tuple[DataFrame, DataFrame]:
    """All samples (``qid, question, gold``) in one batch: scored predictions, and their averages."""
    got, _ = run(samples.select("qid", "question"), seeds, store, hints, type_hints, **more)
    scored = written(score_prediction(got.join(samples.select("qid", "gold"), "qid")))
    return scored, average_metrics(scored, "candidate_paths")


def counted_type_filter(rows: DataFrame, store: GraphStore, expected_type: str | None, node: str = "target") -> DataFrame:
    """Keeps nodes of the expected type, with ``before_count`` and ``after_count`` of distinct nodes per question.

    Where no node has the type, or none is expected, all stay.
    """
    names = type_names(expected_type)
    m = metadata(rows.select(F.col(node).alias("node")).distinct(), store)
    hay = norm_catalog(F.concat_ws(" ", "types"))
    ok = reduce(lambda a, b: a | b, [F.contains(hay, F.lit(n)) for n in names]) & ~F.col("is_literal") if names else F.lit(True)
    d = rows.join(m.select(F.col("node").alias(node), ok.alias("__ok")), node)
    q = Window.partitionBy("qid")
    d = d.withColumn("before_count", F.size(F.collect_set(node).over(q))).withColumn("__n", F.size(F.collect_set(F.when(F.col("__ok"), F.col(node))).over(q)))
    d = d.where(F.col("__ok") | (F.col("__n") == 0))
    return d.select(*rows.columns, "before_count", F.when(F.col("__n") == 0, F.col("before_count")).otherwise(F.col("__n")).alias("after_count"))


def relation_soft_score(expected_type: str | None, relation_texts: Column) -> Column:
    """1 if a relation names the type, else the best share of the type's longer words among a relation's."""
    score = F.lit(0.0)
    for alias in type_names(expected_type):
        words = F.array(*[F.lit(w) for w in alias.split() if len(w) > 2]).cast("array<string>")
        one = lambda t: F.when(F.contains(norm_relation(t), F.lit(alias)), 1.0).otherwise(F.size(F.array_intersect(tokens(norm_relation(t)), words)) / F.greatest(F.size(words), F.lit(1)))  # noqa: B023, E731
        score = F.greatest(score, F.coalesce(F.array_max(F.transform(relation_texts, one)), F.lit(0.0)))
    return score


def embedding_soft_score(expected_type: Column, texts: Column) -> Column:
    """How close the best of some texts (an array) is to any name of the expected type, by their vectors; 0 without either."""
    return best_similarity(type_names_of(expected_type), texts)


def seed_ids(entity_ids: Column, primary: Column, fact_ids: list[Column], resolved: Column, legacy: Column) -> Column:
    """The seeds that an earlier answer gives: its grounded ids, the primary first; else the ids of its facts; else what its
    texts resolve to; else the ids as they were given."""
    some = lambda c: F.when(F.size(_strings(c)) > 0, _strings(c))
    empty = F.array().cast("array<string>")
    first = F.concat(F.when(F.trim(F.coalesce(primary, F.lit(""))) != "", F.array(primary)).otherwise(empty), F.coalesce(entity_ids, empty))
    facts = F.concat(*[F.coalesce(c, empty) for c in fact_ids]) if fact_ids else empty
    return F.coalesce(some(first), some(facts), some(resolved), _strings(legacy))


def answer_like(head: Column, tail: Column, direction: Column, anchors: Column) -> Column:
    """The end of a fact that answers: the tail, or by an "answer -> topic entity" direction the head, unless it is an anchor."""
    d = norm_relation(F.coalesce(direction, F.lit("")))
    free = lambda c: F.when((norm_relation(c) != "") & ~F.array_contains(F.transform(anchors, norm_relation), norm_relation(c)), F.trim(c))
    return F.when(F.contains(d, F.lit("answer topic entity")), F.coalesce(free(head), free(tail))).otherwise(F.coalesce(free(tail), free(head)))


def answer_like_labels(facts: DataFrame, paths: DataFrame, most: int = 3) -> DataFrame:
    """``qid, labels``: from facts (``qid, ord, head, tail, direction, anchors``), else from the ends of paths of that form."""
    def pick(d: DataFrame, at: int) -> DataFrame:
        return d.select("qid", F.lit(at).alias("source"), "ord", answer_like(F.col("head"), F.col("tail"), F.col("direction"), F.col("anchors")).alias("label")).where("label IS NOT NULL")

    d = pick(facts, 0).unionByName(pick(paths, 1))
    d = d.withColumn("best", F.min("source").over(Window.partitionBy("qid"))).where("source = best")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda s: s["label"])
    return d.groupBy("qid").agg(F.slice(F.array_distinct(ordered), 1, most).alias("labels"))


def compact(paths: DataFrame, most_paths: int = 8, most_relations: int = 4, most_chars: int = 400) -> DataFrame:
    """A bounded preview of ranked paths (``ord``) per question: text cut to ``most_chars``, the first matched relations."""
    w = Window.partitionBy("qid").orderBy("ord")
    d = paths.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most_paths)
    text = F.when(F.length("text") > most_chars, F.concat(F.substring("text", 1, most_chars - 3), F.lit("..."))).otherwise(F.col("text"))
    return d.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("__n", text.alias("text"), F.slice("matched_relations", 1, most_relations).alias("matched_relations")))).alias("x")).select("qid", F.transform("x", lambda s: F.struct(s["text"].alias("text"), s["matched_relations"].alias("matched_relations"))).alias("preview"))


def touching_keyword(words: list[str]) -> Column:
    """Whether a path's text, nodes or relations hold any of the words (lower case)."""
    hay = F.transform(F.concat(F.array("text"), "nodes", "relations"), F.lower)
    return F.exists(hay, lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w.lower())) for w in words]))


def attribute_paths(rows: DataFrame) -> DataFrame:
    """Attribute rows (``qid, source, relation, value``) as one-hop paths."""
    from .traverse import text_of

    d = rows.select("qid", F.col("source").alias("seed"), F.col("value").alias("terminal"), (~F.col("value").rlike(r"^[mg]\.")).alias("literal"), F.array("source", "value").alias("nodes"), F.array("relation").alias("relations"), F.array(F.lit(False)).alias("reversed"), F.lit(1).alias("hops"))
    return d.withColumn("text", text_of(F.col("nodes"), F.col("relations"), F.col("reversed")))

"""Typed sub-questions over the graph: routing, collecting, verifying, aggregating, waves over a DAG, grounding.

A batch of sub-questions is a DataFrame; decisions that a language model could take are policies with deterministic
defaults (``operators.beam.default_policy``, the functions here).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_catalog, norm_ws, overlap_max, tokens, type_names
from .aggregate import collect_constrained, collect_entities, intersect_sets, rank_numeric
from .lookup import metadata, pair_check, two_hop_between
from .store import GraphStore, small, written

# The words and phrases that name an operation, in order of precedence, and texts that mean "no answer".
ARGMAX = ["most", "largest", "highest", "biggest", "longest", "latest"]
ARGMIN = ["least", "smallest", "lowest", "earliest", "shortest"]
INTERSECT, INTERSECT_PHRASES = ["intersection", "overlap", "same", "shared", "both", "also"], ["among these"]
COUNT, COUNT_PHRASES = ["count"], ["how many", "number of"]
FAILURES = ["insufficient", "not enough", "cannot determine", "can't determine", "no answer", "no evidence", "not found", "unable to", "unknown", "none", "null"]


def operation(question: Column) -> Column:
    """argmax, argmin, intersect, count or null, in this order of precedence."""
    q = norm_ws(question)
    t = F.regexp_extract_all(q, F.lit("([a-z0-9]+)"), 1)
    has = lambda ws: F.arrays_overlap(t, F.array(*[F.lit(w) for w in ws]))
    says = lambda ps: reduce(lambda a, b: a | b, [F.contains(q, F.lit(p)) for p in ps])
    return F.when(has(ARGMAX), "argmax").when(has(ARGMIN), "argmin").when(says(INTERSECT_PHRASES) | has(INTERSECT), "intersect").when(says(COUNT_PHRASES) | has(COUNT), "count")


def route(kind: Column, has_dependencies: Column, has_anchors: Column) -> Column:
    """The solver of a sub-question; what cannot be served elsewhere is explored."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(k.isin("aggregate", "constrained_collect"), k).when((k == "verify") & (has_dependencies | has_anchors), "verify").otherwise("explore")


def verify(pairs: DataFrame, edges: DataFrame, relations: list[str] | None = None, limit: int = 50, two_hop_limit: int = 48) -> DataFrame:
    """For (source, target) pairs: direct edges either way; for pairs without, two-hop connections.

    The pairs and what is found of them are written, so that the joins know their size: as long as they are small, edges
    are scanned and never shuffled.
    """
    pairs = written(pairs.select("source", "target").distinct())
    direct = pair_check(pairs, edges, relations).select("source", "target", F.lit(1).alias("hops"), F.concat_ws(" ", "relation", F.when(F.col("reversed"), "(reverse)")).alias("evidence"))
    direct = written(direct)
    rest = pairs.join(direct.select("source", "target").distinct(), ["source", "target"], "left_anti")
    rest = written(rest)
    two = two_hop_between(rest.select(F.col("source").alias("node")), rest.select(F.col("target").alias("node")), edges, relations)
    two = two.join(small(rest), ["source", "target"]).select("source", "target", F.lit(2).alias("hops"), F.concat_ws(" -> ", "r1", "mid", "r2").alias("evidence"))
    w = Window.partitionBy("source", "target", "hops").orderBy("evidence")
    d = direct.unionByName(two).withColumn("n", F.row_number().over(w))
    return d.where((F.col("n") <= limit) & ((F.col("hops") == 1) | (F.col("n") <= two_hop_limit)))


def type_filter(rows: DataFrame, store: GraphStore, expected_type: str, node: str = "target") -> DataFrame:
    """Rows whose node has the type, by any of its names; nodes unknown to the graph go."""
    m = metadata(rows.select(F.col(node).alias("node")), store).where("NOT is_literal")
    hay = norm_catalog(F.concat_ws(" ", "types"))
    ok = F.exists(F.array(*[F.lit(n) for n in type_names(expected_type)]), lambda n: F.contains(hay, n))
    return rows.join(m.where(ok).select(F.col("node").alias(node)), node, "left_semi").select(rows.columns)


def plan_relations(candidates: DataFrame, question: str, expected_type: str | None, numeric: bool, top: int = 3) -> DataFrame:
    """Relations for an aggregate: 3 x score, 12 x overlap with the question, 10 for a type name, 3 and 2 for numbers."""
    name = F.concat_ws(" ", "relation", "relation_name")
    hit = F.exists(F.array(*[F.lit(n) for n in type_names(expected_type)] or [F.lit("\0")]), lambda n: F.contains(norm_catalog(name), n))
    num = norm_catalog(name).rlike("number|date|year|amount|price|size|quantity|count|total|balance|acctbal")
    sample = F.exists(F.coalesce("sample_target_names", F.array().cast("array<string>")), lambda s: s.rlike(r"^[-+]?\d"))
    s = 3.0 * F.col("score") + 12.0 * overlap_max(F.lit(question), norm_catalog(name)) + F.when(hit, 10.0).otherwise(0.0) + F.when(F.lit(numeric) & num, 3.0).otherwise(0.0) + F.when(F.lit(numeric) & sample, 2.0).otherwise(0.0)
    # Equal scores follow the candidates' own rank; the direction is the best row's of each relation.
    if "candidate_rank" in candidates.columns:
        s = s - 1e-4 * F.col("candidate_rank")
    d = candidates.withColumn("plan_score", F.round(s, 6)).withColumn("value_mode", F.when(F.lit(numeric) & (num | sample), "literal").otherwise("entity"))
    if "direction" in candidates.columns:
        w = Window.partitionBy("relation").orderBy(F.desc("plan_score"), "direction")
        d = d.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return d.orderBy(F.desc("plan_score"), "relation").limit(top)


def aggregate(op: str, sources: DataFrame, store: GraphStore, relations: list[str], sets: DataFrame | None = None, direction: str = "forward", limit: int = 100, expected_type: str | None = None) -> DataFrame:
    """``value``: an intersection, a count, the best sources by a number, or the collected targets."""
    if op == "intersect" and sets is not None:
        return intersect_sets(sets).select(F.col("entity").alias("value"))
    if op == "count":
        found = collect_entities(sources, store.edges, relations, direction)
        if expected_type:
            found = type_filter(found, store, expected_type)
        return found.agg(F.countDistinct("target").cast("string").alias("value"))
    if op in ("argmax", "argmin"):
        return rank_numeric(sources, store.edges, relations, op == "argmax", 1).select(F.col("node").alias("value"))
    return collect_entities(sources, store.edges, relations, direction, limit).select(F.col("target").alias("value")).distinct()


def constrained(sources: DataFrame, store: GraphStore, relations: list[str], expected_type: str | None, terms: list[str], seeds: int, targets: DataFrame | None = None) -> DataFrame:
    d = collect_constrained(sources, store, relations, expected_type, terms, max(8, min(40, 6 * seeds)))
    return d.join(small(targets.select(F.col("node").alias("target"))), "target", "left_semi") if targets is not None else d


def waves(subquestions: DataFrame, solve: Callable[[DataFrame, DataFrame], DataFrame], max_loops: int = 5) -> DataFrame:
    """Answers (``qid, sub_id, value``) of a DAG (``qid, sub_id, depends_on``): each wave solves what is ready, for all questions.

    ``solve(ready, inputs)`` gives the answers of the ready sub-questions; ``inputs`` are (qid, sub_id, value) of what
    they depend on. A sub-question without an answer stops those that need it.
    """
    spark = subquestions.sparkSession
    got = spark.createDataFrame([], "qid long, sub_id string, value string")
    open_ = subquestions
    for _ in range(max_loops):
        need = open_.select("qid", "sub_id", F.explode_outer("depends_on").alias("dep"))
        have = got.select("qid", F.col("sub_id").alias("dep"), F.lit(1).alias("ok")).distinct()
        ready = need.join(have, ["qid", "dep"], "left").groupBy("qid", "sub_id").agg(F.min(F.when(F.col("dep").isNull(), 1).otherwise(F.coalesce("ok", F.lit(0)))).alias("ok")).where("ok = 1").drop("ok")
        ready = open_.join(ready, ["qid", "sub_id"], "left_semi")
        if not ready.limit(1).count():
            break
        inputs = ready.select("qid", "sub_id", F.explode("depends_on").alias("dep")).join(got.withColumnRenamed("sub_id", "dep"), ["qid", "dep"]).select("qid", "sub_id", "value").distinct()
        new = solve(ready, inputs).select("qid", "sub_id", "value")
        got = got.union(written(new))
        open_ = open_.join(ready.select("qid", "sub_id"), ["qid", "sub_id"], "left_anti")
    return got


def failed_text(c: Column) -> Column:
    t = norm_ws(c)
    return F.exists(F.array(*[F.lit(x) for x in FAILURES]), lambda x: F.contains(t, x)) | (t == "")


def clean_answers(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: ~failed_text(x)))


def ground(facts: DataFrame, answers_col: str = "answer") -> DataFrame:
    """``qid, candidate, score``: ends of facts that the answer names, tails before heads, readable ones first.

    Facts: ``qid, head_id, head_label, tail_id, tail_label`` and the answer text. Where no end is named, all stay.
    """
    ends = F.array(F.struct(F.col("tail_id").alias("id"), F.col("tail_label").alias("label"), F.lit(2.0).alias("w")), F.struct(F.col("head_id").alias("id"), F.col("head_label").alias("label"), F.lit(-1.5).alias("w")))
    d = facts.select("qid", F.col(answers_col).alias("a"), F.explode(ends).alias("e")).select("qid", "a", "e.id", "e.label", "e.w")
    d = d.withColumn("named", F.contains(norm_ws(F.col("a")), norm_ws(F.col("label"))) & (F.col("label") != ""))
    d = d.withColumn("score", F.col("w") + F.when(F.col("label").rlike(r"^[mg]\."), -1.0).otherwise(1.0))
    d = d.groupBy("qid", F.coalesce(F.nullif("id", F.lit("")), "label").alias("candidate")).agg(F.max("score").alias("score"), F.max("named").alias("named"))
    w = F.max(F.col("named").cast("int")).over(Window.partitionBy("qid"))
    return d.withColumn("any", w).where("named OR any = 0").select("qid", "candidate", "score")


def type_evaluation(hard: Column, relation_score: Column, embedding_score: Column, alias: Column) -> Column:
    """How an answer's type was accepted, or null: hard, soft (relation >= .72 and embedding >= .32), embedding (>= .58), alias."""
    return F.when(hard, "hard").when((relation_score >= 0.72) & (embedding_score >= 0.32), "soft").when(embedding_score >= 0.58, "embedding").when(alias, "alias")


def failure_mode(paths: Column, answered: Column, typed: Column, seeds: Column, branching: int = 12, many_seeds: int = 4) -> Column:
    """Why a sub-question failed, which decides how the retry relaxes it."""
    return F.when(paths == 0, "no_paths").when(answered & ~typed, "type_mismatch").when(paths > branching, "branching").when(seeds > many_seeds, "large_seed_set").when(~answered, "insufficient")


def merge_summaries(rows: DataFrame) -> DataFrame:
    """Facts of sub-questions of a question, each where it first occurs: ``qid, ord, text`` to ``qid, texts``."""
    w = Window.partitionBy("qid", "text").orderBy("ord")
    d = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return d.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]).alias("texts"))


def compress_evidence(lines: DataFrame) -> DataFrame:
    """Bundle lines (``is_bundle``) make the single lines of the same head superfluous: ``qid, head, text, is_bundle``."""
    b = lines.where("is_bundle").select("qid", "head").distinct()
    return lines.where("is_bundle").unionByName(lines.where("NOT is_bundle").join(b, ["qid", "head"], "left_anti"))

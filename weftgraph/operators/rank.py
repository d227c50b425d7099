"""Scoring, de-duplication and diverse selection of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import similarity
from ..functions.text import is_id, norm_relation, overlap_left, tokens
from .order import group_places, top
from .store import GraphStore, written
from .traverse import beam_search, bfs_search, edge_key, meeting_paths, two_hop_extensions


def annotate_hints(paths: DataFrame, hints: list[str]) -> DataFrame:
    """``matched_relations``: the hints a path uses, in the hints' order."""
    return paths.withColumn("matched_relations", F.array_intersect(F.array(*[F.lit(h) for h in hints]).cast("array<string>"), F.col("relations")))


def score_paths(paths: DataFrame, store: GraphStore, hints: list[str], type_hints: list[str], prefer_short: bool = True, reward_literals: bool = False, threshold: int = 500) -> DataFrame:
    """Adds ``path_score`` and its parts: hints, types, rarity of relations, literal ends, hops, degree of the end."""
    if not store.saved:
        paths = written(paths)  # read twice: for the ends' degrees, and to be scored
    d = annotate_hints(paths, hints)
    last = F.get("relations", F.size("relations") - 1)
    end = F.lower(F.concat_ws(" ", "terminal", F.when(F.col("literal"), "literal").otherwise("id"), F.array_join(F.split(last, r"\."), " ")))
    wanted = sorted({h.strip().lower() for h in type_hints if h.strip()})
    d = d.withColumn("matched_types", F.filter(F.array(*[F.lit(w) for w in wanted]).cast("array<string>"), lambda w: F.contains(end, w)))
    # Relations are few: their frequencies go along as one map.
    freq = store.relation_stats.agg(F.map_from_entries(F.collect_list(F.struct("relation", "frequency"))).alias("freq"))
    d = d.crossJoin(F.broadcast(freq))
    rarity = F.aggregate("relations", F.lit(0.0), lambda s, r: s + F.coalesce(F.least(F.lit(3.0), 1.0 / F.log10(F.try_element_at("freq", r) + 10.0)), F.lit(0.0)))
    deg = store.degrees(paths.select(F.col("terminal").alias("node"))).withColumnRenamed("mid", "terminal")
    d = d.withColumn("rarity_bonus", rarity).drop("freq").join(deg, "terminal", "left")
    parts = {
        "relation_hits": F.size("matched_relations") * 10.0,
        "answer_type_bonus": F.size("matched_types") * 6.0,
        "literal_bonus": F.when(F.col("literal"), 2.0 if reward_literals else -1.0).otherwise(0.0),
        "hop_penalty": F.col("hops") * (-1.5 if prefer_short else 0.0),
        "high_degree_penalty": F.when(is_id(F.col("terminal")) & (F.coalesce("degree", F.lit(0)) >= threshold), -2.0).otherwise(0.0),
    }
    d = d.withColumns(parts).drop("degree")
    total = F.col("relation_hits") + F.col("answer_type_bonus") + F.col("rarity_bonus") + F.col("literal_bonus") + F.col("hop_penalty") + F.col("high_degree_penalty")
    return d.withColumn("path_score", F.round(total, 6))


def rank_order() -> list[Column]:
    """Best score, then with hints, more types, fewer hops, text, and the steps themselves."""
    return [F.desc("path_score"), (F.size("matched_relations") == 0).cast("int"), F.desc(F.size("matched_types")), F.col("hops"), F.col("text"), edge_key()]


def rerank(paths: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 1) within the question: places in a range-sorted table, so a question may have any number of paths."""
    return group_places(paths, ["qid"], *rank_order(), name="rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def _firsts(paths: DataFrame, by: str) -> DataFrame:
    """The first path per question and beginning of two nodes: a partial minimum per task, then of those."""
    rows = F.min(F.struct(by, *[c for c in paths.columns if c != by]))
    return paths.groupBy("qid", F.slice("nodes", 1, 2).alias("__b")).agg(rows.alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in paths.columns])


def select_diverse(paths: DataFrame, max_paths: int) -> DataFrame:
    """At most ``max_paths`` (0: all) of the ranked paths: the first per two-node beginning, then the rest by rank.

    Questions with no more paths than that keep their order by rank. Firsts are minima, the rest is cut before it is
    ranked (``order.top``): what a task sees of a question is bounded by ``max_paths``.
    """
    if max_paths <= 0:
        return paths
    paths = written(paths)
    n = paths.groupBy("qid").agg((F.count(F.lit(1)) > max_paths).alias("__many"))
    lead = top(_firsts(paths, "rank"), ["qid"], max_paths, "rank", name="__o").drop("__o").withColumn("__t", F.lit(0))
    rest = top(paths, ["qid"], max_paths, "rank", name="__o").drop("__o").join(lead.select("qid", "rank"), ["qid", "rank"], "left_anti").select(paths.columns).withColumn("__t", F.lit(1))
    d = lead.unionByName(rest).join(n, "qid").withColumn("__t", F.when(F.col("__many"), F.col("__t")).otherwise(0))
    # At most twice ``max_paths`` rows of a question are left.
    w = Window.partitionBy("qid").orderBy("__t", "rank")
    return d.withColumn("selected_rank", F.row_number().over(w)).where(F.col("selected_rank") <= max_paths).select(*paths.columns, "selected_rank")


def dedupe(paths: DataFrame, order: str = "ord") -> DataFrame:
    """One path per step sequence and non-empty terminal; an empty terminal gives way to the first other of its key.

    Of equal paths the one with a terminal, then the longer evidence, then the earlier stays, at the earliest place.
    """
    key = F.when(F.size("edge_ids") > 0, F.concat_ws("|", F.lit("e"), F.concat_ws(",", "edge_ids"))).otherwise(F.concat_ws("|", F.lit("t"), "text", F.concat_ws(",", "nodes")))
    d = paths.withColumn("__k", key)
    has = F.col("terminal") != ""
    first = F.min_by("terminal", order).over(Window.partitionBy("qid", "__k", has))
    other = F.first(F.when(has, F.col("terminal")), ignorenulls=True).over(Window.partitionBy("qid", "__k").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = d.withColumn("__t", F.when(has, F.col("terminal")).otherwise(F.coalesce(other, first, F.lit(""))))
    w = Window.partitionBy("qid", "__k", "__t")
    d = d.withColumn("__first", F.min(order).over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc((F.col("terminal") != "").cast("int")), F.desc(F.size("edge_ids")), order)))
    return d.where("__n = 1").withColumn(order, F.col("__first")).drop("__k", "__t", "__first", "__n")


def branch_reduce(paths: DataFrame, most: int, order: str = "ord") -> DataFrame:
    """All paths if they are at most ``most``, else the first per beginning of two nodes, and of those the first ``most``.

    Longer beginnings change nothing: paths that differ in their first two nodes differ in longer beginnings, too.
    """
    paths = written(paths)
    many = paths.groupBy("qid").agg((F.count(F.lit(1)) > most).alias("__many"))
    few = paths.join(many.where("NOT __many").select("qid"), "qid", "left_semi").select(paths.columns)
    lead = _firsts(paths.join(many.where("__many").select("qid"), "qid", "left_semi").select(paths.columns), order)
    return few.unionByName(top(lead, ["qid"], most, order, name="__o").drop("__o"))


def fuzzy_top(paths: DataFrame, likeness: Column, width: int) -> DataFrame:
    """The ``width`` best paths: with matched hints first, more of them first, then by similarity, then in order."""
    return top(paths, ["qid"], width, (F.size("matched_relations") == 0).cast("int"), F.desc(F.size("matched_relations")), F.desc(likeness), "ord", name="fuzzy_rank")


def fuzzy_prune(paths: DataFrame, questions: DataFrame, width: int) -> DataFrame:
    """The ``width`` paths of each question (``qid, question``) that speak to it most: matched hints, then the similarity of
    their texts' vectors (``similarity``, six places), then order. The best are kept per part of a question first (``top``)."""
    d = paths.join(questions.select("qid", "question"), "qid")
    d = d.withColumn("similarity", F.round(similarity(F.col("question"), F.col("text")), 6)).drop("question")
    return fuzzy_top(written(d), F.col("similarity"), width)


def bias_order(place: Column) -> list[Column]:
    """Paths with matched hints first, more of them first, fewer hops first, then by ``place``."""
    return [(F.size("matched_relations") == 0).cast("int"), F.desc(F.size("matched_relations")), F.col("hops"), place]


def stage_order() -> list[Column]:
    """Paths of a strict expansion (``stage`` = 0) before others, then by matched hints, hops and text."""
    return [F.col("stage"), *bias_order(F.col("text"))]


def compact_text() -> Column:
    """Beginning, relations and end of a path, for prompts."""
    one = F.get("nodes", F.lit(0))
    return F.when(F.size("relations") == 0, one).otherwise(F.concat_ws(" | ", one, F.array_join("relations", " | "), F.element_at("nodes", -1)))


def prune(paths: DataFrame, similarity: Column, w1: int, wmax: int) -> DataFrame:
    """Three stages, told by ``pruning_status``; the precise stage's default policy keeps the first ``wmax``."""
    return status_prune(paths, similarity, w1, None, wmax)


def status_prune(paths: DataFrame, similarity: Column, w1: int, picked: Column | None, wmax: int) -> DataFrame:
    """Every path with its ``pruning_status``: cut by rank (``fuzzy_pruned``), by choice (``precise_pruned``), by branch
    (``branch_reduced_pruned``), or ``preserved``.

    ``picked``: the choice as an array of places (from 1, among the ``w1`` paths in order); the first ``wmax`` of it
    count, those out of range then go, and without any left the first ``wmax`` paths are taken. No choice: all go on.
    """
    order = [(F.size("matched_relations") == 0).cast("int"), F.desc(F.size("matched_relations")), F.desc(similarity), "ord"]
    placed = written(group_places(paths, ["qid"], *order, name="fuzzy_rank").withColumn("fuzzy_rank", (F.col("fuzzy_rank") + 1).cast("int")))
    far = placed.where(F.col("fuzzy_rank") > w1).withColumn("pruning_status", F.lit("fuzzy_pruned"))
    # From here on a question has at most ``w1`` paths.
    d = placed.where(F.col("fuzzy_rank") <= w1)
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    if picked is None:
        precise = F.col("fuzzy_rank") <= wmax
    else:
        valid = F.filter(F.slice(F.coalesce(picked, F.array().cast("array<int>")), 1, wmax), lambda i: (i >= 1) & (i <= n))
        precise = F.when(F.size(valid) > 0, F.array_contains(valid, F.col("fuzzy_rank").cast("int"))).otherwise(F.col("fuzzy_rank") <= wmax)
    d = d.withColumn("__p", precise)
    first = F.row_number().over(Window.partitionBy("qid", "__p", F.slice("nodes", 1, 2)).orderBy("fuzzy_rank")) == 1
    many = F.count(F.lit(1)).over(Window.partitionBy("qid", "__p")) > wmax
    status = F.when(~F.col("__p"), "precise_pruned").when(many & ~first, "branch_reduced_pruned").otherwise("preserved")
    return d.withColumn("pruning_status", status).drop("__p").unionByName(far)


def prune_for_context(paths: DataFrame, similarity: Column, w1: int, wmax: int, explorer: str) -> DataFrame:
    """Beam paths of a beam search are consolidated, all others pruned in three stages; both tell ``pruning_status``."""
    if explorer != "relation_beam":
        return status_prune(paths, similarity, w1, None, wmax)
    kept = consolidate(paths, wmax).withColumn("fuzzy_rank", F.col("kept_rank")).withColumn("pruning_status", F.lit("preserved")).drop("kept_rank")
    rest = paths.join(kept.select("qid", "text", "nodes"), ["qid", "text", "nodes"], "left_anti")
    return kept.unionByName(rest.withColumns({"fuzzy_rank": F.lit(0), "pruning_status": F.lit("precise_pruned")}).select(kept.columns))


def consolidate(paths: DataFrame, most: int) -> DataFrame:
    """Beam paths: the best per terminal (fewer hops, less repetition, more hints, shorter text), by score, then the rest."""
    repeats = F.size("relations") - F.size(F.array_distinct("relations"))
    w = Window.partitionBy("qid", "terminal").orderBy("hops", repeats, F.desc(F.size("matched_relations")), F.length("text"), "text")
    d = paths.withColumn("__b", F.row_number().over(w))
    skeleton = F.row_number().over(Window.partitionBy("qid", "relations").orderBy("__b", F.desc("path_score"), "text"))
    d = d.withColumn("__s", skeleton)
    tier = F.when((F.col("__b") == 1) & (F.col("__s") == 1), 0).when(F.col("__b") == 1, 1).when(F.col("__s") == 1, 2).otherwise(3)
    o = F.row_number().over(Window.partitionBy("qid").orderBy(tier, F.desc("path_score"), "hops", "text"))
    return d.withColumn("kept_rank", o).where(F.col("kept_rank") <= most).drop("__b", "__s")


def local_hint_rerank(paths: DataFrame, relation_hint: str, node_hint: str, type_hint: str, constraint_terms: list[str]) -> DataFrame:
    """Adds 8 x relation, 5 x node and 4 x type overlap, and 8 where the constraints match (none: they do)."""
    rel = overlap_left(F.lit(relation_hint), F.concat_ws(" ", "relations"))
    node = overlap_left(F.lit(node_hint), F.concat_ws(" ", "nodes"))
    typ = overlap_left(F.lit(type_hint), F.col("terminal"))
    text = norm_relation(F.col("text"))
    ok = F.lit(True)
    for t in constraint_terms:
        ok = ok & (F.contains(text, norm_relation(F.lit(t))) | (F.size(F.array_intersect(tokens(norm_relation(F.lit(t))), tokens(text))) * 2 >= F.size(tokens(norm_relation(F.lit(t))))))
    return paths.withColumn("path_score", F.round(F.col("path_score") + 8.0 * rel + 5.0 * node + 4.0 * typ + F.when(ok, 8.0).otherwise(0.0), 6))


def hybrid(seeds: DataFrame, store: GraphStore, hints: list[str], type_hints: list[str], depth: int = 2, width: int = 10, max_paths: int = 50) -> DataFrame:
    """Two-hop extensions, beam and breadth-first search together, without repeats, ranked, diverse."""
    edges = store.edges
    score = lambda p: score_paths(p.withColumn("text", F.lit("")), store, hints, type_hints).select(*p.columns, "path_score")
    cols = ["qid", "seed", "terminal", "literal", "nodes", "relations", "reversed", "hops", "text"]
    every = beam_search(seeds, edges, score, depth, width, hints).select(cols)
    every = every.unionByName(bfs_search(seeds, edges, depth, 0, max_paths, 0, hints).select(cols))
    if depth > 1:
        every = every.unionByName(two_hop_extensions(seeds, edges).select(cols))
    every = every.dropDuplicates(["qid", "seed", "nodes", "relations", "reversed"])
    return select_diverse(rerank(score_paths(every, store, hints, type_hints)), max_paths)


def source_target(seeds: DataFrame, targets: DataFrame, edges: DataFrame, depth: int = 2, max_paths: int = 50, relations: list[str] | None = None) -> DataFrame:
    """The first ``max_paths`` (0: all) paths per question from seeds to targets, searched from both ends."""
    return meeting_paths(seeds, targets, edges, depth, max_paths, relations)

"""Relation-level beam search, batched: a state is (question, relation path), its frontier one row per node.

Per hop, for all questions together: relations at the frontiers, filter and score, a policy's actions, budgeted
expansion, scores of the child states, merge of equal relation paths, diverse prune. The number of states is bounded
by ``beam_width * relations_per_state`` per question, the frontier of each by ``max_nodes``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, norm_beam, norm_catalog, tokens, type_match, type_names
from .aggregate import frontier_relations
from .lookup import described_nodes, display_name, metadata, probable_cvt
from .resolve import rerank_expansion
from .order import top
from .store import GraphStore, around, entities_of, fits, kinds_among, small, written
from .traverse import text_of

# Relations never followed, and the words that tell relations of mediators.
BLOCKED = ["type.object.name", "type.object.key", "type.object.guid", "type.object.type"]
BLOCKED_PREFIXES = ["common.", "freebase.", "user.", "base."]
MEDIATOR_TERMS = [
    "from", "to", "date", "year", "title", "office", "holder", "spouse", "nominee", "winner", "employee", "role",
    "team", "performance", "jurisdiction", "district", "governmental_body",
]


@dataclass
class BeamConfig:
    max_hops: int = 3
    beam_width: int = 6
    relations_per_state: int = 3
    top_k: int = 20
    per_source: int = 20
    max_nodes: int = 50
    answer_threshold: float = 0.82
    expected_type: str | None = None
    hint_text: str = ""
    anchor_text: str = ""
    dependency_text: str = ""
    # Ranking of an expansion's targets before its limits: hints by name, terms and ids of dependencies, wider limits.
    hint_names: tuple[str, ...] = ()
    constraint_terms: tuple[str, ...] = ()
    constraint_targets: tuple[str, ...] = ()
    rerank: bool = True
    overfetch_factor: int = 3
    max_overfetch: int = 200
    min_candidates: int = 50


def filter_candidates(c: DataFrame) -> DataFrame:
    """Drops housekeeping relations, the way just come, and label relations of mediator frontiers."""
    bad = F.col("relation").isin(BLOCKED)
    for p in BLOCKED_PREFIXES:
        bad = bad | F.col("relation").startswith(p)
    back = F.coalesce((F.col("last_relation") == F.col("relation")) & (F.col("last_direction") != F.col("direction")), F.lit(False))
    plain = (F.col("cvt_ratio") >= 0.5) & F.col("relation").rlike(r"\.(name|type|guid)$")
    return c.where(~bad & ~back & ~plain)


def _ov(a: Column, b: Column) -> Column:
    return jaccard(tokens(norm_beam(a)), b)


def candidate_score(config: BeamConfig) -> Column:
    """Of candidates with query, path_text, relation_name, samples, support, totals, frequency and cvt_ratio."""
    rel = tokens(norm_beam(F.concat_ws(" ", "relation", "relation_name")))
    sam = tokens(norm_beam(F.concat_ws(" ", "sample_target_names")))
    one = F.lit(1.0)
    s = 0.45 * _ov(F.col("query"), rel) + 0.10 * _ov(F.col("query"), sam) + 0.10 * _ov(F.col("path_text"), rel)
    s = s + 0.15 * _ov(F.lit(config.hint_text), rel) + 0.10 * _ov(F.lit(config.anchor_text), rel) + 0.05 * _ov(F.lit(config.anchor_text), sam)
    s = s + 0.05 * _ov(F.lit(config.dependency_text), sam) + 0.15 * F.least(one, F.col("support_ratio"))
    s = s - 0.05 * F.least(one, F.col("total_neighbor_count") / 100.0) - 0.05 * F.least(one, F.col("global_frequency") / 5000.0)
    best = lambda t: reduce(F.greatest, [_ov(F.lit(w), t) for w in MEDIATOR_TERMS])
    return F.round(s + F.when(F.col("cvt_ratio") >= 0.5, 0.30 * best(rel) + 0.10 * best(sam)).otherwise(0.0), 9)


def default_policy(c: DataFrame, config: BeamConfig) -> DataFrame:
    """The deterministic choice: the best-scored relations; roles by type and support."""
    hint = " ".join((config.expected_type or "").lower().replace(".", " ").replace("_", " ").split())
    blob = norm_catalog(F.concat_ws(" ", F.concat_ws(" ", "sample_target_names"), F.concat_ws(" ", "sample_target_types")))
    role = F.when(F.contains(blob, F.lit(hint)) if hint else F.lit(False), "answer").when(F.col("support_ratio") >= 0.5, "constraint").otherwise("intermediate")
    d = c.where(F.col("candidate_rank") <= config.relations_per_state)
    return d.withColumns({"role": role, "confidence": F.least(F.lit(1.0), 0.45 + F.col("support_ratio") * 0.4)})


def choose(proposed: DataFrame, ranked: DataFrame, top_k: int, batch: int = 100) -> DataFrame:
    """Actions from a policy's proposals (``qid, state_id, relation, direction, role, confidence``), which may come from
    anywhere: only candidates of the state, unknown roles as intermediate, confidences within 0 and 1, the surest proposal
    of a (relation, direction), answers first; the ``top_k`` best. ``batch`` numbers the candidates that are shown at once."""
    p = proposed.select("qid", "state_id", "relation", "direction", F.lower(F.trim("role")).alias("role"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"))
    p = p.withColumn("role", F.when(F.col("role").isin("answer", "constraint", "intermediate"), F.col("role")).otherwise("intermediate"))
    keys = ["qid", "state_id", "relation", "direction"]
    d = ranked.withColumn("batch", F.floor((F.col("candidate_rank") - 1) / batch).cast("int")).join(p, keys)
    d = d.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "role"))).where("__n = 1")
    w = Window.partitionBy("qid", "state_id").orderBy((F.col("role") != "answer").cast("int"), F.desc("confidence"), "relation", "direction")
    return d.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top_k).drop("__n")


def with_fallback(actions: DataFrame, ranked: DataFrame, config: BeamConfig) -> DataFrame:
    """States for which a policy chose nothing follow their first candidates, as intermediate steps that are protected."""
    idle = ranked.join(actions.select("qid", "state_id").distinct(), ["qid", "state_id"], "left_anti").where(F.col("candidate_rank") <= config.relations_per_state)
    idle = idle.withColumns({"role": F.lit("intermediate"), "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("support_ratio")))})
    return actions.unionByName(idle.select([F.col(c).cast(actions.schema[c].dataType) for c in actions.columns]))


def candidates(states: DataFrame, frontier: DataFrame, store: GraphStore, config: BeamConfig) -> DataFrame:
    """Ranked candidates of each state (``qid, state_id, query, path, last_*, ...``; frontier ``qid, state_id, node, ord``)."""
    keys = ["qid", "state_id"]
    meta = metadata(frontier.select("node"), store)
    f = frontier.join(meta.select("node", "is_literal", "is_probable_cvt"), "node")
    ratio = f.groupBy(*keys).agg((F.count_if("is_probable_cvt") / F.greatest(F.count_if(~F.col("is_literal")), F.lit(1))).alias("cvt_ratio"))
    c = frontier_relations(frontier, store, keys).join(store.relations.select("relation", "relation_name"), "relation")
    c = c.join(states, keys).join(ratio, keys)
    c = filter_candidates(c).withColumn("path_text", F.concat_ws(" ", "path_names")).withColumn("candidate_score", candidate_score(config))
    w = Window.partitionBy(*keys).orderBy(F.desc("candidate_score"), F.desc("supporting_node_count"), "relation", "direction")
    return c.withColumn("candidate_rank", F.row_number().over(w)).where(F.col("candidate_rank") <= config.top_k)


def rerank_hints(actions: DataFrame, ranked: DataFrame, store: GraphStore, config: BeamConfig) -> DataFrame:
    """Relations that speak for a target, per action (``qid, state_id, relation, direction, hint``).

    The other relations among the state's first 12 candidates, and those that the hints' and these candidates' names
    (12 names, three relations each) stand for.
    """
    keys = ["qid", "state_id", "relation", "direction"]
    shown = ranked.where("candidate_rank <= 12").select("qid", "state_id", F.col("relation").alias("hint"), "relation_name", "candidate_rank")
    a = actions.select(*keys)
    other = a.join(shown, ["qid", "state_id"]).where("hint <> relation").select(*keys, "hint")
    given = config.hint_names or ((config.hint_text,) if config.hint_text else ())
    names = shown.groupBy("qid", "state_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("candidate_rank", "relation_name"))), lambda x: x["relation_name"]).alias("names"))
    names = names.select("qid", "state_id", F.filter(F.concat(F.array(*[F.lit(g) for g in given]).cast("array<string>"), "names"), lambda x: norm_catalog(x) != "").alias("names"))
    names = names.select("qid", "state_id", F.explode(F.slice(F.array_distinct("names"), 1, 12)).alias("name")).withColumn("lookup_norm", norm_catalog(F.col("name")))
    w = Window.partitionBy("lookup_norm").orderBy("relation", "lookup_source")
    known = store.relation_lookup.withColumn("n", F.row_number().over(w)).where("n <= 3").select("lookup_norm", F.col("relation").alias("hint")).distinct()
    return other.union(a.join(names.join(known, "lookup_norm"), ["qid", "state_id"]).select(*keys, "hint")).distinct()


def expand(actions: DataFrame, frontier: DataFrame, store: GraphStore, config: BeamConfig, ranked: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Budgeted expansion of all (state, action) pairs at once: the rows used up, in order; ``place`` orders the targets.

    Where an action has ``min_candidates`` targets or more and a limit would cut some, the limits are wider by
    ``overfetch_factor``, and the targets found are ranked (``rerank_expansion``; ``ranked``: the states' candidates) before
    ``max_nodes`` of them are kept: those with ``place <= max_nodes``.
    """
    keys = ["qid", "state_id", "relation", "direction"]
    a = keep(actions.select(*keys).join(frontier.select("qid", "state_id", "node", "ord"), ["qid", "state_id"]))
    ahead, behind = around(store.edges, a)
    fwd = ahead.select(F.col("head").alias("node"), "relation", F.col("tail").alias("target"), F.lit("forward").alias("direction"))
    back = behind.where("tail_kind = 'id'").select(F.col("tail").alias("node"), "relation", F.col("head").alias("target"), F.lit("reverse").alias("direction"))
    # Repeated edges count once: told among what the frontiers meet, not among all edges.
    d = keep(small(a).join(fwd.unionByName(back), ["node", "relation", "direction"]).select(*keys, "node", "ord", "target").distinct())
    signal = config.rerank and (ranked is not None or bool(type_names(config.expected_type) or config.hint_names or config.constraint_terms or config.constraint_targets))
    cap = max(config.max_nodes, config.max_overfetch)
    wider = lambda n: min(max(n * config.overfetch_factor, n), cap) if signal else n
    every = Window.partitionBy(*keys)
    # A node's targets are counted, and cut per part of them before they meet: no task holds a hub's.
    totals = d.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("total"))
    d = top(d, [*keys, "node"], max(wider(config.per_source), config.per_source), "target", "ord", name="rn").join(totals, [*keys, "node"])
    d = d.join(frontier, ["qid", "state_id", "node", "ord"])
    total = F.sum(F.when(F.col("rn") == 1, F.col("total"))).over(every)
    risk = (total > config.max_nodes) | (F.max("total").over(every) > config.per_source)
    d = d.withColumn("wide", F.lit(bool(signal)) & risk & (total >= max(1, config.min_candidates)))
    limit = lambda n: F.when(F.col("wide"), wider(n)).otherwise(n)
    d = d.where(F.col("rn") <= limit(config.per_source))
    d = d.withColumn("first", (F.row_number().over(Window.partitionBy(*keys, "target").orderBy("ord", "rn")) == 1).cast("int"))
    d = d.withColumn("seen", F.sum("first").over(Window.partitionBy(*keys).orderBy("ord", "rn")))
    d = d.where(F.col("seen") - F.col("first") < limit(config.max_nodes))
    d = d.withColumn("over", F.max((F.col("total") > limit(config.per_source)) | (F.col("seen") >= limit(config.max_nodes))).over(every)).drop("total")
    if not signal:
        return d.withColumn("place", F.col("seen")).drop("wide")
    d = keep(d)
    found = d.where("wide AND first = 1").select(*keys, F.col("target").alias("node"), F.col("seen").alias("pos"))
    hints = keep(rerank_hints(actions, ranked, store, config)) if ranked is not None else []
    t = [config.expected_type] if config.expected_type else []
    found = rerank_expansion(found, store, t, hints, list(config.constraint_terms), list(config.constraint_targets), keys)
    d = d.join(found.select(*keys, F.col("node").alias("target"), "rerank_pos"), [*keys, "target"], "left")
    return d.withColumn("place", F.coalesce("rerank_pos", "seen")).drop("wide", "rerank_pos")


def children(actions: DataFrame, used: DataFrame, parents: DataFrame, store: GraphStore, config: BeamConfig, hop: int) -> tuple[DataFrame, DataFrame]:
    """Child states with their scores, and their frontiers."""
    keys = ["qid", "state_id", "relation", "direction"]
    edge = F.struct("node", "relation", "direction", "target")
    nodes = used.where((F.col("first") == 1) & (F.col("place") <= config.max_nodes)).select(*keys, "target", F.col("place").alias("seen"), F.concat("evidence", F.array(edge)).alias("evidence"))
    meta = metadata(nodes.select(F.col("target").alias("node")), store).withColumnRenamed("node", "target")
    n = nodes.join(meta, "target")
    typ = type_match(config.expected_type, F.col("name"), F.col("types"))
    n = n.withColumn("tm", typ)
    lit_ok = 0.5 if not config.expected_type else None
    dates = (config.expected_type or "").lower() in ("date", "year", "datetime", "time")
    literal = F.lit(lit_ok) if lit_ok else F.when(F.lit(dates) & F.col("target").rlike(r"\d"), 0.8).otherwise(0.3)
    per = n.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.avg("tm").alias("type_avg"), F.avg("degree").alias("avg_degree"),
        (F.count_if("is_probable_cvt") / F.count(F.lit(1))).alias("child_cvt"),
        F.max(F.when(F.col("is_literal"), literal)).alias("lit_score"),
        F.max((~F.col("is_literal") & ~F.col("is_probable_cvt")).cast("int")).alias("plain"),
        F.max((~F.col("is_literal") & ~F.col("is_probable_cvt") & (F.col("tm") >= 0.95)).cast("int")).alias("sure"),
    )
    cost = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("edge_count"), F.max("over").alias("over"))
    c = actions.join(per, keys).join(cost, keys).drop("query", "path_names", "path", "semantic_score", "hop", "protected_until", "last_relation", "last_direction")
    c = c.join(parents.select("qid", "state_id", "query", "path", "path_names", "semantic_score", "protected_until"), ["qid", "state_id"])
    type_score = F.col("type_avg") if config.expected_type else F.lit(0.5)
    c = c.withColumn("type_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), type_score)))
    base = F.when(F.col("role") == "answer", 0.55).otherwise(0.2)
    plain = F.when((F.col("plain") == 1) & (F.col("type_score") > 0), 0.55 + 0.35 * F.col("type_score")).otherwise(0.0)
    sure = F.when((F.col("sure") == 1) & (F.col("role") == "intermediate"), 0.84).otherwise(0.0)
    pay = F.least(F.lit(0.4), F.col("size") / config.max_nodes * 0.15 + F.col("edge_count") / config.max_nodes * 0.1 + F.when(F.col("over"), 0.1).otherwise(0.0) + F.least(F.lit(0.15), F.col("avg_degree") / 5000.0))
    c = c.withColumns({
        "semantic_score": F.least(F.lit(1.0), 0.6 * F.col("semantic_score") + 0.4 * F.col("confidence")),
        "answer_score": F.least(F.lit(1.0), F.greatest(base, plain, sure, F.coalesce("lit_score", F.lit(0.0)))),
        "diversity_score": F.lit(1.0 / hop),
        "cost_penalty": F.when(F.col("child_cvt") >= 0.5, F.greatest(F.lit(0.0), pay - 0.08)).otherwise(pay),
        "protected_until": F.when((F.col("role") == "intermediate") | (F.col("child_cvt") >= 0.5), F.lit(hop)).otherwise(F.col("protected_until")),
        "path": F.concat("path", F.array(F.struct("relation", "direction", "role"))),
        "path_names": F.concat("path_names", F.array("relation_name")),
        "hop": F.lit(hop),
    })
    c = c.withColumn("contains_answers", (F.col("answer_score") >= 0.6) | (F.col("type_score") >= 0.6))
    c = c.withColumn("state_score", F.round(0.45 * F.col("semantic_score") + 0.25 * F.col("type_score") + 0.20 * F.col("answer_score") + 0.10 * F.col("diversity_score") - F.col("cost_penalty") - 0.04 * hop, 9))
    sign = F.concat_ws(">", F.transform("path", lambda s: F.concat_ws("/", s["relation"], s["direction"])))
    c = c.withColumn("signature", sign)
    kept = ["qid", "query", "signature", "path", "path_names", "semantic_score", "type_score", "answer_score", "diversity_score", "cost_penalty", "protected_until", "hop", "contains_answers", "state_score"]
    # Equal relation paths are one state: the best one's scores, all frontiers in order, the shortest evidence.
    w = Window.partitionBy("qid", "signature").orderBy(F.desc("state_score"), "state_id")
    states = c.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*kept, F.col("relation").alias("last_relation"), F.col("direction").alias("last_direction"))
    f = n.join(c.select(*keys, "signature", F.col("state_score").alias("ss")), keys)
    f = f.groupBy("qid", "signature", F.col("target").alias("node")).agg(F.min_by("evidence", F.struct(F.size("evidence"), F.col("state_id"), F.col("seen"))).alias("evidence"), F.min(F.struct("state_id", "seen")).alias("o"))
    f = f.withColumn("ord", F.row_number().over(Window.partitionBy("qid", "signature").orderBy("o", "node"))).where(F.col("ord") <= config.max_nodes).drop("o")
    return states, f.withColumnRenamed("signature", "state_id")


def prune(states: DataFrame, hop: int, width: int) -> DataFrame:
    """Protected states, two answer-like ones, the best per first step, intermediate ones, the rest: up to ``width``."""
    q = Window.partitionBy("qid")
    order = [F.desc("state_score"), "signature"]
    d = states.withColumn("protected", F.col("protected_until") >= hop)
    d = d.withColumn("a", F.row_number().over(Window.partitionBy("qid", "protected", "contains_answers").orderBy(*order)))
    first2 = ~F.col("protected") & F.col("contains_answers") & (F.col("a") <= 2)
    d = d.withColumn("taken", F.col("protected") | first2)
    d = d.withColumn("b", F.row_number().over(Window.partitionBy("qid", "taken", F.get("path", F.lit(0))["relation"], F.get("path", F.lit(0))["direction"]).orderBy(*order)))
    mid = F.exists("path", lambda s: s["role"] == "intermediate")
    tier = F.when(F.col("protected"), 0).when(first2, 1).when(F.col("b") == 1, 2).when(mid, 3).otherwise(4)
    d = d.withColumn("beam_rank", F.row_number().over(q.orderBy(tier, *order)))
    return d.where(F.col("beam_rank") <= width).drop("protected", "taken", "a", "b")


def search(seeds: DataFrame, store: GraphStore, config: BeamConfig | None = None, policy: Callable[[DataFrame, BeamConfig], DataFrame] = default_policy, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Final states and their frontiers for seeds (``qid, query, node``); ``keep`` writes a table and rereads it.

    A question stops when one of its states reaches the answer threshold; its result is its answer states, else its
    last beam.
    """
    config = config or BeamConfig()
    keep = keep or written
    step = "struct<relation:string,direction:string,role:string>"
    evidence = "array<struct<node:string,relation:string,direction:string,target:string>>"
    states = seeds.select("qid", "query").distinct().select("qid", "query", F.lit("").alias("state_id"), F.array().cast(f"array<{step}>").alias("path"), F.array().cast("array<string>").alias("path_names"), F.lit(1.0).alias("semantic_score"), F.lit(0).alias("protected_until"), F.lit(None).cast("string").alias("last_relation"), F.lit(None).cast("string").alias("last_direction"))
    frontier = seeds.select("qid", F.lit("").alias("state_id"), "node", F.array().cast(evidence).alias("evidence")).withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("node")))
    done_s, done_f = [], []
    for hop in range(1, config.max_hops + 1):
        ranked = keep(candidates(states, frontier.drop("evidence"), store, config))
        acts = keep(policy(ranked, config))
        if policy is not default_policy:
            acts = keep(with_fallback(acts, ranked, config))
        used = keep(expand(acts, frontier, store, config, ranked, keep))
        new, front = children(acts, used, states, store, config, hop)
        new = keep(prune(new, hop, config.beam_width)).withColumn("state_id", F.col("signature"))
        front = keep(front.join(new.select("qid", "state_id"), ["qid", "state_id"], "left_semi"))
        hit = new.where((F.col("answer_score") >= config.answer_threshold) & F.col("contains_answers")).select("qid").distinct()
        last = hop == config.max_hops
        finished = new if last else new.join(hit, "qid", "left_semi")
        answers = finished.where("contains_answers")
        result = answers.unionByName(finished.join(answers.select("qid").distinct(), "qid", "left_anti"))
        done_s.append(result.select("qid", "state_id", "hop", "state_score", "answer_score", "type_score", "contains_answers", "path_names"))
        done_f.append(front.join(result.select("qid", "state_id"), ["qid", "state_id"], "left_semi"))
        if last:
            break
        states, frontier = new.join(hit, "qid", "left_anti"), front.join(hit, "qid", "left_anti")
        if not states.limit(1).count():
            break
    return reduce(DataFrame.unionByName, done_s), reduce(DataFrame.unionByName, done_f)


def answers(states: DataFrame, frontier: DataFrame) -> DataFrame:
    """``qid, node, evidence, state_score``: the best evidence per node, shorter first, then of the better state."""
    d = frontier.join(states.select("qid", "state_id", "state_score"), ["qid", "state_id"])
    w = Window.partitionBy("qid", "node").orderBy(F.size("evidence"), F.desc("state_score"), "state_id")
    return d.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("qid", "node", "evidence", "state_score")


# The relations that matter for each kind of mediator, and words that make a relation worth keeping.
SCHEMA_RELATIONS: dict[str, list[str]] = {
    "government.government_position_held": ["office_holder", "basic_title", "office_position_or_title", "jurisdiction_of_office", "district_represented", "governmental_body", "from", "to"],
    "people.marriage": ["spouse", "from", "to", "date", "location"],
    "award.award_nomination": ["award", "award_nominee", "award_winner", "year", "category", "ceremony"],
    "business.employment_tenure": ["person", "company", "title", "role", "from", "to"],
    "film.performance": ["actor", "character", "film", "special_performance_type"],
    "sports.sports_team_roster": ["player", "position", "number", "from", "to", "team"],
}
CONSTRAINT_WORDS = [
    "date", "year", "time", "start", "end", "from", "to", "title", "office", "holder", "spouse", "nominee", "winner", "employee",
    "employment", "role", "team", "performance", "jurisdiction", "district", "governmental body",
]
DATE_WORDS = ["from", "to", "date", "year", "time"]
ROLE_WORDS = ["title", "office", "holder", "spouse", "role", "team", "performance"]
ANSWER_WORDS = ["title", "office", "holder", "spouse", "award", "role", "position"]


#: Targets whose facts go to the tasks: so many at most, the most frequent ones.
FREQUENT = 1 << 17
#: Edges that a task sorts.
TASK_ROWS = 300_000


def _with_facts(e: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges with the facts of their targets (``target, uses`` and more).

    Edges are dealt by target only if theirs are many and their own target is rare, so that a value of very many edges is in
    no task's hands, and common ones are joined where the edges are read.
    """
    if fits(facts):
        d = e.join(F.broadcast(facts), "target", "left")
    else:
        steps = [4**i for i in range(2, 16)]
        n = facts.agg(*[F.count_if(F.col("uses") >= s) for s in steps]).first()
        least = next((s for s, x in zip(steps, n) if x <= FREQUENT), 4**16)
        often = F.broadcast(facts.where(F.col("uses") >= least))
        rare = e.join(F.broadcast(often.select("target")), "target", "left_anti").join(facts.where(F.col("uses") < least), "target", "left")
        d = e.join(often, "target").unionByName(rare)
    # An edge without a target has no facts.
    without = {"tgt_best": 0.0, "tm": 0.0, "is_literal": True, "tgt_cvt": False}
    return d.drop("uses").withColumns({c: F.coalesce(c, F.lit(x)) for c, x in without.items()})


def cvt_bundles(nodes: DataFrame, store: GraphStore, terms: list[str], expected_type: str | None = None, most: int = 6, scan: int = 64) -> DataFrame:
    """Per mediator in ``nodes`` (``node``, and optionally ``entry``: the ids it was reached from): its telling outgoing
    edges with score and role, at most ``most``.

    ``terms``: the question's words, hints and anchors. An edge scores 12 x the best overlap of a keyword with its
    relation, 4 x with its target's name, 6 x type match, 8 x the best overlap of the mediator's schema with its relation,
    +3 for dates and for roles, +8 for a typed answer, -2 for a nested mediator. Up to four answers come first, then
    four constraints, then the rest; at most two answers or constraints of a relation, or one other edge; nodes it was
    reached from only as answers. Mediators need two edges or an answer, and an answer or a constraint.
    """
    n = written(nodes.select("node").distinct())
    e = around(store.edges, n)[0].select(F.col("head").alias("node"), "relation", F.col("tail").alias("target"), "tail_kind")
    if fits(n):
        e = written(e.join(F.broadcast(n), "node", "left_semi"))
    squeeze = lambda w: " ".join(w.lower().replace("_", " ").replace(".", " ").split())
    given = list(dict.fromkeys(squeeze(w) for w in [*CONSTRAINT_WORDS, expected_type or "", *terms] if squeeze(w)))

    def best(words: list[str], text: Column) -> Column:
        one = F.array(*[F.lit(w) for w in words if " " not in w]).cast("array<string>")
        found = F.when(F.arrays_overlap(text, one), 1.0 / F.size(text)).otherwise(0.0)
        return reduce(F.greatest, [jaccard(F.array(*[F.lit(x) for x in dict.fromkeys(w.split())]), text) for w in words if " " in w], found)

    # What a target's name and types tell, once per target, before its edges meet by mediator: these meet once and stay together.
    t = written(e.groupBy("target").agg(F.count(F.lit(1)).alias("uses")))
    known = entities_of(store.entities, kinds_among(t.select(F.col("target").alias("node")), store.entities, "mid"))
    known = known.select(F.col("mid").alias("target"), F.col("name").alias("__name"), F.col("types").alias("__types"), "is_cvt", F.lit(True).alias("known"))
    if fits(t):
        known = known.join(F.broadcast(t.select("target")), "target", "left_semi")
    told = t.join(known, "target", "left").withColumns({"name": display_name(F.col("target"), F.col("__name")), "types": F.coalesce("__types", F.array().cast("array<string>"))})
    told = told.withColumn("tgt_words", tokens(norm_catalog(F.col("name"))))
    # By the number of the schema; null if nothing fits any.
    by_schema = F.array(F.lit(0.0), *[best([squeeze(w) for w in words], F.col("tgt_words")) for words in SCHEMA_RELATIONS.values()])
    facts = written(told.select(
        "target", "uses", "name", best(given, F.col("tgt_words")).alias("tgt_best"), F.when(F.array_max(by_schema) > 0, by_schema).alias("tgt_priors"),
        (type_match(expected_type, F.col("name"), F.col("types")) if expected_type else F.lit(0.0)).alias("tm"),
        F.col("known").isNull().alias("is_literal"),
        (F.col("known").isNotNull() & probable_cvt(F.col("target"), F.col("__name"), F.col("__types"), F.col("is_cvt"))).alias("tgt_cvt"),
    ))
    # A task sorts some TASK_ROWS edges.
    tasks = -(-(t.agg(F.sum("uses")).first()[0] or 0) // TASK_ROWS)
    dealt = lambda d: d.repartition(tasks, "node") if tasks > int(store.spark.conf.get("spark.sql.shuffle.partitions")) else d
    w = Window.partitionBy("node")
    e = dealt(_with_facts(e, facts)).withColumn("n", F.row_number().over(w.orderBy("relation", "target")))
    # The limit stands behind the second window, as Spark would else sort for it before the edges are dealt, too.
    e = e.withColumn("relations", F.collect_set(F.when(F.col("n") <= scan, F.col("relation"))).over(w)).where(F.col("n") <= scan)
    m = described_nodes(dealt(n), store).where("is_probable_cvt").select("node", F.col("types").alias("cvt_types"))
    if "entry" in nodes.columns:
        m = m.join(nodes.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("entry"))).alias("entry")), "node")
    e = e.join(m, "node")
    # The schema's number, from 1 (0: none), found at a mediator's first edge.
    every = norm_catalog(F.concat_ws(" ", F.concat_ws(" ", "cvt_types"), F.concat_ws(" ", "relations")))
    schema = F.coalesce(*[F.when(F.contains(every, F.lit(squeeze(k))), F.lit(i)) for i, k in enumerate(SCHEMA_RELATIONS, 1)], F.lit(0))
    e = e.withColumn("schema", F.max(F.when(F.col("n") == 1, schema)).over(w)).drop("n", "relations", "cvt_types")

    # What a relation's name alone tells is told once per relation, and joined.
    rel = F.col("rel")
    says = lambda words: reduce(lambda a, b: a | b, [F.contains(rel, F.lit(w)) for w in words])
    says_rel = store.relations.select("relation", norm_catalog(F.concat_ws(" ", "relation", "relation_name")).alias("rel")).withColumn("rel_words", tokens(rel))
    priors = F.array(F.lit(0.0), *[best([squeeze(w) for w in words], F.col("rel_words")) for words in SCHEMA_RELATIONS.values()])
    says_rel = says_rel.select("relation", best(given, F.col("rel_words")).alias("rel_best"), priors.alias("priors"), says(DATE_WORDS).alias("date"), (says(DATE_WORDS) | says(ROLE_WORDS)).alias("dated"), says(ANSWER_WORDS).alias("answering"))
    e = e.join(small(written(says_rel)), "relation").withColumn("prior", F.get("priors", F.col("schema"))).drop("priors")
    is_id = F.col("tail_kind") == "id"
    e = e.withColumn("nested", is_id & F.col("tgt_cvt"))
    tm, date, nested = F.col("tm"), F.col("date"), F.col("nested")
    typed = F.lit(bool(expected_type)) & is_id & ~nested & (tm >= 0.75) & ~date
    role = F.when(date, "constraint").when(typed, "answer").when(is_id & F.col("is_literal"), "constraint").when(nested, "intermediate").when(F.col("answering"), "answer").otherwise("constraint")
    score = 12.0 * F.greatest("rel_best", "prior") + 4.0 * F.greatest("tgt_best", F.coalesce(F.get("tgt_priors", F.col("schema")), F.lit(0.0))) + 6.0 * tm + 8.0 * F.col("prior")
    score = score + F.when(F.col("dated"), 3.0).otherwise(0.0) + F.when(typed, 8.0).otherwise(0.0) - F.when(nested & ~date, 2.0).otherwise(0.0)
    e = e.withColumns({"edge_score": F.round(score, 6), "role": role})
    e = e.select("node", "relation", "target", "name", "role", "edge_score", *[c for c in ("entry",) if c in e.columns])
    order = [F.desc("edge_score"), "relation", "target"]
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("node", "role").orderBy(*order)))
    e = e.withColumn("phase", F.when((F.col("r") <= 4) & (F.col("role") == "answer"), 0).when((F.col("r") <= 4) & (F.col("role") == "constraint"), 1).otherwise(2))
    if "entry" in e.columns:
        e = e.where(~F.array_contains("entry", F.col("target")) | (F.col("role") == "answer"))
    # Of a relation: the first edge, if intermediate, and then one more; else two that are not.
    plain = F.col("role") == "intermediate"
    by = Window.partitionBy("node", "relation").orderBy("phase", *order)
    e = e.withColumn("first", F.first(plain).over(by)).withColumn("at", F.row_number().over(by)).withColumn("others", F.sum((~plain).cast("int")).over(by))
    e = e.where(F.when(plain, F.col("at") == 1).otherwise(F.col("others") + F.col("first").cast("int") <= 2))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("phase", *order))).where(F.col("k") <= most)
    w = Window.partitionBy("node")
    e = e.withColumn("size", F.count(F.lit(1)).over(w)).withColumn("has_answer", F.max((F.col("role") == "answer").cast("int")).over(w)).withColumn("telling", F.max((F.col("role") != "intermediate").cast("int")).over(w))
    return e.where("(size >= 2 OR has_answer = 1) AND telling = 1").select("node", "relation", "target", F.col("name").alias("target_name"), "role", "edge_score", F.col("k").alias("edge_rank"))


def evidence_paths(found: DataFrame) -> DataFrame:
    """The beam's answers (``qid, node, evidence, state_score``) as plain paths, scored by their state."""
    seed = F.when(F.size("evidence") > 0, F.get("evidence", F.lit(0))["node"]).otherwise(F.col("node"))
    d = found.select("qid", seed.alias("seed"), F.col("node").alias("terminal"), (~F.col("node").rlike(r"^[mg]\.")).alias("literal"), F.concat(F.array(seed), F.transform("evidence", lambda x: x["target"])).alias("nodes"), F.transform("evidence", lambda x: x["relation"]).alias("relations"), F.transform("evidence", lambda x: x["direction"] == "reverse").alias("reversed"), F.size("evidence").alias("hops"), F.col("state_score").alias("path_score"))
    return d.withColumn("text", text_of(F.col("nodes"), F.col("relations"), F.col("reversed")))


def bundle_paths(paths: DataFrame, store: GraphStore, terms: list[str], expected_type: str | None = None) -> DataFrame:
    """Paths that end at a mediator become bundles: its edges are told, its best answer is the new end, the score grows by .05.

    Other paths stay as they are. An answer that the path came from counts .1 less.
    """
    ends = paths.select(F.col("terminal").alias("node"), F.col("nodes").alias("entry"))
    b = written(cvt_bundles(ends, store, terms, expected_type))
    text = bundle_text(b)
    d = paths.join(b.where("role = 'answer'").groupBy(F.col("node").alias("terminal")).agg(F.collect_list(F.struct("edge_score", "target")).alias("choices")), "terminal", "left")
    d = d.join(text.select(F.col("node").alias("terminal"), F.col("text").alias("bundle")), "terminal", "left")
    ranked = F.array_sort(F.transform(F.coalesce("choices", F.array().cast("array<struct<edge_score:double,target:string>>")), lambda c: F.struct((F.when(F.array_contains("nodes", c["target"]), 0.1).otherwise(0.0) - c["edge_score"]).alias("s"), c["target"].alias("t"))))
    end = F.coalesce(F.get(ranked, F.lit(0))["t"], F.col("terminal"))
    told = F.col("bundle").isNotNull()
    out = d.withColumns({"__end": end, "text": F.when(told, F.concat_ws(" -> ", "text", "bundle")).otherwise(F.col("text")), "path_score": F.col("path_score") + F.when(told, 0.05).otherwise(0.0), "bundled": told})
    return out.withColumn("terminal", F.col("__end")).select(*paths.columns, "bundled")


def dependency_context(dependencies: DataFrame, most: int = 5) -> DataFrame:
    """What earlier answers say about a question's targets: ``qid, constraint_terms, constraint_targets``.

    ``dependencies``: ``qid, ord, answer, predicted_answers, literals, entity_ids``; the first ``most`` of them, and of
    each list.
    """
    w = Window.partitionBy("qid").orderBy("ord")
    d = dependencies.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    few = lambda c: F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, most)
    own = F.when(F.trim(F.coalesce("answer", F.lit(""))) != "", F.array("answer")).otherwise(F.array().cast("array<string>"))
    d = d.select("qid", "__n", F.concat(own, few("predicted_answers"), few("literals")).alias("t"), few("entity_ids").alias("i"))
    flat = lambda c: F.array_distinct(F.filter(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__n", c))), lambda s: s[c])), lambda x: F.trim(x) != ""))
    return d.groupBy("qid").agg(flat("t").alias("constraint_terms"), flat("i").alias("constraint_targets"))


def bundle_text(bundles: DataFrame) -> DataFrame:
    """``node, text``: the mediator's relations with their values."""
    b = bundles.groupBy("node", "relation").agg(F.array_sort(F.collect_set("target_name")).alias("v"), F.min("edge_rank").alias("o"))
    one = F.when(F.size("v") == 1, F.get("v", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("v", ", "), F.lit("]")))
    b = b.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("o", F.concat("relation", F.lit(": "), one).alias("t")))).alias("x"))
    return b.select("node", F.concat(F.lit("[CVT:"), F.right(F.col("node"), F.lit(4)), F.lit("] {"), F.array_join(F.transform("x", lambda s: s["t"]), "; "), F.lit("}")).alias("text"))

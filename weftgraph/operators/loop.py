"""The question loop: sub-questions that depend on each other, solved for a whole batch of questions at once.

A question's sub-questions form a graph. In each round every open question tries its current sub-question (the first whose
dependencies are answered) once; answers seed what depends on them. A failed attempt is diagnosed, and the diagnosis
decides how the next one is relaxed. A question ends when all are answered, when one has failed ``attempts`` times, or
when ``max_loops`` attempts are used up before a new one begins.

Everything that differs between questions is a column that is joined per row: relation hints, expected types, terms,
strictness, solver. So a round is a fixed number of joins, whatever the questions are, and the number of rounds is bounded
by the budgets. The state (one row per sub-question) and the answers are written each round; nothing is collected.

Sub-questions (``specs``): ``qid, ord, sub_id, question``, and optionally

* ``depends_on``: ids of other sub-questions; ``topics``, ``nodes``: names of entities to start from, and of others that matter;
* ``selected``, ``relations``: the relations chosen, and all that may be meant; ``expected_type``; ``hops`` (1 or 2);
* ``solver_type``: ``explore``, ``constrained_collect``, ``verify``, ``aggregate``; ``filters``: terms that answers should show.

Null or missing optional columns are empty; ids repeated within a question count once, the first by ``ord``; a dependency that
does not exist is never answered, so the question ends without an answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_catalog, norm_relation, ordered_distinct, type_names_of
from .aggregate import sqlite_number
from .evaluate import average_metrics, score_prediction
from .lookup import described, resolve_entities
from .order import top
from .solve import operation
from .store import GraphStore, around, small, written
from .traverse import both_ways

# The number of paths and of seeds from which on a failure counts as branching, and the failures' names.
BRANCHING, MANY_SEEDS = 12, 4
BRANCHED, LARGE_SET = "relation_found_but_branching_too_large", "upstream_set_too_large_with_downstream_filter"
MISTYPED, UNSURE, GENERIC = "type_mismatch_after_retrieval", "relation_not_confident", "generic_retry"

_LISTS = ["depends_on", "topics", "nodes", "selected", "relations", "filters"]
_KEY = ["qid", "sub_id"]


def _none() -> Column:
    return F.array().cast("array<string>")


def complete(specs: DataFrame) -> DataFrame:
    """All columns of sub-questions, each id once per question, with the terms that later sub-questions ask for.

    A sub-question's ``filters`` get the names and relations of those that depend on it, and their expected types.
    """
    have = set(specs.columns)
    one = {c: ordered_distinct(F.coalesce(F.col(c), _none())) if c in have else _none() for c in _LISTS}
    text = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in have else F.lit("") for c in ("expected_type", "solver_type", "question")}
    d = specs.select("qid", "ord", "sub_id", *[c.alias(n) for n, c in {**one, **text}.items()], (F.coalesce("hops", F.lit(2)) if "hops" in have else F.lit(2)).alias("hops"))
    d = d.withColumn("__n", F.row_number().over(Window.partitionBy(*_KEY).orderBy("ord", "question"))).where("__n = 1").drop("__n")
    kind = F.lower("solver_type")
    known = F.when(kind.isin("aggregate", "verify", "constrained_collect", "explore"), kind).when(operation(F.col("question")).isNotNull() & (F.size("depends_on") > 0), "aggregate").otherwise("explore")
    d = d.withColumn("solver_type", known)
    asks = F.concat("nodes", "selected", "relations", F.array("expected_type"))
    later = d.select("qid", F.explode("depends_on").alias("sub_id"), "ord", asks.alias("asks"))
    later = later.groupBy(*_KEY).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "asks"))), lambda s: s["asks"])).alias("later"))
    d = d.join(later, _KEY, "left")
    return d.withColumn("filters", ordered_distinct(F.concat("filters", F.coalesce("later", _none())))).drop("later")


def hints_for(attempt: Column, failure: Column, selected: Column, relations: Column) -> Column:
    """The relations of an attempt: the chosen ones first, then all that may be meant, then both; the chosen ones again where
    the last attempt found too much."""
    some = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    return F.when(failure.isin(BRANCHED, LARGE_SET) | (attempt <= 1), some(selected, relations)).when(attempt == 2, some(relations, selected)).otherwise(F.array_distinct(F.concat(relations, selected)))


def strategy_for(attempt: Column, failure: Column) -> Column:
    return F.when(failure.isin(BRANCHED, LARGE_SET), "constrained_collect").when(attempt <= 1, "auto").when(attempt == 2, "supplement").otherwise("node_expand")


def anchors(specs: DataFrame, store: GraphStore, column: str) -> DataFrame:
    """``qid, sub_id, node``: what the names in a column mean in the graph."""
    m = specs.select(*_KEY, F.explode(column).alias("mention"))
    found = resolve_entities(m.select("mention").distinct(), store, 1).select("mention", F.col("mid").alias("node"))
    return m.join(found, "mention").select(*_KEY, "node").distinct()


# --- one round's solvers: ``step`` has a row per question with its hints, types, terms and budgets as columns ---


def explore(step: DataFrame, seeds: DataFrame, store: GraphStore, per_node: int, most: int, depth: int = 2) -> DataFrame:
    """Paths of up to ``depth`` hops from the seeds: ``qid, sub_id, terminal, literal, relations, hops, matched``.

    Where a step is strict, only its hinted relations are followed; else they come first. ``per_node`` and ``most``: edges
    at the end of a path and paths of a question that are kept, in order of hints, relation and end (0: all).
    """
    wants = step.select(*_KEY, "hints", "strict", F.col("hops").alias("depth"))
    start = seeds.join(wants, _KEY).select(*_KEY, F.col("node").alias("terminal"), F.array("node").alias("nodes"), _none().alias("relations"), F.lit(False).alias("literal"), "hints", "strict", "depth")
    front, out = written(start), []
    for hop in range(1, depth + 1):
        p = front.where(~F.col("literal") & (F.col("depth") >= hop)).withColumnRenamed("terminal", "node").drop("literal")
        d = small(p).join(both_ways(store.edges, p), "node").where(~F.array_contains("nodes", F.col("neighbor")))
        hinted = F.array_contains("hints", F.col("relation"))
        d = d.where(~F.col("strict") | (F.size("hints") == 0) | hinted).withColumn("__h", hinted.cast("int"))
        if per_node > 0:
            d = top(d, [*_KEY, "nodes", "relations"], per_node, F.desc("__h"), "relation", "neighbor", "reversed", name="__r").drop("__r")
        d = d.select(*_KEY, F.col("neighbor").alias("terminal"), F.concat("nodes", F.array("neighbor")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"), "literal", "hints", "strict", "depth")
        front = written(d)
        out.append(front.withColumn("hops", F.lit(hop)))
    d = reduce(DataFrame.unionByName, out).withColumn("matched", F.size(F.array_intersect("relations", "hints")))
    d = d.select(*_KEY, "terminal", "literal", "relations", "hops", "matched", "nodes").distinct()
    if most > 0:
        d = top(d, _KEY, most, F.desc("matched"), "hops", F.col("relations").cast("string"), "terminal", F.col("nodes").cast("string"), name="__r").drop("__r")
    return d.drop("nodes")


def collect(step: DataFrame, seeds: DataFrame, store: GraphStore) -> DataFrame:
    """All targets of the seeds by the hinted relations (any, without hints), either way, as paths of one hop."""
    s = written(seeds.join(step.select(*_KEY, "hints"), _KEY))
    d = small(s).join(both_ways(store.edges, s), "node")
    d = d.where((F.size("hints") == 0) | F.array_contains("hints", F.col("relation")))
    return d.select(*_KEY, F.col("neighbor").alias("terminal"), "literal", F.array("relation").alias("relations"), F.lit(1).alias("hops"), F.lit(1).alias("matched")).distinct()


def confirm(step: DataFrame, seeds: DataFrame, targets: DataFrame, store: GraphStore) -> DataFrame:
    """The seeds that are connected with a target of their step, directly or over one node, either way."""
    adjacency = lambda d: both_ways(store.edges, d).where(~F.col("literal"))
    goal = targets.join(step.select(_KEY), _KEY, "left_semi").select(*_KEY, F.col("node").alias("goal")).distinct()
    p = seeds.join(goal.select(_KEY).distinct(), _KEY, "left_semi").select(*_KEY, F.col("node").alias("terminal"), "node")
    one = written(small(p).join(adjacency(p), "node").select(*_KEY, "terminal", F.col("neighbor").alias("node"), F.array("relation").alias("relations")))
    two = small(one).join(adjacency(one).select("node", F.col("neighbor").alias("next"), "relation"), "node")
    two = two.select(*_KEY, "terminal", F.col("next").alias("node"), F.concat("relations", F.array("relation")).alias("relations"))
    hit = lambda d, hops: d.join(goal.withColumnRenamed("goal", "node"), [*_KEY, "node"], "left_semi").select(*_KEY, "terminal", F.lit(False).alias("literal"), "relations", F.lit(hops).alias("hops"), F.lit(hops).alias("matched"))
    return hit(one, 1).unionByName(hit(two, 2)).distinct()


def compute(step: DataFrame, seeds: DataFrame, sets: DataFrame | None, store: GraphStore) -> DataFrame:
    """Counts, common members and the best by a number, each for the steps whose words ask for it.

    ``count``: the different targets of the seeds by the hinted relations that have the expected type (without hints the
    seeds themselves); ``argmax`` and ``argmin``: the seeds with the best number or year among hinted literals;
    ``intersect``: what all dependencies' answers (``sets``: ``qid, sub_id, dep, node``) have in common.
    """
    op = operation(F.col("question"))
    s = step.withColumn("op", F.coalesce(op, F.lit("count"))).select(*_KEY, "op", "hints", "names")
    s = written(s)
    one = lambda d, value, literal, relations: d.select(*_KEY, value.alias("terminal"), F.lit(literal).alias("literal"), relations.alias("relations"), F.lit(1).alias("hops"), F.lit(1).alias("matched"))
    counted = s.where("op = 'count'").select(_KEY)
    targets = collect(step.join(s.where("op = 'count' AND size(hints) > 0").select(_KEY), _KEY, "left_semi"), seeds, store).select(*_KEY, F.col("terminal").alias("node"))
    own = seeds.join(s.where("op = 'count' AND size(hints) = 0").select(_KEY), _KEY, "left_semi").select(*_KEY, "node")
    every = written(targets.unionByName(own).distinct())
    kind = described(every, store).select("node", norm_catalog(F.concat_ws(" ", "types")).alias("hay"))
    typed = every.join(kind, "node").join(s.select(*_KEY, "names"), _KEY).where((F.size("names") == 0) | F.exists("names", lambda n: F.contains("hay", n)))
    n = counted.join(typed.groupBy(*_KEY).agg(F.count_distinct("node").alias("n")), _KEY, "left")
    out = one(n.where("n > 0"), F.col("n").cast("string"), True, F.array(F.lit("count")))
    asking = written(seeds.join(s.where("op IN ('argmax', 'argmin')"), _KEY))
    facts = around(store.edges, asking)[0].where("tail_kind <> 'id'").select(F.col("head").alias("node"), "relation", F.col("tail").alias("value"))
    ranked = small(asking).join(facts, "node").where((F.size("hints") == 0) | F.array_contains("hints", F.col("relation")))
    ranked = ranked.withColumn("number", sqlite_number(F.col("value"))).where("number IS NOT NULL")
    best = ranked.groupBy(*_KEY, "op").agg(F.max(F.struct("number", "node", "relation")).alias("most"), F.min(F.struct("number", "node", "relation")).alias("least"))
    pick = F.when(F.col("op") == "argmax", F.col("most")).otherwise(F.col("least"))
    out = out.unionByName(one(best, pick["node"], False, F.array(pick["relation"])))
    if sets is None:
        return out
    asked = sets.where(~F.col("literal")).join(s.where("op = 'intersect'").select(_KEY), _KEY, "left_semi")
    total = asked.groupBy(*_KEY).agg(F.count_distinct("dep").alias("total"))
    common = asked.groupBy(*_KEY, "node").agg(F.count_distinct("dep").alias("n")).join(total, _KEY).where("n = total AND total > 1")
    return out.unionByName(one(common, F.col("node"), False, F.array(F.lit("intersect"))))


def judge(step: DataFrame, found: DataFrame, store: GraphStore, most: int) -> DataFrame:
    """Candidates of answers, best first: ``qid, sub_id, value, label, literal, ok, place``.

    ``ok``: the expected type is among the words of the candidate's name, types or, for a literal, its relation; numbers that
    were computed are always. Mediators answer nothing. Better types, terms, hints, then fewer hops come first.
    """
    paths = found.groupBy(*_KEY, "terminal", "literal").agg(F.max("matched").alias("matched"), F.min("hops").alias("hops"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("relations")))).alias("relations"))
    about = described(paths.where(~F.col("literal")).select(F.col("terminal").alias("node")), store).select(F.col("node").alias("terminal"), "name", "types", "is_probable_cvt", F.lit(False).alias("literal"))
    d = paths.join(about, ["terminal", "literal"], "left").where(~F.coalesce("is_probable_cvt", F.lit(False)))
    d = d.join(step.select(*_KEY, "names", "filters", "solver_type"), _KEY)
    own = norm_catalog(F.concat_ws(" ", F.coalesce("name", "terminal"), F.concat_ws(" ", F.coalesce("types", _none()))))
    hay = F.when(F.col("literal"), F.concat_ws(" ", own, norm_relation(F.concat_ws(" ", "relations")))).otherwise(own)
    d = d.withColumn("hay", hay)
    ok = (F.size("names") == 0) | F.exists("names", lambda n: F.contains(F.col("hay"), n)) | (F.col("literal") & (F.col("solver_type") == "aggregate"))
    terms = F.size(F.filter("filters", lambda t: F.contains(F.col("hay"), norm_catalog(t)))) * F.when(F.col("solver_type") == "constrained_collect", 1).otherwise(0)
    d = d.withColumn("ok", ok).withColumn("terms", terms).select(*_KEY, F.col("terminal").alias("value"), F.coalesce(F.nullif(F.trim("name"), F.lit("")), "terminal").alias("label"), "literal", "ok", "terms", "matched", "hops")
    order = [F.desc(F.col("ok").cast("int")), F.desc("terms"), F.desc("matched"), "hops", "label", "value"]
    if most > 0:
        return top(d, _KEY, most, *order, name="place")
    return d.withColumn("place", F.lit(0))


# --- the loop ---


def solve(specs: DataFrame, store: GraphStore, topics: DataFrame | None = None, max_loops: int = 5, attempts: int = 3, per_node: int = 20, max_paths: int = 50, max_answers: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers (``qid, sub_id, value, label, literal, place``), the last state of each sub-question and a trace of attempts.

    ``topics``: seeds of whole questions (``qid, node``), for sub-questions without anchors of their own. 0 for a budget: none.
    State: ``qid, ord, sub_id, attempt, failure, status`` (open, resolved, failed). Trace: one row per attempt with its
    strategy, ``seeds``, ``paths``, ``answers`` (of the expected type) and failure.
    """
    spark, kind = specs.sparkSession, specs.schema["qid"].dataType.simpleString()
    s = written(complete(specs).withColumn("names", type_names_of(F.col("expected_type"))))
    near, goals = written(anchors(s, store, "topics")), written(anchors(s, store, "nodes"))
    own_topics = topics.select("qid", "node").distinct() if topics is not None else spark.createDataFrame([], f"qid {kind}, node string")
    state = written(s.select("qid", "ord", "sub_id", F.lit(0).alias("attempt"), F.lit("").alias("failure"), F.lit("open").alias("status")))
    answers = written(spark.createDataFrame([], f"qid {kind}, sub_id string, value string, label string, literal boolean, place int"))
    log = None
    for _ in range(max_loops - 1 + attempts):
        cur = _current(state, s, max_loops)
        step = cur.join(s, _KEY).withColumn("attempt", F.col("attempt") + 1)
        step = step.withColumn("hints", hints_for(F.col("attempt"), F.col("failure"), F.col("selected"), F.col("relations")))
        narrow = F.col("failure").isin(BRANCHED, LARGE_SET)
        step = step.withColumns({"strategy": strategy_for(F.col("attempt"), F.col("failure")), "solver_type": F.when(narrow, "constrained_collect").otherwise(F.col("solver_type")), "strict": F.col("attempt") <= 1})
        step = written(step)
        # What the round needs: at most one row per solver.
        need = {r.solver_type: r for r in step.groupBy("solver_type").agg(F.max("hops").alias("hops"), F.max(F.size("depends_on")).alias("deps")).collect()}
        if not need:
            break
        sets = step.select(*_KEY, F.explode("depends_on").alias("dep")).join(answers.select("qid", F.col("sub_id").alias("dep"), F.col("value").alias("node"), "literal"), ["qid", "dep"])
        sets = written(sets) if any(r.deps for r in need.values()) else None
        seeds = written(_seeds(step, sets, near, own_topics, store))
        by = lambda k: step.where(F.col("solver_type") == k)  # noqa: B023, E731
        of = lambda k: seeds.join(by(k).select(_KEY), _KEY, "left_semi")  # noqa: B023, E731
        ways = {
            "explore": lambda: explore(by("explore"), of("explore"), store, per_node, max_paths, need["explore"].hops),  # noqa: B023
            "constrained_collect": lambda: collect(by("constrained_collect"), of("constrained_collect"), store),  # noqa: B023
            "verify": lambda: confirm(by("verify"), of("verify"), goals, store),  # noqa: B023
            "aggregate": lambda: compute(by("aggregate"), of("aggregate"), sets, store),  # noqa: B023
        }
        found = written(reduce(DataFrame.unionByName, [ways[k]() for k in need]))
        got = written(judge(step, found, store, max_answers))
        tried = written(_diagnosed(step, seeds, found, got, attempts))
        good = got.where("ok").join(tried.where("status = 'resolved'").select(_KEY), _KEY, "left_semi")
        answers = written(answers.unionByName(good.select("qid", "sub_id", "value", "label", "literal", "place")))
        new = tried.select(*_KEY, F.col("attempt").alias("a"), F.col("failure").alias("f"), F.col("status").alias("s"))
        state = written(state.join(new, _KEY, "left").select("qid", "ord", "sub_id", F.coalesce("a", "attempt").alias("attempt"), F.coalesce("f", "failure").alias("failure"), F.coalesce("s", "status").alias("status")))
        log = tried if log is None else log.unionByName(tried)
    if log is None:
        log = spark.createDataFrame([], f"qid {kind}, sub_id string, attempt int, strategy string, solver_type string, seeds long, paths long, answers long, failure string, status string")
    return answers, state, log


def _current(state: DataFrame, specs: DataFrame, max_loops: int) -> DataFrame:
    """The sub-question that each open question tries next: ``qid, sub_id, attempt, failure``."""
    q = state.groupBy("qid").agg(F.sum("attempt").alias("used"), F.count_if(F.col("status") == "failed").alias("failed"))
    open_ = state.where("status = 'open'").join(q.where("failed = 0"), "qid").where((F.col("attempt") > 0) | (F.col("used") < max_loops))
    done = state.where("status = 'resolved'").select("qid", F.col("sub_id").alias("dep"))
    need = open_.select(*_KEY).join(specs.select(*_KEY, F.explode("depends_on").alias("dep")), _KEY)
    waits = need.join(done, ["qid", "dep"], "left_anti").select(_KEY).distinct()
    ready = open_.join(waits, _KEY, "left_anti")
    return ready.groupBy("qid").agg(F.min(F.struct("ord", "sub_id", "attempt", "failure")).alias("x")).select("qid", "x.sub_id", "x.attempt", "x.failure")


def _seeds(step: DataFrame, sets: DataFrame | None, near: DataFrame, topics: DataFrame, store: GraphStore) -> DataFrame:
    """``qid, sub_id, node``: the entities among the dependencies' answers; else what the topics mean; else what literal
    answers mean; else, for a sub-question without anchors of its own, the question's topics."""
    alone = step.where((F.size("depends_on") == 0) & (F.size("topics") == 0) & (F.size("nodes") == 0)).select(_KEY)
    own = near.join(step.select(_KEY), _KEY, "left_semi").select(*_KEY, "node")
    ways = [(1, own), (3, alone.join(topics, "qid").select(*_KEY, "node"))]
    if sets is not None:
        texts = sets.where("literal")
        meant = resolve_entities(texts.select(F.col("node").alias("mention")), store, 1).select(F.col("mention").alias("node"), "mid")
        ways += [(0, sets.where(~F.col("literal")).select(*_KEY, "node")), (2, texts.join(meant, "node").select(*_KEY, F.col("mid").alias("node")))]
    every = reduce(DataFrame.unionByName, [d.withColumn("rank", F.lit(k)) for k, d in ways])
    every = written(every)
    best = every.groupBy(*_KEY).agg(F.min("rank").alias("best"))
    return every.join(best, _KEY).where("rank = best").select(*_KEY, "node").distinct()


def _diagnosed(step: DataFrame, seeds: DataFrame, found: DataFrame, got: DataFrame, attempts: int) -> DataFrame:
    """One row per attempt: what it had and found, whether it answered, and why not."""
    n_seeds = seeds.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("seeds"))
    paths = found.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("paths"))
    used = found.select(*_KEY, F.explode("relations").alias("r")).groupBy(*_KEY).agg(F.count_distinct("r").alias("used"))
    ok = got.groupBy(*_KEY).agg(F.count_if("ok").alias("answers"))
    d = step.select(*_KEY, "attempt", "strategy", "solver_type", "hints", "depends_on", "filters")
    for other in (n_seeds, paths, used, ok):
        d = d.join(other, _KEY, "left")
    d = d.na.fill(0, ["seeds", "paths", "used", "answers"])
    explored = F.col("solver_type") == "explore"
    failure = (
        F.when(F.col("answers") > 0, "")
        .when((F.size("hints") > 0) & (F.col("paths") >= BRANCHING) & (F.col("used") <= F.size("hints") + 1) & explored, BRANCHED)
        .when((F.size("depends_on") > 0) & (F.col("seeds") >= MANY_SEEDS) & (F.size("filters") > 0) & explored, LARGE_SET)
        .when(F.col("paths") > 0, MISTYPED)
        .when(F.size("hints") > 0, UNSURE)
        .otherwise(GENERIC)
    )
    status = F.when(F.col("answers") > 0, "resolved").when(F.col("attempt") >= attempts, "failed").otherwise("open")
    return d.select(*_KEY, "attempt", "strategy", "solver_type", "seeds", "paths", "answers", failure.alias("failure"), status.alias("status"))


def run(questions: DataFrame, specs: DataFrame, store: GraphStore, topics: DataFrame | None = None, most: int = 10, **budgets) -> tuple[DataFrame, DataFrame]:
    """``qid, question, predicted, sufficient, attempts, candidate_paths`` per question, and the trace of all attempts.

    A question is answered if all its sub-questions are: by the answers of the last one, the first ``most`` (0: all) in order.
    ``questions``: ``qid, question``; see ``solve`` for the rest.
    """
    answers, state, log = solve(specs, store, topics, **budgets)
    q = state.groupBy("qid").agg(F.max_by("sub_id", "ord").alias("sub_id"), (F.count_if(F.col("status") == "resolved") == F.count(F.lit(1))).alias("sufficient"))
    final = answers.join(q.where("sufficient"), _KEY)
    if most > 0:
        final = top(final, ["qid"], most, "place", "label", "value", name="__r")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "label", "value"))), lambda s: s["label"])
    final = final.groupBy("qid").agg(F.array_distinct(texts).alias("predicted"))
    tried = log.groupBy("qid").agg(F.count(F.lit(1)).alias("attempts"), F.sum("paths").alias("candidate_paths"))
    d = questions.select("qid", "question").join(q.select("qid", "sufficient"), "qid", "left").join(final, "qid", "left").join(tried, "qid", "left")
    return d.select("qid", "question", F.coalesce("predicted", _none()).alias("predicted"), F.coalesce("sufficient", F.lit(False)).alias("sufficient"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("candidate_paths", F.lit(0)).alias("candidate_paths")), log


def validate(samples: DataFrame, specs: DataFrame, store: GraphStore, **more) -> tuple[DataFrame, DataFrame]:
    """All samples (``qid, question, gold``) in one batch through the loop: scored predictions, and their averages."""
    got, _ = run(samples.select("qid", "question"), specs, store, **more)
    scored = written(score_prediction(got.join(samples.select("qid", "gold"), "qid")))
    return scored, average_metrics(scored, "candidate_paths")

"""Traversals: reach sets, shortest paths, simple paths and searches, one join per hop for all questions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_id
from .lookup import direct_edges  # noqa: F401  (part of this module's surface)
from .order import group_places, top
from .store import around, kinds_among, of_kinds, small, written


def both_ways(edges: DataFrame, near: DataFrame | None = None, toward: DataFrame | None = None) -> DataFrame:
    """``node, relation, neighbor, reversed, literal`` over id edges in both directions, and literals forward.

    ``near``, ``toward``: the nodes (``node``) for which edges are looked up and those that they have to reach, to leave out
    edges that are declared to have none of them at that end (``store.declared``).
    """
    ahead, back = around(edges, near) if near is not None else (edges, edges)
    if toward is not None:
        kinds = kinds_among(toward, edges, "head", "tail")
        ahead, back = of_kinds(ahead, "tail", F.col("relation"), kinds), of_kinds(back, "head", F.col("relation"), kinds)
    f = ahead.select(F.col("head").alias("node"), "relation", F.col("tail").alias("neighbor"), F.lit(False).alias("reversed"), (F.col("tail_kind") != "id").alias("literal"))
    return f.union(back.where("tail_kind = 'id'").select(F.col("tail"), "relation", F.col("head"), F.lit(True), F.lit(False)))


def _ends(paths: DataFrame) -> DataFrame:
    return paths.select(F.col("terminal").alias("node"))


def reach(sources: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``source, node, dist``: what each source (column ``node``) reaches within ``depth`` undirected hops, itself first.

    Each hop joins the written frontier with the edges as they are and makes the result distinct: the edges are never
    shuffled for a small frontier. A ``qid`` column of the sources stays.
    """
    step = lambda near: both_ways(edges, near).where(~F.col("literal")).select("node", F.col("neighbor").alias("next"))
    keys = [*(["qid"] if "qid" in sources.columns else []), "source", "node"]
    start = sources.select(*[c for c in keys if c == "qid"], F.col("node").alias("source"), "node").distinct()
    front = written(start.join(step(start).select("node"), "node", "left_semi").select(*keys, F.lit(0).alias("dist")))
    seen = front
    for hop in range(1, depth + 1):
        new = small(front.select(keys)).join(step(front), "node").select(*keys[:-1], F.col("next").alias("node")).distinct()
        front = written(new.join(small(seen.select(keys)), keys, "left_anti").select(*keys, F.lit(hop).alias("dist")))
        seen = seen.union(front)
    return seen


def shortest_paths(pairs: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``source, target, length, nodes``: one shortest undirected path per pair, the least in order of its nodes.

    Both ends search at once: each step grows the side whose level has fewer rows, by the least path to each node at that
    distance. With a levels from the source and b from the target, a shortest path of length a + b passes a node at
    distance a from its source, wherever the sides meet, so the levels are joined there, and pairs that have met leave the
    later joins. The last step is not kept as a level: what it reaches goes straight to the join with the other side.
    """
    step = lambda near: both_ways(edges, near).where(~F.col("literal")).select("node", F.col("neighbor").alias("next"))  # noqa: E731  parallel edges are one in the minima
    open_ = written(pairs.select("source", "target").distinct())
    ahead = _level(open_.select(F.col("source").alias("root")).distinct())
    back = _level(open_.select(F.col("target").alias("root")).distinct())
    seen = [ahead.select("root", "node"), back.select("root", "node")]
    out = _met(open_, ahead, back)
    for h in range(1, depth + 1):
        met = written(out.select("source", "target"))
        open_ = written(open_.join(small(met), ["source", "target"], "left_anti"))
        if not open_.limit(1).count():
            break
        # Only roots of open pairs go on.
        ahead = _open_roots(ahead, open_.select(F.col("source").alias("root")))
        back = _open_roots(back, open_.select(F.col("target").alias("root")))
        forward = ahead.count() <= back.count()
        level, own = (ahead, 0) if forward else (back, 1)
        new = _grown(level, step(level), forward)
        if h < depth:
            new = new.groupBy("root", "node").agg(F.min("nodes").alias("nodes"))
            new = written(new.join(small(seen[own]), ["root", "node"], "left_anti"))
            seen[own] = seen[own].union(new.select("root", "node"))
        # The pairs are open, so every walk of their distance is a shortest path: the last step needs no level.
        ahead, back = (new, back) if forward else (ahead, new)
        out = out.unionByName(_met(open_, ahead, back, (h < depth or not forward, h < depth or forward)))
    return out.withColumn("length", F.size("nodes") - 1).select("source", "target", "nodes", "length")


def _level(roots: DataFrame) -> DataFrame:
    return written(roots.select("root", F.col("root").alias("node"), F.array("root").alias("nodes")))


def _open_roots(level: DataFrame, roots: DataFrame) -> DataFrame:
    return level.join(small(written(roots.distinct())), "root", "left_semi")


def _grown(level: DataFrame, step: DataFrame, forward: bool) -> DataFrame:
    """One edge further from each row of a level, with the path from the root, or back to it."""
    path = F.concat("nodes", F.array("next")) if forward else F.concat(F.array("next"), "nodes")
    return small(level).join(step, "node").select("root", F.col("next").alias("node"), path.alias("nodes"))


def _met(pairs: DataFrame, ahead: DataFrame, back: DataFrame, written_sides: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Where the levels of a pair meet, the least path.

    A side (if written, so that its rows are known) is multiplied by its roots' pairs before the sides meet, if that gives
    at most four times its rows; else, as with a hub per target, the sides meet by node first and by pair then.
    """
    b = back.select(F.col("root").alias("target"), "node", F.col("nodes").alias("rest"))
    a = ahead.select(F.col("root").alias("source"), "node", "nodes")
    if written_sides[0] and _few_pairs(pairs.select(F.col("source").alias("root")), ahead):
        d = a.join(small(pairs), "source").join(b, ["target", "node"])
    elif written_sides[1] and _few_pairs(pairs.select(F.col("target").alias("root")), back):
        d = b.join(small(pairs), "target").join(a, ["source", "node"])
    else:
        d = a.join(b, "node").join(small(pairs), ["source", "target"])
    d = d.groupBy("source", "target").agg(F.min(F.concat("nodes", F.slice("rest", 2, 1_000_000))).alias("nodes"))
    return written(d)


def _few_pairs(roots: DataFrame, level: DataFrame) -> bool:
    """Whether a level's rows, each once per pair of its root, are at most four times as many: sums over counts by root."""
    n = level.groupBy("root").agg(F.count(F.lit(1)).alias("rows")).join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("pairs")), "root")
    rows, product = n.agg(F.sum("rows"), F.sum(F.col("rows") * F.col("pairs"))).first()
    return product is None or product <= 4 * rows


def start_paths(seeds: DataFrame) -> DataFrame:
    """Zero-hop paths of seeds (``node`` and optionally ``qid``)."""
    qid = F.col("qid") if "qid" in seeds.columns else F.lit(0)
    return seeds.select(qid.alias("qid"), F.col("node").alias("seed"), F.col("node").alias("terminal"), F.lit(False).alias("literal"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("relations"), F.array().cast("array<boolean>").alias("reversed"), F.lit(0).alias("hops")).distinct()


def grow(paths: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Every simple path one edge longer; literals end paths."""
    p = paths.where(~F.col("literal"))
    a = adjacency.select(F.col("node").alias("terminal"), "relation", "neighbor", F.col("reversed").alias("back"), F.col("literal").alias("to_literal"))
    d = small(p).join(a, "terminal").where(~F.array_contains("nodes", F.col("neighbor")))
    return d.select("qid", "seed", F.col("neighbor").alias("terminal"), F.col("to_literal").alias("literal"), F.concat("nodes", F.array("neighbor")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"), F.concat("reversed", F.array("back")).alias("reversed"), (F.col("hops") + 1).alias("hops"))


def text_of(nodes: Column, relations: Column, reversed_: Column) -> Column:
    """``a -> relation -> b -> other (reverse) -> c``."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(relations), F.lit(1))), lambda i: F.concat(F.get(relations, i - 1), F.when(F.get(reversed_, i - 1), F.lit(" (reverse)")).otherwise(F.lit("")), F.lit(" -> "), F.get(nodes, i)))
    return F.when(F.size(relations) > 0, F.concat(F.get(nodes, F.lit(0)), F.lit(" -> "), F.array_join(steps, " -> "))).otherwise(F.get(nodes, F.lit(0)))


def edge_key() -> Column:
    """The identity and the rank of a path: its steps in order."""
    return F.concat_ws("|", F.transform(F.sequence(F.lit(1), F.size("relations")), lambda i: F.concat_ws("\u0001", F.get("relations", i - 1), F.get("nodes", i), F.get("reversed", i - 1).cast("string"))))


def simple_paths(seeds: DataFrame, edges: DataFrame, depth: int, targets: DataFrame | None = None, max_paths: int = 0, relations: list[str] | None = None, literals: bool = False) -> DataFrame:
    """All simple undirected paths of 1 to ``depth`` hops; with targets, a path stops at one and only those count."""

    def adjacency(front: DataFrame) -> DataFrame:
        a = both_ways(edges, _ends(front))
        if not literals:
            a = a.where(~F.col("literal"))
        return a.where(F.col("relation").isin(relations)) if relations else a

    front, found = start_paths(seeds), None
    goal = small(targets.select(F.col("node").alias("terminal")).distinct()) if targets is not None else None
    for hop in range(1, depth + 1):
        new = written(grow(front, adjacency(front)))
        hit = new.join(goal, "terminal", "left_semi").select(new.columns) if goal is not None else new
        found = hit if found is None else found.unionByName(hit)
        front = new.join(goal, "terminal", "left_anti").select(new.columns) if goal is not None else new
    found = found.withColumn("text", text_of(F.col("nodes"), F.col("relations"), F.col("reversed")))
    return top(found, ["qid"], max_paths, "hops", edge_key(), name="__n").drop("__n") if max_paths > 0 else found


def bfs_search(seeds: DataFrame, edges: DataFrame, depth: int = 2, max_expansions: int = 200, max_paths: int = 50, neighbor_limit: int = 0, hints: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Breadth-first search with budgets per question. A path's place (``seq``, from 1) is its parent's place, then its edge's rank.

    Every edge followed is an expansion and gives one path, so the smaller of both budgets ends the search (0: none).
    """
    return expand_paths(seeds, edges, depth, hints, strict, neighbor_limit, min((x for x in (max_expansions, max_paths) if x > 0), default=0))


def expand_paths(seeds: DataFrame, edges: DataFrame, depth: int = 3, hints: list[str] | None = None, strict: bool = False, neighbor_limit: int = 0, max_paths: int = 0, max_nodes: int = 0) -> DataFrame:
    """Simple paths in breadth-first order, with a budget of paths and one of discovered entities per question (0: none).

    ``seq`` (from 1) is a path's place: by its parent's, then by its edge (hinted first, relation, neighbour, direction).
    ``max_nodes``: once a question has discovered so many entities, its seeds included, edges to further ones are passed
    over (edges to literals and to known entities are not). A node's discovery is the first place that reaches it, so each
    hop ranks its *new* nodes by that place and admits as many as the question has left: a loop over a queue would admit
    the same ones.

    Places are counted over range-sorted slices and budgets cut from partial first rows (``order``): no task holds a
    question. The discovered nodes (``qid, node``) are written and joined.
    """
    hit = F.col("relation").isin(hints) if hints else F.lit(False)

    def adjacency(front: DataFrame) -> DataFrame:
        a = both_ways(edges, _ends(front))
        a = a.where(hit) if hints and strict else a
        return a.withColumn("hint", (~hit).cast("int")).select(F.col("node").alias("terminal"), "relation", "neighbor", F.col("reversed").alias("back"), F.col("literal").alias("to_literal"), "hint")

    front = written(group_places(start_paths(seeds), ["qid"], "seed", name="seq"))
    known = written(front.select("qid", F.col("seed").alias("node")).distinct())
    used, out = None, []
    cols = ["qid", "seed", "terminal", "literal", "nodes", "relations", "reversed", "hops"]
    for _ in range(depth):
        p = front.where(~F.col("literal"))
        d = small(p).join(adjacency(p), "terminal").where(~F.array_contains("nodes", F.col("neighbor")))
        d = d.select("qid", "seed", F.col("neighbor").alias("terminal"), F.col("to_literal").alias("literal"), F.concat("nodes", F.array("neighbor")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"), F.concat("reversed", F.array("back")).alias("reversed"), (F.col("hops") + 1).alias("hops"), F.col("seq").alias("parent"), "hint", "relation", "back")
        order = ["parent", "hint", "relation", "terminal", "back"]
        if neighbor_limit > 0:
            d = top(d, ["qid", "parent"], neighbor_limit, *order, name="__r").drop("__r")
        d = written(d)  # sorting by range reads it twice, and so does a budget of nodes
        if max_nodes > 0:
            d, known = _admitted(d, known, order, max_nodes)
        left = None
        if max_paths > 0:
            d = top(d, ["qid"], max_paths, *order, name="seq")
            left = F.lit(max_paths)
        else:
            d = group_places(d, ["qid"], *order, name="seq").withColumn("seq", F.col("seq") + 1)
        if used is not None:
            d = d.join(small(used), "qid", "left").withColumn("seq", F.col("seq") + F.coalesce("used", F.lit(0))).drop("used")
        front = written((d.where(F.col("seq") <= left) if left is not None else d).select(*cols, F.col("seq").cast("long").alias("seq")))
        out.append(front)
        used = written(reduce(DataFrame.unionByName, out).groupBy("qid").agg(F.max("seq").alias("used")))
    if not out:
        return front.where("false").select(*cols, F.col("seq").cast("long").alias("seq"), F.lit("").alias("text"))
    return reduce(DataFrame.unionByName, out).withColumn("text", text_of(F.col("nodes"), F.col("relations"), F.col("reversed")))


def _admitted(found: DataFrame, known: DataFrame, order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The rows that a budget of discovered entities lets pass, and what is known then.

    A new node's first place is the least of its rows' order, a partial minimum per task; no row is placed before it passes.
    """
    new = found.where(~F.col("literal")).select("qid", F.col("terminal").alias("node"), F.struct(*order).alias("__at")).join(small(known), ["qid", "node"], "left_anti")
    new = new.groupBy("qid", "node").agg(F.min("__at").alias("__at"))
    have = known.groupBy("qid").agg(F.count(F.lit(1)).alias("have"))
    ranked = top(new, ["qid"], most, "__at", name="rank")  # more than ``most`` are never admitted
    admitted = ranked.join(small(have), "qid").where(F.col("have") + F.col("rank") <= most).select("qid", "node")
    known = written(known.union(admitted))
    passed = found.where(~F.col("literal")).join(small(known.withColumnRenamed("node", "terminal")), ["qid", "terminal"], "left_semi").select(found.columns)
    return written(found.where("literal").unionByName(passed)), known


def meeting_paths(seeds: DataFrame, targets: DataFrame, edges: DataFrame, depth: int, max_paths: int = 0, relations: list[str] | None = None) -> DataFrame:
    """The simple undirected paths of 1 to ``depth`` hops from seeds to targets, searched from both ends.

    A path stops at the first target it meets, as in ``simple_paths``. Seeds (``qid, node``) grow half the depth, rounded up,
    targets (``node``, optionally ``qid``) the rest; halves are joined at the node where they meet, and kept if they share no
    other. With b edges per node, that is two frontiers of b^(d/2) rows in place of one of b^d. The last step follows only
    edges to where the other side's halves end: all else that it could reach (a hub's records, say) finds no partner.
    """

    def adjacency(front: DataFrame, partners: DataFrame | None = None) -> DataFrame:
        ends = _ends(partners).distinct() if partners is not None else None
        a = both_ways(edges, _ends(front), ends).where(~F.col("literal"))
        if relations:
            a = a.where(F.col("relation").isin(relations))
        return a.join(small(ends.withColumnRenamed("node", "neighbor")), "neighbor", "left_semi") if ends is not None else a

    on = ["qid"] if "qid" in targets.columns else []
    goal = written(targets.select(*on, F.col("node").alias("terminal")).distinct())
    inner = lambda d: d.join(small(goal), [*on, "terminal"], "left_anti").select(d.columns)
    ahead, back, out = written(start_paths(seeds)), written(start_paths(targets)), []
    for h in range(1, depth + 1):
        last = h == depth
        if h % 2:
            new = written(grow(ahead, adjacency(ahead, (goal if h == 1 else back) if last else None)))
            if h == 1:
                out.append(new.join(small(goal), [*on, "terminal"], "left_semi").select(new.columns))
                ahead = written(inner(new))
                continue
            ahead = written(inner(new))
        else:
            back = written(inner(grow(back, adjacency(back, ahead if last else None))))
        out.append(_joined(ahead, back, on))
    d = reduce(DataFrame.unionByName, out)
    d = d.withColumn("text", text_of(F.col("nodes"), F.col("relations"), F.col("reversed")))
    return top(d, ["qid"], max_paths, "hops", edge_key(), name="__n").drop("__n") if max_paths > 0 else d


def _joined(ahead: DataFrame, back: DataFrame, on: list[str]) -> DataFrame:
    """Forward halves with the backward halves that end where they do, the latter's steps turned around."""
    b = back.select(*on, "terminal", F.col("seed").alias("end"), F.reverse("nodes").alias("n2"), F.reverse("relations").alias("r2"), F.reverse(F.transform("reversed", lambda x: ~x)).alias("v2"))
    d = ahead.join(b, [*on, "terminal"]).where(F.size(F.array_intersect("nodes", "n2")) == 1)
    rest = F.slice("n2", 2, 1_000_000)
    return d.select("qid", "seed", F.col("end").alias("terminal"), F.lit(False).alias("literal"), F.concat("nodes", rest).alias("nodes"), F.concat("relations", "r2").alias("relations"), F.concat("reversed", "v2").alias("reversed"), F.size(F.concat("relations", "r2")).alias("hops"))


def beam_search(seeds: DataFrame, edges: DataFrame, score, depth: int = 2, width: int = 10, hints: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Heuristic beam: every generated path is a result, the ``width`` best (0: all) go on. ``score``: paths to paths with ``path_score``."""
    front, out = start_paths(seeds), None
    cols = front.columns
    for hop in range(1, depth + 1):
        adjacency = both_ways(edges, _ends(front))
        if hints and strict:
            adjacency = adjacency.where(F.col("relation").isin(hints))
        new = written(score(grow(front, adjacency)))
        out = new if out is None else out.unionByName(new)
        if hop == depth:
            break
        if width > 0:
            new = top(new, ["qid"], width, F.desc("path_score"), "hops", "terminal", edge_key(), name="__n")
        front = written(new.select(cols))
    return out.withColumn("text", text_of(F.col("nodes"), F.col("relations"), F.col("reversed")))


def two_hop_extensions(seeds: DataFrame, edges: DataFrame, limit: int = 0) -> DataFrame:
    """Paths of one and two hops; literals end, nothing returns to its root."""
    return bfs_search(seeds, edges, 2, 0, 0, limit)


def induced_subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.where("tail_kind = 'id'")
    n = nodes.select("node").distinct()
    return e.join(n.withColumnRenamed("node", "head"), "head", "left_semi").join(n.withColumnRenamed("node", "tail"), "tail", "left_semi").select("head", "relation", "tail")


def question_subgraph(topics: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """The edges between all nodes within ``depth`` hops of a question's topics; with ``qid`` in ``topics``, per question."""
    near = reach(topics, edges, depth)
    if "qid" not in topics.columns:
        return induced_subgraph(near, edges)
    n = written(near.select("qid", "node").distinct())
    e, _ = around(edges, n)
    d = small(n.withColumnRenamed("node", "head")).join(e.where("tail_kind = 'id'").select("head", "relation", "tail"), "head")
    return d.join(small(n.withColumnRenamed("node", "tail")), ["qid", "tail"], "left_semi").select("qid", "head", "relation", "tail")


def prune_by_topics(topics: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Subgraphs (``edges``: ``qid, head, relation, tail``) cut to one shortest path per pair of a question's topics.

    A question keeps its graph as it is if it has fewer than two topics, if no pair is connected, or if the paths add no
    node to the topics (they are next to each other).
    """
    t = topics.select("qid", "node").distinct()
    e = edges.select("qid", "head", "relation", "tail")
    pairs = t.select("qid", F.col("node").alias("source")).join(t.select("qid", F.col("node").alias("target")), "qid").where("source < target")
    # One graph for all questions: a node of a question is the pair of both.
    name = lambda c: F.concat_ws("\u0001", F.col("qid").cast("string"), c)
    own = e.select(name("head").alias("head"), "relation", name("tail").alias("tail"), F.lit("id").alias("tail_kind"))
    best = shortest_paths(pairs.select(name("source").alias("source"), name("target").alias("target")), own, depth)
    found = best.select(F.explode("nodes").alias("x")).distinct()
    found = found.select(F.substring_index("x", "\u0001", 1).alias("q"), F.substring_index("x", "\u0001", -1).alias("node"))
    more = found.join(t.select(F.col("qid").cast("string").alias("q"), "node"), ["q", "node"], "left_anti").select("q").distinct()
    keep = written(found.join(more, "q", "left_semi"))
    cut = e.withColumn("q", F.col("qid").cast("string")).join(keep.select("q").distinct(), "q", "left_semi")
    ends = keep.select("q", F.col("node").alias("head")), keep.select("q", F.col("node").alias("tail"))
    cut = cut.join(ends[0], ["q", "head"], "left_semi").join(ends[1], ["q", "tail"], "left_semi")
    same = e.withColumn("q", F.col("qid").cast("string")).join(keep.select("q").distinct(), "q", "left_anti")
    return cut.select(e.columns).unionByName(same.select(e.columns))


def ordered_topic_paths(topics: DataFrame, edges: DataFrame, dpredict: int, dmax: int, per_pair: int = 20) -> DataFrame:
    """Paths through a question's topics (``qid, ord, node``) in order, joined leg by leg where they meet.

    A question is searched from depth ``min(dpredict, dmax)`` on and stops at the first depth at which each pair of
    consecutive topics is connected, with at most ``per_pair`` (0: all) paths of a pair, shorter ones first. One topic
    alone is a path without hops.
    """
    w = Window.partitionBy("qid").orderBy("ord")
    legs = topics.select("qid", "ord", F.col("node").alias("source"), F.lead("node").over(w).alias("target"), F.row_number().over(w).alias("leg"), F.count(F.lit(1)).over(Window.partitionBy("qid")).alias("topics"))
    single = legs.where("topics = 1").select("qid", F.col("source").alias("seed"), F.col("source").alias("terminal"), F.array("source").alias("nodes"), F.array().cast("array<string>").alias("relations"), F.array().cast("array<boolean>").alias("reversed"))
    open_, out = written(legs.where("target IS NOT NULL").select("qid", "leg", "topics", "source", "target")), [single]
    for depth in range(min(dpredict, dmax), dmax + 1):
        pairs = open_.select("source", "target").distinct()
        found = simple_paths(pairs.select(F.col("source").alias("node")).distinct(), edges, depth)
        found = pairs.join(found.withColumnsRenamed({"seed": "source", "terminal": "target"}), ["source", "target"])
        if per_pair > 0:
            best = Window.partitionBy("source", "target").orderBy("hops", edge_key())
            found = found.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= per_pair)
        found = written(found.select("source", "target", "nodes", "relations", "reversed"))
        linked = open_.join(found.select("source", "target").distinct(), ["source", "target"], "left_semi")
        done = linked.groupBy("qid", "topics").agg(F.count(F.lit(1)).alias("n")).where("n = topics - 1").select("qid", "topics")
        done = written(done)
        most = done.agg(F.max("topics")).first()[0] or 0
        steps = open_.join(done.select("qid"), "qid").join(found, ["source", "target"])
        whole = steps.where("leg = 1").select("qid", "topics", F.col("source").alias("seed"), F.col("target").alias("terminal"), "nodes", "relations", "reversed")
        for leg in range(2, most):
            nxt = steps.where(F.col("leg") == leg).select("qid", F.col("source").alias("terminal"), F.col("target").alias("end"), F.col("nodes").alias("n2"), F.col("relations").alias("r2"), F.col("reversed").alias("v2"))
            longer = whole.where(F.col("topics") > leg).join(nxt, ["qid", "terminal"]).select("qid", "topics", "seed", F.col("end").alias("terminal"), F.concat("nodes", F.slice("n2", 2, 1_000_000)).alias("nodes"), F.concat("relations", "r2").alias("relations"), F.concat("reversed", "v2").alias("reversed"))
            whole = longer.unionByName(whole.where(F.col("topics") <= leg))
        out.append(whole.drop("topics"))
        open_ = written(open_.join(done.select("qid"), "qid", "left_anti"))
        if not open_.limit(1).count():
            break
    every = reduce(DataFrame.unionByName, out).dropDuplicates(["qid", "nodes", "relations", "reversed"])
    return every.withColumns({"hops": F.size("relations"), "text": text_of(F.col("nodes"), F.col("relations"), F.col("reversed"))})


def supplement_paths(topics: DataFrame, bridges: DataFrame, edges: DataFrame, dmax: int, per_pair: int = 20) -> DataFrame:
    """Ordered paths that pass a linked entity (``qid, node``) right after the first topic, one search per bridge."""
    b = bridges.select("qid", F.col("node").alias("bridge")).distinct().join(topics.select("qid", F.col("node").alias("bridge")), ["qid", "bridge"], "left_anti")
    first = F.min("ord").over(Window.partitionBy("qid"))
    t = topics.select("qid", "ord", "node", first.alias("least")).join(b, "qid")
    key = F.concat_ws("\u0001", F.col("qid").cast("string"), "bridge")
    rows = t.select(key.alias("key"), F.when(F.col("ord") == F.col("least"), 0).otherwise(F.col("ord") - F.col("least") + 1).alias("ord"), "node")
    rows = rows.unionByName(t.where("ord = least").select(key.alias("key"), F.lit(1).alias("ord"), F.col("bridge").alias("node")))
    found = ordered_topic_paths(rows.withColumnRenamed("key", "qid"), edges, min(2, dmax), dmax, per_pair)
    found = found.withColumn("qid", F.substring_index("qid", "\u0001", 1).cast(topics.schema["qid"].dataType))
    return found.dropDuplicates(["qid", "nodes", "relations", "reversed"])


def expand_endpoints(paths: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Longer paths from the ends of paths, each node visited once per question, in the order of (path, relation, node)."""
    seen = paths.select("qid", F.explode("nodes").alias("terminal")).distinct()
    cols = ["qid", "seed", "terminal", "literal", "nodes", "relations", "reversed", "hops"]
    front, out = paths.select(cols), None
    for hop in range(1, rounds + 1):
        new = grow(front, both_ways(edges, _ends(front)).where(~F.col("literal"))).join(seen, ["qid", "terminal"], "left_anti")
        w = Window.partitionBy("qid", "terminal").orderBy("hops", edge_key())
        front = written(new.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(cols))
        seen = seen.union(front.select("qid", "terminal"))
        out = front if out is None else out.unionByName(front)
    return out


def of_ids(paths: DataFrame) -> DataFrame:
    return paths.where(is_id(F.col("terminal")))

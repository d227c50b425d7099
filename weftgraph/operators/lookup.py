"""Lookups around frontiers and resolution of names. Frontiers are DataFrames, so all questions share one join."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_id, jaccard80, norm_catalog, sequence_ratio
from .contain import containing
from .store import GraphStore, around, entities_of, kinds_among, node_table, small, written

# Scores of the kinds of match, type markers of mediators and types of ordinary things.
ENTITY_SCORES = {"mid": 100.0, "name_exact": 95.0, "alias_exact": 85.0, "alias_like": 80.0}
RELATION_SCORES = {"relation_exact": 100.0, "relation_norm_exact": 98.0, "relation_name_exact": 95.0, "relation_name_like": 90.0, "relation_id_like": 85.0}
MEDIATOR_TYPES = ["type.cvt", "freebase.type_hints.mediator", "base.type_ontology.mediator"]
ORDINARY_PREFIXES = ["location.", "people.", "organization.", "film.", "music.", "sports.", "government.", "book.", "tv.", "common.topic"]


def incident(frontier: DataFrame, edges: DataFrame, reverse: bool = True) -> DataFrame:
    """``frontier`` (with ``node``) joined with its edges: adds relation, neighbor, reversed, neighbor_kind."""
    f, (ahead, behind) = small(frontier), around(edges, frontier)
    out = f.join(ahead.select(F.col("head").alias("node"), "relation", F.col("tail").alias("neighbor"), F.lit(False).alias("reversed"), F.col("tail_kind").alias("neighbor_kind")), "node")
    if not reverse:
        return out
    back = f.join(behind.select(F.col("tail").alias("node"), "relation", F.col("head").alias("neighbor"), F.lit(True).alias("reversed"), F.lit("id").alias("neighbor_kind")), "node")
    return out.unionByName(back)


def neighbors(frontier: DataFrame, edges: DataFrame, hints: list[str] | None = None, strict: bool = False, limit: int = 25, reverse: bool = True, literal_sources: bool = True) -> DataFrame:
    """Neighbours of each frontier node: each direction limited, merged, distinct, limited again. ``limit <= 0``: none.

    ``strict``: only hinted relations; otherwise hinted ones come first. ``literal_sources``: whether edges whose tail is a
    literal equal to the node count as edges into it, as in a lookup by an index of tails.
    """
    d = incident(frontier.select("node").distinct(), edges, reverse)
    if not literal_sources:
        d = d.where(~F.col("reversed")).unionByName(incident(frontier.select("node").distinct(), edges.where("tail_kind = 'id'"), True).where("reversed"))
    hit = F.col("relation").isin(hints) if hints else F.lit(False)
    if strict and hints:
        d = d.where(hit)
    d = d.withColumn("hinted", hit.cast("int"))
    d = d.groupBy("node", "relation", "neighbor", "reversed").agg(F.max("hinted").alias("hinted"))
    order = [F.desc("hinted"), "relation", "neighbor"]
    if limit > 0:
        d = d.withColumn("rn", F.row_number().over(Window.partitionBy("node", "reversed").orderBy(*order))).where(F.col("rn") <= limit)
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(*order, "reversed")))
    return (d.where(F.col("rank") <= limit) if limit > 0 else d).select("node", "relation", "neighbor", "reversed", "rank")


def local_neighbors(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours in a small graph whose edges have a place (``ord``): forward edges, then reverse ones, in that order."""
    f = frontier.select("node").distinct()
    out = f.join(edges.select(F.col("head").alias("node"), "relation", F.col("tail").alias("neighbor"), F.lit(False).alias("reversed"), "ord"), "node")
    back = f.join(edges.select(F.col("tail").alias("node"), "relation", F.col("head").alias("neighbor"), F.lit(True).alias("reversed"), "ord"), "node")
    w = Window.partitionBy("node").orderBy("reversed", "ord")
    return out.unionByName(back).withColumn("rank", F.row_number().over(w)).drop("ord")


def resolve_relations_index(hints: DataFrame, store: GraphStore, top_k: int = 5, **more) -> DataFrame:
    """Candidates of hints by an equi-join with the relation lookup (name 95, id 90); hints unknown to it are compared with
    the catalog (``resolve_relations``)."""
    h = hints.select("hint").distinct().withColumn("lookup_norm", norm_catalog(F.col("hint"))).where("lookup_norm <> ''")
    d = h.join(store.relation_lookup, "lookup_norm")
    d = d.select("hint", "relation", F.concat("lookup_source", F.lit("_exact")).alias("match_type"), F.when(F.col("lookup_source") == "relation_name", 95.0).otherwise(90.0).alias("score"))
    d = _best(d, "match_type", ["hint"], top_k, "relation").select("hint", "relation", "match_type", "score", "rank")
    return d.unionByName(resolve_relations(h.join(d.select("hint"), "hint", "left_anti").select("hint"), store, top_k, **more))


def node_edges(frontier: DataFrame, edges: DataFrame, literals: bool = True, limit: int = 25, reverse: bool = True) -> DataFrame:
    """Neighbours, literals taken out after the limit if unwanted."""
    d = neighbors(frontier, edges, limit=limit, reverse=reverse)
    return d if literals else d.where(is_id(F.col("neighbor")))


def display_name(mid: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), mid)


def probable_cvt(mid: Column, name: Column, types: Column, is_cvt: Column) -> Column:
    """Whether a node is likely a mediator: flagged or marked so, else an unnamed one of no ordinary type."""
    types = F.coalesce(types, F.array().cast("array<string>"))
    named = (F.trim(F.coalesce(name, F.lit(""))) != "") & (F.trim(F.coalesce(name, F.lit(""))) != mid)
    plain = F.exists(types, lambda t: t.rlike("^(" + "|".join(p.replace(".", r"\.") for p in ORDINARY_PREFIXES) + ")"))
    marked = F.arrays_overlap(types, F.array(*[F.lit(x) for x in MEDIATOR_TYPES]))
    return F.when(~is_id(mid), False).when(F.coalesce(is_cvt, F.lit(False)), True).when(marked, True).when(named, False).otherwise(~plain)


def described(nodes: DataFrame, store: GraphStore) -> DataFrame:
    """``node, name, types, is_literal, is_probable_cvt``; what is no entity is a literal."""
    return described_nodes(node_table(nodes, store.entities, "mid"), store)


def described_nodes(n: DataFrame, store: GraphStore) -> DataFrame:
    """``described`` of nodes (``node``) that are different and, if read elsewhere, too, written."""
    e = entities_of(store.entities, kinds_among(n, store.entities, "mid"))
    e = e.select(F.col("mid").alias("node"), "name", "types", "is_cvt", F.lit(True).alias("known"))
    d = small(n).join(e, "node", "left")
    return d.select("node", display_name(F.col("node"), F.col("name")).alias("name"), F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.col("known").isNull().alias("is_literal"), (F.col("known").isNotNull() & probable_cvt(F.col("node"), F.col("name"), F.col("types"), F.col("is_cvt"))).alias("is_probable_cvt"))


def metadata(nodes: DataFrame, store: GraphStore) -> DataFrame:
    """``described`` with the nodes' degrees."""
    n = node_table(nodes, store.edges, "head", "tail")
    d = described(n, store).join(store.degrees(n).withColumnRenamed("mid", "node"), "node", "left")
    return d.select("node", "name", "types", F.coalesce("degree", F.lit(0)).alias("degree"), "is_literal", "is_probable_cvt")


def direct_edges(sources: DataFrame, targets: DataFrame, edges: DataFrame, relations: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Edges from any source to any target (each a DataFrame with ``node``)."""
    e = edges.where("tail_kind = 'id'")
    if relations:
        e = e.where(F.col("relation").isin(relations))
    e = e.join(small(sources.select(F.col("node").alias("head")).distinct()), "head", "left_semi").join(small(targets.select(F.col("node").alias("tail")).distinct()), "tail", "left_semi")
    e = e.select("head", "relation", "tail")
    return e.orderBy("head", "tail", "relation").limit(limit) if limit > 0 else e


def two_hop_between(sources: DataFrame, targets: DataFrame, edges: DataFrame, relations: list[str] | None = None, limit: int = 0) -> DataFrame:
    """``source, r1, mid, r2, target`` over id edges; a relation filter holds for both hops."""
    e = edges.where("tail_kind = 'id'")
    if relations:
        e = e.where(F.col("relation").isin(relations))
    one = e.select(F.col("head").alias("source"), F.col("relation").alias("r1"), F.col("tail").alias("mid")).join(small(sources.select(F.col("node").alias("source")).distinct()), "source", "left_semi")
    two = e.select(F.col("head").alias("mid"), F.col("relation").alias("r2"), F.col("tail").alias("target")).join(small(targets.select(F.col("node").alias("target")).distinct()), "target", "left_semi")
    # The first hop is written: if it is small, the second hop's edges are scanned, not shuffled.
    d = small(written(one)).join(two, "mid").select("source", "r1", "mid", "r2", "target")
    return d.orderBy("source", "mid", "target", "r1", "r2").limit(limit) if limit > 0 else d


def pair_check(pairs: DataFrame, edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """For (source, target) pairs: the edges between them, in either direction."""
    e = edges.where("tail_kind = 'id'")
    if relations:
        e = e.where(F.col("relation").isin(relations))
    p = small(pairs.select("source", "target").distinct())
    ahead = p.join(e.select(F.col("head").alias("source"), "relation", F.col("tail").alias("target")), ["source", "target"]).withColumn("reversed", F.lit(False))
    back = p.join(e.select(F.col("tail").alias("source"), "relation", F.col("head").alias("target")), ["source", "target"]).withColumn("reversed", F.lit(True))
    return ahead.unionByName(back)


def having_relation(nodes: DataFrame, edges: DataFrame, relations: list[str]) -> DataFrame:
    """The nodes with an edge of these relations in either direction."""
    e = edges.where(F.col("relation").isin(relations))
    ends = e.select(F.col("head").alias("node")).union(e.where("tail_kind = 'id'").select(F.col("tail").alias("node")))
    return nodes.join(ends, "node", "left_semi")


def touching(nodes: DataFrame, edges: DataFrame, targets: list[str]) -> DataFrame:
    """The nodes next to any of the targets."""
    ends = edges.where(F.col("tail").isin(targets)).select(F.col("head").alias("node")).union(edges.where(F.col("head").isin(targets) & (F.col("tail_kind") == "id")).select(F.col("tail").alias("node")))
    return nodes.join(ends, "node", "left_semi")


def _best(d: DataFrame, by: str, keys: list[str], top_k: int, last: str) -> DataFrame:
    w = Window.partitionBy(*keys, last).orderBy(F.desc("score"), by)
    d = d.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), last)))
    return d.where(F.col("rank") <= top_k)


def resolve_entities(mentions: DataFrame, store: GraphStore, top_k: int = 5, like: bool = False) -> DataFrame:
    """Candidates of each ``mention``: ``mention, mid, match_type, score, rank``.

    By the index of names and aliases, and by id. ``like``: additionally names or aliases that contain the mention, found by
    the rarest trigram of each mention (``contain``).
    """
    m = mentions.select("mention").distinct().withColumn("norm", norm_catalog(F.col("mention"))).where("norm <> ''")
    m = small(written(m))
    a = store.alias_index
    kind = F.when(F.col("alias_source") == "name", "name_exact").otherwise("alias_exact")
    points = F.when(F.col("alias_source") == "name", ENTITY_SCORES["name_exact"]).otherwise(ENTITY_SCORES["alias_exact"])
    found = m.join(a, m.norm == a.alias_norm).select("mention", "mid", kind.alias("match_type"), points.alias("score"))
    as_id = F.regexp_replace(F.regexp_replace(F.trim("mention"), "^/", ""), "/", ".")
    ids = m.withColumn("mid", as_id)
    known = entities_of(store.entities, kinds_among(ids.withColumnRenamed("mid", "node"), store.entities, "mid"))
    found = found.union(ids.join(known.select("mid"), "mid", "left_semi").select("mention", "mid", F.lit("mid"), F.lit(ENTITY_SCORES["mid"])))
    if like:
        pairs = containing(m.select(F.col("norm").alias("needle")), a.select(F.col("alias_norm").alias("text")))
        near = m.join(pairs.withColumnRenamed("needle", "norm"), "norm").join(a, F.col("text") == F.col("alias_norm"))
        found = found.union(near.select("mention", "mid", F.lit("alias_like"), F.lit(ENTITY_SCORES["alias_like"])))
    return _best(found, "match_type", ["mention"], top_k, "mid").select("mention", "mid", "match_type", "score", "rank")


def resolve_relations(hints: DataFrame, store: GraphStore, top_k: int = 5, fuzzy: bool = True, sequence: bool = False) -> DataFrame:
    """Candidates of each ``hint`` among the relations (a small catalog): ``hint, relation, match_type, score, rank``.

    ``fuzzy``: hints with too few matches are compared with every relation by token overlap, and with ``sequence``
    by matching blocks, too.
    """
    h = written(hints.select("hint").distinct().withColumn("norm", norm_catalog(F.col("hint"))).where("norm <> ''"))
    r = store.relations.select("relation", "relation_name", norm_catalog(F.col("relation")).alias("id_norm"), norm_catalog(F.col("relation_name")).alias("name_norm"))
    r = written(r)
    names = h.join(small(r.withColumn("norm", F.col("name_norm"))), "norm")
    ids = h.join(small(r.withColumn("norm", F.col("id_norm"))), "norm")
    whole = h.withColumn("relation", F.trim("hint")).join(small(r), "relation")

    def held(text: str) -> DataFrame:
        pairs = containing(h.select(F.col("norm").alias("needle")), r.select(F.col(text).alias("text")))
        return h.join(small(pairs.withColumnRenamed("needle", "norm")), "norm").join(small(r), F.col("text") == F.col(text))

    ways = [("relation_exact", whole), ("relation_norm_exact", ids), ("relation_name_exact", names), ("relation_name_like", held("name_norm")), ("relation_id_like", held("id_norm"))]
    tries = [d.select("hint", "norm", "relation", "name_norm", F.lit(k).alias("place"), F.lit(kind).alias("match_type"), F.lit(RELATION_SCORES[kind]).alias("score")) for k, (kind, d) in enumerate(ways)]
    every = reduce(DataFrame.unionByName, tries)
    # The first way that matches names the kind.
    first = every.groupBy("hint", "norm", "relation", "name_norm").agg(F.min_by(F.struct("match_type", "score"), "place").alias("x"))
    exact = written(first.select("hint", "norm", "relation", "name_norm", "x.match_type", "x.score"))
    if fuzzy:
        enough = exact.groupBy("hint").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= top_k).select("hint")
        open_ = h.join(enough, "hint", "left_anti")
        if sequence:
            # Matching blocks need no common word: hints with too few matches meet the whole catalog of relations.
            pairs = open_.crossJoin(small(r))
            near = F.greatest(jaccard80(F.col("norm"), F.col("name_norm")), 70.0 * sequence_ratio(F.col("norm"), F.col("name_norm")))
        else:
            word = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("word")
            pairs = open_.select("hint", "norm", word("norm")).join(small(r.select("relation", "name_norm", word("name_norm"))), "word").select("hint", "norm", "relation", "name_norm").distinct()
            near = jaccard80(F.col("norm"), F.col("name_norm"))
        rest = pairs.join(exact.select("hint", "relation"), ["hint", "relation"], "left_anti")
        rest = rest.withColumns({"match_type": F.lit("fuzzy"), "score": near}).where("score > 0")
        exact = exact.unionByName(rest.select(exact.columns))
    return _best(exact, "match_type", ["hint"], top_k, "relation").select("hint", "relation", "match_type", "score", "rank")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def _packed(df: DataFrame, name: str, block: int) -> DataFrame:
    """``part, size, names, units``: up to ``block`` unit vectors of one length per row, as they come; nothing is shuffled."""

    def run(batches):
        held: dict[int, list] = {}

        def row(size):
            names, rows = zip(*held.pop(size))
            x = np.array(rows)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            cols = [[size], [np.array(names, np.int64).tobytes()], [x.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()))], ["size", "names", "units"])

        for b in batches:
            for m, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if m is not None and v and None not in v and any(v):
                    held.setdefault(len(v), []).append((m, v))
                    if len(held[len(v)]) == block:
                        yield row(len(v))
        for size in list(held):
            yield row(size)

    d = df.select(F.col(name).cast("long").alias("name"), F.col("vector").cast("array<double>").alias("vector"))
    return written(d.mapInArrow(run, "size int, names binary, units binary").withColumn("part", F.monotonically_increasing_id()))


def link_by_embedding(mentions: DataFrame, catalog: DataFrame, top_k: int = 1, block: int = 4096, digits: int = 9) -> DataFrame:
    """The ``top_k`` catalog rows (``item, vector``) closest to each mention (``mention, vector``) by cosine.

    Mentions are the stated query set. Both sides are packed into blocks of ``block`` unit vectors, and each block of mentions
    meets each block of the catalog in a group of its own: two rows, a matrix product, and the best of it go on. Nothing
    passes the driver; what is shuffled is each block once per block of the other side. Scores are equal if they are equal to
    ``digits`` places; ties go to the smaller item. Vectors without a norm, and of unequal length, are compared with nothing.
    Items and mentions are integers; null ones take no part.
    """
    q, c = _packed(mentions, "mention", block), _packed(catalog, "item", block)
    pairs = q.select("size", F.col("part").alias("p")).join(c.select("size", F.col("part").alias("s")), "size").select("p", "s")
    pairs = written(pairs)  # of ids
    side = lambda d, key, n: small(pairs).join(d.select(F.col("part").alias(key), "names", "units"), key).select("p", "s", F.lit(n).alias("side"), "names", "units")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("side")
        (names, ids), (unit, x) = ([np.frombuffer(v.as_buffer(), kind) for v in t[col]] for col, kind in (("names", np.int64), ("units", np.float64)))
        scores = np.round(unit.reshape(len(names), -1) @ x.reshape(len(ids), -1).T, digits)
        got = []
        for name, row in zip(names, scores):
            best = np.flatnonzero(row >= np.partition(row, len(row) - top_k)[len(row) - top_k]) if len(row) > top_k else np.arange(len(row))
            best = best[np.lexsort((ids[best], -row[best]))[:top_k]]
            got.append((np.full(len(best), name), ids[best], row[best]))
        return pa.table(dict(zip(("mention", "item", "score"), map(np.concatenate, zip(*got)))))

    found = side(q, "p", 0).unionByName(side(c, "s", 1)).groupBy("p", "s").applyInArrow(run, "mention long, item long, score double")
    w = Window.partitionBy("mention").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)

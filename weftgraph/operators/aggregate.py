"""Aggregations over frontiers and attribute rows, set operators, and budgeted expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_catalog, number_or_year, type_names
from .lookup import incident, metadata
from .order import top
from .store import GraphStore, around, entities_of, kinds_among, small, written


def frontier_relations(frontier: DataFrame, store: GraphStore, keys: list[str] | None = None, literals: bool = True, reverse: bool = True, samples: int = 3) -> DataFrame:
    """Relations at each frontier (``keys`` + ``node``): supporting nodes, neighbours, support ratio, frequency, samples.

    Reverse edges count id tails only. Samples are the first names and types in order.
    """
    keys = keys or []
    f = written(frontier.select(*keys, "node").distinct())
    size = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("frontier_size"))
    e = store.edges if literals else store.edges.where("tail_kind = 'id'")
    d = incident(f, e, reverse=False)
    if reverse:
        back = around(store.edges, f)[1].where("tail_kind = 'id'")
        d = d.unionByName(small(f).join(back.select(F.col("tail").alias("node"), "relation", F.col("head").alias("neighbor"), F.lit(True).alias("reversed"), F.lit("id").alias("neighbor_kind")), "node"))
    d = d.withColumn("direction", F.when(F.col("reversed"), "reverse").otherwise("forward"))
    d = written(d.select(*keys, "node", "relation", "direction", "neighbor"))  # counted, and read for samples
    by = [*keys, "relation", "direction"]
    counts = d.groupBy(*by).agg(F.countDistinct("node").alias("supporting_node_count"), F.count(F.lit(1)).alias("total_neighbor_count"), F.sort_array(F.collect_set("neighbor")).alias("reached") if samples < 0 else F.min("neighbor").alias("first_neighbor"))
    counts = counts.join(size, keys) if keys else counts.crossJoin(size)
    out = counts.join(small(store.relation_stats), "relation", "left")
    out = out.withColumn("support_ratio", F.col("supporting_node_count") / F.greatest("frontier_size", F.lit(1)))
    if samples > 0:
        # The first few names and types per group, found with bounded per-group state.
        w = Window.partitionBy(*by).orderBy("neighbor")
        few = d.select(*by, "neighbor").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= samples)
        few = written(few)
        named = few.join(entities_of(store.entities, kinds_among(few.select(F.col("neighbor").alias("node")), store.entities, "mid")).select(F.col("mid").alias("neighbor"), "name", "types"), "neighbor", "left")
        named = named.groupBy(*by).agg(F.array_sort(F.collect_set(F.coalesce(F.nullif("name", F.lit("")), "neighbor"))).alias("sample_target_names"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("types", F.array().cast("array<string>")))))), 1, samples).alias("sample_target_types"))
        out = out.join(named, by, "left")
    return out.withColumnRenamed("frequency", "global_frequency").drop("first_neighbor")


def aggregate_plan_score(candidates: DataFrame, expected_type: str | None) -> DataFrame:
    """Support ratio, +1 for a type name in the relation or the samples, +0.5 for words of numbers or dates."""
    text = norm_catalog(F.concat_ws(" ", "relation", F.concat_ws(" ", "sample_target_types"), F.concat_ws(" ", "sample_target_names")))
    names = type_names(expected_type)
    hit: Column = F.lit(False)
    for n in names:
        hit = hit | F.contains(text, F.lit(n))
    numeric = norm_catalog(F.col("relation")).rlike("number|date|year|amount|price|size|quantity|count|height|population|area|total")
    return candidates.withColumn("score", F.col("support_ratio") + F.when(hit, 1.0).otherwise(0.0) + F.when(numeric, 0.5).otherwise(0.0))


def frontier_summary(frontier: DataFrame, store: GraphStore, keys: list[str]) -> DataFrame:
    """Per frontier: nodes, literals, share of mediators among entities (4 places), names, types, degrees."""
    m = metadata(frontier, store)
    d = frontier.select(*keys, "node").distinct().join(m, "node")
    ent = ~F.col("is_literal")
    w = Window.partitionBy(*keys).orderBy("node")
    d = d.withColumn("rn", F.row_number().over(w))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("node_count"),
        F.count_if("is_literal").alias("literal_count"),
        F.round(F.count_if(ent & F.col("is_probable_cvt")) / F.greatest(F.count_if(ent), F.lit(1)), 4).alias("probable_cvt_ratio"),
        F.array_sort(F.collect_set(F.when(F.col("rn") <= 5, F.col("name")))).alias("sample_names"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rn") <= 10, F.col("types")))))).alias("sample_types"),
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"),
    )


def top_per_source(frontier: DataFrame, edges: DataFrame, relation: str, limit: int, reverse: bool = False) -> DataFrame:
    """The first ``limit`` neighbours of each source by one relation, and the number there are.

    A source's neighbours are cut per part before they meet (``order.top``), so no task sorts all of a hub's.
    """
    e = edges.where(F.col("relation") == relation)
    e = e.select(F.col("tail").alias("node"), F.col("head").alias("neighbor")) if reverse else e.select(F.col("head").alias("node"), F.col("tail").alias("neighbor"))
    d = written(small(frontier.select("node").distinct()).join(e, "node").distinct())
    total = d.groupBy("node").agg(F.count(F.lit(1)).alias("source_total"))
    return top(d, ["node"], limit, "neighbor", name="rn").join(total, "node")


def expand_budgeted(frontier: DataFrame, edges: DataFrame, relation: str, per_source: int, total: int, keys: list[str], reverse: bool = False) -> DataFrame:
    """Budgeted expansion of frontiers (``keys, node, ord``): sources are used up in order until ``total`` targets.

    Rows ``keys, source, target, pos, is_new`` that were used; ``is_new`` marks the first source that reached a target.
    """
    e = edges.where(F.col("relation") == relation)
    e = e.select(F.col("tail").alias("node"), F.col("head").alias("target")) if reverse else e.select(F.col("head").alias("node"), F.col("tail").alias("target"))
    d = small(frontier).join(e.distinct(), "node")
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "node", "ord").orderBy("target"))).where(F.col("rn") <= per_source)
    d = d.withColumn("first", (F.row_number().over(Window.partitionBy(*keys, "target").orderBy("ord", "rn")) == 1).cast("int"))
    w = Window.partitionBy(*keys).orderBy("ord", "rn")
    d = d.withColumn("seen", F.sum("first").over(w)).withColumn("pos", F.row_number().over(w))
    return d.where(F.col("seen") - F.col("first") < total).select(*keys, F.col("node").alias("source"), "target", "pos", (F.col("first") == 1).alias("is_new"))


def count_union(sets: DataFrame) -> DataFrame:
    """The number of different entities in all sets (``set_id, entity``) of a question, if it has one."""
    keys = [c for c in sets.columns if c not in ("set_id", "entity")]
    return sets.groupBy(*keys).agg(F.countDistinct("entity").alias("n"))


def intersect_sets(sets: DataFrame) -> DataFrame:
    """The entities in every set."""
    keys = [c for c in sets.columns if c not in ("set_id", "entity")]
    total = sets.groupBy(*keys).agg(F.countDistinct("set_id").alias("sets"))
    each = sets.groupBy(*keys, "entity").agg(F.countDistinct("set_id").alias("n"))
    d = each.join(total, keys) if keys else each.crossJoin(total)
    return d.where("n = sets").select(*keys, "entity")


def sqlite_number(c: Column) -> Column:
    """The number a text starts with, its commas dropped; null unless it starts like one."""
    t = F.regexp_replace(F.trim(c), ",", "")
    return F.nullif(F.regexp_extract(t, r"^[-+]?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def rank_numeric(sources: DataFrame, edges: DataFrame, relations: list[str], largest: bool = True, limit: int = 10) -> DataFrame:
    """Sources by a numeric (or date, by its year) attribute, over all of them; ties follow the order of the values."""
    e = edges.where(F.col("relation").isin(relations) & (F.col("tail_kind") != "id"))
    d = e.select(F.col("head").alias("node"), "relation", F.col("tail").alias("value")).join(small(sources.select("node")), "node", "left_semi")
    d = d.withColumn("numeric_value", F.coalesce(sqlite_number(F.col("value")), number_or_year(F.col("value")))).where("numeric_value IS NOT NULL")
    d = d.dropDuplicates(["node", "relation", "value"])
    order = [F.desc("numeric_value"), F.desc("node"), "value"] if largest else ["numeric_value", "node", "value"]
    d = d.orderBy(*order)
    return d.limit(limit) if limit > 0 else d


def best_rows(rows: DataFrame, value: str, order: str, largest: bool = True, keys: list[str] | None = None) -> DataFrame:
    """The row with the largest (smallest) number or year per question; ties to the first row."""
    v = number_or_year(F.col(value))
    w = Window.partitionBy(*(keys or [])).orderBy(F.desc("numeric_value") if largest else "numeric_value", order) if keys else Window.partitionBy(F.lit(0)).orderBy(F.desc("numeric_value") if largest else "numeric_value", order)
    d = rows.withColumn("numeric_value", v).where("numeric_value IS NOT NULL")
    if not keys:
        return d.orderBy(F.desc("numeric_value") if largest else F.asc("numeric_value"), order).limit(1)
    return d.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def collect_entities(sources: DataFrame, edges: DataFrame, relations: list[str], direction: str = "forward", limit: int = 0) -> DataFrame:
    """Id neighbours by these relations: ``source, relation, target``; the limit comes before any later filter."""
    e = edges.where(F.col("relation").isin(relations) & (F.col("tail_kind") == "id"))
    e = e.select(F.col("head").alias("source"), "relation", F.col("tail").alias("target")) if direction == "forward" else e.select(F.col("tail").alias("source"), "relation", F.col("head").alias("target"))
    d = e.join(small(sources.select(F.col("node").alias("source"))), "source", "left_semi").distinct()
    return d.orderBy("source", "relation", "target").limit(limit) if limit > 0 else d


def collect_literals(sources: DataFrame, edges: DataFrame, relations: list[str]) -> DataFrame:
    e = edges.where(F.col("relation").isin(relations) & (F.col("tail_kind") != "id"))
    return e.select(F.col("head").alias("source"), "relation", F.col("tail").alias("value")).join(small(sources.select(F.col("node").alias("source"))), "source", "left_semi").distinct()


def collect_constrained(sources: DataFrame, store: GraphStore, relations: list[str], expected_type: str | None, terms: list[str], limit: int = 40, weights: tuple[float, float, float] = (8.0, 4.0, 3.0), direction: str = "forward") -> DataFrame:
    """Targets by these relations, ranked: type found (in types, else only in the name), terms found, no mediator."""
    d = collect_entities(sources, store.edges, relations, direction)
    m = metadata(d.select(F.col("target").alias("node")), store)
    d = d.join(m.withColumnRenamed("node", "target"), "target")
    hay = norm_catalog(F.concat_ws(" ", "name", F.concat_ws(" ", "types"), "relation"))
    types = norm_catalog(F.concat_ws(" ", "types"))
    found = lambda text: [F.contains(text, F.lit(n)) for n in type_names(expected_type)]
    any_of = lambda xs: F.exists(F.array(*xs), lambda x: x) if xs else F.lit(False)
    score = F.when(any_of(found(types)), weights[0]).when(any_of(found(hay)), weights[1]).otherwise(0.0)
    for t in terms:
        score = score + F.when(F.contains(hay, norm_catalog(F.lit(t))), weights[2]).otherwise(0.0)
    score = score - F.when(F.col("is_probable_cvt"), 2.0).otherwise(0.0)
    d = d.withColumn("score", score).orderBy(F.desc("score"), "relation", "target", "source")
    return (d.limit(limit) if limit > 0 else d).select("source", "relation", "target", "name", "score")

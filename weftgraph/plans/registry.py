"""Registered queries over the star-schema graph and the plain tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregate as ag
from ..operators import beam as bm
from ..operators import etl, evaluate, lookup, loop, rank, resolve, solve, traverse
from ..operators.order import places
from ..operators.store import GraphStore, entities_of, node_stats, written
from ..sources import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, graph: bool = True):
    """Registers a query; ``graph``: its SQL reads kg_entities and kg_triples."""

    def add(f):
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            if graph:
                body = f"{star.SQL_PREFIX}, {body[5:].strip()}" if body.upper().startswith("WITH ") else f"{star.SQL_PREFIX}\n{body}"
            ORACLE_SQL[name] = body
        return f

    return add


def graph(spark: SparkSession, sf: str, whole: bool = False) -> GraphStore:
    return GraphStore(star.triples(spark, sf, whole), star.entities(spark, sf))


def named(store: GraphStore, kind: str) -> DataFrame:
    """The entities whose ids begin with ``m.`` and the kind."""
    return entities_of(store.entities, {f"m.{kind}"}).where(F.col("mid").startswith(f"m.{kind}."))


def mids(store: GraphStore, kind: str) -> DataFrame:
    return named(store, kind).select(F.col("mid").alias("node"))


def values(spark: SparkSession, column: str, items: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in items], f"{column} string")


def _cat(x: str) -> str:
    return rf"trim(regexp_replace(lower(trim(coalesce({x}, ''))), '[\s._/\-()|]+', ' ', 'g'))"


def _tok(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


def _jac(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0)::DOUBLE, 0.0)"


ALL = "SELECT head AS node, relation, tail AS neighbor, false AS reversed FROM kg_triples UNION ALL SELECT tail, relation, head, true FROM kg_triples WHERE tail_kind = 'id'"
NATIONS = "SELECT mid AS node FROM kg_entities WHERE mid LIKE 'm.nation.%'"

# --- lookups -------------------------------------------------------------------------------------------------------

_NEIGHBORS = """
WITH d AS (SELECT DISTINCT a.node, a.relation, a.neighbor, a.reversed, CASE WHEN a.relation = 'geo.nation.region' THEN 1 ELSE 0 END AS h
  FROM ({all}) a JOIN ({nodes}) n ON a.node = n.node {where}),
l AS (SELECT *, row_number() OVER (PARTITION BY node, reversed ORDER BY h DESC, relation, neighbor) AS rn FROM d),
r AS (SELECT node, relation, neighbor, reversed, row_number() OVER (PARTITION BY node ORDER BY h DESC, relation, neighbor, reversed) AS rank FROM l WHERE rn <= 10)
SELECT node, relation, neighbor, reversed, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""


@query("kg_neighbors_soft", _NEIGHBORS.format(all=ALL, nodes=NATIONS, where=""))
def kg_neighbors_soft(spark, sf):
    g = graph(spark, sf)
    return lookup.neighbors(mids(g, "nation"), g.edges, ["geo.nation.region"], limit=10)


@query("kg_neighbors_strict", _NEIGHBORS.format(all=ALL, nodes=NATIONS, where="WHERE a.relation = 'geo.nation.region'"))
def kg_neighbors_strict(spark, sf):
    g = graph(spark, sf)
    return lookup.neighbors(mids(g, "nation"), g.edges, ["geo.nation.region"], strict=True, limit=10)


_DEGREES = "s AS (SELECT mid, sum(i) AS in_degree, sum(o) AS out_degree, sum(l) AS literal_out_degree FROM (SELECT head AS mid, 0 AS i, 1 AS o, CASE WHEN tail_kind = 'id' THEN 0 ELSE 1 END AS l FROM kg_triples UNION ALL SELECT tail, 1, 0, 0 FROM kg_triples WHERE tail_kind = 'id' UNION ALL SELECT mid, 0, 0, 0 FROM kg_entities) GROUP BY mid)"


@query("kg_node_metadata", f"""
WITH {_DEGREES}, n AS (SELECT mid AS node FROM kg_entities WHERE mid LIKE 'm.region.%' OR mid LIKE 'm.nation.%' OR mid LIKE 'm.supplier.%' UNION ALL SELECT DISTINCT tail FROM kg_triples WHERE relation = 'org.supplier.acctbal')
SELECT n.node, coalesce(nullif(e.name, ''), n.node) AS name, coalesce(e.types, '') AS types, CAST(coalesce(s.in_degree + s.out_degree, 0) AS BIGINT) AS degree, e.mid IS NULL AS is_literal, coalesce(e.is_cvt = 1, false) AS is_probable_cvt
FROM n LEFT JOIN kg_entities e ON n.node = e.mid LEFT JOIN s ON n.node = s.mid
""")  # fmt: skip
def kg_node_metadata(spark, sf):
    g = graph(spark, sf)
    lit = g.edges.where("relation = 'org.supplier.acctbal'").select(F.col("tail").alias("node"))
    d = lookup.metadata(mids(g, "region").union(mids(g, "nation")).union(mids(g, "supplier")).union(lit), g)
    return d.withColumn("types", F.array_join("types", "|"))


@query("kg_display_names", "SELECT mid, coalesce(nullif(name, ''), mid) AS display FROM kg_entities")
def kg_display_names(spark, sf):
    return graph(spark, sf).entities.select("mid", lookup.display_name(F.col("mid"), F.col("name")).alias("display"))


@query("kg_probable_cvt", "SELECT mid, CASE WHEN is_cvt = 1 THEN true WHEN name <> '' THEN false WHEN types LIKE 'people.%' OR types LIKE '%|people.%' OR types LIKE '%|location.%' THEN false ELSE true END AS is_probable_cvt FROM kg_entities")
def kg_probable_cvt(spark, sf):
    e = graph(spark, sf).entities
    return e.select("mid", lookup.probable_cvt(F.col("mid"), F.col("name"), F.col("types"), F.col("is_cvt")).alias("is_probable_cvt"))


@query("kg_entity_resolve_alias", f"""
WITH m AS (SELECT DISTINCT name AS mention, {_cat('name')} AS norm FROM kg_entities WHERE mid LIKE 'm.nation.%' OR mid LIKE 'm.part.%'),
f AS (SELECT DISTINCT m.mention, e.mid, 'name_exact' AS match_type, 95.0 AS score FROM m JOIN kg_entities e ON e.name <> '' AND {_cat('e.name')} = m.norm),
r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, mid) AS rank FROM f)
SELECT mention, mid, match_type, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")  # fmt: skip
def kg_entity_resolve_alias(spark, sf):
    g = graph(spark, sf)
    m = g.entities.where("mid LIKE 'm.nation.%' OR mid LIKE 'm.part.%'").select(F.col("name").alias("mention"))
    return lookup.resolve_entities(m, g)


@query("kg_entity_resolve_like", f"""
WITH m AS (SELECT DISTINCT r_name AS mention, {_cat('r_name')} AS norm FROM region UNION SELECT 'm.nation.3', 'm nation 3' UNION SELECT '/m/nation/4', 'm nation 4'),
f AS (SELECT m.mention, e.mid, 'name_exact' AS match_type, 95.0 AS score FROM m JOIN kg_entities e ON e.name <> '' AND {_cat('e.name')} = m.norm
  UNION ALL SELECT m.mention, e.mid, 'alias_like', 80.0 FROM m JOIN kg_entities e ON e.name <> '' AND contains({_cat('e.name')}, m.norm)
  UNION ALL SELECT m.mention, e.mid, 'mid', 100.0 FROM m JOIN kg_entities e ON e.mid = replace(regexp_replace(trim(m.mention), '^/', ''), '/', '.')),
b AS (SELECT *, row_number() OVER (PARTITION BY mention, mid ORDER BY score DESC, match_type) AS n FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, mid) AS rank FROM b WHERE n = 1)
SELECT mention, mid, match_type, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")  # fmt: skip
def kg_entity_resolve_like(spark, sf):
    g = graph(spark, sf)
    m = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_name").alias("mention")).union(values(spark, "mention", ["m.nation.3", "/m/nation/4"]))
    return lookup.resolve_entities(m, g, like=True)


_HINTS = ["geo.nation.region", "Geo Nation_Region", "nation", "supplier nation", "order total price", "retail price of a part", "customer"]
_HINT_ROWS = ", ".join(f"('{h}')" for h in _HINTS)
_RELATION_SQL = f"""
WITH h AS (SELECT hint, {_cat('hint')} AS norm FROM (VALUES {_HINT_ROWS}) t(hint)),
c AS (SELECT DISTINCT relation, {_cat('relation')} AS n FROM kg_triples),
x AS (SELECT h.hint, h.norm, c.relation, c.n, CASE WHEN c.relation = trim(h.hint) THEN 'relation_exact' WHEN c.n = h.norm THEN 'relation_norm_exact' WHEN contains(c.n, h.norm) THEN 'relation_name_like' END AS k FROM h, c),
y AS (SELECT *, CASE k WHEN 'relation_exact' THEN 100.0 WHEN 'relation_norm_exact' THEN 98.0 WHEN 'relation_name_like' THEN 90.0 END AS s FROM x),
"""


@query("kg_relation_resolve_exact", _RELATION_SQL + """
r AS (SELECT *, row_number() OVER (PARTITION BY hint ORDER BY s DESC, relation) AS rank FROM y WHERE s IS NOT NULL)
SELECT hint, relation, k AS match_type, CAST(s AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")  # fmt: skip
def kg_relation_resolve_exact(spark, sf):
    return lookup.resolve_relations(values(spark, "hint", _HINTS), graph(spark, sf), fuzzy=False)


@query("kg_relation_resolve_jaccard", _RELATION_SQL + f"""
q AS (SELECT hint FROM y WHERE s IS NOT NULL GROUP BY hint HAVING count(*) >= 5),
z AS (SELECT hint, relation, k, CAST(s AS DOUBLE) AS s FROM y WHERE s IS NOT NULL UNION ALL SELECT hint, relation, 'fuzzy', 80.0 * {_jac(_tok('norm'), _tok('n'))} FROM y WHERE s IS NULL AND hint NOT IN (SELECT hint FROM q)),
r AS (SELECT *, row_number() OVER (PARTITION BY hint ORDER BY s DESC, relation) AS rank FROM z WHERE s > 0)
SELECT hint, relation, k AS match_type, s AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")  # fmt: skip
def kg_relation_resolve_jaccard(spark, sf):
    return lookup.resolve_relations(values(spark, "hint", _HINTS), graph(spark, sf))


@query("kg_relation_resolve_sequence")
def kg_relation_resolve_sequence(spark, sf):
    return lookup.resolve_relations(values(spark, "hint", _HINTS), graph(spark, sf), sequence=True)


# --- index -----------------------------------------------------------------------------------------------------------


@query("kg_node_stats", f"WITH {_DEGREES} SELECT mid, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, CAST(literal_out_degree AS BIGINT) AS literal_out_degree, CAST(in_degree + out_degree AS BIGINT) AS degree, in_degree + out_degree >= 500 AS high_degree FROM s")
def kg_node_stats(spark, sf):
    g = graph(spark, sf)
    return node_stats(g.edges, g.entities)


@query("kg_relation_stats", "SELECT relation, count(*) AS frequency FROM kg_triples GROUP BY relation")
def kg_relation_stats(spark, sf):
    return graph(spark, sf).relation_stats


@query("kg_alias_index", f"SELECT {_cat('name')} AS alias_norm, mid, name AS entity_name, 'name' AS alias_source FROM kg_entities WHERE name <> ''")
def kg_alias_index(spark, sf):
    return graph(spark, sf).alias_index


@query("kg_relation_lookup", f"WITH c AS (SELECT DISTINCT relation, {_cat('relation')} AS n FROM kg_triples) SELECT n AS lookup_norm, relation, n AS relation_name, 'relation_id' AS lookup_source FROM c UNION ALL SELECT n, relation, n, 'relation_name' FROM c")
def kg_relation_lookup(spark, sf):
    return graph(spark, sf).relation_lookup


# --- joins -----------------------------------------------------------------------------------------------------------


@query("kg_direct_edges", "SELECT head, relation, tail FROM kg_triples WHERE tail_kind = 'id' AND (head LIKE 'm.supplier.%' OR head LIKE 'm.customer.%') AND tail LIKE 'm.nation.%'")
def kg_direct_edges(spark, sf):
    g = graph(spark, sf)
    return lookup.direct_edges(mids(g, "supplier").union(mids(g, "customer")), mids(g, "nation"), g.edges)


@query("kg_two_hop_between", "SELECT a.head AS source, a.relation AS r1, a.tail AS mid, b.relation AS r2, b.tail AS target, a.head || ' -> ' || a.relation || ' -> ' || a.tail || ' -> ' || b.relation || ' -> ' || b.tail AS path_text FROM kg_triples a JOIN kg_triples b ON a.tail = b.head WHERE a.tail_kind = 'id' AND b.tail_kind = 'id' AND a.head LIKE 'm.supplier.%' AND b.tail LIKE 'm.region.%'")
def kg_two_hop_between(spark, sf):
    """Suppliers and the regions of their nations."""
    g = graph(spark, sf)
    d = lookup.two_hop_between(mids(g, "supplier"), mids(g, "region"), g.edges)
    return d.withColumn("path_text", F.concat_ws(" -> ", "source", "r1", "mid", "r2", "target"))


@query("kg_candidate_relation_semi", "SELECT mid AS node FROM kg_entities WHERE mid IN (SELECT head FROM kg_triples WHERE relation IN ('geo.supplier.nation', 'geo.nation.region') UNION SELECT tail FROM kg_triples WHERE relation IN ('geo.supplier.nation', 'geo.nation.region'))")
def kg_candidate_relation_semi(spark, sf):
    g = graph(spark, sf)
    return lookup.having_relation(g.entities.select(F.col("mid").alias("node")), g.edges, ["geo.supplier.nation", "geo.nation.region"])


@query("kg_candidate_constraint_semi", "SELECT mid AS node FROM kg_entities WHERE mid IN (SELECT head FROM kg_triples WHERE tail IN ('m.nation.3', 'm.region.1') UNION SELECT tail FROM kg_triples WHERE tail_kind = 'id' AND head IN ('m.nation.3', 'm.region.1'))")
def kg_candidate_constraint_semi(spark, sf):
    g = graph(spark, sf)
    return lookup.touching(g.entities.select(F.col("mid").alias("node")), g.edges, ["m.nation.3", "m.region.1"])


@query("kg_verify_pairs", """
WITH s AS (SELECT head, tail, relation FROM kg_triples WHERE relation = 'geo.supplier.nation'), n AS (SELECT head, tail, relation FROM kg_triples WHERE relation = 'geo.nation.region')
SELECT s.head AS source, n.tail AS target, 2 AS hops, s.relation || ' -> ' || n.head || ' -> ' || n.relation AS evidence FROM s JOIN n ON n.head = s.tail
UNION ALL SELECT head, tail, 1, relation FROM s
""")  # fmt: skip
def kg_verify_pairs(spark, sf):
    """Suppliers with their regions (two hops), with their nations (one), and with themselves (none)."""
    g = graph(spark, sf)
    r = _regions_of_suppliers(g)
    p = r.select(F.col("supplier").alias("source"), F.explode(F.array("region", "nation", "supplier")).alias("target"))
    return solve.verify(p, g.edges).select("source", "target", "hops", "evidence")


# --- aggregates ------------------------------------------------------------------------------------------------------

_INCIDENT = "SELECT head AS node, relation, tail AS neighbor, 'forward' AS direction FROM kg_triples UNION ALL SELECT tail, relation, head, 'reverse' FROM kg_triples WHERE tail_kind = 'id'"
_FRONTIER = f"""
d AS (SELECT a.* FROM ({_INCIDENT}) a JOIN ({NATIONS}) n ON a.node = n.node),
c AS (SELECT relation, direction, count(DISTINCT node) AS supporting_node_count, count(*) AS total_neighbor_count FROM d GROUP BY 1, 2),
q AS (SELECT relation, count(*) AS f FROM kg_triples GROUP BY 1),
w AS (SELECT relation, direction, neighbor, row_number() OVER (PARTITION BY relation, direction ORDER BY neighbor) AS k FROM (SELECT DISTINCT relation, direction, neighbor FROM d)),
m AS (SELECT w.relation, w.direction, array_to_string(list_sort(list_distinct(list(coalesce(nullif(e.name, ''), w.neighbor)))), ', ') AS names FROM w LEFT JOIN kg_entities e ON e.mid = w.neighbor WHERE k <= 3 GROUP BY 1, 2)
"""


@query("kg_frontier_relations", f"WITH {_FRONTIER.strip()} SELECT c.relation, c.direction, supporting_node_count, total_neighbor_count, supporting_node_count / (SELECT count(*) FROM ({NATIONS}))::DOUBLE AS support_ratio, q.f AS global_frequency, m.names FROM c JOIN q ON c.relation = q.relation JOIN m ON m.relation = c.relation AND m.direction = c.direction")
def kg_frontier_relations(spark, sf):
    g = graph(spark, sf)
    d = ag.frontier_relations(mids(g, "nation"), g)
    return d.select("relation", "direction", "supporting_node_count", "total_neighbor_count", "support_ratio", "global_frequency", F.array_join("sample_target_names", ", ").alias("names"))


@query("kg_frontier_summary", f"""
WITH {_DEGREES}, f AS (SELECT t.tail AS region, t.head AS node FROM kg_triples t WHERE relation = 'geo.nation.region'),
x AS (SELECT f.*, e.name, s.in_degree + s.out_degree AS degree, row_number() OVER (PARTITION BY region ORDER BY node) AS k FROM f JOIN kg_entities e ON e.mid = f.node JOIN s ON s.mid = f.node)
SELECT region, count(*) AS node_count, 0 AS literal_count, 0.0::DOUBLE AS probable_cvt_ratio, array_to_string(list_sort(list_distinct(list(name) FILTER (k <= 5))), ', ') AS sample_names, CAST(min(degree) AS BIGINT) AS min_degree, CAST(max(degree) AS BIGINT) AS max_degree, round(avg(degree), 6) AS avg_degree FROM x GROUP BY region
""")  # fmt: skip
def kg_frontier_summary(spark, sf):
    g = graph(spark, sf)
    f = g.edges.where("relation = 'geo.nation.region'").select(F.col("tail").alias("region"), F.col("head").alias("node"))
    d = ag.frontier_summary(f, g, ["region"])
    return d.select("region", "node_count", F.col("literal_count").cast("int").alias("literal_count"), "probable_cvt_ratio", F.array_join("sample_names", ", ").alias("sample_names"), "min_degree", "max_degree", F.round("avg_degree", 6).alias("avg_degree"))


def _nation_sets(g: GraphStore) -> DataFrame:
    """Per region, the nations with suppliers and those with customers."""
    e = g.edges
    r = e.where("relation = 'geo.nation.region'").select(F.col("head").alias("entity"), F.col("tail").alias("qid"))
    s = e.where("relation = 'geo.supplier.nation'").select(F.lit(1).alias("set_id"), F.col("tail").alias("entity")).distinct()
    c = e.where("relation = 'crm.customer.nation'").select(F.lit(2).alias("set_id"), F.col("tail").alias("entity")).distinct()
    return r.join(s.union(c), "entity").select("qid", "set_id", "entity")


_SETS = "x AS (SELECT r.tail AS qid, s.set_id, r.head AS entity FROM kg_triples r JOIN (SELECT DISTINCT 1 AS set_id, tail AS entity FROM kg_triples WHERE relation = 'geo.supplier.nation' UNION ALL SELECT DISTINCT 2, tail FROM kg_triples WHERE relation = 'crm.customer.nation') s ON s.entity = r.head WHERE r.relation = 'geo.nation.region')"


@query("kg_count_union", f"WITH {_SETS} SELECT qid, count(DISTINCT entity) AS n FROM x GROUP BY qid")
def kg_count_union(spark, sf):
    return ag.count_union(_nation_sets(graph(spark, sf)))


@query("kg_set_intersect", f"WITH {_SETS}, t AS (SELECT qid, count(DISTINCT set_id) AS sets FROM x GROUP BY 1) SELECT x.qid, x.entity FROM x JOIN t ON x.qid = t.qid GROUP BY x.qid, x.entity, t.sets HAVING count(DISTINCT set_id) = t.sets")
def kg_set_intersect(spark, sf):
    return ag.intersect_sets(_nation_sets(graph(spark, sf)))


_RANK = "SELECT DISTINCT head AS node, tail AS value, CAST(tail AS DOUBLE) AS numeric_value FROM kg_triples WHERE relation = '{r}' ORDER BY CAST(tail AS DOUBLE) {o}, head {o}, tail LIMIT 10"


@query("kg_argmax_numeric", _RANK.format(r="sales.order.totalprice", o="DESC"))
def kg_argmax_numeric(spark, sf):
    g = graph(spark, sf)
    return ag.rank_numeric(mids(g, "order"), g.edges, ["sales.order.totalprice"]).select("node", "value", "numeric_value")


@query("kg_argmin_numeric", _RANK.format(r="crm.customer.acctbal", o="ASC"))
def kg_argmin_numeric(spark, sf):
    g = graph(spark, sf)
    return ag.rank_numeric(mids(g, "customer"), g.edges, ["crm.customer.acctbal"], False).select("node", "value", "numeric_value")


@query("kg_argmax_year", "SELECT DISTINCT head AS node, tail AS value, CAST(substr(tail, 1, 4) AS DOUBLE) AS numeric_value FROM kg_triples WHERE relation = 'sales.order.date' ORDER BY 3 DESC, 1 DESC, 2 LIMIT 10")
def kg_argmax_year(spark, sf):
    g = graph(spark, sf)
    return ag.rank_numeric(mids(g, "order"), g.edges, ["sales.order.date"]).select("node", "value", "numeric_value")


@query("kg_collect_entities", "SELECT DISTINCT tail AS source, relation, head AS target FROM kg_triples WHERE relation = 'crm.customer.nation'")
def kg_collect_entities(spark, sf):
    g = graph(spark, sf)
    return ag.collect_entities(mids(g, "nation"), g.edges, ["crm.customer.nation"], "reverse")


@query("kg_collect_literals", "SELECT DISTINCT head AS source, relation, tail AS value FROM kg_triples WHERE relation IN ('product.part.brand', 'product.part.size')")
def kg_collect_literals(spark, sf):
    g = graph(spark, sf)
    return ag.collect_literals(mids(g, "part"), g.edges, ["product.part.brand", "product.part.size"])


@query("kg_collect_constrained", f"""
WITH d AS (SELECT DISTINCT t.tail AS source, t.relation, t.head AS target, e.name, e.types FROM kg_triples t JOIN kg_entities e ON e.mid = t.head WHERE t.relation IN ('geo.nation.region', 'geo.supplier.nation'))
SELECT source, relation, target, name, CAST(CASE WHEN contains({_cat('types')}, 'country') OR contains({_cat('types')}, 'nation') OR contains({_cat('types')}, 'sovereign state') THEN 8.0 WHEN contains({_cat("name || ' ' || types || ' ' || relation")}, 'country') OR contains({_cat("name || ' ' || types || ' ' || relation")}, 'nation') THEN 4.0 ELSE 0.0 END + CASE WHEN contains({_cat("name || ' ' || types || ' ' || relation")}, '1') THEN 3.0 ELSE 0.0 END AS DOUBLE) AS score
FROM d ORDER BY 5 DESC, relation, target, source LIMIT 40
""")  # fmt: skip
def kg_collect_constrained(spark, sf):
    g = graph(spark, sf)
    return ag.collect_constrained(mids(g, "region").union(mids(g, "nation")), g, ["geo.nation.region", "geo.supplier.nation"], "country", ["1"], direction="reverse")


@query("kg_expand_topn_per_source", "WITH d AS (SELECT DISTINCT tail AS node, head AS neighbor FROM kg_triples WHERE relation = 'crm.customer.nation'), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY neighbor) AS rn, count(*) OVER (PARTITION BY node) AS source_total FROM d) SELECT node, neighbor, CAST(rn AS INTEGER) AS rn, source_total FROM r WHERE rn <= 3")
def kg_expand_topn_per_source(spark, sf):
    g = graph(spark, sf)
    return ag.top_per_source(mids(g, "nation"), g.edges, "crm.customer.nation", 3, reverse=True)


@query("kg_expand_budgeted", """
WITH f AS (SELECT tail AS qid, head AS node, row_number() OVER (PARTITION BY tail ORDER BY head) AS ord FROM kg_triples WHERE relation = 'geo.nation.region'),
d AS (SELECT f.qid, f.node, f.ord, t.head AS target, row_number() OVER (PARTITION BY f.qid, f.node, f.ord ORDER BY t.head) AS rn FROM f JOIN kg_triples t ON t.tail = f.node AND t.relation = 'geo.supplier.nation'),
a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid, target ORDER BY ord, rn) = 1 THEN 1 ELSE 0 END AS first FROM d WHERE rn <= 5),
b AS (SELECT *, sum(first) OVER (PARTITION BY qid ORDER BY ord, rn) AS seen, row_number() OVER (PARTITION BY qid ORDER BY ord, rn) AS pos FROM a)
SELECT qid, node AS source, target, CAST(pos AS INTEGER) AS pos, first = 1 AS is_new FROM b WHERE seen - first < 7
""")  # fmt: skip
def kg_expand_budgeted(spark, sf):
    from pyspark.sql import Window

    g = graph(spark, sf)
    f = g.edges.where("relation = 'geo.nation.region'").select(F.col("tail").alias("qid"), F.col("head").alias("node"))
    f = f.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("node")))
    return ag.expand_budgeted(f, g.edges, "geo.supplier.nation", 5, 7, ["qid"], reverse=True)


# --- traversal -------------------------------------------------------------------------------------------------------

_BOTH = "SELECT head AS node, relation, tail AS neighbor, false AS reversed FROM kg_triples WHERE tail_kind = 'id' UNION ALL SELECT tail, relation, head, true FROM kg_triples WHERE tail_kind = 'id'"


@query("kg_reach_k", f"""
WITH b AS ({_BOTH}), l0 AS (SELECT mid AS source, mid AS node FROM kg_entities WHERE mid LIKE 'm.region.%'),
l1 AS (SELECT DISTINCT l0.source, b.neighbor AS node FROM l0 JOIN b ON b.node = l0.node), l2 AS (SELECT DISTINCT l1.source, b.neighbor AS node FROM l1 JOIN b ON b.node = l1.node),
l3 AS (SELECT DISTINCT l2.source, b.neighbor AS node FROM l2 JOIN b ON b.node = l2.node)
SELECT source, node, CAST(min(d) AS INTEGER) AS dist FROM (SELECT *, 0 AS d FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) GROUP BY source, node
""")  # fmt: skip
def kg_reach_k(spark, sf):
    g = graph(spark, sf)
    return traverse.reach(mids(g, "region"), g.edges, 3)


def _regions_of_suppliers(g: GraphStore) -> DataFrame:
    """``supplier, nation, region``, joined along the edges."""
    s = g.edges.where("relation = 'geo.supplier.nation'").select(F.col("head").alias("supplier"), F.col("tail").alias("nation"))
    return s.join(g.edges.where("relation = 'geo.nation.region'").select(F.col("head").alias("nation"), F.col("tail").alias("region")), "nation")


@query("kg_shortest_path_len", f"""
WITH b AS (SELECT DISTINCT node, neighbor FROM ({_BOTH})), n AS (SELECT head AS nation, tail AS region FROM kg_triples WHERE relation = 'geo.nation.region'),
p AS (SELECT s.head AS source, m.nation AS target FROM kg_triples s JOIN n ON n.nation = s.tail JOIN n m ON m.region = n.region WHERE s.relation = 'geo.supplier.nation'),
l0 AS (SELECT DISTINCT source, source AS node FROM p), l1 AS (SELECT DISTINCT l.source, b.neighbor AS node FROM l0 l JOIN b ON b.node = l.node),
l2 AS (SELECT DISTINCT l.source, b.neighbor AS node FROM l1 l JOIN b ON b.node = l.node), l3 AS (SELECT DISTINCT l.source, b.neighbor AS node FROM l2 l JOIN b ON b.node = l.node),
d AS (SELECT *, 1 AS h FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3)
SELECT p.source, p.target, CAST(min(d.h) AS INTEGER) AS length FROM (SELECT DISTINCT source, target FROM p) p JOIN d ON d.source = p.source AND d.node = p.target GROUP BY 1, 2
""")  # fmt: skip
def kg_shortest_path_len(spark, sf):
    """Suppliers and the nations of their region: their own is one hop away, the others are three."""
    g = graph(spark, sf)
    n = g.edges.where("relation = 'geo.nation.region'").select(F.col("head").alias("target"), F.col("tail").alias("region"))
    s = _regions_of_suppliers(g).select(F.col("supplier").alias("source"), "region")
    return traverse.shortest_paths(s.join(n, "region"), g.edges, 3).select("source", "target", "length")


_PATHS = f"""
RECURSIVE_b AS (SELECT DISTINCT node, relation, neighbor, reversed FROM ({_BOTH})),
p1 AS (SELECT [s.mid, b.neighbor] AS nodes, [b.relation] AS rels, s.mid || ' -> ' || b.relation || CASE WHEN b.reversed THEN ' (reverse)' ELSE '' END || ' -> ' || b.neighbor AS text, b.neighbor AS terminal, 1 AS hops FROM (SELECT mid FROM kg_entities WHERE mid LIKE 'm.region.%') s JOIN RECURSIVE_b b ON b.node = s.mid),
p2 AS (SELECT list_append(p.nodes, b.neighbor) AS nodes, list_append(p.rels, b.relation) AS rels, p.text || ' -> ' || b.relation || CASE WHEN b.reversed THEN ' (reverse)' ELSE '' END || ' -> ' || b.neighbor AS text, b.neighbor AS terminal, 2 AS hops FROM p1 p JOIN RECURSIVE_b b ON b.node = p.terminal AND NOT list_contains(p.nodes, b.neighbor)),
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)
""".replace("RECURSIVE_b", "both_ways")


def _geo_paths(g: GraphStore) -> DataFrame:
    return traverse.simple_paths(mids(g, "region"), g.edges, 2)


@query("kg_simple_paths", f"WITH {_PATHS.strip()} SELECT text, terminal, CAST(hops AS INTEGER) AS hops FROM p")
def kg_simple_paths(spark, sf):
    return _geo_paths(graph(spark, sf)).select("text", "terminal", "hops")


@query("kg_source_target_paths", f"WITH {_PATHS.strip()} SELECT text, terminal, CAST(hops AS INTEGER) AS hops FROM p WHERE terminal LIKE 'm.supplier.%'")
def kg_source_target_paths(spark, sf):
    g = graph(spark, sf)
    return rank.source_target(mids(g, "region"), mids(g, "supplier"), g.edges, 2, 0).select("text", "terminal", "hops")


@query("kg_two_hop_extensions", f"WITH {_PATHS.strip()} SELECT text, CAST(hops AS INTEGER) AS hops FROM p")
def kg_two_hop_extensions(spark, sf):
    g = graph(spark, sf)
    return traverse.two_hop_extensions(mids(g, "region"), g.edges).select("text", "hops")


@query("kg_bfs_paths", f"""
WITH {_PATHS.strip()}, s AS (SELECT nodes[1] AS seed, row_number() OVER (ORDER BY nodes[1]) AS z FROM (SELECT DISTINCT [mid] AS nodes FROM kg_entities WHERE mid LIKE 'm.region.%')),
o1 AS (SELECT p.*, row_number() OVER (ORDER BY s.z, rels[1], terminal) AS seq FROM p JOIN s ON s.seed = nodes[1] WHERE hops = 1),
o2 AS (SELECT p.*, (SELECT count(*) FROM o1) + row_number() OVER (ORDER BY o1.seq, p.rels[2], p.terminal) AS seq FROM p JOIN o1 ON o1.nodes = p.nodes[1:2] WHERE p.hops = 2)
SELECT text, CAST(hops AS INTEGER) AS hops, seq FROM (SELECT text, hops, seq FROM o1 UNION ALL SELECT text, hops, seq FROM o2) WHERE seq <= 40
""")  # fmt: skip
def kg_bfs_paths(spark, sf):
    g = graph(spark, sf)
    return traverse.bfs_search(mids(g, "region"), g.edges, 2, 200, 40).select("text", "hops", "seq")


_EXPAND = """
k0 AS (SELECT mid AS node, row_number() OVER (ORDER BY mid) AS z FROM kg_entities WHERE mid LIKE 'm.region.%'),
o1 AS (SELECT p.*, row_number() OVER (ORDER BY k0.z, rels[1], terminal) AS seq FROM p JOIN k0 ON k0.node = nodes[1] WHERE hops = 1),
a1 AS (SELECT terminal AS node FROM (SELECT terminal, min(seq) AS f FROM o1 WHERE terminal NOT IN (SELECT node FROM k0) GROUP BY 1) ORDER BY f LIMIT 60 - (SELECT count(*) FROM k0)),
k1 AS (SELECT node FROM k0 UNION SELECT node FROM a1), q1 AS (SELECT *, row_number() OVER (ORDER BY seq) AS place FROM o1 WHERE terminal IN (SELECT node FROM k1)),
o2 AS (SELECT p.*, row_number() OVER (ORDER BY q1.place, p.rels[2], p.terminal) AS seq FROM p JOIN q1 ON q1.nodes = p.nodes[1:2] WHERE p.hops = 2),
a2 AS (SELECT terminal AS node FROM (SELECT terminal, min(seq) AS f FROM o2 WHERE terminal NOT IN (SELECT node FROM k1) GROUP BY 1) ORDER BY f LIMIT greatest(0, 60 - (SELECT count(*) FROM k1))),
q2 AS (SELECT *, (SELECT count(*) FROM q1) + row_number() OVER (ORDER BY seq) AS place FROM o2 WHERE terminal IN (SELECT node FROM k1 UNION SELECT node FROM a2))
"""


@query("kg_expand_paths", f"WITH {_PATHS.strip()}, {_EXPAND.strip()} SELECT text, CAST(hops AS INTEGER) AS hops, place AS seq FROM (SELECT text, hops, place FROM q1 UNION ALL SELECT text, hops, place FROM q2)")
def kg_expand_paths(spark, sf):
    """Paths of two hops around the regions until 60 entities are discovered."""
    g = graph(spark, sf)
    return traverse.expand_paths(mids(g, "region"), g.edges, 2, max_nodes=60).select("text", "hops", "seq")


@query("kg_induced_subgraph", "SELECT head, relation, tail FROM kg_triples WHERE tail_kind = 'id' AND (head LIKE 'm.nation.%' OR head LIKE 'm.supplier.%' OR head LIKE 'm.region.%') AND (tail LIKE 'm.nation.%' OR tail LIKE 'm.supplier.%' OR tail LIKE 'm.region.%')")
def kg_induced_subgraph(spark, sf):
    g = graph(spark, sf)
    return traverse.induced_subgraph(mids(g, "nation").union(mids(g, "supplier")).union(mids(g, "region")), g.edges)


# --- ranking ---------------------------------------------------------------------------------------------------------

_SCORED = f"""
{_PATHS.strip()}, {_DEGREES}, fq AS (SELECT relation, count(*) AS f FROM kg_triples GROUP BY 1),
sg AS (SELECT mid, sum(n) AS degree FROM (SELECT head AS mid, 1 AS n FROM kg_triples UNION ALL SELECT tail, 1 FROM kg_triples WHERE tail_kind = 'id') GROUP BY 1),
z AS (SELECT p.text, p.nodes, p.rels, p.terminal, p.hops, list_contains(rels, 'geo.supplier.nation') AS hit, contains(lower(p.terminal || ' id ' || replace(rels[-1], '.', ' ')), 'supplier') AS typ,
  round(CASE WHEN list_contains(rels, 'geo.supplier.nation') THEN 10.0 ELSE 0.0 END + CASE WHEN contains(lower(p.terminal || ' id ' || replace(rels[-1], '.', ' ')), 'supplier') THEN 6.0 ELSE 0.0 END
  + (SELECT sum(least(3.0, 1.0 / log10(fq.f + 10.0))) FROM unnest(p.rels) u(r) JOIN fq ON fq.relation = u.r) - 1.5 * p.hops + CASE WHEN coalesce(sg.degree, 0) >= 500 THEN -2.0 ELSE 0.0 END, 6) AS path_score
  FROM p LEFT JOIN sg ON sg.mid = p.terminal),
rk AS (SELECT *, row_number() OVER (ORDER BY path_score DESC, CASE WHEN hit THEN 0 ELSE 1 END, CASE WHEN typ THEN 1 ELSE 0 END DESC, hops, text) AS rank FROM z)
"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    g = graph(spark, sf)
    return rank.rerank(rank.score_paths(_geo_paths(g), g, ["geo.supplier.nation"], ["supplier"]))


@query("kg_path_score", f"WITH {_SCORED.strip()} SELECT text, path_score FROM z")
def kg_path_score(spark, sf):
    return _scored(spark, sf).select("text", "path_score")


@query("kg_path_rerank", f"WITH {_SCORED.strip()} SELECT text, CAST(rank AS INTEGER) AS rank FROM rk")
def kg_path_rerank(spark, sf):
    return _scored(spark, sf).select("text", "rank")


@query("kg_path_select_diverse", f"""
WITH {_SCORED.strip()}, d AS (SELECT *, row_number() OVER (PARTITION BY nodes[1:2] ORDER BY rank) AS k, count(*) OVER () AS n FROM rk),
o AS (SELECT text, row_number() OVER (ORDER BY CASE WHEN k > 1 AND n > 30 THEN 1 ELSE 0 END, rank) AS selected_rank FROM d)
SELECT text, CAST(selected_rank AS INTEGER) AS selected_rank FROM o WHERE selected_rank <= 30
""")  # fmt: skip
def kg_path_select_diverse(spark, sf):
    return rank.select_diverse(_scored(spark, sf), 30).select("text", "selected_rank")


@query("kg_branch_reduce", f"WITH {_SCORED.strip()}, k AS (SELECT *, row_number() OVER (PARTITION BY nodes[1:2] ORDER BY rank) AS f2, count(*) OVER () AS n FROM rk), o AS (SELECT text, row_number() OVER (ORDER BY rank) AS i FROM k WHERE f2 = 1 OR n <= 5) SELECT text FROM o WHERE i <= 5")
def kg_branch_reduce(spark, sf):
    d = _scored(spark, sf).withColumn("ord", F.col("rank"))
    return rank.branch_reduce(d, 5).select("text")


@query("kg_path_dedupe", f"WITH {_SCORED.strip()} SELECT text, CAST(rank AS INTEGER) AS ord FROM rk")
def kg_path_dedupe(spark, sf):
    d = _scored(spark, sf).select("qid", "text", "nodes", "terminal", F.col("rank").alias("ord"), F.transform("relations", lambda r, i: F.concat_ws(":", r, i.cast("string"))).alias("edge_ids"))
    d = d.withColumn("edge_ids", F.concat(F.array("text"), "edge_ids"))
    twice = d.unionByName(d.withColumns({"terminal": F.lit(""), "ord": F.col("ord") + 1_000_000}))
    return rank.dedupe(twice).select("text", "ord")


_ASKED = "which suppliers does a nation of this region have"
_VECTOR = """
{t}w AS (SELECT {k}, unnest(regexp_extract_all(lower({x}), '[a-z0-9]+')) AS w FROM {s}),
{t}f AS (SELECT {k}, unnest(list_prepend(w, [('^' || w || '$')[i:i + 2] FOR i IN range(1, len(w) + 1)])) AS f FROM {t}w),
{t}b AS (SELECT {k}, list_reduce(list_prepend(CAST(7 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(f, '')]), lambda h, c: (h * 31 + c) % 2147483647) % 256 AS b, count(*) AS n FROM {t}f GROUP BY ALL),
{t}v AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY {k})) AS x FROM {t}b)"""


@query("kg_fuzzy_prune", f"""
WITH {_PATHS.strip()}, o AS (SELECT *, list_contains(rels, 'geo.supplier.nation') AS hit, row_number() OVER (ORDER BY text) AS ord FROM p), asked AS (SELECT 0 AS q, '{_ASKED}' AS question),
{_VECTOR.format(t="d", k="ord", x="text", s="o").strip()}, {_VECTOR.format(t="q", k="q", x="question", s="asked").strip()},
sim AS (SELECT ord, sum(dv.x * qv.x) AS s FROM dv JOIN qv ON qv.b = dv.b GROUP BY ord)
SELECT text, similarity, CAST(fuzzy_rank AS INTEGER) AS fuzzy_rank FROM (SELECT text, round(coalesce(s, 0), 6) AS similarity, row_number() OVER (ORDER BY NOT hit, round(coalesce(s, 0), 6) DESC, o.ord) AS fuzzy_rank FROM o LEFT JOIN sim ON sim.ord = o.ord) WHERE fuzzy_rank <= 30
""")  # fmt: skip
def kg_fuzzy_prune(spark, sf):
    """The thirty paths around the regions that are closest to a question by hashed n-grams."""
    g = graph(spark, sf)
    p = places(rank.annotate_hints(_geo_paths(g), ["geo.supplier.nation"]), "text", name="ord").withColumn("ord", F.col("ord") + 1)
    q = spark.createDataFrame([(0, _ASKED)], "qid int, question string")
    return rank.fuzzy_prune(p, q, 30).select("text", "similarity", "fuzzy_rank")


@query("kg_hybrid_search", f"""
WITH {_SCORED.strip()}, d AS (SELECT *, row_number() OVER (PARTITION BY nodes[1:2] ORDER BY rank) AS k, count(*) OVER () AS n FROM rk),
o AS (SELECT text, hops, path_score, row_number() OVER (ORDER BY CASE WHEN k > 1 AND n > 50 THEN 1 ELSE 0 END, rank) AS selected_rank FROM d)
SELECT text, CAST(hops AS INTEGER) AS hops, path_score, CAST(selected_rank AS INTEGER) AS selected_rank FROM o WHERE selected_rank <= 50
""")  # fmt: skip
def kg_hybrid_search(spark, sf):
    g = graph(spark, sf)
    return rank.hybrid(mids(g, "region"), g, ["geo.supplier.nation"], ["supplier"]).select("text", "hops", "path_score", "selected_rank")


@query("kg_topic_paths", """
SELECT s.head AS qid, n.tail || ' -> geo.nation.region (reverse) -> ' || n.head || ' -> geo.supplier.nation (reverse) -> ' || s.head AS text, s.head AS terminal, CAST(2 AS INTEGER) AS hops
FROM kg_triples s JOIN kg_triples n ON n.head = s.tail WHERE s.relation = 'geo.supplier.nation' AND n.relation = 'geo.nation.region'
""")  # fmt: skip
def kg_topic_paths(spark, sf):
    """A question per supplier: its region, its nation, itself."""
    g = graph(spark, sf)
    t = _regions_of_suppliers(g).select(F.col("supplier").alias("qid"), F.posexplode(F.array("region", "nation", "supplier")).alias("ord", "node"))
    return traverse.ordered_topic_paths(t, g.edges, 1, 2).select("qid", "text", "terminal", "hops")


@query("kg_supplement_paths", f"""
WITH both_ways AS (SELECT DISTINCT node, relation, neighbor, reversed FROM ({_BOTH})), t AS (SELECT head AS qid, tail AS region FROM kg_triples WHERE relation = 'geo.nation.region')
SELECT t.qid, t.region || ' -> ' || a.relation || ' (reverse) -> ' || a.neighbor || ' -> ' || b.relation || ' (reverse) -> ' || b.neighbor AS text
FROM t JOIN both_ways a ON a.node = t.region AND a.neighbor = t.qid JOIN both_ways b ON b.node = a.neighbor AND b.neighbor LIKE 'm.supplier.%'
WHERE b.neighbor IN (SELECT min(head) FROM kg_triples WHERE relation = 'geo.supplier.nation' GROUP BY tail)
""")  # fmt: skip
def kg_supplement_paths(spark, sf):
    """A question per nation: from its region to its first supplier, with the nation as the linked bridge."""
    g = graph(spark, sf)
    d = _regions_of_suppliers(g).groupBy("nation", "region").agg(F.min("supplier").alias("supplier"))
    t = d.select(F.col("nation").alias("qid"), F.posexplode(F.array("region", "supplier")).alias("ord", "node"))
    return traverse.supplement_paths(t, d.select(F.col("nation").alias("qid"), F.col("nation").alias("node")), g.edges, 1).select("qid", "text")


# --- beam ------------------------------------------------------------------------------------------------------------


def _beam_seeds(g: GraphStore) -> DataFrame:
    r = named(g, "region")
    return r.select(F.regexp_extract("mid", r"(\d+)$", 1).cast("long").alias("qid"), F.lit("which supplier is in a nation of this region").alias("query"), F.col("mid").alias("node"))


@query("kg_beam_hop1", """
WITH f AS (SELECT mid AS node, CAST(regexp_extract(mid, '(\\d+)$', 1) AS BIGINT) AS qid FROM kg_entities WHERE mid LIKE 'm.region.%')
SELECT f.qid, t.relation, 'reverse' AS direction, CAST(1 AS INTEGER) AS candidate_rank, count(*) AS total_neighbor_count FROM f JOIN kg_triples t ON t.tail = f.node AND t.tail_kind = 'id' GROUP BY 1, 2
""")  # fmt: skip
def kg_beam_hop1(spark, sf):
    g = graph(spark, sf)
    s = _beam_seeds(g)
    step = "struct<relation:string,direction:string,role:string>"
    states = s.select("qid", "query").distinct().select("qid", "query", F.lit("").alias("state_id"), F.array().cast(f"array<{step}>").alias("path"), F.array().cast("array<string>").alias("path_names"), F.lit(None).cast("string").alias("last_relation"), F.lit(None).cast("string").alias("last_direction"))
    c = bm.candidates(states, s.select("qid", F.lit("").alias("state_id"), "node"), g, bm.BeamConfig(expected_type="supplier"))
    return c.select("qid", "relation", "direction", "candidate_rank", "total_neighbor_count")


@query("kg_beam_full")
def kg_beam_full(spark, sf):
    g = graph(spark, sf)
    s, f = bm.search(_beam_seeds(g), g, bm.BeamConfig(max_hops=2, expected_type="supplier"))
    return bm.answers(s, f).select("qid", "node", F.size("evidence").alias("hops"), "state_score")


_LI_WORDS = "['date', 'year', 'time', 'start', 'end', 'from', 'to', 'title', 'office', 'holder', 'spouse', 'nominee', 'winner', 'employee', 'employment', 'role', 'team', 'performance', 'jurisdiction', 'district', 'supplier', 'part', 'quantity']"


def _share_of(tok: str) -> str:
    return f"CASE WHEN len(list_intersect({tok}, {_LI_WORDS})) > 0 THEN 1.0 / len({tok}) ELSE 0.0 END"


@query("kg_cvt_bundle", f"""
WITH e AS (SELECT t.head AS node, t.relation, t.tail AS target, coalesce(nullif(k.name, ''), t.tail) AS target_name, t.relation = 'sales.lineitem.supplier' AS ans, contains(t.relation, 'date') AS dat FROM kg_triples t LEFT JOIN kg_entities k ON k.mid = t.tail WHERE t.relation LIKE 'sales.lineitem.%'),
z AS (SELECT *, round(CAST(12.0 * {_share_of(_tok(_cat('relation')))} + 4.0 * {_share_of(_tok(_cat('target_name')))} + CASE WHEN ans THEN 14.0 ELSE 0.0 END + CASE WHEN dat THEN 3.0 ELSE 0.0 END AS DOUBLE), 6) AS edge_score FROM e)
SELECT node, relation, target, target_name, CASE WHEN ans THEN 'answer' ELSE 'constraint' END AS role, edge_score, CAST(row_number() OVER (PARTITION BY node ORDER BY ans DESC, edge_score DESC, relation, target) AS INTEGER) AS edge_rank FROM z
""")  # fmt: skip
def kg_cvt_bundle(spark, sf):
    g = graph(spark, sf, whole=True)
    li = g.entities.where("is_cvt").select(F.col("mid").alias("node"))
    return bm.cvt_bundles(li, g, ["supplier", "part", "quantity"], "supplier")


@query("kg_expansion_rerank", f"""
WITH t AS (SELECT tail AS qid, head AS node, row_number() OVER (PARTITION BY tail ORDER BY head) AS pos FROM kg_triples WHERE relation = 'geo.nation.region'),
z AS (SELECT t.*, CAST(8.0 + CASE WHEN t.node IN (SELECT tail FROM kg_triples WHERE relation = 'geo.supplier.nation') THEN 6.0 ELSE 0.0 END + CASE WHEN contains({_cat("e.name || ' ' || e.types")}, '1') THEN 2.0 ELSE 0.0 END AS DOUBLE) AS rerank_score FROM t JOIN kg_entities e ON e.mid = t.node)
SELECT qid, node, CAST(pos AS INTEGER) AS pos, rerank_score, CAST(row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, pos) AS INTEGER) AS rerank_pos FROM z
""")  # fmt: skip
def kg_expansion_rerank(spark, sf):
    from pyspark.sql import Window

    g = graph(spark, sf)
    t = g.edges.where("relation = 'geo.nation.region'").select(F.col("tail").alias("qid"), F.col("head").alias("node"))
    t = t.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("node")))
    return resolve.rerank_expansion(t, g, ["country"], ["geo.supplier.nation"], ["1"], [], ["qid"])


_BALANCE = "CAST(b.tail AS DOUBLE)"


@query("kg_question_loop", f"""
WITH nation AS (SELECT mid, name FROM kg_entities WHERE mid LIKE 'm.nation.%'), region AS (SELECT mid, name FROM kg_entities WHERE mid LIKE 'm.region.%'),
s AS (SELECT t.tail AS nation, e.name, row_number() OVER (PARTITION BY t.tail ORDER BY {_BALANCE} DESC, t.head DESC) AS n FROM kg_triples t JOIN kg_triples b ON b.head = t.head AND b.relation = 'org.supplier.acctbal' JOIN kg_entities e ON e.mid = t.head WHERE t.relation = 'geo.supplier.nation'),
c AS (SELECT DISTINCT t.tail AS nation, t.head, e.name FROM kg_triples t JOIN kg_entities e ON e.mid = t.head WHERE t.relation = 'crm.customer.nation'),
f AS (SELECT nation, name, row_number() OVER (PARTITION BY nation ORDER BY name, head) AS n FROM c),
b AS (SELECT r.tail AS region, count(DISTINCT c.head) AS n FROM kg_triples r JOIN c ON c.nation = r.head WHERE r.relation = 'geo.nation.region' GROUP BY 1)
SELECT 'best ' || n.mid AS qid, s.name AS predicted, true AS sufficient, CAST(2 AS BIGINT) AS attempts FROM nation n JOIN s ON s.nation = n.mid AND s.n = 1
UNION ALL SELECT 'best ' || n.mid, '', false, 3 FROM nation n WHERE n.mid NOT IN (SELECT nation FROM s)
UNION ALL SELECT 'count ' || r.mid, CAST(b.n AS VARCHAR), true, 2 FROM region r JOIN b ON b.region = r.mid
UNION ALL SELECT 'retry ' || n.mid, string_agg(f.name, '|' ORDER BY f.n), true, 2 FROM nation n JOIN f ON f.nation = n.mid AND f.n <= 10 GROUP BY n.mid
UNION ALL SELECT 'fail ' || n.mid, '', false, 3 FROM nation n
""")  # fmt: skip
def kg_question_loop(spark, sf):
    """Four kinds of questions in one batch, each with hints of its own: the nation's supplier with the largest balance and
    the number of a region's customers (each in two steps), a nation's customers (by a hint that is wrong at first), and
    something that no nation has."""
    g = graph(spark, sf)
    spec = "sub_id string, ord int, question string, depends_on array<string>, topic boolean, selected array<string>, relations array<string>, expected_type string, solver_type string, hops int"
    kinds = {
        "best": [("a", 0, "its suppliers", [], True, ["geo.supplier.nation"], [], "supplier", "explore", 1), ("b", 1, "the largest balance", ["a"], False, ["org.supplier.acctbal"], [], "", "aggregate", 1)],
        "count": [("a", 0, "its nations", [], True, ["geo.nation.region"], [], "country", "explore", 1), ("b", 1, "how many customers", ["a"], False, ["crm.customer.nation"], [], "customer", "aggregate", 1)],
        "retry": [("a", 0, "its customers", [], True, ["geo.nation.region"], ["crm.customer.nation"], "customer", "explore", 1)],
        "fail": [("a", 0, "its planets", [], True, ["no.such.relation"], [], "planet", "explore", 1)],
    }
    specs = None
    for kind, subs in kinds.items():
        seeds = named(g, "region" if kind == "count" else "nation").select(F.concat(F.lit(f"{kind} "), "mid").alias("qid"), "name")
        d = seeds.crossJoin(F.broadcast(spark.createDataFrame(subs, spec))).withColumn("topics", F.when(F.col("topic"), F.array("name")).otherwise(F.array().cast("array<string>"))).drop("topic", "name")
        specs = d if specs is None else specs.unionByName(d)
    specs = written(specs)
    q = specs.groupBy("qid").agg(F.min_by("question", "ord").alias("question"))
    got, _ = loop.run(q, specs, g, per_node=0, max_paths=0, max_answers=0)
    return got.select("qid", F.array_join("predicted", "|").alias("predicted"), "sufficient", "attempts")


@query("kg_entity_rerank")
def kg_entity_rerank(spark, sf):
    g = graph(spark, sf)
    m = named(g, "nation").select(F.col("name").alias("mention"))
    return resolve.rerank_entities(lookup.resolve_entities(m, g).select("mention", "mid", "score"), g, "country", "nation with suppliers")


@query("kg_constrained_solver", f"""
WITH d AS (SELECT DISTINCT t.head AS source, t.relation, t.tail AS target, e.name, e.types FROM kg_triples t JOIN kg_entities e ON e.mid = t.tail WHERE t.relation = 'geo.nation.region' AND t.head LIKE 'm.nation.%')
SELECT source, relation, target, name, CAST(CASE WHEN contains({_cat('types')}, 'region') THEN 8.0 WHEN contains({_cat("name || ' ' || types || ' ' || relation")}, 'region') THEN 4.0 ELSE 0.0 END + CASE WHEN contains({_cat("name || ' ' || types || ' ' || relation")}, '1') THEN 3.0 ELSE 0.0 END AS DOUBLE) AS score
FROM d ORDER BY 5 DESC, relation, target, source LIMIT 30
""")  # fmt: skip
def kg_constrained_solver(spark, sf):
    g = graph(spark, sf)
    return solve.constrained(mids(g, "nation"), g, ["geo.nation.region"], "region", ["1"], 5)


@query("kg_node_expansion", f"WITH {_PATHS.strip()} SELECT nodes[1] AS seed, terminal, CAST(2 AS INTEGER) AS hops FROM p WHERE hops = 2")
def kg_node_expansion(spark, sf):
    g = graph(spark, sf)
    p = traverse.simple_paths(mids(g, "region"), g.edges, 1)
    return traverse.expand_endpoints(p, g.edges, 1).select("seed", "terminal", "hops")


# --- questions -------------------------------------------------------------------------------------------------------


@query("kg_relation_index", f"""
WITH l AS (SELECT DISTINCT relation, {_cat('relation')} AS norm FROM kg_triples)
SELECT h.relation AS hint, l.relation, 'relation_name_exact' AS match_type, 95.0::DOUBLE AS score, CAST(1 AS INTEGER) AS rank FROM l JOIN l h ON h.norm = l.norm
""")  # fmt: skip
def kg_relation_index(spark, sf):
    g = graph(spark, sf)
    return lookup.resolve_relations_index(g.relations.select(F.col("relation").alias("hint")), g)


@query("kg_question_subgraph", f"""
WITH b AS MATERIALIZED (SELECT DISTINCT node, neighbor FROM ({_BOTH})), q AS (SELECT mid FROM kg_entities WHERE mid LIKE 'm.region.%'),
one AS MATERIALIZED (SELECT DISTINCT q.mid AS qid, b.neighbor AS node FROM q JOIN b ON b.node = q.mid), two AS MATERIALIZED (SELECT DISTINCT one.qid, b.neighbor AS node FROM one JOIN b ON b.node = one.node),
n AS MATERIALIZED (SELECT mid AS qid, mid AS node FROM q UNION SELECT * FROM one UNION SELECT * FROM two),
h AS MATERIALIZED (SELECT n.qid, t.head, t.relation, t.tail FROM kg_triples t JOIN n ON n.node = t.head WHERE t.tail_kind = 'id')
SELECT qid, head, relation, tail FROM h WHERE EXISTS (SELECT 1 FROM n WHERE n.qid = h.qid AND n.node = h.tail)
""")  # fmt: skip
def kg_question_subgraph(spark, sf):
    """A question per region: everything within two hops."""
    g = graph(spark, sf)
    return traverse.question_subgraph(mids(g, "region").select(F.col("node").alias("qid"), "node"), g.edges, 2)


@query("kg_type_filter", f"SELECT DISTINCT tail AS target FROM kg_triples t JOIN kg_entities e ON e.mid = t.tail WHERE t.tail_kind = 'id' AND (contains({_cat('e.types')}, 'country') OR contains({_cat('e.types')}, 'nation') OR contains({_cat('e.types')}, 'sovereign state'))")
def kg_type_filter(spark, sf):
    g = graph(spark, sf)
    return solve.type_filter(g.edges.where("tail_kind = 'id'").select(F.col("tail").alias("target")).distinct(), g, "country")


@query("kg_count_typed", "SELECT CAST(count(DISTINCT head) AS VARCHAR) AS value FROM kg_triples WHERE relation = 'crm.customer.nation'")
def kg_count_typed(spark, sf):
    g = graph(spark, sf)
    return solve.aggregate("count", mids(g, "nation"), g, ["crm.customer.nation", "geo.supplier.nation"], direction="reverse", expected_type="customer")


@query("kg_prune_status", f"""
WITH {_SCORED.strip()}, f AS (SELECT text, row_number() OVER (ORDER BY CASE WHEN hit THEN 0 ELSE 1 END, path_score DESC, rank) AS fuzzy_rank FROM rk)
SELECT text, CAST(fuzzy_rank AS INTEGER) AS fuzzy_rank, CASE WHEN fuzzy_rank > 30 THEN 'fuzzy_pruned' WHEN fuzzy_rank > 5 THEN 'precise_pruned' ELSE 'preserved' END AS pruning_status FROM f
""")  # fmt: skip
def kg_prune_status(spark, sf):
    return rank.prune(_scored(spark, sf).withColumn("ord", F.col("rank")), F.col("path_score"), 30, 5).select("text", "fuzzy_rank", "pruning_status")


@query("kg_best_attribute", """
WITH v AS (SELECT t.tail AS qid, a.head AS name, CAST(a.tail AS DOUBLE) AS v FROM kg_triples t JOIN kg_triples a ON a.head = t.head AND a.relation = 'org.supplier.acctbal' WHERE t.relation = 'geo.supplier.nation'),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY v DESC, name) AS n FROM v) SELECT qid, name, v FROM r WHERE n = 1
""")  # fmt: skip
def kg_best_attribute(spark, sf):
    """Per nation, the supplier with the largest balance."""
    from pyspark.sql import Window

    g = graph(spark, sf)
    s = g.edges.where("relation = 'geo.supplier.nation'").select(F.col("tail").alias("qid"), F.col("head").alias("name"))
    v = g.edges.where("relation = 'org.supplier.acctbal'").select(F.col("head").alias("name"), F.col("tail").cast("double").alias("v"))
    rows = s.join(v, "name").withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("name")))
    return ag.best_rows(rows, "v", "ord", keys=["qid"]).select("qid", "name", "v")


# --- building the graph ----------------------------------------------------------------------------------------------


def _cvts(g: GraphStore) -> DataFrame:
    return written(etl.mediators(g.edges, g.entities))


@query("etl_cvt_detect", "SELECT mid, CAST(2 + 1 + 1 + 1 + 1 + 0 + 2 AS INTEGER) AS score FROM kg_entities WHERE is_cvt = 1")
def etl_cvt_detect(spark, sf):
    """Line items: typed, not ordinary, several edges out, literals, a ``g.`` id; both sides in the domain of sales."""
    return _cvts(graph(spark, sf, whole=True)).select("mid", "score")


_FLAT = "flat AS (SELECT DISTINCT i.head, i.relation || '.' || o.relation AS relation, o.tail, o.tail_kind FROM kg_triples i JOIN kg_triples o ON i.tail = o.head WHERE i.relation = 'sales.order.lineitem' AND NOT (o.tail_kind = 'id' AND i.head = o.tail))"


@query("etl_cvt_flatten", f"WITH {_FLAT} SELECT * FROM flat")
def etl_cvt_flatten(spark, sf):
    g = graph(spark, sf, whole=True)
    return etl.flattened(g.edges, _cvts(g)).distinct()


@query("etl_triplet_distinct", f"WITH {_FLAT} SELECT * FROM flat UNION SELECT DISTINCT head, relation, tail, tail_kind FROM kg_triples WHERE head NOT LIKE 'g.%' AND NOT (tail_kind = 'id' AND tail LIKE 'g.%')")
def etl_triplet_distinct(spark, sf):
    g = graph(spark, sf, whole=True)
    return etl.triplets(g.edges, _cvts(g))[0].select("head", "relation", "tail", "tail_kind")


@query("etl_labels", "SELECT t.head, coalesce(h.name, '') AS head_name, t.relation, t.tail, coalesce(e.name, '') AS tail_name, t.tail_kind FROM kg_triples t LEFT JOIN kg_entities h ON h.mid = t.head LEFT JOIN kg_entities e ON e.mid = t.tail AND t.tail_kind = 'id'")
def etl_labels(spark, sf):
    g = graph(spark, sf, whole=True)
    return etl.with_labels(g.edges, g.entities)


@query("etl_entities", f"WITH {_FLAT}, m AS (SELECT * FROM flat UNION SELECT DISTINCT head, relation, tail, tail_kind FROM kg_triples WHERE head NOT LIKE 'g.%' AND NOT (tail_kind = 'id' AND tail LIKE 'g.%')), i AS (SELECT head AS mid FROM m UNION SELECT tail FROM m WHERE tail_kind = 'id') SELECT i.mid, coalesce(e.name, '') AS name, coalesce(e.types, '') AS types FROM i LEFT JOIN kg_entities e ON e.mid = i.mid")
def etl_entities(spark, sf):
    g = graph(spark, sf, whole=True)
    c = _cvts(g)
    return etl.described_ids(etl.main_ids(g.edges, c), g.entities.drop("is_cvt"), c).select("mid", "name", F.array_join("types", "|").alias("types"))


# --- text, vectors, JSON ---------------------------------------------------------------------------------------------


@query("txt_normalize_ws", r"SELECT doc_id, md5(trim(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'))) AS digest FROM documents", graph=False)
def txt_normalize_ws(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(tx.norm_ws(F.col("text"))).alias("digest"))


@query("txt_normalize_catalog", f"SELECT doc_id, md5({_cat('text')}) AS digest FROM documents", graph=False)
def txt_normalize_catalog(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(tx.norm_catalog(F.col("text"))).alias("digest"))


@query("txt_normalize_beam", r"SELECT doc_id, md5(trim(regexp_replace(lower(trim(coalesce(text, ''))), '[\s._/\-()|,:]+', ' ', 'g'))) AS digest FROM documents", graph=False)
def txt_normalize_beam(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(tx.norm_beam(F.col("text"))).alias("digest"))


@query("txt_token_overlap", f"WITH x AS (SELECT a.conv_id, a.turn, {_tok(_cat('a.text'))} AS a, {_tok(_cat('b.text'))} AS c FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round({_jac('a', 'c')}, 9) AS jaccard, round(coalesce(len(list_intersect(a, c)) / nullif(len(a), 0)::DOUBLE, 0.0), 9) AS left_share FROM x", graph=False)
def txt_token_overlap(spark, sf):
    """Each turn of a conversation with the next one."""
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    d = t.select("conv_id", "turn", "text").join(nxt, ["conv_id", "turn"])
    d = d.select("conv_id", "turn", tx.tokens(tx.norm_catalog(F.col("text"))).alias("a"), tx.tokens(tx.norm_catalog(F.col("t"))).alias("c"))
    left = F.when(F.size("a") > 0, F.size(F.array_intersect("a", "c")) / F.size("a")).otherwise(0.0)
    return d.select("conv_id", "turn", F.round(tx.jaccard(F.col("a"), F.col("c")), 9).alias("jaccard"), F.round(left, 9).alias("left_share"))


@query("txt_verbalize", "SELECT relation, CASE WHEN len(string_split(relation, '.')) > 2 THEN " + _cat("string_split(relation, '.')[-1]") + " ELSE relation END AS display FROM (SELECT DISTINCT relation FROM kg_triples)")
def txt_verbalize(spark, sf):
    return graph(spark, sf).relations.select("relation", "display")


@query("txt_numeric_parse", r"SELECT head, relation, CASE WHEN regexp_full_match(tail, '[-+]?[0-9]+(\.[0-9]+)?') THEN CAST(tail AS DOUBLE) ELSE TRY_CAST(nullif(regexp_extract(tail, '[-+]?[0-9]+(\.[0-9]+)?'), '') AS DOUBLE) END AS number FROM kg_triples WHERE tail_kind = 'literal'")
def txt_numeric_parse(spark, sf):
    e = graph(spark, sf).edges.where("tail_kind = 'literal'")
    return e.select("head", "relation", tx.number_or_year(F.col("tail")).alias("number"))


@query("vec_cosine_topk", "WITH s AS (SELECT q.vec_id AS mention, c.vec_id AS item, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY round(sim, 9) DESC, item) AS rank FROM s) SELECT mention, item, round(sim, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3", graph=False)
def vec_cosine_topk(spark, sf):
    """Rows whose id is divisible by 20 are the queries, against all rows."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("mention"), F.col("embedding").alias("vector"))
    d = e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    return lookup.link_by_embedding(q, d, 3).select("mention", "item", F.round("score", 6).alias("score"), "rank")


@query("json_tolerant_parse", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", graph=False)
def json_tolerant_parse(spark, sf):
    d = spark.read.parquet(f"{sf}/events.parquet")
    return d.select("event_id", tx.tolerant_json(F.col("props"), "k long")["k"].alias("k"))


@query("txt_crc_bucket")
def txt_crc_bucket(spark, sf):
    e = graph(spark, sf).edges
    return e.groupBy(tx.crc_bucket([F.col("head"), F.col("relation"), F.col("tail")], 128).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# --- evaluation ------------------------------------------------------------------------------------------------------


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Per region, its nations as gold; predicted are those with even keys, and one of another region."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    g = n.groupBy(F.col("n_regionkey").alias("qid")).agg(F.array_sort(F.collect_list("n_name")).alias("gold"), F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))).alias("some"))
    return g.select("qid", "gold", F.concat("some", F.array(F.lit("Elsewhere"), F.lit("insufficient"))).alias("predicted"))


_EVAL = """
WITH a AS (SELECT n_regionkey AS qid, list(lower(n_name)) AS gold, coalesce(list(lower(n_name) ORDER BY n_name) FILTER (n_nationkey % 2 = 0), []) AS part FROM nation GROUP BY 1),
b AS (SELECT qid, gold, list_append(part, 'elsewhere') AS p FROM a),
c AS (SELECT qid, len(list_intersect(p, gold)) AS hits, len(p) AS np, len(gold) AS ng, list_contains(gold, p[1]) AS h FROM b),
s AS (SELECT qid, CAST(hits = np AND hits = ng AS INTEGER)::DOUBLE AS exact_match, CAST(h AS INTEGER)::DOUBLE AS hit_at_1, hits / np::DOUBLE AS precision, hits / ng::DOUBLE AS recall FROM c),
e AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM s)
"""


@query("eval_score_prediction", _EVAL + "SELECT qid, exact_match, hit_at_1, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM e", graph=False)
def eval_score_prediction(spark, sf):
    d = evaluate.score_prediction(_predictions(spark, sf))
    return d.select("qid", "exact_match", "hit_at_1", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("eval_aggregate", _EVAL + "SELECT count(*) AS samples, avg(exact_match) AS exact_match, avg(hit_at_1) AS hit_at_1, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM e", graph=False)
def eval_aggregate(spark, sf):
    d = evaluate.average_metrics(evaluate.score_prediction(_predictions(spark, sf)))
    return d.select("samples", "exact_match", "hit_at_1", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("eval_coverage", _EVAL + "SELECT c.qid, CAST(ng AS INTEGER) AS gold_count, CAST(ng AS INTEGER) AS graph_hits, CAST(hits AS INTEGER) AS path_hits, hits = ng AS full_hit, hits = 0 AS zero_hit FROM c", graph=False)
def eval_coverage(spark, sf):
    d = evaluate.coverage(_predictions(spark, sf), "gold", "gold", "predicted")
    return d.select("qid", "gold_count", "graph_hits", "path_hits", "full_hit", "zero_hit")


@query("eval_buckets", _EVAL + "SELECT CASE WHEN exact_match >= 1 THEN 'correct' WHEN recall > 0 THEN 'partial' ELSE 'wrong' END AS bucket, count(*) AS n FROM e GROUP BY 1", graph=False)
def eval_buckets(spark, sf):
    d = evaluate.score_prediction(_predictions(spark, sf))
    return d.groupBy(evaluate.bucket(F.col("exact_match"), F.col("recall")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

"""The entity/triple view of a star schema (regions, nations, customers, suppliers, parts, orders, line items).

One SQL text per table serves Spark and any SQL engine with the same tables: ``{name}`` stands for a table.
A line item is a mediator: an unnamed record between an order, a part and a supplier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import declared

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_LI = "'g.li.' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey"
_MONEY = "CAST(CAST({0} AS DECIMAL(18,2)) AS STRING)"
_DAY = "CAST(CAST({0} AS DATE) AS STRING)"

ENTITIES_SQL = f"""
SELECT 'm.region.' || r_regionkey AS mid, r_name AS name, 'geo.region' AS types, 0 AS is_cvt FROM {{region}}
UNION ALL SELECT 'm.nation.' || n_nationkey, n_name, 'geo.nation|location.country', 0 FROM {{nation}}
UNION ALL SELECT 'm.customer.' || c_custkey, c_name, 'crm.customer|people.person', 0 FROM {{customer}}
UNION ALL SELECT 'm.supplier.' || s_suppkey, s_name, 'org.supplier', 0 FROM {{supplier}}
UNION ALL SELECT 'm.part.' || p_partkey, p_name, 'product.part', 0 FROM {{part}}
UNION ALL SELECT 'm.order.' || o_orderkey, 'Order#' || o_orderkey, 'sales.order', 0 FROM {{orders}}
UNION ALL SELECT {_LI}, '', 'sales.lineitem', 1 FROM {{lineitem}}
"""

#: The kind of the ids of each type, as ENTITIES_SQL makes them; _EDGES tells those of the edges' ends.
_KINDS = {
    "geo.region": "m.region", "geo.nation|location.country": "m.nation", "crm.customer|people.person": "m.customer", "org.supplier": "m.supplier",
    "product.part": "m.part", "sales.order": "m.order", "sales.lineitem": "g.li",
}

_EDGES = [
    ("'m.nation.' || n_nationkey", "geo.nation.region", "'m.region.' || n_regionkey", "id", "nation"),
    ("'m.customer.' || c_custkey", "crm.customer.nation", "'m.nation.' || c_nationkey", "id", "customer"),
    ("'m.customer.' || c_custkey", "crm.customer.segment", "c_mktsegment", "literal", "customer"),
    ("'m.customer.' || c_custkey", "crm.customer.acctbal", _MONEY.format("c_acctbal"), "literal", "customer"),
    ("'m.supplier.' || s_suppkey", "geo.supplier.nation", "'m.nation.' || s_nationkey", "id", "supplier"),
    ("'m.supplier.' || s_suppkey", "org.supplier.acctbal", _MONEY.format("s_acctbal"), "literal", "supplier"),
    ("'m.part.' || p_partkey", "product.part.brand", "p_brand", "literal", "part"),
    ("'m.part.' || p_partkey", "product.part.type", "p_type", "literal", "part"),
    ("'m.part.' || p_partkey", "product.part.size", "CAST(p_size AS STRING)", "literal", "part"),
    ("'m.part.' || p_partkey", "product.part.retailprice", _MONEY.format("p_retailprice"), "literal", "part"),
    ("'m.order.' || o_orderkey", "sales.order.customer", "'m.customer.' || o_custkey", "id", "orders"),
    ("'m.order.' || o_orderkey", "sales.order.status", "o_orderstatus", "literal", "orders"),
    ("'m.order.' || o_orderkey", "sales.order.priority", "o_orderpriority", "literal", "orders"),
    ("'m.order.' || o_orderkey", "sales.order.date", _DAY.format("o_orderdate"), "literal", "orders"),
    ("'m.order.' || o_orderkey", "sales.order.totalprice", _MONEY.format("o_totalprice"), "literal", "orders"),
    ("'m.order.' || l_orderkey", "sales.order.lineitem", _LI, "id", "lineitem"),
    (_LI, "sales.lineitem.part", "'m.part.' || l_partkey", "id", "lineitem"),
    (_LI, "sales.lineitem.supplier", "'m.supplier.' || l_suppkey", "id", "lineitem"),
    (_LI, "sales.lineitem.quantity", _MONEY.format("l_quantity"), "literal", "lineitem"),
    (_LI, "sales.lineitem.shipdate", _DAY.format("l_shipdate"), "literal", "lineitem"),
    (_LI, "sales.lineitem.returnflag", "l_returnflag", "literal", "lineitem"),
]
TRIPLES_SQL = "\nUNION ALL ".join(f"SELECT {h} AS head, '{r}' AS relation, {t} AS tail, '{k}' AS tail_kind FROM {{{src}}}" for h, r, t, k, src in _EDGES)

#: Common table expressions for other engines over tables of the same names.
SQL_PREFIX = f"WITH kg_entities AS ({ENTITIES_SQL}), kg_triples AS ({TRIPLES_SQL})".format(**{t: t for t in TABLES})


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mid, name, types (array), is_cvt (boolean)``."""
    d = spark.sql(ENTITIES_SQL, **tables(spark, sf_dir))
    return d.select(declared("mid", _KINDS), "name", F.split("types", r"\|").alias("types"), (F.col("is_cvt") == 1).alias("is_cvt"))


def triples(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """``head, relation, tail, tail_kind``; a filter on the relation prunes the other tables' scans.

    ``whole``: for work on all edges, each table is read once and a row gives its edges one after the other, so that the
    edges of a record stay together and partial sums and compression see them so.
    """
    kind = lambda x: x.split("'")[1].rstrip(".")  # noqa: E731  of 'm.nation.' || n_nationkey
    head = declared("head", {r: kind(h) for h, r, _, _, _ in _EDGES})
    tail = declared("tail", {r: kind(t) for _, r, t, k, _ in _EDGES if k == "id"})
    if not whole:
        return spark.sql(TRIPLES_SQL, **tables(spark, sf_dir)).select(head, "relation", tail, "tail_kind")
    found = tables(spark, sf_dir)

    def rows(src: str) -> DataFrame:
        mine = [x for x in _EDGES if x[4] == src]
        one = ", ".join(f"named_struct('head', {h}, 'relation', '{r}', 'tail', {t}, 'tail_kind', '{k}')" for h, r, t, k, _ in mine)
        return found[src].selectExpr(f"inline(array({one}))")

    return reduce(DataFrame.unionAll, [rows(src) for src in dict.fromkeys(x[4] for x in _EDGES)]).select(head, "relation", tail, "tail_kind")

"""The graph store: triples and entities, and the statistics and lookups derived from them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import norm_catalog, verbalize_relation

HIGH_DEGREE = 500


def fits(df: DataFrame, most: int = 64 << 20) -> bool:
    """Whether a table takes less than ``most`` bytes in memory.

    The planner's estimate goes by compressed files, of which one byte can be ten of rows or more. So what it takes for small,
    but not for a 64th of ``most``, is measured before it goes through the driver: its rows and the bytes of their values.
    """
    try:
        estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except ValueError:  # an estimate of thousands of digits, from joins of joins
        return False
    return estimate <= most and (estimate <= most >> 6 or _bytes(df) <= most)


def _bytes(df: DataFrame) -> int:
    """About the bytes of a table's rows in memory: 16 a row, 8 a column, and the values of other than fixed length."""
    long = [F.octet_length(F.col(f"`{c}`").cast("string")) for c, t in df.dtypes if t in ("string", "binary") or "<" in t]
    more = sum((F.coalesce(x, F.lit(0)) for x in long), F.lit(16 + 8 * len(df.columns)))
    return df.agg(F.sum(more.cast("long"))).first()[0] or 0


def small(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """Marks a side for broadcast only if it ``fits``."""
    return F.broadcast(df) if fits(df, most) else df


# --- kinds of ids: what a source may declare about its id columns, so that a lookup scans only what can have its nodes ---


def declared(column: str, kinds: dict[str, str]) -> Column:
    """An id column that says of which kind (its first two parts, as in ``m.film.12``) its ids are, by the rows' relation
    (edges) or types (entities, joined by ``|``). Relations and types that are not named may have any ids.

    It is metadata of the column: selections keep it, an expression over the ids loses it.
    """
    return F.col(column).alias(column, metadata={"kinds": kinds})


def _declared(df: DataFrame, *columns: str) -> dict[str, str]:
    return {k: v for c in columns for k, v in df.schema[c].metadata.get("kinds", {}).items()}


def kinds_among(nodes: DataFrame, df: DataFrame, *columns: str) -> set[str] | None:
    """The declared kinds (of ``df``'s id columns) that occur among ``nodes`` (``node``); None if nothing is declared."""
    known = sorted({k for c in columns for k in _declared(df, c).values()})
    if not known:
        return None
    kind = F.substring_index("node", ".", 2).alias("kind")
    return {r.kind for r in nodes.select(kind).where(F.col("kind").isin(known)).distinct().collect()}  # no more than are declared


def of_kinds(df: DataFrame, column: str, by: Column, kinds: set[str] | None) -> DataFrame:
    """Without the rows whose ids in ``column`` are declared to be of other kinds: a filter on constants, so that the planner
    drops whole tables."""
    other = sorted(v for v, k in _declared(df, column).items() if kinds is not None and k not in kinds)
    return df.where(F.coalesce(~by.isin(other), F.lit(True))) if other else df


def entities_of(entities: DataFrame, kinds: set[str] | None) -> DataFrame:
    """The entities that may be of these kinds (None: all)."""
    return of_kinds(entities, "mid", F.array_join("types", "|"), kinds)


def around(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges whose head, and those whose tail may be among ``nodes`` (``node``)."""
    kinds = kinds_among(nodes, edges, "head", "tail")
    return tuple(of_kinds(edges, end, F.col("relation"), kinds) for end in ("head", "tail"))


def node_table(nodes: DataFrame, df: DataFrame, *columns: str) -> DataFrame:
    """The different nodes (``node``), written if ``df`` declares kinds, since they are then read for their kinds, too."""
    n = nodes.select("node").distinct()
    return written(n) if _declared(df, *columns) else n


_WRITTEN: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where Spark is this machine alone."""
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not got:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
        got = sc._jsc.sc().getCheckpointDir().get()
    return got


def written(df: DataFrame) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it again: work is done once, lineage ends, and the planner knows
    the size of what is joined next. The files are deleted when Python ends, or by ``forget``."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/weftgraph-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def forget() -> None:
    """Deletes what ``written`` has written; nothing unfinished may read it."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  Spark has ended before Python
            return


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Adds ``edge_id``: a hash of the edge and of its number among equal edges, the same whenever it is computed."""
    cols = ["head", "relation", "tail", "tail_kind"]
    n = F.row_number().over(Window.partitionBy(*cols).orderBy(F.lit(0)))
    return edges.withColumn("__n", n).withColumn("edge_id", F.xxhash64(*cols, "__n")).drop("__n")


def edges_of(triples: DataFrame) -> DataFrame:
    """Triples with a kind: a missing one is ``id``."""
    kind = F.lower(F.trim(F.col("tail_kind"))) if "tail_kind" in triples.columns else F.lit("id")
    return triples.select("head", "relation", "tail", F.coalesce(F.nullif(kind, F.lit("")), F.lit("id")).alias("tail_kind"))


def node_stats(edges: DataFrame, entities: DataFrame | None = None, threshold: int = HIGH_DEGREE) -> DataFrame:
    """Degrees of all entities, heads and id tails: one shuffle of partially summed counts."""
    is_id = (F.col("tail_kind") == "id").cast("long")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    parts = edges.select(F.col("head").alias("mid"), zero.alias("i"), one.alias("o"), (1 - is_id).alias("l"))
    parts = parts.unionByName(edges.where("tail_kind = 'id'").select(F.col("tail").alias("mid"), one.alias("i"), zero.alias("o"), zero.alias("l")))
    if entities is not None:
        parts = parts.unionByName(entities.select("mid", zero.alias("i"), zero.alias("o"), zero.alias("l")))
    d = parts.groupBy("mid").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("l").alias("literal_out_degree"))
    d = d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    return d.withColumn("high_degree", F.col("degree") >= threshold)


def degrees_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``mid, degree`` of the given nodes (``node``) that have edges: only their edges are counted.

    A small frontier filters the edges before anything is grouped, so it costs a scan of them and a shuffle of its own
    counts, not one of the whole graph's. A large one meets partially summed counts instead of edges.
    """
    n = nodes.select(F.col("node").alias("mid")).distinct()
    out, back = around(edges, nodes)
    ends = out.select(F.col("head").alias("mid")).unionAll(back.where("tail_kind = 'id'").select(F.col("tail").alias("mid")))
    few = fits(n)
    if few:
        ends = ends.join(F.broadcast(n), "mid", "left_semi")
    counts = ends.groupBy("mid").agg(F.count(F.lit(1)).alias("degree"))
    return counts if few else counts.join(n, "mid", "left_semi")


def relation_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("frequency"))


def alias_index(entities: DataFrame) -> DataFrame:
    """One row per name and per alias: ``alias_norm, mid, entity_name, alias_source``."""
    name = entities.where("name IS NOT NULL AND name <> ''").select(norm_catalog(F.col("name")).alias("alias_norm"), "mid", F.col("name").alias("entity_name"), F.lit("name").alias("alias_source"))
    if "aliases" not in entities.columns:
        return name
    a = entities.select("mid", "name", F.explode("aliases").alias("alias")).where(F.trim("alias") != "")
    return name.union(a.select(norm_catalog(F.col("alias")), "mid", F.coalesce(F.nullif("name", F.lit("")), "alias"), F.lit("alias")))


def relation_catalog(edges: DataFrame) -> DataFrame:
    """``relation, relation_name, display``."""
    d = edges.select("relation").distinct()
    return d.select("relation", F.coalesce(F.nullif(norm_catalog(F.col("relation")), F.lit("")), F.trim("relation")).alias("relation_name"), verbalize_relation(F.col("relation")).alias("display"))


def relation_lookup(catalog: DataFrame) -> DataFrame:
    """Two rows per relation: by its id and by its name."""
    rows = F.array(F.struct(norm_catalog(F.col("relation")).alias("lookup_norm"), F.lit("relation_id").alias("lookup_source")), F.struct(norm_catalog(F.col("relation_name")).alias("lookup_norm"), F.lit("relation_name").alias("lookup_source")))
    return catalog.select("relation", "relation_name", F.explode(rows).alias("x")).select("x.lookup_norm", "relation", "relation_name", "x.lookup_source")


def legacy_catalog(triples: DataFrame) -> DataFrame:
    """Relations of triples that carry names: the greatest of its non-empty names, else the id."""
    return triples.groupBy("relation").agg(F.coalesce(F.max(F.nullif("relation_name", F.lit(""))), F.first("relation")).alias("relation_name"))


@dataclass
class GraphStore:
    """Triples and entities. Derived tables are lazy plans; those of a saved store are read (``saved``)."""

    triples: DataFrame
    entities: DataFrame
    threshold: int = HIGH_DEGREE
    saved: bool = False
    _made: dict = field(default_factory=dict)

    def _get(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def spark(self) -> SparkSession:
        return self.triples.sparkSession

    @property
    def edges(self) -> DataFrame:
        return self._get("edges", lambda: edges_of(self.triples))

    @property
    def edges_by_tail(self) -> DataFrame:
        """The same edges; a saved store has them sorted by tail, so that lookups by tail skip files and row groups."""
        return self._get("edges_by_tail", lambda: self.edges)

    @property
    def node_stats(self) -> DataFrame:
        return self._get("node_stats", lambda: node_stats(self.edges, self.entities, self.threshold))

    def degrees(self, nodes: DataFrame) -> DataFrame:
        """``mid, degree`` of these nodes (``node``): from the written statistics of a saved store, else from their edges."""
        if self.saved:
            return self.node_stats.select("mid", "degree")
        return degrees_of(nodes, self.edges)

    @property
    def relation_stats(self) -> DataFrame:
        """Written once: relations are few, and many steps ask for their frequencies."""
        return self._get("relation_stats", lambda: written(relation_stats(self.edges)))

    @property
    def relations(self) -> DataFrame:
        return self._get("relations", lambda: relation_catalog(self.relation_stats))

    @property
    def relation_lookup(self) -> DataFrame:
        return self._get("relation_lookup", lambda: relation_lookup(self.relations))

    @property
    def alias_index(self) -> DataFrame:
        return self._get("alias_index", lambda: alias_index(self.entities))

    def save(self, path: str, **more) -> dict:
        """Writes the store: edges twice, clustered by head and by tail for pruned lookups, and all derived tables; staged
        and resumable (see ``build``). Returns its manifest."""
        from .build import build

        return build(self.triples, self.entities, path, **more)

    @classmethod
    def over(cls, edges: DataFrame, entities: DataFrame) -> "GraphStore":
        """A store over edges that have their kinds."""
        return cls(edges, entities, _made={"edges": edges})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "GraphStore":
        read = lambda n: spark.read.parquet(f"{path}/{n}")
        made = {n: read(n) for n in ("node_stats", "relation_stats", "relations", "relation_lookup", "alias_index")}
        made["edges_by_tail"] = read("edges_by_tail").drop("part")
        return cls(read("edges_by_head").drop("part"), read("entities"), saved=True, _made=made)

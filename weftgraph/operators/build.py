"""Staged, resumable builds of a graph store, and counters of what was written.

A build writes into ``<store>.staging``, table by table; the edges, which are most of it, part by part. Each finished piece
gets a manifest of its own (rows, columns) *after* its files are complete, so a build that was killed goes on with the
first piece that has none, and a half-written one is written again. When all pieces are there, the staging folder is renamed
to the store's in one step; an older store stays in place until then. A build from other inputs, or in other parts, starts over.

Rows are counted by ``Observation`` while they are written, not by further jobs. What may be missing from the inputs is probed
first: without ``tail_kind`` all tails are ids, without ``aliases`` or ``types`` those indexes are empty; without the
required columns the build fails before it writes.

Defined cases: empty inputs give a store of empty tables; rows without a head, relation or tail are not edges and are counted
apart (``skipped``); a finished store is built again only if asked to (``fresh``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .store import GraphStore

FORMAT = 2
REQUIRED = {"triples": ["head", "relation", "tail"], "entities": ["mid", "name"]}
OPTIONAL = {"triples": ["tail_kind"], "entities": ["aliases", "types", "is_cvt"]}
#: What stands for an optional column.
EMPTY = {"tail_kind": "'id'", "aliases": "CAST(array() AS ARRAY<STRING>)", "types": "CAST(array() AS ARRAY<STRING>)", "is_cvt": "false"}


class Folder:
    """A folder of the store's file system, whatever that is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def put(self, name: str, value: dict) -> None:
        out = self._fs.create(self._at(name), True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()

    def get(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        # Spark's readers pass over names that begin with an underscore, so the file is opened as it is.
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def delete(self) -> None:
        self._fs.delete(self._at(""), True)

    def move_to(self, other: "Folder") -> None:
        if not self._fs.rename(self._at(""), other._at("")):
            raise OSError(f"{self.path} could not be renamed to {other.path}")


def observed_write(df: DataFrame, path: str, **conditions: Column) -> dict[str, int]:
    """Writes a table and tells how many rows it has, and for how many each condition held, counted on the way."""
    seen = Observation()
    counts = [F.count_if(c).alias(k) for k, c in conditions.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.mode("overwrite").parquet(path)
    got = seen.get
    return {k: int(got.get(k) or 0) for k in ("rows", *conditions)}


def probe(triples: DataFrame, entities: DataFrame) -> dict[str, bool]:
    """Which optional columns the inputs have; an error if required ones are missing."""
    found = {}
    for name, df in (("triples", triples), ("entities", entities)):
        missing = [c for c in REQUIRED[name] if c not in df.columns]
        if missing:
            raise ValueError(f"{name} lack the columns {missing}")
        found |= {c: c in df.columns for c in OPTIONAL[name]}
    return found


def _completed(df: DataFrame, name: str) -> DataFrame:
    more = [F.expr(EMPTY[c]).alias(c) for c in OPTIONAL[name] if c not in df.columns]
    return df.select(*[f"`{c}`" for c in df.columns if c in REQUIRED[name] + OPTIONAL[name]], *more)


def fingerprint(*inputs: DataFrame) -> str:
    """What tells inputs apart: their columns and files."""
    return hashlib.sha256(json.dumps([[d.schema.simpleString(), sorted(d.inputFiles())] for d in inputs]).encode()).hexdigest()


def build(triples: DataFrame, entities: DataFrame, path: str, parts: int = 8, fresh: bool = False, source: str | None = None, progress: Callable[[str, dict], None] | None = None) -> dict:
    """Builds (or goes on building) a store; returns its manifest: features, and rows by piece.

    ``source`` names the inputs (default: their ``fingerprint``). ``progress`` is called with each piece that is finished.
    """
    spark = triples.sparkSession
    final, stage = Folder(spark, path), Folder(spark, f"{path}.staging")
    head = {"format": FORMAT, "parts": parts, "source": source or fingerprint(triples, entities), "features": probe(triples, entities)}
    if not fresh and final.exists("_manifest.json"):
        done = final.get("_manifest.json")
        if all(done.get(k) == v for k, v in head.items()):
            return done
    if fresh or stage.get("_build.json") != head:
        stage.delete()
        stage.put("_build.json", head)
    raw = _completed(triples, "triples")
    whole = F.col("head").isNotNull() & F.col("relation").isNotNull() & F.col("tail").isNotNull()
    g = GraphStore(raw.where(whole), _completed(entities, "entities"))
    pieces: dict[str, dict] = {}

    def piece(name: str, folder: str, make: Callable[[], DataFrame], **conditions: Column) -> None:
        got = stage.get(f"_done/{name}.json")
        if got is None:
            df = make()
            got = {"columns": df.columns, **observed_write(df, f"{stage.path}/{folder}", **conditions)}
            stage.put(f"_done/{name}.json", got)
            if progress:
                progress(name, got)
        pieces[name] = got

    # Edges in parts by the hash of the end they are sorted by, so that a lookup's files are few.
    for side, order in (("head", ["head", "relation", "tail"]), ("tail", ["tail", "relation", "head"])):
        for k in range(parts):
            own = lambda: g.edges.where(F.pmod(F.xxhash64(side), F.lit(parts)) == k).repartitionByRange(side).sortWithinPartitions(*order)  # noqa: B023, E731
            piece(f"edges_by_{side}-{k}", f"edges_by_{side}/part={k}", own, literals=F.col("tail_kind") != "id")
    saved = GraphStore.over(spark.read.parquet(f"{stage.path}/edges_by_head").drop("part"), g.entities)
    for name in ("entities", "node_stats", "relation_stats", "relations", "relation_lookup", "alias_index"):
        piece(name, name, lambda: getattr(saved, name))  # noqa: B023
    edges = sum(p["rows"] for n, p in pieces.items() if n.startswith("edges_by_head"))
    manifest = head | {"pieces": pieces, "edges": edges, "skipped": raw.where(~whole).count()}
    stage.put("_manifest.json", manifest)
    old = Folder(spark, f"{path}.old")
    if final.exists():
        old.delete()
        final.move_to(old)
    stage.move_to(final)
    old.delete()
    return manifest

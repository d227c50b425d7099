"""What the corpus operators share: words, batches, shared tables, sizes and components.

Conventions of every operator in this subpackage:

* a null text counts as the empty text; rows are never dropped or deduplicated unless that is the operator's job;
* other columns of the input pass through untouched; an input column whose name equals an output column's
  (case-insensitively) gives way to the output;
* repeated rows each get their own output row, equal to the other's.
"""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TABLES: dict[str, str | None] = {}


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, unless they find it where the driver does."""
    root = Path(__file__).resolve().parents[2]
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if any(p and Path(p).resolve() == root for p in paths) or getattr(sc, "_weftgraph_sent", False):
        return
    base = Path(tempfile.mkdtemp(prefix="weftgraph-")).resolve()
    sc.addPyFile(shutil.make_archive(str(base / "weftgraph"), "zip", root, "weftgraph"))
    sc._weftgraph_sent = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: str | None) -> list[bytes]:
    """Maximal runs of anything but space and U+0009..U+000D, A-Z lower-cased."""
    return text.encode().translate(LOWER).split() if text else []


def remainder(doc_id, mod: int) -> int:
    """crc32 of the id as text, modulo ``mod``; -1 for a null id."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def remainder_col(c: str | Column, mod: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % mod, F.lit(-1)).cast("int")


def trim() -> None:
    """Gives memory that a worker has freed back to the system: workers are reused, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def add_columns(df: DataFrame, inputs: Sequence[str], outputs: str, make: Callable[[], Callable], keep: Sequence[str] | None = None) -> DataFrame:
    """Appends columns computed batch by batch in Python.

    ``make()`` runs once per task and gives ``fn``; ``fn(*lists)`` gets the inputs of a batch as lists and returns
    a list (or Arrow array) for each field of the DDL string ``outputs``. ``keep``: the input columns that stay
    (default: all). Nothing is shuffled.
    """
    ship(df.sparkSession)
    new = T._parse_datatype_string(outputs)
    taken = {f.name.lower() for f in new}
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    tmp = {c: f"__in{i}" for i, c in enumerate(inputs)}
    src = df.select(*[F.col(f"`{c}`") for c in stay], *[F.col(f"`{c}`").alias(t) for c, t in tmp.items()])
    schema = T.StructType([*[f for f in src.schema if f.name in stay], *new])
    n_stay = len(stay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fn, to = make(), to_arrow_schema(schema)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                got = fn(*[part.column(n_stay + i).to_pylist() for i in range(len(tmp))])
                cols = [part.column(i) for i in range(n_stay)]
                cols = [c if c.type == to.field(i).type else c.cast(to.field(i).type) for i, c in enumerate(cols)]
                cols += [x if isinstance(x, pa.Array) else pa.array(x, type=to.field(n_stay + i).type) for i, x in enumerate(got)]
                yield pa.RecordBatch.from_arrays(cols, schema=to)
        trim()

    return src.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else (a single machine) a temporary one."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
        got = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return got


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query are deleted as soon as the query ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def remember(df: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """Notes the folder (and the catalog's name) of a table, for ``discard`` and ``drop_tables``."""
    _TABLES[path] = name
    df._weftgraph_path = path
    return df


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/weftgraph-{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    return remember(spark.read.schema(df.schema).parquet(path), path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of this module that nothing unfinished reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._weftgraph_path)


def _delete(spark: SparkSession, path: str) -> None:
    if path not in _TABLES:
        return
    name = _TABLES.pop(path)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tables() -> set[str]:
    """The folders of the tables that exist now."""
    return set(_TABLES)


def drop_tables(spark: SparkSession, *but: DataFrame, older: set[str] = frozenset()) -> None:
    """Deletes all tables written so far but these and the ``older`` ones. No unfinished DataFrame may read the others."""
    keep = {t._weftgraph_path for t in but} | older
    for path in [p for p in _TABLES if p not in keep]:
        _delete(spark, path)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table of long ids: ``(id, component)``, component the smallest id.

    Alternates large-star and small-star steps (each a group-by, so hubs are split between tasks by partial
    aggregation of minima and an AQE-splittable join), writing the edges to the shared folder each round; ids
    without edges are not in the result. The number of rounds grows with the logarithm of the longest path.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = table(e, "cc")
    for _ in range(max_rounds):
        # Large star: each node's larger neighbours hang on its smallest neighbour (or itself). The minima are written
        # first, so that the join's both sides are dealt anew and the part of a hub can be split.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "cc")
        large = table(e.join(low, "v").select("u", F.col("m").alias("v")).distinct(), "cc")
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        low2 = table(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct()
        new = table(small, "cc")
        # A forest of stars: nobody is both a child and a root, and each child has one root.
        open_ = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() or new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        discard(e, low, large, low2)
        e = new
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

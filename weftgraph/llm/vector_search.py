"""Exact top-k by inner product with a pivot-distance index.

Vectors x are lifted to (x, sqrt(M^2 - |x|^2)), M the largest norm, and queries to (q, 0); then the inner product
falls as the Euclidean distance grows, and distances obey the triangle inequality. Every vector is keyed by its
nearest pivot and its distance to it; sorted by that key, the vectors are cut into annuli of at most ``BLOCK`` rows.
A query expands the annuli in order of their lower bounds ``max(0, near - d, d - far)``, d its distance to the
pivot, and stops at the first bound beyond its k-th best distance so far: no later annulus can hold a better one.

Pivots are chosen (farthest first) from a sample of at most ``SAMPLE`` vectors; the index holds every vector, and
results are exact whatever the pivots are. Components are floor(256 x), so scores are integers; they are kept as
doubles, which hold them exactly whatever their size, and multiplied as doubles, longs or Python's integers, whichever
is exact. Distances are taken of vectors scaled to components of at most 1, and bounds allow for their rounding.

Scale: the key order comes from one range-partitioned sort with the row's id as the last key, so neither a popular
pivot nor many copies of a vector meet in one task. Queries travel in blocks: first each to the annuli next to its
own key, which bounds its k-th distance; then to those annuli whose bound passes, in one pass per annulus over the
queries that still need it. The directory of annuli (pivot, near, far) is the only thing sent to every task. It has
about ``DIRECTORY_ROWS`` short rows at most: where there are more vectors than that many annuli of ``BLOCK`` rows, an
entry stands for several neighbouring annuli of a pivot, each still a row of the table and a step of its own.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part. Between unequal lengths
there is no inner product: vectors of each length have an index of their own, one after the other (few lengths are expected;
each costs a build). Scores beyond a
long's range stop at its ends. Rows without an id take no part. Repeated ids are separate candidates,
and none of them is a candidate of a query of the same id. Fewer candidates than k: all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, table

_MOST = 1.7976931348623157e308
K, PIVOTS, SAMPLE, BLOCK, DIRECTORY_ROWS = 5, 48, 2048, 1024, 200_000
RESULT = "query_id long, rank int, vec_id long, score long"


def quantized(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, v array<double> of whole numbers) of the rows that take part."""
    x = F.col(f"`{vec_col}`")
    ok = F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    # floor() gives a long; from 2**52 on a double is whole anyway, and what overflows stops at the largest double.
    big = lambda e: F.least(F.greatest(F.lit(256.0) * e, F.lit(-_MOST)), F.lit(_MOST))
    q = F.transform(x, lambda e: F.when(F.abs(e.cast("double")) < 2.0**44, F.floor(F.lit(256.0) * e.cast("double")).cast("double")).otherwise(big(e.cast("double"))))
    return df.where(ok).select(F.col(f"`{id_col}`").cast("long").alias("id"), q.alias("v"))


def _lift(v: np.ndarray, m2: float) -> np.ndarray:
    """``v``: scaled vectors, none longer than the root of ``m2``."""
    return np.column_stack([v, np.sqrt(np.maximum(m2 - (v * v).sum(1), 0))])


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal."""
    got = [0]
    d = np.linalg.norm(sample - sample[0], axis=1)
    while len(got) < min(n, len(sample)) and d.max() > 0:
        got.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(sample - sample[got[-1]], axis=1))
    return sample[got]


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers in doubles, exactly; beyond a long's range, its ends."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**52:
        return (q @ x.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    whole = lambda m: [[int(e) for e in row] for row in m]
    lo, hi, xs = -(2**63), 2**63 - 1, whole(x)
    return np.array([[max(lo, min(hi, sum(a * b for a, b in zip(r, c)))) for c in xs] for r in whole(q)], np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= cut
        ids, scores = ids[keep], scores[keep]
    o = np.lexsort((ids, ~scores))[:k]  # of longs, -1 - x turns the order around without overflow
    return ids[o], scores[o]


def top_k(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows for each row where ``queries`` (a condition on ``id``) holds."""
    v = quantized(df, id_col, vec_col)
    lengths = [r.d for r in v.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    found = [_top_k(v.where(F.size("v") == d), queries, k, pivots, block) for d in lengths]
    return reduce(DataFrame.unionByName, found) if found else df.sparkSession.createDataFrame([], RESULT)


def _top_k(v: DataFrame, queries: Column, k: int, pivots: int, block: int) -> DataFrame:
    """``top_k`` among vectors (``id, v``) of one length."""
    spark = v.sparkSession
    sc = spark.sparkContext
    stats = v.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("m"), F.count(F.lit(1)).alias("n"), F.sum(queries.cast("long")).alias("q")).first()
    if not stats["q"]:
        return spark.createDataFrame([], RESULT)
    n, scale = stats["n"], 2.0 ** -max(0, math.frexp(stats["m"])[1])
    m2 = float(v.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + (e * scale) * (e * scale)))).first()[0]) * (1 + 1e-12)
    per = max(1, -(-n // (block * DIRECTORY_ROWS)))  # annuli of a directory entry
    few = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    piv = choose_pivots(_lift(np.array([r.v for r in few], float) * scale, m2), pivots)
    sent = sc.broadcast((piv, m2, k, scale))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv, m2, _, scale = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _lift(_matrix(b.column(1)) * scale, m2)
            d2 = (x * x).sum(1)[:, None] - 2 * x @ piv.T + (piv * piv).sum(1)
            p = d2.argmin(1)
            d = np.linalg.norm(x - piv[p], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.int32()), pa.array(d)], ["id", "v", "pivot", "dist"])

    keyed = v.mapInArrow(key, "id long, v array<double>, pivot int, dist double")
    parts = max(1, min(2000, n // 8192 + 1))
    keyed = keyed.repartitionByRange(parts, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Annuli: rows of one pivot, next to each other in distance; ``per`` of them share a directory entry."""
        from pyspark import TaskContext

        part, entry, used, pivot = TaskContext.get().partitionId() << 40, -1, 0, None
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            nonlocal entry, used, pivot, held
            ids, x, d = (np.concatenate(c) for c in zip(*held))
            held = []
            if used == 0 or used == per:
                entry, used = entry + 1, 0
            used += 1
            cols = [[part + entry], [pivot], [float(d[0])], [float(d[-1])], [ids.tobytes()], [x.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()))], ["ring", "pivot", "near", "far", "ids", "rows"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, x, p, d = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
            for lo, hi in zip(edges, edges[1:]):
                if p[lo] != pivot:
                    if held:
                        yield row()
                    pivot, used = int(p[lo]), 0
                while lo < hi:
                    z = min(hi, lo + block - sum(len(h[0]) for h in held))
                    held.append((ids[lo:z], x[lo:z], d[lo:z]))
                    lo = z
                    if sum(len(h[0]) for h in held) == block:
                        yield row()
        if held:
            yield row()

    ring = table(keyed.mapInArrow(cut, "ring long, pivot int, near double, far double, ids binary, rows binary"), "annuli")
    directory = ring.groupBy("ring", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far")).orderBy("ring").collect()
    book = sc.broadcast((np.array([r.ring for r in directory]), np.array([r.pivot for r in directory]), np.array([r.near for r in directory]), np.array([r.far for r in directory])))
    asked = v.where(queries)

    def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of the distances from scaled queries to annuli."""
        piv, _, _, _ = sent.value
        _, p, near, far = book.value
        q = np.column_stack([x, np.zeros(len(x))])
        d = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ piv.T + (piv * piv).sum(1), 0))[:, p]
        return np.maximum(0, np.maximum(near - d, d - far))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to its first annuli, until they surely hold k rows besides itself."""
        rings, scale = book.value[0], sent.value[3]
        for b in batches:
            x = _matrix(b.column(1)) * scale if b.num_rows else np.zeros((0, 1))
            for lo in range(0, len(x), 64):
                order = np.argsort(bounds(x[lo : lo + 64]), axis=1, kind="stable")[:, :2]
                part = b.slice(lo, 64)
                for c in range(order.shape[1]):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rings[order[:, c]])], ["q", "v", "ring"])

    def meet(pairs: DataFrame) -> DataFrame:
        """The k best of each (query, annulus) pair: queries of an annulus meet its rows in blocks."""
        each = pairs.groupBy("ring", F.pmod(F.xxhash64("q"), F.lit(max(1, stats["q"] // 4096))).alias("part")).agg(F.collect_list(F.struct("q", "v")).alias("qs"))
        both = each.join(ring.select("ring", "ids", "rows"), "ring").select("qs", "ids", "rows")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = sent.value[2]
            for b in batches:
                for r in range(b.num_rows):
                    qs = b.column(0).slice(r, 1).flatten()
                    qid = qs.field(0).to_numpy()
                    q = qs.field(1).flatten().to_numpy().reshape(len(qid), -1)
                    ids = np.frombuffer(b.column(1)[r].as_buffer(), np.int64)
                    s = products(q, np.frombuffer(b.column(2)[r].as_buffer(), np.float64).reshape(len(ids), -1))
                    out = []
                    for i, a in enumerate(qid):
                        other = ids != a
                        got, sc_ = _best(ids[other], s[i, other], k)
                        out.append((np.full(len(got), a), got, sc_))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

        return both.mapInArrow(run, "query_id long, vec_id long, score long")

    def merge(found: DataFrame) -> DataFrame:
        """The k best of each query, from at most k rows of each annulus; ties to the smaller id."""
        best = F.slice(F.array_sort(F.collect_list(F.struct((-1 - F.col("score")).alias("s"), "vec_id"))), 1, k)
        return found.groupBy("query_id").agg(best.alias("best"))

    start = table(meet(asked.mapInArrow(first, "q long, v array<double>, ring long")), "first")
    # The k-th score so far, as a distance: |q|^2 + M^2 - 2 score. A score that stopped at a long's low end bounds nothing.
    kth = merge(start).select(F.col("query_id").alias("id"), F.when((F.size("best") >= k) & (F.try_element_at("best", F.lit(-1))["s"] < 2**63 - 1), (-1 - F.try_element_at("best", F.lit(-1))["s"]).cast("double")).alias("kth"))
    more = asked.join(kth, "id", "left").select("id", "v", "kth")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The annuli after the first two whose bound is within the k-th distance, nearest first."""
        _, m2, _, scale = sent.value
        rings = book.value[0]
        for b in batches:
            x = _matrix(b.column(1)) * scale if b.num_rows else np.zeros((0, 1))
            kth = b.column(2).to_numpy(zero_copy_only=False).astype(float) * scale * scale
            for lo in range(0, len(x), 64):
                q = x[lo : lo + 64]
                low = bounds(q)
                order = np.argsort(low, axis=1, kind="stable")
                far = np.sqrt(np.maximum((q * q).sum(1) + m2 - 2 * kth[lo : lo + 64], 0))
                # Distances of scaled vectors are off by the root of the rounding of their squares, at most.
                far = np.where(np.isnan(far), np.inf, far * (1 + 1e-9) + 1e-5)
                sorted_low = np.take_along_axis(low, order, 1)
                for i in range(len(q)):
                    stop = int(np.searchsorted(sorted_low[i], far[i], side="right"))
                    if stop > 2:
                        take = pa.array(np.full(stop - 2, lo + i))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(rings[order[i, 2:stop]])], ["q", "v", "ring"])

    rest = meet(more.mapInArrow(expand, "q long, v array<double>, ring long"))
    best = merge(start.union(rest))
    return best.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "b.vec_id", (-1 - F.col("b.s")).alias("score"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

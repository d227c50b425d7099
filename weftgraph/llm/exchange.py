"""Chunks of documents and exact questions about 64-bit keys of the whole corpus.

``dealt`` sorts the documents into ranges (by an optional flag, the id, the text's hash and the row's place, so null,
repeated or textual ids and identical rows are split like any others), cuts each range into chunks of about ``CHUNK``
bytes of text by running sums, and writes them once to the shared folder, bucketed by chunk: later passes read the
text in place, without a shuffle. The number of a chunk is chosen so that all chunks of a range hash to one bucket:
buckets are even in bytes as far as the sampled ranges are, and hold one file each.

An ``Exchange`` is a reduction by key whose result goes back to everyone who asked. A chunk asks about its distinct
keys: one row per (chunk, range of keys) packs the sorted keys and the facts the chunk knows of each, so keys are
combined before they are shuffled and a popular key costs one entry per chunk. At most ``FAN`` rows leave a chunk,
however large the input is: where more buckets than that are needed, groups of chunks are merged first, and each
merged (group, range) asks again as a chunk would, about a narrower range, until ranges fit one task. Rows therefore
grow with the number of chunks times a constant per level, and levels with its logarithm.

Everything a chunk asks is a function of its rows, which are written; a lost executor's work can be redone anywhere.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cleaned, remember, shared_dir, ship, table, trim

#: Bytes of text of a chunk, and the least to which small inputs are cut for the sake of parallel tasks.
CHUNK, LEAST_CHUNK = 6 << 20, 1 << 20
#: Chunks of a range (one task of each pass), and the most ranges.
PER_RANGE, MOST_RANGES = 4, 50_000
#: Keys of a bucket, roughly, over all chunks; most ranges of keys into which one asker packs its keys.
BUCKET, FAN = 500_000, 4096
#: A chunk's number: flag, range, place in the range, and what makes it hash to the range's bucket.
_FLAG, _RANGE, _PLACE = 61, 40, 20


class Dealt(NamedTuple):
    rows: DataFrame
    text_bytes: int


def _bucket_of(chunk: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket Spark puts a long into: Murmur3 (32 bits, seed 42), modulo the number of buckets."""
    u, m = np.uint32, 0xFFFFFFFF

    def rot(x: np.ndarray, r: int) -> np.ndarray:
        return (x << u(r)) | (x >> u(32 - r))

    h = np.full(len(chunk), 42, u)
    for half in ((chunk & m).astype(u), ((chunk >> 32) & m).astype(u)):
        h = rot(h ^ (rot(half * u(0xCC9E2D51), 15) * u(0x1B873593)), 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).astype(np.int32).astype(np.int64) % buckets


def chunk_number(flag: int, part: int, place: int, buckets: int) -> int:
    """The number of a chunk: ordered by flag, range and place, and hashed by Spark to the bucket of its range."""
    base = (flag << _FLAG) + (part << _RANGE) + (place << _PLACE)
    step = min(1 << _PLACE, 8 * buckets + 8)
    for lo in range(0, 1 << _PLACE, step):
        hit = np.flatnonzero(_bucket_of(base + np.arange(lo, min(lo + step, 1 << _PLACE), dtype=np.int64), buckets) == part % buckets)
        if len(hit):
            return base + lo + int(hit[0])
    return base


def dealt(docs: DataFrame, id_col: str, text_col: str, flag: Column | None = None, chunk: int | None = None) -> Dealt:
    """The documents with ``__chunk``, written by chunk; ``flag`` (0 or 1): rows that get chunks of their own, last."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    s = docs.agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = s["b"] or 0
    chunk = chunk or max(LEAST_CHUNK, min(CHUNK, total // 64 + 1))
    parts = int(max(1, min(MOST_RANGES, (total + 16 * s["n"]) // (PER_RANGE * chunk) + 1)))
    x, keys = F.col(f"`{id_col}`"), ["__flag", "__has", "__id", "__hash", "__row"]
    order = docs.withColumns({"__flag": F.lit(0) if flag is None else flag.cast("int"), "__has": x.isNotNull(), "__id": x, "__hash": F.xxhash64(F.col(f"`{text_col}`")), "__row": F.monotonically_increasing_id()})
    order = order.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*[F.col(f"`{c}`") for c in docs.columns], "__flag")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("__flag", T.IntegerType()), T.StructField("__chunk", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, used, last, name = TaskContext.get().partitionId(), -1, 0, None, 0
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist()
            names = []
            for n, f in zip(sizes, b.column(b.num_columns - 1).to_pylist()):
                if f != last or used + n + 16 > chunk:
                    place, used, last = place + 1, 0, f
                    name = chunk_number(f, part, place, parts)
                used += n + 16
                names.append(name)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.int64())], [*b.schema.names, "__chunk"])

    ship(spark)
    name = f"weftgraph_dealt_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with cleaned(spark):
        order.mapInArrow(number, schema).write.format("parquet").bucketBy(parts, "__chunk").option("path", path).saveAsTable(name)
    return Dealt(remember(spark.read.table(name), path, name), total)


def _squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys as differences: five raw bytes each, the three high ones compressed."""
    d = np.diff(keys).astype("<u8").view(np.uint8).reshape(-1, 8)
    return len(keys).to_bytes(4, "little") + int(keys[0]).to_bytes(8, "little") + d[:, :5].tobytes() + zlib.compress(d[:, 5:].T.tobytes(), 1)


def _stretch(raw: bytes) -> np.ndarray:
    n, first = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:12], "little")
    d = np.zeros((n - 1, 8), np.uint8)
    end = 12 + 5 * (n - 1)
    d[:, :5] = np.frombuffer(raw, np.uint8, 5 * (n - 1), 12).reshape(-1, 5)
    d[:, 5:] = np.frombuffer(zlib.decompress(raw[end:]), np.uint8).reshape(3, -1).T
    out = np.empty(n, np.uint64)
    out[0] = first
    out[1:] = d.reshape(-1).view("<u8")
    return np.cumsum(out, dtype=np.uint64)


def _unzip(raw: bytes, types: list[str], n: int) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(raw), 0, []
    for ty in types:
        out.append(np.frombuffer(raw, ty, n, at))
        at += n * np.dtype(ty).itemsize
    return out


def _zip(cols: Iterable[np.ndarray]) -> bytes:
    return zlib.compress(b"".join(x.tobytes() for x in cols), 1)


ASK = "chunk long, bucket long, keys binary, data binary"
TOLD = "chunk long, bucket long, reply binary, fact1 long, fact2 long, fact3 long"


class Exchange:
    """A reduction by key for chunks that each ask about their own keys.

    ``facts``: (dtype, "sum" or "min") of each fact; sums stop at the type's largest value. ``keys``: how many keys,
    roughly, all chunks ask about. ``summary(keys, *facts)``: up to three sums over the distinct keys, left in
    ``totals``.
    """

    def __init__(self, keys: int, facts: list[tuple[str, str]], summary: Callable | None = None, bucket: int | None = None, fan: int | None = None):
        self.types, self.hows, self.summary = [t for t, _ in facts], [h for _, h in facts], summary
        fan = fan or FAN
        need = max(8, keys // (bucket or BUCKET) + 1)
        self.fans: list[int] = []
        while need > fan:
            self.fans.append(fan)
            need = -(-need // fan)
        self.fans.append(int(need))
        self.group = max(2, fan // PER_RANGE)  # ranges of documents whose chunks are merged
        self.totals = (0, 0, 0)

    def pack(self, chunk: int, keys: np.ndarray, data: Iterable[np.ndarray], level: int = 0) -> pa.Table:
        """The question of a chunk: ``keys`` sorted and distinct, ``data`` one array per fact."""
        data = [np.asarray(x).astype(ty, copy=False) for x, ty in zip(data, self.types)]
        buckets = int(np.prod(self.fans[: level + 1], dtype=object))
        b = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        edge = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
        lo = edge[:-1]
        return pa.table(
            {
                "chunk": pa.array(np.full(len(lo), chunk, np.int64)),
                "bucket": pa.array(b[lo]),
                "keys": pa.array([_squeeze(keys[a:z]) for a, z in zip(lo, edge[1:])], pa.binary()),
                "data": pa.array([_zip(x[a:z] for x in data) for a, z in zip(lo, edge[1:])], pa.binary()),
            }
        )

    def _reduce(self, t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """The distinct keys of several questions, the number of each entry's key, the reduced facts, and the sizes."""
        keys = [_stretch(x) for x in t["keys"].to_pylist()]
        sizes = np.array([len(k) for k in keys])
        cols = list(zip(*[_unzip(raw, self.types, n) for raw, n in zip(t["data"].to_pylist(), sizes)]))
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        out = []
        for parts, ty, how in zip(cols, self.types, self.hows):
            x = np.concatenate(parts)
            if how == "sum":
                out.append(np.minimum(np.bincount(number, x, len(distinct)), np.iinfo(ty).max).astype(ty))
            else:
                low = np.full(len(distinct), np.iinfo(ty).max, ty)
                np.minimum.at(low, number, x)
                out.append(low)
        return distinct, number, out, sizes

    @staticmethod
    def _told(t: pa.Table, number: np.ndarray, facts: list[np.ndarray], sizes: np.ndarray, sums: list[int]) -> pa.Table:
        ends = np.cumsum(sizes)
        replies = [_zip(x[number[a:z]] for x in facts) for a, z in zip(ends - sizes, ends)]
        rest = [0] * (len(sizes) - 1)
        more = {f"fact{k + 1}": pa.array([int(sums[k]) if k < len(sums) else 0, *rest], pa.int64()) for k in range(3)}
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "reply": pa.array(replies, pa.binary()), **more})

    def answers(self, asked: DataFrame, name: str, level: int = 0) -> DataFrame:
        """The replies to all questions, as a table (chunk, bucket, reply)."""
        if level == len(self.fans) - 1:

            def run(t: pa.Table) -> pa.Table:
                distinct, number, facts, sizes = self._reduce(t)
                got = self._told(t, number, facts, sizes, self.summary(distinct, *facts) if self.summary else [])
                trim()
                return got

            told = table(asked.groupBy("bucket").applyInArrow(run, TOLD), name)
            if self.summary:
                s = told.agg(*[F.sum(f"fact{k}").alias(f"f{k}") for k in (1, 2, 3)]).first()
                self.totals = tuple(int(x or 0) for x in s)
            return told
        part = F.shiftright(F.col("chunk"), _RANGE).bitwiseAND((1 << (_FLAG - _RANGE)) - 1)
        asked = table(asked.withColumn("crowd", F.floor(part / self.group).cast("long")), f"{name}-asked")

        def merge(key: tuple, t: pa.Table) -> pa.Table:
            distinct, _, facts, _ = self._reduce(t)
            return self.pack(key[0].as_py() << _RANGE, distinct, facts, level + 1)

        told = self.answers(asked.groupBy("crowd", "bucket").applyInArrow(merge, ASK), name, level + 1)
        back = told.select(F.shiftright("chunk", _RANGE).alias("crowd"), F.floor(F.col("bucket") / self.fans[level + 1]).cast("long").alias("bucket"), F.col("bucket").alias("fine"), "reply")

        def spread(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
            distinct, number, _, sizes = self._reduce(t)
            return self._told(t, number, self.unpack(told, distinct, "fine"), sizes, [])

        return table(asked.groupBy("crowd", "bucket").cogroup(back.groupBy("crowd", "bucket")).applyInArrow(spread, TOLD), name)

    def unpack(self, told: pa.Table, keys: np.ndarray, by: str = "bucket") -> list[np.ndarray]:
        """The reduced facts of a chunk's sorted keys, from the replies to it."""
        each = sum(np.dtype(t).itemsize for t in self.types)
        cols: list[list[np.ndarray]] = [[] for _ in self.types]
        for raw in told.sort_by(by)["reply"].to_pylist():
            raw = zlib.decompress(raw)
            n, at = len(raw) // each, 0
            for c, ty in zip(cols, self.types):
                c.append(np.frombuffer(raw, ty, n, at))
                at += n * np.dtype(ty).itemsize
        out = [np.concatenate(c) if c else np.zeros(0, ty) for c, ty in zip(cols, self.types)]
        if any(len(x) != len(keys) for x in out):
            raise RuntimeError("a chunk's rows changed between two reads")
        return out


def by_chunk(told: DataFrame):
    """Answers grouped by chunk, to go with the rows of ``dealt``."""
    return told.withColumnRenamed("chunk", "__chunk").groupBy("__chunk")

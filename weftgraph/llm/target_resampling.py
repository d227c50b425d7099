"""Importance resampling towards a target distribution, in whole numbers, by two Arrow passes over the texts.

Words are maximal runs of ``[a-z0-9]`` and of anything beyond ASCII, with A-Z lower-cased; features are all runs of one
to three words, joined by one space, repeats counted. A feature's bucket is the CRC-32 of its UTF-8 bytes modulo
``BUCKETS``. With S features of the corpus, s of them in a bucket, and T and t of the target, a bucket's gain is
``floor(1000 * ln((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS))))``; a document's weight is the sum of its
features' gains, its score the weight plus Gumbel noise, made of its id. Of the documents with at least ``LEAST_WORDS``
words, the given percentage with the highest scores is drawn, ties going to the smaller id.

The CRC of two strings in a row is made of their CRCs alone: that of the first is moved on by the second's length, which
is linear, so four table lookups do it for many features at once. Words are hashed once per batch.

Scale: both passes read the texts where they are and shuffle nothing of them. The first makes one vector of ``BUCKETS``
counts per partition (``np.bincount``) and merges them in a tree (``treeReduce``), so that the driver gets one vector. The
second takes the gains as a broadcast of fixed size. Ranks are places in a range-sorted table of ids and scores: no task
holds all of them, and the rows that are drawn go nowhere.

Defined cases: a null, empty or wordless text has no features and weight 0. A null id counts as the empty text in the
noise and ranks after equal scores with ids. Repeated rows have equal scores and get ranks of their own. An empty target
or corpus: the same formula with T or S of 0. An empty table: no rows. An input column named like an output gives way.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import places
from .common import LOWER, add_columns, read, ship, table

BUCKETS = 10_000
RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
_WORDS = bytes(LOWER[i] if i >= 0x80 or chr(i).isalnum() else 0x20 for i in range(256))
#: Bytes of text whose words are held as arrays at a time.
_AT_ONCE = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


def _steps() -> np.ndarray:
    """The CRC-32 register's change by one zero byte: a table of 256 values."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_STEP = _steps()


class Shifts:
    """Tables that move a CRC on by a number of bytes: ``crc(a + b) = moved(crc(a), len(b)) ^ crc(b)``."""

    def __init__(self):
        one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        self._tables = [one]  # by length; moving by no byte changes nothing
        self._long: dict[int, np.ndarray] = {}

    def _next(self, t: np.ndarray) -> np.ndarray:
        return (t >> np.uint32(8)) ^ _STEP[t & np.uint32(255)]

    def of(self, length: int) -> np.ndarray:
        if length < 256:
            while len(self._tables) <= length:
                self._tables.append(self._next(self._tables[-1]))
            return self._tables[length]
        if length not in self._long:
            # Twice the half: a table applied to its own entries.
            half = self.of(length // 2)
            t = self._apply(half, half)
            if len(self._long) > 1000:
                self._long.clear()
            self._long[length] = self._next(t) if length % 2 else t
        return self._long[length]

    @staticmethod
    def _apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
        m = np.uint32(255)
        return t[0][x & m] ^ t[1][(x >> np.uint32(8)) & m] ^ t[2][(x >> np.uint32(16)) & m] ^ t[3][x >> np.uint32(24)]

    def one(self) -> np.ndarray:
        return self.of(1).ravel()

    def tables(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tables of all lengths that occur, one after the other, and where each length's begins."""
        kinds = np.flatnonzero(np.bincount(lengths)) if len(lengths) else np.zeros(0, np.int64)
        t = np.concatenate([self.of(int(n)).ravel() for n in kinds]) if len(kinds) else np.zeros(0, np.uint32)
        place = np.zeros(int(kinds[-1]) + 1 if len(kinds) else 0, np.int64)
        place[kinds] = np.arange(len(kinds)) * 1024
        return t, place[lengths]


def moved(t: np.ndarray, begin: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Each CRC moved on by the table that begins there."""
    m = np.uint32(255)
    out = t[begin + (crc & m)]
    for k in (1, 2, 3):
        out ^= t[begin + (((crc >> np.uint32(8 * k)) & m) + np.uint32(256 * k))]
    return out


def batches_of(texts: list[str | None], most: int = _AT_ONCE) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(the first text's place, the words of some texts), about ``most`` characters at a time; a text is never cut."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < most):
            size += len(texts[hi] or "")
            hi += 1
        yield lo, [words_of(t) for t in texts[lo:hi]]
        lo = hi


def buckets_of(lists: list[list[bytes]], shifts: Shifts, buckets: int = BUCKETS, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every feature of some texts, and the text it belongs to."""
    sizes = np.array([len(x) for x in lists], np.int64)
    n = int(sizes.sum())
    words = [w for x in lists for w in x]
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    shift, begin = shifts.tables(np.fromiter(map(len, words), np.int64, n))
    # Behind another word comes a space and the word: the CRC of the space moved on by the word, and the word's.
    spaced = moved(shift, begin, np.full(n, zlib.crc32(b" "), np.uint32)) ^ crc
    after = shifts.one()
    doc = np.repeat(np.arange(len(lists)), sizes)
    out, docs = [crc % np.uint32(buckets)], [doc]
    for k in range(1, run):
        crc = moved(shift, begin[k:], moved(after, np.zeros(1, np.int64), crc[:-1])) ^ spaced[k:]
        same = doc[k:] == doc[: len(doc) - k]
        out.append(crc[same] % np.uint32(buckets))
        docs.append(doc[k:][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(docs)


def totals(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, least: int = LEAST_WORDS) -> tuple[np.ndarray, int]:
    """The features per bucket of all rows, and how many rows have at least ``least`` words."""
    ship(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, total = Shifts(), np.zeros(buckets + 1, np.int64)
        for b in parts:
            for i in range(0, b.num_rows, 2000):
                for _, lists in batches_of(b.column(0).slice(i, 2000).to_pylist()):
                    total[:buckets] += np.bincount(buckets_of(lists, shifts, buckets)[0], minlength=buckets)
                    total[buckets] += sum(len(x) >= least for x in lists)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    vectors = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(run, "v binary").rdd.map(lambda r: np.frombuffer(r.v, np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64), 0
    got = vectors.treeReduce(lambda x, y: x + y)
    return got[:buckets], int(got[buckets])


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the log ratio of the two smoothed shares, rounded down."""
    n, s, t = len(corpus), corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, made of the id."""
    import hashlib

    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words``, ``n_features``, ``weight`` and ``score`` to each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def make() -> Callable:
        shifts, g = Shifts(), sent.value

        def fn(ids, texts):
            words, features, weight = [], [], []
            for _, lists in batches_of(texts):
                b, doc = buckets_of(lists, shifts, len(g))
                words += [len(x) for x in lists]
                features += np.bincount(doc, minlength=len(lists)).tolist()
                # Sums of whole numbers below 2^53 are exact in doubles.
                weight += np.bincount(doc, g[b].astype(float), len(lists)).astype(np.int64).tolist()
            return words, features, weight, [w + noise(i, seed) for i, w in zip(ids, weight)]

        return fn

    return add_columns(docs, [id_col, text_col], "n_words long, n_features long, weight long, score long", make, keep)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` per row; ``rank`` (from 1) is null for rows that are not drawn."""
    d = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    corpus, n = totals(d, "t", least=least)
    wanted, _ = totals(target, target_col, least=least)
    w = table(weigh(d, gains(corpus, wanted), "i", "t", seed, keep=["i"]), "weights")
    drawn = percent * n // 100
    fit = F.col("n_words") >= least
    # All rows are placed, the unfit ones last: a row number keeps repeated rows apart in the order.
    w = w.withColumn("row", F.monotonically_increasing_id())
    at = places(w, (~fit).cast("int"), F.desc("score"), F.asc_nulls_last("i"), "row")
    rank = F.when(fit & (F.col("place") < drawn), F.col("place") + 1)
    return at.select(F.col("i").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def brute(rows: list[tuple], target: list[str | None], percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> list[tuple]:
    """Plain reference for tests: ``(id, n_features, weight, score, rank)`` of each ``(id, text)``, feature by feature."""
    import hashlib
    import re

    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    def count(texts):
        out = [0] * BUCKETS
        for x in texts:
            for b in features(x)[1]:
                out[b] += 1
        return out

    s, t = count(x for _, x in rows), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + BUCKETS) / ((s[b] + 1) * (sum(t) + BUCKETS)))) for b in range(BUCKETS)]
    out, fit = [], []
    for i, (doc_id, text) in enumerate(rows):
        n, f = features(text)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        fit += [i] * (n >= least)
    fit.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    for r, i in enumerate(fit[: percent * len(fit) // 100]):
        out[i][4] = r + 1
    return [tuple(x) for x in out]

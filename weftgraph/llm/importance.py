"""Quality selection by importance resampling over hashed n-grams.

Two generative models of words and word pairs, hashed to ``BUCKETS`` classes: the target's, from documents labelled
good, and the raw one, from all documents. A document's log importance weight is the sum over its n-grams of the
log ratio of the two (additively smoothed) probabilities. Selection takes the k largest ``weight + Gumbel noise``,
which is sampling k documents without replacement in proportion to their weights; the noise of a document depends on
its id and the seed only, so selections are repeatable.

Scale: both models are vectors of fixed length. Tasks sum them over all their documents before one small exchange
(one row per task and slice of the vector). The k-th largest key is found by narrowing histograms of fixed size, and
so is the last place among the rows that tie with it; nothing is sorted in one place, and no document is left out of
the statistics. Which documents are good is known by the hashes of their ids: up to ``MOST_IDS`` of them go to every
task, so the texts stay where they are; a larger set is joined, at the cost of one shuffle of the texts.

Defined cases: null or empty text: no n-grams, weight 0. Rows with a null id have noise of a fixed id and rank by
key alone; repeated rows have equal keys, and where only some of them fit into the k, the first by their place in the
written table do: k rows are selected, exactly. No labelled rows: all weights are 0. k of 0 selects nothing; k beyond the number of rows, all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, add_columns, mix64, read, table

BUCKETS = 1 << 14
SMOOTHING = 1.0
SHARE = 0.5
SEED = 17
#: Good ids that may be sent to every task (64 MB); beyond it, they are joined.
MOST_IDS = 8_000_000
_SLICES = 16
_WORDS = bytes(LOWER[i] if i >= 0x80 or chr(i).isalnum() else 0x20 for i in range(256))


def ngram_counts(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each unigram and bigram of the texts, and the text it belongs to."""
    import xxhash

    number: dict[bytes, int] = {}
    words, sizes = [], []
    for t in texts:
        w = t.encode().translate(_WORDS).split() if t else []
        words += w
        sizes.append(len(w))
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    tok = h[at] if len(at) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    two = mix64(tok[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix64(tok[1:]))
    same = doc[1:] == doc[:-1]
    b = np.concatenate([mix64(tok), two[same]]) % np.uint64(buckets)
    return b.astype(np.int64), np.concatenate([doc, doc[1:][same]])


def bucket_totals(docs: DataFrame, text_col: str, good, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket, the n-grams of all rows and those of the good rows.

    ``good``: a boolean column, or (an id column, a broadcast sorted array of the good ids).
    """
    ids = None if isinstance(good, str) else good[1]
    d = docs.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{good if ids is None else good[0]}`").alias("g"))

    def run(batches):
        total = np.zeros((2, buckets))
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                k, doc = ngram_counts(part.column(0).to_pylist(), buckets)
                g = part.column(1)
                if ids is None:
                    w = np.array(g.fill_null(False).to_pylist(), float)
                else:
                    x, known = g.fill_null(0).to_numpy(zero_copy_only=False), ids.value
                    at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
                    w = ((known[at] == x) & g.is_valid().to_numpy(zero_copy_only=False)).astype(float) if len(known) else np.zeros(len(x))
                total[0] += np.bincount(k, minlength=buckets)
                total[1] += np.bincount(k, w[doc], minlength=buckets)
        step = buckets // _SLICES
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([total[:, i * step : (i + 1) * step].tobytes() for i in range(_SLICES)], pa.binary())], ["slice", "sums"])

    def add(t: pa.Table) -> pa.Table:
        s = np.sum([np.frombuffer(x, float) for x in t["sums"].to_pylist()], axis=0)
        return pa.table({"slice": t["slice"][:1].cast(pa.int32()), "sums": pa.array([s.tobytes()], pa.binary())})

    # One row of fixed size per task and slice; the result is 2 x BUCKETS numbers.
    rows = d.mapInArrow(run, "slice int, sums binary").groupBy("slice").applyInArrow(add, "slice int, sums binary").collect()
    out = np.zeros((2, buckets))
    step = buckets // _SLICES
    for r in rows:
        out[:, r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["sums"], float).reshape(2, step)
    return out


def log_ratios(totals: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    raw, target = totals
    if not target.sum():
        return np.zeros(len(raw))
    p = lambda x: np.log((x + smoothing) / (x.sum() + smoothing * len(x)))
    return p(target) - p(raw)


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Adds ``log_weight`` and ``sample_key`` (the weight plus Gumbel noise) to each row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def make() -> Callable:
        import xxhash

        r = sent.value

        def fn(ids, texts):
            b, doc = ngram_counts(texts, len(r))
            w = np.bincount(doc, r[b], len(texts)) if len(b) else np.zeros(len(texts))
            u = np.array([(xxhash.xxh3_64_intdigest(str(i).encode(), seed) >> 11) + 0.5 for i in ids]) / 2.0**53
            return w, w - np.log(-np.log(u))

        return fn

    return add_columns(docs, [id_col, text_col], "log_weight double, sample_key double", make)


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a double column, exactly, by narrowing histograms (no NaN)."""
    s = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi, above = s["lo"], s["hi"], 0
    while lo < hi:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        inside = df.where((F.col(col) >= lo) & (F.col(col) <= hi))
        h = inside.groupBy(F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(h, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return hi if lo == hi else lo


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float = SHARE, seed: int = SEED) -> DataFrame:
    """``(id, log_weight, sample_key, selected)`` per row; the share ``share`` of the rows is selected, exactly."""
    good = labels.where((F.col(f"`{label_col}`") == 1) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("i"))
    d = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    good = good.select(F.xxhash64("i").alias("k")).distinct()
    d = d.withColumn("k", F.xxhash64("i"))
    if good.limit(MOST_IDS + 1).count() <= MOST_IDS:
        ids = np.sort(good.toArrow()["k"].to_numpy())
        totals = bucket_totals(d.withColumn("k", F.when(F.col("i").isNotNull(), F.col("k"))), "t", ("k", d.sparkSession.sparkContext.broadcast(ids)))
    else:
        totals = bucket_totals(d.join(good.withColumn("g", F.lit(True)), "k", "left"), "t", "g")
    d = d.drop("k")
    w = table(weigh(d, log_ratios(totals), "i", "t", seed).drop("t").withColumn("place", F.monotonically_increasing_id()), "weights")
    n = w.count()
    k = math.floor(share * n)
    if k <= 0 or k >= n:
        return w.select(F.col("i").alias(id_col), "log_weight", "sample_key", F.lit(k > 0).alias("selected"))
    cut = kth_largest(w, "sample_key", k)
    above = w.where(F.col("sample_key") > cut).count()
    ties = w.where(F.col("sample_key") == cut).select((-F.col("place")).cast("double").alias("late"))
    last = -kth_largest(ties, "late", k - above)
    chosen = (F.col("sample_key") > cut) | ((F.col("sample_key") == cut) & (F.col("place").cast("double") <= last))
    return w.select(F.col("i").alias(id_col), "log_weight", "sample_key", chosen.alias("selected"))


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

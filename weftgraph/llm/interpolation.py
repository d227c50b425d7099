"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates: bigram ``c(v w) / c(v)``, unigram ``c(w) / N`` and uniform
``1 / (V + 1)``. The mixture weights depend on the bucket of the context's frequency ``c(v)`` (its binary logarithm)
and are learned by expectation-maximisation: a part of the training documents (``crc32(id) mod 7 = 3``) is deleted
from the counts and predicted with what remains; the expected shares of the components become the weights. For
scoring, the counts are those of all training documents.

A context that was never seen has no bigram estimate; its bucket mixes the other two components only, so that each
context's probabilities sum to one.

Scale: the text is shuffled once, into chunks that later passes read in place; counts of words and word pairs are
exchanged between chunks and ranges of keys (see ``exchange``), combined per chunk before any shuffle. EM reads a
histogram of the deleted events, bounded by the number of buckets and the quantisation of the two estimates (half
octaves), not by the corpus.

Defined cases: null or empty text: only the end token. A null id counts as training, never deleted or held out.
No training tokens: all counts are 0. Repeated rows each count and are scored each. Ids may be of any type that can be
ordered; other columns than id and text are left out, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, read, remainder, remainder_col, space_words
from .exchange import ASK, Exchange, by_chunk, dealt, trim

MOD, HELD_OUT, DELETED = 7, 2, 3
LEVELS = 24
_END, _START = np.uint64(0x5BF03635C1F6A3D1), np.uint64(0x9D39247E33776D41)
_ONE = np.uint64(1)
_UNSEEN = -200  # level of an estimate that is 0


def _read_chunk(t: pa.Table, id_col: str, text_col: str):
    """Tokens of a chunk: ids, number of tokens per document, sorted keys, and the place of each token's keys."""
    import xxhash

    ids = t[id_col].to_pylist()
    words, sizes = [], []
    for text in t[text_col].to_pylist():
        w = space_words(text)
        words += w
        words.append(b" ")  # no word has a blank: the end
        sizes.append(len(w) + 1)
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    if b" " in number:
        h[number[b" "]] = _END
    del words, number
    tok = h[at]
    sizes = np.array(sizes, np.int64)
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    if len(sizes):
        before[np.cumsum(sizes) - sizes] = _START
    one = mix64(tok) & ~_ONE
    two = mix64(before * np.uint64(0x9E3779B97F4A7C15) + mix64(tok)) | _ONE
    # The context's count is the word's own; documents count for the start.
    ctx = mix64(before) & ~_ONE
    keys, place = np.unique(np.concatenate([one, two]), return_inverse=True)
    n = len(tok)
    start = before == _START
    where = np.searchsorted(keys, ctx)
    return ids, sizes, keys, place[:n], place[n:], np.where(start, -1, np.minimum(where, len(keys) - 1))


def _flags(ids: list) -> tuple[np.ndarray, np.ndarray]:
    r = np.array([remainder(i, MOD) for i in ids])
    return r != HELD_OUT, r == DELETED


class Model:
    def __init__(self, n: int, v: int, docs: int, deleted_tokens: int, deleted_docs: int, weights: np.ndarray | None = None):
        self.n, self.v, self.docs, self.deleted_tokens, self.deleted_docs, self.weights = n, v, docs, deleted_tokens, deleted_docs, weights


def _estimates(keys, uni, bi, ctx, train, deleted, model, without: bool):
    """Context bucket and the two estimates of each token; ``without``: the deleted part taken off the counts."""
    c = train - deleted if without else train
    n = model.n - model.deleted_tokens if without else model.n
    docs = model.docs - model.deleted_docs if without else model.docs
    context = np.where(ctx < 0, docs, c[np.maximum(ctx, 0)]) if len(c) else np.zeros(0)
    p2 = np.where(context > 0, c[bi] / np.maximum(context, 1), 0.0)
    p1 = c[uni] / max(n, 1)
    bucket = np.minimum(np.log2(context + 1).astype(np.int64), LEVELS - 1)
    return bucket, p2, p1


def expectation_maximisation(cells: np.ndarray, v: int, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per bucket, from rows (bucket, events, p2, p1); no bigrams in bucket 0."""
    out = np.zeros((LEVELS, 3))
    fit = lambda n, p, w: [w := (n[:, None] * (w * p) / np.maximum((w * p).sum(1), 1e-300)[:, None]).sum(0) / max(n.sum(), 1e-300) for _ in range(rounds)][-1]
    p = np.column_stack([cells[:, 2], cells[:, 3], np.full(len(cells), 1 / (v + 1))]) if len(cells) else np.zeros((0, 3))
    flat = np.array([0.3, 0.5, 0.2])
    every = fit(cells[:, 1], p, flat) if len(cells) else flat
    every = np.maximum(every, 1e-4)
    every /= every.sum()
    for b in range(LEVELS):
        rows = cells[:, 0] == b if len(cells) else np.zeros(0, bool)
        # Few events: as if 100 more had gone the way of all buckets together.
        w = fit(cells[rows, 1], p[rows], every) if rows.any() else every
        n = cells[rows, 1].sum() if rows.any() else 0.0
        w = (n * w + 100 * every) / (n + 100)
        if b == 0:  # contexts that were not seen
            w[0] = 0
        out[b] = w / w.sum()
    return out


class Scored(NamedTuple):
    rows: DataFrame
    weights: np.ndarray


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: bool = False, chunk: int | None = None, exchange: dict | None = None) -> DataFrame | Scored:
    """Per row: id, ``held_out, n_tokens, n_known, train_tokens, base_score, score``; ``weights``: the learned ones, too.

    ``chunk`` (bytes of a chunk) and ``exchange`` (``bucket`` and ``fan`` of an Exchange) are for tests.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    id_type = dict(d.dtypes)["i"]
    # The deleted documents have chunks of their own, so that EM reads them alone.
    d, total = dealt(d, "i", "t", flag=remainder_col("i", MOD) == DELETED, chunk=chunk)
    d = d.select("__flag", "__chunk", "i", "t")

    def summary(distinct, train, deleted):
        uni = (distinct & _ONE) == 0
        return [int(train[uni].sum(dtype=np.int64)), int((train[uni] > 0).sum()), int(deleted[uni].sum(dtype=np.int64))]

    ex = Exchange(total // 12, [("u4", "sum"), ("u4", "sum")], summary, **exchange or {})

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        ids, sizes, keys, uni, bi, _ = _read_chunk(t, "i", "t")
        train, deleted = _flags(ids)
        counts = []
        for flag in (train, deleted):
            w = np.repeat(flag, sizes).astype(float)
            counts.append(np.bincount(uni, w, len(keys)) + np.bincount(bi, w, len(keys)))
        trim()
        return ex.pack(key[0].as_py(), keys, counts)

    told = ex.answers(d.groupBy("__chunk").applyInArrow(ask, ASK), "counts")
    r = remainder_col("i", MOD)
    g = d.agg(F.sum((r != HELD_OUT).cast("long")).alias("docs"), F.sum((r == DELETED).cast("long")).alias("deleted")).first()
    n, v, deleted_tokens = ex.totals
    model = Model(n, v, g["docs"] or 0, deleted_tokens, g["deleted"] or 0)
    small = "bucket int, q2 int, q1 int, n double, l2 double, l1 double"

    def events(m: Model):
        def run(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
            if not t.num_rows:
                return pa.table({k: pa.array([], ty) for k, ty in zip(("bucket", "q2", "q1", "n", "l2", "l1"), (pa.int32(),) * 3 + (pa.float64(),) * 3)})
            ids, sizes, keys, uni, bi, ctx = _read_chunk(t, "i", "t")
            train, deleted = ex.unpack(told, keys)
            bucket, p2, p1 = _estimates(keys, uni, bi, ctx, train.astype(np.int64), deleted.astype(np.int64), m, True)
            with np.errstate(divide="ignore"):
                l2, l1 = np.log2(p2), np.log2(p1)
            q2 = np.where(p2 > 0, np.floor(2 * np.maximum(l2, -90)), _UNSEEN).astype(np.int64)
            q1 = np.where(p1 > 0, np.floor(2 * np.maximum(l1, -90)), _UNSEEN).astype(np.int64)
            cell = (bucket * 512 + q2 + 256) * 512 + q1 + 256
            u, at = np.unique(cell, return_inverse=True)
            sums = [np.bincount(at, np.where(np.isfinite(x), x, 0.0), len(u)) for x in (np.ones(len(at)), l2, l1)]
            return pa.table({"bucket": pa.array((u // 512 // 512).astype(np.int32)), "q2": pa.array((u // 512 % 512 - 256).astype(np.int32)), "q1": pa.array((u % 512 - 256).astype(np.int32)), "n": sums[0], "l2": sums[1], "l1": sums[2]})

        return run

    def part(rows: DataFrame, told: DataFrame, fn, ddl: str) -> DataFrame:
        return rows.groupBy("__chunk").cogroup(by_chunk(told)).applyInArrow(fn, ddl)

    flagged = lambda c: F.shiftright(c, 61) == 1
    gone = part(d.where("__flag = 1"), told.where(flagged("chunk")), events(model), small)
    cells = gone.groupBy("bucket", "q2", "q1").agg(*[F.sum(c).alias(c) for c in ("n", "l2", "l1")]).collect()
    x = np.array([(c.bucket, c.n, 2 ** (c.l2 / c.n) if c.q2 > _UNSEEN else 0.0, 2 ** (c.l1 / c.n) if c.q1 > _UNSEEN else 0.0) for c in cells]).reshape(-1, 4)
    model.weights = expectation_maximisation(x, model.v)
    ddl = f"i {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def final(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        ids, sizes, keys, uni, bi, ctx = _read_chunk(t, "i", "t")
        train = ex.unpack(told, keys)[0].astype(np.int64)
        bucket, p2, p1 = _estimates(keys, uni, bi, ctx, train, train, model, False)
        w = model.weights[bucket]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (model.v + 1)
        c = train[uni]
        at = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0)
        base = np.log10((c + 1) / (model.n + model.v + 1))
        held = [remainder(i, MOD) == HELD_OUT for i in ids]
        cols = [t["i"], pa.array(held), pa.array(sizes), pa.array(add((c > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(ids), model.n)), pa.array(add(base), pa.float64()), pa.array(add(np.log10(p)), pa.float64())]
        trim()
        return pa.table(cols, ["i", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = part(d, told, final, ddl).withColumnRenamed("i", id_col)
    return Scored(out, model.weights) if weights else out


def op1_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every benchmark item gives windows of ``width`` consecutive words (an item of fewer words, but not none, is one
window). The windows are the patterns. For each pattern length, a shift table over blocks of two words says how
far the search may jump; where the shift is zero, the suffix block selects a bucket, the first block of the window
selects the test strings in it, and direct comparison confirms an occurrence.

Scale: documents are scanned in place, without a shuffle. A benchmark of up to ``shard_bytes`` of text is one scan; a
larger one is dealt into shards by hash, each collected, sent and scanned in a pass of its own whose marks are written
to the shared folder, so that the driver and the tasks hold one shard at a time however large the benchmark is.

Defined cases: null or empty text: no words, no hits. Null or empty items have no windows. Items without an id
mark words but are not listed. Repeated items and rows count as themselves. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, add_columns, discard, read, table

WIDTH = 10
SHARD_BYTES = 16 << 20
#: Bytes that are not part of a word, as blanks; letters A-Z lowered.
_TO_WORDS = bytes(LOWER[i] if i >= 0x80 or chr(i).isalnum() else 0x20 for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of everything beyond U+007F, A-Z lower-cased."""
    return text.encode().translate(_TO_WORDS).split() if text else []


class WuManber:
    """Searcher for patterns (word tuples) of one length ``m``."""

    def __init__(self, m: int, patterns: Iterable[tuple[tuple[bytes, ...], int]]):
        self.m, self.block = m, min(2, m)
        b = self.block
        self.shift: dict = {}
        self.bucket: dict = {}
        for p, item in patterns:
            for end in range(b, m + 1):
                k = p[end - b : end]
                s = m - end
                if s < self.shift.get(k, m - b + 1):
                    self.shift[k] = s
            self.bucket.setdefault(p[m - b :], {}).setdefault(p[:b], {}).setdefault(p, set()).add(item)

    def search(self, t: list[bytes]) -> list[tuple[int, set[int]]]:
        """(start, items) of each occurrence in the words ``t``."""
        m, b, n, found = self.m, self.block, len(t), []
        get, bucket, far = self.shift.get, self.bucket, m - b + 1
        i = m
        if b == 1:
            for j, w in enumerate(t):
                if (w,) in bucket:
                    found.append((j, bucket[(w,)][(w,)][(w,)]))
            return found
        while i <= n:
            s = get((t[i - 2], t[i - 1]), far)
            if s:
                i += s
                continue
            tests = bucket[(t[i - 2], t[i - 1])].get((t[i - m], t[i - m + 1]))
            if tests:
                at = i - m
                items = tests.get(tuple(t[at:i]))
                if items:
                    found.append((at, items))
            i += 1
        return found


def windows(ws: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    if not ws:
        return []
    return [tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))]


def searchers(items: list[tuple[object, str | None]], width: int) -> list[WuManber]:
    by: dict[int, list] = {}
    for item, text in items:
        for p in windows(words(text), width):
            by.setdefault(len(p), []).append((p, item))
    return [WuManber(m, ps) for m, ps in sorted(by.items())]


def scan(t: list[bytes], finders: list[WuManber]) -> tuple[np.ndarray, set]:
    """Which words are hit, and the items whose windows occur."""
    delta, items = np.zeros(len(t) + 1, np.int32), set()
    for f in finders:
        for at, which in f.search(t):
            delta[at] += 1
            delta[at + f.m] -= 1
            items |= which
    return np.cumsum(delta[:-1]) > 0, items


def _shards(benchmark: DataFrame, item_col: str, text_col: str, shard_bytes: int) -> Iterator[tuple[list[tuple], bool]]:
    """The benchmark in lists of about ``shard_bytes`` of text, one at a time, and whether it is the last."""
    b = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    total = b.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = -(-total // shard_bytes) if total > shard_bytes else 1
    shard = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        yield [(r.i, r.t) for r in (b.where(shard == k) if n > 1 else b).collect()], k == n - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` (sorted as strings) and ``contaminated`` to each row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    cols = [c for c in docs.columns if c.lower() not in {"__mask", "__items"}]
    df, before = docs, None
    for k, (shard, last) in enumerate(_shards(benchmark, item_col, item_text_col, shard_bytes)):
        sent = sc.broadcast((shard, width))
        first = k == 0

        def make(sent=sent, first=first, last=last):
            finders = searchers(*sent.value)

            def fn(texts, masks=None, before=None):
                n_words, n_hit, masks_out, items_out = [], [], [], []
                for j, text in enumerate(texts):
                    t = words(text)
                    hit, items = scan(t, finders)
                    names = {str(x) for x in items if x is not None}
                    if not first:
                        if masks[j]:
                            hit |= np.unpackbits(np.frombuffer(masks[j], np.uint8), count=len(t)).astype(bool)
                        names.update(before[j])
                    n_words.append(len(t))
                    n_hit.append(int(hit.sum()))
                    items_out.append(sorted(names))
                    masks_out.append(None if last else np.packbits(hit).tobytes())
                if last:
                    return n_words, n_hit, items_out, [n > 0 for n in n_hit]
                return masks_out, items_out

            return fn

        ins = [text_col] if first else [text_col, "__mask", "__items"]
        outs = "n_words long, n_hit long, items array<string>, contaminated boolean" if last else "__mask binary, __items array<string>"
        df = add_columns(df, ins, outs, make, keep=cols)
        if not last:
            df = table(df, "marks")
            if before is not None:
                discard(before)
            before = df
            sent.destroy()
    return df


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    d = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, most: float = 0.0) -> DataFrame:
    """Keeps the documents of which at most the share ``most`` of the words is hit by benchmark windows."""
    d = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return d.where(F.col("n_hit") <= most * F.col("n_words")).select(*docs.columns)


def brute(text: str | None, items: list[tuple[object, str | None]], width: int = WIDTH) -> tuple[int, int, list[str]]:
    """Plain reference for tests: compares every window at every position."""
    t, hit, names = words(text), set(), set()
    for item, x in items:
        for p in windows(words(x), width):
            for at in range(len(t) - len(p) + 1):
                if tuple(t[at : at + len(p)]) == p:
                    hit.update(range(at, at + len(p)))
                    names.add(str(item))
    return len(t), len(hit), sorted(names)

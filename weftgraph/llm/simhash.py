"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius by bit-sliced comparison.

A document's shingles are its runs of four words (A-Z lower-cased, joined by one space, repeats included; with fewer words
the whole sequence); a fingerprint's bit is set if it is set in more than half of the shingles' XXH64 values. Documents
link when their fingerprints differ in at most ``RADIUS`` bits; a component is what links connect.

1. Fingerprints are made batch by batch where the texts are; only (id, fingerprint) goes on. Equal fingerprints are one
   from here on, so copies, however many, cost one row.
2. The 64 bits are cut into ``RADIUS + k`` parts; two fingerprints within the radius agree in at least ``k`` of them. Each
   fingerprint is offered under every choice of ``k`` parts, so linked ones share a bucket. ``k`` grows with the number
   of fingerprints, so that a bucket of random ones stays small; whatever it is, no link is lost.
3. Buckets are compared bit-sliced: plane j holds bit j of 64 members in one word. For a member, each plane is flipped where
   its own bit is set, which leaves a one wherever a member differs; the ones are added up in counters that are themselves
   sliced, two planes at a time through a carry-save adder. After every eight planes, rows whose members all exceed the
   radius are abandoned. Many small buckets are compared in one sweep. Buckets of more than ``LARGE`` members are cut into
   blocks by hash, and each pair of blocks is a group of its own.
4. A comparison gives a spanning forest of what it has linked, never the pairs; components are found by shuffles.

Scale: what is shuffled is some bytes per fingerprint and choice of parts (5 at up to 16 million fingerprints, 15 beyond,
35 beyond 4 thousand million). A bucket's comparisons grow with the square of its different fingerprints, 64 of them in
one machine word; blocks of a large bucket are spread over tasks.

Defined cases: null, empty or blank text: fingerprint zero, linked like any other. A row with a null id takes part; its
component is the smallest id reachable, null if there is none. Repeated rows get a row each. Ids may be of any type that has
an order. An empty table gives an empty result; columns beside id and text are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, components, discard, read, ship, space_words, table

WIDTH, RADIUS, SEED = 4, 4, 42
#: Members of a bucket that one group compares at once.
LARGE = 4096
#: Fingerprints of a group of buckets.
CELL = 1 << 14
#: A bucket of random fingerprints has at most about so many.
CROWD = 2000
_SLICE = 1 << 18


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc, x: np.ndarray) -> np.ndarray:
    return _turn(acc + x * _P2, 31) * _P1


def xxh64_of_length(text: np.ndarray, at: np.ndarray, length: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the substrings of one length that begin at ``at``; ``text``: bytes, with seven or more behind the last."""
    eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    n, p = np.uint64(seed), at
    with np.errstate(over="ignore"):
        if length >= 32:
            v = [np.full(len(at), x, np.uint64) for x in (n + _P1 + _P2, n + _P2, n, n - _P1)]
            for _ in range(length // 32):
                v = [_round(x, eight[p + 8 * k]) for k, x in enumerate(v)]
                p = p + 32
            h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                h = (h ^ _round(np.uint64(0), x)) * _P1 + _P4
        else:
            h = np.full(len(at), n + _P5, np.uint64)
        h = h + np.uint64(length)
        for _ in range(length % 32 // 8):
            h = _turn(h ^ _round(np.uint64(0), eight[p]), 27) * _P1 + _P4
            p = p + 8
        if length % 8 >= 4:
            h = _turn(h ^ ((eight[p] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            p = p + 4
        for _ in range(length % 4):
            h = _turn(h ^ (text[p].astype(np.uint64) * _P5), 11) * _P1
            p = p + 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def xxh64_many(text: bytes, at: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many substrings: those of a common length together, the others one by one."""
    import xxhash

    padded = np.frombuffer(text + bytes(8), np.uint8)
    out = np.zeros(len(at), np.uint64)
    order = np.argsort(length, kind="stable")
    cut = np.flatnonzero(np.diff(length[order], prepend=-1))
    for lo, hi in zip(cut, [*cut[1:], len(order)]):
        own, n = order[lo:hi], int(length[order[lo]])
        if len(own) >= 32 and n < 4096:
            out[own] = xxh64_of_length(padded, at[own], n, seed)
        else:
            out[own] = [xxhash.xxh64_intdigest(text[a : a + n], seed) for a in at[own].tolist()]
    return out


def fingerprints_of(texts: list[str | None], width: int = WIDTH) -> np.ndarray:
    """A fingerprint per text."""
    out, lo = [np.zeros(0, np.uint64)], 0
    while lo < len(texts):  # about a megabyte of words at a time
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < 1 << 20):
            size += len(texts[hi] or "")
            hi += 1
        out.append(_fingerprints_of(texts[lo:hi], width))
        lo = hi
    return np.concatenate(out)


def _fingerprints_of(texts: list[str | None], width: int) -> np.ndarray:
    lists = [space_words(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    words = [w for x in lists for w in x]
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.r_[0, ends[:-1]] if len(words) else ends
    # A shingle begins at each word that has enough words of its text behind it; a short text is one shingle.
    first = np.cumsum(sizes) - sizes
    each = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(texts)), each)
    word = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each) + first[doc]
    at, length = begins[word], ends[word + np.minimum(sizes, width)[doc] - 1] - 1 - begins[word]
    ones = np.zeros((len(texts), 64), np.int64)
    for lo in range(0, len(doc), _SLICE):
        own = doc[lo : lo + _SLICE]
        h = xxh64_many(text, at[lo : lo + _SLICE], length[lo : lo + _SLICE])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.ascontiguousarray(np.packbits(2 * ones > each[:, None], axis=1, bitorder="little")).view("<u8").astype(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(i, fp)``: the fingerprint as a signed long."""

    def make():
        def fn(texts):
            return [fingerprints_of(texts, width).view(np.int64).tolist()]

        return fn

    d = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    return add_columns(d, ["t"], "fp long", make, keep=["i"])


# --- bit-sliced comparison ---


def planes_of(fps: np.ndarray) -> np.ndarray:
    """``(64, words)``: bit k of word w of plane j is bit j of member ``64 w + k``."""
    n = -(-len(fps) // 64) * 64
    x = np.zeros(n, np.uint64)
    x[: len(fps)] = fps
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def within(planes: np.ndarray, block: np.ndarray, own: np.ndarray, open_: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have members within the radius, and those members.

    ``planes``: (64, blocks, words); ``block``: each row's block; ``own``: each row's fingerprint; ``open_``: (rows, words),
    the members to compare with. Rows none of whose members can be within the radius any more are dropped every eight planes.
    """
    rows = np.arange(len(own))
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    count = [np.zeros_like(open_) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros_like(open_)
    alive = open_
    for j in range(0, 64, 2):
        a, b = (planes[k][block] ^ np.where((own >> np.uint64(k)) & np.uint64(1), every, np.uint64(0))[:, None] for k in (j, j + 1))
        either = a ^ b
        carry = (a & b) | (count[0] & either)
        count[0] = count[0] ^ either
        for k in range(1, len(count)):
            carry, count[k] = count[k] & carry, count[k] ^ carry
        over |= carry
        if j % 8 == 6:
            beyond, equal = over.copy(), np.full_like(over, every)
            for k in reversed(range(len(count))):
                if radius >> k & 1:
                    equal &= count[k]
                else:
                    beyond |= equal & count[k]
                    equal &= ~count[k]
            alive = open_ & ~beyond
            stay = alive.any(1)
            if not stay.all():
                rows, block, own, open_, over, alive = rows[stay], block[stay], own[stay], open_[stay], over[stay], alive[stay]
                count = [c[stay] for c in count]
            if not len(rows):
                break
    return rows, alive


def members(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and member of each set bit."""
    return np.nonzero(np.unpackbits(np.ascontiguousarray(alive).astype("<u8").view(np.uint8).reshape(len(alive), 8 * alive.shape[1]), axis=1, bitorder="little"))


def connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the place of a smaller or equal member of its set) after joining the sets of ``a`` and ``b``."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def link_buckets(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within buckets of equal keys: pairs of fingerprints."""
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.r_[cut, len(keys)])
    a, b = [], []
    few = (size > 1) & (size <= 64)
    if few.any():  # one word per bucket, all of them at once
        at, n = cut[few], size[few]
        rows = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(at, n) + nth
        padded = np.zeros(len(n) * 64, np.uint64)
        padded[rows * 64 + nth] = fps[place]
        later = np.uint64(0xFFFFFFFFFFFFFFFF) << nth.astype(np.uint64) << np.uint64(1)
        later[nth == 63] = 0
        there = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - n[rows].astype(np.uint64))
        got, alive = within(planes_of(padded)[:, :, None], rows, fps[place], (later & there)[:, None], radius)
        r, m = members(alive)
        a.append(place[got[r]])
        b.append(at[rows[got[r]]] + m)
    label = connect(np.arange(len(keys)), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(keys))
    for at, n in zip(cut[size > 64].tolist(), size[size > 64].tolist()):
        label[at : at + n] = at + link_block(fps[at : at + n], fps[at : at + n], radius, same=True)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return fps[moved], fps[label[moved]]


def link_block(x: np.ndarray, y: np.ndarray, radius: int = RADIUS, same: bool = False, step: int = 256) -> np.ndarray:
    """Labels of the members of ``x`` followed by ``y`` (``same``: of ``x``, compared among themselves)."""
    label = np.arange(len(x) if same else len(x) + len(y))
    planes = planes_of(y)[:, None, :]
    there = np.zeros(planes.shape[2] * 64, np.uint8)
    there[: len(y)] = 1
    there = np.packbits(there, bitorder="little").view("<u8").astype(np.uint64)
    for lo in range(0, len(x), step):
        own = x[lo : lo + step]
        got, alive = within(planes, np.zeros(len(own), np.int64), own, np.repeat(there[None], len(own), 0), radius)
        r, m = members(alive)
        label = connect(label, lo + got[r], m if same else len(x) + m)
    return label


# --- the join ---


def choices(n: int, radius: int = RADIUS, crowd: int = CROWD) -> list[int]:
    """Masks of bits, one of which any two fingerprints within the radius share, for ``n`` fingerprints."""
    k = 1
    while k < 4 and n > crowd << (64 * k // (radius + k)):
        k += 1
    ends = [64 * i // (radius + k) for i in range(radius + k + 1)]
    part = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(ends, ends[1:])]
    return [sum(c) for c in itertools.combinations(part, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(fps: DataFrame, n: int, radius: int = RADIUS, crowd: int = CROWD, large: int = LARGE, cell: int = CELL) -> DataFrame:
    """Pairs of distinct fingerprints (``fp``, of which there are ``n``) that connect whatever is linked."""
    masks = choices(n, radius, crowd)
    slots = max(1, -(-n // cell))
    offer = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    keys = table(fps.select("fp", offer.alias("x")).select("x.choice", "x.key", "fp"), "keys")
    crowded = table(keys.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > large), "crowded")
    u = lambda t, c: t[c].to_numpy().view(np.uint64)

    def link(t: pa.Table) -> pa.Table:
        return _pairs(*link_buckets(u(t, "key"), u(t, "fp"), radius))

    def cross(t: pa.Table) -> pa.Table:
        fp, side = u(t, "fp"), t["side"].to_numpy()
        x, y = fp[side <= 1], fp[side == 2]
        every = x if not len(y) else np.concatenate([x, y])
        label = link_block(x, x if not len(y) else y, radius, same=not len(y)) if (side == 0).any() or len(y) else np.arange(len(x))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return _pairs(every[moved], every[label[moved]])

    plain, some = keys, crowded.limit(1).count() > 0
    if some:
        plain = keys.join(crowded, ["choice", "key"], "left_anti")
    out = plain.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots))).groupBy("choice", "slot").applyInArrow(lambda t: link(t), "a long, b long")
    if some:
        blocks = F.ceil(F.col("size") / F.lit(large)).cast("int")
        d = keys.join(crowded, ["choice", "key"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        # A block meets itself (side 0), and each other one, as the first (side 1) or the second (side 2) of the pair.
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        d = d.withColumn("with", other).select("choice", "key", "fp", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), F.when(F.col("block") == F.col("with"), 0).when(F.col("block") < F.col("with"), 1).otherwise(2).alias("side"))
        out = out.union(d.groupBy("choice", "key", "x", "y").applyInArrow(lambda t: cross(t), "a long, b long"))
    got = table(out, "links")
    discard(keys, crowded)
    return got


def near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, **sizes) -> DataFrame:
    """``(id, fingerprint, component_id)`` per row. ``sizes``: ``crowd``, ``large`` and ``cell`` of ``links``, for tests."""
    ship(docs.sparkSession)
    each = table(fingerprints(docs, id_col, text_col, width), "fingerprints")
    lowest = table(each.groupBy("fp").agg(F.min("i").alias("low")), "distinct")
    found = links(lowest.select("fp"), lowest.count(), radius, **sizes)
    groups = components(found).select(F.col("id").alias("fp"), "component")
    own = lowest.join(groups, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    own = table(own, "classes")
    least = own.groupBy("component").agg(F.min("low").alias("component_id"))
    named = table(own.join(least, "component").select("fp", "component_id"), "names")
    discard(lowest, found, own)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return each.join(named, "fp").select(F.col("i").alias(id_col), digits.alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def brute(rows: list[tuple], radius: int = RADIUS) -> list[tuple]:
    """Plain reference for tests: ``(id, fingerprint, component)`` of each ``(id, text)``, over all pairs."""
    import re

    import xxhash

    fps = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64(x.encode(), 42).intdigest() for x in s]
        fps.append(sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), doc_id) if x is not None), default=None)
    return [(doc_id, f"{fps[i]:016x}", low[find(i)]) for i, (doc_id, _) in enumerate(rows)]

"""Removal of byte strings that repeat, from longest-previous-factor values cut off at the minimum length.

For a start position s, LPF(s) is the length of the longest string starting at s that also starts at an earlier
position. In suffix order, the earlier matches of s are found at the previous and next smaller positions; ``lpf``
computes the array of one string that way. Over a corpus only one thing is asked of it: whether LPF(s) (or its
counterpart with later positions) reaches ``length``. Suffix order may therefore be cut off at that depth, and the
order among unequal beginnings is free: positions are ordered by the 64-bit fingerprint of their next ``length``
bytes, equal strings lie next to each other, and the smallest position of such a run is the first copy. That needs
no suffix array over the whole corpus in one place, which no machine could hold (see the README for figures).

Not every position is sorted. Among each ``WIN`` neighbouring ``GRAM``-byte strings the one with the least hash is an
anchor; equal texts have equal anchors. Chunks of documents ask (see ``exchange``) how often their anchors, and the
spans of consecutive anchors that cover whole runs of windows, occur. A window with an anchor that occurs once
occurs once; windows inside a repeated span are repeated. Only the windows left over are asked about one by one, in
a second exchange. The text is shuffled once, into chunks that all passes read in place; keys are combined per chunk
before they are shuffled, so a passage in a third of all documents costs one entry per chunk.

The anchors also tell, at no further cost, where shorter strings repeat: ``shared`` are the bytes within repeated
anchors, ``longest_shared`` the longest run of them. Every string of ``GRAM + WIN - 1`` bytes (200) that repeats holds
an anchor that does.

Defined cases: null or empty text: no bytes. Documents shorter than ``length`` bytes lose nothing. Matches do not
cross documents; overlapping matches in one document count. "First" is the smallest id (null ids before all), then
an arbitrary but fixed order of the rows of one id, then the smallest position. Repeated rows are copies of each
other. Ids may be of any type that can be ordered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, read
from .exchange import ASK, Exchange, by_chunk, dealt, trim

LENGTH, GRAM, WIN = 400, 150, 51
SEGMENT = 1 << 17
_R = 0xD1342543DE82EF95
_RINV = pow(_R, -1, 1 << 64)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ONE = np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def lpf(text: bytes) -> np.ndarray:
    """The longest-previous-factor array of one string, by suffix array, LCP and previous/next smaller positions."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    rank = np.frombuffer(text, np.uint8).astype(np.int64)
    h = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - h] = rank[h:]
        sa = np.lexsort((second, rank))
        step = (np.diff(rank[sa]) != 0) | (np.diff(second[sa]) != 0)
        rank = np.empty(n, np.int64)
        rank[sa] = np.concatenate([[0], np.cumsum(step)])
        if rank[sa[-1]] == n - 1 or h >= n:
            break
        h *= 2
    lcp, k = [0] * (n + 1), 0  # lcp[i]: of the suffixes at i - 1 and i in order
    for i in range(n):
        if rank[i] == 0:
            k = 0
            continue
        j = int(sa[rank[i] - 1])
        while i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        lcp[rank[i]] = k
        k = max(0, k - 1)
    out, stack = np.zeros(n, np.int64), []
    order = [*sa.tolist(), -1]
    for i, p in enumerate(order):
        low = lcp[i]
        # Whoever leaves the stack has its next smaller position here; below it lies its previous smaller one.
        while stack and stack[-1][0] > p:
            q, before = stack.pop()
            out[q] = max(before, low)
            low = min(low, before)
        stack.append((p, low))
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, r in enumerate((_R, _RINV)):
            p = np.full(n, r, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i with a whole window."""
    have, y = 1, x
    while have * 2 <= w:
        y = np.minimum(y[: len(y) - have], y[have:])
        have *= 2
    return np.minimum(y[: len(x) - w + 1], y[w - have : w - have + len(x) - w + 1]) if w > have else y[: len(x) - w + 1]


def scale(length: int) -> tuple[int, int]:
    """Bytes of an anchor, and the number of neighbouring places among which one is chosen."""
    gram = max(1, min(GRAM, length * 3 // 4))
    return gram, min(WIN, length - gram + 1)


class Segment:
    """Several pieces of text (whole documents, or parts of a long one with what lies around them), hashed at once."""

    def __init__(self, pieces: list[tuple[int, int, int, int, bool, bool, bytes]], length: int):
        """pieces: (document, offset of the bytes, first and last + 1 place they own, whether they reach the document's
        beginning and its end, bytes); each has room for an anchor."""
        gram, win = scale(length)
        self.length = length
        raw = np.frombuffer(b"".join(p[-1] for p in pieces), np.uint8)
        n = len(raw)
        self.raw, self.n = raw, n
        s, inverse = self._prefix()
        h = mix64((s[gram:] - s[:-gram]) * inverse[: n - gram + 1])
        at = np.arange(len(h), dtype=np.uint64)
        chosen = (_sliding_min((mix64(h) & ~_LOW) | at, win) & _LOW).astype(np.int64)
        del s, at
        sizes = np.array([len(p[-1]) for p in pieces])
        first = np.cumsum(sizes) - sizes
        self.first, self.of = first, [(d, o) for d, o, *_ in pieces]
        own = np.array([(a - o, z - o) for _, o, a, z, *_ in pieces]) + first[:, None]
        rooms = sizes - (gram + win - 1) + 1
        self.rooms, self.gram, self.win = rooms, gram, win
        chosen = chosen[self.room]
        anchor = np.unique(chosen)
        self.anchor_at = anchor
        self.piece = np.searchsorted(first, anchor, "right") - 1
        self.mark = h[anchor] & ~_ONE
        self.owned = (anchor >= own[self.piece, 0]) & (anchor < own[self.piece, 1])
        low, high = own[:, 0], np.minimum(own[:, 1], first + sizes - length + 1)
        self.windows = low, np.maximum(0, high - low)
        number = np.zeros(len(h), np.int32)
        number[anchor] = np.arange(len(anchor))
        self.chosen = number[chosen]
        # Spans: from an anchor to the first one whose bytes end where the last window before the next anchor ends.
        m = len(anchor)
        i = np.arange(max(0, m - 1))
        j = np.searchsorted(anchor, anchor[1:] - 1 + length - gram, "left")
        ok = (j < m) & (self.piece[1:] == self.piece[:-1])
        i, j = i[ok], j[ok]
        # Near a cut, anchors may be missing: chains there are left to the neighbouring piece.
        begin = np.array([p[4] for p in pieces])
        end = np.array([p[5] for p in pieces])
        q = self.piece[i]
        ok = (self.piece[j] == q) & (begin[q] | (anchor[i] >= first[q] + win - 1)) & (end[q] | (anchor[j] + gram + win - 1 <= first[q] + sizes[q]))
        i, j = i[ok], j[ok]
        step = np.diff(anchor, prepend=0).astype(np.uint64)
        item = mix64(self.mark ^ mix64(step + np.uint64(0x632BE59BD9B4E019)))
        pm, im = _powers(m + 1)
        acc = np.zeros(m + 1, np.uint64)
        np.cumsum(item * pm[:m], out=acc[1:])
        body = (acc[j + 1] - acc[i + 1]) * im[np.minimum(i + 1, m)]
        self.span = mix64(body ^ mix64(self.mark[i] + _ONE)) | _ONE
        self.span_owned = self.owned[i]
        self.low, self.high = anchor[i], anchor[j] + gram - length + 1

    def _prefix(self) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = _powers(self.n + 1)
        s = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_TABLE[self.raw] * power[: self.n], out=s[1:])
        return s, inverse

    @property
    def room(self) -> np.ndarray:
        """The places at which an anchor was chosen within one piece."""
        return _ranges(self.first, self.rooms)

    @property
    def start(self) -> np.ndarray:
        """The windows that the pieces own."""
        return _ranges(*self.windows)

    def keys(self) -> list[np.ndarray]:
        """The anchors and spans that count here."""
        return [self.mark[self.owned], self.span[self.span_owned]]

    def covered(self, which: np.ndarray) -> np.ndarray:
        """The windows within any of the marked spans."""
        d = np.zeros(self.n + 2, np.int32)
        np.add.at(d, self.low[which], 1)
        np.add.at(d, self.high[which], -1)
        return np.cumsum(d)[self.start] > 0

    def least(self, many: np.ndarray) -> np.ndarray:
        """The least number of occurrences among the anchors chosen inside each window."""
        x = np.full(self.n, 255, np.uint8)
        x[self.room] = many[self.chosen]
        got = _sliding_min(x, self.length - (self.gram + self.win - 1) + 1)
        return got[self.start] if len(got) else np.zeros(0, np.uint8)

    def whole(self, which: np.ndarray) -> np.ndarray:
        """Fingerprints of whole windows."""
        if not len(which):
            return np.zeros(0, np.uint64)
        at = self.start[which]
        s, inverse = self._prefix()
        return mix64((s[at + self.length] - s[at]) * inverse[at])

    def place(self, at: int) -> tuple[int, int]:
        """The document of a place in the joined bytes, and the place in it."""
        p = int(np.searchsorted(self.first, at, "right")) - 1
        d, offset = self.of[p]
        return d, int(at - self.first[p]) + offset

    def places(self, at: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(document, places in it) of sorted places in the joined bytes."""
        out = []
        if len(at):
            piece = np.searchsorted(self.first, at, "right") - 1
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(piece)) + 1):
                p = int(piece[part[0]])
                d, offset = self.of[p]
                out.append((d, at[part] - self.first[p] + offset))
        return out


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] of them), first[1], ..."""
    n = np.maximum(sizes, 0)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _segments(texts: list[bytes], length: int):
    gram, win = scale(length)
    before, after = 3 * win, length + 3 * win + gram
    pieces, size = [], 0
    for d, t in enumerate(texts):
        if len(t) < gram + win - 1:
            continue
        for lo in range(0, len(t), SEGMENT):
            a, z = max(0, lo - before), min(len(t), lo + SEGMENT + after)
            if z - a < gram + win - 1:
                a = max(0, z - (gram + win - 1))
            pieces.append((d, a, lo, min(len(t), lo + SEGMENT), a == 0, z == len(t), t[a:z]))
            size += z - a
            if size >= SEGMENT:
                yield Segment(pieces, length)
                pieces, size = [], 0
    if pieces:
        yield Segment(pieces, length)


def _ordered(t: pa.Table, id_col: str, text_col: str) -> tuple[pa.Table, list[bytes]]:
    """The chunk in the order that says which copy is the first."""
    keys = pa.table([pc.is_valid(t[id_col]), t[id_col], t[text_col]], ["known", "id", "text"])
    t = t.take(pc.sort_indices(keys, [("known", "ascending"), ("id", "ascending"), ("text", "ascending")]))
    return t, [(x or "").encode() for x in t[text_col].to_pylist()]


def _at(keys: np.ndarray, told: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    return told[np.searchsorted(distinct, keys)] if len(distinct) else np.zeros(len(keys), told.dtype)


def _later(keys: np.ndarray, code: np.ndarray, first: bool) -> np.ndarray:
    """Which occurrences, in order, go: those with an earlier one (``first``), or with any other."""
    if not first:
        return code > 0
    _, index = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[index] = False
    return (code == 2) | ((code == 1) & again)


def _count(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
    return k, np.minimum(n, 255).astype(np.uint8)


#: What is known of a key: occurrences (255: or more), and the first chunk that holds it.
FACTS = [("u1", "sum"), ("i8", "min")]


class _Chunk:
    """The passes over a chunk: each starts from its rows again, and holds some eight bytes for each byte of them."""

    def __init__(self, number: int, texts: list[bytes], length: int, first: bool):
        self.number, self.texts, self.length, self.first = number, texts, length, first
        self.segments = list(_segments(texts, length))

    def _facts(self, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return keys, [n, np.full(len(keys), self.number, np.int64)]

    def ask_anchors(self) -> tuple[np.ndarray, list[np.ndarray]]:
        return self._facts(*_count([k for s in self.segments for k in s.keys()]))

    def codes(self, told: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """0: one occurrence in all; 1: several, the first in this chunk; 2: several, one in an earlier chunk. And how many."""
        many, low = told
        return np.where(many > 1, np.where(low == self.number, 1, 2), 0).astype(np.uint8), many

    def windows(self, told: list[np.ndarray], distinct: np.ndarray):
        """(segment, which anchors repeat, windows known to go, places and keys of windows to be asked about) in order.

        Windows within a repeated span are known to repeat. Of all places of the span one, the first, stands for it:
        its windows are asked about all the same, so that an equal window outside such spans meets them. Where each
        occurrence of an anchor of the window lies in an occurrence of the span, there is no such window.
        """
        seen: dict[int, tuple[int, int]] = {}
        every = self.codes(told)
        for s in self.segments:
            many = _at(s.mark, every[1], distinct)
            code, often = (_at(s.span, x, distinct) for x in every)
            stands = np.zeros(len(code), bool)
            for t in np.flatnonzero(code == 1).tolist():
                here = s.place(s.low[t])  # neighbouring pieces both see places near their border
                stands[t] = seen.setdefault(int(s.span[t]), here) == here
            known = s.covered((code > 0) & ~stands if self.first else code > 0)
            least = s.least(many)
            ask = ~known & (least > 1)
            if not self.first:
                which = np.flatnonzero(stands)
                edges = np.searchsorted(s.start, [s.low[which], s.high[which]])
                for t, a, z in zip(which.tolist(), *edges.tolist()):
                    w = slice(a, z)
                    ask[w] |= (least[w] != often[t]) | (often[t] == 255)
            which = np.flatnonzero(ask)
            yield s, many > 1, known, which, s.whole(which)

    def ask_windows(self, told: list[np.ndarray], distinct: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        self.found = list(self.windows(told, distinct))
        return self._facts(*_count([keys for *_, keys in self.found]))

    def removed(self, told2: list[np.ndarray], distinct2: np.ndarray) -> tuple[list, list]:
        """The maximal removed runs of each document, and the runs of shared bytes; after ``ask_windows``."""
        gone: list[list[np.ndarray]] = [[] for _ in self.texts]
        shared: list[list[np.ndarray]] = [[] for _ in self.texts]
        seen = np.zeros(0, np.uint64)
        codes2, _ = self.codes(told2)
        for s, repeats, hit, which, keys in self.found:
            code = _at(keys, codes2, distinct2)
            go = _later(keys, code, self.first)
            if self.first:
                go |= (code == 1) & np.isin(keys, seen)
                seen = np.union1d(seen, keys[code == 1])
            hit[which[go]] = True
            for out, at in ((gone, s.start[hit]), (shared, s.anchor_at[s.owned & repeats])):
                for d, x in s.places(at):
                    out[d].append(x)
        gram, _ = scale(self.length)
        return [_runs(x, self.length) for x in gone], [_runs(x, gram) for x in shared]


def _runs(starts: list[np.ndarray], length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes covered by strings of this length."""
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + length).tolist()))


def _characters(x: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the characters that they only cut into."""
    out = []
    for lo, hi in runs:
        while lo < hi and x[lo] & 0xC0 == 0x80:
            lo += 1
        while hi < len(x) and hi > lo and x[hi] & 0xC0 == 0x80:
            hi -= 1
        if hi > lo:
            out.append((lo, hi))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = True, characters: bool = False, keep_text: bool = True, chunk: int | None = None, exchange: dict | None = None) -> DataFrame:
    """Adds ``n_bytes``, ``removed`` (runs of bytes, from and to), ``kept`` (the remaining bytes), ``n_shared`` and
    ``longest_shared`` to each row.

    ``keep_first``: the first copy of a repeated string stays; otherwise every copy goes. ``characters``: characters
    that a run only cuts into stay. ``keep_text``: whether the text itself is returned, too. ``chunk`` (bytes of a
    chunk) and ``exchange`` (``bucket`` and ``fan`` of an Exchange) are for tests.
    """
    new = {"n_bytes", "removed", "kept", "n_shared", "longest_shared"}
    stay = [c for c in docs.columns if c.lower() not in new | {"__chunk", "__flag"}]
    d, total = dealt(docs.select(*[F.col(f"`{c}`") for c in stay]), id_col, text_col, chunk=chunk)
    lean = d.select("__chunk", F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    gram, win = scale(length)
    anchors = Exchange(total * 4 // (win + 1), FACTS, **exchange or {})
    single = Exchange(total * 4 // (win + 1), FACTS, **exchange or {})

    def chunk_of(key: tuple, t: pa.Table) -> tuple[pa.Table, _Chunk]:
        t, texts = _ordered(t, id_col, text_col)
        return t, _Chunk(key[0].as_py(), texts, length, keep_first)

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        _, c = chunk_of(key, t)
        got = anchors.pack(c.number, *c.ask_anchors())
        trim()
        return got

    told = anchors.answers(lean.groupBy("__chunk").applyInArrow(ask, ASK), "anchors")

    def known(c: _Chunk, told: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        distinct, _ = c.ask_anchors()
        return anchors.unpack(told, distinct), distinct

    def ask2(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        _, c = chunk_of(key, t)
        got = single.pack(c.number, *c.ask_windows(*known(c, told)))
        trim()
        return got

    told2 = single.answers(lean.groupBy("__chunk").cogroup(by_chunk(told)).applyInArrow(ask2, ASK), "windows")
    stay = [c for c in stay if keep_text or c != text_col]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in stay), "n_bytes long, removed array<struct<from:int,to:int>>, kept binary, n_shared long, longest_shared long"])
    run_type = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def final(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        t, c = chunk_of(key, t)
        a = known(c, told.filter(pc.equal(told["which"], 1)))
        keys, _ = c.ask_windows(*a)
        runs, shared = c.removed(single.unpack(told.filter(pc.equal(told["which"], 2)), keys), keys)
        if characters:
            runs = [_characters(x, r) for x, r in zip(c.texts, runs)]
        kept = []
        for x, rs in zip(c.texts, runs):
            edge = [0, *(e for r in rs for e in r), len(x)]
            kept.append(b"".join(x[a:b] for a, b in zip(edge[::2], edge[1::2])))
        cols = [t[c] for c in stay]
        cols += [pa.array([len(x) for x in c.texts], pa.int64()), pa.array([[{"from": a, "to": b} for a, b in r] for r in runs], run_type), pa.array(kept, pa.binary())]
        sizes = [[z - a for a, z in r] for r in shared]
        cols += [pa.array([sum(x) for x in sizes], pa.int64()), pa.array([max(x, default=0) for x in sizes], pa.int64())]
        trim()
        return pa.table(cols, [*stay, "n_bytes", "removed", "kept", "n_shared", "longest_shared"])

    every = told.select("chunk", "bucket", "reply", F.lit(1).alias("which")).union(told2.select("chunk", "bucket", "reply", F.lit(2)))
    return d.groupBy("__chunk").cogroup(by_chunk(every)).applyInArrow(final, ddl)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_first=False, keep_text=False)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["to"] - r["from"])
    return d.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared", "longest_shared")


#: Bytes of a repeated passage that the pipeline removes: well under 50 words.
STAGE_LENGTH = 200


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, length: int = STAGE_LENGTH) -> DataFrame:
    """Later copies of passages go, whole characters only; ``n_chars`` follows. Emptied documents stay, empty; a null
    text stays null."""
    names = list(docs.columns)
    d = dedup(docs.withColumn("__absent", F.col("text").isNull()), length=length, characters=True, keep_text=False)
    text = F.when(~F.col("__absent"), F.col("kept").cast("string"))
    out = d.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__absent"), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in names])


def brute(texts: list[bytes], length: int, keep_first: bool) -> list[list[tuple[int, int]]]:
    """Plain reference for tests: looks every window up."""
    where: dict[bytes, list[tuple[int, int]]] = {}
    for d, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            where.setdefault(t[s : s + length], []).append((d, s))
    hit = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for d, s in places[1:] if keep_first else places:
                hit[d][s : s + length] = b"\1" * length
    out = []
    for h in hit:
        x = np.diff(np.concatenate([[0], np.frombuffer(bytes(h), np.uint8), [0]]).astype(int))
        out.append(list(zip(np.flatnonzero(x > 0).tolist(), np.flatnonzero(x < 0).tolist())))
    return out

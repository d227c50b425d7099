"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

The text is cut into pieces by the tokenizer's pattern. For a piece, the leaves of a segment tree hold the rank of
the pair that starts at each live byte position; an inner node holds the leftmost minimum of its children. The root
is the next merge; a merge updates three leaves (the pair itself, its left and its right live neighbour), each in
logarithmic time. A piece of n bytes takes O(n log n), however adverse. Short pieces are processed many at a time,
one tree per row of a matrix; long ones one by one.

Scale: documents are encoded in place, nothing is shuffled. Each Python worker keeps the ids of the chunks (words
with their leading blank and punctuation) met lately, two generations of at most ``CACHE`` each, none longer than ``LONGEST``; the tables of ranks
are read from the vocabulary file on the worker.

Defined cases: null or empty text: no tokens. Repeated rows and extra columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from itertools import chain, compress
from operator import not_

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import add_columns, read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of a generation of the cache, and characters of the longest ones that are kept: both bound its bytes.
CACHE, LONGEST = 100_000, 64
#: White space as the patterns of public tokenizers mean it: Unicode's White_Space property.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_INF = 2**31 - 1
_STOPS = frozenset(".,;:!?")
_LOADED: dict[tuple[str, str], "Encoder"] = {}


def load(vocabulary: str = VOCABULARY, pattern: str | None = None) -> "Encoder":
    """The encoder of a vocabulary file (a name known to ``public_tokenizers``, or a path), kept per process."""
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    if (vocabulary, pattern) not in _LOADED:
        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _LOADED[vocabulary, pattern] = Encoder(ranks, pattern)
    return _LOADED[vocabulary, pattern]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.text = [str(i) for i in range(len(self.token))]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, vals = [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(r)
        # An open-addressed table of the pairs, for lookups of many at a time.
        k, v = np.array(keys, np.int64), np.array(vals, np.int32)
        self.bits = max(8, int(4 * len(k)).bit_length())
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at = self._slot(k)
        while len(k):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = k[free]
            done = self.slot_key[at] == k
            self.slot_rank[at[done]] = v[done]
            k, v, at = k[~done], v[~done], (at[~done] + 1) & ((1 << self.bits) - 1)
        self.pair = dict(zip(keys, vals))
        # No piece of the public patterns goes beyond a run of non-blanks and one blank before it, so a text may be
        # cut into such chunks first; a pattern without that property has to be given as the cut, too.
        self.cut = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+").findall
        #: Texts whose blanks and line ends all stand alone need no regular expression.
        self.odd = re.compile(f"[{_WS}][{_WS}]|[\\0\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); -1 where there is none or one of them is negative."""
        k = a.astype(np.int64) << 32 | b
        k[(a < 0) | (b < 0)] = -2
        at = self._slot(k)
        got = self.slot_key[at]
        out = np.where(got == k, self.slot_rank[at], -1)
        open_ = np.flatnonzero((got != k) & (got >= 0))
        while len(open_):
            at_ = (at[open_] + 1) & ((1 << self.bits) - 1)
            at[open_] = at_
            got = self.slot_key[at_]
            hit = got == k[open_]
            out[open_[hit]] = self.slot_rank[at_[hit]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """One piece, one tree."""
        n = len(piece)
        if n == 1:
            return [self.ranks[piece]]
        w = 1 << (n - 1).bit_length()
        inf = 1 << 62
        tok = [int(self.byte[c]) for c in piece]
        pair = self.pair.get
        tree = [inf] * (2 * w)
        for i in range(n - 1):
            r = pair(tok[i] << 32 | tok[i + 1])
            if r is not None:
                tree[w + i] = r * w + i
        for i in range(w - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))

        def put(i: int, v: int) -> None:
            i += w
            tree[i] = v
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                m = a if a < b else b
                if tree[i] == m:
                    break
                tree[i] = m
                i >>= 1

        while (root := tree[1]) < inf:
            r, i = divmod(root, w)
            j = nxt[i]
            k, h = nxt[j], prv[i]
            tok[i], nxt[i] = r, k
            put(j, inf)
            x = None if k < 0 else pair(r << 32 | tok[k])
            if k >= 0:
                prv[k] = i
            put(i, inf if x is None else x * w + i)
            if h >= 0:
                x = pair(tok[h] << 32 | r)
                put(h, inf if x is None else x * w + h)
        out, i = [], 0
        while i >= 0:
            out.append(tok[i])
            i = nxt[i]
        return out

    def merge_many(self, pieces: list[bytes], w: int) -> list[bytes]:
        """Pieces of 2 to ``w`` bytes (w a power of two), one tree per row; ids as ``<u4`` bytes."""
        n, inf = len(pieces), np.int32(_INF)
        size = np.fromiter(map(len, pieces), np.int32, n)
        raw = np.frombuffer(b"".join([p.ljust(w, b"\0") for p in pieces]), np.uint8).reshape(n, w)
        col = np.arange(w, dtype=np.int32)
        tok = np.where(col < size[:, None], self.byte[raw], -1).astype(np.int32)
        # Neighbours and leaves by their place in the flattened matrices; one spare place takes what has no target.
        base = np.arange(n, dtype=np.int64) * w
        nxt = np.where(col + 1 < size[:, None], base[:, None] + col + 1, -1).ravel()
        prv = np.where(col > 0, base[:, None] + col - 1, -1).ravel()
        tree = np.full((n, 2 * w), inf, np.int32)
        r = self._rank(tok[:, :-1].ravel(), tok[:, 1:].ravel()).reshape(n, w - 1)
        tree[:, w : 2 * w - 1] = np.where(r >= 0, r * w + col[:-1], inf)
        lo = w
        while lo > 1:
            np.minimum(tree[:, lo : 2 * lo : 2], tree[:, lo + 1 : 2 * lo : 2], out=tree[:, lo // 2 : lo])
            lo //= 2
        tok, tree = tok.ravel(), tree.ravel()
        row = np.flatnonzero(tree[1 :: 2 * w] < inf)
        levels = w.bit_length() - 1

        def put(rows: np.ndarray, place: np.ndarray, value) -> None:
            top = rows * (2 * w)
            at = (place & (w - 1)) + w
            tree[top + at] = value
            for _ in range(levels):
                at >>= 1
                two = top + 2 * at
                tree[top + at] = np.minimum(tree.take(two), tree.take(two + 1))

        while len(row):
            root = tree.take(row * (2 * w) + 1)
            r, i = root // w, row * w + (root & (w - 1))
            j = nxt.take(i)
            k, h = nxt.take(j), prv.take(i)
            tok[i], nxt[i], tok[j] = r, k, -1
            put(row, j, inf)
            live = k >= 0
            prv[k[live]] = i[live]
            x = self._rank(r, np.where(live, tok.take(k), -1))
            put(row, i, np.where(x >= 0, x * w + (i & (w - 1)), inf))
            live = np.flatnonzero(h >= 0)
            if len(live):
                hh = h[live]
                x = self._rank(tok.take(hh), r[live])
                put(row[live], hh, np.where(x >= 0, x * w + (hh & (w - 1)), inf))
            row = row[tree.take(row * (2 * w) + 1) < inf]
        kept = tok >= 0
        flat = tok[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.reshape(n, w).sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Encodes pieces; ids as ``<u4`` bytes."""
        got: dict[str, bytes] = {}
        by: dict[int, tuple[list[str], list[bytes]]] = {}
        one = lambda p: np.array(self.merge_one(p), "<u4").tobytes()
        for s in new:
            p = s.encode()
            if (r := self.ranks.get(p)) is not None:
                got[s] = r.to_bytes(4, "little")
                continue
            w = 1 << (len(p) - 1).bit_length()
            if w > 128:
                got[s] = one(p)
            else:
                names, pieces = by.setdefault(w, ([], []))
                names.append(s)
                pieces.append(p)
        for w, (names, pieces) in by.items():
            step = max(1, (1 << 18) // w)
            for lo in range(0, len(names), step):
                part = pieces[lo : lo + step]
                got.update(zip(names[lo : lo + step], self.merge_many(part, w) if len(part) >= 16 else map(one, part)))
        return got

    def _pieces(self, chunk: str) -> list[str]:
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[-1:] in _STOPS and word[:-1].isalpha():
            return [chunk[:-1], word[-1]]
        return self.find(chunk)

    def _cut(self, text: str) -> list[str]:
        if self.odd(text):
            return self.cut(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _learn_chunks(self, new: set[str]) -> None:
        if len(self.known) + len(new) > CACHE:
            self.known, self.older = {"": b""}, self.known
        old = new & self.older.keys()
        self.known.update((x, self.older[x]) for x in old)
        new = list(new - old)
        pieces = [self._pieces(x) for x in new]
        ids = self.learn(set(chain.from_iterable(pieces)))
        self.known.update((x, ids[p[0]] if len(p) == 1 else b"".join([ids[y] for y in p])) for x, p in zip(new, pieces))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out, lo = [], 0
        while lo < len(texts):
            hi, n = lo, 0
            while hi < len(texts) and (hi == lo or n < 1 << 20):
                n += len(texts[hi] or "")
                hi += 1
            chunks = [self._cut(t) if t else [] for t in texts[lo:hi]]
            ids = [list(map(self.known.get, c)) for c in chunks]
            new = set(chain.from_iterable(compress(c, map(not_, x)) for c, x in zip(chunks, ids)))
            if new:
                self._learn_chunks(new)
                now = self.known
                ids = [[now[c] if y is None else y for c, y in zip(c_, x)] if None in x else x for c_, x in zip(chunks, ids)]
                for c in new:
                    if len(c) > LONGEST:
                        del now[c]
            out += [np.frombuffer(b"".join(x), "<u4") for x in ids]
            lo = hi
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the token ids of each text as an array of int."""

    def make() -> Callable:
        enc = load(vocabulary)
        return lambda texts: [[x.astype(np.int32) for x in enc.encode_batch(texts)]]

    return add_columns(docs, [text_col], f"`{out_col}` array<int>", make)


def decode(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the bytes that the ids of each row stand for (null ids: no bytes). An id outside the vocabulary fails."""

    def make() -> Callable:
        enc = load(vocabulary)
        return lambda ids: [[enc.decode(x or []) for x in ids]]

    return add_columns(docs, [ids_col], f"`{out_col}` binary", make)


def digest(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Encodes each text and decodes the ids in one pass: adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""

    def make() -> Callable:
        enc = load(vocabulary)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def fn(texts):
            n, a, b = [], [], []
            for ids in map(np.ndarray.tolist, enc.encode_batch(texts)):
                n.append(len(ids))
                a.append(sha(",".join(map(enc.text.__getitem__, ids)).encode()))
                b.append(sha(enc.decode(ids)))
            return n, a, b

        return fn

    return add_columns(docs, [text_col], "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and their number."""
    from pyspark.sql import functions as F

    d = encode(docs)
    return d.withColumn("n_tokens", F.size("ids").cast("long"))

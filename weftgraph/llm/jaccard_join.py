"""Groups of near-duplicate documents: a join over rare word shingles with parity sketches as filter.

The parity sketch of a set flips one bit per element; the Hamming distance of two sketches is at most the size of the
sets' symmetric difference, which for a Jaccard similarity of J is at most ``(1 - J) / (1 + J) * (|A| + |B|)``. Pairs
whose sketches are further apart are not linked; the others are verified exactly.

Which pairs are compared: equal parts of sketches, as the pigeonhole principle offers them, tie documents together
that only share frequent passages (measured: nearly all documents of a corpus become one family). So the pigeonhole
is taken over shingles in order of their frequency instead: of the ``n - ceil(J n) + 1`` rarest shingles of a set, a
linked partner must hold one.

1. Chunks of documents ask how many sets hold each shingle (see ``exchange``). A set with more shingles of its own
   than its size allows is linked with none but its equals; the other sets go on, and ask again among themselves.
2. Each offers its rarest shingles; documents that offer the same one are tied to the smallest id of them: a star per
   shingle (a minimum by key, then a join whose hot keys can be split), never the pairs. Connected stars are families.
3. Within a family, in blocks of ``BLOCK`` documents, pairs whose sketches pass the bound and which are not connected
   yet are verified; each pair of blocks is a task's group of its own and gives at most one link per document it joins.
4. Connected links are the groups; equal sets, of which only the smallest id took part, follow it.

Scale: what is shuffled is the text once, about six bytes per shingle, and the sets of step 2. A shingle costs one
entry per chunk, however frequent. Work within a family grows with the square of its *different* sets divided by the
block, spread over as many groups; blocks hold neighbours by distance from the family's first document, and pairs of
blocks that the triangle inequality rules out are not formed.

Defined cases: null, empty or blank text: no shingles, linked with nothing. Fewer words than a shingle has: the whole
sequence is the only one. Rows with a null id are linked with nothing, their component is null. Rows with one id and
one set are one document; if an id comes with different texts, each is a document of its own under that id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, components, discard, mix64, read, space_words, table
from .exchange import ASK, Exchange, by_chunk, dealt, trim

WIDTH, NUM, DEN = 4, 85, 100
BLOCK = 128
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted 64-bit hashes of the distinct shingles of each text."""
    out, lo = [], 0
    while lo < len(texts):  # about a megabyte of words at a time
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < 1 << 20):
            size += len(texts[hi] or "")
            hi += 1
        out += _shingle_sets(texts[lo:hi], width)
        lo = hi
    return out


def _shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    import xxhash

    number: dict[bytes, int] = {}
    words, sizes = [], []
    for t in texts:
        w = space_words(t)
        words += w
        sizes.append(len(w))
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    tok = mix64(h)[at] if len(at) else np.zeros(0, np.uint64)
    n = len(tok)
    acc = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        acc = mix64(acc + tok[k : n - width + 1 + k] * _C[k % 4] + np.uint64(k)) if len(acc) else acc
    out, lo = [], 0
    for s in sizes:
        if s >= width:
            out.append(np.unique(acc[lo : lo + s - width + 1]))
        elif s:
            x = np.array([s], np.uint64)
            for k in range(lo, lo + s):
                x = mix64(x * _C[1] + tok[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
        lo += s
    return out


def linked(both: int, a: int, b: int, num: int = NUM, den: int = DEN) -> bool:
    return den * both >= num * (a + b - both)


def most_apart(a, b, num: int = NUM, den: int = DEN):
    """The largest symmetric difference of linked sets of these sizes."""
    return (den - num) * (a + b) // (den + num)


def sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One parity sketch per row."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if len(row):
        x = mix64(np.concatenate(sets) ^ _C[3]) & np.uint64(bits - 1)
        np.bitwise_xor.at(out, (row, (x >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (x & np.uint64(63)))
    return out


def join_block(sets: list[np.ndarray], side: list[int], num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Links that connect whatever is linked: pairs of places in ``sets``; across sides only, if there are two."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    side = np.array(side)
    two = len(set(side.tolist())) > 1
    bits = 1 << max(10, min(16, int(4 * size.max(initial=1)).bit_length()))
    sk = sketches(sets, bits)
    root = np.arange(n)
    out = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        if two:
            rest = rest[side[rest] != side[i]]
        far = np.bitwise_count(sk[rest] ^ sk[i]).sum(1, dtype=np.int64)
        rest = rest[far <= most_apart(size[i], size[rest], num, den)]
        for j in rest.tolist():
            if find(i) == find(j):
                continue
            a, b = sets[i], sets[j]
            if len(a) > len(b):
                a, b = b, a
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            if linked(int((b[at] == a).sum()), len(a), len(b), num, den):
                root[find(j)] = find(i)
                out.append((i, j))
    return out


def _most_unique(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most elements a linked set may have that its partner lacks: the union is at most den / num times either."""
    return (den - num) * n // num


def _digests(texts: list[str | None], width: int) -> list[bytes]:
    import xxhash

    return [xxhash.xxh3_128_digest(s.tobytes()) for s in shingle_sets(texts, width)]


def _survey(chunk: pa.Table, width: int) -> tuple[list, list[np.ndarray], list[bytes], np.ndarray]:
    """Ids, sets, digests of the sets, and which rows stand for their set within the chunk (smallest id first)."""
    import xxhash

    t = chunk.sort_by("i")
    ids = t["i"].to_pylist()
    sets = shingle_sets(t["t"].to_pylist(), width)
    digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    seen: set[bytes] = set()
    stands = np.zeros(len(ids), bool)
    for k, (i, s, x) in enumerate(zip(ids, sets, digests)):
        if i is not None and len(s) and x not in seen:
            seen.add(x)
            stands[k] = True
    return ids, sets, digests, stands


def _held(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct elements of several sets and how many hold each (255: or more)."""
    k, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
    return k, np.minimum(n, 255).astype(np.uint8)


#: What is asked of a shingle: how many sets hold it (255: or more).
HELD = [("u1", "sum")]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN, chunk: int | None = None, exchange: dict | None = None) -> DataFrame:
    """``(id, n_shingles, component_id, representative)`` per row: links are pairs with ``den * |A and B| >= num * |A or B|``.

    ``representative``: whether the row's set is the one of its group whose id names the group. ``chunk`` (bytes of a
    chunk) and ``exchange`` (``bucket`` and ``fan`` of an Exchange) are for tests.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"))
    store, total = dealt(d, "i", "t", chunk=chunk)
    d = store.select("__chunk", "i", "t")
    ex = Exchange(total // 24, HELD, **exchange or {})

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        _, sets, _, stands = _survey(t, width)
        k, n = _held([s for s, x in zip(sets, stands) if x])
        trim()
        return ex.pack(key[0].as_py(), k, [n])

    told = ex.answers(d.groupBy("__chunk").applyInArrow(ask, ASK), "shingles")

    def sift(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        ids, sets, digests, stands = _survey(t, width)
        keys, _ = _held([s for s, x in zip(sets, stands) if x])
        (many,) = ex.unpack(told, keys)
        out = []
        for s, x in zip(sets, stands):
            alone = int((many[np.searchsorted(keys, s)] == 1).sum()) if x else 0
            out.append(s.tobytes() if x and alone <= _most_unique(len(s), num, den) else None)
        trim()
        return pa.table({"i": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "fp": pa.array(digests, pa.binary()), "s": pa.array(out, pa.binary())})

    seen = table(d.groupBy("__chunk").cogroup(by_chunk(told)).applyInArrow(sift, "i long, n long, fp binary, s binary"), "sets")
    discard(store, told)
    rep = table(seen.where("n > 0 AND i IS NOT NULL").groupBy("fp").agg(F.min("i").alias("rep")), "classes")
    sets = table(seen.where("s IS NOT NULL").join(rep.select(F.col("rep").alias("i"), "fp"), ["i", "fp"], "left_semi").select("i", "fp", F.xxhash64("i", "fp").alias("k"), "s"), "survivors")
    # What later steps need is written apart, and the rest deleted.
    slim = table(seen.select("i", "n", "fp"), "digests")
    discard(seen)
    size = int(sets.agg(F.sum(F.length("s"))).first()[0] or 0)
    if not size:
        return _result(slim, rep, None, id_col)
    # From here on a set is known by ``k``, a number of its own: ids may come with several texts.
    parts = max(8, size // (8 << 20))
    ex2 = Exchange(size // 16, HELD, **exchange or {})
    sets_by = sets.withColumn("__chunk", F.shiftleft(F.pmod("k", F.lit(parts)).cast("long"), 40))
    arrays = lambda t: [np.frombuffer(x, np.uint64) for x in t["s"].to_pylist()]

    def ask2(key: tuple, t: pa.Table) -> pa.Table:
        k, n = _held(arrays(t))
        return ex2.pack(key[0].as_py(), k, [n])

    told2 = ex2.answers(sets_by.select("__chunk", "s").groupBy("__chunk").applyInArrow(ask2, ASK), "shared")

    def offer(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        """The rarest shingles of each set: a linked partner holds one of them."""
        every = arrays(t)
        keys, _ = _held(every)
        (many,) = ex2.unpack(told, keys)
        got, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, s in zip(t["k"].to_pylist(), every):
            m = many[np.searchsorted(keys, s)]
            if (m == 1).sum() > _most_unique(len(s), num, den):
                continue
            first = np.lexsort((s, m))[: len(s) - -(-num * len(s) // den) + 1]
            first = first[m[first] > 1]
            got.append(s[first])
            doc.append(np.full(len(first), k, np.int64))
        trim()
        return pa.table({"shingle": np.concatenate(got).view(np.int64), "k": np.concatenate(doc)})

    offered = table(sets_by.select("__chunk", "k", "s").groupBy("__chunk").cogroup(by_chunk(told2)).applyInArrow(offer, "shingle long, k long"), "offers")
    lead = table(offered.groupBy("shingle").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a < z").select("shingle", "a"), "leads")
    tied = offered.join(lead, "shingle").where("k <> a").select("a", F.col("k").alias("b")).distinct()
    members = table(components(tied).select(F.col("id").alias("k"), F.col("component").alias("family")), "families")
    large = table(members.groupBy("family").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK).select("family"), "large")
    mine = table(members.join(sets, "k").select("family", "k", "s"), "members")
    names = table(sets.select("k", "fp"), "names")
    discard(told2, sets, offered, lead)

    def link(t: pa.Table) -> pa.Table:
        ids, sides = t["k"].to_pylist(), t["side"].to_pylist() if "side" in t.column_names else [0] * t.num_rows
        e = join_block(arrays(t), sides, num, den)
        trim()
        return pa.table({"a": pa.array([ids[x] for x, _ in e], pa.int64()), "b": pa.array([ids[y] for _, y in e], pa.int64())})

    links = mine.join(large, "family", "left_anti").groupBy("family").applyInArrow(link, "a long, b long")
    if large.limit(1).count():
        links = links.union(_large(mine.join(large, "family"), num, den, link))
    joined = table(components(table(links, "links")).withColumnRenamed("id", "k").join(names, "k"), "joined")
    discard(mine, members, large)
    return _result(slim, rep, joined, id_col)


def _result(seen: DataFrame, rep: DataFrame, joined: DataFrame | None, id_col: str) -> DataFrame:
    if joined is None:
        group = rep.select("fp", F.col("rep").alias("component"), F.lit(True).alias("first"))
    else:
        # A group is named by its smallest id; its representative is the set of that id, the first by digest if several.
        own = joined.select("fp", "component").join(rep, "fp")
        named = own.groupBy("component").agg(F.min("rep").alias("low"), F.min(F.struct("rep", "fp")).alias("best"))
        own = own.join(named, "component").select("fp", F.col("low").alias("component"), (F.col("fp") == F.col("best.fp")).alias("first"))
        group = rep.join(own, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component"), F.coalesce("first", F.lit(True)).alias("first"))
    out = seen.select("i", "n", "fp").join(table(group, "groups"), "fp", "left")
    own = F.when(F.col("i").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("i")).otherwise(F.col("component"))
    first = (F.col("i").isNull() | (F.col("n") == 0)) | (F.col("first") & (F.col("i") == F.col("component")))
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), first.alias("representative"), F.col("fp").alias("digest"))


def _large(mine: DataFrame, num: int, den: int, link) -> DataFrame:
    """Links of families of more than ``BLOCK`` documents, by pairs of blocks."""
    from pyspark.sql import Window

    first = table(mine.groupBy("family").agg(F.min_by("s", "k").alias("s0")), "first")

    def far(batches):
        for b in batches:
            d, n = [], []
            for x, x0 in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s = np.frombuffer(x, np.uint64)
                d.append(len(np.setxor1d(s, np.frombuffer(x0, np.uint64), assume_unique=True)))
                n.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(d, pa.int64()), pa.array(n, pa.int64())], ["family", "k", "s", "far", "n"])

    d = table(mine.join(first, "family").select("family", "k", "s", "s0").mapInArrow(far, "family long, k long, s binary, far long, n long"), "distances")
    counts = d.groupBy("family", "far").agg(F.count(F.lit(1)).alias("c"))
    # One row per family and distance: as many as distances, not as documents.
    w = Window.partitionBy("family").orderBy("far")
    before = table(counts.withColumn("before", F.sum("c").over(w) - F.col("c")), "before")
    d = d.join(before, ["family", "far"])
    # Documents at one distance that overflow a block are dealt over several by their id's hash.
    deal = F.when(F.col("c") > BLOCK, F.pmod(F.xxhash64("k"), F.ceil(F.col("c") / BLOCK))).otherwise(F.lit(0))
    d = table(d.select("family", "k", "s", "far", "n", (F.floor(F.col("before") / BLOCK) + deal).cast("long").alias("block")), "blocks")
    blocks = d.groupBy("family", "block").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.max("n").alias("n"))
    x, y = blocks.alias("x"), blocks.alias("y")
    reach = (F.col("x.n") + F.col("y.n")) * F.lit((den - num) / (den + num)) + 1
    near = (F.col("y.lo") - F.col("x.hi") <= reach) & (F.col("x.lo") - F.col("y.hi") <= reach)
    pairs = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.block") <= F.col("y.block")) & near)
    side = lambda b, k: F.struct(F.col(f"{b}.block").alias("block"), F.lit(k).alias("side"))
    pairs = pairs.select(F.col("x.family").alias("family"), F.concat_ws("-", F.col("x.block"), F.col("y.block")).alias("pair"), F.explode(F.when(F.col("x.block") == F.col("y.block"), F.array(side("x", 0))).otherwise(F.array(side("x", 0), side("y", 1)))).alias("e"))
    pairs = table(pairs.select("family", "pair", "e.block", "e.side"), "pairs")
    return d.join(pairs, ["family", "block"]).select("family", "pair", "side", "k", "s").groupBy("family", "pair").applyInArrow(link, "a long, b long")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group stays: the one with the smallest id. Documents without an id stay, and so do those
    without a word. Of rows with one id, those with the group's own text stay as one; an id whose other text is in no
    group keeps that text, too. Ids are integers."""
    g = near_groups(docs, width=width, num=num, den=den)
    # Rows are told apart by id and text: an id may come with several.
    keep = table(g.where("representative AND doc_id IS NOT NULL").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")), "kept")
    ids = table(keep.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("copies")), "kept-ids")
    every = table(g.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.countDistinct("digest").alias("all")), "all-ids")
    odd = ids.join(every, "doc_id").where("all > 1 OR copies > 1").select("doc_id")
    out = docs.join(ids.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if odd.limit(1).count():
        plain = out.join(odd, "doc_id", "left_anti").select(*docs.columns)
        tricky = add_columns(out.join(odd, "doc_id", "left_semi").select(*docs.columns), ["text"], "__digest binary", lambda: lambda texts: [_digests(texts, width)])
        chosen = keep.select("doc_id", F.col("digest").alias("__digest"))
        out = plain.union(tricky.join(chosen, ["doc_id", "__digest"], "left_semi").dropDuplicates(["doc_id", "__digest"]).select(*docs.columns))
    return out.union(docs.where("doc_id IS NULL"))


def brute(texts: list[str | None], width: int = WIDTH, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Plain reference for tests: (set size, smallest place reachable by links) of each text, over all pairs."""
    sets = []
    for t in texts:
        w = space_words(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]

"""SimHash against brute force over all pairs: near copies, odd texts, many buckets, large buckets cut into blocks."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import simhash


def corpus(seed=1, n=90):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Ä", "É", "don't"]
    base = [[r.choice(words) for _ in range(r.choice([5, 150, 400]))] for _ in range(8)]
    rows = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, r.choice([" ", "  ", "\t\n"]).join(t).upper() if r.random() < 0.2 else " ".join(t)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "a b c"), (n + 6, "a b c d"), (None, rows[3][1]), (None, "alone here"), rows[5], rows[5]]
    rows += [(n + 7, "long " * 30_000 + "end"), (n + 8, "x" * 300_000 + " y z q r")]
    return rows


def fps(seed, centers=6, each=60, far=300):
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(far)} | {0, 2**64 - 1}
    for _ in range(centers):
        c = r.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return sorted(out)


def groups(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = collections.defaultdict(set)
    for x in nodes:
        out[find(x)].add(x)
    return sorted(map(sorted, out.values()))


def close(nodes, radius):
    return [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= radius]


def test_equals_brute_force(spark):
    rows = corpus()
    got = simhash.near(spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(simhash.brute(rows))


def test_text_ids_and_no_rows(spark):
    rows = [(f"k{i}" if i is not None else None, t) for i, t in corpus(3, 30)]
    got = simhash.near(spark.createDataFrame(rows, "doc_id string, text string"))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(simhash.brute(rows))
    assert simhash.near(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("sizes", [{}, {"large": 16, "cell": 64}, {"crowd": 1, "cell": 64}])
def test_links_connect_what_is_close(spark, sizes):
    """Buckets in one sweep, large ones in blocks, and choices of several parts: all give the same components."""
    nodes = fps(4)
    signed = np.array(nodes, np.uint64).view(np.int64).tolist()
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(nodes), **sizes).collect()
    pairs = [(a % 2**64, b % 2**64) for a, b in got]
    assert all(a != b for a, b in pairs)
    assert groups(nodes, pairs) == groups(nodes, close(nodes, 4))


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_kernel(radius):
    nodes = fps(radius, 4, 120, 60)
    x = np.array(nodes, np.uint64)
    r = random.Random(radius)
    keys = np.array([r.choice([0, 1, 1, 1, 1]) if r.random() < 0.8 else r.randrange(2, 40) for _ in nodes], np.uint64)
    a, b = simhash.link_buckets(keys, x, radius)
    same = [(p, q) for p, q in close(nodes, radius) if keys[nodes.index(p)] == keys[nodes.index(q)]]
    assert groups(nodes, zip(a.tolist(), b.tolist())) == groups(nodes, same)


@pytest.mark.parametrize("radius", [1, 2, 4, 6])
def test_choices_meet(radius):
    r = random.Random(radius)
    for n in (10, 10**8, 10**11):
        masks = simhash.choices(n, radius)
        for _ in range(200):
            x = y = r.getrandbits(64)
            for j in r.sample(range(64), radius):
                y ^= 1 << j
            assert any(x & m == y & m for m in masks)


def test_hash_equals_the_engines(spark):
    """Substrings of all lengths up to 70 bytes, and long ones, hash as Spark's xxhash64 does."""
    texts = ["é" * (n // 2) + "a" * (n % 2) for n in range(1, 70)] + ["b" * 5000]
    text = " ".join(texts).encode()
    length = np.array([len(t.encode()) for t in texts])
    at = np.cumsum(length + 1) - length - 1
    got = simhash.xxh64_many(text, np.repeat(at, 40), np.repeat(length, 40))[::40].view(np.int64).tolist()
    want = [x.h for x in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.xxhash64("t").alias("h")).orderBy("i").collect()]
    assert got == want

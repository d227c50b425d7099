"""Target-distribution resampling against feature-by-feature brute force: odd rows, ties, very long words, clashing columns."""

import collections
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from weftgraph.llm import target_resampling as tr

DOC = "doc_id long, text string, n_features string, t int"


def corpus(seed=5, n=120):
    r = random.Random(seed)
    words = ["Alpha", "b2", "gäm", "δ", "x" * 300, "y" * 70001, "-", "9", "don't", "e.f", " k"]
    rows = [(i, " ".join(r.choice(words[:4] + words[6:]) for _ in range(r.choice([0, 1, 2, 19, 20, 60])))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \t-"), (n + 3, " ".join(words * 3)), (None, "alpha b2 " * 15), rows[7], rows[8], rows[8]]
    return rows


TARGET = [None, "", "alpha b2 gäm", "B2 alpha 9 9 9", "δ"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "own", 1) for i, t in rows], DOC)


def target(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("seed", [5, 6])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = tr.resample(frame(spark, rows), target(spark, TARGET), percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    out = [tuple(r) for r in got.collect()]
    want = tr.brute(rows, TARGET, percent=30)
    assert collections.Counter(out) == collections.Counter(want)
    assert sorted(x[4] for x in out if x[4]) == list(range(1, sum(x[4] is not None for x in want) + 1))


def test_partitions_do_not_matter(spark):
    rows = corpus()
    a, b = (sorted(map(str, tr.resample(frame(spark, rows).repartition(k), target(spark, TARGET)).collect())) for k in (1, 7))
    assert a == b


def test_no_target_and_no_rows(spark):
    rows = corpus()[:20]
    assert collections.Counter(tuple(r) for r in tr.resample(frame(spark, rows), target(spark, [])).collect()) == collections.Counter(tr.brute(rows, []))
    assert tr.resample(frame(spark, []), target(spark, TARGET)).collect() == []


def test_crc_of_joined_words():
    import zlib

    r = random.Random(1)
    words = [bytes(r.choice(b"abc019") for _ in range(n)) for n in (1, 2, 7, 255, 256, 511, 70000)]
    lists = [[r.choice(words) for _ in range(n)] for n in (0, 1, 2, 3, 40)]
    b, doc = tr.buckets_of(lists, tr.Shifts())
    want = sorted((i, zlib.crc32(b" ".join(x[k : k + n])) % tr.BUCKETS) for i, x in enumerate(lists) for n in (1, 2, 3) for k in range(len(x) - n + 1))
    assert sorted(zip(doc.tolist(), b.tolist())) == want


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    d, b = (pq.read_table(f"{sf}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    want = tr.brute([(x["doc_id"], x["text"]) for x in d], [x["text"] for x in b])
    got = [tuple(r) for r in tr.op12_target_resampling(spark, sf).collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_gains_are_whole_numbers():
    g = tr.gains(np.array([0, 5, 10]), np.array([3, 0, 0]))
    assert g.dtype == np.int64 and g[0] > 0 > g[2]

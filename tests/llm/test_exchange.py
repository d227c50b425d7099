"""The exchange between chunks, over many chunks and several levels, and the dealing of skewed inputs."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import common, exchange, interpolation, jaccard_join, suffix_dedup

from .test_operators import corpus

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Chunk bytes, and how keys are spread: one bucket; many in one level; three levels.
SHAPES = [(100_000, {}), (3_000, {"bucket": 200}), (300, {"bucket": 20, "fan": 8})]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(seed=9, n=90), DOC)


def chunks(got):
    return [r.b for r in got.rows.groupBy("__chunk").agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).alias("b")).collect()]


def test_chunk_numbers_hash_as_spark_does(spark):
    for buckets in (1, 7, 500):
        names = [exchange.chunk_number(f, p, k, buckets) for f in (0, 1) for p in range(12) for k in range(3)]
        assert names == sorted(names) and len(set(names)) == len(names)
        rows = spark.createDataFrame([(x,) for x in names], "c long").select("c", F.pmod(F.hash("c"), F.lit(buckets)).alias("b")).collect()
        assert all(r.b == (r.c >> 40) % (1 << 21) % buckets for r in rows)


@pytest.mark.parametrize("kind", ["null", "one", "text", "skewed", "identical"])
def test_chunks_are_even_whatever_the_ids(spark, kind):
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rows = {
        "null": [(None, text(500)) for _ in range(400)],
        "one": [(7, text(500)) for _ in range(400)],
        "text": [(f"id-{k}", text(500)) for k in range(400)],
        "skewed": [(k, text(4000 if k < 40 else 40)) for k in range(1000)],
        "identical": [(7, "same text " * 50)] * 400,
    }[kind]
    d = spark.createDataFrame(rows, f"i {'string' if kind == 'text' else 'long'}, t string")
    got = exchange.dealt(d, "i", "t", chunk=20_000)
    sizes = chunks(got)
    assert sum(sizes) == sum(len(t) for _, t in rows) == got.text_bytes and got.rows.count() == len(rows)
    assert max(sizes) <= 20_000 and len(sizes) <= 4 * got.text_bytes / 20_000 + 8


def test_a_long_text_has_a_chunk_of_its_own(spark):
    d = spark.createDataFrame([(1, "a" * 50_000), (2, "b"), (3, None), (4, "c" * 900)], "i long, t string")
    sizes = chunks(exchange.dealt(d, "i", "t", chunk=1000))
    assert sorted(sizes)[-1] == 50_000 and sum(sizes) == 50_901


@pytest.mark.parametrize(("bucket", "fan"), [(10**6, 4096), (50, 4096), (5, 8)])
def test_reduction_at_every_level(spark, bucket, fan):
    r = np.random.default_rng(3)
    asked = {exchange.chunk_number(0, k // 3, k % 3, 1): np.unique(r.integers(0, 2**63, 60).astype(np.uint64) % np.uint64(97) * np.uint64(0x9E3779B97F4A7C15)) for k in range(40)}
    ex = exchange.Exchange(3000, [("u1", "sum"), ("i8", "min")], lambda k, n, low: [len(k), int(n.sum()), 0], bucket=bucket, fan=fan)
    assert len(ex.fans) == {10**6: 1, 50: 1, 5: 4}[bucket]
    rows = [tuple(x.values()) for c, k in asked.items() for x in ex.pack(c, k, [np.full(len(k), 9), np.full(len(k), c)]).to_pylist()]
    told = ex.answers(spark.createDataFrame(rows, exchange.ASK), "t").toArrow()
    n = collections.Counter(x for k in asked.values() for x in k.tolist())
    for c, keys in asked.items():
        many, low = ex.unpack(told.filter(exchange.pc.equal(told["chunk"], c)), keys)
        assert many.tolist() == [min(255, 9 * n[x]) for x in keys.tolist()]
        assert low.tolist() == [min(a for a, k in asked.items() if x in k) for x in keys]
    assert ex.totals == (len(n), sum(min(255, 9 * x) for x in n.values()), 0)


@pytest.mark.parametrize(("chunk", "how"), SHAPES)
@pytest.mark.parametrize("first", [False, True])
def test_repeated_passages_over_chunks(spark, docs, chunk, how, first):
    rows = sorted(corpus(seed=9, n=90), key=lambda r: (r[0] is not None, r[0] or 0))
    want = collections.Counter((r[0], str(x)) for r, x in zip(rows, suffix_dedup.brute([(r[1] or "").encode() for r in rows], 60, first)))
    got = suffix_dedup.dedup(docs, length=60, keep_first=first, chunk=chunk, exchange=how).collect()
    assert collections.Counter((r.doc_id, str([(x["from"], x["to"]) for x in r.removed])) for r in got) == want


@pytest.mark.parametrize(("chunk", "how"), SHAPES)
def test_near_duplicates_over_chunks(docs, chunk, how):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_groups(docs, chunk=chunk, exchange=how).collect()}
    rows = sorted((r for r in corpus(seed=9, n=90) if r[0] is not None), key=lambda r: r[0])
    want = {(rows[k][0], n, rows[k][0] if n == 0 else rows[c][0]) for k, (n, c) in enumerate(jaccard_join.brute([r[1] for r in rows]))}
    assert {g for g in got if g[0] is not None} == want


def test_language_model_is_the_same_over_chunks(docs):
    whole = {(r.doc_id, round(r.base_score, 6), r.n_known): r.score for r in interpolation.score(docs).collect()}
    for chunk, how in SHAPES[1:]:
        for r in interpolation.score(docs, chunk=chunk, exchange=how).collect():
            assert math.isclose(whole[r.doc_id, round(r.base_score, 6), r.n_known], r.score, rel_tol=1e-9)


def test_language_model_equals_its_definition(docs):
    """Every score from plain counts, the learned weights and the definition of the model."""
    got = interpolation.score(docs, weights=True)
    weights = got.weights
    rows = corpus(seed=9, n=90)
    uni, two, before, starts = collections.Counter(), collections.Counter(), collections.Counter(), 0
    toks = lambda t: [None, *common.space_words(t), b" "]
    for i, t, *_ in rows:
        if common.remainder(i, 7) != 2:
            w = toks(t)
            starts += 1
            uni.update(w[1:])
            two.update(zip(w, w[1:]))
    n, v = sum(uni.values()), len(uni)
    want = collections.Counter()
    for i, t, *_ in rows:
        w, s = toks(t), 0.0
        for a, b in zip(w, w[1:]):
            c = starts if a is None else uni[a]
            l2, l1, l0 = weights[min(int(math.log2(c + 1)), interpolation.LEVELS - 1)]
            s += math.log10((l2 * two[a, b] / c if c else 0) + l1 * uni[b] / n + l0 / (v + 1))
        want[i, round(s, 6)] += 1
    assert collections.Counter((r.doc_id, round(r.score, 6)) for r in got.rows.collect()) == want
    assert weights[0][0] == 0 and np.allclose(weights.sum(1), 1)


def test_longest_shared_shows_shorter_passages(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("red green blue cyan pink gold grey teal lime navy".split()) + str(r.randrange(10**6)) for _ in range(n))
    passage = text(26)
    assert 200 < len(passage) < 400
    rows = [(k, f"{text(40)} {passage if k % 3 == 0 else text(5)} {text(40)}") for k in range(30)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=False).collect()
    assert all((x.longest_shared >= 150) == (x.doc_id % 3 == 0) and x.longest_shared <= len(passage) + 2 and not x.removed for x in got)


def test_tables_are_deleted(spark, docs):
    jaccard_join.near_groups(docs).count()
    common.drop_tables(spark)
    assert not common._TABLES and not [t for t in spark.catalog.listTables() if t.name.startswith("weftgraph_dealt")]

"""Hashed n-gram vectors and what is pruned by them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.embed import DIMS, bucket, embed, features, similarity
from weftgraph.operators import question, rank


def plain(text):
    v = [0] * DIMS
    for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split():
        for f in features(w):
            v[bucket(f)] += 1
    n = math.sqrt(sum(x * x for x in v))
    return [x / n if n else 0.0 for x in v]


def test_vectors_and_similarity(spark):
    texts = ["The film, directed by X", "film director", None, "", "  ", "a", "é only", "The film, directed by X"]
    d = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in d.select("a", "b", embed(F.col("a")).alias("v"), similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.v == pytest.approx(plain(r.a))
        assert r.s == pytest.approx(sum(x * y for x, y in zip(plain(r.a), plain(r.b))))


def test_fuzzy_prune(spark):
    r = random.Random(2)
    words = "film director actor nation city person award year".split()
    rows = [(r.choice([1, 1, 2]), " ".join(r.choice(words) for _ in range(4)), r.sample(["x", "y"], r.choice([0, 0, 1, 2])), i) for i in range(120)]
    asked = {1: "who is the director of the film", 2: "which city"}
    d = spark.createDataFrame(rows, "qid int, text string, matched_relations array<string>, ord int")
    got = {(x.qid, x.fuzzy_rank): x.ord for x in rank.fuzzy_prune(d, spark.createDataFrame(list(asked.items()), "qid int, question string"), 9).collect()}
    want = {}
    for q, text in asked.items():
        s = lambda t: round(sum(a * b for a, b in zip(plain(text), plain(t))), 6)  # noqa: B023, E731
        own = sorted((len(m) == 0, -len(m), -s(t), i) for qq, t, m, i in rows if qq == q)
        want |= {(q, k + 1): x[-1] for k, x in enumerate(own[:9])}
    assert got == want


def test_type_similarity(spark):
    d = spark.createDataFrame([("film", ["a feature film"]), ("film", ["nothing"]), (None, ["film"]), ("film", []), ("film", None)], "t string, texts array<string>")
    got = [r.s for r in d.select(question.embedding_soft_score(F.col("t"), F.col("texts")).alias("s")).collect()]
    assert got[0] > 0.58 > got[1] and got[2:] == [0.0, 0.0, 0.0]

"""Texts as vectors of hashed n-grams, and similarities of texts.

A text's features are its words (runs of ``[a-z0-9]``, lower-cased) and the trigrams of each word between two marks; a
feature's bucket is a polynomial hash of its characters modulo ``DIMS``, and the vector holds the buckets' counts, scaled to
length 1. Nothing is trained or looked up, so equal texts have equal vectors anywhere, and a rule that SQL can say.

One Arrow pass per batch: the features of a word are hashed once per batch. Null and wordless texts have a zero vector, which
is similar to nothing (0).
"""

from __future__ import annotations

import re
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Workers need not have this package: its functions go along with the UDFs that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The size of vectors and the hash.
DIMS, PRIME, BASE, START = 256, 2147483647, 31, 7
_WORD = re.compile("[a-z0-9]+")


def bucket(feature: str, dims: int = DIMS) -> int:
    h = START
    for c in feature:
        h = (h * BASE + ord(c)) % PRIME
    return h % dims


def features(word: str) -> list[str]:
    w = f"^{word}$"
    return [word, *(w[i : i + 3] for i in range(len(w) - 2))]


def vectors(texts, dims: int = DIMS) -> np.ndarray:
    """A row per text."""
    known: dict[str, np.ndarray] = {}
    out = np.zeros((len(texts), dims))
    for row, t in zip(out, texts):
        for w in _WORD.findall(t.lower()) if t else ():
            if w not in known:
                known[w] = np.bincount([bucket(f, dims) for f in features(w)], minlength=dims)
            row += known[w]
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def embed(text: Column, dims: int = DIMS) -> Column:
    """The vector of a text, as an array of doubles."""
    import pandas as pd

    def run(t):
        return pd.Series(list(vectors(t.tolist(), dims)), dtype=object)

    run.__annotations__ = {"t": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(text)


def similarity(a: Column, b: Column) -> Column:
    """The cosine of two texts' vectors, from 0 to 1."""
    import pandas as pd

    def run(x, y):
        return pd.Series((vectors(x.tolist()) * vectors(y.tolist())).sum(1))

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(a, b)


def best_similarity(a: Column, b: Column) -> Column:
    """The best cosine of any text of one array with any of another; 0 without texts."""
    import pandas as pd

    def run(x, y):
        out = []
        for p, q in zip(x, y):
            p, q = ([] if z is None else [t for t in z if t] for z in (p, q))
            out.append(float((vectors(p) @ vectors(q).T).max()) if p and q else 0.0)
        return pd.Series(out, dtype=float)

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(a, b)

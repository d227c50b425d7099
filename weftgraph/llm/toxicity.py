"""Counterfactual-regularised toxicity classifier.

A sparse logistic regression over the presence of words and word beginnings in a text. Besides the labelled texts,
training looks at counterfactuals: a labelled sentence that names a group, with the group's name swapped for another
of its set, and with the name left out. The penalty ``swap_weight * (logit(x) - logit(x'))**2`` pulls their scores
together, so naming a group neither raises nor lowers a score; built-in neutral sentences about every group, without
a label, put all names under the penalty even where the labelled texts name nobody.

Scale: training reads the labels of all rows, then fits on at most ``SAMPLE_ROWS`` labelled texts (lowest hashes of
their ids) of at most ``SAMPLE_BYTES`` in all, each row counting ``ROW_BYTES`` besides its text: both bounds are
parameters. Scoring needs a dictionary of at most
``MOST_FEATURES`` strings, sent to the tasks, and one pass over each text; nothing is shuffled.

Defined cases: null and empty texts get the score of the intercept. Labels that are null, or of rows without an id,
are not used. With no labels of one kind at all, every score is the share of toxic labels (0.5 without labels).
Repeated rows and extra columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, add_columns, read, remainder_col

SAMPLE_ROWS = 8000
SAMPLE_BYTES = 48 << 20
#: What a row counts besides its text, so that empty texts of repeated ids are bounded, too.
ROW_BYTES = 64
MOST_FEATURES = 4000
#: Names of groups; a name may be swapped for another of its line.
GROUPS: list[list[str]] = [
    ["women", "men", "girls", "boys"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "queer"],
    ["black", "white", "asian", "latino", "african", "european", "arab", "indigenous"],
    ["immigrants", "refugees", "natives", "foreigners", "locals"],
    ["deaf", "blind", "disabled", "autistic"],
    ["old", "young", "elderly"],
    ["frauen", "männer"], ["juden", "muslime", "christen"], ["ausländer", "flüchtlinge"],
    ["femmes", "hommes"], ["juifs", "musulmans", "chrétiens"], ["immigrés", "réfugiés"],
    ["mujeres", "hombres"], ["judíos", "musulmanes", "cristianos"], ["inmigrantes", "refugiados"],
]
#: Neutral frames for every name.
NEUTRAL = ["many {} people live in this town", "the {} met friends at the market", "she wrote a book about {} families"]
_LETTERS = bytes(LOWER[i] if i >= 0x80 or chr(i).isalpha() else 0x20 for i in range(256))


def parts(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased) and of everything beyond U+007F."""
    return text.encode().translate(_LETTERS).split() if text else []


def present(words: Iterable[bytes]) -> set[bytes]:
    """The features of a text: its words, and the beginnings of four and five bytes of its words."""
    w = set(words)
    return w | {b"4" + x[:4] for x in w if len(x) > 4} | {b"5" + x[:5] for x in w if len(x) > 5}


class Model:
    """Weights and intercept; ``both``: whether there were texts of both labels to learn from."""

    def __init__(self, weights: dict[bytes, float], intercept: float, both: bool = True):
        self.intercept, self.both = intercept, both
        self.word = {k: v for k, v in weights.items() if k[:1] not in (b"4", b"5")}
        self.four = {k[1:]: v for k, v in weights.items() if k[:1] == b"4"}
        self.five = {k[1:]: v for k, v in weights.items() if k[:1] == b"5"}

    def logit(self, text: str | None) -> float:
        w = set(parts(text))
        z = self.intercept + sum(self.word[x] for x in w & self.word.keys())
        if self.four:
            z += sum(self.four[x] for x in {x[:4] for x in w if len(x) > 4} & self.four.keys())
        if self.five:
            z += sum(self.five[x] for x in {x[:5] for x in w if len(x) > 5} & self.five.keys())
        return z

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.logit(text)))))


def swaps() -> dict[bytes, bytes]:
    """Each group name to the next of its set."""
    got: dict[bytes, bytes] = {}
    for g in GROUPS:
        for a, b in zip(g, [*g[1:], g[0]]):
            got.setdefault(a.encode(), b.encode())
    return got


def fit(labelled: Callable[[], Iterable[tuple[str | None, int]]], most: int = MOST_FEATURES, swap_weight: float = 1.0, l1: float = 2e-5, rounds: int = 300) -> Model:
    """Fits the model on (text, 0 or 1) rows, which ``labelled()`` must give in the same order each time it is called."""
    swap = swaps()
    neutral = [(f.format(n), None) for g in GROUPS for n in g for f in NEUTRAL]
    seen, n = (Counter(), Counter()), [0, 0]
    for text, y in labelled():
        seen[y].update(present(parts(text)))
        n[y] += 1
    if not all(n):
        p = (n[1] + 0.5) / (sum(n) + 1) if sum(n) else 0.5
        p = min(max(p, 1e-6), 1 - 1e-6)
        return Model({}, math.log(p / (1 - p)), both=False)
    # The features whose presence tells most about the label: the root of the G statistic of the 2 x 2 table.
    z, m_all = {}, sum(n)
    for k in seen[0].keys() | seen[1].keys():
        a, b = seen[1][k], seen[0][k]
        if a + b < 3:
            continue
        g = 0.0
        for have, of in ((a, n[1]), (b, n[0])):
            for o, e in ((have, of * (a + b) / m_all), (of - have, of * (m_all - a - b) / m_all)):
                g += 2 * o * math.log(o / e) if o else 0.0
        if g > 20:
            z[k] = g
    names = sorted(z, key=lambda k: (-z[k], k))[:most]
    names += sorted({k for w in swap for k in present([w])} - set(names))
    at = {k: i for i, k in enumerate(names)}
    rows, cols, ys, pair_rows, pair_cols, pair_sign, pairs = [], [], [], [], [], [], 0
    n_rows = 0
    for text, y in [*labelled(), *neutral]:
        words = parts(text)
        x = {at[k] for k in present(words) if k in at}
        if y is not None:
            rows += [n_rows] * len(x)
            cols += list(x)
            ys.append(y)
            n_rows += 1
        if not swap.keys().isdisjoint(words):
            # The same sentence about another group, and about nobody in particular.
            for changed in ([swap.get(w, w) for w in words], [w for w in words if w not in swap]):
                other = {at[k] for k in present(changed) if k in at}
                for sign, ks in ((1.0, x - other), (-1.0, other - x)):
                    pair_rows += [pairs] * len(ks)
                    pair_cols += list(ks)
                    pair_sign += [sign] * len(ks)
                pairs += 1
    rows, cols, y = np.array(rows, int), np.array(cols, int), np.array(ys, float)
    pair_rows, pair_cols, pair_sign = np.array(pair_rows, int), np.array(pair_cols, int), np.array(pair_sign)
    d, m = len(names), len(y)
    # Both labels weigh the same. FISTA: the smooth part by gradient, the l1 part by soft thresholds.
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (m - y.sum()))
    w = v = np.zeros(d + 1)
    t = 1.0

    def loss_and_slope(u: np.ndarray) -> tuple[float, np.ndarray]:
        s = np.bincount(rows, u[cols], m) + u[d]
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        e = (p - y) * share
        g = np.append(np.bincount(cols, e[rows], d), e.sum())
        f = float(((np.logaddexp(0, s) - y * s) * share).sum())
        if pairs:
            gap = np.bincount(pair_rows, pair_sign * u[pair_cols], pairs)
            g[:d] += 2 * swap_weight * np.bincount(pair_cols, pair_sign * gap[pair_rows], d) / pairs
            f += swap_weight * float((gap**2).mean())
        return f, g

    step = 8.0
    for _ in range(rounds):
        f, g = loss_and_slope(v)
        while True:
            new = v - step * g
            new[:d] = np.sign(new[:d]) * np.maximum(np.abs(new[:d]) - step * l1, 0)
            gap = new - v
            if step < 1e-3 or loss_and_slope(new)[0] <= f + g @ gap + gap @ gap / (2 * step) + 1e-12:
                break
            step /= 2
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    # Toxic texts in the labels tend to hold several telling words; one has to be enough in a short text. Where the
    # labels can be told apart, the boundary therefore goes to the neutral side of the gap between them.
    logit = np.bincount(rows, w[cols], m) + w[d]
    low, high = np.quantile(logit[y > 0], 0.005), np.quantile(logit[y == 0], 0.999)
    return Model({k: float(w[i]) for k, i in at.items() if w[i]}, float(w[d] - (high + 0.3 * (low - high)) if low > high else w[d]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, most_bytes: int) -> list[tuple[str, int]]:
    """The labelled texts to learn from: lowest hashes of the ids first, within both bounds."""
    few = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").alias("y")).withColumn("h", F.xxhash64("i")).orderBy("h", "i", "y").limit(rows)
    # At most ``rows`` labels are sent to the tasks.
    got = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).join(F.broadcast(few), "i").withColumn("n", F.coalesce(F.octet_length("t"), F.lit(0)) + ROW_BYTES)
    from pyspark.sql import Window

    w = Window.orderBy("h", "i", "y", "t").rowsBetween(Window.unboundedPreceding, 0)
    return [(r.t, int(r.y)) for r in got.withColumn("all", F.sum("n").over(w)).where(F.col("all") <= most_bytes).select("t", "y").collect()]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    got = sample(docs, labels, id_col, text_col, label_col, rows, most_bytes)
    return fit(lambda: got)


def classify(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds ``score`` and ``predicted`` to each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        m = sent.value

        def fn(texts):
            s = [m.score(t) for t in texts]
            return s, [int(x >= threshold) for x in s]

        return fn

    return add_columns(docs, [text_col], "score double, predicted int", make)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(remainder_col("doc_id", 5) > 0)
    d = classify(docs, train(docs, labels))
    return d.select("doc_id", (remainder_col("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not judged toxic; all of them if there are no texts of both labels to learn from."""
    model = train(docs, read(spark, sf_dir, "labels"))
    if not model.both:
        return docs
    return classify(docs, model).where("predicted = 0").select(*docs.columns)

"""URL filter: host/path rules first, then gradient-boosted trees on lexical features. DataFrame functions only.

Features of a URL: length, lengths and depth of host and path, digits and hyphens, character entropy of the host's
own part, number of parameters and of query bytes, and two statistics of its suffix (smoothed share of blocked
training URLs per public suffix, and its support). The trees are grown by histograms: each feature is cut at up to
``BINS`` quantiles of the training table, each level of a tree is one grouped aggregation of gradients (a few
thousand sums at most reach the driver, whatever the number of training rows), and the model becomes one column
expression, so scoring is a narrow projection inside the scan's stage.

The training table is a DataFrame ``(url, label)``; ``labelled_urls`` makes the built-in one from lists of host
words and path forms. Rules are ``(host, path, verdict)``; a rule fits its host and every subdomain if the path
starts with the rule's path; the longest rule (host and path together) wins.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged by the trees. Repeated
rows and extra columns pass through.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read
from .common import table as shared

RULES: list[tuple[str, str, str]] = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BINS, TREES, DEPTH, RATE, L2, SUFFIXES = 16, 8, 3, 0.5, 1.0, 200
#: Training rows of a task: small tables are one partition, so that their many short jobs are one task each.
ROWS = 200_000
_GOOD = "almanac diary atlas manuals garden museum library school weather recipes travel history science music city health cycling forum daily river mountain bakery village journal tea-garden".split()
_BAD = "diet-tricks slots-4-you bonus-poker mass-mailer7 popup-click win-cash-now best-loans24 hot-singles click-4-bonus replica-watches77 fast-credit crypto-x10 lottery-prize adult-cams seo-links99 buy-meds-online pillz4u99 freebets777".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in training table ``(url, label)``: label 1 to block."""
    rows = []
    tlds = ["example.com", "example.org", "example.net"]
    for i, w in enumerate(_GOOD):
        for j, t in enumerate(tlds):
            host = f"{['www.', 'blog.', '', 'm.'][(i + j) % 4]}{w}{['', 'house', 'online', 'room'][(i * 3 + j) % 4]}.{t}"
            for k, p in enumerate(["/en/{}", "/de/{}.html", "/fr/{}?page=2&ref=x", "/es/{}/", "/en/{}#top", "/en/{}?utm_source=feed"]):
                rows.append((f"http{'s' * ((i + k) % 2)}://{host}{p.format((i * 37 + j * 11 + k * 101) % 999)}", 0))
    for i, w in enumerate(_BAD):
        for j, t in enumerate(tlds):
            for k, p in enumerate(["/en/{}", "/go.php?id={}&aff=8821&sub=77&clk=1", "/fr/{}?page=2&ref=x", "/es/{}/", "/{}/win/00{}/x9k2", "/en/{}?utm_source=feed"]):
                n = (i * 41 + j * 13 + k * 97) % 999
                rows.append((f"http{'s' * ((i + k) % 2)}://{['www.', '', 'm.'][(i + j) % 3]}{w}.{t}{p.format(n, n)}", 1))
    return spark.createDataFrame(rows, "url string, label int")


def host_col(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def path_col(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.locate("/", rest)
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(F.lit(""))


def _count(s: Column, chars: str) -> Column:
    return (F.length(s) - F.length(F.translate(s, chars, ""))).cast("double")


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    own = F.regexp_replace(F.regexp_replace(host, r"^(www|m|blog)\.", ""), r"\.[^.]*\.[^.]*$", "")
    letters = F.array(*[_count(own, c) for c in "abcdefghijklmnopqrstuvwxyz0123456789-"])
    n = F.greatest(F.length(own), F.lit(1)).cast("double")
    entropy = F.aggregate(letters, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0))
    query = F.when(F.locate("?", u) > 0, F.substring_index(F.substring_index(u, "#", 1), "?", -1)).otherwise(F.lit(""))
    digits = "0123456789"
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length(own).cast("double"),
        "labels": _count(host, "."),
        "depth": _count(path, "/"),
        "path_length": F.length(path).cast("double"),
        "digit_share": _count(u, digits) / F.greatest(F.length(u), F.lit(1)),
        "host_digits": _count(own, digits),
        "host_hyphens": _count(own, "-"),
        "entropy": F.round(entropy, 6),
        "parameters": _count(query, "&") + (query != "").cast("double"),
        "query_length": F.length(query).cast("double"),
    }


def suffix_col(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def fit(table: DataFrame, url_col: str = "url", label_col: str = "label", bins: int = BINS, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, suffixes: int = SUFFIXES) -> dict:
    """The model: cut points, statistics of the ``suffixes`` most frequent suffixes and trees, all of bounded size.

    A URL of any other suffix has the training table's share of blocked URLs, and support 0."""
    t = table.where(F.col(label_col).isin(0, 1)).select(F.col(url_col).alias("u"), F.col(label_col).cast("double").alias("y"))
    t = t.withColumns({"h": host_col(F.col("u")), "p": path_col(F.col("u"))})
    base = t.agg(F.avg("y").alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not base["n"] or base["p"] in (0.0, 1.0):
        p = min(max(base["p"] or 0.0, 0.01), 0.99)
        return {"start": math.log(p / (1 - p)), "trees": [], "suffix": []}
    few = t.groupBy(suffix_col(F.col("h")).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).orderBy(F.desc("n"), "s").limit(suffixes).collect()
    suffix = [(r["s"], (r["k"] + 5 * base["p"]) / (r["n"] + 5), math.log1p(r["n"])) for r in few]
    x = _all_features(F.col("u"), F.col("h"), F.col("p"), suffix, base["p"])
    names = list(x)
    t = t.select("y", *[c.alias(n) for n, c in x.items()])
    cuts = t.agg(*[F.percentile_approx(n, [i / bins for i in range(1, bins)], 10000).alias(n) for n in names]).first()
    cuts = {n: sorted(set(cuts[n])) for n in names}
    # One small code per feature: the number of cut points below the value.
    t = t.select("y", *[reduce(lambda a, b: a + b, [(F.col(n) > c).cast("int") for c in cuts[n]], F.lit(0)).alias(n) for n in names])
    t = shared(t.coalesce(base["n"] // ROWS + 1), "url-codes")
    start = math.log(base["p"] / (1 - base["p"]))
    grown: list[dict] = []
    coded = lambda name, i: F.col(name) > i
    for _ in range(trees):
        z = F.lit(start) + sum((_value(g, coded) for g in grown), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        rows = t.withColumns({"g": F.col("y") - p, "w": p * (1 - p)})
        tree: dict = {"leaf": None}
        for _ in range(depth):
            rows = rows.withColumn("node", _leaf_index(tree, coded))
            long = rows.select("node", "g", "w", F.posexplode(F.array(*names)).alias("f", "b"))
            sums = long.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("w").alias("w")).collect()
            hist: dict = {}
            for r in sums:
                hist.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["w"])
            leaves = _leaves(tree)
            for i, leaf in enumerate(leaves):
                per = hist.get(i)
                if not per:
                    leaf["leaf"] = leaf["leaf"] or 0.0
                    continue
                total_g = sum(v[0] for v in per[0].values())
                total_w = sum(v[1] for v in per[0].values())
                best = (1e-9, None)
                for f in sorted(per):
                    gl = wl = 0.0
                    for b in sorted(per[f])[:-1]:
                        gl, wl = gl + per[f][b][0], wl + per[f][b][1]
                        gain = gl * gl / (wl + L2) + (total_g - gl) ** 2 / (total_w - wl + L2) - total_g**2 / (total_w + L2)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, b, gl, wl))
                leaf["leaf"] = rate * total_g / (total_w + L2)
                if best[1]:
                    f, b, gl, wl = best[1]
                    leaf.update(name=names[f], bin=b, cut=cuts[names[f]][b], yes={"leaf": rate * (total_g - gl) / (total_w - wl + L2)}, no={"leaf": rate * gl / (wl + L2)})
        grown.append(tree)
    discard(t)
    return {"start": start, "trees": grown, "suffix": suffix, "share": base["p"]}


def _all_features(url: Column, host: Column, path: Column, suffix: list, share: float) -> dict[str, Column]:
    x = features(url, host, path)
    if suffix:
        rates = F.create_map(*[F.lit(v) for s, r, _ in suffix for v in (s, float(r))])
        support = F.create_map(*[F.lit(v) for s, _, n in suffix for v in (s, float(n))])
        x["suffix_rate"] = F.coalesce(F.try_element_at(rates, suffix_col(host)), F.lit(float(share)))
        x["suffix_support"] = F.coalesce(F.try_element_at(support, suffix_col(host)), F.lit(0.0))
    return x


def _leaves(tree: dict) -> list[dict]:
    return [*_leaves(tree["no"]), *_leaves(tree["yes"])] if "name" in tree else [tree]


def _leaf_index(tree: dict, test) -> Column:
    at = iter(range(1 << 20))

    def walk(t: dict) -> Column:
        if "name" not in t:
            return F.lit(next(at))
        no = walk(t["no"])
        return F.when(test(t["name"], t["bin"]), walk(t["yes"])).otherwise(no)

    return walk(tree)


def _value(tree: dict, test) -> Column:
    if "name" not in tree:
        return F.lit(float(tree["leaf"]))
    return F.when(test(tree["name"], tree["bin"]), _value(tree["yes"], test)).otherwise(_value(tree["no"], test))


def _score(tree: dict) -> Column:
    """As ``_value``, on feature values in place of their codes."""
    if "name" not in tree:
        return F.lit(float(tree["leaf"]))
    return F.when(F.col(f"__{tree['name']}") > F.lit(float(tree["cut"])), _score(tree["yes"])).otherwise(_score(tree["no"]))


def judge(df: DataFrame, model: dict, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``score`` (the trees' probability of a block) and ``verdict``."""
    new = {"host", "path", "rule", "score", "verdict"}
    keep = [c for c in df.columns if c.lower() not in new or c == url_col]
    d = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url_col}`").alias("__u"))
    d = d.withColumns({"__host": host_col(F.col("__u")), "__path": path_col(F.col("__u"))})
    x = _all_features(F.col("__u"), F.col("__host"), F.col("__path"), model["suffix"], model.get("share", 0.5))
    used = set()
    for t in model["trees"]:
        _names(t, used)
    d = d.withColumns({f"__{n}": x[n] for n in sorted(used)}) if used else d
    z = F.lit(model["start"]) + sum((_score(t) for t in model["trees"]), F.lit(0.0))
    rule = verdict = F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last that fits is the longest
        fits = ((F.col("__host") == host) | F.col("__host").endswith("." + host)) & F.col("__path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    score = 1 / (1 + F.exp(-z))
    out = d.withColumns({"__rule": rule, "__v": verdict, "__score": score})
    return out.select(*[F.col(f"`{c}`") for c in keep if c.lower() not in new], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__score").alias("score"), F.coalesce("__v", F.when(F.col("__score") >= threshold, "block").otherwise("allow")).alias("verdict"))


def _names(tree: dict, into: set[str]) -> None:
    if "name" in tree:
        into.add(tree["name"])
        _names(tree["yes"], into)
        _names(tree["no"], into)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")

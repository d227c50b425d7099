"""Containment join: which texts hold which needles, by postings of short substrings.

A text that holds a needle holds each of the needle's trigrams. Of these the one that the fewest texts hold is looked up,
and what it finds is verified; a needle with a trigram that no text has finds nothing. So the work follows the rarest part
of each needle, and the join is an equality of trigrams, never a comparison of all needles with all texts. Needles of one or
two characters are looked up whole among the texts' substrings of that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small, written

WIDTH = 3


def grams(text: Column, width: int) -> Column:
    """The distinct substrings of a length; none of a shorter text."""
    n = F.char_length(text)
    at = F.when(n >= width, F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(width))))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """``needle, text``: all pairs of a needle (``needle``) and a text (``text``) that holds it.

    Each of both counts once; null and empty needles are in no text, nulls hold nothing. The texts are read twice (to count the
    substrings that needles ask for, and to find them), the needles are written once.
    """
    q = needles.where("needle IS NOT NULL AND needle <> ''").select("needle").distinct()
    width = F.least(F.char_length("needle"), F.lit(WIDTH))
    parts = F.when(width == 1, grams(F.col("needle"), 1)).when(width == 2, grams(F.col("needle"), 2)).otherwise(grams(F.col("needle"), WIDTH))
    asked = written(q.select("needle", width.alias("width"), F.explode(parts).alias("gram")))
    widths = [r.width for r in asked.select("width").distinct().collect()]  # at most three rows
    t = texts.where("text IS NOT NULL").select("text").distinct()
    wanted = small(asked.select("gram").distinct())
    post = lambda: t.select("text", F.explode(F.concat(*[grams(F.col("text"), w) for w in widths]) if widths else F.array().cast("array<string>")).alias("gram"))
    seen = post().join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = asked.join(seen, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    best = written(best.where("x.n > 0").select("needle", "x.gram"))
    return small(best).join(post(), "gram").where(F.contains("text", F.col("needle"))).select("needle", "text")

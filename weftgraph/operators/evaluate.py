"""Evaluation of answers: normalisation, per-sample scores, averages, coverage and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_ws


def normalize_answers(c: Column) -> Column:
    """Normalised, without empty ones and "insufficient", each where it first occurs."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), norm_ws), lambda x: (x != "") & (x != "insufficient")))


def score_prediction(df: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """Adds exact_match, hit_at_1, precision, recall and f1 (both empty: 1, 0, 0, 1, 0)."""
    d = df.withColumns({"__p": normalize_answers(F.col(predicted)), "__g": normalize_answers(F.col(gold))})
    both, p, g = F.size(F.array_intersect("__p", "__g")), F.size("__p"), F.size("__g")
    precision = F.when(p > 0, both / p).otherwise(0.0)
    recall = F.when(g > 0, both / g).otherwise(F.when(p == 0, 1.0).otherwise(0.0))
    d = d.withColumns({"exact_match": ((both == p) & (both == g)).cast("double"), "hit_at_1": F.coalesce(F.array_contains("__g", F.get("__p", F.lit(0))), F.lit(False)).cast("double"), "precision": precision, "recall": recall, "empty_prediction": (p == 0).cast("double")})
    s = F.col("precision") + F.col("recall")
    return d.withColumn("f1", F.when((s > 0) & (F.col("precision") > 0), 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0)).drop("__p", "__g")


def average_metrics(scored: DataFrame, candidates: str | None = None) -> DataFrame:
    """Means over all samples; zeros without samples."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    aggs = [mean(c).alias(c) for c in ("exact_match", "hit_at_1", "precision", "recall", "f1")]
    return scored.agg(F.count(F.lit(1)).alias("samples"), *aggs, mean("empty_prediction").alias("empty_prediction_rate"), *([mean(candidates).alias("avg_candidate_paths")] if candidates else []))


def coverage(df: DataFrame, gold: str = "gold", graph: str = "graph", paths: str = "paths") -> DataFrame:
    """Hits of gold answers among the graph's and the candidate paths' nodes, per sample."""
    g = normalize_answers(F.col(gold))
    d = df.withColumns({"gold_count": F.size(g), "graph_hits": F.size(F.array_intersect(g, normalize_answers(F.col(graph)))), "path_hits": F.size(F.array_intersect(g, normalize_answers(F.col(paths))))})
    return d.withColumns({"full_hit": (F.col("gold_count") > 0) & (F.col("path_hits") == F.col("gold_count")), "zero_hit": F.col("path_hits") == 0})


def coverage_summary(covered: DataFrame) -> DataFrame:
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return covered.agg(F.count(F.lit(1)).alias("samples"), F.sum("gold_count").alias("gold"), F.sum("graph_hits").alias("graph_hits"), F.sum("path_hits").alias("path_hits"), F.count_if("full_hit").alias("full_hits"), F.count_if("zero_hit").alias("zero_hits"), (F.count_if("full_hit") / n).alias("full_rate"), (F.count_if("zero_hit") / n).alias("zero_rate"))


def bucket(exact_match: Column, recall: Column) -> Column:
    return F.when(exact_match >= 1, "correct").when(recall > 0, "partial").otherwise("wrong")

"""Incremental triples: new files are appended once each; a restart goes on where it stopped (checkpoint)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TRIPLES = "head string, relation string, tail string, tail_kind string"


def triple_stream(spark: SparkSession, folder: str) -> DataFrame:
    d = spark.readStream.schema(TRIPLES).parquet(folder)
    return d.withColumn("tail_kind", F.coalesce(F.lower(F.trim("tail_kind")), F.lit("id"))).where("head IS NOT NULL AND relation IS NOT NULL AND tail IS NOT NULL")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends whatever is new in ``folder`` to ``out`` and stops."""
    return triple_stream(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def relation_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("relation").agg(F.count(F.lit(1)).alias("frequency"))

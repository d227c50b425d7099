"""Readers and writers: RDF parquet, triple JSON, question JSONL, entity/triple CSV, predictions; resume by anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RDF = "subject string, predicate string, object string, object_type string, object_language string"
TRIPLE = "head string, relation string, tail string"
ENTITIES_CSV = "id string, name string, aliases string, types string, is_cvt string"
TRIPLETS_CSV = "head string, head_name string, relation string, tail string, tail_name string, tail_kind string"


def rdf_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """All ``data-*.parquet`` of a folder; an error if there are none."""
    return spark.read.schema(RDF).parquet(f"{folder}/data-*.parquet")


def triples_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {head, relation, tail}."""
    return spark.read.schema(TRIPLE).json(path, multiLine=True)


def question_graphs(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """JSONL with ``question, answer[], q_entity[], a_entity[], graph[][3]``; ``limit`` counts physical lines.

    A missing id becomes ``sample-<line>``; blank lines are skipped.
    """
    # The number of a line within its file: lines before its split (counted once per split) and its place in the split.
    m = F.col("_metadata")
    raw = spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"))
    counts = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    lines = raw.join(starts, ["file", "block"]).select((F.col("place") - F.col("first") + F.col("before")).alias("line"), "value").where(F.trim("value") != "")
    if limit > 0:
        lines = lines.where(F.col("line") < limit)
    schema = "id string, question string, answer array<string>, q_entity array<string>, a_entity array<string>, graph array<array<string>>"
    d = lines.select("line", F.from_json("value", schema).alias("x")).select("line", "x.*")
    return d.withColumn("id", F.coalesce("id", F.concat(F.lit("sample-"), F.col("line"))))


def graph_triples(questions: DataFrame) -> DataFrame:
    """The question graphs' rows of exactly three parts, as ``id, head, relation, tail``."""
    g = F.filter(F.coalesce("graph", F.array().cast("array<array<string>>")), lambda r: F.size(r) == 3)
    return questions.select("id", F.explode(g).alias("t")).select("id", F.col("t")[0].alias("head"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("tail"))


def questions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSONL with ``id, question, answers[{kb_id, text}]``: the non-blank answer texts."""
    schema = "id string, question string, answers array<struct<kb_id:string,text:string>>"
    d = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("x")).select("x.*")
    texts = F.filter(F.transform(F.coalesce("answers", F.array().cast("array<struct<kb_id:string,text:string>>")), lambda a: F.trim(a["text"])), lambda t: t.isNotNull() & (t != ""))
    return d.select("id", "question", texts.alias("answers"))


def _checked(d: DataFrame, rules: dict[str, str], validate: bool) -> DataFrame:
    """Fails at run time on the first row that breaks a rule."""
    if not validate:
        return d
    for message, rule in rules.items():
        first = d.columns[0]
        d = d.withColumn(first, F.when(F.expr(rule), F.col(first)).otherwise(F.raise_error(F.lit(message)).cast("string")))
    return d


def entities_csv(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """Processed entities, columns by name whatever their order: ``mid, name, aliases, types, is_cvt``."""
    d = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = {"id", "name", "aliases", "types", "is_cvt"} - set(d.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    d = _checked(d, {"an entity id has to begin with m. or g.": "id LIKE 'm.%' OR id LIKE 'g.%'", "is_cvt has to be 0 or 1": "is_cvt IN ('0', '1')"}, validate)
    many = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), lambda x: F.trim(x) != "")
    return d.select(F.col("id").alias("mid"), F.coalesce("name", F.lit("")).alias("name"), many("aliases").alias("aliases"), many("types").alias("types"), (F.col("is_cvt") == "1").alias("is_cvt"))


def triplets_csv(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    d = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = {"head", "relation", "tail", "tail_kind"} - set(d.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    d = _checked(d.select("head", "relation", "tail", "tail_kind"), {"tail_kind has to be id or literal": "tail_kind IN ('id', 'literal')", "an id tail has to begin with m. or g.": "tail_kind <> 'id' OR tail LIKE 'm.%' OR tail LIKE 'g.%'"}, validate)
    return d


def legacy_csv(spark: SparkSession, entities: str, triples: str) -> tuple[DataFrame, DataFrame]:
    """``mid, name, aliases`` and ``head, relation, relation_name, tail`` files."""
    e = spark.read.option("header", True).csv(entities)
    e = e.select("mid", F.coalesce("name", F.lit("")).alias("name"), F.filter(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda x: F.trim(x) != "").alias("aliases"), F.array().cast("array<string>").alias("types"), F.lit(False).alias("is_cvt"))
    t = spark.read.option("header", True).csv(triples)
    return e, t.select("head", "relation", "relation_name", "tail", F.when(F.col("tail").startswith("m.") | F.col("tail").startswith("g."), "id").otherwise("literal").alias("tail_kind"))


def write_csv(entities: DataFrame, triples: DataFrame, path: str) -> None:
    joined = lambda c: F.array_join(F.array_sort(c), "|").alias(c)
    entities.select(F.col("mid").alias("id"), "name", joined("aliases"), joined("types"), F.col("is_cvt").cast("int").alias("is_cvt")).write.mode("overwrite").option("header", True).csv(f"{path}/entities")
    triples.select("head", "head_name", "relation", "tail", "tail_name", "tail_kind").write.mode("overwrite").option("header", True).csv(f"{path}/triplets")


PREDICTION = "id string, question string, predicted array<string>, gold array<string>, exact_match double, recall double"


def write_predictions(predictions: DataFrame, path: str, bucket: str | None = None) -> None:
    """JSON lines, in fixed field order; ``bucket``: a column that names the sub-folder."""
    w = predictions.write.mode("append")
    (w.partitionBy(bucket) if bucket else w).json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions that parse."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", PREDICTION, {"mode": "PERMISSIVE"}).alias("x")).select("x.*").where("id IS NOT NULL")


def still_to_do(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: the samples without a prediction."""
    return samples.join(done.select("id").distinct(), "id", "left_anti")

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import bpe, common, decontaminate, jaccard_join, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "ids", "n_tokens"]
    assert 0 < out.count() <= docs.count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert not decontaminate.decontaminate(out.drop("ids", "n_tokens"), bench).where("contaminated").count()
    rows = out.collect()
    assert all(r.n_chars == len(r.text) and len(r.ids) == r.n_tokens for r in rows)
    left = suffix_dedup.brute([r.text.encode() for r in rows], suffix_dedup.STAGE_LENGTH, False)
    assert sum(bool(x) for x in left) <= 0.02 * len(rows)


def edge_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows and ids."""
    long = " ".join(f"word{k * k % 7919}x{k}" for k in range(30_000))
    same = " ".join(f"tie{k}" for k in range(60))
    return [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", "en", None, 3), (4, long, "en", "s", len(long)), (5, same, "en", "s", len(same)), (6, same, "en", "s", len(same)), (6, same, "en", "s", len(same)), (None, "no id here", "en", "s", 10), (7, "one text of this id", None, "s", None), (7, "another text of it entirely", "en", "s", 27)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edge"))
    spark.createDataFrame([(2, 0), (None, 1), (4, None)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "a b c"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(edge_rows(), DOC).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("stage", [toxicity.stage, jaccard_join.stage, suffix_dedup.stage, decontaminate.stage, bpe.stage])
def test_stages_on_odd_rows(spark, tables, stage):
    d = spark.read.parquet(f"{tables}/documents.parquet")
    out = stage(spark, d, tables)
    assert out.columns[:5] == d.columns
    assert stage(spark, d.limit(0), tables).count() == 0
    got = out.collect()
    count = collections.Counter((r.doc_id, r.text) for r in got)
    if stage is jaccard_join.stage:
        want = collections.Counter({(r[0], r[1]): 1 for r in edge_rows() if r[0] != 6})
        assert count == want
    elif stage is suffix_dedup.stage:
        same = edge_rows()[4][1]
        assert count == collections.Counter((r[0], "" if r[0] == 6 else r[1]) for r in edge_rows()) and (5, same) in count
        assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    else:
        assert count == collections.Counter((r[0], r[1]) for r in edge_rows())


def test_stages_keep_extra_columns(spark, tables):
    d = spark.read.parquet(f"{tables}/documents.parquet").withColumns({"kept": F.lit(1), "score": F.lit("x"), "items": F.lit(2.5), "representative": F.lit(True)})
    for stage in (toxicity.stage, jaccard_join.stage, decontaminate.stage):
        assert stage(spark, d, tables).columns == d.columns


def test_run_deletes_what_it_wrote(spark, tables):
    older = common.tables()
    out = corpus_pipeline.run(spark, tables)
    assert common.tables() - older == {out._weftgraph_path} and out.count() > 0

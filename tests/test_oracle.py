"""Registered queries against their SQL on the smallest tables."""

import collections
import zlib

import duckdb
import pytest

from weftgraph.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SOME = [
    "kg_neighbors_soft", "kg_neighbors_strict", "kg_node_metadata", "kg_entity_resolve_like", "kg_relation_resolve_jaccard",
    "kg_node_stats", "kg_direct_edges", "kg_two_hop_between", "kg_verify_pairs", "kg_frontier_relations", "kg_frontier_summary",
    "kg_set_intersect", "kg_argmax_numeric", "kg_collect_constrained", "kg_expand_budgeted", "kg_reach_k", "kg_bfs_paths",
    "kg_question_loop", "kg_expand_paths", "kg_shortest_path_len", "kg_source_target_paths", "kg_branch_reduce", "kg_prune_status",
    "kg_path_rerank", "kg_path_select_diverse", "kg_path_dedupe", "etl_cvt_detect", "etl_cvt_flatten", "etl_entities",
    "txt_normalize_catalog", "txt_token_overlap", "vec_cosine_topk", "json_tolerant_parse", "eval_score_prediction", "eval_buckets",
]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(pdf, names):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in pdf[names].itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got, names) == rows(want, names)


def test_crc_buckets(spark, db):
    """Every bucket against the CRC of each edge's parts."""
    from weftgraph.sources import star

    edges = db.execute(f"{star.SQL_PREFIX} SELECT head, relation, tail FROM kg_triples").fetchall()
    want = collections.Counter(zlib.crc32("\u001f".join(e).encode()) % 128 for e in edges)
    assert {r.bucket: r.n for r in QUERIES["txt_crc_bucket"](spark, SF).collect()} == want


def test_registry_is_consistent():
    assert set(ORACLE_SQL) <= set(QUERIES)

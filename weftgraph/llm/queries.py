"""The queries of the corpus operators: ``QUERIES`` by name, ``ORACLE_SQL`` where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_bpe
from .decontaminate import op10_decontaminate
from .html_text import op2_html
from .importance import op4_importance
from .interpolation import op1_interpolation
from .jaccard_join import op3_jaccard
from .sequenced_changes import ORACLE as CHANGES_SQL
from .sequenced_changes import op13_sequenced_changes
from .simhash import op11_simhash
from .suffix_dedup import op9_suffix_dedup
from .target_resampling import op12_target_resampling
from .toxicity import op6_toxicity
from .url_filter import op8_url_filter
from .vector_search import ORACLE as TOPK_SQL
from .vector_search import op7_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_interpolation": op1_interpolation,
    "op2_html": op2_html,
    "op3_jaccard": op3_jaccard,
    "op4_importance": op4_importance,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_topk": op7_topk,
    "op8_url_filter": op8_url_filter,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_simhash": op11_simhash,
    "op12_target_resampling": op12_target_resampling,
    "op13_sequenced_changes": op13_sequenced_changes,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components: every document takes the least id that it reaches over the links.
JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.both >= 85 * (x.n + y.n - p.both)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

_BENCH_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents), b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(i) WHERE len(w) > 0),
x AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM d, (SELECT DISTINCT m FROM p) q, unnest(range(1, greatest(len(w) - m + 2, 1))) t(i)),
h AS (SELECT x.doc_id, x.i, x.m, p.item_id FROM x JOIN p ON p.m = x.m AND p.s = x.s),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(0, m)) t(k) GROUP BY doc_id),
n AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(len(n.items), 0) AS n_items, sha256(coalesce(array_to_string(n.items, ','), '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard": JACCARD_SQL,
    "op7_topk": TOPK_SQL,
    "op10_decontaminate": DECONTAMINATE_SQL,
    "op13_sequenced_changes": CHANGES_SQL,
}

"""Context-aware reranking of candidates: expansion targets, entity candidates, start nodes, dependency seeds, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_catalog, overlap_left, tokens, type_names
from .aggregate import frontier_relations
from .lookup import having_relation, metadata, touching
from .store import GraphStore, around, node_table, small, written

# Words put before and after a name to find entities of a type, and the ends of a place's qualifier.
TYPE_WORDS: dict[str, list[str]] = {
    "state": ["state", "us state"],
    "country": ["country", "nation"],
    "nation": ["country", "nation"],
    "city": ["city", "town"],
    "person": ["person"],
    "organization": ["organization"],
    "sports team": ["team", "sports team"],
    "educational institution": ["university", "college", "school"],
    "college": ["college", "university", "school"],
    "university": ["university", "college"],
    "school": ["school"],
    "religion": ["religion"],
    "language": ["language"],
    "film": ["film", "movie"],
    "book": ["book"],
    "tv series": ["tv series", "television series", "show"],
    "radio station": ["radio station"],
    "character": ["character", "fictional character"],
}
PLACES = ["administrative division", "city", "citytown", "country", "location", "place", "region", "state", "town"]
STOPS = ["and", "are", "for", "from", "has", "have", "in", "is", "of", "or", "that", "the", "to", "was", "were", "what", "where", "which", "who", "with"]
DATES = {"date", "year", "datetime", "time"}


def _any(names: list[str], test) -> Column:
    return F.exists(F.array(*[F.lit(n) for n in names]), test) if names else F.lit(False)


def rerank_expansion(targets: DataFrame, store: GraphStore, expected_types: list[str], relations: list[str] | DataFrame, terms: list[str], constraint_targets: list[str], keys: list[str]) -> DataFrame:
    """Adds ``rerank_score`` and ``rerank_pos`` to targets (``keys, node, pos``).

    8 for a type name in name or types (else 2 for a shared word), 6 for an edge of a hinted relation, 2 per term, 3 for
    an edge to a constraint's target, -2 for mediators and for literals where no date is expected. All zero: as it was.
    ``relations``: the hinted ones, for all targets or as rows (``keys, hint``).
    """
    names = sorted({n for t in expected_types for n in type_names(t)})
    ids = node_table(targets, store.edges, "head", "tail")
    m = metadata(ids, store)
    d = targets.join(m, "node", "left")
    hinted = isinstance(relations, DataFrame) or bool(relations)
    if isinstance(relations, DataFrame):
        ahead, back = around(store.edges, ids)
        ends = ahead.select(F.col("head").alias("node"), F.col("relation").alias("hint")).union(back.where("tail_kind = 'id'").select(F.col("tail").alias("node"), F.col("relation").alias("hint")))
        ends = ends.join(small(ids), "node", "left_semi").distinct()
        hit = targets.select(*keys, "node").join(ends, "node").join(small(relations), [*keys, "hint"], "left_semi").select(*keys, "node").distinct()
        d = d.join(hit.withColumn("__r", F.lit(True)), [*keys, "node"], "left")
    elif relations:
        d = d.join(having_relation(ids, store.edges, relations).withColumn("__r", F.lit(True)), "node", "left")
    if constraint_targets:
        d = d.join(touching(ids, store.edges, constraint_targets).withColumn("__c", F.lit(True)), "node", "left")
    hay = norm_catalog(F.concat_ws(" ", "name", F.concat_ws(" ", "types")))
    s = F.when(_any(names, lambda n: F.contains(hay, n)), 8.0).when(_any(names, lambda n: F.arrays_overlap(tokens(n), tokens(hay))), 2.0).otherwise(0.0)
    s = s + (F.when(F.col("__r"), 6.0).otherwise(0.0) if hinted else 0.0) + (F.when(F.col("__c"), 3.0).otherwise(0.0) if constraint_targets else 0.0)
    for t in terms:
        s = s + F.when(F.contains(hay, norm_catalog(F.lit(t))), 2.0).otherwise(0.0)
    s = s - F.when(F.col("is_probable_cvt"), 2.0).otherwise(0.0)
    if names and not DATES & set(names):
        s = s - F.when(F.col("is_literal"), 2.0).otherwise(0.0)
    w = Window.partitionBy(*keys).orderBy(F.desc("rerank_score"), "pos")
    return d.withColumn("rerank_score", s).withColumn("rerank_pos", F.row_number().over(w)).select(*targets.columns, "rerank_score", "rerank_pos")


def name_variants(mentions: DataFrame) -> DataFrame:
    """``mention, variant, ord`` of mentions (``mention, expected_type, context``): spans of the context, the name, spellings, with type words."""
    name, ctx = F.trim("mention"), F.coalesce("context", F.lit(""))
    kind = norm_catalog(F.col("expected_type"))
    quoted = F.concat(F.lit(r"(?i)(?<!\w)\Q"), name, F.lit(r"\E\s*,\s*([^,;?]+)"))
    spans = F.regexp_extract_all(ctx, quoted, F.lit(1))

    def qualifier(s: Column) -> Column:
        ws = F.filter(F.transform(F.split(F.trim(s), r"\s+"), lambda w: F.regexp_replace(w, r"^[\"'()\[\]{}]+|[\"'()\[\]{}]+$", "")), lambda w: w != "")
        stop = F.array_position(F.transform(ws, lambda w: F.regexp_replace(F.lower(w), r"^\.+|\.+$", "").isin(STOPS)), True)
        return F.array_join(F.slice(ws, 1, F.least(F.lit(4), F.when(stop > 0, stop - 1).otherwise(F.size(ws))).cast("int")), " ")

    place = _any(PLACES, lambda p: F.contains(kind, p))
    quals = F.filter(F.transform(spans, qualifier), lambda q: q != "")
    compound = F.when(place, F.flatten(F.transform(quals, lambda q: F.array(F.concat(name, F.lit(", "), q), F.concat(name, F.lit(" "), q))))).otherwise(F.array().cast("array<string>"))
    words = F.split(name, r"\s+")
    person = (kind == "person") | F.contains(kind, F.lit("character"))

    def spelled(test: str, cut: int, tail: str) -> Column:
        hits = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (F.length(F.get(words, i - 1)) >= 5) & F.lower(F.get(words, i - 1)).endswith(test))
        return F.transform(hits, lambda i: F.array_join(F.transform(words, lambda w, j: F.when(j == i - 1, F.concat(w.substr(F.lit(1), F.length(w) - cut), F.lit(tail))).otherwise(w)), " "))

    typos = F.when(person, F.concat(spelled("d", 1, ""), spelled("nd", 2, "n"))).otherwise(F.array().cast("array<string>"))
    table = F.create_map(*[x for k, v in TYPE_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    near = F.coalesce(F.try_element_at(table, kind), F.array().cast("array<string>"))
    geo = kind.isin("state", "country", "nation", "city")

    def typed(n: Column) -> Column:
        both = F.flatten(F.transform(near, lambda s: F.array(F.concat(n, F.lit(" "), s), F.concat(s, F.lit(" "), n))))
        of = F.flatten(F.transform(near, lambda s: F.array(F.concat(n, F.lit(" "), s, F.lit(" of")), F.concat(s, F.lit(" of "), n))))
        return F.when(geo, F.concat(both, of)).otherwise(both)

    every = F.concat(compound, F.array(name), typos, F.flatten(F.transform(F.concat(F.array(name), typos), typed)))
    return mentions.select("mention", F.posexplode(F.array_distinct(F.filter(every, lambda x: F.trim(x) != ""))).alias("ord", "variant"))


def rerank_entities(candidates: DataFrame, store: GraphStore, expected_type: str | None, context: str, widest: int = 6) -> DataFrame:
    """Adds ``context_score`` and ``context_rank`` to candidates (``mention, mid, score``).

    Type overlap with metadata (25) and relations (10), +30 for a match, -10 for none and -20 more where a candidate's
    types all lie in another domain than those of the mention's matching candidates, context overlap (12, 14), -3 for
    mediators. If any candidate of a mention has the type, the others go.
    """
    candidates = written(candidates)  # found once: what follows reads them again and again
    nodes = candidates.select(F.col("mid").alias("node")).distinct()
    m = metadata(nodes, store)
    r = frontier_relations(nodes.withColumn("mid", F.col("node")), store, ["mid"], literals=False)
    w = Window.partitionBy("mid").orderBy(F.desc("support_ratio"), F.desc("supporting_node_count"), "relation", "direction")
    r = r.withColumn("n", F.row_number().over(w)).where(F.col("n") <= widest)
    r = r.groupBy("mid").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.concat_ws(" ", "relation", F.concat_ws(" ", "sample_target_types"), F.concat_ws(" ", "sample_target_names"))))).alias("rel_text"))
    d = candidates.join(m.withColumnRenamed("node", "mid"), "mid").join(r, "mid", "left")
    meta, rel = F.concat_ws(" ", "name", F.concat_ws(" ", "types")), F.coalesce("rel_text", F.lit(""))
    s = F.col("score") + 12.0 * overlap_left(F.lit(context), meta) + 14.0 * overlap_left(F.lit(context), rel) - F.when(F.col("is_probable_cvt"), 3.0).otherwise(0.0)
    names = type_names(expected_type)
    match = _any(names, lambda n: F.contains(norm_catalog(F.concat_ws(" ", "types")), n))
    if names:
        s = s + 25.0 * overlap_left(F.lit(expected_type), meta) + 10.0 * overlap_left(F.lit(expected_type), rel) + F.when(match, 30.0).otherwise(-10.0)
    d = d.withColumns({"__s": s, "type_match": match, "__d": F.array_distinct(F.transform("types", lambda t: F.substring_index(t, ".", 1)))})
    home = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("type_match"), F.col("__d"))).over(Window.partitionBy("mention"))))
    foreign = ~F.col("type_match") & (F.size(home) > 0) & (F.size("__d") > 0) & ~F.arrays_overlap(home, F.col("__d"))
    d = d.withColumn("context_score", F.round(F.col("__s") - F.when(foreign, 20.0).otherwise(0.0), 6)).drop("__s", "__d")
    some = F.max(F.col("type_match").cast("int")).over(Window.partitionBy("mention"))
    d = d.withColumn("__any", some).where("type_match OR __any = 0")
    rank = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("context_score"), "mid"))
    return d.withColumn("context_rank", rank).select(*candidates.columns, "type_match", "context_score", "context_rank")


def keep_close(ranked: DataFrame, most: int = 5) -> DataFrame:
    """Without a policy's pick: the candidates near the best one, ``max(.9 * best, best - 4)`` or more."""
    best = F.max("context_score").over(Window.partitionBy("mention"))
    return ranked.withColumn("__b", best).where(F.col("context_score") >= F.greatest(F.col("__b") * 0.9, F.col("__b") - 4)).where(F.col("context_rank") <= most).drop("__b")


def start_nodes(nodes: DataFrame, store: GraphStore, expected_type: str, question: str, most: int = 2) -> DataFrame:
    """The best start nodes (``qid, node``): 18 x type match + 14 x metadata overlap + 12 x relation overlap - 4 for mediators."""
    m = metadata(nodes.select("node"), store)
    r = frontier_relations(nodes.select("node").withColumn("start", F.col("node")), store, ["start"], literals=False, samples=0)
    r = r.groupBy(F.col("start").alias("node")).agg(F.concat_ws(" ", F.array_sort(F.collect_set("relation"))).alias("rel_text"))
    d = nodes.join(m, "node").join(r, "node", "left")
    match = _any(type_names(expected_type), lambda n: F.contains(norm_catalog(F.concat_ws(" ", "types")), n))
    s = 18.0 * match.cast("double") + 14.0 * overlap_left(F.lit(question), F.concat_ws(" ", "name", F.concat_ws(" ", "types"))) + 12.0 * overlap_left(F.lit(question), F.coalesce("rel_text", F.lit(""))) - F.when(F.col("is_probable_cvt"), 4.0).otherwise(0.0)
    d = d.withColumn("start_score", F.round(s, 6))
    return d.withColumn("start_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("start_score"), "node"))).where(F.col("start_rank") <= most).select("qid", "node", "start_score", "start_rank")


def order_seeds(seeds: DataFrame, store: GraphStore, question: str, provenance: Column) -> DataFrame:
    """Dependency seeds in order (none dropped): overlap with provenance and metadata, -2 for mediators, a little for degree."""
    m = metadata(seeds.select("node"), store)
    d = seeds.join(m, "node")
    s = 14.0 * overlap_left(F.lit(question), provenance) + 10.0 * overlap_left(F.lit(question), F.concat_ws(" ", "name", F.concat_ws(" ", "types"))) - F.when(F.col("is_probable_cvt"), 2.0).otherwise(0.0) + F.least(F.lit(2.0), F.col("degree") / 2000.0)
    d = d.withColumn("seed_score", F.round(s, 6))
    return d.withColumn("seed_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("seed_score"), "node"))).select("qid", "node", "seed_score", "seed_rank")


def apply_verdicts(states: DataFrame, verdicts: DataFrame, hop: int) -> DataFrame:
    """A policy's verdicts (``qid, signature, semantic, answer, continue_, verdict``) on states: scores only rise, and unprotected states may go."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    d = states.join(verdicts, ["qid", "signature"], "left")
    d = d.withColumns({
        "semantic_score": F.greatest("semantic_score", clamp(F.col("semantic"))),
        "answer_score": F.greatest("answer_score", clamp(F.col("answer"))),
        "type_score": F.greatest("type_score", clamp(F.col("continue_"))),
    })
    gone = (F.lower(F.trim(F.coalesce("verdict", F.lit("continue")))) == "discard") & (F.col("protected_until") < hop)
    return d.where(~gone).select(states.columns)

"""Command line: RDF to tables, build (or go on building) a store, inspect entities and relations, search paths."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import etl, lookup, rank, traverse
from .operators.build import build
from .operators.store import GraphStore
from .sources import files


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="weftgraph")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("entities"), b.add_argument("triples"), b.add_argument("store")
    b.add_argument("--no-validation", action="store_true"), b.add_argument("--fresh", action="store_true"), b.add_argument("--parts", type=int, default=8)
    r = sub.add_parser("etl")
    r.add_argument("rdf"), r.add_argument("out"), r.add_argument("--main-view", choices=["flattened", "raw"], default="flattened")
    r.add_argument("--no-flatten", action="store_true"), r.add_argument("--drop-base", action="store_true"), r.add_argument("--hint", action="append", default=[])
    i = sub.add_parser("inspect")
    i.add_argument("store"), i.add_argument("--entity"), i.add_argument("--relation"), i.add_argument("--top", type=int, default=10)
    s = sub.add_parser("search")
    s.add_argument("store"), s.add_argument("seeds", nargs="+")
    s.add_argument("--strategy", choices=["hybrid", "beam", "bfs", "two_hop", "source_target"], default="hybrid")
    s.add_argument("--target", action="append", default=[]), s.add_argument("--hint", action="append", default=[])
    s.add_argument("--type", action="append", default=[]), s.add_argument("--depth", type=int, default=2), s.add_argument("--paths", type=int, default=50)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    if a.command == "build":
        check = not a.no_validation
        done = lambda name, got: print(name, got["rows"], flush=True)
        got = build(files.triplets_csv(spark, a.triples, check), files.entities_csv(spark, a.entities, check), a.store, a.parts, a.fresh, progress=done)
        print(json.dumps({k: got[k] for k in ("edges", "skipped", "features")}))
        return
    if a.command == "etl":
        config = etl.EtlConfig(main_view=a.main_view, flatten=not a.no_flatten, drop_base=a.drop_base, mediator_hints=tuple(a.hint or etl.MEDIATOR_HINTS))
        print(json.dumps(etl.write(files.rdf_parquet(spark, a.rdf), a.out, config)))
        return
    g = GraphStore.load(spark, a.store)
    one = lambda c, xs: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    if a.command == "inspect":
        if a.entity:
            lookup.resolve_entities(one("mention", [a.entity]), g, a.top, like=True).show(a.top, False)
        if a.relation:
            lookup.resolve_relations(one("hint", [a.relation]), g, a.top).show(a.top, False)
        return
    ids = [x for x in a.seeds if x.startswith(("m.", "g."))]
    seeds = one("node", ids)
    names = [x for x in a.seeds if x not in ids]
    if names:
        seeds = seeds.union(lookup.resolve_entities(one("mention", names), g, 1).select("mid"))
    if a.strategy == "hybrid":
        d = rank.hybrid(seeds, g, a.hint, a.type, a.depth, max_paths=a.paths)
    elif a.strategy == "bfs":
        d = traverse.bfs_search(seeds, g.edges, a.depth, max_paths=a.paths, hints=a.hint)
    elif a.strategy == "two_hop":
        d = traverse.two_hop_extensions(seeds, g.edges, a.paths)
    elif a.strategy == "source_target":
        d = rank.source_target(seeds, one("node", a.target), g.edges, a.depth, max_paths=a.paths)
    else:
        from pyspark.sql import functions as F

        score = lambda q: rank.score_paths(q.withColumn("text", F.lit("")), g, a.hint, a.type).select(*q.columns, "path_score")
        d = traverse.beam_search(seeds, g.edges, score, a.depth, hints=a.hint)
    for line in d.select("text", "hops").limit(a.paths).toJSON().collect():
        print(line)


if __name__ == "__main__":
    main()

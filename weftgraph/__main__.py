"""python -m weftgraph: run an algorithm or the partitioner on a graph in text files, sweep its parameters, collate reports.

    python -m weftgraph run pagerank EDGES OUT
    python -m weftgraph partition EDGES OUT --init hd --objective vertex -k 4 --beta 0.2 --sigma 0.02 --tau 5
    python -m weftgraph sweep EDGES OUT --init rd,hd,cc,gd --objective edge,vertex -k 2,4,8 --beta 0.1,0.15 --runs 3
    python -m weftgraph collate REPORTS OUT

EDGES is an edge list (``--format`` of readers.EDGE_LISTS, ``null`` by default) or adjacency lists (of readers.ADJACENCY).
A partition run writes labels and report below OUT; a sweep one folder for each combination and run, named by it.
Spark's master and settings come from spark-submit or the environment, as always.
"""

from __future__ import annotations

import argparse
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from .graph import symmetrize, vertices
from .operators import components, paths, ranks, triangles
from .operators import degrees as deg
from .partition import loop, quality
from .partition import propagation as lp
from .partition.sampling import Sampling
from .plans.bsp import scratch
from .registry import ALGORITHMS, algorithm
from .sources import readers, writers

algorithm("identity", "The edges as they are")(lambda e: e)
algorithm("out_degree", "Out-degree of every vertex")(deg.out_degree)
algorithm("in_degree", "In-degree of every vertex")(deg.in_degree)
algorithm("degree_distribution", "Number of vertices of each degree")(deg.degree_distribution)
algorithm("pagerank", "PageRank, 30 steps, mass at sinks lost")(ranks.pagerank)
algorithm("pagerank_walk", "PageRank as a walk, to convergence")(lambda e: ranks.random_walk(e)[0])
algorithm("rwr", "Random walk with restart at vertex 1")(lambda e: ranks.random_walk(e, sources=vertices(e).filter("id = 1"))[0])
algorithm("components", "Weakly connected components")(components.connected_components)
algorithm("sssp", "Hops from vertex 1")(lambda e: paths.shortest_paths(e, 1))
algorithm("max_propagation", "Largest out-degree upstream")(paths.max_propagation)
algorithm("triangle_closing", "Vertices with common in-neighbours")(triangles.triangle_closing)
algorithm("clustering_coefficient", "Local clustering coefficients")(lambda e: triangles.clustering_coefficient(symmetrize(e)))


def read_edges(spark: SparkSession, path: str, form: str) -> DataFrame:
    if form in readers.EDGE_LISTS:
        return readers.read_edge_list(spark, path, **readers.EDGE_LISTS[form]).select("src", "dst")
    return readers.read_adjacency(spark, path, **readers.ADJACENCY[form])[1].select("src", "dst")


def partition_to(edges: DataFrame, out: str, init: str, objective: str, k: int, beta: float, sigma: float, tau: int, seed: int, graph: str) -> None:
    with scratch(edges.sparkSession):
        start = Sampling(init, beta, sigma, tau) if init in ("rd", "hd", "cc", "gd") else init
        result = loop.partition(edges, lp.Objective(objective, k), start, seed)
        writers.write_labels(result.labels, f"{out}/labels")
        writers.write_report(quality.report(result.sym, result.labels, k, result.facts | {"GRAPH": graph}), f"{out}/report")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph", description="Graph analytics and balanced partitioning.")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="an algorithm: " + ", ".join(sorted(ALGORITHMS)))
    run.add_argument("name", choices=sorted(ALGORITHMS))
    one, many, collate = sub.add_parser("partition"), sub.add_parser("sweep"), sub.add_parser("collate")
    for q in (run, one, many):
        q.add_argument("edges")
        q.add_argument("out")
        q.add_argument("--format", default="null", choices=[*readers.EDGE_LISTS, *readers.ADJACENCY])
    for q, listed in ((one, lambda kind: kind), (many, lambda kind: lambda text: [kind(x) for x in text.split(",")])):
        for flag, kind, value in (("--init", str, "hub"), ("--objective", str, "edge"), ("-k", int, "8"), ("--beta", float, "0.15"), ("--sigma", float, "0.05"), ("--tau", int, "3")):
            q.add_argument(flag, type=listed(kind), default=value)
    one.add_argument("--seed", type=int, default=1)
    many.add_argument("--runs", type=int, default=1)
    collate.add_argument("reports")
    collate.add_argument("out")
    collate.add_argument("--mode", default="")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("weftgraph").getOrCreate()
    if a.command == "collate":
        writers.collate_reports(spark, a.reports, a.mode).coalesce(1).write.option("header", True).csv(a.out)
        return
    edges = read_edges(spark, a.edges, a.format)
    if a.command == "run":
        with scratch(spark):
            out = ALGORITHMS[a.name].run(edges)
            writers.write_columns(out, a.out, out.columns)
    elif a.command == "partition":
        partition_to(edges, a.out, a.init, a.objective, a.k, a.beta, a.sigma, a.tau, a.seed, a.edges)
    else:
        for init, objective, k, beta, sigma, tau, seed in product(a.init, a.objective, a.k, a.beta, a.sigma, a.tau, range(1, a.runs + 1)):
            name = f"{init}-{objective}-k{k}-b{beta}-s{sigma}-t{tau}-r{seed}"
            partition_to(edges, f"{a.out}/{name}", init, objective, k, beta, sigma, tau, seed, a.edges)


if __name__ == "__main__":
    main()

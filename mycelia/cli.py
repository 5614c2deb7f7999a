"""Time the component search of a graph file over settings: python -m mycelia.cli [options] PATH"""

from __future__ import annotations

import argparse
import time

from mycelia.functions.paths import result_path_of
from mycelia.functions.ranges import parse_ranges, positive_int
from mycelia.operators.components import component_count, connected_components
from mycelia.plans.staged import staged_components
from mycelia.session import build, release
from mycelia.sources.edges import all_vertices, load_edges
from mycelia.sources.results import append_column, ensure_folder


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mycelia", description=__doc__)
    p.add_argument("path")
    p.add_argument("-c", "--chunk-size", default="2048", help="records per Arrow batch; a list such as 1024,2048:4096:1024")
    p.add_argument("-e", "--exchange", default="1", help="rounds between exchanges of the staged method; a list")
    p.add_argument("-r", "--runs", type=positive_int, default=1)
    p.add_argument("-o", "--output", default="results")
    p.add_argument("-t", "--threads", type=int, default=0, help="0 or less: all")
    p.add_argument("-m", "--method", choices=("contract", "stars", "labels", "frontier", "staged"), default="contract")
    p.add_argument("-p", "--parts", type=positive_int, default=4, help="of the staged method")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    chunks, exchanges = parse_ranges(args.chunk_size, "chunk size"), parse_ranges(args.exchange, "exchange")
    ensure_folder(args.output)
    target = result_path_of(args.output, "results_spark", args.path)
    spark = build(master=f"local[{args.threads if args.threads > 0 else '*'}]")
    began = time.time()
    edges, n = load_edges(spark, args.path)
    edges = edges.persist()
    m = edges.count()
    vertices = all_vertices(spark, n) if n is not None else edges.select(edges.src.alias("id")).distinct()
    print(f"loaded n={vertices.count()} m={m} in {time.time() - began:.3f} seconds")
    for chunk in chunks:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(chunk))
        for exchange in exchanges:
            seconds = []
            for _ in range(args.runs):
                began = time.time()
                labels = staged_components(edges, vertices, args.parts, exchange) if args.method == "staged" else connected_components(edges, vertices, args.method)
                count = component_count(labels).first()[0]
                seconds.append(time.time() - began)
                print(f"chunk={chunk} exchange={exchange}: {count} components in {seconds[-1]:.3f} seconds")
            append_column(target, f"chunk_{chunk}_exchange_{exchange}", seconds)
    edges.unpersist()
    release(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

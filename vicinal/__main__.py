"""Command line: `query` joins a file of points with itself, `generate` writes one."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from .operators import report
from .operators.knn import STRATEGIES, knn_join
from .schema import Options
from .sources import points as P

log = logging.getLogger("vicinal")


def positive(text: str) -> int:
    n = int(text.removeprefix("="))
    if n <= 0:
        raise argparse.ArgumentTypeError("must be positive")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vicinal")
    sub = top.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="k nearest neighbours of each point of a file")
    q.add_argument("-f", "--file", required=True)
    q.add_argument("-n", type=positive, required=True, help="points to use, at most")
    q.add_argument("-d", type=positive, required=True, help="coordinates to use")
    q.add_argument("-k", type=positive, required=True)
    q.add_argument("-M", "--megabytes", type=positive, default=64, help="memory of one block of distances")
    q.add_argument("-l", "--labels", action="store_true", help="the first field is a label")
    q.add_argument("-P", "--print", action="store_true", help="print the first neighbours of the first points")
    q.add_argument("-m", "--images", action="store_true", help="with the first neighbours, print the points as 28 by 28 pictures")
    q.add_argument("-D", "--debug", action="store_true")
    q.add_argument("--strategy", choices=STRATEGIES, default="auto")
    q.add_argument("--out", help="write the neighbours to this folder as Parquet")
    g = sub.add_parser("generate", help="write a file of points")
    g.add_argument("-f", "--file", required=True)
    g.add_argument("-g", "--grid", choices=["random", "regular"], required=True)
    g.add_argument("-n", type=positive, help="points of a random grid")
    g.add_argument("-s", type=positive, help="steps of a regular grid")
    g.add_argument("-d", type=positive, required=True)
    g.add_argument("-l", "--labels", action="store_true")
    g.add_argument("--seed", type=int, default=0)
    return top


def print_neighbors(rows: list, labels: bool, images: bool) -> None:
    """The first queries, each followed by its nearest neighbours; rows by (qid, rank)."""
    last = None
    for r in rows:
        if r.qid != last:
            print(f"point {r.qid}" + (f", label {r.query_label}" if labels else "") + (f"\n{r.query_picture}" if images else ""))
            last = r.qid
        print(f"  {r.rank}: " + (f"label {r.label}" if labels else f"point {r.cid}") + f", squared distance {r.dist:g}" + (f"\n{r.picture}" if images else ""))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("vicinal").getOrCreate()
    if args.command == "generate":
        points = P.generate_points(spark, args.grid, args.d, n=args.n, s=args.s, seed=args.seed, labels=args.labels)
        P.write_points_csv(points, args.file, args.d, labelled=args.labels)
        return
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.INFO)
    began = time.perf_counter()
    points = P.read_points_csv(spark, args.file, labelled=args.labels, n=args.n, d=args.d)
    found = knn_join(points, k=args.k, strategy=args.strategy, options=Options(part_bytes_limit=args.megabytes * 1_000_000)).persist()
    if args.out:
        found.write.mode("overwrite").parquet(args.out)
    print(report.result_summary(found, 0, points.count()).first().text)
    print(f"Total time: {(time.perf_counter() - began) * 1000:.2f} ms")
    if args.debug:
        log.debug(found._jdf.queryExecution().toString())
    if args.print or args.images:
        shown = report.extract(report.with_labels(found, points, points) if args.labels else found)
        if args.images:
            shown = report.with_pictures(shown, points, points)
        print_neighbors(shown.orderBy("qid", "rank").collect(), args.labels, args.images)
    found.unpersist()


if __name__ == "__main__":
    main()

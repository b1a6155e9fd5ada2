"""Command line for the two jobs.

    python -m graphvec run --edges FILE --out DIR [--name NAME] [--length L] [--walks N]
        [--dim D] [--window W] [--replicas P] [--iterations I] [--seed S] [--header] [--histogram]
    python -m graphvec score --emb VEC --edgelist EDGES --labellist LABELS \\
        [--num-shuffles N] [--all] [--seed S] [--zero-k none|all] [--header each|first]

``run`` reads ``src,dst`` lines, walks, trains and writes ``DIR/NAME_vec.txt``. ``score`` prints
micro/macro F1 per training share and their means. The session comes from
``SparkSession.builder.getOrCreate()``, so cluster settings (``spark.checkpoint.dir`` must
be among them) apply.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from graphvec.operators.embed import EmbedConfig
from graphvec.plans.embedding_job import WalkConfig, run_job, score_files
from graphvec.session import drop_scratch


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphvec")
    sub = p.add_subparsers(dest="cmd", required=True)
    run = sub.add_parser("run", help="walk, train and write vectors")
    run.add_argument("--edges", required=True, help="text file or folder with one 'src,dst' a line")
    run.add_argument("--out", required=True, help="folder for the results")
    run.add_argument("--name", default="graph", help="first part of the results' names")
    walk, fit = WalkConfig(), EmbedConfig(vector_size=128, window=10)
    run.add_argument("--length", type=int, default=walk.length, help="vertices in a walk")
    run.add_argument("--walks", type=int, default=walk.walks_per_vertex, help="walks from each vertex")
    run.add_argument("--dim", type=int, default=fit.vector_size, help="components of a vector")
    run.add_argument("--window", type=int, default=fit.window, help="reach of a training pair")
    run.add_argument("--replicas", type=int, default=fit.num_partitions, help="models trained in parallel and averaged")
    run.add_argument("--iterations", type=int, default=fit.num_iterations, help="passes over the walks")
    run.add_argument("--seed", type=int, default=0)
    run.add_argument("--header", action="store_true", help="put a line 'N D' into the first part file")
    run.add_argument("--histogram", action="store_true", help="also write the visit histogram CSV")
    score = sub.add_parser("score", help="multi-label evaluation of a vector file")
    score.add_argument("--emb", required=True)
    score.add_argument("--edgelist", required=True)
    score.add_argument("--labellist", required=True)
    score.add_argument("--num-shuffles", type=int, default=1)
    score.add_argument("--all", action="store_true", help="training shares 10..90 %% instead of 10/50/90 %%")
    score.add_argument("--seed", type=int, default=500)
    score.add_argument("--zero-k", choices=("none", "all"), default="none", help="labels predicted for a vertex without labels")
    score.add_argument("--header", choices=("each", "first"), help="'N D' lines in each file, or in the first; default: _meta.json")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphvec").getOrCreate()
    try:
        return _run(spark, args)
    finally:
        drop_scratch(spark)  # results are written or printed by now


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.cmd == "run":
        res = run_job(
            spark,
            args.edges,
            args.out,
            name=args.name,
            walk_cfg=WalkConfig(length=args.length, walks_per_vertex=args.walks, seed=args.seed),
            embed_cfg=EmbedConfig(
                vector_size=args.dim, window=args.window, num_partitions=args.replicas,
                num_iterations=args.iterations, seed=args.seed,
            ),
            header=args.header,
            write_histogram=args.histogram,
        )
        print(json.dumps({"vectors": res.num_vectors, "dim": res.dim, **res.extras}))
        return 0
    shares = [i / 10 for i in range(1, 10)] if args.all else [0.1, 0.5, 0.9]
    runs, means = score_files(
        spark, args.emb, args.edgelist, args.labellist,
        train_percents=shares, num_shuffles=args.num_shuffles, seed=args.seed, zero_k=args.zero_k,
        header={"each": True, "first": "first", None: False}[args.header],
    )
    for r in runs.orderBy("train_percent", "shuffle").collect():
        print(json.dumps(r.asDict()))
    for r in means.orderBy("train_percent").collect():
        print(json.dumps({"average": r.asDict()}))
    return 0


if __name__ == "__main__":
    sys.exit(main())

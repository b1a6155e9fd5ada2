"""Benchmark the headline workloads and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Workloads (part-supplier graph from ``lineitem``, embeddings table):
  graph      build the walk tables (skew-safe numbering, bucketed slots)
  walks      seeded walks, length 40, 10 per vertex (BASELINE yardstick), broadcast
             plan (the slot table passes its size check at this scale)
  walks_shuffle  the same walks by the default plan, for graphs of any size
  visits     vertex-visit histogram of those walks
  vocab      vocabulary (min_count 5) of those walks
  nearest    top-10 cosine neighbours of every embedding
  train      Word2Vec, 128-d, window 10, 4 replicas, on 2 walks per vertex
  evaluate   one-vs-rest logistic regression + F1 at 10/50/90 % training
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from graphvec.operators import corpus, evaluate, graph, similarity, visits, walks  # noqa: E402
from graphvec.operators.embed import EmbedConfig, train  # noqa: E402
from graphvec.session import local_session  # noqa: E402
from graphvec.sources import tables  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    spark.range(1000).count()  # JVM warm-up outside the timings
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        out = fn()
        times[name] = round(time.time() - t, 3)
        return out

    edges = graph.symmetrize(tables.part_supplier_edges(spark, sf_dir))
    g = timed("graph", lambda: graph.walk_graph(edges))
    w = timed("walks", lambda: walks.random_walks(g, length=40, walks_per_vertex=10, seed=42, strategy="broadcast"))
    timed(
        "walks_shuffle",
        lambda: walks.random_walks(g, length=40, walks_per_vertex=10, seed=42).count(),
    )
    timed("visits", lambda: visits.visit_histogram(w).collect())
    tok = corpus.walk_tokens(w)
    timed("vocab", lambda: corpus.vocabulary(tok, min_count=5).count())
    vec = tables.embedding_vectors(spark, sf_dir)
    timed(
        "nearest",
        lambda: similarity.nearest_by_word(vec, vec.select(F.col("word").alias("query")), 10).count(),
    )
    small = walks.random_walks(g, length=40, walks_per_vertex=2, seed=43, strategy="broadcast")
    timed(
        "train",
        lambda: train(corpus.walk_tokens(small), EmbedConfig(vector_size=128, window=10, seed=1, num_partitions=4)).count(),
    )
    timed(
        "evaluate",
        lambda: evaluate.evaluation_grid(
            vec, tables.embedding_labels(spark, sf_dir), num_shuffles=1, max_iter=20
        ).collect(),
    )
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

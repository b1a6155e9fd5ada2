"""End-to-end jobs: edge list -> walks -> vectors -> files, and the
embedding evaluation over saved files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from graphvec.operators import corpus, evaluate, graph, visits, walks
from graphvec.operators.embed import EmbedConfig, train
from graphvec.sinks import writers
from graphvec.sources import text


@dataclass(frozen=True)
class WalkConfig:
    """Walk settings; defaults are the original job's (length 40, 80 walks
    per vertex)."""

    length: int = 40
    walks_per_vertex: int = 80
    seed: int = 0
    strategy: str = "shuffle"

    def __post_init__(self):
        if self.length <= 0 or self.walks_per_vertex <= 0:
            raise ValueError("walk length and walks per vertex must be positive")


@dataclass(frozen=True)
class JobResult:
    walks: DataFrame
    vectors: DataFrame
    num_vectors: int
    dim: int
    extras: dict = field(default_factory=dict)


def embed_graph(
    edges: DataFrame,
    walk_cfg: WalkConfig = WalkConfig(),
    embed_cfg: EmbedConfig = EmbedConfig(vector_size=128, window=10),
) -> tuple[DataFrame, DataFrame]:
    """Walks and vectors for a directed edge table (symmetrize first for an
    undirected graph)."""
    g = graph.walk_graph(edges)
    w = walks.random_walks(
        g,
        length=walk_cfg.length,
        walks_per_vertex=walk_cfg.walks_per_vertex,
        seed=walk_cfg.seed,
        strategy=walk_cfg.strategy,
    )
    vec = train(corpus.walk_tokens(w), embed_cfg)
    return w, vec


def run_job(
    spark: SparkSession,
    edges_path: str,
    output_dir: str,
    *,
    name: str = "graph",
    walk_cfg: WalkConfig = WalkConfig(),
    embed_cfg: EmbedConfig = EmbedConfig(vector_size=128, window=10),
    header: bool = False,
    write_histogram: bool = False,
) -> JobResult:
    """The original job: read ``src,dst`` lines (both directions), walk,
    train, write ``<name>_vec.txt`` (and optionally the visit histogram
    ``<name>_vertex_visit_freq.csv``). The vectors are part files plus
    ``_meta.json``; with ``header`` the parts, in the order of their names, are the one-file layout with its
    ``N D`` line."""
    edges = text.read_edge_list(spark, edges_path, symmetric=True)
    w, vec = embed_graph(edges, walk_cfg, embed_cfg)
    out = output_dir.rstrip("/")
    meta = writers.write_vectors_text(vec, f"{out}/{name}_vec.txt", header=header)
    extras = {}
    if write_histogram:
        path = f"{out}/{name}_vertex_visit_freq.csv"
        writers.write_visit_histogram(visits.visit_histogram(w), path)
        extras["histogram"] = path
    return JobResult(walks=w, vectors=vec, num_vectors=meta["n"], dim=meta["d"], extras=extras)


def score_files(
    spark: SparkSession,
    vectors_path: str,
    edges_path: str,
    labels_path: str,
    *,
    train_percents=(0.1, 0.5, 0.9),
    num_shuffles: int = 1,
    seed: int = 500,
    header: bool | str = False,
    **fit_kw,
) -> tuple[DataFrame, DataFrame]:
    """The original scoring script: vectors of the graph's vertices, labels
    per vertex, one-vs-rest logistic regression per share and shuffle.
    ``header`` is that of ``read_vectors_text``. Returns (per-run results,
    means per share)."""
    vec = text.read_vectors_text(spark, vectors_path, header=header)
    nodes = graph.vertices(text.read_edge_list(spark, edges_path, symmetric=False))
    keep = evaluate.nodes_with_features(nodes, vec)
    vec = vec.join(keep.withColumnRenamed("node", "word"), "word", "left_semi")
    labels = text.read_labels(spark, labels_path)
    results = evaluate.evaluation_grid(
        vec, labels, train_percents=train_percents, num_shuffles=num_shuffles, seed=seed, **fit_kw
    )
    return results, evaluate.f1_mean(results)

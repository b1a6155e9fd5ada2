"""Print the formatted physical plans of the main operators, to check scan
pushdown (PushedFilters / ReadSchema), join strategies and exchanges.

    python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from pyspark.sql import functions as F  # noqa: E402

from graphvec.operators import corpus, graph, similarity, visits, walks  # noqa: E402
from graphvec.session import local_session  # noqa: E402
from graphvec.sources import tables  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    edges = graph.symmetrize(tables.part_supplier_edges(spark, sf))
    print("### degree (partial + final aggregate, 2-column ReadSchema)")
    graph.degree(edges).explain("formatted")
    g = graph.walk_graph(edges)
    print("### one walk step, shuffle plan (hash table from the slots)")
    seeds = walks.walk_seeds(g, 2)
    moved, keep = walks._step(seeds, g.slots.select("slot", "dst", "dst_first", "dst_degree").hint("shuffle_hash"), 42, 1,
                              drop_dead=True, carry=[])
    moved.select(*keep).explain("formatted")
    w = walks.random_walks(g, length=10, walks_per_vertex=2, seed=42)
    print("### visit histogram")
    visits.visit_histogram(w).explain("formatted")
    print("### vocabulary lookup join (encode)")
    tok = corpus.walk_tokens(w)
    corpus.encode(tok, corpus.vocabulary(tok, min_count=5)).explain("formatted")
    print("### nearest neighbours (mapInArrow over the vectors, bounded window)")
    v = tables.embedding_vectors(spark, sf)
    similarity.nearest_by_word(v, v.select(F.col("word").alias("query")).limit(3), 5).explain("formatted")


if __name__ == "__main__":
    main()

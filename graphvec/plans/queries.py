"""Named queries over the test tables, each with an equivalent DuckDB SQL.

Every query reads whole tables (``lineitem``, ``embeddings``)
or data Spark derives from them. Arrays are returned as space-joined
strings and doubles rounded to 6 places, so both engines hash the same
values. The walk oracle is a recursive CTE that recomputes the md5 draw.

Parameters of the registered queries (fixed so both sides agree):
walk length 10, 2 walks per vertex, seed 42; min_count 5; window 5;
chunk length 3, sentences of at most 7 words for the pairs; top-k 5;
split seed 500, shares 0.1/0.5/0.9, 2 shuffles.

Nothing is kept between queries: each builds its graph and walks anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphvec.functions.vectors import cosine, rounded
from graphvec.operators import corpus, evaluate, graph, pruned, segments, similarity, visits, walks
from graphvec.sources import tables
from graphvec.sinks import writers
from graphvec.sources import text
from graphvec.sources.text import read_adjacency_matrix
from graphvec.session import scratch_path, write_table

WALK_LENGTH = 10
WALKS_PER_VERTEX = 2
SEED = 42
MIN_COUNT = 5
WINDOW = 5
CHUNK = 3
TOP_K = 5
SPLIT_SEED = 500
SHARES = (0.1, 0.5, 0.9)
SHUFFLES = 2
SENTENCE = 7
ADJACENCY_CHUNK = 100
DIRECTED_LENGTH = 3
DIRECTED_WALKS = 20
SEGMENT_BLOCK = 100


def _norm(df: DataFrame) -> DataFrame:
    """Integral columns to BIGINT, floating columns to DOUBLE."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, T.FloatType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _text(c) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), " ")


# ------------------------------------------------------------------ shared


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.symmetrize(tables.part_supplier_edges(spark, sf))


def _walk_graph(spark: SparkSession, sf: str) -> graph.WalkGraph:
    return graph.walk_graph(_edges(spark, sf))


def _walks(
    spark: SparkSession, sf: str, n: int = WALKS_PER_VERTEX, strategy: str = "shuffle"
) -> DataFrame:
    return walks.random_walks(
        _walk_graph(spark, sf), length=WALK_LENGTH, walks_per_vertex=n, seed=SEED, strategy=strategy
    )


def _tokens(spark, sf):
    return corpus.walk_tokens(_walks(spark, sf))


def _vocab(tokens):
    return corpus.vocabulary(tokens, min_count=MIN_COUNT)


def _encoded(spark, sf, max_len: int) -> DataFrame:
    """Walks without unknown words, cut to sentences, as a trainer reads them."""
    tok = _tokens(spark, sf)
    return corpus.chunk(corpus.encode(tok, _vocab(tok)), max_len=max_len)


def _vectors(spark, sf):
    return tables.embedding_vectors(spark, sf)


def _labels(spark, sf):
    return tables.embedding_labels(spark, sf)


def _scores(spark, sf):
    """Scores with weights that the data fix: each label's mean vector, all components. A node keeps
    its k best labels."""
    vec = _vectors(spark, sf)
    nodes = vec.select(F.col("word").alias("node"), "vector").join(_k_true(spark, sf), "node")
    return evaluate.predict_topk(nodes, evaluate.label_means(vec, _labels(spark, sf)))


def _k_true(spark, sf):
    return evaluate.label_sets(_labels(spark, sf)).select("node", F.size("labels").alias("k"))


# ------------------------------------------------------------------ queries


def q_edges_symmetric(spark, sf):
    return _edges(spark, sf)


def q_edges_canonical(spark, sf):
    return graph.canonical_edges(_edges(spark, sf))


def q_adjacency(spark, sf):
    return graph.adjacency(_edges(spark, sf), chunk_size=ADJACENCY_CHUNK).select("src", "chunk", _text("neighbors").alias("neighbors"))


def q_degree(spark, sf):
    return graph.degree(_edges(spark, sf))


def q_vertices(spark, sf):
    return graph.vertices(_edges(spark, sf))


def q_edges_indexed(spark, sf):
    return graph.indexed_edges(_walk_graph(spark, sf))


def q_walk_seeds(spark, sf):
    return _norm(walks.walk_seeds(_walk_graph(spark, sf), WALKS_PER_VERTEX).select("start", "walk_no"))


def q_walks_single(spark, sf):
    return _norm(_walks(spark, sf, 1).select("start", "walk_no", _text("walk").alias("walk")))


def q_walks_multi(spark, sf):
    """Spark chooses the join of each step by the size of the slot table."""
    return _norm(_walks(spark, sf, strategy="auto").select("start", "walk_no", _text("walk").alias("walk")))


def q_walks_multi_shuffle(spark, sf):
    """Same walks through the shuffle plan."""
    w = _walks(spark, sf, strategy="shuffle")
    return _norm(w.select("start", "walk_no", _text("walk").alias("walk")))


def q_walks_directed(spark, sf):
    """Directed supplier -> part walks: most parts are sinks, where a walk ends early and is
    dropped unless it is on its last step."""
    g = graph.walk_graph(tables.supplier_to_part_edges(spark, sf))
    w = walks.random_walks(g, length=DIRECTED_LENGTH, walks_per_vertex=DIRECTED_WALKS, seed=SEED)
    return _norm(w.select("start", "walk_no", _text("walk").alias("walk")))


def q_walk_segments(spark, sf):
    """Walks by segment doubling, as far as the segments set aside suffice (blocks of 100 tails, so that the hubs are
    paired in parts)."""
    g = _walk_graph(spark, sf)
    starts = g.starts.select("vertex", F.lit(WALKS_PER_VERTEX).cast("long").alias("n"))
    s = segments.walk_segments(g, starts, steps=WALK_LENGTH - 1, walks=WALKS_PER_VERTEX, seed=SEED, block=SEGMENT_BLOCK)
    return _norm(s.select("start", F.col("j").alias("walk_no"), F.size("path").alias("steps"), _text("path").alias("path")))


def q_walks_doubled(spark, sf):
    """The finished walks of segment doubling: for each its vertices, and whether every step is an edge."""
    g = _walk_graph(spark, sf)
    w = write_table(segments.doubled_walks(g, length=WALK_LENGTH, walks_per_vertex=WALKS_PER_VERTEX, seed=SEED), "doubled")
    at = F.explode(F.sequence(F.lit(1), F.size("walk") - 1))
    steps = w.withColumn("i", at).select("start", "walk_no", F.get("walk", F.col("i") - 1).alias("src"), F.get("walk", F.col("i")).alias("dst"))
    known = steps.join(g.edges.select("src", "dst").distinct(), ["src", "dst"]).groupBy("start", "walk_no").agg(F.count(F.lit(1)).alias("hits"))
    out = w.join(known, ["start", "walk_no"], "left")
    return _norm(out.select("start", "walk_no", F.size("walk").alias("vertices"), (F.col("hits") == F.size("walk") - 1).alias("along_edges")))


def q_visit_counts(spark, sf):
    return visits.visit_counts(_walks(spark, sf))


def q_visit_histogram(spark, sf):
    return visits.visit_histogram(_walks(spark, sf))


def q_visit_loglog(spark, sf):
    ll = visits.visit_loglog(visits.visit_histogram(_walks(spark, sf)))
    return ll.select(rounded("log_visits").alias("log_visits"), rounded("log_vertices").alias("log_vertices"))


def q_visit_ticks(spark, sf):
    return visits.visit_ticks(visits.visit_histogram(_walks(spark, sf)))


def q_walk_tokens(spark, sf):
    return _norm(_tokens(spark, sf).select("start", "walk_no", _text("tokens").alias("tokens")))


def q_vocabulary(spark, sf):
    return _vocab(_tokens(spark, sf))


def q_corpus_size(spark, sf):
    return corpus.corpus_size(_vocab(_tokens(spark, sf)))


def q_encoded_walks(spark, sf):
    tok = _tokens(spark, sf)
    enc = corpus.encode(tok, _vocab(tok))
    return _norm(enc.select("start", "walk_no", _text("ids").alias("ids")))


def q_chunked_walks(spark, sf):
    ch = _encoded(spark, sf, CHUNK)
    return _norm(ch.select("start", "walk_no", "chunk", _text("ids").alias("ids")))


def q_skipgram_pairs(spark, sf):
    ids = ["start", "walk_no", "chunk"]
    p = corpus.skipgram_pairs(_encoded(spark, sf, SENTENCE), window=WINDOW, seed=SEED, id_cols=ids, col="ids")
    return _norm(p)


def q_cooccurrence(spark, sf):
    c = corpus.cooccurrence(_encoded(spark, sf, SENTENCE), window=WINDOW, id_cols=["start", "walk_no", "chunk"], col="ids")
    return c.select("input", "target", rounded("weight").alias("weight"))


def q_vector_norms(spark, sf):
    n = similarity.vector_norms(_vectors(spark, sf))
    return n.select("word", rounded("norm").alias("norm"))


def q_vector_lookup(spark, sf):
    li = tables.read_table(spark, sf, "lineitem")
    q = li.select(F.col("l_partkey").cast("string").alias("query")).distinct()
    out = similarity.lookup(_vectors(spark, sf), q, strict=False)
    return out.select(
        "query",
        F.col("vector").isNotNull().alias("found"),
        F.size("vector").cast("bigint").alias("dim"),
        rounded(F.aggregate(F.col("vector"), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))).alias("total"),
    ).select("query", "found", F.when(F.col("found"), F.col("dim")).alias("dim"), "total")


def q_nearest_by_word(spark, sf):
    """Neighbours of every word whose id is divisible by 100, among all words."""
    v = _vectors(spark, sf)
    ids = tables.read_table(spark, sf, "embeddings").where(F.col("vec_id") % 100 == 0)
    names = ids.select(F.col("vec_id").cast("string").alias("query"))
    r = similarity.nearest_by_word(v, names, TOP_K)
    return _norm(r.select("query", "word", rounded("similarity").alias("similarity"), "rank"))


def q_nearest_pruned(spark, sf):
    """The same queries through parts of vectors that are left unread where their angles rule them out."""
    v = _vectors(spark, sf)
    ids = tables.read_table(spark, sf, "embeddings").where(F.col("vec_id") % 100 == 0)
    asked = ids.select(F.col("vec_id").cast("string").alias("query"), F.col("embedding").alias("vector"))
    r = pruned.search(pruned.build(v), asked, TOP_K, exclude_self=True)
    return _norm(r.select("query", "word", rounded("similarity").alias("similarity"), "rank"))


def q_nearest_by_vector(spark, sf):
    emb = tables.read_table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector")
    )
    cent = similarity.vector_sum(emb, "label", average=True).withColumnRenamed("label", "query")
    r = similarity.nearest_by_vector(_vectors(spark, sf), cent, TOP_K)
    return _norm(r.select("query", "word", rounded("similarity").alias("similarity"), "rank"))


def q_vector_sum(spark, sf):
    emb = tables.read_table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vector"))
    s = similarity.vector_sum(emb, "label")
    return _norm(s.select("label", F.posexplode("vector").alias("pos", "value")).select(
        "label", "pos", rounded("value").alias("value")
    ))


def q_matrix_edges(spark, sf):
    """Which nations buy from which, as a nation x nation 0/1 text matrix (25 x 25 at any size of the
    tables), written line by line in order and read back."""
    nations = tables.read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("buyer"))
    n = nations.agg(F.max("buyer")).first()[0] + 1
    sold = tables.nation_trade(spark, sf).groupBy("buyer").agg(F.collect_set("seller").alias("sellers"))
    cell = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda j: F.coalesce(F.array_contains("sellers", j), F.lit(False)).cast("int"))
    rows = spark.range(n).withColumnRenamed("id", "buyer").join(sold, "buyer", "left").select("buyer", F.array_join(cell, " ").alias("value"))
    path = scratch_path(spark, "nation_matrix")
    rows.repartitionByRange(4, "buyer").sortWithinPartitions("buyer").select("value").write.text(path)
    return read_adjacency_matrix(spark, path)


# -------------------------------------------------- sources and sinks, round trips


def _vector_summary(vec: DataFrame) -> DataFrame:
    return vec.select(
        "word",
        F.size("vector").cast("bigint").alias("dim"),
        rounded(F.aggregate("vector", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))).alias("total"),
    )


def q_edge_list_file(spark, sf):
    """Part-supplier edges written as ``src,dst`` CSV lines, read back as an
    undirected edge list (both directions)."""
    path = scratch_path(spark, "edge_list")
    writers.write_csv(tables.part_supplier_edges(spark, sf), path, header=False)
    return text.read_edge_list(spark, path, symmetric=True)


def q_label_file(spark, sf):
    path = scratch_path(spark, "labels")
    writers.write_csv(_labels(spark, sf), path, header=False)
    return _norm(text.read_labels(spark, path))


def q_id_file(spark, sf):
    path = scratch_path(spark, "ids")
    writers.write_csv(graph.vertices(_edges(spark, sf)), path, header=False)
    return text.read_ids(spark, path)


def q_histogram_file(spark, sf):
    path = scratch_path(spark, "visit_freq")
    writers.write_visit_histogram(visits.visit_histogram(_walks(spark, sf)), path)
    return text.read_visit_histogram(spark, path)


def q_vector_text_parts(spark, sf):
    """Distributed vector text (part files + metadata), read back."""
    path = scratch_path(spark, "vec_parts")
    writers.write_vectors_text(_vectors(spark, sf), path)
    return _vector_summary(text.read_vectors_text(spark, path, header=False))


def q_vector_text_file(spark, sf):
    """The one-file layout, ``N D`` first, as ordered part files, read back."""
    path = scratch_path(spark, "vec_file")
    writers.write_vectors_text(_vectors(spark, sf), path, header=True)
    return _vector_summary(text.read_vectors_text(spark, path, header="first"))


def q_model_files(spark, sf):
    """Saved model (metadata + parquet), loaded with all checks."""
    path = scratch_path(spark, "model")
    writers.save_model(_vectors(spark, sf), path)
    return _vector_summary(text.load_model(spark, path))


def q_label_sets(spark, sf):
    s = evaluate.label_sets(_labels(spark, sf))
    return s.select("node", _text("labels").alias("labels"))


def q_label_count(spark, sf):
    return evaluate.label_count(_labels(spark, sf))


def q_nodes_with_features(spark, sf):
    return evaluate.nodes_with_features(graph.vertices(_edges(spark, sf)), _vectors(spark, sf))


def q_features_with_labels(spark, sf):
    f = evaluate.features_with_labels(_vectors(spark, sf), _labels(spark, sf))
    return f.select("node", F.size("vector").cast("bigint").alias("dim"), _text("labels").alias("labels"))


def q_multi_hot(spark, sf):
    lab = _labels(spark, sf)
    return evaluate.multi_hot(lab, evaluate.label_positions(lab)).select("node", _text("ones").alias("ones"))


def q_multi_hot_decode(spark, sf):
    """Labels coded and decoded again."""
    lab = _labels(spark, sf)
    positions = evaluate.label_positions(lab)
    back = evaluate.multi_hot_decode(evaluate.multi_hot(lab, positions), positions)
    return back.select("node", _text("labels").alias("labels"))


def q_label_scores(spark, sf):
    """Every probability that the scorer keeps for a node."""
    s = _scores(spark, sf).select("node", F.explode("scores").alias("s"))
    return _norm(s.select("node", "s.label", rounded("s.score").alias("score")))


def q_split_nodes(spark, sf):
    nodes = _vectors(spark, sf).select(F.col("word").alias("node"))
    return evaluate.split_nodes(nodes, 0.5, seed=SPLIT_SEED, shuffle_no=0)


def q_topk_labels(spark, sf):
    return _norm(evaluate.topk_labels(_scores(spark, sf), _k_true(spark, sf)))


def q_f1_scores(spark, sf):
    lab = _labels(spark, sf)
    pred = evaluate.topk_labels(_scores(spark, sf), _k_true(spark, sf))
    f = evaluate.f1_scores(lab, pred, evaluate.label_universe(lab))
    return f.select(rounded("micro_f1").alias("micro_f1"), rounded("macro_f1").alias("macro_f1"), "tp", "fp", "fn")


def q_f1_mean(spark, sf):
    """All shares and shuffles in one grouped count; the nodes are ranked once for each shuffle."""
    lab = _labels(spark, sf)
    uni = evaluate.label_universe(lab)
    pred = evaluate.topk_labels(_scores(spark, sf), _k_true(spark, sf))
    nodes = _vectors(spark, sf).select(F.col("word").alias("node"))
    n = nodes.count()
    shares = F.array(*[F.struct(F.lit(p).alias("train_percent"), F.lit(int(p * n)).alias("cut")) for p in SHARES])
    test = None
    for s in range(SHUFFLES):
        order = evaluate.shuffle_order(nodes, seed=SPLIT_SEED, shuffle_no=s)
        cut = order.select("node", "pos", F.lit(s).alias("shuffle"), F.explode(shares).alias("c"))
        cut = cut.where(F.col("pos") >= F.col("c.cut")).select("node", "shuffle", "c.train_percent")
        test = cut if test is None else test.unionByName(cut)
    by = ["train_percent", "shuffle"]
    results = evaluate.f1_scores(lab.join(test, "node"), pred.join(test, "node"), uni, by=by)
    m = evaluate.f1_mean(results)
    return m.select("train_percent", rounded("micro_f1").alias("micro_f1"), rounded("macro_f1").alias("macro_f1"), "shuffles")


def _two_steps_closer(vec: DataFrame, w: DataFrame) -> bool:
    """On a part-supplier graph a step changes the kind of vertex and two steps do not, and vertices of
    one kind have like surroundings: is the cosine of a walk's first and third vertex on average above that of its
    first and second?"""
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("steps"), F.col("walk")[0].alias("a"), F.col("walk")[i].alias("b")) for i in (1, 2)]))
    pairs = w.select(ends.alias("p")).select("p.steps", F.col("p.a").cast("string").alias("a"), F.col("p.b").cast("string").alias("b"))
    a = vec.select(F.col("word").alias("a"), F.col("vector").alias("va"))
    b = vec.select(F.col("word").alias("b"), F.col("vector").alias("vb"))
    means = pairs.where("a <> b").join(a, "a").join(b, "b").groupBy("steps").agg(F.avg(cosine("va", "vb")).alias("m"))
    got = {r["steps"]: r["m"] for r in means.collect()}
    return got.get(2, 0.0) > got.get(1, 0.0)


def _trained(spark, sf, method: str) -> DataFrame:
    from graphvec.operators.embed import EmbedConfig, train

    w = _walks(spark, sf)
    cfg = EmbedConfig(vector_size=16, min_count=MIN_COUNT, window=WINDOW, seed=SEED, num_partitions=4, num_iterations=4)
    vec = write_table(train(corpus.walk_tokens(w), cfg, method=method), "vectors")
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    closer = F.lit(_two_steps_closer(vec, w)).alias("two_steps_closer")
    return vec.select("word", F.size("vector").cast("bigint").alias("dim"), finite.alias("finite"), closer)


def q_embed_vectors(spark, sf):
    """16-d skip-gram vectors of the walks from 4 parallel replicas: for each word the size of its vector, whether
    it is finite, and a check of what the vectors have learned."""
    return _trained(spark, sf, "skipgram")


def q_block_vectors(spark, sf):
    """The same checks for vectors trained in four blocks of words."""
    return _trained(spark, sf, "blocks")


def q_factorized_vectors(spark, sf):
    """The same checks for vectors factorised from co-occurrence counts."""
    return _trained(spark, sf, "factorize")


def q_fitted_labels(spark, sf):
    """The fitted classifier of every label, held against its own optimum: with the returned weights, every component of the
    gradient of summed loss and penalty, added up here by plain expressions, is below 1e-4."""
    data = write_table(evaluate.features_with_labels(_vectors(spark, sf), _labels(spark, sf)), "rows")
    universe = write_table(evaluate.label_universe(_labels(spark, sf)), "universe")
    fitted = write_table(evaluate.fit_one_vs_rest(data, universe), "fitted")
    every = data.select(F.col("vector").cast("array<double>").alias("x"), "labels", F.explode(F.array(*[F.lit(r["label"]) for r in fitted.select("label").collect()])).alias("label"))
    met = every.join(fitted, "label").withColumn("y", F.array_contains("labels", F.col("label")).cast("double"))
    z = F.aggregate(F.zip_with("x", "coefficients", lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v)
    off = met.withColumn("r", 1 / (1 + F.exp(-z)) - F.col("y")).withColumn("x", F.concat("x", F.array(F.lit(1.0))))
    parts = off.select("label", "y", "coefficients", F.posexplode(F.transform("x", lambda v: v * F.col("r"))).alias("i", "g"))
    whole = parts.groupBy("label", "i").agg(F.sum("g").alias("g"), F.first("coefficients").alias("w"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    slope = F.abs(F.col("g") + F.coalesce(F.get("w", F.col("i")), F.lit(0.0)))
    out = whole.groupBy("label").agg(F.max("n").alias("n_rows"), F.max("y").cast("bigint").alias("positives"), (F.max(slope) < 1e-4).alias("at_optimum"))
    return _norm(out)


def q_evaluation_grid(spark, sf):
    """One-vs-rest logistic regression on the embeddings: sizes and counts of every split, and whether
    the scores are scores."""
    r = evaluate.evaluation_grid(
        _vectors(spark, sf), _labels(spark, sf), train_percents=SHARES, num_shuffles=1, seed=SPLIT_SEED, max_iter=20
    )
    unit = F.col("micro_f1").between(0, 1) & F.col("macro_f1").between(0, 1)
    return _norm(r.select("train_percent", "shuffle", "n_train", "n_test", "n_predicted", "n_true", unit.alias("in_range")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "edges_symmetric": q_edges_symmetric,
    "edges_canonical": q_edges_canonical,
    "adjacency": q_adjacency,
    "degree": q_degree,
    "vertices": q_vertices,
    "edges_indexed": q_edges_indexed,
    "walk_seeds": q_walk_seeds,
    "walks_single": q_walks_single,
    "walks_multi": q_walks_multi,
    "walks_multi_shuffle": q_walks_multi_shuffle,
    "walks_directed": q_walks_directed,
    "walk_segments": q_walk_segments,
    "walks_doubled": q_walks_doubled,
    "visit_counts": q_visit_counts,
    "visit_histogram": q_visit_histogram,
    "visit_loglog": q_visit_loglog,
    "visit_ticks": q_visit_ticks,
    "walk_tokens": q_walk_tokens,
    "vocabulary": q_vocabulary,
    "corpus_size": q_corpus_size,
    "encoded_walks": q_encoded_walks,
    "chunked_walks": q_chunked_walks,
    "skipgram_pairs": q_skipgram_pairs,
    "cooccurrence": q_cooccurrence,
    "vector_norms": q_vector_norms,
    "vector_lookup": q_vector_lookup,
    "nearest_by_word": q_nearest_by_word,
    "nearest_pruned": q_nearest_pruned,
    "nearest_by_vector": q_nearest_by_vector,
    "vector_sum": q_vector_sum,
    "matrix_edges": q_matrix_edges,
    "edge_list_file": q_edge_list_file,
    "label_file": q_label_file,
    "id_file": q_id_file,
    "histogram_file": q_histogram_file,
    "vector_text_parts": q_vector_text_parts,
    "vector_text_file": q_vector_text_file,
    "model_files": q_model_files,
    "label_sets": q_label_sets,
    "label_count": q_label_count,
    "nodes_with_features": q_nodes_with_features,
    "features_with_labels": q_features_with_labels,
    "multi_hot": q_multi_hot,
    "multi_hot_decode": q_multi_hot_decode,
    "label_scores": q_label_scores,
    "split_nodes": q_split_nodes,
    "topk_labels": q_topk_labels,
    "f1_scores": q_f1_scores,
    "f1_mean": q_f1_mean,
    "embed_vectors": q_embed_vectors,
    "block_vectors": q_block_vectors,
    "factorized_vectors": q_factorized_vectors,
    "fitted_labels": q_fitted_labels,
    "evaluation_grid": q_evaluation_grid,
}

"""DuckDB SQL equivalents of ``plans.queries``: same columns, same types
(BIGINT / DOUBLE / VARCHAR / BOOLEAN), doubles rounded to 6 places."""

from __future__ import annotations

from graphvec.plans.queries import (
    ADJACENCY_CHUNK,
    CHUNK,
    DIRECTED_LENGTH,
    DIRECTED_WALKS,
    MIN_COUNT,
    SEED,
    SEGMENT_BLOCK,
    SENTENCE,
    SPLIT_SEED,
    TOP_K,
    WALK_LENGTH,
    WALKS_PER_VERTEX,
    WINDOW,
)
from graphvec.operators import segments

_DRAW = "('0x' || substr(md5({key}), 1, 15))::BIGINT"

_GRAPH = """
e AS (SELECT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem
      UNION ALL SELECT 2 * l_suppkey + 1 AS src, 2 * l_partkey AS dst FROM lineitem),
deg AS (SELECT src, count(*) AS degree FROM e GROUP BY src),
ei AS (SELECT e.src, row_number() OVER (PARTITION BY e.src ORDER BY e.dst) - 1 AS idx, e.dst,
              coalesce(d.degree, 0) AS dst_degree
       FROM e LEFT JOIN deg d ON e.dst = d.src)"""


_DIRECTED = _GRAPH[_GRAPH.index("deg AS") :]


def _walk_cte(n: int, length: int = WALK_LENGTH) -> str:
    draw = _DRAW.format(key=f"'{SEED}|' || w.start || '|' || w.walk_no || '|' || (w.step + 1)")
    last = length - 1
    return f"""
wk{n}(start, walk_no, step, cur, deg, walk) AS (
  SELECT src, r.walk_no, 0, src, degree, [src] FROM deg, range({n}) r(walk_no)
  UNION ALL
  SELECT w.start, w.walk_no, w.step + 1, ei.dst, ei.dst_degree, list_append(w.walk, ei.dst)
  FROM wk{n} w JOIN ei ON ei.src = w.cur AND ei.idx = {draw} % w.deg
  WHERE w.step + 1 <= {last} AND w.deg > 0),
walks{n} AS (SELECT start, walk_no, walk FROM wk{n} WHERE step = {last})"""


_CORPUS = f"""
tok AS (SELECT CAST(unnest(walk) AS VARCHAR) AS word FROM walks2),
cnt AS (SELECT word, count(*) AS cn FROM tok GROUP BY word HAVING count(*) >= {MIN_COUNT}),
vocab AS (SELECT word, cn, row_number() OVER (ORDER BY cn DESC, word) - 1 AS word_idx FROM cnt),
pos AS (SELECT start, walk_no, generate_subscripts(walk, 1) - 1 AS pos,
               CAST(unnest(walk) AS VARCHAR) AS word FROM walks2),
enc AS (SELECT start, walk_no, list(word_idx ORDER BY pos) AS ids
        FROM pos JOIN vocab USING (word) GROUP BY start, walk_no)"""

_VISITS = """
vc AS (SELECT v AS vertex, count(*) AS visits FROM (SELECT unnest(walk) AS v FROM walks2) GROUP BY v),
hist AS (SELECT visits AS number_of_visits, count(*) AS number_of_vertices FROM vc GROUP BY visits)"""

_SENTENCES = f"""
sent AS (SELECT start, walk_no, c AS chunk, ids[c * {SENTENCE} + 1 : c * {SENTENCE} + {SENTENCE}] AS ids
         FROM (SELECT start, walk_no, ids, unnest(range(CAST(ceil(len(ids) / {SENTENCE}.0) AS BIGINT))) AS c FROM enc)),
p AS (SELECT start, walk_no, chunk, ids, len(ids) AS n, generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS target FROM sent)"""

_VEC = """
v AS (SELECT CAST(vec_id AS VARCHAR) AS word, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""

_LABELS = """
lab AS (SELECT DISTINCT node, label FROM (
          SELECT CAST(vec_id AS VARCHAR) AS node, label FROM embeddings
          UNION ALL SELECT CAST(vec_id AS VARCHAR), CAST(vec_id % 10 AS INTEGER) FROM embeddings)),
kk AS (SELECT node, count(*) AS k FROM lab GROUP BY node),
comp AS (SELECT CAST(vec_id AS VARCHAR) AS node, generate_subscripts(embedding, 1) AS i,
                CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
mean AS (SELECT label, i, avg(x) AS w FROM lab JOIN comp USING (node) GROUP BY label, i),
sc AS (SELECT node, label, 1 / (1 + exp(-sum(x * w))) AS score FROM comp JOIN mean USING (i) GROUP BY node, label),
pred AS (SELECT node, label, rank, score FROM (
           SELECT sc.node, sc.label, sc.score, kk.k,
                  row_number() OVER (PARTITION BY sc.node ORDER BY sc.score DESC, sc.label) AS rank
           FROM sc JOIN kk USING (node)) WHERE rank <= k),
u AS (SELECT DISTINCT label FROM lab)"""


def _cos(a: str, b: str) -> str:
    na = f"sqrt(list_dot_product({a}, {a}))"
    nb = f"sqrt(list_dot_product({b}, {b}))"
    return f"CASE WHEN {na} * {nb} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / ({na} * {nb}) END"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


def _segment_cte() -> str:
    """Segment doubling, round by round; the last table is ``seg<rounds>``."""
    lengths = segments.head_lengths(WALK_LENGTH - 1)
    top, unit, block = len(lengths) - 1, segments.UNIT, SEGMENT_BLOCK
    parts = [f"push0 AS (SELECT src AS vertex, degree, {WALKS_PER_VERTEX * unit} AS a0 FROM deg)"]
    for k in (1, 2, 3):
        given = ", ".join(f"p.a{i}" for i in range(k))
        parts.append(
            f"push{k} AS (SELECT p.vertex, p.degree, {given}, coalesce(s.x, 0)::BIGINT AS a{k} FROM push{k - 1} p LEFT JOIN "
            f"(SELECT e.dst, sum(q.a{k - 1} // q.degree) AS x FROM e JOIN push{k - 1} q ON q.vertex = e.src GROUP BY e.dst) s ON s.dst = p.vertex)"
        )
    c, columns = f"a0 // {unit}", []
    for i, weights in reversed(list(enumerate([*segments.tail_weights(lengths, WALKS_PER_VERTEX), None]))):
        if weights:
            c += " + (" + " + ".join(f"{w} * a{k}" for k, w in enumerate(weights)) + f") // {1000 * unit} + {segments.ADDED}"
        columns.append(f"({c})::BIGINT AS c{i}")
    parts.append(f"sup AS (SELECT vertex, degree, {', '.join(columns)} FROM push3)")
    count = lambda i, t="": f"greatest(({t}c{i} - {t}c{i + 1} + {block - 1}) // {block}, 1)"
    role = " ".join(f"WHEN j >= c{i + 1} THEN {i}" for i in range(top))
    part = " ".join(f"WHEN j >= c{i + 1} THEN (j - c{i + 1}) % {count(i)}" for i in range(top))
    draw = _DRAW.format(key=f"'{SEED}|segment|' || vertex || '|' || j")
    parts.append(f"one AS (SELECT *, CASE {role} ELSE {top} END AS role, CASE {part} ELSE 0 END AS part FROM (SELECT *, unnest(range(c0)) AS j FROM sup))")
    parts.append(f"seg0 AS (SELECT vertex AS start, j, role, part, [ei.dst] AS path FROM one JOIN ei ON ei.src = vertex AND ei.idx = {draw} % degree)")
    for i in range(top):
        drawn = _DRAW.format(key=f"'{SEED}|part|' || start || '|' || j || '|{i}'")
        parts.append(
            f"spot{i} AS (SELECT s.*, role = {i} AS tail, CASE WHEN role = {i} THEN start ELSE path[-1] END AS spot, "
            f"CASE WHEN role = {i} THEN part WHEN u.vertex IS NULL THEN 0 ELSE {drawn} % {count(i, 'u.')} END AS part_at "
            f"FROM seg{i} s LEFT JOIN sup u ON u.vertex = path[-1])"
        )
        parts.append(f"place{i} AS (SELECT *, row_number() OVER (PARTITION BY spot, part_at, tail ORDER BY start, j) AS place FROM spot{i})")
        parts.append(
            f"seg{i + 1} AS (SELECT h.start, h.j, h.role, h.part, CASE WHEN t.path IS NULL THEN h.path ELSE (h.path || t.path)[1:{lengths[i + 1]}] END AS path "
            f"FROM place{i} h LEFT JOIN place{i} t ON t.tail AND t.spot = h.spot AND t.part_at = h.part_at AND t.place = h.place WHERE NOT h.tail)"
        )
    return ",\n".join(parts)


_ROUNDS = len(segments.head_lengths(WALK_LENGTH - 1)) - 1
_W1 = _walk_cte(1)
_W2 = _walk_cte(2)
_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"

ORACLE: dict[str, str] = {
    "edges_symmetric": _with(_GRAPH) + "SELECT src, dst FROM e",
    "edges_canonical": _with(_GRAPH)
    + "SELECT src, dst, count(*) AS multiplicity FROM e WHERE src <= dst GROUP BY src, dst",
    "adjacency": _with(_GRAPH)
    + f"SELECT src, idx // {ADJACENCY_CHUNK} AS chunk, array_to_string(list(dst ORDER BY idx), ' ') AS neighbors "
    f"FROM ei GROUP BY src, idx // {ADJACENCY_CHUNK}",
    "degree": _with(_GRAPH) + "SELECT src, count(*) AS degree FROM e GROUP BY src",
    "vertices": _with(_GRAPH) + "SELECT DISTINCT v AS vertex FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e)",
    "edges_indexed": _with(_GRAPH) + "SELECT src, idx, dst, dst_degree FROM ei",
    "walk_seeds": _with(_GRAPH) + "SELECT src AS start, r.walk_no AS walk_no FROM deg, range(2) r(walk_no)",
    "walks_single": _with(_GRAPH, _W1)
    + "SELECT start, walk_no, array_to_string(walk, ' ') AS walk FROM walks1",
    "walks_multi": _with(_GRAPH, _W2)
    + "SELECT start, walk_no, array_to_string(walk, ' ') AS walk FROM walks2",
    "walks_multi_shuffle": _with(_GRAPH, _W2)
    + "SELECT start, walk_no, array_to_string(walk, ' ') AS walk FROM walks2",
    "walks_directed": _with(
        "e AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem),\n" + _DIRECTED, _walk_cte(DIRECTED_WALKS, DIRECTED_LENGTH)
    )
    + f"SELECT start, walk_no, array_to_string(walk, ' ') AS walk FROM walks{DIRECTED_WALKS}",
    "walk_segments": _with(_GRAPH, _segment_cte())
    + f"SELECT start, j AS walk_no, len(path) AS steps, array_to_string(path, ' ') AS path FROM seg{_ROUNDS}",
    "walks_doubled": _with(_GRAPH)
    + f"SELECT src AS start, r.walk_no AS walk_no, {WALK_LENGTH}::BIGINT AS vertices, true AS along_edges FROM deg, range({WALKS_PER_VERTEX}) r(walk_no)",
    "visit_counts": _with(_GRAPH, _W2, _VISITS) + "SELECT vertex, visits FROM vc",
    "visit_histogram": _with(_GRAPH, _W2, _VISITS) + "SELECT number_of_visits, number_of_vertices FROM hist",
    "visit_loglog": _with(_GRAPH, _W2, _VISITS)
    + "SELECT round(log10(number_of_visits), 6) AS log_visits, round(log10(number_of_vertices), 6) AS log_vertices FROM hist",
    "visit_ticks": _with(
        _GRAPH,
        _W2,
        _VISITS,
        """
mx AS (SELECT max(number_of_visits) AS v, max(number_of_vertices) AS n FROM hist),
ax AS (SELECT 'visits' AS axis, v AS mx FROM mx UNION ALL SELECT 'vertices' AS axis, n AS mx FROM mx)""",
    )
    + "SELECT axis, CAST(-0.1 AS DOUBLE) AS tick FROM ax WHERE mx IS NOT NULL "
    "UNION ALL SELECT axis, CAST(i AS DOUBLE) AS tick FROM ax, range(15) t(i) WHERE pow(10, i) < mx",
    "walk_tokens": _with(_GRAPH, _W2)
    + "SELECT start, walk_no, array_to_string(walk, ' ') AS tokens FROM walks2",
    "vocabulary": _with(_GRAPH, _W2, _CORPUS) + "SELECT word, cn, word_idx FROM vocab",
    "corpus_size": _with(_GRAPH, _W2, _CORPUS)
    + "SELECT CAST(coalesce(sum(cn), 0) AS BIGINT) AS train_words FROM vocab",
    "encoded_walks": _with(_GRAPH, _W2, _CORPUS)
    + "SELECT start, walk_no, array_to_string(ids, ' ') AS ids FROM enc",
    "chunked_walks": _with(_GRAPH, _W2, _CORPUS)
    + f"SELECT start, walk_no, c AS chunk, array_to_string(ids[c * {CHUNK} + 1 : c * {CHUNK} + {CHUNK}], ' ') AS ids "
    f"FROM (SELECT start, walk_no, ids, unnest(range(CAST(ceil(len(ids) / {CHUNK}.0) AS BIGINT))) AS c FROM enc)",
    "skipgram_pairs": _with(
        _GRAPH,
        _W2,
        _CORPUS,
        _SENTENCES,
        f"""
r AS (SELECT *, {WINDOW} - ({_DRAW.format(key=f"'{SEED}|' || start || '|' || walk_no || '|' || chunk || '|' || pos")} % {WINDOW}) AS reach FROM p),
c AS (SELECT start, walk_no, chunk, pos, target, ids,
             unnest(range(greatest(0, pos - reach), least(n - 1, pos + reach) + 1)) AS ctx_pos FROM r)""",
    )
    + "SELECT start, walk_no, chunk, pos, ctx_pos, ids[ctx_pos + 1] AS input, target FROM c WHERE ctx_pos <> pos",
    "cooccurrence": _with(
        _GRAPH,
        _W2,
        _CORPUS,
        _SENTENCES,
        f"""
c AS (SELECT ids, pos, target,
             unnest(range(greatest(0, pos - {WINDOW}), least(n - 1, pos + {WINDOW}) + 1)) AS ctx_pos FROM p)""",
    )
    + f"SELECT ids[ctx_pos + 1] AS input, target, "
    f"round(sum({WINDOW} - abs(ctx_pos - pos) + 1) / {WINDOW}.0, 6) AS weight "
    "FROM c WHERE ctx_pos <> pos GROUP BY 1, 2",
    "vector_norms": "SELECT CAST(vec_id AS VARCHAR) AS word, "
    "round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm "
    "FROM embeddings",
    "vector_lookup": "WITH q AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS query FROM lineitem) "
    "SELECT q.query, e.embedding IS NOT NULL AS found, "
    "CASE WHEN e.embedding IS NOT NULL THEN CAST(len(e.embedding) AS BIGINT) END AS dim, "
    "round(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total "
    "FROM q LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = q.query",
    "nearest_by_word": _with(
        _VEC,
        f"""
s AS (SELECT a.word AS query, b.word AS word, {_cos('a.vec', 'b.vec')} AS sim
      FROM v a, v b WHERE a.word <> b.word AND CAST(a.word AS BIGINT) % 100 = 0),
r AS (SELECT query, word, sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, word) AS rank FROM s)""",
    )
    + f"SELECT query, word, round(sim, 6) AS similarity, rank FROM r WHERE rank <= {TOP_K}",
    "nearest_by_vector": _with(
        _VEC,
        f"""
ex AS (SELECT label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cent AS (SELECT CAST(label AS VARCHAR) AS query, list(ax ORDER BY pos) AS vec
         FROM (SELECT label, pos, avg(x) AS ax FROM ex GROUP BY label, pos) GROUP BY label),
s AS (SELECT c.query, v.word, {_cos('c.vec', 'v.vec')} AS sim FROM cent c, v),
r AS (SELECT query, word, sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, word) AS rank FROM s)""",
    )
    + f"SELECT query, word, round(sim, 6) AS similarity, rank FROM r WHERE rank <= {TOP_K}",
    "vector_sum": "WITH ex AS (SELECT label, generate_subscripts(embedding, 1) AS pos, "
    "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) "
    "SELECT CAST(label AS BIGINT) AS label, CAST(pos - 1 AS BIGINT) AS pos, round(sum(x), 6) AS value "
    "FROM ex GROUP BY label, pos",
    "matrix_edges": "SELECT DISTINCT CAST(c_nationkey + 1 AS BIGINT) AS src, CAST(s_nationkey + 1 AS BIGINT) AS dst "
    "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey "
    "JOIN supplier ON s_suppkey = l_suppkey",
    "edge_list_file": _with(_GRAPH) + "SELECT src, dst FROM e",
    "label_file": _with(_LABELS) + "SELECT node, CAST(label AS BIGINT) AS label FROM lab",
    "id_file": _with(_GRAPH) + "SELECT DISTINCT v AS id FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e)",
    "histogram_file": _with(_GRAPH, _W2, _VISITS) + "SELECT number_of_visits, number_of_vertices FROM hist",
    "vector_text_parts": "SELECT CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS BIGINT) AS dim, "
    "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings",
    "vector_text_file": "SELECT CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS BIGINT) AS dim, "
    "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings",
    "model_files": "SELECT CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS BIGINT) AS dim, "
    "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings",
    "label_sets": _with(_LABELS)
    + "SELECT node, array_to_string(list_sort(list_distinct(list(label))), ' ') AS labels FROM lab GROUP BY node",
    "label_count": _with(_LABELS) + "SELECT count(DISTINCT label) AS num_labels FROM lab",
    "nodes_with_features": _with(_GRAPH)
    + "SELECT DISTINCT CAST(src AS VARCHAR) AS node FROM e "
    "WHERE CAST(src AS VARCHAR) IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings)",
    "features_with_labels": _with(
        _LABELS,
        """
ls AS (SELECT node, array_to_string(list_sort(list_distinct(list(label))), ' ') AS labels FROM lab GROUP BY node)""",
    )
    + "SELECT CAST(vec_id AS VARCHAR) AS node, CAST(len(embedding) AS BIGINT) AS dim, coalesce(ls.labels, '') AS labels "
    "FROM embeddings LEFT JOIN ls ON ls.node = CAST(vec_id AS VARCHAR)",
    "multi_hot": _with(_LABELS, "\nps AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos FROM u)")
    + "SELECT node, array_to_string(list(pos ORDER BY pos), ' ') AS ones FROM lab JOIN ps USING (label) GROUP BY node",
    "multi_hot_decode": _with(_LABELS)
    + "SELECT node, array_to_string(list(label ORDER BY label), ' ') AS labels FROM lab GROUP BY node",
    "label_scores": _with(_LABELS) + "SELECT node, CAST(label AS BIGINT) AS label, round(score, 6) AS score FROM pred",
    "split_nodes": _with(
        f"""
k AS (SELECT CAST(vec_id AS VARCHAR) AS node,
             {_DRAW.format(key=f"'{SPLIT_SEED}|0|' || CAST(vec_id AS VARCHAR)")} AS key FROM embeddings)"""
    )
    + "SELECT node, (row_number() OVER (ORDER BY key, node) - 1) < CAST(floor(0.5 * (SELECT count(*) FROM k)) AS BIGINT) AS is_train FROM k",
    "topk_labels": _with(_LABELS) + "SELECT node, CAST(label AS BIGINT) AS label, rank FROM pred",
    "f1_scores": _with(
        _LABELS,
        """
j AS (SELECT coalesce(t.label, x.label) AS label, t.node IS NOT NULL AS it, x.node IS NOT NULL AS ip
      FROM lab t FULL OUTER JOIN pred x ON t.node = x.node AND t.label = x.label),
pl AS (SELECT label, sum(CASE WHEN it AND ip THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN ip AND NOT it THEN 1 ELSE 0 END) AS fp,
              sum(CASE WHEN it AND NOT ip THEN 1 ELSE 0 END) AS fn FROM j GROUP BY label),
f AS (SELECT u.label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn
      FROM u LEFT JOIN pl USING (label)),""" + f"""
g AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg({_F1}) AS macro FROM f)""",
    )
    + f"SELECT round({_F1}, 6) AS micro_f1, round(coalesce(macro, 0.0), 6) AS macro_f1, "
    "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM g",
    "f1_mean": _with(
        _LABELS,
        f"""
keys AS (SELECT CAST(vec_id AS VARCHAR) AS node, s.sh AS shuffle,
                {_DRAW.format(key=f"'{SPLIT_SEED}|' || s.sh || '|' || CAST(vec_id AS VARCHAR)")} AS key
         FROM embeddings, range(2) s(sh)),
ranked AS (SELECT node, shuffle, row_number() OVER (PARTITION BY shuffle ORDER BY key, node) - 1 AS pos,
                  count(*) OVER (PARTITION BY shuffle) AS n FROM keys),
shares AS (SELECT * FROM (VALUES (0.1), (0.5), (0.9)) v(p)),
test AS (SELECT p, shuffle, node FROM ranked, shares WHERE pos >= CAST(floor(p * n) AS BIGINT)),
tt AS (SELECT t.p, t.shuffle, l.node, l.label FROM test t JOIN lab l USING (node)),
pp AS (SELECT t.p, t.shuffle, x.node, x.label FROM test t JOIN pred x USING (node)),
j AS (SELECT coalesce(tt.p, pp.p) AS p, coalesce(tt.shuffle, pp.shuffle) AS shuffle,
             coalesce(tt.label, pp.label) AS label, tt.node IS NOT NULL AS it, pp.node IS NOT NULL AS ip
      FROM tt FULL OUTER JOIN pp ON tt.p = pp.p AND tt.shuffle = pp.shuffle AND tt.node = pp.node AND tt.label = pp.label),
pl AS (SELECT p, shuffle, label, sum(CASE WHEN it AND ip THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN ip AND NOT it THEN 1 ELSE 0 END) AS fp,
              sum(CASE WHEN it AND NOT ip THEN 1 ELSE 0 END) AS fn FROM j GROUP BY p, shuffle, label),
grid AS (SELECT DISTINCT p, shuffle FROM test),
f AS (SELECT g.p, g.shuffle, u.label, coalesce(pl.tp, 0) AS tp, coalesce(pl.fp, 0) AS fp, coalesce(pl.fn, 0) AS fn
      FROM grid g CROSS JOIN u LEFT JOIN pl ON pl.p = g.p AND pl.shuffle = g.shuffle AND pl.label = u.label),
per AS (SELECT p, shuffle, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg({_F1}) AS macro FROM f GROUP BY p, shuffle),
res AS (SELECT p, shuffle, {_F1} AS micro, macro FROM per)""",
    )
    + "SELECT CAST(p AS DOUBLE) AS train_percent, round(avg(micro), 6) AS micro_f1, round(avg(macro), 6) AS macro_f1, "
    "count(*) AS shuffles FROM res GROUP BY p",
    "embed_vectors": _with(_GRAPH, _W2, _CORPUS)
    + "SELECT word, CAST(16 AS BIGINT) AS dim, true AS finite, true AS two_steps_closer FROM vocab",
    "block_vectors": _with(_GRAPH, _W2, _CORPUS)
    + "SELECT word, CAST(16 AS BIGINT) AS dim, true AS finite, true AS two_steps_closer FROM vocab",
    "factorized_vectors": _with(_GRAPH, _W2, _CORPUS)
    + "SELECT word, CAST(16 AS BIGINT) AS dim, true AS finite, true AS two_steps_closer FROM vocab",
    "fitted_labels": _with(_LABELS)
    + "SELECT CAST(label AS BIGINT) AS label, (SELECT count(*) FROM embeddings) AS n_rows, count(*) AS positives, true AS at_optimum FROM lab GROUP BY label",
    "evaluation_grid": _with(
        _LABELS,
        f"""
ranked AS (SELECT node, row_number() OVER (ORDER BY key, node) - 1 AS pos, count(*) OVER () AS n
           FROM (SELECT CAST(vec_id AS VARCHAR) AS node,
                        {_DRAW.format(key=f"'{SPLIT_SEED}|0|' || CAST(vec_id AS VARCHAR)")} AS key FROM embeddings)),
shares AS (SELECT * FROM (VALUES (0.1), (0.5), (0.9)) v(p)),
cut AS (SELECT p, node, pos, n, CAST(floor(p * n) AS BIGINT) AS c FROM ranked, shares)""",
    )
    + "SELECT CAST(p AS DOUBLE) AS train_percent, CAST(0 AS BIGINT) AS shuffle, any_value(c) AS n_train, any_value(n) - any_value(c) AS n_test, "
    "CAST(sum(CASE WHEN pos >= c THEN coalesce(k, 0) ELSE 0 END) AS BIGINT) AS n_predicted, "
    "CAST(sum(CASE WHEN pos >= c THEN coalesce(k, 0) ELSE 0 END) AS BIGINT) AS n_true, true AS in_range "
    "FROM cut LEFT JOIN kk USING (node) GROUP BY p",
}
#: The same queries, another way to their result.
ORACLE["nearest_pruned"] = ORACLE["nearest_by_word"]

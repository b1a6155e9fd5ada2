import json

import pytest

from graphvec.operators.embed import vectors_from_mapping
from graphvec.sinks import writers
from graphvec.sources import text


def _write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_edge_list_extra_column_and_symmetric(spark, tmp_path):
    p = _write(tmp_path / "e.csv", ["2,3,x", "4,5"])
    got = sorted(tuple(r) for r in text.read_edge_list(spark, p).collect())
    assert got == [(2, 3), (3, 2), (4, 5), (5, 4)]


@pytest.mark.parametrize("bad", ["x,1", "7"])
def test_edge_list_bad_line_fails(spark, tmp_path, bad):
    p = _write(tmp_path / "bad.csv", ["1,2", bad])
    with pytest.raises(Exception):
        text.read_edge_list(spark, p).collect()


def test_adjacency_matrix_columns(spark, tmp_path):
    p = _write(tmp_path / "m.txt", ["0 1 1", "1 0 0", "0 0 0"])
    got = sorted(tuple(r) for r in text.read_adjacency_matrix(spark, p).collect())
    assert got == [(1, 2), (1, 3), (2, 1)]


@pytest.mark.parametrize("header", [False, True])
def test_vectors_text_round_trip(spark, tmp_path, header):
    v = vectors_from_mapping(spark, {"1": [0.5, -1.0], "2": [0.25, 2.0], "3": [0.0, 0.0]})
    out = str(tmp_path / "vec")
    meta = writers.write_vectors_text(v.repartition(3), out, header=header)
    assert meta == {"n": 3, "d": 2}
    back = {r.word: list(r.vector) for r in text.read_vectors_text(spark, out, header="first" if header else False).collect()}
    assert back == {"1": [0.5, -1.0], "2": [0.25, 2.0], "3": [0.0, 0.0]}
    if header:
        whole = "".join(p.read_text() for p in sorted((tmp_path / "vec").glob("part-*")))
        assert [x.split(" ")[0] for x in whole.split()[:1]] == ["3"] and whole.startswith("3 2\n1 ")


def test_vectors_text_files_with_own_headers(spark, tmp_path):
    _write(tmp_path / "a.txt", ["1 2", "x 1 2"])
    _write(tmp_path / "b.txt", ["1 2", "y 3 4"])
    got = {r.word: list(r.vector) for r in text.read_vectors_text(spark, str(tmp_path)).collect()}
    assert got == {"x": [1.0, 2.0], "y": [3.0, 4.0]}


@pytest.mark.parametrize(
    "lines",
    [["x 1 2", "y 3 4"], ["5 2", "a b c d", "e"], ["2 2", "x 1 2"], ["1 2", "x 1 2 3"], ["2 2", "x 1 2", "y 1 z"], ["1 2", "x 1 2", ""], ["n 2", "x 1 2"]],
)
def test_vectors_text_bad_files_raise(spark, tmp_path, lines):
    p = _write(tmp_path / "v.txt", lines)
    with pytest.raises(ValueError):
        text.read_vectors_text(spark, p)


def test_vectors_text_lost_or_odd_part_raises(spark, tmp_path):
    v = vectors_from_mapping(spark, {str(i): [float(i), 1.0] for i in range(20)})
    out = tmp_path / "vec"
    writers.write_vectors_text(v.repartition(4), str(out))
    assert text.read_vectors_text(spark, str(out), header=False).count() == 20
    part = sorted(p for p in out.glob("part-*") if p.stat().st_size)[0]
    kept = part.read_text()
    part.write_text("")
    (out / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError):
        text.read_vectors_text(spark, str(out), header=False)
    part.write_text(kept.replace(" 1.0", " 1.0 7.0", 1))
    with pytest.raises(ValueError):
        text.read_vectors_text(spark, str(out), header=False)


def test_part_keys_above_a_million(spark, tmp_path):
    from graphvec.sources import tables

    rows = [(1_000_005, 5), (5, 1_000_005), (3_000_000, 7)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = [tuple(r) for r in tables.part_supplier_edges(spark, str(tmp_path)).collect()]
    assert sorted(edges) == [(10, 2_000_011), (2_000_010, 11), (6_000_000, 15)]
    assert len({x for e in edges for x in e}) == 6


def test_model_round_trip_and_checks(spark, tmp_path):
    v = vectors_from_mapping(spark, {"a": [1.0, 2.0], "b": [3.0, 4.0]})
    out = str(tmp_path / "model")
    writers.save_model(v, out)
    back = {r.word: list(r.vector) for r in text.load_model(spark, out).collect()}
    assert back == {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    meta_file = [p for p in (tmp_path / "model" / "metadata").glob("part-*")][0]
    meta = json.loads(meta_file.read_text())
    meta["class"] = "something.Else"
    bad = tmp_path / "bad"
    (bad / "metadata").mkdir(parents=True)
    (bad / "metadata" / "part-00000").write_text(json.dumps(meta))
    v.write.parquet(str(bad / "data"))
    with pytest.raises(ValueError):
        text.load_model(spark, str(bad))


def test_labels_ids_histogram(spark, tmp_path):
    lab = _write(tmp_path / "g.csv", ["1,3", "1,4", "2,3"])
    assert sorted(tuple(r) for r in text.read_labels(spark, lab).collect()) == [("1", 3), ("1", 4), ("2", 3)]
    ids = _write(tmp_path / "n.csv", ["5", "6"])
    assert sorted(r.id for r in text.read_ids(spark, ids).collect()) == [5, 6]
    h = _write(tmp_path / "h.csv", ["numberOfVisits,numberOfVertices", "3,10", "4,2"])
    assert sorted(tuple(r) for r in text.read_visit_histogram(spark, h).collect()) == [(3, 10), (4, 2)]

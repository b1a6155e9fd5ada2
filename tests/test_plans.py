from graphvec.operators.embed import EmbedConfig
from graphvec.plans.embedding_job import WalkConfig, run_job, score_files


def test_job_and_scoring_round_trip(spark, tmp_path):
    a, b = range(1, 9), range(11, 19)
    lines = [f"{x},{y}" for x in a for y in a if x < y] + [f"{x},{y}" for x in b for y in b if x < y] + ["8,11"]
    edges = tmp_path / "edges.csv"
    edges.write_text("\n".join(lines) + "\n")
    labels = tmp_path / "labels.csv"
    labels.write_text("\n".join(f"{v},{1 if v < 10 else 2}" for v in list(a) + list(b)) + "\n")
    res = run_job(
        spark, str(edges), str(tmp_path / "out"), name="cliques",
        walk_cfg=WalkConfig(length=10, walks_per_vertex=10, seed=1),
        embed_cfg=EmbedConfig(vector_size=8, window=3, min_count=1, seed=3),
        write_histogram=True,
    )
    assert res.num_vectors == 16 and res.dim == 8
    runs, means = score_files(
        spark, str(tmp_path / "out" / "cliques_vec.txt"), str(edges), str(labels),
        train_percents=(0.5,), max_iter=20,
    )
    assert runs.count() == 1
    m = means.first()
    assert 0.0 <= m.micro_f1 <= 1.0 and m.shuffles == 1


def test_command_line_run_and_score(spark, tmp_path):
    from graphvec.__main__ import main

    edges = tmp_path / "data" / "edges.csv"
    edges.parent.mkdir()
    edges.write_text("\n".join(f"{i},{i % 7 + 1}" for i in range(1, 30)) + "\n")
    labels = tmp_path / "group-edges.csv"
    labels.write_text("\n".join(f"{i},{i % 2}" for i in range(1, 30)) + "\n")
    out = tmp_path / "out"
    out.mkdir()
    for header in (False, True):
        name = f"toy{header}"
        args = ["run", "--edges", str(edges), "--out", str(out), "--name", name, "--length", "5", "--walks", "4", "--dim", "8", "--window", "3"]
        assert main(args + ["--header"] * header) == 0
        assert (out / f"{name}_vec.txt").exists()
        score = ["score", "--emb", str(out / f"{name}_vec.txt"), "--edgelist", str(edges), "--labellist", str(labels)]
        assert main(score + ["--header", "first"] * header) == 0

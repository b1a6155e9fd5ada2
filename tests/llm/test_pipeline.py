"""The pipeline against a plain version of its stages, and the registered queries."""

import hashlib
import random
from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
import pyarrow as pa
from tests_llm_plain import brute_components, brute_substring, prose, sets
from tokenizers import Tokenizer

OPS = ["op1_url_filter", "op2_langid", "op3_robust_outliers", "op4_chain", "op5_pack_binary", "op6_prefix_groups", "op7_seed_extend", "op8_vp_tree", "op9_bpe", "op10_warc"]


def test_registered():
    names = entry.queries()
    assert [n for n in names if n in OPS] == OPS and "pipeline" in names
    assert {"op11_recurrent_lm", "op12_alignment", "op13_divergence_cube"} <= set(names)
    assert {"op13_divergence_cube", "op1_url_filter", "op6_prefix_groups", "op7_seed_extend", "op8_vp_tree", "op10_warc"} <= set(entry.oracle_sql())
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "drop_low_quality", "drop_near_copies", "drop_repeats", "pack_tokens"]


def table(spark, tmp_path):
    rng = random.Random(3)
    passage = prose(rng, "fr", 40)
    docs, labels = [], []
    for i in range(260):
        text = prose(rng, "en", rng.randint(60, 160))
        if i % 9 == 0:
            text += " grobian " + prose(rng, "en", 5) + " loweheit grobian"
        if i % 7 == 1:
            text += " " + passage
        if i % 13 == 2 and docs:
            text = docs[-1][1] + " end"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int("grobian" in text)))
    docs += [(300, None, None, None, None), (301, "too short", "en", "s", 9), (302, "der " * 200, "en", "s", 800), (*docs[40][:4], None), (303, docs[10][1], "en", "t", 1)]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, docs


def test_stages(spark, tmp_path, tokenizer_path):
    sf, rows = table(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [(r[0], r[1]) for r in rows]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, sf)
        assert out.columns == columns
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        got = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "toxicity":
            want = [(i, t) for i, t in kept if "grobian" not in (t or "")]
        elif name == "quality":
            want = [(i, t) for i, t in kept if i < 300 or i == 303]
        elif name == "near_copies":
            groups = {}
            for (i, t), root in zip(kept, brute_components(kept)[1]):
                assert sets(t)
                groups.setdefault(root, []).append((i, t))
            want = [min(g) for g in groups.values()]
        else:
            assert len(got) == len(kept)
            sums = {(i, sha) for i, _, _, sha in brute_substring(kept)}
            for i, t in got:
                assert (i, hashlib.sha256(" ".join(t.split()).encode()).hexdigest()) in sums
            want = got
        assert Counter(got) == Counter(want), name
        kept = got
    packed = corpus_pipeline.pack_tokens(spark, docs, sf).collect()
    theirs = Tokenizer.from_file(tokenizer_path)
    for i, t in kept:
        pieces = sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == [*theirs.encode(t, add_special_tokens=False).ids, 1]
    whole = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in whole.collect()) == Counter((r.doc_id, r.start, tuple(r.ids)) for r in packed)


def test_empty_table(spark, tmp_path):
    sf = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_python_functions_of_a_stage_get_small_batches(spark, documents):
    """Texts of 40 MB in a partition reach a worker in batches of a few MB; the caller's smaller setting is kept."""
    from graphvec import session
    from graphvec.llm import toxicity

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    was = spark.conf.get(session._BATCH_KEY)
    try:
        toxicity.filter_toxic(documents([(1, "x")]), toxicity.Chain([], [])).count()
        rows = spark.range(400).coalesce(1).selectExpr("repeat('word ', 20000) as text")
        found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 40_000_000 and max(found) < 2 * session.BATCH_BYTES
        spark.conf.set(session._BATCH_KEY, "1m")
        session.bounded_batches(spark)
        assert spark.conf.get(session._BATCH_KEY) == "1m"
    finally:
        spark.conf.set(session._BATCH_KEY, was)

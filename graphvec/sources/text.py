"""Text, CSV and model readers for the layouts of the engine this library
re-creates. Every reader is a distributed Spark read; nothing is parsed on
the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphvec.operators.graph import symmetrize
from graphvec.operators.ranking import running_total
from graphvec.session import write_table

# Fixed values of the saved-model layout (shared with Spark's own mllib
# Word2VecModel format).
MODEL_CLASS = "org.apache.spark.mllib.feature.Word2VecModel"
MODEL_VERSION = "1.0"
MODEL_SCHEMA = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)


def _strict_bigint(c: Column, what: str) -> Column:
    v = F.trim(c).cast("bigint")
    return F.when(v.isNull(), F.raise_error(F.concat(F.lit(f"bad {what}: "), F.coalesce(c, F.lit("<missing>"))))).otherwise(v)


def read_edge_list(spark: SparkSession, path: str, *, symmetric: bool = True) -> DataFrame:
    """``src,dst`` lines (no header, extra fields ignored, duplicates kept).
    A line with a non-integer or missing field fails the job. With
    ``symmetric`` every line yields both directions."""
    parts = F.split(F.col("value"), ",")
    edges = spark.read.text(path).select(
        _strict_bigint(F.get(parts, 0), "source id").alias("src"),
        _strict_bigint(F.get(parts, 1), "target id").alias("dst"),
    )
    return symmetrize(edges) if symmetric else edges


def numbered_lines(spark: SparkSession, path: str, *, across_files: bool = False) -> DataFrame:
    """``(file, line_no, value)`` with 0-based line numbers, computed in
    parallel: lines of one file split are numbered in order, and each split's
    offset is the line count of the splits before it. By default numbering
    restarts in every file; with ``across_files`` it runs through all files
    in name order (a positional table written as ordered part files). The
    tagged lines are written once so the numbering is stable on retry."""
    tagged = write_table(
        spark.read.text(path).select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_blk"),
            F.monotonically_increasing_id().alias("_mid"),
        ),
        "lines",
    )
    blocks = tagged.groupBy("file", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    # one row per file split
    blocks = running_total(blocks, ["file", "_blk"], "_n", out="_off")
    if not across_files:
        blocks = blocks.withColumn("_off", F.col("_off") - F.min("_off").over(Window.partitionBy("file")))
    return tagged.join(blocks, ["file", "_blk"]).select(
        "file", (F.col("_off") + F.col("_mid") - F.col("_first")).alias("line_no"), "value"
    )


def read_adjacency_matrix(spark: SparkSession, path: str, *, separator: str = " ") -> DataFrame:
    """Directed ``(src, dst)`` edges of an N x N 0/1 matrix: row ``i`` and
    column ``j`` (both 1-based) with cell ``1`` give the edge ``(i, j)``. The places of the
    ones are found inside the line, so only ones become rows. Not mirrored. Any non-integer cell fails the job. ``path`` is one file
    or a folder of part files in row order (rows numbered across files)."""
    lines = numbered_lines(spark, path, across_files=True)
    cells = F.split(F.trim("value"), _regex_quote(separator))
    ones = F.transform(cells, lambda c, j: F.when(_strict_bigint(c, "matrix cell") == 1, j + 1))
    found = F.explode(F.filter(ones, lambda j: j.isNotNull()))
    return lines.select((F.col("line_no") + 1).cast("bigint").alias("src"), found.alias("dst")).select("src", F.col("dst").cast("bigint"))


def _regex_quote(s: str) -> str:
    import re

    return re.escape(s)


def read_vectors_text(spark: SparkSession, path: str, *, header: bool | str = True) -> DataFrame:
    """``(word, vector ARRAY<FLOAT>)`` from ``node v1 .. vD`` lines.

    ``header=True``: every file starts with a line ``N D`` and holds N vectors of D components.
    ``header="first"``: the first file, in the order of names, starts with such a line for all files
    (what ``writers.write_vectors_text(header=True)`` writes).
    ``header=False``: part files and their ``_meta.json``, which must agree with the rows.

    A missing or malformed header, a wrong number of vectors or components, and components that
    are no numbers raise ``ValueError``; no line is ever left out.
    """
    if header is False:
        meta = spark.read.text(f"{path.rstrip('/')}/_meta.json").collect()
        meta = json.loads(meta[0].value)  # one line, written by the writer
        lines = spark.read.text(path).select(F.lit("all").alias("file"), F.split(F.trim("value"), " ").alias("t"))
        heads = spark.createDataFrame([("all", int(meta["n"]), int(meta["d"]))], "file string, n bigint, d int")
        body = lines
    else:
        lines = numbered_lines(spark, path, across_files=header == "first")
        lines = lines.select(F.lit("all").alias("file") if header == "first" else F.col("file"), "line_no", F.split(F.trim("value"), " ").alias("t"))
        first = lines.where(F.col("line_no") == 0)
        number = lambda i, kind: F.when(F.size("t") == 2, F.expr(f"try_cast(t[{i}] AS {kind})"))
        heads = first.select("file", number(0, "BIGINT").alias("n"), number(1, "INT").alias("d"))
        body = lines.where(F.col("line_no") > 0)
    rows = write_table(
        body.select(
            "file", F.col("t")[0].alias("word"),
            F.transform(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda x: x.try_cast("float")).alias("vector"),
        ),
        "vectors_text",
    )
    bad = F.exists("vector", lambda x: x.isNull())
    counts = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"),
        F.max(bad.cast("int")).alias("bad"),
    )
    checked = heads.join(counts, "file", "full_outer").withColumn("rows", F.coalesce("rows", F.lit(0)))
    wrong = checked.where(
        F.col("n").isNull() | F.col("d").isNull() | (F.col("n") != F.col("rows"))
        | ((F.col("rows") > 0) & ((F.col("lo") != F.col("d")) | (F.col("hi") != F.col("d")) | (F.col("bad") > 0)))
    ).limit(1).collect()
    if wrong:
        w = wrong[0]
        if w["n"] is None or w["d"] is None:
            raise ValueError(f"{w['file']}: the first line must be 'N D'")
        raise ValueError(f"{w['file']}: announced {w['n']} vectors of {w['d']}, found {w['rows']} of {w['lo']} to {w['hi']}" + " with components that are no numbers" * bool(w["bad"]))
    if heads.limit(1).count() == 0:
        raise ValueError(f"{path}: no vector file")
    return rows.select("word", "vector")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``vertex,label`` lines, several per vertex allowed: ``(node, label)``."""
    return spark.read.schema("node string, label int").option("mode", "FAILFAST").csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One integer id per line: ``(id)``."""
    return spark.read.schema("id bigint").option("mode", "FAILFAST").csv(path)


def read_visit_histogram(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header ``numberOfVisits,numberOfVertices``."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(
        F.col("numberOfVisits").cast("bigint").alias("number_of_visits"),
        F.col("numberOfVertices").cast("bigint").alias("number_of_vertices"),
    )


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """Saved model ``path/metadata`` (one JSON line) + ``path/data``
    (parquet). Class, version, schema, vector size and word count are all
    checked; one aggregate job, nothing collected but that row."""
    meta_rows = spark.read.text(f"{path}/metadata").collect()
    if len(meta_rows) != 1:
        raise ValueError("model metadata must be one line")
    meta = json.loads(meta_rows[0].value)
    if (meta.get("class"), meta.get("version")) != (MODEL_CLASS, MODEL_VERSION):
        raise ValueError(f"metadata names {meta.get('class')} {meta.get('version')}, this reads {MODEL_CLASS} {MODEL_VERSION}")
    data = spark.read.parquet(f"{path}/data")
    got = T.StructType([T.StructField(f.name, f.dataType) for f in data.select("word", "vector").schema])
    if got != MODEL_SCHEMA:
        raise ValueError(f"model data schema {got.simpleString()} != {MODEL_SCHEMA.simpleString()}")
    data = data.select("word", "vector")
    st = data.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")
    ).first()
    if st["n"] != meta["numWords"]:
        raise ValueError(f"metadata says {meta['numWords']} words, data has {st['n']}")
    if st["lo"] != meta["vectorSize"] or st["hi"] != meta["vectorSize"]:
        raise ValueError(f"metadata says {meta['vectorSize']} components, data has {st['lo']} to {st['hi']}")
    return data

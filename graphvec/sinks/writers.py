"""Distributed writers: vector text files, CSV tables and saved models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphvec.sources.text import MODEL_CLASS, MODEL_VERSION


def _vector_line(df: DataFrame) -> DataFrame:
    return df.select(
        F.concat_ws(" ", "word", F.array_join(F.col("vector").cast("array<string>"), " ")).alias("value")
    )


def write_vectors_text(vectors: DataFrame, path: str, *, header: bool = False, mode: str = "error") -> dict:
    """``node v1 .. vD`` lines as part files, and ``_meta.json`` holding ``{"n": N, "d": D}``.
    With ``header`` the first part file, in the order of names, is the line ``N D`` and the rest follow
    in the order of words, so the files one after the other are the one-file layout; no task writes more than its
    part."""
    st = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    n, d = int(st["n"]), int(st["d"] or 0)
    spark = vectors.sparkSession
    if header:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        body = _vector_line(vectors.repartitionByRange(parts, "word").sortWithinPartitions("word"))
        head = spark.createDataFrame([(f"{n} {d}",)], "value string").coalesce(1)
        lines = head.unionByName(body)  # a union keeps the order of its inputs' partitions
    else:
        lines = _vector_line(vectors)
    lines.write.mode(mode).text(path)
    meta = spark.createDataFrame([(json.dumps({"n": n, "d": d}),)], "value string").coalesce(1)
    meta.write.mode("overwrite").text(f"{path}/_meta.json")
    return {"n": n, "d": d}


def write_csv(df: DataFrame, path: str, *, header: bool = True, mode: str = "error") -> None:
    """Comma-separated rows with a header line per part file."""
    df.write.mode(mode).option("header", header).csv(path)


def write_visit_histogram(hist: DataFrame, path: str, *, mode: str = "error") -> None:
    """Histogram CSV with the original column names."""
    write_csv(
        hist.select(
            F.col("number_of_visits").alias("numberOfVisits"),
            F.col("number_of_vertices").alias("numberOfVertices"),
        ),
        path,
        mode=mode,
    )


def save_model(
    vectors: DataFrame, path: str, *, max_records_per_file: int = 100_000, mode: str = "error"
) -> None:
    """``path/metadata`` (one JSON line: class, version, vectorSize,
    numWords) and ``path/data`` (parquet ``word, vector ARRAY<FLOAT>``),
    files capped at ``max_records_per_file`` rows."""
    spark = vectors.sparkSession
    data = vectors.select("word", F.col("vector").cast("array<float>").alias("vector"))
    st = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not st["n"]:
        raise ValueError("cannot save an empty model")
    meta = json.dumps(
        {"class": MODEL_CLASS, "version": MODEL_VERSION, "vectorSize": int(st["d"]), "numWords": int(st["n"])},
        separators=(",", ":"),
    )
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/metadata")
    data.write.mode(mode).option("maxRecordsPerFile", max_records_per_file).parquet(f"{path}/data")

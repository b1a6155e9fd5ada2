"""Readers for the parquet tables the engine is tested on, and the graph,
vector and label inputs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def part_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed ``(src, dst)`` part -> supplier edges, one per lineitem row
    (duplicates kept: a part bought twice from a supplier is a multi-edge).
    Parts are the even, suppliers the odd vertex ids, so they never meet."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_partkey").cast("bigint") * 2).alias("src"),
        (F.col("l_suppkey").cast("bigint") * 2 + 1).alias("dst"),
    )


def supplier_to_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed ``(src, dst)`` supplier -> part edges with the raw keys as one id space: vertices
    that are parts only are sinks."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").cast("bigint").alias("src"), F.col("l_partkey").cast("bigint").alias("dst"))


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``(buyer, seller)`` nations: some customer of the one bought from a supplier of the
    other."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    buyers = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("buyer"))
    sellers = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("seller"))
    trade = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(buyers, F.col("o_custkey") == buyers.c_custkey)
    return trade.join(sellers, F.col("l_suppkey") == sellers.s_suppkey).select("buyer", "seller").distinct()


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word, vector ARRAY<FLOAT>)`` from the ``embeddings`` table."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("string").alias("word"),
        F.col("embedding").cast("array<float>").alias("vector"),
    )


def embedding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node, label)`` long form: each embedded node carries its own label
    plus the label ``vec_id % 10``, giving one or two labels per node."""
    emb = read_table(spark, sf_dir, "embeddings")
    own = emb.select(F.col("vec_id").cast("string").alias("node"), F.col("label").cast("int"))
    second = emb.select(
        F.col("vec_id").cast("string").alias("node"), F.pmod("vec_id", F.lit(10)).cast("int").alias("label")
    )
    return own.unionByName(second).distinct()

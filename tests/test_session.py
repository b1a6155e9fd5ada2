import os

import pytest
from pyspark.sql import functions as F

from graphvec.session import drop_table, write_table


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = _shuffle_files(spark), spark.conf.get(key)
    rows = write_table(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert rows.agg(F.sum("count")).first()[0] == 1000
    made = {f for f in _shuffle_files(spark) - before}
    assert len({f.split("_")[1] for f in made}) <= 1  # of the sum just taken
    assert spark.conf.get(key) == setting


def test_tables_that_are_not_ours_are_not_deleted(spark, tmp_path):
    mine = write_table(spark.range(5), "numbers")
    drop_table(mine)
    assert not os.path.exists(mine.inputFiles()[0].removeprefix("file://"))
    path = str(tmp_path / "theirs")
    spark.range(5).write.parquet(path)
    with pytest.raises(ValueError, match="no table"):
        drop_table(spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 5


def test_rows_written_and_read_back(spark):
    """All kinds of columns survive the packing of written tables."""
    df = spark.createDataFrame(
        [(1, 2, 1.5, "a", [1, None], bytearray(b"x"), True), (None, None, None, None, None, None, None), (-(2**62), -3, float("nan"), "", [], bytearray(), False)],
        "a long, b short, c double, d string, e array<int>, f binary, g boolean",
    )
    back = write_table(df.repartition(1), "kinds").collect()
    assert sorted(map(str, back)) == sorted(map(str, df.collect()))

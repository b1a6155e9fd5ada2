"""Session helpers: building a local session for tests/bench and finding the
checkpoint folder a job may use to cut lineage.

The checkpoint folder is whatever ``spark.checkpoint.dir`` names (a shared, reliable file system);
without it nothing is written. All tables of one application lie in one folder below it, which
``drop_scratch`` deletes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF_KEY = "spark.checkpoint.dir"

# Rows per partition/bucket for tables whose row count is known (about 64-160
# MB of walker or slot rows); a floor on top of spark.sql.shuffle.partitions.
ROWS_PER_PARTITION = 2_000_000

_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables between steps: sorted numbers as differences, pages packed harder than by Spark's default.
_WRITTEN = {"compression": "zstd", "parquet.writer.version": "v2"}

#: Bytes of rows that travel between the JVM and a Python worker at a time (Spark's default is 64 MB, held on both sides by every task).
BATCH_BYTES = 4 << 20


def local_session(
    cpus: int | str = "*",
    *,
    shuffle_partitions: int = 8,
    app: str = "graphvec",
    driver_memory: str = "8g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A local session with the settings the library is designed for. Jobs that write tables
    between steps need ``spark.checkpoint.dir`` (``extra`` or Spark's own defaults)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on batches of this session's Python functions hold at most some ``most`` bytes, whatever the length of texts; a
    smaller setting is kept. Which rows a function gets does not change, only how many at a time."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_KEY))
    if now <= 0 or now > most:
        spark.conf.set(_BATCH_KEY, f"{most}b")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, registering it with the
    SparkContext. Raises if ``spark.checkpoint.dir`` is not set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(_CONF_KEY, None) or sc.getConf().get(_CONF_KEY, None)
    if not configured:
        raise RuntimeError(
            f"{_CONF_KEY} is not set: tables between steps need a shared, reliable folder"
        )
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def partitions_for(spark: SparkSession, rows: int, explicit: int | None = None) -> int:
    """Partition count for ``rows`` rows: ``explicit`` if given, else the
    larger of ``spark.sql.shuffle.partitions`` and one per
    ``ROWS_PER_PARTITION`` rows, so a small session setting cannot make
    huge partitions or buckets."""
    if explicit:
        return int(explicit)
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(base, -(-int(rows) // ROWS_PER_PARTITION))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder for a written table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def scratch_root(spark: SparkSession) -> str:
    """The application's folder below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/graphvec-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table this application wrote below the checkpoint folder. DataFrames that
    read them are unusable afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes a query's shuffle files when it has ended, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEAN_KEY, None)
    spark.conf.set(_CLEAN_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_KEY) if before is None else spark.conf.set(_CLEAN_KEY, before)


def drop_table(table: DataFrame) -> None:
    """Delete the files of a frame that ``write_table`` returned and no other frame still reads."""
    spark = table.sparkSession
    for path in table._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().rootPaths().mkString("\n").split("\n"):
        if f"/graphvec-{spark.sparkContext.applicationId}/" not in path:
            raise ValueError(f"{path} is no table of this application")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_table(
    df: DataFrame,
    name: str,
    *,
    partition_by: list[str] | None = None,
    path: str | None = None,
    mode: str = "error",
) -> DataFrame:
    """Write ``df`` as parquet below the shared checkpoint folder and return a
    DataFrame reading it back: lineage is cut, the rows survive executor loss,
    and Spark sees real file sizes when it picks a join strategy. The shuffle files of the job are deleted at its end.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    w = df.write.format("parquet").mode(mode).options(**_WRITTEN)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with _shuffles_end_with_query(spark):
        w.save(path)
    # the schema is known: no job has to read it from the files (partition columns come last and are told by the folders)
    return spark.read.parquet(path) if partition_by else spark.read.schema(df.schema).parquet(path)

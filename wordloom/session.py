"""Session helpers: a tuned local session for tests/bench and lineage cutting."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "wordloom") -> SparkSession:
    """Build (or reuse) a session with AQE and Arrow on and the UI off."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WORDLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.wordloom.scanPartitions", str(2 * parts))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the context at ``spark.checkpoint.dir``.

    On a cluster the setting must name a shared folder; we only invent one
    (under /tmp) when it is unset *and* the master is local, as in tests.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative operators")
        path = tempfile.mkdtemp(prefix="wordloom-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the tables written inside go when each is written, not at some later garbage collection."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# primary key of each input table (the key that spread() partitions by)
TABLE_KEYS = {"documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id",
              "pages": "page_id", "benchmark": "item_id", "conversations": "conv_id"}


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` in as many partitions as ``spark.wordloom.scanPartitions`` says; as it is where that is unset.

    For inputs written as one row group, which a single task reads. The setting
    is the user's: neither the input's size nor the number of cores decides, and no result depends on it.
    """
    want = df.sparkSession.conf.get("spark.wordloom.scanPartitions", None)
    if not want:
        return df
    return df.repartition(int(want), key) if key else df.repartition(int(want))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), TABLE_KEYS.get(name))


def write_state(df: DataFrame, name: str = "state", compression: str = "snappy", rows: int | None = None) -> DataFrame:
    """Cut lineage by writing a parquet table under ``spark.checkpoint.dir`` (the
    shared folder) and reading it back; for per-iteration state tables. While it is written, Arrow batches hold at most
    ``rows`` rows, for tables whose rows are of megabytes."""
    import uuid
    spark = df.sparkSession
    root, before = ensure_checkpoint_dir(spark), spark.conf.get(BATCH_ROWS)
    path = f"{root.rstrip('/')}/wordloom-{name}-{uuid.uuid4().hex}"
    try:
        if rows:
            spark.conf.set(BATCH_ROWS, str(min(int(before), rows) if int(before) > 0 else rows))
        with shuffles_removed(spark):
            df.write.mode("overwrite").option("compression", compression).parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.parquet(path)


def drop_state(df: DataFrame) -> None:
    """Delete the files of a superseded ``write_state`` table; nothing may read it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/wordloom-" in folder:  # a table of this library
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

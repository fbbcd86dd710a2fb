"""State tables in the shared folder, and small helpers the operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import BATCH_ROWS, ensure_checkpoint_dir, shuffles_removed


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_state(df: DataFrame, name: str, rows: int | None = 2000) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    While it is written, Arrow batches hold at most ``rows`` rows, so a worker has a few MB of text at a time;
    None leaves the session's setting, for tables of numbers, whose per-batch sums then merge more.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(BATCH_ROWS)
    try:
        if rows:
            spark.conf.set(BATCH_ROWS, str(min(int(before), rows) if int(before) > 0 else rows))
        with shuffles_removed(spark):
            df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_states(*states: DataFrame | None) -> None:
    """Delete the files of ``write_state`` tables that nothing will read any more."""
    for state in states:
        for folder in {f.rsplit("/", 1)[0] for f in state.inputFiles()} if state is not None else ():
            path = state.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(state.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    at = at.astype(np.int64)
    if column.null_count:
        gone = column.is_null().to_numpy(zero_copy_only=False)
        if (np.diff(at)[gone] > 0).any():
            return utf8(column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
                                         else b""))
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]: at[-1]], at - at[0]


#: What operators keep in a worker process from task to task: name -> how to forget it.
KEPT: dict[str, Callable[[], None]] = {}


def release() -> None:
    """Give freed memory back to the system: workers are reused, also by other operators' tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20,
             owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``limit`` bytes in each; a longer value is alone.

    What operators other than ``owner`` keep in this worker is forgotten first, and memory is released at the end.
    """
    for name in KEPT.keys() - {owner}:
        KEPT[name]()
    for batch in batches:
        at, lo = utf8(batch[column])[1], 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    release()


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def sub_bucket(*columns, buckets: int):
    """Bucket 0 .. buckets-1 from a hash of ``columns``."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


FILTER_BITS = 1 << 23


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bits_of(keys: DataFrame, place: Column):
    """A broadcast bit map of ``FILTER_BITS`` bits in which the bits at ``place`` of every row are set."""
    parts = (keys.select((place + 1).alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("n"))
             .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits")).collect())
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for n, bits in parts:
        whole[(n - 1) * 4096: n * 4096] = np.frombuffer(bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole.tobytes())


def _sieved(df: DataFrame, column: str, keys: DataFrame, inside: bool) -> DataFrame:
    sieve = bits_of(keys, F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(FILTER_BITS)))
    own = free_name(df, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sieve.value, np.uint8)
        for batch in batches:
            null = np.array(batch[own].is_null())
            at = batch[own].fill_null(0).to_numpy()
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & ~null
            yield batch.drop_columns([own]).filter(pa.array(hit == inside))

    hashed = df.withColumn(own, F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))))
    return hashed.mapInArrow(run, df.schema)


def maybe_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be in ``keys`` (one column): a first sieve before the exact join.

    The keys' hashes set bits of a bit map of fixed size (1 MB), the only thing
    that is broadcast. With very many keys all rows pass, and the join does all the work.
    """
    return _sieved(df, column, keys, True)


def surely_out(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows that ``maybe_in`` leaves out: their ``column`` is null or not in ``keys``."""
    return _sieved(df, column, keys, False)


def without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``df`` left-anti ``keys`` on ``column``; only rows the sieve cannot clear go through the join."""
    return surely_out(df, column, keys).union(
        maybe_in(df, column, keys).join(keys.withColumnRenamed(keys.columns[0], column), column, "left_anti")
        .select(*df.columns))


SKETCH_BITS, SKETCH_ROWS, SLICES = 19, 2, 64


class Sketch:
    """Count-min sketch of 64-bit tokens, of fixed size: summed per task, then over tasks, then broadcast."""

    def __init__(self, counts: np.ndarray | None = None):
        self.counts = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64) if counts is None else counts

    @staticmethod
    def places(tokens: np.ndarray) -> list[np.ndarray]:
        down = np.uint64(64 - SKETCH_BITS)
        return [(tokens >> down).astype(np.int64), ((tokens * np.uint64(0xD1342543DE82EF95)) >> down).astype(np.int64)]

    def add(self, tokens: np.ndarray) -> None:
        for row, at in zip(self.counts, self.places(tokens)):
            row += np.bincount(at, minlength=len(row))

    def slices(self) -> list[bytes]:
        return [x.astype("<i8").tobytes() for x in self.counts.reshape(SLICES, -1)] if self.counts.any() else []

    def counted(self, tokens: np.ndarray) -> np.ndarray:
        """At least the true numbers."""
        return np.minimum.reduce([row[at] for row, at in zip(self.counts, self.places(tokens))])

    @property
    def usual(self) -> int:
        """What light tokens bring to any cell."""
        return int(self.counts[0].mean())

    @staticmethod
    def gather(parts: DataFrame):
        """A broadcast of the sum of (slice, counts) rows: summed in streams, first by slice and reading task."""
        near = parts.withColumn("task", F.spark_partition_id() % 64)
        total = _summed(_summed(near, ["slice", "task"]), ["slice"])
        got = {r["slice"]: bytes(r["counts"]) for r in total.select("slice", "counts").collect()}
        blank = bytes(8 * (SKETCH_ROWS << SKETCH_BITS) // SLICES)
        return parts.sparkSession.sparkContext.broadcast(b"".join(got.get(i, blank) for i in range(SLICES)))

    @classmethod
    def of(cls, raw: bytes) -> Sketch:
        return cls(np.frombuffer(raw, "<i8").reshape(SKETCH_ROWS, -1))


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of counts per key, held one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        out = lambda: pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[-1]], pa.int32()), blobs([total.tobytes()])],
            ["slice", "task", "counts"])
        for batch in batches:
            for i in range(batch.num_rows):
                now = tuple(batch[k][i].as_py() for k in keys)
                if now != key:
                    if key is not None:
                        yield out()
                    key, total = now, np.frombuffer(batch["counts"][i].as_py(), "<i8").copy()
                else:
                    total += np.frombuffer(batch["counts"][i].as_py(), "<i8")
        if key is not None:
            yield out()

    return (parts.repartition(*keys).sortWithinPartitions(*keys).select("slice", "task", "counts")
            .mapInArrow(run, "slice int, task int, counts binary"))


def keyed_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal key columns in a sorted stream, each as one table."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[n].to_numpy() for n in names])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            key = tuple(keys[:, lo].tolist())
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)
    release()

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

#: An odd 64-bit constant for mixing.
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets one of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.getCheckpointDir():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rupaka-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


#: Drops a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives executors. The shuffle files that led to it go."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/rupaka-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Writes tables, as written() does, that are deleted at the end of the ``with`` block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/rupaka-scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        return written(df, self.folder)

    def __exit__(self, *_) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Settings that bound what one batch of rows holds in the JVM and in a worker, and their most.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch sizes to BATCHES: with long texts, copies of a batch are most of what a task needs besides its sort."""
    for key, most in BATCHES.items():
        now = spark.conf.get(key).lower().rstrip("b")
        if int(now.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(now[-1], 0) > most:
            spark.conf.set(key, str(most))


def released(run):
    """An Arrow function that gives what it has freed back to the system when its rows have ended: a worker goes on to serve other stages."""

    @functools.wraps(run)
    def then(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return then


#: Bits of a Bitmap: 4 MB, whatever is in it.
BITS = 1 << 25


class Bitmap:
    """A set of ids as BITS bits by their hash, built on the cluster in buckets of 4 KB and broadcast: bounded at BITS / 8 bytes.

    Rows that it doesn't have surely aren't in the set, so only the others need an exact join.
    """

    def __init__(self, ids: DataFrame, col: str, table_of=written):
        bucket, bit = F.bitmap_bucket_number(self._spot(F.col(col))), F.bitmap_bit_position(self._spot(F.col(col)))
        spots = ids.filter(F.col(col).isNotNull()).select(bucket.alias("bucket"), bit.alias("bit"))
        self.rows = table_of(spots.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))

    @staticmethod
    def _spot(col):
        return F.pmod(F.xxhash64(col, F.lit(77)), F.lit(BITS)) + 1

    def marked(self, df: DataFrame, col: str, name: str = "marked") -> DataFrame:
        """Adds the boolean ``name``: whether the set may hold the row's id; false for null ids."""
        spot = self._spot(F.col(col))
        bit = F.bitmap_bit_position(spot)
        byte = F.conv(F.hex(F.substr(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        rows = self.rows.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
        joined = df.join(F.broadcast(rows), F.when(F.col(col).isNotNull(), F.bitmap_bucket_number(spot)) == F.col("_bucket"), "left")
        return joined.withColumn(name, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as ``doc_id``) and the text (as ``text``); whatever else a table holds can't clash with names used later. Texts then go through Arrow in small batches."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    r"""A 64-bit hash of each word ``[^\x20\x09-\x0D]+``; bytes.split() parts exactly at those six characters."""
    words = data.split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words, joined from runs of powers of two; empty if there are fewer words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    out, at, power, width = None, 0, words, 1
    while True:
        if size & width:
            n = len(words) - at - width + 1
            part = power[at : at + n] if out is not None else power
            out = part if out is None else mix(out[:n] * MIX + part)
            at += width
        if at == size:
            return out[: len(words) - size + 1]
        power, width = mix(power[:-width] * MIX + power[width:]), 2 * width

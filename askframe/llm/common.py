"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; only Spark's reader touches the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of texts that are handled at a time, but for a single longer one.
SLICE_BYTES = 4 << 20
#: Bytes of the Arrow batches that go to Python workers. Spark's own limit of 64 MB, of which worker and executor hold
#: several, is lowered to it; another setting of the session stays.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a table's Parquet files up to which it is broadcast; beyond, both sides of a join are shuffled.
BROADCAST_BYTES = 16 << 20


def slices(batch: pa.RecordBatch, column: int, rows: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``rows`` rows and about SLICE_BYTES of a string or binary column."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(sizes, before + SLICE_BYTES))))
        yield batch.slice(start, end - start)
        start = end


def small_batches(spark: SparkSession) -> None:
    """Lower the size of Arrow batches to BATCH_BYTES, where the session has not been given one of its own."""
    if spark.conf.get(_BATCH) in ("67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def map_texts(
    df: DataFrame,
    key: str,
    text: str,
    out_schema: str,
    fn: Callable[[list[str]], Sequence[pa.Array]],
    rows: int = 256,
) -> DataFrame:
    """Apply ``fn`` to slices of at most ``rows`` texts (null as empty) and return ``key`` beside its columns.

    A slice ends early at SLICE_BYTES, so memory is bounded by that and the longest text.

    ``fn`` gets a list of strings and returns one Arrow array for each field of ``out_schema``. Only ``key`` and
    ``text`` are read, so other columns of ``df``, whatever their names, neither clash nor cost anything.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, rows):
                arrays = [part.column(0), *fn(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = T.StructType([source.schema["k"], *T._parse_datatype_string(out_schema).fields])
    names = out.fieldNames()
    return source.mapInArrow(run, out).withColumnRenamed("k", key)


def shared_folder(spark: SparkSession) -> str:
    """The folder that every machine sees: the one the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine may do without; a cluster that names none is refused, as its executors would each
    write to a disk of their own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        context.setCheckpointDir(named or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and go on from there, for what a lazy result still reads.

    A lost executor then costs a re-read of files that every machine sees. Spark takes the files away with the frames
    that read them, where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes to."""
    files, at = _store(spark, path)
    files.delete(at, True)


class Scratch:
    """Tables that an operator writes on its way, in the shared folder, and drops as soon as it has read them.

    Like ``cut``, each ends the lineage before it. As Parquet they take less room than checkpoints, and readers skip the
    columns that they don't need. The shuffle files of the plan that wrote a table go when it is written.
    """

    _SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        small_batches(spark)
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        path, conf = f"{self.folder}/{uuid.uuid4().hex}", self.spark.conf
        before = conf.get(self._SHUFFLES, "false")
        conf.set(self._SHUFFLES, "true")
        try:
            df.write.option("parquet.block.size", 16 << 20).parquet(path)
        finally:
            conf.set(self._SHUFFLES, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = table, path
        return table

    def small(self, table: DataFrame) -> DataFrame:
        """A table of ``cut``, to be broadcast if its files hold BROADCAST_BYTES at most."""
        files, at = _store(self.spark, self.paths[id(table)][1])
        return F.broadcast(table) if files.getContentSummary(at).getLength() <= BROADCAST_BYTES else table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``cut`` returned; nothing may read them any more."""
        for table in tables:
            delete(self.spark, self.paths.pop(id(table))[1])

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        kept = {id(t) for t in tables}
        self.drop(*[table for key, (table, _) in list(self.paths.items()) if key not in kept])

    def close(self) -> None:
        """Delete all that is left."""
        self.paths.clear()
        delete(self.spark, self.folder)


def hash128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of the same values, to be used together as one 128-bit name."""
    return [F.xxhash64(F.lit(7), *columns), F.xxhash64(F.lit(1_000_003), *columns, F.lit(11))]


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once for each row, whatever uses it.

    Filters that the optimizer infers and pushes down, and projections that it merges, would copy a costly expression
    into each place that refers to it, even into the body of a lambda. Nothing is moved through a generator.
    """
    kept = [F.col(c) for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))

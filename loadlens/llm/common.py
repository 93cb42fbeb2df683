"""What the training-data operators share: table reading, scratch tables and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a maximal run without space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is configured, a folder of our own serves a local master, as in tests; on a
    cluster that is an error, as executors would not see it."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        configured = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/loadlens-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_fs(spark: SparkSession, path: str):
    """The Hadoop file system that owns path, and path as that system's object. For metadata work on the driver only."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(df_or_path, spark: SparkSession | None = None) -> None:
    """Delete a scratch table that no pending result reads any more."""
    if isinstance(df_or_path, DataFrame):
        spark, paths = df_or_path.sparkSession, {f.rpartition("/")[0] for f in df_or_path.inputFiles()}
    else:
        paths = {df_or_path}
    for path in paths:
        fs, at = hadoop_fs(spark, path)
        fs.delete(at, True)


#: Rows of one long each that a semi-join may broadcast, about 100 MB. Beyond it both sides are shuffled.
BROADCAST_IDS = 4_000_000


def rows_with(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of df whose column name is in ids (one column of that name, distinct, materialized).

    ids are broadcast after a look at their number; more of them than BROADCAST_IDS go through a shuffle join."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, name, "left_semi")


_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = 16_000_000):
    """Within it, jobs hand at most about so many bytes to Python at once; else a batch is bounded by its rows alone."""
    before = spark.conf.get(_BATCH_CONF, None)
    spark.conf.set(_BATCH_CONF, most)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_CONF) if before is None else spark.conf.set(_BATCH_CONF, before)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_batch(fields: list[tuple[str, pa.DataType]]):
    """Turn a function from a RecordBatch to columns (or None) into one for mapInArrow."""
    schema = pa.schema(fields)

    def wrap(f):
        def run(batches):
            for batch in batches:
                if batch.num_rows and (columns := f(batch)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c, t in zip(columns, schema, strict=True)], schema=schema)

        return run

    return wrap

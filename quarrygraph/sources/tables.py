"""Readers for the engine's own tables, the shared checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written table that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode, where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quarrygraph-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: The session's setting that removes a query's shuffle files once it has run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """:func:`cut` for large tables: compressed columns in the same folder; what was shuffled to make them is removed.

    ``df`` must not be read again other than by its own plan.
    """
    return in_turn([df])


def in_turn(parts: Iterable[DataFrame]) -> DataFrame:
    """Parts of one schema as one :func:`stored` table; each is written before the next is asked for."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        ensure_checkpoint_dir(spark)
        path = path or f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Remove :func:`stored` tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/stored-" in f}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores by a hash of ``keys``, if what it reads is too little to fill them (one file may be one row group).

    Large inputs fill the cores with their own splits and are not shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores, *keys) if int(str(size)) < cores * split else df


def bounded(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``written`` (a read or :func:`cut` table, as it is counted) to be broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(written) if written.limit(rows + 1).count() <= rows else written

"""Session helpers: a local session for tests/bench, and lineage cutting.

Library code never builds its own session; it receives one. ``local_session``
exists for tests, the bench and the smoke entry.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", app: str = "strata", extra: dict | None = None) -> SparkSession:
    """A ``local[cores]`` session with AQE on and the UI off (tests, bench)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**_LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` from the session. Only when it is unset and
    the master is local (tests, bench) a scratch folder is created; on a cluster
    an unset value is an error, because a machine-local folder would not survive
    the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3) for this cluster")
    path = tempfile.mkdtemp(prefix="strata-ckpt-", dir=os.environ.get("STRATA_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


#: Measured bytes up to which a table is broadcast.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row in a broadcast table, about: text by its length, other
    values 8, and 32 for the row."""
    size = F.lit(32)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        size = size + (F.coalesce(F.octet_length(c), F.lit(0)) + 8 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8))
    return size.cast("long")


def materialize(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """Cut the lineage of ``df`` with a reliable checkpoint (written to the
    shared ``spark.checkpoint.dir``, so it survives executor loss; an eager
    reliable checkpoint computes and writes in one job) and return
    (checkpointed frame, metrics). ``count`` (rows) and ``bytes`` are always
    measured, as are extra aggregate ``metrics`` (aliased), while the rows are
    written: no job of their own. (Should an executor be lost meanwhile, rows
    may be counted twice; the metrics only serve as bounds.)"""
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    ck = df.observe(seen, F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes"), *metrics).checkpoint(eager=True)
    return ck, seen.get


def stage_end(df: DataFrame) -> DataFrame:
    """The same rows, with the generated code of what leads up to them in a class of
    its own. Spark writes a chain of projections, filters and lookups as one method, and
    the JVM only interprets a method above 8,000 bytes; an observed frame ends the chain."""
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` (reliable, shared folder) and return the new frame."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

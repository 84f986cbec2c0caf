"""Session settings and the two ways a job cuts its lineage.

Both ways write to the shared folder named by ``spark.checkpoint.dir`` so that a
lost executor costs a re-read, never a rebuild.  Only a local master (tests,
notebooks) may leave it unset.  ``passing_stages`` removes what a finished step staged.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # no Python stack trace per column call
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "orderlens", **conf: str) -> SparkSession:
    """A session with adaptive execution on and timestamps pinned to UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor must see.

    Only a local master may do without: it gets a new scratch folder.  Anywhere else a
    folder on the driver's own disk would split the stages over the machines.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="orderlens-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (not so for local-cluster)."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    For results that several later branches read: the upstream joins run once,
    later readers still prune columns and push filters, and the optimizer sees
    the real file size, so its automatic broadcasts rest on a checked size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    for paths in _passing.__dict__.get("paths", ())[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The stages of the blocks a thread is in, by ``passing_stages``.
_passing = threading.local()


@contextmanager
def passing_stages(spark: SparkSession) -> Iterator[None]:
    """Stages that are written inside are removed at the end, and so are shuffle files that no
    query reads any more.  For work whose results are stored elsewhere before the block ends.
    """
    stack = _passing.__dict__.setdefault("paths", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            remove(spark, path)
        release_shuffles(spark)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of queries that are over.

    Its cleaner follows the driver's garbage collector, which by itself may run every half an
    hour, while a job that rewrites tables batch by batch leaves files behind with each batch.
    """
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing is read from any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps partition order (needed for global ranks)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

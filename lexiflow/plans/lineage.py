"""Cut a plan where a result is read more than once, so that it is computed once and survives lost executors.

Small results go through ``checkpoint()``; large ones are written as a compressed table. Both lie in the shared folder that
the cluster names in ``spark.checkpoint.dir``. Without that setting a session on one machine gets a temporary folder, as in
tests; on a cluster, whose executors can't see it, that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import warnings

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_folders: dict[str, SparkSession] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lexiflow-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    _folders[sc.getCheckpointDir()] = spark
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there; partitions and their order stay."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """``df`` written as a table beside the checkpoints and read from there; columns that aren't asked for aren't read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.parquet(path)


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder for files of one's own, deleted with the tables."""
    path = f"{checkpoint_dir(spark)}/files/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete the tables and files that this process wrote. Results that still read them can't be used any more."""
    while _written:
        _delete(*_written.pop())


@atexit.register
def _clean() -> None:
    """At the end of the process: the tables and the checkpoints of its sessions, as far as these still live."""
    try:
        release()
        for path, spark in _folders.items():
            _delete(spark, path)
    except (Py4JError, Py4JNetworkError, ConnectionError, AttributeError, TypeError) as e:
        warnings.warn(f"left for the cluster to clean, as the session has ended: {[*_folders]} ({type(e).__name__})", stacklevel=1)

"""Tables in the folder that all executors share.

Lineage is cut by writing a table there and reading it back, so a lost executor
costs a re-read and never a recomputation of what came before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is used in local mode only;
    on a cluster its absence is an error. The folder goes when Python ends.
    """
    context = spark.sparkContext
    if context.applicationId not in _folders:
        base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="themeloom-")
        folder = f"{base.rstrip('/')}/themeloom-{context.applicationId}"
        _folders[context.applicationId] = folder
        atexit.register(_drop, context, folder)
    return _folders[context.applicationId]


def _drop(context, folder: str) -> None:
    if context._jsc is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Folders for tables on the way, shared by driver and executors, and how many parts they are dealt in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[tempfile.TemporaryDirectory] = []
#: (session, folder) of the folders handed out and not yet removed.
_handed: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only a session on one machine may do without that setting; its folder goes with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.TemporaryDirectory(prefix="dossier-", ignore_cleanup_errors=True))
        root = "file://" + _local[0].name
    folder = f"{root.rstrip('/')}/streams/{uuid.uuid4().hex}"
    _handed.append((spark, folder))
    return folder


def release(spark: SparkSession) -> None:
    """Removes the session's folders handed out until now; results that are read from them must have been read or written on."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for own in [h for h in _handed if h[0] is spark]:
        path = spark._jvm.org.apache.hadoop.fs.Path(own[1])
        path.getFileSystem(conf).delete(path, True)
        _handed.remove(own)


def written(rows: DataFrame, folder: str) -> DataFrame:
    """The rows, written to a folder (in place of what a lost attempt left there) and read back: what follows doesn't repeat them."""
    rows.write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def partitions(spark: SparkSession) -> int:
    """Parts for steps that hold much of a part at once: as many as the session states, where Spark would join them to one a core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

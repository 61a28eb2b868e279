"""What driver and executors share: written tables, which cut lineage and outlive executors, and this package."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Applications that the package was sent to.
_SENT: set[str] = set()
#: Tables that `write_table` has written and `delete_tables` has not deleted.
WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; an own one where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def write_table(df: DataFrame, name: str, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes a frame to the shared folder; the frame that reads it, and its path."""
    spark = df.sparkSession
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete_tables(spark: SparkSession, paths) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


def send_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, through the shared folder; once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        for at, _, names in os.walk(PACKAGE):
            for name in sorted(n for n in names if n.endswith(".py")):
                z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(PACKAGE)))
    path = f"{shared_folder(spark)}/{os.path.basename(PACKAGE)}-{uuid.uuid4().hex}.zip"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(content.getvalue())
    out.close()
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)

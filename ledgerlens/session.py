"""Session construction and reliable materialisation."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def build_session(app_name: str = "ledgerlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume.

    Time zone UTC makes timestamp arithmetic reproducible; AQE coalesces small
    shuffle partitions and splits skewed join partitions. Shuffle parallelism is
    left to the cluster's own configuration unless given in ``conf``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give every executor this package, whatever folder or machine it starts in; once per application."""
    package = os.path.dirname(os.path.abspath(__file__))
    name = f"{os.path.basename(package)}.zip"
    if any(str(f).endswith(name) for f in spark.sparkContext._python_includes):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-package-"), name)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)  # the driver serves it to the executors


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may fall
    back to a scratch folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/ledgerlens-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from that table.

    Used where the same rows are read more than once and must come out identical
    (a rank and its offsets, a sum of doubles feeding two branches), and to cut
    the lineage of loops. Being a Parquet table rather than a checkpointed RDD it
    keeps column pruning, filter pushdown and a known size, and it survives the
    loss of any executor. Inside ``with stages(spark)`` it is removed at the end of
    the block; else the folder, named by the application, is its owner's to remove.
    ``compression`` names another codec than the session's.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``materialize`` writes inside the block when it ends.

    For code whose results have been written by then, such as a scored batch.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

"""Session construction and the shared folder every job cuts its lineage into."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(master).appName("tidemark")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A local master (tests) without one gets a local folder.

    The setting is read from the session, also where only the context was given a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, name: str = "cut", instead: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends there and no executor owns it.

    ``instead`` is a frame of an earlier call that nothing reads any more, as that of a loop's last round: its files go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._files = path
    if instead is not None and getattr(instead, "_files", None):
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(instead._files)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
    return out


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is to be a merge join: its size on disk says little of its rows, so Spark could broadcast what no driver holds."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

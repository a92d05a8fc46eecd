"""Session, tables and lineage cuts, shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "skeinlog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; a running one is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a directory of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    ``spark.checkpoint.dir`` is used where the cluster names it. Only where it is unset (tests on one
    machine) a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "skeinlog-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_folders: set[str] = set()


def _delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of cuts; nothing is left to do where the JVM has ended before."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
    except Exception:  # noqa: BLE001
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no recomputation.

    Written as Parquet and not by ``checkpoint()`` so that the next plan sees sizes, prunes columns and
    pushes filters. All cuts of an application are deleted when its driver ends.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    folder = f"{checkpoint_dir(spark).rstrip('/')}/skeinlog-{app}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

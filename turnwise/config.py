"""Names of tables and folders used by a run, and the folder shared by all executors."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from functools import cache

from pyspark import SparkContext
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Names:
    """Where one deployment keeps its data. Tables are named ``database.table``."""

    database: str = "default"
    calls_folder: str = "calls"
    labelled_calls: str = "labelled_calls"
    call_assessments: str = "call_assessments"
    participant_rows: str = "participant_rows"
    participant_vectors: str = "participant_vectors"
    index_folder: str = "participant_index"
    checkpoint_folder: str = "participant_vectors_checkpoint"

    def table(self, name: str) -> str:
        return f"{self.database}.{getattr(self, name)}"


def use_database(spark: SparkSession, names: Names) -> str:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{names.database}`")
    spark.catalog.setCurrentDatabase(names.database)
    return spark.catalog.currentDatabase()


def reset_tables(spark: SparkSession, names: Names) -> None:
    """Drop the result tables so that the next run starts empty."""
    for field in ("labelled_calls", "call_assessments", "participant_rows", "participant_vectors"):
        spark.sql(f"DROP TABLE IF EXISTS {names.table(field)}")


def build_session(app: str = "turnwise", cores: str = "*", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves a session in local mode, whose executors are on this
    machine; on a cluster they could not read it, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or _own_folder(spark.sparkContext.applicationId)).rstrip("/")


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"turnwise-{application}-")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder name below the shared folder, in a part of this application's own."""
    return f"{_work_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def _work_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/turnwise/{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Remove all work folders of this application. Results that still read them can't be used after that."""
    remove_folder(spark, _work_root(spark))


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@cache
def _shipped(application: str) -> str:
    """A zip of this package for the Python workers of one application."""
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix=f"turnwise-{application}-"), "turnwise_package")
    parent, name = os.path.split(package)
    path = shutil.make_archive(target, "zip", parent, name)
    SparkContext.getOrCreate().addPyFile(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run. Once per application."""
    _shipped(spark.sparkContext.applicationId)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def is_folder(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(jvm_path) and files.getFileStatus(jvm_path).isDirectory()

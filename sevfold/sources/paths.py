"""The shared folder for what a job has to set down between its steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``.

    Where none is set, a job on one machine gets a temporary folder; on a cluster that is an
    error, since executors would each write to their own disk.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sevfold-")
        spark.conf.set(SETTING, folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/sevfold/{name}-{uuid.uuid4().hex}"

"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def working_folder(spark: SparkSession, label: str) -> str:
    """A new folder path in the shared folder that the cluster names in spark.checkpoint.dir.

    Where that setting is absent and the session is local (tests, a laptop), a temporary folder is made and
    set. Elsewhere its absence is an error, since executors and driver see no folder of each other.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tillscope-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

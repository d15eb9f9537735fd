"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def build_session(app_name: str = "factstore", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Sizes that depend on the cluster (shuffle partitions, memory) are left to the
    caller; adaptive execution coalesces and splits shuffle partitions at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # As common JSON readers do, the last of two equal keys counts.
        "spark.sql.variant.allowDuplicateKeys": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="factstore-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's checkpoint folder.

    The setting ``spark.checkpoint.dir`` names storage every executor can reach.
    Only where it is unset in a local run is a temporary folder used, which goes with
    the process; on a cluster that folder would not be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

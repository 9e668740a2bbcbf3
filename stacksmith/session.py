"""Spark session and shared-scratch helpers."""

from __future__ import annotations

import os
import shlex
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "stacksmith") -> SparkSession:
    """Build (or reuse) a session with settings every job here relies on.

    On a cluster the launcher's master and conf win; the settings below only
    fill what is unset.  The UI is off: no extra server is started.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    launched = _launcher_conf()
    for k, v in default_conf(master or launched.get("spark.master", "local[*]"), shuffle_partitions).items():
        if k not in launched:
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def _launcher_conf() -> dict[str, str]:
    """``--conf`` pairs that spark-submit or PYSPARK_SUBMIT_ARGS hand over."""
    args = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    pairs = [args[i + 1].split("=", 1) for i, a in enumerate(args[:-1]) if a == "--conf" and "=" in args[i + 1]]
    named = {"--master": "spark.master", "--driver-memory": "spark.driver.memory"}
    pairs += [[named[a], args[i + 1]] for i, a in enumerate(args[:-1]) if a in named]
    if SparkContext._active_spark_context is not None:
        pairs += [list(p) for p in SparkContext._active_spark_context.getConf().getAll()]
    return dict(pairs)


def default_conf(master: str, shuffle_partitions: int | None = None) -> dict[str, str]:
    """Settings for what the launcher left unset.

    Off local only semantic switches are set: host, memory, partition counts
    and split sizes are the cluster's business.
    """
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master.startswith("local") and not master.startswith("local-cluster"):
        conf |= {
            "spark.sql.shuffle.partitions": str(shuffle_partitions or os.cpu_count() or 8),
            "spark.driver.memory": "16g",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
        }
    elif shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return conf


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting is used as is.  Only a local master (tests) may fall
    back to a private folder: elsewhere each executor would write to its own
    disk, so an unset folder is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="stacksmith-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name + '-' if name else ''}{uuid.uuid4().hex[:12]}"

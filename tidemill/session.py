"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is written for; names in `conf` use `_` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Call sites of single column expressions are not needed, and plans hold many of them.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("_", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: By application: the folder of a local session that names none, and all paths handed out.
_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    A temporary folder is used only where none is configured and the session is local (tests).
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidemill-")
    return _OWN[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemill/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what `scratch_path` named in this application so far; how many of these paths there were.

    Call it once results are written: tables that still read stored stages fail afterwards.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def cut_lineage(df):
    """Reliable checkpoint in the shared folder: survives the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)

"""SparkSession construction and the few settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import warnings

from pyspark.sql import SparkSession

# Settings every operator assumes. UTC keeps dates/ISO weeks engine-independent;
# duplicate JSON keys occur in real session logs (last one wins, as in Python).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# no Python call-site capture per DataFrame call (pure driver-side overhead); static, so only a new session takes it
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_spark(master: str | None = None, app: str = "lumenlog", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the required settings applied."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {**REQUIRED_CONF, **START_CONF}
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.ui.showConsoleProgress", "false")
    conf.setdefault("spark.driver.memory", "8g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_required_conf(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    """Runtime SQL settings; safe to call on a session created elsewhere (e.g. the driver's)."""
    for k, v in REQUIRED_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception as e:  # the session keeps its own
            warnings.warn(f"{k} could not be set to {v}, which the operators assume: {e}", stacklevel=2)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    On a cluster this comes from ``spark.checkpoint.dir`` (a shared file system)
    or an earlier ``setCheckpointDir``. Only in local mode (tests), where driver and
    executors are one process, a private temporary folder stands in for it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="lumenlog-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d

"""Session construction and shared storage locations."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Defaults for a session we build ourselves (tests, bench). On a cluster the
# session comes from the platform and these are not applied.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def get_spark(master: str = "local[8]", app: str = "strata", shuffle_partitions: int = 8,
              **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update({k.replace("__", "."): v for k, v in extra.items()})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    functions of its modules can be loaded there from any working folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="strata-package-"), "strata.zip")  # Spark serves it from the driver
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; only when nothing is configured (local
    tests) do we create a folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="strata-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root.

    Used for written intermediate tables (lineage cuts) and round-trip
    outputs; never a machine-local temp folder when a cluster names one.
    """
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/strata/{name}-{uuid.uuid4().hex[:12]}"
    if path.startswith("file:"):
        os.makedirs(path[len("file:"):], exist_ok=True)
    return path


def reliable_checkpoint(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint
    folder (never ``localCheckpoint``): an expensive stage reused by several
    branches is computed once and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def free_shuffles(spark: SparkSession):
    """Shuffle files of queries that end in here are removed at their end. For
    queries that run once, as those that write a table; a setting of the
    session holds if there is one."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    mine = spark.conf.get(key, None) is None
    if mine:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if mine:
            spark.conf.unset(key)


def materialize(df, name: str):
    """Cut lineage with a written Parquet table in the shared checkpoint
    folder and read it back. Unlike ``checkpoint()`` the result is columnar:
    each later branch reads only its columns and pushes its filters into the
    scan."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)

"""Session helpers: a tuned session for local runs and a shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyarrow import fs
from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "docfields",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE, skew-join handling, UTC, Arrow (batches capped at
    64 MB) enabled; UI off."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          # Python stages get Arrow batches bounded by bytes as well as rows:
          # 10,000 long documents in one batch would not fit a worker
          .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
          .config("spark.driver.memory", os.environ.get("DOCFIELDS_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``docfields`` importable in Python workers (executors).

    Python stages reference this package's functions; the package is zipped
    once per application and added with ``addPyFile`` (like ``--py-files``:
    the zip is code, built on the driver and served by Spark to every
    executor; no data goes through that folder), so executors on any host
    (or a driver started from another folder) can import it.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    # Clusters whose images (or --py-files) already carry the package set
    # spark.docfields.shipPackage=false; then nothing is built on the driver.
    if sc.getConf().get("spark.docfields.shipPackage", "true").lower() == "false":
        _SHIPPED.add(app)
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="docfields-pkg-"), "docfields.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local session without one (tests) gets a folder of our own. On a
    cluster a machine-local folder would lose rows, so there a missing setting
    is an error.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        require_local(sc.master)
        base = tempfile.mkdtemp(prefix="docfields-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base.rstrip("/")


def require_local(master: str) -> None:
    """Raise unless driver and executors are one process."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {master})")


def shared_filesystem(uri: str):
    """The file system of a folder in shared storage, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path of the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/docfields-{name}-{uuid.uuid4().hex[:12]}"


def spread(scan, slots: int | None = None):
    """Deal a bare file scan out over all task slots when it has fewer files
    than the cluster has slots (few large row groups under a CPU-heavy stage).

    Only the file list is looked at; nothing is planned or run. At cluster
    scale there are more files than slots: no-op."""
    if scan.isStreaming:
        return scan
    target = slots or scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(target) if len(scan.inputFiles()) < target else scan


def staged(df, name: str):
    """Write ``df`` once to the shared scratch folder and read it back: cuts
    lineage, and later uses see the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

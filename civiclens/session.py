"""Session helpers.

The library never creates its own cluster configuration for production runs: it
reads what the session already has.  ``local_session`` exists for tests, the
bench and the driver smoke check.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "civiclens") -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CIVICLENS_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used as
    is.  Only when it is unset on a local master (tests) a scratch folder is
    created; any other master without it is an error, since a folder of the
    driver's machine is none that executors share.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not is_local(spark.sparkContext.master):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="civiclens-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for materialised tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


# Settings the operators are designed for on a cluster (applied by the job
# submitter, not by the library): AQE re-plans joins from measured sizes,
# splits skewed join partitions and coalesces small shuffle partitions.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
    "spark.sql.files.maxPartitionBytes": str(128 << 20),
    "spark.sql.session.timeZone": "UTC",
    # Arrow batches handed to Python workers (HTML pages can be large): bound
    # the rows per batch so a batch stays small in worker memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


_SHIPPED: set[str] = set()


def _driver_dir(spark: SparkSession) -> str:
    """A driver-side folder for the code archive: the checkpoint folder when it
    is a local path, else a temporary folder (Spark's file server copies the
    archive to executors; nothing else reads it)."""
    ckpt = ensure_checkpoint_dir(spark)
    if "://" not in ckpt or ckpt.startswith("file:"):
        path = os.path.join(ckpt.replace("file://", "").replace("file:", ""), "pyfiles")
        os.makedirs(path, exist_ok=True)
        return path
    return tempfile.mkdtemp(prefix="civiclens-pyfiles-")


def ship_package(spark: SparkSession) -> None:
    """Make ``civiclens`` importable in executor Python workers (mapInPandas,
    applyInPandasWithState): zip the package once per application and add it
    with ``addPyFile``."""
    import zipfile

    import civiclens

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(civiclens.__file__))
    base = os.path.dirname(pkg_dir)
    target = os.path.join(_driver_dir(spark), f"civiclens-{civiclens.__version__}-{app}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Everything here is a default of, or a safe choice for, a cluster as well as local mode.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

BATCH_BYTES = 4 << 20


def local_session(cpus: int | str = "*", app: str = "popweave", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        # recording the Python line of every column expression costs more than building the plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in {**RUNTIME_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a missing
    setting is an error, since a machine-local folder would not survive a lost executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="popweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name under the shared root."""
    return f"{shared_root(spark)}/popweave-{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def even_parts(rows: DataFrame, per_part: int = 50_000) -> int:
    """Partitions for rows that cost much each: as many as the rows ask for, so that tasks do not grow with the input.

    No fewer than other shuffles have. One count, for which Spark reads no columns but those that filters need.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_part))


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers BATCH_BYTES at a time, so that long texts do not pile up on either side; a session's own limit stays."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that they find it from any working directory."""
    context = spark.sparkContext
    if not getattr(context, "_popweave_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        # Spark's own folder on the driver, from where it serves files; it goes with the context
        name = os.path.join(tempfile.mkdtemp(dir=context._temp_dir), "popweave")
        context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))
        context._popweave_shipped = True

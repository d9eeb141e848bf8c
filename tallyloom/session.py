"""Session settings shared by tests, the bench and interactive use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tallyloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session. On a cluster pass no master: spark-submit decides, and so do its sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
            .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        )
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # keyed state of streams lies on disk, not on the heap
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only where none is named (tests)."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tallyloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, for written intermediate tables. It stays until ``clear_scratch``."""
    _SCRATCH.append(os.path.join(ensure_checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}"))
    return _SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Remove the folders that this program got from ``scratch_dir``; results that were not written elsewhere go with them.

    Gives back how many there were. Checkpoints of ``cut_lineage`` are Spark's own; a cluster may set ``spark.cleaner.referenceTracking.cleanCheckpoints`` for them.
    """
    done = 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


#: What Spark takes if nobody says otherwise, and what texts get here
SPARK_BATCH_BYTES, BATCH_BYTES = f"{64 << 20}b", f"{4 << 20}b"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches for Python are cut by bytes, so that long texts do not add up; a value that the user has chosen stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, SPARK_BATCH_BYTES) == SPARK_BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def spread(spark: SparkSession) -> int:
    """How many pieces to cut one global order into."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="tallyloom-ship-"), "tallyloom")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "tallyloom"))
    _SHIPPED.add(app)

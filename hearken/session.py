"""Session settings and the shared folder every job writes intermediate data to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def local_session(cores: str = "8", app: str = "hearken") -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; made up only on a local master."""
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(root)
        return root
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hearken-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/scratch/{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and cut its lineage."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Repartition a file scan that has fewer splits than there are cores.

    For work that costs far more per row than shuffling it does; ``by`` may name a
    key that a later aggregate can reuse. A table of many
    files has enough splits already and passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of a batch between Spark and Python.

    Each side of each task holds a few batches, outside the heap. Jobs read the setting when they run.
    """
    if int(spark.conf.get(BATCH_KEY).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store it names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

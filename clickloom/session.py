"""Session builder and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def build_session(app: str = "clickloom", cores: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.default.parallelism", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="clickloom-")
    return _local_dirs[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the work folder; never used twice."""
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_work(spark: SparkSession) -> None:
    """Delete the tables this application wrote on the way; call it when no result still reads them."""
    context = spark.sparkContext
    for path in _made.pop(context.applicationId, []):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is; one that is missing is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it is missing."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts lineage with a table that outlives executors, and gives Catalyst the true
    file sizes, which neither a cache nor a checkpointed RDD does for join planning.
    """
    path = new_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(path)

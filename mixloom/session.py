"""Session construction and the shared folder used for landed tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_landed: dict[str, list[str]] = {}


def build_session(
    app: str = "mixloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """Session with adaptive execution on and time zone pinned to UTC."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the session's ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder of its own; a
    cluster session without it is refused, as executors do not share ``/tmp``.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            f"set {_CHECKPOINT_KEY} to a folder that all executors share"
        )
    app_id = spark.sparkContext.applicationId
    if app_id not in _local_dirs:
        _local_dirs[app_id] = tempfile.mkdtemp(prefix="mixloom-")
    return _local_dirs[app_id]


def landing_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/mixloom/{label}-{uuid.uuid4().hex}"
    _landed.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def land(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back, so that Spark knows the size."""
    spark = df.sparkSession
    path = landing_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that ``landing_path`` named in this application."""
    paths = _landed.get(spark.sparkContext.applicationId, [])
    if path not in paths:
        raise ValueError("only tables landed by this application can be discarded")
    paths.remove(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target.getFileSystem(conf).delete(target, True)


def discard_all(spark: SparkSession) -> None:
    """Remove every landed table, once no frame that reads one is needed."""
    for path in list(_landed.get(spark.sparkContext.applicationId, [])):
        discard(spark, path)

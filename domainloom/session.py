"""Session defaults and lineage cutting.

``stage`` writes a DataFrame to the shared folder that the session names in
``spark.checkpoint.dir`` and reads it back: executors may be lost at any time,
the written table stays.  The folder is only chosen here when the session has
none, as in local tests.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "domainloom", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` overrides any of them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return b.config(map=settings).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    set_before = getattr(spark.sparkContext, "_domainloom_dir", None)
    if set_before:
        return set_before
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="domainloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext._domainloom_dir = f"file://{path}"
    return spark.sparkContext._domainloom_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{checkpoint_dir(spark)}/domainloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    The plan after it starts at the written files, so a lost executor costs a
    re-read and nothing upstream is computed twice.  The files are removed when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/domainloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._domainloom_path = path
    return out


def dropped(*staged: DataFrame) -> None:
    """Removes the files of ``stage``'s tables that nothing will read any more; other DataFrames are left alone.

    The driver's heap is then collected, upon which Spark also removes the shuffle
    files of plans that nothing refers to any more; without tables that is all.
    """
    for df in staged:
        path = getattr(df, "_domainloom_path", None)
        if path is not None:
            hadoop_path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    SparkSession.active().sparkContext._jvm.System.gc()


def restaged(tables: list[DataFrame]) -> DataFrame:
    """The rows of ``stage``'s tables of one schema as a single scan, so that many small ones take few tasks."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._domainloom_path for t in tables])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

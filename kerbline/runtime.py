"""Session, checkpoint folder and materialised intermediates.

Intermediates are Parquet tables in the folder that ``spark.checkpoint.dir`` names, which all executors share, so that
a lost executor costs a re-read and never an iteration. Nothing here uses a machine-local folder on a cluster.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("kerbline")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one is set only in a local session where the setting is absent."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kerbline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Rows of a file of an intermediate table whose size is known to be bounded.
ROWS_A_FILE = 20_000


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it; lineage ends there.

    ``rows`` is a known bound on the rows: the last stage then has as many tasks as that takes, not one for each shuffle
    partition, because every small file costs its task several calls of the file system. The folder is removed when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{shared_dir(spark)}/kerbline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    back = spark.read.schema(df.schema).parquet(path)
    back.kerbline_path = path
    return back


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage, between large plans: its plans, and the shuffles and broadcasts that Spark drops with them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Delete the table behind a materialised frame that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kerbline_path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

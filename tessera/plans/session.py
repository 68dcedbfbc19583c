"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings every plan here assumes (UTC, AQE, skew handling).

    On a cluster ``master`` and the sizes come from spark-submit; ``conf`` overrides the defaults.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from spark.checkpoint.dir; a local one only where that is unset on a local master."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if "TESSERA_LOCAL_CHECKPOINT" not in os.environ:
        made = os.environ["TESSERA_LOCAL_CHECKPOINT"] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return os.environ["TESSERA_LOCAL_CHECKPOINT"]


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose few splits would leave most cores idle, dealt out to all of them; others as they are.

    For work that costs much more than reading. Few splits hold little data, so the exchange is bounded by
    half as many splits as there are cores, whatever the size of the table.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from there (reliable checkpoint)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from it.

    Unlike a checkpoint it carries the size it really has, so that loops of joins keep honest estimates.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(where)  # the folder goes when the session ends
    return out

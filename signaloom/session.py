"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

WORK_DIR_SETTING = "spark.checkpoint.dir"

#: Settings a job should start with; every one is a plain Spark option.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "signaloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`RECOMMENDED_CONF`; keyword ``spark_x_y`` style keys are passed as given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Fix the runtime settings that results depend on, for a session built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _configured_work_dir(spark: SparkSession) -> str | None:
    return spark.conf.get(WORK_DIR_SETTING, None) or spark.sparkContext.getConf().get(WORK_DIR_SETTING)


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local folder only for a local master."""
    configured = _configured_work_dir(spark)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {WORK_DIR_SETTING} to a folder that all executors can reach")
    local = tempfile.mkdtemp(prefix="signaloom-work-")
    spark.conf.set(WORK_DIR_SETTING, local)
    return local


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{work_dir(spark)}/signaloom/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    One pass over the input (unlike an eager checkpoint of a plan, which runs it twice), columnar on the way
    back, and still there when an executor is lost.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # re-plan at run time: shuffles sized, joins chosen by real sizes, partitions of hot keys split
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # hash instead of sort for a shuffled join whose partitions turned out small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128MB",
    # filter a large fact by the catalogue and by the period's orders before it is shuffled
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1GB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    "spark.sql.optimizer.runtimeFilter.number.threshold": "30",
    # no call-site capture for every column built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: str, app: str, **settings: str) -> SparkSession:
    """A local session with a shuffle partition per core. On a cluster, pass SETTINGS to spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    partitions = {} if cores == "*" else {"spark.sql.shuffle.partitions": cores}
    for key, value in {**SETTINGS, **partitions, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the checkpoints', or the warehouse where there is none."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")

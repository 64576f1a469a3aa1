"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tapewright", **conf: str) -> SparkSession:
    """UTC session time, adaptive execution, Arrow batches of bounded size."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    builder = SparkSession.builder.appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read again, which cuts its lineage.

    The folder is that of ``spark.checkpoint.dir``; where it is unset (tests,
    notebooks), a folder in the warehouse is set for this session.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = context.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir', 'spark-warehouse').rstrip('/')}/_checkpoints"
        context.setCheckpointDir(root)
    return df.checkpoint()

"""Session construction for tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "prismatic", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with UTC time, AQE and as many shuffle partitions as cores."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. A local session without one gets a folder of this machine; a cluster without one can't work."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="prismatic-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame as written to the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()

"""Session defaults for local work; on a cluster the session is the caller's."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("longview")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of ``spark.checkpoint.dir``, so that later steps survive lost executors.

    Without that setting a temporary folder will do where all runs in one process; on a cluster it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="longview-"))
    return df.checkpoint()


def versions(spark: SparkSession) -> DataFrame:
    """(component, version) of what a result rests on."""
    import platform
    from importlib import metadata

    found = [("python", platform.python_version()), ("spark", spark.version), ("java", spark._jvm.System.getProperty("java.version"))]
    for name in ("numpy", "pandas", "pyarrow"):
        found.append((name, metadata.version(name)))
    return spark.createDataFrame(found, "component string, version string")

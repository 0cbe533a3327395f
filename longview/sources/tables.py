"""Readers and writers of tabular and nested health data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.frame import HealthFrame, from_table


def read_csv(spark: SparkSession, path: str, key: str | None = None, sep: str = ",", obs_only: Iterable[str] = (), schema=None) -> HealthFrame:
    """CSV or TSV with a header. Without ``key`` rows are numbered by file position (not stable across edits)."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if key is None:
        key, df = "obs_id", df.withColumn("obs_id", F.monotonically_increasing_id())
    return from_table(df, key, obs_only)


def read_fhir(spark: SparkSession, path: str, resource: str | None = None) -> DataFrame:
    """Resources of FHIR JSON bundles (one JSON document a file), or of bare resources, as rows."""
    raw = spark.read.option("multiLine", True).json(path)
    out = raw.select(F.explode("entry").alias("e")).select("e.resource.*") if "entry" in raw.columns else raw
    return out.where(F.col("resourceType") == resource) if resource else out


def from_pandas(spark: SparkSession, frame, key: str | None = None, obs_only: Iterable[str] = ()) -> HealthFrame:
    frame = frame.reset_index(drop=key is not None) if key is None else frame
    if key is None:
        frame = frame.rename(columns={frame.columns[0]: "obs_id"})
    return from_table(spark.createDataFrame(frame), key or "obs_id", obs_only)


def to_pandas(frame: HealthFrame, layer: str | None = None):
    """At the edge of the API only: the layer must fit the driver."""
    return frame.layer(layer).toPandas()


def write_parquet(frame: HealthFrame, path: str) -> None:
    frame.x.write.mode("overwrite").parquet(f"{path}/x")
    if frame.obs is not None:
        frame.obs.write.mode("overwrite").parquet(f"{path}/obs")
    for name, df in frame.layers.items():
        df.write.mode("overwrite").parquet(f"{path}/layers/{name}")

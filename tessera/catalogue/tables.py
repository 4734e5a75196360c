"""The project's test tables, read as DataFrames with the names the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.codes import code_form, epoch_seconds


def read(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def assignments(spark: SparkSession, at: str) -> DataFrame:
    return read(spark, at, "assignment").select(
        "id", code_form(F.col("sn")).alias("sn"), code_form(F.col("dept_id")).alias("dept_id"),
        epoch_seconds(F.col("valid_from")).alias("starts"), epoch_seconds(F.col("valid_to")).alias("ends"), "loaded_at",
    )


def repairs(spark: SparkSession, at: str) -> DataFrame:
    return read(spark, at, "repair").select(
        "id", "repair_no", code_form(F.col("serial_no")).alias("sn"),
        epoch_seconds(F.col("started_at")).alias("starts"), epoch_seconds(F.col("ended_at")).alias("ends"), "loaded_at",
    )

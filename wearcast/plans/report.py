"""Flagship report used by the driver's smoke check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.plans import training
from wearcast.sources.tables import fixture_telemetry

def maintenance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """impute -> features -> select -> split -> fit both models with the reference settings -> choose -> score the
    hold-out -> prediction table, riskiest first."""
    telemetry = fixture_telemetry(spark, sf_dir).drop("p", "prediction")
    res = training.train(telemetry)
    return res.results.orderBy(F.col("Failure_Probability").desc(), F.col(S.ROW_ID))

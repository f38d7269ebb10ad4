"""Scored-reading reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions import columns as C


def prediction_results(scored: DataFrame, key: str = S.KEY, label: str = S.LABEL, prediction: str = "prediction",
                       prob: str = "p", row_id: str = S.ROW_ID) -> DataFrame:
    """M9: the prediction table, one row per scored reading (row id kept, never positional)."""
    return scored.select(
        F.col(row_id), F.col(key).alias("Machine_ID"),
        C.status_label(label).alias("Actual_Status"), C.status_label(prediction).alias("Predicted_Status"),
        F.col(prob).cast("double").alias("Failure_Probability"), C.risk_level(prob).alias("Risk_Level"),
        (C.status_label(label) == C.status_label(prediction)).alias("Correct_Prediction"))


def high_risk(results: DataFrame, prob: str = "Failure_Probability", threshold: float = S.HIGH_RISK_THRESHOLD,
              row_id: str = S.ROW_ID) -> DataFrame:
    """P8 + O2: readings above the threshold, most likely first (ties by row id)."""
    return results.where(C.above(prob, threshold)).orderBy(F.col(prob).desc(), F.col(row_id))


def top_risk(results: DataFrame, k: int = 15, prob: str = "Failure_Probability",
             threshold: float = S.HIGH_RISK_THRESHOLD, row_id: str = S.ROW_ID, key: str = "Machine_ID") -> DataFrame:
    """O3 + O5 + P13: the ``k`` riskiest readings above the threshold with a percent label;
    one placeholder row ``('None', 0.0)`` when there is none.

    ``orderBy().limit()`` plans as a TakeOrdered: each task keeps ``k`` rows.
    """
    top = results.where(C.above(prob, threshold)).orderBy(F.col(prob).desc(), F.col(row_id)).limit(k)
    top = top.select(F.col(row_id), F.col(key), F.col(prob), C.percent_text(prob).alias("label"),
                     F.lit(False).alias("placeholder"))
    n = results.agg(F.count_if(C.above(prob, threshold)).alias("_n"))
    placeholder = n.where(F.col("_n") == 0).select(
        F.lit(None).cast("long").alias(row_id), F.lit("None").alias(key), F.lit(0.0).alias(prob),
        F.lit("0.0%").alias("label"), F.lit(True).alias("placeholder"))
    return top.unionByName(placeholder)


def risk_summary(results: DataFrame, level: str = "Risk_Level", prob: str = "Failure_Probability",
                 key: str = "Machine_ID") -> DataFrame:
    """Totals by risk band. ``readings`` is the row count (what the dashboards call machines);
    ``machines`` is the distinct machine count."""
    return results.agg(
        F.count(F.lit(1)).alias("readings"), F.count_distinct(key).alias("machines"),
        F.count_if(C.above(prob)).alias("high_risk"),
        F.count_if(F.col(level) == "Medium").alias("medium_risk"),
        F.count_if(F.col(level) == "Low").alias("low_risk"),
        F.count_if(F.col(level).isNull()).alias("unbanded"))


def results_json(results: DataFrame, key: str = "Machine_ID", prob: str = "Failure_Probability",
                 level: str = "Risk_Level", row_id: str = S.ROW_ID) -> DataFrame:
    """One JSON record per reading; a NULL risk is written as ``null`` rather than dropped."""
    rec = F.struct(F.col(key).alias("machine_id"), F.col(prob).cast("double").alias("probability"),
                   F.col(level).alias("risk"))
    return results.select(F.col(row_id), F.to_json(rec, {"ignoreNullFields": "false"}).alias("json"))


def results_totals_json(results: DataFrame) -> DataFrame:
    """S8 totals object as JSON (one row)."""
    s = risk_summary(results)
    return s.select(F.to_json(F.struct(F.col("readings").alias("total"), "high_risk", "medium_risk", "low_risk")).alias("json"))


def alert_flags(scored: DataFrame, prob: str = "probability", prediction: str = "prediction",
                threshold: float = S.HIGH_RISK_THRESHOLD) -> DataFrame:
    """P9 + P10 + P5: alert predicate, alert-zone flag and the live status text."""
    return scored.withColumn("is_alert", C.is_alert(prediction)) \
                 .withColumn("alert_zone", C.above(prob, threshold)) \
                 .withColumn("status", C.live_status_label(prediction))

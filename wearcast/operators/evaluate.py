"""Model evaluation tables (A11-A21). Each is one aggregation or a scan over grouped scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions.columns import safe_div
from wearcast.operators import features as FE
from wearcast.operators.scan import prefix_sums


def crosstab(df: DataFrame, actual: str = "Actual_Status", predicted: str = "Predicted_Status",
             levels: Sequence[str] = ("Normal", "Failure")) -> DataFrame:
    """Actual x predicted counts; a predicted level that never occurs is a 0 column."""
    return df.groupBy(actual).pivot(predicted, list(levels)).agg(F.count(F.lit(1))).na.fill(0, list(levels))


def confusion(df: DataFrame, label: str = S.LABEL, prediction: str = "prediction") -> DataFrame:
    """The 2x2 confusion counts in one row."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 for class 1; 0/0 -> 0.0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return cm.select("*", F.coalesce(F.try_divide(tp + tn, tp + tn + fp + fn), F.lit(0.0)).alias("accuracy"),
                     precision.alias("precision"), recall.alias("recall"),
                     F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def classification_metrics(df: DataFrame, label: str = S.LABEL, prediction: str = "prediction") -> DataFrame:
    return metrics_from_confusion(confusion(df, label, prediction))


def score_groups(df: DataFrame, score: str = "p", label: str = S.LABEL) -> DataFrame:
    """Positives and negatives per distinct score (partial aggregation; a hot score is one row)."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_curve(df: DataFrame, score: str = "p", label: str = S.LABEL, n_blocks: int | None = None) -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score, descending, plus the (0, 0) start.

    Cumulative counts come from a blocked prefix scan over the distinct scores,
    not from one global window. Empty classes give NULL rates.
    """
    groups = score_groups(df, score, label).withColumn("neg_score", -F.col("score"))
    cum = prefix_sums(groups, ["neg_score"], ["pos", "neg"], n_blocks=n_blocks)
    totals = df.agg(F.count_if(F.col(label) == 1).alias("P"), F.count_if(F.col(label) != 1).alias("N"))
    pts = cum.crossJoin(F.broadcast(totals)).select(
        F.col("score").alias("threshold"), safe_div(F.col("cum_neg").cast("double"), F.col("N")).alias("fpr"),
        safe_div(F.col("cum_pos").cast("double"), F.col("P")).alias("tpr"))
    start = totals.select(F.lit(None).cast("double").alias("threshold"),
                          F.when(F.col("N") > 0, F.lit(0.0)).alias("fpr"), F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(df: DataFrame, score: str = "p", label: str = S.LABEL, n_blocks: int | None = None) -> DataFrame:
    """Tie-aware ROC AUC = P(s+ > s-) + P(s+ = s-)/2; NULL when a class is empty."""
    groups = score_groups(df, score, label)
    cum = prefix_sums(groups, ["score"], ["neg"], n_blocks=n_blocks, prefix="below_", inclusive=False)
    return cum.agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") * 0.5)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def score_histogram(df: DataFrame, score: str = "Failure_Probability", bins: int = S.HISTOGRAM_BINS) -> DataFrame:
    """``bins`` equal-width bins between min and max score, zero-filled; all-equal scores -> bin 0."""
    spark = df.sparkSession
    rng = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    binned = df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(rng)).select(
        F.least(F.coalesce(F.floor(F.try_divide((F.col(score) - F.col("lo")) * bins, F.col("hi") - F.col("lo"))),
                           F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(rng)).select(
        "bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("bin_start"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 1) / bins).alias("bin_end"))
    return edges.join(F.broadcast(counts), "bin", "left").select("bin", "bin_start", "bin_end",
                                                                 F.coalesce("n", F.lit(0)).alias("n"))


def class_balance(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """A18 + A19: n_neg / n_pos (NULL without positives) and balanced weights n / (2 n_c)."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 0).alias("n_neg"),
                  F.count_if(F.col(label) == 1).alias("n_pos")).select(
        "n", "n_neg", "n_pos",
        F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")).alias("imbalance_ratio"),
        F.try_divide(F.col("n").cast("double"), F.col("n_neg") * 2.0).alias("weight_neg"),
        F.try_divide(F.col("n").cast("double"), F.col("n_pos") * 2.0).alias("weight_pos"))


def with_class_weights(df: DataFrame, label: str = S.LABEL, name: str = "weight") -> DataFrame:
    """Per-row balanced class weight, joined from the one-row balance table."""
    bal = class_balance(df, label)
    return df.crossJoin(F.broadcast(bal.select("weight_neg", "weight_pos"))).withColumn(
        name, F.when(F.col(label) == 1, F.col("weight_pos")).otherwise(F.col("weight_neg"))).drop("weight_neg", "weight_pos")


def scaler_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population std per feature (std 0 -> 1), long form."""
    wide = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(f"s{i}") for i, c in enumerate(cols)])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("s"))
                                            for i, c in enumerate(cols)])).alias("e"))
    return long.select(F.col("e.feature").alias("feature"), F.col("e.s.mean").alias("mean"),
                       F.when(F.col("e.s.std") == 0, F.lit(1.0)).otherwise(F.col("e.s.std")).alias("scale"))


def scale_columns(df: DataFrame, cols: Sequence[str], fit: DataFrame) -> DataFrame:
    """M6 (column form): (x - mean) / scale, with the fit table broadcast (one row per feature)."""
    wide = fit.groupBy().pivot("feature", list(cols)).agg(F.first(F.struct("mean", "scale")))
    joined = df.crossJoin(F.broadcast(wide.select(*[F.col(f"`{c}`").alias(f"_fit_{c}") for c in cols])))
    return joined.select(*[c for c in df.columns if c not in cols],
                         *[((F.col(c) - F.col(f"_fit_{c}.mean")) / F.col(f"_fit_{c}.scale")).alias(c) for c in cols])


def run_summary(log: DataFrame, key: str = S.KEY, time: str = S.TIME, row_id: str = S.ROW_ID,
                prob: str = "probability", prediction: str = "prediction", history: int = S.LIVE_HISTORY) -> DataFrame:
    """A21 per machine: readings, alerts, alert %, mean and max probability over the last ``history``, duration (s)."""
    counts = log.groupBy(key).agg(F.count(F.lit(1)).alias("readings"),
                                  F.count_if(F.col(prediction) == 1).alias("alerts"),
                                  F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    recent = FE.last_readings(log, history, key, time, row_id).groupBy(key).agg(
        F.avg(prob).alias("mean_probability"), F.max(prob).alias("max_probability"))
    return counts.join(recent, key, "left").select(
        key, "readings", "alerts", F.try_divide(F.col("alerts") * 100.0, F.col("readings")).alias("alert_pct"),
        "mean_probability", "max_probability",
        ((F.unix_micros(F.col("_t1").cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / 1e6).alias("duration_s"))

"""Registered queries over the fixture view, each with a DuckDB oracle.

Every query reads the whole ``events`` table through the fixture view
(``wearcast.sources.tables``), so its work grows with the data. Floating
outputs are rounded to 6 digits on both sides; every result keeps a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearcast import schema as S
from wearcast.operators import features, impute, series
from wearcast.sources.tables import FIXTURE_SQL, fixture_telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c) -> "F.Column":
    """Round to 6 digits the way both engines agree on: round(x * 1e6) / 1e6."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(1e6)) / F.lit(1e6)


def R6(expr: str) -> str:
    return f"(ROUND(({expr}) * 1000000.0) / 1000000.0)"


def with_fixture(body: str) -> str:
    return "WITH " + FIXTURE_SQL + ",\n" + body


SENS = S.SENSORS
SENS_Q = [f'"{c}"' if c == "current" else c for c in SENS]


def _q(c: str) -> str:
    return f'"{c}"' if c in ("current", "timestamp") else c


# ---------------------------------------------------------------- imputation
def imputed_df(spark, sf_dir, block_rows=series.BLOCK_ROWS):
    t = fixture_telemetry(spark, sf_dir)
    return impute.impute(t.drop("p", "prediction"), SENS, block_rows=block_rows)


@register("imputed", with_fixture(
    "ff AS (SELECT reading_id, machine_id, \"timestamp\", failure, "
    + ", ".join(f"last_value({_q(c)} IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY \"timestamp\", reading_id "
                f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {_q(c)}" for c in SENS)
    + " FROM telemetry),\n"
    "bf AS (SELECT reading_id, machine_id, \"timestamp\", failure, "
    + ", ".join(f"first_value({_q(c)} IGNORE NULLS) OVER (ORDER BY machine_id, \"timestamp\", reading_id "
                f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {_q(c)}" for c in SENS)
    + " FROM ff)\n"
    "SELECT reading_id, machine_id, \"timestamp\", failure, "
    + ", ".join(f"{R6(f'COALESCE({_q(c)}, (SELECT median({_q(c)}) FROM bf))')} AS {_q(c)}" for c in SENS)
    + " FROM bf"))
def q_imputed(spark, sf_dir):
    df = imputed_df(spark, sf_dir)
    return df.select(S.ROW_ID, S.KEY, S.TIME, S.LABEL, *[r6(c).alias(c) for c in SENS])


# ---------------------------------------------------------------- features
_ROLL_SQL_W = "OVER (PARTITION BY machine_id ORDER BY \"timestamp\", reading_id ROWS BETWEEN {a} PRECEDING AND {b})"


@register("rolling_features", with_fixture(
    "SELECT reading_id, machine_id, "
    + ", ".join(f"{R6(f'avg({_q(c)}) ' + _ROLL_SQL_W.format(a=4, b='CURRENT ROW'))} AS {c}_rolling_avg"
                for c in S.ROLLING_MEAN_INPUTS) + ", "
    + ", ".join(f"{R6(f'COALESCE(stddev_samp({_q(c)}) ' + _ROLL_SQL_W.format(a=4, b='CURRENT ROW') + ', 0.0)')} AS {c}_rolling_std"
                for c in S.ROLLING_STD_INPUTS) + ", "
    + f"{R6('power_consumption / (torque + 1.0)')} AS power_efficiency, "
    + f"{R6('temperature * vibration')} AS temp_vib_interaction FROM telemetry"))
def q_rolling_features(spark, sf_dir):
    t = fixture_telemetry(spark, sf_dir)
    out = features.rolling_features(t)
    return out.select(S.ROW_ID, S.KEY, *[r6(c).alias(c) for c in S.ROLLING_FEATURES + S.STAT_FEATURES])


def _serving_sql():
    prev = _ROLL_SQL_W.format(a=5, b="1 PRECEDING")
    parts = []
    for c in S.ROLLING_MEAN_INPUTS:
        parts.append(f"{R6(f'CASE WHEN count({_q(c)}) {prev} >= 5 THEN avg({_q(c)}) {prev} ELSE {_q(c)} END')} AS {c}_rolling_avg")
    for c in S.ROLLING_STD_INPUTS:
        parts.append(f"{R6(f'CASE WHEN count({_q(c)}) {prev} >= 5 THEN stddev_pop({_q(c)}) {prev} ELSE 0.0 END')} AS {c}_rolling_std")
    return with_fixture("SELECT reading_id, machine_id, " + ", ".join(parts)
                        + f", {R6('power_consumption / (torque + 1.0)')} AS power_efficiency, "
                        + f"{R6('temperature * vibration')} AS temp_vib_interaction FROM telemetry")


@register("serving_features", _serving_sql())
def q_serving_features(spark, sf_dir):
    t = fixture_telemetry(spark, sf_dir)
    out = features.serving_features(t)
    return out.select(S.ROW_ID, S.KEY, *[r6(c).alias(c) for c in S.ROLLING_FEATURES + S.STAT_FEATURES])


# ---------------------------------------------------------------- profile
from wearcast.operators import evaluate as EV  # noqa: E402
from wearcast.operators import health as HL  # noqa: E402
from wearcast.operators import profile as PR  # noqa: E402
from wearcast.operators import rules as RU  # noqa: E402
from wearcast.operators import scoring as SC  # noqa: E402
from wearcast.operators import selection as SEL  # noqa: E402
from wearcast.functions import columns as C  # noqa: E402

RAW_COLS = [S.ROW_ID, S.KEY, S.TIME] + SENS + [S.LABEL]


def raw(spark, sf_dir):
    return fixture_telemetry(spark, sf_dir).select(*RAW_COLS)


@register("dataset_profile", with_fixture(
    "SELECT count(*) AS readings, 14 AS columns, count(DISTINCT machine_id) AS machines, "
    "CAST(sum(failure) AS BIGINT) AS failures, " + R6("avg(failure) * 100.0") + " AS failure_pct, "
    "count(*) FILTER (WHERE failure = 0) AS normals, "
    + R6("avg(CASE WHEN failure = 0 THEN 1.0 ELSE 0.0 END) * 100.0") + " AS normal_pct, "
    "min(\"timestamp\") AS first_time, max(\"timestamp\") AS last_time, "
    "(" + " + ".join(f"count(*) FILTER (WHERE {_q(c)} IS NULL)" for c in RAW_COLS) + ") AS null_cells "
    "FROM telemetry"))
def q_dataset_profile(spark, sf_dir):
    out = PR.dataset_profile(raw(spark, sf_dir))
    return out.select("readings", "columns", "machines", "failures", r6("failure_pct").alias("failure_pct"),
                      "normals", r6("normal_pct").alias("normal_pct"), "first_time", "last_time", "null_cells")


@register("null_counts", with_fixture(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {_q(c)} IS NULL) AS nulls FROM telemetry"
                       for c in RAW_COLS)))
def q_null_counts(spark, sf_dir):
    return PR.null_counts(raw(spark, sf_dir))


_REQUIRED = S.REQUIRED_COLUMNS + ["reading_id", "torque", "humidity"]


@register("required_columns", with_fixture(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c != 'humidity'} AS present, {c in SENS} AS is_feature, "
                       f"{'CAST(0 AS BIGINT)' if c == 'humidity' else f'count({_q(c)})'} AS non_null FROM telemetry" for c in _REQUIRED)
    .replace("CAST(0 AS BIGINT) AS non_null FROM telemetry", "CAST(0 AS BIGINT) AS non_null")))
def q_required_columns(spark, sf_dir):
    """A4 + P2: which required columns are there, which are features, and how many values they hold."""
    return PR.required_columns(raw(spark, sf_dir), _REQUIRED)


_QSQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({_q(c)}) AS count, {R6(f'avg({_q(c)})')} AS mean, {R6(f'stddev_samp({_q(c)})')} AS std, "
    f"{R6(f'min({_q(c)})')} AS min, {R6(f'quantile_cont({_q(c)}, 0.25)')} AS q25, {R6(f'quantile_cont({_q(c)}, 0.5)')} AS q50, "
    f"{R6(f'quantile_cont({_q(c)}, 0.75)')} AS q75, {R6(f'max({_q(c)})')} AS max FROM telemetry" for c in SENS)


@register("summary_stats", with_fixture(_QSQL))
def q_summary_stats(spark, sf_dir):
    out = PR.summary_stats(raw(spark, sf_dir), SENS)
    return out.select("feature", "count", *[r6(c).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


def _status_sql(c):
    return f"CASE WHEN {c} = 1 THEN 'Failure' ELSE 'Normal' END"


_RISK_SQL = ("CASE WHEN p > 0.0 AND p <= 0.3 THEN 'Low' WHEN p > 0.3 AND p <= 0.7 THEN 'Medium' "
             "WHEN p > 0.7 AND p <= 1.0 THEN 'High' END")

_RESULTS_SQL = ("results AS (SELECT reading_id, machine_id AS Machine_ID, " + _status_sql("failure") + " AS Actual_Status, "
                + _status_sql("prediction") + " AS Predicted_Status, p AS Failure_Probability, " + _RISK_SQL + " AS Risk_Level, "
                + "(" + _status_sql("failure") + ") = (" + _status_sql("prediction") + ") AS Correct_Prediction FROM telemetry)")


def results_df(spark, sf_dir):
    return SC.prediction_results(fixture_telemetry(spark, sf_dir))


@register("value_counts", with_fixture(
    _RESULTS_SQL + ", vc AS ("
    "SELECT 'failure' AS attribute, CAST(failure AS VARCHAR) AS value, count(*) AS n FROM telemetry GROUP BY 2 "
    "UNION ALL SELECT 'Predicted_Status', Predicted_Status, count(*) FROM results GROUP BY 2 "
    "UNION ALL SELECT 'Risk_Level', Risk_Level, count(*) FROM results WHERE Risk_Level IS NOT NULL GROUP BY 2) "
    "SELECT attribute, value, n, " + R6("n * 100.0 / sum(n) OVER (PARTITION BY attribute)") + " AS pct FROM vc"))
def q_value_counts(spark, sf_dir):
    """A7 + A8 for three attributes in one pass."""
    res = results_df(spark, sf_dir).withColumn("failure", F.when(F.col("Actual_Status") == "Failure", "1").otherwise("0"))
    out = PR.value_counts(res, ["failure", "Predicted_Status", "Risk_Level"])
    return out.select("attribute", "value", "n", r6("pct").alias("pct"))


_CORR_COLS = SENS + [S.LABEL]


def _corr_sql(a, b):
    qa, qb = _q(a), _q(b)
    both = f"{qa} IS NOT NULL AND {qb} IS NOT NULL"
    return (f"covar_pop({qa}, {qb}) FILTER (WHERE {both}) / NULLIF(stddev_pop({qa}) FILTER (WHERE {both}) * "
            f"stddev_pop({qb}) FILTER (WHERE {both}), 0)")


def _corr_matrix_sql():
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for j, b in enumerate(_CORR_COLS):
            if i == j:
                e = f"CASE WHEN stddev_pop({_q(a)}) > 0 THEN 1.0 END"
            else:
                e = _corr_sql(a, b)
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {R6(e)} AS corr FROM telemetry")
    return with_fixture(" UNION ALL ".join(parts))


@register("correlation_matrix", _corr_matrix_sql())
def q_correlation_matrix(spark, sf_dir):
    out = PR.correlation_matrix(raw(spark, sf_dir), _CORR_COLS)
    return out.select("feature_a", "feature_b", r6("corr").alias("corr"))


@register("target_correlation", with_fixture(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R6(_corr_sql(c, 'failure'))} AS corr FROM telemetry" for c in SENS)))
def q_target_correlation(spark, sf_dir):
    out = PR.target_correlation(raw(spark, sf_dir), SENS)
    return out.select("feature", r6("corr").alias("corr"))


# ---------------------------------------------------------------- evaluation
@register("crosstab", with_fixture(
    _RESULTS_SQL + " SELECT Actual_Status, count(*) FILTER (WHERE Predicted_Status = 'Normal') AS Normal, "
    "count(*) FILTER (WHERE Predicted_Status = 'Failure') AS Failure FROM results GROUP BY Actual_Status"))
def q_crosstab(spark, sf_dir):
    return EV.crosstab(results_df(spark, sf_dir))


_CM_SQL = ("count(*) FILTER (WHERE failure = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE failure = 0 AND prediction = 1) AS fp, "
           "count(*) FILTER (WHERE failure = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE failure = 1 AND prediction = 1) AS tp")


@register("confusion", with_fixture("SELECT " + _CM_SQL + " FROM telemetry"))
def q_confusion(spark, sf_dir):
    return EV.confusion(fixture_telemetry(spark, sf_dir))


@register("classification_metrics", with_fixture(
    "cm AS (SELECT " + _CM_SQL + " FROM telemetry) SELECT tn, fp, fn, tp, "
    + R6("COALESCE((tp + tn) * 1.0 / NULLIF(tp + tn + fp + fn, 0), 0.0)") + " AS accuracy, "
    + R6("COALESCE(tp * 1.0 / NULLIF(tp + fp, 0), 0.0)") + " AS precision, "
    + R6("COALESCE(tp * 1.0 / NULLIF(tp + fn, 0), 0.0)") + " AS recall, "
    + R6("COALESCE(2.0 * tp / NULLIF(2.0 * tp + fp + fn, 0), 0.0)") + " AS f1 FROM cm"))
def q_classification_metrics(spark, sf_dir):
    m = EV.classification_metrics(fixture_telemetry(spark, sf_dir))
    return m.select("tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in ["accuracy", "precision", "recall", "f1"]])


_GROUPS_SQL = ("g AS (SELECT p AS score, count(*) FILTER (WHERE failure = 1) AS pos, count(*) FILTER (WHERE failure <> 1) AS neg "
               "FROM telemetry GROUP BY p), "
               "tot AS (SELECT count(*) FILTER (WHERE failure = 1) AS P, count(*) FILTER (WHERE failure <> 1) AS N FROM telemetry)")


@register("roc_auc", with_fixture(
    _GROUPS_SQL + ", c AS (SELECT score, pos, neg, COALESCE(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) "
    "SELECT " + R6("sum(pos * (below + neg * 0.5)) / NULLIF(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0)") + " AS auc FROM c"))
def q_roc_auc(spark, sf_dir):
    return EV.roc_auc(fixture_telemetry(spark, sf_dir)).select(r6("auc").alias("auc"))


@register("roc_curve", with_fixture(
    _GROUPS_SQL + ", c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp, "
    "sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM g) "
    "SELECT NULL::DOUBLE AS threshold, CASE WHEN N > 0 THEN 0.0 END AS fpr, CASE WHEN P > 0 THEN 0.0 END AS tpr FROM tot "
    "UNION ALL SELECT " + R6("score") + ", " + R6("cn * 1.0 / NULLIF(N, 0)") + ", " + R6("cp * 1.0 / NULLIF(P, 0)") + " FROM c, tot"))
def q_roc_curve(spark, sf_dir):
    out = EV.roc_curve(fixture_telemetry(spark, sf_dir))
    return out.select(r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@register("score_histogram", with_fixture(
    "rng AS (SELECT min(p) AS lo, max(p) AS hi FROM telemetry), "
    "b AS (SELECT LEAST(COALESCE(CAST(floor((p - lo) * 30 / NULLIF(hi - lo, 0)) AS INTEGER), 0), 29) AS bin FROM telemetry, rng WHERE p IS NOT NULL), "
    "cnt AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) "
    "SELECT CAST(r.i AS INTEGER) AS bin, " + R6("lo + (hi - lo) * r.i / 30") + " AS bin_start, " + R6("lo + (hi - lo) * (r.i + 1) / 30")
    + " AS bin_end, COALESCE(n, 0) AS n FROM range(30) r(i) CROSS JOIN rng LEFT JOIN cnt ON cnt.bin = r.i"))
def q_score_histogram(spark, sf_dir):
    out = EV.score_histogram(fixture_telemetry(spark, sf_dir), "p")
    return out.select("bin", r6("bin_start").alias("bin_start"), r6("bin_end").alias("bin_end"), "n")


@register("class_weights", with_fixture(
    "c AS (SELECT count(*) AS n, count(*) FILTER (WHERE failure = 0) AS n_neg, count(*) FILTER (WHERE failure = 1) AS n_pos FROM telemetry) "
    "SELECT n, n_neg, n_pos, " + R6("n_neg * 1.0 / NULLIF(n_pos, 0)") + " AS imbalance_ratio, "
    + R6("n * 1.0 / NULLIF(n_neg * 2.0, 0)") + " AS weight_neg, " + R6("n * 1.0 / NULLIF(n_pos * 2.0, 0)") + " AS weight_pos FROM c"))
def q_class_weights(spark, sf_dir):
    b = EV.class_balance(fixture_telemetry(spark, sf_dir))
    return b.select("n", "n_neg", "n_pos", *[r6(c).alias(c) for c in ["imbalance_ratio", "weight_neg", "weight_pos"]])


@register("scaler_fit", with_fixture(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R6(f'avg({_q(c)})')} AS mean, {R6(f'CASE WHEN stddev_pop({_q(c)}) = 0 THEN 1.0 ELSE stddev_pop({_q(c)}) END')} AS scale FROM telemetry"
    for c in SENS)))
def q_scaler_fit(spark, sf_dir):
    fit = EV.scaler_fit(raw(spark, sf_dir), SENS)
    return fit.select("feature", r6("mean").alias("mean"), r6("scale").alias("scale"))


@register("scaled_features", with_fixture(
    "st AS (SELECT " + ", ".join(f"avg({_q(c)}) AS m_{c}, CASE WHEN stddev_pop({_q(c)}) = 0 THEN 1.0 ELSE stddev_pop({_q(c)}) END AS s_{c}" for c in SENS)
    + " FROM telemetry) SELECT reading_id, " + ", ".join(f"{R6(f'({_q(c)} - m_{c}) / s_{c}')} AS {_q(c)}" for c in SENS)
    + " FROM telemetry, st"))
def q_scaled_features(spark, sf_dir):
    t = raw(spark, sf_dir)
    out = EV.scale_columns(t.select(S.ROW_ID, *SENS), SENS, EV.scaler_fit(t, SENS))
    return out.select(S.ROW_ID, *[r6(c).alias(c) for c in SENS])


# ---------------------------------------------------------------- scoring reports
@register("prediction_results", with_fixture(
    _RESULTS_SQL + " SELECT reading_id, Machine_ID, Actual_Status, Predicted_Status, " + R6("Failure_Probability")
    + " AS Failure_Probability, Risk_Level, Correct_Prediction FROM results"))
def q_prediction_results(spark, sf_dir):
    return results_df(spark, sf_dir).withColumn("Failure_Probability", r6("Failure_Probability"))


@register("risk_summary", with_fixture(
    _RESULTS_SQL + " SELECT count(*) AS readings, count(DISTINCT Machine_ID) AS machines, "
    "count(*) FILTER (WHERE Failure_Probability > 0.7) AS high_risk, count(*) FILTER (WHERE Risk_Level = 'Medium') AS medium_risk, "
    "count(*) FILTER (WHERE Risk_Level = 'Low') AS low_risk, count(*) FILTER (WHERE Risk_Level IS NULL) AS unbanded FROM results"))
def q_risk_summary(spark, sf_dir):
    return SC.risk_summary(results_df(spark, sf_dir))


@register("high_risk", with_fixture(
    _RESULTS_SQL + " SELECT reading_id, Machine_ID, Actual_Status, Predicted_Status, " + R6("Failure_Probability")
    + " AS Failure_Probability, Risk_Level, Correct_Prediction FROM results WHERE Failure_Probability > 0.7"))
def q_high_risk(spark, sf_dir):
    return SC.high_risk(results_df(spark, sf_dir)).withColumn("Failure_Probability", r6("Failure_Probability"))


@register("top_risk", with_fixture(
    _RESULTS_SQL + ", top AS (SELECT reading_id, Machine_ID, Failure_Probability FROM results WHERE Failure_Probability > 0.7 "
    "ORDER BY Failure_Probability DESC, reading_id LIMIT 15) "
    "SELECT reading_id, Machine_ID, " + R6("Failure_Probability") + " AS Failure_Probability, "
    "format('{:.1f}%', round_even(Failure_Probability * 100.0, 1)) AS label, false AS placeholder FROM top "
    "UNION ALL SELECT NULL::BIGINT, 'None', 0.0, '0.0%', true FROM (SELECT count(*) AS n FROM top) WHERE n = 0"))
def q_top_risk(spark, sf_dir):
    return SC.top_risk(results_df(spark, sf_dir)).withColumn("Failure_Probability", r6("Failure_Probability"))


@register("results_json", with_fixture(
    _RESULTS_SQL + " SELECT reading_id, Machine_ID AS machine_id, " + R6("Failure_Probability") + " AS probability, "
    "Risk_Level AS risk, true AS has_risk_key FROM results"))
def q_results_json(spark, sf_dir):
    js = SC.results_json(results_df(spark, sf_dir))
    parsed = js.select(S.ROW_ID, F.from_json("json", "machine_id string, probability double, risk string").alias("r"),
                       F.col("json").contains('"risk":').alias("has_risk_key"))
    return parsed.select(S.ROW_ID, "r.machine_id", r6("r.probability").alias("probability"), "r.risk", "has_risk_key")


# ---------------------------------------------------------------- sequences and history
_W_M = "PARTITION BY machine_id ORDER BY \"timestamp\", reading_id"


@register("last_n", with_fixture(
    "r AS (SELECT reading_id, machine_id, row_number() OVER (PARTITION BY machine_id ORDER BY \"timestamp\" DESC, reading_id DESC) AS recency "
    "FROM telemetry) SELECT reading_id, machine_id, recency FROM r WHERE recency <= 30"))
def q_last_n(spark, sf_dir):
    out = features.last_readings(raw(spark, sf_dir), S.BROWSER_HISTORY)
    return out.select(S.ROW_ID, S.KEY, F.col("recency").cast("long").alias("recency"))


@register("sequence", with_fixture(
    f"s AS (SELECT reading_id, machine_id, row_number() OVER ({_W_M}) AS seq FROM telemetry) "
    "SELECT reading_id, machine_id, seq, LEAST(seq - 1, 100) AS history_len FROM s"))
def q_sequence(spark, sf_dir):
    out = features.sequence(raw(spark, sf_dir))
    return out.select(S.ROW_ID, S.KEY, "seq", "history_len")


@register("run_progress", with_fixture(
    f"s AS (SELECT reading_id, machine_id, row_number() OVER ({_W_M}) AS seq, count(*) OVER (PARTITION BY machine_id) AS n FROM telemetry) "
    "SELECT reading_id, machine_id, seq, " + R6("(seq - 1) * 1.0 / n") + " AS progress FROM s"))
def q_run_progress(spark, sf_dir):
    out = features.run_progress(raw(spark, sf_dir))
    return out.select(S.ROW_ID, S.KEY, "seq", r6("progress").alias("progress"))


@register("imminent_label", with_fixture(
    f"s AS (SELECT reading_id, machine_id, (row_number() OVER ({_W_M}) - 1) * 1.0 / count(*) OVER (PARTITION BY machine_id) AS progress, "
    "max(failure) OVER (PARTITION BY machine_id) AS fails FROM telemetry) "
    "SELECT reading_id, machine_id, " + R6("progress") + " AS progress, CASE WHEN fails = 1 AND progress > 0.95 THEN 1 ELSE 0 END AS imminent FROM s"))
def q_imminent_label(spark, sf_dir):
    out = features.imminent_label(raw(spark, sf_dir))
    return out.select(S.ROW_ID, S.KEY, r6("progress").alias("progress"), "imminent")


@register("run_summary", with_fixture(
    "r AS (SELECT machine_id, p, row_number() OVER (PARTITION BY machine_id ORDER BY \"timestamp\" DESC, reading_id DESC) AS recency FROM telemetry), "
    "recent AS (SELECT machine_id, avg(p) AS mean_probability, max(p) AS max_probability FROM r WHERE recency <= 100 GROUP BY machine_id), "
    "c AS (SELECT machine_id, count(*) AS readings, count(*) FILTER (WHERE prediction = 1) AS alerts, "
    "(epoch_us(max(\"timestamp\")) - epoch_us(min(\"timestamp\"))) / 1000000.0 AS duration_s FROM telemetry GROUP BY machine_id) "
    "SELECT c.machine_id, readings, alerts, " + R6("alerts * 100.0 / NULLIF(readings, 0)") + " AS alert_pct, "
    + R6("mean_probability") + " AS mean_probability, " + R6("max_probability") + " AS max_probability, "
    + R6("duration_s") + " AS duration_s FROM c LEFT JOIN recent USING (machine_id)"))
def q_run_summary(spark, sf_dir):
    log = fixture_telemetry(spark, sf_dir).withColumnRenamed("p", "probability")
    out = EV.run_summary(log)
    return out.select(S.KEY, "readings", "alerts", *[r6(c).alias(c) for c in
                                                     ["alert_pct", "mean_probability", "max_probability", "duration_s"]])


@register("alert_zone", with_fixture(
    "SELECT reading_id, machine_id, prediction = 1 AS is_alert, p > 0.7 AS alert_zone, "
    "CASE WHEN prediction = 1 THEN 'FAILURE' ELSE 'NORMAL' END AS status, strftime(\"timestamp\", '%H:%M:%S') AS clock, "
    "CASE WHEN epoch_us(\"timestamp\") % 1000000 = 0 THEN strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%f') END AS iso_time, CAST(prediction AS INTEGER) AS prediction, "
    + R6("CAST(p AS DOUBLE)") + " AS probability FROM telemetry"))
def q_alert_zone(spark, sf_dir):
    t = fixture_telemetry(spark, sf_dir).withColumnRenamed("p", "probability")
    out = SC.alert_flags(t)
    return out.select(S.ROW_ID, S.KEY, "is_alert", "alert_zone", "status", C.clock_time(S.TIME).alias("clock"),
                      C.iso_time(S.TIME).alias("iso_time"), F.col("prediction").cast("int").alias("prediction"),
                      r6(F.col("probability").cast("double")).alias("probability"))


@register("elapsed", with_fixture(
    "r AS (SELECT reading_id, machine_id, \"timestamp\", row_number() OVER (PARTITION BY machine_id ORDER BY \"timestamp\" DESC, reading_id DESC) AS recency FROM telemetry "
    "), k AS (SELECT * FROM r WHERE recency <= 100) "
    "SELECT reading_id, machine_id, " + R6("(epoch_us(\"timestamp\") - min(epoch_us(\"timestamp\")) OVER (PARTITION BY machine_id)) / 1000000.0")
    + " AS elapsed_s FROM k"))
def q_elapsed(spark, sf_dir):
    kept = features.last_readings(raw(spark, sf_dir), S.LIVE_HISTORY)
    kept = kept.withColumn("_t0", F.min(S.TIME).over(Window.partitionBy(S.KEY)))  # at most 100 rows a machine
    return kept.select(S.ROW_ID, S.KEY, r6(C.elapsed_seconds(S.TIME, "_t0")).alias("elapsed_s"))


# ---------------------------------------------------------------- feature selection
def _feature_sql_cte():
    w4 = _ROLL_SQL_W.format(a=4, b="CURRENT ROW")
    return ("feat AS (SELECT *, " + ", ".join(f"avg({_q(c)}) {w4} AS {c}_rolling_avg" for c in S.ROLLING_MEAN_INPUTS) + ", "
            + ", ".join(f"COALESCE(stddev_samp({_q(c)}) {w4}, 0.0) AS {c}_rolling_std" for c in S.ROLLING_STD_INPUTS)
            + ", power_consumption / (torque + 1.0) AS power_efficiency, temperature * vibration AS temp_vib_interaction FROM telemetry)")


def _feature_cut_sql():
    corr = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs({_corr_sql(c, 'failure')}) AS a FROM feat" for c in S.ALL_FEATURES)
    return with_fixture(
        _feature_sql_cte() + ", imp0 AS (" + corr + "), "
        "imp AS (SELECT feature, COALESCE(a, 0.0) / sum(COALESCE(a, 0.0)) OVER () AS importance FROM imp0), "
        "rk AS (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank, "
        "sum(importance) OVER (ORDER BY importance DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM imp), "
        "u AS (SELECT count(*) FILTER (WHERE cum <= 0.95) AS under FROM rk) "
        "SELECT feature, " + R6("importance") + " AS importance, rank, " + R6("cum") + " AS cumulative_importance, "
        "CASE WHEN under < 10 THEN rank <= 10 ELSE cum <= 0.95 END AS selected FROM rk, u")


def correlation_importance(df: DataFrame, feats=S.ALL_FEATURES, label: str = S.LABEL) -> DataFrame:
    """Importance stand-in derived from the data: |corr(feature, label)| normalised to sum 1."""
    tc = PR.target_correlation(df, feats, label).withColumn("a", F.coalesce(F.abs("corr"), F.lit(0.0)))
    total = tc.agg(F.sum("a").alias("_t"))
    return tc.crossJoin(F.broadcast(total)).select("feature", F.try_divide(F.col("a"), F.col("_t")).alias("importance"))


@register("feature_cut", _feature_cut_sql())
def q_feature_cut(spark, sf_dir):
    feats = features.rolling_features(raw(spark, sf_dir))
    cut = SEL.cumulative_cut(correlation_importance(feats))
    return cut.select("feature", r6("importance").alias("importance"), F.col("rank").cast("long").alias("rank"),
                      r6("cumulative_importance").alias("cumulative_importance"), "selected")


# ---------------------------------------------------------------- health, clamps, rules
@register("health_index", with_fixture(
    f"s AS (SELECT reading_id, machine_id, prediction, row_number() OVER ({_W_M}) AS seq FROM telemetry), "
    "l AS (SELECT *, min(seq) FILTER (WHERE prediction = 1) OVER (PARTITION BY machine_id) AS latch FROM s) "
    "SELECT reading_id, machine_id, seq, " + R6("CASE WHEN latch IS NULL OR seq < latch THEN 0.0 ELSE LEAST(1.0, (seq - latch + 1) * 0.05) END")
    + " AS degradation FROM l"))
def q_health_index(spark, sf_dir):
    t = fixture_telemetry(spark, sf_dir).select(S.ROW_ID, S.KEY, S.TIME, "prediction")
    out = HL.health_index(t)
    return out.select(S.ROW_ID, S.KEY, "seq", r6("degradation").alias("degradation"))


@register("clamped", with_fixture(
    "SELECT reading_id, CASE WHEN vibration IS NULL THEN NULL ELSE GREATEST(vibration, 0.0) END AS vibration, "
    "CASE WHEN temperature IS NULL THEN NULL ELSE LEAST(GREATEST(temperature, 50.0), 120.0) END AS temperature, "
    "CASE WHEN pressure IS NULL THEN NULL ELSE GREATEST(pressure, 0.0) END AS pressure FROM telemetry"))
def q_clamped(spark, sf_dir):
    out = RU.clamped(raw(spark, sf_dir))
    return out.select(S.ROW_ID, "vibration", "temperature", "pressure")


@register("range_violations", with_fixture(" UNION ALL ".join(
    f"SELECT reading_id, machine_id, '{c}' AS sensor, {_q(c)} AS value, CASE WHEN {_q(c)} < {lo} THEN 'below' ELSE 'above' END AS side "
    f"FROM telemetry WHERE {_q(c)} < {lo} OR {_q(c)} > {hi}" for c, (lo, hi) in S.NORMAL_RANGES.items())))
def q_range_violations(spark, sf_dir):
    return RU.range_violations(raw(spark, sf_dir))


@register("critical_alerts", with_fixture(
    "a AS (SELECT reading_id, machine_id, concat_ws(',', CASE WHEN vibration > 8.0 THEN 'vibration' END, "
    "CASE WHEN temperature > 90.0 THEN 'temperature' END, CASE WHEN pressure < 4.0 THEN 'pressure_low' END, "
    "CASE WHEN pressure > 6.0 THEN 'pressure_high' END, CASE WHEN p > 0.7 THEN 'failure_probability' END) AS reasons FROM telemetry) "
    "SELECT reading_id, machine_id, reasons, CAST(len(string_split(reasons, ',')) AS INTEGER) AS n_reasons FROM a WHERE reasons <> ''"))
def q_critical_alerts(spark, sf_dir):
    out = RU.critical_alerts(fixture_telemetry(spark, sf_dir))
    return out.select(S.ROW_ID, S.KEY, F.array_join("reasons", ",").alias("reasons"), "n_reasons")


# ---------------------------------------------------------------- projections and report variants
@register("feature_projection", with_fixture(
    "SELECT reading_id, " + ", ".join(_q(c) for c in ["vibration", "temperature", "pressure", "torque", "power_consumption"])
    + ", CAST(0.0 AS DOUBLE) AS humidity FROM telemetry"))
def q_feature_projection(spark, sf_dir):
    """The model's ordered feature list; a feature the readings lack is 0.0."""
    return SEL.project_features(raw(spark, sf_dir), ["vibration", "temperature", "pressure", "torque",
                                                     "power_consumption", "humidity"], keep=[S.ROW_ID])


def R2(expr: str) -> str:
    return f"(ROUND(({expr}) * 100.0) / 100.0)"


@register("summary_table", with_fixture(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({_q(c)}) AS count, {R2(f'avg({_q(c)})')} AS mean, {R2(f'stddev_samp({_q(c)})')} AS std, "
    f"{R2(f'min({_q(c)})')} AS min, {R2(f'quantile_cont({_q(c)}, 0.25)')} AS q25, {R2(f'quantile_cont({_q(c)}, 0.5)')} AS q50, "
    f"{R2(f'quantile_cont({_q(c)}, 0.75)')} AS q75, {R2(f'max({_q(c)})')} AS max FROM telemetry" for c in SENS)))
def q_summary_table(spark, sf_dir):
    """A5 + P14: the describe() table as printed, two decimals."""
    out = PR.summary_stats(raw(spark, sf_dir), SENS)
    return out.select("feature", "count", *[C.round_to(c, 2).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


@register("browser_high_risk", with_fixture(
    _RESULTS_SQL + ", b AS (SELECT * FROM results WHERE Risk_Level = 'High' ORDER BY reading_id LIMIT 10) "
    "SELECT reading_id, Machine_ID, " + R6("Failure_Probability") + " AS Failure_Probability, "
    "format('{:.1f}%', round_even(Failure_Probability * 100.0, 1)) AS label FROM b"))
def q_browser_high_risk(spark, sf_dir):
    """O3 (browser table): the first 10 'High' rows in file order (row id), unsorted by score."""
    res = results_df(spark, sf_dir).where(F.col("Risk_Level") == "High").orderBy(S.ROW_ID).limit(10)
    return res.select(S.ROW_ID, "Machine_ID", r6("Failure_Probability").alias("Failure_Probability"),
                      C.percent_text("Failure_Probability").alias("label"))

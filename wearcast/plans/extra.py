"""Queries for models, sampling, sinks and streaming.

Where a round trip or a stream must reproduce a batch result exactly, the batch
oracle SQL is reused: the CSV round trip equals the fixture, the streamed
serving features equal ``serving_features``, the streamed health index equals
``health_index``, the streamed history equals ``last_n``. Models are checked by
what holds row by row for any fit (which rows are held out, ranges, bands,
metrics that follow from counts), streamed scores against the batch scores.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.operators import boosting as BO
from wearcast.operators import evaluate as EV
from wearcast.operators import features as FE
from wearcast.operators import forest as FO
from wearcast.operators import model as MD
from wearcast.operators import sampling as SA
from wearcast.operators import scoring as SC
from wearcast.operators import selection as SEL
from wearcast.operators import stored
from wearcast.plans import catalog as CAT
from wearcast.plans import training
from wearcast.plans.catalog import ORACLES, RAW_COLS, SENS, raw, register, r6, with_fixture, _q
from wearcast.session import checkpoint_dir, ship_package
from wearcast.sources import inferred
from wearcast.sources.sinks import write_csv, write_sorted_csv
from wearcast.sources.tables import fixture_telemetry, read_telemetry_csv
from wearcast.streaming import live, runlog


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/wearcast-scratch/{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- sources and sinks
@register("csv_roundtrip", with_fixture(
    "SELECT reading_id, machine_id, \"timestamp\", " + ", ".join(_q(c) for c in SENS) + ", failure FROM telemetry"))
def q_csv_roundtrip(spark, sf_dir):
    """S3 write then S1 + S2 read: the telemetry survives a header CSV round trip unchanged."""
    path = scratch(spark, "csv")
    write_csv(raw(spark, sf_dir), path)
    back = read_telemetry_csv(spark, path)
    return back.select(S.ROW_ID, S.KEY, S.TIME, *SENS, S.LABEL)


@register("csv_without_ids", with_fixture(
    "SELECT machine_id, \"timestamp\", " + ", ".join(_q(c) for c in SENS) + ", failure, true AS has_id FROM telemetry"))
def q_csv_without_ids(spark, sf_dir):
    """The reference's own 13-column shape, without row ids, in two files."""
    path = scratch(spark, "csv13")
    write_csv(raw(spark, sf_dir).drop(S.ROW_ID).repartition(2, S.KEY), path)
    back = read_telemetry_csv(spark, path)
    return back.select(S.KEY, S.TIME, *SENS, S.LABEL, F.col(S.ROW_ID).isNotNull().alias("has_id"))


_BROKEN = "reading_id % 3 = 1 AND reading_id % 211 = 1"


def _mixed_files(spark, sf_dir) -> str:
    """The telemetry in three folders of CSV: as it is; with more columns, in another order and with broken cells; with an
    empty table."""
    path, t = scratch(spark, "mixed"), raw(spark, sf_dir)
    write_csv(t.where("reading_id % 3 <> 1"), f"{path}/a")
    torque = F.when(F.expr(_BROKEN), F.lit("broken")).otherwise(F.col("torque").cast("string"))
    more = t.where("reading_id % 3 = 1").withColumns({"torque": torque, "site": F.expr("reading_id % 7"), "load": F.expr("reading_id % 8 / 4"),
                                                      "checked": F.expr("reading_id % 2 = 0"), "note": F.concat(F.lit("r, "), F.col(S.ROW_ID))})
    write_csv(more.select("site", S.LABEL, "note", *reversed(SENS), S.KEY, "load", S.TIME, "checked", S.ROW_ID), f"{path}/b")
    write_csv(t.where("false").coalesce(1), f"{path}/c")
    return path


@register("csv_inferred", with_fixture(
    "SELECT reading_id, machine_id, \"timestamp\", " + ", ".join(_q(c) for c in SENS) + ", failure, CASE WHEN reading_id % 3 = 1 THEN reading_id % 7 END AS site, "
    "CASE WHEN reading_id % 3 = 1 THEN reading_id % 8 / 4.0 END AS load, CASE WHEN reading_id % 3 = 1 THEN reading_id % 2 = 0 END AS checked, "
    f"CASE WHEN reading_id % 3 = 1 THEN 'r, ' || reading_id END AS note FROM telemetry WHERE NOT ({_BROKEN})"))
def q_csv_inferred(spark, sf_dir):
    """Files with other columns and orders, types inferred; the rows without faults."""
    rows = inferred.accepted(inferred.read_csv(spark, _mixed_files(spark, sf_dir)))
    return rows.select(S.ROW_ID, S.KEY, S.TIME, *SENS, S.LABEL, "site", "load", "checked", "note")


@register("csv_quarantine", with_fixture(
    "SELECT reading_id, machine_id, 'b' AS folder, 'torque: not double' AS reason, 'broken' AS rescued, CAST(NULL AS DOUBLE) AS torque, "
    f"{CAT.R6('power_consumption')} AS power_consumption FROM telemetry WHERE {_BROKEN}"))
def q_csv_quarantine(spark, sf_dir):
    """The rows with a broken cell, with file, reason, the cell's text and all that could be read."""
    rows = inferred.quarantined(inferred.read_csv(spark, _mixed_files(spark, sf_dir)))
    return rows.select(S.ROW_ID, S.KEY, F.element_at(F.split("_file", "/"), -2).alias("folder"), F.col("_reason").alias("reason"),
                       F.get_json_object("_rescued", "$.torque").alias("rescued"), "torque", r6("power_consumption").alias("power_consumption"))


@register("csv_types", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{kind}')" for c, kind in [(S.ROW_ID, "bigint"), *inferred.DECLARED.items(), ("site", "bigint"), ("load", "double"), ("checked", "boolean"), ("note", "string")])
    + ") t(name, kind)")
def q_csv_types(spark, sf_dir):
    """The inferred type of every column."""
    found = inferred.infer(spark, _mixed_files(spark, sf_dir))
    return spark.createDataFrame(sorted(found.types.items()), "name string, kind string")


@register("high_risk_file", ORACLES["high_risk"])
def q_high_risk_file(spark, sf_dir):
    """The sorted high-risk list written to CSV and read back."""
    path = scratch(spark, "high-risk")
    hr = SC.high_risk(CAT.results_df(spark, sf_dir))
    write_sorted_csv(hr, path)
    back = spark.read.schema("reading_id long, Machine_ID string, Actual_Status string, Predicted_Status string, "
                             "Failure_Probability double, Risk_Level string, Correct_Prediction boolean") \
        .option("header", True).csv(path)
    return back.withColumn("Failure_Probability", r6("Failure_Probability"))


@register("prediction_file", ORACLES["prediction_results"])
def q_prediction_file(spark, sf_dir):
    """S3: the whole prediction table written to CSV and read back."""
    path = scratch(spark, "predictions")
    table = CAT.results_df(spark, sf_dir)
    write_csv(table, path)
    back = spark.read.schema(table.schema).option("header", True).csv(path)
    return back.withColumn("Failure_Probability", r6("Failure_Probability"))


@register("results_totals", "WITH s AS (" + ORACLES["risk_summary"] + ") SELECT readings AS total, high_risk, medium_risk, low_risk FROM s")
def q_results_totals(spark, sf_dir):
    """The totals object that goes with the JSON records, parsed back."""
    js = SC.results_totals_json(CAT.results_df(spark, sf_dir))
    return js.select(F.from_json("json", "total long, high_risk long, medium_risk long, low_risk long").alias("r")).select("r.*")


@register("feature_list")
def q_feature_list(spark, sf_dir):
    """The selected features written as (ordinal, feature) and read back in order."""
    feats = FE.rolling_features(raw(spark, sf_dir))
    cut = SEL.cumulative_cut(CAT.correlation_importance(feats))
    path = scratch(spark, "features")
    SEL.write_feature_list(SEL.feature_list(cut), path)
    return spark.read.parquet(path).orderBy("ordinal")


def _feature_list_sql():
    base = ORACLES["feature_cut"]
    head, _ = base.rsplit("SELECT feature, ", 1)
    return head + ("SELECT CAST(rank AS INTEGER) AS ordinal, feature FROM rk, u "
                   "WHERE CASE WHEN under < 10 THEN rank <= 10 ELSE cum <= 0.95 END")


ORACLES["feature_list"] = _feature_list_sql()


@register("serving_from_store", ORACLES["serving_features"])
def q_serving_from_store(spark, sf_dir):
    """O1: readings written once in stored order; the serving features come from that table without an exchange of them."""
    name = f"readings_{uuid.uuid4().hex[:12]}"
    stored.write(raw(spark, sf_dir), name, scratch(spark, "stored"))
    out = FE.serving_features(stored.read(spark, name))
    return out.select(S.ROW_ID, S.KEY, *[r6(c).alias(c) for c in S.ROLLING_FEATURES + S.STAT_FEATURES])


# ---------------------------------------------------------------- sampling
_HASH_SQL = f"CAST('0x' || substr(md5(CAST(reading_id AS VARCHAR) || ':{S.SEED}'), 1, 15) AS BIGINT)"
_SPLIT_SQL = (f"h AS (SELECT reading_id, failure, machine_id, {_HASH_SQL} AS h FROM telemetry),\n"
              "o AS (SELECT *, row_number() OVER (PARTITION BY failure ORDER BY h, reading_id) AS r, "
              "round(count(*) OVER (PARTITION BY failure) * 0.2) AS k FROM h),\n"
              "split AS (SELECT reading_id, machine_id, failure, CASE WHEN r <= k THEN 'test' ELSE 'train' END AS split FROM o)\n")


@register("stratified_split", with_fixture(_SPLIT_SQL + "SELECT reading_id, failure, split FROM split"))
def q_stratified_split(spark, sf_dir):
    """M1: exact per-class 20 % test share."""
    return SA.stratified_split(raw(spark, sf_dir)).select(S.ROW_ID, S.LABEL, "split")


@register("split_shares", with_fixture(
    "SELECT failure, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM telemetry GROUP BY failure"))
def q_split_shares(spark, sf_dir):
    """M1 check: test rows per class equal round(0.2 * n_class)."""
    sp = SA.stratified_split(raw(spark, sf_dir))
    return sp.groupBy(S.LABEL).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("n_test"))


@register("seeded_shuffle", with_fixture(f"SELECT reading_id, machine_id, {_HASH_SQL} AS shuffle_key FROM telemetry"))
def q_seeded_shuffle(spark, sf_dir):
    """Reproducible shuffled order, with the key it is sorted by."""
    return SA.seeded_shuffle(raw(spark, sf_dir).select(S.ROW_ID, S.KEY))


# ---------------------------------------------------------------- models
def _fit_pair(spark, sf_dir):
    """The training job with the reference settings: run once per session and input folder and kept on the session,
    since five queries look at its different results."""
    kept = spark.__dict__.setdefault("_wearcast_trained", {})
    if sf_dir not in kept:
        kept[sf_dir] = training.train(raw(spark, sf_dir))
    return kept[sf_dir]


_IN_UNIT = "p BETWEEN 0 AND 1"


@register("feature_importance", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', true, true)" for f in S.ALL_FEATURES) + ") t(feature, in_range, sums_to_one)")
def q_feature_importance(spark, sf_dir):
    """M3: forest importances of the 17 features over all rows, trees grown out; each lies in [0, 1] and they add up to 1."""
    imp = _fit_pair(spark, sf_dir).importance.select("feature", "importance")
    total = imp.agg(F.sum("importance").alias("total"))
    return imp.crossJoin(F.broadcast(total)).select(  # one row
        "feature", F.col("importance").between(0, 1).alias("in_range"), (F.abs(F.col("total") - 1) < 1e-9).alias("sums_to_one"))


@register("model_scores", with_fixture(
    _SPLIT_SQL + "SELECT reading_id, machine_id AS Machine_ID, CASE WHEN failure = 1 THEN 'Failure' ELSE 'Normal' END AS Actual_Status, "
    "true AS p_in_range, true AS band_follows_p, true AS correct_follows FROM split WHERE split = 'test'"))
def q_model_scores(spark, sf_dir):
    """M4 + M5 + M7 + M8 + M9: both models fitted with the reference settings; the chosen one scores the hold-out. The
    scores come with the checks that hold for any model: range, risk band and correctness follow from p and the label."""
    r = _fit_pair(spark, sf_dir).results
    p = F.col("Failure_Probability")
    band = F.when(p > 0.7, "High").when(p > 0.3, "Medium").when(p > 0, "Low")
    return r.select(S.ROW_ID, "Machine_ID", "Actual_Status", p.between(0, 1).alias("p_in_range"),
                    F.col("Risk_Level").eqNullSafe(band).alias("band_follows_p"),
                    (F.col("Correct_Prediction") == (F.col("Actual_Status") == F.col("Predicted_Status"))).alias("correct_follows"))


@register("model_choice", "SELECT * FROM (VALUES ('Gradient-Boosted Trees', true, true), ('Random Forest', true, true)) t(model, metrics_follow, choice_follows)")
def q_model_choice(spark, sf_dir):
    """M8: hold-out metrics of both models, worked out again from the confusion counts, and the choice (higher F1, tie -> forest)."""
    res = _fit_pair(spark, sf_dir)
    rows = []
    for f in [res.rf, res.gbt]:
        m = f.metrics
        rows.append((f.name, *(int(m[k]) for k in ("tp", "fp", "fn", "tn")), float(m["accuracy"]), float(m["precision"]), float(m["recall"]),
                     float(m["f1"]), f.name == res.best.name))
    df = spark.createDataFrame(rows, "model string, tp long, fp long, fn long, tn long, accuracy double, precision double, recall double, f1 double, chosen boolean")
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    accuracy = F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    same = (F.abs(F.col("accuracy") - accuracy) < 1e-9) & (F.abs(F.col("precision") - precision) < 1e-9) & (F.abs(F.col("recall") - recall) < 1e-9) & (F.abs(F.col("f1") - f1) < 1e-9)
    boosted_wins = res.gbt.metrics["f1"] > res.rf.metrics["f1"]
    return df.select("model", same.alias("metrics_follow"), (F.col("chosen") == ((F.col("model") == res.gbt.name) == F.lit(boosted_wins))).alias("choice_follows"))


@register("model_roundtrip", with_fixture(_SPLIT_SQL + "SELECT reading_id, true AS equal FROM split WHERE split = 'test'"))
def q_model_roundtrip(spark, sf_dir):
    """The chosen model, saved and loaded, gives the hold-out the same scores."""
    res = _fit_pair(spark, sf_dir)
    path = scratch(spark, "model")
    MD.save(res.best.model, path)
    test = _engineered(spark, sf_dir).select(S.ROW_ID, *res.selected).join(
        SA.stratified_split(raw(spark, sf_dir)).where("split = 'test'").select(S.ROW_ID), S.ROW_ID)
    loaded = MD.score(MD.load(path), test, [S.ROW_ID])
    saved = res.results.select(S.ROW_ID, F.col("Failure_Probability").alias("saved"))
    return loaded.join(saved, S.ROW_ID).select(S.ROW_ID, (F.abs(F.col("p") - F.col("saved")) < 1e-9).alias("equal"))


@register("artifacts_roundtrip", with_fixture(_SPLIT_SQL + "SELECT reading_id, true AS forest_equal, true AS boosting_equal, true AS scaler_equal FROM split WHERE split = 'test'"))
def q_artifacts_roundtrip(spark, sf_dir):
    """Both models and the scaler, each saved and loaded, say the same of every hold-out reading: equal scores of
    either model, equal standardised values."""
    res = _fit_pair(spark, sf_dir)
    path = scratch(spark, "artifacts")
    training.save_artifacts(res, path)
    back = training.load_artifacts(spark, path)
    test = _engineered(spark, sf_dir).select(S.ROW_ID, *res.selected).join(
        SA.stratified_split(raw(spark, sf_dir)).where("split = 'test'").select(S.ROW_ID), S.ROW_ID)
    for name, now, then in (("rf", res.rf.model, back.rf), ("gbt", res.gbt.model, back.gbt)):
        test = MD.score(now, test, test.columns).drop("prediction").withColumnRenamed("p", name)
        test = MD.score(then, test, test.columns).drop("prediction").withColumnRenamed("p", f"{name}_back")
    scaled = EV.scale_columns(test.select("*", *[F.col(c).alias(f"raw_{c}") for c in back.selected]), back.selected, back.scaler)
    same = F.lit(True)
    for c in res.selected:
        mean, scale = res.rf.model.scaler[c]
        same = same & (F.abs(F.col(c) - (F.col(f"raw_{c}") - mean) / scale) < 1e-9)
    return scaled.select(S.ROW_ID, (F.col("rf") == F.col("rf_back")).alias("forest_equal"), (F.col("gbt") == F.col("gbt_back")).alias("boosting_equal"), same.alias("scaler_equal"))


#: A rule over sensors with few different values, which any sound fit of trees finds exactly.
_RULE = "(temperature > 82 AND pressure > 5) OR voltage < 213"
_RULE_INPUTS = ["temperature", "pressure", "voltage", "rotation_speed"]
_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in _RULE_INPUTS)


@register("planted_models", with_fixture(f"SELECT reading_id, CASE WHEN {_RULE} THEN 1 ELSE 0 END AS forest, CASE WHEN {_RULE} THEN 1 ELSE 0 END AS boosting FROM telemetry WHERE {_KNOWN}"))
def q_planted_models(spark, sf_dir):
    """M4 + M5 + M7: forest and boosting, fitted on a label that a rule plants, predict every reading as the rule says."""
    data = raw(spark, sf_dir).where(_KNOWN).select(S.ROW_ID, *_RULE_INPUTS, F.expr(_RULE).cast("int").alias("planted"))
    forest = FO.fit(data, _RULE_INPUTS, "planted", trees=60)
    boosting = BO.fit(data, _RULE_INPUTS, "planted", weight=None, rounds=40)
    both = MD.score(forest, data, data.columns).drop("p").withColumnRenamed("prediction", "forest")
    return MD.score(boosting, both, [S.ROW_ID, "forest"]).select(S.ROW_ID, "forest", F.col("prediction").alias("boosting"))


@register("planted_importance", "SELECT * FROM (VALUES ('temperature', true), ('pressure', true), ('voltage', true), ('rotation_speed', false)) t(feature, matters)")
def q_planted_importance(spark, sf_dir):
    """M3: the importances of a forest grown out on that label tell the rule's sensors from the other one."""
    data = raw(spark, sf_dir).where(_KNOWN).select(S.ROW_ID, *_RULE_INPUTS, F.expr(_RULE).cast("int").alias("planted"))
    return FO.importance(data, _RULE_INPUTS, "planted", trees=40).select("feature", (F.col("importance") > 0.05).alias("matters"))


def _engineered(spark, sf_dir):
    return training.engineered_table(raw(spark, sf_dir))


# ---------------------------------------------------------------- streaming
STREAM_COLS = RAW_COLS + ["prediction"]


def stage_stream_input(spark: SparkSession, sf_dir: str, slices: int = 3) -> tuple[str, list[DataFrame]]:
    """The fixture cut into ``slices`` time-ordered parts (written one run at a time)."""
    t = fixture_telemetry(spark, sf_dir).select(*STREAM_COLS)
    rng = t.agg(F.min(F.unix_micros(F.col(S.TIME).cast("timestamp"))).alias("lo"),
                F.max(F.unix_micros(F.col(S.TIME).cast("timestamp"))).alias("hi")).first()
    lo, hi = rng["lo"], rng["hi"] + 1
    cuts = [lo + (hi - lo) * i // slices for i in range(slices + 1)]
    us = F.unix_micros(F.col(S.TIME).cast("timestamp"))
    parts = [t.where((us >= cuts[i]) & (us < cuts[i + 1])) for i in range(slices)]
    return scratch(spark, "stream-in"), parts


def run_in_slices(spark, sf_dir, build, name: str, foreach: bool = False, run_ids: bool = False):
    """Write each time slice, then run the stream with ``availableNow`` from its checkpoint: state crosses
    batches and every run is a restart."""
    ship_package(spark)
    src, parts = stage_stream_input(spark, sf_dir)
    sink, ckpt = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-ckpt")
    schema = fixture_telemetry(spark, sf_dir).select(*STREAM_COLS).schema
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(src)
        out = build(live.reading_stream(spark, src, schema))
        if foreach:
            def sink_batch(df, batch_id, _sink=sink):
                df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{_sink}/batch={batch_id}")
            q = out.writeStream.foreachBatch(sink_batch).option("checkpointLocation", ckpt) \
                   .outputMode("update").trigger(availableNow=True).start()
        else:
            q = live.write_log(out, sink, ckpt, run_id=f"run-{i}" if run_ids else None)
        q.awaitTermination()
    return spark.read.parquet(sink)


def _serving(readings):
    return live.serving_stream(readings, [S.ROW_ID, S.KEY, S.TIME] + SENS + [S.LABEL, "prediction"])


@register("stream_serving_features", ORACLES["serving_features"])
def q_stream_serving_features(spark, sf_dir):
    """Keyed streaming state reproduces the batch serving features."""
    out = run_in_slices(spark, sf_dir, _serving, "serving")
    return out.select(S.ROW_ID, S.KEY, *[r6(c).alias(c) for c in S.ROLLING_FEATURES + S.STAT_FEATURES])


@register("stream_health_index", ORACLES["health_index"])
def q_stream_health_index(spark, sf_dir):
    """T5: streamed health index (sticky latch on the alert flag) equals the batch form."""
    out = run_in_slices(spark, sf_dir, _serving, "health")
    return out.select(S.ROW_ID, S.KEY, "seq", r6("degradation").alias("degradation"))


@register("stream_history", ORACLES["last_n"])
def q_stream_history(spark, sf_dir):
    """The last 30 readings per machine kept as state; the final emission equals ``last_n``."""
    fields = [S.ROW_ID, S.KEY, S.TIME, "vibration", "temperature", "pressure", "prediction"]
    out = run_in_slices(spark, sf_dir, lambda r: live.history_stream(r, fields, S.BROWSER_HISTORY), "history", foreach=True)
    latest = out.groupBy(S.KEY).agg(F.max("batch_id").alias("batch_id"))
    return out.join(latest, [S.KEY, "batch_id"]).select(S.ROW_ID, S.KEY, "recency")


@register("stream_history_state", ORACLES["last_n"])
def q_stream_history_state(spark, sf_dir):
    """The last 30 readings per machine read from the checkpoint's state after three restarts; the stream itself hands
    on one row a machine and batch."""
    ship_package(spark)
    fields = [S.ROW_ID, S.KEY, S.TIME, "vibration", "temperature", "pressure", "prediction"]
    src, parts = stage_stream_input(spark, sf_dir)
    ckpt = scratch(spark, "history-ckpt")
    for part in parts:
        part.write.mode("append").parquet(src)
        readings = live.reading_stream(spark, src, part.schema)
        live.kept_history_stream(readings, fields, S.BROWSER_HISTORY).writeStream.format("noop").option("checkpointLocation", ckpt) \
            .outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return live.kept_history(spark, ckpt).select(S.ROW_ID, S.KEY, "recency")


DELAY_HOURS = 6
HEARTBEAT = "HEARTBEAT"


def run_ordered(spark, parts: list[DataFrame], name: str) -> DataFrame:
    """The event-time stream over ``parts``, a restart between them, then a heartbeat: one reading of no machine, later
    than all others, that moves the watermark past them."""
    ship_package(spark)
    src, sink, ckpt = scratch(spark, f"{name}-in"), scratch(spark, f"{name}-out"), scratch(spark, f"{name}-ckpt")
    schema = parts[0].schema
    end = F.max(F.col(S.TIME)) + F.expr(f"INTERVAL {DELAY_HOURS + 1} HOURS")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    beat = whole.agg(end.alias(S.TIME)).select(*[(F.lit(HEARTBEAT) if f.name == S.KEY else F.col(S.TIME) if f.name == S.TIME
                                                 else F.lit(-1) if f.name in (S.ROW_ID, S.LABEL, "prediction") else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    keep = [S.ROW_ID, S.KEY, S.TIME] + SENS + [S.LABEL, "prediction"]
    for part in [*parts, beat]:
        part.write.mode("append").parquet(src)
        released = live.ordered_serving_stream(live.reading_stream(spark, src, schema), keep, f"{DELAY_HOURS} hours")
        live.write_log(released, sink, ckpt).awaitTermination()
    return spark.read.parquet(sink).where(F.col(S.KEY) != HEARTBEAT)


@register("stream_ordered_features", ORACLES["serving_features"])
def q_stream_ordered_features(spark, sf_dir):
    """T2 in event-time order: readings arrive up to six hours after their time, shuffled over the micro-batches; what
    leaves equals the batch serving features."""
    t = fixture_telemetry(spark, sf_dir).select(*STREAM_COLS)
    arrival = F.unix_micros(F.col(S.TIME).cast("timestamp")) + F.pmod(F.xxhash64(S.ROW_ID), F.lit(DELAY_HOURS * 3_600_000_000))
    rng = t.agg(F.min(arrival).alias("lo"), F.max(arrival).alias("hi")).first()
    cuts = [rng["lo"] + (rng["hi"] + 1 - rng["lo"]) * i // 3 for i in range(4)]
    out = run_ordered(spark, [t.where((arrival >= a) & (arrival < b)) for a, b in zip(cuts, cuts[1:])], "ordered")
    return live.on_time(out).select(S.ROW_ID, S.KEY, *[r6(c).alias(c) for c in S.ROLLING_FEATURES + S.STAT_FEATURES])


@register("stream_late_readings", with_fixture(
    "m AS (SELECT epoch_us(min(\"timestamp\")) AS lo, epoch_us(max(\"timestamp\")) AS hi FROM telemetry),\n"
    f"c AS (SELECT lo + (hi - lo) * 2 // 3 AS cut FROM m),\n"
    f"w AS (SELECT ((max(epoch_us(\"timestamp\")) - {DELAY_HOURS * 3_600_000_000}) // 1000) * 1000 AS mark FROM telemetry, c WHERE reading_id % 97 <> 0 AND epoch_us(\"timestamp\") < cut)\n"
    "SELECT reading_id, machine_id, reading_id % 97 = 0 AND epoch_us(\"timestamp\") <= mark AS late FROM telemetry, w"))
def q_stream_late_readings(spark, sf_dir):
    """Readings held back until the last micro-batch; those that the watermark has passed by then are late and go to
    the side table, all others leave in order."""
    t = fixture_telemetry(spark, sf_dir).select(*STREAM_COLS)
    us = F.unix_micros(F.col(S.TIME).cast("timestamp"))
    rng = t.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    first = (F.col(S.ROW_ID) % 97 != 0) & (us < rng["lo"] + (rng["hi"] - rng["lo"]) * 2 // 3)
    out = run_ordered(spark, [t.where(first), t.where(~first)], "late")
    late = live.late_readings(out, [S.ROW_ID, S.KEY]).withColumn("late", F.lit(True))
    return live.on_time(out).select(S.ROW_ID, S.KEY, F.lit(False).alias("late")).unionByName(late)


@register("stream_alert_counts", with_fixture(
    "SELECT machine_id, count(*) AS readings, count(*) FILTER (WHERE prediction = 1) AS alerts FROM telemetry GROUP BY machine_id"))
def q_stream_alert_counts(spark, sf_dir):
    """T4: running per-machine readings and alerts in update mode; the last update per machine is the total."""
    out = run_in_slices(spark, sf_dir, live.alert_counts, "counts", foreach=True)
    latest = out.groupBy(S.KEY).agg(F.max("batch_id").alias("batch_id"))
    return out.join(latest, [S.KEY, "batch_id"]).select(S.KEY, "readings", "alerts")


@register("stream_run_log", with_fixture(
    "m AS (SELECT epoch_us(min(\"timestamp\")) AS lo, epoch_us(max(\"timestamp\")) + 1 AS hi FROM telemetry),\n"
    "s AS (SELECT reading_id, machine_id, CASE WHEN epoch_us(\"timestamp\") < lo + (hi - lo) * 1 // 3 THEN 'run-0' WHEN epoch_us(\"timestamp\") < lo + (hi - lo) * 2 // 3 THEN 'run-1' "
    "ELSE 'run-3' END AS run FROM telemetry, m)\n"
    "SELECT reading_id, machine_id, run, count(*) OVER (PARTITION BY run) AS entered FROM s"))
def q_stream_run_log(spark, sf_dir):
    """Three runs with readings and one without (run-2), logged through the ledger; every reading with the number of
    rows that the ledger has for its run."""
    ship_package(spark)
    src, parts = stage_stream_input(spark, sf_dir)
    path, ckpt = scratch(spark, "runs"), scratch(spark, "runs-ckpt")
    for run, part in enumerate([parts[0], parts[1], None, parts[2]]):
        if part is not None:
            part.write.mode("append").parquet(src)
        readings = live.reading_stream(spark, src, parts[0].schema)
        runlog.write_run(readings.select(S.ROW_ID, S.KEY, S.TIME), path, ckpt, f"run-{run}").awaitTermination()
    entered = runlog.ledger(spark, path).groupBy(F.col("run").alias("of")).agg(F.sum("rows").alias("entered"))
    return runlog.read_log(spark, path).join(entered, F.col("run") == F.col("of")).select(S.ROW_ID, S.KEY, "run", "entered")


@register("stream_scores", with_fixture("SELECT reading_id, machine_id, true AS p_in_range, true AS equals_batch_score, true AS run_is_tagged, "
                                        "true AS alert_follows FROM telemetry"))
def q_stream_scores(spark, sf_dir):
    """T1 + S7 + S9: the chosen model and its feature list, saved, loaded and applied to a stream of readings; the log
    carries a run id and the JSON message, the alerts are a stream of their own. Every row is compared with the batch
    score of the same serving features."""
    res = _fit_pair(spark, sf_dir)
    model_path, list_path = scratch(spark, "model"), scratch(spark, "features")
    MD.save(res.best.model, model_path)
    SEL.write_feature_list(res.selected, list_path, spark)
    model, feats = MD.load(model_path), SEL.read_feature_list(spark, list_path)
    keep = [S.ROW_ID, S.KEY, S.TIME, "seq", "degradation", *feats, *[c for c in ("vibration", "temperature", "pressure") if c not in feats]]

    def scored(readings):
        # the fixture's stand-in prediction drives the health latch but is not carried into scoring
        features = live.serving_stream(readings, [S.ROW_ID, S.KEY, S.TIME] + SENS + [S.LABEL])
        return live.with_message(live.score_stream(features, model, keep))

    log = run_in_slices(spark, sf_dir, scored, "scores", run_ids=True)
    alerts = run_in_slices(spark, sf_dir, lambda r: live.alerts(scored(r)), "alerts").select(S.ROW_ID, F.lit(True).alias("alerted"))
    batch = MD.score(model, FE.serving_features(raw(spark, sf_dir)), [S.ROW_ID]).select(S.ROW_ID, F.col("p").alias("batch_p"))
    return log.join(batch, S.ROW_ID).join(alerts, S.ROW_ID, "left").select(
        S.ROW_ID, S.KEY, F.col("probability").between(0, 1).alias("p_in_range"), (F.abs(F.col("probability") - F.col("batch_p")) < 1e-9).alias("equals_batch_score"),
        F.col("run_id").startswith("run-").alias("run_is_tagged"), (F.coalesce("alerted", F.lit(False)) == (F.col("prediction") == 1)).alias("alert_follows"))

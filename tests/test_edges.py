"""Hand-made edge frames (imputation, windows, bins, metrics, selection) and the blocked-window invariants."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearcast.functions import columns as C
from wearcast.operators import evaluate as EV
from wearcast.operators import features as FE
from wearcast.operators import impute as IM
from wearcast.operators import profile as PR
from wearcast.operators import scoring as SC
from wearcast.operators import selection as SEL
from wearcast.operators import series
from wearcast.operators.quantiles import exact_quantiles
from wearcast.operators.scan import next_non_null, prefix_sums

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "reading_id long, machine_id string, timestamp timestamp_ntz, vibration double, temperature double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df, col):
    return {r["reading_id"]: r[col] for r in df.collect()}


# ------------------------------------------------------------------ imputation
def test_leading_null_takes_own_first_value(spark):
    rows = [(1, "M1", T0, None, 1.0), (2, "M1", T0 + dt.timedelta(hours=1), 5.0, None),
            (3, "M1", T0 + dt.timedelta(hours=2), None, 3.0)]
    out = IM.impute(frame(spark, rows), ["vibration", "temperature"])
    assert by_id(out, "vibration") == {1: 5.0, 2: 5.0, 3: 5.0}
    assert by_id(out, "temperature") == {1: 1.0, 2: 1.0, 3: 3.0}


def test_all_null_machine_takes_next_machine_then_median(spark):
    rows = [(1, "A", T0, None, 1.0), (2, "A", T0 + dt.timedelta(hours=1), None, 2.0),
            (3, "B", T0, 7.0, None), (4, "B", T0 + dt.timedelta(hours=1), 9.0, None)]
    out = IM.impute(frame(spark, rows), ["vibration", "temperature"])
    assert by_id(out, "vibration") == {1: 7.0, 2: 7.0, 3: 7.0, 4: 9.0}
    # B is all null for temperature and last: the median of the filled column (1, 2) = 1.5
    assert by_id(out, "temperature") == {1: 1.0, 2: 2.0, 3: 1.5, 4: 1.5}


@pytest.mark.parametrize("rows", [2, 7, 10_000])
def test_forward_fill_across_blocks(spark, rows):
    data = [(i, "M", T0 + dt.timedelta(minutes=37 * i), (float(i) if i % 4 == 0 else None), 0.0) for i in range(40)]
    out = IM.fill_forward_back(frame(spark, data), ["vibration"], block_rows=rows)
    assert by_id(out, "vibration") == {i: float(i - i % 4) for i in range(40)}


# ------------------------------------------------------------------ windows
def _random_series(spark, n_machines=4, n=80, seed=7):
    rnd = random.Random(seed)
    rows = []
    rid = 0
    for m in range(n_machines):
        t = T0
        for _ in range(n if m else 3 * n):  # machine 0 is the hot one
            t += dt.timedelta(minutes=rnd.choice([1, 5, 30, 90, 600]))
            v = None if rnd.random() < 0.05 else rnd.gauss(2, 1)
            rows.append((rid, f"M{m}" if m < 3 else None, None if rnd.random() < 0.03 else t, v, rnd.gauss(70, 3)))
            rid += 1
    return frame(spark, rows)


@pytest.mark.parametrize("rows", [10, 23, 100_000])
def test_blocked_rolling_equals_plain_window(spark, rows):
    df = _random_series(spark)
    w = Window.partitionBy("machine_id").orderBy(F.col("timestamp").asc_nulls_last(), "reading_id")
    want = df.select("reading_id", F.avg("vibration").over(w.rowsBetween(-4, 0)).alias("m"),
                     F.stddev_pop("vibration").over(w.rowsBetween(-5, -1)).alias("s"))
    specs = [("m", lambda w: F.avg("vibration").over(w.rowsBetween(-4, 0))),
             ("s", lambda w: F.stddev_pop("vibration").over(w.rowsBetween(-5, -1)))]
    got = series.rolling(df, specs, 5, block_rows=rows)
    a = {r["reading_id"]: (r["m"], r["s"]) for r in want.collect()}
    b = {r["reading_id"]: (r["m"], r["s"]) for r in got.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None and y is None) or math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("rows", [1, 23, 100_000])
def test_sequence_and_last_n_equal_plain_window(spark, rows):
    df = _random_series(spark)
    w = Window.partitionBy("machine_id").orderBy(F.col("timestamp").asc_nulls_last(), "reading_id")
    want = by_id(df.select("reading_id", F.row_number().over(w).alias("seq")), "seq")
    got = by_id(series.sequence_number(df, block_rows=rows), "seq")
    assert want == got
    wd = Window.partitionBy("machine_id").orderBy(F.col("timestamp").desc_nulls_first(), F.col("reading_id").desc())
    want_last = by_id(df.select("reading_id", F.row_number().over(wd).alias("r")).where("r <= 7"), "r")
    got_last = by_id(series.last_n(df, 7, block_rows=rows), "recency")
    assert want_last == got_last


def test_blocks_are_bounded_however_the_readings_lie(spark):
    """A burst in one day, a long sparse tail and missing times: blocks of the asked size, none short but the last."""
    burst = [(i, "HOT", T0 + dt.timedelta(seconds=i), 1.0, 1.0) for i in range(4000)]
    tail = [(10_000 + i, "HOT", T0 + dt.timedelta(days=3 * i + 2), 1.0, 1.0) for i in range(60)]
    lost = [(20_000 + i, "HOT", None, 1.0, 1.0) for i in range(5)]
    small = [(30_000 + i, f"S{i % 50}", T0 + dt.timedelta(hours=i), 1.0, 1.0) for i in range(500)]
    df = series.with_block(frame(spark, burst + tail + lost + small), block_rows=100)
    sizes = {(r["machine_id"], r["_block"]): r["n"] for r in df.groupBy("machine_id", "_block").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(b == 0 for m, b in sizes if m != "HOT")
    hot = sorted((b, n) for (m, b), n in sizes.items() if m == "HOT")
    assert all(n >= 50 for _, n in hot[:-1])
    # one day in half a year is a single bucket here: finer blocks than a bucket are not made
    even = frame(spark, burst + lost)
    cut = series.with_block(even, block_rows=100).groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(cut) >= 30 and max(r["n"] for r in cut) <= 160


def test_few_rows_are_repaired(spark, monkeypatch):
    data = [(i, "M", T0 + dt.timedelta(seconds=i), float(i), 1.0) for i in range(20_000)]
    df = series.with_block(frame(spark, data), block_rows=2000)
    blocks = df.select("_block").distinct().count()
    assert 5 <= blocks <= 20 and 2 * 4 * blocks < 0.01 * len(data)
    single = FE.rolling_features(_random_series(spark).withColumn("pressure", F.lit(5.0)).withColumn("current", F.lit(1.0))
                                 .withColumn("torque", F.lit(1.0)).withColumn("power_consumption", F.lit(1.0)))
    single.collect()
    text = single._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    # the readings themselves are dealt out once, by machine and block; borders and counts are small exchanges of their own
    assert final.count("hashpartitioning(machine_id") - final.count("ReusedExchange") <= 4


def test_single_reading_std_and_serving_fallback(spark):
    df = frame(spark, [(1, "M", T0, 2.5, 70.0)]).withColumn("pressure", F.lit(5.0)) \
        .withColumn("current", F.lit(12.0)).withColumn("torque", F.lit(149.0)).withColumn("power_consumption", F.lit(30.0))
    r = FE.rolling_features(df).first()
    assert r["vibration_rolling_std"] == 0.0 and r["vibration_rolling_avg"] == 2.5
    assert r["power_efficiency"] == pytest.approx(0.2)
    s = FE.serving_features(df).first()
    assert s["vibration_rolling_avg"] == 2.5 and s["current_rolling_std"] == 0.0


# The first seven readings of the reference's committed live log
# (vibration, temperature, pressure, torque, power_consumption).
GOLDEN = [
    (2.437988257251682, 67.63508362131776, 5.89100688340037, 151.25325942374224, 24.849101881378623),
    (2.2639705624627777, 69.3996848691089, 5.918274801256064, 151.06255601591957, 22.232988219036105),
    (1.5852157462582213, 70.41117111387936, 5.369023292216278, 144.02089810540406, 25.5975959385875),
    (2.631655764605799, 69.6468889321801, 4.961825812317846, 151.76436056166355, 20.89997583150016),
    (2.465373238567858, 70.64611293288957, 5.434404607076674, 144.85562550435483, 22.161553192777497),
    (2.470997496416856, 71.59382763683809, 5.844592111279935, 152.9355294595693, 23.225702948980963),
    (2.6560893396312384, 70.93995778648426, 5.409478447749616, 153.1434179774832, 23.63941234142857),
]
# Their logged serving features at readings 1, 6 and 7: (vibration_rolling_avg, temperature_rolling_avg,
# pressure_rolling_avg, power_efficiency, temp_vib_interaction).
GOLDEN_OUT = {
    0: (2.437988257251682, 67.63508362131776, 5.89100688340037, 0.16320899779373574, 164.89353964700828),
    5: (2.2768407138292677, 69.54778829387513, 5.514907079253446, 0.15087941705544414, 176.90816884952685),
    6: (2.2834425616623024, 70.33953709697921, 5.50562412482936, 0.1533598557213889, 188.4228656305709),
}


def test_serving_features_reproduce_committed_live_log(spark):
    rows = [(i, "LIVE", T0 + dt.timedelta(milliseconds=500 * i), *g) for i, g in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "reading_id long, machine_id string, timestamp timestamp_ntz, vibration double, "
                                     "temperature double, pressure double, torque double, power_consumption double") \
        .withColumn("current", F.lit(12.0))
    out = {r["reading_id"]: r for r in FE.serving_features(df).collect()}
    for i, want in GOLDEN_OUT.items():
        r = out[i]
        got = (r["vibration_rolling_avg"], r["temperature_rolling_avg"], r["pressure_rolling_avg"],
               r["power_efficiency"], r["temp_vib_interaction"])
        assert got == pytest.approx(want, rel=1e-12)


# ------------------------------------------------------------------ bins, metrics, reports
def test_risk_bins_are_left_open(spark):
    ps = [0.0, 0.3, 0.300001, 0.7, 0.700001, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", C.risk_level("p").alias("r"))
    got = {r["p"]: r["r"] for r in df.collect()}
    assert got == {0.0: None, 0.3: "Low", 0.300001: "Medium", 0.7: "Medium", 0.700001: "High", 1.0: "High"}


def test_percent_text_like_python(spark):
    # the two committed high-risk probabilities, formatted as the dashboard did
    ps = [0.9997801, 0.99828905, 0.5, 0.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", C.percent_text("p").alias("t"))
    got = {r["p"]: r["t"] for r in df.collect()}
    assert got == {p: f"{p:.1%}" for p in ps}


def test_one_class_auc_is_null_and_no_positive_predictions_give_zero(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2), (0, 0, 0.3)], "failure int, prediction int, p double")
    assert EV.roc_auc(df).first()["auc"] is None
    m = EV.classification_metrics(df).first()
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0 and m["accuracy"] == 1.0


def test_auc_with_ties_matches_rank_formula(spark):
    rnd = np.random.default_rng(3)
    y = rnd.integers(0, 2, 400)
    p = np.round(rnd.random(400) * 0.5 + y * 0.2, 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "failure int, p double")
    ranks = pd.Series(p).rank().to_numpy()
    npos, nneg = y.sum(), (1 - y).sum()
    want = (ranks[y == 1].sum() - npos * (npos + 1) / 2) / (npos * nneg)
    assert EV.roc_auc(df, n_blocks=5).first()["auc"] == pytest.approx(want, rel=1e-12)


def test_placeholder_when_nothing_is_high_risk(spark):
    res = spark.createDataFrame([(1, "M", 0.2), (2, "M", 0.69)], "reading_id long, Machine_ID string, Failure_Probability double")
    out = SC.top_risk(res).collect()
    assert len(out) == 1 and out[0]["Machine_ID"] == "None" and out[0]["placeholder"]


def test_histogram_all_equal_scores_fall_in_bin_zero(spark):
    df = spark.createDataFrame([(0.5,)] * 4, "Failure_Probability double")
    got = {r["bin"]: r["n"] for r in EV.score_histogram(df).collect()}
    assert got[0] == 4 and sum(got.values()) == 4 and len(got) == 30


def test_constant_column_correlation_is_null_not_an_error(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (1.0, 3.0, 1), (1.0, 5.0, 0)], "a double, b double, failure int")
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in PR.correlation_matrix(df, ["a", "b", "failure"]).collect()}
    assert got[("a", "b")] is None and got[("a", "a")] is None and got[("b", "b")] == 1.0


# ------------------------------------------------------------------ selection
def _importances(spark, values):
    names = [f"f{i:02d}" for i in range(len(values))]
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")


def test_cut_floor_of_ten(spark):
    vals = [0.4, 0.3, 0.15, 0.08, 0.03] + [0.04 / 12] * 12  # the 0.95 cut keeps 4 (<10) -> top 10
    cut = SEL.cumulative_cut(_importances(spark, vals))
    assert cut.where("selected").count() == 10


def test_plain_cut(spark):
    vals = [0.25] + [0.0625] * 11 + [0.02] * 5  # the 0.95 cut keeps 12
    cut = SEL.cumulative_cut(_importances(spark, vals))
    kept = [r["feature"] for r in cut.where("selected").orderBy("rank").collect()]
    assert len(kept) == 12 and kept[0] == "f00"


# ------------------------------------------------------------------ distributed building blocks
def test_exact_quantiles_equal_numpy_through_histogram_rounds(spark):
    rnd = np.random.default_rng(11)
    vals = np.concatenate([rnd.normal(size=3000), np.full(500, 0.25), rnd.exponential(size=1500)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)] * 10, "x double")
    q = exact_quantiles(df, ["x"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0], bins=4)
    for p in [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]:
        assert q[("x", p)] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)


def test_exact_quantiles_of_odd_values(spark):
    vals = [float("-inf"), -1e308, -1e-300, 0.0, 5e-324, 1e-300, 1.0, 1e308, float("inf"), float("nan"), float("nan")]
    df = spark.createDataFrame([(v, None) for v in vals], "x double, y double")
    q = exact_quantiles(df, ["x", "y"], [k / 10 for k in range(11)], bins=4)
    assert [q[("x", k / 10)] for k in (1, 2, 3, 4, 5, 6, 7)] == vals[1:8] and math.isnan(q[("x", 1.0)])
    assert q[("x", 0.0)] == float("-inf") and q[("x", 0.8)] == float("inf")
    assert q[("y", 0.5)] is None


def test_csv_by_name_bad_cells_and_stable_ids(spark, tmp_path):
    from wearcast import schema as S
    from wearcast.sources.tables import read_telemetry_csv
    head = [S.TIME, S.KEY, *S.SENSORS, S.LABEL]
    row = ["2024-01-01T00:00:00", "M1", *["1.5"] * len(S.SENSORS), "0"]

    def write(folder, *files):
        (tmp_path / folder).mkdir()
        for k, lines in enumerate(files):
            (tmp_path / folder / f"f{k}.csv").write_text("\n".join(",".join(x) for x in lines) + "\n")
        return str(tmp_path / folder)

    two = [row, row, [*row[:2], "", "NaN", *row[4:]]]
    a = read_telemetry_csv(spark, write("a", [head, *two], [head, row])).collect()
    b = read_telemetry_csv(spark, write("b", [head, row, two[2]], [head, row], [head, row])).collect()
    assert len(a) == 4 and len({r[S.ROW_ID] for r in a}) == 4 and sorted(a, key=str) == sorted(b, key=str)
    assert sum(r["vibration"] is None and r["temperature"] is None for r in a) == 1
    swapped = [head[0], head[1], head[3], head[2], *head[4:]]
    for bad in (write("c", [head, row], [swapped, row]), write("d", [head, [*row[:2], "abc", *row[3:]]])):
        with pytest.raises(Exception):
            read_telemetry_csv(spark, bad).collect()
    with pytest.raises(ValueError):
        read_telemetry_csv(spark, write("e", [head[:-1], row[:-1]]))


def test_checkpoint_folder_is_never_silently_local():
    from wearcast.session import checkpoint_dir

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, *_):
            return self.value

    class Context:
        master, folder = "yarn", None

        def getCheckpointDir(self):
            return self.folder

        def getConf(self):
            return Conf(None)

        def setCheckpointDir(self, path):
            self.folder = path

    class Session:
        def __init__(self, value):
            self.conf, self.sparkContext = Conf(value), Context()

    with pytest.raises(ValueError):
        checkpoint_dir(Session(None))
    assert checkpoint_dir(Session("hdfs:///shared")) == "hdfs:///shared"
    local = Session(None)
    local.sparkContext.master = "local[2]"
    assert checkpoint_dir(local)


def test_split_by_machine_and_one_class(spark):
    from wearcast.operators import model as MD
    from wearcast.operators import sampling as SA
    df = spark.range(2000).selectExpr("id AS reading_id", "concat('M', id % 100) AS machine_id", "cast(0 as int) AS failure")
    sides = SA.group_split(df).groupBy("machine_id").agg(F.count_distinct("split").alias("n"), F.max("split").alias("s")).collect()
    assert {r["n"] for r in sides} == {1} and 5 < sum(r["s"] == "test" for r in sides) < 40
    for weights in (MD.positive_weights, MD.balanced_weights):
        with pytest.raises(ValueError):
            weights(df)


def test_blocked_scans_equal_pandas(spark):
    rnd = random.Random(5)
    rows = [(f"K{i:04d}", None if rnd.random() < 0.6 else float(i), rnd.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double, c long")
    nn = {r["k"]: r["v_next"] for r in next_non_null(df, "k", ["v"], n_blocks=7).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v", "c"]).sort_values("k")
    want = dict(zip(pdf["k"], pdf["v"].bfill()))
    assert all((nn[k] is None and (want[k] is None or math.isnan(want[k]))) or nn[k] == want[k] for k in want)
    ps = {r["k"]: r["cum_c"] for r in prefix_sums(df, ["k"], ["c"], n_blocks=7).collect()}
    assert ps == dict(zip(pdf["k"], pdf["c"].cumsum()))

"""Telemetry schema, feature names and the fixed values the results depend on."""

from __future__ import annotations

KEY = "machine_id"
TIME = "timestamp"
ROW_ID = "reading_id"
LABEL = "failure"

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced.
# Sensor columns, in table order.
SENSORS = [
    "vibration", "temperature", "pressure", "runtime_hours", "voltage",
    "current", "acoustic_emission", "rotation_speed", "torque", "power_consumption",
]
# Rolling means (5 readings) and rolling sample standard deviations.
ROLLING_MEAN_INPUTS = ["vibration", "temperature", "pressure"]
ROLLING_STD_INPUTS = ["vibration", "current"]
ROLLING_WINDOW = 5
# Feature order: sensors, then rolling means, then rolling stds, then the two derived features.
ROLLING_FEATURES = [f"{c}_rolling_avg" for c in ROLLING_MEAN_INPUTS]
STAT_FEATURES = [f"{c}_rolling_std" for c in ROLLING_STD_INPUTS] + ["power_efficiency", "temp_vib_interaction"]
ALL_FEATURES = SENSORS + ROLLING_FEATURES + STAT_FEATURES
# Feature selection: keep cumulative importance <= 0.95, but never fewer than 10.
SELECTION_CUM_THRESHOLD = 0.95
SELECTION_MIN_FEATURES = 10
# Risk bands, left-open: (0, 0.3] Low, (0.3, 0.7] Medium, (0.7, 1.0] High.
RISK_EDGES = [0.0, 0.3, 0.7, 1.0]
RISK_LABELS = ["Low", "Medium", "High"]
HIGH_RISK_THRESHOLD = 0.7
# Declared alert thresholds.
CRITICAL_VIBRATION = 8.0
CRITICAL_TEMPERATURE = 90.0
CRITICAL_PRESSURE_LOW = 4.0
CRITICAL_PRESSURE_HIGH = 6.0
FAILURE_PROBABILITY_ALERT = 0.7
# Declared normal operating ranges (min, max) for nine sensors.
NORMAL_RANGES = {
    "vibration": (0.5, 4.0),
    "temperature": (60.0, 80.0),
    "pressure": (4.5, 6.0),
    "voltage": (210.0, 230.0),
    "current": (10.0, 20.0),
    "acoustic_emission": (55.0, 75.0),
    "rotation_speed": (1400.0, 1600.0),
    "torque": (130.0, 165.0),
    "power_consumption": (18.0, 28.0),
}
# Live scoring: history kept per machine, and points kept for a browser chart.
LIVE_HISTORY = 100
BROWSER_HISTORY = 30
# Health index: +0.05 per reading once the failure latch is set, kept in [0, 1].
HEALTH_STEP_UP = 0.05
# Model settings.
SEED = 42
TEST_FRACTION = 0.2
RF_PARAMS = dict(numTrees=200, maxDepth=15, minInstancesPerNode=5)
IMPORTANCE_RF_TREES = 100
IMPORTANCE_DEPTH = 15
GBT_PARAMS = dict(maxIter=200, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8")
# The same settings by their meaning, for the library's own tree models (min_split: rows a node needs to be split).
FOREST = dict(trees=200, depth=15, min_split=10, min_leaf=5)
BOOSTING = dict(rounds=200, depth=6, rate=0.1, row_share=0.8, column_share=0.8)
HISTOGRAM_BINS = 30
# Required columns for a telemetry file.
REQUIRED_COLUMNS = ["timestamp", "machine_id", "vibration", "temperature", "pressure", "failure"]
# ---------------------------------------------------------------------------

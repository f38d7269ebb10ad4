"""Stored order: features from the table equal those from the readings, without an exchange of them."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wearcast import schema as S
from wearcast.operators import features as FE
from wearcast.operators import series, stored
from wearcast.sources.tables import fixture_telemetry


def test_no_exchange_of_the_readings(spark, tmp_path):
    df = fixture_telemetry(spark, SF_SMALL)
    df = df.unionByName(df.select(*[(F.lit("BIG") if c == S.KEY else F.col(S.ROW_ID) + 10**6 if c == S.ROW_ID else F.col(c)).alias(c) for c in df.columns]))
    stored.write(df, "stored_test", str(tmp_path / "t"), buckets=4, block_rows=100)
    table = stored.read(spark, "stored_test")
    assert table.where(F.col(S.KEY) == "BIG").select(series.BLOCK).distinct().count() >= 6
    plain = FE.serving_features(df, block_rows=100)
    cols = [S.ROW_ID, *S.ROLLING_FEATURES, *S.STAT_FEATURES]

    def rows(x):
        return {r[S.ROW_ID]: tuple(None if v is None else round(v, 9) for v in r) for r in x.select(*cols).collect()}

    out = FE.serving_features(table, block_rows=100)
    assert rows(out) == rows(plain)
    window = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = FE.serving_features(stored.read(spark, "stored_test"), block_rows=100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", window)
    branch = [line for line in plan.splitlines() if line.startswith(":")]  # the union's first side: all rows but the borders
    assert plan.startswith("Union") and branch and not any("Exchange" in line for line in branch)
    spark.sql("DROP TABLE stored_test")

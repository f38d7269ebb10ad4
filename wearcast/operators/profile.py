"""Data profiling (A1-A10, P2, P19). Global aggregates only: partial aggregation, no big shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wearcast import schema as S
from wearcast.functions.columns import safe_div
from wearcast.operators.quantiles import exact_quantiles, quantile_stats


def dataset_profile(df: DataFrame, key: str = S.KEY, label: str = S.LABEL, time: str = S.TIME) -> DataFrame:
    """A1 + A2 + A3: rows, columns, machines, failures and shares, time range, NULL cells."""
    value_cols = [c for c in df.columns]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in value_cols), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("readings"),
        F.lit(len(df.columns)).alias("columns"),
        F.count_distinct(key).alias("machines"),
        F.sum(label).cast("long").alias("failures"),
        (F.avg(label) * 100.0).alias("failure_pct"),
        F.count_if(F.col(label) == 0).alias("normals"),
        (F.avg(F.when(F.col(label) == 0, 1.0).otherwise(0.0)) * 100.0).alias("normal_pct"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        nulls.alias("null_cells"),
    )


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A3: NULL count per column, long form ``(column, nulls)``."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', n{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (`column`, nulls)")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (S.LABEL, S.ROW_ID)) -> list[str]:
    """Numeric columns of the schema, minus ``exclude`` (the label, and the row id, which is no measurement)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def required_columns(df: DataFrame, required: Sequence[str] = S.REQUIRED_COLUMNS) -> DataFrame:
    """A4: ``(column, present, is_feature, non_null)`` for each required column, from one aggregate over the table."""
    have, numeric = set(df.columns), set(numeric_columns(df))
    entry = [F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"), F.lit(c in numeric).alias("is_feature"),
                      (F.count(c) if c in have else F.lit(0)).cast("long").alias("non_null")) for c in required]
    return df.agg(F.count(F.lit(1)).alias("_n"), F.array(*entry).alias("e")).select(F.explode("e").alias("e")).select("e.*")


def summary_stats(df: DataFrame, cols: Sequence[str] = S.SENSORS, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """A5: describe(): count, mean, sample std, min, exact 25/50/75 % (linear), max; one row per column.

    Two passes over the rows: the moments with the sketches of the quantiles, then
    the exact selection of ``exact_quantiles``. One row a column reaches the driver.
    """
    cols = list(cols)
    m = df.agg(*quantile_stats(cols), *[x for i, c in enumerate(cols) for x in (
        F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}"), F.min(c).cast("double").alias(f"min{i}"), F.max(c).cast("double").alias(f"max{i}"))]).first()
    q = exact_quantiles(df, cols, list(probs), stats=m)
    rows = [(c, m[f"n{i}"], m[f"mean{i}"], m[f"std{i}"], m[f"min{i}"], *[q[(c, p)] for p in probs], m[f"max{i}"]) for i, c in enumerate(cols)]
    names = ", ".join(f"q{int(p * 100)} double" for p in probs)
    return df.sparkSession.createDataFrame(rows, f"feature string, count long, mean double, std double, min double, {names}, max double")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A7 + A8: ``(attribute, value, n, pct)`` of the non-NULL values of each column, most frequent first (ties by value).

    One pass over the rows and one aggregation for all columns; the shares come from a window over the few counts.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in cols])).alias("e")
    n = df.select(cells).select("e.*").where(F.col("value").isNotNull()).groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    pct = safe_div(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy("attribute")))
    return n.withColumn("pct", pct).orderBy("attribute", F.col("n").desc(), "value")


_MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _pair_stats(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson r per (a, b) over pairwise-complete rows; NULL where a side is constant there (no ANSI failure). NaN is missing.

    A batch of readings becomes the moments of all pairs by a few matrix products; a task sends one row a pair, and the
    sums of those are all that is shuffled. Values are taken from a point among the data, so that nothing cancels out.
    """
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    wide = len(cols)
    values = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    sample = values.limit(1000).agg(*[F.coalesce(F.avg(F.when(~F.isnan(f"x{i}"), F.col(f"x{i}"))), F.lit(0.0)) for i in range(wide)]).first()
    point = np.array([v if np.isfinite(v) else 0.0 for v in sample])

    def run(batches):
        total = np.zeros((len(_MOMENTS), wide, wide))
        low, high = np.full((wide, wide), np.inf), np.full((wide, wide), -np.inf)
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(wide)], axis=1)
            known = ~np.isnan(x)
            m, z = known.astype(float), np.where(known, x - point, 0.0)
            sx, sxx = z.T @ m, (z * z).T @ m
            total += np.stack([m.T @ m, sx, sx.T, sxx, sxx.T, z.T @ z])
            for j in range(wide):  # the range of each column where column j is known
                own = np.where(known & known[:, j:j + 1], x, np.nan)
                low[:, j], high[:, j] = np.fmin(low[:, j], np.fmin.reduce(own, axis=0, initial=np.inf)), np.fmax(high[:, j], np.fmax.reduce(own, axis=0, initial=-np.inf))
        i, j = (v.ravel() for v in np.indices((wide, wide)))
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(t.ravel()) for t in total), pa.array(low.ravel()), pa.array(high.ravel())],
                              ["i", "j", *_MOMENTS, "low", "high"])

    schema = "i int, j int, " + ", ".join(f"{c} double" for c in (*_MOMENTS, "low", "high"))
    sums = values.mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _MOMENTS], F.min("low").alias("low"), F.max("high").alias("high"))
    # the range of the right column lies in the mirrored row
    other = sums.select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("high") > F.col("low")).alias("varies_too"))
    both = sums.join(other, ["i", "j"])
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    spread = F.sqrt((F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))) * (F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))))
    varies = F.col("high") > F.col("low")
    names = F.array(*[F.lit(c) for c in cols])
    wanted = F.array(*[F.struct(F.lit(cols.index(a)).alias("i"), F.lit(cols.index(b)).alias("j")) for a, b in pairs])
    return both.where(F.array_contains(wanted, F.struct("i", "j"))).select(
        names[F.col("i")].alias("feature_a"), names[F.col("j")].alias("feature_b"),
        F.when(varies & F.col("varies_too"), F.try_divide(cov, spread)).alias("corr"), F.when(varies, F.lit(1.0)).alias("_self"))


def correlation_matrix(df: DataFrame, cols: Sequence[str] = S.SENSORS + [S.LABEL]) -> DataFrame:
    """Long form ``(feature_a, feature_b, corr)``, all ordered pairs; diagonal 1.0 (NULL for a constant column)."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]] + [(c, c) for c in cols]
    st = _pair_stats(df, pairs)  # one aggregation, one row per pair; mirrored after it
    a, b = F.col("feature_a"), F.col("feature_b")
    mirrored = F.when(a == b, F.array(F.struct(a.alias("feature_a"), b.alias("feature_b"), F.col("_self").alias("corr")))) \
                .otherwise(F.array(F.struct(a.alias("feature_a"), b.alias("feature_b"), F.col("corr").alias("corr")),
                                   F.struct(b.alias("feature_a"), a.alias("feature_b"), F.col("corr").alias("corr"))))
    return st.select(F.explode(mirrored).alias("e")).select("e.*")


def target_correlation(df: DataFrame, cols: Sequence[str] = S.SENSORS, label: str = S.LABEL) -> DataFrame:
    """A10 + P19: correlation of every feature with the label, label itself dropped, descending."""
    st = _pair_stats(df, [(c, label) for c in cols])
    return st.select(F.col("feature_a").alias("feature"), "corr").orderBy(F.col("corr").desc_nulls_last(), F.col("feature"))

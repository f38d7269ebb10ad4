"""Per-machine time-series windows that stay parallel when one machine is huge.

A plain ``Window.partitionBy('machine_id')`` sends every reading of a machine
to one task; a machine holding a third of the data would then be a third of the
job in one task. Here each machine's series is cut into blocks of about
``BLOCK_ROWS`` readings and the window runs per ``(machine, block)``.

Blocks follow from counts. Machines with more readings than a block are cut into
intervals of time, ``FINE`` equal ones for each block they need; an interval that
holds more than half a block is cut again between its own first and last time,
and, once it is a single time (or the readings without one), between its first
and last row id, until each holds half a block at most. A block closes after
``block_rows`` readings of consecutive intervals and takes in a last short one,
so it holds twice that at most, however the readings lie: one clock in 1970,
bursts, equal times and missing times cost a round of counting, not a larger
block. Only readings that are equal in time and id cannot be told apart (nor can
those of one time if ids are not whole numbers). Each
round counts the rows of the intervals it cuts; the counts are written to the
checkpoint folder, and depend on the data alone. Machines that fit a block are
block 0 and join nothing. Readings without a time stand after all others.

Results that need rows from earlier blocks are repaired exactly:

* row frames looking back ``P`` rows: only the first ``P`` rows of a block can
  be wrong, and the last ``P`` rows of the block before hold what they lack (no
  block but a machine's last is shorter). Both meet at the border, ``(machine,
  block)`` again, in a window of at most ``2P`` rows. Machines with one block
  repair nothing.
* running values (forward fill, sequence numbers) carry a per-block summary
  (one row per machine and block) across blocks, then join it back.

Order inside a machine is ``(time, row_id)``, missing times last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wearcast import schema as S
from wearcast.session import pin

BLOCK = "_block"
NEXT = "_next"
LOCAL_RN = "_lrn"
LOCAL_CNT = "_lcnt"
BLOCK_ROWS = 65_536
FINE = 8
BROADCAST_ROWS = 100_000  # of a table of intervals

# A window builder receives an ordered WindowSpec (partition + order, no frame)
# and returns the windowed column, choosing its own frame.
Builder = Callable[[WindowSpec], Column]


def in_order(time: str, row_id: str) -> list[Column]:
    return [F.col(time).asc_nulls_last(), F.col(row_id).asc()]


def _div(value: str, low: str, width: str) -> Column:
    return F.expr(f"(CAST({value} AS DECIMAL(38, 0)) - {low}) div {width}").cast("long")


def _small(table: DataFrame) -> DataFrame:
    """A pinned table of counts, broadcast only if it is short."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _cut(intervals: DataFrame, block_rows: int) -> DataFrame:
    """How intervals of too many readings are cut: on time (``_on`` 0) or id (1), from ``_low`` in steps of ``_width``;
    readings without a time in a mixed interval come after its last step."""
    steps = F.lit(FINE) * F.ceil(F.col("_n") / block_rows)
    on_time = F.coalesce(F.col("_t1") > F.col("_t0"), F.lit(False)) | (F.col("_t0").isNotNull() & (F.col("_nulls") > 0))
    splits = (F.col("_n") * 2 > block_rows) & (on_time | F.coalesce(F.col("_i1") > F.col("_i0"), F.lit(False)))
    low, high = (F.when(on_time, F.col(f"_t{e}")).otherwise(F.col(f"_i{e}")).cast("decimal(38,0)") for e in (0, 1))
    return intervals.where(splits).withColumn("_steps", steps.cast("long")).withColumn("_on", F.when(on_time, 0).otherwise(1)) \
        .withColumn("_low", low).withColumn("_high", high).withColumn("_width", F.expr("(_high - _low) div _steps + 1"))


def _intervals(rows: DataFrame, by: list[str]) -> DataFrame:
    return pin(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_t0"), F.max("_t").alias("_t1"), F.count_if(F.col("_t").isNull()).alias("_nulls"),
                                     F.min("_i").alias("_i0"), F.max("_i").alias("_i1")))


def _place(rows: DataFrame, cut: DataFrame, at: list[str], name: str) -> DataFrame:
    """Add the number of the step that each row falls into (0 where its interval is not cut)."""
    t = cut.select(*[F.col(c).alias(f"_c{c}") for c in at], "_on", "_low", "_width", "_steps")
    on = F.lit(True)
    for c in at:
        on = on & rows[c].eqNullSafe(F.col(f"_c{c}"))
    step = F.when(F.col("_on").isNull(), 0).when(F.col("_on") == 1, _div("_i", "_low", "_width")).when(F.col("_t").isNull(), F.col("_steps")).otherwise(_div("_t", "_low", "_width"))
    return rows.join(t, on, "left").select(*[rows[c] for c in rows.columns], step.cast("long").alias(name))


def with_block(df: DataFrame, key: str = S.KEY, time: str = S.TIME, block_rows: int = BLOCK_ROWS, row_id: str = S.ROW_ID) -> DataFrame:
    """Add the machine's block (0, then increasing) and the number of its next one (NULL in its last); a table that has
    them already (``stored.py``) stays as it is."""
    if BLOCK in df.columns and NEXT in df.columns:
        return df
    whole = isinstance(df.schema[row_id].dataType, T.IntegralType)
    keys = [F.col(key).alias("_k"), F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), (F.col(row_id).cast("long") if whole else F.lit(None).cast("long")).alias("_i")]
    narrow = df.select(*keys)
    large = pin(narrow.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows))
    if not large.take(1):
        return df.select("*", F.lit(0).cast("long").alias(BLOCK), F.lit(None).cast("long").alias(NEXT))
    machines = _small(large.select(F.col("_k").alias("_lk")))
    path, cuts = ["_k"], []
    cut_rows = narrow.join(machines, F.col("_k").eqNullSafe(F.col("_lk")), "left_semi")
    leaves = None  # intervals that stay: machine, steps, count
    found = _intervals(cut_rows, path)
    while True:
        cut = pin(_cut(found, block_rows))
        n_cut = cut.count()
        wide = F.broadcast(cut) if n_cut <= BROADCAST_ROWS else cut
        step = f"_b{len(cuts)}"
        on = [found[c].eqNullSafe(cut[c]) for c in path]
        done = found.join(wide, reduce(Column.__and__, on), "left_anti").select(*path, "_n")
        leaves = done if leaves is None else leaves.unionByName(done, allowMissingColumns=True)
        if not n_cut:
            break
        cuts.append((wide, list(path), step))
        cut_rows = _place(cut_rows, wide, path, step).join(wide.select(*[F.col(c).alias(f"_s{c}") for c in path]), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in path]), "left_semi")
        path = [*path, step]
        found = _intervals(cut_rows, path)

    steps = path[1:]
    leaves = leaves.select("_k", *[F.coalesce(c, F.lit(0)).alias(c) for c in steps], "_n")
    w = Window.partitionBy("_k").orderBy(*steps)
    raw = leaves.withColumn("_raw", F.floor(F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / block_rows).cast("long"))
    sizes = raw.groupBy("_k", "_raw").agg(F.sum("_n").alias("_size"))
    wb = Window.partitionBy("_k").orderBy("_raw")
    # two neighbours are never both short: a short one gives the next the rest of its own range
    merged = sizes.withColumn("_b", F.when((F.col("_size") * 2 < block_rows), F.coalesce(F.lag("_raw").over(wb), F.col("_raw"))).otherwise(F.col("_raw")))
    merged = merged.withColumn("_nb", F.min(F.when(F.col("_b") == F.col("_raw"), F.col("_raw"))).over(wb.rowsBetween(1, Window.unboundedFollowing))) \
        .select(F.col("_k").alias("_mk"), F.col("_raw").alias("_mr"), "_b", "_nb")
    blocks = raw.join(merged, F.col("_k").eqNullSafe(F.col("_mk")) & (F.col("_raw") == F.col("_mr"))) \
        .select(F.col("_k").alias("_bk"), *[F.col(c).alias(f"_l{c}") for c in steps], "_b", "_nb")
    out = df.select("*", *keys)
    for wide, at, step in cuts:
        out = _place(out, wide, at, step)
    on = reduce(Column.__and__, [F.col("_k").eqNullSafe(F.col("_bk")), *[F.col(c) == F.col(f"_l{c}") for c in steps]])
    out = out.join(_small(pin(blocks)), on, "left")
    return out.select(*df.columns, F.coalesce("_b", F.lit(0)).cast("long").alias(BLOCK), F.col("_nb").cast("long").alias(NEXT))


def _local(df: DataFrame, key: str, time: str, row_id: str) -> tuple[DataFrame, WindowSpec]:
    wc = Window.partitionBy(key, BLOCK).orderBy(*in_order(time, row_id))
    out = (df.withColumn(LOCAL_RN, F.row_number().over(wc))
             .withColumn(LOCAL_CNT, F.count(F.lit(1)).over(Window.partitionBy(key, BLOCK))))
    return out, wc


def rolling(df: DataFrame, specs: Sequence[tuple[str, Builder]], lookback: int,
            key: str = S.KEY, time: str = S.TIME, row_id: str = S.ROW_ID, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add windowed columns whose frames reach at most ``lookback`` rows back (and none ahead).

    ``specs`` is a list of ``(name, builder)``; the builder gets the ordered
    window and applies its own ``rowsBetween(-k, j)`` with ``k <= lookback``
    and ``j <= 0``. Results equal ``builder(Window.partitionBy(key).orderBy(time,
    row_id))`` exactly, missing times last.
    """
    names = [n for n, _ in specs]
    base, wc = _local(with_block(df, key, time, max(block_rows, 2 * lookback), row_id), key, time, row_id)
    # All branches start from the same windowed plan, so the (machine, block) shuffle is done once and reused.
    local = base.select("*", *[b(wc).alias(n) for n, b in specs])
    head = (F.col(LOCAL_RN) <= lookback) & (F.col(BLOCK) > 0)
    tail = (F.col(LOCAL_RN) > F.col(LOCAL_CNT) - lookback) & F.col(NEXT).isNotNull()
    # a row may be both; the copy at the next border is context only
    border = F.array_compact(F.array(
        F.when(head, F.struct(F.col(BLOCK).alias("at"), F.lit(True).alias("own"))),
        F.when(tail, F.struct(F.col(NEXT).alias("at"), F.lit(False).alias("own")))))
    edge = local.drop(*names).where(head | tail).select(*df.columns, F.explode(border).alias("_e"))
    wm = Window.partitionBy(key, F.col("_e.at")).orderBy(*in_order(time, row_id))
    repaired = edge.select("*", *[b(wm).alias(n) for n, b in specs]).where("_e.own")
    return local.where(~head).select(*df.columns, *names).unionByName(repaired.select(*df.columns, *names))


def _with_summary(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Join a per-(machine, block) summary to the readings, on the key they are already partitioned by."""
    s = summary.withColumnsRenamed({key: "_sk", BLOCK: "_sb"})
    return rows.join(s, rows[key].eqNullSafe(F.col("_sk")) & (rows[BLOCK] == F.col("_sb")), "left").drop("_sk", "_sb")


def block_offsets(blocked: DataFrame, key: str = S.KEY) -> DataFrame:
    """Per (machine, block): rows in earlier blocks (``_before``) and rows in the machine (``_total``)."""
    counts = blocked.groupBy(key, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy(BLOCK)
    return counts.select(
        key, BLOCK,
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(key)).alias("_total"))


def sequence_number(df: DataFrame, name: str = "seq", total: str | None = None, key: str = S.KEY,
                    time: str = S.TIME, row_id: str = S.ROW_ID, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """1-based position of each reading within its machine; optionally the machine's row count."""
    return sequence_frame(df, name, total, key, time, row_id, block_rows).drop(BLOCK)


def with_machine_values(seq_df: DataFrame, aggs: dict[str, tuple[Column, str]], key: str = S.KEY) -> DataFrame:
    """Attach per-machine aggregates to every reading without joining on the machine key alone.

    ``seq_df`` carries ``BLOCK`` (as returned by ``sequence_frame``). Each
    ``name -> (partial_expr, merge)`` is aggregated per (machine, block) - the
    key the rows are already partitioned by - merged over the machine's blocks
    with a window on that small summary (``merge`` is ``min``/``max``/``sum``),
    and joined back on (machine, block).
    """
    merge_fn = {"min": F.min, "max": F.max, "sum": F.sum}
    part = seq_df.groupBy(key, BLOCK).agg(*[expr.alias(f"_p_{n}") for n, (expr, _) in aggs.items()])
    w = Window.partitionBy(key)
    summary = part.select(key, BLOCK, *[merge_fn[m](f"_p_{n}").over(w).alias(n) for n, (_, m) in aggs.items()])
    return _with_summary(seq_df, summary, key)


def sequence_frame(df: DataFrame, name: str = "seq", total: str | None = None, key: str = S.KEY,
                   time: str = S.TIME, row_id: str = S.ROW_ID, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``sequence_number`` that keeps the ``BLOCK`` column for further per-(machine, block) work."""
    base, _ = _local(with_block(df, key, time, block_rows, row_id), key, time, row_id)
    out = _with_summary(base, block_offsets(base, key), key).withColumn(name, (F.col("_before") + F.col(LOCAL_RN)).cast("long"))
    extra = [F.col("_total").cast("long").alias(total)] if total else []
    return out.select(*[F.col(c) for c in df.columns], F.col(BLOCK), F.col(name), *extra)


def last_n(df: DataFrame, n: int, name: str = "recency", key: str = S.KEY, time: str = S.TIME,
           row_id: str = S.ROW_ID, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The latest ``n`` readings of each machine, ``recency`` 1 = newest (a missing time counts as latest).

    Only blocks with fewer than ``n`` readings in later blocks can contribute
    (found on the per-(machine, block) count summary); each of those keeps its
    own latest ``n`` rows, and only those candidates - O(n) per machine however
    long its history - are ranked per machine.
    """
    blocked = with_block(df, key, time, block_rows, row_id)
    offsets = block_offsets(blocked, key).withColumn("_size", F.coalesce(
        F.lead("_before").over(Window.partitionBy(key).orderBy(BLOCK)), F.col("_total")) - F.col("_before"))
    needed = offsets.where(F.col("_total") - F.col("_before") - F.col("_size") < n).select(F.col(key).alias("_sk"), F.col(BLOCK).alias("_sb"))
    latest = [F.col(time).desc_nulls_first(), F.col(row_id).desc()]
    cand = blocked.join(needed, blocked[key].eqNullSafe(F.col("_sk")) & (blocked[BLOCK] == F.col("_sb")), "left_semi") \
                  .withColumn("_ldr", F.row_number().over(Window.partitionBy(key, BLOCK).orderBy(*latest))) \
                  .where(F.col("_ldr") <= n)
    ranked = cand.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*latest)))
    return ranked.where(F.col(name) <= n).select(*df.columns, name)

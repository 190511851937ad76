"""L1-L3: sorting, top-k and the distributed global rank.

``global_rank`` is the base of every order-dependent statistic (quantiles,
Q-Q points, KS, Shapiro-Wilk, ROC). It never uses an unpartitioned window:

1. range-partition on (group keys, order keys, tie-break) - a hot value is
   split across partitions by the tie-break, so no task holds a third of the
   table;
2. sort inside each partition and tag every row with its partition id and
   position (``monotonically_increasing_id`` minus the partition prefix);
3. pin that placement with a reliable checkpoint: partition ids and
   positions become stored columns, so the counting job, the numbering job
   and any later re-execution (executor loss, a self-join that misses the
   cache) all see the same numbers;
4. count rows per (partition, group) - at most P + G rows - and turn the
   counts into offsets with a window over that small table;
5. join the offsets back (broadcast only after the row count was checked).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabstat.session import materialize

# Largest side table (rows) that is collected and broadcast; above it the
# table is checkpointed and joined with a shuffle.
BROADCAST_ROWS = 200_000

_PID, _POS, _N, _P0, _OFF, _GN = "_ts_pid", "_ts_pos", "_ts_n", "_ts_p0", "_ts_off", "_ts_gn"


def _as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def sort_by(df: DataFrame, cols, ascending: bool | Sequence[bool] = False) -> DataFrame:
    """L1: global sort (range-partitioned by Spark)."""
    return df.orderBy(*_as_list(cols), ascending=ascending)


def head(df: DataFrame, n: int, order_cols, ascending: bool | Sequence[bool] = True) -> DataFrame:
    """L2: first ``n`` rows of a mandatory order (TakeOrderedAndProject)."""
    order = _as_list(order_cols)
    if not order:
        raise ValueError("head needs an order: row order is not defined in Spark")
    return df.orderBy(*order, ascending=ascending).limit(n)


def broadcast_if_small(small: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """Detach a derived side table from its lineage, broadcast it if small.

    The row count is checked first. Up to ``limit`` rows the table is
    rebuilt as a local relation and broadcast; above it the table is
    written to the reliable checkpoint folder and joined with a shuffle.
    Either way the side no longer shares lineage with the frame it is
    joined to, so a self-join never recomputes (and re-samples) it.
    """
    rows = small.limit(limit + 1).collect()
    if len(rows) <= limit:
        local = small.sparkSession.createDataFrame(rows, small.schema)
        return F.broadcast(local), len(rows)
    return materialize(small, "checkpoint"), len(rows)


def global_rank(df: DataFrame, order_cols, by=None, tiebreak=None,
                descending: bool = False, rank_col: str = "rank",
                group_size_col: str | None = None,
                num_partitions: int | None = None,
                pin: str = "checkpoint") -> DataFrame:
    """L3: 1-based row number of each row in a total order, per ``by`` group.

    ``order_cols`` are sorted ascending (or all descending), then
    ``tiebreak`` ascending. Without a tie-break a per-row id of the input is
    used, so equal values still spread across partitions. Equals
    ``row_number() OVER (PARTITION BY by ORDER BY order, tiebreak)``.
    ``group_size_col`` adds the row count of the row's group.
    """
    order = _as_list(order_cols)
    by = _as_list(by)
    tb = _as_list(tiebreak)
    base = df
    drop_tb = False
    if not tb:
        base = base.withColumn("_ts_tb", F.monotonically_increasing_id())
        tb = ["_ts_tb"]
        drop_tb = True
    keys = [F.col(c).asc_nulls_first() for c in by]
    keys += [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]
    keys += [F.col(c).asc_nulls_first() for c in tb]
    # without an explicit count AQE coalesces contiguous range partitions to
    # its advisory size (order is preserved; positions are taken afterwards)
    ranged = base.repartitionByRange(num_partitions, *keys) if num_partitions else base.repartitionByRange(*keys)
    tagged = (ranged
              .sortWithinPartitions(*keys)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_POS, F.monotonically_increasing_id()
                          - F.shiftleft(F.col(_PID).cast("long"), 33)))
    tagged = materialize(tagged, pin)

    counts = tagged.groupBy(_PID, *by).agg(F.count(F.lit(1)).alias(_N), F.min(_POS).alias(_P0))
    before = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(_OFF, F.coalesce(F.sum(_N).over(before), F.lit(0)))
    if group_size_col:
        counts = counts.withColumn(_GN, F.sum(_N).over(Window.partitionBy(*by)))
    small, _ = broadcast_if_small(counts)

    t, c = tagged.alias("_t"), small.alias("_c")
    cond = [F.col(f"_t.{_PID}") == F.col(f"_c.{_PID}")]
    cond += [F.col(f"_t.{k}").eqNullSafe(F.col(f"_c.{k}")) for k in by]
    out_cols = [F.col(f"_t.{x}") for x in df.columns]
    rank = (F.col(f"_c.{_OFF}") + F.col(f"_t.{_POS}") - F.col(f"_c.{_P0}") + 1).alias(rank_col)
    out_cols.append(rank)
    if group_size_col:
        out_cols.append(F.col(f"_c.{_GN}").alias(group_size_col))
    out = t.join(c, on=cond, how="inner").select(*out_cols)
    if drop_tb and "_ts_tb" in out.columns:
        out = out.drop("_ts_tb")
    return out

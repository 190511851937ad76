"""Derived columns, label maps, one-hot, scaling, bins, date parts,
melt, filters, distinct values and bounded point samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabstat.functions.exprs import measured, right_closed_bins

# Largest vocabulary one_hot accepts (each category becomes a column).
MAX_CATEGORIES = 10_000


def derive(df: DataFrame, exprs: Mapping[str, Column | str]) -> DataFrame:
    """Add columns from Column expressions or SQL snippets."""
    return df.withColumns({k: (F.expr(v) if isinstance(v, str) else v) for k, v in exprs.items()})


def map_labels(df: DataFrame, col: str, mapping: Mapping, out: str | None = None,
               strict: bool = False, cast: str = "int") -> DataFrame:
    """Map values through ``mapping``; unknown values -> NULL (or an error)."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    val = F.try_element_at(m, F.col(col))
    if strict:
        val = F.when(F.col(col).isNotNull() & val.isNull(),
                     F.raise_error(F.concat(F.lit(f"unmapped value in {col}: "), F.col(col).cast("string")))
                     ).otherwise(val)
    return df.withColumn(out or col, val.cast(cast))


@dataclass
class OneHotModel:
    """Vocabulary per column (sorted; the first is dropped when drop_first)."""
    categories: dict
    drop_first: bool = True
    sep: str = "_"

    def output_columns(self) -> list[str]:
        out = []
        for c, cats in self.categories.items():
            use = cats[1:] if self.drop_first else cats
            out += [f"{c}{self.sep}{v}" for v in use]
        return out

    def transform(self, df: DataFrame, keep_original: bool = False) -> DataFrame:
        new = {}
        for c, cats in self.categories.items():
            use = cats[1:] if self.drop_first else cats
            for v in use:
                new[f"{c}{self.sep}{v}"] = F.when(F.col(c) == F.lit(v), 1).otherwise(0)
        out = df.withColumns(new) if new else df
        return out if keep_original else out.drop(*self.categories.keys())


def one_hot_fit(df: DataFrame, cols: Sequence[str], drop_first: bool = True,
                max_categories: int = MAX_CATEGORIES) -> OneHotModel:
    """Sorted vocabularies of all ``cols`` in one distinct-aggregate."""
    cols = list(cols)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
                                         for c in cols])).alias("_x")).select("_x.*")
    voc = long.where(F.col("v").isNotNull()).distinct()
    counts = voc.groupBy("k").count().collect()
    too_big = [r["k"] for r in counts if r["count"] > max_categories]
    if too_big:
        raise ValueError(f"one_hot: more than {max_categories} categories in {too_big}")
    rows = voc.collect()
    cats = {c: [] for c in cols}
    for r in rows:
        cats[r["k"]].append(r["v"])
    return OneHotModel({c: sorted(v) for c, v in cats.items()}, drop_first)


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = True) -> DataFrame:
    """One 0/1 column ``col_value`` per category, sorted, first dropped."""
    return one_hot_fit(df, cols, drop_first).transform(df)


@dataclass
class ScaleModel:
    """Per-column affine map x -> (x - shift) / scale."""
    shift: dict
    scale: dict

    def transform(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        cols = list(cols or self.shift.keys())
        return df.withColumns({c: (F.col(c) - F.lit(self.shift[c])) / F.lit(self.scale[c]) for c in cols})

    def inverse(self, col: Column | str, name: str) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return c * F.lit(self.scale[name]) + F.lit(self.shift[name])


def minmax_fit(df: DataFrame, cols: Sequence[str]) -> ScaleModel:
    row = df.agg(*[F.min(measured(c)).alias(f"{c}__lo") for c in cols], *[F.max(measured(c)).alias(f"{c}__hi") for c in cols]).first()
    shift, scale = {}, {}
    for c in cols:
        lo, hi = row[f"{c}__lo"], row[f"{c}__hi"]
        shift[c] = float(lo) if lo is not None else 0.0
        rng = (hi - lo) if lo is not None else 0.0
        scale[c] = float(rng) if rng else 1.0  # constant column maps to 0
    return ScaleModel(shift, scale)


def minmax_scale(train: DataFrame, test: DataFrame | None, cols: Sequence[str]):
    """P5: fit min/max on train (NaN counts as missing and stays NaN), apply to
    train and test."""
    m = minmax_fit(train, cols)
    return m.transform(train, cols), (m.transform(test, cols) if test is not None else None), m


def standard_fit(df: DataFrame, cols: Sequence[str]) -> ScaleModel:
    """Mean and *population* std (the reference's scaler), zero std -> 1; NaN
    counts as missing and stays NaN when scaled."""
    row = df.agg(*[F.avg(measured(c)).alias(f"{c}__m") for c in cols], *[F.stddev_pop(measured(c)).alias(f"{c}__s") for c in cols]).first()
    shift = {c: float(row[f"{c}__m"] or 0.0) for c in cols}
    scale = {c: (float(row[f"{c}__s"]) if row[f"{c}__s"] else 1.0) for c in cols}
    return ScaleModel(shift, scale)


def standard_scale(train: DataFrame, test: DataFrame | None, cols: Sequence[str]):
    """Z-score with population std fitted on train."""
    m = standard_fit(train, cols)
    return m.transform(train, cols), (m.transform(test, cols) if test is not None else None), m


@dataclass
class ArrayScaleModel:
    """Element-wise affine map of an array column: (x - shift) / scale."""
    shift: list
    scale: list

    def column(self, col: str) -> Column:
        sh = F.array(*[F.lit(float(v)) for v in self.shift])
        sc = F.array(*[F.lit(float(v)) for v in self.scale])
        centred = F.zip_with(F.col(col).cast("array<double>"), sh, lambda x, m: x - m)
        return F.zip_with(centred, sc, lambda d, s: d / s)

    def transform(self, df: DataFrame, col: str, out: str | None = None) -> DataFrame:
        return df.withColumn(out or col, self.column(col))


def standard_fit_array(df: DataFrame, col: str) -> ArrayScaleModel:
    """P6 for an array/vector column: mean and population std per element
    from one ``Summarizer`` aggregate (vector buffers, no per-element
    columns)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(F.col(col).cast("array<double>"))
    row = df.select(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")).first()["s"]
    n = int(row["count"])
    mean = row["mean"].toArray()
    var = row["variance"].toArray() * ((n - 1) / n if n > 0 else 0.0)
    std = [float(x) ** 0.5 if x > 0 else 1.0 for x in var]
    return ArrayScaleModel([float(m) for m in mean], std)


def bin_labels(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str] | None,
               out: str = "bin") -> DataFrame:
    """Right-closed interval labels (lowest edge included, outside -> NULL)."""
    return df.withColumn(out, right_closed_bins(col, edges, labels))


def date_parts(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Parsed date plus month, year and year as text."""
    d = F.to_date(F.col(col))
    return df.withColumns({
        f"{prefix}date": d,
        f"{prefix}month": F.month(d).cast("long"),
        f"{prefix}year": F.year(d).cast("long"),
        f"{prefix}year_str": F.year(d).cast("string"),
    })


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "measurement",
         val: str = "value") -> DataFrame:
    """Wide -> long (ids..., measurement, value); values cast to double."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return wide.unpivot(list(ids), list(values), var, val)


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    """P10: equality predicate (pushed to the scan by Catalyst)."""
    return df.where(F.col(col) == F.lit(value))


def filter_range(df: DataFrame, col: Column | str, lo, hi) -> DataFrame:
    """P10: inclusive range predicate."""
    c = F.col(col) if isinstance(col, str) else col
    return df.where(c.between(F.lit(lo), F.lit(hi)))


def filter_years(df: DataFrame, col: str, first: int, last: int) -> DataFrame:
    """P10: inclusive calendar-year range as a half-open range on the raw
    column, so the predicate reaches the Parquet scan (``year(col)`` cannot
    be pushed down)."""
    t = dict(df.dtypes)[col]
    lo = F.lit(f"{int(first):04d}-01-01").cast(t)
    hi = F.lit(f"{int(last) + 1:04d}-01-01").cast(t)
    return df.where((F.col(col) >= lo) & (F.col(col) < hi))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Unique values of one column."""
    return df.select(col).distinct()


def sample_unit(key: Column | str, seed: int) -> Column:
    """Portable hash of an integer key to [0, 1): same value in any SQL engine.

    u = ((key mod 2^31-1) · 2654435761 + seed · 40503) mod 2^32 / 2^32.
    """
    k = F.col(key) if isinstance(key, str) else key
    mixed = F.pmod(k.cast("long"), F.lit(2147483647)) * F.lit(2654435761) + F.lit(seed * 40503)
    return F.pmod(mixed, F.lit(4294967296)).cast("double") / F.lit(4294967296.0)


def sample_unit_sql(key_sql: str, seed: int) -> str:
    k = f"((({key_sql}) % 2147483647 + 2147483647) % 2147483647)"
    return f"(((({k} * 2654435761 + {seed * 40503}) % 4294967296) + 4294967296) % 4294967296) / 4294967296.0"


def point_sample(df: DataFrame, cols: Sequence[str], key: str, fraction: float, seed: int = 1729,
                 by: Sequence[str] = ()) -> DataFrame:
    """Raw points for scatter/pair/strip plots, a share of each group.

    A row is kept when the portable hash of its key is below ``fraction``,
    so the sample does not depend on partitioning and every group keeps the
    same share; its size grows with the input. ``bounded_points`` has a bound.
    """
    return df.where(sample_unit(key, seed) < F.lit(float(fraction))).select(key, *by, *cols)


#: Partial samples of a group that meet in one task at the last merge.
MERGE = 32


def _least(groups: int, most: int):
    """Keeps the ``most`` least rows by (_u, _k, _h) of each group, the first
    ``groups`` columns, of what a task reads: the partial of a bottom-m
    aggregate. It holds at most that many rows and a batch."""

    def cut(table: pa.Table) -> pa.Table:
        code = np.zeros(len(table), np.int64)
        for c in range(groups):
            own = table.column(c).combine_chunks().dictionary_encode("encode")
            code = np.unique(np.stack([code, own.indices.to_numpy(zero_copy_only=False)]), axis=1, return_inverse=True)[1].ravel()
        order = np.lexsort([*(table.column(c).to_numpy() for c in ("_h", "_k", "_u")), code])
        own = code[order]
        start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
        return table.take(pa.array(order[place < most]))

    def run(batches):
        kept = None
        for batch in batches:
            if batch.num_rows:
                own = cut(pa.Table.from_batches([batch]))
                kept = own if kept is None else cut(pa.concat_tables([kept, own]).combine_chunks())
        if kept is not None:
            yield from kept.combine_chunks().to_batches()
    return run


def bounded_points(df: DataFrame, cols: Sequence[str], key: str, most: int, seed: int = 1729,
                   by: Sequence[str] = (), unit: Column | None = None) -> DataFrame:
    """At most ``most`` raw points of each group, for plots.

    A group keeps its ``most`` rows of least (portable hash of the integer key,
    key), all rows if it has fewer: a uniform sample without replacement, the
    same at any partitioning. It is a mergeable aggregate: every task keeps the
    ``most`` least rows of each group it reads and sends only these; the
    partials are merged MERGE at a time and then by group, so a group of any
    size never meets in one task.

    Null is a group of ``by``; rows whose key is null come in no sample; rows of
    equal keys count each and are ordered by a hash of their columns. Output:
    key, by, cols, and ``n``, the number of rows with a key in the group.
    ``unit`` is another number to order by, such as a hash whose order differs
    more between seeds (the portable one is shifted by the seed).
    """
    names = list(dict.fromkeys([*by, key, *cols]))
    rows = df.where(F.col(key).isNotNull()).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *names)
    groups = [f"_g{i}" for i in range(len(by))]
    ranked = rows.withColumns({"_u": sample_unit(key, seed) if unit is None else unit.cast("double"), "_k": F.col(key).cast("long"), "_h": F.xxhash64(*names)})
    partial = ranked.mapInArrow(_least(len(by), most), ranked.schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
    merged = partial.repartition(*groups, "_part").drop("_part").mapInArrow(_least(len(by), most), ranked.schema)
    order = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_u", "_k", "_h")
    kept = merged.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(f"_p.{c}").eqNullSafe(F.col(f"_s.{c}")) for c in groups] or [F.lit(True)]
    return kept.alias("_p").join(F.broadcast(sizes).alias("_s") if not by else sizes.alias("_s"), same).select(*[F.col(f"_p.{c}") for c in names], "n")

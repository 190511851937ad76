"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The missing-value tokens of pandas.read_csv defaults, which the
# reference relies on when it loads its CSV.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             na_tokens: list[str] | None = None) -> DataFrame:
    """Header CSV with pandas' NA tokens mapped to NULL.

    Columns are read as strings (no inference pass over the data), every NA
    token becomes NULL, then values are cast to ``schema``. Without a schema
    the strings are kept; pass an explicit schema in production.
    """
    tokens = PANDAS_NA_TOKENS if na_tokens is None else na_tokens
    raw = (spark.read.option("header", True).option("mode", "FAILFAST")
           .option("nullValue", None).csv(path))
    if schema is not None:
        names = [f.name for f in schema.fields]
        missing = [n for n in names if n not in raw.columns]
        if missing:
            raise ValueError(f"CSV lacks columns {missing}")
    cols = []
    for c in raw.columns:
        v = F.when(F.col(c).isin(tokens), F.lit(None)).otherwise(F.col(c))
        if schema is not None and c in schema.fieldNames():
            dtype = schema[c].dataType
            v = v.cast(dtype)
            if isinstance(dtype, (T.FloatType, T.DoubleType)):
                v = F.when(F.isnan(v), F.lit(None)).otherwise(v)
        cols.append(v.alias(c))
    return raw.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV (no index column)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def numeric_columns(df: DataFrame, exclude: list[str] | tuple = (),
                    sort: bool | None = None) -> list[str]:
    """Names of numeric columns minus ``exclude``.

    Like a pandas column-index difference, the names come back sorted when
    something was excluded; otherwise in schema order (``sort`` overrides).
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    ex = set(exclude)
    names = [n for n in names if n not in ex]
    if sort is None:
        sort = bool(exclude)
    return sorted(names) if sort else names


def select_numeric(df: DataFrame, exclude: list[str] | tuple = (),
                   sort: bool | None = None) -> DataFrame:
    """S3: project the numeric columns minus ``exclude``."""
    return df.select(*numeric_columns(df, exclude, sort))

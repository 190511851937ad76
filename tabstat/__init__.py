"""tabstat: tabular statistics and model comparison on Spark.

Every public operator takes a DataFrame plus column names and returns a
DataFrame (or a small fitted object whose results are DataFrames). The core
work runs as Spark jobs: aggregates, range-partitioned ranks, joins against
size-checked small tables, and Arrow-batched numpy blocks where a closed
Spark expression does not exist.

Layout
------
sources    reading and writing tables (CSV / parquet), numeric projection
functions  Column expressions (normal cdf / quantile, bins, Box-Cox) and
           driver-side scalar special functions (t, F, chi-square tails)
operators  the operators: clean, features, rank, profile, normality,
           matrix, regress, sample, neighbors, evaluate, models, pruning
plans      end-to-end compositions (classification comparison, regression
           comparison) and the query registry on the test tables
"""

from tabstat.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"

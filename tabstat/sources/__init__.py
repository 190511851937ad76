from tabstat.sources.io import (  # noqa: F401
    numeric_columns,
    read_csv,
    read_table,
    select_numeric,
    write_csv,
    write_parquet,
)

"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstat.session import checkpoint_dir, ship_package

#: Arrow batches of whole texts: rows and bytes a Python worker holds at once.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and bound Arrow batches of whole texts."""
    ship_package(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared checkpoint folder, lineage cut.

    The folder is the one the session names in ``spark.checkpoint.dir``, so
    every executor sees the files and a lost executor loses none of them. The
    table lives in the session's own checkpoint sub-folder and goes with it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column of an Arrow batch, null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def int_lists(rows: list, kind: pa.DataType) -> pa.Array:
    """Rows of integers (lists, arrays, or bytes of that kind) as one Arrow
    array without a Python object per item."""
    import numpy as np

    dtype = np.dtype(kind.to_pandas_dtype())
    rows = [np.frombuffer(r, dtype) if isinstance(r, bytes) else np.asarray(r, dtype) for r in rows]
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
    flat = pa.array(np.concatenate(rows) if rows else np.empty(0, dtype), kind)
    if ends[-1] >= 2 ** 31:
        return pa.LargeListArray.from_arrays(pa.array(ends), flat).cast(pa.list_(kind))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)


def split_units(text: str) -> list[str]:
    """Cut a text at places where the byte-level pre-tokenisation pattern
    always cuts, such that each unit alone gets the tokens it has in the text.

    * Before a space that a non-space character follows: such a space opens a
      pre-token (``' ?X+'``), and a run of white space before it ends where it
      would end at the end of a text.
    * Between a letter and one final punctuation mark.
    * Around a single newline between two other characters.

    A repeated unit need be encoded only once.
    """
    parts = text.split(" ")
    units: list[str] = []
    _words(parts[0], units)
    for part in parts[1:]:
        if part.isalpha():
            units.append(" " + part)
        elif part and not part[0].isspace():
            _words(" " + part, units)
        elif units:  # a longer run of white space stays with the unit before it
            units[-1] += " " + part
        else:
            units.append(" " + part)
    return units


def _words(part: str, units: list[str]) -> None:
    """Append the units of a piece of text without inner spaces."""
    if "\n" in part:
        lines = part.split("\n")
        if all(line and not line[0].isspace() and not line[-1].isspace() for line in lines[1:]) and (not lines[0] or not lines[0][-1].isspace()) and lines[0]:
            for k, line in enumerate(lines):
                if k:
                    units.append("\n")
                _words(line, units)
            return
    if part and part[-1] in ",.;:!?" and part[-2:-1].isalpha():
        units.append(part[:-1])
        units.append(part[-1])
    else:
        units.append(part)


class UnitCache:
    """Token ids of short units, kept between the batches of a worker.

    ``encode_many`` encodes a list of texts. Ids are kept as little-endian
    32-bit bytes, so a row's ids are one join. The cache has two generations
    of at most ``limit`` units; what is used again moves to the new one when
    the old one goes. Memory stays bounded; results do not depend on what it
    holds.
    """

    def __init__(self, encode_many, limit: int = 400_000, longest: int = 48):
        self.encode_many, self.limit, self.longest = encode_many, limit, longest
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def packed(self, rows: list[list[str]]) -> list[bytes]:
        """Ids of each row of units."""
        if len(self.known) > self.limit:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        found = [list(map(known.get, row)) for row in rows]
        gaps = [(row, own, _gaps(own)) for row, own in zip(rows, found) if None in own]
        new, long = [], []
        for u in {row[i] for row, _, at in gaps for i in at}:
            v = old.get(u)
            if v is not None:
                known[u] = v
            else:
                (new if len(u) <= self.longest else long).append(u)
        for units in (new, long):
            known.update(zip(units, (array("I", ids).tobytes() for ids in self.encode_many(units))))
        for row, own, at in gaps:
            for i in at:
                own[i] = known[row[i]]
        for u in long:
            del known[u]
        return [b"".join(own) for own in found]


def _gaps(values: list) -> list[int]:
    """Places of None."""
    out, at = [], -1
    for _ in range(values.count(None)):
        at = values.index(None, at + 1)
        out.append(at)
    return out


def in_groups(rows: list, most: int = 2 << 20, size=len) -> Iterator[list]:
    """Consecutive rows whose sizes add up to about ``most`` (one row at least)."""
    group, total = [], 0
    for row in rows:
        group.append(row)
        total += size(row)
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group

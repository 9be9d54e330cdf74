"""Helpers shared by the training-data operators.

Every operator selects the columns that it needs under internal names first, so further columns of the input, whatever
their names, neither clash nor travel.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.session import checkpoint, shared_dir, stored  # noqa: F401  operators take them from here

#: A word: a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_of(column: str) -> Column:
    """A text column as a string that is never null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """df's whole row as one struct ``row`` beside further columns, so that no column name of df can clash with ours.

    ``select("row.*")`` gives the rows back.
    """
    return df.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in columns.items()))


NULL_ID = -(1 << 63)


class Ranges:
    """Consecutive ranges of (id, tie), nulls first, found from approximate quantiles of the ids alone.

    An id that fills several ranges is divided among them by its ties (signed 64-bit hashes), so that a hot one spreads. One
    number for each range is held by the driver and sent to the tasks.
    """

    def __init__(self, rows: DataFrame, id_col: str, parts: int):
        key = F.coalesce(F.col(id_col), F.lit(NULL_ID))
        shares = [i / parts for i in range(1, parts)]
        cuts = rows.select(F.percentile_approx(key, shares, min(20 * parts, 1_000_000)).alias("c")).head()[0] if parts > 1 else []
        self.cuts = sorted(cuts or [])

    def of(self, ids, ties):
        """The number of each row's range, from arrays of ids (NULL_ID for null) and ties."""
        import numpy as np

        if not isinstance(self.cuts, np.ndarray):
            self.cuts = np.array(self.cuts, np.int64)
        below, equal = np.searchsorted(self.cuts, ids, "left"), np.searchsorted(self.cuts, ids, "right")
        spread = (np.asarray(ties, np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # in the order of the signed ties
        own = (spread * (equal - below).astype(np.uint64)) >> np.uint64(32)
        return np.where(equal > below, below + 1 + own.astype(np.int64), below)


def id_array(column: pa.Array):
    """A long column as an array, with NULL_ID for null."""
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def narrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are wide: hold Arrow batches to this many rows, so that a Python worker's memory stays bounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


_kept: dict = {}


def kept(key, make: Callable):
    """In a Python worker: what make() gives, for all tasks, until another operator keeps something there.

    So the caches of one operator at a time take memory.
    """
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """In a Python worker: drop what kept() holds and give its memory back. Operators that keep nothing call it in their
    tasks, since workers live on from one operator to the next."""
    if _kept:
        _kept.clear()
        gc.collect()  # caches refer to their owners
        pa.default_memory_pool().release_unused()


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    narrow_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


class Memo(dict):
    """A bounded cache: values come from make(key); once ``most`` entries are held they become the old generation, from
    which a later use takes them over. Keys longer than ``longest`` are not kept."""

    def __init__(self, make: Callable, most: int = 300_000, longest: int = 64, known: dict | None = None):
        super().__init__(known or {})
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def map_rows(df: DataFrame, schema: str, columns: pa.Schema, make: Callable[[], Callable[[list[list]], list]]) -> DataFrame:
    """Arrow map: make() runs once per task and returns a function from the input columns (lists) to the output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                got = each([c.to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(got, columns, strict=True)], schema=columns)

    return df.mapInArrow(run, schema)

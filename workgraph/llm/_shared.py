"""Small helpers the operators share: written tables that cut lineage, ASCII words and column naming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters that part words: \x20 and \x09-\x0D (fixed by the contract of the word-based operators).
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. Where the session names none, a temporary one is set in local mode (tests), and a
    cluster is an error: a folder of one machine would lose rows there."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="workgraph-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends here and Spark knows the table's size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark removes an action's shuffle files when the action ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like names that df does not use, whatever the letter case."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(c, UPPER, LOWER)


def strip_white(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def word_array(text: Column) -> Column:
    """The words of a text; a null or blank text has none."""
    bare = strip_white(text)
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))


def n_words(text: Column) -> Column:
    """How many words a text has (null: 0), without building them."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def with_columns(df: DataFrame, new: dict[str, str], inputs: list[str], make: Callable[..., list[pa.Array]], rows: int = 256, size: int = 2 << 20) -> DataFrame:
    """df with columns of the types in new, last, that make computes in Python from so many rows' inputs at a time.

    Arrow batches are cut into pieces of so many rows or bytes of inputs, and each piece's result goes back before the next
    is made: memory follows the piece, or one row, and not the batch. make gets the inputs as Arrow arrays and returns an
    Arrow array for each new column. Columns of df named as a new one are replaced.
    """
    named = {n.lower() for n in new}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in named]
    schema = T.StructType([*[df.schema.fields[i] for i in kept], *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in new.items())).fields])
    arrow = [to_arrow_type(schema[n].dataType) for n in new]
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in pieces([batch.column(i) for i in at], rows, size):
                part = batch.slice(start, n)
                made = [a.cast(t) for a, t in zip(make(*[part.column(i) for i in at]), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *made], schema.names)

    return df.mapInArrow(run, schema)


def pieces(columns: list[pa.Array], rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive pieces of so many rows, or bytes of text, at most; a longer row is one by itself."""
    total = len(columns[0])
    weight = np.zeros(total, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            weight += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(weight)])
    start = 0
    while start < total:
        end = min(start + rows, int(np.searchsorted(upto, upto[start] + size, "right")) - 1, total)
        end = max(end, start + 1)
        yield start, end - start
        start = end


def int_lists(rows: list[np.ndarray | None]) -> pa.Array:
    """Arrays of ints, or nulls, as one Arrow list array."""
    n = [0 if x is None else len(x) for x in rows]
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    full = [x for x in rows if x is not None]
    values = pa.array(np.concatenate(full) if full else np.zeros(0, np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([x is None for x in rows]))

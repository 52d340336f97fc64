"""Prefix scans by key over tables of any size, whose tasks see a range of rows and never all rows of a key.

Rows are range-partitioned by key and order; each part of a key leaves one summary row; the summaries before a part are its
offset; then each part is scanned alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

PART, AT = "_part", "_at"


def spread(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df range-partitioned by keys and order, sorted and written, with the number of each row's part and its place in order.
    Rows that are equal in all of them share a part."""
    names = [*keys, *order]
    out = df.repartitionByRange(parts, *names) if parts else df.repartitionByRange(*names)
    out = written(out.sortWithinPartitions(*names).withColumn(AT, F.monotonically_increasing_id()))
    return out.withColumn(PART, F.shiftright(AT, 33))


def scan(rows: DataFrame, keys: list[str], new: dict[str, tuple[str, Column]]) -> DataFrame:
    """Spread rows with new columns, each a running sum or max ('sum', 'max') of a column up to and with its row, or the value
    of the row before ('before'), or the last value so far that is not null ('last'), in order within its keys; null keys are a
    key. Sums of no number are null.

    The window and the join stand on (part, keys), so a key has as many tasks as parts. A summary row stands for all rows
    of a key in a part; only the summaries of one key meet in a task.
    """
    place = Window.partitionBy(PART, *keys).orderBy(AT)
    upto = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    local = {"sum": lambda c: F.sum(c).over(upto), "max": lambda c: F.max(c).over(upto), "before": lambda c: F.lag(c).over(place), "last": lambda c: F.last(c, True).over(upto)}
    total = {"sum": F.sum, "max": F.max, "before": lambda c: F.max_by(c, AT), "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(AT)))}
    prior = {"sum": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before), "before": lambda c: F.lag(c).over(Window.partitionBy(*keys).orderBy(PART)), "last": lambda c: F.last(c, True).over(before)}
    joined = {
        "sum": lambda a, b: F.coalesce(a + F.coalesce(b, F.lit(0)), a, b), "max": lambda a, b: F.greatest(a, b),
        "before": lambda a, b: F.when(F.col("_first"), b).otherwise(a), "last": lambda a, b: F.coalesce(a, b),
    }
    own = {f"_l{i}": local[how](c) for i, (how, c) in enumerate(new.values())}
    scanned = rows.withColumns(own | {"_first": F.row_number().over(place) == 1})
    sums = rows.groupBy(PART, *keys).agg(*[total[how](c).alias(f"_t{i}") for i, (how, c) in enumerate(new.values())])
    offsets = sums.select(F.col(PART).alias("_p"), *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *[prior[how](F.col(f"_t{i}")).alias(f"_o{i}") for i, (how, _) in enumerate(new.values())])
    same = scanned[PART] == offsets["_p"]
    for j, k in enumerate(keys):
        same = same & scanned[k].eqNullSafe(offsets[f"_k{j}"])
    out = scanned.join(offsets, same)
    return out.select(*[c for c in rows.columns if c not in new], *[joined[how](F.col(f"_l{i}"), F.col(f"_o{i}")).alias(n) for i, (n, (how, _)) in enumerate(new.items())])

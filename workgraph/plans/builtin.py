"""Plans made of the operators: what a run takes, in which batches, and where rejects go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import registry

#: The built-in plan's selector, batch size and route.
MATCH = {"status": ["NOT_STARTED"], "sort": {"by": "size", "order": "asc"}, "limit": 100}
BATCH, SMALL = 5, 128
SOFT_FLAGS = r"\b(stub|TODO|FIXME|unk\w*)\b"


def match_plan(items: DataFrame, status: DataFrame | None = None, workflow: str = "", done: list[str] | None = None, scope: dict | None = None) -> DataFrame:
    """The built-in plan: the smallest items not started, in batches, each with its route."""
    chosen = registry.open_items(items, status, workflow, done or [], MATCH, scope) if status is not None else registry.apply_scope(registry.select_items(items, MATCH), scope or {})
    rank = chosen.withColumn("pos", F.concat(F.lpad(F.coalesce("size", F.lit(-1)).cast("string"), 20, "0"), "id"))
    return registry.batches(rank, BATCH, None).drop("pos").withColumn("route", F.when(F.col("size") < SMALL, "small"))


def verify(items: DataFrame, verifier: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """items as a verifier judges them. A verifier is a function from items to the same rows with accepted (boolean), and
    with status and evidence where it has them; registry.diff_verdict is the built-in one. No verdict is a rejection.
    A verifier that gives no accepted column, or another type, is an error."""
    out = verifier(items)
    if "accepted" not in out.columns or out.schema["accepted"].dataType.typeName() != "boolean":
        raise ValueError("a verifier gives a boolean column accepted")
    rest = {c: F.lit(None).cast("string") for c in ("status", "evidence") if c not in out.columns}
    return out.withColumns({"accepted": F.coalesce("accepted", F.lit(False))} | rest)


def soft_flags(text: Column) -> Column:
    """Markers of unfinished work in a reply, in order; a flag never rejects."""
    return F.regexp_extract_all(text, F.lit(SOFT_FLAGS), 1)

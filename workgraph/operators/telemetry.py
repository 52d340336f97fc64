"""Runs, events, spans, spend, budgets and pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .scans import scan, spread


def list_runs(runs: DataFrame, status: list[str] | None = None, pipeline: str | None = None, model: str | None = None) -> DataFrame:
    keep = F.lit(True)
    if status:
        keep = keep & F.col("status").isin(status)
    if pipeline is not None:
        keep = keep & (F.col("pipeline") == pipeline)
    if model is not None:
        keep = keep & (F.col("model") == model)
    return runs.filter(keep).orderBy("created_at", "id")


def read_events(df: DataFrame, run: str | None = None, item: str | None = None, type: str | None = None, after: int = 0, limit: int = 1000) -> DataFrame:
    """Events after a cursor in ascending order, at most limit of them (10,000 at most)."""
    keep = F.col("seq") > after
    for column, value in (("run_id", run), ("work_item_id", item), ("type", type)):
        if value is not None:
            keep = keep & (F.col(column) == value)
    return df.filter(keep).orderBy("seq").limit(max(1, min(limit, 10_000)))


def run_spans(spans: DataFrame, run: str) -> DataFrame:
    return spans.filter(F.col("run_id") == run).withColumn("attrs", F.coalesce(F.try_parse_json("attrs"), F.parse_json(F.lit("{}")))).withColumn("seconds", F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")).orderBy("started_at", "id")


def latest_transcript(artifacts: DataFrame) -> DataFrame:
    """The newest transcript of each (run, worker); the worker is meta's workerId, else worker_seq."""
    worker = F.coalesce(F.get_json_object("meta", "$.workerId"), F.col("worker_seq").cast("string"))
    rank = F.row_number().over(Window.partitionBy("run_id", "worker").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    return artifacts.filter("kind = 'transcript'").withColumn("worker", worker).withColumn("_r", rank).filter("_r = 1").drop("_r")


def turn_cost(usage: DataFrame, models: DataFrame) -> DataFrame:
    """usage with cost_micro_usd, rounded half up, and unknown_model; an unknown model has no cost."""
    m = models.select(F.col("name").alias("_name"), "p_in", "p_out", "p_cr", "p_cw")
    out = usage.join(m, usage["model"] == F.col("_name"), "left")
    cost = F.col("input_tok") * F.col("p_in") + F.col("output_tok") * F.col("p_out") + F.col("cache_read") * F.col("p_cr") + F.col("cache_write") * F.col("p_cw")
    return out.withColumn("cost_micro_usd", F.floor(cost + 0.5).cast("long")).withColumn("unknown_model", F.col("_name").isNull()).drop("_name", "p_in", "p_out", "p_cr", "p_cw")


def affordable(runs: DataFrame, models: DataFrame, input_tok: int = 100_000, output_tok: int = 20_000) -> DataFrame:
    """runs (model, spent, cap) with estimate and ok: whether the next turn's estimate still fits under the cap."""
    asked = runs.withColumns({"input_tok": F.lit(input_tok), "output_tok": F.lit(output_tok), "cache_read": F.lit(0), "cache_write": F.lit(0)})
    out = turn_cost(asked, models).withColumnRenamed("cost_micro_usd", "estimate").drop("input_tok", "output_tok", "cache_read", "cache_write")
    return out.withColumn("ok", F.coalesce(F.col("cap").isNull() | (F.col("spent") + F.col("estimate") <= F.col("cap")), F.lit(False)))


def count_where(condition: str):
    return F.sum(F.expr(condition).cast("long"))


def global_metrics(runs: DataFrame, events: DataFrame, spans: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row of counters; each table is read once, and single rows are put side by side."""
    n = lambda c: F.coalesce(count_where(c), F.lit(0))
    r = runs.agg(F.count("*").alias("runs"), n("status in ('queued','running')").alias("active"), n("status = 'done'").alias("done"), n("status = 'failed'").alias("failed"), n("status = 'cancelled'").alias("cancelled"))
    for df, name, c in ((events, "events", "true"), (spans, "spans", "true"), (proposals, "open_proposals", "status = 'open'")):
        r = r.join(df.agg(n(c).alias(name)))
    return r


def run_metrics(runs: DataFrame, events: DataFrame, spans: DataFrame, usage: DataFrame) -> DataFrame:
    """(run_id, events, spans, items, cost_micro_usd) for each run; each table is summed by run before the join."""
    out = runs.select(F.col("id").alias("run_id"))
    parts = [events.groupBy("run_id").agg(F.count("*").alias("events"), F.count_distinct("work_item_id").alias("items")), spans.groupBy("run_id").agg(F.count("*").alias("spans")), usage.groupBy("run_id").agg(F.sum("cost_micro_usd").alias("cost_micro_usd"))]
    for p in parts:
        out = out.join(p, "run_id", "left")
    return out.select("run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "spans", "items", "cost_micro_usd")])


def spend(audit: DataFrame) -> DataFrame:
    """(actor, spent) with the total under a null actor; nothing spent is 0."""
    return audit.rollup("actor").agg(F.coalesce(F.sum("cost_micro_usd"), F.lit(0)).alias("spent"))


def run_gate(requests: DataFrame, tokens: DataFrame, audit: DataFrame, global_cap: int | None = None) -> DataFrame:
    """requests (id, token, pipeline, budget) with refusal: null, or the first of unauthorized, allowlist, exhausted, global, budget."""
    spent = audit.groupBy(F.col("actor").alias("token")).agg(F.sum("cost_micro_usd").alias("_spent"))
    t = tokens.filter("revoked_at is null").select(F.col("id").alias("token"), F.col("cap").alias("_cap"), F.col("allow").alias("_allow"), F.lit(True).alias("_known"))
    out = requests.join(t.join(spent, "token", "left"), "token", "left").join(audit.agg(F.coalesce(F.sum("cost_micro_usd"), F.lit(0)).alias("_all")))
    why = F.when(F.col("_known").isNull(), "unauthorized").when((F.size("_allow") > 0) & ~F.array_contains("_allow", F.col("pipeline")), "allowlist").when(F.coalesce("_spent", F.lit(0)) > F.col("_cap"), "exhausted")
    if global_cap is not None:
        why = why.when(F.col("_all") > global_cap, "global").when(F.col("budget").isNull(), "budget")
    return out.withColumn("refusal", why).select(*requests.columns, "refusal")


def event_head(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("events"), F.coalesce(F.max("seq"), F.lit(0)).alias("head"))


def budget_crossing(costs: DataFrame, caps: DataFrame, parts: int | None = None) -> DataFrame:
    """The first turn of each run whose running spend is strictly over the run's cap, with that spend. A run's turns may fill
    many tasks: spends are scanned in parts, and the first turn is a partial minimum."""
    spent = scan(spread(costs, ["run_id"], ["ts", "id"], parts), ["run_id"], {"spent": ("sum", F.col("cost_micro_usd"))})
    over = spent.join(caps.select("run_id", "cap"), "run_id").filter(F.col("spent") > F.col("cap"))
    first = over.groupBy("run_id").agg(F.min_by(F.struct("id", "spent", "cap"), F.struct("ts", "id")).alias("x"))
    return first.select("run_id", "x.id", "x.spent", "x.cap")


def pacing(log: DataFrame, models: DataFrame, parts: int | None = None) -> DataFrame:
    """log (id, model, t in ms) with release_ms, the earliest time at one request per 60000 / rpm ms and model, and
    too_soon: closer to the one before than that. rpm of 0 or less is unlimited. With rows counted from 0,
    release(i) = max over j <= i of (t(j) - j * gap) + i * gap: a running count, and then a running maximum, each scanned
    in parts of a model's log."""
    m = models.select(F.col("name").alias("_name"), F.when(F.col("rpm") > 0, 60000.0 / F.col("rpm")).otherwise(0.0).alias("gap"))
    rows = spread(log.join(m, log["model"] == F.col("_name")).drop("_name"), ["model"], ["t", "id"], parts)
    out = scan(rows, ["model"], {"_n": ("sum", F.lit(1)), "_was": ("before", F.col("t"))}).withColumn("_i", F.col("_n") - 1)
    out = scan(out, ["model"], {"_most": ("max", F.col("t") - F.col("_i") * F.col("gap"))})
    return out.select(*log.columns, "gap", (F.col("_most") + F.col("_i") * F.col("gap")).alias("release_ms"), F.coalesce(F.col("t") - F.col("_was") < F.col("gap"), F.lit(False)).alias("too_soon"))


def assign_seq(df: DataFrame, base: int, order: list[str]) -> DataFrame:
    """df with seq base + 1 ... base + n in the given order. Rows are range-partitioned and written; counts per partition
    become offsets, so no task sees all rows."""
    spread = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = spread.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return spread.join(offsets, part == F.col("_part")).withColumn("seq", base + 1 + F.col("_before") + place).drop("_at", "_part", "_before")

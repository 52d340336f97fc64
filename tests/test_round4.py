"""Operators whose intermediate rows or groups grew faster than their input, held against small plain answers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from workgraph.operators import binary, declarations, registry
from workgraph.streaming import jobs, keyed


def most_rows(df, metric: str = "numOutputRows") -> int:
    """The most that a metric of any step of df's plan counts when it is run."""
    df.collect()

    def walk(node) -> int:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        m = node.metrics()
        own = m.apply(metric).value() if m.contains(metric) else 0
        kids = node.children()
        return max([own, *(walk(kids.apply(i)) for i in range(kids.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_name_of_many_definitions_meets_a_word_once(spark):
    n = 300
    lines = spark.createDataFrame([(f"p{k}", 2, "f(); g();") for k in range(n)] + [(f"p{k}", 1, "int f() {") for k in range(n)], "path string, line_no int, raw string")
    defs = spark.createDataFrame([("f", k + 1, f"p{k}", 1) for k in range(n)] + [("g", 0, "p0", 9)], "name string, ord int, path string, line_no int")
    hits = binary.plan_call_sites(lines, defs)
    assert sorted(map(tuple, hits.collect())) == sorted((f"p{k}", 2, "g") for k in range(n))
    assert most_rows(hits) <= 5 * n


def test_a_conversion_plan_gathers_no_class(spark):
    files = spark.createDataFrame([(f"p{k}", 'extern "C" void f(CGame* self);\nvoid f(CGame* self) {\n  ((CGame*)self)->x = 1;\n}\nint a = f(0);') for k in range(3)], "path string, text string")
    symbols = spark.createDataFrame([(2, "m__11CGameFv"), (1, "b__Q24game5CGameFv"), (3, "x__5OtherFv")], "ordinal int, name string")
    plan = declarations.conversion_plan(files, symbols)
    rows = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
    assert not [c for d in plan for c, kind in d.dtypes if kind.startswith(("array", "map"))]
    assert rows(plan.hits, "class", "path", "line_no", "kind") == sorted(("CGame", f"p{k}", n, kind) for k in range(3) for n, kind in ((1, "decl"), (2, "def-selfcast")))
    assert rows(plan.members, "class", "ordinal", "name") == [("CGame", 1, "b__Q24game5CGameFv"), ("CGame", 2, "m__11CGameFv")]
    assert rows(plan.renames, "name", "target") == [("m__11CGameFv", "m__5CGameFv")]
    assert rows(plan.targets, "path", "target") == [(f"p{k}", "f__Q24game5CGameFv") for k in range(3)]
    assert rows(plan.call_sites, "path", "line_no", "name") == sorted((f"p{k}", n, "f") for k in range(3) for n in (1, 5))
    assert rows(plan.sites(), "class", "n_sites") == [("CGame", 6)]


def test_changes_of_a_unit_are_not_shuffled_with_its_items(spark):
    log = spark.createDataFrame([("w", "u", "", seq, "ab"[seq % 2]) for seq in range(1, 101)], "workflow_id string, unit_id string, target_id string, seq long, status string")
    items = spark.createDataFrame([(f"i{k}", "u") for k in range(200)], "id string, unit_id string")
    got = registry.status_changes(log, items)
    assert got.count() == 100 * 200
    assert most_rows(got.filter("seq < 101"), "shuffleRecordsWritten") <= 5000


def test_edges_are_merged_without_a_join(spark):
    e = lambda rows: spark.createDataFrame(rows, "from_id string, to_id string, kind string")
    got = registry.merge_edges(e([("a", "b", None), ("a", "c", "calls"), ("a", "c", "calls")]), e([("d", None, "calls"), ("x", "y", "calls")]), e([("a", "b", None), ("x", "y", "calls")]))
    assert sorted(map(str, got.collect())) == sorted(map(str, e([("a", "c", "calls"), ("d", None, "calls")]).collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_drift_examines_only_files_that_name_a_symbol(spark):
    insns = spark.createDataFrame([(f"g{k}", "other", k, "li", "r3, 2") for k in range(500)] + [("f", "func_80000010", 0, "lwz", "r4, 0x10(r3)")], "file string, fn string, idx long, mnemonic string, operands string")
    symbols = spark.createDataFrame([(1, "func_80000010")], "ordinal long, name string")
    lines = spark.createDataFrame([("h", 1, "static void func_80000010(int a, int b);")], "path string, line_no int, raw string")
    got = binary.header_drift(lines, symbols, insns)
    assert [r.drift for r in got.collect()] == ["header 2 params, binary 1"]
    assert most_rows(got, "shuffleRecordsWritten") < 100


# --- streams whose keys share buckets ---


def test_many_keys_share_few_states(spark, tmp_path):
    rows = spark.range(6000).select(F.concat(F.lit("run"), F.col("id") % 3000).alias("run_id"), "id", F.lit(3).cast("long").alias("cost_micro_usd"))
    rows.write.parquet(f"{tmp_path}/costs")
    stream = jobs.spend_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/costs"), 5)
    q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet", outputMode="append")
    q.awaitTermination()
    assert max(sum(o.numRowsTotal for o in p.stateOperators) for p in q.recentProgress) <= keyed.BUCKETS
    assert sorted((r.run_id, r.id, r.spent) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted((f"run{i}", i + 3000, 6) for i in range(3000))


def test_a_unit_of_many_items_fires_once_and_not_if_one_is_rejected_in_the_batch(spark, tmp_path):
    shape = "pipeline string, unit_id string, work_item_id string, n_items int, accepted boolean"
    more = jobs.HELD_ITEMS + 200
    batches = [[("p", "u", f"i{k}", more, True) for k in range(more - 1)] + [("p", "v", "i", 1, True)] + [("p", "w", f"i{k}", 300, True) for k in range(300)] + [("p", "v", "i", 1, False), ("p", "w", None, 300, False)], [("p", "u", "i7", more, True), ("p", "u", "i8", more, True)], [("p", "u", "last", more, True), ("p", "w", "i", 300, True)], [("p", "u", "last", more, True)]]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = []
        for rows in batches:
            spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
            src = spark.readStream.schema(shape).parquet(f"{tmp_path}/log")
            jobs.unit_complete(src).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet", outputMode="append").awaitTermination()
            found.append([tuple(r) for r in spark.read.schema("pipeline string, unit_id string").parquet(f"{tmp_path}/out").collect()])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert found == [[], [], [("p", "u")], [("p", "u")]]


def test_resolved_changes_come_from_a_stream_of_scope_changes(spark, tmp_path):
    shape = "workflow_id string, unit_id string, target_id string, seq long, status string"
    rng = random.Random(9)
    scopes = [("u", ""), ("u", ""), ("", "a"), ("u", "a"), ("v", "b"), ("v", ""), ("", "b"), (None, "c")]
    rows = [("w", *rng.choice(scopes), seq, rng.choice(["S", "T", None])) for seq in range(200)]
    items = spark.createDataFrame([("a", "u"), ("d", "u"), ("b", "v"), ("c", None)], "id string, unit_id string")
    for some in (rows[:90], rows[90:]):
        spark.createDataFrame(some, shape).write.mode("append").parquet(f"{tmp_path}/log")
        stream = jobs.scope_change_stream(spark.readStream.schema(shape).parquet(f"{tmp_path}/log"))
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet", outputMode="append").awaitTermination()
    kept = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    log = spark.createDataFrame(rows, shape)
    assert kept.count() < len(rows)
    assert sorted(map(str, registry.status_changes(kept, items).collect())) == sorted(map(str, registry.status_changes(log, items).collect()))

"""Findings of round 3, third session."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from workgraph import tables
from workgraph.operators import lint, registry
from workgraph.sources import readers, sinks

ITEMS = "id string, kind string, status string, lifecycle string"


def test_tasks_of_a_snapshot_are_bounded_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    before = {n: spark.conf.get(n, None) for n in ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    items = spark.range(1000).select(F.lpad("id", 4, "0").alias("id"), F.lit("function").alias("kind"), F.lit("NEW").alias("status"), F.lit("pending").alias("lifecycle"))
    deps = items.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("calls").alias("kind"))
    caps = items.select(F.col("id").alias("work_item_id"), F.lit("c").alias("capability"))
    sinks.export_registry(items, deps, caps, str(tmp_path / "snapshot"))
    for name, key in zip(sinks.SNAPSHOT, ("id", "from_id", "work_item_id"), strict=True):
        files = sorted((tmp_path / "snapshot" / name).glob("*.parquet"))
        got = [[r[0] for r in spark.read.parquet(str(f)).select(key).collect()] for f in files]
        assert sum(got, []) == [f"{i:04}" for i in range(1000)] and max(map(len, got)) < 150
    assert before == {n: spark.conf.get(n, None) for n in before}
    assert [d.count() for d in sinks.import_registry(spark, str(tmp_path / "snapshot"))] == [1000, 1000, 1000]


def test_violations_are_the_same_in_parts(spark):
    items = spark.createDataFrame([("a", "f", "s", "pending"), ("a", "f", "s", "pending"), ("b", "f", "", "no"), (None, "f", "s", "pending")], ITEMS)
    deps = spark.createDataFrame([("a", "b", "calls"), ("a", "x", "calls"), ("y", None, "none")], "from_id string, to_id string, kind string")
    caps = spark.createDataFrame([("a", "c"), ("z", "c")], "work_item_id string, capability string")
    want = [("dangling_capability", "z"), ("dangling_from_id", "y"), ("dangling_to_id", None), ("dangling_to_id", "x"), ("duplicate_id", "a"), ("edge_kind", "none"), ("lifecycle", "b"), ("missing_id", None), ("missing_status", "b")]
    for parts in (None, 7):
        got = [tuple(r) for r in registry.registry_violations(items, deps, caps, parts).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_a_listing_is_dealt_once(spark):
    rng, rows = random.Random(5), []
    for file in ("a", "b", None):
        rows += [(file, i, rng.choice([".fn f, global", "  .fn g", ".endfn f", ".fn", "note", *["/* 0000000A 00000000  38 60 00 01 */\tli r3, 1 // x"] * 5])) for i in range(400)]
    want, fn, n = [], {}, {}
    for file, _, line in rows:
        if line.strip().startswith(".fn "):
            fn[file] = line.strip()[4]
        elif line.startswith(".endfn"):
            fn[file] = ""
        elif line.startswith("/*") and fn.get(file):
            n[file] = n.get(file, -1) + 1
            want.append((file, fn[file], n[file], 10, "38 60 00 01", "li", "r3, 1"))
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    lines = spark.createDataFrame(rows, "file string, pos long, line string").mapInPandas(counted, "file string, pos long, line string")
    for block, parts in ((7, 3), (1 << 16, None)):
        seen.value = 0
        got = [tuple(r) for r in readers.parse_listing(lines, parts, block).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and seen.value == len(rows)


def test_ascii_is_not_shown_to_the_class_of_unsafe_characters(spark):
    lines = spark.createDataFrame([("a.c", 1, "plain"), ("a.c", 2, "x é y é z \U0001f600 ß"), ("a.c", 3, "表 ok"), ("a.c", 4, None)], "path string, line_no int, raw string")
    found = lint.lint_delta(lines)
    assert [(r.line_no, r.rule, r.message.count("é"), r.message.count("\U0001f600"), r.message.count("ß")) for r in found.collect()] == [(2, "non_sjis_char", 1, 1, 1)]
    assert "[\\x00-\\x7F]+" in found._jdf.queryExecution().toString()  # stripped before the class is tried

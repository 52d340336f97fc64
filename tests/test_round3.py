"""Linkage statements, canonical names, as-of status changes, rules as data, scans in parts, splits of files, the log's heads."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from workgraph.functions import scalars
from workgraph.operators import binary, declarations, lint, registry, scans, telemetry
from workgraph.sources import readers
from workgraph.streaming import jobs

# --- C linkage ---


def read(text):
    return [x[:4] for x in declarations.statements(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('extern "C" __declspec(section ".init") void f1(int a);', [(1, "decl", '__declspec(section ".init") void f1(int a);', "f1")]),
        ('extern "C" void f2(int a,\nint b);', [(1, "decl", "void f2(int a, int b);", "f2")]),
        ('extern "C" void f2(int a\nint b);', []),
        ('extern "C" void f2(int a\n  , int b);', [(1, "decl", "void f2(int a , int b);", "f2")]),
        ('/* extern "C" int a;\n extern "C" int b; */ extern "C" int c;', [(2, "decl", "int c;", "c")]),
        ('extern "C" struct T { int x; };', []),
        ('extern "C" int f(CGame* self) { // }\n  return 1; /* } */\n}\nextern "C" int g;', [(1, "def", "int f(CGame* self)", "f"), (4, "decl", "int g;", "g")]),
        ('extern "C" {\n int a;\n void f(int x,\n  int y);\n int h() { return 1; }\n int k()\n {\n  int no;\n }\n typedef int T;\n int e = 3;\n}\nint out;\nextern "C" int b[4];', [(2, "decl", "int a;", "a"), (3, "decl", "void f(int x, int y);", "f"), (14, "decl", "int b[4];", "b")]),
        ('extern "C" void (*cb)(int);', [(1, "decl", "void (*cb)(int);", "cb")]),
        ('extern "C" void (CGame::*m)(int);', [(1, "decl", "void (CGame::*m)(int);", "m")]),
        ('extern "C" void f(int) __attribute__((noreturn));', [(1, "decl", "void f(int) __attribute__((noreturn));", "f")]),
        ('extern "C" int x = 3;', [(1, "decl", "int x = 3;", None)]),
        ('extern "C" int f() { char c = \'}\'; const char* s = "{//"; return c; } int after;', [(1, "def", "int f()", "f")]),
        ('extern "C" int open(int a) { if (a) {', [(1, "def", "int open(int a)", "open")]),
        ("", []),
    ],
)
def test_statements(text, want):
    assert read(text) == want


def test_bodies_without_comments(spark):
    files = spark.createDataFrame([("a.cpp", "int f(int a) {\n  // }\n  g(); /* { */\n}\nint after(int b) { return 1; }\n")], "path string, text string")
    assert [(r.line_no, r.name, r.body.count("\n")) for r in declarations.extract_defs(files).collect()] == [(1, "f", 3), (5, "after", 0)]


# --- mangled names ---


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("m1__5CGameFv", None), ("m1__11CGameFv", "m1__5CGameFv"), ("__ct__5CGameFv", None), ("__ct__11CGameFPc", "__ct__5CGameFPc"), ("__dt__Q24game5CGameFv", None), ("__dt__Q24game9CGameFv", "__dt__Q24game5CGameFv"),
        ("m__11CGameFi", None), ("m__11CGameFv@12", None), ("__800B0AF4", None), ("func_80001234", None), ("a__1b__44CPlayerFv", "a__1b__7CPlayerFv"), ("x__Q15CGameFv", None), ("plain", None), (None, None), ("m__0CGameFv", None),
    ],
)
def test_canonical_names(spark, name, want):
    d = spark.createDataFrame([(name,)], "name string").withColumn("m", scalars.split_name(F.col("name")))
    assert d.select(scalars.canonical_name(F.col("name"), F.col("m"))).first()[0] == want


def test_split_mangled():
    assert scalars.mangled_parts("@a@m__5CGameFv@instance") | {"scope": 0} == {"member": "@a@m", "class": "CGame", "namespaces": [], "scope": 0, "ctor": False, "dtor": False, "params": "v"}
    assert scalars.mangled_parts("__ct__Q34game2ui5CMenuFi")["scope"] == ["game", "ui", "CMenu"]
    assert scalars.split_mangled("m__5CGame")["params"] is None and scalars.split_mangled("m__9CGame") is None


def test_hint_of_members(spark):
    d = spark.createDataFrame([(1, "a", "void a(CGame* self, int b)"), (2, "b", "void b(int a, CGame* self)"), (3, "c", "void c(void * _this)"), (4, "d__x", "int d"), (5, None, None)], "ord long, name string, decl string")
    s = spark.createDataFrame([(1, "q", 5)], "ordinal long, name string, address_key long")
    assert {r.ord: r.hint for r in binary.classify_decls(d, s, s.select("name")).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}


# --- status changes ---


def test_status_changes_of_three_scopes(spark):
    rng = random.Random(28)
    log = [("w", rng.choice(("", "u1", "u2", "u3")), rng.choice(("", "a", "b", "c", "d")), seq, rng.choice(("S", "T"))) for seq in range(400)]
    log = [r for r in log if r[1] or r[2]]
    log.sort(key=lambda r: r[3])
    given = [("a", "u1"), ("z", "u3"), ("b", "u2"), ("lone", None)]
    items = {(u or "", i) for i, u in given} | {r[1:3] for r in log if r[1] and r[2]}
    held, want = {}, []
    resolve = lambda u, i: held.get((u, i)) or held.get(("", i)) or held.get((u, ""))
    for _, u, i, seq, status in log:
        before = {x: resolve(*x) for x in items}
        held[u, i] = status
        want += [(*x, seq, before[x], resolve(*x)) for x in items if before[x] != resolve(*x)]
    d = spark.createDataFrame(log, "workflow_id string, unit_id string, target_id string, seq long, status string")
    got = registry.status_changes(d.repartition(5), spark.createDataFrame(given, "id string, unit_id string"))
    order = lambda r: tuple(map(str, r))
    assert sorted([tuple(r)[1:] for r in got.collect()], key=order) == sorted(want, key=order)
    assert registry.status_changes(d.limit(0)).count() == 0


def test_edges_with_nulls(spark):
    e = lambda rows: spark.createDataFrame(rows, "from_id string, to_id string, kind string")
    now, add, gone = e([("a", None, "calls"), ("b", "c", "calls"), ("b", "c", "calls")]), e([("x", "y", None), ("b", "c", "calls")]), e([("a", None, "calls"), ("no", "no", "no")])
    assert sorted(map(str, registry.merge_edges(now, add, gone).collect())) == sorted(map(str, e([("x", "y", None), ("b", "c", "calls")]).collect()))
    assert tuple(registry.edge_changes(now, add, gone).first()) == (1, 1)
    after = registry.merge_edges(now, add, gone)
    assert tuple(registry.edge_changes(after, add, gone).first()) == (0, 0)


# --- rules as data ---


def test_rule_table(spark):
    files = spark.createDataFrame([("a.c", "int x; // goto\n goto  out;"), ("b.cpp", "goto a; goto b;")], "path string, text string")
    rules = spark.createDataFrame(
        [(1, "go", r"\bgoto\s+\w+;", "code", None, "{rule} at {path}:{line}:{column}: {snippet}"), (2, "raw", "goto", "raw", r"\.c$", None), (3, "bad", "(", "code", None, None), (4, "badpath", "x", "code", "[", None), (5, "null", None, "code", None, None)],
        "ord long, id string, pattern string, on string, path_filter string, message string",
    )
    got = lambda **k: sorted((r.path, r.line_no, r.rule, r.column_no, r.message) for r in lint.rule_findings(lint.lines(files), rules, **k).collect())
    want = [("a.c", 1, "raw", 11, "raw: int x; // goto"), ("a.c", 2, "go", 2, "go at a.c:2:2: goto out;"), ("a.c", 2, "raw", 2, "raw: goto out;"), ("b.cpp", 1, "go", 1, "go at b.cpp:1:1: goto a; goto b;")]
    assert got() == want and got(at_once=1) == want and got(only=["go"]) == [w for w in want if w[2] == "go"] and got(only=["none"]) == []
    assert sorted(map(tuple, lint.rule_problems(rules, ["go", "none"]).collect())) == [("none", "unknown-rule")]
    assert sorted(map(tuple, lint.rule_problems(rules).collect())) == [("bad", "bad-pattern"), ("badpath", "bad-path-filter")]


def test_gate_messages(spark):
    added = spark.createDataFrame([("a.cpp", 1, "☃x☃ é☺ \U0001f600"), ("a.cpp", 2, "#include <vector>"), ("a.c", 3, 'extern "C" void f();')], "path string, line_no int, raw string")
    got = {(r.line_no, r.rule_ord): r.message for r in lint.lint_delta(added).collect()}
    assert got[1, 1] == "character(s) with no Shift-JIS encoding (will fail the build): ☃é☺\U0001f600 — replace with ASCII or valid SJIS"
    assert got[2, 10] == "angle include <vector> is not whitelisted" and got[3, 2].startswith("`extern") and got[3, 8] == 'extern "C" is only allowed for lbl_* reloc names'
    assert len(lint.GATE_MESSAGES) == 22


def test_spans_equal_the_plain_way():
    rng = random.Random(12)
    for _ in range(300):
        held, plain = lint.Spans(), []
        for _ in range(40):
            a = rng.randrange(60)
            b = a + rng.randrange(6)
            fits = all(b <= x or y <= a for x, y in plain)
            assert held.add(a, b) == fits
            plain += [(a, b)] * fits
        assert held.starts == sorted(held.starts) and len(held.starts) == len(plain)


# --- scans ---


def test_scans_equal_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(("hot", "hot", "hot", "b", None)), i // 3, i, rng.choice((None, rng.randrange(-9, 9)))) for i in range(900)]
    d = spark.createDataFrame(rows, "k string, t long, id long, v long")
    w = Window.partitionBy("k").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = d.select("k", "id", F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"), F.lag("v").over(w).alias("b"), F.last("v", True).over(upto).alias("l"), F.row_number().over(w).cast("long").alias("n"))
    want = sorted(map(str, want.collect()))
    for parts in (1, 3, 40):
        spread = scans.spread(d.repartition(7), ["k"], ["t", "id"], parts)
        got = scans.scan(spread, ["k"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "b": ("before", F.col("v")), "l": ("last", F.col("v")), "n": ("sum", F.lit(1))})
        assert sorted(map(str, got.select("k", "id", "s", "m", "b", "l", "n").collect())) == want
    assert spread.filter("k = 'hot'").select(scans.PART).distinct().count() > 10  # one key in many tasks


def test_scanned_operators_in_parts(spark):
    rng = random.Random(9)
    log = spark.createDataFrame([(i, "m", rng.randrange(20000)) for i in range(300)], "id long, model string, t long")
    models = spark.createDataFrame([("m", 900.0)], "name string, rpm double")
    want, last, at = {}, None, None
    for i, _, t in sorted(map(tuple, log.collect()), key=lambda r: (r[2], r[0])):
        at = t if at is None else max(t, at + 60000 / 900)
        want[i] = (pytest.approx(at), last is not None and t - last < 60000 / 900)
        last = t
    assert {r.id: (r.release_ms, r.too_soon) for r in telemetry.pacing(log, models, 9).collect()} == want
    costs = spark.createDataFrame([("r", i, i // 2, 10) for i in range(200)] + [("q", 1, 1, 5)], "run_id string, id long, ts long, cost_micro_usd long")
    caps = spark.createDataFrame([("r", 505), ("q", 5)], "run_id string, cap long")
    assert [tuple(r) for r in telemetry.budget_crossing(costs, caps, 11).collect()] == [("r", 50, 510, 505)]
    items = spark.createDataFrame([(i, None if i % 3 else "u", i) for i in range(50)], "id long, unit_id string, pos long")
    got = {r.id: (r.grp, r.batch) for r in registry.batches(items, 4, parts=6).collect()}
    assert got == {i: (2, (i - i // 3 - 1) // 4) if i % 3 else (1, i // 3 // 4) for i in range(50)}


# --- files in splits ---


def test_lines_of_split_files(spark, tmp_path):
    rng = random.Random(7)
    lines = {}
    for name in ("a.s", "b.s"):
        rows = []
        for i in range(400):
            rows.append(rng.choice((f".fn f{i}, global", ".endfn", "", "// note", f"/* {i:08X} {i:08X}  38 60 00 0{i % 9} */\tli r3, {i}", "x" * 50)))
        lines[name] = rows
        (tmp_path / name).write_text("\n".join(rows), encoding="utf-8", newline="")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = readers.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        seen = sorted((r.ordinal, r.file.rsplit("/", 1)[-1], r.pos, r.line) for r in got.collect())
        want = [(k, n, p, x) for k, (n, p, x) in enumerate((n, p, x) for n in ("a.s", "b.s") for p, x in enumerate(lines[n]))]
        assert seen == want
        listed = {}
        for r in readers.read_listing(spark, str(tmp_path)).collect():
            listed[r.file.rsplit("/", 1)[-1], r.idx] = (r.fn, r.operands)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {}
    for name, rows in lines.items():
        fn, idx = "", 0
        for x in rows:
            if x.startswith(".fn"):
                fn = x[4:].split(",")[0]
            elif x == ".endfn":
                fn = ""
            elif x.startswith("/*") and fn:
                want[name, idx] = (fn, x.split("\tli ")[1])
                idx += 1
    assert listed == want


# --- the appended log ---


def test_append_goes_on_after_a_failed_write(spark, tmp_path):
    source, log = f"{tmp_path}/in", f"{tmp_path}/log"
    put = lambda lo, hi: spark.range(lo, hi).withColumnRenamed("id", "event").coalesce(1).write.mode("append").parquet(source)
    run = lambda: jobs.append_events(spark.readStream.schema("event long").parquet(source), log, ["event"], f"{log}-state", availableNow=True).awaitTermination()
    put(0, 5)
    run()
    put(5, 8)
    run()
    # the second batch has written its head and half of its events when its task is lost: it runs again
    import shutil

    shutil.rmtree(f"{log}/batch=0000000001")
    (tmp_path / "log-state" / "commits" / "1").unlink()
    for p in (tmp_path / "log-state" / "commits").glob(".1.crc"):
        p.unlink()
    put(8, 9)
    run()
    got = spark.read.parquet(log)
    assert sorted((r.event, r.seq) for r in got.collect()) == [(i, i + 1) for i in range(9)]
    assert [spark.read.parquet(f"{log}/_heads/{k:010d}").first().head for k in range(3)] == [5, 8, 9]


# --- keyed streams ---


class Blocks(dict):
    """A map state in memory."""

    updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__  # noqa: N815


def test_pieces_of_a_key_are_merged():
    import pandas as pd

    from workgraph.streaming.keyed import Sorter

    rng = random.Random(1)
    for sizes in ((5,), (7, 3), (40, 1, 33, 90), (10, 10, 10)):
        seqs = rng.sample(range(10_000), sum(sizes))
        frames, at = [], 0
        for n in sizes:
            frames.append(pd.DataFrame({"seq": seqs[at : at + n], "v": [str(x) for x in seqs[at : at + n]]}))
            at += n
        blocks = Blocks()
        out = list(Sorter(blocks, "seq", 8).sorted(iter(frames)))
        assert [x for f in out for x in f["seq"].tolist()] == sorted(seqs) and all(str(a) == b for f in out for a, b in zip(f["seq"], f["v"], strict=True))
        assert not blocks and (len(sizes) == 1 or max(map(len, out)) <= 8 * len(sizes))
    assert list(Sorter(Blocks(), "seq").sorted(iter([]))) == []


def test_stream_of_a_hot_key_equals_its_twin(spark, tmp_path):
    rng = random.Random(33)
    rows = [("w", "u", rng.choice("aaaab"), seq, rng.choice("xyz")) for seq in range(3000)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "workflow_id string, unit_id string, target_id string, seq long, status string")
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    costs = log.select("seq", F.col("target_id").alias("run_id"), F.lit(3).cast("long").alias("cost_micro_usd")).withColumnRenamed("seq", "id")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        src = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
        got = drain(spark, jobs.status_change_stream(src), tmp_path / "changes")
        spent = drain(spark, jobs.spend_stream(src.select(F.col("seq").alias("id"), F.col("target_id").alias("run_id"), F.lit(3).cast("long").alias("cost_micro_usd")), 700), tmp_path / "spent")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(map(str, got.collect())) == sorted(map(str, registry.status_changes(log).collect()))
    caps = costs.select("run_id").distinct().withColumn("cap", F.lit(700).cast("long"))
    assert sorted((r.run_id, r.id, r.spent) for r in spent.collect()) == sorted((r.run_id, r.id, r.spent) for r in telemetry.budget_crossing(costs.withColumn("ts", F.col("id")), caps).collect())


def drain(spark, stream, folder):
    stream.writeStream.option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start(str(folder), format="parquet", outputMode="append").awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(folder))


def test_status_stream_follows_three_scopes(spark, tmp_path):
    shape = "workflow_id string, unit_id string, target_id string, seq long, status string"
    items = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", None)], "id string, unit_id string")
    batches = [[("w", "u", "", 1, "S")], [("w", "", "a", 2, "S"), ("w", "u", "", 3, "T")], [("w", "u", "a", 4, "V"), ("w", "", "a", 5, "X"), ("w", "", "c", 6, "Y"), ("w", "u", "b", 7, "T")]]
    every = []
    for rows in batches:
        every += rows
        spark.createDataFrame(rows, shape).write.mode("append").parquet(f"{tmp_path}/log")
        got = drain(spark, jobs.status_change_stream(spark.readStream.schema(shape).parquet(f"{tmp_path}/log"), items=items), tmp_path / "out")
    want = registry.status_changes(spark.createDataFrame(every, shape), items)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5


def test_a_timer_sweeps_leases(spark, tmp_path):
    import time

    shape = "op_seq long, work_item_id string, owner string, epoch string, op string, ttl_ms long"
    rows = spark.createDataFrame([(1, "i", "r:1", "e", "claim", 1500), (2, "j", "r:1", "e", "claim", 10**9)], shape).withColumn("ts", F.current_timestamp())
    rows.write.parquet(f"{tmp_path}/ops")
    src = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/ops")
    q = jobs.lease_stream(src, sweep=True).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start(f"{tmp_path}/out", format="parquet", outputMode="append")
    try:
        for _ in range(90):
            time.sleep(1)
            found = [(r.work_item_id, r.op, r.owner, r.ok) for r in spark.read.schema("work_item_id string, op_seq long, op string, owner string, ok boolean").parquet(f"{tmp_path}/out").collect()] if list(tmp_path.glob("out/*.parquet")) else []
            if any(op == "sweep" for _, op, *_ in found):
                break
    finally:
        q.stop()
    assert sorted(found) == [("i", "claim", "r:1", True), ("i", "sweep", "r:1", True), ("j", "claim", "r:1", True)]


# --- large JSON files ---


def test_json_files_are_split_between_entries(spark, tmp_path):
    import json

    items = [{"id": f"i{k}", "kind": "f", "status": "S", "meta": 'a \\" } ] {', "x": {"y": [1, {"z": 2}]}} for k in range(4)]
    a, b, c, d = map(json.dumps, items)
    texts = {
        "pretty": (json.dumps({"version": 1, "workItems": items, "other": [{"id": "no"}]}, indent=1), 4, 4), "bare": (json.dumps(items, indent=2), 4, 4), "a line each": (f"[\n{a},\n{b},\n\n{c}\n]\n", 3, 3), "commas in front": (f"[\n{a}\n, {b}\n,\n{c}\n]", 3, None),
        "one line": (json.dumps({"workItems": items}), 4, 1), "shared lines": (f'{{"workItems": [\n{a}, {b}\n, {c}]}}', 3, 1), "last shares": (f"[\n{a},\n{b}]", 2, 1), "first shares": (f"[{a},\n{b}\n]", 2, 1), "key below": (f'{{\n"workItems": [\n{a}\n],\n"more": {{"workItems": [\n{d}\n]}}\n}}', 1, 1),
        "broken": (f"[\n{a},\n", 0, 1), "closed twice": (f"[\n{a}\n]]", None, 1), "none": (json.dumps({"workItems": []}, indent=1), 0, 1), "empty": ("", 0, None),
    }
    for name, (text, want, entries) in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
        path = str(tmp_path / f"{name}.json")
        if want is not None:
            assert sorted(r.id for r in readers.read_registry(spark, path).collect()) == [f"i{k}" for k in range(want)], name
        if entries is not None:
            assert readers.json_entries(spark, path, None if text.startswith("[") else "workItems").count() == entries, name
    (tmp_path / "map.json").write_text(json.dumps({"entries": {f"u{k}": {"s": {"retail_symbol": f"n{k % 3}"}} for k in range(6)}}, indent=1), encoding="utf-8")
    assert readers.json_entries(spark, str(tmp_path / "map.json"), "entries").count() == 6
    assert sorted(r.name for r in readers.read_reloc_names(spark, str(tmp_path / "map.json")).collect()) == ["n0", "n1", "n2"]

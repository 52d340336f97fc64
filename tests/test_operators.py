"""Registry, lint, listing and stream operators on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from workgraph.functions import scalars
from workgraph.operators import binary, declarations, lint, registry, telemetry
from workgraph.plans import builtin
from workgraph.sources import readers, sinks
from workgraph.streaming import jobs

ITEM = "id string, kind string, status string, unit_id string, lifecycle string, region string, symbol string, address string, size long, attempts long, exhausted boolean, ready boolean, meta string, updated_at string"


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        ("a", "function", "NOT_STARTED", "u1", "pending", "r", "f1", "0x1", 10, 0, False, True, '{"n":1,"s":"1","t":["x","y"],"d":{"k":true}}', "2024"),
        ("b", "function", "FULL_MATCH", "u1", "accepted", "r", "f2", None, None, 3, True, True, "{bad", "2023"),
        ("c", "object", "NOT_STARTED", None, "pending", "q", "f3", None, 300, 1, False, False, "{}", None),
    ]
    return spark.createDataFrame(rows, ITEM)


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ({}, "abc"), ({"status": []}, "abc"), ({"status": ["NOT_STARTED"]}, "ac"), ({"size": {"min": 10}}, "ac"), ({"size": {"max": 10}}, "a"), ({"ready": True, "exhausted": False}, "a"),
        ({"meta": [{"key": "n", "op": "eq", "value": 1}]}, "a"), ({"meta": [{"key": "n", "op": "eq", "value": "1"}]}, ""), ({"meta": [{"key": "s", "op": "eq", "value": "1"}]}, "a"),
        ({"meta": [{"key": "n", "op": "neq", "value": "1"}]}, "abc"), ({"meta": [{"key": "t", "op": "contains", "value": "y"}]}, "a"), ({"meta": [{"key": "d.k", "op": "eq", "value": True}]}, "a"),
        ({"meta": [{"key": "s", "op": "regex", "value": "("}]}, ""), ({"sort": {"by": "size"}, "limit": 2}, "ba"), ({"sort": {"by": "size", "order": "desc"}, "limit": 2}, "ca"), ({"limit": 1}, "a"),
    ],
)
def test_select(items, selector, want):
    got = ids(registry.select_items(items, selector))
    assert got == list(want) if "limit" in selector else sorted(got) == list(want)


@pytest.mark.parametrize("bad", [{"x": 1}, {"limit": 0}, {"limit": True}, {"status": "a"}, {"meta": [{"key": "a", "op": "like"}]}, {"sort": {"by": "id"}}, {"size": {"low": 1}}])
def test_bad_selectors(items, bad):
    with pytest.raises(ValueError):
        registry.select_items(items, bad)


def test_scope_that_meets_nothing(items):
    assert ids(registry.apply_scope(items, {"targets": []})) == []


def test_status_ladder(spark, items):
    status = spark.createDataFrame([("w", "u1", "a", "P"), ("w", "", "a", "T"), ("w", "u1", "", "U"), ("x", "u1", "b", "other")], "workflow_id string, unit_id string, target_id string, status string")
    assert {r.id: r.resolved for r in registry.resolve_status(items, status, "w").collect()} == {"a": "P", "b": "U", "c": None}
    assert sorted(ids(registry.open_items(items, status, "w", ["U"]))) == ["a", "c"]


def test_violations(spark, items):
    deps = spark.createDataFrame([("a", "b", "calls"), ("a", "z", "odd")], "from_id string, to_id string, kind string")
    caps = spark.createDataFrame([("q", "c1")], "work_item_id string, capability string")
    got = {(r.rule, r.subject) for r in registry.registry_violations(items.unionByName(items.limit(1)), deps, caps).collect()}
    assert got == {("duplicate_id", "a"), ("edge_kind", "odd"), ("dangling_to_id", "z"), ("dangling_capability", "q")}


def test_summary_falls_back_on_position(spark):
    targets = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos long, id string")
    entries = spark.createDataFrame([(0, "b", "X", True), (1, None, "Y", False), (2, None, "Z", True)], "ord long, target_id string, status string, accepted boolean")
    assert {r.id: (r.status, r.accepted) for r in registry.map_summary(targets, entries).collect()} == {"a": ("Y", False), "b": ("X", True), "c": ("", False)}


def test_diff_verdict(spark):
    d = spark.createDataFrame([(0, 0, 9, 0, 0), (0, 2, 9, 1, 1), (4, None, None, None, None), (2, None, None, None, None)], "exit_code int, mismatch_count long, total_instructions long, structural_count long, reg_swap_count long")
    assert [(r.accepted, r.status) for r in registry.diff_verdict(d).collect()] == [(True, "FULL_MATCH"), (False, None), (False, "NOT_FOUND"), (False, "NOT_BUILDABLE")]


def test_route_stays_when_spent(spark, items):
    routes = [{"name": "small", "size_below": 128, "maxAttempts": 1}, {"name": "any"}]
    tried = spark.createDataFrame([("a", "small", 1)], "id string, route string, n long")
    assert {r.id: r.route for r in registry.route(items, routes, tried).collect()} == {"a": None, "b": "any", "c": "any"}


# --- telemetry ---


def test_pacing_equals_a_simulation(spark):
    rng = random.Random(1)
    log, t = [], 0
    for i in range(60):
        t += rng.randint(0, 900)
        log.append((i, "m", t))
    models = spark.createDataFrame([("m", 120.0)], "name string, rpm double")
    got = {r.id: r.release_ms for r in telemetry.pacing(spark.createDataFrame(log, "id long, model string, t long"), models).collect()}
    last = float("-inf")
    for i, _, at in log:
        last = max(at, last + 500)
        assert got[i] == last


def test_sequence_has_no_gap(spark):
    got = telemetry.assign_seq(spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000), 50, ["k"]).orderBy("k").collect()
    assert [r.seq for r in got] == list(range(51, 1051))


# --- lint ---


def reference_delta_state(codes):
    """The open-cast state, line by line."""
    import re

    pending, out = False, []
    for c in codes:
        if not pending and re.search(lint.CAST_OPEN, c):
            pending = True
        hit = pending and bool(re.search(lint.ASSIGN, c))
        if pending and ")" in c:
            pending = False
        out.append(hit)
    return out


def test_delta_gate(spark):
    rng = random.Random(4)
    parts = ["static_cast<int>(", "x = 1", ")", "y == 2", "foo"]
    rows, want = [], {}
    for f in range(60):
        codes = [" ".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(8)]
        rows += [(f"{f}.cpp", i + 1, c) for i, c in enumerate(codes)]
        want |= {(f"{f}.cpp", i + 1): h for i, h in enumerate(reference_delta_state(codes))}
    got = lint.lint_delta(spark.createDataFrame(rows, "path string, line_no int, raw string")).filter("rule_ord = 16").collect()
    assert {(r.path, r.line_no) for r in got} == {k for k, h in want.items() if h}


def test_delta_rules(spark):
    cases = [
        ("a.c", 'extern "C" void f();', {"extern_c_in_c", "no_extern_c"}), ("a.cpp", 'extern "C" int lbl_8;', set()), ("a.cpp", "#pragma once", {"no_pragmas"}), ("a.cpp", "#include <vector>", {"no_angle_include"}),
        ("a.cpp", "#include <string.h>", set()), ("a.cpp", "u32 r31 = 0;", {"no_register_names"}), ("a.cpp", "void* p;", {"no_void_ptr"}), ("a.cpp", "// void* p;", set()), ("a.cpp", "int unk1F;", {"no_unk_name"}),
        ("a.cpp", "*(u8*)(p + 0x10)", {"no_offset_arithmetic"}), ("a.cpp", "xé", {"non_sjis_char"}), ("a.cpp", "日本", set()), ("a.cpp", "#if 0", {"no_if0"}), ("a.cpp", "void __ct__3FooFv(Foo* self)", {"cpp_free_ctor"}),
    ]
    df = spark.createDataFrame([(p, i, raw) for i, (p, raw, _) in enumerate(cases)], "path string, line_no int, raw string").withColumn("path", F.concat("line_no", "path"))
    got = {i: set() for i in range(len(cases))}
    for r in lint.lint_delta(df).collect():
        got[r.line_no].add(r.rule)
    assert got == {i: want for i, (*_, want) in enumerate(cases)}


def test_added_lines(spark):
    rng = random.Random(7)
    old, new = [], []
    for f in range(80):
        a = [rng.choice("abcdef") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcdef") if rng.random() < 0.3 else x for x in a] + [rng.choice("abc")] * rng.randint(0, 2)
        new.append((str(f), "\n".join(b)))
        if f % 9:
            old.append((str(f), "\n".join(a)))
    s = "path string, text string"
    got = lint.added_lines(spark.createDataFrame(old, s), spark.createDataFrame(new, s)).collect()
    was = dict(old)
    for path, text in new:
        b = lint._split(text)
        mine = {r.line_no for r in got if r.path == path}
        if path not in was:
            assert mine == set(range(1, len(b) + 1))
            continue
        a = lint._split(was[path])
        kept = [x for i, x in enumerate(b, 1) if i not in mine]
        left = iter(a)
        assert all(x in left for x in kept)  # what is kept is a subsequence of the old text
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
        assert len(kept) == longest[-1][-1]


def test_metrics_and_regressions(spark):
    files = spark.createDataFrame([("a.cpp",), ("b.cpp",)], "path string")
    found = spark.createDataFrame([("a.cpp", "smell.extern_c", "kind=nonlbl-decl"), ("a.cpp", "smell.extern_c", "kind=nonlbl-def"), ("a.cpp", "smell.asm_code", "")], "path string, rule string, message string")
    m = {r.path: r for r in lint.file_metrics(found, files).collect()}
    assert (m["a.cpp"].extern_c_nonlbl_decl, m["a.cpp"].extern_c_nonlbl_def, m["a.cpp"].asm_code, m["b.cpp"].asm_code) == (1, 1, 1, 0)
    assert {r.path: r.severity for r in lint.severity(lint.file_metrics(found, files)).collect()} == {"a.cpp": 6, "b.cpp": 0}
    now = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("new", "x", 9), ("a", "fresh", 4)], "path string, metric string, n long")
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 5)], "path string, metric string, n long")
    assert {(r.path, r.metric, r.before, r.after) for r in lint.regressions(now, base).collect()} == {("a", "x", 1, 2), ("a", "y", 0, 1)}


def test_clones(spark):
    u = spark.createDataFrame([("a", 1, "int f() { return 1; }"), ("b", 9, "int  f() { /* x */ return 1; } // y"), ("c", 2, "{ }"), ("d", 2, "{ }")], "path string, line_no int, text string")
    assert [(r.path, r.copies, r["first"].path) for r in lint.clone_findings(u, [], ["path", "line_no"]).collect()] == [("b", 2, "a")]
    c = spark.createDataFrame([("a", 1, "struct Foo { int a; int b; }"), ("b", 1, "struct Bar { int a; int b; }")], "path string, line_no int, text string")
    assert lint.class_clones(c, [], ["path", "line_no"]).count() == 1


def test_declarations(spark):
    text = 'extern "C" void func_80001234(Foo* self,\n    int b);\nextern "C" {\nint lbl_1;\nvoid (*cb)(int);\n}\nint Foo::bar(int x) {\n  if (x) { return 1; }\n  return 2;\n}\n'
    f = spark.createDataFrame([("a.cpp", text)], "path string, text string")
    assert [(r.line_no, r.name) for r in declarations.extract_decls(f).collect()] == [(1, "func_80001234"), (4, "lbl_1"), (5, "cb")]
    assert [(r.line_no, r.name, r.body.count("}")) for r in declarations.extract_defs(f).collect()] == [(7, "Foo::bar", 2)]


def test_repeated_casts_keep_their_lines(spark):
    hit = "x = static_cast<int>(y = 1);"
    text = f"{hit}\nint z;\n{hit} {hit}\nstatic_cast<int>(\n  a, b\n  = 2);\r\n{hit}"
    f = spark.createDataFrame([("a.cpp", text), ("b.cpp", "int x;"), ("c.cpp", None)], "path string, text string")
    assert sorted((r.path, r.line_no) for r in lint.init_side_effects(f).collect()) == [("a.cpp", n) for n in (1, 3, 4, 7)]


def test_many_edits_take_little_memory():
    a, b = [f"a{i}" for i in range(3000)], [f"b{i}" if i % 3 else f"a{i}" for i in range(3000)]
    assert lint._inserted(a, b) == [i for i in range(3000) if i % 3]


def test_extern_c_kinds(spark):
    text = 'extern "C" int lbl_eu_1;\nextern "C" void f(int);\nextern "C" void g(int) { return; }\nextern "C" int x;\n'
    got = declarations.extern_c_findings(spark.createDataFrame([("a.cpp", text)], "path string, text string"))
    assert [(r.line_no, r.kind) for r in got.orderBy("line_no").collect()] == [(1, "lbl"), (2, "nonlbl-decl"), (3, "nonlbl-def"), (4, "other")]
    m = lint.file_metrics(got, got.select("path")).first()
    assert (m.extern_c_nonlbl_decl, m.extern_c_nonlbl_def) == (1, 1)


def test_header_drift(spark):
    insns = [("f", "func_80000010", 0, "lwz", "r4, 0x10(r3)"), ("f", "main", 1, "lwz", "r3, 0x4(r30)"), ("f", "main", 2, "lwz", "r31, 0x4(r30)"), ("f", "main", 3, "mr", "r3, r31"), ("f", "main", 4, "bl", "func_80000010__Fv"), ("f", "func_80000010__Fv", 5, "lwz", "r4, 0x8(r3)")]
    d = spark.createDataFrame(insns, "file string, fn string, idx long, mnemonic string, operands string")
    symbols = spark.createDataFrame([(1, "func_80000010__Fv"), (2, "func_80000020__Fi")], "ordinal long, name string")
    raws = ["static void func_80000010(int a, int b);", "  int func_80000020();", "int func_80000030();", "int other();"]
    lines = spark.createDataFrame([("h", i, r) for i, r in enumerate(raws, 1)], "path string, line_no int, raw string")
    got = {r.line_no: (r.retail, r.drift) for r in binary.header_drift(lines, symbols, d).collect()}
    assert got == {1: ("func_80000010__Fv", "header declares static but binary shows this-taking; header 2 params, binary 1"), 2: ("func_80000020__Fi", "header declares member but binary proves no-this")}


def test_verifier_contract(items):
    out = builtin.verify(items, lambda d: d.withColumn("accepted", F.col("size") > 5)).collect()
    assert {r.id: r.accepted for r in out} == {"a": True, "b": False, "c": True}
    with pytest.raises(ValueError, match="accepted"):
        builtin.verify(items, lambda d: d.withColumn("accepted", F.lit("yes")))


# --- listings ---


def test_provenance_and_verdict(spark):
    rows = [
        ("f", "main", 0, "li", "r3, 5"), ("f", "main", 1, "bl", "one"), ("f", "main", 2, "addi", "r3, r1, 0x8"), ("f", "main", 3, "bl", "two"), ("f", "main", 4, "lwz", "r31, 0x4(r30)"), ("f", "main", 5, "mr", "r3, r31"), ("f", "main", 6, "bl", "three"),
        ("f", "main", 7, "bl", "four"), ("f", "two", 8, "lwz", "r4, 0x10(r3)"), ("f", "three", 9, "lwz", "r4, 0x8(r3)"), ("f", "four", 10, "add", "r3, r3, r4"), ("f", "main", 11, "addi", "r3, r3, lbl@l"), ("f", "main", 12, "bl", "five"),
    ]
    d = spark.createDataFrame(rows, "file string, fn string, idx long, mnemonic string, operands string")
    p = {r.callee: r.kind for r in binary.r3_provenance(d).collect()}
    assert p == {"one": "CONSTANT", "two": "ADDR_STACK", "three": "LOAD_FIELD", "four": "CALL_RESULT", "five": "ADDR_LABEL"}
    v = {r.symbol: r.kind for r in binary.member_verdict(d).collect()}
    assert (v["one"], v["two"], v["three"], v["four"]) == ("not_member", "review", "member", "integer_only")
    g = {r.fn: r for r in binary.call_graph(binary.call_edges(d)).collect()}
    assert g["main"].callees == ["one", "two", "three", "four", "five"] and g["two"].callers == ["main"]


def test_listing_and_symbols(spark, tmp_path):
    (tmp_path / "x.s").write_text("# head\n/* 80000000 00000000  38 60 00 01 */\tli r3, 1\n.fn foo, global\n/* 80000004 00000004  38 60 00 02 */\tli r3, 2 // note\n.endfn foo\n/* 80000008 00000008  38 60 00 03 */\tli r3, 3\n")
    assert [(r.fn, r.idx, r.address, r.mnemonic, r.operands) for r in readers.read_listing(spark, str(tmp_path / "x.s")).collect()] == [("foo", 0, 0x80000004, "li", "r3, 2")]
    (tmp_path / "s.txt").write_text("// c\nfoo = .text:0x80000004; // type:function\nbad line\n\nbar = 0x10; // x\n")
    assert [(r.name, r.address_key) for r in readers.read_symbols(spark, str(tmp_path / "s.txt")).orderBy("ordinal").collect()] == [("foo", 0x80000004), ("bar", 16)]
    objects = spark.createDataFrame([("o", bytes.fromhex("8000000400800000048000")), ("p", b"ab")], "path string, content binary")
    symbols = spark.createDataFrame([("foo", 0x80000004)], "name string, address_key long")
    assert [(r.path, r.offset) for r in readers.scan_words(objects, symbols).collect()] == [("o", 0)]
    (tmp_path / "r.json").write_text('{"entries":{"s":{"t":{"retail_symbol":"n1"}},"u":{"t":{"retail_symbol":""}}}}')
    assert [r.name for r in readers.read_reloc_names(spark, str(tmp_path / "r.json")).collect()] == ["n1"]


def test_registry_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"workItems":[{"id":"a","kind":"function","status":"X","size":5}]}')
    (tmp_path / "b.json").write_text('[{"id":"b","kind":"function","status":"X"}]')
    (tmp_path / "c.json").write_text('[{"id":"b","kind":"function"}]')
    a = readers.read_registry(spark, str(tmp_path / "a.json")).first()
    assert (a.id, a.size, a.lifecycle, a.ready) == ("a", 5, "pending", False)
    assert readers.read_registry(spark, str(tmp_path / "b.json")).first().id == "b"
    with pytest.raises(Exception, match="lacks id"):
        readers.read_registry(spark, str(tmp_path / "c.json")).collect()
    t = readers.map_targets(spark.createDataFrame([('{"id":"t","workflow_status":"BACKLOG","size":"0x29C","x":"1"}',), ('{"id":"u","size":"zz"}',)], "json string"), "eu").collect()
    assert [(r.id, r.lifecycle, r.size, r.region, r.meta) for r in t] == [("t", "blocked", 668, "eu", '{"x":"1"}'), ("u", "pending", None, "eu", "{}")]


def test_sinks(spark, items, tmp_path):
    deps = spark.createDataFrame([("a", "b", "calls")], "from_id string, to_id string, kind string")
    caps = spark.createDataFrame([("a", "c1")], "work_item_id string, capability string")
    sinks.export_registry(items, deps, caps, f"{tmp_path}/snap")
    assert [d.count() for d in sinks.import_registry(spark, f"{tmp_path}/snap")] == [3, 1, 1]
    sinks.export_registry(items, deps.withColumn("to_id", F.lit("zz")), caps, f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="dangling_to_id"):
        sinks.import_registry(spark, f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="dangling_to_id"):
        sinks.import_registry(spark, f"{tmp_path}/bad", f"{tmp_path}/to")
    assert [d.count() for d in sinks.import_registry(spark, f"{tmp_path}/snap", f"{tmp_path}/to")] == [3, 1, 1]
    with pytest.raises(ValueError, match="is there already"):
        sinks.import_registry(spark, f"{tmp_path}/snap", f"{tmp_path}/to")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bad", "snap", "to"]
    m = spark.createDataFrame([("a", 0, 2, 0)], "path string, init_side_effect long, void_ptr long, goto_count long")
    sinks.write_baseline(m, f"{tmp_path}/base")
    assert {(r.metric, r.n) for r in sinks.read_baseline(spark, f"{tmp_path}/base").collect()} == {("init_side_effect", 0), ("void_ptr", 2)}
    assert sinks.read_baseline(spark, f"{tmp_path}/none").count() == 0


def test_names(spark):
    assert scalars.split_mangled("update__5CGameFv") == {"member": "update", "class": "CGame", "namespaces": [], "ctor": False, "dtor": False, "params": "v"}
    assert scalars.split_mangled("plain_name") is None
    got = scalars.split_mangled("__dt__Q22nw3FooFv")
    assert (got["class"], got["namespaces"], got["dtor"]) == ("Foo", ["nw"], True)
    d = spark.createDataFrame([(["nw", "Foo"],), (["Foo"],)], "p array<string>")
    assert [r[0] for r in d.select(scalars.build_name(F.col("p"))).collect()] == ["Q22nw3Foo", "3Foo"]


def test_plan(items):
    assert [(r.id, r.batch, r.route) for r in builtin.match_plan(items).collect()] == [("a", 0, "small"), ("c", 0, None)]


# --- streams ---


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rng = random.Random(3)
    t0 = 1_700_000_000
    ops = [(i, t0 + i * 60, f"o{i % 3}", f"run{rng.randint(1, 2)}:{1}", "e0", rng.choice(["claim", "claim", "heartbeat", "release", "sweep"]), 120_000) for i in range(60)]
    df = spark.createDataFrame(ops, "op_seq long, at long, work_item_id string, owner string, epoch string, op string, ttl_ms long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    df.write.parquet(f"{tmp_path}/ops")
    src = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/ops")
    assert sorted(map(str, run_stream(jobs.lease_stream(src), "leases").collect())) == sorted(map(str, jobs.lease_outcomes(df).collect()))

    events = spark.createDataFrame([(i, f"run{i % 2}", 10) for i in range(1, 11)], "seq long, run_id string, cost_micro_usd long")
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    tail = jobs.tail_events(spark, f"{tmp_path}/events", 4, "seq long, run_id string, cost_micro_usd long")
    assert sorted(r.seq for r in run_stream(tail, "tail").collect()) == [5, 6, 7, 8, 9, 10]
    counts = run_stream(jobs.run_counters(tail), "counters", "complete").collect()
    assert {(r.run_id, r.events, r.head) for r in counts} == {("run0", 3, 10), ("run1", 3, 9)}
    spend = jobs.spend_stream(tail.withColumnRenamed("seq", "id"), 15)
    assert {(r.run_id, r.id, r.spent) for r in run_stream(spend, "spend").collect()} == {("run0", 8, 20), ("run1", 7, 20)}
    log = tail.select(F.lit("w").alias("workflow_id"), F.lit("u").alias("unit_id"), F.col("run_id").alias("target_id"), "seq", F.when(F.col("seq") < 8, "a").otherwise("b").alias("status"))
    assert {(r.target_id, r.seq, r.from_status, r.to_status) for r in run_stream(jobs.status_change_stream(log), "changes").collect()} == {("run0", 6, None, "a"), ("run0", 8, "a", "b"), ("run1", 5, None, "a"), ("run1", 9, "a", "b")}
    done = tail.select(F.lit("p").alias("pipeline"), F.col("run_id").alias("unit_id"), F.concat(F.lit("i"), "seq").alias("work_item_id"), F.lit(3).alias("n_items"), (F.col("seq") != 7).alias("accepted"))
    assert [(r.pipeline, r.unit_id) for r in run_stream(jobs.unit_complete(done), "units").collect()] == [("p", "run0")]


def test_idle_state_is_forgotten(spark, tmp_path):
    def run(target, seq):
        spark.createDataFrame([("w", "u", target, seq, "x")], shape).write.mode("append").parquet(f"{tmp_path}/log")
        src = spark.readStream.schema(shape).parquet(f"{tmp_path}/log")
        jobs.status_change_stream(src, idle_ms=1).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start(f"{tmp_path}/out", format="parquet", outputMode="append").awaitTermination()

    shape = "workflow_id string, unit_id string, target_id string, seq long, status string"
    for seq, target in enumerate(["a", "b", "a"]):
        run(target, seq)
    assert {(r.target_id, r.seq, r.from_status) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", 0, None), ("b", 1, None), ("a", 2, None)}


def test_units_fire_once(spark, tmp_path):
    shape = "pipeline string, unit_id string, work_item_id string, n_items int, accepted boolean"
    batches = [[("p", "u", "i", 2, True), ("p", "v", "i", 1, None), ("p", "w", "i", 2, True)], [("p", "u", "i", 2, True), ("p", "w", "j", 2, False)], [("p", "u", "j", 2, True), ("p", "w", "j", 2, True)], [("p", "u", "j", 2, True), ("p", "v", "i", 1, True)]]
    for rows in batches:
        spark.createDataFrame(rows, shape).write.mode("append").parquet(f"{tmp_path}/log")
        src = spark.readStream.schema(shape).parquet(f"{tmp_path}/log")
        jobs.unit_complete(src).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet", outputMode="append").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("p", "u")]


def test_append_numbers_batches(spark, tmp_path):
    spark.range(5).withColumn("k", F.col("id")).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("id long, k long").parquet(f"{tmp_path}/in")
    q = jobs.append_events(src, f"{tmp_path}/log", ["k"], f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    assert [r.seq for r in spark.read.parquet(f"{tmp_path}/log").orderBy("k").collect()] == [1, 2, 3, 4, 5]


def test_leases_are_folded_batch_by_batch(spark):
    rng, t0 = random.Random(4), 1_700_000_000
    kinds = ["claim", "claim", "heartbeat", "release", "sweep"]
    rows = [(i, t0 + i * 60, item, f"run{rng.randint(1, 2)}:1", "e0", rng.choice(kinds), 120_000) for i in range(300) for item in [rng.choice(["a", "a", "a", "b", None])]]
    df = spark.createDataFrame(rows, "op_seq long, t long, work_item_id string, owner string, epoch string, op string, ttl_ms long").withColumn("ts", F.timestamp_seconds("t"))
    held, want = {}, {}
    for seq, t, item, owner, epoch, op, ttl in rows:
        held[item], want[seq] = jobs.lease_step(held.get(item), op, owner, epoch, t * 1000, ttl)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = jobs.lease_outcomes(df)
        assert {r.op_seq: r.ok for r in out.collect()} == want
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()  # no frame holds an item's whole history
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)

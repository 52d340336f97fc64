"""Lint at corpus scale: rules as columns over lines, added lines, metrics, regressions and clones."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import ACCEPTED

BREAK_ALL = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]"
BREAK = r"\r\n|\n|\r"

# The patterns, names, weights and lists of the rules.
ANGLE_INCLUDES = ("macros.h", "types.h", "decomp.h", "string.h", "stddef.h", "stdarg.h", "math.h", "float.h", "limits.h", "ctype.h", "stdlib.h", "stdio.h", "new")
EXTERN_C = r'extern\s+"C"'
CAST_OPEN = r"(?:reinterpret_cast|static_cast)\s*<[^>]+>\s*\(\s*$"
CAST_ASSIGN = r"(?:reinterpret_cast|static_cast)\s*<[^>]+>\s*\([^()]*\w\s*=(?!=)"
ASSIGN = r"\w\s*=(?!=)"
DECLARATION = r"^\s*(?:u8|u16|u32|u64|s8|s16|s32|s64|f32|f64|int|char|short|long|float|double|bool|void|unsigned|signed|const|static|struct|class|[A-Z]\w*(?:\s*[*&])?)\s"
UNK_NAME = r"\bunk[0-9A-Fa-f]+\b"
UNK_GENERATED = r"Unk(?:Class_[0-9A-Fa-f]+|VirtualFunc[0-9]+|Struct[0-9A-Fa-f]+)"
METRICS = {
    "extern_c_nonlbl_decl": ("smell.extern_c", "nonlbl-decl"), "extern_c_nonlbl_def": ("smell.extern_c", "nonlbl-def"), "self_params": ("smell.self_param", None), "void_ptr": ("smell.void_ptr", None),
    "ptr_arith": ("smell.ptr_arith", None), "deref_arith": ("smell.deref_arith", None), "asm_code": ("smell.asm_code", None), "rn_params": ("smell.rn_params", None),
    "goto_count": ("smell.goto_count", None), "asm_insn_shim": ("smell.asm_insn_shim", None), "schedule_pragma": ("smell.schedule_pragma", None), "init_side_effect": ("smell.init_side_effect", None),
}
WEIGHTS = {"extern_c_nonlbl_decl": 1, "extern_c_nonlbl_def": 2, "self_params": 2, "void_ptr": 1, "ptr_arith": 1, "deref_arith": 1, "asm_code": 3, "rn_params": 2, "asm_insn_shim": 3, "schedule_pragma": 3, "init_side_effect": 4}
SEEDED = ("asm_insn_shim", "schedule_pragma", "init_side_effect")
TEXT_RULES = {
    "smell.decomp_macro": r"DECOMP_(?:PPC|FORCELITERAL|FORCEACTIVE)", "smell.pragma": r"^\s*#\s*pragma", "smell.asm_insn_shim": r"\bDECOMP_ASM_INSN_BEGIN\b",
    "smell.schedule_pragma": r"^\s*#\s*pragma\s+schedule\b", "smell.if0": r"^\s*#\s*if\s+0",
}
#: Structural rules in the regex form: one hit a line.
LINE_RULES = {
    "smell.self_param": r"\bself\s*[,)]", "smell.self_access": r"\bself\s*->", "smell.void_ptr": r"\bvoid\s*\*+\s*\w+", "smell.void_ptr_cast": r"\(\s*void\s*\*+\s*\)",
    "smell.ptr_arith": r"\(\s*(?:u8|s8|char|unsigned char|signed char)\s*\*\s*\)\s*\w+\s*[+-]\s*(?:0[xX][0-9A-Fa-f]+|\d+\s*[),;\]])", "smell.deref_arith": r"\*\s*\(\s*\w+\s*\*\s*\)\s*\(\s*\(\s*\w+\s*\*?\s*\)\s*\w+\s*\+",
    "smell.asm_code": r"\b(?:__asm|asm)\b|\bregister\b", "smell.fake_stack": r"\bvolatile\b[^;]*\b(?:char|u8)\b[^;]*\[|\b(?:u8|char)\s+(?:sp|stack)\d*\s*\[", "smell.rn_params": r"\br(?:[3-9]|[12]\d|3[01])\s*[,)]",
    "smell.goto_count": r"\bgoto\s+\w+\s*;", "smell.class_in_cpp": r"\bclass\s+\w+[^;(]*\{", "smell.struct_in_cpp": r"\bstruct\s+\w+[^;(]*\{", "smell.vtable_wrapper": r"\(\s*\*+\s*\(\s*\w+\s*\*+\s*\)\s*\*",
}
CPP_ONLY = ("smell.class_in_cpp", "smell.struct_in_cpp")
POINTER_RULES = {
    "ptr.cast_byte_offset_deref": r"\*\s*\(\s*\w+\s*\*\s*\)\s*\(\s*\(\s*(?:u8|s8|char)\s*\*\s*\)\s*\w+\s*[+-]\s*\w+", "ptr.cast_byte_ptr_arith": r"\(\s*(?:u8|s8|char)\s*\*\s*\)\s*\w+\s*[+-]\s*\w+", "ptr.cast_int_arith": r"\(\s*(?:u32|s32|int|unsigned int|uintptr_t)\s*\)\s*\w+\s*[+-]\s*\w+",
    "ptr.subscript_on_cast": r"\(\s*\(\s*\w+\s*\*\s*\)\s*\w+\s*\)\s*\[", "ptr.ptr_offset_deref": r"\*\s*\(\s*\w+\s*[+-]\s*\w+\s*\)", "ptr.reinterpret_arith": r"reinterpret_cast\s*<[^>]+>\s*\([^()]*\)\s*[+-]\s*\w+",
}


# What a finding of each check of the gate says, in the order of the checks.
GATE_MESSAGES = (
    "character(s) with no Shift-JIS encoding (will fail the build): {characters} — replace with ASCII or valid SJIS",
    '`extern "C"` is C++-only syntax and does not compile in C files — remove it',
    "new preprocessor pragmas are forbidden (codegen steering)",
    "#if 0 wrapping is forbidden (can hide symbols from diffs)",
    "section attributes are forbidden",
    "DECOMP_* codegen-steering macros are forbidden",
    "binary-patching escapes (insn_patches / insert_insns / reloc_offset_moves / postprocess_reloc_names) are forbidden — chase EQUIVALENT_MATCH, not byte-identity patches",
    'extern "C" is only allowed for lbl_* reloc names',
    "constructor/destructor written as a C-style free function taking `* self` — use a member constructor/destructor (Class::Class / Class::~Class) instead",
    "angle include <{included}> is not whitelisted",
    ".s includes are forbidden",
    "volatile/fake stack buffers are forbidden",
    "assembly is forbidden, including single-instruction asm",
    "DECOMP_ASM_INSN single-instruction asm shims are forbidden in new code — write high-level C++ and chase a natural match",
    "assignment inside a cast (init-list store-ordering trick) is forbidden — write the plain value",
    "assignment inside a multi-line cast / member-initializer is forbidden — write the plain value",
    "register keyword / register bindings are forbidden",
    "identifiers named after GPRs (r0-r31) are forbidden",
    "void* is forbidden; use a proper struct/class type",
    "unknown-name placeholder `unkN` is forbidden in new code; name the variable/field from the retail symbol or struct layout",
    "generated unknown type/member (`UnkClass_*`, `UnkVirtualFunc*`, `UnkStruct*`) is forbidden in new code; use a real struct/class name from the headers or declare it properly",
    "raw pointer offset arithmetic is forbidden; use struct fields",
)


def code_of(raw: Column) -> Column:
    """A line before its first //."""
    return F.substring_index(raw, "//", 1)


def snippet(text: Column, collapse: bool = True) -> Column:
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.substring(F.regexp_replace(text, r"\s+", " ") if collapse else text, 1, 100)


def lines(files: DataFrame, breaks: str = BREAK, keep_last_empty: bool = True) -> DataFrame:
    """(path, line_no, raw, code) of files (path, text), lines from 1. Line breaks: BREAK for whole files, BREAK_ALL for the gate."""
    out = files.select("path", F.posexplode(F.split("text", breaks)).alias("pos", "raw"))
    if not keep_last_empty:
        n = F.size(F.split("text", breaks)).alias("n")
        out = files.select("path", n, F.posexplode(F.split("text", breaks)).alias("pos", "raw")).filter("not (pos = n - 1 and raw = '')").drop("n")
    return out.select("path", (F.col("pos") + 1).alias("line_no"), "raw", code_of(F.col("raw")).alias("code"))


def is_cpp(path: Column) -> Column:
    return path.rlike(r"\.(?:cpp|cc|cxx|hpp|hh)$")


def is_c(path: Column) -> Column:
    return path.rlike(r"\.(?:c|h)$")


def lint(source: DataFrame, rules: list[tuple[str, str, str]], path_filter: dict[str, str] | None = None) -> DataFrame:
    """(path, line_no, rule_ord, rule, column_no, snippet, message): one row for each rule (id, pattern, 'raw' or 'code') and
    line that it matches.

    All rules are columns of one projection; the lines are read once.
    """
    gates = path_filter or {}
    hits = [
        F.struct(F.lit(i).alias("rule_ord"), F.lit(rule).alias("rule"), F.regexp_instr(on, F.lit(pattern)).alias("column_no"), F.when(F.col("path").rlike(gates.get(rule, "")), F.col(on)).alias("text"))
        for i, (rule, pattern, on) in enumerate(rules)
    ]
    found = source.select("path", "line_no", F.explode(F.filter(F.array(*hits), lambda h: (h["column_no"] > 0) & h["text"].isNotNull())).alias("h"))
    found = found.select("path", "line_no", "h.rule_ord", "h.rule", "h.column_no", snippet(F.col("h.text")).alias("snippet"))
    return found.withColumn("message", F.concat_ws(": ", "rule", "snippet"))


# --- rules as data -----------------------------------------------------------------------------------------------------


def bad_patterns(spark: SparkSession, patterns: list[str]) -> set[str]:
    """Those of the patterns that Spark cannot compile. All are tried at once; a half that fails is halved again."""
    distinct = sorted(set(patterns))
    if not distinct:
        return set()
    try:
        spark.sql("select " + ", ".join(f"'' rlike :p{i}" for i in range(len(distinct))), args={f"p{i}": p for i, p in enumerate(distinct)}).collect()
        return set()
    except Exception as e:
        if "REGEX" not in str(e).upper() and "PATTERN" not in str(e).upper():
            raise
    if len(distinct) == 1:
        return set(distinct)
    half = len(distinct) // 2
    return bad_patterns(spark, distinct[:half]) | bad_patterns(spark, distinct[half:])


def rule_problems(rules: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(id, problem) of a rule table: unknown-rule for ids of only that it has not, bad-pattern and bad-path-filter for
    patterns that do not compile. Such a rule has no findings."""
    spark = rules.sparkSession
    told = [(r.id, kind, p) for r in rules.select("id", "pattern", "path_filter").toLocalIterator() for kind, p in (("bad-pattern", r.pattern), ("bad-path-filter", r.path_filter)) if p is not None]
    bad = bad_patterns(spark, [p for *_, p in told])
    known = {r.id for r in rules.select("id").toLocalIterator()}
    rows = [(i, kind) for i, kind, p in told if p in bad and (not only or i in only)] + [(i, "unknown-rule") for i in only or [] if i not in known]
    return spark.createDataFrame(rows, "id string, problem string")


def rule_findings(source: DataFrame, rules: DataFrame, only: list[str] | None = None, at_once: int = 200) -> DataFrame:
    """lint() with rules from a table (ord, id, pattern, on, path_filter, message): what on names ('raw' or 'code') must match
    pattern, on paths that match path_filter (null: all). {rule}, {path}, {line}, {column} and {snippet} of a message are
    filled in; a null message is '{rule}: {snippet}'. only keeps some ids. A pattern that does not compile matches nothing.

    Patterns must be constants to be compiled once a task, so the rules come to the driver, one at a time, and become columns
    of one projection, at_once of them in each: however many there are, no rule is joined to a line.
    """
    if only is not None:
        rules = rules.filter(F.col("id").isin(only))
    rows = list(rules.select("ord", "id", "pattern", "on", "path_filter", "message").orderBy("ord", "id").toLocalIterator())
    bad = bad_patterns(source.sparkSession, [p for r in rows for p in (r.pattern, r.path_filter) if p is not None])
    good = [r for r in rows if r.pattern is not None and r.pattern not in bad and r.path_filter not in bad]
    out = None
    for k in range(0, max(1, len(good)), at_once):
        part = good[k : k + at_once]
        hit = lambda r: F.struct(F.lit(r.ord).cast("long").alias("rule_ord"), F.lit(r.id).alias("rule"), F.regexp_instr(r.on, F.lit(r.pattern)).alias("column_no"), (F.col("path").rlike(r.path_filter) if r.path_filter is not None else F.lit(True)).alias("in_path"), F.col(r.on).alias("text"), F.lit(r.message or "{rule}: {snippet}").alias("told"))
        none = F.array().cast("array<struct<rule_ord:bigint,rule:string,column_no:int,in_path:boolean,text:string,told:string>>")
        found = F.filter(F.array(*map(hit, part)), lambda h: (h["column_no"] > 0) & h["in_path"]) if part else none
        some = source.select("path", "line_no", F.explode(found).alias("h")).select("path", "line_no", "h.rule_ord", "h.rule", "h.column_no", snippet(F.col("h.text")).alias("snippet"), "h.told")
        out = some if out is None else out.unionByName(some)
    message = F.col("told")
    for name, value in (("rule", F.col("rule")), ("path", F.col("path")), ("line", F.col("line_no").cast("string")), ("column", F.col("column_no").cast("string")), ("snippet", F.col("snippet"))):
        message = F.replace(message, F.lit(f"{{{name}}}"), value)
    return out.withColumn("message", message).drop("told")


def built_in_rules() -> tuple[list[tuple[str, str, str]], dict[str, str]]:
    pack = [(r, p, "code") for d in (TEXT_RULES, LINE_RULES) for r, p in d.items()]
    return pack, dict.fromkeys(CPP_ONLY, r"\.(?:cpp|cc|cxx)$")


def init_side_effects(files: DataFrame) -> DataFrame:
    """(path, line_no) of assignments in casts, which may cross lines. A hit's line is one more than the line breaks in the
    pieces of text before it and in the hits among them: no text is carried along."""
    breaks = lambda parts: F.transform(parts, lambda x: F.regexp_count(x, F.lit(BREAK)))
    hits = files.select("path", breaks(F.regexp_extract_all("text", F.lit(CAST_ASSIGN), 0)).alias("in_hits"), breaks(F.split("text", CAST_ASSIGN)).alias("between"))
    each = hits.filter(F.size("in_hits") > 0).select("path", F.posexplode("in_hits").alias("pos", "own"), "in_hits", "between")
    upto = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda x, y: x + y)
    return each.select("path", (1 + upto("between", F.col("pos") + 1) + upto("in_hits", F.col("pos"))).alias("line_no")).distinct()


def lint_delta(added: DataFrame, angle: tuple[str, ...] = ANGLE_INCLUDES, unk_name: str = UNK_NAME, unk_generated: str = UNK_GENERATED) -> DataFrame:
    """(path, line_no, rule_ord, rule, snippet, message) over added lines (path, line_no, raw): the gate's checks, in its order.
    A message about characters without an encoding names each once, in the order they appear.

    A cast that stays open over added lines is followed by a window: a line with ) closes it, one that ends in a cast opens it.
    """
    a = added.withColumn("code", code_of(F.col("raw")))
    w = Window.partitionBy("path").orderBy("line_no")
    raw, code, path = F.col("raw"), F.col("code"), F.col("path")
    opens = code.rlike(CAST_OPEN)
    mark = F.when(code.contains(")"), 0).when(opens, 1)
    a = a.withColumn("_open", F.coalesce(F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 1, F.lit(False)) | opens)
    included = F.regexp_extract(raw, r"^\s*#\s*include\s*<([^>]+)>", 1)
    checks = [
        ("non_sjis_char", raw.rlike(r"[^\x00-\x7F]") & beyond_ascii(raw).rlike(sjis_unsafe())),
        ("extern_c_in_c", is_c(path) & code.rlike(EXTERN_C)),
        ("no_pragmas", raw.rlike(r"^\s*#\s*pragma\b")),
        ("no_if0", raw.rlike(r"^\s*#\s*if\s+0\b")),
        ("no_section_attr", raw.rlike(r"__declspec\s*\(\s*section|__attribute__\s*\(\s*\(\s*section")),
        ("no_codegen_macros", raw.rlike("DECOMP_PPC_|DECOMP_FORCELITERAL|DECOMP_FORCEACTIVE")),
        ("no_binary_patching", raw.rlike("insn_patches|insert_insns|reloc_offset_moves|postprocess_reloc_names")),
        ("no_extern_c", raw.rlike(EXTERN_C) & ~raw.contains("lbl_")),
        ("cpp_free_ctor", is_cpp(path) & code.rlike("__[cd]t__") & ~code.contains("::") & code.rlike(r"\*\s*self\s*(?:[,)]|$)")),
        ("no_angle_include", (included != "") & ~included.isin(*angle)),
        ("no_asm", raw.rlike(r'#\s*include\s*[<"][^>"]+\.s[>"]')),
        ("no_volatile_fake_stack", raw.rlike(r"\bvolatile\b[^;]*\b(?:char|u8)\b[^;]*\[|\b(?:u8|char)\s+(?:sp|stack)\d*\s*\[\s*(?:0x[0-9A-Fa-f]+|\d+)")),
        ("no_asm", code.rlike(r"\basm\b|__asm")),
        ("no_asm_insn_shim", code.rlike(r"\bDECOMP_ASM_INSN_(?:BEGIN|END)\b")),
        ("no_init_side_effect", code.rlike(CAST_ASSIGN)),
        ("no_init_side_effect", F.col("_open") & code.rlike(ASSIGN)),
        ("no_register_keyword", code.rlike(r'\bregister\b|asm\s*\(\s*"r')),
        ("no_register_names", code.rlike(r"\br(?:3[01]|[12][0-9]|[0-9])\b") & code.rlike(DECLARATION)),
        ("no_void_ptr", code.rlike(r"\(\s*void\s*\*\s*\)|void\s*\*\s*\w+")),
        ("no_unk_name", code.rlike(unk_name)),
        ("no_unk_generated", code.rlike(unk_generated)),
        ("no_offset_arithmetic", code.rlike(r"\(\s*\w+\s*\*\s*\)") & code.rlike(r"\+\s*0x[0-9A-Fa-f]+")),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i + 1).alias("rule_ord"), F.lit(r).alias("rule"))) for i, (r, c) in enumerate(checks)]))
    found = a.select("path", "line_no", "raw", snippet(raw, False).alias("snippet"), F.explode(hits).alias("h")).select("path", "line_no", "raw", "h.rule_ord", "h.rule", "snippet")
    message = F.get(F.array(*map(F.lit, GATE_MESSAGES)), F.col("rule_ord") - 1)
    characters = F.array_join(F.array_distinct(F.regexp_extract_all(beyond_ascii(raw), F.lit(sjis_unsafe()), F.lit(0))), "")
    message = F.when(F.col("rule_ord") == 1, F.replace(message, F.lit("{characters}"), characters)).otherwise(F.replace(message, F.lit("{included}"), included))
    return found.select("path", "line_no", "rule_ord", "rule", "snippet", message.alias("message"))


def beyond_ascii(raw: Column) -> Column:
    """A line's characters over U+007F: a class of thousands of spans is walked through for each character it is shown."""
    return F.regexp_replace(raw, r"[\x00-\x7F]+", "")


def sjis_unsafe() -> str:
    """A character class of what has no Shift-JIS encoding: everything over U+007F but what the codec takes."""
    good = [c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and _encodes(chr(c))]
    spans: list[list[int]] = []
    for c in good:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[^\\x00-\\x7F" + "".join(f"\\u{a:04X}" if a == b else f"\\u{a:04X}-\\u{b:04X}" for a, b in spans) + "]"


def _encodes(c: str) -> bool:
    try:
        c.encode("shift_jis")
    except UnicodeEncodeError:
        return False
    return True


def added_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, line_no, raw) of the lines that new has and old has not, by a shortest edit script; all lines of a new path.

    Unchanged files leave by a hash before any text is compared; a pair is compared in one row's Python.
    """
    both = new.select("path", F.col("text").alias("now")).join(old.select("path", F.col("text").alias("was")), "path", "left").filter("was is null or xxhash64(was) <> xxhash64(now) or was <> now")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, n, t) for p, now, was in zip(f["path"], f["now"], f["was"], strict=True) for n, t in _added(None if was is None or was != was else was, now)]
            yield pd.DataFrame(rows, columns=["path", "line_no", "raw"])

    return both.mapInPandas(run, "path string, line_no int, raw string")


def _split(text: str) -> list[str]:
    out = re.split(BREAK_ALL, text)
    return out[:-1] if out and out[-1] == "" else out


def _added(was: str | None, now: str) -> list[tuple[int, str]]:
    b = _split(now or "")
    if was is None:
        return list(enumerate(b, 1))
    a = _split(was)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    return [(lo + j + 1, y[j]) for j in _inserted(x, y)]


def _inserted(a: list[str], b: list[str]) -> list[int]:
    """Places of b outside a longest common subsequence of both: the problem is halved where a shortest script's middle
    lies, so that memory follows the lines and not their edits."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
        if i == j or k == m:
            out += range(k, m)
            continue
        x, y = _middle(a[i:j], b[k:m])
        todo += [(i + x, j, k + y, m), (i, i + x, k, k + y)]
    return sorted(out)


def _middle(a: list[str], b: list[str]) -> tuple[int, int]:
    """A point (taken of a, taken of b) that a shortest edit script passes, neither at the start nor at the end: how far
    d edits reach from either side is followed until both meet. Both lists differ in their first and in their last line."""
    n, m = len(a), len(b)
    reach = ({1: 0}, {1: 0})  # by diagonal: lines of a passed, from the front and from the back
    sides = ((a, b), (a[::-1], b[::-1]))
    for d in range((n + m + 1) // 2 + 1):
        for side, (own, (p, q)) in enumerate(zip(reach, sides, strict=True)):
            other = reach[1 - side]
            for k in range(-d, d + 1, 2):
                down = k == -d or (k != d and own.get(k - 1, -1) < own.get(k + 1, -1))
                x = own[k + 1] if down else own[k - 1] + 1
                while x < n and x - k < m and p[x] == q[x - k]:
                    x += 1
                own[k] = x
                facing = other.get(n - m - k)
                # after a front step the back has made d - 1 edits, and after a back step the front has made d
                if facing is not None and (d + side - 1 - (n - m - k)) % 2 == 0 and abs(n - m - k) <= d + side - 1 and x + facing >= n:
                    return (x, x - k) if side == 0 else (n - x, m - (x - k))
    raise AssertionError("both sides meet")


def finding_report(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, path, n): by rule, by path with zeros kept, and the total, where both are null."""
    sets = findings.groupingSets([["rule"], ["path"], []], "rule", "path").agg(F.count("*").alias("n"))
    zero = files.select("path").distinct().join(findings.select("path").distinct(), "path", "left_anti").select(F.lit(None).cast("string").alias("rule"), "path", F.lit(0).cast("long").alias("n"))
    return sets.unionByName(zero)


def file_metrics(findings: DataFrame, files: DataFrame) -> DataFrame:
    """A row a file: the count of each metric. findings has path, rule and message."""
    def hit(rule: str, kind: str | None) -> Column:
        c = F.col("rule") == rule
        return F.coalesce(F.sum((c & F.col("message").contains(f"kind={kind}") if kind else c).cast("long")), F.lit(0))

    per = findings.groupBy("path").agg(*[hit(*v).alias(k) for k, v in METRICS.items()])
    return files.select("path").distinct().join(per, "path", "left").select("path", *[F.coalesce(m, F.lit(0)).alias(m) for m in METRICS])


def metric_totals(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.sum(c).alias(c) for c in metrics.columns if c != "path"])


def severity(metrics: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """(path, severity): metrics by weight."""
    w = weights or WEIGHTS
    total = F.lit(0)
    for k, n in w.items():
        total = total + n * F.col(k)
    return metrics.select("path", total.cast("long").alias("severity"))


def top_files(severities: DataFrame, n: int = 10) -> DataFrame:
    return severities.orderBy(F.col("severity").desc(), "path").limit(n)


def regressions(current: DataFrame, base: DataFrame) -> DataFrame:
    """(path, metric, before, after) of long-form metrics (path, metric, n) that rose: for paths the baseline knows and metrics
    that stand anywhere in it; a metric that a path lacks was 0."""
    known = base.select("metric").distinct()
    paths = base.select("path").distinct()
    after = current.join(known, "metric", "left_semi").join(paths, "path", "left_semi").withColumnRenamed("n", "after")
    before = base.withColumnRenamed("n", "before")
    return after.join(before, ["path", "metric"], "left").withColumn("before", F.coalesce("before", F.lit(0))).filter("after > before").select("path", "metric", "before", "after")


def is_fresh(current: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: whether two reports of equal columns hold the same rows."""
    gone = stored.exceptAll(current.select(*stored.columns)).limit(1)
    new = current.select(*stored.columns).exceptAll(stored).limit(1)
    return gone.unionAll(new).agg((F.count("*") == 0).alias("fresh"))


def clone_key(text: Column) -> Column:
    """Block comments, then line comments, then runs of white space as one space."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def clone_findings(units: DataFrame, scope: list[str], order: list[str], least: int = 12) -> DataFrame:
    """units with copies and the place of the first copy, for each but the first of a group of equal normalised text in the scope.

    Groups are counted on 256-bit hashes of the text, and no group is gathered: counts and firsts are joined back.
    """
    u = units.withColumn("_key", clone_key(F.col("text"))).filter(F.length("_key") >= least).withColumn("_hash", F.sha2("_key", 256))
    groups = u.groupBy(*scope, "_hash").agg(F.count("*").alias("copies"), F.min(F.struct(*order)).alias("first")).filter("copies > 1")
    out = u.join(groups, [*scope, "_hash"])
    return out.filter(F.struct(*order) != F.col("first")).drop("_key", "_hash", "text")


def class_clones(units: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Clones among classes, whose own name is put out of the comparison."""
    named = units.withColumn("text", F.regexp_replace("text", r"^(\s*(?:class|struct)\s+)\w+", "$1N"))
    return clone_findings(named, scope, order)


def matched_name_findings(source: DataFrame, items: DataFrame) -> DataFrame:
    """(path, name, line_no, id): the first place in each file of each name of an accepted item; the later item wins a name.

    items (id, symbol, function, status, ord): both names are keys.
    """
    keys = items.filter(F.col("status").isin(*ACCEPTED)).select("id", "ord", F.explode(F.array_compact(F.array("symbol", "function"))).alias("name")).groupBy("name").agg(F.max_by("id", "ord").alias("id"))
    words = source.select("path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\w+"), 0))).alias("name"))
    return words.join(keys, "name").groupBy("path", "name", "id").agg(F.min("line_no").alias("line_no"))


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line_no", "rule_ord")


class Spans:
    """Spans that do not meet, in order: a new one is held against its two neighbours."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Keeps a span that meets no kept one; whether it did."""
        i = bisect_left(self.starts, start)
        while i < len(self.starts) and self.ends[i] <= start:  # empty spans at one place
            i += 1
        if (i and self.ends[i - 1] > start) or (i < len(self.starts) and self.starts[i] < end):
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def pointer_findings(files: DataFrame) -> DataFrame:
    """(path, rule, start, end) of pointer patterns, greedily in the order of the rules: a match is kept if it meets no kept
    one. A match costs the logarithm of how many are kept in its file."""
    rules = [(r, re.compile(p)) for r, p in POINTER_RULES.items()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, text in zip(f["path"], f["text"], strict=True):
                kept = Spans()
                out += [(path, rule, *m.span()) for rule, pattern in rules for m in pattern.finditer(text or "") if kept.add(*m.span())]
            yield pd.DataFrame(out, columns=["path", "rule", "start", "end"])

    return files.select("path", "text").mapInPandas(run, "path string, rule string, start int, end int")


def fake_array_access(source: DataFrame) -> DataFrame:
    """(path, line_no, name): names indexed by a number that no line of the file declares as an array."""
    indexed = source.select("path", "line_no", F.explode(F.regexp_extract_all("code", F.lit(r"(?<![\w.>])(\w+)\s*\[\s*(?:0[xX][0-9A-Fa-f]+|\d+|'[^']*')\s*\]"), 1)).alias("name"))
    declared = source.select("path", F.explode(F.regexp_extract_all("code", F.lit(r"\b\w+[\s*&]+(\w+)\s*\[[^\]]*\]\s*(?:=|;|,|\))"), 1)).alias("name")).distinct()
    return indexed.join(declared, ["path", "name"], "left_anti").distinct()


def define_rename_alias(source: DataFrame, placeholder: str = r"^(?:func_[0-9A-Fa-f]{7,8}|lbl_\w+|Class_[0-9A-Fa-f]+)$") -> DataFrame:
    """(path, line_no, name, alias, block): #define of a placeholder as a plain name; block where the file has its #undef."""
    d = source.select("path", "line_no", F.regexp_extract("code", r"^\s*#\s*define\s+(\w+)\s+(\w+)\s*$", 1).alias("name"), F.regexp_extract("code", r"^\s*#\s*define\s+(\w+)\s+(\w+)\s*$", 2).alias("alias")).filter("name <> ''")
    d = d.filter(F.col("name").rlike(placeholder) & ~F.col("alias").rlike(placeholder) & F.col("alias").rlike("^[A-Za-z_]"))
    undef = source.select("path", F.regexp_extract("code", r"^\s*#\s*undef\s+(\w+)", 1).alias("name")).filter("name <> ''").distinct().withColumn("block", F.lit(True))
    return d.join(undef, ["path", "name"], "left").select("path", "line_no", "name", "alias", F.coalesce("block", F.lit(False)).alias("block"))

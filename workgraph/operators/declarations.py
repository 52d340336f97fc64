"""Declarations and definitions of a corpus, class membership by name, and the conversion plan of every class."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_name, member_name, split_name, strip_comments
from ..tables import written
from .registry import ACCEPTED, is_placeholder

MOST_LINES = 8  # lines that one declaration may go on for

# The marks of C linkage, what may stand around a declared name, and the names of an object's own parameter.
EXTERN = r'extern\s+"C"'
DECLSPEC, GCC_ATTRIBUTE, LAST_MACRO = r"__declspec\s*\([^)]*\)", r"__attribute__\s*\(\([^)]*\)\)", r"\s+[A-Z_][A-Z0-9_]*$"
NO_DECLARATION = r"(?:typedef|using)\b"
POINTER_NAME = r"[^(\n]*\(\s*(?:[A-Za-z_]\w*\s*::\s*)?\*\s*(?:[A-Za-z_]\w*\s+)*([A-Za-z_]\w*)\s*\)"
CALL_NAME, LAST_NAME = r"([A-Za-z_]\w*)\s*\(", r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?$"
SELF = "(?:self|_this)"

_EXTERN = re.compile(EXTERN)
_HEAD = re.compile(r"^(?P<sig>[A-Za-z_][\w\s*&:<>,~]*?\b(?P<name>~?\w+(?:::~?\w+)*)\s*\([^;{}]*\)\s*(?:const\s*)?(?::[^{;]*)?)\{", re.M)
_UNIT = re.compile(r"^(?P<head>(?:class|struct)\s+(?P<cls>\w+)[^;{}()]*|[A-Za-z_][\w\s*&:<>,~]*?\b(?P<name>~?\w+(?:::~?\w+)*)\s*\([^;{}]*\)\s*(?:const\s*)?(?::[^{;]*)?)\{", re.M)
_NOT_NAMES = frozenset("if for while switch return sizeof do else catch".split())


#: Comments, and literals, in which nothing else begins.
_ASIDE = re.compile(r"""/\*.*?(?:\*/|\Z)|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_INK = re.compile(r"[^\n]")


def code_only(text: str, literals: bool = True) -> str:
    """text of the same length and lines with blanks for comments, whatever lines they cross; without literals, for them too."""
    return _ASIDE.sub(lambda m: m[0] if literals and m[0][0] in "\"'" else _INK.sub(" ", m[0]), text)


def declared_name(text: str) -> str | None:
    """The name a declaration gives: that of a pointer to a function or member, else the one before the first bracket where a
    bracket ends it, else the last word. Attributes do not count."""
    text = re.sub(DECLSPEC, "", text, count=1).strip().removesuffix(";").strip()
    text = re.sub(GCC_ATTRIBUTE, "", re.sub(LAST_MACRO, "", text).strip(), count=1).strip()
    m = re.match(POINTER_NAME, text) or re.search(CALL_NAME if text.endswith(")") else LAST_NAME, text)
    return m[1] if m else None


class _Statement:
    """Lines of one statement as they are joined."""

    def __init__(self, line: int) -> None:
        self.line, self.parts, self.depth, self.end = line, [], 0, line

    def add(self, code: str, at: int) -> None:
        self.parts.append(code.strip())
        self.depth += code.count("{") - code.count("}")
        self.end = at

    @property
    def text(self) -> str:
        return " ".join(self.parts)

    def ended(self) -> bool:
        return self.parts[-1].endswith(";") or self.depth > 0

    def goes_on(self, code: str) -> bool:
        """Whether a line that is not blank goes on with the statement: one at the margin only after a comma or backslash."""
        return code[:1] in (" ", "\t") or self.parts[-1][-1:] in (",", "\\")


def statements(text: str) -> Iterator[tuple[int, str, str, str | None, str]]:
    """(line, kind, head, name, body) of what has C linkage, in one pass over text without comments.

    kind decl: a declaration, alone or in a linkage block, joined over its lines; body is empty. A null name is one that
    could not be read. kind def: a definition whose body opens on the line of its linkage; head is what stands before the
    body, and body what stands in its braces. Bodies, types, typedefs and initialised variables of a block are left out.
    """
    rows, shape = code_only(text).split("\n"), code_only(text, literals=False).split("\n")
    i = 0
    while i < len(rows):
        m = _EXTERN.search(rows[i])
        if not m:
            i += 1
            continue
        rest = (rows[i][: m.start()] + rows[i][m.end() :]).strip()
        if rest == "{":
            i = yield from _block(rows, shape, i + 1)
        elif "{" in rest:
            head = rest[: rest.index("{")].strip()
            body, i_end = _body(rows, shape, i)
            if "(" in head and (name := declared_name(head)) is not None:
                yield i + 1, "def", head, name, body
            i = i_end + 1
        else:
            s = _Statement(i)
            s.add(rest, i)
            j = i
            while not s.ended() and j - i < MOST_LINES and j + 1 < len(rows):
                j += 1
                code = rows[j]
                if not code.strip() or code.lstrip().startswith("#"):
                    continue
                if not s.goes_on(code):
                    j -= 1
                    break
                s.add(code, j)
            if "{" not in s.text and s.text.endswith(";"):
                yield i + 1, "decl", s.text, declared_name(s.text), ""
            i = max(j, i) + 1


def _block(rows: list[str], shape: list[str], i: int) -> Iterator[tuple]:
    """The declarations of a linkage block whose lines begin at i; returns the line after it."""
    depth, held = 0, None
    while i < len(rows):
        core = _EXTERN.sub("", rows[i], count=1).strip()
        depth += shape[i].count("{") - shape[i].count("}")
        if depth < 0:
            return i + 1
        if depth > 0:  # what was held has a body
            held = None
        elif core and (held or not (core.startswith(("}", "#")) or "{" in core or "=" in core or re.match(NO_DECLARATION, core))):
            held = held or _Statement(i)
            held.add(core, i)
            if held.parts[-1].endswith(";"):
                yield held.line + 1, "decl", held.text, declared_name(held.text), ""
                held = None
        i += 1
    return i


def _body(rows: list[str], shape: list[str], i: int) -> tuple[str, int]:
    """(text in the braces that open first on line i, the line that closes them)."""
    depth, parts, at = 0, [], i
    while at < len(rows):
        first = None if at > i else shape[i].index("{") + 1 if "{" in shape[i] else 0
        start = first or 0
        depth += first is not None
        for m in re.finditer(r"[{}]", shape[at][start:]):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return " ".join([*parts, rows[at][start : start + m.start()]]), at
        parts.append(rows[at][start:])
        at += 1
    return " ".join(parts), len(rows) - 1


def _balanced(shape: str, at: int) -> int:
    """The place after the brace that closes the one at at, in text without comments and literals; its end where none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(shape, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(shape)


def _definitions(text: str, pattern: re.Pattern) -> Iterator[tuple[re.Match, int]]:
    """(match, end) of what pattern finds before a body, outside comments."""
    shape = code_only(text, literals=False)
    for m in pattern.finditer(shape):
        yield m, _balanced(shape, m.end() - 1)


def _rows(files: DataFrame, schema: str, each) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *r) for p, t in zip(f["path"], f["text"], strict=True) for r in each(t or "")], columns=names)

    return files.select("path", "text").mapInPandas(run, schema)


def extract_linkage(files: DataFrame) -> DataFrame:
    """(path, line_no, kind, head, name, body) of declarations and definitions of C linkage, as statements() reads them."""
    return _rows(files, "path string, line_no int, kind string, head string, name string, body string", statements)


def extract_decls(files: DataFrame) -> DataFrame:
    """(path, line_no, decl, name) of extern "C" declarations; a null name is one that could not be read."""
    return extract_linkage(files).filter("kind = 'decl'").select("path", "line_no", F.col("head").alias("decl"), "name")


def extract_defs(files: DataFrame) -> DataFrame:
    """(path, line_no, name, body) of function definitions, with balanced bodies."""

    def each(text: str):
        for m, end in _definitions(text, _HEAD):
            if m["name"] not in _NOT_NAMES:
                yield text.count("\n", 0, m.start()) + 1, m["name"], text[m.end() - 1 : end]

    return _rows(files, "path string, line_no int, name string, body string", each)


def extract_heads(files: DataFrame) -> DataFrame:
    """(path, line_no, name, sig) of function definitions: what stands before the body."""

    def each(text: str):
        for m in _HEAD.finditer(code_only(text, literals=False)):
            if m["name"] not in _NOT_NAMES:
                yield text.count("\n", 0, m.start()) + 1, m["name"], " ".join(m["sig"].split())

    return _rows(files, "path string, line_no int, name string, sig string", each)


def extern_c_findings(files: DataFrame) -> DataFrame:
    """(path, line_no, rule, kind, message) of declarations of C linkage: a label's, a definition, a function's declaration, or
    something else. file_metrics() reads the kind in the message."""
    d = extract_linkage(files).select("path", "line_no", F.col("kind").alias("is"), F.col("head").alias("decl"))
    kind = F.when(F.col("decl").rlike(r"\blbl_\w+"), "lbl").when(F.col("is") == "def", "nonlbl-def").when(F.col("decl").contains("("), "nonlbl-decl").otherwise("other")
    d = d.withColumn("rule", F.lit("smell.extern_c")).withColumn("kind", kind)
    return d.select("path", "line_no", "rule", "kind", F.concat(F.lit('extern "C" '), "kind", F.lit(" '"), F.substring("decl", 1, 80), F.lit("' (kind="), "kind", F.lit(")")).alias("message"))


_VOID_PARAM = re.compile(r"\bvoid\s*\*(?!\s*\*)")


def void_ptr_params(files: DataFrame, items: DataFrame) -> DataFrame:
    """(path, line_no, name, param, id) of void* parameters in definitions whose name is an accepted item's symbol or
    function; the later item (by ord) has a name. Names count with and without their class."""

    def each(text: str):
        for m in _HEAD.finditer(code_only(text, literals=False)):
            if m["name"] not in _NOT_NAMES:
                inside = m["sig"][m["sig"].index("(") + 1 : m["sig"].rindex(")")]
                for param in inside.split(","):
                    if _VOID_PARAM.search(param):
                        yield text.count("\n", 0, m.start()) + 1, m["name"], " ".join(param.split())[:100]

    found = _rows(files, "path string, line_no int, name string, param string", each)
    found = found.withColumn("key", F.explode(F.array_distinct(F.array("name", F.substring_index("name", "::", -1)))))
    keys = items.filter(F.col("status").isin(*ACCEPTED)).select("id", "ord", F.explode(F.array_compact(F.array("symbol", "function"))).alias("key")).groupBy("key").agg(F.max_by("id", "ord").alias("id"))
    return found.join(keys, "key").groupBy("path", "line_no", "name", "param").agg(F.min("id").alias("id"))


def extract_units(files: DataFrame) -> DataFrame:
    """(path, line_no, kind, name, text) of functions and classes, the units that clones are looked for among."""

    def each(text: str):
        for m, end in _definitions(text, _UNIT):
            name = m["cls"] or m["name"]
            if name not in _NOT_NAMES:
                yield text.count("\n", 0, m.start()) + 1, "class" if m["cls"] else "function", name, text[m.start() : end] if m["cls"] else text[m.end() - 1 : end]

    return _rows(files, "path string, line_no int, kind string, name string, text string", each)


def skip_asm_bodies(files: DataFrame) -> DataFrame:
    """(path, line_no, entry) of lines of inline-assembly bodies; entry marks the one that opens a body."""

    def each(text: str):
        depth, open_ = 0, False
        for n, raw in enumerate(text.split("\n"), 1):
            code = raw.split("//", 1)[0]
            start = not open_ and re.search(r"\b(?:__asm|asm)\b[^;]*$", code)
            if start:
                open_, depth = True, 0
            if open_:
                yield n, bool(start)
                depth += code.count("{") + code.count("(") - code.count("}") - code.count(")")
                if depth <= 0 and re.search(r"[})]", code):
                    open_ = False

    return _rows(files, "path string, line_no int, entry boolean", each)


def drop_asm_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings outside inline-assembly bodies; on the line that opens one, the assembly rule's stay."""
    a = skip_asm_bodies(files)
    out = findings.join(a, ["path", "line_no"], "left")
    return out.filter(F.col("entry").isNull() | (F.col("entry") & (F.col("rule") == "smell.asm_code"))).drop("entry")


def _split_names(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("m", split_name(F.col("name"))).filter("m.class is not null")


def class_members(symbols: DataFrame) -> DataFrame:
    """(class, ordinal, name, ctor, dtor, target): the retail names of classes, a row each, with constructor and destructor
    flags and target, the canonical name of one that deviates (else null)."""
    return _split_names(symbols).select(F.col("m.class").alias("class"), "ordinal", "name", F.col("m.ctor").alias("ctor"), F.col("m.dtor").alias("dtor"), canonical_name(F.col("name"), F.col("m")).alias("target"))


def class_scopes(symbols: DataFrame) -> DataFrame:
    """(class, namespaces, scope), a row a class: the namespace path, and the scope that holds the class too, of its first
    scoped member."""
    scoped = F.when(F.size("m.scope") > 0, F.struct("ordinal", F.col("m.namespaces").alias("ns"), F.col("m.scope").alias("scope")))
    none = F.array().cast("array<string>")
    g = _split_names(symbols).groupBy(F.col("m.class").alias("class")).agg(F.min(scoped).alias("first"))
    return g.select("class", F.coalesce("first.ns", none).alias("namespaces"), F.coalesce("first.scope", none).alias("scope"))


def rename_targets(defs: DataFrame, scopes: DataFrame) -> DataFrame:
    """defs (class, name, ...) with naive_target, the name as a method without parameters or scope, and target, the canonical
    name in the scope of class_scopes(): a constructor's or destructor's where the name says so, else a method's."""
    of = scopes.select(F.col("class").alias("_class"), F.col("scope").alias("_scope"))
    d = defs.join(of, defs["class"] == F.col("_class"), "left").withColumn("_scope", F.coalesce("_scope", F.array().cast("array<string>")))
    member = F.when(F.col("name").startswith("__ct__"), "__ct").when(F.col("name").startswith("__dt__"), "__dt").otherwise(F.col("name"))
    naive = member_name(F.col("name"), F.col("class"), F.array().cast("array<string>"))
    return d.withColumn("naive_target", naive).withColumn("target", member_name(member, F.col("class"), F.col("_scope"))).drop("_class", "_scope")


def fake_members(lines: DataFrame, name: str) -> DataFrame:
    """Lines of a class's source that cast self to the class, outside its own member definitions."""
    trick = rf"\(\s*{re.escape(name)}\s*\*\s*\)\s*self\b|\b{re.escape(name)}\s*\*\s*self\b"
    return lines.filter(F.col("code").rlike(trick) & ~F.col("code").rlike(rf"\b{re.escape(name)}::~?\w+\s*\("))


class ConversionPlan(NamedTuple):
    """The tables of a plan, by class: a class may have any number of rows in each, and none is gathered."""

    hits: DataFrame  # (class, path, line_no, kind, name)
    members: DataFrame  # (class, ordinal, name, ctor, dtor, target)
    targets: DataFrame  # (class, path, line_no, name, naive_target, target)
    call_sites: DataFrame  # (class, path, line_no, name)

    @property
    def renames(self) -> DataFrame:
        """Members to rename, with their canonical names."""
        return self.members.filter("target is not null")

    def sites(self) -> DataFrame:
        """(class, n_sites), a row for each class with hits."""
        return counted(self.hits.select("class").distinct(), self.call_sites, "n_sites")


def counted(classes: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """classes with the number of their rows; none is 0."""
    n = rows.groupBy("class").agg(F.count("*").alias(name))
    return classes.join(n, "class", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def conversion_plan(files: DataFrame, symbols: DataFrame) -> ConversionPlan:
    """The plan of all classes at once: where a definition casts or takes self of a class, or a declaration names it (hits);
    the retail names of classes with hits, and those to rename with their canonical names; the mangled names of its
    definitions; and the lines that call them."""
    from .binary import plan_call_sites
    from .lint import lines

    defs = extract_defs(files).withColumn("body", strip_comments(F.col("body")))
    cast = F.regexp_extract("body", rf"\(\s*(\w+)\s*\*+\s*\)\s*{SELF}\b", 1)
    own = defs.select("path", "line_no", "name", cast.alias("class")).filter("`class` <> ''").withColumn("kind", F.lit("def-selfcast"))
    # a definition that takes self of the class, without a cast in its body
    takes = extract_heads(files).select("path", "line_no", "name", F.regexp_extract("sig", rf"\b(\w+)\s*\*\s*{SELF}\b", 1).alias("class")).filter("`class` <> ''").withColumn("kind", F.lit("def-param"))
    takes = takes.join(own.select("path", "line_no", "name", "class"), ["path", "line_no", "name", "class"], "left_anti")
    decl = extract_decls(files).select("path", "line_no", "name", F.regexp_extract("decl", rf"\b(\w+)\s*\*\s*{SELF}\b", 1).alias("class")).filter("`class` <> '' and name is not null").withColumn("kind", F.lit("decl"))
    own = written(own.unionByName(takes))  # the hits, targets and sites below read it
    hits = own.unionByName(decl)
    named = own.select("name", "path", "line_no", F.xxhash64("path", "line_no", "name").alias("ord"))
    sites = plan_call_sites(lines(files), named).join(own.select("name", "class").distinct(), "name")
    members = class_members(symbols).join(hits.select("class").distinct(), "class", "left_semi")
    targets = rename_targets(own.filter("not name like '%::%'"), class_scopes(symbols))
    return ConversionPlan(hits.select("class", "path", "line_no", "kind", "name"), members, targets.select("class", "path", "line_no", "name", "naive_target", "target"), sites.select("class", "path", "line_no", "name"))


def all_findings(files: DataFrame, items: DataFrame) -> DataFrame:
    """(path, line_no, rule) of every rule family over a corpus: text and line rules, casts that assign, pointer patterns, C
    linkage, indexed names, renaming defines, clones of functions and classes, and names of accepted items."""
    from . import lint

    src = lint.lines(files)
    pack, gates = lint.built_in_rules()
    row = lambda d, rule: d.select("path", "line_no", rule.alias("rule"))
    before = F.substring(F.col("text"), F.lit(1), F.col("start"))
    pointers = lint.pointer_findings(files).join(files.select("path", "text"), "path").withColumn("line_no", F.regexp_count(before, F.lit(lint.BREAK)) + 1)
    units, place = extract_units(files), ["path", "line_no"]
    parts = [
        row(lint.lint(src, pack, gates), F.col("rule")), row(lint.init_side_effects(files), F.lit("smell.init_side_effect")), row(pointers, F.col("rule")), row(extern_c_findings(files), F.col("rule")),
        row(lint.fake_array_access(src), F.lit("smell.fake_array_access")), row(lint.define_rename_alias(src), F.lit("smell.define_rename_alias")),
        row(lint.class_clones(units.filter("kind = 'class'"), [], place), F.lit("clone.duplicate_class")), row(lint.clone_findings(units.filter("kind = 'function'"), [], place), F.lit("clone.repeated_code")),
        row(void_ptr_params(files, items), F.lit("match.void_ptr_params")),
    ]
    named = lint.matched_name_findings(src, items)
    parts += [row(named.filter(is_placeholder(F.col("name"), family)), F.lit(rule)) for family, rule in (("function", "match.func_placeholder"), ("class", "match.class_placeholder"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

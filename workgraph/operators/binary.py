"""Listings and symbols: call graph, register provenance, member verdicts and declaration classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: Fixed values, as are the verdict texts below: mnemonics that only read r3, integer operations, and loads.
READERS = ("cmp", "b", "bl", "blr", "bctrl", "st", "mtctr", "mtlr", "mfspr", "mftb", "bc", "bcctr")
INTEGER_OPS = ("rlwinm", "slwi", "srwi", "srawi", "rlwimi", "or", "orc", "and", "andc", "xor", "add", "sub", "subf", "mulli", "mullw", "divw", "neg", "extsb", "extsh", "cntlzw", "clrlwi", "clrrwi", "rotlwi")
LOADS = ("lwz", "lbz", "lhz", "lha", "lfs", "lfd")
DEREF_LOAD = r"(?:lwz|lbz|lhz|lha|lfs|lfd)\s+r\d+,\s*([0-9A-Fa-fxX]+)\(r3\)"
DEREF_STORE = r"(?:stw|stb|sth|stfs|stfd)\s+r\d+,\s*([0-9A-Fa-fxX]+)\(r3\)"


def hex_value(text: Column) -> Column:
    """A number read as hex with or without 0x."""
    return F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, 10).cast("long")


def is_reader(mnemonic: Column) -> Column:
    """Whether a mnemonic begins with one of READERS."""
    return mnemonic.rlike("^(" + "|".join(READERS) + ")")


def call_edges(insns: DataFrame) -> DataFrame:
    """(file, caller, callee, idx) of direct calls; local labels and section names are none."""
    target = F.trim(F.substring_index("operands", ",", 1))
    return insns.filter("mnemonic = 'bl'").select("file", F.col("fn").alias("caller"), target.alias("callee"), "idx").filter("not startswith(callee, '.') and not startswith(callee, '@')")


def call_graph(edges: DataFrame) -> DataFrame:
    """(fn, callees, callers), each distinct and in the order of first sight."""
    def side(key: str, other: str, name: str) -> DataFrame:
        first = edges.groupBy(F.col(key).alias("fn"), F.col(other).alias("other")).agg(F.min(F.struct("file", "idx")).alias("at"))
        return first.groupBy("fn").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "other"))), lambda x: x["other"]).alias(name))

    return side("caller", "callee", "callees").join(side("callee", "caller", "callers"), "fn", "full").select("fn", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("callees", "callers")])


def callee_usage(insns: DataFrame) -> DataFrame:
    """How each function uses r3: derefs and their highest offset, stores, virtual dispatch, integer use only."""
    full = F.concat_ws(" ", "mnemonic", "operands")
    i = insns.withColumn("_full", full).withColumn("_l", F.regexp_extract("_full", DEREF_LOAD, 1)).withColumn("_s", F.regexp_extract("_full", DEREF_STORE, 1))
    i = i.withColumn("_r3", F.col("_full").contains("r3")).withColumn("_d", (F.col("_l") != "") | (F.col("_s") != ""))
    i = i.withColumn("_o", F.when(F.col("_l") != "", hex_value(F.col("_l"))).when(F.col("_s") != "", hex_value(F.col("_s"))))
    other = F.col("_r3") & ~F.col("_d")
    g = i.groupBy("fn").agg(
        F.bool_or("_d").alias("deref"), F.coalesce(F.max("_o"), F.lit(0)).alias("max_offset"), F.bool_or((F.col("_s") != "") & (F.col("_l") == "")).alias("stores"),
        F.bool_or((F.col("mnemonic") == "lwz") & F.col("operands").rlike(r"\br12\b") & F.col("operands").contains("(r3)")).alias("_v"), F.bool_or(F.col("mnemonic") == "bctrl").alias("_b"),
        F.bool_or(other & F.col("mnemonic").isin(*INTEGER_OPS)).alias("_i"), F.bool_or(other & F.col("mnemonic").isin("mr", "bl", "lwz", "stw") & F.col("operands").rlike(r"r3\b")).alias("_f"),
        F.sum(F.col("_r3").cast("long")).alias("r3_ops"), F.sum(F.col("_d").cast("long")).alias("derefs"),
    )
    only = (F.col("derefs") == 0) & (F.col("r3_ops") > 0) & (F.col("_i") | ~F.col("_f"))
    return g.select("fn", "deref", "max_offset", "stores", (F.col("_v") & F.col("_b")).alias("vtable_dispatch"), only.alias("integer_only"), "r3_ops", "derefs")


#: Mnemonics whose operands are all read when a parameter is inferred.
READ_ONLY = ("stw", "stb", "sth", "stfs", "stfd", "stwx", "cmpwi", "cmpw", "cmplwi", "cmplw", "cmp", "mtctr", "mtlr", "bctrl", "bl", "bc")


def callee_params(insns: DataFrame) -> DataFrame:
    """(fn, register, class) of the argument registers whose first mention in the function is a read. A register is int where
    any integer operation stands in the body, whatever it works on."""
    regs = [*[f"r{i}" for i in range(3, 11)], *[f"f{i}" for i in range(1, 5)]]
    said = insns.select("fn", "file", "idx", "mnemonic", "operands", F.explode(F.array(*map(F.lit, regs))).alias("register"))
    word = F.concat(F.lit(r"\b"), F.col("register"), F.lit(r"\b"))
    said = said.filter(F.regexp_like("operands", word))
    ops = F.transform(F.filter(F.split("operands", r"\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, ",$", ""))
    said = said.withColumn("_ops", ops)
    read = F.col("mnemonic").isin(*READ_ONLY) | (F.get("_ops", 0) != F.col("register")) | F.array_contains(F.slice("_ops", F.lit(2), F.size("_ops")), F.col("register"))
    compare = F.col("mnemonic").startswith("cmp")
    g = said.groupBy("fn", "register").agg(
        F.min_by(read, F.struct("file", "idx")).alias("_read"), F.bool_or(F.col("operands").contains(F.concat(F.lit("("), F.col("register"), F.lit(")")))).alias("_ptr"),
        F.bool_or(compare).alias("_cmp"), F.bool_and(~compare | F.col("operands").rlike("0x[01]$")).alias("_small"),
    )
    integer = insns.groupBy("fn").agg(F.bool_or(F.col("mnemonic").isin(*INTEGER_OPS)).alias("_int"))
    kind = F.when(F.col("register").startswith("f"), "float").when(F.col("_ptr"), "ptr").when(F.col("_cmp") & F.col("_small"), "bool").when(F.col("_int") | F.col("_cmp"), "int").otherwise("opaque")
    return g.filter("_read").join(integer, "fn").select("fn", "register", kind.alias("class"))


def r3_provenance(insns: DataFrame) -> DataFrame:
    """(file, idx, callee, kind, detail): where r3 comes from at each call, from the 8 instructions before it in the file and,
    for a copy from another register, the 8 before the copy. One window of 16 rows; no rows are joined."""
    w = Window.partitionBy("file").orderBy("idx").rowsBetween(-16, -1)
    word = lambda text, reg: F.regexp_like(text, F.concat(F.lit(r"\b"), reg, F.lit(r"\b")))
    back = F.reverse(F.collect_list(F.struct("mnemonic", "operands")).over(w))
    calls = insns.withColumn("_back", back).filter("mnemonic = 'bl'").withColumn("callee", F.trim(F.substring_index("operands", ",", 1)))
    near = F.slice("_back", 1, 8)
    hit = F.filter(F.transform(near, lambda x, i: F.struct(i.alias("at"), x["mnemonic"].alias("m"), x["operands"].alias("o"))), lambda x: (x["m"] == "bl") | (word(x["o"], F.lit("r3")) & ~is_reader(x["m"])))
    c = calls.withColumn("_hit", F.try_element_at(hit, F.lit(1)))
    m, o = F.col("_hit.m"), F.col("_hit.o")
    tokens = lambda text: F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, ",$", ""))
    part = lambda text, n: F.get(tokens(text), n)
    source = F.coalesce(part(o, 1), F.lit("?"))
    c = c.withColumn("_src", source).withColumn("_chain", F.filter(F.slice("_back", F.coalesce(F.col("_hit.at"), F.lit(0)) + 2, 8), lambda x: word(x["operands"], F.col("_src")) & ~is_reader(x["mnemonic"])))
    c = c.withColumn("_two", F.try_element_at("_chain", F.lit(1)))
    m2, o2 = F.col("_two.mnemonic"), F.col("_two.operands")
    label = lambda t: t.contains("@l") | t.contains("@ha")

    def kind_of(mn: Column, op: Column, fields: int, need: bool) -> Column:
        n = F.size(tokens(op))
        addi = (mn == "addi") & ((part(op, 0) == "r3") if need else (n >= 3))
        return (
            F.when(mn.isin("li", "lis"), "CONSTANT").when(mn.isin(*LOADS) & (n >= fields) & ((part(op, 0) == "r3") if need else F.lit(True)), "LOAD_FIELD")
            .when(addi & label(op), "ADDR_LABEL").when(addi & (n >= 3) & (part(op, 1) == "r1"), "ADDR_STACK").when(addi, "ADDI")
        )

    chained = F.when(m2.isNull(), "COPY").otherwise(F.coalesce(kind_of(m2, o2, 2, False), F.when(m2 == "mr", "COPY").otherwise(F.upper(m2))))
    copied = (m == "mr") & (part(o, 0) == "r3")
    kind = F.when(m.isNull(), "UNKNOWN").when(m == "bl", "CALL_RESULT").when(copied, chained).otherwise(F.coalesce(kind_of(m, o, 3, True), F.upper(m)))
    told = lambda mn, op: F.when(mn.isin("li", "lis"), F.concat_ws(" ", mn, op)).otherwise(op)
    detail = F.when(m.isNull(), "").when(copied, F.when(m2.isNull(), o).otherwise(told(m2, o2))).when(m == "bl", o).otherwise(told(m, o))
    return c.select("file", "idx", "callee", kind.alias("kind"), detail.alias("detail"))


def provenance_counts(provenance: DataFrame) -> DataFrame:
    """(callee, kind, n)."""
    return provenance.groupBy("callee", "kind").agg(F.count("*").alias("n"))


def member_verdict(insns: DataFrame, class_size: int = 0, pointers: DataFrame | None = None) -> DataFrame:
    """(symbol, kind, verdict) for every function and callee in one job: the chain of tests in order, the first that holds.
    With pointers (name, from scanned object words), also vtable_hints: how often the symbol's address is stored as data.
    A hint never changes the verdict."""
    p = r3_provenance(insns)
    imm = F.regexp_extract("detail", r"^(?:li|lis)\s+r3\s*,\s*(0x[0-9A-Fa-f]+|\d+)", 1)
    value = F.when(imm.startswith("0x"), hex_value(imm)).otherwise(imm.cast("long"))
    sites = p.groupBy(F.col("callee").alias("symbol")).agg(
        F.count("*").alias("sites"), F.bool_or((F.col("kind") == "CONSTANT") & (imm != "") & (value != 0)).alias("n1"),
        F.sum((F.col("kind") == "ADDR_STACK").cast("long")).alias("stack"), F.sum(F.col("kind").isin("ADDR_LABEL", "LOAD_FIELD").cast("long")).alias("anchored"),
    )
    d = callee_usage(insns).withColumnRenamed("fn", "symbol").join(sites, "symbol", "full")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n3 = F.lit(class_size > 0) & (F.coalesce("max_offset", F.lit(0)) >= class_size)
    far = F.concat(F.lit("NOT member of class (N3: r3 offset 0x"), F.lower(F.hex(F.coalesce("max_offset", F.lit(0)))), F.lit(f" >= size {hex(class_size)})"))
    chain = [
        (yes("n1"), "not_member", F.lit("NOT non-static member (N1: constant r3 at call site)")),
        (yes("integer_only"), "integer_only", F.lit("NOT non-static member (r3 used as integer, never deref'd)")),
        (~yes("deref") & (F.coalesce("r3_ops", F.lit(0)) > 0), "not_member", F.lit("NOT non-static member (N2: r3 never deref'd/forwarded)")),
        (n3, "not_member", far),
        (yes("vtable_dispatch"), "vtable_dispatch", F.lit("possible virtual member (vtable dispatch via r3; confirm vtable membership)")),
        (yes("deref") & (F.col("sites") > 0) & (F.col("stack") == F.col("sites")), "review", F.lit("Tier B: flag for review (derefs r3 but all-stack provenance)")),
        (yes("deref") & (F.coalesce("anchored", F.lit(0)) > 0), "member", F.lit("possible member (instance-anchored r3 calls; not exclusive)")),
        (yes("deref"), "undecidable", F.lit("Tier B: flag for review (derefs r3; no instance-anchored call sites)")),
    ]
    kind, verdict = F.lit("not_member"), F.lit("NOT non-static member (r3 never used as object base)")
    for test, k, text in reversed(chain):
        hold = F.coalesce(test, F.lit(False))
        kind, verdict = F.when(hold, k).otherwise(kind), F.when(hold, text).otherwise(verdict)
    out = d.select("symbol", kind.alias("kind"), verdict.alias("verdict"))
    if pointers is None:
        return out
    hints = pointers.groupBy(F.col("name").alias("symbol")).agg(F.count("*").alias("vtable_hints"))
    return out.join(hints, "symbol", "left").withColumn("vtable_hints", F.coalesce("vtable_hints", F.lit(0)).cast("long"))


# What a header's drift is called.
STATIC_DRIFT, MEMBER_DRIFT, COUNT_DRIFT = "header declares static but binary shows this-taking", "header declares member but binary proves no-this", "header %d params, binary %d"
#: Fixed value: a declaration of a placeholder function in a header.
HEADER_DECL = r"^\s*(static\s+)?[\w\s*&:<>]*?\b(func_[0-9A-Fa-f]{8})\w*\s*\("


def header_drift(lines: DataFrame, symbols: DataFrame, insns: DataFrame) -> DataFrame:
    """(path, line_no, retail, drift): declarations of placeholder functions (lines of path, line_no, raw) that the binary
    contradicts, by the first symbol in file order that begins with the declared name: static or not, and the number of
    parameters. Equi-joins on the 13 characters of a placeholder name. Of the listing, only files that define or call one of
    these symbols are examined: what they show of it, no other file can add to."""
    inside = F.regexp_extract("raw", r"\((.*)\)", 1)
    d = lines.select("path", "line_no", F.regexp_extract("raw", HEADER_DECL, 1).alias("st"), F.regexp_extract("raw", HEADER_DECL, 2).alias("base"), inside.alias("inside")).filter("base <> ''")
    d = d.withColumn("n_header", F.when(F.trim("inside") == "", 0).otherwise(F.size(F.split("inside", ","))))
    retail = symbols.groupBy(F.substring("name", 1, 13).alias("base")).agg(F.min_by("name", F.struct("ordinal", "name")).alias("retail"))
    d = written(d.join(retail, "base"))
    named = F.array_compact(F.array("fn", F.when(F.col("mnemonic") == "bl", F.trim(F.substring_index("operands", ",", 1)))))
    files = insns.select("file", F.explode(named).alias("retail")).distinct().join(written(d.select("retail").distinct()), "retail", "left_semi")
    files = written(files.select("file").distinct())
    insns = insns.limit(0) if files.isEmpty() else insns.join(files, insns["file"].eqNullSafe(files["file"]), "left_semi")
    n = callee_params(insns).groupBy(F.col("fn").alias("retail")).agg(F.count("*").alias("n_binary"))
    v = member_verdict(insns).select(F.col("symbol").alias("retail"), "verdict")
    out = d.join(n, "retail", "left").join(v, "retail", "left").withColumn("n_binary", F.coalesce("n_binary", F.lit(0)))
    # a symbol that the listing has never seen is no object base anywhere
    told = F.coalesce("verdict", F.lit("NOT non-static member (r3 never used as object base)"))
    static, never, member = F.col("st") != "", told.startswith("NOT non-static member"), told.contains("possible member") | told.contains("possible virtual")
    drift = F.array_compact(F.array(F.when(static & member, STATIC_DRIFT), F.when(~static & never, MEMBER_DRIFT), F.when((F.col("n_binary") > 0) & (F.col("n_binary") != F.col("n_header")), F.format_string(COUNT_DRIFT, "n_header", "n_binary"))))
    return out.select("path", "line_no", "retail", F.array_join(drift, "; ").alias("drift")).filter("drift <> ''")


# --- symbols -----------------------------------------------------------------------------------------------------------


def first_names(symbols: DataFrame) -> DataFrame:
    """The first row of each name in file order."""
    return symbols.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("ordinal"))).filter("_r = 1").drop("_r")


def symbol_index(symbols: DataFrame) -> DataFrame:
    """(address_key, names in file order)."""
    return symbols.groupBy("address_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("names"))


def name_universe(symbols: DataFrame, reloc: DataFrame) -> DataFrame:
    """(name, ordinal): symbols' names, then names of reloc that are not among them, after the last."""
    own = symbols.groupBy("name").agg(F.min("ordinal").alias("ordinal"))
    late = reloc.select("name").distinct().join(own, "name", "left_anti").join(symbols.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("_last")))
    return own.unionByName(late.select("name", (F.col("_last") + 1).alias("ordinal")))


def prefix_drift(decls: DataFrame, names: DataFrame) -> DataFrame:
    """(name, drift) by prefix: a retail name that the declared one begins, else one that begins the declared name; the first in file order.

    Equi-joins on cut names: for every distinct length of the one side, the other side's names are cut to it.
    """
    d = decls.select("name").distinct()
    lengths = d.select(F.length("name").alias("n")).distinct().agg(F.collect_set("n").alias("ns"))  # as many as names have lengths
    cut = names.join(F.broadcast(lengths)).select(F.col("name").alias("retail"), "ordinal", F.explode("ns").alias("n")).filter("length(retail) > n").select("retail", "ordinal", F.expr("substring(retail, 1, n)").alias("name"))
    longer = d.join(cut, "name").groupBy("name").agg(F.min_by("retail", F.struct("ordinal", "retail")).alias("longer"))
    lengths = names.select(F.length("name").alias("n")).distinct().agg(F.collect_set("n").alias("ns"))
    cut = d.join(F.broadcast(lengths)).select("name", F.explode("ns").alias("n")).filter("length(name) > n and n > 0").select("name", F.expr("substring(name, 1, n)").alias("retail"))
    shorter = cut.join(names.withColumnRenamed("name", "retail"), "retail").groupBy("name").agg(F.min_by("retail", F.struct("ordinal", "retail")).alias("shorter"))
    return d.join(longer, "name", "left").join(shorter, "name", "left").select("name", F.coalesce("longer", "shorter").alias("drift")).filter("drift is not null")


#: Fixed value: a first parameter that stands for an object.
SELF_FIRST = r"\(\s*(?:[A-Za-z_:<>]+|void)\s*\*\s*(?:self|_this|p)\b|\(\s*void\s*\*\s*self"


def classify_decls(decls: DataFrame, symbols: DataFrame, reloc: DataFrame) -> DataFrame:
    """(ord, name, class, resolved, hint): unparsed, exact, jp_stale, drift or invented, with the name it resolves to. hint
    tells of members: a __ in the name, or, where decls has the text (decl), a first parameter that stands for an object.

    An embedded address (8 hex digits in the name) resolves to the first occupant of that address: stale where the name is a
    retail name elsewhere, drift where another name lives there. Then prefixes, then equal text after the last __.
    """
    names = name_universe(symbols, reloc)
    exact = names.select(F.col("name").alias("_n"), F.lit(True).alias("_exact"))
    hexes = decls.filter("name is not null").select("ord", "name", F.posexplode(F.regexp_extract_all("name", F.lit(r"_?([0-9A-Fa-f]{8})\b"), 1)).alias("pos", "hex"))
    occupants = symbols.select(F.col("address_key").alias("addr"), F.col("name").alias("occupant"), "ordinal")
    at = hexes.withColumn("addr", F.conv("hex", 16, 10).cast("long")).join(occupants, "addr").groupBy("ord").agg(F.min_by("occupant", F.struct("pos", "ordinal")).alias("at_address"), F.bool_or(F.col("occupant") == F.col("name")).alias("_home"))
    tail = lambda c: F.when(F.col(c).contains("__"), F.substring_index(c, "__", -1))
    tails = names.select(tail("name").alias("_tail"), "name", "ordinal").filter("_tail <> ''").groupBy("_tail").agg(F.min_by("name", F.struct("ordinal", "name")).alias("by_tail"))
    drift = prefix_drift(decls.filter("name is not null"), names)
    out = decls.join(exact, decls["name"] == exact["_n"], "left").join(at, "ord", "left").join(drift, "name", "left").withColumn("_t", tail("name"))
    out = out.join(tails, F.col("_t") == F.col("_tail"), "left")
    stale = F.col("_exact") & F.col("at_address").isNotNull() & ~F.col("_home")
    away = F.col("_exact").isNull() & F.col("at_address").isNotNull() & (F.col("at_address") != F.col("name"))
    kind = F.when(F.col("name").isNull(), "unparsed").when(stale, "jp_stale").when(F.col("_exact"), "exact").when(away | F.col("drift").isNotNull() | F.col("by_tail").isNotNull(), "drift").otherwise("invented")
    resolved = F.when(kind == "jp_stale", F.col("at_address")).when(kind == "drift", F.coalesce(F.when(away, F.col("at_address")), "drift", "by_tail")).when(kind == "exact", F.col("name"))
    hint = F.coalesce(F.col("name").contains("__"), F.lit(False))
    if "decl" in decls.columns:
        hint = hint | F.coalesce(F.col("decl").rlike(SELF_FIRST), F.lit(False))
    return out.select("ord", "name", kind.alias("class"), resolved.alias("resolved"), hint.alias("hint"))


def plan_call_sites(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """(path, line_no, name): lines that name a definition (name, ord, path, line_no) as a whole word, but for its own line; one
    hit a line, of the first definition in order. A name meets a word once, however often it is defined."""
    words = lines.select("path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"\w+"), 0))).alias("name"))
    first = written(definitions.groupBy("name").agg(F.min("ord").alias("ord")))
    hits = words.join(first, "name").join(definitions.select("name", "path", "line_no"), ["name", "path", "line_no"], "left_anti")
    return hits.groupBy("path", "line_no").agg(F.min_by("name", F.struct("ord", "name")).alias("name"))

"""Scalar helpers on columns: JSON paths, names, comments, owners and mangled names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.binary import DEREF_LOAD, DEREF_STORE, hex_value
from ..operators.lint import clone_key, code_of, snippet
from ..operators.registry import json_path

__all__ = ["build_name", "canonical_name", "class_code", "clone_key", "code_of", "deref_offset", "embedded_addresses", "json_or_empty", "json_path", "member_name", "owner_parts", "snippet", "split_name", "strip_comments"]


def embedded_addresses(name: Column) -> Column:
    """The numbers written as eight hex digits in a name, in order."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"_?([0-9A-Fa-f]{8})\b"), 1), lambda x: F.conv(x, 16, 10).cast("long"))


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def json_or_empty(text: Column) -> Column:
    """JSON text as a variant; corrupt or null text is an empty object."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def owner_parts(owner: Column) -> Column:
    """(run, worker) of an owner, split at the last colon; null for another form."""
    form = r"^([^:]+):(\d+)$"
    return F.when(owner.rlike(form), F.struct(F.regexp_extract(owner, form, 1).alias("run"), F.regexp_extract(owner, form, 2).cast("long").alias("worker")))


def deref_offset(mnemonic: Column, operands: Column) -> Column:
    """The offset, always read as hex, of a load or store based on r3; null for other instructions."""
    full = F.concat_ws(" ", mnemonic, operands)
    found = F.concat(F.regexp_extract(full, DEREF_LOAD, 1), F.regexp_extract(full, DEREF_STORE, 1))
    return F.when(found != "", hex_value(found))


def build_name(path: Column) -> Column:
    """The mangled form of a class path (array of names): length and name, or Q, how many, and each with its length."""
    each = F.array_join(F.transform(path, lambda p: F.concat(F.length(p).cast("string"), p)), "")
    return F.when(F.size(path) == 1, each).otherwise(F.concat(F.lit("Q"), F.size(path).cast("string"), each))


# What tools write around a mangled name, and where its class begins.
BUCKET, LOCAL, ADDRESS = r"^(?:@[^@]*@)+", r"(?:@instance|@\d+)+$", r"^(?:func|lbl|data)_[0-9A-Fa-f]{8}"
CLASS_MARK = r"__(?=Q\d|\d+[A-Za-z_@])"
CONSTRUCTOR, DESTRUCTOR = "__ct__", "__dt__"

_AROUND = re.compile(f"{BUCKET}|{LOCAL}")
_MARK = re.compile(CLASS_MARK)


def _tokens(text: str, count: int) -> tuple[list[str], str] | None:
    """count length-prefixed names and the rest. A name that would run over the end stops at the F of its parameters; one of
    three digits that does is an address, and no name."""
    out = []
    for _ in range(count):
        m = re.match(r"\d+", text)
        if not m or not int(m[0]):
            return None
        n, text = int(m[0]), text[m.end() :]
        if n > len(text):
            n = text.find("F") if n <= 99 else 0
            if n <= 0:
                return None
        out.append(text[:n])
        text = text[n:]
    return out, text


def split_mangled(name: str | None) -> dict | None:
    """mangled_parts() without the scope: member, class, namespaces, ctor, dtor and params."""
    parts = mangled_parts(name)
    return parts and {k: v for k, v in parts.items() if k != "scope"}


def mangled_parts(name: str | None) -> dict | None:
    """member, class, namespaces, scope, ctor, dtor and parameters of a mangled name; None where it is not one.

    scope holds the names of a Q form, the class among them; params is null where no parameters follow the class. The last
    class in a name counts; bucket prefixes, local suffixes and placeholder addresses around it do not.
    """
    if not name:
        return None
    bare = re.sub(ADDRESS, "", _AROUND.sub("", name))
    ctor, dtor = bare.rfind(CONSTRUCTOR), bare.rfind(DESTRUCTOR)
    special = max(ctor, dtor)
    marks = [m.start() for m in _MARK.finditer(bare)]
    if special < 0 and not marks:
        return None
    rest = bare[special + len(CONSTRUCTOR) :] if special >= 0 else bare[marks[-1] + 2 :]
    count = 1
    if scoped := rest[:1] == "Q":
        if rest[1:2] not in tuple("123456789"):
            return None
        count, rest = int(rest[1]), rest[2:]
    got = _tokens(rest, count)
    if not got:
        return None
    path, tail = got
    own = [m.start() for m in _MARK.finditer(name)]
    member = ("__ct" if ctor >= dtor else "__dt") if special >= 0 else name[: own[-1]] if own else name
    return {"member": member, "class": path[-1], "namespaces": path[:-1], "scope": path if scoped else [], "ctor": special >= 0 and ctor >= dtor, "dtor": special >= 0 and dtor > ctor, "params": tail[1:] if tail[:1] == "F" else None}


def split_name(name: Column) -> Column:
    """mangled_parts() over a column, a batch at a time; fields are null where the name is not mangled."""
    blank = {"member": None, "class": None, "namespaces": None, "scope": None, "ctor": None, "dtor": None, "params": None}

    @F.pandas_udf("struct<member:string,`class`:string,namespaces:array<string>,scope:array<string>,ctor:boolean,dtor:boolean,params:string>")
    def run(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mangled_parts(n) or blank for n in names], columns=list(blank))

    return run(name)


def class_code(cls: Column, scope: Column) -> Column:
    """How a mangled name writes its class: length and name, or Q and all names of its scope, the class last."""
    path = F.when(F.try_element_at(scope, F.lit(-1)) == cls, scope).otherwise(F.concat(scope, F.array(cls)))
    each = F.array_join(F.transform(path, lambda p: F.concat(F.length(p).cast("string"), p)), "")
    return F.when(F.size(scope) > 0, F.concat(F.lit("Q"), F.size(path).cast("string"), each)).otherwise(F.concat(F.length(cls).cast("string"), cls))


def member_name(member: Column, cls: Column, scope: Column, params: Column | None = None) -> Column:
    """The mangled name of a class's member: its constructor's and destructor's members are __ct and __dt."""
    return F.concat(member, F.lit("__"), class_code(cls, scope), F.lit("F"), F.coalesce(params, F.lit("v")) if params is not None else F.lit("v"))


def canonical_name(name: Column, parts: Column) -> Column:
    """The name that a compiler gives the member that name stands for, from the parts of split_name(); null where name is that
    already, and where nothing is known to be wrong: no class, an @ in it, or a method with other parameters than none."""
    right = member_name(parts["member"], parts["class"], parts["scope"], parts["params"])
    known = parts["class"].isNotNull() & ~name.contains("@") & (parts["ctor"] | parts["dtor"] | name.contains("Fv"))
    return F.when(known & (right != name), right)

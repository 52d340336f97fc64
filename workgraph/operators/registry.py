"""Registry analytics: selection, status resolution, roll-ups, integrity, batching and routing of work items."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .scans import scan, spread
from .telemetry import assign_seq

#: Statuses after which an item counts as done, lifecycles, edge kinds.
TERMINAL = ("FULL_MATCH", "EQUIVALENT_MATCH", "NOT_BUILDABLE", "NOT_FOUND")
ACCEPTED = ("FULL_MATCH", "EQUIVALENT_MATCH")
LIFECYCLES = ("pending", "claimed", "active", "verified", "accepted", "rejected", "revalidation_required", "blocked", "not_required")
EDGE_KINDS = ("depends_on", "calls", "unresolved_calls", "abi_helper")
LISTS = {"status": "status", "lifecycle": "lifecycle", "kind": "kind", "ids": "id", "unit": "unit_id", "region": "region", "milestone": "milestone", "requiredLevel": "required_level"}
SORTS = {"size": "size", "attempts": "attempts", "unit": "unit_id", "region": "region", "updated_at": "updated_at"}
META_OPS = ("eq", "neq", "in", "contains", "regex")


def check_selector(selector: dict) -> None:
    """Raises ValueError for wrong types, unknown keys, operators or sorts, and limits that are not positive integers."""
    known = {*LISTS, "symbol", "address", "ready", "exhausted", "attempts", "size", "meta", "sort", "limit"}
    if unknown := set(selector) - known:
        raise ValueError(f"unknown selector keys: {sorted(unknown)}")
    for k, v in selector.items():
        if k in LISTS and not (isinstance(v, list) and all(isinstance(x, str) for x in v)):
            raise ValueError(f"{k}: a list of strings is needed")
        if k in ("symbol", "address") and not isinstance(v, str):
            raise ValueError(f"{k}: a string is needed")
        if k in ("ready", "exhausted") and not isinstance(v, bool):
            raise ValueError(f"{k}: true or false is needed")
        if k in ("attempts", "size") and not (isinstance(v, dict) and set(v) <= {"min", "max"} and all(isinstance(x, int) and not isinstance(x, bool) for x in v.values())):
            raise ValueError(f"{k}: a range of integers is needed")
        if k == "meta" and not (isinstance(v, list) and all(isinstance(m, dict) and isinstance(m.get("key"), str) and m.get("op") in META_OPS for m in v)):
            raise ValueError("meta: predicates of key, op and value are needed")
        if k == "sort" and not (isinstance(v, dict) and v.get("by") in SORTS and v.get("order", "asc") in ("asc", "desc")):
            raise ValueError("sort: unknown key or order")
        if k == "limit" and not (isinstance(v, int) and not isinstance(v, bool) and v > 0):
            raise ValueError("limit: a positive integer is needed")


def json_path(column: Column, key: str) -> Column:
    """The value at a dotted path of a JSON text as a variant; null where a hop is missing or the text is corrupt."""
    path = "$" + "".join(f"['{p}']" for p in key.split("."))
    return F.try_variant_get(F.try_parse_json(column), path, "variant")


def meta_op(column: Column, key: str, op: str, value) -> Column:
    """A typed predicate on a dotted path of a JSON column: eq and neq compare type and value, so 1 is not "1" and a
    missing value is neq to everything; contains looks in arrays or in the text form; a bad regex holds nowhere."""
    found = json_path(column, key)
    kind = F.coalesce(F.schema_of_variant(found), F.lit("VOID"))

    def same(v) -> Column:
        if v is None:
            return F.coalesce(F.is_variant_null(found), F.lit(False))
        if isinstance(v, bool):
            return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == v), F.lit(False))
        if isinstance(v, (int, float)):
            return F.coalesce(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)") & (F.try_variant_get(found, "$", "double") == float(v)), F.lit(False))
        return F.coalesce((kind == "STRING") & (F.try_variant_get(found, "$", "string") == str(v)), F.lit(False))

    text = F.try_variant_get(found, "$", "string")
    if op == "eq":
        return same(value)
    if op == "neq":
        return ~same(value)
    if op == "in":
        out = F.lit(False)
        for v in value:
            out = out | same(v)
        return out
    if op == "contains":
        members = F.try_variant_get(found, "$", "array<string>")
        return F.coalesce(F.when(kind.startswith("ARRAY"), F.array_contains(members, str(value))).otherwise(text.contains(str(value))), F.lit(False))
    try:
        re.compile(value)
    except re.error:
        return F.lit(False)
    return F.coalesce(text.rlike(value), F.lit(False))


def select_items(df: DataFrame, selector: dict) -> DataFrame:
    """Items for which every part of the selector holds. An empty list filters nothing; a null never satisfies a range.
    Predicates on meta hold before the limit. A limit adds id as the last sort key; nulls come first going up, last going down."""
    check_selector(selector)
    keep = F.lit(True)
    for k, column in LISTS.items():
        if selector.get(k):
            keep = keep & F.col(column).isin(selector[k])
    for k in ("symbol", "address", "ready", "exhausted"):
        if k in selector:
            keep = keep & (F.col(k) == selector[k])
    for k in ("attempts", "size"):
        r = selector.get(k, {})
        if "min" in r:
            keep = keep & (F.col(k) >= r["min"])
        if "max" in r:
            keep = keep & (F.col(k) <= r["max"])
    for m in selector.get("meta", []):
        keep = keep & meta_op(F.col("meta"), m["key"], m["op"], m.get("value"))
    out = df.filter(keep)
    order = []
    if sort := selector.get("sort"):
        c = F.col(SORTS[sort["by"]])
        order.append(c.desc_nulls_last() if sort.get("order") == "desc" else c.asc_nulls_first())
    if "limit" in selector:
        return out.orderBy(*order, "id").limit(selector["limit"])
    return out.orderBy(*order) if order else out


def apply_scope(df: DataFrame, scope: dict) -> DataFrame:
    """Items inside a scope of targets and units, lists or tables of one column; a scope that meets nothing gives no rows.
    Tables are semi-joined, so a scope may be as large as the registry."""
    for name, column in (("targets", "id"), ("units", "unit_id")):
        held = scope.get(name)
        if isinstance(held, DataFrame):
            df = df.join(held.toDF(column), column, "left_semi").select(*df.columns)
        elif held is not None:
            df = df.filter(F.col(column).isin(held))
    return df


def patch_items(df: DataFrame, patch: DataFrame, now: Column) -> DataFrame:
    """Fields of patch (by id; null: as it was) written over df; updated_at moves to now where an item is patched."""
    fields = [c for c in patch.columns if c != "id" and c in df.columns]
    p = patch.select(F.col("id"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = df.join(p, "id", "left")
    new = {c: F.coalesce(f"_{c}", c) for c in fields} | {"updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def resolve_status(items: DataFrame, status: DataFrame, workflow: str) -> DataFrame:
    """items with resolved: the status of (unit, target), else of the target alone, else of the unit alone, else null."""
    s = status.filter(F.col("workflow_id") == workflow)
    precise = s.filter("unit_id <> '' and target_id <> ''").select(F.col("unit_id").alias("pu"), F.col("target_id").alias("pt"), F.col("status").alias("precise"))
    target = s.filter("unit_id = '' and target_id <> ''").select(F.col("target_id").alias("tt"), F.col("status").alias("by_target"))
    unit = s.filter("unit_id <> '' and target_id = ''").select(F.col("unit_id").alias("uu"), F.col("status").alias("by_unit"))
    out = items.join(precise, (F.col("unit_id") == F.col("pu")) & (F.col("id") == F.col("pt")), "left").join(target, F.col("id") == F.col("tt"), "left").join(unit, F.col("unit_id") == F.col("uu"), "left")
    return out.select(*items.columns, F.coalesce("precise", "by_target", "by_unit").alias("resolved"))


def open_items(items: DataFrame, status: DataFrame, workflow: str, done: list[str], selector: dict | None = None, scope: dict | None = None) -> DataFrame:
    """Selected items in scope whose resolved status is none of done; no status is open."""
    chosen = apply_scope(select_items(items, selector or {}), scope or {})
    return resolve_status(chosen, status, workflow).filter(F.col("resolved").isNull() | ~F.col("resolved").isin(done))


def registry_violations(items: DataFrame, deps: DataFrame, caps: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(rule, subject): missing fields, unknown vocabulary, duplicate ids and dangling ends. With parts, ids meet in so many
    tasks; else in as many as the session's shuffles have."""
    row = lambda d, rule, subject: d.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))
    dealt = lambda d, c: d.repartition(parts, c) if parts else d
    ids = dealt(items.select("id"), "id").groupBy("id").count()
    out = [row(items.filter(F.coalesce(F.col(c), F.lit("")) == ""), f"missing_{c}", "id") for c in ("id", "kind", "status")]
    out.append(row(items.filter(~F.coalesce("lifecycle", F.lit("")).isin(*LIFECYCLES)), "lifecycle", "id"))
    out.append(row(ids.filter("count > 1"), "duplicate_id", "id"))
    out.append(row(deps.filter(~F.coalesce("kind", F.lit("")).isin(*EDGE_KINDS)), "edge_kind", "kind"))
    ends = row(deps, "dangling_from_id", "from_id").unionByName(row(deps, "dangling_to_id", "to_id"))
    if caps is not None:
        ends = ends.unionByName(row(caps, "dangling_capability", "work_item_id"))
    out.append(dealt(ends, "subject").join(ids, ends["subject"] == ids["id"], "left_anti"))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def resume(df: DataFrame, done: DataFrame) -> DataFrame:
    return df.join(done.select("id"), "id", "left_anti")


def map_summary(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """(pos, id) and (ord, target_id, status, accepted) -> each target's entry by id, else the unkeyed entry of its position."""
    keyed = entries.filter("target_id is not null").groupBy("target_id").agg(F.min_by(F.struct("status", "accepted"), "ord").alias("k"))
    loose = assign_seq(entries.filter("target_id is null").select("ord", F.struct("status", "accepted").alias("u")), -1, ["ord"]).select("u", F.col("seq").alias("upos"))
    out = targets.join(keyed, targets["id"] == keyed["target_id"], "left").join(loose, targets["pos"] == loose["upos"], "left")
    got = F.coalesce("k", "u")
    return out.select("pos", "id", F.coalesce(got["status"], F.lit("")).alias("status"), F.coalesce(got["accepted"], F.lit(False)).alias("accepted"))


def deps_of(df: DataFrame, item: str) -> DataFrame:
    return df.filter(F.col("from_id") == item).orderBy("to_id", "kind")


def dependents_of(df: DataFrame, item: str) -> DataFrame:
    return df.filter(F.col("to_id") == item).orderBy("from_id", "kind")


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Rows that are equal in every column of left, nulls too."""
    same = F.lit(True)
    for c in left.columns:
        same = same & left[c].eqNullSafe(right[c])
    return same


def merge_edges(current: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """The edges after add and remove; doing it twice changes nothing. Nulls are equal."""
    every = current.unionByName(add).withColumn("_gone", F.lit(False)).unionByName(remove.select(*current.columns, F.lit(True).alias("_gone")))
    return every.groupBy(*current.columns).agg(F.bool_or("_gone").alias("_gone")).filter("not _gone").drop("_gone")


def edge_changes(current: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """(added, removed): how many edges merge_edges() adds to current and takes from it, each edge once."""
    was, now = current.dropDuplicates().withColumn("_was", F.lit(1)), merge_edges(current, add, remove).withColumn("_now", F.lit(1))
    both = was.select(*current.columns, "_was", F.lit(0).alias("_now")).unionByName(now.select(*current.columns, F.lit(0).alias("_was"), "_now"))
    each = both.groupBy(*current.columns).agg(F.max("_was").alias("was"), F.max("_now").alias("now"))
    n = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    return each.agg(n("now > was").alias("added"), n("was > now").alias("removed"))


def unit_status(df: DataFrame) -> DataFrame:
    """(unit, total, remaining) and a map of status counts, one row a unit; null unit is '(none)', null status '(unknown)'."""
    s = df.select(F.coalesce("unit_id", F.lit("(none)")).alias("unit"), F.coalesce("status", F.lit("(unknown)")).alias("status"))
    return s.groupBy("unit", "status").agg(F.count("*").alias("n"), F.sum((~F.col("status").isin(*TERMINAL)).cast("long")).alias("left")).groupBy("unit").agg(F.sum("n").alias("total"), F.sum("left").alias("remaining"), F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("by_status"))


def completeness(df: DataFrame, files: DataFrame) -> DataFrame:
    """A row a unit: COMPLETE, PARTIAL (a/t), NO SOURCE where src/<unit>.cpp is not among files(path), or NOT_STARTED."""
    per = df.groupBy(F.coalesce("unit_id", F.lit("(none)")).alias("unit")).agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("status").isin(*ACCEPTED).cast("long")), F.lit(0)).alias("accepted"))
    have = files.select(F.regexp_extract("path", r"^src/(.+)\.cpp$", 1).alias("of")).filter("of <> ''").distinct().withColumn("has", F.lit(True))
    out = per.join(have, per["unit"] == have["of"], "left")
    label = F.when(F.col("accepted") == F.col("total"), "COMPLETE").when(F.col("accepted") > 0, F.format_string("PARTIAL (%d/%d)", "accepted", "total")).when(F.col("has").isNull(), "NO SOURCE").otherwise("NOT_STARTED")
    return out.select("unit", "total", "accepted", label.alias("completeness"))


def complete_count(df: DataFrame, files: DataFrame) -> DataFrame:
    """(units, complete): how many units there are, and how many of them are COMPLETE."""
    return completeness(df, files).agg(F.count("*").alias("units"), F.coalesce(F.sum((F.col("completeness") == "COMPLETE").cast("long")), F.lit(0)).alias("complete"))


def complete_units(outcomes: DataFrame) -> DataFrame:
    """Units all of whose seen items (unit_id, accepted) were accepted."""
    return outcomes.filter("unit_id is not null").groupBy("unit_id").agg(F.bool_and("accepted").alias("complete")).filter("complete").select("unit_id")


def batches(df: DataFrame, n: int, key: str | None = "unit_id", order: str = "pos", parts: int | None = None) -> DataFrame:
    """df with grp and batch: rows of one key in order, keys by first sight, chunks of n. Null key is ''. Rows are counted in
    parts of a key, and keys are numbered in ranges: no task meets all rows of a key, or all keys."""
    if key is None:
        return assign_seq(df, -1, [order]).withColumn("grp", F.lit(1)).withColumn("batch", F.floor(F.col("seq") / n)).drop("seq")
    rows = spread(df.withColumn("_k", F.coalesce(F.col(key), F.lit(""))), ["_k"], [order], parts)
    counted = scan(rows, ["_k"], {"_n": ("sum", F.lit(1))})
    first = assign_seq(rows.groupBy("_k").agg(F.min(order).alias("_first")), 0, ["_first"]).select("_k", F.col("seq").alias("grp"))
    return counted.join(first, "_k").select(*df.columns, "grp", F.floor((F.col("_n") - 1) / n).alias("batch"))


def route(rejects: DataFrame, routes: list[dict], attempts: DataFrame) -> DataFrame:
    """rejects with route: the first whose conditions hold; null where none does, or where the item has had that route's maxAttempts.
    Routes may ask for size_below (strict; null fails), statuses (an empty list matches nothing) and attempts_max (inclusive)."""
    tried = attempts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("route", "n"))).alias("_tried"))
    out = rejects.join(tried, "id", "left")
    pick = F.lit(None).cast("string")
    for r in reversed(routes):
        ok = F.lit(True)
        if "size_below" in r:
            ok = ok & F.coalesce(F.col("size") < r["size_below"], F.lit(False))
        if "statuses" in r:
            ok = ok & (F.col("status").isin(r["statuses"]) if r["statuses"] else F.lit(False))
        if "attempts_max" in r:
            ok = ok & (F.col("attempts") <= r["attempts_max"])
        spent = F.coalesce(F.try_element_at("_tried", F.lit(r["name"])), F.lit(0)) >= r["maxAttempts"] if "maxAttempts" in r else F.lit(False)
        pick = F.when(ok, F.when(~spent, F.lit(r["name"]))).otherwise(pick)
    return out.withColumn("route", pick).drop("_tried")


SCOPE = ("workflow_id", "unit_id", "target_id")
#: Buckets in which the rows of a unit or target meet its items.
SALTS = 16
#: Items of a unit's block, beyond SALTS blocks.
BLOCK = 4096


def status_changes(log: DataFrame, items: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(scope, seq, from_status, to_status and the other columns of log) of every change of an item's resolved status, where
    log has rows of three scopes: a unit's target, a target of any unit (unit_id '') and a unit (target_id '').

    An item resolves to its most specific row, so a row speaks for an item unless a more specific one has spoken before.
    Items are the log's own and those of items (id, unit_id); a row of a unit may change many. A seq is one row's; a null
    unit is ''.

    What comes before a row is found in its own scope before it meets its items, so a change that a unit's row gives to
    many items is written once for each and neither shuffled nor sorted. Only where an item turns from one scope to a more
    specific one is the wider scope's last status looked up: a row an item. Rows and items of a unit meet in SALTS blocks
    of the items (those of a target in one), or in more of BLOCK items, so that one unit's changes come from many tasks (parts of them, else as many as
    shuffles have). A block is one row, a list that each of the unit's changes goes through, in the order of seq: so the
    changes of one row stand together, and files of them hold little more than the runs.
    """
    rest = [c for c in log.columns if c not in (*SCOPE, "seq", "status")]
    rows = log.withColumns({c: F.coalesce(c, F.lit("")) for c in ("unit_id", "target_id")})
    precise = rows.filter("unit_id <> '' and target_id <> ''")
    parts = parts or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def changed(df: DataFrame, by: list[str]) -> DataFrame:
        return df.withColumn("_was", F.lag("status").over(Window.partitionBy(*by).orderBy("seq"))).filter(~F.col("status").eqNullSafe(F.col("_was")))

    of_unit, of_target = ["workflow_id", "unit_id"], ["workflow_id", "target_id"]
    units = written(changed(rows.filter("unit_id <> '' and target_id = ''"), of_unit).drop("target_id"))
    targets = written(changed(rows.filter("unit_id = '' and target_id <> ''"), of_target).drop("unit_id"))
    every = precise.select(*SCOPE)
    if items is not None:
        given = items.select(F.coalesce("unit_id", F.lit("")).alias("unit_id"), F.col("id").alias("target_id")).distinct()
        for df, by in ((units, of_unit), (targets, of_target)):
            every = every.unionByName(df.select(*by).distinct().join(given, by[1]).select(*SCOPE))
    own = precise.groupBy(*SCOPE).agg(F.min("seq").alias("_own"))
    since = targets.groupBy(*of_target).agg(F.min("seq").alias("_since"))
    every = every.distinct().join(own, list(SCOPE), "left").join(since, of_target, "left").withColumn("_until", F.least("_own", "_since"))
    every = written(every)

    def upto(points: DataFrame, at: str, df: DataFrame, by: list[str], name: str) -> DataFrame:
        """(scope, name): the last status in df's scope before each point, null if there is none."""
        both = points.select(*SCOPE, F.col(at).alias("seq"), F.lit(None).cast("struct<status:string>").alias("_s")).unionByName(
            df.select(*by, "seq", F.struct(F.col("status").cast("string").alias("status")).alias("_s")), allowMissingColumns=True)
        last = F.last("_s", True).over(Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
        return both.withColumn("_l", last).filter("_s is null").select(*SCOPE, F.col("_l.status").alias(name))

    # where an item turns to its target's rows, and to its own
    turning = upto(every.filter("_until is not null"), "_until", units, of_unit, "_unit_was").join(
        upto(every.filter("_since < _own"), "_own", targets, of_target, "_target_was"), list(SCOPE), "left")

    def met(df: DataFrame, by: list[str], least: int, what: DataFrame, *of_item: str) -> DataFrame:
        """Rows of df with each of their items, in least blocks or more, and its columns of_item."""
        blocks = F.greatest(F.lit(least), F.ceil(F.count("*") / BLOCK).cast("int")).alias("_blocks")
        sized = written(what.groupBy(*by).agg(blocks))
        block = F.pmod(F.xxhash64(*SCOPE), F.col("_blocks")).cast("int").alias("_block")
        item = F.struct(*[c for c in (*SCOPE, *of_item) if c not in by]).alias("_item")
        lists = what.join(sized, by).select(*by, block, item).groupBy(*by, "_block").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
        dealt = df.join(sized, by).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
        dealt = dealt.repartition(parts, *by, "_block").sortWithinPartitions(*by, "_block", "seq")
        return dealt.join(lists, [*by, "_block"]).withColumn("_item", F.explode("_items")).select(*df.columns, "_item.*")

    out = ["seq", "_was", "status", *rest]
    by_unit = met(units, of_unit, SALTS, every, "_until").filter("_until is null or seq < _until").select(*SCOPE, *out)
    heard = every.join(turning, list(SCOPE), "left").filter("_since is not null and (_own is null or _since < _own)")
    by_target = met(targets, of_target, 1, heard, "_own", "_since", "_unit_was").filter("_own is null or seq < _own")
    by_target = by_target.withColumn("_was", F.when(F.col("seq") == F.col("_since"), F.col("_unit_was")).otherwise(F.col("_was"))).select(*SCOPE, *out)
    before = F.lag(F.struct("status")).over(Window.partitionBy(*SCOPE).orderBy("seq"))
    alone = precise.withColumn("_b", before).join(every.select(*SCOPE, "_own", "_since").join(turning, list(SCOPE), "left"), list(SCOPE))
    first = F.when(F.col("_since") < F.col("_own"), F.col("_target_was")).otherwise(F.col("_unit_was"))
    alone = alone.withColumn("_was", F.when(F.col("_b").isNull(), first).otherwise(F.col("_b.status"))).select(*SCOPE, *out)
    found = by_unit.unionByName(by_target).unionByName(alone).filter(~F.col("status").eqNullSafe(F.col("_was")))
    return found.select(*SCOPE, "seq", F.col("_was").alias("from_status"), F.col("status").alias("to_status"), *rest)


def latest_status(log: DataFrame) -> DataFrame:
    return log.groupBy(*SCOPE).agg(F.max_by("status", "seq").alias("status"))


def reset_status(df: DataFrame, unit: str | None = None, target: str | None = None) -> DataFrame:
    """What is left after a reset by target (of any unit), by unit, or of everything."""
    if target is not None:
        return df.filter(F.col("target_id") != target)
    return df.filter(F.col("unit_id") != unit) if unit is not None else df.limit(0)


def list_status(df: DataFrame, workflow: str, unit: str | None = None, target: str | None = None) -> DataFrame:
    keep = F.col("workflow_id") == workflow
    if unit is not None:
        keep = keep & (F.col("unit_id") == unit)
    if target is not None:
        keep = keep & (F.col("target_id") == target)
    return df.filter(keep).orderBy("seq", "unit_id", "target_id")


def finalize(items: DataFrame, actions: DataFrame) -> DataFrame:
    """items after actions (id, promote, new_status): promoting accepts and writes a status if given; a status alone is written."""
    a = actions.select("id", F.col("promote").alias("_p"), F.col("new_status").alias("_s"))
    out = items.join(a, "id", "left")
    return out.withColumn("lifecycle", F.when(F.col("_p"), "accepted").otherwise(F.col("lifecycle"))).withColumn("status", F.coalesce("_s", "status")).drop("_p", "_s").select(*items.columns)


def finalize_run(items: DataFrame, actions: DataFrame, status: DataFrame, workflow: str, now: Column, completion: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, status, events) after finished items' actions (id, unit_id, promote, new_status, actor, evidence).

    Each gets a precise status: the action's, else the workflow's completion status, else DONE. A promotion accepts the item
    and writes a status only if the action has one; a status alone is written; neither writes no item. An event tells of a
    status that differs from the one resolved before, with both, the actor, the time and any evidence.
    """
    a = actions.withColumn("unit_id", F.coalesce("unit_id", F.lit(""))).withColumn("_to", F.coalesce("new_status", F.lit(completion), F.lit("DONE")))
    before = resolve_status(a, status, workflow).withColumnRenamed("resolved", "_from")
    data = F.to_json(F.struct(F.lit(workflow).alias("workflowId"), "actor", F.col("_from").alias("from"), now.cast("string").alias("updatedAt"), F.col("_to").alias("status"), "evidence"))
    events = before.filter(~F.col("_from").eqNullSafe(F.col("_to"))).select(now.alias("ts"), F.col("id").alias("work_item_id"), F.lit("target-status").alias("type"), F.lit("info").alias("level"), data.alias("data"))
    row = a.select(F.lit(workflow).alias("workflow_id"), "unit_id", F.col("id").alias("target_id"), F.col("_to").alias("status"))
    kept = status.join(row.select(*SCOPE), list(SCOPE), "left_anti").select(*row.columns)
    patch = a.filter(F.coalesce("promote", F.lit(False)) | F.col("new_status").isNotNull()).select("id", F.when(F.col("promote"), "accepted").alias("lifecycle"), F.col("new_status").alias("status"))
    return patch_items(items, patch, now), kept.unionByName(row), events


def leases_by(df: DataFrame, owner: str | None = None, run: str | None = None) -> DataFrame:
    """Leases with run and worker split from the owner at its last colon; owners of another form are left out."""
    out = df.withColumn("run", F.regexp_extract("owner", r"^([^:]+):(\d+)$", 1)).withColumn("worker", F.regexp_extract("owner", r"^([^:]+):(\d+)$", 2)).filter("run <> ''")
    if owner is not None:
        out = out.filter(F.col("owner") == owner)
    return out.filter(F.col("run") == run) if run is not None else out


def diff_verdict(df: DataFrame) -> DataFrame:
    """df (exit_code and the counts of a diff) with accepted, status (null for a plain mismatch) and feedback."""
    good = F.coalesce((F.col("exit_code") == 0) & (F.col("mismatch_count") == 0), F.lit(False))
    ran = F.coalesce(F.col("exit_code") == 0, F.lit(False))
    status = F.when(good, "FULL_MATCH").when(ran, F.lit(None)).when(F.col("exit_code") == 4, "NOT_FOUND").otherwise("NOT_BUILDABLE")
    told = F.format_string("diff mismatch: %d/%d instructions differ (%d structural, %d reg-swap)", "mismatch_count", "total_instructions", "structural_count", "reg_swap_count")
    return df.withColumn("accepted", good).withColumn("status", status).withColumn("feedback", F.when(ran & ~good, told))


PLACEHOLDERS = {"function": r"^func_[0-9A-Fa-f]{7,8}$", "class": r"^Class_[0-9A-Fa-f]+"}


def is_placeholder(column: Column, pattern: str) -> Column:
    """Whether a name is of a placeholder family, or matches a pattern; an empty pattern matches nothing."""
    pattern = PLACEHOLDERS.get(pattern, pattern)
    return column.rlike(pattern) if pattern else F.lit(False)

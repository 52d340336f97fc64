"""Sources: registries, target lists, source trees, symbol files, listings, reloc maps, object words and price tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scans import scan, spread
from ..tables import small_tasks, written

REGISTRY = "id string, kind string, status string, unit string, lifecycle string, region string, symbol string, address string, size long, attempts long, exhausted boolean, ready boolean, meta string"
#: What a foreign workflow status means as a lifecycle; all else is pending.
LIFECYCLE_OF = {"DISCOVERY": "pending", "QUEUED": "pending", "CLAIMED": "pending", "ACTIVE": "pending", "BACKLOG": "blocked", "BLOCKED": "blocked", "ACCEPTED": "accepted", "REVALIDATION_REQUIRED": "revalidation_required", "NOT_REQUIRED": "not_required"}
BLOCK = 1 << 16  # places of a listing that are scanned in one task
PROMOTED = ("id", "kind", "unit", "status", "workflow_status", "region", "symbol", "address", "milestone", "required_level", "size", "source", "attempts", "exhausted", "ready")
LINT_FILES, REPORT_FILES = r"\.(?:cpp|cc|cxx|c|hpp|hh|hxx|h)$", r"(?<!\.ctx)\.c$|\.cpp$"


def json_entries(spark: SparkSession, path: str, under: str | None = None) -> DataFrame:
    """(file, entry) of JSON files of any size: the text of each entry of a file's root, or of what its root holds under a key.

    A JSON string holds no line break, so each line's brackets can be counted alone, and a scan in parts of a file gives the
    depth at which a line begins. Lines that begin between entries start an entry (or several, if they hold them whole). A
    file whose lines do not keep entries apart, or whose brackets do not close, has one null entry: it must be read whole.
    """
    split, whole = _json_texts(spark, path, under)
    whole = whole.select("file", F.lit(None).cast("string").alias("entry"))
    return whole if split is None else split.unionByName(whole)


def _json_texts(spark: SparkSession, path: str, under: str | None) -> tuple[DataFrame | None, DataFrame]:
    """json_entries() of the files that are split (file, entry; None if no file can be), and the others (file, text). A file on
    one line cannot be split, so its line is its text, and its brackets are not counted."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).filter(F.trim("text") != "")
    long = written(raw.groupBy("file").agg(F.count("*").alias("_n")).filter("_n > 1").select("file"))
    if long.isEmpty():
        return None, raw
    lines = numbered_lines(spark, path).select("file", "pos", "line").join(long, "file", "left_semi")
    bare = F.regexp_replace("line", r'"(?:\\.|[^"\\])*"', '""')
    step = F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))
    closers = F.regexp_count(F.regexp_extract(bare, r"^[\s\]}]*", 0), F.lit(r"[\]}]"))  # before anything else on the line
    rows = spread(lines.filter(F.trim("line") != "").withColumns({"_step": step.cast("long"), "_closers": closers.cast("long"), "_opens": bare.rlike(r"[\[{]\s*$")}), ["file"], ["pos"])
    deep = scan(rows, ["file"], {"_end": ("sum", F.col("_step"))}).withColumn("_depth", F.col("_end") - F.col("_step"))
    at = 1 if under is None else 2
    key = F.when(F.col("_depth") == 1, F.regexp_extract("line", r'^\s*"([^"]*)"\s*:\s*[\[{]\s*$', 1))
    if under is not None:
        deep = scan(deep.withColumn("_key", F.when(key != "", key)), ["file"], {"_under": ("last", F.col("_key"))})
    inside = F.coalesce(F.col("_under") == under, F.lit(False)) if under is not None else F.lit(True)
    depth, end = F.col("_depth"), F.col("_end")
    entry = inside & (depth - F.col("_closers") >= at)
    # an entry may not share a line with what opens or closes its holder, and what closes it may not open it again
    shared = entry & (end < at) | (depth < at) & ((end > at) | (end == at) & ~F.col("_opens")) | inside & ~entry & (depth >= at) & (end >= at)
    found = F.coalesce(F.bool_or(inside & (depth < at) & (end == at)), F.lit(False))
    files = deep.groupBy("file").agg(((F.sum("_step") != 0) | (F.min("_end") < 0) | F.bool_or(shared) | ~found).alias("_whole"))
    layout = written(files)
    starts = scan(deep.withColumn("_starts", (entry & (depth == at)).cast("long")), ["file"], {"_entry": ("sum", F.col("_starts"))})
    held = starts.filter(entry).join(layout.filter("not _whole").select("file"), "file", "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    split = held.groupBy("file", "_entry").agg(F.regexp_replace(text, r"^\s*,|,\s*$", "").alias("entry")).select("file", "entry")
    whole = deep.join(layout.filter("_whole").select("file"), "file", "left_semi").groupBy("file").agg(text.alias("text"))
    return split, raw.join(long, "file", "left_anti").unionByName(whole)


def _json_rows(spark: SparkSession, path: str, under: str | None, brackets: str, kind: str, whole) -> DataFrame:
    """(v): what a schema makes of each entry in brackets, and of files that must be read whole; malformed ones are null."""
    split, texts = _json_texts(spark, path, under)
    out = texts.select(F.col("text").alias("value")).select(whole.alias("v"))
    return out if split is None else split.select(F.from_json(F.concat(F.lit(brackets[0]), "entry", F.lit(brackets[1])), kind).alias("v")).unionByName(out)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Work items of a JSON file: {"workItems": [...]} or a bare array; defaults filled in; rows without id, kind or status raise.

    A file with items on lines of their own is split between them, however large; another is one row.
    """
    kind = f"array<struct<{_struct(REGISTRY)}>>"
    array = F.from_json("value", kind)
    whole = F.when(F.ltrim("value").startswith("["), array).otherwise(F.coalesce(F.from_json(F.get_json_object("value", "$.workItems"), kind), array))
    bare = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).first()
    # not explode(), before which Spark would parse each text once more to see whether it holds anything
    out = _json_rows(spark, path, None if bare and bare[0] == "[" else "workItems", "[]", kind, whole).select(F.posexplode_outer("v").alias("_at", "i")).filter("_at is not null").select("i.*")
    out = out.fillna({"lifecycle": "pending", "attempts": 0}).withColumns({"exhausted": F.coalesce("exhausted", F.lit(False)), "ready": F.coalesce("ready", F.lit(False)), "meta": F.coalesce("meta", F.lit("{}"))})
    bad = F.coalesce("id", F.lit("")).eqNullSafe("") | F.coalesce("kind", F.lit("")).eqNullSafe("") | F.coalesce("status", F.lit("")).eqNullSafe("")
    return out.withColumn("id", F.when(bad, F.raise_error(F.lit("a work item lacks id, kind or status"))).otherwise(F.col("id"))).withColumnRenamed("unit", "unit_id")


def _struct(ddl: str) -> str:
    return ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in ddl.split(", "))


def map_targets(df: DataFrame, default_region: str) -> DataFrame:
    """Foreign target rows (json: one object's text) as work items: status names mapped, hex sizes read, leftover keys in meta."""
    kv = F.from_json("json", "map<string,string>")
    d = df.select(kv.alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    size = F.when(F.regexp_replace(at("size"), "^0[xX]", "").rlike("^[0-9A-Fa-f]+$"), F.conv(F.regexp_replace(at("size"), "^0[xX]", ""), 16, 10).cast("long"))
    lifecycle = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv_ in LIFECYCLE_OF.items() for x in kv_]), at("workflow_status")), F.lit("pending"))
    meta = F.to_json(F.map_filter("m", lambda k, _: ~k.isin(*PROMOTED)))
    return d.select(
        at("id").alias("id"), F.coalesce(at("kind"), F.lit("function")).alias("kind"), at("unit").alias("unit_id"), F.coalesce(at("status"), F.lit("NOT_STARTED")).alias("status"), lifecycle.alias("lifecycle"),
        F.coalesce(at("region"), F.lit(default_region)).alias("region"), at("symbol").alias("symbol"), at("address").alias("address"), size.alias("size"), F.lit(0).cast("long").alias("attempts"),
        F.lit(False).alias("exhausted"), F.lit(False).alias("ready"), meta.alias("meta"),
    )


def read_corpus(spark: SparkSession, roots: list[str], mode: str = "lint") -> DataFrame:
    """(path, text) of source files below the roots: names with a dot in front are skipped, and so is what cannot be read."""
    found = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(roots, wholetext=True)
    return source_files(found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), mode)


def source_files(files: DataFrame, mode: str = "lint") -> DataFrame:
    """Files (path, text) that are sources by their names, each path once."""
    return files.filter(F.col("path").rlike(LINT_FILES if mode == "lint" else REPORT_FILES) & ~F.col("path").rlike(r"/\.[^/]")).dropDuplicates(["path"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, ordinal, line) of text files, however long: pos counts a file's lines from 0, ordinal those of all files, in
    the order of their paths. Files are read in splits: a first pass counts each split's lines, sums over the splits (a row
    each) are the numbers at which they start, and a second pass numbers lines in their splits."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line")).withColumn("_at", F.monotonically_increasing_id())
    splits = raw.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    upto = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(splits.select("file", "_block", "_first", upto(Window.partitionBy("file").orderBy("_block")).alias("_pos"), upto(Window.orderBy("file", "_block")).alias("_ordinal")))
    at = F.col("_at") - F.col("_first")
    return raw.join(starts, ["file", "_block"]).select("file", (F.col("_pos") + at).alias("pos"), (F.col("_ordinal") + at).alias("ordinal"), "line")


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, address_key) of lines `name = [section:]0xADDR; ...`; other lines are left out. ordinal goes on from file
    to file; a file of any size is read in splits."""
    form = r"^\s*([^\s=#/][^\s=]*)\s*=\s*(?:[\w.]+:)?0[xX]([0-9A-Fa-f]+)\s*;"
    name, addr = F.regexp_extract("line", form, 1), F.regexp_extract("line", form, 2)
    return numbered_lines(spark, path).select("ordinal", name.alias("name"), F.conv(addr, 16, 10).cast("long").alias("address_key")).filter("name <> ''")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, fn, idx, address, bytes, mnemonic, operands) of instructions inside functions; idx counts through the file, which
    may be of any size: it is read in splits."""
    return parse_listing(numbered_lines(spark, path).select("file", "pos", "line"))


def parse_listing(lines: DataFrame, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """read_listing() for lines (file, pos, line): the open function is the last mark before a line; an end mark closes it.

    A file is dealt in blocks of so many places, over parts tasks. Each is scanned alone: an instruction before a block's first
    mark is open or not by the blocks before it, and what a block ends with stands on its last row, so rows are dealt once and
    the summaries, a row a block, are added where they are read.
    """
    ins = r"^/\* ([0-9A-F]+) ([0-9A-F]+)  ([0-9A-F]{2}(?: [0-9A-F]{2}){3}) \*/\s*(.+)"
    line = F.trim("line")
    mark = F.when(line.startswith(".fn "), F.trim(F.regexp_extract(line, r"^\.fn\s+([^,]+)", 1))).when(line.startswith(".endfn"), "")
    rows = lines.select("file", "pos", F.floor(F.col("pos") / block).alias("_block"), mark.alias("_mark"), F.when(F.col("line").rlike(ins), F.col("line")).alias("line"))
    rows = rows.filter("_mark is not null or line is not null")
    rows = rows.repartition(parts, "file", "_block") if parts else rows.repartition("file", "_block")
    place = Window.partitionBy("file", "_block").orderBy("pos")
    upto = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.last("_mark", True).over(upto).alias("_fn"), F.lead(F.lit(True)).over(place).isNull().alias("_last"))
    found = F.col("line").isNotNull()
    count = lambda c: F.sum(c.cast("long")).over(upto)
    rows = rows.withColumns({"_before": count(found & F.col("_fn").isNull()), "_inside": count(found & F.coalesce(F.col("_fn") != "", F.lit(False)))})
    with small_tasks(lines.sparkSession):
        rows = written(rows.filter(F.col("_last") | found & F.coalesce(F.col("_fn") != "", F.lit(True))).drop("_mark", "pos"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.filter("_last").select("file", "_block", "_before", "_inside", F.last("_fn", True).over(earlier).alias("_open"))
    is_open = F.coalesce(F.col("_open") != "", F.lit(False))
    own = F.col("_inside") + F.when(is_open, F.col("_before")).otherwise(0)
    offsets = written(ends.select(F.col("file").alias("_file"), F.col("_block").alias("_b"), "_open", F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("_n")))
    out = rows.join(offsets, rows["file"].eqNullSafe(offsets["_file"]) & rows["_block"].eqNullSafe(offsets["_b"]))
    fn = F.coalesce("_fn", "_open")
    idx = F.col("_n") + F.col("_inside") + F.when(is_open, F.col("_before")).otherwise(0) - 1
    body = F.trim(F.regexp_replace(F.regexp_extract("line", ins, 4), r"\s*//.*$|  .*$", ""))
    return out.filter(F.col("line").isNotNull() & F.coalesce(fn != "", F.lit(False))).withColumn("body", body).select(
        "file", fn.alias("fn"), idx.cast("int").alias("idx"), F.conv(F.regexp_extract("line", ins, 1), 16, 10).cast("long").alias("address"), F.regexp_extract("line", ins, 3).alias("bytes"),
        F.regexp_extract("body", r"^([a-z0-9_.]+)", 1).alias("mnemonic"), F.trim(F.regexp_replace("body", r"^[a-z0-9_.]+", "")).alias("operands"),
    )


def read_reloc_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct retail names of a reloc map; a malformed file has none. A map with units on lines of their own is split."""
    kind = "map<string,map<string,struct<retail_symbol:string>>>"
    entries = _json_rows(spark, path, "entries", "{}", kind, F.from_json(F.get_json_object("value", "$.entries"), kind))
    return entries.select(F.explode(F.map_values("v")).alias("m")).select(F.explode(F.map_values("m")).alias("s")).select(F.col("s.retail_symbol").alias("name")).filter("name <> ''").distinct()


def scan_words(objects: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, offset, name) of aligned big-endian words of objects (path, content) that are a symbol's address; a partial last word is not read."""
    offset = F.explode(F.sequence(F.lit(0), F.length("content") - 4, F.lit(4)))
    words = objects.filter(F.length("content") >= 4).select("path", "content", offset.alias("offset")).select("path", "offset", F.conv(F.hex(F.expr("substring(content, offset + 1, 4)")), 16, 10).cast("long").alias("address_key"))
    return words.join(symbols.select("address_key", "name"), "address_key").select("path", "offset", "name")


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """(name, provider, model, rpm, p_in, p_out, p_cr, p_cw, hash) of a price table; negative or missing prices raise."""
    spec = "struct<provider:string,model:string,thinkingLevel:string,maxTokens:long,rpm:double,cost:struct<inputPerM:double,outputPerM:double,cacheReadPerM:double,cacheWritePerM:double>>"
    kind = f"map<string,{spec}>"
    m = _json_rows(spark, path, None, "{}", kind, F.from_json("value", kind)).select(F.explode("v").alias("name", "s"))
    prices = [F.col(f"s.cost.{c}") for c in ("inputPerM", "outputPerM", "cacheReadPerM", "cacheWritePerM")]
    ok = F.col("s.provider").isNotNull() & F.col("s.model").isNotNull()
    for p in prices:
        ok = ok & F.coalesce(p >= 0, F.lit(False))
    name = F.when(ok, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("bad model entry: "), "name")))
    return m.select(name.alias("name"), "s.provider", "s.model", "s.rpm", *[p.alias(a) for p, a in zip(prices, ("p_in", "p_out", "p_cr", "p_cw"), strict=True)], F.sha2(F.to_json("s"), 256).alias("hash"))

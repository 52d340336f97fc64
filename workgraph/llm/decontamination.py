"""Benchmark decontamination by winnowing: documents that hold passages of benchmark items.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, fresh, written

#: What parts words, once A-Z are lower-cased (fixed by the contract).
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A word before A-Z are lower-cased, which moves no edge.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Bits of the filter that keeps texts without a common fingerprint out of the second pass (1 MB).
BITMAP_BITS = 1 << 23
NEW = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once however often of reads it."""
    return F.get(F.transform(F.array(value), of), 0)


def words_of(text: Column) -> Column:
    """Words of a text: letters a-z after lower-casing A-Z, digits, and everything beyond ASCII. Null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def fingerprints(words: Column, size: int) -> Column:
    """Winnowed fingerprints of all windows of size words, as runs of windows that have the same one: an array of
    (n = size, at = first window of the run, to = its last, print).

    A window's fingerprint is the least hash among its k-grams, where k is half of size: two texts that share size words
    in a row share that window's fingerprint, whatever stands around it.
    """
    k = (size + 1) // 2
    wide = size - k + 1
    least = lambda g, i: F.least(*[F.get(g, i + j) for j in range(wide)]) if wide > 1 else F.get(g, i)
    changed = lambda m, i: (i == 0) | (F.get(m, i) != F.get(m, i - 1))

    def runs(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: changed(m, i))
        run = lambda s, x, j: F.struct(F.lit(size).alias("n"), x.alias("at"), (F.coalesce(F.get(s, j + 1), F.size(m)) - 1).alias("to"), F.get(m, x).alias("print"))
        return let(starts, lambda s: F.transform(s, lambda x, j: run(s, x, j)))

    grams = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    minima = lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - wide), lambda i: least(g, i))
    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(grams(h), lambda g: let(minima(g), runs)))
    return F.when(F.size(words) >= size, found).otherwise(F.array().cast("array<struct<n:int,at:int,to:int,print:bigint>>"))


def item_windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, sets) of the items. Windows: each different one's words (window), how many (n), fingerprint (print) and
    the set of items that hold it; an item of fewer than size words is one window. Sets: set and its item ids as sorted
    strings; windows of one passage share a set. Both are written tables.
    """
    base = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    held = base.select("item", F.explode(cut).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    held = written(held.withColumn("set", F.md5(F.array_join("items", ","))).withColumn("n", F.size(F.split("window", " "))))
    sets = written(held.select("set", "items").dropDuplicates(["set"]))
    w = F.split("window", " ")
    prints = F.coalesce(*[F.when(F.col("n") == k, F.get(fingerprints(w, k), 0)["print"]) for k in range(1, size + 1)])
    return written(held.select("window", "n", "set", prints.alias("print"))), sets


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key (long) may be one of the wanted: all that are, and a share of the others as large as the share of
    BITMAP_BITS bits that the wanted ones set. The bitmap is broadcast: it has BITMAP_BITS bits, however many are wanted."""
    held, bits = fresh(rows, "_bucket", "_bits")
    slot = lambda c: F.pmod(c, F.lit(BITMAP_BITS)) + 1
    bitmap = wanted.groupBy(F.bitmap_bucket_number(slot(F.col(key))).alias(held)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot(F.col(key)))).alias(bits))
    at = F.bitmap_bit_position(slot(F.col(key)))
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(slot(rows[key])) == bitmap[held])
    return met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with n_words; n_hit, the words inside an occurrence of a window of size item words; n_items, the items with
    occurring windows; items_sha256 of their ids, sorted as strings and joined by commas; contaminated (n_hit > 0); and
    hit_spans, the runs of hit words as (first, last) word numbers from 0.

    Fingerprints of documents and items are joined; a run of windows with a common fingerprint is then extended to its
    whole windows, which are compared word by word. Every shared window has its fingerprint in both, so none is missed.
    Texts that may hold a hit are told by a bitmap of fixed size before they are shuffled. Shorter items get fingerprints of their own length (at most size - 1 lengths). Results belong to texts: copies of a
    text are extended once, and texts are found again by two 64-bit hashes. Ids of items are looked up once for each
    different combination of item sets, and no row is made for a document with an item.

    Null, blank or wordless texts and items: no words, nothing hit. Very long texts: whole, in arrays of one row. Repeated
    rows get the same result each; repeated item ids are one item; items of null id hit words but are not counted.
    Empty tables: nothing hit. docs keeps its columns and their order; new ones follow and replace any of their names.
    """
    h1, h2 = fresh(docs, "_h1", "_h2")
    keep = [c for c in docs.columns if c.lower() not in NEW or c == text_col]
    key = [F.xxhash64(text_col).alias(h1), F.xxhash64(F.lit(13), text_col).alias(h2)]
    windows, sets = item_windows(items, size, item_id_col, item_text_col)
    prints = written(windows.select("n", "print").distinct())
    sizes = sorted(r.n for r in prints.select("n").distinct().collect())  # at most size rows
    texts = docs.select(*key, F.col(text_col).alias("text")).filter(F.length("text") > 0)
    words = words_of(F.col("text"))
    every = let(words, lambda w: F.flatten(F.array(*[fingerprints(w, k) for k in sizes or [size]])))
    runs = texts.select(h1, h2, F.explode(every).alias("r")).select(h1, h2, "r.*")
    spots = written(runs.join(prints, ["n", "print"], "left_semi").groupBy(h1, h2).agg(F.collect_set(F.struct("n", "at", "to")).alias("spots")))
    met = among(texts, spots, h1).join(spots, [h1, h2]).groupBy(h1, h2).agg(F.first("text").alias("text"), F.first("spots").alias("spots"))
    window = lambda w, s, p: F.struct(p.alias("at"), (p + s["n"]).alias("to"), F.array_join(F.slice(w, p + 1, s["n"]), " ").alias("window"))
    extended = let(words, lambda w: F.flatten(F.transform("spots", lambda s: F.transform(F.sequence(s["at"], s["to"]), lambda p: window(w, s, p)))))
    hits = met.select(h1, h2, F.explode(extended).alias("x")).select(h1, h2, "x.*").join(windows.select("window", "set"), "window")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["to"] - 1)))))
    per = hits.groupBy(h1, h2).agg(F.collect_set(F.struct("at", "to")).alias("spans"), F.array_sort(F.collect_set("set")).alias("sets"))
    per = written(per.select(h1, h2, covered.alias("at"), "sets", F.md5(F.array_join("sets", ",")).alias("combined")))
    ids = per.dropDuplicates(["combined"]).select("combined", F.explode("sets").alias("set")).join(sets, "set")
    ids = ids.groupBy("combined").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    ids = ids.select("combined", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    edge = lambda step: F.filter("at", lambda x, i: F.coalesce(F.get("at", i + step) != x + step, F.lit(True)))
    spans = F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    found = per.join(ids, "combined").select(h1, h2, F.size("at").cast("long").alias("n_hit"), "n_items", "items_sha256", spans.alias("hit_spans"))
    n_words = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0))
    d = docs.select(*keep, n_words.cast("long").alias("n_words"), *key).join(found, [h1, h2], "left")
    new = {"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "n_items": F.coalesce("n_items", F.lit(0)).cast("long"), "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256)), "contaminated": F.col("n_hit").isNotNull(), "hit_spans": F.coalesce("hit_spans", F.array().cast("array<struct<first:int,last:int>>"))}
    return d.select(*keep, "n_words", *[c.alias(n) for n, c in new.items()])

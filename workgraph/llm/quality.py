"""Quality rules: word and line counts, and how far a text's histograms diverge from those of its language.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WHITE_RUN, fresh, strip_white, word_array, written

#: Character classes, each with the pattern of its runs, taken out of the text one after the other; the last class is the rest.
CLASSES = (("lower", "[a-z]+"), ("white", WHITE_RUN), ("upper", "[A-Z]+"), ("mark", "[.,;:'\"()!?-]+"), ("digit", "[0-9]+"), ("symbol", "[\\x21-\\x7E]+"))
#: Classes that every language uses alike: letters of any kind, white space, marks, digits, symbols.
FOLDED = ((0, 2, 6), (1,), (3,), (4,), (5,))
#: The symbols that n_symbols counts (fixed by the contract).
SYMBOLS = "[^#*$%&|<>]+"


def repeated_words(words: Column, wide: int = 8) -> tuple[Column, callable]:
    """(hashes of all windows of wide words, a function of their column giving how many words stand in repeated ones).

    Windows are compared by 64-bit hashes inside one row: no row is made for a word.
    """
    n = F.size(words)
    hashes = F.when(n >= wide, F.transform(F.sequence(F.lit(1), n - (wide - 1)), lambda i: F.xxhash64(F.slice(words, i, wide)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of(p: Column) -> Column:
            same = lambda k: F.get(p, k)["h"]
            twice = F.filter(p, lambda x, k: (F.coalesce(same(k - 1) == x["h"], F.lit(False))) | F.coalesce(same(k + 1) == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def length(at: Column) -> Column:
            # each window adds the words up to the next repeated window's start, wide at most
            gaps = F.transform(at, lambda x, k: F.least(F.lit(wide), F.coalesce(F.get(at, k + 1) - x, F.lit(wide))))
            return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

        step = F.transform(F.array(pairs), of)  # arrays of one element: each part is worked out once
        return F.get(F.transform(step, length), 0)

    return hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)).cast("long")


def with_class_counts(d: DataFrame, text: str, out: str, symbols: str | None = None) -> DataFrame:
    """d with out: code points of each of CLASSES and of what is left, as an array of doubles; and, under the name symbols,
    how many SYMBOLS there are, looked for only in what letters, white space, marks and digits leave.

    Each class is taken out of what the last one left, in a column of its own, so that no pattern runs twice.
    """
    steps = [text, *fresh(d, *[f"{out}{i}" for i in range(len(CLASSES))])]
    for (_, pattern), was, now in zip(CLASSES, steps, steps[1:], strict=False):
        d = d.withColumn(now, F.regexp_replace(was, pattern, ""))
    if symbols:
        d = d.withColumn(symbols, F.char_length(F.regexp_replace(steps[5], SYMBOLS, "")).cast("long"))
    n = [F.char_length(c).cast("double") for c in steps]
    return d.withColumn(out, F.array(*[a - b for a, b in zip(n, n[1:], strict=False)], n[-1])).drop(*steps[1:])


def shares(counts: Column) -> Column:
    """Counts over their sum; all zero where there are none. counts should be a plain column: it is read twice."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.get(F.transform(F.array(total), lambda t: F.transform(counts, lambda c: F.when(t > 0, c / t).otherwise(0.0))), 0)


def jensen_shannon(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (base 2, the divergence's root, 0 to 1) of two arrays of shares."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)))


def spaced(words: Column) -> Column:
    """Words in lower case, each with a space of its own on both sides."""
    return F.concat(F.lit(" "), F.lower(F.array_join(words, "  ")), F.lit(" "))


def common_counts(line: Column, common: Column, n: Column) -> Column:
    """How often each common word stands in spaced() text, and how many of n words are others."""
    size = F.octet_length(line)
    each = F.transform(common, lambda w: ((size - F.octet_length(F.replace(line, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("double"))
    return F.get(F.transform(F.array(each), lambda e: F.concat(e, F.array(F.greatest(F.lit(0.0), n - F.aggregate(e, F.lit(0.0), lambda a, b: a + b))))), 0)


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 20, min_word_share: float = 0.002, min_lang_words: int = 10_000) -> tuple[DataFrame, list[float]]:
    """(references, shares of all documents together). References have one row for each language of min_lang_words words or
    more: lang, common (words), common_ref and class_ref (shares), from all its documents, whatever their length.

    Common words (in lower case) are those of at least min_word_share of the language's words, the top most frequent of
    them; ties go by the word. Words are first counted in 65536 hashed slots, and then by name in slots that are full
    enough to hold a common word; that is exact, and no shuffle carries the whole vocabulary. All tables are written,
    so Spark broadcasts one only where its size allows. The shares of all documents are over FOLDED classes.
    """
    base = docs.filter(F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    k = len(CLASSES) + 1
    sums = written(with_class_counts(base, "text", "c").groupBy("lang").agg(*[F.sum(F.get("c", i)).alias(f"c{i}") for i in range(k)]))
    every = sums.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)) for i in range(k)]).first()
    every = [sum(every[i] for i in group) for group in FOLDED]
    langs = sums.filter("lang is not null").withColumn("c", F.array(*[F.col(f"c{i}") for i in range(k)])).select("lang", shares(F.col("c")).alias("class_ref"))
    word = base.filter("lang is not null").select("lang", F.explode(word_array(F.lower("text"))).alias("w")).withColumn("slot", F.pmod(F.xxhash64("w"), F.lit(1 << 16)).cast("int"))
    least = F.col("count") >= min_word_share * F.col("n")
    slots = written(word.groupBy("lang", "slot").count())
    total = slots.groupBy("lang").agg(F.sum("count").alias("n")).filter(F.col("n") >= min_lang_words)
    full = written(slots.join(total, "lang").filter(least).select("lang", "slot", "n"))
    often = word.join(full, ["lang", "slot"]).groupBy("lang", "w").agg(F.count("*").alias("count"), F.first("n").alias("n")).filter(least)
    ranked = often.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("less"), "w"))), 1, top).alias("best"), F.first("n").alias("n"))
    common = ranked.select("lang", F.transform("best", lambda b: b["w"]).alias("common"), F.transform("best", lambda b: -b["less"] / F.col("n")).alias("ref"))
    common = common.withColumn("common_ref", F.concat("ref", F.array(F.greatest(F.lit(0.0), 1 - F.aggregate("ref", F.lit(0.0), lambda a, b: a + b))))).drop("ref")
    return written(langs.join(total.select("lang"), "lang", "left_semi").join(common, "lang", "left")), [x / sum(every) if sum(every) else 0.0 for x in every]


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_class: float = 0.32, max_common: float = 0.42, min_chars: int = 200, min_words: int = 40, references: tuple[DataFrame, list[float]] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, common_distance, kept.

    The base fails texts of under 20 words, or with over 30 % of their words in repeated windows of 8. The others are
    held against their language's references: a text is dropped if the distance of its character classes is over
    max_class (texts of min_chars or more), or that of its common words over max_common (min_words or more). Texts of no
    language, or of one too thin for a reference, are held against the FOLDED classes of all documents, which every
    language shares; they have no common words to be held against. Texts under both lengths keep the base's verdict.

    Null or blank text: no words, base fails. Very long texts: whole, in arrays of one row. Ties: a distance equal to its
    limit passes. Repeated rows: each gets its own row. Empty table: empty result. docs keeps its columns and their
    order; the new ones follow and take the place of any of the same name.
    """
    w, t, h, line, counts, found, ref, lang = fresh(docs, "_words", "_text", "_hashes", "_line", "_counts", "_found", "_ref", "_lang")
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "common_distance", "kept"]
    refs, every = references if references is not None else language_references(docs, text_col, lang_col)
    refs = refs.select(F.col("lang").alias(lang), F.struct("class_ref", "common", "common_ref").alias(ref))
    keep = [c for c in docs.columns if c.lower() not in new or c in (text_col, lang_col)]
    d = docs.select(*keep).join(refs, docs[lang_col].cast("string") == F.col(lang), "left")
    d = d.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumn(w, word_array(F.col(t)))
    hashes, covered = repeated_words(F.col(w))
    d = d.withColumn(h, hashes).withColumn("n_words", F.size(w).cast("long"))
    d = d.withColumn("n_repeat_words", covered(F.col(h))).drop(h)
    lines = F.filter(F.split(t, "\n"), lambda x: strip_white(x) != "")
    d = d.withColumn("n_dup_lines", F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 0).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    d = with_class_counts(d, t, counts, "n_symbols")
    d = d.withColumn("word_chars", F.char_length(t).cast("long") - F.get(counts, 1).cast("long"))  # all but white space is in words
    good = ~F.col("base_failed")
    folded = F.array(*[sum((F.get(counts, i) for i in group[1:]), F.get(counts, group[0])) for group in FOLDED])
    own, other = jensen_shannon(shares(F.col(counts)), F.col(f"{ref}.class_ref")), jensen_shannon(F.transform(folded, lambda c: c / F.greatest(F.char_length(t), F.lit(1))), F.array(*map(F.lit, every)))
    d = d.withColumn("class_distance", F.when(good & (F.char_length(t) >= min_chars), F.when(F.col(lang).isNotNull(), own).otherwise(other)))
    common = F.when(F.size(F.col(f"{ref}.common")) > 0, F.col(f"{ref}.common"))
    d = d.withColumn(line, F.when(good & (F.col("n_words") >= min_words), spaced(F.col(w))))
    d = d.withColumn(found, common_counts(F.col(line), common, F.col("n_words").cast("double")))
    d = d.withColumn("common_distance", F.when(F.col(line).isNotNull() & common.isNotNull(), jensen_shannon(shares(F.col(found)), F.col(f"{ref}.common_ref"))))
    ok = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= max_class) & (F.coalesce(F.col("common_distance"), F.lit(0.0)) <= max_common)
    return d.withColumn("kept", good & ok).select(*keep, *new)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """The rows of docs that quality() keeps, with the columns of docs, whatever their names.

    A row number next to the verdict keeps Spark from pushing the filter down: it would put the verdict's whole
    expression, many times over, in place of its column.
    """
    whole, text, lang, row = fresh(docs, "_whole", "_text_", "_lang_", "_row")
    judged = quality(docs.select(F.struct(*docs.columns).alias(whole), F.col(text_col).alias(text), F.col(lang_col).alias(lang)), text, lang, **how)
    return judged.select(whole, "kept", F.monotonically_increasing_id().alias(row)).filter(F.col("kept") & (F.col(row) >= 0)).select(f"{whole}.*")

"""Line de-duplication: lines found in several documents stay only in the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, fresh, strip_white, written


def line_key(line: Column) -> Column:
    """What two lines must share to be the same: white space at both ends dropped, A-Z lower-cased."""
    return ascii_lower(strip_white(line))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with the lines that min_docs or more documents share taken out of all but the document of smallest id.

    A line's key is line_key(); keys of under min_chars code points are never dropped. Lines are exploded, their keys
    hashed (twice 64 bits) and the documents of a hash counted with partial sums before the shuffle. Only positions to
    drop go back to the documents, whose texts are shuffled once. The repeated keys are a written table: Spark knows
    its size, and splits a hot key where it is too large to broadcast.

    Null or empty text: one empty line; the text becomes ''. Rows of one id count as one document, and each loses its
    own lines. Null id: its lines are neither counted nor dropped. Empty table: empty result. Other columns pass
    unchanged, in place. counts names two more columns: lines before dropping, and lines dropped.
    """
    lines_, drops, id_, mark = fresh(docs, "_lines", "_drops", "_id", "_mark")
    line = (
        docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) >= min_chars))
        .select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
        .select("id", "mark", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    if min_docs == 2:  # two documents hold a key exactly when its least and greatest ids differ
        seen = line.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last")
    else:
        seen = line.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    repeated = written(seen.select("h1", "h2", "first"))
    losing = line.join(repeated, ["h1", "h2"]).filter(F.col("id") != F.col("first")).groupBy("id", "mark").agg(F.collect_set("pos").alias(drops))
    losing = losing.withColumnsRenamed({"id": id_, "mark": mark})
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(losing, (docs[id_col] == losing[id_]) & (F.xxhash64(docs[text_col]) == losing[mark]), "left").drop(id_, mark)
    split = joined.withColumn(lines_, F.split(text, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), drops)
    out = {text_col: F.when(F.col(drops).isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(lines_), i)), "\n"))}
    if counts:
        out |= {counts[0]: F.size(lines_).cast("long"), counts[1]: F.coalesce(F.size(drops), F.lit(0)).cast("long")}
    return split.select(*[out.pop(c).alias(c) if c == text_col else F.col(c) for c in docs.columns], *[c.alias(n) for n, c in out.items()])

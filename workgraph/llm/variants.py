"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods, and the form each rarer one stands for."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, partitions, written
from ._words import mix

#: A run of letters (fixed by the contract).
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Bits of a block of the filters (one cache line) and bits set in it for a word.
BLOCK, SET = 512, 6
#: Bits of the filters for each word, as long as all filters together stay under MOST_BITS (32 MB): more words fill the
#: blocks further, and the exact join gets more false positives to remove.
WORD_BITS, MOST_BITS = 16, 1 << 28
#: Bytes of the filters that are put together at a time; edits that are probed at a time.
REGION, PROBES = 1 << 16, 1 << 20
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def slipped(run: Column, doc_id: Column, every: int = 199) -> Column:
    """A lower-cased run as its document writes it: where every divides the crc32 of `doc_id:run`, one code point is missing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): slipped runs of whole texts with at least so many code points and occurrences. Counts are summed in the
    tasks before they are shuffled. Null texts have no words; a null id is written as nothing in front of the colon."""
    long = F.regexp_extract_all(F.col(text_col), F.lit(RUN.replace("+", f"{{{min_length},}}")), F.lit(0))  # a slip only shortens
    run = docs.select(F.col(id_col).alias("id"), F.explode(long).alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))
    word = run.select(slipped(F.col("run"), F.col("id")).alias("word"))
    return word.groupBy("word").agg(F.count("*").alias("n")).filter((F.char_length("word") >= min_length) & (F.col("n") >= min_count))


# --- words of one length as matrices of code points, and hashes that an edit changes in constant time ---


def _powers(length: int) -> np.ndarray:
    up = np.full(length + 1, _BASE, np.uint64)
    up[0] = 1
    return np.cumprod(up)


def _matrix(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.uint64)


def hashes(points: np.ndarray) -> np.ndarray:
    """Hash of each row of code points: a polynomial before the last mixing."""
    return (mix(points + np.uint64(1)) * _powers(points.shape[1])[: points.shape[1]]).sum(1, dtype=np.uint64)


def deletions(points: np.ndarray) -> np.ndarray:
    """(word, place): the hash of each word without the code point at that place."""
    each = mix(points + np.uint64(1)) * _powers(points.shape[1])[: points.shape[1]]
    upto = np.cumsum(each, 1, dtype=np.uint64)
    return upto - each + (upto[:, -1:] - upto) * _INVERSE


def replacements(points: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """(word, place, letter): the hash of each word with that letter at that place."""
    up = _powers(points.shape[1])[: points.shape[1]]
    coded, new = mix(points + np.uint64(1)), mix(letters.astype(np.uint64) + np.uint64(1))
    return (coded * up).sum(1, dtype=np.uint64)[:, None, None] + (new[None, None, :] - coded[:, :, None]) * up[None, :, None]


# --- blocked Bloom filters, one for each length ---


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each mixed hash, by its upper 24 bits."""
    return (((h >> np.uint64(40)) * np.uint64(blocks)) >> np.uint64(24)).astype(np.int64)


def _bit(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of the SET bits of each mixed hash in its block."""
    return ((((h >> np.uint64(6 * k)) * np.uint64(0x9E3779B1)) >> np.uint64(9)) % np.uint64(BLOCK)).astype(np.int64)


class Filters:
    """Blocked Bloom filters of the words of each length. A word sets SET bits in one block."""

    def __init__(self, shards: dict[int, np.ndarray]) -> None:
        self.shards = shards  # length -> bytes, blocks of BLOCK bits

    def holds(self, length: int, h: np.ndarray) -> np.ndarray:
        """Whether each hash may be that of a word of this length; never false for one that is."""
        bits = self.shards.get(length)
        if bits is None:
            return np.zeros(h.shape, bool)
        flat = mix(h.reshape(-1))
        start = _block(flat, len(bits) * 8 // BLOCK) * (BLOCK // 8)
        left = np.arange(len(flat))
        for k in range(SET):  # most of what is no word goes with the first bits
            at = _bit(flat[left], k)
            left = left[(bits[start[left] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(flat), bool)
        out[left] = True
        return out.reshape(h.shape)


def build_filters(words: DataFrame, word_bits: int = WORD_BITS, most_bits: int = MOST_BITS) -> Filters:
    """The filters of all words of a table (word). Each region of a filter, of REGION bytes at most, is put together in a
    task of its own from the hashes that fall into it; the driver gets the finished regions, most_bits together whatever
    the number of words (and a block for each length)."""
    sized = words.groupBy(F.char_length("word").alias("length")).count().collect()  # a row for each length
    total = sum(r["count"] for r in sized)
    each = min(word_bits, most_bits / max(1, total))
    blocks = {r["length"]: max(1, min(1 << 24, int(-(-r["count"] * each // BLOCK)))) for r in sized}
    per = REGION * 8 // BLOCK

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
            for n in np.unique(lengths).tolist():
                h = hashes(_matrix([texts[i] for i in np.nonzero(lengths == n)[0].tolist()], n))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array((_block(mix(h), blocks[n]) // per).astype(np.int32)), pa.array(h.view(np.int64))], ["length", "region", "h"])

    def region(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = key[0].as_py(), key[1].as_py()
        bits = np.zeros(min(per, blocks[n] - r * per) * BLOCK // 8, np.uint8)
        for batch in batches:
            h = mix(batch.column(2).to_numpy().view(np.uint64))
            start = (_block(h, blocks[n]) - r * per) * (BLOCK // 8)
            for k in range(SET):
                at = _bit(h, k)
                np.bitwise_or.at(bits, start + (at >> 3), np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([r], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["length", "region", "bits"])

    placed = words.select("word", F.char_length("word").alias("length")).mapInArrow(place, "length int, region int, h long")
    made = placed.groupBy("length", "region").applyInArrow(region, "length int, region int, bits binary").collect()
    shards: dict[int, list] = {}
    for row in sorted(made, key=lambda r: (r["length"], r["region"])):
        shards.setdefault(row["length"], []).append(np.frombuffer(row["bits"], np.uint8))
    return Filters({n: np.concatenate(parts) for n, parts in shards.items()})


def probed(words: DataFrame, filters: Filters, letters: list[int]) -> DataFrame:
    """(word, other): the edits of each word that its filters hold: every deletion, and replacements by a greater letter.

    The other half of all edits is these seen from the other word: an insertion is a deletion of the longer word, and
    a replacement by a smaller letter is one by a greater letter. letters are the code points that words have.
    """
    sent = words.sparkSession.sparkContext.broadcast(filters)
    alphabet = np.array(sorted(letters), np.uint64)

    def rows(texts: list[str], n: int) -> Iterator[tuple[str, str]]:
        filters_, points = sent.value, _matrix(texts, n)
        if n > 1:
            for i, k in zip(*np.nonzero(filters_.holds(n - 1, deletions(points))), strict=True):
                yield texts[i], texts[i][:k] + texts[i][k + 1 :]
        for i, k, c in zip(*np.nonzero(filters_.holds(n, replacements(points, alphabet)) & (alphabet[None, None, :] > points[:, :, None])), strict=True):
            yield texts[i], texts[i][:k] + chr(int(alphabet[c])) + texts[i][k + 1 :]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            by_length: dict[int, list[str]] = {}
            for t in texts:
                by_length.setdefault(len(t), []).append(t)
            for n, same in by_length.items():
                step = max(1, PROBES // (n * max(1, len(alphabet))))
                for at in range(0, len(same), step):
                    found = sorted(set(rows(same[at : at + step], n)))
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], ["word", "other"])

    return words.select("word").mapInArrow(run, "word string, other string")


def near_words(words: DataFrame, word_bits: int = WORD_BITS, most_bits: int = MOST_BITS) -> DataFrame:
    """(word, n, near, near_n): all pairs of words (word, n), in both directions, that differ by exactly one inserted,
    deleted or replaced code point. Only edits that the filters hold are shuffled; the join with the words drops those
    that are none, so the result is exact whatever the filters let through."""
    letters = alphabet_of(words)
    edits = probed(words.repartition(partitions(words.sparkSession), "word"), build_filters(words, word_bits, most_bits), letters)
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = edits.join(other, "other").join(words, "word")
    both = F.array(F.struct("word", "n", F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def alphabet_of(words: DataFrame) -> list[int]:
    """The different code points of all words: at most as many as the script of the words has."""
    return sorted(ord(r.x) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).filter("x <> ''").distinct().collect())


def roots(steps: DataFrame, most: int = 6) -> DataFrame:
    """(word, root) of a table (word, form) in which following forms ends: each round doubles the steps taken. A form has
    five times its word's count, so 26 steps (five rounds) reach beyond any 64-bit count; rounds end when nothing moves."""
    at = written(steps.select("word", F.col("form").alias("root")))
    for _ in range(most):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(at.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        at = moved.drop("_moved")
        if not moved.filter("_moved").limit(1).count():
            break
    return at


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, times: int = 5, id_col: str = "doc_id", text_col: str = "text", word_bits: int = WORD_BITS, most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each word of vocabulary(): word, form, root, n, n_near, form_n.

    Near words differ by one edit. A word's form is its near word of greatest count n (ties: the smallest in code-point
    order) where that is at least times its own, else null; root is where following forms ends, the word itself where it
    has none. n_near counts near words.

    Null, empty and wordless texts add nothing. Very long texts: whole, a row a run. Repeated rows count again. Empty table
    or no word: empty result. Other columns of docs are not used, whatever their names. No word is collected anywhere:
    filters have a bound of their own, and pairs meet in equi-joins on words.
    """
    words = written(vocabulary(docs, min_length, min_count, id_col, text_col))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words, word_bits, most_bits).groupBy("word").agg(F.count("*").alias("n_near"), best)
    of = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best")))
    steps = of.filter("best is not null").select("word", F.col("best.near").alias("form"))
    out = of.join(roots(steps), "word", "left")
    return out.select("word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n"))

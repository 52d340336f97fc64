"""Alignment of two tokenizers: groups of tokens between common byte ends, and how often each pair of ids ends together.

A first pass over the documents counts pairs for each task; a minimal perfect hash of the distinct pairs gives each a slot of
a dense count vector; the tasks' vectors are summed as a tree; a second pass aligns the documents again and looks counts up.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, pieces, with_columns, written
from ._words import mix

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: A piece of a text that both tokenizers encode alone: it ends before a space or a newline after anything but white space,
#: or after a single newline. Neither has a token across such an edge.
UNIT = re.compile(r"\n(?= ?\S)|(?:[ \n]\s*)?\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
#: White space that parts units in another way than single spaces and newlines between other characters do.
ODD, ODD_RUNS = re.compile(r"[^\S \n]|\0"), ("  ", " \n", "\n ", "\n\n")
# Fixed value: how the first tokenizer cuts a text before it merges bytes.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units without an effect on what stands before or behind them; they are encoded together, parted by newlines.
PLAIN = re.compile(r" ?\S(?:[^\n]*\S)?\Z")
#: Units that are encoded together; bytes of text whose units are counted before they are aligned; units that a second pass
#: remembers (about 350 bytes each).
SLICE, WINDOW, MOST_UNITS = 20_000, 24 << 20, 500_000
#: Pairs in a bucket of the hash; bits for each pair in a level; pairs whose counts are broadcast (about 18 bytes each).
BUCKET, SPARE, MOST_PAIRS = 4096, 1.5, 8_000_000
NEW = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups_sha256": "string"}


class Aligned:
    """Units that were aligned together: counts for each unit, and the links of all in order."""

    __slots__ = ("good", "links", "n_a", "n_b", "n_links", "of", "strings")


class Pair:
    """Two tokenizers, and the bytes of their tokens."""

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        coded = {c: x for x, c in enumerate(_byte_letters())}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(coded.get(c, 0) for c in t) for t in names]
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.labels = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]
        self.a_line, self.b_line = self.a.encode("\n", add_special_tokens=False).ids, self.b.encode("\n")[-1:]
        crossing = any(re.search(r"[^▁]▁|\n", t) for i, t in enumerate(names) if not self.b.is_control(i))
        whole = json.loads(self.a.to_str())
        first = whole["pre_tokenizer"] or {}
        own = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and len(self.a_line) == 1
        self.split = own and not crossing  # other tokenizers: whole texts
        self.a_fast = self._ranked(whole) if own else None

    def _ranked(self, whole: dict):
        """The same byte-level merges as ranks, whose encoder is several times faster; only where a token's id is its rank."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
        singles = [i for i, t in enumerate(self.a_bytes) if len(t) == 1]
        first = len(singles)
        vocab = whole["model"]["vocab"]
        if whole["normalizer"] or max(singles) != first - 1 or any(vocab.get("".join(m)) != first + i for i, m in enumerate(merges)):
            return None
        return tiktoken.Encoding("a", pat_str=PRETOKEN, mergeable_ranks={self.a_bytes[i]: i for i in range(first + len(merges))}, special_tokens={})

    def _a(self, text: str) -> list[int]:
        return self.a_fast.encode_ordinary(text) if self.a_fast else self.a.encode(text, add_special_tokens=False).ids

    def _b(self, text: str) -> list[int]:
        # a line in front keeps the space that this tokenizer adds away from the text
        return self.b.encode("\n" + text, num_threads=1)[2:]

    def units(self, text: str | None) -> list[str]:
        """The units of space and text; null and empty texts have none."""
        if not text:
            return []
        text = " " + text
        if not self.split:
            return [text]
        if text[-1] in " \n" or any(run in text for run in ODD_RUNS) or ODD.search(text):
            return UNIT.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0")[1:].split("\0")  # the same, faster

    @staticmethod
    def sorted_out(units: Iterable[str]) -> Iterator[tuple[list[str], bool]]:
        """Slices of units, and whether all in a slice are plain."""
        plain, odd = [], []
        for u in units:
            (plain if PLAIN.match(u) else odd).append(u)
        for some, kind in ((plain, True), (odd, False)):
            for at in range(0, len(some), SLICE):
                yield some[at : at + SLICE], kind

    @staticmethod
    def _together(units: list[str], encode, line: list[int], table: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of all plain units in order, how many each has), encoded in one text; None where that is not their bytes."""
        text = "\n".join(units)
        found = encode(text)
        if b"".join(map(table.__getitem__, found)) != text.encode():
            return None
        ids = np.asarray(found, np.int64)
        parts = ids == line[0]
        ends = np.append(np.nonzero(parts)[0], len(ids))
        return (ids[~parts], np.diff(ends, prepend=-1) - 1) if len(ends) == len(units) else None

    @staticmethod
    def _alone(units: list[str], encode, table: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all units in order, how many each has, whether they are its bytes)."""
        lists = [encode(u) for u in units]
        good = np.array([b"".join([table[k] for k in x]) == u.encode() for u, x in zip(units, lists, strict=True)], bool)
        return np.array(list(chain.from_iterable(lists)), np.int64), np.array([len(x) for x in lists], np.int64), good

    def align(self, units: list[str], plain: bool, strings: bool = False) -> Aligned:
        """Different units, aligned. A unit whose bytes a tokenizer does not give back is not good, and has no link."""
        together = lambda encode, line, table: plain and len(line) == 1 and self._together(units, encode, line, table) or None
        good = np.ones(len(units), bool)
        pairs = []
        for encode, line, table in ((self._a, self.a_line, self.a_bytes), (self._b, self.b_line, self.b_bytes)):
            found = together(encode, line, table)
            if found is None:
                *found, same = self._alone(units, encode, table)
                good &= same
            pairs.append(found)
        (a_ids, n_a), (b_ids, n_b) = pairs
        if not good.all():
            a_ids, b_ids = a_ids[np.repeat(good, n_a)], b_ids[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        a_cut, b_cut = _among(a_end, b_end), _among(b_end, a_end)
        out = Aligned()
        out.good, out.n_a, out.n_b = good, n_a, n_b
        out.of = np.repeat(np.arange(len(units)), n_a)[a_cut]  # the unit of each link
        out.links = (a_ids[a_cut] << 32) | b_ids[b_cut]
        out.n_links = np.bincount(out.of, minlength=len(units))
        if strings:
            group = np.concatenate([(np.cumsum(a_cut) - a_cut) * 2, (np.cumsum(b_cut) - b_cut) * 2 + 1])
            label = np.concatenate([a_ids * 2 + a_cut, (b_ids + len(self.a_bytes)) * 2 + b_cut])
            words = list(map(self.labels.__getitem__, label[np.argsort(group, kind="stable")].tolist()))
            ends = np.cumsum(n_a + n_b).tolist()
            out.strings = ["".join(words[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        return out


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    held = set(prints)
    return [chr(x) if x in held else chr(next(other)) for x in range(256)]


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each of the ascending x is among the ascending y."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


@lru_cache(2)
def tokenizer_pair(a: str, b: str) -> Pair:
    return Pair(a, b)


# --- minimal perfect hash of pairs ---


def _level(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.view(np.uint64) ^ np.uint64((level + 1) * 0xA24BAED4963EE407 & (2**64 - 1)))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(keys.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(bits of each level, all bits) of different keys: in each level a key that falls alone on a bit sets it and is done,
    the others go on. A key's slot is how many bits are set before its own."""
    sizes, bits, level = [], [], 0
    while len(keys):
        m = max(8, int(len(keys) * SPARE))
        at = (_level(keys, level) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        bits.append(alone)
        keys = keys[~alone[at]]
        level += 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


class PairTable:
    """The perfect hash of all pairs, with the pair (to verify) and the count in each slot."""

    def __init__(self, buckets: int, rows: list, best: np.ndarray) -> None:
        """rows: (bucket, sizes, bits, keys, counts) of each bucket, keys and counts by slot; best: highest count by B id."""
        levels = max([1, *(len(r[1]) for r in rows)])
        self.buckets, self.best = buckets, best
        self.base, self.size = np.zeros((buckets, levels), np.int64), np.zeros((buckets, levels), np.int64)
        bits, at = [], 0
        for bucket, sizes, packed, *_ in rows:
            self.size[bucket, : len(sizes)] = sizes
            self.base[bucket, : len(sizes)] = at + np.cumsum(sizes) - sizes
            bits.append(np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(sizes)))
            at += sum(sizes)
        every = np.concatenate([*bits, np.zeros(64 - at % 64, np.uint8)])
        self.words = np.packbits(every, bitorder="little").view("<u8")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)  # bits set before each word
        self.keys = np.concatenate([np.zeros(0, np.int64), *(np.asarray(r[3], np.int64) for r in rows)])
        self.counts = np.concatenate([np.zeros(0, np.int64), *(np.asarray(r[4], np.int64) for r in rows)])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each pair; -1 for a pair that is not in the table."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys)) if self.buckets else np.zeros(0, np.int64)
        bucket = bucket_of(keys, max(1, self.buckets))
        for level in range(self.size.shape[1]):
            m = self.size[bucket[left], level]
            left, m = left[m > 0], m[m > 0]
            if not len(left):
                break
            at = self.base[bucket[left], level] + (_level(keys[left], level) % m.astype(np.uint64)).astype(np.int64)
            hit = (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[hit]] = self._rank(at[hit])
            left = left[~hit]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)

    def _rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set before each place."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


# --- the passes ---


def partial_counts(docs: DataFrame, a: str, b: str, text_col: str) -> DataFrame:
    """(key, n, task): how many links hold each pair, by task and WINDOW of text. key is the A id * 2^32 + the B id."""

    def window(texts: list[str], pair: Pair, task: int) -> Iterator[pa.RecordBatch]:
        units = Counter()
        for t in texts:
            units.update(pair.units(t))
        bad: set[str] = set()
        for retry in (True, False):
            keys, weights = [], []
            for some, plain in pair.sorted_out(units):
                x = pair.align(some, plain)
                bad.update(u for u, ok in zip(some, x.good.tolist(), strict=True) if not ok)
                n = np.fromiter(map(units.__getitem__, some), np.int64, len(some))
                keys.append(x.links)
                weights.append(n[x.of])
            if not (bad and retry):
                break
            for t in texts:  # a text with such a unit has no tokens at all
                own = pair.units(t)
                if not bad.isdisjoint(own):
                    units.subtract(own)
            units = +units
        if keys:
            k, where = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(k), np.int64)
            np.add.at(n, where, np.concatenate(weights))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.array(np.full(len(k), task, np.int32))], ["key", "n", "task"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task = tokenizer_pair(a, b), TaskContext.get().partitionId()
        held, size = [], 0
        for batch in batches:
            for start, n in pieces([batch.column(0)], 1 << 20, 1 << 20):
                some = [t for t in batch.column(0).slice(start, n).to_pylist() if t]
                held += some
                size += sum(map(len, some))
                if size >= WINDOW:
                    yield from window(held, pair, task)
                    held, size = [], 0
        yield from window(held, pair, task)

    return docs.select(text_col).mapInArrow(run, "key long, n long, task int")


def count_pairs(docs: DataFrame, a: str = A, b: str = B, text_col: str = "text", bucket: int = BUCKET) -> tuple[DataFrame, int, int]:
    """(table, its buckets, how many pairs): the counts of all pairs that end together somewhere in docs.

    A row of the table is a bucket of the perfect hash: bucket, sizes, bits, and its pairs (keys) and their counts by slot.
    Buckets are built and summed in tasks of their own: first a vector for each bucket and lane of tasks, as many lanes
    as a lane has tasks, then the vectors of all lanes. So no task meets more than the root of all parts.
    """
    parts = written(partial_counts(docs, a, b, text_col))
    keys = written(parts.select("key").distinct())
    total, tasks = keys.count(), parts.agg(F.max("task")).first()[0]
    buckets, lanes = -(-total // bucket), max(1, int((1 + (tasks or 0)) ** 0.5))
    if not total:
        return docs.sparkSession.createDataFrame([], "bucket int, sizes array<int>, bits binary, keys array<bigint>, counts array<bigint>"), 0, 0

    def bucketed(df: DataFrame) -> DataFrame:
        return with_columns(df, {"bucket": "int"}, ["key"], lambda k: [pa.array(bucket_of(k.to_numpy(), buckets))], rows=1 << 16)

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.concatenate([x.column(0).to_numpy() for x in batches])
        sizes, bits = perfect_hash(k)
        by_slot = np.empty(len(k), np.int64)
        by_slot[_slots_of(k, sizes, bits)] = k
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sizes], pa.list_(pa.int32())), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([by_slot], pa.list_(pa.int64()))], ["bucket", "sizes", "bits", "keys"])

    hashed = written(bucketed(keys).select("key", "bucket").groupBy("bucket").applyInArrow(build, "bucket int, sizes array<int>, bits binary, keys array<bigint>"))

    def fill(key: tuple, rows: pa.Table, built: pa.Table) -> pa.Table:
        by_slot = np.asarray(built.column("keys")[0].values if built.num_rows else [], np.int64)
        n, counts = rows.column("n").to_numpy(), np.zeros(len(by_slot), np.int64)
        if rows.num_rows:
            k = rows.column("key").to_numpy()
            at = _slots_of(k, built.column("sizes")[0].as_py(), np.unpackbits(np.frombuffer(built.column("bits")[0].as_py(), np.uint8), count=sum(built.column("sizes")[0].as_py())).astype(bool))
            if (by_slot[at] != k).any():
                raise ValueError("a pair is not in its slot")
            np.add.at(counts, at, n)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([counts], pa.list_(pa.int64()))})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sum(np.asarray(c.values, np.int64) for batch in batches for c in batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([counts], pa.list_(pa.int64()))], ["bucket", "counts"])

    left = bucketed(parts).withColumn("lane", F.col("task") % lanes).groupBy("bucket", "lane")
    right = hashed.withColumn("lane", F.explode(F.array(*map(F.lit, range(lanes))))).groupBy("bucket", "lane")
    vectors = left.cogroup(right).applyInArrow(fill, "bucket int, counts array<bigint>")
    summed = vectors.groupBy("bucket").applyInArrow(add, "bucket int, counts array<bigint>")
    return written(hashed.join(summed, "bucket")), buckets, total


def _slots_of(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slots of keys that one bucket's hash holds."""
    rank = np.cumsum(bits) - bits
    out, left, base = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    for level, m in enumerate(sizes):
        at = base + (_level(keys[left], level) % np.uint64(m)).astype(np.int64)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + m
    return out


def pair_counts(table: DataFrame) -> DataFrame:
    """(a, b, n, best) of a table of count_pairs: ids, links that hold them, and whether n is the highest of the B id."""
    flat = table.select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).select(F.shiftright("x.keys", 32).alias("a"), F.col("x.keys").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), F.col("x.counts").alias("n"))
    top = flat.groupBy("b").agg(F.max("n").alias("top"))
    return flat.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


class Memory:
    """Units met by this worker: an index each, with what a document adds up of them."""

    def __init__(self, pair: Pair, table: PairTable | None) -> None:
        self.pair, self.table = pair, table
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.strings: list[str] = []
        self.links: list[np.ndarray] = []
        self.sums = [np.zeros(0, np.int64)] * 6  # n_a, n_b, links, best links, counts, not good

    def learn(self, lists: list[list[str]]) -> None:
        if len(self.index) > MOST_UNITS:
            self.clear()
        new = set(chain.from_iterable(lists)).difference(self.index)
        sums = [[x] for x in self.sums]
        for some, plain in self.pair.sorted_out(new):
            x = self.pair.align(some, plain, strings=True)
            best = count = np.zeros(len(some), np.int64)
            if self.table is not None:
                slot = self.table.slots(x.links)
                n = np.where(slot >= 0, self.table.counts[slot], 0) if len(self.table.counts) else np.zeros(len(slot), np.int64)
                top = n == self.table.best[x.links & 0xFFFFFFFF]
                best = np.bincount(x.of, top, len(some)).astype(np.int64)
                count = np.zeros(len(some), np.int64)
                np.add.at(count, x.of, n)
            else:
                self.links += np.split(x.links, np.cumsum(x.n_links)[:-1])
            self.index.update(zip(some, range(len(self.strings), len(self.strings) + len(some)), strict=True))
            self.strings += x.strings
            for held, now in zip(sums, (x.n_a, x.n_b, x.n_links, best, count, (~x.good).astype(np.int64)), strict=True):
                held.append(now)
        self.sums = [np.concatenate(x) for x in sums]

    def add_up(self, lists: list[list[str]]) -> tuple[list[np.ndarray], list[str], list[np.ndarray]]:
        """(sums by name, groups, links) of documents; zeros where some unit is not good."""
        at = [list(map(self.index.__getitem__, units)) for units in lists]
        n = np.array([len(x) for x in at], np.int64)
        flat = np.append(np.fromiter(chain.from_iterable(at), np.int64, n.sum()), len(self.strings))  # a zero, for documents without units at the end
        sums = [np.add.reduceat(np.append(x, 0)[flat], np.cumsum(n) - n) * (n > 0) if len(n) else n for x in self.sums]
        good = (sums[5] == 0).tolist()
        groups = ["".join(map(self.strings.__getitem__, x))[:-1] if ok else "" for x, ok in zip(at, good, strict=True)]
        links = [[self.links[i] for i in x] if ok else [] for x, ok in zip(at, good, strict=True)] if self.table is None else []
        return [x * (sums[5] == 0) for x in sums], groups, links


_memory: dict[str, Memory] = {}


def aligned(docs: DataFrame, a: str = A, b: str = B, text_col: str = "text", most_pairs: int = MOST_PAIRS, bucket: int = BUCKET, groups: str | None = None) -> DataFrame:
    """docs with n_a, n_b (tokens), n_groups, n_links, n_best, count_sum and groups_sha256; groups names a column for the
    groups themselves, written `a1,a2|b1;a3|b2,b3`.

    A encodes space and text, B the text, to which it adds the space; their strings of special tokens are plain text.
    Groups end at byte offsets where tokens of both end, a link being the last pair of a group. A pair's count is over
    all docs; a link is best if its count is the highest of its B id (ties too). Counts and hash are broadcast for up to
    most_pairs pairs; beyond that each document's pairs are joined with the counts, to the same result.

    Texts null, empty, or that a tokenizer does not give back whole: no tokens, zeros and ''. Very long texts: whole, in
    units; memory follows the different units of WINDOW bytes and the longest text. Repeated rows count again. Ties: above.
    Empty table: empty result. docs keeps its columns and their order; new ones follow and replace any of their names.
    """
    spark = docs.sparkSession
    table, buckets, total = count_pairs(docs, a, b, text_col, bucket)
    small = total <= most_pairs
    top = pair_counts(table).groupBy("b").agg(F.max("n").alias("n")) if small else None
    found, run = None, uuid.uuid4().hex
    if small:
        best = np.zeros(tokenizer_pair(a, b).b.vocab_size(), np.int64)  # a number for each id of B
        for r in top.collect():
            best[r.b] = r.n
        found = spark.sparkContext.broadcast(PairTable(buckets, [tuple(r) for r in table.select("bucket", "sizes", "bits", "keys", "counts").collect()], best))
    new = dict(NEW) | ({groups: "string"} if groups else {})
    row, links, best_, sum_ = fresh(docs, "_row", "_links", "_best", "_sum")
    keep = [c for c in docs.columns if c.lower() not in NEW or c == text_col]

    def make(column: pa.Array) -> list[pa.Array]:
        if run not in _memory:
            _memory.clear()
            _memory[run] = Memory(tokenizer_pair(a, b), found.value if small else None)
        memory = _memory[run]
        lists = [memory.pair.units(t) for t in column.to_pylist()]
        memory.learn(lists)
        sums, told, own = memory.add_up(lists)
        out = [pa.array(sums[i]) for i in (0, 1, 2, 2, 3, 4)] + [pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in told], pa.string())]
        out += [pa.array(told, pa.string())] if groups else []
        if not small:
            each = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.int64),) * 2 for x in own]
            out.append(pa.array([[{"key": k, "k": n} for k, n in zip(x.tolist(), y.tolist(), strict=True)] for x, y in each], pa.list_(pa.struct([("key", pa.int64()), ("k", pa.int64())]))))
        return out

    d = docs.select(*keep)
    if small:
        return with_columns(d, new, [text_col], make, rows=2048, size=4 << 20)
    d = written(with_columns(d, new | {links: "array<struct<key:bigint,k:bigint>>"}, [text_col], make, rows=2048, size=4 << 20).withColumn(row, F.monotonically_increasing_id()))
    n = pair_counts(table).select((F.shiftleft("a", 32) + F.col("b")).alias("key"), "n", F.col("best").cast("long").alias("best"))
    sums = d.select(row, F.explode(links).alias("x")).select(row, "x.*").join(n, "key").groupBy(row).agg(F.sum(F.col("k") * F.col("best")).alias(best_), F.sum(F.col("k") * F.col("n")).alias(sum_))
    d = d.drop("n_best", "count_sum").join(sums, row, "left")
    return d.select(*keep, *[{"n_best": F.coalesce(best_, F.lit(0)).alias("n_best"), "count_sum": F.coalesce(sum_, F.lit(0)).alias("count_sum")}.get(c, F.col(c)) for c in new])

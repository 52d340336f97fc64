"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, int_lists, with_columns
from ._words import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Marks a U+2581 of the text itself, which is written as bytes so that it is not read back as a space.
LITERAL = "\0" + SPACE
_UNIT = re.compile(r" *[^ \n]+| +|\n")
_MASK64 = 2**64 - 1
#: Odd multipliers: the first spreads a candidate merge over 64 bits, the second gives the bits that are drawn.
_STEP, _DRAW = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D
#: Agendas of longer units are heaps. Units of up to so many characters are remembered, and merged together in arrays; a slice
#: has so many units, and an array so many rows.
LONG_UNIT, KEPT_UNIT, SLICE, ROWS = 48, 32, 40_000, 2048
#: Bits of the filter that tells a word's first sight from its second.
SIGHTS = 1 << 23
#: Nodes (16 bytes each) that are remembered at most; with them go 1.2 piece ids (4 bytes) and 0.1 words (about 150 bytes) a node.
MOST_NODES = 10_000_000


class Paths:
    """Merge decisions met before, as a trie for each word. A node is a candidate merge; its two kids are where the agenda
    goes on when it is done and when it is skipped: a node (positive), an end with piece ids (negative), or unknown (0).
    Any occurrence of a word follows its own draws down the trie; the agenda runs only where nobody has been."""

    def __init__(self) -> None:
        self.most = MOST_NODES
        self.clear()

    def clear(self) -> None:
        self.root: dict[str, int] = {}
        self.step, self.kids = array("Q", [0]), array("i", [0, 0])
        self.first, self.ids = array("q", [0]), array("i")
        self.seen, self.n_seen = bytearray(SIGHTS >> 3), 0

    def first_sight(self, unit: str) -> bool:
        """Whether a unit is met for the first time, but for chance; only units met again are worth remembering."""
        k = hash(unit) % SIGHTS
        if self.seen[k >> 3] >> (k & 7) & 1:
            return False
        if self.n_seen > SIGHTS >> 3:
            self.seen, self.n_seen = bytearray(SIGHTS >> 3), 0
        self.seen[k >> 3] |= 1 << (k & 7)
        self.n_seen += 1
        return True

    def full(self) -> bool:
        return len(self.step) > self.most or 5 * len(self.ids) > 6 * self.most or 10 * len(self.root) > self.most

    def add(self, unit: str, trail: list[tuple[int, bool]], ids: list[int], keep: bool) -> int:
        """The value of a new end with these ids, which the trail of decisions leads to."""
        self.ids.extend(ids)
        self.first.append(len(self.ids))
        end = 1 - len(self.first)
        if keep:
            slot, at = -1, self.root.get(unit, 0)
            for step, skipped in trail:
                if at <= 0:
                    at = len(self.step)
                    self.step.append(step * _STEP & _MASK64)
                    self.kids.extend((0, 0))
                    self._hang(unit, slot, at)
                slot = 2 * at + skipped
                at = self.kids[slot]
            self._hang(unit, slot, end)
        return end

    def _hang(self, unit: str, slot: int, value: int) -> None:
        if slot < 0:
            self.root[unit] = value
        else:
            self.kids[slot] = value

    def follow(self, units: list[str], keys: np.ndarray, threshold: int) -> np.ndarray:
        """The end that each unit's draws lead to, or 0."""
        get = self.root.get
        at = np.array([get(u, 0) for u in units], np.int32)
        steps, kids = np.frombuffer(self.step, np.uint64), np.frombuffer(self.kids, np.int32)
        live = np.nonzero(at > 0)[0]
        node, key = at[live], keys[live]
        while len(live):
            skipped = (((key ^ steps[node]) * np.uint64(_DRAW)) >> np.uint64(32)) < np.uint64(threshold)
            node = kids[2 * node + skipped]
            more = node > 0
            at[live[~more]] = node[~more]
            live, node, key = live[more], node[more], key[more]
        return at


class PairTable:
    """The rank and the piece that two ids make, looked up for whole arrays in an open hash table."""

    BITS, NONE = 20, 1 << 30

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.keys = np.full((1 << self.BITS) + 1, -1, np.int64)
        self.ranks, self.made = np.full(len(self.keys), self.NONE, np.int32), np.zeros(len(self.keys), np.int32)
        for (a, b), (rank, piece) in pairs.items():
            k = a << 21 | b
            i = (k * _STEP & _MASK64) >> 64 - self.BITS
            while self.keys[i] >= 0:
                i = (i + 1) % (1 << self.BITS)
            self.keys[i], self.ranks[i], self.made[i] = k, rank, piece

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in the table; the last place, of rank NONE, for those that make nothing."""
        k = a.astype(np.int64) << 21 | b
        i = ((k.astype(np.uint64) * np.uint64(_STEP)) >> np.uint64(64 - self.BITS)).astype(np.int64)
        found = self.keys[i]
        todo = np.nonzero((found != k) & (found >= 0))
        while len(todo[0]):
            i[todo] = (i[todo] + 1) % (1 << self.BITS)
            found = self.keys[i[todo]]
            todo = tuple(t[(found != k[todo]) & (found >= 0)] for t in todo)
        return np.where(self.keys[i] == k, i, 1 << self.BITS)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.ranks[self.find(a, b)]


class Vocabulary:
    """The pieces of a model file: merging order, ids, bytes for what has no piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.byte = [0] * 256
        self.ids: dict[str, int] = {}
        self.out: list[bytes] = [b""] * n
        score: dict[str, float] = {}
        for i in range(n):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.out[i] = bytes([int(p[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[p], score[p] = i, model.get_score(i)
                self.out[i] = p.replace(SPACE, " ").encode()
        # merging order: the better score first, equal scores as one rank
        place = {x: i for i, x in enumerate(sorted({*score.values()}, reverse=True))}
        self.rank = {p: place[x] for p, x in score.items()}
        # units end before a space and around a newline; that is exact as long as no piece crosses such a place
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece of this model crosses a unit's edge")
        self.paths, self.n = Paths(), n
        # the same for arrays; a character without a piece stands for itself, above all ids
        self.chars = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self.chars[32], self.chars[ord(SPACE)] = self.chars[ord(SPACE)], n + ord(SPACE)
        self.pairs = PairTable({(self.ids[p[:i]], self.ids[p[i:]]): (r, self.ids[p]) for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids})

    def merge(self, unit: str, key: int, threshold: int, trail: list[tuple[int, bool]] | None = None) -> list[int]:
        """The pieces of one unit. Candidate merges stand in an agenda by rank, then place; each is skipped where 32 bits
        drawn from the key, the place of its first character and its rank fall under threshold, and comes back only when
        a neighbour's merge makes it anew. trail gets each candidate taken up and whether it was skipped."""
        part: list[str | None] = [LITERAL if c == SPACE else c for c in unit] if SPACE in unit else list(unit)
        if part[0] == " ":
            part = [SPACE if c == " " else c for c in part]
        (self._merge_heap if len(part) > LONG_UNIT else self._merge_list)(part, key, threshold, [] if trail is None else trail)
        out: list[int] = []
        ids = self.ids
        for p in part:
            if p in ids:
                out.append(ids[p])
            elif p is not None:
                out += [self.byte[x] for x in (p[1:] if p == LITERAL else p).encode()]
        return out

    def _merge_list(self, part: list[str], key: int, threshold: int, trail: list[tuple[int, bool]]) -> None:
        """The agenda as a list with the rank of each pair of neighbours; the best is looked up."""
        get, last = self.rank.get, 1 << 40
        agenda = [get(a + b, last) for a, b in zip(part, part[1:], strict=False)]
        start = list(range(len(part)))
        while agenda and (best := min(agenda)) != last:
            k = agenda.index(best)
            step = start[k] << 17 | best
            skipped = ((key ^ step * _STEP & _MASK64) * _DRAW & _MASK64) >> 32 < threshold
            trail.append((step, skipped))
            if skipped:
                agenda[k] = last
                continue
            p = part[k] = part[k] + part.pop(k + 1)
            del agenda[k], start[k + 1]
            if k:
                agenda[k - 1] = get(part[k - 1] + p, last)
            if k < len(agenda):
                agenda[k] = get(p + part[k + 1], last)

    def _merge_heap(self, part: list[str | None], key: int, threshold: int, trail: list[tuple[int, bool]]) -> None:
        """The agenda as a heap, for units of any length; merged-away parts become None, so places are those of the start."""
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, str]] = []
        rank = self.rank

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (p := part[a] + part[b]) in rank:
                heapq.heappush(agenda, (rank[p], a, b, p))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            best, a, b, p = heapq.heappop(agenda)
            if part[a] is None or part[b] is None or right[a] != b or part[a] + part[b] != p:
                continue
            step = a << 17 | best
            skipped = ((key ^ step * _STEP & _MASK64) * _DRAW & _MASK64) >> 32 < threshold
            trail.append((step, skipped))
            if skipped:
                continue
            part[a], part[b] = p, None
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])

    def _merge_rows(self, units: list[str], keys: np.ndarray, threshold: int) -> tuple[list[list[int]], list[list[tuple[int, bool]]]]:
        """merge() for many units: (ids, trail) of each. A unit is a row with a column for each character, and each round
        takes the best candidate of every row. A merged piece stands in the column of its first character."""
        gone, pad, none = -1, (1 << 21) - 1, PairTable.NONE
        size = np.array(list(map(len, units)))
        rows, wide = len(units), int(size.max())
        ids = np.full((rows, wide + 1), pad, np.int32)
        ids[np.arange(wide + 1) < size[:, None]] = self.chars[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        after, before = np.tile(np.arange(1, wide + 2, dtype=np.int8), (rows, 1)), np.tile(np.arange(-1, wide, dtype=np.int8), (rows, 1))
        rank = np.full((rows, wide), none, np.int32)
        rank[:, :-1] = self.pairs.get(ids[:, : wide - 1], ids[:, 1:wide])
        live, told = np.arange(rows), []
        while len(live):
            have = rank[live]
            k = have.argmin(axis=1)
            best = have[np.arange(len(live)), k]
            more = best < none
            live, k, best = live[more], k[more], best[more]
            step = (k << 17 | best).astype(np.uint64)
            skipped = (((keys[live] ^ step * np.uint64(_STEP)) * np.uint64(_DRAW)) >> np.uint64(32)) < np.uint64(threshold)
            told.append((live, step, skipped))
            rank[live[skipped], k[skipped]] = none
            r, k = live[~skipped], k[~skipped]
            eaten = after[r, k]
            piece = self.pairs.made[self.pairs.find(ids[r, k], ids[r, eaten])]
            behind = after[r, eaten]
            ids[r, k], ids[r, eaten], rank[r, eaten] = piece, gone, none
            after[r, k], before[r, behind] = behind, k
            rank[r, k] = self.pairs.get(piece, ids[r, behind])
            front = before[r, k]
            has = front >= 0
            rank[r[has], front[has]] = self.pairs.get(ids[r[has], front[has]], piece[has])
        stay = (ids != gone) & (ids != pad)
        upto, flat = np.cumsum(stay.sum(axis=1)).tolist(), ids[stay].tolist()
        row = np.concatenate([t[0] for t in told])
        by = np.argsort(row, kind="stable")
        steps = list(zip(np.concatenate([t[1] for t in told])[by].tolist(), np.concatenate([t[2] for t in told])[by].tolist(), strict=True))
        ends = np.cumsum(np.bincount(row, minlength=rows)).tolist()
        out = [flat[a:b] for a, b in zip([0, *upto], upto, strict=False)]
        for i in np.nonzero(((ids >= self.n) & (ids != pad)).any(axis=1))[0].tolist():
            out[i] = [y for x in out[i] for y in ([x] if x < self.n else [self.byte[z] for z in chr(x - self.n).encode("utf-8", "surrogatepass")])]
        return out, [steps[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_units(self, units: list[str], keys: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in a row, how many each has)."""
        paths = self.paths
        if paths.full():
            paths.clear()
        at = paths.follow(units, keys, threshold)
        new: tuple[list[int], list[int]] = ([], [])  # units not to be remembered, and those to be
        for i in np.nonzero(at == 0)[0].tolist():
            u = units[i]
            new[len(u) <= KEPT_UNIT and (u in paths.root or not paths.first_sight(u))].append(i)
        for keep in (True, False):
            if not keep:
                kept = len(paths.first), len(paths.ids)
            short = sorted((i for i in new[keep] if len(units[i]) <= KEPT_UNIT), key=lambda i: len(units[i]))
            for a in range(0, len(short), ROWS):
                some = short[a : a + ROWS]
                for i, ids, trail in zip(some, *self._merge_rows([units[i] for i in some], keys[some], threshold), strict=True):
                    at[i] = paths.add(units[i], trail, ids, keep)
            for i in new[keep]:
                if len(units[i]) > KEPT_UNIT:
                    at[i] = paths.add(units[i], [], self.merge(units[i], int(keys[i]), threshold), keep)
        end = -1 - at
        first, pool = np.frombuffer(paths.first, np.int64), np.frombuffer(paths.ids, np.int32)
        start, n = first[end], first[end + 1] - first[end]
        out = pool[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        del first, pool  # arrays that are looked at cannot shrink
        del paths.first[kept[0] :], paths.ids[kept[1] :]
        return out, n

    def encode_all(self, texts: list[str | None], keys: list[int], rate: float, seed: int) -> Iterator[np.ndarray | None]:
        """Ids of each text (null for null). A unit's draws are keyed by its text's key and its place in it."""
        threshold = int(rate * 2**32)
        salt = mix(np.array([seed & _MASK64], np.uint64))
        units: list[str] = []
        key: list[np.ndarray] = []
        sizes: list[int | None] = []

        def flush() -> Iterator[np.ndarray | None]:
            keyed = np.concatenate(key) if key else np.zeros(0, np.uint64)
            got = [self.encode_units(units[a : a + SLICE], keyed[a : a + SLICE], threshold) for a in range(0, len(units), SLICE)]
            ids = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int32)
            upto = np.concatenate([[0], np.cumsum(np.concatenate([g[1] for g in got]))]) if got else np.zeros(1, np.int64)
            at = 0
            for n in sizes:
                yield None if n is None else ids[upto[at] : upto[at + n]]
                at += n or 0
            for held in (units, key, sizes):
                held.clear()

        for text, k in zip(texts, keys, strict=True):
            cut = _UNIT.findall(" " + text) if text else []
            units += cut
            sizes.append(None if text is None else len(cut))
            key.append(mix(mix(np.arange(len(cut), dtype=np.uint64) + mix(np.array([k & _MASK64], np.uint64))) ^ salt))
            if len(units) >= SLICE:
                yield from flush()
        yield from flush()

    def encode(self, text: str, key: int, rate: float, seed: int) -> np.ndarray:
        return next(self.encode_all([text], [key], rate, seed))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, rate: float = 0.1, seed: int = 41, id_col: str = "doc_id", text_col: str = "text", out: str = "ids", check: str | None = None, model: str = MODEL, nodes: int = MOST_NODES) -> DataFrame:
    """docs with the piece ids of each text in column out (array<int>), and, if check names a column, whether decoding them
    gives the text back (boolean, in the same pass).

    Every candidate merge of the agenda is skipped with probability rate, by a hash of the seed, the document's id, the
    word's place, the place in the word and the merge. So each occurrence of a word has draws of its own, and reruns
    agree. rate 0 is the model's own segmentation. decode() gives the text back whatever was skipped: characters without
    a piece, and U+2581, are written as bytes.

    Null text: null ids, and check is true. Empty text: no ids. Null id: drawn as one id of its own. Very long texts and words: encoded
    whole, in slices of words; a word's agenda takes memory as its length. Ties of equal rank go to the first place.
    Repeated rows get equal ids. Empty table: empty result. Other columns pass unchanged; ones named as out or check
    are replaced, and these stand last. A worker remembers merge decisions in up to so many nodes (beside the vocabulary about
    40 bytes each), which costs time where they are few, and changes no result.
    """
    key = fresh(docs, "_key")[0]

    def run(keys: pa.Array, texts: pa.Array) -> list[pa.Array]:
        v = vocabulary(model)
        v.paths.most = nodes
        rows = texts.to_pylist()
        ids = list(v.encode_all(rows, keys.to_pylist(), rate, seed))
        found = [int_lists(ids)]
        if check:
            found.append(pa.array([t is None or v.decode(x.tolist()) == t for t, x in zip(rows, ids, strict=True)], pa.bool_()))
        return found

    keyed = docs.withColumn(key, F.coalesce(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(0)))
    return with_columns(keyed, {out: "array<int>"} | ({check: "boolean"} if check else {}), [key, text_col], run).drop(key)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the text of each array of ids in column out. Null ids: null; no ids: ''. A column named as out is replaced."""

    def run(ids: pa.Array) -> list[pa.Array]:
        v = vocabulary(model)
        return [pa.array([None if x is None else v.decode(x) for x in ids.to_pylist()], pa.string())]

    return with_columns(df, {out: "string"}, [ids_col], run)

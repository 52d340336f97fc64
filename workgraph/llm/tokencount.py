"""Token counts that follow edits: pre-token segment trees, re-encoded only where an edit touches them."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._shared import int_lists, with_columns

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that goes with the rank file (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
FAN = 32
#: A pre-token's end depends on up to so many characters after it: what \s+(?!\S) looks at.
LOOK = 2
MOST_CACHED = 200_000


class Counter:
    """Tokens of a pre-token, by the rank file's merges."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.bpe.encode_ordinary(piece))
            if len(piece) <= 48:
                if len(self.known) > MOST_CACHED:
                    self.known.clear()
                self.known[piece] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class Tree:
    """A sequence of pre-tokens under levels of nodes that hold the sums of characters and tokens below them.

    levels[0] has (None, characters, tokens) of the leaves; each level above has, for its nodes, (kids, characters,
    tokens), where kids counts the entries of the level below. A node has 2 * FAN kids at most, the top level as many
    nodes. All are arrays, so that a tree is read from and written to columns as it is.
    """

    __slots__ = ("levels",)

    def __init__(self, levels: list[tuple]) -> None:
        self.levels = levels
        while len(levels[-1][1]) > 2 * FAN:
            _, chars, tokens = levels[-1]
            at = np.arange(0, len(chars), FAN)
            levels.append((np.diff(at, append=len(chars)).astype(np.int32), np.add.reduceat(chars, at, dtype=np.int32), np.add.reduceat(tokens, at, dtype=np.int32)))

    @classmethod
    def build(cls, chars, tokens) -> Tree:
        return cls([(None, np.asarray(chars, np.int32), np.asarray(tokens, np.int32))])

    @property
    def chars(self) -> int:
        return int(self.levels[-1][1].sum())

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][2].sum())

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character at; past the end: (leaves, characters)."""
        lo, hi, start = 0, len(self.levels[-1][1]), 0
        for k in range(len(self.levels) - 1, -1, -1):
            kids, chars, _ = self.levels[k]
            upto = np.cumsum(chars[lo:hi])
            i = int(np.searchsorted(upto, at - start, "right"))
            if lo + i == hi:
                return len(self.levels[0][1]), self.chars
            start += int(upto[i] - chars[lo + i])
            if k == 0:
                return lo + i, start
            lo, hi = int(kids[: lo + i].sum()), int(kids[: lo + i + 1].sum())
        return 0, 0

    def splice(self, parts: list[tuple[int, int, list[int], list[int]]]) -> Tree:
        """The tree in which leaves lo to hi are new ones (characters, tokens), for parts in order that do not overlap.
        Only sums over changed kids are taken again; a node that has grown too wide is split, an empty one goes."""
        _, chars, tokens = self.levels[0]
        out = [(None, _replaced(chars, [(lo, hi, c) for lo, hi, c, _ in parts]), _replaced(tokens, [(lo, hi, t) for lo, hi, _, t in parts]))]
        spans = [(lo, hi, len(c)) for lo, hi, c, _ in parts]
        for kids, chars, tokens in self.levels[1:]:
            upto, count, changed = np.cumsum(kids), kids.copy(), np.zeros(len(kids), bool)
            for lo, hi, n in spans:
                p = min(int(np.searchsorted(upto, lo, "right")), len(kids) - 1)
                q = int(np.searchsorted(upto, hi - 1, "right")) if hi > lo else p
                count[p : q + 1] -= np.maximum(np.minimum(upto[p : q + 1], hi) - np.maximum(upto[p : q + 1] - kids[p : q + 1], lo), 0)
                count[p] += n
                changed[p : q + 1] = True
            below, end = out[-1], np.cumsum(count)
            edge = np.diff(changed.astype(np.int8), prepend=0, append=0)
            spans, new = [], ([], [], [])
            for p, q in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True):
                sizes = [n for i in range(p, q) for n in _widths(int(count[i]))]
                at, each = int(end[p] - count[p]), ([], [], [])
                for n in sizes:
                    for held, x in zip(each, (n, int(below[1][at : at + n].sum()), int(below[2][at : at + n].sum())), strict=True):
                        held.append(x)
                    at += n
                for held, x in zip(new, each, strict=True):
                    held.append((p, q, x))
                spans.append((p, q, len(sizes)))
            out.append(tuple(_replaced(old, held) for old, held in zip((kids, chars, tokens), new, strict=True)))
        while len(out) > 1 and not len(out[-1][1]):
            out.pop()
        return Tree(out)

    def leaves(self) -> list[tuple[int, int]]:
        return list(zip(self.levels[0][1].tolist(), self.levels[0][2].tolist(), strict=True))


def _widths(n: int) -> list[int]:
    """How many kids the nodes get that take the place of one with n."""
    if n <= 2 * FAN:
        return [n] if n else []
    parts = -(-n // FAN)
    return [n // parts + (i < n % parts) for i in range(parts)]


def _replaced(old: np.ndarray, parts: list[tuple[int, int, list[int]]]) -> np.ndarray:
    """old with the entries lo to hi of each part replaced."""
    out, at = [], 0
    for lo, hi, new in parts:
        out += [old[at:lo], np.array(new, np.int32)]
        at = hi
    return np.concatenate([*out, old[at:]]) if out else old


def pretokens(text: str) -> list[str]:
    return _SPLIT.findall(text)


def edit(text: str, tree: Tree, edits: list[tuple[int, int, str]], count: Counter) -> tuple[str, Tree, int]:
    """(text, tree, pre-tokens encoded) after text[start:end] became new, for edits in order that do not overlap.

    Old pre-tokens that end LOOK characters before an edit stand. From there the new text is split again until an edge
    falls on an old edge behind the edit, and before what the next edit touches: the text from there on is the old one,
    and the pattern never looks back.
    """
    pieces_, at = [], 0
    for start, end, new in edits:
        pieces_ += [text[at:start], new]
        at = end
    after = "".join([*pieces_, text[at:]])
    old, n_leaves = tree.levels[0][1], len(tree.levels[0][1])
    first = [tree.find(max(0, start - LOOK)) for start, _, _ in edits]
    parts, shift, i, encoded = [], 0, 0, 0
    while i < len(edits):
        lo, begin = first[i]
        if parts and lo < parts[-1][1]:
            lo, begin = parts[-1][1], parts[-1][4]
        at, leaf, edge = begin + shift, lo, begin  # the next old leaf, and the old edge before it
        chars, tokens = [], []
        need = edits[i][1]
        shift += len(edits[i][2]) - (edits[i][1] - edits[i][0])
        i += 1
        hi = n_leaves
        while at < len(after):
            m = _SPLIT.match(after, at)
            at = m.end()
            chars.append(at - m.start())
            tokens.append(count.count(m[0]))
            while i < len(edits) and at - shift > edits[i][0]:
                need = edits[i][1]
                shift += len(edits[i][2]) - (edits[i][1] - edits[i][0])
                i += 1
            if at - shift >= need:
                while edge < at - shift and leaf < n_leaves:
                    edge += int(old[leaf])
                    leaf += 1
                if edge == at - shift and edge >= need and (i == len(edits) or first[i][1] >= edge):
                    hi = leaf
                    break
        if hi == n_leaves:
            edge = len(text)
        encoded += len(chars)
        parts.append((lo, hi, chars, tokens, edge))
    return after, tree.splice([p[:4] for p in parts]) if parts else tree, encoded


TREE = "chars:array<int>,tokens:array<int>,kids:array<int>,node_chars:array<int>,node_tokens:array<int>,levels:array<int>"
_PARTS = ("chars", "tokens", "kids", "node_chars", "node_tokens", "levels")


def _columns(trees: list[Tree]) -> dict[str, pa.Array]:
    """Trees as list arrays: the leaves, and the nodes of all levels above them from the lowest up."""
    upper = lambda t, k: np.concatenate([x[k] for x in t.levels[1:]]) if len(t.levels) > 1 else np.zeros(0, np.int32)
    rows = [(t.levels[0][1], t.levels[0][2], upper(t, 0), upper(t, 1), upper(t, 2), np.array([len(x[1]) for x in t.levels[1:]], np.int32)) for t in trees]
    return {name: int_lists([r[k] for r in rows]) for k, name in enumerate(_PARTS)}


def _trees(column: pa.Array) -> list[Tree]:
    """The trees of a struct column; a null one is empty."""
    good = column.is_valid().to_pylist()
    lists = []
    for name in _PARTS:
        a = column.field(name)
        ends, values = a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
        lists.append([values[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
    out = []
    for i, ok in enumerate(good):
        if not ok:
            out.append(Tree.build([], []))
            continue
        levels, at = [(None, lists[0][i], lists[1][i])], 0
        for n in lists[5][i].tolist():
            levels.append(tuple(lists[k][i][at : at + n] for k in (2, 3, 4)))
            at += n
        out.append(Tree(levels))
    return out


def count_tokens(docs: DataFrame, text_col: str = "text", out: str = "tokens", ranks: str = RANKS) -> DataFrame:
    """docs with a struct column out: n_pretokens, n_tokens, and the text's tree (TREE).

    Null or empty text: zeros and an empty tree. Very long text: whole, its tree grows by levels. Repeated rows get equal
    counts. Empty table: empty result. Other columns pass unchanged; one named as out is replaced and stands last.
    """

    def run(column: pa.Array) -> list[pa.Array]:
        c = counter(ranks)
        known, trees = c.known, []
        for t in column.to_pylist():
            p = pretokens(t) if t else []
            trees.append(Tree.build(np.fromiter(map(len, p), np.int32, len(p)), np.fromiter([known[x] if x in known else c.count(x) for x in p], np.int32, len(p))))
        n = [len(t.levels[0][1]) for t in trees]
        made = {"n_pretokens": pa.array(n, pa.int64()), "n_tokens": pa.array([t.tokens for t in trees], pa.int64())} | _columns(trees)
        return [pa.StructArray.from_arrays(list(made.values()), list(made))]

    return with_columns(docs, {out: f"struct<n_pretokens:long,n_tokens:long,{TREE}>"}, [text_col], run)


def recount(counted: DataFrame, edits: str, text_col: str = "text", tokens_col: str = "tokens", out: str = "recounted", ranks: str = RANKS) -> DataFrame:
    """counted (from count_tokens) with a struct column out: the edited text, n_edits, n_encoded, n_pretokens, n_tokens and
    the text's tree, so that recount() can follow again with text_col and tokens_col inside it.

    edits is an array column of (start, end, new), in code points of the text as it was, ends exclusive. They are applied
    by start, then end; one that overlaps an earlier one, or lies outside the text, is left out. Only pre-tokens around
    edits are encoded again (n_encoded says how many), and only the nodes above them are summed again. Null text,
    tree or edits: as if empty. Very long texts: the text is put together once for all edits. Empty table: empty result.
    Other columns pass unchanged; one named as out is replaced and stands last.
    """

    def run(texts: pa.Array, leaves: pa.Array, changes: pa.Array) -> list[pa.Array]:
        c, trees, after, told = counter(ranks), [], [], []
        for t, tree, todo in zip(texts.to_pylist(), _trees(leaves), changes.to_pylist(), strict=True):
            t, good, free, n = t or "", [], 0, 0
            for e in sorted(todo or [], key=lambda e: (e["start"], e["end"])):
                if free <= e["start"] <= e["end"] <= len(t):
                    good.append((e["start"], e["end"], e["new"] or ""))
                    free = e["end"]
            if good:
                t, tree, n = edit(t, tree, good, c)
            trees.append(tree)
            after.append(t)
            told.append((len(good), n, len(tree.levels[0][1]), tree.tokens))
        made = {"text": pa.array(after, pa.string())} | {k: pa.array([x[i] for x in told], pa.int64()) for i, k in enumerate(("n_edits", "n_encoded", "n_pretokens", "n_tokens"))} | _columns(trees)
        return [pa.StructArray.from_arrays(list(made.values()), list(made))]

    return with_columns(counted, {out: f"struct<text:string,n_edits:long,n_encoded:long,n_pretokens:long,n_tokens:long,{TREE}>"}, [text_col, tokens_col, edits], run)


_MASKED = re.compile(r"[0-9]{4,}|[A-Z]{4,}")


def masking_edits(docs: DataFrame, text_col: str = "text", out: str = "edits") -> DataFrame:
    """docs with the edits that a cleaning step would make: long digit runs become 0, shouted words lower case."""

    def run(column: pa.Array) -> list[pa.Array]:
        found = [[{"start": m.start(), "end": m.end(), "new": "0" if m[0][0] <= "9" else m[0].lower()} for m in _MASKED.finditer(t or "")] for t in column.to_pylist()]
        return [pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())])))]

    return with_columns(docs, {out: "array<struct<start:int,end:int,new:string>>"}, [text_col], run)

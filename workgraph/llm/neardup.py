"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import Forest, components, edge_batch
from ._shared import with_columns, written
from ._words import mix, shingle_set, texts

VALUES = 128  # MinHash values of a signature, 16 bits each
TREES = 16  # sorted orders of the signature
DEPTH = 12  # values of an order that are sorted by
SHALLOW = 4  # values that two neighbours must share at least
SKETCH = 48  # values that neighbours are compared on
_rng = np.random.Generator(np.random.Philox(key=[5, 85]))
_A = _rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, VALUES, dtype=np.uint32)
ORDERS = [_rng.permutation(VALUES)[:DEPTH].tolist() for _ in range(TREES)]


def signature(s: np.ndarray) -> bytes:
    """VALUES MinHash values of a shingle set, each cut to 16 mixed bits, big-endian so that bytes sort as numbers."""
    low = np.full(VALUES, 2**32 - 1, np.uint32)
    half = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(half), 512):
        np.minimum(low, (half[i : i + 512, None] * _A + _B).min(axis=0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()


def _sign(wide: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, sig = [], [], [], []
            for t in texts(batch.column(1)):
                s = shingle_set(t, wide)
                n.append(len(s))
                s1.append(int(np.add.reduce(s).astype(np.int64)) if len(s) else 0)
                s2.append(int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).astype(np.int64)) if len(s) else 0)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary())], ["id", "n", "s1", "s2", "sig"])

    return run


def _binary(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(len(column), width // 2)


#: What a task of _neighbours() tells: edges, or (where a is null) the rows at its ends.
TOLD = "a long, b long, tree int, key binary, id long, sketch binary"


def _neighbours(window: int, least: float, shallow: int):
    """Sorted rows (tree, key, id, sketch) -> edges between rows at most window apart that share shallow values of the
    order and so much of the sketch, and the first and last window rows, whose neighbours other tasks may have. How deep
    the shared prefix is follows the region: in a dense one the nearest rows share many values, in a thin one few."""

    def told(edges: list[tuple[int, int]], rows: pa.RecordBatch | None) -> pa.RecordBatch:
        n, m = len(edges), 0 if rows is None else len(rows)
        ends = [pa.array([e[k] for e in edges] + [None] * m, pa.int64()) for k in (0, 1)]
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([*ends, *[pa.concat_arrays([pa.nulls(n, t), *([] if rows is None else [rows.column(k).cast(t)])]) for k, t in enumerate(kinds)]], ["a", "b", "tree", "key", "id", "sketch"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        first, last = 0, None
        for batch in batches:
            if not len(batch):
                continue
            if first < window:
                yield told([], batch.slice(0, window - first))
                first += min(len(batch), window - first)
            last = batch.slice(max(0, len(batch) - window)) if last is None or len(batch) >= window else pa.Table.from_batches([last, batch]).slice(max(0, len(last) + len(batch) - window)).combine_chunks().to_batches()[0]
            rows = [batch.column(0).to_numpy(zero_copy_only=False), _binary(batch.column(1), 2 * DEPTH)[:, :shallow], batch.column(2).to_numpy(zero_copy_only=False), _binary(batch.column(3), 2 * SKETCH)]
            if held is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
            tree, key, ids, sketch = rows
            f = Forest()
            for lag in range(1, min(window, len(ids) - 1) + 1):
                near = np.nonzero((tree[lag:] == tree[:-lag]) & (key[lag:] == key[:-lag]).all(axis=1))[0]
                if not len(near):
                    break
                near = near[(sketch[near + lag] == sketch[near]).mean(axis=1) >= least]
                for a, b in zip(ids[near + lag].tolist(), ids[near].tolist(), strict=True):
                    f.join(a, b)
            yield told(f.edges(), None)
            held = [x[-window:] for x in rows]
        if last is not None:
            yield told([], last)

    return run


def _intersections(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of sets with each of others; for a list with itself, of different ones only.
    Shingles that one side lacks, or that a single text has, are in no intersection and take no column."""
    itself = sets is others
    both = sets if itself else sets + others
    doc = np.repeat(np.arange(len(both), dtype=np.int64), [len(s) for s in both])
    code = np.unique(np.concatenate(both) if both else np.zeros(0, np.uint64), return_inverse=True)[1].ravel()
    n = int(code.max()) + 1 if len(code) else 0
    if itself:
        shared = np.bincount(code, minlength=n) > 1
    else:
        shared = (np.bincount(code[doc < len(sets)], minlength=n) > 0) & (np.bincount(code[doc >= len(sets)], minlength=n) > 0)
    code, doc = (np.cumsum(shared) - 1)[code[shared[code]]], doc[shared[code]]
    out = np.zeros((len(sets), len(others)))
    by = np.argsort(code, kind="stable")
    code, doc = code[by], doc[by]
    step = max(256, 4_000_000 // max(1, len(both)))  # columns of the incidence matrix at a time
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        i, j = np.searchsorted(code, [at, at + step])
        m = np.zeros((len(both), min(step, int(code[-1]) + 1 - at)), np.float32)
        m[doc[i:j], code[i:j] - at] = 1
        out += m @ m.T if itself else m[: len(sets)] @ m[len(sets) :].T
    return out


def _linked(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Where 100 * intersection >= percent * union."""
    both = _intersections(sets, others)
    union = np.array([len(s) for s in sets])[:, None] + np.array([len(s) for s in others])[None, :] - both
    return (100 * both >= percent * union) & (both > 0)


def _sets(wide: int):
    """Texts -> their shingle sets as bytes, so that a text is cut and hashed once however many blocks it stands in."""
    return lambda column: [pa.array([shingle_set(t, wide).tobytes() for t in texts(column)], pa.binary())]


def _blocks(percent: int, most_docs: int, most_shingles: int):
    """Rows (region, id, set) sorted by region -> edges (id, root) among the rows of a region that stand together, at
    most so many at a time; all pairs of a block are compared on full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sets: list[np.ndarray] = []
        region, size = None, 0

        def done() -> list[tuple[int, int]]:
            if len(ids) < 2:
                return []
            f = Forest()
            for a, b in zip(*np.nonzero(np.triu(_linked(sets, sets, percent), 1)), strict=True):
                f.join(ids[a], ids[b])
            return f.edges()

        for batch in batches:
            edges: list[tuple[int, int]] = []
            for r, i, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r != region or len(ids) >= most_docs or size >= most_shingles:
                    edges += done()
                    ids, sets, region, size = [], [], r, 0
                s = np.frombuffer(t, np.uint64)
                ids.append(i)
                sets.append(s)
                size += len(s)
            yield edge_batch(edges)
        yield edge_batch(done())

    return run


def _against(percent: int):
    """Rows (region, qb, mb, asks, id, set) of one block of queries and one of members -> edges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def done() -> list[tuple[int, int]]:
            asks, rest = [x for x in rows if x[0]], [x for x in rows if not x[0]]
            if not asks or not rest:
                return []
            f = Forest()
            for a, b in zip(*np.nonzero(_linked([x[2] for x in asks], [x[2] for x in rest], percent)), strict=True):
                if asks[a][1] != rest[b][1]:
                    f.join(asks[a][1], rest[b][1])
            return f.edges()

        for batch in batches:
            edges: list[tuple[int, int]] = []
            for r, q, m, asks, i, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (r, q, m) != at:
                    edges += done()
                    at, rows = (r, q, m), []
                rows.append((asks, i, np.frombuffer(t, np.uint64)))
            yield edge_batch(edges)
        yield edge_batch(done())

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, wide: int = 5, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 128, block_shingles: int = 400_000, window: int = 3, orders: int = 3, shallow: int = SHALLOW) -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of docs.

    Texts are linked when 100 * intersection >= percent * union of their sets of shingles of wide words.
    1. Rows of equal shingle sets are one class (by size and 128 bits of hash); its smallest id stands for it.
    2. Every class stands in TREES sorted orders of its MinHash signature. Neighbours by longest common prefix, with a
       loose check of a sketch, make edges if they share shallow values and as much of SKETCH values as two linked
       texts do but for four standard deviations; a lower percent needs a lower shallow. Rows at the ends of sorted
       partitions meet again in a small table. The components are regions, wider than any component of real links.
    3. In a region of up to block_docs all pairs are compared on full sets in one task. A larger region is cut into
       blocks along some of the sorted orders; what they link is merged. Then the documents outside the region's
       largest component are the queries, compared on full sets with all its documents, in blocks: whatever the
       blocks missed is found, and no pair of the largest component is made.
    4. Links' components give component_id, the smallest id that can be reached.

    Null or blank texts: n_shingles 0, linked with nothing. Null id: component_id null. Ids must be whole numbers; other
    types are an error. Rows of one id are one document: what links to either text links to both. Very long texts: whole,
    hashed in slices. Ties: the smallest id names a component. Other columns are left out, whatever their names. Empty
    table: empty result.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col}: whole numbers are needed")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(base.mapInArrow(_sign(wide), "id long, n long, s1 long, s2 long, sig binary"))
    classes = written(signed.filter("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")))
    reps = classes.select(F.col("rep").alias("id"), "s1", "s2", "n").join(signed, ["id", "s1", "s2", "n"]).dropDuplicates(["id", "s1", "s2", "n"]).select("id", "n", "sig")
    reps = written(reps)
    key = lambda order: F.concat(*[F.substring("sig", 2 * v + 1, 2) for v in order])
    trees = reps.select("id", F.substring("sig", 1, 2 * SKETCH).alias("sketch"), F.posexplode(F.array(*[key(o) for o in ORDERS])).alias("tree", "key")).select("tree", "key", "id", "sketch")
    spread = trees.repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    share = percent / 100
    near = _neighbours(window, share - 4 * (share * (1 - share) / SKETCH) ** 0.5, shallow)
    told = written(spread.mapInArrow(near, TOLD))
    seam = told.filter("a is null").select("tree", "key", "id", "sketch").coalesce(1).sortWithinPartitions("tree", "key", "id")  # a few rows a task
    pairs = told.filter("a is not null").select("a", "b").unionByName(seam.mapInArrow(near, TOLD).filter("a is not null").select("a", "b"))
    regions = components(pairs).withColumnRenamed("component", "region")
    regions = written(regions.join(reps, "id").select("id", "region", "n", *[key(o).alias(f"k{i}") for i, o in enumerate(ORDERS[:orders])]))
    sizes = written(regions.groupBy("region").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")))
    big = (F.col("docs") > block_docs) | (F.col("shingles") > block_shingles)
    placed = regions.join(sizes, "region").withColumn("big", big)
    held = base.join(placed, "id").select("region", "id", "n", "text", "big", "docs", "shingles", *[f"k{i}" for i in range(orders)])
    held = written(with_columns(held, {"set": "binary"}, ["text"], _sets(wide)).drop("text"))
    compare = _blocks(percent, block_docs, block_shingles)
    small = held.filter("not big").select("region", "id", "set").repartition(F.col("region")).sortWithinPartitions("region", "id")
    edges = [small.mapInArrow(_blocks(percent, 1 << 30, 1 << 60), "a long, b long")]
    large = held.filter("big")
    many = sizes.filter(big).count()
    if many:
        for i in range(orders):
            edges.append(large.repartitionByRange("region", f"k{i}", "id").sortWithinPartitions("region", f"k{i}", "id").select("region", "id", "set").mapInArrow(compare, "a long, b long"))
    links = edges[0]
    for e in edges[1:]:
        links = links.unionByName(e)
    links = written(links)
    found = written(components(links))
    if many:
        labelled = large.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        parts = labelled.groupBy("region", "component").agg(F.count("*").alias("docs_in"), F.sum("n").alias("shingles_in"))
        top = parts.groupBy("region").agg(F.max_by("component", F.struct("docs_in", -F.col("component"))).alias("top"), F.max_by("shingles_in", F.struct("docs_in", -F.col("component"))).alias("top_shingles"), F.max("docs_in").alias("top_docs"))
        top = written(top)
        rows = labelled.join(top, "region").withColumn("asks", F.col("component") != F.col("top"))
        blocks = lambda n, s: F.greatest(F.ceil(n / (4 * block_docs)), F.ceil(s / (2 * block_shingles)), F.lit(1)).cast("int")
        rows = rows.withColumn("nq", blocks(F.col("docs") - F.col("top_docs"), F.col("shingles") - F.col("top_shingles"))).withColumn("nm", blocks(F.col("docs"), F.col("shingles")))
        mine = lambda n: F.pmod(F.xxhash64(F.lit(3), "id"), n).cast("int")
        asks = rows.filter("asks").select("region", mine(F.col("nq")).alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("mb"), F.lit(True).alias("asks"), "id", "set")
        members = rows.filter("docs > top_docs").select("region", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), mine(F.col("nm")).alias("mb"), F.lit(False).alias("asks"), "id", "set")
        rest = asks.unionByName(members).repartition(F.col("region"), F.col("qb"), F.col("mb")).sortWithinPartitions("region", "qb", "mb")
        late = rest.mapInArrow(_against(percent), "a long, b long")
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(late))
        found = written(found)
    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id"))
    named = written(named)
    out = signed.select("id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id")).alias("component_id"))

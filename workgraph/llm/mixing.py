"""Mixing sources to target weights by exact block quotas and a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh, n_words, written


#: Block draws of a mix: fewer than the generator's limit for exact hypergeometric draws.
MOST_DRAWS = 900_000_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs) with weight and target: the words the mix should take of each source.

    Sources by code point, null last, weigh weights in turn. Targets share the size of all sources by weight; none goes
    above most times its source's size, and what is over is shared again by weight until none is above. That fixed
    point is found in closed form: with sources in order of cap / weight, the level is (all - caps so far) / (weight
    left), and a source is capped as long as its cap / weight is under the level. The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.get(turn, (F.row_number().over(order) - 1) % len(weights)))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))))
    s = s.withColumn("capped", F.col("ratio") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)  # the first uncapped source's; later ones have less or the same
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)).drop("cap", "ratio", "level", "capped", "weight")


def _split(ranges: pd.DataFrame, node: int, depth: int, down: int, seed: int) -> Iterator[tuple]:
    """Rows (node, source, lo, hi) down levels below node: at each, half of the draws go left by a multivariate hypergeometric draw."""
    stack = [(node, ranges["lo"].to_numpy(np.int64), ranges["hi"].to_numpy(np.int64), 0)]
    names = ranges["rank"].to_numpy(np.int64)
    while stack:
        at, lo, hi, level = stack.pop()
        if level == down:
            for i in np.nonzero(hi > lo)[0]:
                yield at, int(names[i]), int(lo[i]), int(hi[i])
            continue
        have = hi - lo
        total = int(have.sum())
        rng = np.random.Generator(np.random.Philox(key=[seed & (2**63 - 1), (depth + level) << 48 | at]))
        left, want, rest = np.zeros_like(have), (total + 1) // 2, total
        for i in np.nonzero(have)[0]:  # one conditional draw a source; draw_plan() keeps the sum under the generator's limit
            rest -= int(have[i])
            if want <= 0:
                break
            k = int(have[i]) if rest == 0 else int(rng.hypergeometric(int(have[i]), rest, want))
            k = min(k, want)
            left[i] = k
            want -= k
        stack += [(2 * at, lo, lo + left, level + 1), (2 * at + 1, lo + left, hi, level + 1)]


def splitting_tree(quotas: DataFrame, depth: int, seed: int = 17) -> DataFrame:
    """(rank, quota) -> (shard, rank, lo, hi): which positions of a source's permuted block draws each of 2**depth shards gets.

    The upper half of the levels is split in one task, the lower half below each of its nodes in tasks of their own.
    A task holds one row a source. Every split is an exact draw; quotas may sum to MOST_DRAWS.
    """
    upper = depth // 2

    def expand(down: int, start: int):
        def f(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rank")
            return pd.DataFrame(list(_split(pdf, int(pdf["shard"].iloc[0]), start, down, seed)), columns=["shard", "rank", "lo", "hi"])

        return f

    shape = "shard long, rank long, lo long, hi long"
    root = quotas.filter("quota > 0").select(F.lit(0).cast("long").alias("shard"), F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("lo"), F.col("quota").cast("long").alias("hi"))
    nodes = root.groupBy("shard").applyInPandas(expand(upper, 0), shape)
    return nodes.groupBy("shard").applyInPandas(expand(depth - upper, upper), shape)


def _fill(block: pd.DataFrame, most: int) -> pd.DataFrame:
    """How often each document of a source's last block makes up what is left of its target: in hashed order, each that
    still fits, again in further rounds where long documents leave a gap; then the smallest other one, if the mix comes
    nearer with it."""
    block = block.sort_values(["hash", "id", "mark"], kind="stable").reset_index(drop=True)
    left, size = float(block["left"].iloc[0]), block["size"].to_numpy()
    times = np.zeros(len(block), np.int64)
    for _ in range(most - int(block["epochs"].iloc[0])):
        for i, n in enumerate(size):
            if 0 < n <= left:
                times[i] += 1
                left -= n
    rest = np.nonzero((times == 0) & (size > 0))[0]
    if len(rest) and size[least := rest[np.argmin(size[rest])]] < 2 * left:
        times[least] = 1
    return block.assign(times=times)


def draw_plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_words: int = 2_000_000, block_docs: int = 64, most_blocks: int = 65536) -> DataFrame:
    """One row for each row of docs: id, mark, size, source, source_size, target and draws, an array of (shard, epoch).

    Documents of a source are dealt into blocks by a keyed hash, and blocks stand in the order of a keyed hash. The
    source's target is so many whole epochs of all blocks, and then the first blocks of one more, the last of them as
    far as its documents fit best. A quota is thus an exact number of block draws; the splitting tree deals the quotas
    out to shards. The number of blocks follows the source's documents up to most_blocks, so a hot source has many and no
    key is hot; beyond that its blocks grow (a third of 50 billion documents: 250,000 a block), of which only the last one
    drawn is looked at by document, in one task. block_docs grows where there would be over MOST_DRAWS draws.

    Null text: size 0, never drawn in part. Null source: a source of its own, last. Very long texts: only their size is
    kept. Ties in the hashed order go by id, then text hash. Repeated rows are documents of their own. Empty table:
    empty result. Other columns are left out, whatever their names. Reruns give the same draws: every choice is a hash of
    id, text and seed.
    """
    doc = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    doc = written(doc.withColumn("hash", F.xxhash64(F.lit(seed), "id", "mark")))
    sizes = doc.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    n_docs = sizes.agg(F.sum("n_docs")).first()[0] or 0
    block_docs = max(block_docs, -(-n_docs * (most + 1) // MOST_DRAWS))
    sources = written(
        source_targets(sizes, weights, most)
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("n_blocks", F.least(F.lit(most_blocks), F.ceil(F.col("n_docs") / block_docs)).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
        .withColumn("rest", F.when(F.col("epochs") < most, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
    )
    named = sources.select("source", "rank", "n_blocks").withColumnRenamed("source", "of")
    dealt = doc.join(named, doc["source"].eqNullSafe(named["of"])).drop("of").withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "hash"), "n_blocks")).drop("n_blocks")
    dealt = written(dealt)
    blocks = dealt.groupBy("rank", "block").agg(F.sum("size").alias("words")).join(sources.select("rank", "n_blocks", "epochs", "rest"), "rank")
    turn = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 2), "rank", "block"), "block")
    blocks = blocks.withColumn("pos", F.row_number().over(turn) - 1).withColumn("before", F.sum("words").over(turn) - F.col("words"))
    # in one more epoch: 'all' of the block, 'none', or as much as is left
    blocks = written(blocks.withColumn("left", F.col("rest") - F.col("before")).withColumn("more", (F.col("left") > 0) & (F.col("words") > 0)))
    quotas = blocks.groupBy("rank").agg((F.max(F.col("epochs") * F.col("n_blocks")) + F.sum(F.col("more").cast("long"))).alias("quota"))
    total = sources.agg(F.sum("target")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1.0, total / shard_words))))
    leaves = splitting_tree(quotas, depth, seed)
    seats = leaves.select("shard", "rank", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("seat"))
    # the position of an epoch's blocks in the source's line of draws; blocks without 'more' take none in the last epoch
    counted = Window.partitionBy("rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    drawn = blocks.withColumn("ahead", F.coalesce(F.sum(F.col("more").cast("long")).over(counted), F.lit(0)))
    spots = F.concat(
        F.when(F.col("epochs") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("epochs"), F.lit(1)) - 1), lambda e: F.struct(e.alias("epoch"), (e * F.col("n_blocks") + F.col("pos")).alias("seat")))).otherwise(F.array()),
        F.when(F.col("more"), F.array(F.struct(F.col("epochs").alias("epoch"), (F.col("epochs") * F.col("n_blocks") + F.col("ahead")).alias("seat")))).otherwise(F.array()),
    )
    placed = drawn.select("rank", "block", "left", "words", "epochs", F.explode_outer(spots).alias("spot")).select("rank", "block", "left", "words", "epochs", "spot.epoch", "spot.seat")
    placed = placed.join(seats, ["rank", "seat"], "left").groupBy("rank", "block").agg(F.first("left").alias("left"), F.first("words").alias("words"), F.first("epochs").alias("epochs"), F.sort_array(F.collect_list(F.when(F.col("seat").isNotNull(), F.struct("epoch", "shard")))).alias("spots"))
    placed = written(placed.withColumn("partly", (F.col("left") > 0) & (F.col("left") < F.col("words"))))
    out = dealt.join(placed, ["rank", "block"])
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", times long"
    cut = out.filter("partly").groupBy("rank", "block").applyInPandas(lambda block: _fill(block, most), shape)
    out = out.filter("not partly").withColumn("times", (F.col("left") >= F.col("words")).cast("long")).unionByName(cut)
    whole = F.filter("spots", lambda s: s["epoch"] < F.col("epochs"))
    last = F.when(F.col("times") > 0, F.flatten(F.transform(F.filter("spots", lambda s: s["epoch"] == F.col("epochs")), lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.col("times"), F.lit(1)) - 1), lambda j: F.struct((s["epoch"] + j).alias("epoch"), s["shard"].alias("shard"))))))
    out = out.withColumn("draws", F.concat(whole, F.coalesce(last, F.filter("spots", lambda s: F.lit(False)))))
    out = out.join(sources.select("rank", "source_size", "target"), "rank")
    return out.select("id", "mark", "source", "size", "source_size", "target", F.transform("draws", lambda s: F.struct(s["shard"].alias("shard"), s["epoch"].alias("epoch"))).alias("draws"))


def mix(docs: DataFrame, shard: str | None = None, order: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """The mixed documents: each row of docs as often as draw_plan() draws it, in shards, shuffled within each.

    Rows come arranged by the splitting tree's shards and in the hashed order inside each; shard and order name columns
    for both. Rows of null text have size 0 and follow their block's draws. Rows of equal id, text and source are told
    apart by a hash of their other columns, so reruns agree; only such rows are numbered in a window. Null ids and sources
    are values like others. Columns of docs pass unchanged, whatever their names. Empty table: empty result.
    """
    plan = draw_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **how)
    i, m, s, n, draw, mark, src, nth, at, place = fresh(docs, "_id", "_mark", "_source", "_nth", "_draw", "_markd", "_sourced", "_nthd", "_shard", "_place")
    number = lambda keys, by: F.row_number().over(Window.partitionBy(*keys).orderBy(by))
    plan = plan.select(F.col("id").alias(i), F.col("mark").alias(m), F.col("source").alias(s), F.col("draws").alias(draw))
    twice = written(plan.groupBy(i, m, s).count().filter("count > 1").drop("count"))
    plan = written(plan.withColumn(n, number((i, m, s), draw)).filter(F.size(draw) > 0))
    marked = docs.withColumn(mark, F.xxhash64(text_col)).withColumn(src, F.col(source_col).cast("string"))
    same = lambda d: F.col(id_col).eqNullSafe(d[i]) & (F.col(mark) == d[m]) & F.col(src).eqNullSafe(d[s])
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    rest = marked.join(twice, same(twice), "left_semi")
    rows = marked.join(twice, same(twice), "left_anti").withColumn(nth, F.lit(1)).unionByName(rest.withColumn(nth, number((id_col, mark, src), F.xxhash64(*plain))))
    out = rows.join(plan, same(plan) & (F.col(nth) == F.col(n))).withColumn(draw, F.explode(draw))
    out = out.withColumn(at, F.col(f"{draw}.shard")).withColumn(place, F.xxhash64(F.lit(seed + 4), at, f"{draw}.epoch", i, m, s, n))
    out = out.repartition(F.col(at)).sortWithinPartitions(at, place)
    extra = [F.col(at).alias(shard)] if shard else []
    extra += [F.col(place).alias(order)] if order else []
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *extra)


def mix_column(draws: Column, size: Column) -> Column:
    """Words taken: the size as often as drawn."""
    return size * F.size(draws).cast("long")

"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt into blocks by hash.  A source's quota is a whole
number of block draws whose words come nearest its target.  The tree parts the
quotas of all sources among output shards: each node hands the shards on its left
a multivariate-hypergeometric share.  Every shard walks its own path from the root
with generators seeded by node, so nothing is shared between tasks and reruns
agree.  Shards draw disjoint ranges of each source's permuted blocks, and shuffle
the documents of their blocks among themselves.

A source's draws sum to its exact quota whatever the tree does; the tree settles
which shard draws which blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import WORD, scratch, sized, unused, whole_text, written

_FANOUT = 256
_POOLS = 4


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, docs, weight, target): one row per source.

    ``sizes`` has source and size.  Sources by code point, null last, take the
    weights in turn and share the total size; a target stops at ``cap`` times
    the source's size and the excess is shared again by weight.  With sources
    sorted by size over weight, the capped ones are a prefix, so the level is
    found from running sums.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("_n", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).withColumn("weight", choice)
    order = Window.orderBy((F.col("source_size") / F.col("weight")), "_n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = ranked.withColumns({"_level": level, "_place": F.row_number().over(order)})
    free = F.col("_level") * F.col("weight") <= cap * F.col("source_size")
    first = F.min(F.when(free, F.struct("_place", "_level"))).over(Window.partitionBy())
    return leveled.withColumn("_first", first).select(
        "source", "source_size", "docs", "weight",
        F.when(F.col("_place") >= F.col("_first._place"), F.col("_first._level") * F.col("weight"))
        .otherwise(cap * F.col("source_size")).cast("double").alias("target"),
    )


def shard_quotas(quotas: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first draw, draws) of every source for one shard: its path down the splitting tree."""
    start, mine = np.zeros_like(quotas), quotas
    low, high = 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, low * (shards + 1) + high]))
        left = _hypergeometric(rng, mine, int(mine.sum()) * (mid - low) // (high - low))
        if shard < mid:
            mine, high = left, mid
        else:
            start, mine, low = start + left, mine - left, mid
    return start, mine


def _hypergeometric(rng: np.random.Generator, colors: np.ndarray, take: int) -> np.ndarray:
    if not take:
        return np.zeros_like(colors)
    if colors.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(colors, take, method="marginals").astype(np.int64)
    # Beyond numpy's range: halve the colours until they fit.
    big = colors // 2
    return _hypergeometric(rng, big, take // 2) + _hypergeometric(rng, colors - big, take - take // 2)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, block_words: int = 1 << 20, least_blocks: int = 4096,
    shard_words: int = 1 << 26, least_shards: int = 16, seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(placed, draws).

    ``placed``: one row per document: id, source, size, source_size, target, block.
    ``draws``: one row per draw of a block: source, block, copy, shard, draw.
    A document is taken once for every draw of its block, at most ``cap`` times.
    There are a shard for each ``shard_words`` of all sizes and ``least_shards`` at
    least.  Null, empty and very long texts count their words, null text none; a
    null source is a source; equal ids fall into one block, so repeated rows are
    taken alike; other columns are not read; an empty table gives empty results.
    One row per source comes to the driver: as many as there are weights to set.
    """
    spark = docs.sparkSession
    sizes = written(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size")),
        "mix-sizes",
    )
    targets = source_targets(sizes.select("source", "size"), weights, cap).withColumn(
        "blocks", F.greatest(F.lit(least_blocks).cast("long"), F.ceil(F.col("source_size") / block_words))
    )
    targets = written(targets, "mix-targets")
    known = targets.select(F.col("source").alias("_s"), "source_size", "target", "blocks")
    block = F.pmod(F.xxhash64(F.lit(seed), "_id"), "blocks")
    placed = sizes.join(known, sizes.source.eqNullSafe(known._s)).withColumn("block", block).drop("_s", "blocks")
    # Blocks in pools by size, largest first, in permuted order within a pool.
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    mean = F.col("source_size") / F.greatest(F.count(F.lit(1)).over(Window.partitionBy("source")), F.lit(1))
    times = F.col("words") / F.greatest(mean, F.lit(1e-9))
    pool = F.when(times > 4, 0).when(times > 1, 1).when(times > 0.25, 2).otherwise(3)
    blocks = blocks.withColumn("pool", pool).withColumn("at", F.xxhash64(F.lit(seed + 1), "source", "block")).withColumn("bucket", F.pmod("at", F.lit(_FANOUT)))
    blocks = written(blocks, "mix-blocks")
    keys = ["source", "pool"]
    by_bucket = blocks.groupBy(*keys, "bucket").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    outer = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = by_bucket.select(
        F.col("source").alias("_s"), F.col("pool").alias("_p"), F.col("bucket").alias("_b"),
        F.coalesce(F.sum("w").over(outer), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("n0"),
    )
    inner = Window.partitionBy(*keys, "bucket").orderBy("at", "block")
    full = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    ordered = blocks.join(by_bucket, blocks.source.eqNullSafe(by_bucket._s) & (blocks.pool == by_bucket._p) & (blocks.bucket == by_bucket._b)).select(
        "source", "block", "pool", "words", "source_size", "target", full.alias("full"),
        (F.col("w0") + F.sum("words").over(inner) - F.col("words")).alias("before"),
        (F.col("n0") + F.row_number().over(inner) - 1).alias("place"),
    )
    ordered = written(ordered, "mix-order")
    # What is left of the target after whole copies is drawn pool by pool; what a
    # pool misses or exceeds its share by is passed on to the next smaller one.
    state = ordered.groupBy("source").agg(
        F.first("full").alias("full"), F.count(F.lit(1)).alias("all_blocks"),
        F.greatest(F.max((F.col("target") - F.col("full") * F.col("source_size")) / F.greatest("source_size", F.lit(1))), F.lit(0.0)).alias("share"),
        *[F.coalesce(F.sum(F.when(F.col("pool") == k, F.col("words"))), F.lit(0)).alias(f"w{k}") for k in range(_POOLS)],
        *[F.count(F.when(F.col("pool") == k, 1)).alias(f"n{k}") for k in range(_POOLS)],
    ).withColumn("carry", F.lit(0.0))
    state = written(state, "mix-state")
    for k in range(_POOLS):
        state = state.withColumn(f"goal{k}", F.when(F.col("full") < cap, F.col("share") * F.col(f"w{k}") + F.col("carry")).otherwise(F.lit(0.0)))
        goals = state.select(F.col("source").alias("_s"), F.col(f"goal{k}").alias("_g"))
        own = ordered.where(F.col("pool") == k)
        took = own.join(goals, own.source.eqNullSafe(goals._s)).where(F.col("before") + F.col("words") / 2 <= F.col("_g")).groupBy(F.col("source").alias("_t")).agg(
            F.sum("words").alias("_tw"), F.count(F.lit(1)).alias("_tn")
        )
        state = written(state.join(took, state.source.eqNullSafe(took._t), "left").withColumn(
            "carry", F.col(f"goal{k}") - F.coalesce("_tw", F.lit(0))
        ).withColumn(f"took{k}", F.coalesce("_tn", F.lit(0)).cast("long")).drop("_t", "_tw", "_tn"), "mix-state")
    upto = lambda name, k: sum((F.col(f"{name}{j}") for j in range(k)), F.lit(0).cast("long"))
    sums = state.select(
        F.col("source").alias("_s"), "all_blocks",
        F.array(*[F.col(f"took{k}") for k in range(_POOLS)]).alias("_took"),
        F.array(*[upto("took", k) for k in range(_POOLS)]).alias("_drawn"), F.array(*[upto("n", k) for k in range(_POOLS)]).alias("_passed"),
    )
    ordered = ordered.join(sums, ordered.source.eqNullSafe(sums._s)).select(
        "source", "block", "full", "all_blocks", (F.col("place") < F.get("_took", "pool")).alias("part"),
        (F.get("_passed", "pool") + F.col("place")).alias("place"), (F.get("_drawn", "pool") + F.col("place")).alias("part_place"),
    )
    quota = state.withColumn("extra", upto("took", _POOLS))
    plan = quota.select("source", (F.col("all_blocks") * F.col("full") + F.col("extra")).alias("quota"), "all_blocks").orderBy(F.asc_nulls_last("source")).collect()
    names, amounts = [r.source for r in plan], np.array([r.quota for r in plan], np.int64)
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first().s
    shards = max(least_shards, -(-total // shard_words))

    def walk(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for shard in pdf["id"]:
                start, mine = shard_quotas(amounts, int(shard), shards, seed)
                yield pd.DataFrame({"source": pd.Series(names, dtype=object), "shard": int(shard), "first": start, "n": mine})

    ranges = spark.range(shards).mapInPandas(walk, "source string, shard long, first long, n long").where("n > 0")
    slots = ranges.select(F.col("source").alias("_s"), "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    taken = ordered.withColumn("copies", F.col("full") + F.when(F.col("part"), 1).otherwise(0))
    copies = taken.where("copies > 0").select("source", "block", "full", "place", "part_place", "all_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    copies = copies.withColumn("draw", F.col("copy") * F.col("all_blocks") + F.when(F.col("copy") < F.col("full"), F.col("place")).otherwise(F.col("part_place")))
    draws = copies.join(slots, copies.source.eqNullSafe(slots._s) & (copies.draw == slots.draw)).select("source", "block", "copy", "shard", copies.draw)
    return placed, draws


def taken(placed: DataFrame, draws: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies."""
    times = draws.groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.count(F.lit(1)).alias("copies"))
    joined = placed.join(times, placed.source.eqNullSafe(times._s) & (placed.block == times._b), "left")
    return joined.select(
        F.col("_id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * F.coalesce("copies", F.lit(0))).alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"),
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shuffled: bool = True, seed: int = 17, **options) -> DataFrame:
    """The mixed documents: rows of ``docs`` repeated or left out, plus shard.

    Columns keep their names; the new one is ``shard``, with underscores before it
    where that is taken.  Each shard lies in one partition, its rows in the order
    of a random key (``shuffled`` false leaves them where they were).  Draws are
    looked up by broadcast while their table is small, else by a shuffle join.
    Cases are treated as in ``mix``.
    """
    spark = docs.sparkSession
    names = docs.columns
    shard, key, many, block, drawn, draw, s, b, ps = unused(names, "shard", "_key", "_many", "_block", "_drawn", "_draw", "_s", "_b", "_ps")
    with scratch(spark) as keep:
        placed, draws = mix(docs, id_col, text_col, source_col, seed=seed, **options)
        block_words, least = options.get("block_words", 1 << 20), options.get("least_blocks", 4096)
        blocks = F.greatest(F.lit(least).cast("long"), F.ceil(F.col("n") / block_words))
        sources = written(placed.groupBy("source").agg(F.first("source_size").alias("n")).select(F.col("source").alias(ps), blocks.alias(many)), "mix-sources")
        lists = draws.groupBy(F.col("source").alias(s), F.col("block").alias(b)).agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias(drawn))
        lists = written(lists, "mix-draws")
        shards = (lists.agg(F.max(F.array_max(F.transform(drawn, lambda d: d["shard"])))).first()[0] or 0) + 1
        keep(sources, lists)
    bounded = _draws_are_small(lists, drawn)
    tagged = docs.join(sized(sources), docs[source_col].eqNullSafe(F.col(ps))).withColumn(block, F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), many))
    joined = tagged.join(F.broadcast(lists) if bounded else lists, F.col(source_col).eqNullSafe(F.col(s)) & (F.col(block) == F.col(b)))
    out = joined.select(*names, F.explode(drawn).alias(draw)).select(*names, F.col(draw)["shard"].alias(shard), F.xxhash64(F.lit(seed + 2), F.col(id_col), F.col(draw)["copy"], F.col(draw)["shard"]).alias(key))
    if shuffled:
        out = out.repartition(shards, shard).sortWithinPartitions(shard, key)
    return out.select(*names, shard)


def _draws_are_small(lists: DataFrame, drawn: str, most_bytes: int = 64 << 20) -> bool:
    """Whether the table of draws takes at most ``most_bytes``, sources counted by their longest name."""
    found = lists.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(drawn)).alias("d"), F.max(F.octet_length(lists.columns[0])).alias("m")).first()
    return found.n * (48 + (found.m or 0)) + 24 * (found.d or 0) <= most_bytes

"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments, and fingerprints that are alike agree in some
segment but for one bit.  A segment that differs in one bit has one half that does
not differ, so rows meet by (segment, half): in a task, sorted segments are probed
with the Hamming ball of radius one around each, which is enumerated there and not
shuffled.  Matches are verified by their complete distance.  Of two segments that
differ in one bit, only the one with the zero bit probes.

Families are joined before that: buckets of equal segments compare each member with
the first one, a row's nearest link before its others.  Balls are then probed for
components: a row that meets a larger component anywhere is compared with all its
members by their complete distance, nearest first.  So a family costs a row for each
of its strangers and not for each pair, and what a probe or a comparison had no room
for comes in later rounds, by when most of it is joined.  Groups and components too
large for a task are dealt out in blocks.

For near-duplicates this is the candidate search only: a pair links when the
Jaccard similarity of its shingle sets, computed exactly, reaches the bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import connected_components
from lectern.llm.shared import give_back_memory, scratch, sized, unused, whole_text, written

_CHUNK = 1 << 16  # rows that a task compares at once
_BLOCK = 1 << 14  # rows of a component that a task compares
_GIANT = 1 << 20  # rows of a group from which it is dealt out
_FIRST = 16  # components that a row takes of a bucket in the first round; each round takes 16 times the last
_NEAREST = 64  # members of a component that a row is compared with exactly at first; then 16 times as many
_FEW = 8  # members of a component that are compared by a join
_ROOM = 16 << 20  # bytes of sets that a task holds of a component, and of the rows compared with it
_NEAR_WORDS = 17  # near_dedup's fingerprint: 1088 bits, room for 45 segments of 24 bits
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIRS = "u long, v long, kind int"
_PAIR, _MORE, _LARGE, _CROWDED = 0, 1, 2, 3


def _shingle_hashes(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles of a whole text, in bounded pieces."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z, only \x20 \x09-\x0D
    if not words:
        return
    h = xxhash.xxh64_intdigest
    last = max(1, len(words) - width + 1)
    for at in range(0, last, 50_000):
        part = words[at : min(at + 50_000, last) + width - 1]
        whole = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate(([0], ends[:-1])).tolist()
        stops = (ends[min(width, len(part)) - 1 :] - 1).tolist()
        yield np.fromiter((h(whole[a:b], seed) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have bit 63, 62, ... 0."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 3, words: int = 1, seed: int = 42) -> np.ndarray:
    """``words`` 64-bit SimHash words; a bit is one if set in over half of the hashes.

    Further words use the same hashes mixed by multiplication.  Without a word
    the fingerprint is zero.
    """
    return _print_of(_shingle_hashes(text, width, seed), words)


def _print_of(pieces: Iterator[np.ndarray], words: int) -> np.ndarray:
    counts = np.zeros((words, 64), np.int64)
    total = 0
    for h in pieces:
        total += len(h)
        for k in range(words):
            if k:
                h = h * _MIX
                h ^= h >> np.uint64(29)
            counts[k] += _bit_counts(h)
    bits = counts * 2 > total
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, words: int, seed: int = 42) -> DataFrame:
    """(id, fp array<bigint>) of every row of ``docs``."""
    schema = docs.select(F.col(id_col).alias("_id")).withColumn("fp", F.array().cast("array<bigint>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), width, words, seed).view(np.int64).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["_id", "fp"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, schema)


def _distance(a: str, b: str, words: int):
    total = F.lit(0)
    for k in range(words):
        total = total + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return total


def _segment(fp, start: int, bits: int):
    """``bits`` bits of the fingerprint from bit ``start`` on, counted from word 0's lowest."""
    word, low = divmod(start, 64)
    value = F.shiftrightunsigned(fp[word], low)
    if low + bits > 64:
        value = value.bitwiseOR(F.shiftleft(fp[word + 1], 64 - low))
    return value.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _keys(fp: Column, segments: list[tuple[int, int]], halves: int) -> Column:
    """Keys of all segments: segment and half, the half that rows meet by, the other half."""
    out = []
    for k, (start, bits) in enumerate(segments):
        value, half = _segment(fp, start, bits), bits // 2
        low = value.bitwiseAND(F.lit((1 << half) - 1).cast("long"))
        swapped = F.shiftleft(low, half).bitwiseOR(F.shiftrightunsigned(value, half))
        out += [F.lit((2 * k + h) << bits).cast("long") + x for h, x in enumerate((value, swapped)[:halves])]
    return F.array(*out)


def _ranks(comp: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The place of each row's component in the order of size and name."""
    names, first, own = np.unique(comp, return_index=True, return_inverse=True)
    place = np.empty(len(names), np.int64)
    place[np.lexsort((names, size[first]))] = np.arange(len(names))
    return place[own]


def _probed(left: tuple, right: tuple, flips: list[int | None], most: int, ratio: float) -> tuple[np.ndarray, ...]:
    """(u, v, keys with more, keys of the rows u, whether v is one row): rows of ``left`` and the larger components that they meet in ``right``.

    ``left`` has key, comp, fid, n, size of rows, ``right`` has key, comp, smallest n,
    largest n, size of the components in a bucket.  Of each bucket a row takes up to
    ``most`` components, beginning at a place of its own.  Components all of whose
    sets there are too far from the row's size for ``ratio`` are left out.
    """
    key, comp, fid, n, size = left
    ranks = _ranks(np.concatenate([comp, right[1]]), np.concatenate([size, right[4]]))
    own, theirs = ranks[: len(key)], ranks[len(key) :]
    order = np.lexsort((theirs, right[0]))
    there, names, low_n, high_n, theirs, alone = right[0][order], right[1][order], right[2][order], right[3][order], theirs[order], right[4][order] == 1
    width = len(ranks) + 1
    place = np.searchsorted(there, there, "left") * width + theirs
    spin = (fid.view(np.uint64) * _MIX >> np.uint64(33)).astype(np.int64)
    us, vs, more, keys, ones = [], [], [], [], []
    for bit in flips:
        asked = key if bit is None else key ^ (1 << bit)
        low = np.searchsorted(there, asked, "left")
        hit = low < len(there)
        hit[hit] = there[low[hit]] == asked[hit]
        at, low = np.flatnonzero(hit), low[hit]
        high = np.searchsorted(there, asked[at], "right")
        larger = np.searchsorted(place, low * width + own[at], "right")
        count = high - larger
        took = np.minimum(count, most)
        more.append(key[at[count > most]])
        ends = np.cumsum(took)
        who = np.repeat(np.arange(len(at)), took)
        step = np.arange(len(who)) - np.repeat(ends - took, took)
        found = larger[who] + (step + np.where(count > most, spin[at], 0)[who]) % np.maximum(count, 1)[who]
        a = at[who]
        fits = (high_n[found] >= ratio * n[a] - 1e-9) & (n[a] >= ratio * low_n[found] - 1e-9)
        us.append(fid[a[fits]])
        vs.append(names[found[fits]])
        keys.append(key[a[fits]])
        ones.append(alone[found[fits]])
    return np.concatenate(us), np.concatenate(vs), np.unique(np.concatenate(more)), np.concatenate(keys), np.concatenate(ones)


def _in_buckets(key: np.ndarray, comp: np.ndarray, n: np.ndarray, size: np.ndarray) -> tuple:
    """The components in each bucket: key, comp, smallest n, largest n, size."""
    order = np.lexsort((comp, key))
    key, comp, n, size = key[order], comp[order], n[order], size[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])]))
    return key[first], comp[first], np.minimum.reduceat(n, first), np.maximum.reduceat(n, first), size[first]


def _batch(u, v, kind: int) -> pa.RecordBatch:
    """Distinct rows (u, v, kind)."""
    if v is None:
        u = np.unique(u)
    elif len(u):
        u, v = np.unique(np.stack([u, v]), axis=1)
    rows = [pa.array(u, pa.int64()), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v, pa.int64()), pa.array(np.full(len(u), kind), pa.int32())]
    return pa.RecordBatch.from_arrays(rows, ["u", "v", "kind"])


def _columns(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [np.concatenate([b.column(k).to_numpy() for b in batches]) for k in range(batches[0].num_columns)]


def _heads(ratio: float):
    """Batches of (key, fid, n) sorted by key and fid -> each member of a bucket with its first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            key, fid, n = _columns([batch])
            if head is not None:
                key, fid, n = (np.concatenate([[h], x]) for h, x in zip(head, (key, fid, n), strict=True))
            if len(key):
                first = np.searchsorted(key, key, "left")
                head = key[first[-1]], fid[first[-1]], n[first[-1]]
                fits = (fid != fid[first]) & (np.minimum(n, n[first]) >= ratio * np.maximum(n, n[first]) - 1e-9)
                yield _batch(np.minimum(fid, fid[first])[fits], np.maximum(fid, fid[first])[fits], _PAIR)

    return run


_MEMBER = ["key", "comp", "fid", "n", "size"]


def _met(rows: list[np.ndarray], half: int, bits: int, most: int, ratio: float) -> Iterator[pa.RecordBatch]:
    """Pairs and groups with more of whole groups of rows (key, comp, fid, n, size).

    In a crowd, where single rows meet more of each other than there are of them,
    those pairs are left out and the group is named (see ``_crowded``).
    """
    key, comp, fid, n, size = rows
    # Equal segments meet in either half; they are probed in the first one.
    even = (key >> bits) & 1 == 0
    for mine, flips in ((np.ones(len(key), bool), list(range(half))), (even, [None])):
        if mine.any():
            left = tuple(x[mine] for x in (key, comp, fid, n, size))
            u, v, more, at, one = _probed(left, _in_buckets(left[0], left[1], left[3], left[4]), flips, most, ratio)
            groups, times = np.unique(at[one] >> half, return_counts=True)
            singles = np.sort(left[0][left[4] == 1] >> half)
            crowds = groups[times > np.searchsorted(singles, groups, "right") - np.searchsorted(singles, groups, "left")]
            out = ~(one & np.isin(at >> half, crowds))
            yield _batch(u[out], v[out], _PAIR)
            yield _batch(crowds, None, _CROWDED)
            yield _batch(more >> half, None, _MORE)


def _balls(half: int, bits: int, most: int, ratio: float, chunk: int, giant: int):
    """Batches of (key, comp, fid, n, size) sorted by key -> pairs, groups with more, groups too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        large = None  # the group that is being skipped
        for batch in batches:
            if large is not None:
                batch = batch.filter(pa.array(batch.column(0).to_numpy() >> half != large))
                if not batch.num_rows:
                    continue
                large = None
            held.append(batch)
            if sum(b.num_rows for b in held) < chunk:
                continue
            rows = _columns(held)
            last = rows[0][-1] >> half
            cut = int(np.searchsorted(rows[0], last << half, "left"))
            if cut:
                yield from _met([x[:cut] for x in rows], half, bits, most, ratio)
            if len(rows[0]) - cut >= giant:
                large, held = int(last), []
                yield _batch(np.array([large]), None, _LARGE)
            else:
                held = [pa.RecordBatch.from_arrays([pa.array(x[cut:]) for x in rows], _MEMBER)]
        if held and sum(b.num_rows for b in held):
            yield from _met(_columns(held), half, bits, most, ratio)
        give_back_memory()

    return run


def _blocks(count: Column, block: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(count / block))


def _spread(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))


def _dealt(members: DataFrame, large: DataFrame, half: int, bits: int, most: int, ratio: float, block: int) -> DataFrame:
    """Pairs of the groups of ``large(u)``, and those of them with more: blocks of rows by blocks of components in buckets."""
    rows = members.join(F.broadcast(large), F.col("g") == F.col("u"), "left_semi")
    kinds = rows.groupBy("g", "key", "comp").agg(F.min("n").alias("n"), F.max("n").alias("fid"), F.first("size").alias("size"))
    sizes = rows.groupBy("g").agg(_blocks(F.count(F.lit(1)), block).alias("lefts"))
    sizes = sizes.join(kinds.groupBy("g").agg(_blocks(F.count(F.lit(1)), block).alias("rights")), "g").withColumnRenamed("g", "_g")
    sizes = F.broadcast(written(sizes, "simhash-sizes"))
    left = rows.join(sizes, F.col("g") == F.col("_g")).select("*", F.pmod(F.xxhash64("fid"), "lefts").alias("p"), _spread("rights").alias("q"), F.lit(True).alias("side"))
    right = kinds.join(sizes, F.col("g") == F.col("_g")).select("*", F.pmod(F.xxhash64("comp"), "rights").alias("q"), _spread("lefts").alias("p"), F.lit(False).alias("side"))
    shown = ["g", "p", "q", "side", *_MEMBER]

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        key, comp, fid, n, size = (table.column(c).to_numpy() for c in _MEMBER)
        mine, theirs = tuple(x[side] for x in (key, comp, fid, n, size)), tuple(x[~side] for x in (key, comp, n, fid, size))
        flips: list[int | None] = [*range(half), *([None] if not int(key[0]) >> bits & 1 else [])]
        u, v, more, _, _ = _probed(mine, theirs, flips, most, ratio)
        return pa.Table.from_batches([_batch(u, v, _PAIR), _batch(more >> half, None, _MORE)])

    return left.select(*shown).union(right.select(*shown)).groupBy("g", "p", "q").applyInArrow(compare, _PAIRS)


def _crowded(homes: DataFrame, crowds: DataFrame, segments: list[tuple[int, int]], most: int, limit: int, ratio: float) -> DataFrame:
    """The pairs of single rows in the groups of ``crowds(u)`` that are within the complete distance ``most``.

    Rows bring their fingerprints along, which would be too much for all groups; so
    strangers that only meet in many segments are told apart where they meet, and
    cost no row each.
    """
    bits = segments[0][1]
    half = bits // 2
    rows = homes.where(F.col("size") == 1).select(F.explode(_keys(F.col("fp"), segments, 2)).alias("key"), "fid", "n", "fp").withColumn("g", F.shiftright("key", half))
    rows = rows.join(sized(crowds), F.col("g") == F.col("u"), "left_semi")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, fid, n = (table.column(c).to_numpy() for c in ("key", "fid", "n"))
        fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(fid), -1)
        size = np.ones(len(fid), np.int64)
        flips: list[int | None] = [*range(half), *([None] if not int(key[0]) >> bits & 1 else [])]
        u, v, *_ = _probed((key, fid, fid, n, size), _in_buckets(key, fid, n, size), flips, limit, ratio)
        order = np.argsort(fid)
        a, b = (order[np.searchsorted(fid, x, sorter=order)] for x in (u, v))
        near = [np.zeros(0, bool)]
        for at in range(0, len(a), _CHUNK):
            near.append(np.bitwise_count(fp[a[at : at + _CHUNK]] ^ fp[b[at : at + _CHUNK]]).sum(axis=1, dtype=np.int64) <= most)
        near = np.concatenate(near)
        return pa.Table.from_batches([_batch(u[near], v[near], _PAIR)])

    return rows.select("g", "key", "fid", "n", "fp").groupBy("g").applyInArrow(compare, _PAIRS)


def _nearest(asked: DataFrame, homes: DataFrame, most: int, take: int, block: int) -> DataFrame:
    """(u, v, d, kind): the ``take`` nearest members, within ``most``, of the component v of ``asked(u, v, fu)``; of kind _MORE those (u, v) with more.

    Blocks of members by blocks of rows; a row takes the nearest of each block.
    """
    counts = asked.groupBy("v").agg(_blocks(F.count(F.lit(1)), block).alias("lefts"))
    held = homes.where(F.col("size") > _FEW).join(sized(written(counts, "simhash-counts")), F.col("comp") == F.col("v")).select("v", "fid", "fp", "lefts", _blocks(F.col("size"), block).alias("rights"))
    rights = held.select("v", "lefts", "rights").distinct().withColumnRenamed("v", "_v")
    left = asked.join(sized(written(rights, "simhash-blocks")), F.col("v") == F.col("_v")).select("v", F.col("u").alias("fid"), F.col("fu").alias("fp"), F.pmod(F.xxhash64("u"), "lefts").alias("p"), _spread("rights").alias("q"), F.lit(True).alias("side"))
    right = held.select("v", "fid", "fp", F.lit(0).cast("long").alias("p"), F.pmod(F.xxhash64("fid"), "rights").alias("q"), F.lit(False).alias("side"), "lefts")
    right = right.select("v", "fid", "fp", _spread("lefts").alias("p"), "q", "side")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        fid, v = table.column("fid").to_numpy(), table.column("v").to_numpy()
        column = table.column("fp").combine_chunks()
        fp = column.flatten().to_numpy().view(np.uint64).reshape(len(fid), -1)
        names, prints = fid[~side], fp[~side]
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 4]
        for row, own in zip(fid[side], fp[side], strict=True):
            far = np.bitwise_count(prints ^ own).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(far <= most)
            if len(near) > take:
                out.append([np.array([row]), v[:1], np.array([0]), np.array([_MORE])])
                near = near[np.argsort(far[near], kind="stable")[:take]]
            out.append([np.full(len(near), row), names[near], far[near], np.full(len(near), _PAIR)])
        u, m, d, kind = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(m, pa.int64()), "d": pa.array(d, pa.int32()), "kind": pa.array(kind, pa.int32())})

    return left.unionByName(right).groupBy("v", "p", "q").applyInArrow(compare, "u long, v long, d int, kind int")


class Exact(NamedTuple):
    """An exact test behind the fingerprints: of pairs (u, v), and of sets that a task holds."""

    pairs: Callable[[DataFrame], DataFrame]  #: keeps the true ones of (u, v)
    sets: Callable[[DataFrame], DataFrame]  #: (fid, s) of those of a column f
    reach: Callable[[pa.Scalar, pa.Scalar], bool]  #: whether two sets s link


def _joining(asked: DataFrame, homes: DataFrame, most: int, exactly: Exact, room: int, block: int) -> DataFrame:
    """Links (u, v) of the rows u to members of the components v of ``asked(u, v, fu)``: the first found in each block, nearest first.

    One link joins a row to the component, so the members are told apart where they
    lie and a row costs no row for each member that it is near to but does not link
    with.  Blocks of members by blocks of rows; both bring their sets along.
    """
    with_sizes = asked.join(homes.select(F.col("fid").alias("u"), F.col("n").alias("nu")), "u")
    blocks = lambda n: F.greatest(_blocks(F.count(F.lit(1)), block), _blocks(F.sum(8 * F.col(n) + 200), room))
    members = homes.join(sized(written(asked.select("v").distinct(), "simhash-asked")), F.col("comp") == F.col("v"))
    counts = with_sizes.groupBy("v").agg(blocks("nu").alias("lefts")).join(members.groupBy("v").agg(blocks("n").alias("rights")), "v")
    counts = sized(written(counts.withColumnRenamed("v", "_v"), "simhash-counts"))
    named = asked.select(F.col("u").alias("f")).union(members.select(F.col("fid").alias("f"))).distinct()
    sets = exactly.sets(written(named, "simhash-named")).select(F.col("fid").alias("_fid"), "s")
    left = asked.join(counts, F.col("v") == F.col("_v")).join(sets, F.col("u") == F.col("_fid"))
    left = left.select("v", F.col("u").alias("fid"), F.col("fu").alias("fp"), "s", F.pmod(F.xxhash64("u"), "lefts").alias("p"), _spread("rights").alias("q"), F.lit(True).alias("side"))
    right = members.join(counts, F.col("v") == F.col("_v")).join(sets, F.col("fid") == F.col("_fid"))
    right = right.select("v", "fid", "fp", "s", _spread("lefts").alias("p"), F.pmod(F.xxhash64("fid"), "rights").alias("q"), F.lit(False).alias("side"))

    reach = exactly.reach

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, fid = (table.column(c).to_numpy() for c in ("side", "fid"))
        fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(fid), -1)
        sets, inside = table.column("s"), np.flatnonzero(~side)
        prints, us, vs = fp[inside], [], []
        for row in np.flatnonzero(side):
            far = np.bitwise_count(prints ^ fp[row]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(far <= most)
            for k in near[np.argsort(far[near], kind="stable")]:
                if reach(sets[row], sets[inside[k]]):
                    us.append(fid[row])
                    vs.append(fid[inside[k]])
                    break
        large = table.nbytes > 1 << 20
        del table, side, fid, fp, sets, prints
        if large:
            give_back_memory()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return left.unionByName(right).groupBy("v", "p", "q").applyInArrow(compare, "u long, v long")


def linked(
    prints: DataFrame, segments: list[tuple[int, int]], words: int, most: int, exactly: Exact | None = None,
    ratio: float = 0.0, chunk: int = _CHUNK, giant: int = _GIANT, block: int = _BLOCK, limit: int = _FIRST, take: int = _NEAREST, room: int = _ROOM,
) -> DataFrame:
    """(node, root) over the distinct fingerprints of ``prints(fid, fp)`` that link to another.

    ``segments`` lists (first bit, bits), all of one even width of 48 bits at most.
    Fingerprints link when some segment differs in at most one bit and the whole in
    at most ``most``; with ``exactly`` only those that its test holds for.  ``ratio`` says that sets whose sizes, in a column
    ``n`` of ``prints``, are further apart cannot link.

    Pairs of one component are not looked at again, and none of another is left
    out: rounds go on for the groups whose rows met more components than a round
    takes, and for the rows with more near members of a component than were tried.
    """
    spark = prints.sparkSession
    bits = segments[0][1]
    half = bits // 2
    if "n" not in prints.columns:
        prints = prints.withColumn("n", F.lit(0).cast("long"))
    with scratch(spark) as keep:
        roots = None

        def joined(pairs: DataFrame, links: DataFrame | None = None) -> None:
            """Take the links among ``pairs(u, v)``, which are near, and ``links(u, v)`` into ``roots``."""
            nonlocal roots
            true = exactly.pairs(pairs) if exactly else pairs
            true = written(true if links is None else true.union(links), "simhash-links")
            if roots is None or not true.isEmpty():
                roots = connected_components(true, roots)

        def apart(pairs: DataFrame) -> DataFrame:
            """The (u, v) that are of different components by now."""
            for c in ("u", "v"):
                pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
            return pairs.where(~F.coalesce("ru", "u").eqNullSafe(F.coalesce("rv", "v"))).select("u", "v")

        stored = prints.select(F.explode(_keys(F.col("fp"), segments, 1)).alias("key"), "fid", "n")
        stars = stored.repartition("key").sortWithinPartitions("key", "fid").mapInArrow(_heads(ratio), _PAIRS)
        stars = written(stars.select("u", "v").distinct(), "simhash-stars")
        near = written(_verified(stars, prints, words, most), "simhash-near")
        if exactly:  # a row's nearest first one before the others, most of which are then of its component
            ends = near.select(F.col("u").alias("x"), "u", "v", "d").union(near.select(F.col("v").alias("x"), "u", "v", "d"))
            best = ends.groupBy("x").agg(F.min(F.struct("d", "u", "v")).alias("b")).select("b.u", "b.v").distinct()
            joined(best)
            joined(apart(near.join(best, ["u", "v"], "left_anti").select("u", "v")))
        else:
            joined(near.select("u", "v"))
        open_groups = None
        while True:
            sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("s")).withColumnRenamed("root", "_root")
            of = roots.join(sizes, F.col("root") == F.col("_root")).select("node", "root", "s")
            homes = prints.join(of, F.col("fid") == F.col("node"), "left").select("fid", "fp", "n", F.coalesce("root", "fid").alias("comp"), F.coalesce("s", F.lit(1)).cast("long").alias("size"))
            homes = written(homes, "simhash-homes")
            members = homes.select(F.explode(_keys(F.col("fp"), segments, 2)).alias("key"), "comp", "fid", "n", "size")
            members = members.withColumn("g", F.shiftright("key", half))
            if open_groups is not None:
                members = members.join(sized(open_groups), F.col("g") == F.col("u"), "left_semi")
            told = members.repartition("g").sortWithinPartitions("key").select(*_MEMBER)
            told = written(told.mapInArrow(_balls(half, bits, limit, ratio, chunk, giant), _PAIRS), "simhash-told")
            large = told.where(F.col("kind") == _LARGE).select("u").distinct()
            if not large.isEmpty():
                told = told.union(written(_dealt(members, large, half, bits, limit, ratio, giant), "simhash-dealt"))
            crowds = told.where(F.col("kind") == _CROWDED).select("u").distinct()
            if not crowds.isEmpty():
                crowds = written(crowds, "simhash-crowds")
                told = told.union(written(_crowded(homes, crowds, segments, most, limit, ratio), "simhash-strangers"))
            meets = told.where(F.col("kind") == _PAIR).select("u", "v").distinct()
            mine = homes.select(F.col("fid").alias("u"), F.col("fp").alias("fu"))
            meets = written(meets.join(mine, "u").select("u", "v", "fu"), "simhash-meets")
            few = homes.where(F.col("size") <= _FEW).select(F.col("comp").alias("v"), F.col("fid").alias("m"), F.col("fp").alias("fm"))
            near = meets.join(few, "v").select("u", F.col("m").alias("v"), _distance("fu", "fm", words).alias("d")).where(F.col("d") <= most)
            many = homes.where(F.col("size") > _FEW).select(F.col("comp").alias("v")).distinct()
            crowd, some = written(meets.join(sized(written(many, "simhash-many")), "v", "left_semi"), "simhash-crowd"), take
            if crowd.isEmpty():
                joined(near.select("u", "v"))
            elif exactly:
                joined(near.select("u", "v"), _joining(crowd, homes, most, exactly, room, block))
            else:
                while not crowd.isEmpty():
                    tried = written(_nearest(crowd, homes, most, some, block), "simhash-nearest")
                    pairs = tried.where(F.col("kind") == _PAIR).select("u", "v")
                    joined(pairs if some > take else near.select("u", "v").union(pairs))
                    left = apart(tried.where(F.col("kind") == _MORE).select("u", "v").distinct())
                    crowd, some = written(crowd.join(left, ["u", "v"], "left_semi"), "simhash-crowd"), some * 16
            open_groups = written(told.where(F.col("kind") == _MORE).select("u").distinct(), "simhash-more")
            if open_groups.isEmpty():
                keep(roots)
                return roots
            limit *= 16


def _verified(pairs: DataFrame, prints: DataFrame, words: int, most: int) -> DataFrame:
    """The pairs (u, v) within the complete distance ``most``, with it as d; only asked fingerprints are moved."""
    asked = sized(written(pairs.select(F.explode(F.array("u", "v")).alias("f")).distinct(), "simhash-asked"))
    held = prints.join(asked, F.col("fid") == F.col("f"), "left_semi")
    a = held.select(F.col("fid").alias("u"), F.col("fp").alias("fa"))
    b = held.select(F.col("fid").alias("v"), F.col("fp").alias("fb"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", _distance("fa", "fb", words).alias("d")).where(F.col("d") <= most)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2, seed: int = 42) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, size of the component.

    64-bit fingerprints link at ``most`` or fewer differing bits (at most 3: two
    segments of 32 bits, balls of radius one, find every such pair).  Rows
    without words share fingerprint zero.  component_id is the smallest id
    reachable; null ids are ignored for it, so a component of null ids only has a
    null component_id.  Very long texts are shingled whole, in pieces; repeated rows
    are rows of one component, other columns are not read, an empty table gives an
    empty result.
    """
    if most > 3:
        raise ValueError("two segments with balls of radius one find distances up to 3")
    with scratch(docs.sparkSession) as keep:
        each = written(fingerprints(docs, id_col, text_col, width, 1, seed).select(F.col("_id"), F.col("fp")[0].alias("fid")), "simhash-fp")
        groups = written(each.groupBy("fid").agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-groups")
        roots = linked(groups.select("fid", F.array("fid").alias("fp")), [(0, 32), (32, 32)], 1, most)
        by_fp = groups.join(roots, groups.fid == roots.node, "left").select("fid", "low", "n", F.coalesce("root", "fid").alias("root"))
        by_root = by_fp.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_size"))
        table = written(by_fp.join(by_root, "root").select(F.col("fid").alias("_fid"), "component_id", "component_size"), "simhash-components")
        keep(each, table)
    return each.join(table, each.fid == table._fid).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fid"), 16, "0")).alias("fingerprint"), "component_id", "component_size"
    )


def _text_hash(text_col: str) -> Column:
    return F.unhex(F.sha2(whole_text(text_col), 256))


def _shingled(docs: DataFrame, id_col: str, text_col: str, width: int, words: int, seed: int = 42) -> DataFrame:
    """(id, text hash, a shorter one, fid, n, fp) of every row: name, size and fingerprint of the set of its shingles.

    Sets are named by 64 bits of a hash over them; two different sets of one name
    would be taken for one, which among 10^9 texts has a chance of 3 %.
    """
    given = docs.select(F.col(id_col).alias("_id"), _text_hash(text_col).alias("_sha"), F.xxhash64(whole_text(text_col)).alias("_hash"), F.col(text_col).alias("_t"))
    schema = given.selectExpr("_id", "_sha", "_hash", "0L fid", "0L n", "array(0L) fp").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fids, sizes, prints = [], [], []
            for t in batch.column(3):
                name, own = _shingle_set(t.as_py(), width, seed)
                fids.append(name)
                sizes.append(len(own))
                prints.append(_print_of(iter([own]), words).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(fids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))],
                ["_id", "_sha", "_hash", "fid", "n", "fp"]
            )
        give_back_memory()

    return given.mapInArrow(run, schema)


def _shingle_set(text: str | None, width: int, seed: int) -> tuple[int, np.ndarray]:
    """(name, sorted hashes) of the set of a text's shingles."""
    own = np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingle_hashes(text, width, seed)]))
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64)), own


def _sets(texts: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """(fid, shingles) of every text of the one column of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingle_set(t.as_py(), width, seed) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["fid", "shingles"])
        give_back_memory()

    return texts.mapInArrow(run, "fid long, shingles binary")


def _alike(docs: DataFrame, text_col: str, each: DataFrame, width: int, similarity: float) -> Exact:
    """Tests the names of ``each(fid, _hash)`` for a Jaccard similarity of ``similarity`` or more.

    Sets are made again from the texts that pairs ask for, as few are.
    """

    def reach(a: pa.Scalar, b: pa.Scalar) -> bool:
        a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
        if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= similarity * (len(a) + len(b) - both) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [reach(a, b) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        give_back_memory()

    def sets(asked: DataFrame) -> DataFrame:
        texts = each.join(sized(asked), each.fid == asked.f, "left_semi").groupBy("fid").agg(F.min("_hash").alias("h")).select("h").distinct()
        given = docs.select(F.col(text_col).alias("_t"), F.xxhash64(whole_text(text_col)).alias("_hash"))
        given = given.join(sized(written(texts, "near-texts")), F.col("_hash") == F.col("h"), "left_semi").select("_t")
        return written(_sets(given, width).groupBy("fid").agg(F.first("shingles").alias("s")), "near-sets")

    def pairs(asked: DataFrame) -> DataFrame:
        asked = written(asked, "near-pairs")
        if asked.isEmpty():
            return asked
        held = sets(written(asked.select(F.explode(F.array("u", "v")).alias("f")).distinct(), "near-asked"))
        for c in ("u", "v"):
            asked = asked.join(held.select(F.col("fid").alias(c), F.col("s").alias(f"s{c}")), c)
        return asked.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")

    return Exact(pairs, sets, reach)


def _index(rows: int, p: float, recall: float) -> tuple[int, int]:
    """(bits of a segment, number of segments) that find a pair whose bits differ with chance ``p``.

    Six bits more than the rows have keep the chance matches of a row few at any
    number of rows.
    """
    bits = max(24, math.ceil(math.log2(rows)) + 6)
    bits += bits % 2
    hit = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _segments(bits: int, n: int, total: int) -> list[tuple[int, int]]:
    """``n`` segments over ``total`` bits: side by side where there is room, else overlapping evenly."""
    last = min((n - 1) * bits, total - bits)
    return [(round(k * last / max(1, n - 1)), bits) for k in range(n)]


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8,
    recall: float = 0.99, slack: float = 3.0,
) -> DataFrame:
    """The rows of ``docs`` left when one row of each near-duplicate group stays.

    Word shingles of ``width`` words (a shorter text is one shingle), groups by
    Jaccard similarity of ``similarity`` or more, which is computed exactly from
    the sets of shingles.  Pairs to compute are found by fingerprints of one length
    and one distance bound, whatever the number of rows; only the index follows it:
    segments are six bits wider than the rows' log2 (24 at least), and there are as
    many as a pair at exactly ``similarity`` needs to be found with probability
    ``recall``; closer pairs are found more often.  A pair is a candidate up to
    ``slack`` standard deviations above the distance expected at ``similarity``.

    The row with the smallest id stays; a null id goes before others do.  Rows are
    told apart by id and text, so a row that shares its id (or has none) stays or
    goes by its own text; of rows that repeat both, one stays where the group keeps
    them.  Rows without words (null, empty or white space) are one group.  Very
    long texts are shingled whole, in pieces; an empty table gives an empty result.
    All columns of ``docs`` are returned as they are, whatever their names.
    """
    names = docs.columns
    spark = docs.sparkSession
    cosine = 2 * similarity / (1 + similarity)
    p = math.acos(cosine) / math.pi
    rows = max(2, docs.count())
    bits, n = _index(rows, p, recall)
    words = _NEAR_WORDS
    total = words * 64
    most = math.floor(total * p + slack * math.sqrt(total * p * (1 - p)))
    with scratch(spark) as keep:
        each = written(_shingled(docs, id_col, text_col, width, words), "near-fp")
        prints = written(each.groupBy("fid").agg(F.first("n").alias("n"), F.first("fp").alias("fp")), "near-prints")
        exactly = _alike(docs, text_col, each.select("fid", "_hash"), width, similarity)
        roots = linked(prints, _segments(bits, n, total), words, most, exactly=exactly, ratio=similarity)
        # One row for each id and text, so a hot text is counted before it moves.
        distinct = each.groupBy("_id", "_sha", "fid").agg(F.count(F.lit(1)).alias("times"))
        homes = written(distinct.join(roots, F.col("fid") == F.col("node"), "left").select("_id", "_sha", "times", F.coalesce("root", "fid").alias("root")), "near-homes")
        rank = F.struct(F.col("_id").isNull().alias("none"), "_id", "_sha")
        groups = homes.groupBy("root").agg(F.min(rank).alias("stays"), F.sum("times").alias("n")).where("n > 1")
        groups = written(groups.select(F.col("root").alias("_root"), "stays"), "near-groups")
        inside = homes.join(sized(groups), F.col("root") == F.col("_root")).withColumn("stay", F.col("_id").eqNullSafe(F.col("stays._id")) & (F.col("_sha") == F.col("stays._sha")))
        goes = written(inside.where("not stay").select("_id", "_sha"), "near-goes")
        # Rows that repeat id and text: keep one of them.
        again = written(inside.where("stay and times > 1").select("_id", "_sha"), "near-again")
        keep(goes, again)
    own, gid = unused(names, "_near_hash", "_near_id")
    hashed = docs.withColumn(own, _text_hash(text_col))
    match = lambda right: F.col(id_col).eqNullSafe(F.col(right.columns[0])) & (F.col(own) == F.col(right.columns[1]))
    apart = lambda df: sized(df).toDF(*unused(names, "_goes_id", "_goes_sha"))
    goes = apart(goes)
    left = hashed.join(goes, match(goes), "left_anti")
    if again.isEmpty():
        return left.select(*names)
    again = apart(again)
    single = left.join(again, match(again), "left_anti").select(*names)
    folded = left.join(again, match(again), "left_semi").groupBy(F.col(id_col).alias(gid), own).agg(
        *[F.first(c).alias(c) for c in names if c != id_col]
    )
    return single.unionByName(folded.withColumnRenamed(gid, id_col).select(*names))

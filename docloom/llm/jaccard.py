"""Exact set-similarity join: all pairs of sets whose Jaccard similarity reaches 4/5, as links.

Prefix filter (Chaudhuri et al., 2006): with the numbers of every set in one global order, two sets that
reach the similarity share a number among the first n - ceil(4n/5) + 1 of each. At the first number
that they share, what is left of both must still suffice (positional filter, Xiao et al., 2008). No
similar pair is lost. Candidates whose parities, a bit a number, already differ in more places than
similar sets may are dropped; each of the others is decided by its whole sets.

Order and skew: numbers that many sets hold come last. How many hold them is estimated in a table of
fixed width, which changes the work but not the pairs. Links that are known beforehand, such as those
of fingerprints, spare their components. Then each row meets its neighbours by size in its group; then
only rows of different components still meet, in blocks of bounded size, with their parities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, resident
from .vectors import by_group, group_starts

#: Members of a chunk; a block has at most about twice as many.
CHUNK = 2048
#: Neighbours in a group that a row meets before components are known.
WINDOW = 8
#: Bits of the parities that go into blocks with a row.
SKETCH = 1024
#: Pairs whose sketches are compared at once.
SLICE = 1 << 14
#: Bits of a number that choose its place in the table of counts.
TABLE_BITS = 16
#: Sets above the usual that make the numbers of a place common; each doubling is a level more.
COMMON = 256


def numbers(raw: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, as sorted distinct numbers, have a Jaccard similarity of at least 4/5; empty sets are equal."""
    if min(len(x), len(y)) * 5 < max(len(x), len(y)) * 4:
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 5 * shared >= 4 * (len(both) - shared)


def common_levels(sets: DataFrame) -> np.ndarray:
    """For each place of the table, how common its numbers are: 0 for most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << TABLE_BITS, np.int64)
        for batch in batches:
            for start in range(0, len(batch), 256):
                flat = np.concatenate([numbers(r.as_buffer()) for r in batch.column(0).slice(start, 256)])
                count += np.bincount((flat >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used])], ["place", "n"])

    rows = sets.select("hashes").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(1 << TABLE_BITS)
    count[[r.place for r in rows]] = [r.n for r in rows]
    usual = np.median(count)
    excess = np.maximum(count - usual - 8 * np.sqrt(usual), 0)
    return np.ceil(np.log2(np.maximum(excess / COMMON, 1))).astype(np.uint8)


def prefixes(sets: DataFrame, levels: np.ndarray) -> DataFrame:
    """``key, row, part, n, pos, common``: the numbers of the prefix of each of ``sets(row, part, hashes)`` with the set's size and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            names, parts = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for start in range(0, len(batch), 256):
                keys, sizes = [], []
                for raw in batch.column(2).slice(start, 256):
                    own = numbers(raw.as_buffer())
                    level = levels[(own >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                    take = len(own) - (4 * len(own) + 4) // 5 + 1 if len(own) else 0
                    keys.append(own[np.argsort(level, kind="stable")[:take]])
                    sizes.append(len(own))
                takes = np.array([len(k) for k in keys], np.int64)
                flat = np.concatenate(keys)
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(takes) - takes, takes)
                common = levels[(flat >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] > 0
                arrays = [flat.view(np.int64), *(np.repeat(x[start : start + 256], takes) for x in (names, parts)), np.repeat(np.array(sizes, np.int32), takes), pos.astype(np.int32), common]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "row", "part", "n", "pos", "common"])

    return sets.select("row", "part", "hashes").mapInArrow(run, "key long, row long, part long, n int, pos int, common boolean")


def _candidates(window: int | None):
    """Distinct pairs of a block that the filters leave, as (a, b); with a window also (key, null) of groups that exceed it.

    Where rows bring sketches, pairs that these rule out end in the block: rows of different sets that share common
    numbers cost comparisons, but make no rows.
    """

    def handle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        resident()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(rows), -1) if "sketch" in rows.column_names else None
        n, pos, row, side, part = (rows.column(c).to_numpy() for c in ("n", "pos", "row", "side", "part"))
        starts = group_starts(rows, ["key", "block"])
        sizes = np.diff(starts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        left, live, d, found = n - pos, np.arange(len(rows)), 0, []
        while window is None or d < window:
            d += 1
            live = live[live < len(rows) - d]
            live = live[(group[live] == group[live + d]) & (5 * n[live] >= 4 * n[live + d])]
            if not len(live):
                break
            i, j = live, live + d
            ok = 9 * np.minimum(left[i], left[j]) >= 4 * (n[i] + n[j])
            ok &= (part[i] != part[j]) & ((side[i] != side[j]) | (side[i] == 2)) & (row[i] != row[j])
            if sketch is not None:
                at = np.flatnonzero(ok)
                for some in (at[k : k + SLICE] for k in range(0, len(at), SLICE)):
                    x, y = i[some], j[some]
                    ok[some] = 9 * np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= n[x].astype(np.int64) + n[y]
            found.append(np.stack([np.minimum(row[i[ok]], row[j[ok]]), np.maximum(row[i[ok]], row[j[ok]])], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        if window is not None:
            wide = np.unique(rows.column("key").to_numpy()[starts[:-1][sizes > window + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(wide), pa.nulls(len(wide), pa.int64())], ["a", "b"])

    return by_group(["key", "block"], handle)


def _meet(rows: DataFrame, window: int | None) -> DataFrame:
    brought = [c for c in rows.columns if c == "sketch"]
    rows = rows.select("key", "block", "n", "row", "pos", "side", "part", *brought).repartition("key", "block").sortWithinPartitions("key", "block", "n", "row")
    return rows.mapInArrow(_candidates(window), "a long, b long")


def parity(own: np.ndarray, width: int | None = None) -> bytes:
    """For each value of the low bits, whether an odd number of the set's numbers has it; about one bit a number, or ``width`` bits."""
    width = width or (max(64, 1 << int(len(own) - 1).bit_length()) if len(own) else 64)
    return np.packbits(np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def may_be_similar(x: bytes, n: int, y: bytes, m: int) -> bool:
    """False only if sets of n and m numbers with these parities differ in more numbers than similar sets may."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(p) > len(q):
        p, q = q, p
    q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)
    return 9 * int(np.bitwise_count(p ^ q).sum()) <= n + m


def _ends(pairs: DataFrame, rows: DataFrame, *names: str) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("row").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in names]), end)
    return pairs.select("a", "b", *[f"{end}_{c}" for end in ("a", "b") for c in names])


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose ``sets(row, hashes)`` are similar. Only the sets that a pair has are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            fine = [similar(numbers(x[k].as_buffer()), numbers(y[k].as_buffer())) for k in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "jaccard-rows")
    used = materialize(sets.join(ids, "row", "left_semi").select("row", "hashes"), "jaccard-used")
    found = materialize(_ends(pairs, used, "hashes").mapInArrow(run, "a long, b long"), "jaccard-links")
    discard(ids, used)
    return found


def verified(pairs: DataFrame, sets: DataFrame, sketches: DataFrame) -> DataFrame:
    """The distinct ``pairs(a, b)`` whose ``sets(row, hashes)`` are similar; only what the parities leave is read."""

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(2, 6)]
            yield batch.select(["a", "b"]).filter(pa.array([may_be_similar(*v) for v in zip(*cols, strict=True)], pa.bool_()))

    left = materialize(_ends(pairs, sketches, "bits", "n").mapInArrow(leave, "a long, b long"), "jaccard-left")
    found = similar_pairs(left, sets)
    discard(left)
    return found


def sketched(sets: DataFrame) -> DataFrame:
    """``row, n, bits, sketch``: size and parities of each set, and these in SKETCH bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [numbers(r.as_buffer()) for r in batch.column(1)]
            sizes = [len(r) for r in raws]
            arrays = [pa.array(sizes, pa.int32()), pa.array(map(parity, raws), pa.binary()), pa.array([parity(r, SKETCH) for r in raws], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", "n", "bits", "sketch"])

    return sets.select("row", "hashes").mapInArrow(run, "row long, n int, bits binary, sketch binary")


def similar_links(sets: DataFrame, copies: DataFrame, known: DataFrame, chunk: int = CHUNK, window: int = WINDOW) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs among the rows that ``copies(row)`` does not list.

    ``sets(row, hashes)`` holds each row's sorted distinct numbers (little-endian unsigned 64-bit). The
    rows not listed have different sets; those listed only count for the order of the numbers.
    ``known(a, b)`` are links of similar pairs that were found already; they come out with the others.
    """
    parts = connected_components(known, "jaccard-known").select(F.col("node").alias("row"), "component")
    distinct = sets.join(copies, "row", "left_anti").join(parts, "row", "left")
    rows = materialize(prefixes(distinct.select("row", F.coalesce("component", "row").alias("part"), "hashes"), common_levels(sets)), "jaccard-prefixes")
    sketches = materialize(sketched(sets), "jaccard-sketches")
    wide = rows.where("common").groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > chunk)
    wide = materialize(wide.select(F.col("key").alias("__key"), F.ceil(F.col("members") / chunk).cast("int").alias("chunks")), "jaccard-wide")
    mine = F.coalesce(F.pmod(F.xxhash64("row"), F.col("chunks").cast("long")).cast("int"), F.lit(0))
    cut = rows.join(wide, F.col("key") == F.col("__key"), "left").withColumn("mine", mine)
    first = cut.withColumns({"block": F.col("mine").cast("long"), "side": F.lit(2)})
    met = materialize(_meet(first, window), "jaccard-met")
    tried = materialize(met.where("b is not null").distinct(), "jaccard-pairs")
    links = known.unionByName(verified(tried, sets, sketches))
    more = met.where("b is null").select("a").unionByName(wide.select(F.col("__key").alias("a"))).distinct()
    more = materialize(more, "jaccard-more")
    if more.isEmpty():
        discard(rows, sketches, wide, met, tried, more)
        return links
    parts = connected_components(links, "jaccard-parts")
    rest = cut.drop("part").join(more, F.col("key") == F.col("a"), "left_semi").join(parts, F.col("row") == F.col("node"), "left").join(sketches.select("row", "sketch"), "row")
    rest = held = materialize(rest.select("key", "row", "n", "pos", "mine", "chunks", "sketch", F.coalesce("component", "row").alias("part")), "jaccard-rest")
    mixed = rest.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    rest = rest.join(mixed, "key", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int"))
    block = F.least("mine", "other").cast("long") * (1 << 31) + F.greatest("mine", "other")
    pairs = _meet(rest.withColumns({"block": block, "side": side}), None).distinct().join(tried, ["a", "b"], "left_anti")
    pairs = materialize(pairs, "jaccard-pairs")
    links = links.unionByName(verified(pairs, sets, sketches))
    discard(rows, sketches, wide, met, tried, more, held, pairs)
    return links

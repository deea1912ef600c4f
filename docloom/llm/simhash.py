"""SimHash near-dedup with pigeonring filtering.

Fingerprint: each word shingle votes with the bits of its XXH64; a bit is 1 if more than half the
shingles, repeats included, have it.

Search: the fingerprint is a ring of m segments. If two fingerprints differ in at most t bits, some
segment starts a chain whose first l segments differ in at most l*t/m bits, for every l (Qin and Xiao,
"Pigeonring", 2018). With t < m the first segment of that chain is equal, which gives the index key
(segment number, value). Where a key has many members, the chain's next segment goes into the key as
well, with the bits that the chain's budget lets differ, so a large bucket splits into many small
ones, again and again. Pairs within a bucket must then pass every prefix of the chain before the full
Hamming check.

Skew: equal fingerprints are one member. A bucket that is still large is cut into chunks, and each
pair of chunks is a block of bounded size, so no task holds a bucket. A block returns a spanning
forest of its links, not the links: components stay exactly the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import connected_components, discard, materialize, resident
from .jaccard import similar_links, similar_pairs

BITS = 64
#: Members of a chunk; a block has at most about twice as many.
CHUNK = 2048
#: Rows that a task gathers before it looks for pairs.
GATHER = 65_536


def _lane_table() -> np.ndarray:
    """For each byte, a word of eight 8-bit lanes with the byte's bits: sums of up to 255 words count bits."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


LANES = _lane_table()
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> list[int]:
    """XXH64 of each space-joined run of ``width`` words; of the whole sequence if it has fewer words."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes | None], width: int) -> np.ndarray:
    """The fingerprints of the texts as unsigned 64-bit integers; zero for a text without words."""
    return prints_of([np.array(shingle_hashes(t or b"", width), "<u8") for t in texts])


def prints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of texts whose shingles have these hashes, repeats included."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    flat = np.concatenate([hashes[i] for i in full])
    starts = np.cumsum(sizes) - sizes
    blocks = -(-sizes // 255)
    owner = np.repeat(np.arange(len(full)), blocks)
    first = np.cumsum(blocks) - blocks
    at = starts[owner] + 255 * (np.arange(len(owner)) - first[owner])
    lanes = np.add.reduceat(LANES[flat.view(np.uint8).reshape(-1, 8)], at, axis=0)
    votes = np.add.reduceat(lanes.view(np.uint8).reshape(len(owner), BITS).astype(np.int64), first, axis=0)
    out[full] = np.packbits(2 * votes > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_documents(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` for each row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            parts, size, k = [], 0, 0
            for i, t in enumerate(texts):  # long texts are fingerprinted a few at a time
                size += len(t or b"")
                if size > 4 << 20 or i + 1 == len(texts):
                    parts.append(fingerprints(texts[k : i + 1], width))
                    size, k = 0, i + 1
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments of 64 bits, as even as can be, first to last."""
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest node that the links (a, b) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label[a], label[b]):
            return label


def chain_forest(fp: np.ndarray, group: np.ndarray, start: np.ndarray, role: np.ndarray, side: np.ndarray, m: int, t: int) -> np.ndarray:
    """For each row the first row that it is connected with by pairs of one group that pass the chain from the group's segment and the Hamming check.

    Rows lie group by group. Role 1 marks rows in their own bucket, 0 rows that probe it; two probing
    rows are no pair. In a block of two chunks (sides 0 and 1) rows of one side are no pair; side 2
    marks a chunk with itself. Pairs are folded into the forest as they are found, and rows that it
    connects already are not compared.
    """
    parts = segments(m)
    shifts, masks = np.array([s for s, _ in parts], np.uint64), np.array([(1 << w) - 1 for _, w in parts], np.uint64)
    budget = [t * (k + 1) // m for k in range(m)]
    label, live, d = np.arange(len(fp)), np.arange(len(fp)), 0
    while True:
        d += 1
        live = live[live < len(fp) - d]
        live = live[group[live] == group[live + d]]
        if not len(live):
            return label
        i, j = live, live + d
        ok = ((role[i] | role[j]) & ((side[i] != side[j]) | (side[i] == 2))) > 0
        ok &= label[i] != label[j]
        i, j = i[ok], j[ok]
        x, seen = fp[i] ^ fp[j], np.zeros(len(i), np.int64)
        for k in range(1, m):  # the first link is equal: it is in the key
            at = (start[i] + k) % m
            seen = seen + np.bitwise_count((x >> shifts[at]) & masks[at])
            keep = seen <= budget[k]
            i, j, x, seen = i[keep], j[keep], x[keep], seen[keep]
        if len(i):
            label = forest(len(fp), label[i], label[j])[label]


def _block_links(m: int, t: int):
    """Spanning forests of the links in each block; the rows of a block follow each other."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        col = {n: rows.column(n).to_numpy() for n in rows.column_names}
        new = np.ones(len(rows), bool)
        new[1:] = (col["key"][1:] != col["key"][:-1]) | (col["block"][1:] != col["block"][:-1])
        label = chain_forest(col["fp"].view(np.uint64), np.cumsum(new), col["start"], col["role"], col["side"], m, t)
        child = np.flatnonzero(label != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(col["rep"][label[child]]), pa.array(col["rep"][child])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < GATHER:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key, block = rows.column("key").to_numpy(), rows.column("block").to_numpy()
            last = np.flatnonzero((key != key[-1]) | (block != block[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield solve(rows.slice(0, cut))
            held, n = rows.slice(cut).to_batches(), len(rows) - cut
        if n:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def near_links(members: DataFrame, max_bits: int = 3, n_segments: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``members(fp, rep)`` within ``max_bits``.

    ``members`` has distinct fingerprints. ``max_bits`` must be below ``n_segments``. A key with more than
    ``chunk`` members takes the next link of the chain in, until it has about 32 bits; members whose next
    segment differs within the chain's budget join as probes. What is still large becomes blocks.
    """
    if max_bits >= n_segments:
        raise ValueError("max_bits must be below n_segments: the first segment of a chain has to be equal")
    parts = segments(n_segments)

    def value(link: int) -> Column:
        """Of the chain that begins at ``start``, the segment after ``link`` others."""
        each = [F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in parts]
        return F.element_at(F.array(*[each[(s + link) % n_segments] for s in range(n_segments)]), F.col("start") + 1)

    def longer(rows: DataFrame, link: int) -> DataFrame:
        budget, widest = max_bits * (link + 1) // n_segments, max(w for _, w in parts)
        flips = [(sum(1 << b for b in bits), k) for k in range(budget + 1) for bits in combinations(range(widest), k)]
        fits = F.element_at(F.array(*[F.lit(1 << parts[(s + link) % n_segments][1]).cast("long") for s in range(n_segments)]), F.col("start") + 1)
        tries = F.array(*[F.struct(F.lit(mask).cast("long").alias("mask"), F.lit(k).alias("n")) for mask, k in flips])
        rows = rows.withColumns({"next": value(link), "fits": fits, "try": tries})
        allowed = F.filter("try", lambda f: (f["mask"] < F.col("fits")) & (f["n"] + F.col("used") <= budget))
        rows = rows.select("fp", "rep", "start", "key", "used", "next", F.explode(allowed).alias("f"))
        return rows.select("fp", "rep", "start", F.xxhash64("key", F.col("next").bitwiseXOR(F.col("f.mask"))).alias("key"), (F.col("used") + F.col("f.n")).alias("used"))

    rows = members.select("fp", "rep", F.explode(F.array(*map(F.lit, range(n_segments)))).alias("start"))
    rows = rows.select("fp", "rep", "start", (F.col("start").cast("long") * F.lit(1 << 33) + value(0)).alias("key"), F.lit(0).alias("used"))
    links, groups = max(1, 32 // max(w for _, w in parts)), []
    for link in range(1, links + 1):
        large = rows.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).where("chunks > 1")
        large = materialize(large, "simhash-large")
        if large.isEmpty():
            groups.append(rows.withColumn("chunks", F.lit(1)))
            break
        sized = materialize(rows.join(large, "key", "left").select(*rows.columns, F.coalesce("chunks", F.lit(1)).alias("chunks")), "simhash-keys")
        if link == links:
            groups.append(sized)
            break
        groups.append(sized.where("chunks = 1"))
        rows = longer(sized.where("chunks > 1").drop("chunks"), link)
        rows = materialize(rows, "simhash-longer")
    blocks = reduce(DataFrame.unionByName, groups).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("chunks").cast("long")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int"))
    block = F.least("mine", "other").cast("long") * (1 << 31) + F.greatest("mine", "other")
    blocks = blocks.select("key", block.alias("block"), "start", (F.col("used") == 0).cast("int").alias("role"), side.alias("side"), "fp", "rep")
    blocks = blocks.repartition("key", "block").sortWithinPartitions("key", "block", "rep")
    return blocks.mapInArrow(_block_links(n_segments, max_bits), "a long, b long")


def group_near_duplicates(
    docs: DataFrame, width: int = 3, max_bits: int = 3, n_segments: int = 4, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id`` (smallest id reachable over links, itself included).

    Null and blank texts have fingerprint zero, which links like any other. Rows that share an id are
    one node; each row keeps its fingerprint and all their links count. Rows with a null id get their
    fingerprint and the component of the rows that have the same one, null if none has an id, and
    connect nothing. Very long texts are fingerprinted whole. An empty table gives an empty result. Other
    columns of ``docs`` are not looked at.
    """
    prints = materialize(fingerprint_documents(docs, width, id_col, text_col), "simhash-prints")
    members = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("__top"))
    members = materialize(members, "simhash-members")
    links = near_links(members.select("fp", "rep"), max_bits, n_segments, chunk)
    repeated = prints.where("doc_id is not null").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    twice = prints.join(repeated.select("doc_id"), "doc_id").distinct().join(members.select("fp", "rep"), "fp")
    links = links.unionByName(twice.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    parts = connected_components(links, "simhash-links")
    named = members.select("fp", "rep").join(parts, members["rep"] == parts["node"], "left")
    named = named.select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, fp, hashes`` for each row: its distinct shingle hashes in order, 8 bytes each, their XXH3, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in slices(sizes, 1 << 20):  # sets are larger than texts
                part = batch.slice(a, b - a)
                hashes = [np.array(shingle_hashes(t or b"", width), "<u8") for t in part.column(1).cast(pa.binary()).to_pylist()]
                fp = prints_of(hashes)
                sets = [np.unique(h).tobytes() for h in hashes]
                digests = [xxhash.xxh3_128_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(fp.view(np.int64)), pa.array(sets, pa.binary())], ["doc_id", "digest", "fp", "hashes"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary, fp long, hashes binary")


def keep_first(docs: DataFrame, width: int = 5, max_bits: int = 7, n_segments: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that with the group's smallest id.

    Near duplicates are texts whose shingle sets have a Jaccard similarity of at least 0.8, and groups
    are their components. Fingerprints within ``max_bits`` propose pairs by pigeonring filtering, and the
    sets decide; what is similar but further apart in bits is found by the join of ``similar_links``, so
    no pair is lost. Null and blank texts have the empty set, which equals itself. Of rows that share an
    id one with the smallest text stays, null texts before others. Rows with a null id are in no group
    and stay. Very long texts are compared whole. An empty table gives an empty result.
    """
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # whatever the columns are called
    doc, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    sets = shingle_sets(rows.select(doc.alias("doc_id"), text.alias("text")).where("doc_id is not null"), width)
    sets = materialize(sets.withColumn("row", F.monotonically_increasing_id()), "shingle-sets")
    members = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.min("fp").alias("fp"))
    members = materialize(members, "shingle-members")
    copies = materialize(sets.select("row").join(members.select("row"), "row", "left_anti"), "shingle-copies")
    prints = materialize(members.groupBy("fp").agg(F.min("row").alias("rep")), "shingle-prints")
    near = near_links(prints, max_bits, n_segments)
    same = members.select("fp", F.col("row").alias("b")).join(prints.select("fp", F.col("rep").alias("a")), "fp").where("a != b").select("a", "b")
    near = materialize(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same).distinct(), "shingle-near")
    links = similar_links(sets.select("row", "hashes"), copies, similar_pairs(near, sets.select("row", "hashes")))
    for end in ("a", "b"):
        names = members.select(F.col("row").alias(end), F.col("rep").alias(f"__{end}"))
        links = links.join(names, end).drop(end).withColumnRenamed(f"__{end}", end)
    named = sets.select("doc_id", "digest").join(members.select("digest", "rep"), "digest")
    named = materialize(named.select("doc_id", "rep"), "shingle-names")
    links = links.unionByName(named.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    parts = connected_components(links, "shingle-links")
    discard(sets, members, copies, prints, near)
    gone = parts.where("node != component").select("node")
    kept = rows.join(gone, doc == F.col("node"), "left_anti")
    twice = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("twice"))
    twice = materialize(twice, "simhash-twice")
    if twice.isEmpty():
        return kept.toDF(*docs.columns)
    order = F.struct(text.isNotNull(), text)
    one = kept.join(twice, doc == F.col("twice"), "left_semi").groupBy(doc.alias("id")).agg(F.min_by(F.struct(*rows.columns), order).alias("row"))
    return kept.join(twice, doc == F.col("twice"), "left_anti").unionByName(one.select("row.*")).toDF(*docs.columns)

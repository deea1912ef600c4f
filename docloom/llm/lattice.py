"""Embedding near-dedup by E8 lattice hashing.

Each table projects unit vectors to eight random directions and decodes the result to the nearest point
of the E8 lattice: the vector's home cell. A vector also probes the lattice points around its home that
are nearest to it. Two vectors meet where one's home is the other's home or probe, and every meeting is
verified by cosine in double precision.

Nothing is lost or done twice: equal vectors are one member with a count. A pair that meets in several
tables or cells is counted at the first of them only, which both cells' tasks can tell because homes
and probes are computed in exact integer arithmetic. Counts and spanning forests leave a task, not
pairs. A cell with many members is cut into chunks whose pairs are blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .simhash import forest
from .vectors import binary, by_group, group_starts, matrix, valid, vector_rows

#: Members of a chunk; a block has at most about twice as many.
CHUNK = 2048
_GRID = float(1 << 20)


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled to integers."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [list(v) for v in product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out, float)


ROOTS = e8_roots()


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(y)
    rest = y - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(rest[odd]).argmax(1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode_e8(y: np.ndarray) -> np.ndarray:
    """The nearest E8 points, doubled to integers: even-sum integers, or those moved by a half."""
    whole, half = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half) * 2


@dataclass(frozen=True)
class Lattice:
    """``tables`` projections of vectors of ``dim`` numbers; larger ``scale``: smaller cells.

    ``scale`` is that of 64 numbers and more. Of fewer, eight directions keep a larger part of a
    distance, so cells grow with it.
    """

    dim: int
    tables: int
    scale: float
    probes: int
    seed: int = 3

    @property
    def directions(self) -> np.ndarray:
        return _directions(self.dim, self.tables, self.seed)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Cell keys of unit vectors, shape (n, tables, 1 + probes): the home, then the probes.

        Vectors and directions are rounded to a grid, so products and sums are exact and the keys do not
        depend on which other rows are computed with them.
        """
        fixed = np.rint(unit * _GRID)
        scale = self.scale * min(1.0, np.sqrt(max(self.dim, 8) / 64))
        out = np.empty((len(unit), self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            y = (fixed @ self.directions[t]) * (scale / _GRID**2)
            home = decode_e8(y)
            toward = np.rint((y - home / 2) * _GRID) @ ROOTS.T * len(ROOTS) - np.arange(len(ROOTS))
            best = np.argsort(-toward, axis=1)[:, : self.probes]
            cells = np.concatenate([home[:, None], home[:, None] + ROOTS[best]], axis=1)
            packed = np.ascontiguousarray((cells + 128).astype(np.uint8)).view("<u8")[:, :, 0]
            mixed = (packed + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(32)) ^ np.uint64(self.dim)) * np.uint64(0xD6E8FEB86659FD93)
            out[:, t] = mixed.view(np.int64)
        return out


@lru_cache(maxsize=8)
def _directions(dim: int, tables: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, dim])
    found: list[np.ndarray] = []
    while len(found) < tables:
        q = np.linalg.qr(rng.standard_normal((max(dim, 8), max(dim, 8))))[0][:dim]
        found += [np.rint(q[:, 8 * k : 8 * k + 8] * _GRID) for k in range(q.shape[1] // 8)]
    return np.array(found[:tables])


def parameters(n: int) -> dict:
    """Scale, tables and probes that suit n vectors: smaller cells for more vectors, more tables to make up for them.

    All miss a pair at cosine 0.95 in all tables with a probability of about 0.0001 (measured on random
    directions of 8 to 64 numbers); they differ in the work alone. ``near_vectors`` takes what it is given.
    """
    if n <= 200_000:
        return {"scale": 5.0, "tables": 5, "probes": 4}
    if n <= 20_000_000:
        return {"scale": 7.0, "tables": 6, "probes": 8}
    return {"scale": 10.0, "tables": 12, "probes": 16}


#: Settings that ``near_vectors`` takes if none are given, whatever the table's size.
SETTINGS = parameters(0)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _cells(settings: dict, with_vectors: bool):
    """Each vector's rows: one for its home in each table (role 1) and one for each probe (role 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for start in range(0, len(part), 2048):
                    rows = part.slice(start, 2048)
                    unit = _unit(matrix(rows.column("embedding"), dim))
                    lattice = Lattice(dim, **settings)
                    keys = lattice.keys(unit)
                    each = keys.shape[1] * keys.shape[2]
                    at = np.repeat(np.arange(len(rows)), each)
                    arrays = [pa.array(keys.ravel()), pa.array(np.asarray(rows.column("rep"))[at])]
                    if with_vectors:
                        role = np.tile(np.arange(keys.shape[2]) == 0, len(rows) * keys.shape[1]).astype(np.int32)
                        table = np.tile(np.repeat(np.arange(keys.shape[1], dtype=np.int32), keys.shape[2]), len(rows))
                        arrays += [pa.array(np.asarray(rows.column("copies"))[at]), pa.array(role), pa.array(table), binary(unit).take(pa.array(at))]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "rep", "copies", "role", "turn", "unit"][: len(arrays)])

    return run


def _first_meeting(lattice: Lattice, unit: np.ndarray, x: np.ndarray, y: np.ndarray, table: int, key: int) -> np.ndarray:
    """Whether this cell of this table is the first where x and y (places in ``unit``, x the smaller id) meet."""
    used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    keys = lattice.keys(unit[used])
    x, y = at[: len(x)], at[len(x) :]
    first = np.ones(len(x), bool)
    for t in range(table + 1):
        home_x, home_y = keys[x, t, 0], keys[y, t, 0]
        at_x = (keys[y, t] == home_x[:, None]).any(1)
        at_y = (keys[x, t] == home_y[:, None]).any(1)
        first &= ~(at_x | at_y) if t < table else np.where(at_x, home_x == key, home_y == key)
    return first


def _links(settings: dict, threshold: float):
    """From blocks of cells: (id, links, null) with the links counted here, and (id, null, other) spanning their components."""

    def handle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, table, role, side, rep, copies = (rows.column(c).to_numpy() for c in ("key", "turn", "role", "side", "rep", "copies"))
        units = rows.column("unit").combine_chunks()
        ids, counts, roots, children = [], [], [], []
        starts = group_starts(rows, ["key", "block"])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            unit = matrix(units.slice(a, b - a), len(units[a].as_py()) // 8)
            lattice = Lattice(unit.shape[1], **settings)
            homes = np.flatnonzero(role[a:b])
            found_i, found_j = [], []
            for s in range(0, len(homes), 256):
                some = homes[s : s + 256]
                i, j = np.nonzero(unit[some] @ unit.T >= threshold)
                i = some[i]
                fine = (rep[a + i] != rep[a + j]) & ((side[a + i] != side[a + j]) | (side[a + i] == 2))
                fine &= (role[a + j] == 0) | (rep[a + i] < rep[a + j])
                found_i.append(i[fine])
                found_j.append(j[fine])
            i, j = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_i, found_j))
            if not len(i):
                continue
            small = np.where(rep[a + i] < rep[a + j], i, j)
            x, y = small, i + j - small
            first = np.concatenate([_first_meeting(lattice, unit, x[k : k + 65_536], y[k : k + 65_536], int(table[a]), int(key[a])) for k in range(0, len(x), 65_536)])
            n = np.bincount(x[first], copies[a + y[first]], b - a) + np.bincount(y[first], copies[a + x[first]], b - a)
            some = np.flatnonzero(n)
            ids.append(rep[a + some])
            counts.append(n[some].astype(np.int64))
            names, at = np.unique(np.concatenate([rep[a + x], rep[a + y]]), return_inverse=True)
            label = forest(len(names), at[: len(x)], at[len(x) :])
            child = np.flatnonzero(label != np.arange(len(names)))
            roots.append(names[label[child]])
            children.append(names[child])
        if ids:
            counted, linked = np.concatenate(ids), np.concatenate(roots)
            kind = np.repeat([True, False], [len(counted), len(linked)])
            second = np.concatenate([*counts, *children])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([counted, linked])), pa.array(second, mask=~kind), pa.array(second, mask=kind)], ["id", "links", "other"]
            )

    return by_group(["key", "block"], handle)


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, settings: dict | None = None, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other vectors within the threshold, ``component_id`` is the smallest id
    reachable over links, itself included, and ``kept`` tells whether that is the id itself. Vectors that
    are null, zero or hold null or non-finite components link with nothing; vectors of different lengths
    do not link. Rows with a null id are left out; rows that repeat id and vector are one; an id with
    several vectors has a row for each, and all their links connect it. An empty table gives an empty
    result. Other columns are not looked at. ``settings`` are those of ``parameters``.
    """
    settings = settings or SETTINGS
    sides = {f"h{k}": F.xxhash64(F.lit(k), "embedding") for k in (1, 2)}  # 128 bits stand for the vector where it is a key
    rows = vector_rows(vectors, id_col, vector_col).withColumns(sides | {"fine": valid()}).dropDuplicates(["vec_id", *sides])
    rows = materialize(rows, "lattice-vectors")
    members = rows.where("fine").groupBy(*sides).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    members = materialize(members.withColumn("dim", F.size("embedding")), "lattice-members")
    schema = "key long, rep long"
    wide = members.mapInArrow(_cells(settings, False), schema).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    wide = materialize(wide.select(F.col("key").alias("__key"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "lattice-wide")
    cells = members.mapInArrow(_cells(settings, True), schema + ", copies long, role int, turn int, unit binary")
    cells = cells.join(wide, F.col("key") == F.col("__key"), "left")
    mine = F.coalesce(F.pmod(F.xxhash64("rep"), F.col("chunks").cast("long")).cast("int"), F.lit(0))
    cells = cells.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int"))
    block = F.least("mine", "other").cast("long") * (1 << 31) + F.greatest("mine", "other")
    cells = cells.select("key", block.alias("block"), "rep", "copies", "role", "turn", side.alias("side"), "unit")
    cells = cells.repartition("key", "block").sortWithinPartitions("key", "block", "rep")
    found = materialize(cells.mapInArrow(_links(settings, threshold), "id long, links long, other long"), "lattice-links")
    counts = found.where("links is not null").groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    links = found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    ids = rows.where("fine").select("vec_id", *sides)
    several = ids.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    several = ids.join(several, "vec_id").join(members.select(*sides, "rep"), [*sides]).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    parts = connected_components(links.unionByName(several), "lattice-edges")
    named = members.select("rep", "copies", *sides).join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    named = named.select(*sides, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("fine"))
    out = rows.select("vec_id", "fine", *sides).join(named, ["fine", *sides], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))

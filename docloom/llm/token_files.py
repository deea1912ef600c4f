"""Token ids in binary segments: frequency-ranked ids, byte-aligned lengths, separate control bytes.

Ids are replaced by their rank in the corpus (0: most frequent), so most take one byte. Each rank takes
1 to 4 little-endian bytes; four 2-bit lengths make a control byte, and control and data bytes lie in
two streams. A reader looks a control byte up in a table to get four lengths and offsets at once.

A dataset is a Parquet folder whose rows are segments in ascending document order: Spark's committer
makes the write safe when executors are lost and works with any store. Column ``payload`` is the
segment: a header (magic, version, documents, ids, control bytes, data bytes as little-endian
unsigned 32-bit integers), the ids per document (unsigned 32-bit), the control bytes and the data bytes.
The folder ``_order`` in it holds the ids by rank, a row per ``RANKS`` ids; Spark's readers of the segments skip it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..scratch import scratch_path
from .bpe import Words, encoded
from .common import prefix_offsets, resident

MAGIC, VERSION = 0x54464C44, 1
HEADER = np.dtype([(n, "<u4") for n in ("magic", "version", "documents", "ids", "control", "data")])
#: Words that a Python worker remembers at most: asking the library again costs more than memory.
WORDS = 500_000
#: Bytes of text that are cut into words at a time.
SLICE_BYTES = 4 << 20
#: Ids that a segment holds at least, unless the partition ends.
SEGMENT_IDS = 1 << 20
#: Ids in a row of the table of ranks.
RANKS = 1 << 16
SEGMENTS = "part long, seq long, n_ids long, doc_ids array<long>, payload binary"
#: Table: the four lengths that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3) + 1
TOTALS = LENGTHS.sum(1)
#: Table: where each of its four numbers starts within a control byte's data.
STARTS = np.cumsum(LENGTHS, axis=1) - LENGTHS


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks; missing numbers of the last byte are zeros."""
    wide = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    wide[: len(ranks)] = ranks
    size = 1 + (wide > 0xFF).astype(np.uint8) + (wide > 0xFFFF) + (wide > 0xFFFFFF)
    quads = size.reshape(-1, 4) - 1
    control = (quads << np.arange(0, 8, 2, dtype=np.uint8)).sum(1).astype(np.uint8)
    data = wide.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks that ``pack`` was given."""
    base = np.cumsum(TOTALS[control]) - TOTALS[control]
    at = (base[:, None] + STARTS[control]).ravel()[:n]
    size = LENGTHS[control].ravel()[:n]
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class LibraryEncoder:
    """New words in bulk through the tokenizers library.

    Lower-case words of Latin letters go to the library joined by spaces; each ends at a token with the
    word-end suffix. What else there is goes to it one by one.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.dtype, self.size = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4"), size
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def find(self, parts: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        letters, rest = [p for p in parts if p.isalpha()], [p for p in parts if not p.isalpha()]
        groups = [letters[i : i + 500] for i in range(0, len(letters), 500)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.dtype)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(stops) != len(group):
                rest += group
                continue
            raw, stops = ids.tobytes(), stops.tolist()
            out.update(zip(group, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
        for part, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[part] = np.array(got.ids, self.dtype).tobytes()
        return [out[p] for p in parts]


def library(path: str) -> tuple[LibraryEncoder, Words]:
    """One tokenizer and memory of words per Python worker."""

    def make() -> tuple[LibraryEncoder, Words]:
        encoder = LibraryEncoder(path)
        return encoder, Words(encoder.find, encoder.added, WORDS)

    return resident(("library", path), make)


def binary_rows(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of one array, which end at ``ends``, as binary values."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (binary, little-endian, 16-bit where the vocabulary allows) with ``end_id`` after each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words = library(path)
        for batch in batches:
            at = 0
            for ids, ends in encoded(batch.column(1), words, encoder.dtype, SLICE_BYTES):
                names = batch.column(0).slice(at, len(ends))
                ids = np.insert(ids, ends, end_id)
                yield pa.RecordBatch.from_arrays([names, binary_rows(ids, ends + np.arange(1, len(ends) + 1))], ["doc_id", "ids"])
                at += len(ends)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def flat(column: pa.BinaryArray, dtype: str) -> np.ndarray:
    """The column's values, one after the other, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype) if data and len(column) else np.zeros(0, dtype)


def id_order(tokens: DataFrame, dtype: str, size: int) -> np.ndarray:
    """All ids by falling count over all documents, ties by id: at most one row per id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()  # the memory of words is of no more use
        count = np.zeros(size, np.int64)
        for batch in batches:
            ids = flat(batch.column(0), dtype)
            for a in range(0, len(ids), 1 << 22):
                count += np.bincount(ids[a : a + (1 << 22)], minlength=size)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(size, np.int64)
    count[[r.id for r in rows]] = [r.n for r in rows]
    return np.lexsort((np.arange(size), -count))


def write_segments(tokens: DataFrame, path: str, dtype: str, order: np.ndarray) -> None:
    """Writes the documents in ascending id order, and ``order``, which lists the ids by rank."""
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def segment(seq: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
        counts = np.array([len(x) // np.dtype(dtype).itemsize for x in ids], "<u4")
        flat = np.frombuffer(b"".join(ids), dtype)
        control, data = pack(rank[flat])
        head = np.array([(MAGIC, VERSION, len(ids), len(flat), len(control), len(data))], HEADER)
        payload = b"".join([head.tobytes(), counts.tobytes(), control, data])
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
            ["part", "seq", "n_ids", "doc_ids", "payload"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        seq, held, names, ids = 0, 0, [], []
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                ids.append(raw)
                held += len(raw) // np.dtype(dtype).itemsize
                if held >= SEGMENT_IDS:
                    yield segment(seq, names, ids)
                    seq, held, names, ids = seq + 1, 0, [], []
        if names:
            yield segment(seq, names, ids)

    keyed = tokens.withColumn("tie", F.xxhash64("ids"))  # rows that share an id part by their ids
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").drop("tie")
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "zstd").parquet(path)
    table = [(k, bytearray(order[k : k + RANKS].astype("<u4").tobytes())) for k in range(0, len(order), RANKS)]
    tokens.sparkSession.createDataFrame(table, "first long, ids binary").coalesce(1).write.parquet(f"{path}/_order")


def read_order(spark: SparkSession, path: str) -> np.ndarray:
    """The ids by rank of the dataset in ``path``."""
    rows = spark.read.schema("first long, ids binary").parquet(f"{path}/_order").orderBy("first").collect()
    return np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4")


def read_segments(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document of the dataset in ``path``: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (unsigned 32-bit)."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.select("part", "seq", "n_ids")
    parts = prefix_offsets(sizes.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n").select("part", F.col("before").alias("base"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(parts, "part")
    sizes = sizes.select("part", "seq", (F.col("before") + F.col("base")).alias("start"))
    table = read_order(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                start, doc_ids, payload = (batch.column(c)[k] for c in range(3))
                buf = np.frombuffer(payload.as_py(), np.uint8)
                head = buf[: HEADER.itemsize].view(HEADER)[0]
                if head["magic"] != MAGIC or head["version"] != VERSION:
                    raise ValueError("not a token segment of this version")
                cuts = np.cumsum([HEADER.itemsize, 4 * int(head["documents"]), int(head["control"]), int(head["data"])])
                counts = buf[cuts[0] : cuts[1]].view("<u4").astype(np.int64)
                ids = table[unpack(buf[cuts[1] : cuts[2]], buf[cuts[2] : cuts[3]], int(head["ids"]))].astype("<u4")
                ends = np.cumsum(counts)
                view = memoryview(ids).cast("B")
                raw = [view[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                arrays = [doc_ids.values, pa.array(ends - counts + start.as_py()), pa.array(counts), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                if keep_ids:
                    arrays.append(pa.array(map(bytes, raw), pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    rows = segments.join(sizes, ["part", "seq"]).select("start", "doc_ids", "payload")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def token_files(
    docs: DataFrame, path: str, end_id: int = 2, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Encodes, writes to ``out`` (a scratch folder if none is given) and reads back: see ``read_segments``.

    Null and empty texts have the end id alone. Rows that share an id follow each other in the order
    of a hash of their ids; null ids come first. A very long text is encoded whole, and a segment holds at least one
    document. An empty table writes no segment and gives an empty result. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    encoder = LibraryEncoder(path)
    out = out or scratch_path(spark, "token-files")
    raw = scratch_path(spark, "token-ids")
    tokens = tokenize(docs, path, end_id, id_col, text_col)
    tokens.write.option("compression", "zstd").parquet(raw)
    tokens = spark.read.schema(tokens.schema).parquet(raw)
    order = id_order(tokens, encoder.dtype.str, encoder.size)
    write_segments(tokens, out, encoder.dtype.str, order)
    return read_segments(spark, out, keep_ids)


__all__ = ["LibraryEncoder", "id_order", "pack", "read_order", "read_segments", "token_files", "tokenize", "unpack", "write_segments"]

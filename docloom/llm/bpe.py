"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round finds every word's lowest-rank pair, by
binary search over the sorted pair keys, and merges all its places from the left; only pairs beside a
merge are looked up again, and finished words leave the array. Words that were seen are remembered per
Python worker, so work follows the number of different words.

Texts are cut at white space first: the pre-tokenizer never joins what stands on both sides of it. The
pieces of a slice of texts are numbered by Arrow, so that Python sees each different one once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident

#: Words that a Python worker remembers at most.
WORDS = 400_000
#: Bytes of text that are cut into words at a time.
SLICE_BYTES = 2 << 20
NONE = np.iinfo(np.int64).max
#: White space of the pattern, which is that of Unicode.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def lower(text: str) -> str:
    """Lower case letter by letter, without the rule for a final sigma."""
    return text.replace("Σ", "σ").lower()


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Remembered:
    """A bounded memory in two generations: what was not used while one filled up is forgotten."""

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {"": b""}, {}

    def learn(self, missing: set[str], used: Callable[[], set[str]], find: Callable[[list[str]], list[bytes]]) -> None:
        """Afterwards ``young`` holds all that is ``used``, of which it lacks what is ``missing``."""
        if len(self.young) + len(missing) > self.half:
            self.old, self.young, missing = self.young, {"": b""}, used()
        kept = missing & self.old.keys()
        self.young.update(zip(kept, map(self.old.__getitem__, kept), strict=True))
        new = list(missing - kept)
        self.young.update(zip(new, find(new), strict=True))


def strings(pieces: pa.Array) -> list[str]:
    """The pieces, which hold no line end, as Python strings: one long string that is cut is much faster than one by one."""
    if not len(pieces):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    return pc.binary_join(whole, "\n")[0].as_py().split("\n")


def binaries(values: list[bytes]) -> pa.Array:
    """The values as binary, from one long value and their ends."""
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, values), np.int32, len(values)), out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(values))])


class Words:
    """Ids of pieces of text without ASCII white space, from the ids of their parts.

    A word of Latin letters, lower-cased, and the ASCII marks after it are pre-tokens of their own, so
    each is a part that is looked up by itself; any other piece is one part. ``find`` gives the ids of
    many parts at a time. Arrow splits and numbers pieces and parts: Python sees each different one once.
    """

    def __init__(self, find: Callable[[list[str]], list[bytes]], added: Iterable[str], most: int = WORDS):
        self.find, self.known = find, Remembered(most)
        firsts = {t[:1] for t in added}  # an added token among the marks would be split
        self.marks = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in firsts)
        self.word = "^[A-Za-zÀ-ÖØ-öø-ÿ]+"
        self.plain = f"{self.word}[{re.escape(self.marks)}]*$"

    def parts(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each piece's two parts; the second is often empty."""
        plain = pc.match_substring_regex(pieces, self.plain)
        first = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(pieces, self.marks)), pieces)
        return first, pc.if_else(plain, pc.replace_substring_regex(pieces, self.word, ""), "")

    def __call__(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece as binary."""
        sides = [pc.dictionary_encode(p) for p in self.parts(pieces)]
        used = [strings(d.dictionary) for d in sides]
        self.known.learn({*used[0], *used[1]} - self.known.young.keys(), lambda: {*used[0], *used[1]}, self.find)
        get = self.known.young.__getitem__
        first, second = (binaries(list(map(get, u))).take(d.indices) for u, d in zip(used, sides, strict=True))
        return pc.binary_join_element_wise(first, second, b"")


def encoded(texts: pa.Array, words: Words, dtype: np.dtype, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of about ``limit`` bytes of texts at a time, one after the other, and their ends by text.

    Texts are cut at ASCII white space, which the pre-tokenizer never joins across. Null texts have no ids.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for a, b in slices(sizes, limit):
        pieces = pc.ascii_split_whitespace(pc.fill_null(texts.slice(a, b - a), ""))
        offsets = np.asarray(pieces.offsets)
        different = pc.dictionary_encode(pieces.flatten())
        ids = words(different.dictionary).take(different.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1]
        data = ids.buffers()[2]
        flat = np.frombuffer(data, np.uint8)[: ends[-1]].view(dtype) if data and ends[-1] else np.zeros(0, dtype)
        yield flat, ends[offsets[1:] - offsets[0]].astype(np.int64) // dtype.itemsize
        del pieces, different, ids, data, flat
        pa.default_memory_pool().release_unused()


class NumpyBpe:
    """A byte-level BPE with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        tokens = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            tokens[i] = token.encode()
        self.texts = pa.array(tokens, pa.binary())
        self.size = size
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(left * size + right, kind="stable")
        self.keys, self.ranks, self.made = (left * size + right)[order], order, made
        # Merging all places of a pair at once is right if no pair comes before the pairs that make its parts.
        last = np.full(size, -1, np.int64)
        np.maximum.at(last, made, np.arange(len(made)))
        self.at_once = bool(((last[left] < np.arange(len(made))) & (last[right] < np.arange(len(made)))).all())
        pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pieces.replace(r"\s", _SPACE))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _ranks(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at places ``at``, NONE where a pair never merges."""
        keys = sym[at] * self.size + sym[at + 1]
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[found] == keys, self.ranks[found], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, given as its UTF-8 bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not sizes.any():
            return [b""] * len(words)
        flat = np.frombuffer(b"".join(words), np.uint8)
        names = np.flatnonzero(sizes)  # of the words whose symbols are in the array
        count = sizes[names]
        owner = np.repeat(np.arange(len(names)), count)
        ends = np.cumsum(count) - 1
        sym = self.inner[flat]
        sym[ends] = self.final[flat[ends]]
        rank = np.full(len(sym), NONE)
        inside = np.ones(len(sym), bool)
        inside[ends] = False
        inside = np.flatnonzero(inside)
        rank[inside] = self._ranks(sym, inside)
        done_names, done_counts, done_sym = [], [], []
        while len(names):
            best = np.minimum.reduceat(rank, np.cumsum(count) - count)
            stay = best != NONE
            if not stay.all():
                gone = ~stay
                held = stay[owner]
                done_names.append(names[gone])
                done_counts.append(count[gone])
                done_sym.append(sym[~held])
                names, count, best, sym, rank = names[stay], count[stay], best[stay], sym[held], rank[held]
                owner = np.repeat(np.arange(len(names)), count)
                if not len(names):
                    break
            at = np.flatnonzero(rank == best[owner])
            if self.at_once:  # of touching places, which only a pair of equal symbols has, every second one
                touching = np.flatnonzero(np.diff(at) == 1)
                if len(touching):
                    new = np.ones(len(at), bool)
                    new[touching + 1] = False
                    run = np.flatnonzero(new)[np.cumsum(new) - 1]
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
            else:
                at = at[np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            count = count - np.bincount(owner[at], minlength=len(count))
            look = np.zeros(len(sym), bool)
            look[at] = True
            before = np.where(keep[at - 1], at - 1, at - 2)  # the symbol before may have been merged away just now
            look[before[at > 0]] = True
            sym, rank, look = sym[keep], rank[keep], look[keep]
            owner = np.repeat(np.arange(len(count)), count)
            ends = np.cumsum(count) - 1
            rank[ends] = NONE
            look[ends] = False
            near = np.flatnonzero(look)
            rank[near] = self._ranks(sym, near)
        names, count = np.concatenate(done_names), np.concatenate(done_counts)
        data = np.concatenate(done_sym).astype(self.dtype).tobytes()
        stops = (np.cumsum(count) * self.dtype.itemsize).tolist()
        out = [b""] * len(words)
        for i, a, b in zip(names.tolist(), [0, *stops], stops, strict=False):
            out[i] = data[a:b]
        return out

    def pre_tokens(self, chunk: str) -> list[str]:
        return self.pieces.findall(lower(unicodedata.normalize("NFC", chunk)))

    def find(self, parts: list[str]) -> list[bytes]:
        """The ids of each piece of text without ASCII white space; all their pre-tokens are merged together."""
        tokens: list[str] = []
        counts: list[int] = []
        for w in parts:
            if w.isascii() and w.isalpha() and w.islower():
                tokens.append(w)
                counts.append(1)
                continue
            cut = self.cut.split(w) if self.cut and "<" in w else [w]
            own = [y for x in cut for y in ([x] if x in self.special else self.pre_tokens(x))]
            tokens += own
            counts.append(len(own))
        ids = self.merge([t.encode() for t in tokens])
        for i, t in enumerate(tokens):
            if t in self.special:
                ids[i] = np.array([self.special[t]], self.dtype).tobytes()
        if max(counts, default=1) == min(counts, default=1) == 1:
            return ids
        stops = np.cumsum(counts).tolist()
        return [b"".join(ids[a:b]) for a, b in zip([0, *stops], stops, strict=False)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of documents whose ids end at ``ends``: their tokens joined by spaces, as a tokenizer without decoder gives them, in UTF-8."""
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.texts.take(pa.array(ids))), b" ")


def loaded(path: str) -> tuple[NumpyBpe, Words]:
    """One tokenizer and memory of words per Python worker."""

    def make() -> tuple[NumpyBpe, Words]:
        bpe = NumpyBpe(path)
        return bpe, Words(bpe.find, bpe.special)

    return resident(("bpe", path), make)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the text decoded from
    the ids. ``ids`` holds those integers as binary. Null and empty texts have no ids; a very long text is
    encoded whole. Repeated rows each give a row, an empty table none; other columns of ``docs`` are not
    looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, words = loaded(path)
        for batch in batches:
            at = 0
            for ids, ends in encoded(batch.column(1), words, bpe.dtype):
                wide = memoryview(ids.astype("<u4")).cast("B") if len(ids) else memoryview(b"")
                cuts = [0, *(ends * 4).tolist()]
                raw = [wide[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                shown = bpe.decode(ids, ends)
                arrays = [
                    batch.column(0).slice(at, len(ends)), pa.array(np.diff(ends, prepend=0)), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in shown], pa.string()),
                ]
                if keep_ids:
                    arrays.append(pa.array(map(bytes, raw), pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays)])
                at += len(ends)
                del ids, wide, raw, shown, arrays

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return rows.mapInArrow(run, schema)

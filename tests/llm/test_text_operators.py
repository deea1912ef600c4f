"""Text operators against brute force, on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import bpe, licenses, mixing, quality, sharding, simhash, token_files, toxicity
from docloom.llm.common import connected_components, prefix_offsets
from docloom.llm.queries import TOKENIZER, fold

PATH = public_tokenizers.path(TOKENIZER)
COLUMNS = "doc_id long, text string, source string, size string, key string, score double, label string, mix_copy int"
R = random.Random(7)


WORDS = "the of and a river mountain Stone bridge walks quickly under Über straße été 12 7, x! don't we'll <|endoftext|> ΣΑΣ 日本".split(" ")


def sentence(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


BASE = sentence(400)
TEXTS = [None, "", "  \n ", "one", "two words", BASE, BASE, BASE + " end", "x " + BASE, sentence(30_000), "a" * 20_000, "\x1c\x1d   \x85 é İ, İstanbul"]
TEXTS += [sentence(R.randint(3, 60)) for _ in range(40)] + ["same text here"] * 70


def rows():
    out = [(i, t, "hot" if i % 3 else f"s{i % 7}", "big", "k", 9.5, "x", 3) for i, t in enumerate(TEXTS)]
    out += [out[5], out[5], (None, "no id", None, None, None, None, None, None), (12, "another text of id twelve", None, "", "", 0.0, "", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), int(i % 4 == 0)) for i in range(len(TEXTS))] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def library():
    t = Tokenizer.from_file(PATH)
    return t


def test_prefix_offsets(spark):
    frame = spark.createDataFrame([(k, k % 5) for k in range(0, 5000, 3)], "k long, n long")
    total = 0
    for r in prefix_offsets(frame, "k", "n", 4).orderBy("k").collect():
        assert r.before == total
        total += r.n


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(R.randint(0, 80), R.randint(0, 80)) for _ in range(70)]])
def test_components(spark, edges):
    part = {x: x for e in edges for x in e}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [e[::-1] for e in edges[:3]], "a long, b long")).collect()}
    assert got == {x: find(x) for x in part if any(a != b and x in (a, b) for a, b in edges)}


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, 24).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(24))
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    n = Counter(r.source for r in got)
    for (shard, source), k in Counter((r.shard, r.source) for r in got).items():
        assert abs(k - n[source] / 24) <= 1.5 + len(n) / 24, (shard, source)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_documents(empty).count() == 0
    assert {r.shard for r in sharding.shard_documents(docs.limit(3)).collect()} <= set(range(24))


def brute_shards(rows_, n_shards=24, seed=17):
    """(shard, slot) by row, from the ranks as they are defined."""
    def bits(name, n):
        return int(hashlib.md5(name.encode()).hexdigest()[: n // 4], 16)

    by_source = {}
    for k, (i, text, source) in enumerate(rows_):
        raw = (text or "").encode()
        size, crc = len(raw) + 8, zlib.crc32(raw)
        key = bits(f"{seed}:{'' if i is None else i}:{size}:{crc}", 48)
        by_source.setdefault(source, []).append((key, i, size, crc, k))
    placed = []
    for source, members in by_source.items():
        phase = (bits(f"{seed}:" + ("none" if source is None else f"source:{source}"), 40) + 0.5) / 2.0**40
        for rank, (_, i, size, crc, k) in enumerate(sorted(members)):
            placed.append((min((rank + phase) / len(members), 1 - 2.0**-40), source or "", i, size, crc, k))
    n = len(placed)
    out = {}
    for at, row in enumerate(sorted(placed)):
        shard = at * n_shards // n
        out[row[-1]] = (shard, at - -(-shard * n // n_shards))
    return [out[k] for k in range(n)]


def test_sharding_against_brute_force(spark):
    rows_ = [(i, sentence(R.randint(0, 9)), f"one{i}" if i % 2 else ("hot" if i % 10 else "cold")) for i in range(3000)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in sharding.shard_documents(frame).collect()}
    want = brute_shards(rows_)
    assert [(got[i].shard, got[i].slot) for i, *_ in rows_] == want
    hot = Counter(got[i].shard for i, _, source in rows_ if source == "hot")  # beside 1500 sources of one row
    assert set(hot) == set(range(24)) and max(hot.values()) < 1.5 * min(hot.values())


def test_large_rates(spark):
    frame = spark.createDataFrame([(i, "x" * (1 if i < 40 else 4000), "rare" if i < 40 else "common") for i in range(400)], "doc_id long, text string, source string")
    rate = {r.source: r.rate for r in mixing.source_rates(frame, {"rare": 1.0, "common": 1.0}).collect()}["rare"]
    out = mixing.mix_sources(frame, {"rare": 1.0, "common": 1.0}).where("source = 'rare'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    n = np.array([r.n for r in out])
    assert rate > 10_000 and len(n) == 40
    assert abs(n.mean() - rate) < 5 * np.sqrt(rate / 40) and 0.5 < n.var() / rate < 2  # a Poisson's variance is its mean
    with pytest.raises(ValueError, match="__mix"):
        mixing.mix_sources(frame.withColumnRenamed("source", "__mix_n"), source_col="__mix_n")


def test_mixing(spark, docs, empty):
    got = mixing.mix_sources(docs, seed=4)
    assert set(got.columns) == set(docs.columns) | {"mix_key"}
    assert mixing.mix_sources(empty).count() == 0
    copies = Counter((r.doc_id, r.text) for r in got.collect())
    assert all(sorted(r.mix_copy for r in got.where(F.col("doc_id") == i).collect()) for i in (5,)) or (5, TEXTS[5]) not in copies
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("twelve bytes").alias("text"), F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("source"))
    out = mixing.mix_sources(frame, weights={"big": 1.0, "small": 1.0})
    n = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["big"] - 10_000) < 500 and abs(n["small"] - 10_000) < 500
    counts = np.array([r.n for r in out.where("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()])
    share = np.bincount(counts, minlength=12)[5] / 2000
    assert abs(share - 5**5 * np.exp(-5) / 120) < 0.03
    assert set(r.source for r in mixing.mix_sources(frame, weights={"small": 1.0}).select("source").distinct().collect()) == {"small"}
    (cdf,) = spark.range(1).select(mixing.poisson_cdf(F.lit(900.0)).alias("c")).first()
    assert abs(cdf[-1] - 1) < 1e-9 and abs(cdf[900] - 0.5) < 0.02


def brute_fingerprint(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles))


def test_simhash(docs, empty):
    got = simhash.group_near_duplicates(docs).collect()
    assert len(got) == len(rows())
    some = [(i, t) for i, t in enumerate(TEXTS) if not t or len(t) < 5000]
    prints = {i: brute_fingerprint(t, 3) for i, t in some}
    for r in got:
        if r.doc_id in prints and r.doc_id != 12:
            assert r.fp & (1 << 64) - 1 == prints[r.doc_id]
    nodes = [(r.doc_id, r.fp & (1 << 64) - 1) for r in got if r.doc_id is not None]
    part = {i: i for i, _ in nodes}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, x in nodes:
        for b, y in nodes:
            if (x ^ y).bit_count() <= 3:
                p, q = find(a), find(b)
                part[max(p, q)] = min(p, q)
    assert all(r.component_id == find(r.doc_id) for r in got if r.doc_id is not None)
    assert simhash.group_near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("bits", "m", "chunk"), [(3, 4, 2048), (3, 4, 40), (7, 8, 2048), (7, 8, 40), (7, 8, 4), (3, 4, 8), (1, 3, 8)])
def test_simhash_links(spark, bits, m, chunk):
    rng = random.Random(bits * m + chunk)
    prints = {rng.getrandbits(64) for _ in range(150)}
    seed = rng.getrandbits(64)
    for _ in range(250):  # one large group of near copies, and pairs at the border
        prints.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits))))
    prints |= {p ^ sum(1 << b for b in rng.sample(range(64), bits + k % 2)) for k, p in enumerate(list(prints)[:60])}
    ids = dict(enumerate(sorted(prints)))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in ids.items()], "fp long, rep long")
    links = simhash.near_links(frame, bits, m, chunk)
    got = {r.node: r.component for r in connected_components(links).collect()}
    part = {i: i for i in ids}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in ids:
        for b in range(a + 1, len(ids)):
            if (ids[a] ^ ids[b]).bit_count() <= bits:
                p, q = find(a), find(b)
                part[max(p, q)] = min(p, q)
    assert {i: got.get(i, i) for i in ids} == {i: find(i) for i in ids}


def test_keep_first(docs, empty):
    kept = simhash.keep_first(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and None in ids
    assert 5 in ids and not {6, 7, 8} & set(ids) and simhash.keep_first(empty).count() == 0
    assert sum(i is not None and i >= 52 for i in ids) == 1


def test_bpe_against_library(docs, empty):
    t = library()
    got = {(r.doc_id, r.n_tokens): r for r in bpe.encode_documents(docs, PATH, keep_ids=True).collect()}
    for i, text, *_ in rows():
        want = t.encode(text or "", add_special_tokens=False).ids
        r = got[i, len(want)]
        raw = np.array(want, "<u4").tobytes()
        assert bytes(r.ids) == raw and r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(empty, PATH).count() == 0


ODD = "abcdefg xyzTHE'sretvld0123456789.,!?-<|>ßÄéΣςσİ́̈\x1c\x1d\x85\xa0 　​᠎﻿\n\t日本한국\U0001f600\x00"


@pytest.mark.parametrize("which", ["numpy", "library"])
def test_word_memo_on_odd_texts(which):
    t, rng = library(), random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["a" * 4000, "!" * 3001, "<|endoftext|>a<|startoftext|>", "don't' it's we'll", "x's.", "ΑΣ, ΣΑΣ.", "É. é, Éa!"]
    own = bpe.NumpyBpe(PATH) if which == "numpy" else token_files.LibraryEncoder(PATH)
    words = bpe.Words(own.find, own.special if which == "numpy" else own.added, 900)  # so that memories turn over
    got = []
    for i in range(0, len(texts), 100):
        for ids, ends in bpe.encoded(pa.array(texts[i : i + 100]).slice(0), words, own.dtype, 5000):
            got += [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == want


def test_merge_one_place_at_a_time():
    own = bpe.NumpyBpe(PATH)
    words = [w.encode() for w in ("aaaaaaa", "hello", "mississippi", "x", "ééé", "!!!!!!")]
    at_once = own.merge(words)
    own.at_once = False
    assert own.at_once is False and own.merge(words) == at_once


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 4097])
def test_pack(n):
    ranks = np.array([R.choice([0, 1, 255, 256, 65_535, 65_536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1]) for _ in range(n)], np.uint32)
    control, data = token_files.pack(ranks)
    assert len(control) == -(-n // 4)
    assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def test_token_files(spark, docs, empty, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 300)
    t, out = library(), f"file://{tmp_path}/segments"
    got = token_files.token_files(docs, PATH, out=out, keep_ids=True).orderBy("start").collect()
    want = {}
    for i, text, *_ in rows():
        want.setdefault(i, []).append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    start, last = 0, -1
    for r in got:
        raw = bytes(r.ids)
        want[r.doc_id].remove(raw)
        assert r.start == start and r.n_tokens == len(raw) // 4 and r.ids_crc32 == zlib.crc32(raw)
        assert (r.doc_id if r.doc_id is not None else -1) >= last
        start, last = start + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    assert not any(want.values()) and spark.read.parquet(out).count() > 1
    assert token_files.token_files(empty, PATH).count() == 0


def test_token_files_from_the_path_alone(spark, docs, tmp_path):
    out = f"file://{tmp_path}/segments"
    token_files.token_files(docs, PATH, out=out)
    code = f"""
from pyspark.sql import SparkSession
from docloom.llm import token_files
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
for r in token_files.read_segments(spark, {out!r}, keep_ids=True).orderBy("start").collect():
    print("row", r.doc_id, bytes(r.ids).hex())
"""
    shown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True).stdout
    got = Counter(tuple(line.split(" ")[1:]) for line in shown.splitlines() if line.startswith("row "))
    t = library()
    assert got == Counter((str(i), np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes().hex()) for i, text, *_ in rows())


LICENSED = [
    ("Licensed under the Apache License, Version 2.0.", 1, "apache", "apache"),
    ("Released under the MIT License. gnu GENERAL public-license", 2, "gpl,mit", "gpl,mit"),
    ("mit license mit license", 2, "mit", "mit"),
    ("Licensed under CC BY-NC 4.0.", 1, "cc-by", "cc-by,cc-by-nc"),
    ("All rights reserved.", 0, "", "all-rights-reserved"),
    ("rights all reserved", 0, "", ""),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", 0, "", "mit"),
    ("Permission to grant a copy of files to any person", 0, "", ""),
    ("", 0, "", ""),
    (None, 0, "", ""),
]


def test_licenses(spark, docs, empty):
    filler = [(1000 + i, sentence(50)) for i in range(60)]
    frame = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(LICENSED)] + filler, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    for i, (text, n, base, labels_) in enumerate(LICENSED):
        assert (got[i].n_base, got[i].base_labels, got[i].labels) == (n, base, labels_), text
        assert got[i].n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        assert (got[i].score > 0) == bool(labels_) and 0 <= got[i].score <= 1
    assert (got[1].first_word, got[1].last_word) == (3, 5) and got[4].first_word is None
    assert (got[2].first_word, got[2].last_word) == (0, 2)
    assert all(got[i].labels == "" for i, _ in filler)
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(docs).count() == len(rows())


@pytest.mark.parametrize("filler", [0, 2, 200])
@pytest.mark.parametrize("template", [t for t in licenses.TEMPLATES if t[0] in ("all-rights-reserved", "bsd", "mpl", "mit")], ids=lambda t: t[1][:20])
def test_licence_in_every_document(spark, template, filler):
    label, text, _ = template
    rows_ = [(i, f"word {text} {sentence(5)}") for i in range(max(1, filler))] + [(1000 + i, "nothing here") for i in range(filler // 10)]
    got = licenses.scan_licenses(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert all((label in r.labels.split(",") and r.score == 1.0) if r.doc_id < 1000 else r.labels == "" for r in got)


def brute_labels(text):
    """Labels of the templates that begin at any place of the text, by the definition."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    out = set()
    for label, template, phrases in licenses.TEMPLATES:
        want, d = template.encode().split(), licenses.DRIFT
        for at in range(-len(want), len(words) + 1):
            near = lambda p: {words[i] for i in range(at + p - d, at + p + d + 1) if 0 <= i < len(words)}  # noqa: E731, B023
            if sum(w in near(p) for p, w in enumerate(want)) < licenses.COVERAGE * len(want):
                continue
            keys = [k.encode().split() for k in phrases]
            places = [[p for p in range(len(want)) if want[p : p + len(k)] == k] for k in keys]
            if all(any(words[i : i + len(k)] == k for p in ps for i in range(max(0, at + p - d), at + p + d + 1)) for k, ps in zip(keys, places, strict=True)):
                out.add(label)
                break
    return out


def damaged(template, rng):
    """The template with words lost, swapped or put in, often still recognisable."""
    words = template.split()
    for _ in range(rng.randint(0, 5)):
        k = rng.randrange(len(words))
        rng.choice([lambda: words.pop(k), lambda: words.insert(k, "xx"), lambda: words.__setitem__(k, "yy")])() if len(words) > 1 else None
    return " ".join(words)


@pytest.mark.parametrize("filler", [0, 100])
def test_licenses_against_brute_force(spark, filler):
    rng = random.Random(filler)
    texts = [f"{sentence(rng.randint(0, 4))} {damaged(t, rng)} {sentence(rng.randint(0, 4))}" for _, t, _ in licenses.TEMPLATES for _ in range(12)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(10_000 + i, sentence(20)) for i in range(filler)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    want = [brute_labels(t) for t in texts]
    assert sum(map(bool, want)) > 100 and sum(not w for w in want) > 20
    assert [set(filter(None, got[i].labels.split(","))) - set(got[i].base_labels.split(",")) for i in range(len(texts))] == [w - set(got[i].base_labels.split(",")) for i, w in enumerate(want)]


@pytest.mark.parametrize("n", [1, 3, 10, 100])
def test_licence_labels_do_not_depend_on_the_table(spark, n):
    for label, text, _ in licenses.TEMPLATES:
        if label in ("mit", "bsd", "isc"):
            rows_ = [(0, f"so {text} end")] + [(i, sentence(30)) for i in range(1, n)]
            got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
            assert label in got[0].split(",") and not any(got[i] for i in range(1, n))


def test_licence_words_without_end():
    """A very long text of licence words takes time and memory in proportion."""
    index = licenses.Index.build({}, 0)
    words = licenses.words_of(b"mit license " * 100_000)
    starts, labels_ = licenses.base_places(words)
    assert starts == list(range(0, 200_000, 2)) and labels_ == {"mit"}
    found = index.find(licenses.words_of(b"license software the " * 60_000 + b"released under the mit license"))
    assert {index.templates[t].label for t, _, _ in found} == {"mit"}


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return np.mean((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0]))


def test_quality_edges(docs, empty, labels):
    got = quality.score_quality(docs, labels, fold(5) != 0).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(empty, labels, fold(5) != 0).count() == 0
    none = quality.score_quality(docs, labels.where("false"), fold(5) != 0).collect()
    assert {r.score for r in none} == {0.5}


def test_quality_fit_against_plain_equations(spark, labels):
    """The model is that of one ridge system over all labelled rows, and its calibration that of one sorted list."""
    rng = random.Random(2)
    texts = [(i, sentence(rng.randint(1, 80)) + ("!!! " * 20 if i % 3 == 0 else "")) for i in range(300)]
    known = [(i, int((i % 3 == 0) != (i % 17 == 0))) for i, _ in texts] + [(3, None), (None, 1)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    labels_ = spark.createDataFrame(known, "doc_id long, quality int")
    model = quality.train_model(quality.document_statistics(frame), labels_, F.col("doc_id") % 5 != 0)
    rows_ = [(quality.statistics(t).astype("<f4").astype(float), q) for (i, t), (_, q) in zip(texts, known, strict=False) if i % 5]
    x, y = np.array([s for s, _ in rows_]), np.array([float(q) for _, q in rows_])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale, atol=1e-6)
    z = np.hstack([np.sqrt(2 / quality.FOURIER) * np.cos(np.clip((x - mean) / scale, -6, 6) @ model.turn + model.shift), np.ones((len(x), 1))])
    penalty = quality.RIDGE * len(x) * np.diag([*[1 / quality.FOURIER] * quality.FOURIER, 1e-9])
    weights = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(z @ model.weights, z @ weights, atol=1e-4)
    raw = z @ weights
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = sorted(set(at.tolist()))
    level = [y[at == b].mean() for b in bins]
    size = [(at == b).sum() for b in bins]
    want = [max(min(np.average(level[i : j + 1], weights=size[i : j + 1]) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]  # max-min form
    assert np.allclose(model.levels, want, atol=1e-6)
    sample = quality.labelled_statistics(frame, labels_, F.col("doc_id") % 5 != 0, 50)
    assert sample.count() == 50 and quality.labelled_statistics(frame, labels_, F.col("doc_id") % 5 != 0).count() == 240


def test_isotonic():
    total, ones = np.array([2.0, 1, 1, 4]), np.array([1.0, 1, 0, 4])
    assert np.allclose(quality.isotonic(total, ones), [0.5, 0.5, 0.5, 1.0])


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    turn, shift = rng.standard_normal((quality.N_STATS, quality.FOURIER)) / np.sqrt(quality.N_STATS), rng.uniform(0, 2 * np.pi, quality.FOURIER)
    m = quality.Model(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), turn, shift, np.zeros(quality.FOURIER + 1), np.zeros(1), np.zeros(1))
    x = rng.standard_normal((40, quality.N_STATS))
    z = m.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * quality.N_STATS))
    assert np.abs(z @ z.T - kernel).mean() < 0.08


def test_toxicity_edges(docs, empty, labels):
    model = toxicity.train_model(docs, labels, fold(4) != 2)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.train_model(docs, labels.where("toxic = 0"), fold(4) != 2)
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(docs, none).collect())
    assert all(r.score == 0.5 for r in toxicity.score_toxicity(docs, toxicity.train_model(empty, labels, fold(4) != 2)).collect())
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    clash = docs.withColumnRenamed("key", "y").withColumnRenamed("size", "__id").withColumnRenamed("label", "toxic")
    assert toxicity.score_toxicity(clash, toxicity.train_model(clash, labels, fold(4) != 2)).count() == len(rows())


def test_toxicity_training_against_a_plain_version(spark):
    """Counts, ratios and chosen features as defined, and weights at which the penalised loss has no slope."""
    rng = random.Random(4)
    texts = [(i, sentence(rng.randint(2, 12)) + (" scoundrel" if i % 4 == 0 else "")) for i in range(120)]
    known = [(i, int(i % 4 == 0 or i % 31 == 0)) for i, _ in texts]
    frame, labels_ = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, y int"), spark.createDataFrame(known, "doc_id long, toxic int")
    train = F.col("doc_id") % 3 != 0
    model = toxicity.train_model(frame, labels_, train, features=200, support=2)
    sets = [(set(np.concatenate([*toxicity.ngrams(t)]).tolist()), y) for (i, t), (_, y) in zip(texts, known, strict=True) if i % 3]
    n = [sum(y == c for _, y in sets) for c in (0, 1)]
    held = {g: [sum(g in s for s, y in sets if y == c) for c in (0, 1)] for g in set().union(*(s for s, _ in sets))}
    ratio = {g: np.log((b + 1) / (n[1] + 2)) - np.log((a + 1) / (n[0] + 2)) for g, (a, b) in held.items()}
    strength = {g: abs(ratio[g]) / np.sqrt(1 / (a + 1) + 1 / (b + 1)) for g, (a, b) in held.items() if a + b >= 2}
    chosen = sorted(sorted(strength, key=lambda g: (-round(strength[g], 9), g))[:200])
    mine = np.flatnonzero(model.slot >= 0).tolist()
    assert len(set(mine) ^ set(chosen)) <= 4  # equal strengths up to rounding
    r = np.array([ratio[g] for g in mine])
    x = np.array([[g in s for g in mine] for s, _ in sets]) * r
    y = np.array([float(c) for _, c in sets])
    w = model.weights / r
    p = 1 / (1 + np.exp(-(x @ w + model.bias)))
    assert np.abs(x.T @ (p - y) + w).max() < 0.05 and abs((p - y).sum()) < 0.05
    every = toxicity.train_model(frame, labels_, train, features=None, support=1)
    assert (every.slot >= 0).sum() >= 0.9 * len(held)
    scored = {s.doc_id: s.score for s in toxicity.score_toxicity(frame, model).collect()}
    assert auc([int(i % 4 == 0) for i, _ in texts], [scored[i] for i, _ in texts]) > 0.99
    kept = {s.doc_id for s in toxicity.keep_clean(frame, model).collect()}
    assert kept == {i for i, s in scored.items() if s < 0.3}


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_logistic_in_blocks(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(12, rng.integers(0, 9), replace=False)).astype("<u2") for _ in range(40)]
    y, values = rng.integers(0, 2, 40).astype(float), rng.standard_normal(12)
    w, b = toxicity.fit_logistic(sets, values, y, np.ones(40), 1.0, 50)
    x = np.array([[j in s for j in range(12)] for s in sets]) * values
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 0.02


def test_distinct_ngrams():
    text = "Ab, ab! AB abc"
    clean = " ab ab ab abc "
    want = {clean[i : i + n] for n in toxicity.ORDERS for i in range(len(clean) - n + 1)}
    found = np.concatenate(list(toxicity.ngrams(text)))
    distinct = toxicity.Distinct(1 << toxicity.DIM_BITS)(found)
    assert len(distinct) == len(set(found.tolist())) == len(want)
    long = "word " * 300_000
    assert sum(map(len, toxicity.ngrams(long))) == sum(len(long) + 1 - n + 1 for n in toxicity.ORDERS)


def test_classifiers_on_held_out_rows(spark):
    base = "/root/testdata/sf0.01"
    frame, known = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    q = quality.score_quality(frame, known, fold(5) != 0).join(known, "doc_id").where(fold(5) == 0).collect()
    assert auc([r.quality for r in q], [r.score for r in q]) > 0.95
    t = toxicity.score_toxicity(frame, toxicity.train_model(frame, known, fold(4) != 2)).join(known, "doc_id").where(fold(4) == 2).collect()
    assert auc([r.toxic for r in t], [r.score for r in t]) > 0.85

"""Registered queries, and the pipeline against a plain version of each stage, on the smallest tables."""

import hashlib
import importlib.util
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from docloom.llm import jaccard, quality, simhash, toxicity
from docloom.llm.queries import QUERIES, TOKENIZER, fold, table

SF = "/root/testdata/sf0.001"
needs_pipeline = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def plain_toxicity(model, text):
    """The score from a set of n-gram strings."""
    cleaned = re.sub(rb"[^a-z0-9\x80-\xff]", b" ", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    clean = b" " + b" ".join(cleaned.split()) + b" "
    total = model.bias
    seen = set()
    for n in toxicity.ORDERS:
        for g in {clean[i : i + n] for i in range(len(clean) - n + 1)}:
            h = sum(b * pow(0x100000001B3, k, 1 << 64) for k, b in enumerate(g)) + n
            at = model.slot[(h * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - toxicity.DIM_BITS)]
            if at >= 0:
                seen.add(int(at))
    total += sum(model.weights[list(seen)]) if seen else 0
    return 1 / (1 + math.exp(-max(-60, min(60, total))))


def plain_copies(docs, seed=29):
    mass = Counter()
    for r in docs:
        mass[r.source] += len((r.text or "").encode())
    whole, parts = sum(mass.values()), sum(math.sqrt(m) for m in mass.values())
    out = {}
    for r in docs:
        rate = math.sqrt(mass[r.source]) / parts * whole / mass[r.source]
        u = int(hashlib.md5(f"{seed}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2.0**52
        n, term, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u and n < 200:
            n += 1
            term *= rate / n
            total += term
        out[r.doc_id] = n
    return out


@needs_pipeline
def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = docs.collect()
    model = toxicity.train_model(docs, labels, fold(4) != 2)
    after = stages["toxicity"](spark, docs, SF)
    kept = {r.doc_id for r in rows if plain_toxicity(model, r.text) < corpus_pipeline.THRESHOLD}
    assert sorted(r.doc_id for r in after.collect()) == sorted(kept) and after.columns == docs.columns

    docs, rows = spark.createDataFrame([r for r in rows if r.doc_id in kept], docs.schema), [r for r in rows if r.doc_id in kept]
    stats = quality.document_statistics(docs)
    model = quality.train_model(stats, labels, fold(5) != 0)
    x = np.array([quality.statistics(r.text).astype("<f4") for r in rows], float)
    z = np.hstack([np.sqrt(2 / quality.FOURIER) * np.cos(np.clip((x - model.mean) / model.scale, -6, 6) @ model.turn + model.shift), np.ones((len(x), 1))])
    kept = {r.doc_id for r, s in zip(rows, np.interp(z @ model.weights, model.knots, model.levels), strict=True) if s >= corpus_pipeline.THRESHOLD}
    after = stages["quality"](spark, docs, SF)
    assert sorted(r.doc_id for r in after.collect()) == sorted(kept) and after.columns == docs.columns

    docs, rows = spark.createDataFrame([r for r in rows if r.doc_id in kept], docs.schema), [r for r in rows if r.doc_id in kept]
    groups, _ = plain_similar([(r.doc_id, r.text) for r in rows])
    after = stages["near_dedup"](spark, docs, SF)
    assert sorted(r.doc_id for r in after.collect()) == sorted({*groups.values()}) and after.columns == docs.columns

    docs, rows = spark.createDataFrame([r for r in rows if groups[r.doc_id] == r.doc_id], docs.schema), [r for r in rows if groups[r.doc_id] == r.doc_id]
    after = stages["mix"](spark, docs, SF)
    want = {i: n for i, n in plain_copies(rows).items() if n}
    assert Counter(r.doc_id for r in after.collect()) == want and after.columns == docs.columns

    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    digest = {r.doc_id: hashlib.sha256(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in rows}
    got = [(r.doc_id, r.ids_sha256) for r in stages["bpe"](spark, after, SF).collect()]
    assert Counter(got) == {(i, digest[i]): n for i, n in want.items()}
    assert Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == Counter(got)


@needs_pipeline
def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline

    fields = table(spark, SF, "documents").schema
    odd = [(1, None, None, None, None), (2, "", "", "", 0), (3, "a few words", "en", "s", 11), (3, "a few words", "en", "s", 11), (None, "no id", "en", None, 5)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, fields)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert name == "bpe" or docs.columns == fields.names
            assert docs.count() >= 0


def plain_similar(docs, width=5):
    """Components of all pairs whose shingle sets have a Jaccard similarity of 0.8 or more, and the number of such pairs of different sets."""
    sets, owners = {}, {}
    for i, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
        sets[i] = frozenset(b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()
        for s in sets[i]:
            owners.setdefault(s, []).append(i)
    part, pairs = {i: i for i in sets}, 0

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    blank = [i for i in sets if not sets[i]]
    near = {(a, b) for a in sets for s in sets[a] for b in owners[s] if a < b} | {(blank[0], b) for b in blank[1:]}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            pairs += sets[a] != sets[b]
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, pairs


def near_copies(seed=11):
    """Chains of texts whose neighbours are at similarities from 0.6 to 1, and one large group of them."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for k in range(60):
        words = [word() for _ in range(rng.choice([4, 6, 30, 200, 300]))]
        texts.append(" ".join(words))
        for _ in range(3):
            words = list(words)
            for _ in range(rng.randint(0, len(words) // 45 + 1)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    base = [word() for _ in range(120)]
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return [*texts, None, "", texts[0], texts[0].upper()]


@pytest.mark.parametrize("chunk", [2048, 16])
def test_near_dedup_against_brute_force_similarity(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard.similar_links, "__defaults__", (chunk, 2))
    monkeypatch.setattr(jaccard, "COMMON", 8)
    docs = list(enumerate(near_copies()))
    groups, pairs = plain_similar(docs)
    assert pairs > 100
    kept = simhash.keep_first(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), width=5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*groups.values()})


@needs_pipeline
def test_near_dedup_stage_against_brute_force_similarity(spark):
    import corpus_pipeline

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    groups, pairs = plain_similar([(r.doc_id, r.text) for r in docs.collect()])
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "/root/testdata/sf0.01")
    assert pairs and sorted(r.doc_id for r in kept.collect()) == sorted({*groups.values()})


@pytest.mark.parametrize("bits", [0, 7])
def test_near_dedup_links_do_not_depend_on_the_fingerprints(spark, bits):
    """Fingerprints propose pairs, the join finds the rest."""
    docs = list(enumerate(near_copies(12)))
    groups, _ = plain_similar(docs)
    kept = simhash.keep_first(spark.createDataFrame(docs, "doc_id long, text string"), max_bits=bits)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*groups.values()})


def test_near_dedup_keeps_clashing_columns(spark):
    rows = [(1, "same words here", 5, "x"), (2, "same words here", 6, "y"), (3, "other", 7, "z"), (3, None, 8, "w"), (None, "other", 9, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, `a.b` string").withColumnRenamed("node", "__gone")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


def test_near_dedup_keeps_texts_that_only_share_a_fingerprint(spark):
    """A line repeated many times outvotes the rest of a text, which is most of its set of shingles."""
    rng = random.Random(5)
    line = "the same seven words again and again "
    texts = [line * 60 + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2)]
    prints = simhash.fingerprints([t.encode() for t in texts], 5)
    assert int(prints[0] ^ prints[1]).bit_count() <= 7
    kept = simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=5)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1]


def test_sets_that_share_common_numbers_end_in_their_block(spark, monkeypatch):
    """Different sets with equal first numbers are candidates of each other; their pairs make no rows, and a similar pair among them is found."""
    draw, counts, verified = np.random.default_rng(3), [], jaccard.verified
    shared = np.arange(1, 10, dtype="<u8")
    sets = [np.sort(np.concatenate([shared, draw.integers(1 << 40, 1 << 63, 31).astype("<u8")])) for _ in range(120)]
    sets[119] = np.sort(np.concatenate([sets[7][:39], draw.integers(1 << 40, 1 << 63, 1).astype("<u8")]))

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    monkeypatch.setattr(jaccard, "COMMON", 1 << 20)
    rows = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "row long, hashes binary")
    none = spark.createDataFrame([], "a long, b long")
    links = jaccard.similar_links(rows, spark.createDataFrame([], "row long"), none, window=2)
    assert {(r.a, r.b) for r in links.collect()} == {(7, 119)}
    assert len(counts) == 2 and counts[1] < 100, counts

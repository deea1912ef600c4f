"""Licence scan: positional rare-token index over licence templates.

A pass over all documents counts how many hold each word of the templates. Each template is indexed by
its ``RAREST`` words of highest inverse document frequency and by the rarest words of each key phrase,
however many documents hold them. For each file its indexed words are looked up; every posting proposes
the place where the template would begin (position in file less position in template). Places that
several words agree on are verified, ``DRIFT`` words to both sides: enough of the template's words stand
where they should, and so do its mandatory key phrases, in full.

A template that a file holds is always proposed, since its key phrases are there and indexed: what a
file is found to hold does not depend on the other files.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of the contract and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, characteristic passage of the licence, key phrases that must all be there.
TEMPLATES = (
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("unless required by applicable law", "as is basis")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", ("person or organization obtaining",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("attribution 4 0 international",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "redistribute it")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "associated documentation files")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("without any express or implied warranty", "held liable")),
)

#: Words of highest inverse document frequency that each template is indexed by.
RAREST = 4
#: Words of each key phrase that its templates are indexed by.
ALWAYS = 2
#: Share of a template's words that must stand in place, within DRIFT words.
COVERAGE = 0.8
DRIFT = 2
#: Words of a file after which the proposals behind are decided.
WINDOW = 4096

#: A-Z to a-z, ASCII that is neither letter nor digit to spaces; bytes of other characters stay.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    #: Where each key phrase stands in the template.
    places: tuple[tuple[int, ...], ...]

    @classmethod
    def of(cls, label: str, text: str, phrases: tuple[str, ...]) -> Template:
        words, keys = tuple(text.encode().split()), tuple(tuple(k.encode().split()) for k in phrases)
        places = tuple(tuple(p for p in range(len(words)) if words[p : p + len(k)] == k) for k in keys)
        if not words or not all(places):
            raise ValueError(f"template {text!r} is empty or does not hold its key phrases {phrases}")
        return cls(label, words, keys, places)

    def coverage(self, words: list[bytes], at: int) -> float:
        """Share of the template's words that stand in place if it begins at ``at``; 0 without the key phrases."""
        for key, places in zip(self.keys, self.places, strict=True):
            near = (i for p in places for i in range(max(0, at + p - DRIFT), at + p + DRIFT + 1))
            if not any(tuple(words[i : i + len(key)]) == key for i in near):
                return 0.0
        hit = sum(w in words[max(0, at + p - DRIFT) : max(0, at + p + DRIFT + 1)] for p, w in enumerate(self.words))
        return hit / len(self.words)


@dataclass(frozen=True)
class Index:
    """Templates, postings (template, position) of the indexed words, and how many must agree by template."""

    templates: tuple[Template, ...]
    postings: dict[bytes, tuple[tuple[int, int], ...]]
    agree: tuple[int, ...]

    @classmethod
    def build(cls, counts: dict[bytes, int], n_docs: int, templates=TEMPLATES) -> Index:
        split, postings, agree = tuple(Template.of(*t) for t in templates), defaultdict(list), []
        idf = {w: math.log((1 + n_docs) / (1 + counts.get(w, 0))) for t in split for w in t.words}

        def rarest(words: Iterable[bytes], n: int) -> set[bytes]:
            return set(sorted(set(words), key=lambda w: (-idf[w], w))[:n])

        for t, template in enumerate(split):
            sure = [rarest(k, ALWAYS) for k in template.keys]
            chosen = rarest(template.words, RAREST).union(*sure)
            agree.append(min(2, *map(len, sure), len(chosen)))
            for p, w in enumerate(template.words):
                if w in chosen:
                    postings[w].append((t, p))
        return cls(split, {w: tuple(places) for w, places in postings.items()}, tuple(agree))

    def find(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, coverage) of each verified place, the best start of those within DRIFT of a proposal."""
        longest = max((len(t.words) for t in self.templates), default=0)
        votes: dict[tuple[int, int], set[int]] = defaultdict(set)
        found: dict[tuple[int, int], float] = {}

        def decide(before: int) -> None:
            for t, at in [place for place in votes if place[1] < before]:
                if len(votes.pop((t, at))) >= self.agree[t]:
                    template = self.templates[t]
                    cover, off, start = max((template.coverage(words, k), -abs(k - at), k) for k in range(at - DRIFT, at + DRIFT + 1))
                    if cover >= COVERAGE:
                        found[t, max(start, 0)] = cover

        decided = 0
        for i, w in enumerate(words):
            for t, p in self.postings.get(w, ()):
                votes[t, i - p].add(p)
            if i - decided >= WINDOW:
                decide(i - longest)
                decided = i
        decide(len(words) + 1)
        return [(t, at, cover) for (t, at), cover in sorted(found.items())]


def base_places(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Sorted starts, one for each place, of the contract's phrases, and their labels."""
    joined = b" " + b" ".join(words) + b" "
    found, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        want, at = b" " + phrase.encode() + b" ", -1
        while (at := joined.find(want, at + 1)) >= 0:
            found.append(at)
            labels.add(label)
    if not found:
        return [], labels
    begins = np.cumsum([0, *(len(w) + 1 for w in words)])
    return np.searchsorted(begins, np.sort(found)).tolist(), labels


def document_counts(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """How many documents hold each template word, and how many there are: one row per word reaches the driver."""
    vocabulary = sorted({w for _, text, _ in templates for w in text.encode().split()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts, n = set(vocabulary), defaultdict(int), 0
        for batch in batches:
            n += len(batch)
            for text in batch.column(0):
                for w in wanted.intersection(words_of((text.as_py() or "").encode())):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*map(bytes.decode, counts), None], pa.string()), pa.array([*counts.values(), n], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word.encode(): r.n for r in rows if r.word is not None}, next((r.n for r in rows if r.word is None), 0)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``spans`` lists the verified template places as ``label:first word:words``. ``score`` is 1 with a
    phrase of the contract, else the best coverage of a verified template, else 0. Null and empty texts
    have no words and empty labels; very long texts are searched a window at a time. Repeated rows each
    give a row, an empty table none; other columns of ``docs`` are not looked at.
    """
    index = Index.build(*document_counts(docs, templates, text_col), templates=templates)

    def scan(text: str | None) -> tuple:
        words = words_of((text or "").encode())
        starts, base = base_places(words)
        found = index.find(words)
        labels = base | {index.templates[t].label for t, _, _ in found}
        score = 1.0 if starts else max((c for _, _, c in found), default=0.0)
        spans = [f"{index.templates[t].label}:{at}:{len(index.templates[t].words)}" for t, at, _ in found]
        ends = (starts[0], starts[-1]) if starts else (None, None)
        return len(words), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans

    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"
    return rows.mapInArrow(run, schema)

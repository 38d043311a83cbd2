"""License scans as an exact set-similarity join of text blocks with templates.

A template is the set of words of a notice; a block contains it when it has at least
``CONTAINMENT`` of these words. Words are ordered by how many documents of the corpus
hold them, rarest first. Each template is indexed by its prefix, the rarest words of which
any containing block must have one; a block is looked up by its words, cut off by its length and
by the places of the first common word on both sides, and only then compared.

Blocks are the lines of a text, and all its words with line breaks as blanks, so that wrapped notices
are whole. More than ``BLOCK`` words are read in blocks of that size which overlap by half, so every
run of up to half a block lies in one, whatever lines it spans. The templates are a fixed
list, so the index and the counts of its words are bounded whatever the corpus.

Defined cases: a null or empty text has no words and no labels; repeated rows are scanned one
by one; a text of any length is scanned whole, in its blocks; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

CONTAINMENT = 0.9
BLOCK = 64

#: Phrases whose places are counted, and their labels: fixed by the contract.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices of public licenses (label, wording).
TEMPLATES = (
    ("agpl", "GNU Affero General Public License as published by the Free Software Foundation"),
    ("all-rights-reserved", "All rights reserved"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("apache", "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike License"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("public-domain", "This work has been released into the public domain"),
)

#: Separators become blanks and A-Z small letters; all other bytes are parts of words.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_FOLD_LINES = _FOLD[:10] + b"\n" + _FOLD[11:]


def _needed(size: int, containment: float) -> int:
    return ceil(containment * size - 1e-9)


@dataclass(frozen=True)
class Index:
    """Templates in the global order, and for each prefix word the templates and places it leads to."""

    order: dict[bytes, tuple[int, bytes]]
    templates: tuple[tuple[str, tuple[bytes, ...], int], ...]
    prefixes: dict[bytes, tuple[tuple[int, int], ...]]

    @staticmethod
    def build(frequencies: dict[bytes, int], templates: Sequence[tuple[str, str]], containment: float) -> Index:
        sets = [(label, set(wording.encode().translate(_FOLD).split())) for label, wording in templates]
        order = {w: (frequencies.get(w, 0), w) for _, words in sets for w in words}
        ranked = tuple((label, tuple(sorted(words, key=order.get)), _needed(len(words), containment)) for label, words in sets)
        prefixes: dict[bytes, list] = {}
        for t, (_, words, needed) in enumerate(ranked):
            for place, word in enumerate(words[: len(words) - needed + 1]):
                prefixes.setdefault(word, []).append((t, place))
        return Index(order, ranked, {w: tuple(x) for w, x in prefixes.items()})

    def matches(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        """Labels and containments of the templates that a block's words contain."""
        ordered = sorted((w for w in block if w in self.order), key=self.order.get)
        met: set[int] = set()
        for i, word in enumerate(ordered):
            for t, place in self.prefixes.get(word, ()):
                if t in met:
                    continue
                met.add(t)  # the first common word decides
                label, words, needed = self.templates[t]
                if len(block) < needed or 1 + min(len(ordered) - i - 1, len(words) - place - 1) < needed:
                    continue
                common = sum(w in block for w in words)
                if common >= needed:
                    yield label, common / len(words)


def template_frequencies(texts: DataFrame, templates: Sequence[tuple[str, str]]) -> dict[bytes, int]:
    """Documents that hold each word of the templates, counted over the whole corpus."""
    vocabulary = frozenset(w for _, wording in templates for w in wording.encode().translate(_FOLD).split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = dict.fromkeys(vocabulary, 0)
        for batch in slices(batches, "body"):
            for body in batch.column("body").to_pylist():
                for word in vocabulary.intersection(body.translate(_FOLD).split()):
                    totals[word] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(totals), pa.binary()), "n": pa.array(list(totals.values()), pa.int64())})

    counted = texts.select("body").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def _phrases(text: bytes) -> list[tuple[int, str]]:
    """First word and label of every place of a phrase in a text of single-spaced words with a blank at both ends."""
    found = []
    for phrase, label in PHRASES:
        wanted, at = b" %b " % phrase.encode(), text.find(b" %b " % phrase.encode())
        while at >= 0:
            found.append((text.count(b" ", 0, at), label))
            at = text.find(wanted, at + 1)
    return found


def blocks(body: bytes) -> Iterator[set[bytes]]:
    parts = [words for line in body.translate(_FOLD_LINES).split(b"\n") if (words := line.split())]
    if len(parts) != 1:
        parts.append([word for words in parts for word in words])
    for words in parts:
        for start in range(0, max(len(words) - BLOCK // 2, 1), BLOCK // 2):
            yield set(words[start:start + BLOCK])


_RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def scan(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Phrases, labels and best containment of every document, one row each."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    index = Index.build(template_frequencies(texts, templates), templates, containment)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = frozenset(index.prefixes)
        for batch in slices(batches, "body"):
            rows = []
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                words = body.translate(_FOLD).split()
                places = _phrases(b" %b " % b" ".join(words))
                base = {label for _, label in places}
                labels, score = set(base), 1.0 if base else 0.0
                if not prefixes.isdisjoint(words):
                    for block in blocks(body):
                        for label, contained in index.matches(block):
                            labels.add(label)
                            score = max(score, contained)
                starts = [p for p, _ in places] or [None]
                rows.append((doc, len(words), len(places), min(starts), max(starts), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64())
            names = [x.split()[0] for x in _RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return texts.mapInArrow(find, _RESULT)


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(
        f"({t}, '{label}', {sorted(w.decode() for w in set(wording.encode().translate(_FOLD).split()))!r})" for t, (label, wording) in enumerate(TEMPLATES))
    half = BLOCK // 2
    return f"""
WITH phrases(p, label) AS (VALUES {phrases}), templates(t, label, ws) AS (VALUES {templates}),
texts AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
tokens AS (SELECT r, regexp_extract_all(text, '{word}') AS w FROM texts),
places AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM tokens),
hits AS (SELECT r, i, label FROM places JOIN phrases ON w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY r),
line_words AS (SELECT r, regexp_extract_all(line, '{word}') AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
  UNION ALL SELECT r, w FROM tokens),
text_blocks AS (SELECT r, list_distinct(w[s + 1:s + {BLOCK}]) AS b FROM (SELECT r, w, unnest(range(0, greatest(len(w) - {half}, 1), {half})) AS s FROM line_words)),
near AS (SELECT r, label, len(list_intersect(b, ws)) / len(ws) AS contained FROM text_blocks JOIN templates ON len(list_intersect(b, ws)) >= ceil({CONTAINMENT} * len(ws) - 1e-9)),
all_labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM near UNION ALL SELECT r, label FROM hits) GROUP BY r),
best AS (SELECT r, max(contained) AS contained FROM near GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(contained, 0.0) END::DOUBLE AS score
FROM texts JOIN tokens USING (r) LEFT JOIN base USING (r) LEFT JOIN all_labels USING (r) LEFT JOIN best USING (r)
"""

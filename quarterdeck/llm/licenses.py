"""Operator 5: license scan by an exact set-similarity join of text blocks with license templates.

A token is two words that stand one after the other, so that a sentence with a notice's words in other places is none.
A template is a set of distinct tokens; a block matches if it holds at least THRESHOLD of them (containment of
the template in the block). The join is exact: the template tokens are ordered by their frequency over the
whole corpus, rarest first, and
  prefix      a block that misses all of a template's first |T| - need + 1 tokens can't hold `need` of them,
  length      a block of fewer than `need` tokens can't either,
  position    nor one whose tokens from the first shared one on are too few on either side;
what passes is verified token by token. Templates of a notice's one sentence are looked for in lines, longer
legal texts in paragraphs (lines up to one of blanks alone, a carriage return among them). The templates are a constant of this module, so
they travel with the code; the corpus is scanned in place and never shuffled.

Base phrases are counted besides: all places at which a phrase's words stand consecutively.

Defined results: a null or empty text has no words, no labels (empty strings), score 0 and null first and last
word; a null doc_id is kept; repeated rows get a row each; other columns are ignored; an empty table gives no rows. Templates
that tie in a block all give their labels. A very long text is scanned alone, at about 40 bytes of memory for each of its own.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.words import Vocabulary, Words, chunks, shingle_hashes, text_buffer, word_hashes, words

THRESHOLD = 0.8

#: Phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label, scope, text. Public license notices and grants.
TEMPLATES = (
    ("gpl-notice", "line", "This work is licensed under the GNU General Public License"),
    ("apache-2.0-notice", "line", "Licensed under the Apache License, Version 2.0."),
    ("mit-notice", "line", "Released under the MIT License."),
    ("cc-by-notice", "line", "Licensed under CC BY 4.0."),
    ("mpl-2.0-text", "paragraph", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mit-text", "paragraph", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("isc-text", "paragraph", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-text", "paragraph", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-text", "paragraph", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0-text", "paragraph", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("unlicense-text", "paragraph", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)

SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def hashes_of(text: str) -> np.ndarray:
    """Hashes of a text's words in order."""
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(words(data, np.array([0, len(data)]), unicode=False))


def tokens(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's word hashes, those of its tokens, and the place of each token's first word."""
    pairs, at = shingle_hashes(hashes, bounds, 2)
    return pairs, np.arange(len(pairs)) + np.repeat(bounds[:-1] - at[:-1], np.diff(at))


def tokens_of(text: str) -> np.ndarray:
    """Hashes of a text's tokens in order."""
    hashes = hashes_of(text)
    if len(hashes) < 2:
        raise ValueError("a template holds two words at least")
    return tokens(hashes, np.array([0, len(hashes)]))[0]


def token_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each token of the vocabulary stands in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.hashes), np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for first, last in chunks(offsets):
                found = words(data, offsets[first : last + 1], unicode=False)
                _, number = vocabulary.find(tokens(word_hashes(found), found.bounds)[0])
                total += np.bincount(number, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["token", "n"])

    out = np.zeros(len(vocabulary.hashes), np.int64)
    for r in docs.select(F.col("text").cast("string")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r["token"]] = r["n"]
    return out


class Join:
    """Templates as ranked token sets: rank 0 is the corpus's rarest token of all templates."""

    def __init__(self, templates, vocabulary: Vocabulary, frequency: np.ndarray, threshold: float):
        self.vocabulary = vocabulary
        order = np.lexsort((vocabulary.hashes, frequency))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.labels, self.scopes, self.sets, self.need = [], [], [], []
        self.prefixes: dict[str, dict[int, list[tuple[int, int]]]] = {"line": {}, "paragraph": {}}
        for k, (label, scope, text) in enumerate(templates):
            ranks = sorted(set(self.rank[vocabulary.find(tokens_of(text))[1]].tolist()))
            need = int(np.ceil(threshold * len(ranks) - 1e-9))
            self.labels.append(label)
            self.scopes.append(scope)
            self.sets.append(ranks)
            self.need.append(need)
            for i, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefixes[scope].setdefault(r, []).append((k, i))
        self.first = {scope: np.zeros(len(order), bool) for scope in self.prefixes}
        for scope, by_rank in self.prefixes.items():
            self.first[scope][list(by_rank)] = True

    def matches(self, scope: str, rank: np.ndarray, block: np.ndarray, n_tokens: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Yields (block, template, containment). rank and block: of each template token found, by place; n_tokens: by block."""
        for b in np.unique(block[self.first[scope][rank]]).tolist():
            a, z = np.searchsorted(block, [b, b + 1])
            held = np.unique(rank[a:z]).tolist()
            own, tried = set(held), set()
            for j, r in enumerate(held):
                for k, i in self.prefixes[scope].get(r, ()):
                    if k in tried:
                        continue
                    tried.add(k)
                    if n_tokens[b] < self.need[k] or 1 + min(len(self.sets[k]) - i - 1, len(held) - j - 1) < self.need[k]:
                        continue
                    shared = sum(x in own for x in self.sets[k])
                    if shared >= self.need[k]:
                        yield b, k, shared / len(self.sets[k])


def phrase_places(hashes: np.ndarray, bounds: np.ndarray, phrase: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the places at, those where the phrase's words stand one after the other in one text."""
    end = bounds[np.searchsorted(bounds, at, "right")]
    at = at[at + len(phrase) <= end]
    for k, h in enumerate(phrase.tolist()):
        at = at[hashes[at + k] == np.uint64(h)]
    return at


def edges_of(found: Words) -> dict[str, np.ndarray]:
    """First bytes of all lines, and of all paragraphs."""
    newline = np.flatnonzero(found.data == 10)
    marks = np.cumsum(found.data > 32)[newline]  # up to each line end
    empty = newline[1:][np.diff(marks) == 0]
    return {scope: np.unique(np.r_[found.offsets[:-1], cuts + 1]) for scope, cuts in (("line", newline), ("paragraph", empty))}


def scanned(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with its words, base places, labels and score (the largest containment; 1 for a base phrase)."""
    vocabulary = Vocabulary(np.concatenate([tokens_of(text) for _, _, text in templates]))
    join = Join(templates, vocabulary, token_frequencies(docs, vocabulary), threshold)
    phrase_words = [(hashes_of(p), label) for p, label in phrases.items()]
    heads = Vocabulary(np.array([w[0] for w, _ in phrase_words], np.uint64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in chunks(offsets):
                found = words(data, offsets[first : last + 1], unicode=False)
                hashes = word_hashes(found)
                n = last - first
                base: list[set] = [set() for _ in range(n)]
                more: list[set] = [set() for _ in range(n)]
                score = np.zeros(n)
                head, _ = heads.find(hashes)
                places = []
                for phrase, label in phrase_words:
                    at = phrase_places(hashes, found.bounds, phrase, head[hashes[head] == phrase[0]])
                    places.append(at)
                    for d in np.unique(np.searchsorted(found.bounds, at, "right") - 1).tolist():
                        base[d].add(label)
                        score[d] = 1.0
                at = np.sort(np.concatenate(places))
                doc = np.searchsorted(found.bounds, at, "right") - 1
                n_base = np.bincount(doc, minlength=n)
                pairs, place = tokens(hashes, found.bounds)
                hit, number = vocabulary.find(pairs)
                rank = join.rank[number]
                for scope, edges in edges_of(found).items():
                    of_word = np.searchsorted(edges, found.starts, "right") - 1
                    block = of_word[place]
                    inside = block == of_word[place + 1] if len(place) else np.zeros(0, bool)  # both words in one block
                    n_tokens = np.bincount(block[inside], minlength=len(edges))
                    own = inside[hit]
                    for b, k, share in join.matches(scope, rank[own], block[hit][own], n_tokens):
                        d = int(np.searchsorted(found.offsets, edges[b], "right")) - 1
                        more[d].add(join.labels[k])
                        score[d] = max(score[d], share)
                firsts = [int(at[a] - found.bounds[d]) if (a := np.searchsorted(doc, d)) < len(doc) and doc[a] == d else None for d in range(n)] if len(at) else [None] * n
                lasts = [int(at[z] - found.bounds[d]) if (z := np.searchsorted(doc, d, "right") - 1) >= 0 and doc[z] == d else None for d in range(n)] if len(at) else [None] * n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(np.diff(found.bounds)), pa.array(n_base), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)]), pa.array(score)],
                    names=[x.split()[0] for x in SCANNED.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SCANNED)

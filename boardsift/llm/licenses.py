"""License scans by a positional index of rare words.

All words of the phrases and templates are indexed once: for every word the postings (template, position).  In a file,
the licence words of highest inverse document frequency over the whole corpus are looked up, and of every template
whose key phrase the file has all words for at least the rarest of these.  A place p of such a word that stands at
position q of a template proposes the start p - q; the proposals of the template's words are intersected, so a start
is left only where all of them stand at their relative positions, and there the key phrase is verified.  A template is
found where its key phrase stands and the share of its words that stand at their places is large enough; a base phrase
is a template that is all key phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsift.llm.common import arrow_batches, text_slices

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Sentences of well-known public licences.  label: (key phrase that must stand, template).
TEMPLATES = {
    "mit-text": (
        "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    "apache-2.0-text": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    "gpl-text": ("terms of the gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    "lgpl-text": ("terms of the gnu lesser general public license", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    "agpl-text": ("terms of the gnu affero general public license", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    "bsd": ("redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    "isc": ("permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "mpl-text": ("terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    "epl-text": ("terms of the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    "cc-text": ("creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    "unlicense": ("released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
}
#: Share of a template's words that must stand at their places around its key phrase.
TEMPLATE_SHARE = 0.7

#: A-Z to lower case, and what separates words ([\x00-\x2F\x3A-\x60\x7B-\x7F]) to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


#: Words of highest inverse document frequency that are looked up in a file, besides those its open templates need.
RAREST = 8


class PositionalIndex:
    """Postings (template, position) of all words of the phrases and templates."""

    def __init__(self, base: dict[str, str], templates: dict[str, tuple[str, str]], frequency: dict[bytes, int]):
        # words, where their key phrase starts and how long it is, label, whether they are a base phrase
        self.entries = [(words_of(p), 0, len(words_of(p)), label, True) for p, label in base.items()]
        for label, (key, template) in templates.items():
            words, inside = words_of(key), words_of(template)
            at = next(i for i in range(len(inside)) if inside[i : i + len(words)] == words)
            self.entries.append((inside, at, len(words), label, False))
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for n, (words, *_) in enumerate(self.entries):
            for at, word in enumerate(words):
                self.postings.setdefault(word, []).append((n, at))
        rarest_first = sorted(self.postings, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {word: i for i, word in enumerate(rarest_first)}
        self.key_words = [frozenset(words[at : at + n]) for words, at, n, _, _ in self.entries]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], set[str], float]:
        """Places (start, label) of base phrases, all labels, and the largest share of a template that was found."""
        places: list[tuple[int, str]] = []
        labels: set[str] = set()
        score = 0.0
        present = self.rank.keys() & set(words)
        open_ = {n for n, key in enumerate(self.key_words) if key <= present}
        if not open_:
            return places, labels, score
        by_rank = self.rank.__getitem__
        chosen = set(sorted(present, key=by_rank)[:RAREST]) | {min(self.key_words[n], key=by_rank) for n in open_}
        found: dict[bytes, list[int]] = {}
        for p, word in enumerate(words):
            if word in chosen:
                found.setdefault(word, []).append(p)
        # starts proposed by each word of an open template's key phrase, intersected
        starts: dict[int, set[int]] = {}
        for word in sorted(found, key=by_rank):
            for n, q in self.postings[word]:
                _, at, size, _, _ = self.entries[n]
                if n in open_ and at <= q < at + size and starts.get(n) != set():
                    proposed = {p - q for p in found[word]}
                    starts[n] = starts[n] & proposed if n in starts else proposed
        for n, left in starts.items():
            template, at, size, label, is_base = self.entries[n]
            for start in left:
                if start + at < 0 or words[start + at : start + at + size] != template[at : at + size]:
                    continue
                if is_base:
                    places.append((start, label))
                    labels.add(label)
                    score = 1.0
                    continue
                share = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(template)) / len(template)
                if share >= TEMPLATE_SHARE:
                    labels.add(label)
                score = max(score, share)
        return places, labels, score


def _vocabulary(base: dict[str, str], templates: dict[str, tuple[str, str]]) -> list[bytes]:
    return sorted({w for p in base for w in words_of(p)} | {w for _, t in templates.values() for w in words_of(t)})


def _counts(vocabulary: list[bytes]):
    known = frozenset(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict.fromkeys(vocabulary, 0)
        for batch in text_slices(batches):
            for text in batch.column("text").to_pylist():
                for word in known.intersection(words_of(text)):
                    seen[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return work


def document_frequencies(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, tuple[str, str]] = TEMPLATES) -> dict[bytes, int]:
    """In how many of all documents each word of the phrases and templates occurs (one number per licence word)."""
    vocabulary = _vocabulary(base, templates)
    counted = arrow_batches(docs).select(docs["text"].cast("string").alias("text")).mapInArrow(_counts(vocabulary), "word string, n long")
    return {r["word"].encode(): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


_FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, starts array<long>"


def _scan(index: PositionalIndex):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                places, labels, score = index.scan(words)
                starts = sorted(p for p, _ in places)
                rows.append((len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score, starts))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return work


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Scan every whole text of ``docs`` (doc_id, text, ...) for the base phrases and the templates.

    Returns per row: doc_id, n_words, n_base (all places), first_word, last_word (null without a place), base_labels,
    labels (both comma-joined, empty without any), score (1 with a base phrase, else the largest share of a template
    around its key phrase) and starts, the places themselves.  Null and empty texts have no words; texts are read whole,
    however long; repeated rows give repeated rows; doc_id may be null; other columns are ignored; an empty table gives
    an empty result.
    """
    index = PositionalIndex(base, templates, document_frequencies(docs, base, templates))
    plain = arrow_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return plain.mapInArrow(_scan(index), _FOUND)

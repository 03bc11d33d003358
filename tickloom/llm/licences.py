"""Licence detection with a positional index of rare template words.

One pass counts in how many documents each template word stands (over the whole table). Each template is indexed by
its words of highest IDF: word -> (template, position). All indexed words of a file vote for (template, start); votes at
neighbouring starts are one alignment, its words are compared at their relative positions, and a template counts if
enough IDF weight matches and its key phrases stand there word by word. The plain phrases are templates too, found
through their rarest word and verified in full, at every place.

Two scans, no shuffle of texts; only the counts of the template words (a fixed list) reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import map_slices, raw_texts

# The phrases of the base rule and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices of public licences, each with its label and the phrases that must stand in it.
TEMPLATES = {
    "mit-line": ("Released under the MIT License", ["under the mit license"]),
    "apache-line": ("Licensed under the Apache License, Version 2.0", ["licensed under the apache license"]),
    "gpl-line": ("This work is licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", ["cc by nc"]),
    "reserved": ("All rights reserved", ["all rights reserved"]),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge"]),
    "apache-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        ["except in compliance with the license"]),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ["under the terms of the gnu general public license"]),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met", ["redistribution and use in source and binary forms"]),
}

#: Indexed words of a template, words an alignment may shift, least matched IDF weight.
INDEXED, SHIFT, LEAST = 6, 8, 0.8

#: A-Z to lower case; what is neither a digit, a letter nor beyond ASCII to a space.
_FOLD = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(0x80)) + bytes(range(0x80, 0x100))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _lines() -> dict[str, list[bytes]]:
    """The words of every template and phrase."""
    return {**{name: words_of(text.encode()) for name, (text, _) in TEMPLATES.items()}, **{p: p.encode().split() for p in PHRASES}}


class Index:
    """Postings of the rare words of all templates, for the document counts ``seen`` of ``total`` documents."""

    def __init__(self, seen: dict[bytes, int], total: int):
        self.lines = _lines()
        vocabulary = {w for line in self.lines.values() for w in line}
        self.idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1 for w in vocabulary}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        self.anchors: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for name, line in self.lines.items():
            rare = sorted(set(line), key=lambda w: (-self.idf[w], w))
            if name in PHRASES:
                self.anchors[rare[0]].append((name, line.index(rare[0])))
            else:
                for at, word in enumerate(line):
                    if word in rare[:INDEXED]:
                        self.postings[word].append((name, at))
        held = Counter(name for posts in self.postings.values() for name in {n for n, _ in posts})
        #: Least votes of an alignment.
        self.need = {name: min(3, n) for name, n in held.items()}
        self.wanted = frozenset(self.postings) | frozenset(self.anchors)
        self.keys = {name: [k.encode().split() for k in keys] for name, (_, keys) in TEMPLATES.items()}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places of the phrases (start, label) in order, and the score of each template found."""
        wanted = self.wanted
        hits = [i for i, w in enumerate(words) if w in wanted]
        places: list[tuple[int, str]] = []
        where: dict[bytes, list[int]] = defaultdict(list)
        for i in hits:
            where[words[i]].append(i)
            for name, at in self.anchors.get(words[i], ()):
                line = self.lines[name]
                if i >= at and words[i - at:i - at + len(line)] == line:
                    places.append((i - at, PHRASES[name]))
        votes: Counter[tuple[str, int]] = Counter()
        for word, at_words in where.items():
            for name, at in self.postings.get(word, ()):
                votes.update((name, i - at) for i in at_words)
        scores: dict[str, float] = {}
        by_name: dict[str, list[int]] = defaultdict(list)
        for name, start in votes:
            by_name[name].append(start)
        for name, starts in by_name.items():
            starts.sort()
            # Every widest run of starts within SHIFT: a cut elsewhere could part the votes of one alignment.
            last, held = 0, 0
            for first, start in enumerate(starts):
                end = last
                while end < len(starts) and starts[end] - start <= SHIFT:
                    held += votes[name, starts[end]]
                    end += 1
                if end > last and held >= self.need[name]:
                    group = starts[first:end]
                    found = self._matched(words, name, group)
                    if found >= LEAST and self._verified(words, name, group):
                        scores[name] = max(found, scores.get(name, 0.0))
                last = end
                held -= votes[name, start]
        return sorted(places), scores

    def _matched(self, words: list[bytes], name: str, starts: list[int]) -> float:
        """The share of the template's IDF weight whose words stand at their place for one of the starts."""
        line = self.lines[name]
        held = sum(self.idf[w] for at, w in enumerate(line) if any(0 <= s + at < len(words) and words[s + at] == w for s in starts))
        return held / sum(self.idf[w] for w in line)

    def _verified(self, words: list[bytes], name: str, starts: list[int]) -> bool:
        span = words[max(0, starts[0]):starts[-1] + len(self.lines[name])]
        return all(any(span[i:i + len(key)] == key for i in range(len(span) - len(key) + 1)) for key in self.keys[name])


def document_counts(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many rows of ``docs`` each template word stands, and the number of rows. Rows of a slice count at once."""
    vocabulary = frozenset(w for line in _lines().values() for w in line)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter[bytes] = Counter()
        for text in raw_texts(batch):
            seen.update(vocabulary.intersection(words_of(text)))
        seen[b""] = batch.num_rows
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = map_slices(docs.select("text"), work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    seen = {r.word.encode(): r.n for r in rows}
    return seen, seen.pop(b"", 0)


def scan(docs: DataFrame) -> DataFrame:
    """Licences of every row of ``docs`` (doc_id, text): ``SCHEMA``.

    Null and empty texts have no words, no label and score 0; first_word and last_word are null without a phrase; a null
    doc_id stays null; repeated rows are scanned one by one; an empty table gives no rows.
    """
    index = Index(*document_counts(docs))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
            words = words_of(text)
            places, scores = index.scan(words)
            base = {label for _, label in places}
            out.append((doc_id, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                        ",".join(sorted(base)), ",".join(sorted(base | scores.keys())), 1.0 if places else max(scores.values(), default=0.0)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), work, SCHEMA)

"""License scan: exact set containment of license templates in blocks of text.

A block is any ``BLOCK_WORDS`` consecutive words of the whole text (or all of a shorter one), across line breaks, at whatever place; for a
template of more than ``BLOCK_WORDS / SPREAD`` words it has ``SPREAD`` times the template's. A block
meets a template when it holds at least ``THRESHOLD`` of the template's distinct words. Blocks that meet a template are told as notices, from the left: one
that begins behind the fullest block of the notice before is another notice. The search is an
exact set-similarity join: template words are ordered by their document frequency over the whole corpus
(one aggregation over the bounded template vocabulary); a block that meets a template holds one
of its rarest ``size - need + 1`` words (prefix filter), so only blocks around the places of those are looked at, if
they have enough of the template's words at all (length filter) and enough can be left after the rarest word that
matched (positional filter); the blocks' overlaps are then counted exactly, by a window that slides over the places of the template's words.

Defined edge cases: a null text is empty and gives zero counts, null places and empty labels; a null doc_id stays null;
a very long text is scanned whole; repeated rows each give a row; equal labels from several notices are listed once; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM_TABLE, alnum_words, document_frequencies, map_texts, table

#: Phrases whose places are counted, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that the method looks for, with their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
]
THRESHOLD = 0.9
BLOCK_WORDS = 64
#: A block has at least so many times the words of the template.
SPREAD = 1.25


class TemplateIndex:
    """Templates with their words as ranks in the global order, rarest first, and the prefixes' inverted lists."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        sets = [(label, set(alnum_words(text))) for label, text in templates]
        self.widths = [max(BLOCK_WORDS, math.ceil(SPREAD * len(alnum_words(text)))) for _, text in templates]
        words = sorted({w for _, s in sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(words)}
        self.labels = [label for label, _ in sets]
        self.sets = [frozenset(self.rank[w] for w in s) for _, s in sets]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.lists: dict[int, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.sets):
            for j, r in enumerate(sorted(s)[: len(s) - self.need[t] + 1]):
                self.lists.setdefault(r, []).append((t, j))
        self.prefix_words = frozenset(w for w in words if self.rank[w] in self.lists)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, first word, share of the template) of every notice."""
        ranks = [self.rank.get(w) for w in words]
        around: dict[int, list[tuple[int, int]]] = {}
        for place, r in enumerate(ranks):
            for t, j in self.lists.get(r, ()):
                around.setdefault(t, []).append((place, j))
        out = []
        for t, found in around.items():
            width = self.widths[t]
            # stretches that hold every block with one of these places
            stretches: list[list[int]] = []
            for place, j in found:
                if stretches and place - width + 1 < stretches[-1][1]:
                    stretches[-1][1:] = [min(len(words), place + width), min(j, stretches[-1][2])]
                else:
                    stretches.append([max(0, place - width + 1), min(len(words), place + width), j])
            for low, high, j in stretches:
                hits = [i for i in range(low, high) if ranks[i] in self.sets[t]]
                if min(len(hits), len(self.sets[t]) - j) >= self.need[t]:
                    out += [(t, first, n / len(self.sets[t])) for n, first in notices(hits, ranks, width, self.need[t])]
        return out


def notices(hits: list[int], ranks: list, width: int, need: int) -> list[tuple[int, int]]:
    """The notices among the places of a template's words: how many of its words each one's fullest block holds, and the first of them.

    Of the blocks that end at a place the shortest with the most words counts; of equally full ones the leftmost.
    """
    held: dict[int, int] = {}
    out: list[list[int]] = []
    left = 0
    for i in hits:
        held[ranks[i]] = held.get(ranks[i], 0) + 1
        while hits[left] <= i - width or held[ranks[hits[left]]] > 1:
            r = ranks[hits[left]]
            held[r] -= 1
            if not held[r]:
                del held[r]
            left += 1
        if len(held) >= need:
            if not out or hits[left] > out[-1][2]:
                out.append([0, 0, 0])
            if len(held) > out[-1][0]:
                out[-1] = [len(held), hits[left], i]
    return [(n, first) for n, first, _ in out]


def template_words(templates=TEMPLATES) -> frozenset[bytes]:
    return frozenset(w for _, text in templates for w in text.encode().translate(ALNUM_TABLE).split())


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: word count, places of the phrases, labels, score and the notices (label, first word, share)."""
    index = TemplateIndex(templates, document_frequencies(docs, template_words(templates)), threshold)
    needles = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def make():
        def scan(text):
            words = alnum_words(text)
            joined = b" " + b" ".join(words) + b" "
            places, base = [], set()
            for needle, label in needles:
                at = joined.find(needle)
                while at >= 0:
                    places.append(joined.count(b" ", 0, at))
                    base.add(label)
                    at = joined.find(needle, at + 1)
            found: dict[tuple[str, int], float] = {}
            if not index.prefix_words.isdisjoint(words):
                for t, first, share in index.matches(words):
                    key = (index.labels[t], first)
                    found[key] = max(share, found.get(key, 0))
            labels = sorted(base | {label for label, _ in found})
            score = 1.0 if base else max(found.values(), default=0.0)
            blocks = [{"label": k[0], "first_word": k[1], "containment": v} for k, v in sorted(found.items())]
            return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, blocks

        return scan

    return map_texts(docs, make, "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<struct<label:string,first_word:bigint,containment:double>>")


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("blocks")

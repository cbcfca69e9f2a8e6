"""License scans: exact phrases, and short notices with a bounded number of edits.

A text is lower-cased (A-Z only) and cut into words; the words joined by single
spaces are what is searched. Exact phrases are counted at every place where
their words stand consecutively. A notice of length L is searched with up to
k = L // 14 character edits: split into k + 1 pieces, at least one piece must
occur exactly (pigeonhole), so one Aho-Corasick pass over the pieces of all
notices finds every place that needs a look. There, in a window of the notice's
length and its edits, the regex library matches the notice with bounded errors,
best match first, which verifies the edits and gives the span. Finds of one
notice are taken in order of edits and place; where a better one overlaps a
find, its window is searched again on either side of the better one. Windows of
equal content are matched once, so repeated lines cost one match.

Cases: a null text counts as empty; an empty one has no words, labels or spans
and score 0; texts are searched whole, however long; overlapping places of a
phrase all count, and of overlapping fuzzy finds of one notice the one with the
fewest edits stays, the first at a tie; finds that touch without overlapping all
stay; repeated rows give equal results; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glanage.llm.common import WORD, mapped

#: Exact phrases and their labels, as fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices and their labels, as fixed values; digits and signs as the word rule leaves them.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under the gnu general public license version", "gpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc"),
)
#: Characters of a notice for each edit allowed.
PER_EDIT = 14
#: Windows whose matches are remembered, at most.
_MEMORY = 20_000

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Found:
    label: str
    first: int  # word
    last: int  # word
    start: int  # character of the text
    stop: int
    edits: int
    size: int


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, per_edit: int = PER_EDIT):
        import ahocorasick
        import regex

        self.notices = [(text, label, len(text) // per_edit) for text, label in notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}") for text, _, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (text, _, k) in enumerate(self.notices):
            cuts = [round(j * len(text) / (k + 1)) for j in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                seeds.setdefault(text[lo:hi], []).append((i, lo))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()
        self.memory: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def _best(self, i: int, joined: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(edits, start, stop) of the best match of notice i in a stretch of the words."""
        if hi - lo < len(self.notices[i][0]) - self.notices[i][2]:
            return None
        content = joined[lo:hi]
        if (i, content) not in self.memory:
            if len(self.memory) >= _MEMORY:
                self.memory.clear()
            m = self.patterns[i].search(content)
            self.memory[i, content] = m and (sum(m.fuzzy_counts), m.start(), m.end())
        found = self.memory[i, content]
        return found and (found[0], lo + found[1], lo + found[2])

    def _finds(self, i: int, joined: str, windows: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        heap = [(*m, lo, hi) for lo, hi in windows if (m := self._best(i, joined, lo, hi))]
        heapq.heapify(heap)
        kept: list[tuple[int, int, int]] = []  # (start, stop, edits), in order
        while heap:
            edits, start, stop, lo, hi = heapq.heappop(heap)
            at = bisect.bisect_left(kept, (stop,))
            over = at - 1
            if over < 0 or kept[over][1] <= start:
                kept.insert(at, (start, stop, edits))
                continue
            # The finds are apart and in order, so those that reach into the window are neighbours.
            while over > 0 and kept[over - 1][1] > lo:
                over -= 1
            free = lo
            for a, b, _ in kept[over:bisect.bisect_left(kept, (hi,))]:
                if m := self._best(i, joined, free, min(a, hi)):
                    heapq.heappush(heap, (*m, free, min(a, hi)))
                free = max(free, b)
            if m := self._best(i, joined, free, hi):
                heapq.heappush(heap, (*m, free, hi))
        return [(i, start, stop, edits) for start, stop, edits in kept]

    def fuzzy(self, joined: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, stop, edits) in the joined words; finds of one notice don't overlap."""
        windows: dict[int, set[tuple[int, int]]] = {}
        for last, (size, places) in self.seeds.iter(joined):
            for i, offset in places:
                text, _, k = self.notices[i]
                lo = last + 1 - size - offset - k
                windows.setdefault(i, set()).add((max(0, lo), min(len(joined), lo + len(text) + 2 * k)))
        return [find for i, own in sorted(windows.items()) for find in self._finds(i, joined, own)]

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[Found]]:
        """Number of words, the exact phrases with their first words, the fuzzy finds."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
        if not words:
            return 0, [], []
        padded = b" " + b" ".join(words) + b" "
        hits = []
        for phrase in PHRASES:
            needle = b" " + phrase.encode() + b" "
            at = padded.find(needle)
            while at >= 0:
                hits.append((phrase, at))
                at = padded.find(needle, at + 1)
        base = []
        if hits:
            blanks = np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)
            base = list(zip([p for p, _ in hits], np.searchsorted(blanks, [at for _, at in hits]).tolist(), strict=True))
        joined = padded[1:-1].decode("utf-8", "surrogatepass")
        finds = self.fuzzy(joined)
        if not finds:
            return len(words), base, []
        spots = [m.span() for m in WORD.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
        blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        found = []
        for i, start, stop, edits in finds:
            # A find may begin or end with the blank between two words.
            first, last = np.searchsorted(blanks, (start + (joined[start] == " "), stop - (joined[stop - 1] == " "))).tolist()
            found.append(Found(self.notices[i][1], first, max(first, last), spots[first][0], spots[max(first, last)][1], edits, len(self.notices[i][0])))
        return len(words), base, found


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, start: long, stop: long, edits: int>>"
)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: exact counts, labels, and the fuzzy spans in characters of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for b in batches:
            rows = []
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                n, base, found = scanner.scan(text)
                places = [at for _, at in base]
                exact = sorted({PHRASES[p] for p, _ in base})
                score = 1.0 if base else max((1 - f.edits / f.size for f in found), default=0.0)
                rows.append(
                    (
                        key,
                        n,
                        len(base),
                        min(places, default=None),
                        max(places, default=None),
                        ",".join(exact),
                        ",".join(sorted({*exact, *(f.label for f in found)})),
                        score,
                        [{"label": f.label, "start": f.start, "stop": f.stop, "edits": f.edits} for f in found],
                    )
                )
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("n_fuzzy", F.size("spans").cast("long")).withColumn("spans", F.to_json("spans"))

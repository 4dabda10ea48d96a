"""License scan by conditional compression.

Words that speak of licences or rights are *cues*.  Around each cue of a paragraph
(lines up to one without a word) a window is cut for each template, a little longer than
it on both sides.  The window's words are compressed alone, and once with the template's words as
Zstandard raw-content dictionary: the more bytes that takes off, the higher the template
ranks.  The ranking is gone down until the exact wording of a template is there, its words sought in
order; only templates that save the same number of bytes are told apart by their wording.  Nothing is cut off:
a template whose wording is there is found however low it ranks.  Cues outside of the wordings found are
looked at again, until none gives another.

Windows recur a great deal, so each task keeps the answers to the last few
thousand different ones.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, quoted

# fixed values: wordings of licence notices in public use
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "mit-short": "Released under the MIT License.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# blanks, line breaks and comment signs may stand between words
CUES = (
    r"(?i)licen[sc]|copyright|\(c\) |©|all\W+rights\W+reserved|rights\W+reserved|permission\W+is\W+hereby|permission\W+to\W+use|"
    r"redistribution\W+and\W+use|creative\W+commons|\bcc0\b|\bcc\W+by|public\W+domain|spdx|mozilla\W+public|free\W+software|waived\W+all"
)
LEAST_WORDS = 0.8  # of the template's words, in order, in a confirmed block
_LEVEL = 19
_CUE = re.compile(CUES)


_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_WORDLESS = re.compile(r"\n(?:[\W_]*\n)+")


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _plain(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def _joined(words: Sequence[str]) -> bytes:
    return " ".join(words).encode("utf-8", "surrogatepass")


class Scanner:
    """Templates ready for comparison with blocks."""

    def __init__(self, templates: Mapping[str, str]):
        self.templates = {name: _tokens(text) for name, text in templates.items()}
        frame = zstandard.ZstdCompressionParameters.from_level(
            _LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        self._alone = zstandard.ZstdCompressor(compression_params=frame)
        given = lambda content: zstandard.ZstdCompressor(
            compression_params=frame, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        )
        least = 8  # bytes of Zstandard's least dictionary
        self._given = {name: given(_plain(text)) for name, text in templates.items() if len(_plain(text)) >= least}
        worded = {name: _joined(words) for name, words in self.templates.items()}
        self._worded = {name: given(content) for name, content in worded.items() if len(content) >= least}
        self.compared = lru_cache(maxsize=16384)(self._compared)
        self.reduction = lru_cache(maxsize=16384)(self._reduction)
        self._size = lru_cache(maxsize=16384)(lambda have: len(self._alone.compress(_joined(have))))
        self.saving = lru_cache(maxsize=4096)(self._saving)

    def _reduction(self, name: str, have: tuple[str, ...]) -> int:
        """Bytes that the template's words take off the compressed words; none for a template too short for a dictionary."""
        if name not in self._worded:
            return 0
        return self._size(have) - len(self._worded[name].compress(_joined(have)))

    def _saving(self, block: str, name: str) -> float:
        """The share of the compressed size that a template takes off."""
        if name not in self._given:
            return 0.0
        content = _plain(block)
        return 1 - len(self._given[name].compress(content)) / len(self._alone.compress(content))

    def _compared(self, name: str, have: tuple[str, ...]) -> tuple[float, int, int, tuple[str, ...], tuple[str, ...]]:
        """Share of the template's words found in order, the words from and to, its missing words, and foreign words among them."""
        want = self.templates[name]
        matches = [m for m in SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
        if not matches:
            return 0.0, 0, 0, tuple(want), ()
        found = {i for m in matches for i in range(m.a, m.a + m.size)}
        met = {i for m in matches for i in range(m.b, m.b + m.size)}
        first, last = matches[0].b, matches[-1].b + matches[-1].size
        missing = tuple(w for i, w in enumerate(want) if i not in found)
        return len(found) / len(want), first, last, missing, tuple(have[i] for i in range(first, last) if i not in met)


def _paragraphs(text: str) -> list[tuple[int, str]]:
    """``(start, paragraph)``: runs of lines that have a word; ``start`` counts code points."""
    out, at = [], 0
    for gap in _WORDLESS.finditer(text):
        out.append((at, text[at : gap.start()]))
        at = gap.end()
    return [*out, (at, text[at:])]


def _best(scanner: Scanner, have: list[str], cue: int, low: int, high: int, confirmed: bool) -> tuple | None:
    """The template that ranks best about the word ``cue`` among the words from ``low`` to ``high``, as
    ``((bytes saved, wording, template), template, words from and to, share, missing, foreign)``.

    With ``confirmed`` it is the first down the ranking whose wording is there.  Among templates that save equally many
    bytes it is the one with more words and fewer differing ones, then the last by name.
    """
    ranked = []
    for name, want in scanner.templates.items():
        if want:
            reach = len(want) + len(want) // 4 + 4
            begin = max(low, cue - reach)
            window = tuple(have[begin : min(high, cue + reach + 1)])
            ranked.append((scanner.reduction(name, window), name, begin, window))
    best = None
    for saved, name, begin, window in sorted(ranked, key=lambda r: (-r[0], r[1])):
        if best is not None and saved < best[0][0]:
            break
        want = scanner.templates[name]
        if confirmed and (Counter(want) & Counter(window)).total() < LEAST_WORDS * len(want):
            continue  # not enough words in any order
        share, first, last, missing, foreign = scanner.compared(name, window)
        if confirmed and share < LEAST_WORDS:
            continue
        key = (saved, len(want) - 2 * len(missing) - len(foreign), name)
        if best is None or key > best[0]:
            best = (key, name, begin + first, begin + last, share, missing, foreign)
    return best


def _findings(paragraph: str, scanner: Scanner) -> list[tuple]:
    """``(start, stop, template, saving, share, missing, foreign, confirmed)`` of one paragraph, in order."""
    spans = [m.span() for m in _WORD.finditer(paragraph)]
    if not spans:
        return []
    # lower-casing may change the number of code points, so words are lower-cased one by one
    have, starts = [paragraph[a:b].lower() for a, b in spans], [a for a, _ in spans]
    cues = [(m.start(), max(0, bisect_right(starts, m.start()) - 1)) for m in _CUE.finditer(paragraph)]
    taken: list[tuple[int, int]] = []  # words of confirmed wordings
    out = []
    while True:
        offers = {}
        for _, cue in cues:
            if any(a <= cue < b for a, b in taken):
                continue
            low, high = max([0, *(b for _, b in taken if b <= cue)]), min([len(have), *(a for a, _ in taken if a > cue)])
            found = _best(scanner, have, cue, low, high, True)
            if found:
                offers[found[2], found[3], found[1]] = found
        fresh = []
        for offer in sorted(offers.values(), key=lambda o: (-o[0][0], -o[0][1], o[2], o[1])):
            if all(offer[3] <= a or b <= offer[2] for a, b in [*taken, *fresh]):
                fresh.append((offer[2], offer[3]))
                out.append(offer)
        if not fresh:
            break
        taken += fresh
    rows = []
    for _, name, first, last, share, missing, foreign in out:
        start, stop = spans[first][0], spans[last - 1][1]
        while start and not paragraph[start - 1].isspace() and not paragraph[start - 1].isalnum():
            start -= 1
        while stop < len(paragraph) and not paragraph[stop].isspace() and not paragraph[stop].isalnum():
            stop += 1
        rows.append((start, stop, name, scanner.saving(paragraph[start:stop], name), share, missing, foreign, True))
    told = set()
    for at, cue in cues:  # the other cues' lines, once each
        start = paragraph.rfind("\n", 0, at) + 1
        if start in told or any(a <= cue < b for a, b in taken):
            continue
        told.add(start)
        low, high = max([0, *(b for _, b in taken if b <= cue)]), min([len(have), *(a for a, _ in taken if a > cue)])
        guess = _best(scanner, have, cue, low, high, False)
        if guess:
            stop = paragraph.find("\n", at)
            _, name, _, _, share, missing, foreign = guess
            line = paragraph[start : stop if stop >= 0 else len(paragraph)]
            rows.append((start, start + len(line), name, scanner.saving(line, name), share, missing, foreign, False))
    return sorted(rows)


def scan(text: str | None, scanner: Scanner) -> list[tuple]:
    """Findings of one text: every confirmed wording, none over another, and each other line with a cue with its best guess."""
    rows = []
    if not text or not _CUE.search(text):
        return rows
    line, counted = 0, 0
    for begin, paragraph in _paragraphs(text):
        for start, stop, name, saving, share, missing, foreign, confirmed in _findings(paragraph, scanner):
            line += text.count("\n", counted, begin + start)
            counted = begin + start
            rows.append((line, begin + start, begin + stop, text[begin + start : begin + stop], name, round(saving, 6), round(share, 6), list(missing), list(foreign), confirmed))
    return rows


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per confirmed wording of every text, and per other line with a cue:

    doc_id, line, start, stop (code points), block, license, saving, share (of the
    template's words), missing, foreign (words), confirmed, exact.

    Texts without a cue, null and empty ones give no row, and neither does an empty table.  Repeated rows give their
    findings each.  A text may have any number of blocks, and paragraphs any length: only the windows about their
    cues are compressed and compared.  Templates that save equally many bytes are ranked by their wording, then
    by name.  Other columns of ``docs`` are not read, so their names may clash.  Without templates nothing is found.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for frame in frames:
            rows = [(key, *row) for key, content in zip(frame["doc_id"], frame["text"]) for row in scan(content, scanner)]
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "line", "start", "stop", "block", "license", "saving", "share", "missing", "foreign", "confirmed"]
    # the cue is looked for before rows leave the JVM
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).cast("string").alias("text")).filter(F.col("text").rlike(CUES))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = map_frames(rows, batches,
        f"doc_id {kind}, line bigint, start bigint, stop bigint, block string, license string, saving double, share double, "
        "missing array<string>, foreign array<string>, confirmed boolean",
    )
    exact = (F.size("missing") == 0) & (F.size("foreign") == 0)
    return found.select("*", exact.alias("exact"))

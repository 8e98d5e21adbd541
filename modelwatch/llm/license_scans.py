"""License scan: exact phrases, and short notices found with a bounded number of edits.

A notice with at most ``k`` edits contains at least one of its ``k + 1`` pieces unchanged (pigeonhole), so an automaton
over all pieces finds every place where a notice can be; the regex library's bounded-error matching then verifies it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import regex
from pyspark.sql import DataFrame

from modelwatch.llm.common import alnum_words, map_texts

#: Phrases and labels of the exact search.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices of public licences, as lower-case words, with their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution": "cc-by",
    "all rights reserved no part of this publication may be reproduced": "proprietary",
}
#: Characters of a notice per permitted edit.
CHARS_PER_EDIT = 12


@dataclass
class Notice:
    text: str
    label: str
    edits: int
    pieces: list[tuple[int, str]]
    pattern: regex.Pattern


def compile_notices(notices: dict[str, str], chars_per_edit: int = CHARS_PER_EDIT) -> list[Notice]:
    out = []
    for text, label in notices.items():
        k = len(text) // chars_per_edit
        cuts = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
        pieces = [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        out.append(Notice(text, label, k, pieces, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}")))
    return out


class Scanner:
    """Finds notices in a text of words joined by single spaces."""

    def __init__(self, notices: dict[str, str]) -> None:
        self.notices = compile_notices(notices)
        self.seeds = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, piece in notice.pieces:
                places.setdefault(piece, []).append((i, offset))
        for piece, where in places.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of each verified place, by start; one notice's places do not overlap."""
        windows: dict[int, list[list[int]]] = {}
        for last, (length, where) in self.seeds.iter(text):
            for i, offset in where:
                k, size = self.notices[i].edits, len(self.notices[i].text)
                start = last - length + 1 - offset
                low, high = max(0, start - k), min(len(text), start + size + k)
                own = windows.setdefault(i, [])
                # Candidates that lie close together share a window, so that a match is verified once.
                if own and low <= own[-1][0] + k and high <= own[-1][1] + k:
                    own[-1] = [min(low, own[-1][0]), max(high, own[-1][1])]
                else:
                    own.append([low, high])
        found = []
        for i, own in windows.items():
            done = -1
            for low, high in sorted(own):
                low = max(low, done)
                while high - low >= len(self.notices[i].text) - self.notices[i].edits:
                    m = self.notices[i].pattern.search(text, low, high)
                    if m is None:
                        break
                    found.append((m.start(), m.end(), i, sum(m.fuzzy_counts)))
                    done = low = max(m.end(), low + 1)
        return sorted(found)


def exact_places(text: str) -> list[tuple[int, str]]:
    """(first word, label) of every place of a phrase, in a text of words joined by single spaces."""
    out = []
    for phrase, label in PHRASES.items():
        word = at = 0
        for m in re.finditer(rf"(?<![^ ]){phrase}(?![^ ])", text):
            word, at = word + text.count(" ", at, m.start()), m.start()
            out.append((word, label))
    return sorted(out)


SPAN = "struct<label:string,first_word:int,last_word:int,edits:int,notice:string>"


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None
) -> DataFrame:
    """One row per document with its exact phrases, its notices and their labels.

    ``notices`` lists the fuzzy places (words from 0, both ends included). ``score`` is 1 with an exact phrase, else the
    best notice's share of unedited characters, else 0. Null and empty texts have no words, no labels and score 0.
    Repeated rows are scanned each; other columns do not matter; an empty table gives an empty result. Texts are scanned whole,
    in time that follows their length.
    """
    chosen = NOTICES if notices is None else notices
    scanner: list[Scanner] = []

    def fn(texts):
        if not scanner:
            scanner.append(Scanner(chosen))
        out = [[] for _ in range(8)]
        for raw in texts:
            words = alnum_words(raw or b"")
            text = b" ".join(words).decode("utf-8", "replace")
            base = exact_places(text) if "license" in text else []
            spans, best, first, at = [], 1.0 if base else 0.0, 0, 0
            for start, end, i, edits in scanner[0].find(text):
                notice = scanner[0].notices[i]
                begins = start + (text[start : start + 1] == " ")
                first += text.count(" ", at, begins) if begins >= at else -text.count(" ", begins, at)
                at = begins
                last = first + text[start:end].strip(" ").count(" ")
                spans.append({"label": notice.label, "first_word": first, "last_word": last, "edits": edits, "notice": notice.text})
                best = max(best, 1 - edits / len(notice.text))
            labels = {label for _, label in base}
            starts = [p for p, _ in base]
            row = (
                len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                ",".join(sorted(labels | {s["label"] for s in spans})), best, spans,
            )
            for column, v in zip(out, row, strict=True):
                column.append(v)
        return out

    fields = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        f"notices array<{SPAN}>"
    )
    return map_texts(docs, [id_col], text_col, fn, fields)

"""License scans: exact phrases, and fuzzy search for short notices.

A text becomes words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered (on UTF-8 bytes: digits,
a-z and every byte from 0x80), joined by one space.  Base phrases are found there exactly.

Fuzzy search.  A notice that occurs with at most e edits contains at least one of its e + 1 pieces
unchanged (pigeonhole).  One Aho-Corasick automaton holds the pieces of all notices; a hit sets a
candidate stretch of the notice's length plus e on both sides, stretches that overlap are joined and cut
in overlapping pieces of a few lengths, and the regex library's bounded-error matching
``(?b)(?:notice){e<=k}`` verifies each piece, again on both sides of what it finds, and reports span and
edits.  A notice's digits must all be there and no others, as they tell versions apart.  Pieces are of bounded
length, so work beyond the automaton's one pass grows with the hits.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: short notices of the method, with labels
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu lesser general public license": "lgpl",
    "gnu affero general public license version 3": "agpl-3",
    "subject to the terms of the mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the bsd 2 clause license": "bsd",
    "licensed under the bsd 3 clause license": "bsd",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "dedicated to the public domain under cc0 1 0": "cc0",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}
#: one edit for so many characters
PER_EDIT = 18
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(place, text) of edits + 1 pieces of nearly equal length."""
    n, k = len(notice), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def _pattern(notice: str, edits: int) -> str:
    """Best match of a notice whose digits stay and which takes no others: each stretch between them may have all edits."""
    parts = regex.findall("[0-9]+|[^0-9]+", notice)
    return "(?b)(?:" + "".join(x if x[0].isdigit() else f"(?:{regex.escape(x)}){{e<={edits}:[^0-9]}}" for x in parts) + ")"


class Scanner:
    def __init__(self, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, per_edit: int = PER_EDIT) -> None:
        self.phrases = [(f" {p} ".encode(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.notices = [(n, label, len(n) // per_edit) for n, label in (NOTICES if notices is None else notices).items()]
        self.check = [regex.compile(_pattern(n, k)) for n, _, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            for at, piece in split_pieces(n, k):
                held.setdefault(piece, []).append((i, at))
        for piece, owners in held.items():
            self.seeds.add_word(piece, (len(piece), owners))
        if held:
            self.seeds.make_automaton()
        self.held = bool(held)

    def base(self, norm: bytes) -> tuple[int, list[int], set[str]]:
        """(number, first words, labels) of the phrases' places in b' w w w '."""
        places, labels = [], set()
        for phrase, label in self.phrases:
            at = norm.find(phrase)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = norm.find(phrase, at + 1)
        words, seen, last = [], 0, 0
        for at in sorted(places):
            seen += norm.count(b" ", last, at)
            last = at
            words.append(seen)
        return len(words), words, labels

    @staticmethod
    def _stretches(spans: list[tuple[int, int]], width: int) -> Iterator[tuple[int, int]]:
        """Overlapping spans joined, in pieces of at most 4 widths of which neighbours share one: no place of a notice is cut in all."""
        lo, hi = spans[0]
        for a, b in [*spans[1:], (None, None)]:
            if a is not None and a <= hi:
                hi = max(hi, b)
                continue
            while hi - lo > 4 * width:
                yield lo, lo + 4 * width
                lo += 3 * width
            yield lo, hi
            lo, hi = a, b

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits), in characters of the normalised text; of overlapping ones the best."""
        if not self.held:
            return []
        near: dict[int, list[tuple[int, int]]] = {}
        for end, (size, owners) in self.seeds.iter(text):
            for i, at in owners:
                n, _, k = self.notices[i]
                lo = end + 1 - size - at - k
                near.setdefault(i, []).append((max(lo, 0), lo + len(n) + 2 * k))
        out = set()
        for i, spans in near.items():
            n, label, k = self.notices[i]
            # a search gives the best place of a stretch, so both sides of it are searched again
            todo = [(lo, min(hi, len(text))) for lo, hi in self._stretches(sorted(spans), len(n) + 2 * k)]
            while todo:
                lo, hi = todo.pop()
                if hi - lo >= len(n) - k and (m := self.check[i].search(text, lo, hi)):
                    if sum(m.fuzzy_counts) <= k:
                        out.add((label, m.start(), m.end(), sum(m.fuzzy_counts)))
                    todo.append((max(m.end(), lo + 1), hi))
                    if m.end() > m.start():
                        todo.append((lo, m.start()))
        best: list[tuple[str, int, int, int]] = []
        starts: list[int] = []
        for x in sorted(out, key=lambda x: (x[3], x[1] - x[2], x[1], x[0])):
            at = bisect(starts, x[1])
            if (not at or best[at - 1][2] <= x[1]) and (at == len(best) or x[2] <= best[at][1]):
                best.insert(at, x)
                starts.insert(at, x[1])
        return best

    def scan(self, text: str | None) -> dict:
        ws = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
        norm = b" " + b" ".join(ws) + b" "
        n, places, base = self.base(norm)
        found = self.fuzzy(norm[1:-1].decode("utf-8", "replace"))
        sure = 1.0 if base else max((1 - e / max(b - a, e, 1) for _, a, b, e in found), default=0.0)
        return {
            "n_words": len(ws), "n_base": n, "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {x[0] for x in found})), "score": sure,
            "notices": [{"label": x, "start": a, "end": b, "edits": e} for x, a, b, e in found],
        }


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label string, start long, end long, edits long>>"
_ARROW = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("notices", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: counts and places of base phrases (words from 0), labels, score and notices.

    Starts and ends of notices are characters of the text's words joined by one space.  A null or
    empty text has no words and no labels, null places and score 0.  Score is 1 with a base phrase,
    else the best notice's share of unedited characters.  Null ids, repeated rows and extra columns
    change nothing; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [scanner.scan(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in _ARROW)], ["doc_id", *(k for k, _ in _ARROW)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)

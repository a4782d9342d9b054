"""License scans (operator 6): exact phrases, and fuzzy search for short notices.

Texts become lower-cased words joined by single blanks. A notice of k allowed edits is split into k + 1
seeds; whatever matches it with at most k edits holds one seed unchanged (pigeonhole), so an
Aho-Corasick automaton over all seeds locates the only places where a match can be. There the regex
library verifies with bounded errors and gives the span.

Every window is verified on its own and its best match kept. Of matches of one notice that share a word,
the one with the fewest edits stays (the earlier one of equals); matches that share none all stay. So each
place where a notice stands within its edits is covered by a reported span. Windows of equal text are
verified once, so a text that repeats a notice a million times costs no more than its length.

Cases: a null text is an empty text with no words, no places and score 0; overlapping places of base
phrases all count; very long texts take time in proportion to their length and seed hits; an empty table
gives an empty result; repeated rows are scanned each; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import raw, table

#: Phrases of the base rules and their labels.
PHRASES = ((b"under the mit license", "mit"), (b"apache license version 2", "apache-2"), (b"cc by nc", "cc-by-nc"))

#: Openings and names of public license notices, in normal form.
NOTICES = (
    ("all rights reserved", "all-rights-reserved"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution non commercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution share alike", "cc-by-sa"),
    ("creative commons zero", "cc0"),
    ("gnu affero general public license", "agpl"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

#: One edit for so many characters, and at least one for each notice.
CHARS_PER_EDIT = 12

_BLANKS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def edits(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


class Scanner:
    """Seeds and verifiers of a list of (notice, label)."""

    #: Window texts whose verdicts are remembered.
    MEMO = 200_000

    def __init__(self, notices: tuple = NOTICES):
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, label) in enumerate(notices):
            whole, k = f" {notice} ", edits(notice)
            cuts = [len(whole) * i // (k + 1) for i in range(k + 2)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                seeds.setdefault(whole[s:e], []).append((number, s))
            self.notices.append((len(whole), k, label, regex.compile(f"(?b)(?:{regex.escape(whole, literal_spaces=True)}){{e<={k}}}")))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()
        self.memo: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def _verify(self, number: int, window: str) -> tuple[int, int, int] | None:
        """(edits, start, stop) of the best match inside a window."""
        key = number, window
        if key not in self.memo:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            m = self.notices[number][3].search(window)
            self.memo[key] = (sum(m.fuzzy_counts), *m.span()) if m else None
        return self.memo[key]

    def spans(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, first word, last word, edits, notice length) of the notices in a text in normal form
        (a blank at each end)."""
        windows: dict[int, set[int]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for number, at in places:
                windows.setdefault(number, set()).add(end + 1 - n - at)
        if not windows:
            return []
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        out = []
        for number, own in windows.items():
            whole, k, label, _ = self.notices[number]
            found = set()
            for place in own:
                low = max(0, place - k)
                best = self._verify(number, text[low : place + whole + k])
                if best:
                    found.add((best[0], low + best[1], low + best[2]))
            if not found:
                continue
            cost, start, stop = np.array(sorted(found)).T
            # the words that hold the first and the last character that isn't a blank
            first = np.searchsorted(blanks, start, side="right") - 1
            last = np.searchsorted(blanks, stop - 1) - 1
            taken: list[int] = []  # first words of the chosen spans, which share no word
            ends: dict[int, int] = {}
            for c, f, e in zip(cost.tolist(), first.tolist(), last.tolist(), strict=True):
                e = max(e, f)
                at = bisect_right(taken, f)
                if (at and ends[taken[at - 1]] >= f) or (at < len(taken) and taken[at] <= e):
                    continue
                taken.insert(at, f)
                ends[f] = e
                out.append((label, f, e, c, whole - 2))
        return sorted(out)


def scan_text(text: str | None, scanner: Scanner) -> tuple:
    words = raw(text).translate(_BLANKS).split()
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in PHRASES:
        whole = b" " + phrase + b" "
        at = joined.find(whole)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = joined.find(whole, at + 1)
    first = last = None
    if places:
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        first, last = np.searchsorted(blanks, [min(places), max(places)]).tolist()
    spans = scanner.spans(joined.decode("utf-8", "surrogatepass"))
    score = 1.0 if base else max((1.0 - k / n for _, _, _, k, n in spans), default=0.0)
    labels = base | {label for label, *_ in spans}
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"label": a, "first_word": f, "last_word": e, "edits": k} for a, f, e, k, _ in spans]


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
_KINDS = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN)]
_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"


def scan(docs: DataFrame, notices: tuple = NOTICES) -> DataFrame:
    """One row per row of docs: word count, places of the base phrases, labels, score, and the spans that
    the fuzzy search verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for b in batches:
            rows = [(i, *scan_text(t, scanner)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

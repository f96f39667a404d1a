"""Licence scan: exact phrases, and short notices with a bounded number of edits.

Texts are reduced to lower-case ASCII-folded words. A notice may differ by up to k edits; cut into k + 1 parts,
at least one part then stands in the text unchanged (pigeonhole), so an automaton over all parts
finds every candidate place. Only around those places does the regex library's bounded-error
matching run; it verifies the edits and gives the span.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only, read_table

#: Phrase -> label. A place counts where the words stand consecutively.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label -> short notices of public licences, as words.
NOTICES: dict[str, tuple[str, ...]] = {
    "agpl": ("gnu affero general public license",),
    "apache": ("licensed under the apache license version 2 0",),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "released under the bsd license",
    ),
    "cc-by": ("licensed under cc by 4 0", "creative commons attribution 4 0 international"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international"),
    "cc0": ("cc0 1 0 universal public domain dedication",),
    "gpl": (
        "this program is free software you can redistribute it and or modify it",
        "licensed under the gnu general public license version 3",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose",),
    "lgpl": ("gnu lesser general public license",),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "released under the mit license",
    ),
    "mpl": ("this source code form is subject to the terms of the mozilla public license",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}

#: ASCII bytes that are no digit or letter become a space, A-Z become a-z; bytes of other characters stay.
_FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def max_edits(notice: str) -> int:
    """One edit for each twelve characters: a typo or two, not another licence."""
    return max(1, len(notice) // 12)


class NoticeFinder:
    """Fuzzy search of all notices in a text of space-joined words with a space at both ends."""

    def __init__(self, notices: dict[str, tuple[str, ...]] = NOTICES):
        import ahocorasick
        import regex

        self.seeds = ahocorasick.Automaton()
        self.patterns = []
        parts: dict[str, list[tuple[int, int]]] = {}
        for label, texts in sorted(notices.items()):
            for text in texts:
                k = max_edits(text)
                number = len(self.patterns)
                self.patterns.append((label, text, k, regex.compile(f"(?e)({regex.escape(text, literal_spaces=True)}){{e<={k}}}")))
                bounds = [len(text) * i // (k + 1) for i in range(k + 2)]
                for a, b in zip(bounds, bounds[1:], strict=False):
                    parts.setdefault(text[a:b], []).append((number, a))
        #: No match is longer.
        self.longest = max((len(text) + k for _, text, k, _ in self.patterns), default=0)
        for part, places in parts.items():
            self.seeds.add_word(part, (len(part), places))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of the matches; where notices of two labels overlap, the one with fewer edits stays."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.seeds.iter(text):
            for number, at in places:
                _, notice, k, _ = self.patterns[number]
                start = end + 1 - length - at
                a, b = max(0, start - k), min(len(text), start + len(notice) + k)
                own = windows.setdefault(number, [])
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(a, own[-1][0]), max(b, own[-1][1])
                else:
                    own.append([a, b])
        found = []
        for number, own in windows.items():
            label, notice, k, pattern = self.patterns[number]
            for a, b in own:
                for m in pattern.finditer(text[a:b]):
                    found.append((sum(m.fuzzy_counts), a + m.start(), a + m.end(), label))
        kept: list[tuple[int, int, int, str]] = []
        for edits, start, end, label in sorted(set(found)):
            near = kept[bisect_left(kept, start - self.longest, key=itemgetter(0)) : bisect_left(kept, end, key=itemgetter(0))]
            if all(other == label or e <= start or edits == least for _, e, least, other in near):
                insort(kept, (start, end, edits, label))
        return sorted((label, start, end, edits) for start, end, edits, label in kept)


@functools.cache
def _finder() -> NoticeFinder:
    return NoticeFinder()


_BASE = re.compile("(?= (" + "|".join(PHRASES) + ") )")


def scan(text: str | None) -> dict:
    """One text's words, base places, and notice spans (in words), as described at ``scan_licenses``."""
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    base = [(m[1], m.start()) for m in _BASE.finditer(joined)] if "license" in joined else []
    notices = _finder().find(joined)
    gaps = [m.start() for m in re.finditer(" ", joined)] if base or notices else []
    places = [bisect_left(gaps, at + 1) - 1 for _, at in base]
    base_labels = sorted({PHRASES[p] for p, _ in base})
    spans, best = [], 1.0 if base else 0.0
    for label, start, end, edits in notices:
        spans.append((label, bisect_left(gaps, start + (joined[start] == " ")) - 1, bisect_left(gaps, end - 1), edits))
        best = max(best, 1.0 - edits / max(1, end - start))
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(base_labels),
        "labels": ",".join(sorted({*base_labels, *(s[0] for s in spans)})),
        "score": best,
        "spans": [dict(zip(("label", "first", "end", "edits"), s, strict=True)) for s in spans],
    }


def scan_licenses(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans; one row per input row.

    ``spans`` has every verified notice: label, first word, word after the last, and its edits. The score is 1 where a
    base phrase stands, else 1 less the share of edited characters of the best notice, else 0. A null text has no
    words and empty label lists. Ids may be null or repeated; an empty table gives no rows; very long texts are scanned whole, in time
    that grows with their length. Further columns are ignored. No shuffle.
    """
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
    kinds = {
        "n_words": pa.int64(),
        "n_base": pa.int64(),
        "first_word": pa.int64(),
        "last_word": pa.int64(),
        "base_labels": pa.string(),
        "labels": pa.string(),
        "score": pa.float64(),
        "spans": spans,
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[c] for x in found], t) for c, t in kinds.items())],
                names=["doc_id", *kinds],
            )

    rows = only(documents, doc_id=doc_id, text=text)
    return rows.mapInArrow(
        run,
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first long, end long, edits long>>",
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))

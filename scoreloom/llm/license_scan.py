"""License scan: exact base phrases, and short notices found in spite of a few typing errors.

Fuzzy search goes by the pigeonhole rule. A notice of m bytes that may hold k edits is
cut into k + 1 pieces, so one piece at least stands unchanged in every match. The pieces
are searched for exactly; around each hit a window of its own is handed to the ``regex``
library, whose bounded-error matching verifies the edits and reports the best span. Edits may fall
anywhere but on the words that tell a licence from its neighbours: those have to stand exactly at the
place found (whole words, in order), and no word that makes another licence of it in or beside it.

Rows are independent, so the operator is one ``mapInArrow`` over the scan: no shuffle,
memory of one text at a time, and a lost task is simply run again.

Defined cases: a null text counts as empty and gives zero words, null positions, empty
label strings and score 0; repeated rows are each scanned; further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Phrases counted word by word, and their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Notices searched for with edits, normalised to lower-case words; the words that have to stand exactly; and
#: words that make another licence of it, at the place or next to it.
NOTICES = (
    ("mit", "released under the mit license", ("mit",)),
    ("mit", "licensed under the mit license", ("mit",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache", "2")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc", "by", "nc"), ("sa", "nd")),
    ("gpl-3", "gnu general public license version 3", ("general", "3"), ("lesser", "library", "affero")),
    ("gpl-2", "gnu general public license version 2", ("general", "2"), ("lesser", "library", "affero")),
    ("mpl-2", "mozilla public license version 2 0", ("mozilla", "2")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: One edit is allowed for each so many bytes of a notice.
BYTES_PER_EDIT = 12

WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else 0x20 for b in range(256))
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
    " labels string, score double, notices string"
)


class Notice:
    """A notice with its exact seeds, its bounded-error pattern, and the words that have to or must not stand there."""

    def __init__(self, label: str, text: str, telling: tuple = (), barred: tuple = (), bytes_per_edit: int = BYTES_PER_EDIT):
        self.label, self.text = label, text.encode()
        self.telling, self.barred = tuple(w.encode() for w in telling), frozenset(w.encode() for w in barred)
        self.edits = max(1, len(self.text) // bytes_per_edit)
        n, parts = len(self.text), self.edits + 1
        cuts = [n * i // parts for i in range(parts + 1)]
        self.seeds = [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:])]
        self.pattern = regex.compile(b"(?b)(?:" + regex.escape(self.text, special_only=True) + b"){e<=%d}" % self.edits)

    def windows(self, words: bytes) -> list[tuple[int, int]]:
        """Stretches of ``words``, one for each place where a match may stand; none holds two matches."""
        found, n, slack = set(), len(self.text), self.edits
        for seed, at in self.seeds:
            p = words.find(seed)
            while p >= 0:
                found.add((max(0, p - at - slack), min(len(words), p - at + n + slack)))
                p = words.find(seed, p + 1)
        return sorted(found)

    def tells(self, words: bytes, a: int, b: int) -> bool:
        """Whether the whole words at [a, b) hold the telling ones in order, and neither they nor their neighbours a barred one."""
        if not self.telling and not self.barred:
            return True
        start, end = words.rfind(b" ", 0, a) + 1, words.find(b" ", b)
        end = len(words) if end < 0 else end
        here = words[start:end].split()
        at = iter(here)
        if not all(w in at for w in self.telling):  # each is looked for behind the one before
            return False
        before, after = words[max(0, start - 40) : start].split()[-1:], words[end : end + 40].split()[:1]
        return not self.barred & {*here, *before, *after}

    def matches(self, words: bytes) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of each match, from left to right; of overlapping ones that of fewest edits."""
        found = set()
        for a, b in self.windows(words):
            m = self.pattern.search(words, a, b)
            if m and self.tells(words, m.start(), m.end()):
                found.add((sum(m.fuzzy_counts), m.start(), m.end()))
        kept: list[tuple[int, int, int]] = []
        for e, a, b in sorted(found):
            k = bisect_right(kept, (a, b, e))
            if (not k or kept[k - 1][1] <= a) and (k == len(kept) or kept[k][0] >= b):
                kept.insert(k, (a, b, e))
        yield from kept


def normalised(text: str) -> tuple[bytes, int]:
    """Lower-case words joined by one space, and their number."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(WORD_BYTES).split()
    return b" ".join(words), len(words)


def base_places(words: bytes, phrases=BASE_PHRASES) -> list[tuple[int, str]]:
    """(word number, label) of every place of a base phrase."""
    padded, found = b" " + words + b" ", []
    for label, phrase in phrases:
        wanted = b" " + phrase.encode() + b" "
        p, counted, number = padded.find(wanted), 0, 0
        while p >= 0:
            number += padded.count(b" ", counted, p)  # each stretch is counted once
            counted = p
            found.append((number, label))
            p = padded.find(wanted, p + 1)
    return sorted(found)


def fuzzy_places(words: bytes, notices: list[Notice]) -> list[tuple[int, int, int, str, float]]:
    """(start, end, edits, label, score): of overlapping matches the one of fewest edits stays."""
    found = sorted(
        (e, a, b, i) for i, n in enumerate(notices) for a, b, e in n.matches(words)
    )
    kept: list[tuple[int, int, int, str, float]] = []  # disjoint, by start
    for e, a, b, i in found:
        k = bisect_right(kept, a, key=lambda x: x[0])
        if (not k or kept[k - 1][1] <= a) and (k == len(kept) or kept[k][0] >= b):
            kept.insert(k, (a, b, e, notices[i].label, 1 - e / len(notices[i].text)))
    return kept


def spans_in_text(text: str, places) -> list[str]:
    """``label:start:end`` with code points of the original text."""
    starts, ends, at, offsets = [], [], 0, []
    for m in WORDS.finditer(text.translate(UPPER)):
        starts.append(m.start())
        ends.append(m.end())
        offsets.append(at)
        at += len(m.group().encode("utf-8", "surrogatepass")) + 1
    out = []
    for a, b, _, label, _ in places:
        i, j = bisect_right(offsets, a) - 1, bisect_right(offsets, max(a, b - 1)) - 1
        out.append(f"{label}:{starts[i]}:{ends[j]}")
    return out


def scan_text(text: str | None, notices: list[Notice]) -> tuple:
    words, n = normalised(text or "")
    base, fuzzy = base_places(words), fuzzy_places(words, notices)
    own = sorted({x[1] for x in base})
    return (
        n,
        len(base),
        base[0][0] if base else None,
        base[-1][0] if base else None,
        ",".join(own),
        ",".join(sorted({*own, *(x[3] for x in fuzzy)})),
        1.0 if base else max((x[4] for x in fuzzy), default=0.0),
        ",".join(spans_in_text(text or "", fuzzy)) if fuzzy else "",
    )


def scan_licenses(docs: DataFrame, notices=NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its license labels, word positions, score and notice spans."""
    notices = tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Notice(*x) for x in notices]
        for batch in batches:
            rows = [scan_text(t.as_py(), known) for t in batch.column(1)]
            cols = list(zip(*rows)) if rows else [[] for _ in range(8)]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"],
            )

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(run, SCHEMA)

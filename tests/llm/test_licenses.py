"""Fuzzy notices against an edit-distance scan of every place, and licences that differ in a word or number."""

from __future__ import annotations

import random

import pytest

from scoreloom.llm import license_scan as L

KNOWN = [L.Notice(*x) for x in L.NOTICES]


def labels(text):
    return L.scan_text(text, KNOWN)[5]


@pytest.mark.parametrize(
    "text",
    ["licensed under the mpl license", "licensed under cc by sa 4 0", "cc by nd 4 0", "licensed under cc by nd 4 0", "gnu general public license version 1",
     "gnu lesser general public license version 3", "gnu affero general public license version 3", "gnu library general public license version 2",
     "mozilla public license version 1 1", "apache license version 1 1", "licensed under the apache license version 1 0", "released under the bsd license"],
)
def test_other_licences_bear_no_false_label(text):
    assert labels(text) == "" and labels(f"some words. {text}, and more words") == ""


def test_typing_errors_elsewhere_are_forgiven():
    cases = {
        "relaesed under the mit license": "mit", "licenced undr the mit license": "mit", "licenced under the apache licence, version 2.0": "apache-2",
        "gnu genral public license version 3": "", "gnu general publc licence version 3": "gpl-3", "gnu general publik license version 2": "gpl-2",
        "mozilla pubic licence version 2.0": "mpl-2", "lisensed under cc-by-nc 4.0": "cc-by-nc", "licensed under cc by nc sa 4 0": "cc-by-nc",
        "GNU  General Public License, version 2; gnu lesser general public license version 3": "gpl-2",
        "redistribution and use in source and binary form with or without modifications are permited": "bsd",
    }
    assert {t: labels(t) for t in cases} == cases


def closest(pattern, text):
    """By end position the least edits of ``pattern`` against any piece of ``text`` that ends there."""
    column = list(range(len(pattern) + 1))
    out = [column[-1]]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(column[i - 1] + (p != c), column[i] + 1, new[i - 1] + 1))
        column = new
        out.append(column[-1])
    return out


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k, kind = rng.randrange(len(t)), rng.randrange(3)
        t[k : k + (kind != 0)] = [] if kind == 1 else [rng.choice("abcdefghij ")]
    return "".join(t)


def test_search_equals_an_edit_distance_scan():
    """Without telling words: a match is found where, and only where, some piece is within the edits."""
    rng, hits = random.Random(11), 0
    for _ in range(250):
        name, text = rng.choice([x[:2] for x in L.NOTICES])
        notice = L.Notice(name, text)
        words = L.normalised("some text before " + edited(rng, text, rng.randrange(0, notice.edits + 3)) + " and some behind")[0]
        least = min(closest(notice.text, words))
        got = list(notice.matches(words))
        assert bool(got) == (least <= notice.edits) and all(least <= e <= notice.edits for _, _, e in got)
        hits += bool(got)
    assert 100 < hits < 240


def test_telling_words_decide_among_matches():
    """With telling words a match goes if and only if one of them isn't whole at the place."""
    rng = random.Random(12)
    for _ in range(300):
        x = rng.choice([x for x in L.NOTICES if len(x) > 2])
        loose, strict = L.Notice(*x[:2]), L.Notice(*x)
        words = L.normalised("before " + edited(rng, x[1], rng.randrange(0, 3)) + " behind")[0]
        for a, b, e in loose.matches(words):
            whole = words[: words.find(b" ", b) if b" " in words[b:] else len(words)][words.rfind(b" ", 0, a) + 1 :].split()
            at, told = 0, True
            for w in strict.telling:
                told = told and w in whole[at:]
                at = whole.index(w, at) + 1 if told else at
            assert ((a, b, e) in list(strict.matches(words))) == (told and not strict.barred & set(whole))

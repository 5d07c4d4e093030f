"""Periodic runs against a scan of every period, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import pytest

from scoreloom.llm import periodic_runs
from scoreloom.llm.ngram_join import WordHashes
from tests.llm.test_scans import CLASHING, NASTY, nasty  # noqa: F401


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    figures = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *figures, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 3:
            s = rng.randrange(n)
            p = rng.randrange(1, (n - s) // 2 + 2)
            for i in range(s + p, rng.randrange(s, n + 1)):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_a_scan_of_all_periods(seed):
    rng, hashes = random.Random(seed), WordHashes()
    for _ in range(700):
        w = periodic(rng, rng.randrange(rng.choice([20, 60, 160])), rng.choice([1, 2, 3, 5, 40]))
        want = plain_runs(w)
        assert periodic_runs.runs_in(w) == sorted(want)
        assert periodic_runs.runs_of([b"%d" % x for x in w], hashes) == want


def test_sets_grow_beyond_a_block(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 3)
    rng = random.Random(9)
    for _ in range(300):
        w = periodic(rng, rng.randrange(150), rng.choice([1, 2, 3]))
        assert periodic_runs.runs_in(w) == sorted(plain_runs(w))


def test_query_equals_plain_version(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(f"W{x}" for x in periodic(rng, rng.choice([0, 5, 30, 300]), rng.choice([2, 50])))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, "é x " * 9 + "\t\n"), (303, "a\x0bb\x0cc " * 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = periodic_runs.detect_runs(df, rewrite=periodic_runs.planted).collect()
    assert sorted(map(tuple, got)) == sorted(plain_row(*d) for d in docs)
    assert sum(r["n_runs"] > 0 for r in got) > 40


def test_real_outputs(spark):
    df = spark.createDataFrame([(1, "x y " * 10 + "end"), (None, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.detect_runs(df, keep=True).collect()}
    assert got[1]["collapsed"] == "x y end" and [tuple(r) for r in got[1]["runs"]] == [(0, 20, 2)]
    assert got[None]["collapsed"] == "a b" and got[None]["runs"] == [] and got[None]["start"] is None


def test_run_cases(nasty):  # noqa: F811
    got = periodic_runs.detect_runs(nasty, rewrite=periodic_runs.planted).collect()
    assert len(got) == len(NASTY)
    long = [r for r in got if r["doc_id"] == 4 and r["n_runs"]]
    assert [(r["start"], r["length"], r["period"], r["exponent_milli"]) for r in long] == [(0, 30_000, 1, 30_000_000)]
    assert periodic_runs.detect_runs(nasty.limit(0)).collect() == []


@pytest.mark.parametrize("words", [[b"a"] * 300_000, [b"a", b"b"] * 150_000, [b"%d" % (i % 999) for i in range(300_000)], [b"%d" % (i * i % 8191 % 2) for i in range(300_000)]])
def test_time_of_long_texts(words):
    began = time.perf_counter()
    assert periodic_runs.runs_of(words, WordHashes())
    assert time.perf_counter() - began < 30

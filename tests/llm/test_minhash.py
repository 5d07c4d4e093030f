"""MinHash near-duplicates against all pairs of full sets, and the signatures against their statistics."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import minhash
from scoreloom.llm.ngram_join import WordHashes, shingles
from tests.llm.test_models import words
from tests.llm.test_scans import NASTY, nasty  # noqa: F401


@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    """Small tables: what leaders don't link is left to the pairs of a bucket, as always in the end."""
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", 1)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain(docs):
    """(doc_id, n_shingles, component_id, kept) by the links of all pairs."""
    sets, comp = {d: shingle_set(t) for d, t in docs}, {d: d for d, _ in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return sorted((d, len(sets[d]), comp[d], comp[d] == d) for d in sets)


def found(spark, docs):
    return sorted(map(tuple, minhash.dedup_minhash(spark.createDataFrame(docs, "doc_id long, text string")).collect()))


def edited(rng, base, most):
    copy = list(base)
    for _ in range(rng.randrange(0, most)):
        copy[rng.randrange(len(copy))] = f"edit{rng.randrange(9)}"
    return " ".join(copy)


def test_classes_equal_all_pairs(spark):
    rng, docs = random.Random(5), []
    passage = words(rng, 60)
    for _ in range(8):
        base = words(rng, rng.choice([8, 40, 150, 400])).split()
        docs += [edited(rng, base, max(2, len(base) // 25)) for _ in range(rng.choice([1, 3, 12]))]
        docs += [" ".join(base).upper(), words(rng, 30) + " " + passage]
    docs += ["one two", "one  TWO", "", " \t\n", "a b c d e", "a b c d e f", None, "a b c d e f g h i j k", "a b c d e f g h i j", "É x", "é x"]
    rows = list(enumerate(docs, 10))
    rng.shuffle(rows)
    want = plain(rows)
    assert found(spark, rows) == want and sum(not r[3] for r in want) > 10


def test_chain_of_versions(spark):
    """Neighbours are alike, the ends are not: one class still."""
    text, docs = [f"w{i}" for i in range(90)], []
    for i in range(14):
        docs.append((100 - i, " ".join(text)))
        text[2 * i] = f"v{i}"
    want = plain(docs)
    assert found(spark, docs) == want and {r[2] for r in want} == {87}


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Many texts that share a long passage and are not linked, pairs among them that are."""
    monkeypatch.setattr(minhash, "CROWD", 10)
    rng = random.Random(6)
    passage, docs = words(rng, 70), []
    for _ in range(40):
        own = words(rng, 30)
        docs += [own + " " + passage] + [own + " " + passage + " " + words(rng, 2)] * (rng.random() < 0.5)
    rows = list(enumerate(docs))
    want = plain(rows)
    assert found(spark, rows) == want and 5 < sum(not r[3] for r in want) < 35


def test_rows_of_one_id_have_their_own_sets(spark):
    rng = random.Random(8)
    a, b = words(rng, 60), words(rng, 60)
    docs = [(5, a), (5, b), (5, b), (7, b + " more"), (8, a + " more"), (9, words(rng, 60))]
    assert [(r[0], r[2]) for r in found(spark, docs)] == [(5, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_estimate_is_corrected_for_collisions(spark):
    """The mean error over many pairs is small at every similarity, and no link falls below the least matches."""
    rng, rows = np.random.default_rng(1), []
    for i in range(400):
        n, share = int(rng.integers(20, 900)), float(rng.choice([0.0, 0.3, 0.6, 0.85, 0.95]))
        both = int(n * share)
        h = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        x, y = (minhash.signature(minhash.minima(p)).tolist() for p in (h[:n], h[n - both :]))
        rows.append((i, share, both / (2 * n - both), *x, *y))
    sides = [f"{s}{i}" for s in "xy" for i in range(len(minhash.BITS_OF))]
    df = spark.createDataFrame(rows, "i long, share double, j double, " + ", ".join(f"{c} long" for c in sides))
    df = df.select("share", "j", *(F.struct(*(F.col(f"{s}{i}").alias(f"b{i}") for i in range(len(minhash.BITS_OF)))).alias(s) for s in "xy"))
    got = df.select("share", "j", F.expr(minhash.estimate("x", "y")).alias("e"), F.expr(minhash.matches("x", "y")).alias("m")).toPandas()
    assert (got.assign(d=(got.e - got.j).abs()).groupby("share").apply(lambda g: abs((g.e - g.j).mean()), include_groups=False) < 0.02).all()
    assert (got.e - got.j).abs().max() < 0.1 and got[got.j >= 0.85].m.min() >= minhash.least_matches()
    assert 820 < minhash.least_matches() < 870 and (got[got.j == 0].m < minhash.least_matches()).all()


def test_bands_meet_as_often_as_they_should():
    rng = np.random.default_rng(2)
    shares = []
    for _ in range(400):
        h = rng.integers(0, 2**63, 217).astype(np.uint64)  # 183 of 217: similarity 0.85 less a little
        a, b = (minhash.band_keys(minhash.minima(x, 128)) for x in (h[:200], h[17:]))
        shares.append((a == b).mean())
    assert min(shares) > 0 and abs(np.mean(shares) - (183 / 217) ** 4) < 0.03


def test_minima_are_those_of_the_whole_set():
    h = shingles(" ".join(f"w{i}" for i in range(3000)), WordHashes())
    least = minhash.minima(h)
    assert (minhash.minima(h, 128) == least[:128]).all()
    assert (least == ((h[:, None] ^ minhash.ADD) * minhash.TIMES).min(axis=0)).all() and len(np.unique(least)) == minhash.HASHES


def test_minhash_cases(nasty):  # noqa: F811
    got = minhash.dedup_minhash(nasty)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == len(NASTY)
    assert sorted(map(tuple, got.where("doc_id in (2, 3)").collect())) == [(2, 0, 2, True), (3, 0, 3, True)]
    assert [tuple(r) for r in got.where("doc_id is null").collect()] == [(None, 1, None, None)]
    assert minhash.dedup_minhash(nasty.limit(0)).count() == 0

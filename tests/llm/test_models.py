"""Toxicity, top-k, n-gram join, packing, fingerprints, mixing and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scoreloom.llm import fingerprints, mixing, ngram_join, packing, topk, toxicity
from scoreloom.llm.queries import tokenizer_path
from tests.llm.test_scans import CLASHING, NASTY, nasty  # noqa: F401


def words(rng, n):
    return " ".join(rng.choice("lorem ipsum dolor sit amet sed do eiusmod tempor ut labore et magna aliqua enim minim".split()) + str(rng.randrange(40)) for _ in range(n))


# Toxicity


def labelled(spark, n=400):
    rng, docs, labels = random.Random(1), [], []
    for i in range(n):
        text, toxic = words(rng, rng.randrange(5, 80)), i % 4 == 0
        if toxic:
            text += " vilword" + rng.choice("abcdef") + " " + words(rng, 3)
        docs.append((i, text))
        labels.append((i, 1 - int(i % 5 == 0), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    got = toxicity.score_toxicity(docs, labels.where("doc_id < 300")).where("doc_id >= 300").withColumnRenamed("toxic", "said").join(labels, "doc_id").collect()
    assert np.mean([r["said"] == r["toxic"] for r in got]) > 0.95


def test_fit_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 30, 8)).astype(np.int32),) for _ in range(200)]
    rows = [(i, np.ones(len(i), np.float32)) for (i,) in rows]
    x, y = toxicity.Rows(rows, 5, 1), rng.integers(0, 2, 200).astype(float)
    w = toxicity.fit_logistic(x, np.zeros((200, 0)), y, 1e-2, 200)
    g = x.back((toxicity.sigmoid(x.times(w[:32]) + w[-1]) - y) / 200) + 1e-2 * w[:32]
    assert np.abs(g).max() < 1e-3


def test_toxicity_cases(spark, nasty):
    _, labels = labelled(spark, 20)
    empty = labels.limit(0)
    got = toxicity.score_toxicity(nasty, empty, keep=True)
    left = [c for c in nasty.columns if c.lower() not in ("p_quality", "p_toxic", "toxic")]
    assert got.count() == len(NASTY) and got.columns == [*left, "p_quality", "p_toxic", "toxic"]
    assert {round(r["p_toxic"], 6) for r in got.collect()} == {0.5}
    assert toxicity.score_toxicity(nasty.limit(0), labels).count() == 0


# Top-k


def brute_topk(rows, k=10):
    good = [(i, np.floor(1024 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if q % 100 == 0:
            s = sorted((-int(a @ b), i) for i, b in good if i != q and len(a) == len(b))
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [50, 10_000])
def test_topk_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(401)]
    rows += [(500, None), (501, [1.0, None] + [0.0] * 4), (502, [float("nan")] * 6), (None, [1.0] * 6), (600, [1.0, 2.0]), (601, [3.0, 4.0]), (700, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in topk.search_topk(df, df.where("vec_id % 100 = 0"), shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = {q: v for q, v in brute_topk(rows).items() if v}
    assert dict(got) == want


def test_topk_of_equal_vectors_goes_by_id(spark):
    df = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(300)], "vec_id long, embedding array<float>")
    got = topk.search_topk(df, df.where("vec_id = 100"), shard_rows=40).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10))
    assert topk.search_topk(df.limit(0), df.limit(0)).count() == 0


def test_topk_of_huge_components(spark):
    """Components whose 1024-fold is no double, and scores beyond 64 bits, are ordered exactly."""
    rows = [(100, [1e306, 2.0]), (1, [1e306, 0.0]), (2, [1e306, 1.0]), (3, [-1e306, 0.0]), (4, [0.0, 1.0]), (5, [1e300, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search_topk(df, df.where("vec_id = 100"), shard_rows=2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 1, 5, 4, 3] and got[0]["score"] == 2**63 - 1 and got[3]["score"] == 2048 * 1024


# N-gram join


def brute_join(docs):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                i = len(sets[a] & sets[b])
                if a < b and i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {d: (len(sets[d]), comp[d]) for d in ids}


def test_join_equals_brute_force(spark):
    rng, docs = random.Random(5), []
    passage = words(rng, 60)
    for g in range(6):
        base = words(rng, rng.choice([8, 40, 120])).split()
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(9)}"
            docs.append(" ".join(copy))
        docs.append(" ".join(base).upper())
        docs.append(words(rng, 30) + " " + passage)
    docs += ["one two", "one  TWO", "", " \t\n", "a b c d e", "a b c d e f", None]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    got = ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_join(rows)


def test_join_of_a_chain_of_versions(spark):
    """Neighbours are alike, the ends are not: one class still."""
    text, docs = [f"w{i}" for i in range(80)], []
    for i in range(30):
        docs.append((100 - i, " ".join(text)))
        text[2 * i] = f"v{i}"
    got = ngram_join.join_ngrams(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: c for d, (_, c) in brute_join(docs).items()}


def test_join_of_repeated_ids_loses_no_link(spark):
    """Rows of one id have a set each: (5, B) is linked to 7 although (5, A) is another text."""
    rng = random.Random(8)
    a, b = words(rng, 60), words(rng, 60)
    docs = [(5, a), (5, b), (7, b + " more"), (8, a + " more"), (9, words(rng, 60))]
    got = ngram_join.join_ngrams(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_first_of_each_class(spark):
    rng = random.Random(8)
    a, b, c = (words(rng, 60) for _ in range(3))
    docs = [(5, a), (5, b), (7, b + " more"), (8, a + " more"), (9, c), (9, c), (9, a + " x"), (None, a), (None, a), (3, ""), (3, ""), (4, None)]
    got = ngram_join.first_of_each_class(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = [(5, a), (5, b), (9, c), (None, a), (None, a), (3, ""), (3, ""), (4, None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_join_cases(nasty):
    got = ngram_join.join_ngrams(nasty)
    assert got.count() == len(NASTY)
    assert {(r["n_shingles"], r["component_id"]) for r in got.where("doc_id in (2, 3)").collect()} == {(0, 2), (0, 3)}
    assert [r["component_id"] for r in got.where("doc_id is null").collect()] == [None]
    assert ngram_join.join_ngrams(nasty.limit(0)).count() == 0


# Packing


def check_packing(spark, docs, **settings):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), **settings).collect()
    size = settings.get("size", packing.BIN)
    bins = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    for d in docs.collect():
        ids = np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(p for p in pieces[d["doc_id"]])
        assert any(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine)
        if len(ids) <= size:
            assert any(n == len(ids) for _, _, n, _ in mine)
    return got, bins


def test_packing_is_tight_and_gapless(spark):
    rng = random.Random(7)
    docs = [(i, words(rng, rng.choice([3, 20, 100, 700])) + "\n" + words(rng, 4)) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got, bins = check_packing(spark, df, block_pieces=40)
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // packing.BIN) + 2


def test_packing_cases(spark, nasty):
    got, _ = check_packing(spark, nasty)
    assert sum(r["doc_id"] == 1 for r in got) == 2 and {r["length"] for r in got if r["doc_id"] in (2, 3)} == {1}
    assert packing.pack_documents(nasty.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["a  b", "x\n\ny", " lead", "trail ", "tab\tx", "<|endoftext|> a", "é😀 don't 123 's", "", "a b c", "it's\nThe we'll"])
def test_word_memory_gives_the_tokenizers_ids(text):
    e = packing.Encoder(tokenizer_path())
    assert e.encode([text, "warm it's\nup", text])[0] == e.whole([text])[0]


def test_the_merge_list_decides_on_the_fast_encoder():
    letters = packing.byte_letters()
    bytes_ = {c: i for i, c in enumerate(letters)}
    good = bytes_ | {"ab": 256, "abc": 257}
    assert packing.merges_rank_as_ids(good, ["a b", "ab c"], letters)
    assert not packing.merges_rank_as_ids(good, ["ab c", "a b"], letters)  # another order
    assert not packing.merges_rank_as_ids(good, ["a b"], letters)  # a token without merge
    assert not packing.merges_rank_as_ids(good | {"bc": 258}, ["a b", "ab c", "b d"], letters)
    e = packing.Encoder(tokenizer_path())
    assert e.words != e.whole and e.words([" lorem", "ipsum", "don't"]) == e.whole([" lorem", "ipsum", "don't"])


def test_crossover_and_mutation_keep_every_piece():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 900, 200).tolist()
    one, two = packing.best_fit(sorted(lengths, reverse=True), 1000), packing.best_fit(lengths, 1000)
    child = packing.mutate(packing.crossover(one, two, 1000, rng), 1000, rng)
    assert sorted(x for b in child for x in b) == sorted(lengths) and max(map(sum, child)) <= 1000


def hard_lengths(kind, seed, size=2048, n=60):
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        if kind == "triplets":  # n bins of three pieces each are filled to the brim
            a, b = (int(x) for x in rng.integers(400, 900, 2))
            out += [a, b, size - a - b]
        else:
            out += rng.integers(300, 1100, 5).tolist()
    return out


@pytest.mark.parametrize("kind", ["triplets", "uniform"])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_evolution_beats_best_fit_where_it_misses_the_bound(kind, seed, monkeypatch):
    calls, cross = [], packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: calls.append(1) or cross(*a))
    lengths = hard_lengths(kind, seed)
    bound, plain = -(-sum(lengths) // 2048), len(packing.best_fit(sorted(lengths, reverse=True), 2048))
    best = packing.evolve(lengths, 2048, 1, [], packing.GENERATIONS, packing.POPULATION)
    assert sorted(x for b in best for x in b) == sorted(lengths) and max(map(sum, best)) <= 2048
    assert bound <= len(best) < plain and len(calls) > 0


def test_packing_is_no_worse_than_best_fit_of_all(spark):
    """Blocks, islands and levels together need no more bins than best fit decreasing over all pieces at once."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, words(rng, rng.randrange(60, 260))) for i in range(160)], "doc_id long, text string")
    got, bins = check_packing(spark, docs, block_pieces=50)
    assert len(bins) <= len(packing.best_fit(sorted((r["length"] for r in got), reverse=True), packing.BIN))


def test_packing_spreads_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "the same text")] * 400, "doc_id long, text string")
    got = packing.pack_documents(docs, tokenizer_path(), block_pieces=50).collect()
    n = got[0]["length"]
    assert len(got) == 400 and len({r["sequence_id"] for r in got}) == -(-400 // (packing.BIN // n))


# Fingerprints


def test_fingerprints_against_direct_hash(spark):
    rng = random.Random(9)
    docs = [(3 * i, "\n".join(words(rng, 12) for _ in range(rng.randrange(0, 6)))) for i in range(40)] + [(500, None), (501, "éñ😀x"), (502, "abc")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for (d, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        own, changed = fingerprints.Fingerprint.of(t), fingerprints.Fingerprint.of(edited)
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own.hex(), changed.hex())  # the update rule gives the direct hash
        assert r["near_edited"] == pytest.approx(own.likeness(changed)) and r["near_next"] == pytest.approx(own.likeness(fingerprints.Fingerprint.of(nxt)))


def test_fingerprint_is_order_free_and_incremental():
    a, b = fingerprints.Fingerprint.of("one line\ntwo lines\nthree"), fingerprints.Fingerprint.of("three\none line\ntwo lines")
    assert a == b and a - fingerprints.Fingerprint.of("three") == fingerprints.Fingerprint.of("one line\ntwo lines")
    assert a != fingerprints.Fingerprint.of("one line\ntwo lines\nthree\nthree")


def test_fingerprint_cases(nasty):
    assert fingerprints.fingerprint_documents(nasty).count() == len(NASTY)
    assert fingerprints.fingerprint_documents(nasty.limit(1)).first()["near_next"] == 1.0
    assert fingerprints.fingerprint_documents(nasty.limit(0)).count() == 0


# Mixing


def test_period_meets_every_window():
    a = mixing.shares({"a": 5.0, "b": 3.0, "c": 1.5, "d": 0.5}, 100)
    order = mixing.period(a)
    for s, n in a.items():
        for t in range(len(order) + 1):
            assert abs(order[:t].count(s) - t * n / 100) < 1


def test_mixing_against_simulation(spark):
    rng = random.Random(3)
    docs = [(i, "x" * rng.randrange(1, 300), rng.choice("aaaaabbc")) for i in range(600)] + [(900, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, block_chars=500, resolution=50).collect()
    assert len(got) == len(docs) and {r["doc_id"] for r in got} == {d[0] for d in docs}
    assert [r["mix_slot"] for r in got] == sorted(r["mix_slot"] for r in got)
    by = defaultdict(set)
    for r in got:
        by[r["mix_slot"]].add((r["source"], r["mix_block"]))
    assert all(len(x) == 1 for x in by.values())  # one block a slot
    chars = defaultdict(int)
    for _, t, s in docs:
        chars[s] += max(1, len(t or ""))
    blocks = {s: (n - 1) // 500 + 1 for s, n in chars.items()}
    slots = {}
    for s, first, behind, base, picks, size in mixing.phases(blocks, {s: n**0.5 for s, n in chars.items()}, 50):
        slots |= {(s, k): base + (k - first) // len(picks) * size + picks[(k - first) % len(picks)] for k in range(first, behind)}
    assert sorted(slots.values()) == list(range(sum(blocks.values())))  # every slot is one block's
    assert all(slots[r["source"], r["mix_block"]] == r["mix_slot"] for r in got)


def test_mixing_cases(nasty):
    got = mixing.mix_sources(nasty.withColumn("source", F.col("h")))
    assert got.count() == len(NASTY)
    assert mixing.mix_sources(nasty.withColumn("source", F.col("h")).limit(0)).count() == 0


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs, plain = spark.read.parquet(f"{sf}/documents.parquet"), None
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i == 2:
            kept = {r["doc_id"] for r in out.select("doc_id").collect()}
            want = {c for _, c in brute_join([(r["doc_id"], r["text"]) for r in docs.collect()]).values()}
            assert kept == want
        docs, plain = out, docs
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in plain.select("doc_id").collect()}


def test_pipeline_keeps_columns_of_any_name(spark, nasty):  # noqa: F811
    docs, sf = nasty.select("*", F.lit(7).alias("toxic "), F.lit("s").alias("source"), F.lit(2).alias("n_chars")), "/root/testdata/sf0.001"
    want = docs.drop("text", "n_chars", "doc_id").distinct().count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [*nasty.columns, "toxic ", "source", "n_chars"], name
        assert docs.select("Toxic", "`a.b`", "n_lines", "mix_slot", "p_toxic").distinct().collect() == [(9, 9, 9, 9, 9)], name
    assert docs.drop("text", "n_chars", "doc_id").distinct().count() == want and docs.count() == len(NASTY) - 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == 6


def test_pipeline_of_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def test_join_head_counts_are_summed_over_fragments(monkeypatch):
    rng = np.random.default_rng(1)
    rows, expected = [(-2, np.array([3, 7], np.uint64), np.array([5, 9], np.uint64))], {3: 5, 7: 9}
    for f in range(6):
        tokens, sets = rng.integers(0, 50, 200).astype(np.uint64), rng.integers(0, 30, 200).astype(np.uint64)
        rows += [(f, tokens[at], sets[at]) for at in np.array_split(np.arange(200), 3)]
        holders = {}
        for t, s in zip(tokens.tolist(), sets.tolist()):
            holders.setdefault(t, set()).add(s)
        for of in holders.values():
            for s in of - {0} if len(of) > 1 or 0 in of else ():
                expected[s] = expected.get(s, 0) + 1
    packed = [(f, a.tobytes(), b.tobytes()) for f, a, b in rows]
    kinds = [pa.int32(), pa.binary(), pa.binary()]
    for held in (ngram_join.HELD, 10):
        monkeypatch.setattr(ngram_join, "HELD", held)
        for size in (1, 4, 100):
            parts = [packed[i : i + size] for i in range(0, len(packed), size)]
            batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*p), kinds)], ["f", "a", "b"]) for p in parts]
            for ranges in (1, 3):
                sent = [r for out in ngram_join._count_fragments(ranges)(iter(batches)) for r in zip(*out.to_pydict().values())]
                sent = [pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(r, kinds)], ["f", "a", "b"]) for r in sorted(sent)]
                got = [r for out in ngram_join._count_sets(iter(sent)) for r in zip(*out.to_pydict().values())]
                assert len(got) == len(expected) and dict(got) == expected
    assert not list(ngram_join._count_fragments(1)(iter([]))) and not list(ngram_join._count_sets(iter([])))


def test_join_elements_come_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(ngram_join, "BATCH", 4)
    held = {1: list(range(11)), 2: [5], 3: []}
    given = pa.RecordBatch.from_arrays([pa.array(held), pa.array([np.array(t, np.int64).tobytes() for t in held.values()], pa.binary())], ["s", "h"])
    out = list(ngram_join._elements(iter([given, given.slice(0, 0)])))
    assert max(len(b) for b in out) <= 4
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(t, s) for s, ts in held.items() for t in ts]

"""N-gram Jaccard join by vertical partitioning: classes of documents linked by shared word shingles.

A document's set holds the hashes of its distinct five-word shingles. The global order of
shingles is cut into fragments; overlaps are counted in each fragment separately and summed
for each pair. Before any pair is formed:

1. *Equal sets* become one node, by a pre-aggregated group of their 128-bit digests.
2. *Fragments of the head.* In hash order, two sets of similarity 0.8 share at least k of
   their first n - ceil(0.8 n) + k shingles (the prefix argument with k common elements;
   k = n div 10 + 1, and a partner is no smaller than 0.8 n). Each task sends the heads of
   its sets by fragment; a shingle that two sets of one task hold is settled there and
   sent once, so a shingle that a third of all sets hold costs one entry for each task.
   Sets with fewer shared head shingles than that can have no link and go no further.
3. *Rarest first.* For the rest, all shingles are counted and ordered by frequency among
   them; those of one set only drop out. Prefixes of n - ceil(0.8 n) + 1 in that order
   are the postings from which pairs come.

Pairs: a group of thousands of near copies would make all pairs of its members. For classes
one link to a connected member is enough, so each set is first compared with one leader of
its posting lists that is of another class: the most typical member, in later rounds
another one. Links merge classes. When such rounds yield little more, all remaining pairs of
different classes in a list are compared, so no link between classes is lost. That step forms
at most the pairs of one list whose lengths and places allow the similarity, and those of one
class never; a list is long only where many sets share one of their rarest shingles.

Verification: both sets' segments are joined fragment by fragment, partial overlaps counted
in each and summed for the pair, and 100 * overlap >= 80 * union decides.

Classes come from alternating large-star and small-star steps over the links, each a
pre-aggregated minimum and a join, over classes of the round before; nothing is gathered on the
driver but counts. Sides of counted size are broadcast in joins where they fit, a round's files
are deleted when the next one's stand, and few rows go to few tasks.

Defined cases: a null or wordless text has the empty set, which links with nothing; fewer
words than five are one shingle; rows with a null id get their number of shingles and no
class; rows that repeat an id each have their own set; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import cut, fits, forget, quoted, small, tasks_for, trimmed

WORDS = 5
NUM, DEN = 4, 5  # similarity 0.8
#: Segments of a set in verification.
SEGMENTS = 4
#: Entries of the head index for each fragment, about, and the most that a task holds back.
FRAGMENT_ENTRIES = 500_000
HELD = 500_000
#: Rows of an Arrow batch of single shingles.
BATCH = 65_536
#: Leader rounds end after so many, or when less than this share of a round's comparisons gives links.
LEADER_ROUNDS = 6
LEADER_YIELD = 0.02
REMEMBERED = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)

ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
         ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT w.doc_id, count(g.s) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS d, doc_id AS c FROM documents
  UNION SELECT l.b AS d, r.c FROM r JOIN l ON l.a = r.d
)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n
"""


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = (h ^ w[i : len(w) - width + 1 + i]) * MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def digest(h: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set as two signed numbers."""
    d = xxhash.xxh3_128_intdigest(h.tobytes())
    return tuple(np.array([d >> 64, d & (2**64 - 1)], np.uint64).view(np.int64).tolist())


def least(n):
    """The smallest overlap that a set of n elements needs."""
    return -(-NUM * n // DEN)


def head(n: int) -> int:
    return min(n, n - least(n) + n // 10 + 1)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = []
        for t in batch.column(1):
            h = shingles(t.as_py(), hashes)
            rows.append((len(h), *digest(h)))
        cols = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols), batch.column(2)], ["doc_id", "n", "fa", "fb", "h"])


def _settle(tokens: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, set) entries; a set 0 says that the token is shared anyway. Returns what to send on
    (one entry for a shared token, with set 0) and the sets with their numbers of shared tokens."""
    order = np.lexsort((sets, tokens))
    tokens, sets = tokens[order], sets[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])
    tokens, sets = tokens[new], sets[new]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    at = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    shared = (np.diff(np.append(at, len(tokens))) > 1) | (sets[at] == 0)
    credited, counts = np.unique(sets[shared[run] & (sets != 0)], return_counts=True)
    return tokens[at], np.where(shared, np.uint64(0), sets[at]), credited, counts


def _ranges(keys: np.ndarray, values: np.ndarray, n: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, keys, values) for each of ``n`` equal ranges of sorted 64-bit keys that has some."""
    part = (keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    at = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
    for a, b in zip(at, np.append(at[1:], len(keys))):
        yield int(part[a]), keys[a:b].tobytes(), values[a:b].astype(np.uint64).tobytes()


def _packed(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    types = [pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["f", "a", "b"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """The rows (f, a, b), which come in order of f, as (f, their pairs of arrays)."""
    now, rows = None, []
    for batch in batches:
        for f, a, b in zip(*(batch.column(i) for i in range(3))):
            f = f.as_py()
            if f != now and rows:
                yield now, rows
                rows = []
            now = f
            rows.append(tuple(np.frombuffer(x.as_buffer(), np.uint64).copy() for x in (a, b)))
    if rows:
        yield now, rows


def _heads(fragments: int):
    """Rows (fragment, tokens, sets): head entries by fragment, and under negative numbers counts settled in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0

        def sent() -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _ in held])
            sets = np.repeat(np.array([s for _, s in held], np.uint64), [len(t) for t, _ in held])
            tokens, sets, credited, counts = _settle(tokens, sets)
            rows = [*_ranges(tokens, sets, fragments)]  # of the global order
            if len(credited):
                rows.append((-1 - int(credited[0] % np.uint64(fragments)), credited.tobytes(), counts.astype(np.uint64).tobytes()))
            return _packed(rows)

        for batch in batches:
            for t in batch.column(0):
                h = shingles(t.as_py(), hashes)
                if len(h):
                    key = np.array(digest(h)[0], np.int64).view(np.uint64)
                    held.append((h[: head(len(h))].copy(), key if key else np.uint64(1)))
                    size += len(held[-1][0])
                if size >= HELD:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return run


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sets and the sums of their counts."""
    sets, at = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
    counts = np.zeros(len(sets), np.uint64)
    np.add.at(counts, at, np.concatenate([c for _, c in held]))
    return sets, counts


def _count_fragments(ranges: int):
    """Rows in order of fragment to rows (f, sets, counts) by range of the sets: their numbers of shared head shingles, summed
    over the task's fragments. Sums of more than ``HELD`` sets are sent on in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for f, rows in _runs(batches):
            done = rows if f < 0 else [_settle(*(np.concatenate(x) for x in zip(*rows)))[2:]]  # f < 0: settled in the task that sent it
            for sets, counts in done:
                held.append((sets, counts.astype(np.uint64)))
                size += len(sets)
            if size > 2 * HELD:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD:
                    yield _packed([*_ranges(*held[0], ranges)])
                    held, size = [], 0
        if size:
            yield _packed([*_ranges(*_summed(held), ranges)])

    return run


def _count_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range to one row (fa, n_shared) for each set."""
    for _, rows in _runs(batches):
        sets, counts = _summed(rows)
        yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64)), pa.array(counts.astype(np.int64))], ["fa", "n_shared"])


def _spots(s: np.ndarray, bits: int) -> list[np.ndarray]:
    h = s.astype(np.uint64) * MIX
    return [((h ^ (h >> np.uint64(31))) >> np.uint64(64 - bits)).astype(np.int64), ((h * MIX) >> np.uint64(64 - bits)).astype(np.int64)]


def _filter_parts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(1 << bits, bool)
        for batch in batches:
            for at in _spots(batch.column(0).to_numpy(zero_copy_only=False), bits):
                field[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(field).tobytes()], pa.binary())], ["b"])

    return run


def id_filter(ids: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter of ``ids``: 16 bits an id, but never more than 16 MB, beyond which it only lets more through."""
    bits = min(27, max(10, (16 * rows).bit_length()))
    parts = ids.repartition(4).mapInArrow(_filter_parts(bits), "b binary").collect()
    return np.unpackbits(np.bitwise_or.reduce([np.frombuffer(r["b"], np.uint8) for r in parts])).astype(bool)


def _likely_sets(packed):
    """(doc_id, text) to (s, fa, fb, h) of the rows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, field = WordHashes(), np.unpackbits(np.frombuffer(packed.value, np.uint8)).astype(bool)
        bits = len(field).bit_length() - 1
        for batch in batches:
            one, two = _spots(batch.column(0).to_numpy(zero_copy_only=False), bits)
            part = batch.filter(pa.array(field[one] & field[two]))
            rows, size = [], 0
            for i, (s, t) in enumerate(zip(part.column(0).to_pylist(), part.column(1)), 1):
                h = shingles(t.as_py(), hashes)
                rows.append((s, *digest(h), h.tobytes()))
                size += len(h)
                if size >= 8 * BATCH or i == len(part):
                    types = [pa.int64()] * 3 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["s", "fa", "fb", "h"])
                    rows, size = [], 0

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, h) to one row (t, s) for each shingle."""
    held, size = [], 0

    def sent() -> Iterator[pa.RecordBatch]:
        tokens, names = np.concatenate([t for t, _ in held]), np.repeat([s for _, s in held], [len(t) for t, _ in held])
        for at in range(0, len(tokens), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + BATCH]) for x in (tokens, names)], ["t", "s"])

    for batch in batches:
        for s, h in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = np.frombuffer(h.as_buffer(), np.int64)
            held.append((t.copy(), s))
            size += len(t)
            if size >= BATCH:
                yield from sent()
                held, size = [], 0
    if held:
        yield from sent()


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, n, [(df, t)]) to (s, n, typical, rarest-first tokens), for sets with enough shared shingles."""
    for batch in batches:
        rows = []
        for s, n, found in zip(*(batch.column(i) for i in range(3))):
            n, pairs = n.as_py(), found.values
            df, t = (pairs.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            if len(t) >= least(n):
                order = np.lexsort((t, df))
                rows.append((s.as_py(), n, float(df.sum()) / n, t[order].astype(np.int64).tobytes()))
        types = [pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["s", "n", "c", "ts"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, n, c, k, ts) to a row (t, s, n, c, k, rest) for each token of the prefix; rest: shared tokens from there on."""
    for batch in batches:
        for s, n, c, k, ts in zip(*(batch.column(i) for i in range(5))):
            n, t = n.as_py(), np.frombuffer(ts.as_py(), np.int64)
            size = min(n - least(n) + 1 - (n - len(t)), len(t))  # tokens of no other set come first
            if size > 0:
                cols = [t[:size], *(np.full(size, x) for x in (s.as_py(), n, c.as_py(), k.as_py())), len(t) - np.arange(size)]
                kinds = [np.int64, np.int64, np.int64, np.float64, np.int64, np.int64]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(d)) for x, d in zip(cols, kinds)], ["t", "s", "n", "c", "k", "rest"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, n, ts) to (s, n, f, seg): a set's shared tokens, cut by ranges of the global order."""
    for batch in batches:
        rows = []
        for s, n, ts in zip(*(batch.column(i) for i in range(3))):
            t = np.sort(np.frombuffer(ts.as_py(), np.int64).view(np.uint64))
            part = t >> np.uint64(62)
            cuts = np.searchsorted(part, np.arange(SEGMENTS + 1))
            rows += [(s.as_py(), n.as_py(), f, t[a:b].tobytes()) for f, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["s", "n", "f", "seg"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [
            len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True))
            for x, y in zip(batch.column(4), batch.column(5))
        ]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(got, pa.int64())], ["a", "b", "na", "nb", "o"])


def verified(pairs: DataFrame, rows: int, segments: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links: partial overlaps by fragment, summed. Sides are broadcast where they fit."""
    ends = pairs.select("b").distinct()
    held = cut(ends.join(segments, F.col("b") == F.col("s")).selectExpr("b", "n as nb", "f", "seg as y"))
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.length("y")), F.lit(0))).first()
    right = F.broadcast(held) if fits(64 * n + size, 1) else held
    left = segments.selectExpr("s as a", "n as na", "f", "seg as x").join(small(pairs.select("a", "b"), rows, 32), "a")
    both = left.join(right, ["b", "f"])
    partial = both.select("a", "b", "na", "nb", "x", "y").mapInArrow(trimmed(_overlaps), "a long, b long, na long, nb long, o long")
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    links = cut(summed.where(f"{DEN} * o >= {NUM} * (na + nb - o)").select("a", "b").coalesce(tasks_for(rows)))
    forget(held)
    return links


def components(links: DataFrame, rows: int) -> DataFrame:
    """(v, c) for each end of a link (a, b) of at most ``rows``: the smallest end that it reaches."""

    def sign(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    def least_of(e: DataFrame) -> DataFrame:
        return small(e.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), 2 * rows, 32)

    tasks = tasks_for(rows)
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().coalesce(tasks))
    seen = sign(edges)
    while seen[0]:
        back = edges.selectExpr("v as u", "u as v")
        # renamed, since Spark leaves a checkpoint's constraints as they were in its renewed copies, and a union can't read those
        low = least_of(back.union(back.selectExpr("v as x", "u as y")))
        large = back.join(low, "u").selectExpr("v as u", "least(u, m) as m").distinct().coalesce(tasks).withColumnRenamed("m", "v")
        large = cut(large)
        found = large.join(least_of(large), "u")
        found = found.selectExpr("u", "m as v").union(found.where("v <> m").selectExpr("v as u", "m as v"))
        before, edges = edges, cut(found.distinct().coalesce(tasks))
        forget(before, large)
        now = sign(edges)
        if now == seen:
            break
        seen = now
    ends = edges.groupBy("u").agg(F.min("v").alias("c")).selectExpr("u as v", "c")
    out = cut(ends.union(edges.selectExpr("v", "v as c").distinct()).coalesce(tasks))
    forget(edges)
    return out


def _long_enough(a: str, b: str) -> str:
    return f"{NUM} * greatest({a}.n, {b}.n) <= {DEN} * least({a}.n, {b}.n)"


def node_classes(nodes: DataFrame) -> DataFrame:
    """(s, k) of all ``nodes`` (s, n, c, ts), which are checkpointed: the smallest s that each reaches.

    A class's links lie in one label graph a round: only links between classes are carried on, so no
    round reads the links of earlier ones.
    """
    count, entries = nodes.agg(F.count("*"), F.expr(f"coalesce(sum(n - ({NUM} * n + {DEN - 1}) div {DEN} + 1), 0)")).first()
    labels = cut(nodes.selectExpr("s", "s as k"))
    segments = nodes.select("s", "n", "ts").mapInArrow(trimmed(_segments), "s long, n long, f int, seg binary")
    leading, step = True, 0
    while True:
        named = nodes.join(small(labels, count, 32), "s").select("s", "n", "c", "k", "ts")
        lists = named.mapInArrow(trimmed(_postings), "t long, s long, n long, c double, k long, rest long")
        key = F.struct("c", "s") if step == 0 else F.struct(F.xxhash64("s", F.lit(step)).cast("double").alias("c"), "s")
        mixed = lists.groupBy("t").agg(
            F.max(F.struct(key.alias("o"), "n", "k")).alias("l"), F.min("k").alias("k0"), F.max("k").alias("k1")
        )
        mixed = mixed.where("k0 <> k1").select("t", "l.o", "l.n", "l.k")
        if leading:  # each set with one leader of its lists
            found = lists.alias("x").join(mixed.alias("l"), "t").where(f"x.k <> l.k and {_long_enough('x', 'l')}")
            found = found.selectExpr("s as a", "x.k as ka", "struct(l.o, l.k) as o").coalesce(tasks_for(entries))
            pairs = found.groupBy("a", "ka").agg(F.max("o").alias("o")).selectExpr("a", "o.o.s as b", "ka", "o.k as kb").coalesce(tasks_for(count))
        else:  # the pairs of a list that are of two classes and whose places in it allow enough overlap
            left = lists.join(mixed.select("t"), "t", "left_semi")
            found = left.alias("x").join(left.alias("l"), "t").where(
                f"x.k < l.k and {_long_enough('x', 'l')} and"
                f" {NUM + DEN} * least(x.rest, l.rest) >= {NUM} * (x.n + l.n)"
            )
            pairs = found.selectExpr("x.s as a", "l.s as b", "x.k as ka", "l.k as kb").distinct()
        pairs = cut(pairs)
        n_pairs = pairs.count()
        links = verified(pairs, n_pairs, segments)
        n_links = links.count()
        if n_links:
            between = pairs.join(small(links, n_links, 32), ["a", "b"]).selectExpr("ka as a", "kb as b")
            merged = components(between, n_links)
            before = labels
            moved = labels.join(small(merged, 2 * n_links, 32), F.col("k") == F.col("v"), "left")
            labels = cut(moved.select("s", F.coalesce("c", "k").alias("k")))
            forget(before, merged)
        forget(pairs, links)
        if not leading:
            return labels
        step += 1
        leading = step < LEADER_ROUNDS and n_links > LEADER_YIELD * n_pairs


def linked_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, component_id and the class (g1, g2) of every row."""
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    hashed = rows.select("doc_id", "text", F.xxhash64("text").alias("h"))
    sets = cut(hashed.mapInArrow(trimmed(_sets), "doc_id long, n long, fa long, fb long, h long"))
    nodes = sets.where("n > 0 and doc_id is not null").groupBy("fa", "fb").agg(F.min("doc_id").alias("s"), F.first("n").alias("n"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    fragments = int(max(1, total * 3 // 10 // FRAGMENT_ENTRIES))
    heads = rows.where("doc_id is not null").select("text").mapInArrow(trimmed(_heads(fragments)), "f int, a binary, b binary")
    counts = heads.repartition("f").sortWithinPartitions("f").mapInArrow(trimmed(_count_fragments(fragments)), "f int, a binary, b binary")
    counts = counts.repartition("f").sortWithinPartitions("f").mapInArrow(trimmed(_count_sets), "fa long, n_shared long")
    likely = nodes.join(counts, "fa").where(f"n_shared >= ceil({NUM} * n / {DEN}) div 10 + 1")
    likely = cut(likely.select(F.monotonically_increasing_id().alias("v"), "s", "n", "fa", "fb"))  # v: a set's own number
    n_likely = likely.count()
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(id_filter(likely.select("s"), n_likely)).tobytes())
    found = rows.where("doc_id is not null").mapInArrow(trimmed(_likely_sets(packed)), "s long, fa long, fb long, h binary")
    found = found.join(small(likely.select("v", "s", "fa", "fb"), n_likely, 64), ["s", "fa", "fb"]).dropDuplicates(["v"])  # repeated rows count once
    elements = found.select("v", "h").mapInArrow(trimmed(_elements), "t long, s long")
    common = elements.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    grouped = elements.join(common, "t").groupBy("s").agg(F.collect_list(F.struct("df", "t")).alias("e"))
    ordered = grouped.join(small(likely.selectExpr("v as s", "n"), n_likely, 32), "s").select("s", "n", "e")
    tasks = max(tasks_for(n_likely, 5000), tasks_for(total, 2_000_000))
    classed = cut(ordered.mapInArrow(trimmed(_ordered), "s long, n long, c double, ts binary").coalesce(tasks))
    labels = node_classes(classed)
    firsts = likely.join(small(labels, n_likely, 32), F.col("v") == labels["s"]).select(likely["s"], "fa", "fb", "k")
    lowest = firsts.groupBy("k").agg(F.min("s").alias("component_id"))
    named = firsts.join(small(lowest, n_likely, 32), "k").select("fa", "fb", "k", "component_id")
    named = nodes.join(small(named, n_likely, 64), ["fa", "fb"], "left").select("fa", "fb", "k", F.coalesce("component_id", "s").alias("component_id"))
    return sets.join(named, ["fa", "fb"], "left").select(
        "doc_id",
        "h",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce("k", "fa").alias("g1"),
        F.when(F.col("k").isNull(), F.col("fb")).otherwise(0).alias("g2"),
    )


def join_ngrams(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return linked_rows(docs, doc_id, text).select("doc_id", "n_shingles", "component_id")


def first_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that are linked to another row of smaller (id, hash of the text); of equal rows one stays.

    Rows with a null id or without words are in no class and stay, each of them.
    """
    rows = linked_rows(docs, doc_id, text).where("n_shingles > 0 and doc_id is not null")
    keyed = rows.groupBy("doc_id", "h", "g1", "g2").agg(F.count("*").alias("m"))
    firsts = keyed.groupBy("g1", "g2").agg(F.min(F.struct("doc_id", "h")).alias("o"), F.sum("m").alias("rows")).where("rows > 1")
    marked = keyed.join(firsts, ["g1", "g2"]).select(
        F.col("doc_id").alias("__d"), F.col("h").alias("__h"), (F.struct("doc_id", "h") == F.col("o")).alias("__first"), F.col("m").alias("__m")
    )
    marked = cut(marked)
    n, repeated = marked.agg(F.count("*"), F.count_if(F.col("__first") & (F.col("__m") > 1))).first()
    key = (F.col(quoted(doc_id)).cast("long") == marked["__d"]) & (F.xxhash64(F.col(quoted(text)).cast("string")) == marked["__h"])

    def without(gone: DataFrame, rows: int) -> DataFrame:
        return docs.join(small(gone, rows, 48), key, "left_anti")

    if not repeated:
        return without(marked.where("not __first"), n)
    again = marked.where("__first and __m > 1")
    once = docs.join(small(again, repeated, 48), key, "left_semi").dropDuplicates([doc_id, text])
    return without(marked.where("not __first or __m > 1"), n).unionByName(once)

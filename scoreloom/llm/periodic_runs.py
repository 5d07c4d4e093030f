"""Periodic run detection: maximal repetitions of words, and texts without their repeated periods.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends
with period q, at least two periods and ``LEAST`` words long.

Detection is by a suffix automaton of the words. Its states are visited from the longest to the
shortest, and each passes the ordered set of its end positions on to its suffix link, the smaller
set into the larger. Where a position gets a new neighbour at a distance d not over the length of
the state, the words before both are alike over that length and no more: that is a square of
period d, and its run begins where the state's words do. The run's end follows by comparing words d
apart. A run of period q and length l has two ends q apart whose common suffix has l - q words,
which is at least LEAST / 2 and at least q, and between which that suffix ends nowhere else, for it
would have a smaller period. So each run is found at a state of at least LEAST / 2 words, and
shorter ones need no sets. Multiples of a period can be met while a set is not yet complete;
they give the same stretch, where the smallest counts.

Only stretches of words covered by windows of LEAST / 2 words that stand twice in the same stretch are
given to the automaton. The first l - q words of a run and the last l - q consist of such windows
and leave no word between them, so no run is lost, and most texts have no such stretch.

Plan: one ``mapInArrow`` over the scan, no shuffle; memory of one text's automaton (flat arrays);
a lost task is run again. Insertions are n log n at most, in blocks of bounded length.

Defined cases: a null text has no words; a text without runs has null figures and the digest of
no lines; a null id is kept, and its text is not rewritten; repeated rows are each read; further
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import quoted
from scoreloom.llm.ngram_join import MIX, WordHashes

#: The least words of a run, and of a window that all its words are in.
LEAST = 12
WINDOW = LEAST // 2
#: Rounds in which stretches are cut down to what repeats within them.
ROUNDS = 8
#: Positions in a block of an ordered set.
BLOCK = 512
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)
RUNS = "array<struct<start:long,length:long,period:long>>"

ORACLE_SQL = """
WITH t AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
         lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, t
), v AS (
  SELECT doc_id, ws, len(ws) AS n, h // 10 AS g, h % 10 = 0 AND len(ws) > 0 AS planted FROM w
), a AS (
  SELECT doc_id, ws, n, planted, CASE WHEN planted THEN g % n ELSE n END AS a,
         CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM v
), x AS (
  SELECT doc_id, n, list_transform(range(n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) AS ws FROM a
), g AS (
  SELECT doc_id, i, array_to_string(ws[i + 1 : i + 6], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(greatest(n - 5, 0))) AS i FROM x)
), q AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i
), s AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q
), m AS (
  SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 6 + q AS length FROM s GROUP BY doc_id, q, island
), r AS (
  SELECT doc_id, start, length, min(q) AS period FROM m WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length
), f AS (
  SELECT doc_id, count(*) AS n_runs, list({'s': start, 'l': length, 'p': period} ORDER BY start, period) AS runs,
         list({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period)[1] AS top FROM r GROUP BY doc_id
)
SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, 1000 * top.l // top.p AS exponent_milli,
  sha256(coalesce(array_to_string(list_transform(runs, lambda r: r.s || ',' || r.l || ',' || r.p || chr(10)), ''), '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN runs IS NULL THEN ws ELSE list_transform(list_filter(range(n),
    lambda i: len(list_filter(runs, lambda r: i >= r.s + r.p AND i < r.s + r.l)) = 0), lambda i: ws[i + 1]) END, ' '), '')) AS collapsed_sha256
FROM x LEFT JOIN f USING (doc_id)
"""


class Places:
    """An ordered set of positions in blocks of bounded length."""

    def __init__(self, rows: list[int]):
        self.rows, self.heads, self.size = [rows], [rows[0]], len(rows)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for row in self.rows:
            yield from row

    def put(self, x: int) -> tuple[int, int]:
        """Inserts a new position; the ones before and behind it, or -1."""
        k = max(0, bisect_right(self.heads, x) - 1)
        row = self.rows[k]
        at = bisect_left(row, x)
        before = row[at - 1] if at else self.rows[k - 1][-1] if k else -1
        behind = row[at] if at < len(row) else self.rows[k + 1][0] if k + 1 < len(self.rows) else -1
        row.insert(at, x)
        self.heads[k] = row[0]
        self.size += 1
        if len(row) > 2 * BLOCK:
            self.rows[k : k + 1] = [row[:BLOCK], row[BLOCK:]]
            self.heads[k : k + 1] = [row[0], row[BLOCK]]
        return before, behind


class SuffixAutomaton:
    """States of all factors of a sequence of small whole numbers, with suffix links.

    Most states have one way on: it stands in flat arrays, further ones in a table.
    """

    def __init__(self, word: list[int]):
        self.link, self.length, self.end = array("i", [-1]), array("i", [0]), array("i", [-1])
        self.sign, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        link, length, end, sign, to, more = self.link, self.length, self.end, self.sign, self.to, self.more
        last = 0
        for i, c in enumerate(word):
            new = len(link)
            link.append(0)
            length.append(i + 1)
            end.append(i)
            sign.append(-1)
            to.append(-1)
            p, q, last = last, -1, new
            while p >= 0:
                if sign[p] == c:
                    q = to[p]
                    break
                ways = more.get(p)
                if ways is not None and c in ways:
                    q = ways[c]
                    break
                if sign[p] < 0:
                    sign[p], to[p] = c, new
                elif ways is None:
                    more[p] = {c: new}
                else:
                    ways[c] = new
                p = link[p]
            if q < 0:
                continue
            if length[q] == length[p] + 1:
                link[new] = q
                continue
            copy = len(link)
            link.append(link[q])
            length.append(length[p] + 1)
            end.append(-1)
            sign.append(sign[q])
            to.append(to[q])
            if q in more:
                more[copy] = dict(more[q])
            while p >= 0:
                if sign[p] == c:
                    if to[p] != q:
                        break
                    to[p] = copy
                else:
                    ways = more[p]
                    if ways[c] != q:
                        break
                    ways[c] = copy
                p = link[p]
            link[q] = link[new] = copy


def seeds(word: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of squares: two ends that become neighbours in the set of a state long enough, from its first word on."""
    known = SuffixAutomaton(word)
    link, length, end = known.link, known.length, known.end
    sizes = np.frombuffer(length, np.int32)
    order = np.argsort(-sizes, kind="stable")[: int((sizes >= WINDOW).sum())].tolist()
    del known, sizes
    sets: dict = {}
    for v in order:
        own = sets.pop(v, None)
        if end[v] >= 0:  # a prefix: its own end is the set's, with what its children sent
            size = length[v]
            if own is None:
                own = [end[v]]
            else:
                for pair in _put(own, [end[v]]):
                    if pair[1] - pair[0] <= size:
                        yield pair[0] - size + 1, pair[1], pair[1] - pair[0]
                own = _blocks(own)
        u = link[v]
        size = length[u]
        if size < WINDOW:
            continue
        there = sets.get(u)
        if there is None:
            sets[u] = own
            continue
        if len(own) > len(there):
            own, there = there, own
        for i, j in _put(there, own):
            if j - i <= size:
                yield i - size + 1, j, j - i
        sets[u] = _blocks(there)


def _blocks(places):
    return Places(places) if isinstance(places, list) and len(places) > BLOCK else places


def _put(large, few) -> Iterator[tuple[int, int]]:
    """Inserts the rising ``few`` into ``large``; the pairs of neighbours, one of either, that come about."""
    last = -1
    if isinstance(large, list):
        for x in few:
            at = bisect_left(large, x)
            if at and large[at - 1] != last:
                yield large[at - 1], x
            if at < len(large):
                yield x, large[at]
            large.insert(at, x)
            last = x
        return
    for x in few:
        before, behind = large.put(x)
        if before != last:
            yield before, x
        if behind >= 0:
            yield x, behind
        last = x


def runs_in(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of small whole numbers."""
    n, row, seen, found = len(word), np.array(word, np.int32), set(), {}
    for start, end, d in seeds(word):
        if (start, d) in seen:
            continue
        seen.add((start, d))
        at, step = end + 1, 32
        while at < n:
            differ = row[at : at + step] != row[at - d : min(at + step, n) - d]
            if differ.any():
                at += int(differ.argmax())
                break
            at, step = min(at + step, n), 2 * step
        if at - start >= max(LEAST, 2 * d):
            key = (start, at - start)
            found[key] = min(d, found.get(key, d))
    return sorted((s, size, d) for (s, size), d in found.items())


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of words covered by windows that repeat within their stretch; every run lies in one."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return []
    g = np.full(n, WINDOW, np.uint64)
    for i in range(WINDOW):
        g = (g ^ hashes[i : n + i]) * MIX
        g ^= g >> np.uint64(29)
    ranked = np.sort(g)
    if not (ranked[1:] == ranked[:-1]).any():
        return []
    places, part = np.arange(n), np.zeros(n, np.uint64)
    for _ in range(ROUNDS):
        key = g[places] ^ (part * MIX)
        order = np.argsort(key)
        ranked = key[order]
        alike = ranked[1:] == ranked[:-1]
        keep = np.zeros(len(places), bool)
        keep[order[1:][alike]] = True
        keep[order[:-1][alike]] = True
        kept = places[keep]
        if not len(kept):
            return []
        first = np.ones(len(kept), bool)
        first[1:] = kept[1:] - kept[:-1] > WINDOW
        done = len(kept) == len(places)
        places, part = kept, np.cumsum(first).astype(np.uint64)
        if done:
            break
    at = np.flatnonzero(np.append(first, True))
    return [(int(places[a]), int(places[b - 1]) + WINDOW) for a, b in zip(at, at[1:])]


def runs_of(words: list[bytes], hashes: WordHashes) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the words, by start and period."""
    if len(words) < LEAST:
        return []
    out = []
    for a, b in stretches(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))):
        if b - a >= LEAST:
            names: dict = {}
            out += [(a + s, size, d) for s, size, d in runs_in([names.setdefault(w, len(names)) for w in words[a:b]])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those behind the first period of a run that they are in."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s + d for s, _, d in runs], 1)
    np.add.at(edge, [s + size for s, size, _ in runs], -1)
    return list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rewriting: every tenth document, by the CRC of its id, repeats a piece of itself to its end."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def detect_runs(
    docs: DataFrame,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
    keep: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its runs' number, the longest one, and digests of all runs and of the collapsed text.

    ``rewrite`` changes the words first; with ``keep`` the runs and the collapsed text come along."""
    schema = SCHEMA + (f", runs {RUNS}, collapsed string" if keep else "")
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    types = [*[pa.int64()] * 5, pa.string(), pa.string(), *([run_type, pa.string()] if keep else [])]
    names = ["doc_id", *"n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split(), *(["runs", "collapsed"] if keep else [])]

    def of(row_id: int | None, content: bytes | None, hashes: WordHashes) -> tuple:
        words = (content or b"").split()
        if rewrite is not None:
            words = rewrite(row_id, words)
        runs = runs_of(words, hashes)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{size},{d}\n" for s, size, d in runs)
        left = b" ".join(collapsed(words, runs))
        milli = 1000 * top[1] // top[2] if runs else None
        row = (len(runs), *top, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
        return row + (([dict(zip(("start", "length", "period"), r)) for r in runs], left.decode()) if keep else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [of(i.as_py(), t.as_py(), hashes) for i, t in zip(batch.column(0), batch.column(1))]
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    read = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").cast("binary").alias("text"))
    return read.mapInArrow(run, schema)

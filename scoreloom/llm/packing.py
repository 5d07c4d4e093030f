"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised whole, closed with ``END``, and cut only where longer than a bin;
the first piece is then the shorter one. Pieces that fill a bin are bins of their own. The
rest are packed into as few bins as possible.

Grouping genetic algorithm: an individual is a set of bins. Crossover takes whole
well-filled bins of one parent into the other, removes the bins that hold the same pieces,
and puts the displaced pieces back by best fit (the fullest bin that still takes a piece,
found in a table of free room, longest pieces first). Mutation dissolves some of the
least-filled bins likewise. In both, bins first exchange one of their pieces for a longer loose one.
Evolution starts from best fit decreasing and ends at the bound of the lengths' sum: a block
where best fit meets the bound is packed as well as can be, and needs no crossover. Pieces of one length are interchangeable for packing, so an
individual's bins are multisets of lengths and a crossover is cheap.

Islands: pieces are dealt by place into blocks of about ``block_pieces`` (more where these are
so short that they fill less than four bins); each block is worked on by
``islands`` populations with their own seeds, one task each. After each of ``epochs`` every
island's best individual migrates to the next island of the block, as a row of a few
kilobytes. The winners' full bins stand; the pieces of bins that are filled below
``settled`` are packed once more with those of neighbouring blocks, until one block is left
or no bin can be saved.

Only lengths and ids are shuffled, never texts or tokens. The assignment then joins back to
the pieces.

Defined cases: a null text counts as empty and is one piece holding ``END`` alone; repeated
rows are each packed; null ids are kept; an empty table gives no row; further columns are
not read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.common import cut, quoted

BIN = 2048
END = 0
BLOCK_PIECES = 3000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 30
POPULATION = 8
#: Bins of an individual that evolve in an epoch.
EVOLVED = 80
SETTLED = 0.995
REMEMBERED = 250_000
#: Words handed to the tokenizer, and texts held in words, at a time.
WORDS = 1000
TEXTS = 100
SPECIAL = "<|"
#: The vocabulary's own split of texts, a probe of it, and white space that keeps a text whole.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's a  probe:\n 123 don't -- \u00e9\U0001f600\u4e16 (x_y)\t$$$ THTION ouan\u00e8re."
ODD_SPACE = ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))


# Tokens ------------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers.

    The tokenizer's first step never joins what stands on two sides of a line break or of a
    single space, if neither neighbour is white space; a space goes with the word behind it.
    Such words are encoded once and remembered. Other texts go to the tokenizer whole. Words
    are encoded by an equal, faster encoder made from the tokenizer's own vocabulary, if its
    merge list says that the two are equal (``merges_rank_as_ids``), else by the tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel part; threads would each keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.first: dict[str, bytes] = {}  # at the start of a line
        self.inner: dict[str, bytes] = {}  # behind a space
        self.line = self.whole(["\n"])[0]
        self.words = self._fast(path) or self.whole

    def _fast(self, path: str):
        """An encoder that merges the adjacent pair whose token has the smallest id, if that is the tokenizer's own rule."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = byte_letters()
        special = {t["content"] for t in described.get("added_tokens", ())}
        vocabulary = {t: i for t, i in described["model"]["vocab"].items() if t not in special}
        if described["model"].get("type") != "BPE" or not merges_rank_as_ids(vocabulary, described["model"]["merges"], letters):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        if fast.encode_ordinary(PROBE) != self.tokenizer.encode(PROBE, add_special_tokens=False).ids:  # the split of texts
            return None
        return lambda words: [array("I", fast.encode_ordinary(w)).tobytes() for w in words]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.first, self.inner = {}, {}

    def _learn(self, known: dict[str, bytes], words: set[str], space: str) -> None:
        new = words.difference(known)
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = words
            new = sorted(new)
            for at in range(0, len(new), WORDS):  # the tokenizer's own results are far larger than the ids
                part = new[at : at + WORDS]
                known.update(zip(part, self.words([space + w for w in part])))

    def encode(self, texts: list[str]) -> list[bytes]:
        lines = [[x.split(" ") for x in t.split("\n")] if splits(t) else None for t in texts]
        self._learn(self.first, {x[0] for part in lines if part for x in part}, "")
        self._learn(self.inner, {w for part in lines if part for x in part for w in x[1:]}, " ")
        return [self._joined(part) if part else self.whole([t])[0] for t, part in zip(texts, lines)]

    def _joined(self, lines: list[list[str]]) -> bytes:
        out: list[bytes] = []
        for k, (head, *rest) in enumerate(lines):
            if k:
                out.append(self.line)
            out.append(self.first[head])
            out += map(self.inner.__getitem__, rest)
        return b"".join(out)


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one letter: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


def merges_rank_as_ids(vocabulary: dict[str, int], merges: list, letters: dict[str, int]) -> bool:
    """Whether every token is a byte or the outcome of exactly one merge, and the merges stand in the order of their tokens' ids."""
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    ids = [vocabulary.get("".join(p), -1) for p in pairs]
    single = [i for t, i in vocabulary.items() if len(t) == 1]
    return (
        all(len(p) == 2 and p[0] in vocabulary and p[1] in vocabulary for p in pairs)
        and all(a < b for a, b in zip([max(single, default=-1), *ids], ids))
        and len(single) == 256 == len([t for t in vocabulary if t in letters])
        and len(vocabulary) == len(pairs) + 256
    )


def splits(text: str) -> bool:
    """Whether ``text`` may be encoded word by word: its only white space is single spaces and single breaks inside."""
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and SPECIAL not in text and not any(x in text for x in ODD_SPACE)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder; its memory of words is a task's."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces_of(ids: bytes, size: int = BIN) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of a closed document."""
    n = len(ids) // 4
    first = n if n <= size else n % size or size
    out, start, length = [], 0, first
    while start < n:
        out.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
        start, length = start + length, size
    return out


def tokenised_pieces(docs: DataFrame, tokenizer: str, doc_id: str, text: str, size: int, place: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(tokenizer), np.array([END], "<u4").tobytes()
        known.forget()  # a worker that stays idle after its task holds no words
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part, rows = batch.slice(at, TEXTS), []
                ids = known.encode([t or "" for t in part.column(1).to_pylist()])
                for d, w, x in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), ids):
                    rows += [(d, i, *p, w) for i, p in enumerate(pieces_of(x + end, size))]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                cols = list(zip(*rows)) if rows else [[]] * 6
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "w"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        known.forget()

    rows = docs.select(
        F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"), place.cast("double").alias("w")
    )
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, w double")


# The genetic algorithm over lengths ---------------------------------------------------------------------------------


class Room:
    """Open bins by free room, with a bit for each room that occurs: best fit in a few steps."""

    def __init__(self, size: int):
        self.size, self.bits, self.open = size, 0, [[] for _ in range(size + 1)]

    def add(self, content: list[int], free: int) -> None:
        self.open[free].append(content)
        self.bits |= 1 << free

    def place(self, length: int) -> None:
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            content = self.open[free].pop()
            if not self.open[free]:
                self.bits ^= 1 << free
        else:
            content, free = [], self.size
        content.append(length)
        self.add(content, free - length)

    def bins(self) -> list[tuple[int, ...]]:
        return [tuple(sorted(c, reverse=True)) for contents in self.open for c in contents]


def best_fit(lengths, size: int, into=()) -> list[tuple[int, ...]]:
    room = Room(size)
    for b in into:
        room.add(list(b), size - sum(b))
    for n in lengths:
        room.place(n)
    return room.bins()


def fitness(bins: list, size: int) -> tuple[int, float]:
    """Fewer bins, then unevenly filled ones, which leave one bin nearly free."""
    return -len(bins), sum((sum(b) / size) ** 2 for b in bins)


def exchange(bins: list, loose: list[int], size: int) -> tuple[list, list[int]]:
    """Each bin that isn't full takes a longer loose length for one of its own, where that leaves least room."""
    loose, out = sorted(loose), []
    for b in bins:
        free = size - sum(b)
        if free and loose:
            gains = [(loose[at] - own, own, loose[at]) for own in b if (at := bisect_right(loose, own + free) - 1) >= 0]
            gain, own, new = max(gains, default=(0, 0, 0))
            if gain > 0:
                del loose[bisect_right(loose, new) - 1]
                insort(loose, own)
                rest = list(b)
                rest.remove(own)
                b = tuple(sorted((*rest, new), reverse=True))
        out.append(b)
    return out, loose


def crossover(one: list, other: list, size: int, rng: np.random.Generator) -> list:
    """Whole well-filled bins of ``one`` go into ``other``; what they displace is put back by best fit."""
    good = sorted(one, key=sum, reverse=True)
    taken = [good[i] for i in np.flatnonzero(rng.random(max(1, len(good) // 2)) < 0.7)]
    need = Counter(x for b in taken for x in b)
    kept, loose = [], []
    for b in sorted(other, key=sum):
        hit = [x for x in b if need[x] > 0] if need else []
        if not hit:
            kept.append(b)
            continue
        left = []
        for x in b:  # a length of the injected bins is removed where it is found first
            if need[x] > 0:
                need[x] -= 1
            else:
                left.append(x)
        loose += left
        need = +need
    kept, loose = exchange(kept, loose, size)
    return best_fit(sorted(loose, reverse=True), size, taken + kept)


def mutate(bins: list, size: int, rng: np.random.Generator) -> list:
    """The least-filled bins, and some others, are dissolved; what they held goes back by exchanges and best fit."""
    order = sorted(bins, key=sum)
    n = min(len(order), 2 + int(rng.integers(0, max(1, len(order) // 10))))
    more = set(rng.choice(len(order), min(len(order), n // 2 + 1), replace=False).tolist()) | set(range(n))
    loose = [x for i in more for x in order[i]]
    kept, loose = exchange([b for i, b in enumerate(order) if i not in more], loose, size)
    rng.shuffle(loose)
    return best_fit(sorted(loose, reverse=True) if rng.random() < 0.5 else loose, size, kept)


def evolve(lengths: list[int], size: int, seed: int, guests: list, generations: int, population: int) -> list:
    """The best individual of one island after some generations, from best fit decreasing and the guests.

    Where the best one needs more bins than the bound, its ``EVOLVED`` least-filled and otherwise random bins
    evolve; the rest of its bins stand for this epoch.
    """
    rng = np.random.default_rng(seed)
    best = max([best_fit(sorted(lengths, reverse=True), size), *guests], key=lambda b: fitness(b, size))
    if len(best) <= -(-sum(lengths) // size):
        return best
    order = sorted(best, key=sum)
    later = np.sort(rng.choice(len(order), min(len(order), EVOLVED), replace=False)).tolist()
    chosen = [*range(min(len(order), EVOLVED // 2)), *later]
    chosen = list(dict.fromkeys(chosen))[:EVOLVED]
    fixed = [b for i, b in enumerate(order) if i not in set(chosen)]
    first = [order[i] for i in chosen]
    loose = [x for b in first for x in b]
    bound = -(-sum(loose) // size)
    people = [first]
    while len(people) < population and min(map(len, people)) > bound:
        mixed = np.array(loose)
        rng.shuffle(mixed)
        half = len(mixed) // 2
        people.append(best_fit([*sorted(mixed[:half].tolist(), reverse=True), *mixed[half:].tolist()], size))
    for _ in range(generations):
        people.sort(key=lambda b: fitness(b, size), reverse=True)
        if len(people[0]) <= bound:
            break
        a, b = people[0], people[int(rng.integers(1, len(people)))] if len(people) > 1 else people[0]
        child = mutate(crossover(a, b, size, rng), size, rng)
        people = [*people[: population - 1], child]
    return fixed + max(people, key=lambda b: fitness(b, size))


def pack_bits(bins: list) -> bytes:
    return b"".join(np.array([len(b), *b], "<u2").tobytes() for b in bins)


def unpack_bits(data: bytes) -> list[tuple[int, ...]]:
    x, out, at = np.frombuffer(data, "<u2").tolist(), [], 0
    while at < len(x):
        out.append(tuple(x[at + 1 : at + 1 + x[at]]))
        at += 1 + x[at]
    return out


def _epoch(size: int, generations: int, population: int, epoch: int):
    """Rows (block, island, lengths, best, guest): another epoch of each island."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, island, lengths, best, guest in zip(*(batch.column(i).to_pylist() for i in range(5))):
                known = [unpack_bits(x) for x in (best, guest) if x]
                got = evolve(np.frombuffer(lengths, "<u2").tolist(), size, hash((block, island, epoch)) & 0xFFFFFFFF, known, generations, population)
                cols = [pa.array([block], pa.int64()), pa.array([island], pa.int32()), pa.array([lengths], pa.binary()), pa.array([pack_bits(got)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["block", "island", "lengths", "best"])

    return run


def evolve_blocks(blocks: DataFrame, size: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """(block, best): the best individual of any island, from (block, lengths)."""
    state = blocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).select(
        "block", "island", "lengths", F.lit(None).cast("binary").alias("best"), F.lit(None).cast("binary").alias("guest")
    )
    around = Window.partitionBy("block").orderBy("island")
    for epoch in range(epochs):
        state = state.repartition("block", "island")  # one task for each island, if there are as many
        state = cut(state.mapInArrow(_epoch(size, generations, population, epoch), "block long, island int, lengths binary, best binary"))
        if epoch + 1 < epochs:  # elites go round the block's ring
            guest = F.coalesce(F.lag("best").over(around), F.last("best").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            state = state.withColumn("guest", guest).select("block", "island", "lengths", "best", "guest")

    def winners(pdf: pd.DataFrame) -> pd.DataFrame:
        best = max((unpack_bits(x) for x in pdf["best"]), key=lambda b: fitness(b, size))
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "best": [pack_bits(best)]})

    return state.select("block", "best").groupBy("block").applyInPandas(winners, "block long, best binary")


def _bins(size: int, settled: float, last: bool):
    """Each winner's bins with their pieces: (block, best, lengths, us) to rows (u, block, bin, length, offset, done)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, best, lengths, us in zip(*(batch.column(i).to_pylist() for i in range(4))):
                waiting = defaultdict(list)  # pieces of one length are as good as each other
                for n, u in zip(np.frombuffer(lengths, "<u2").tolist(), np.frombuffer(us, "<i8").tolist()):
                    waiting[n].append(u)
                rows = []
                for i, b in enumerate(unpack_bits(best)):
                    done, at = last or sum(b) >= settled * size, 0
                    for n in b:
                        rows.append((waiting[n].pop(), block, i, n, at, done))
                        at += n
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["u", "block", "bin", "length", "offset", "done"])

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = BIN,
    block_pieces: int = BLOCK_PIECES,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
    settled: float = SETTLED,
    place: Column | None = None,
) -> DataFrame:
    """One row for each piece, with its sequence and its place there.

    ``place``, a number from 0 to below 1, is a document's place in an order that sequences
    should follow: a block takes neighbours in it. Without it documents are dealt by a hash.
    """
    if place is None:  # the row's number keeps repeated rows apart
        hashed = F.xxhash64(F.col(quoted(doc_id)), F.col(quoted(text)), F.monotonically_increasing_id())
        place = F.shiftrightunsigned(hashed, 12).cast("double") / 2.0**52
    if size > 65535:
        raise ValueError("lengths are held in 16 bits")
    pieces = cut(
        tokenised_pieces(docs, tokenizer, doc_id, text, size, place).withColumn("u", F.monotonically_increasing_id())
    )
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", F.col("u") * 2).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out, rest, level = full.select(*columns), pieces.where(F.col("length") < size).select("u", "w", "length"), 0
    places = None
    n, tokens = rest.agg(F.count("*"), F.sum("length")).first()
    while n:
        blocks = max(1, min(round(n / block_pieces), tokens // (4 * size)))  # a block fills some bins, be its pieces ever so short
        last = blocks == 1
        dealt = rest.withColumn("block", F.least(F.floor(F.col("w") * blocks), F.lit(blocks - 1)).cast("long"))
        work = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("length", "u"))).alias("l"))
        work = cut(work.select("block", "l.length", "l.u").mapInArrow(_lengths, "block long, lengths binary, us binary"))
        best = evolve_blocks(work.select("block", "lengths"), size, islands, epochs, generations, population)
        won = best.join(work, "block").select("block", "best", "lengths", "us")
        placed = cut(won.mapInArrow(_bins(size, settled, last), "u long, block long, bin long, length long, offset long, done boolean"))
        placed = cut(placed.join(rest.select("u", "w"), "u")) if not last else placed
        done = placed.where("done").select(
            "u", ((F.col("block") * (1 << 32) + F.col("bin")) * 64 + level).alias("b"), "offset"
        )
        places = done if places is None else places.union(done)
        if last:
            break
        rest, level = placed.where("not done").select("u", "w", "length"), level + 1
        before, (n, tokens) = n, rest.agg(F.count("*"), F.sum("length")).first()
        if n > 0.9 * before:  # little settles at this size: take what there is
            settled = 0.0
    if places is not None:
        placed = pieces.join(places, "u").withColumn("sequence_id", F.col("b") * 2 + 1)
        out = out.unionByName(placed.select(*columns))
    return out


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, us = ([np.array(x, k).tobytes() for x in batch.column(i).to_pylist()] for i, k in ((1, "<u2"), (2, "<i8")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.binary()), pa.array(us, pa.binary())], ["block", "lengths", "us"])

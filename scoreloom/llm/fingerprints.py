"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Every paragraph is hashed into one wide vector, and a document's fingerprint is the sum
of its paragraphs' vectors, lane by lane, modulo a power of two. The order of paragraphs
plays no part, and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has two parts:

* ``EQUAL_LANES`` lanes modulo 2^64 from a 512-bit BLAKE2b digest of the whole paragraph;
  they decide equality;
* ``LIKE_LANES`` lanes modulo 2^32 (a text has fewer bytes than 2^31, so none overflows), to which each code point of the paragraph adds +1 or
  -1 in one lane, chosen by a hash of the 16 bytes that begin there (zeros behind the
  paragraph's end), so every byte counts whatever the script. Read as signed
  numbers they are a linear sketch, whose cosine estimates how much two texts share.

Fingerprints of edited texts come from the update rule: subtract the paragraphs that the
edit touches, add the new ones.

Ordering: the edit takes text from the next document by id. Split points of the id column
and each interval's first id are computed first (one number per interval); the rows are
then dealt by interval once, each interval also gets the first document of the one that
follows, and a partition streams through its sorted rows. There is no global window.

Defined cases: null texts count as empty; the empty text has no paragraph and the
fingerprint zero; empty lines are not paragraphs; two equal fingerprints have likeness 1,
and a zero sketch against another has 0; null ids come first; rows with one id are ordered
by their text; a single document is its own next one; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import search_tree, shuffle_partitions

EQUAL_LANES = 8
LIKE_LANES = 256
#: Bytes of zeros between paragraphs, so that no 16-byte window reaches into the next one.
GAP = b"\n" + bytes(16)
#: Odd multipliers of the window hash.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))

#: Bytes hashed at a time, which bounds the memory of a long text.
CHUNK = 1 << 20
#: Bytes that begin a code point.
_BEGINS = np.array([(b & 0xC0) != 0x80 for b in range(256)])

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


class Fingerprint:
    """Lane sums of a multiset of paragraphs."""

    __slots__ = ("equal", "like")

    def __init__(self, equal: np.ndarray | None = None, like: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL_LANES, np.uint64) if equal is None else equal
        self.like = np.zeros(LIKE_LANES, np.uint32) if like is None else like

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        """The sum over the paragraphs (non-empty lines) of ``text``."""
        parts = [p for p in text.encode("utf-8", "surrogatepass").split(b"\n") if p]
        if not parts:
            return cls()
        digests = b"".join(hashlib.blake2b(p, digest_size=64).digest() for p in parts)
        equal = np.frombuffer(digests, "<u8").reshape(-1, EQUAL_LANES).sum(axis=0, dtype=np.uint64)
        raw = GAP + GAP.join(parts) + GAP
        codes = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes + len(GAP))
        edges = np.zeros(len(raw), np.int8)
        edges[ends - sizes], edges[ends] = 1, -1
        inside = np.cumsum(edges, dtype=np.int8).view(bool)  # not the gaps
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        counts = np.zeros(2 * LIKE_LANES, np.int64)
        for a in range(0, len(raw) - len(GAP), CHUNK):
            b = min(a + CHUNK, len(raw) - len(GAP))
            at = np.flatnonzero(_BEGINS[codes[a:b]] & inside[a:b]) + a
            h = (words[at] * MIX[0]) ^ (np.bitwise_xor(words[at + 8], words[at + 8] >> np.uint64(29)) * MIX[1])
            h ^= h >> np.uint64(32)
            h *= MIX[2]
            lane = (h >> np.uint64(55)).astype(np.int64)  # 9 bits: the lane, then the sign
            counts += np.bincount(lane, minlength=2 * LIKE_LANES)
        return cls(equal, (counts[0::2] - counts[1::2]).astype(np.uint32))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal + other.equal, self.like + other.like)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal - other.equal, self.like - other.like)

    def __eq__(self, other) -> bool:
        return np.array_equal(self.equal, other.equal) and np.array_equal(self.like, other.like)

    def hex(self) -> str:
        return self.equal.astype("<u8").tobytes().hex() + self.like.astype("<u4").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        if self == other:
            return 1.0
        a, b = (x.like.view(np.int32).astype(np.float64) for x in (self, other))
        scale = np.sqrt((a @ a) * (b @ b))
        return float(min(1.0, max(0.0, (a @ b) / scale))) if scale else 0.0


def edited_pair(text: str, following: str, own: Fingerprint) -> tuple[str, Fingerprint]:
    """The edited text and its fingerprint, updated from that of ``text``."""
    k = len(text) // 4
    if not k:
        return text, own
    kept = text[: len(text) - k]
    edited = kept + following[:k]
    at = kept.rfind("\n") + 1
    return edited, own - Fingerprint.of(text[at:]) + Fingerprint.of(edited[at:])


def _row(doc_id, text: str, own: Fingerprint, following: str, after: Fingerprint) -> tuple:
    edited, changed = edited_pair(text, following, own)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own.hex(), changed.hex(), own.likeness(changed), own.likeness(after)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (interval, ahead, id, text), sorted; rows ``ahead`` only serve the one before them."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    held, out = None, []

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    for batch in batches:
        for part, ahead, doc_id, text in zip(*(batch.column(i) for i in range(4))):
            part, ahead, doc_id, text = part.as_py(), ahead.as_py(), doc_id.as_py(), text.as_py() or ""
            if ahead and (held is None or held[0] != part):
                continue
            own = Fingerprint.of(text)
            if held is not None:
                out.append(_row(*held[1:], text, own))
            held = None if ahead else (part, doc_id, text, own)
            if len(out) >= 500:
                yield packed()
                out = []
    if held is not None:
        raise ValueError("an interval has no row of the following one")
    if out:
        yield packed()


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses."""
    spark = docs.sparkSession
    rows = docs.selectExpr(
        f"coalesce(cast(`{doc_id}` as long), {-(2**63)}L) as id", f"coalesce(cast(`{text}` as string), '') as text"
    )
    n = shuffle_partitions(spark)
    splits = rows.select("id").stat.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    splits = sorted({int(x) for x in splits})
    part = search_tree(F.col("id"), splits)
    firsts = sorted((r["id"], r["part"]) for r in rows.groupBy(part.alias("part")).agg(F.min("id").alias("id")).collect())
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    before = [(first, firsts[i - 1][1]) for i, (first, _) in enumerate(firsts)]  # of the first interval: the last
    ahead = F.broadcast(spark.createDataFrame(before, "id long, before int"))  # one row for each interval
    dealt = rows.join(ahead, "id", "left").withColumn(
        "to",
        F.explode(
            F.when(
                F.col("before").isNull(), F.array(F.struct(part.alias("part"), F.lit(False).alias("ahead")))
            ).otherwise(
                F.array(
                    F.struct(part.alias("part"), F.lit(False).alias("ahead")),
                    F.struct(F.col("before").alias("part"), F.lit(True).alias("ahead")),
                )
            )
        ),
    )
    # ids differ from interval to interval, so "ahead" rows sort behind or, in the last interval, are flagged
    return (
        dealt.select("to.part", "to.ahead", "id", "text")
        .repartitionById(len(splits) + 1, F.col("part"))
        .sortWithinPartitions("part", "ahead", "id", "text")
        .mapInArrow(_stream, SCHEMA)
        .withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(-(2**63))))
    )

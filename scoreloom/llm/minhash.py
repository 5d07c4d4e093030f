"""MinHash near-duplicates with b-bit signatures: classes of documents whose shingle sets are alike.

A document's set holds the hashes of its distinct five-word shingles. Multiplicative hash functions
order the shingles, and the minimum under each is what two sets share with a probability equal to
their Jaccard similarity.

1. *Equal sets* become one node, by a pre-aggregated group of their 128-bit digests.
2. *Bands.* The first minima make ``BANDS`` bands of ``ROWS``; nodes with an equal band meet in a
   bucket. Two sets of similarity 0.85 share no band with a probability of 6e-11.
3. *b-bit signatures.* Candidates get ``HASHES`` minima, of which only ``BITS`` low bits are kept, packed
   as bit planes into longs. Two signatures are compared by exclusive or and bit counts; of matches by chance there
   are 2^-BITS, so the estimate is (matches / HASHES - 2^-BITS) / (1 - 2^-BITS). A candidate goes on
   if its matches are not so few that a link would have them with a probability below 1e-9.
4. *Own shingles.* The shingles that no other candidate holds are counted once for each candidate. A pair
   shares none of them, which bounds its similarity: most edited copies of one text, each with
   edits of its own, can be no links of each other, however alike they look.
5. *Full sets* decide: 100 * intersection >= 85 * union of the candidates' whole sets is a link. All before
   only spares that work.

Pairs: a group of thousands of near copies would make all pairs of its members. For classes one
link to a connected member is enough, so each node is first compared with the leader of one of its
buckets, if that is of another class and may link: of its fullest bucket, then of its emptiest, in
later rounds of another one. Links merge classes. When such rounds yield little more, all pairs of
different classes in a bucket are compared by their signatures: first those as alike as half of
all links look, which merges most of what is left, then all others that may link. A bucket where
a node would meet more than ``CROWD`` nodes of other classes (a passage that very many texts share)
is split first, by a further band that its members share, where that at least halves its pairs; so on.
Alike sets share two bands but with a probability of 2e-9, and four but with one of 4e-7. Nothing is
capped or left out.

Defined cases: a null or wordless text has the empty set, which links with nothing; fewer words
than five are one shingle; rows with a null id get their number of shingles and no class; rows that
repeat an id each have their own set; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import ngram_join
from scoreloom.llm.common import cut, fits, forget, quoted, small, tasks_for
from scoreloom.llm.ngram_join import LEADER_ROUNDS, LEADER_YIELD, MIX, WordHashes, components, digest, id_filter, shingles

NUM, DEN = 17, 20  # similarity 0.85
BANDS, ROWS = 32, 4
#: Hash functions of a signature, and the bits that it keeps of each minimum.
HASHES, BITS = 1024, 2
#: The probability with which the signature may turn away a link.
LOSS = 1e-9
#: Other classes' nodes that a node may meet in a bucket, on average, before the bucket is split.
CROWD = 200
#: Values that are hashed at a time.
CHUNK = 65_536
#: Sets of so few elements are like no other set: n / (n + 1) < 0.85.
ALONE = -(-NUM // (DEN - NUM)) - 1
#: Longs of a bit plane, and the signature's columns: plane by plane.
PLANE = HASHES // 64
BITS_OF = tuple(f"b{i}" for i in range(BITS * PLANE))

ORACLE_SQL = (
    "SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM ("
    + ngram_join.ORACLE_SQL.replace("100 * c >= 80 *", "100 * c >= 85 *")
    + ") AS found"
)


def _constants() -> tuple[np.ndarray, np.ndarray]:
    """Additive and odd multiplicative constants of the hash functions, by a mixed counter."""
    z = np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * MIX
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return z[:HASHES], z[HASHES:] | np.uint64(1)


ADD, TIMES = _constants()


def minima(h: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The least value of a set's elements under each of the first ``hashes`` functions."""
    out, step = np.full(hashes, np.iinfo(np.uint64).max, np.uint64), CHUNK // hashes
    for at in range(0, len(h), step):
        np.minimum(out, ((h[at : at + step, None] ^ ADD[:hashes]) * TIMES[:hashes]).min(axis=0), out=out)
    return out


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(29))) * MIX
    return z ^ (z >> np.uint64(32))


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, of its number and its minima."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key ^ column)
    return key.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima as bit planes."""
    low = _mixed(least)
    planes = [np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for b in range(BITS)]
    return np.concatenate(planes).view(np.int64)


def least_matches(loss: float = LOSS, similarity: float = NUM / DEN) -> int:
    """The most matches below which a link falls with a probability of ``loss`` at most."""
    p = 2.0**-BITS + (1 - 2.0**-BITS) * similarity
    total, m = 0.0, 0
    while m < HASHES:
        total += comb(HASHES, m) * p**m * (1 - p) ** (HASHES - m)
        if total > loss:
            return m
        m += 1
    return m


def matches(a: str, b: str) -> str:
    """SQL: the number of hash functions whose low bits agree."""
    planes = lambda i: " | ".join(f"({a}.b{j} ^ {b}.b{j})" for j in range(i, BITS * PLANE, PLANE))
    differ = (f"bit_count({planes(i)})" for i in range(PLANE))
    return f"({HASHES} - {' - '.join(differ)})"


def estimate(a: str, b: str) -> str:
    """SQL: the collision-corrected similarity of two signatures."""
    return f"(({matches(a, b)} / {HASHES} - {2.0**-BITS}D) / {1 - 2.0**-BITS}D)"


def _may_link(a: str, b: str, least: int) -> str:
    most = f"least({a}.m, {b}.m)"  # m: shingles that another candidate holds too
    return f"{DEN} * {most} >= {NUM} * ({a}.n + {b}.n - {most}) and {matches(a, b)} >= {least}"


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, fa, fb, bands); sets that are like no other have no bands."""
    hashes = WordHashes()
    for batch in batches:
        rows, keys, ends = [], [], [0]
        for t in batch.column(1):
            h = shingles(t.as_py(), hashes)
            rows.append((len(h), *digest(h)))
            if len(h) > ALONE:
                keys.append(band_keys(minima(h, BANDS * ROWS)))
            ends.append(len(keys) * BANDS)
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, bands], ["doc_id", "n", "fa", "fb", "bands"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, ts) to (v, b0, ...): the signature of a whole set."""
    for batch in batches:
        signs = [signature(minima(np.frombuffer(ts.as_buffer(), np.uint64))) for ts in batch.column(1)]
        columns = [pa.array(c) for c in np.array(signs, np.int64).reshape(-1, len(BITS_OF)).T]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["v", *BITS_OF])


def confirmed(pairs: DataFrame, rows: int, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links by their whole ``sets`` (s, n, ts). Sides are broadcast where they fit."""
    ends = small(pairs.select("b").distinct(), rows, 16)
    held = cut(sets.join(ends, F.col("b") == F.col("s")).selectExpr("b", "n as nb", "ts as y"))
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.length("y")), F.lit(0))).first()
    right = F.broadcast(held) if fits(64 * n + size, 1) else held
    left = sets.selectExpr("s as a", "n as na", "ts as x").join(small(pairs.select("a", "b"), rows, 32), "a")
    both = left.join(right, "b").select("a", "b", "na", "nb", "x", "y")
    overlaps = both.mapInArrow(ngram_join._overlaps, "a long, b long, na long, nb long, o long")
    links = cut(overlaps.where(f"{DEN} * o >= {NUM} * (na + nb - o)").select("a", "b"))
    forget(held)
    return links


def shared_sizes(sets: DataFrame) -> DataFrame:
    """(v, own): the number of a set's shingles that no other of the ``sets`` (s, n, ts) holds, where there are some."""
    elements = sets.select("s", "ts").mapInArrow(ngram_join._elements, "t long, s long")
    alone = elements.groupBy("t").agg(F.count("*").alias("df"), F.max("s").alias("v")).where("df = 1")
    return alone.groupBy("v").agg(F.count("*").alias("own"))


def led_pairs(postings: DataFrame, named: DataFrame, step: int, count: int) -> DataFrame:
    """Each node with the leader of one of its buckets, if that is of another class and may link.

    A node goes to its fullest bucket first, then to its emptiest, then to others; its leader is the node there
    whose buckets are fullest, in later rounds another one.
    """
    order = {0: "df", 1: "-df"}.get(step, f"xxhash64(t, {step})")
    chosen = postings.groupBy("v").agg(F.expr(f"max(struct({order} as o, t))").getField("t").alias("t"))
    lists = chosen.join(named, "v")
    key = "struct(c, v)" if step < 2 else f"struct(double(xxhash64(v, {step})) as c, v)"
    led = lists.groupBy("t").agg(
        F.expr(f"max(struct({key} as o, n, m, k, {', '.join(BITS_OF)}))").alias("l"), F.min("k").alias("k0"), F.max("k").alias("k1")
    )
    led = led.where("k0 <> k1").select("t", "l.*")
    found = lists.alias("x").join(led.alias("l"), "t").where(f"x.k <> l.k and {_may_link('x', 'l', least_matches())}")
    return found.selectExpr("x.v as a", "l.o.v as b", "x.k as ka", "l.k as kb").coalesce(tasks_for(count))


def _cross(lists: DataFrame, *bucket: str) -> DataFrame:
    """(*bucket, members, cross): a bucket's nodes, and twice its pairs of different classes, where there are some."""
    sizes = lists.groupBy(*bucket, "k").agg(F.count("*").alias("one")).groupBy(*bucket)
    sizes = sizes.agg(F.sum("one").alias("members"), F.expr("sum(one) * sum(one) - sum(one * one)").alias("cross"))
    return sizes.where("cross > 0")


def remaining_pairs(lists: DataFrame, named: DataFrame, bands: DataFrame, least: int) -> DataFrame:
    """All pairs of nodes of different classes in a bucket of ``lists`` (t, v, i, k) that may link; crowded buckets by a further band."""
    out, before, level = None, [], 0
    wide = named.join(bands, "v")
    # a pair is compared in one bucket alone: that of the first bands that it shares
    first = "size(filter(zip_with(slice(x.bands, 1, x.i), slice(l.bands, 1, x.i), (p, q) -> p = q), z -> z))"
    while True:
        sizes = _cross(lists, "t").select("t", "cross", (F.col("cross") > F.lit(CROWD) * F.col("members")).alias("crowded"))
        marked = cut(lists.join(sizes, "t"))
        before.append(marked)
        calm, crowd = marked.where("not crowded").drop("cross", "crowded"), marked.where("crowded").drop("crowded")
        wider = None
        if crowd.limit(1).count():
            # with each band behind the bucket's last one: of the bands that two nodes share, the first lead to the next
            wider = crowd.join(bands, "v").select(*crowd.columns, F.posexplode("bands").alias("j", "y")).where("j > i")
            wider = wider.withColumn("u", F.xxhash64("t", "y"))
            halved = _cross(wider, "t", "u").groupBy("t").agg(F.sum("cross").alias("after"))
            gains = cut(crowd.select("t", "cross").distinct().join(halved, "t", "left").select("t", F.expr("2 * coalesce(after, 0) < cross").alias("gain")))
            calm = calm.unionByName(crowd.join(gains.where("not gain"), "t").drop("cross", "gain"))
            wider = wider.join(gains.where("gain"), "t", "left_semi").withColumns({"t": F.col("u"), "i": F.col("j")}).select(*lists.columns)
            before.append(gains)
        known = calm.drop("k").join(wide, "v")
        pairs = known.alias("x").join(known.alias("l"), "t").where(f"x.k < l.k and {_may_link('x', 'l', least)} and {first} = {level}")
        pairs = cut(pairs.selectExpr("x.v as a", "l.v as b", "x.k as ka", "l.k as kb"))
        out = pairs if out is None else out.unionByName(pairs)
        before.append(pairs)
        if wider is None:
            pairs = cut(out.distinct())  # buckets whose keys are alike by chance
            forget(*before)
            return pairs
        lists, level = cut(wider), level + 1
        before.append(lists)


def node_classes(nodes: DataFrame, count: int, postings: DataFrame, sets: DataFrame, bands: DataFrame) -> DataFrame:
    """(s, k) of all ``nodes`` (v, n, m, c, b0..b3): the smallest v that each reaches."""
    labels = cut(nodes.selectExpr("v as s", "v as k"))
    steps = [("led", k) for k in range(LEADER_ROUNDS)] + [("all", least_matches(0.5)), ("all", least_matches())]
    while steps:
        kind, at = steps.pop(0)
        named = small(nodes.select("v", "n", "m", "c", *BITS_OF).join(small(labels, count, 32), F.col("v") == F.col("s")).drop("s"), count, 64 + 8 * len(BITS_OF))
        if kind == "led":
            pairs = cut(led_pairs(postings, named, at, count))
        else:
            lists = postings.drop("df").join(small(labels.select(F.col("s").alias("v"), "k"), count, 32), "v")
            pairs = remaining_pairs(lists, named, bands, at)
        n_pairs = pairs.count()
        links = confirmed(pairs, n_pairs, sets)
        n_links = links.count()
        if n_links:
            between = pairs.join(small(links, n_links, 32), ["a", "b"]).selectExpr("ka as a", "kb as b")
            merged, before = components(between, n_links), labels
            moved = labels.join(small(merged, 2 * n_links, 32), F.col("k") == F.col("v"), "left")
            labels = cut(moved.select("s", F.coalesce("c", "k").alias("k")))
            forget(before, merged)
        forget(pairs, links)
        if kind == "led" and at and n_links <= LEADER_YIELD * count:
            steps = [x for x in steps if x[0] == "all"]
    return labels


def dedup_minhash(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    known = cut(rows.mapInArrow(_banded, "doc_id long, n long, fa long, fb long, bands array<long>"))
    firsts = [F.first(c).alias(c) for c in ("n", "bands")]
    grouped = known.where("n > 0 and doc_id is not null").groupBy("fa", "fb").agg(F.min("doc_id").alias("s"), F.count("*").alias("m"), *firsts)
    nodes = cut(grouped.select(F.monotonically_increasing_id().alias("v"), "*"))  # v: a set's own number
    lists = nodes.select("v", F.posexplode("bands").alias("i", "t"))
    shared = lists.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    postings = cut(lists.join(shared, "t"))
    met = postings.groupBy("v").agg(F.sum("df").cast("double").alias("c"))
    likely = cut(nodes.join(met, "v").select("v", "s", "fa", "fb", "n", "c", "bands"))
    count = likely.count()
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(id_filter(likely.select("s"), count)).tobytes())
    found = rows.where("doc_id is not null").mapInArrow(ngram_join._likely_sets(packed), "s long, fa long, fb long, h binary")
    found = found.join(small(likely.select("v", "n", "s", "fa", "fb"), count, 64), ["s", "fa", "fb"])
    whole = sets = cut(found.dropDuplicates(["v"]).selectExpr("v as s", "n", "h as ts"))  # repeated rows count once
    own = likely.join(small(shared_sizes(sets), count, 16), "v", "left").withColumn("m", F.expr("n - coalesce(own, 0)")).drop("own")
    own = cut(own.where(f"{DEN} * m >= {NUM} * n"))
    left = own.count()
    sets = sets.join(small(own.select(F.col("v").alias("s")), left, 8), "s", "left_semi")
    signs = sets.select("s", "ts").mapInArrow(_signed, f"v long, {', '.join(f'{b} long' for b in BITS_OF)}")
    able = cut(own.join(signs, "v"))
    kept = cut(postings.join(small(able.select("v"), left, 8), "v", "left_semi"))
    labels = node_classes(able, left, kept, sets, able.select("v", "bands"))
    named = able.join(small(labels, left, 32), F.col("v") == labels["s"]).select(able["s"], "fa", "fb", "k")
    lowest = named.groupBy("k").agg(F.min("s").alias("component_id"), F.count("*").alias("members"))
    moved = named.join(small(lowest, left, 32), "k").where("members > 1").select("fa", "fb", "component_id")
    copies = nodes.where("m > 1").select("fa", "fb", "s")
    changed = cut(copies.join(moved, ["fa", "fb"], "full").select("fa", "fb", F.coalesce("component_id", "s").alias("c")))
    forget(whole, postings, kept, likely, own, able, nodes)
    known = known.select("doc_id", "n", "fa", "fb").join(small(changed, changed.count(), 64), ["fa", "fb"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    known = known.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return known.withColumn("kept", F.col("doc_id") == F.col("component_id"))

"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a pseudo-random order, are cut into blocks of ``block_chars``
characters. Block k (from 0) of a source of weight w is released at floor(k / w) and due at
ceil((k + 1) / w), in slots of one block each. The earliest deadline among the released
blocks goes first; on one processor this meets every deadline, so at any slot each source
is less than one block away from its target share.

Weights are fractions a / D with the fixed denominator ``resolution``, so the schedule
repeats every D slots: one period is scheduled on the driver, and the slot of any block
follows by arithmetic. When a source has no block left, a new phase begins with the weights
of the others scaled up; there are at most as many phases as sources. The driver holds one
count for each source and a row for each source and phase in which it has a block.

Plan: documents are numbered within their source without a window over a whole source. The
order is that of a hash; its leading bits deal a source into chunks of bounded size, chunk
totals are pre-aggregated and summed, and only the running sum within a chunk is a window.
A source that holds a third of the rows is as many chunks as its size asks for, and their
totals are summed up in two levels.

A document belongs to the block where it starts. One longer than a block leaves the blocks that
it covers empty, so the order deviates from the target by less than one block and the longest text.

Every document is kept: mixing decides the order alone. ``mix_slot`` is that order, and the
rows come out sorted by it across partitions.

Defined cases: null texts count one character, as do empty ones; a null source is a source
of its own; repeated rows are each scheduled; ties of the order hash go by id; a source
without a given weight has the least; columns named mix_block or mix_slot (with the caller's ``prefix``) are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.common import cut, every, fresh, quoted, small

BLOCK_CHARS = 20_000
RESOLUTION = 1000
TEMPERATURE = 0.5
CHUNK_ROWS = 400


def shares(weights: dict, resolution: int) -> dict:
    """Numerators over ``resolution``, each at least 1, by largest remainders."""
    whole = sum(weights.values())
    exact = {s: w / whole * (resolution - len(weights)) for s, w in weights.items()}
    got = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[: resolution - sum(got.values())]:
        got[s] += 1
    return got


def earliest_deadlines(numerators: dict) -> Iterator:
    """Earliest deadline first over one period, slot by slot: the source of each.

    A source's next block waits for its release, floor(k / w), and then stands among the ready ones by its
    deadline, ceil((k + 1) / w); only one block of each source is held.
    """
    size = sum(numerators.values())
    names = sorted(numerators, key=lambda s: (s is None, s or ""))
    due = lambda i, k: -(-(k + 1) * size // numerators[names[i]])
    ready, waiting = [(due(i, 0), i, 0) for i in range(len(names))], []
    heapq.heapify(ready)
    for slot in range(size):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(i, k), i, k))
        end, i, k = heapq.heappop(ready)
        assert end > slot
        yield names[i]
        if k + 1 < numerators[names[i]]:
            heapq.heappush(waiting, ((k + 1) * size // numerators[names[i]], i, k + 1))


def period(numerators: dict) -> list:
    """The source of each slot of one period."""
    return list(earliest_deadlines(numerators))


def phases(blocks: dict, weights: dict, resolution: int) -> list[tuple]:
    """Rows (source, first, behind, base, picks, size): block k in [first, behind) of ``source`` stands in slot
    base + (k - first) div len(picks) * size + picks[(k - first) % len(picks)].

    A phase that ends within its first period is followed no further than its end, and a source has a row for
    each phase in which it has a block: there are no more rows than blocks.
    """
    left, done, base, rows = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        numerators = shares({s: weights[s] for s in left}, max(resolution, 4 * len(left)))
        picks: dict = {}
        for slot, s in enumerate(earliest_deadlines(numerators)):
            own = picks.setdefault(s, [])
            own.append(slot)
            if len(own) == left[s]:  # the first to run out, in the first period
                end = slot
                break
        else:
            end = min((n - 1) // len(picks[s]) * slot + (n - 1) // len(picks[s]) + picks[s][(n - 1) % len(picks[s])] for s, n in left.items())
        size = sum(numerators.values())
        for s, own in picks.items():
            whole, rest = divmod(end + 1, size)
            taken = whole * len(own) + sum(p < rest for p in own)
            if taken:
                rows.append((s, done[s], done[s] + taken, base, own, size))
                done[s] += taken
                left[s] -= taken
                if not left[s]:
                    del left[s]
        base += end + 1
    return rows


def mix_sources(
    docs: DataFrame,
    weights: dict | None = None,
    block_chars: int = BLOCK_CHARS,
    resolution: int = RESOLUTION,
    temperature: float = TEMPERATURE,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    prefix: str = "",
) -> DataFrame:
    """``docs`` with ``mix_block`` and ``mix_slot``, sorted by slot. Without ``weights`` a source's weight is
    its number of characters to the power ``temperature``. ``prefix`` comes before the two names."""
    spark = docs.sparkSession
    block, slot = f"{prefix}mix_block", f"{prefix}mix_slot"
    kept = every(docs, (block, slot))
    own = fresh(docs, "__")  # no column of docs begins so
    name, size, order, chunk, at, row = (f"{own}{x}" for x in ("source", "size", "order", "chunk", "at", "id"))
    keyed = docs.select(
        *kept,
        F.col(quoted(source)).cast("string").alias(name),
        F.greatest(F.coalesce(F.char_length(F.col(quoted(text))), F.lit(1)), F.lit(1)).cast("long").alias(size),
        F.xxhash64(F.col(quoted(doc_id)), F.col(quoted(text))).alias(order),
        F.col(quoted(doc_id)).alias(row),
    )
    light = keyed.select(F.col(name).alias("s"), F.col(size).alias("n"), F.col(order).alias("o"))
    counts = {r["s"]: r for r in light.groupBy("s").agg(F.count("*").alias("rows"), F.sum("n").alias("chars")).collect()}
    if not counts:
        return docs.select(*kept, F.lit(None).cast("long").alias(block), F.lit(None).cast("long").alias(slot))
    bits = max(0, max(r["rows"] for r in counts.values()) // CHUNK_ROWS).bit_length()
    leading = lambda o, b: F.shiftright(o, 64 - b) if b else F.lit(0).cast("long")
    # two levels of running sums: chunks within a coarse part of their source, coarse parts within the source
    chunks = light.groupBy("s", leading("o", bits).alias("c")).agg(F.sum("n").alias("n"))
    chunks = cut(chunks.withColumn("p", F.shiftright("c", bits - bits // 2)))
    parts = chunks.groupBy("s", "p").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("s").alias("ps"), F.col("p").alias("pp"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    before = Window.partitionBy("s", "p").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    within = chunks.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = within.join(small(parts, len(counts) << (bits // 2), 64), F.col("s").eqNullSafe(F.col("ps")) & (F.col("p") == F.col("pp")))
    starts = starts.select(F.col("s").alias(f"{own}cs"), F.col("c").alias(f"{own}cc"), (F.col("base") + F.col("start")).alias(f"{own}start"))
    starts = small(starts, len(counts) << bits, 64)
    least = min(weights.values()) if weights else 1.0
    wanted = {s: (weights.get(s, least) if weights is not None else r["chars"] ** temperature) for s, r in counts.items()}
    plan = phases({s: (r["chars"] - 1) // block_chars + 1 for s, r in counts.items()}, wanted, resolution)
    columns = [f"{own}{x}" for x in ("ps", "first", "behind", "base", "picks", "period")]
    ps, first, behind, base, picks, whole = (F.col(c) for c in columns)
    kinds = ("string", "long", "long", "long", "array<int>", "long")
    slots = spark.createDataFrame(plan, ", ".join(f"{c} {k}" for c, k in zip(columns, kinds)))
    slots = small(slots, len(plan), 64 + 4 * max(resolution, 4 * len(counts)))
    running = Window.partitionBy(name, chunk).orderBy(order, row).rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumn(chunk, leading(order, bits))
    numbered = keyed.withColumn(at, F.sum(size).over(running) - F.col(size))
    numbered = numbered.join(starts, F.col(name).eqNullSafe(F.col(f"{own}cs")) & (F.col(chunk) == F.col(f"{own}cc")))
    numbered = numbered.withColumn(block, F.floor((F.col(f"{own}start") + F.col(at)) / F.lit(block_chars)).cast("long"))
    k = F.col(quoted(block)) - first
    placed = numbered.join(slots, F.col(name).eqNullSafe(ps) & (F.col(quoted(block)) >= first) & (F.col(quoted(block)) < behind))
    placed = placed.withColumn(slot, base + F.floor(k / F.size(picks)).cast("long") * whole + F.get(picks, (k % F.size(picks)).cast("int")))
    return (
        placed.repartitionByRange(F.col(quoted(slot)), F.col(order))
        .sortWithinPartitions(quoted(slot), order, row)
        .select(*kept, quoted(block), quoted(slot))
    )

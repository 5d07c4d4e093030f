"""Exact top-k search by inner product: one KD-tree for each shard of the candidates.

A shard's tree splits at the median of its widest component and keeps a tight bounding box
for each node. For a query q and a box [lo, hi] no vector inside scores above the sum of
max(q * lo, q * hi). The search is best first: the node of the largest bound is opened
next, and it ends when that bound is below the kth best score so far. The kth score is
propagated: each query first searches one home shard, and what it finds there is the bound
with which it enters all others.

Plan: the candidates are dealt to shards of at most about ``shard_rows`` by a hash of their
id, so equal vectors spread out; the queries go in groups of at most ``group_rows``. A task
holds one shard and one group, both bounded. This is the stated query set against all
rows, in blocks. The results of all shards meet as k rows for each query and shard.

Components become floor(1024 x) as integers; sums stay exact in doubles below 2^53, and
larger vectors are scored with Python's integers, which also decide the order; only the score that
is returned is then held to 64 bits.

Defined cases: a vector that is null, or has a null or non-finite component, and a row with
a null id, takes part neither as query nor as candidate; vectors of different length are
not compared; an empty vector scores 0 against empty vectors; rows of the query's own id
are no candidates of it; repeated other rows each are; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.common import cut

SHARD_ROWS = 20_000
GROUP_ROWS = 20_000
LEAF = 128
#: From here on doubles are whole numbers, and 1024 times one may not be a double.
LARGE = 2.0**43
#: Bytes that hold any score of finite doubles, for those beyond 62 bits.
BIG = 280
SCHEMA = "query_id long, vec_id long, score long, big binary"

ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


class Tree:
    """KD-tree over the rows of ``points`` with tight boxes; rows of a leaf are contiguous in ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.kids: list[int] = []  # the first of two children, or -1
        self._node(0, len(points))
        at = 0
        while at < len(self.span):
            a, b = self.span[at]
            wide = self.hi[at] - self.lo[at]
            if b - a > leaf and wide.size and wide.max() > 0:
                mid, axis = (a + b) // 2, int(np.argmax(wide))
                part = self.order[a:b]
                self.order[a:b] = part[np.argpartition(points[part, axis], mid - a)]
                self.kids[at] = len(self.span)
                self._node(a, mid)
                self._node(mid, b)
            at += 1
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _node(self, a: int, b: int) -> None:
        rows = self.points[self.order[a:b]]
        self.lo.append(rows.min(axis=0) if len(rows) else np.zeros(rows.shape[1]))
        self.hi.append(rows.max(axis=0) if len(rows) else np.zeros(rows.shape[1]))
        self.span.append((a, b))
        self.kids.append(-1)

    def search(self, q: np.ndarray, k: int, ids: np.ndarray, own: int, least: float | None) -> list[tuple[int, int]]:
        """Up to k (score, id) of the largest scores not below ``least``, ties to the smaller id."""
        best: list[tuple] = []  # a heap of (score, -id); the worst first
        todo = [(-np.inf, 0)]
        while todo:
            bound, at = heapq.heappop(todo)
            floor = best[0][0] if len(best) == k else least
            if floor is not None and -bound < floor:
                break
            if (kid := self.kids[at]) >= 0:
                bounds = np.maximum(q * self.lo[kid : kid + 2], q * self.hi[kid : kid + 2]).sum(axis=1)
                heapq.heappush(todo, (-bounds[0], kid))
                heapq.heappush(todo, (-bounds[1], kid + 1))
                continue
            a, b = self.span[at]
            rows = self.order[a:b]
            scores = self.points[rows] @ q
            keep = ids[rows] != own
            if floor is not None:
                keep &= scores >= floor
            rows, scores = rows[keep], scores[keep]
            if len(rows) > k:
                top = np.lexsort((ids[rows], -scores))[:k]
                rows, scores = rows[top], scores[top]
            for x, i in zip(scores.tolist(), ids[rows].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (x, -i))
                elif (x, -i) > best[0]:
                    heapq.heapreplace(best, (x, -i))
        return [(int(x), -i) for x, i in best]


def _matrix(values: pd.Series) -> np.ndarray:
    """Rows of floor(1024 x); as Python's integers where doubles don't hold them exactly."""
    raw = np.array(values.tolist(), dtype=np.float64).reshape(len(values), -1)
    if abs(raw).max(initial=0) < LARGE:
        return np.floor(1024 * raw)
    return _whole(np.array([[1024 * int(x) if abs(x) >= LARGE else math.floor(1024 * x) for x in row] for row in raw.tolist()], dtype=object), raw.shape)


def _whole(m: np.ndarray, shape: tuple) -> np.ndarray:
    return np.array([int(x) for x in m.ravel()], dtype=object).reshape(shape)


def _shard_search(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            points, asked = _matrix(candidates["v"]), _matrix(queries["v"])
            ids = candidates["vec_id"].to_numpy(np.int64)
            bound = (int(abs(points).max(initial=0)) * int(abs(asked).max(initial=0))) * max(1, points.shape[1])
            if bound >= 2**53:  # no longer exact in doubles
                points, asked = _whole(points, points.shape), _whole(asked, asked.shape)
            tree = Tree(points)
            for qid, q, least in zip(queries["vec_id"], asked, queries["least"]):
                least = None if least is None or pd.isna(least) else int(least)
                for score, i in tree.search(q, k, ids, int(qid), least):
                    big = (score + 2 ** (8 * BIG - 1)).to_bytes(BIG, "big") if abs(score) >= 2**62 else None
                    out.append((int(qid), i, min(max(score, -(2**63)), 2**63 - 1), big))
        found = pd.DataFrame(out, columns=["query_id", "vec_id", "score", "big"])
        return found.astype({c: "int64" for c in ("query_id", "vec_id", "score")})

    return run


def search_topk(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Each query's k candidates of the largest integer inner product: query_id, rank, vec_id, score."""

    def prepared(df: DataFrame) -> DataFrame:
        raw = F.col(f"`{vector}`")
        good = raw.isNotNull() & F.forall(
            raw, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double"))
        )
        return df.where(F.col(f"`{vec_id}`").isNotNull() & good).select(
            F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
            raw.alias("v"),
        ).withColumn("dim", F.size("v"))

    base, asked = prepared(candidates), prepared(queries)
    n, m = base.count(), asked.count()
    shards, groups = max(1, -(-n // shard_rows)), max(1, -(-m // group_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    home = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")
    group = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(groups)).cast("int")
    base = base.withColumn("shard", shard).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.withColumn("home", home).withColumn("g", group)

    def searched(part: DataFrame) -> DataFrame:
        keys = ["g", "shard", "dim"]
        return base.groupBy(*keys).cogroup(part.groupBy(*keys)).applyInPandas(_shard_search(k), SCHEMA)

    at_home = cut(searched(asked.withColumn("shard", F.col("home")).withColumn("least", F.lit(None).cast("long"))))  # searched once, for the bounds and for the result
    found = at_home
    if shards > 1:
        bounds = at_home.groupBy("query_id").agg(F.when((F.count("*") >= k) & (F.count("big") == 0), F.min("score")).alias("least"))
        rest = (
            asked.join(bounds, asked["vec_id"] == bounds["query_id"], "left")
            .drop("query_id")
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
            .where("shard <> home")
        )
        found = at_home.unionByName(searched(rest))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("big"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )

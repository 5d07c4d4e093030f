"""Toxicity by classifier chains.

The categories are predicted one after the other. Each has a logistic model, linear in
hashed word features, and every model but the first also sees the log-odds of the
categories before it. In training these come from out-of-fold predictions: each labelled
row's earlier probabilities are those of a model that has not seen the row, so the later
model does not trust them more than it may when it scores new texts.

Features of a word are the word itself and its prefixes of ``PREFIXES`` letters, which
carry over to inflected forms; a text's features are their shares among all its words,
slightly damped for very short texts, so length does not move the score.

Training takes at most ``max_labelled`` labelled rows, those of the smallest hashed ids, as
long as their texts hold ``max_chars`` characters together. Their sparse counts stay on the
executors, in a checkpoint: each model of a category (one of all rows, one without each fold) is
fitted by one task, which holds at most the bounded sample, and only weights reach the driver.
Scoring is one pass over all texts without a shuffle, and broadcasts the weights, whose size is
fixed by ``bits``.

Defined cases: a null text counts as empty and is scored by the intercepts; rows whose
label is null are left out of training; repeated labelled rows each count; with no labelled
row, or one class only, a category's probability is its (smoothed) share of positives;
null ids are kept; an id that repeats in the documents is labelled each time, and left out of training where its
rows alone exceed the bounds; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.common import cut, fits, quoted, trimmed

BITS = 18
PREFIXES = (3, 4, 5, 6)
#: Bounds of the labelled sample.
MAX_LABELLED = 8_000
MAX_CHARS = 64_000_000
FOLDS = 3
RIDGE = 1e-5
STEPS = 60
#: Features of fewer labelled rows are left out.
LEAST_ROWS = 3
#: Bounds of a chunk of sparse rows.
CHUNK_ENTRIES = 500_000
CHUNK_ROWS = 1000
CATEGORIES = ("quality", "toxic")
#: Shares are scaled so that one word in a hundred counts one.
SCALE = 100.0
#: So many words are added to a text's number of words, so that one word doesn't decide on a very short text.
DAMPING = 50
WORD = re.compile(r"\w+")
#: Bound of a worker's memory of words.
REMEMBERED = 200_000


def word_features(word: str, bits: int = BITS) -> list[int]:
    """Hashed features of a lower-case word."""
    mask = (1 << bits) - 1
    parts = [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & mask for p in parts]


def text_counts(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def sparse_text(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their scaled shares."""
    words = text_counts(text)
    total = sum(words.values())
    found: Counter = Counter()
    for w, n in words.items():
        for f in word_features(w, bits):
            found[f] += n
    ids = np.fromiter(found.keys(), np.int32, len(found))
    return ids, np.fromiter(found.values(), np.float32, len(found)) * np.float32(SCALE / (total + DAMPING))


class Rows:
    """Sparse rows with the features that occur in at least ``least`` of them."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], bits: int = BITS, least: int = 1):
        ids = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int32)
        values = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.float32)
        kept = np.where(np.bincount(ids, minlength=1 << bits)[ids] >= least, ids, -1)
        self._fill(np.array([len(i) for i, _ in rows], int), kept, values, 1 << bits)

    @classmethod
    def of(cls, sizes: np.ndarray, ids: np.ndarray, values: np.ndarray, width: int) -> Rows:
        """Rows of ``sizes`` entries each; ids below zero are left out."""
        out = object.__new__(cls)
        out._fill(sizes, ids, values, width)
        return out

    def _fill(self, sizes, ids, values, width) -> None:
        self.n, self.width = len(sizes), width
        keep = ids >= 0
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[keep]
        self.ids, self.values = ids[keep], values[keep].astype(np.float32)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.ids], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, self.values * g[self.row], minlength=self.width)

    def part(self, chosen: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        keep = chosen[self.row]
        number = np.cumsum(chosen) - 1
        out.n, out.width = int(chosen.sum()), self.width
        out.row, out.ids, out.values = number[self.row[keep]], self.ids[keep], self.values[keep]
        return out


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Descent:
    """Limited-memory BFGS of one model, one trial point ``at`` at a time, from a mean loss without the ridge."""

    def __init__(self, w: np.ndarray, ridge: float = RIDGE, steps: int = STEPS):
        self.w = self.at = w
        self.ridge, self.left, self.done = ridge, steps, False
        self.loss: float | None = None
        self.pairs: list = []

    def tell(self, loss: float, g: np.ndarray) -> None:
        """Loss and gradient at the trial point; sets the next one."""
        g = g.copy()
        loss += 0.5 * self.ridge * float(self.at[:-1] @ self.at[:-1])
        g[:-1] += self.ridge * self.at[:-1]
        if self.loss is not None:
            if loss > self.loss - 1e-4 * self.step * self.slope and self.step >= 1e-6:  # too long a step
                self.step *= 0.5
                self.at = self.w - self.step * self.q
                return
            s, t = self.at - self.w, g - self.g
            if s @ t > 1e-14:
                self.pairs = [*self.pairs[-7:], (s, t, 1 / (s @ t))]
            self.left -= 1
            self.done = self.loss - loss < 1e-7 * max(1.0, abs(self.loss)) or self.left <= 0
        self.w, self.loss, self.g = self.at, loss, g
        q, alphas = g.copy(), []
        for s, t, rho in reversed(self.pairs):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * t
        q *= (self.pairs[-1][0] @ self.pairs[-1][1]) / (self.pairs[-1][1] @ self.pairs[-1][1]) if self.pairs else 1 / max(1e-12, np.linalg.norm(g))
        for (s, t, rho), a in zip(self.pairs, reversed(alphas)):
            q += (a - rho * (t @ q)) * s
        self.q, self.step, self.slope = q, 1.0, g @ q
        self.at = self.w - q


def loss_parts(x: Rows, more: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The loss summed over the rows, then its gradient: hashed features, columns of ``more``, intercept."""
    d, m = x.width, more.shape[1]
    z = x.times(w[:d]) + more @ w[d : d + m] + w[-1]
    r = sigmoid(z) - y
    return np.concatenate([[(np.logaddexp(0, z) - y * z).sum()], x.back(r), more.T @ r, [r.sum()]])


def start(width: int, n: float, positive: float) -> np.ndarray:
    w = np.zeros(width + 1)
    w[-1] = logit((positive + 0.5) / (n + 1)) if n else 0.0
    return w


def fit_logistic(x: Rows, more: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights of rows at hand (hashed features, then the columns of ``more``, then the intercept)."""
    fit = Descent(start(x.width + more.shape[1], x.n, y.sum()), ridge, steps)
    if x.n and y.min() != y.max():
        while not fit.done:
            parts = loss_parts(x, more, y, fit.at) / x.n
            fit.tell(parts[0], parts[1:])
    return fit.w


def chain_scores(margins: list[float], models: list[np.ndarray], width: int) -> list[float]:
    """Probabilities along the chain, from each model's word margin."""
    out: list[float] = []
    for margin, w in zip(margins, models):
        z = margin + w[-1] + sum(a * float(logit(p)) for a, p in zip(w[width : width + len(out)], out))
        out.append(float(sigmoid(z)))
    return out


CHUNKS = "n int, fold binary, y binary, size binary, ids binary, val binary"


def _chunks(categories: int, folds: int, bits: int):
    """(k, text, labels...) to runs of sparse rows, of a bounded number of entries each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def sent() -> pa.RecordBatch:
            fold, y = (np.array([h[i] for h in held], np.int8).tobytes() for i in (0, 1))
            size = np.array([len(h[2]) for h in held], np.int32).tobytes()
            ids, val = (np.concatenate([h[i] for h in held]).tobytes() for i in (2, 3))
            cols = [pa.array([len(held)], pa.int32()), *(pa.array([c], pa.binary()) for c in (fold, y, size, ids, val))]
            return pa.RecordBatch.from_arrays(cols, ["n", "fold", "y", "size", "ids", "val"])

        entries = 0
        for batch in batches:
            for r in range(batch.num_rows):
                ids, val = sparse_text(batch.column(1)[r].as_py(), bits)
                fold = zlib.crc32(str(batch.column(0)[r].as_py()).encode()) % folds
                held.append((fold, [batch.column(2 + c)[r].as_py() != 0 for c in range(categories)], ids, val))
                entries += len(ids)
                if entries >= CHUNK_ENTRIES or len(held) >= CHUNK_ROWS:
                    yield sent()
                    held, entries = [], 0
        if held:
            yield sent()

    return run


def _models(category: int, categories: int, bits: int, earlier: list):
    """Fits the model of a task: chunks with ``without``, the fold that the model must not see (-1: none), to its weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, without, held = [], None, np.zeros(1 << bits, np.int64)
        kinds = (np.int8, np.int8, np.int32, np.int32, np.float32)
        for batch in batches:
            for parts in zip(*(batch.column(i) for i in range(7))):
                without = parts[0].as_py()
                fold, y, size, ids, val = (np.frombuffer(p.as_py(), k) for p, k in zip(parts[2:], kinds))
                held += np.bincount(ids, minlength=1 << bits)
                chunks.append([fold, y.reshape(parts[1].as_py(), categories).astype(float), size, ids, val])
        if not chunks:
            return
        known = np.flatnonzero(held >= LEAST_ROWS)  # all models hold the same features
        place = np.full(1 << bits, -1, np.int32)
        place[known] = np.arange(len(known), dtype=np.int32)
        width, seen = len(known), []
        for at, (fold, y, size, ids, val) in enumerate(chunks):
            x, more = Rows.of(size, place[ids], val, width), np.zeros((len(size), 0))
            for models in earlier:  # one for each fold, which has not seen that fold's rows
                z = np.zeros(x.n)
                for f, w in enumerate(models):
                    mine = fold == f
                    if mine.any():
                        z[mine] = x.part(mine).times(w[:width]) + more[mine] @ w[width:-1] + w[-1]
                more = np.column_stack([more, logit(sigmoid(z))])
            mine = fold != without
            seen.append((x.part(mine), more[mine], y[mine, category]))
            chunks[at] = None
        n, positive = sum(x.n for x, _, _ in seen), sum(float(y.sum()) for _, _, y in seen)
        fit = Descent(start(width + category, n, positive))
        while not fit.done and 0 < positive < n:
            parts = sum(loss_parts(x, more, y, fit.at) for x, more, y in seen)
            fit.tell(parts[0] / n, parts[1:] / n)
        cols = [pa.array([without], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (known.astype(np.int32), fit.w))]
        yield pa.RecordBatch.from_arrays(cols, ["without", "known", "w"])

    return run


def fit_chain(chunks: DataFrame, categories: int, bits: int = BITS, folds: int = FOLDS) -> list[np.ndarray]:
    """One dense weight vector for each category, from the chunks of all labelled rows."""
    earlier: list = []
    out = []
    for c in range(categories):
        wanted = [-1, *(range(folds) if c + 1 < categories else ())]
        copies = chunks.withColumn("without", F.explode(F.array(*(F.lit(f) for f in wanted)))).select("without", *chunks.columns)
        tasks = copies.repartitionById(len(wanted), F.col("without") + 1)
        got = {r["without"]: r for r in tasks.mapInArrow(trimmed(_models(c, categories, bits, earlier)), "without int, known binary, w binary").collect()}
        dense = np.zeros((1 << bits) + c + 1)
        if not got:  # no labelled row
            dense[-1] = start(0, 0, 0)[-1]
        else:
            w = {f: np.frombuffer(r["w"], float) for f, r in got.items()}
            known = np.frombuffer(got[-1]["known"], np.int32)
            dense[known], dense[1 << bits :] = w[-1][: len(known)], w[-1][len(known) :]
            earlier = [*earlier, [w[f] for f in wanted[1:]]]
        out.append(dense)
    return out


def train(docs: DataFrame, labels: DataFrame, categories, doc_id: str, text: str, max_labelled: int, max_chars: int, bits: int, folds: int = FOLDS):
    """Chain models from a sample of the labelled rows that is bounded in rows and in characters."""
    known = labels.where(" and ".join(f"{quoted(c)} is not null" for c in categories)).select(
        F.col("doc_id").cast("long").alias("k"), *(F.col(quoted(c)).cast("int").alias(f"y{i}") for i, c in enumerate(categories))
    )
    known = known.withColumn("o", F.shiftrightunsigned(F.xxhash64("k"), 4))
    total = known.count()
    if total > max_labelled:  # 60-bit hash below a bound, then exactly the smallest
        bound = int(2**60 * min(1.0, 1.2 * max_labelled / total + 0.001))
        known = known.where(F.col("o") < bound).orderBy("o", "k", *(f"y{i}" for i in range(len(categories)))).limit(max_labelled)
    keep = F.broadcast if fits(min(total, max_labelled), 64) else lambda x: x
    texts = docs.select(F.col(quoted(doc_id)).cast("long").alias("k"), F.col(quoted(text)).cast("string").alias("t"))
    sizes = texts.join(keep(known.select("k", "o")), "k").groupBy("o", "k").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("t"), F.lit(0))).alias("chars"))
    chosen, rows, chars = [], 0, 0
    for r in sizes.orderBy("o", "k").toLocalIterator():  # at most max_labelled ids; an id may repeat in the documents
        if rows + r["n"] <= max_labelled and chars + r["chars"] <= max_chars:
            chosen.append((r["k"],))
            rows, chars = rows + r["n"], chars + r["chars"]
    ids = docs.sparkSession.createDataFrame(chosen, "k long")
    found = texts.join(keep(known.drop("o").join(ids, "k")), "k")
    chunks = cut(found.mapInArrow(trimmed(_chunks(len(categories), folds, bits)), CHUNKS))
    return fit_chain(chunks, len(categories), bits, folds)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories=CATEGORIES,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = 0.5,
    max_labelled: int = MAX_LABELLED,
    max_chars: int = MAX_CHARS,
    bits: int = BITS,
    keep: bool = False,
    prefix: str = "",
) -> DataFrame:
    """A probability ``p_<category>`` for each category, and the last category's name as 0 or 1: whether it reaches ``threshold``.

    With ``keep`` the rows keep all columns of ``docs`` (columns of those names, in any case, are replaced);
    ``prefix`` comes before the names, so that a caller can choose names that replace none.
    """
    models = train(docs, labels, categories, doc_id, text, max_labelled, max_chars, bits)
    width = 1 << bits
    weights = docs.sparkSession.sparkContext.broadcast([w.astype(np.float32) for w in models])
    names = [*(f"{prefix}p_{c}" for c in categories), f"{prefix}{categories[-1]}"]
    taken = {n.lower() for n in names}
    columns = [c for c in docs.columns if c.lower() not in taken] if keep else [doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws = weights.value
        memory: dict[str, tuple] = {}
        for batch in batches:
            found = []
            for t in batch.column(len(columns)):
                counts = text_counts(t.as_py())
                margins = [0.0] * len(ws)
                for word, n in counts.items():
                    part = memory.get(word)
                    if part is None:
                        if len(memory) >= REMEMBERED:
                            memory.clear()
                        ids = word_features(word, bits)
                        part = memory[word] = tuple(float(sum(w[i] for i in ids)) for w in ws)
                    for c, x in enumerate(part):
                        margins[c] += n * x
                total = SCALE / (sum(counts.values()) + DAMPING)
                found.append(chain_scores([m * total for m in margins], ws, width))
            cols = [pa.array([p[c] for p in found], pa.float64()) for c in range(len(ws))]
            flags = pa.array([int(p[-1] >= threshold) for p in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), *cols, flags], plain)

    # columns of any name go through under plain ones
    plain = [f"c{i}" for i in range(len(columns) + len(names))]
    asked = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)), F.col(quoted(text)).cast("string").alias("t"))
    kinds = [*(f.dataType for f in asked.schema.fields[:-1]), *(T.DoubleType() for _ in categories), T.IntegerType()]
    return asked.mapInArrow(trimmed(run), T.StructType([T.StructField(c, k) for c, k in zip(plain, kinds)])).toDF(*columns, *names)

"""Toxicity scores from a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over a text's distinct hashed terms: words
without outer punctuation, and their beginnings of 3 to 6 bytes. The pairwise part learns what
additive weights miss, such as an insult together with a mention of a group.

Training is bounded: at most TRAIN_ROWS labelled rows (those with the lowest hash of their id, and
of their rows in the documents those with the lowest hash of the text) and FEATURES hashed terms
(those whose share of toxic and other rows differs most, in standard errors; equal ones by
number). Terms are counted and chosen on the executors, so that the driver gets at most
TRAIN_ROWS rows of at most FEATURES numbers, however long the texts and however often an id
repeats. The model is a few hundred rows of numbers and is broadcast; scoring is map-only.

Defined cases: a null text counts as empty and gets the score of the bias alone; labels other
than 0 and 1 are not used; without usable labels of both kinds every score is the (smoothed) share
of toxic labels; a label id that occurs several times counts each time; texts are scored whole;
repeated rows repeat; ties of terms and of rows do not change with the layout; other columns are
ignored or carried; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, Memo, binaries, id_mod, map_batches, materialise, prepare, release, text_bytes, words_of

TRAIN_ROWS, FEATURES, FACTORS = 8_000, 512, 8
#: Hash buckets of terms; fewest rows that a chosen term is in.
BUCKETS, SEEN = 1 << 22, 4
#: Words that a worker remembers in each of two generations.
MEMO = 150_000
EDGE = bytes(b for b in range(128) if not chr(b).isalnum())


def terms_of(word: bytes) -> list[int]:
    """Hashed terms of one word."""
    word = word.strip(EDGE)
    if not word:
        return []
    h = xxhash.xxh32_intdigest
    return [h(word, 1) % BUCKETS, *(h(word[:n], 1 + n) % BUCKETS for n in range(3, 7) if len(word) >= n)]


class FactorizationMachine:
    """w0, w and V over selected hash buckets."""

    def __init__(self, factors: int = FACTORS, features: int = FEATURES, steps: int = 400, rate: float = 0.05, decay: float = 5e-6, hold: float = 1.0, lift: float = 4.0, seed: int = 7):
        self.factors, self.features, self.steps, self.rate, self.decay, self.hold, self.lift, self.seed = factors, features, steps, rate, decay, hold, lift, seed
        self.slots: dict[int, int] = {}
        self.w0, self.w, self.v = 0.0, np.zeros(0), np.zeros((0, factors))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
        """Chooses among the terms of a few rows and fits; `train` does the same for any table."""
        n1, n0 = int(labels.sum()), int((1 - labels).sum())
        flat = np.concatenate([*rows, np.empty(0, np.int32)])
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        terms, place = np.unique(flat, return_inverse=True)
        c = np.bincount(place, minlength=len(terms))
        c1 = np.bincount(place[labels[at] > 0], minlength=len(terms))
        p = c / max(1, n1 + n0)
        z = np.abs(c1 / max(1, n1) - (c - c1) / max(1, n0)) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / max(1, n1) + 1 / max(1, n0)))
        use = np.flatnonzero((c >= SEEN) & (z > 0))
        chosen = terms[use[np.argsort(-z[use], kind="stable")[: self.features]]]
        return self.fit_chosen(rows, labels, chosen)

    def fit_chosen(self, rows: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray) -> FactorizationMachine:
        """Fits on the chosen terms of rows."""
        n1, n0 = int(labels.sum()), int((1 - labels).sum())
        self.w0 = float(np.log((n1 + 0.5) / (n0 + 0.5)))
        if not n1 or not n0:
            return self
        chosen = np.sort(chosen)
        self.slots = {int(b): i for i, b in enumerate(chosen)}
        x = np.zeros((len(rows), len(chosen)), np.float32)
        for i, r in enumerate(rows):
            x[i, np.searchsorted(chosen, r[np.isin(r, chosen)])] = 1
        self._descend(x, labels.astype(np.float32))
        return self

    def _descend(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(self.seed)
        d = x.shape[1]
        params = [np.array([self.w0], np.float32), np.zeros(d, np.float32), rng.normal(0, 0.02, (d, self.factors)).astype(np.float32)]
        weight = np.where(y > 0, self.lift, 1.0).astype(np.float32)
        weight /= weight.sum()
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        # The bias is held near the share of toxic labels: else it takes the whole weight of
        # documents without any term, and one insult alone no longer outweighs it.
        start, decays = (params[0].copy(), 0.0, 0.0), (self.hold, self.decay, self.decay)
        for t in range(1, self.steps + 1):
            w0, w, v = params
            xv = x @ v
            out = w0 + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
            err = weight * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y)
            gx = x.T @ err
            grads = [np.array([err.sum()], np.float32), gx, x.T @ (xv * err[:, None]) - v * gx[:, None]]
            for i, g in enumerate(grads):
                g = g + decays[i] * (params[i] - start[i])
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                params[i] = params[i] - self.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        self.w0, self.w, self.v = float(params[0][0]), params[1].astype(np.float64), params[2].astype(np.float64)

    def score(self, slots: list[int]) -> float:
        if not slots:
            return float(1 / (1 + np.exp(-self.w0)))
        v = self.v[slots]
        out = self.w0 + self.w[slots].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(out, -30, 30))))


class Scorer(Memo):
    """word -> its model slots, as met."""

    def __init__(self, model: FactorizationMachine):
        super().__init__(MEMO)
        self.model = model

    def compute(self, word: bytes) -> tuple[int, ...]:
        slots = self.model.slots
        return tuple(slots[t] for t in terms_of(word) if t in slots)

    def score(self, data: bytes) -> float:
        found: set[int] = set()
        for slots in map(self.__getitem__, set(words_of(data))):
            if slots:
                found.update(slots)
        return self.model.score(sorted(found))


def term_table(rows: DataFrame) -> DataFrame:
    """(rid, h, y, terms) of rows of (y, data), written: distinct hashed terms, a hash of the text."""

    def make():
        memo: dict[bytes, list[int]] = {}

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            out, h = [], []
            for data in binaries(b.column(1)):
                own: set[int] = set()
                for w in set(words_of(data)):
                    t = memo.get(w)
                    if t is None:
                        if len(memo) > MEMO:
                            memo.clear()
                        t = memo[w] = terms_of(w)
                    own.update(t)
                out.append(np.array(sorted(own), np.int32))
                h.append(xxhash.xxh64_intdigest(data))
            ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
            terms = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))
            return pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), b.column(0), terms], names=["h", "y", "terms"])

        return run

    return materialise(map_batches(rows, make, "h long, y int, terms array<int>").withColumn("rid", F.monotonically_increasing_id()), "terms")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = TRAIN_ROWS, features: int = FEATURES) -> FactorizationMachine:
    """Fits on at most `max_rows` labelled rows of `docs`; `labels` holds only rows to learn from."""
    spark = docs.sparkSession
    prepare(spark)
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    table = term_table(docs.select("doc_id", text_bytes().alias("data")).join(F.broadcast(chosen), "doc_id").select("y", "data"))
    rows, path = table, WRITTEN[-1]
    if table.count() > max_rows:
        lowest = table.select("h", "y", "rid").orderBy("h", "y", "rid").limit(max_rows).select("rid")
        rows = table.join(F.broadcast(lowest), "rid", "left_semi")
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    n0 = n - n1
    machine = FactorizationMachine(features=features)
    best: list[int] = []
    if n1 and n0:
        c, c1 = F.col("c"), F.col("c1")
        p = c / n
        z = F.abs(c1 / n1 - (c - c1) / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
        counted = rows.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("c1"))
        # Standard errors are rounded: equal ones stay equal whatever the order of operations.
        best = [r[0] for r in counted.where(c >= SEEN).select("t", F.round(z, 9).alias("z")).where("z > 0").orderBy(F.desc("z"), "t").limit(features).collect()]
    known = F.array(*map(F.lit, best)).cast("array<int>") if best else F.array().cast("array<int>")
    got = rows.select("y", F.array_intersect("terms", known).alias("terms")).toArrow()
    release(spark, [path])
    terms = [np.sort(np.array(t, np.int32)) for t in got.column("terms").to_pylist()]
    y = np.array(got.column("y").to_pylist(), np.int64)
    by = sorted(range(len(y)), key=lambda i: (int(y[i]), terms[i].tolist()))
    return machine.fit_chosen([terms[i] for i in by], y[by] if len(y) else y, np.array(best, np.int32))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted (0 or 1) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        scorer = Scorer(sent.value)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            s = [scorer.score(t) for t in binaries(b.column(1))]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

        return run

    return map_batches(docs.select("doc_id", text_bytes().alias("data")), make, f"doc_id {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5) -> DataFrame:
    """The documents below the threshold, with all their columns; map-side only."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def make():
        scorer = Scorer(sent.value)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            keep = [i for i, t in enumerate(b.column(text).to_pylist()) if scorer.score((t or "").encode()) < threshold]
            return b.take(pa.array(keep, pa.int32()))

        return run

    return map_batches(docs, make, docs.schema)


def learning_labels(labels: DataFrame, folds: int = 5) -> DataFrame:
    """The labels of rows whose crc32(doc_id as text) mod `folds` is not 0."""
    return labels.where(id_mod(folds) != 0)

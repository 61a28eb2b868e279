"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact check.

Words are lower-cased and split at white space. A document leaks an item when some run of its
words is within floor(RATE * n) word edits of the item's n words.

The CGK random walk turns a word sequence into a string of three times its length: at step j it
writes the current word and moves on by the bit that (j, word) hashes to, so that few edits
become few differing places. Places are sampled (SAMPLES a table); a window whose sampled places
all agree with an item's in any table is a candidate, and a semi-global edit distance over the
window and its margin decides exactly.

Tables and walks follow the item's length (PLANS), so that at least RECALL of the passages with
all allowed edits are candidates, be the edits deletions, insertions or substitutions. Distortion
grows with the number of edits; where the tables would cost more than the exact check (longer
items, or a larger rate than the plans hold for), every window goes to that check and none is lost.

Which windows are embedded: by the q-gram lemma a run within e edits shares at least
n - q + 1 - q e q-grams with the item, all on diagonals at most e from its beginning. Windows at
every start that meets this count are embedded; the others cannot match, so nothing is lost. (All
windows of all item lengths would take hundreds of times the CPU; the README has the figures.)

Items are broadcast in blocks of at most BLOCK_BYTES of text; a larger benchmark takes several
passes. Documents are never shuffled.

Defined cases: null texts count as empty; an item without words matches nothing; an item longer
than a document can match within its edits; of an item's runs in a document the one with the
fewest edits is told, of equal ones the first; repeated items or rows each give their matches; an
empty table gives an empty result; other columns are ignored or carried.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, map_batches, mix64, prepare, text_bytes, words_of

#: Word edits allowed, as a share of the item's words.
RATE = 0.2
#: Places a table samples; share of passages at the full allowance that the tables are to find.
SAMPLES, RECALL = 3, 0.99
#: (most words of an item, tables, walks that they are dealt over), measured at RATE for RECALL.
PLANS = ((32, 96, 8), (64, 192, 16), (128, 512, 32))
#: Bytes of item text in one broadcast.
BLOCK_BYTES = 8 << 20
PAD = np.uint64(0x5851F42D4C957F2D)
SEED = 20240229


def cgk(windows: np.ndarray, seed: int) -> np.ndarray:
    """The walk's output, 3 n places, for each row of n word codes."""
    m, n = windows.shape
    padded = np.concatenate([windows, np.full((m, 1), PAD)], axis=1)
    out = np.empty((m, 3 * n), np.uint64)
    at, rows = np.zeros(m, np.int64), np.arange(m)
    for j in range(3 * n):
        word = padded[rows, at]
        out[:, j] = word
        step = mix64(word ^ np.uint64((seed * 1_000_003 + j * 7919) & ((1 << 64) - 1))) & np.uint64(1)
        at = np.minimum(at + step.astype(np.int64), n)
    return out


def plan(n: int, edits: int) -> tuple[int, int] | None:
    """Tables and walks for items of n words; None where every window is checked exactly."""
    if edits > RATE * n + 1e-9:
        return None
    return next((p[1:] for p in PLANS if n <= p[0]), None)


def sample_keys(windows: np.ndarray, tables: int, walks: int) -> np.ndarray:
    """(tables, rows) keys of the sampled places; places depend on the words of a row and the table only."""
    m, n = windows.shape
    places = np.random.default_rng(SEED + n).integers(0, 2 * n, (tables, SAMPLES))
    keys = np.empty((tables, m), np.uint64)
    for w in range(walks):
        embedded = cgk(windows, SEED + w)
        for t in range(w, tables, walks):
            key = np.full(m, np.uint64(t + 1))
            for place in places[t]:
                key = mix64(key ^ embedded[:, place])
            keys[t] = key
    return keys


def best_run(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(distance, end) of the run of `region` with the fewest word edits to the item."""
    n = len(item)
    m = len(region)
    row = np.zeros(m + 1, np.int64)
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int64)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (region != item[i - 1]), row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """The benchmark items of one broadcast, with their q-grams and LSH tables."""

    def __init__(self, items: list[tuple[object, bytes]], rate: float = RATE):
        kept = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _ in kept]
        self.words = [np.array([xxhash.xxh64_intdigest(x) for x in w], np.uint64) for _, w in kept]
        self.edits = [int(rate * len(w) + 1e-9) for _, w in kept]
        self.vocabulary: dict[bytes, int] = {}
        for _, w in kept:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.need, self.grams = [], {}
        grams: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(kept):
            n, e = len(w), self.edits[k]
            q = max((q for q in (1, 2, 3) if q <= n and n - q + 1 - q * e >= 1), default=1)
            self.need.append(max(1, n - q + 1 - q * e))
            codes = np.array([self.vocabulary[x] for x in w], np.int64)
            for o, code in enumerate(self.codes(codes, q).tolist()):
                grams[q].append((code, k, o))
        for q, rows in grams.items():
            table = np.array(sorted(rows), np.int64)
            keys, first, size = np.unique(table[:, 0], return_index=True, return_counts=True)
            self.grams[q] = (keys, first, size, table[:, 1], table[:, 2])
        self.tables: dict[int, np.ndarray] = {}
        self.slot = np.zeros(len(self.words), np.int64)
        for n in {len(w) for w in self.words}:
            own = np.array([k for k, w in enumerate(self.words) if len(w) == n])
            if size := plan(n, self.edits[own[0]]):
                self.tables[n] = sample_keys(np.stack([self.words[k] for k in own]), *size)
                self.slot[own] = np.arange(len(own))

    def codes(self, ids: np.ndarray, q: int) -> np.ndarray:
        """A number for each run of q vocabulary ids."""
        size = len(self.vocabulary) + 1
        out = ids[: len(ids) - q + 1].copy()
        for k in range(1, q):
            out = out * size + ids[k : len(ids) - q + 1 + k]
        return out

    def _starts(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, start) of all windows that the q-gram count allows, over joined documents."""
        items, spots, offsets = [], [], []
        for q, (keys, first, size, of, offset) in self.grams.items():
            if len(ids) < q:
                continue
            full = ids[: len(ids) - q + 1] > 0
            for k in range(1, q):
                full &= ids[k : len(ids) - q + 1 + k] > 0
            at = np.flatnonzero(full)
            codes = ids[at]
            for k in range(1, q):
                codes = codes * (len(self.vocabulary) + 1) + ids[at + k]
            slot = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
            hit = keys[slot] == codes
            at, slot = at[hit], slot[hit]
            width = size[slot]
            row = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[slot], width)
            items.append(of[row])
            spots.append(np.repeat(at, width))
            offsets.append(offset[row])
        if not sum(map(len, items)):
            return (np.empty(0, np.int64),) * 3
        item, spot = np.concatenate(items), np.concatenate(spots)
        doc = np.searchsorted(begins, spot, side="right") - 1
        start = spot - np.concatenate(offsets) - begins[doc]
        by = np.lexsort((start, doc, item))
        item, doc, start = item[by], doc[by], start[by]
        group = np.cumsum(np.concatenate([[0], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])]))
        line = group * (1 << 33) + start + (1 << 31)
        e = np.array(self.edits)[item]
        enough = np.searchsorted(line, line + 2 * e, side="right") - np.arange(len(line)) >= np.array(self.need)[item]
        item, doc, start, e = item[enough], doc[enough], start[enough], e[enough]
        width = 2 * e + 1
        shift = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) - np.repeat(e, width)
        every = np.unique(np.stack([np.repeat(item, width), np.repeat(doc, width), np.repeat(start, width) + shift]), axis=1)
        return every[0], every[1], every[2] + begins[every[1]]

    def find(self, texts: list[bytes]) -> list[tuple[int, object, int, int]]:
        """(text index, item id, first word, distance): the best run of each leaked item."""
        get = self.vocabulary.get
        lists = [words_of(t) for t in texts]
        sizes = np.array([len(w) + 1 for w in lists], np.int64)
        ids = np.zeros(int(sizes.sum()), np.int64)
        begins = np.cumsum(sizes) - sizes
        for w, a in zip(lists, begins.tolist()):
            ids[a : a + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
        item, doc, start = self._starts(ids, begins)
        if not len(item):
            return []
        n, e = np.array([len(w) for w in self.words])[item], np.array(self.edits)[item]
        start, length = start - begins[doc], sizes[doc] - 1
        # Windows reach past both ends of their document and are padded there, so that a passage at
        # an end has as many windows as any other.
        ok = (start >= -e) & (start < length) & (length >= n - e)
        item, start, doc, n = item[ok], start[ok], doc[ok], n[ok]
        wanted = defaultdict(set)
        for size in np.unique(n).tolist():
            rows = np.flatnonzero(n == size)
            if size not in self.tables:
                for k, d, s in zip(item[rows].tolist(), doc[rows].tolist(), start[rows].tolist()):
                    wanted[d, k].add(s)
                continue
            held = self.tables[size]
            (of, spots), window = np.unique(np.stack([doc[rows], start[rows]]), axis=1, return_inverse=True)
            by = np.argsort(window, kind="stable")
            rows, window = rows[by], window[by]
            for a in range(0, len(spots), 10_000):
                part, at = of[a : a + 10_000], spots[a : a + 10_000]
                windows = np.full((len(part), size), PAD)
                for r, (d, s) in enumerate(zip(part.tolist(), at.tolist())):
                    words = lists[d][max(0, s) : s + size]
                    skip = max(0, -s)
                    windows[r, skip : skip + len(words)] = [xxhash.xxh64_intdigest(x) for x in words]
                keys = sample_keys(windows, *plan(size, self.edits[item[rows[0]]]))
                # A window meets in the tables just the items whose q-gram count it has.
                first, last = np.searchsorted(window, [a, a + len(part)])
                for c in range(first, last, 10_000):
                    pair = rows[c : min(c + 10_000, last)]
                    seen = window[c : c + len(pair)] - a
                    met = np.zeros(len(pair), bool)
                    for t in range(len(keys)):
                        met |= held[t, self.slot[item[pair]]] == keys[t, seen]
                    for k, d, s in zip(item[pair[met]].tolist(), doc[pair[met]].tolist(), start[pair[met]].tolist()):
                        wanted[d, k].add(s)
        out = []
        for (d, k), spots in sorted(wanted.items()):
            size, edits = len(self.words[k]), self.edits[k]
            best = None
            spots = sorted(spots)
            a = 0
            while a < len(spots):
                b = a
                while b + 1 < len(spots) and spots[b + 1] <= spots[b] + size:
                    b += 1
                # A run begins at most 2 e from its windows and is at most e longer than the item.
                first = max(0, spots[a] - 2 * edits)
                region = lists[d][first : spots[b] + size + 3 * edits]
                distance, end = best_run(self.words[k], np.array([xxhash.xxh64_intdigest(x) for x in region], np.uint64))
                if distance <= edits and (best is None or distance < best[0]):
                    best = (distance, max(0, first + end - size))
                a = b + 1
            if best:
                out.append((d, self.ids[k], best[1], best[0]))
        return out


def item_blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", limit: int = BLOCK_BYTES):
    """Item lists of bounded text size, streamed partition by partition."""
    block: list[tuple[object, bytes]] = []
    size = 0
    for r in benchmark.select(F.col(id_column).alias("i"), text_bytes(text_column).alias("t")).toLocalIterator():
        if block and size + len(r.t) > limit:
            yield block
            block, size = [], 0
        block.append((r.i, bytes(r.t)))
        size += len(r.t)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, first_word, distance: a row for each leaked item of a document."""
    spark = docs.sparkSession
    prepare(spark)
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word long, distance int"
    item_kind = pa.int64() if kinds[1] in ("bigint", "long") else pa.int32() if kinds[1] == "int" else pa.string()
    rows, out = docs.select("doc_id", text_bytes().alias("data")), None
    for block in item_blocks(benchmark):
        items = spark.sparkContext.broadcast(Items(block, rate))

        def make(items=items):
            own = items.value

            def run(b: pa.RecordBatch) -> pa.RecordBatch:
                found = own.find(binaries(b.column(1)))
                take = pa.array([f[0] for f in found], pa.int32())
                return pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array([f[1] for f in found], item_kind), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int32())], names=["doc_id", "item_id", "first_word", "distance"])

            return run

        one = map_batches(rows, make, schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that leak no item, with all their columns; map-side only."""
    spark = docs.sparkSession
    prepare(spark)
    out, text = docs, docs.columns.index("text")
    for block in item_blocks(benchmark):
        items = spark.sparkContext.broadcast(Items(block, rate))

        def make(items=items):
            own = items.value

            def run(b: pa.RecordBatch) -> pa.RecordBatch:
                leaking = {f[0] for f in own.find([(t or "").encode() for t in b.column(text).to_pylist()])}
                return b.take(pa.array([i for i in range(b.num_rows) if i not in leaking], pa.int32()))

            return run

        out = map_batches(out, make, docs.schema)
    return out

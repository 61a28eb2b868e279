"""LM scoring by a weighted backoff automaton over all training n-grams.

Model: unigrams smoothed by adding DELTA, P(w) = (c(w) + DELTA) / (N + DELTA (V + 1)); longer
histories by a Dirichlet prior, P(w | h) = (c(h w) + MU P(w | h')) / (c(h) + MU), h' the history
without its oldest word and MU by the history's length. As an automaton: a state per seen history of up to ORDER - 1 words; an
arc per seen n-gram with weight log10 P(w | h), to the state of the longest seen history that
then ends there; a failure arc to the state of h' with weight log10 MU / (c(h) + MU). A text is
scored in one left-to-right traversal that carries the state and adds up what it passes.

The automaton of the whole corpus has no size bound, so it is never collected or broadcast. A
first pass counts training tokens and distinct words. Then each task cuts its documents into
blocks and sends each block's distinct n-grams with their training counts (already added up in
the block) to the shards of their hashes; a shard adds up all blocks and answers each with the
counts of just its n-grams. A block then builds the part of the automaton that its own documents
can reach and traverses them; its documents are read and cut once more for that, which moves
them once instead of twice, and a checksum tells if a read should differ. All shuffles grow in
proportion to the text, with no hot key: a frequent n-gram comes once a block. A block sends a shard one message for all orders and none
where it has nothing for it, so there are never more messages than distinct n-grams of blocks.

N-grams are hashes of XXH64 word hashes, cut to as many bits as make the chance that an n-gram
shares its hash with another one about 2^-SPARE_BITS, whatever the corpus' size.

Defined cases: a null or empty text is the one end token; rows with null id count as id ''; texts
are read whole; repeated rows count and are scored each; an empty table gives an empty result;
other columns are ignored; with no training rows all counts are zero. Scores keep 10 digits, so
that they do not depend on how documents are dealt to blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, id_mod, mix64, prepare, text_bytes, trim, words_of

DELTA, ORDER = 0.1, 3
#: Strength of the prior for histories of one word, and of two or more; by held-out likelihood.
MU = (400.0, 3.0)
#: Tokens in a block, after which a task begins the next one.
BLOCK_TOKENS = 2_000_000
#: Bytes of messages, about, that one shard adds up.
SHARD_BYTES = 64 << 20
#: Bits of an n-gram's hash beyond those that number all n-grams.
SPARE_BITS = 28
#: Tokens of a text that one lane of the traversal takes.
LANE = 256
END, START = 0x9D5C3F1B7A8E6042, 0x3C6EF372FE94F82B


def prior(mu: tuple[float, ...], words: int) -> float:
    return mu[min(words, len(mu)) - 1]


class WordIds(dict):
    """word -> its number in the block, as met; `hashes` has XXH64 by number. 0: start, 1: end."""

    def __init__(self):
        super().__init__()
        self.hashes = [START, END]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


def ngrams(tokens: np.ndarray, starts: np.ndarray, order: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 .. order the positions where a k-gram ends inside its document, and its hashes.

    Each document begins with START, so `tokens` has one START at every index in `starts`.
    """
    begin = np.zeros(len(tokens), np.int32)
    begin[starts] = starts
    depth = np.arange(1, len(tokens) + 1, dtype=np.int32) - np.maximum.accumulate(begin)
    cut = np.uint64(64 - bits)
    h = mix64(tokens)
    for k in range(1, order + 1):
        if k > 1:
            h[1:] = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[1:] + np.uint64(k))
        at = np.flatnonzero(depth >= k) if k > 1 else np.arange(len(tokens))
        yield at, h[at] >> cut


class BackoffAutomaton:
    """The part of the automaton that a block of documents reaches, as arrays.

    State 0 is the empty history; then come the histories of one word, then those of two, and
    so on, as seen in training. `fail` and `cost` are a state's failure arc. `arc[k]` numbers
    the (k+1)-gram that ends at each position of the block among the arcs out of the histories
    of k words (-1: no such arc); `weight[k]` and `to[k]` are those arcs. Out of the empty
    history there is an arc for every word.
    """

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray], size: int, total: int, distinct: int, delta: float = DELTA, mu: tuple[float, ...] = MU):
        """grams[k]: positions where a (k+1)-gram ends, and its number; counts[k]: by number."""
        self.order = len(grams)
        self.base = np.log10((counts[0] + delta) / (total + delta * (distinct + 1)))
        self.arc, self.weight, self.to = [], [], []
        self.fail, self.cost = [np.zeros(1, np.int32)], [np.zeros(1)]
        states, level = 1, [np.zeros(1, np.int8)]
        state_at = np.zeros(size, np.int32)
        rank_before, prob_before = None, None
        for k, ((at, rank), c) in enumerate(zip(grams, counts)):
            seen = c > 0
            whole = np.full(size, -1, np.int32)
            whole[at] = rank
            some = np.zeros(len(c), np.int64)
            some[rank] = at
            if k == 0:
                prob = (c + delta) / (total + delta * (distinct + 1))
                weight = self.base
            else:
                history = counts[k - 1][rank_before[some - 1]]
                prob = (c + prior(mu, k) * prob_before[rank_before[some]]) / (history + prior(mu, k))
                weight = np.log10(prob)
            if k < self.order - 1:
                number = np.where(seen, states + np.cumsum(seen) - 1, -1).astype(np.int32)
                self.fail.append(state_at[some[seen]])
                self.cost.append(np.log10(prior(mu, k + 1) / (c[seen] + prior(mu, k + 1))))
                level.append(np.full(int(seen.sum()), k + 1, np.int8))
                states += int(seen.sum())
                ends = seen[rank]
                state_at[at[ends]] = number[rank[ends]]
                to = np.where(seen, number, 0)
            else:
                to = state_at[some]
            if k:
                whole[at[~seen[rank]]] = -1
            self.arc.append(whole)
            self.weight.append(weight)
            self.to.append(to.astype(np.int32))
            rank_before, prob_before = whole if k == 0 else _filled(size, at, rank), prob
        self.fail, self.cost, self.level = np.concatenate(self.fail), np.concatenate(self.cost), np.concatenate(level)

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading the tokens at these positions, and the weights passed."""
        out = np.zeros(len(state))
        after = np.zeros(len(state), np.int32)
        left = np.arange(len(state))
        for k in range(self.order - 1, 0, -1):
            here = self.level[state[left]] == k
            arc = self.arc[k][at[left]]
            hit = here & (arc >= 0)
            done = left[hit]
            out[done] += self.weight[k][arc[hit]]
            after[done] = self.to[k][arc[hit]]
            miss = left[here & ~hit]
            out[miss] += self.cost[state[miss]]
            state[miss] = self.fail[state[miss]]
            left = left[~hit]
        arc = self.arc[0][at[left]]
        out[left] += self.weight[0][arc]
        after[left] = self.to[0][arc]
        return after, out

    def traverse(self, starts: np.ndarray, lane: int = LANE) -> np.ndarray:
        """log10 probability of each token; 0 at the START tokens.

        Texts are read left to right in lanes of at most `lane` tokens, all lanes one token at a
        step, each carrying its state. A lane inside a text first reads the order - 1 tokens
        before its own, without adding them up: a state is at most that many words.
        """
        size = len(self.arc[0])
        ends = np.append(starts[1:], size)
        many = -(-(ends - starts - 1) // lane)
        text = np.repeat(np.arange(len(starts)), many)
        number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        first = starts[text] + 1 + number * lane
        last = np.minimum(first + lane, ends[text])
        begin = np.maximum(starts[text], first - max(1, self.order - 1))
        by = np.argsort(begin - last, kind="stable")
        begin, first, last = begin[by], first[by], last[by]
        length = last - begin
        state = np.zeros(len(begin), np.int32)
        out = np.zeros(size)
        for t in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -t))
            at = begin[:m] + t
            state[:m], w = self.step(state[:m], at)
            own = at >= first[:m]
            out[at[own]] = w[own]
        return out


def _filled(size: int, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    out = np.zeros(size, np.int32)
    out[at] = rank
    return out


_CODEC = pa.Codec("zstd", compression_level=1)


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed, behind their length."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()
    return len(raw).to_bytes(8, "little") + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def _unpack(b: bytes, dtype: str) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    if not size:
        return np.empty(0, dtype)
    raw = np.frombuffer(_CODEC.decompress(b[8:], size), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def distinct_counts(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (under 2^63) in order, and how often each occurs where `learn` holds."""
    both = keys << np.uint64(1) | learn.astype(np.uint64)
    both.sort()
    keys = both >> np.uint64(1)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    learned = (both & np.uint64(1)).astype(np.int64)
    return keys[new], np.add.reduceat(learned, new) if len(new) else np.empty(0, np.int64)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Each key's number among the distinct keys in order, and how many there are."""
    by = np.argsort(keys)
    keys = keys[by]
    out = np.empty(len(keys), np.int32)
    out[by] = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]), dtype=np.int32) if len(keys) else 0
    return out, int(out[by[-1]]) + 1 if len(keys) else 0


def _cuts(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where each shard's keys begin among sorted keys, and their end."""
    edges = np.array([-((-i << bits) // shards) for i in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


class Block(NamedTuple):
    """Documents that are scored together. flat: word numbers of the joined documents, hashes: of
    the words by number, sizes: tokens of each document, train: which are learned from."""

    number: int
    ids: list[pa.RecordBatch]
    flat: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray
    train: np.ndarray

    @property
    def mark(self) -> int:
        """Tells a block from one that was cut otherwise."""
        parts = (self.flat, self.sizes, self.train, self.hashes)
        return xxhash.xxh64_intdigest(b"".join(x.tobytes() for x in parts)) >> 1


_MESSAGE = "shard long, block long, mark long, a binary, b binary"


def messages(block: Block, order: int, shards: int, bits: int) -> list[tuple[int, int, int, bytes, bytes]]:
    """A message holds how many keys each order has, all keys as gaps, and their training counts."""
    starts = np.cumsum(block.sizes) - block.sizes
    learn = np.repeat(block.train, block.sizes)
    keys, counts, cuts = [], [], []
    for at, h in ngrams(block.hashes[block.flat], starts, order, bits):
        k, n = distinct_counts(h, learn[at])
        keys.append(k)
        counts.append(n.astype(np.uint32))
        cuts.append(_cuts(k, shards, bits))
    rows, mark = [], block.mark
    for s in range(shards):
        spans = [slice(c[s], c[s + 1]) for c in cuts]
        own = [k[x] for k, x in zip(keys, spans)]
        if any(len(x) for x in own):
            head = np.array([len(x) for x in own], np.uint64)
            gaps = [np.diff(x, prepend=np.uint64(0)) for x in own]
            rows.append((s, block.number, mark, _pack(np.concatenate([head, *gaps])), _pack(np.concatenate([n[x] for n, x in zip(counts, spans)]))))
    return rows


_OWN = "block long, mark long, ids binary, hashes binary, flat binary, sizes binary, train binary"


def own_row(block: Block) -> list[tuple]:
    """What a block needs of its documents for the traversal."""
    # Words are numbered by their frequency, which leaves most high bytes zero.
    often = np.argsort(-np.bincount(block.flat, minlength=len(block.hashes)), kind="stable")
    rank = np.empty(len(often), np.uint32)
    rank[often] = np.arange(len(often), dtype=np.uint32)
    doc = pa.BufferOutputStream()
    with pa.ipc.new_stream(doc, block.ids[0].schema) as w:
        for b in block.ids:
            w.write_batch(b)
    parts = (np.frombuffer(doc.getvalue(), np.uint8), block.hashes[often], rank[block.flat], block.sizes, block.train.astype(np.uint8))
    return [(block.number, block.mark, *map(_pack, parts))]


def _blocks(limit: int, tell: Callable[[Block], list[tuple]], columns: str) -> Callable:
    """Rows of (data, train, id) -> what `tell` says of each block of at least `limit` tokens, or a task's rest."""
    names, kinds = zip(*((c.split(" ")[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in columns.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        words, ids, flat, train = WordIds(), [], [], []
        size = 0

        def flush() -> pa.RecordBatch:
            block = Block(part << 24 | number, ids, np.concatenate(flat), np.array(words.hashes, np.uint64), np.array([len(x) for x in flat], np.int64), np.array(train, bool))
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*tell(block)), kinds)], names=list(names))

        for batch in batches:
            begin = 0
            marks = batch.column(1).to_pylist()
            for i, data in enumerate(binaries(batch.column(0))):
                own = words_of(data)
                one = np.empty(len(own) + 2, np.uint32)
                one[0], one[-1] = 0, 1
                one[1:-1] = np.fromiter(map(words.__getitem__, own), np.uint32, len(own))
                flat.append(one)
                train.append(marks[i])
                size += len(one)
                if size >= limit:
                    ids.append(pa.RecordBatch.from_arrays([batch.column(2)[begin : i + 1]], names=["id"]))
                    yield flush()
                    begin, number, size = i + 1, number + 1, 0
                    words, ids, flat, train = WordIds(), [], [], []
            if begin < batch.num_rows:
                ids.append(pa.RecordBatch.from_arrays([batch.column(2)[begin:]], names=["id"]))
        if flat:
            yield flush()
        words = ids = flat = None
        trim()

    return run


def _answer(order: int) -> Callable:
    """A shard's messages -> counts for each block, in the order of its keys."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        gaps = [_unpack(a, "<u8") for a in frame["a"]]
        sizes = np.array([g[:order] for g in gaps]).astype(np.int64)
        counts = [_unpack(b, "<u4") for b in frame["b"]]
        ends = np.cumsum(sizes, axis=1)
        answers: list[list[np.ndarray]] = [[] for _ in gaps]
        for k in range(order):
            flat = np.concatenate([np.cumsum(g[order + e[k] - s[k] : order + e[k]], dtype=np.uint64) for g, e, s in zip(gaps, ends, sizes)])
            n = np.concatenate([c[e[k] - s[k] : e[k]] for c, e, s in zip(counts, ends, sizes)]).astype(np.int64)
            by = np.argsort(flat, kind="stable")  # quick, as it is made of sorted runs
            flat = flat[by]
            new = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
            sums = np.add.reduceat(n[by], new) if len(new) else np.empty(0, np.int64)
            told = np.empty(len(flat), np.int64)
            told[by] = np.repeat(sums, np.diff(np.append(new, len(flat))))
            for own, part in zip(answers, np.split(told, np.cumsum(sizes[:, k])[:-1])):
                own.append(part)
        return pd.DataFrame({"block": frame["block"], "mark": frame["mark"], "shard": key[0], "a": [_pack(np.concatenate(x)) for x in answers]})

    return run


def _ten_digits(x: np.ndarray) -> list[float]:
    return [float(f"{v:.10g}") for v in x.tolist()]


def _traverse(order: int, bits: int, shards: int, total: int, distinct: int, delta: float, mu: tuple[float, ...], id_column: str) -> Callable:
    def run(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if len(own) != 1 or not len(frame) or (frame["mark"] != own["mark"][0]).any():
            raise RuntimeError("the documents were not the same when read again")
        own = own.iloc[0]
        ids = pa.ipc.open_stream(_unpack(own["ids"], "u1").tobytes()).read_all().column(0)
        hashes, flat, sizes, train = (_unpack(own[c], d) for c, d in (("hashes", "<u8"), ("flat", "<u4"), ("sizes", "<i8"), ("train", "u1")))
        starts = np.cumsum(sizes) - sizes
        told = frame.sort_values("shard")
        answers = [_unpack(a, "<i8") for a in told["a"]]
        shard = told["shard"].to_numpy()
        grams, counts = [], []
        used = np.zeros(len(answers), np.int64)
        for at, h in ngrams(hashes[flat], starts, order, bits):
            rank, n = numbered(h)
            grams.append((at.astype(np.int32), rank))
            lowest = np.empty(n, np.uint64)
            lowest[rank] = h
            size = np.diff(_cuts(lowest, shards, bits))[shard]
            counts.append(np.concatenate([a[u : u + s] for a, u, s in zip(answers, used, size)]).astype(np.float64) if n else np.empty(0))
            used += size
        automaton = BackoffAutomaton(grams, counts, len(flat), total, distinct, delta, mu)
        arcs = automaton.traverse(starts)
        rank = grams[0][1]
        base, known = automaton.base[rank], counts[0][rank] > 0
        base[starts], known[starts] = 0.0, False
        added = lambda x: _ten_digits(np.add.reduceat(x.astype(np.longdouble), starts).astype(np.float64))
        return pd.DataFrame(
            {
                id_column: ids.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get),
                "held_out": train == 0,
                "n_tokens": sizes - 1,
                "n_known": np.add.reduceat(known.astype(np.int64), starts),
                "train_tokens": total,
                "base_score": added(base),
                "score": added(arcs),
            }
        )

    return run


def corpus_size(rows: DataFrame) -> tuple[int, int, int]:
    """(all tokens, training tokens, distinct training tokens) of rows of (data, train)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = learned = 0
        met: set[bytes] = set()
        told: list[np.ndarray] = []

        def flush() -> None:
            told.append(np.fromiter(map(xxhash.xxh64_intdigest, met), np.uint64, len(met)).view(np.int64))
            met.clear()

        for batch in batches:
            for data, learn in zip(binaries(batch.column(0)), batch.column(1).to_pylist()):
                own = words_of(data)
                tokens += len(own) + 1
                if learn:
                    learned += len(own) + 1
                    met.update(own)
                    if len(met) > 1 << 20:
                        flush()
        flush()
        hashes = pa.array(np.unique(np.concatenate(told)))
        none = pa.nulls(len(hashes), pa.int64())
        yield pa.RecordBatch.from_arrays([hashes, none, none], names=["h", "tokens", "learned"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([tokens]), pa.array([learned])], names=["h", "tokens", "learned"])

    told = rows.select("data", "train").mapInArrow(run, "h long, tokens long, learned long")
    # One row a word, and one (null) for all tallies.
    words = told.groupBy("h").agg(F.sum("tokens").alias("tokens"), F.sum("learned").alias("learned"))
    n, tokens, learned = words.agg(F.count("h"), F.sum("tokens"), F.sum("learned")).first()
    return tokens or 0, learned or 0, n + (1 if learned else 0)


def score_documents(docs: DataFrame, train: Column, order: int = ORDER, delta: float = DELTA, mu: tuple[float, ...] = MU, id_column: str = "doc_id", text_column: str = "text", block_tokens: int = BLOCK_TOKENS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Scores every row; rows where `train` holds are what the model learns from.

    A task holds one block of `block_tokens` (about 150 bytes each) or one shard of about
    `shard_bytes` of messages; raise both with the executors' memory, so that messages stay large.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(text_bytes(text_column).alias("data"), F.coalesce(train, F.lit(False)).alias("train"), F.col(id_column))
    kind = docs.schema[id_column].dataType.simpleString()
    tokens, total, distinct = corpus_size(rows)
    bits = min(63, max(1, tokens * order).bit_length() + SPARE_BITS)
    shards = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 6 * order * tokens // shard_bytes)
    sent = rows.mapInArrow(_blocks(block_tokens, lambda b: messages(b, order, shards, bits), _MESSAGE), _MESSAGE)
    own = rows.mapInArrow(_blocks(block_tokens, own_row, _OWN), _OWN)
    # Shards and blocks are few and large: many partitions keep several from meeting in one task.
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * shards)
    answers = sent.repartition(parts, "shard").groupBy("shard").applyInPandas(_answer(order), "block long, mark long, shard long, a binary")
    traverse = _traverse(order, bits, shards, total, distinct, delta, mu, id_column)
    both = answers.repartition(parts, "block").groupBy("block").cogroup(own.repartition(parts, "block").groupBy("block"))
    return both.applyInPandas(traverse, f"{id_column} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_scores(docs: DataFrame, folds: int = 10, **options) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod `folds` is not 0, scores all."""
    return score_documents(docs, id_mod(folds) != 0, **options)

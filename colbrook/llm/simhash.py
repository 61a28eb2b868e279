"""SimHash near-dedup with BK-trees over shards of fingerprints.

A document's fingerprint has a bit set where over half of its word-shingle hashes have it: 64
bits, or several words of 64 bits, each from its own mix of the hash. Distinct fingerprints are
dealt to shards by keys of some of their bits:

* `spans`: the bits are cut into s > radius spans, and each choice of s - radius of them is a key.
  Two fingerprints that differ in at most `radius` bits agree on s - radius whole spans at least, so
  no link is lost. s follows the number of fingerprints, so that a shard holds about 64 of them and
  the pairs that are looked at grow in proportion to the fingerprints.
* `samples`: for wide fingerprints and radii, each key is a sample of bits; their number follows
  from the target recall at the given similarity, their width from the number of fingerprints.

In each shard a BK-tree (children keyed by the integer Hamming distance to the parent) is
searched along the edges within the radius only. A task holds many small shards and builds their
trees together, level by level. A shard of over SHARD fingerprints is cut into pieces; each
piece's tree meets every other piece in a task of its own, so no task holds more than two. The
trees travel by shuffle with their shard key and not by broadcast: a broadcast needs the
fingerprints of all documents on the driver, about 40 bytes for each of the keys, without a bound. A shard gives a spanning forest of its links, never all pairs. Connected
components over these links come from large-star and small-star steps on written tables.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links
like any other; fewer words than a shingle give one shingle; a null doc_id counts as larger than
any other; ids may be of any type that sorts; repeated rows link through their equal fingerprint; different texts under one doc_id
are different documents; an empty table gives an empty result; other columns are ignored or kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, binaries, map_batches, materialise, mix64, prepare, release, text_bytes, trim, without, words_of

#: Most fingerprints in one tree; dealt rows that one task takes; pairs looked at in one step.
SHARD, TASK_ROWS, ROOM = 20_000, 20_000, 2_000_000
#: Most rows of a candidate component, or of a piece of it, that are compared together.
PIECE = 500
#: Most shingles of a text whose candidates come from its shingles too.
SHORT = 40
#: Most hot shard keys that are broadcast; beyond, they are joined by shuffle.
HOT_KEYS = 500_000
#: Ways that a large component's fingerprints are dealt to when they learn its number.
SALTS = 16
SEED = 97


@dataclass(frozen=True)
class Settings:
    """shingle: words; size: 64-bit words of a fingerprint; radius: bits; distinct: count each
    different shingle once; recall: of pairs at `similarity`, for sampled keys (0: spans);
    reach: the radius for candidates whose similarity is then decided exactly."""

    shingle: int = 4
    size: int = 1
    radius: int = 4
    distinct: bool = False
    similarity: float = 0.0
    recall: float = 0.0
    reach: int = 0

    @classmethod
    def for_similarity(cls, similarity: float, shingle: int = 5, size: int = 8, recall: float = 0.98) -> Settings:
        """Fingerprints and a radius that link texts whose shingle sets have this Jaccard similarity.

        Sets of similarity J have cosine 2J / (1 + J), and each bit differs with probability
        acos(cosine) / pi. The radius lies two standard deviations above the mean distance,
        the reach 3.5, which leaves out 3 in 10,000 such pairs.
        """
        p = differing(similarity)
        bits = 64 * size
        mean, sd = bits * p, math.sqrt(bits * p * (1 - p))
        return cls(shingle, size, round(mean + 2 * sd), True, similarity, recall, round(mean + 3.5 * sd))


def differing(similarity: float) -> float:
    """Probability that a bit differs between texts of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


# -- fingerprints ----------------------------------------------------------------------------


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included."""
    words = words_of(data)
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    return np.fromiter((h(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)


def fingerprint(data: bytes, settings: Settings) -> bytes:
    """The fingerprint as a number in bytes, highest first; its lowest word is of the plain hashes."""
    h = shingle_hashes(data, settings.shingle)
    if settings.distinct:
        h = np.unique(h)
    out = []
    for k in range(settings.size):
        own = mix64(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if k else h
        total = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 15):
            bits = np.unpackbits(own[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.int32)
        out.append(np.packbits(2 * total > len(h), bitorder="little").tobytes())
    return b"".join(out)[::-1]


def fingerprints(docs: DataFrame, settings: Settings, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and fp of every row, written to the shared folder."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = [fingerprint(t, settings) for t in binaries(b.column(0))]
            return pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp, pa.binary())], names=[*keys, "fp"])

        return run

    rows = docs.select(text_bytes().alias("data"), *keys)
    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys) + ", fp binary"
    return materialise(map_batches(rows, make, schema), "fingerprints")


# -- trees -----------------------------------------------------------------------------------


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class BKForest:
    """One BK-tree a shard, in arrays: node i's children are `first[i]:last[i]`, sorted by edge."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        n = len(values)
        self.order = np.empty(n, np.int64)
        self.edge, self.first, self.last = (np.zeros(n, np.int64) for _ in range(3))
        self.shards, roots, index = np.unique(shard, return_index=True, return_inverse=True)
        made = len(roots)
        self.order[:made] = roots
        members = np.setdiff1d(np.arange(n), roots)
        of = index[members]
        while len(members):
            d = distance(values[members], values[self.order[of]])
            by = np.lexsort((members, d, of))
            members, d, of = members[by], d[by], of[by]
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (d[1:] != d[:-1])])
            heads = np.flatnonzero(new)
            ids = made + np.arange(len(heads))
            self.order[ids], self.edge[ids] = members[heads], d[heads]
            parents = of[heads]
            self.first[parents[::-1]] = ids[::-1]
            self.last[parents] = ids + 1
            made += len(heads)
            members, of = members[~new], ids[(np.cumsum(new) - 1)[~new]]
        self.values = values[self.order]
        self.size = np.bincount(index, minlength=len(roots)) if n else np.zeros(0, np.int64)

    def search(self, queries: np.ndarray, shard: np.ndarray, radius: int, room: int = ROOM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, value rows) of all pairs of one shard within the radius, in blocks."""
        if not len(self.shards) or not len(queries):
            return
        root = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        asked = np.flatnonzero(self.shards[root] == shard)
        asked = asked[np.argsort(root[asked], kind="stable")]
        block = np.cumsum(self.size[root[asked]]) // max(1, room // queries.shape[1])
        for q in np.split(asked, np.flatnonzero(np.diff(block)) + 1) if len(asked) else ():
            node = root[q]
            while len(q):
                d = distance(queries[q], self.values[node])
                near = d <= radius
                yield q[near], self.order[node[near]]
                width = self.last[node] - self.first[node]
                has = width > 0
                q, node, d, width = q[has], node[has], d[has], width[has]
                child = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.first[node], width)
                follow = np.abs(self.edge[child] - np.repeat(d, width)) <= radius
                q, node = np.repeat(q, width)[follow], child[follow]


def _find(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of each of n items the smallest item that it is linked to, by min-label hooking."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            odd = ra != rb
            if not odd.any():
                break
            a, b, ra, rb = a[odd], b[odd], ra[odd], rb[odd]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            root = _find(root)
    return root


def shard_links(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Spanning links (a, b) inside the shards of one task, or between the pieces p and o of a shard."""
    n = len(frame)
    fp = np.frombuffer(b"".join(frame["fp"]), np.uint64).reshape(n, -1)
    rep, piece = frame["rep"].to_numpy(), frame["piece"].to_numpy()
    shard = frame.groupby(["key", "p", "o"], sort=False).ngroup().to_numpy()
    tree_rows = np.flatnonzero(piece == frame["p"].to_numpy())
    ask_rows = np.flatnonzero(piece == frame["o"].to_numpy())
    trees = BKForest(fp[tree_rows], shard[tree_rows])
    root = forest(n, ((ask_rows[q], tree_rows[v]) for q, v in trees.search(fp[ask_rows], shard[ask_rows], radius)))
    del fp, trees
    trim()
    linked = root != np.arange(n)
    return pd.DataFrame({"a": rep[linked], "b": rep[root[linked]]}).drop_duplicates()


# -- shards ----------------------------------------------------------------------------------


def linked_share(settings: Settings, width: int, keys: int) -> float:
    """Share of pairs at the similarity that lie within the radius and meet in a shard, over all distances."""
    bits, p = 64 * settings.size, differing(settings.similarity)
    share = 0.0
    for d in range(settings.radius + 1):
        agree = math.comb(bits - d, width) / math.comb(bits, width)
        share += math.comb(bits, d) * p**d * (1 - p) ** (bits - d) * (1 - (1 - agree) ** keys)
    return share


def key_count(settings: Settings, width: int) -> int:
    """Fewest keys that reach the target recall, or 99 % of what the radius leaves where that is less."""
    within = linked_share(settings, 0, 1)
    low, high = 0, 1
    while linked_share(settings, width, high) < min(settings.recall, 0.99 * within):
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if linked_share(settings, width, middle) < min(settings.recall, 0.99 * within) else (low, middle)
    return high


def key_bits(settings: Settings, count: int) -> list[np.ndarray]:
    """The bit numbers of each shard key, for `count` fingerprints."""
    bits = 64 * settings.size
    if not settings.recall:
        r = settings.radius
        want = math.log2(max(2, count) / 64)
        n = next((n for n in range(r + 1, r + 6) if bits * (n - r) / n >= want), r + 5)
        cuts = [i * bits // n for i in range(n + 1)]
        spans = [np.arange(a, b) for a, b in zip(cuts, cuts[1:])]
        return [np.concatenate(c) for c in combinations(spans, n - r)]
    width = min(40, max(12, math.ceil(math.log2(max(2, count) / 64))))
    keys = key_count(settings, width)
    rng = np.random.default_rng(SEED)
    pool = np.concatenate([rng.permutation(bits) for _ in range(math.ceil((keys + 1) * width / (bits - width)) + 1)])
    return [pool[k * width : (k + 1) * width] for k in range(keys)]


def shard_keys(fp: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
    """(rows, keys): a 64-bit number of the key's place and bits."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
    out = np.empty((len(fp), len(chosen)), np.uint64)
    for k, at in enumerate(chosen):
        value = np.zeros(len(fp), np.uint64)
        for b in at:
            value = value << np.uint64(1) | bits[:, b].astype(np.uint64)
        out[:, k] = mix64(value ^ mix64(np.array([k + 1], np.uint64)))
    return out


def links_of(nodes: DataFrame, settings: Settings, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between representatives of distinct fingerprints: nodes(fp binary, rep long)."""
    spark = nodes.sparkSession
    count = nodes.count()
    chosen = key_bits(settings, count)
    width = 8 * settings.size

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(b.num_rows, -1)
            keys = shard_keys(raw, chosen)
            take = np.repeat(np.arange(b.num_rows), len(chosen))
            fp = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(take), [None, pa.py_buffer(np.ascontiguousarray(raw[take]).tobytes())]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), fp, b.column(1).take(pa.array(take))], names=["key", "fp", "rep"])

        return run

    dealt = map_batches(nodes.select("fp", "rep"), make, "key long, fp binary, rep long")
    hot = materialise(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > shard), "hot")
    n_hot = hot.count()
    tasks = max(1, math.ceil(count * len(chosen) / TASK_ROWS))
    if n_hot:
        rows = dealt.join(F.broadcast(hot) if n_hot <= HOT_KEYS else hot, "key", "left")
        pieces = F.coalesce(F.ceil(F.col("size") / shard), F.lit(1)).cast("int")
        rows = rows.withColumn("piece", F.pmod(F.xxhash64("fp"), pieces).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), pieces - 1), lambda o: F.struct(F.least(o, F.col("piece")).alias("p"), F.greatest(o, F.col("piece")).alias("o")))
        rows = rows.select("key", "fp", "rep", "piece", F.explode(pairs).alias("pair")).select("key", "fp", "rep", "piece", "pair.p", "pair.o")
    else:
        zero = F.lit(0)
        rows = dealt.select("key", "fp", "rep", zero.alias("piece"), zero.alias("p"), zero.alias("o"))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("key", "p", "o"), F.lit(tasks)))
    return rows.repartition(min(tasks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "task").groupBy("task").applyInPandas(lambda f: shard_links(f, settings.radius), "a long, b long")


# -- components ------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all linked nodes; root is the smallest node of the component.

    Alternates large-star and small-star until no link changes, which it reaches in a number of steps
    that grows with the logarithm of the nodes. Each step aggregates links by
    node with partial minima; a star with very many leaves is never collected in one task.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state, path = None, WRITTEN[-1]
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialise(small, "links")
        release(edges.sparkSession, [path])
        path = WRITTEN[-1]
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def short_keys(texts: DataFrame, settings: Settings) -> DataFrame:
    """(fp, key) of texts of at most SHORT shingles: the first of their sorted shingle hashes.

    Two sets of this similarity have one of these in common: of n hashes each shares at least
    similarity * n, so that one of the first n + 1 less this number is shared. No such pair is lost.
    """

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            fps, keys = [], []
            for t in binaries(b.column(0)):
                if len(words_of(t)) >= SHORT + settings.shingle:
                    continue
                h = np.unique(shingle_hashes(t, settings.shingle))
                first = h[: len(h) + 1 - math.ceil(settings.similarity * len(h) - 1e-9)] if len(h) else h
                fps += [fingerprint(t, settings)] * len(first)
                keys += first.view(np.int64).tolist()
            return pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(keys, pa.int64())], names=["fp", "key"])

        return run

    return map_batches(texts.select("data"), make, "fp binary, key long")


def component_ids(table: DataFrame, settings: Settings, short: DataFrame | None = None) -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint of a table with doc_id and fp.

    A component is numbered by one of its fingerprints; component_id is its smallest doc_id.
    Fingerprints with a key of `short` (fp, key) in common are linked too.
    """
    nodes = table.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = materialise(nodes.withColumn("rep", F.monotonically_increasing_id()), "nodes")
    links = links_of(nodes, settings)
    if short is not None:
        held = materialise(short.join(nodes, "fp").select("key", "rep").distinct(), "short")
        lowest = materialise(held.groupBy("key").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), "lowest")
        links = links.unionByName(held.join(lowest, "key").select(F.col("rep").alias("a"), "b"))
    found = components(links)
    joined = nodes.join(found, nodes["rep"] == found["node"], "left").withColumn("salt", F.pmod(F.col("rep"), F.lit(SALTS)))
    alone = joined.where(F.col("root").isNull()).select("fp", F.col("rep").alias("component"), F.col("low").alias("component_id"))
    # A root is its component's smallest node and has no row in `found`.
    linked = joined.where(F.col("root").isNotNull()).select("fp", "low", "root", "salt")
    roots = nodes.select(F.col("rep").alias("root"), F.col("low").alias("root_low"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("low")).join(roots, "root").select("root", F.least("low", "root_low").alias("component_id"))
    spread = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    linked = linked.join(spread, ["root", "salt"]).select("fp", F.col("root").alias("component"), "component_id")
    alone = alone.join(lowest.withColumnRenamed("component_id", "low"), alone["component"] == F.col("root"), "left").select("fp", "component", F.coalesce("low", "component_id").alias("component_id"))
    return alone.unionByName(linked)


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, fingerprint (hex digits, highest first), component_id of every document."""
    prepare(docs.sparkSession)
    table = fingerprints(docs, settings)
    ids = component_ids(table, settings)
    return table.join(ids, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# -- exact similarity ------------------------------------------------------------------------


def similar_forest(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Of each set of distinct hashes one that it is linked to by Jaccard similarity, or itself."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    code = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), size)[np.argsort(code, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(code))]) if len(code) else np.zeros(1, np.int64)
    begin = np.cumsum(size) - size
    root, open_ = np.arange(n), np.ones(n, bool)
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed] = False
        todo = [seed]
        while todo and open_.any():
            i = todo.pop()
            if size[i]:
                own = code[begin[i] : begin[i] + size[i]]
                width = first[own + 1] - first[own]
                at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[own], width)
                both = np.bincount(owner[at], minlength=n)
                like = both >= similarity * (size + size[i] - both) - 1e-9
            else:
                like = size == 0
            new = np.flatnonzero(like & open_)
            root[new], open_[new] = seed, False
            todo += new.tolist()
    return root


def similar_links(frame: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """Spanning links (a, b) of true similarity inside the components, or pairs of pieces, of one task."""
    out = []
    for _, group in frame.groupby(["component", "p", "o"], sort=False):
        root = similar_forest([np.unique(shingle_hashes(t, settings.shingle)) for t in group["data"]], settings.similarity)
        rid = group["rid"].to_numpy()
        linked = root != np.arange(len(group))
        out.append(pd.DataFrame({"a": rid[linked], "b": rid[root[linked]]}))
    trim()
    return pd.concat(out)


def similar_rows(found: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """(rid, root) of the rows that true similarity links to another: found(rid, component), texts(rid, data).

    Every pair inside a candidate component is decided by its shingles; a component of over PIECE
    rows is cut, and each two of its pieces meet in a group of their own.
    """
    spark = found.sparkSession
    # Written, so that the join's side with the rows of one large component can be split.
    sizes = materialise(found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    members = materialise(found.join(sizes, "component").select("rid", "component", "size"), "members")
    pieces = F.ceil(F.col("size") / PIECE).cast("int")
    rows = texts.join(members, "rid").withColumn("piece", F.pmod(F.xxhash64("rid"), pieces).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), pieces - 1), lambda o: F.struct(F.least(o, F.col("piece")).alias("p"), F.greatest(o, F.col("piece")).alias("o")))
    rows = rows.select("rid", "data", "component", F.explode(pairs).alias("pair")).select("rid", "data", "component", "pair.p", "pair.o")
    tasks = max(1, math.ceil(members.count() / PIECE), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("component", "p", "o"), F.lit(tasks)))
    links = rows.groupBy("task").applyInPandas(lambda f: similar_links(f, settings), "a long, b long")
    return components(links).select(F.col("node").alias("rid"), "root")


def drop_near_copies(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The row with the smallest doc_id of every component, with all columns.

    With a similarity set, fingerprints give the candidates only: links are pairs whose shingle
    sets have that Jaccard similarity.
    """
    prepare(docs.sparkSession)
    # Row numbers tell repeated rows apart; written, they stay the same however often they are read.
    rid = "rid"
    while rid in docs.columns:
        rid = f"_{rid}"
    numbered = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    table = fingerprints(numbered, settings, ("doc_id", rid))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(rid).alias("r"))
    short = short_keys(numbered.select(text_bytes().alias("data")), settings) if settings.similarity else None
    candidates = component_ids(table, replace(settings, radius=settings.reach or settings.radius), short)
    found = table.join(candidates, "fp").select(F.col(rid), "component", order.alias("order"))
    if settings.similarity:
        found = materialise(found.withColumnRenamed(rid, "rid"), "found")
        similar = similar_rows(found, numbered.select(F.col(rid).alias("rid"), text_bytes().alias("data")), settings)
        found = found.join(similar, "rid", "left").select(F.col("rid").alias(rid), F.coalesce("root", "rid").alias("component"), "order")
    best = found.groupBy("component").agg(F.min("order").alias("best")).select(F.col("best.r").alias(rid))
    return without(numbered, rid, table.select(rid).join(best, rid, "left_anti")).select(*docs.columns)

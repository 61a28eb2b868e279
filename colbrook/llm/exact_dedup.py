"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after deleting white space. A table of digests is written once.
Each partition makes a Misra-Gries summary of k counters. A counter falls short of its digest's
count by at most the partition's rows / (k + 1), so that in the counters added up by digest every
digest with over 2 / (k + 1) of all rows stands above rows / (k + 1), as do at most k others. Their
true counts and winners come from one partial aggregation over just these, and are broadcast so
that all their rows are settled map-side. The remaining digests are aggregated and joined by
ordinary shuffles; the largest groups among them are bounded by k, and a join splits those.

k follows the rows, so that these groups stay near LIGHT_ROWS, between the bounds MIN_K and MAX_K.

Defined cases: a null text counts as empty; of equal texts the row with the most code points in
its original text stays, then the smallest doc_id (null last), then any one of repeated rows;
ids may be of any type that sorts; an empty table gives an empty result; other columns are
ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialise, prepare, without

#: Rows of a group that are left to the shuffle, about; bounds of a summary's counters. MAX_K bounds
#: the broadcast: about 150 bytes a winner.
LIGHT_ROWS, MIN_K, MAX_K = 100_000, 1000, 100_000


def mg_merge(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge (key, count) pairs into a summary of at most k counters.

    Adds equal keys, then lowers all by the (k+1)-th largest count; what stays positive is kept.
    A key's counter falls short of its count by at most rows / (k + 1).
    """
    s = pd.Series(counts).groupby(keys).sum()
    if len(s) > k:
        v = s.to_numpy()
        s = s - np.partition(v, len(v) - k - 1)[len(v) - k - 1]
        s = s[s > 0]
    return s.index.to_numpy(), s.to_numpy()


def _summaries(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.array([], dtype=object), np.array([], dtype=np.int64)
        for f in frames:
            own = f["digest"].value_counts()
            keys, counts = mg_merge(np.concatenate([keys, own.index.to_numpy()]), np.concatenate([counts, own.to_numpy()]), k)
        yield pd.DataFrame({"digest": keys, "n": counts.astype(np.int64)})

    return run


def counters(rows: int) -> int:
    """Counters of a summary over so many rows."""
    return min(MAX_K, max(MIN_K, 2 * rows // LIGHT_ROWS))


def heavy_hitters(digests: DataFrame, rows: int, k: int) -> DataFrame:
    """(digest, n), at most k candidates: every digest with over 2 rows / (k + 1) rows is among them."""
    own = digests.select("digest").mapInPandas(_summaries(k), "digest string, n long")
    return own.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") > rows // (k + 1))


def digest_table(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: rid (row number that tells repeated rows apart), doc_id, digest, n."""
    text = F.coalesce(F.col("text"), F.lit(""))
    table = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id"),
        F.sha2(F.translate(text, WHITE, "").cast("binary"), 256).alias("digest"),
        F.char_length(text).cast("long").alias("n"),
        *([F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []),
    )
    return materialise(table, "digests")


def _decide(table: DataFrame, k: int | None) -> DataFrame:
    """Adds keep_id, group_size and kept to every row of a digest table."""
    order = F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    winner = F.min_by(F.struct("doc_id", "rid"), order).alias("w")
    own = [c for c in table.columns if c != "n"]
    total = table.count()
    k = k or counters(total)
    candidates = F.broadcast(heavy_hitters(table, total, k).select(F.col("digest").alias("g_digest")))
    found = table.join(candidates, F.col("digest") == F.col("g_digest")).groupBy("g_digest").agg(winner, F.count(F.lit(1)).alias("g_size"))
    winners = materialise(found, "heavy")
    settled = lambda rows: rows.select(*own, F.col("w.doc_id").alias("keep_id"), F.col("g_size").alias("group_size"), (F.col("rid") == F.col("w.rid")).alias("kept"))
    marked = table.join(F.broadcast(winners), F.col("digest") == F.col("g_digest"), "left")
    light = marked.where(F.col("g_size").isNull()).select(*table.columns)
    groups = light.groupBy(F.col("digest").alias("g_digest")).agg(winner, F.count(F.lit(1)).alias("g_size"))
    return settled(marked.where(F.col("g_size").isNotNull())).unionByName(settled(light.join(groups, F.col("digest") == F.col("g_digest"))))


def exact_dedup(docs: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    prepare(docs.sparkSession)
    return _decide(digest_table(docs), k).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, k: int | None = None) -> DataFrame:
    """The documents that stay, with all their columns.

    Decisions are made on digests alone; the texts are filtered by the dropped row numbers.
    """
    prepare(docs.sparkSession)
    table = digest_table(docs, tuple(docs.columns))
    dropped = _decide(table.drop("row"), k).where(~F.col("kept")).select("rid")
    return without(table, "rid", dropped).select("row.*")

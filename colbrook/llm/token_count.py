"""Token counts of a byte-level BPE vocabulary with a whole-token shortcut.

Offline, each vocabulary string is run through the merges; those that end as one token form a
proven set. A text is cut into pre-tokens; those in the set count one without any merging, and
only the rest are merged (each distinct one once a worker, in a memo of bounded size).
Special strings inside a text count one token each, as the library does by default.

Defined cases: a null text counts as empty (0 tokens); texts of any length are counted whole;
rows may repeat; other columns are ignored; an empty table gives an empty result. The vocabulary
is a file of fixed size; it is checked against MAX_VOCABULARY entries before being broadcast.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_batches, prepare

#: The pre-token pattern that byte-level BPE vocabularies of this kind are made for.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Largest vocabulary that is broadcast; pre-tokens a worker remembers in each of two generations.
MAX_VOCABULARY, MEMO = 1_000_000, 200_000


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Merges of a tokenizers JSON file as byte strings, special strings, and the proven set."""

    def __init__(self, content: str):
        model = json.loads(content)
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["model"]["vocab"] if all(c in letters for c in t)}
        self.specials = [t["content"] for t in model["added_tokens"] if t["special"]]
        if len(raw) > MAX_VOCABULARY:
            raise ValueError(f"vocabulary of {len(raw)} entries; at most {MAX_VOCABULARY} are broadcast")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.ranks = {(raw[a], raw[b]): i for i, (a, b) in enumerate(pairs)}
        self.whole = frozenset(s for t, b in raw.items() if t not in self.specials and self.merged(b) == 1 and (s := _text(b)) is not None)

    def merged(self, word: bytes) -> int:
        """Tokens of one pre-token: repeatedly join the adjacent pair of the lowest rank."""
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 400:
            return self._merged_long(parts)
        ranks = self.ranks.get
        scores = [ranks(p, 1 << 30) for p in zip(parts, parts[1:])]
        while scores:
            low = min(scores)
            if low == 1 << 30:
                break
            i = scores.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = ranks((parts[i], parts[i + 1]), 1 << 30)
            if i:
                scores[i - 1] = ranks((parts[i - 1], parts[i]), 1 << 30)
        return len(parts)

    def _merged_long(self, parts: list[bytes]) -> int:
        """The same with a heap and links: n log n for very long pre-tokens."""
        import heapq

        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        ranks = self.ranks.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            left -= 1
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (r := ranks((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
        return left


def _text(b: bytes) -> str | None:
    try:
        return b.decode()
    except UnicodeDecodeError:
        return None


class Counter(Memo):
    """pre-token -> tokens: 1 for proven strings, others merged when first met."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(MEMO)
        self.vocabulary = vocabulary
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True)))) if vocabulary.specials else None

    def compute(self, token: str) -> int:
        return 1 if token in self.vocabulary.whole else self.vocabulary.merged(token.encode())

    def count(self, text: str) -> int:
        if self.split and any(s in text for s in self.vocabulary.specials):
            pieces = self.split.split(text)
            return len(pieces) - 1 + sum(sum(map(self.__getitem__, self.find(p))) for p in pieces)
        return sum(map(self.__getitem__, self.find(text)))


_COUNTERS: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    prepare(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    vocabulary = spark.sparkContext.broadcast(Vocabulary(content))
    key = hash((tokenizer_path, len(content)))
    kind = docs.schema[id_column].dataType.simpleString()

    def make():
        counter = _COUNTERS.get(key)
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[key] = Counter(vocabulary.value)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            n = [counter.count(t) for t in texts]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

        return run

    return map_batches(docs.select(F.col(id_column), F.col(text_column).cast("string")), make, f"{id_column} {kind}, n_bytes long, n_tokens long, over_limit boolean")

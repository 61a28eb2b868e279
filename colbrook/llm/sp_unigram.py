"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

White space becomes the marker U+2581, with one marker put before the text where the model says
so. The best segmentation maximises the sum of piece scores; it is found by Viterbi over a
double-array trie of the pieces' UTF-8 bytes. A character that no piece covers costs ten less
than the lowest score and falls back to one byte piece per UTF-8 byte. No piece holds a marker
after another character, and some characters are in no longer piece: the best segmentation is
therefore the joined segmentation of the units between those places, each found once a worker.

Decoding joins pieces, decodes byte pieces as UTF-8 (invalid bytes become U+FFFD), turns markers
into spaces and drops the marker put in front.

The work on a text is its length times that of the longest piece at most, spaced or not. Scores
are the model file's own. Of segmentations with equal sums the one whose last piece began
first is taken.

Defined cases: a null text counts as empty and gives no pieces; a text that itself holds U+2581
decodes to a space there; texts are encoded whole at any length; repeated rows repeat; other
columns are ignored or carried; an empty table gives an empty result. A model of over
MAX_PIECES pieces is refused, as it is broadcast.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_batches, prepare

MARK = "▁"
#: Largest model that is broadcast; units that a worker remembers in each of two generations.
MAX_PIECES, MEMO = 1_000_000, 100_000
#: Bytes of a unit from which its Viterbi rows are kept in arrays, at 16 bytes for each of its bytes.
LONG_UNIT = 1 << 16
#: Cost of an uncovered character below the lowest score, as SentencePiece sets it.
UNKNOWN_PENALTY = 10.0
#: Scores under this mark pieces that the model never chooses; they don't set the lowest score.
UNUSED_SCORE = -1e8
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message: bytes for lengths, ints else."""
    at, n = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    while at < n:
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class DoubleArray:
    """BASE and CHECK arrays over bytes, and the value of each state (-1: none).

    The child of `state` by byte c is base[state] + c, if check says that it is. The arrays end
    in a margin, so that no bound needs to be checked.
    """

    def __init__(self, keys: list[tuple[bytes, int]]):
        tree: dict = {}
        for key, value in keys:
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 16
        self.base, self.check, self.value = [1] * size, [-1] * size, [-1] * size
        taken = bytearray(size)
        taken[0] = 1
        low, wide = 257, 257
        queue = [(0, tree)]
        while queue:
            state, node = queue.pop()
            self.value[state] = node.pop(-1, -1)
            codes = sorted(node)
            if not codes:
                continue
            while taken[low]:
                low += 1
            at = low
            if len(codes) > 2:
                at = max(at, wide)
            while any(taken[at - codes[0] + c] for c in codes):
                at += 1
                if at + 512 > len(taken):
                    taken += bytearray(len(taken))
            if len(codes) > 2:
                wide = max(257, at - 512)
            base = at - codes[0]
            while base + 512 > len(self.base):
                more = len(self.base)
                self.base += [1] * more
                self.check += [-1] * more
                self.value += [-1] * more
                taken += bytearray(max(0, len(self.base) + 512 - len(taken)))
            self.base[state] = base
            for c in codes:
                taken[base + c] = 1
                self.check[base + c] = state
                queue.append((base + c, node[c]))


class PieceModel:
    """A .model file: pieces, scores, kinds, and the trie of the pieces that text can match."""

    def __init__(self, content: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.prefix, self.strip = True, True
        for number, value in _fields(content):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 3:
                        self.prefix = bool(v)
                    elif n == 4:
                        self.strip = bool(v)
        if len(self.pieces) > MAX_PIECES:
            raise ValueError(f"a model of {len(self.pieces)} pieces; at most {MAX_PIECES} are broadcast")
        text = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER) and self.pieces[i]]
        self.trie = DoubleArray([(self.pieces[i].encode(), i) for i in text])
        #: A walk in the trie ends after this many bytes at the latest.
        self.longest = 1 + max((len(self.pieces[i].encode()) for i in text), default=0)
        used = [self.scores[i] for i in text if self.scores[i] > UNUSED_SCORE]
        self.unknown = min(used, default=0.0) - UNKNOWN_PENALTY
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unk = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        inner = any(MARK in self.pieces[i].lstrip(MARK) for i in text)
        joined = {c for i in text if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        alone = "".join(c for c in map(chr, range(1, 128)) if c not in joined)
        cut = f"[{re.escape(alone)}]|" if alone else ""
        self.units = re.compile("(?s).+" if inner else f"{cut}{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+")
        self.back = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]

    def segment(self, unit: str) -> list[int]:
        """Piece ids of the best segmentation of a string of markers and characters."""
        data = unit.encode()
        n = len(data)
        if n < LONG_UNIT:
            best, come, via = [0.0] + [-1e300] * n, [0] * (n + 1), [-1] * (n + 1)
        else:
            best, come, via = array("d", [-1e300]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
            best[0] = 0.0
        longest = self.longest
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        at = 0
        while at < n:
            here = best[at]
            lead = data[at]
            width = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
            one = at + width
            state, to, covered = 0, at, False
            for code in data[at : at + longest]:
                last, state = state, base[state] + code
                if check[state] != last:
                    break
                to += 1
                piece = value[state]
                if piece >= 0:
                    score = here + scores[piece]
                    if score > best[to]:
                        best[to], come[to], via[to] = score, at, piece
                    if to == one:
                        covered = True
            if not covered and here + self.unknown > best[one]:
                best[one], come[one], via[one] = here + self.unknown, at, -1
            at = one
        out: list[int] = []
        while at:
            if via[at] >= 0:
                out.append(via[at])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(data[come[at] : at]))
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
            at = come[at]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.back.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


class Encoder(Memo):
    """unit -> its piece ids as little-endian int32 bytes, in a memo of bounded size."""

    def __init__(self, model: PieceModel):
        super().__init__(MEMO)
        self.model, self.find = model, model.units.findall

    def compute(self, unit: str) -> bytes:
        return array("i", self.model.segment(unit)).tobytes()

    def encode(self, text: str) -> bytes:
        if self.model.strip:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.find((MARK if self.model.prefix else "") + text.replace(" ", MARK))))


_ENCODERS: dict[int, Encoder] = {}


def _encoder_of(spark, model_path: str):
    prepare(spark)
    with open(model_path, "rb") as f:
        content = f.read()
    model = spark.sparkContext.broadcast(PieceModel(content))
    key = hash((model_path, hashlib.sha256(content).digest()))

    def get() -> Encoder:
        encoder = _ENCODERS.get(key)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[key] = Encoder(model.value)
        return encoder

    return get


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", check: bool = False) -> DataFrame:
    """id and pieces (array of piece ids) of every row; with check also whether they decode to the text."""
    get = _encoder_of(docs.sparkSession, model_path)
    kind = docs.schema[id_column].dataType.simpleString()

    def make():
        encoder = get()
        decode = encoder.model.decode

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = [encoder.encode(t) for t in texts]
            ends = np.cumsum([0, *(len(o) // 4 for o in out)], dtype=np.int32)
            columns = {id_column: b.column(0), "pieces": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out), "<i4")))}
            if check:
                columns["round_trip"] = pa.array([decode(array("i", o).tolist()) == t for o, t in zip(out, texts)], pa.bool_())
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return run

    return map_batches(docs.select(F.col(id_column), F.col(text_column).cast("string")), make, f"{id_column} {kind}, pieces array<int>" + ", round_trip boolean" * check)


def decode(rows: DataFrame, model_path: str, id_column: str = "doc_id", pieces_column: str = "pieces") -> DataFrame:
    """id and text of every row of piece ids; null pieces give an empty text."""
    get = _encoder_of(rows.sparkSession, model_path)
    kind = rows.schema[id_column].dataType.simpleString()

    def make():
        model = get().model

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(p or []) for p in b.column(1).to_pylist()], pa.string())], names=[id_column, "text"])

        return run

    return map_batches(rows.select(id_column, pieces_column), make, f"{id_column} {kind}, text string")


def encode_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, pieces_sha256 (ids as int32, little-endian), round_trip.

    round_trip says that decoding the pieces gives the text back.
    """
    get = _encoder_of(docs.sparkSession, model_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        encoder = get()
        model = encoder.model
        is_byte = np.array([k == BYTE for k in model.kinds])

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            cols: tuple[list, ...] = ([], [], [], [])
            for t in b.column(1).to_pylist():
                out = encoder.encode(t or "")
                ids = np.frombuffer(out, "<i4")
                for c, v in zip(cols, (len(ids), int(is_byte[ids].sum()), hashlib.sha256(out).hexdigest(), model.decode(ids.tolist()) == (t or ""))):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_pieces", "n_byte_pieces", "pieces_sha256", "round_trip"])

        return run

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), make, f"doc_id {kind}, n_pieces long, n_byte_pieces long, pieces_sha256 string, round_trip boolean")

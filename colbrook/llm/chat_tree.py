"""Chat formatting into prefix trees.

Conversations that share initial turns are merged: a shared turn is emitted once, depth-first,
and every symbol gets a position id (its distance from the conversation's beginning) and an
attention interval list (the spans of its ancestors and its own), so that each conversation can
be read as if it stood alone. Symbols are code points of the template's output.

Conversations are range-partitioned and sorted by the path of all their turn hashes, which puts
those that share turns next to each other: depth-first order is sort order. A task walks its
sorted rows with one stack. A pack is one training sequence and holds all that it refers to, so
that what two packs share is in both: a task closes a pack at MAX_SYMBOLS symbols or MAX_LEAVES
conversations, and a turn is emitted once a pack. Conversations that share a turn and take S
symbols in all, P of the tasks and n leaves emit it at most P + S / MAX_SYMBOLS + n / MAX_LEAVES
times, with no task taking all that share a first turn.

Template: "<|im_start|>role\\ntext<|im_end|>\\n" (a line feed or backslash inside a role is written as
\\n or \\\\). Inside role and text every "<|" becomes "<||",
and every longer run "<|..|" gets one bar more: no control string can occur inside, and taking a
bar away from each run gives the text back.

Defined cases: a null role or text counts as empty; a null turn sorts first; rows of a
conversation with equal turn sort by role, then text; a null conv_id is a conversation of its
own; repeated rows repeat as turns; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

START, END = "<|im_start|>", "<|im_end|>"
#: Symbols and conversations after which a pack is closed.
MAX_SYMBOLS, MAX_LEAVES = 1 << 20, 1 << 16
_RUN = regex.compile(r"<(\|+)")


def escape(text: str) -> str:
    return _RUN.sub(r"<\1|", text)


def unescape(text: str) -> str:
    return _RUN.sub(lambda m: m[0][:-1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's output, and where the text begins and ends in it."""
    name = escape(role).replace("\\", "\\\\").replace("\n", "\\n")
    head = f"{START}{name}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


class Pack:
    """A forest: symbols emitted once, nodes (begin, end, parent, position, loss span), leaves."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[tuple[int, int, int, int, int, int]] = []
        self.leaves: list[tuple[object, int]] = []
        self.stack: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        keep = 0
        while keep < min(len(self.stack), len(turns)) and self.stack[keep][0] == turns[keep]:
            keep += 1
        del self.stack[keep:]
        for turn in turns[keep:]:
            out, a, b = render(*turn)
            parent = self.stack[-1][1] if self.stack else -1
            position = self.nodes[parent][3] + self.nodes[parent][1] - self.nodes[parent][0] if parent >= 0 else 0
            loss = (self.size + a, self.size + b) if turn[0] == "assistant" else (0, 0)
            self.nodes.append((self.size, self.size + len(out), parent, position, *loss))
            self.parts.append(out)
            self.size += len(out)
            self.stack.append((turn, len(self.nodes) - 1))
        self.leaves.append((conv_id, self.stack[-1][1] if self.stack else -1))

    def row(self) -> dict:
        """The pack's text; a row per node; attention: the node's ancestors' spans and its own."""
        spans: list[list[list[int]]] = []
        for begin, end, parent, *_ in self.nodes:
            above = [list(s) for s in spans[parent]] if parent >= 0 else []
            if above and above[-1][1] == begin:
                above[-1][1] = end
            else:
                above.append([begin, end])
            spans.append(above)
        return {
            "text": "".join(self.parts),
            "nodes": [dict(zip(("start", "stop", "parent", "position", "loss_start", "loss_stop"), n)) | {"attention": [x for s in a for x in s]} for n, a in zip(self.nodes, spans)],
            "leaves": [{"conv_id": c, "node": n} for c, n in self.leaves],
        }


def build_packs(conversations: DataFrame, max_symbols: int = MAX_SYMBOLS, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """One row a pack: text, nodes and leaves. Input: conv_id, turn, role, text rows."""
    prepare(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    clean = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.withColumn("path", path).repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    node = "start int, stop int, parent int, position int, loss_start int, loss_stop int, attention array<int>"
    schema = f"text string, nodes array<struct<{node.replace(' ', ':').replace(',:', ',')}>>, leaves array<struct<conv_id:{kind},node:int>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = Pack()
        for f in frames:
            for conv_id, turns in zip(f["conv_id"], f["turns"]):
                pack.add(None if pd.isna(conv_id) else conv_id, [(t["role"], t["text"]) for t in turns])
                if pack.size >= max_symbols or len(pack.leaves) >= max_leaves:
                    yield pd.DataFrame([pack.row()])
                    pack = Pack()
        if pack.leaves:
            yield pd.DataFrame([pack.row()])

    return dealt.select("conv_id", "turns").mapInPandas(run, schema)


def with_positions(packs: DataFrame) -> DataFrame:
    """Adds `positions`, the position id of every symbol of the text, and `owner`, its node's number.

    A symbol attends to its node's intervals up to itself.
    """
    each = lambda f: F.flatten(F.transform("nodes", f))
    return packs.withColumn("positions", each(lambda n: F.sequence(n["position"], n["position"] + n["stop"] - n["start"] - 1))).withColumn("owner", each(lambda n, i: F.array_repeat(i, n["stop"] - n["start"])))


_ROLE = regex.compile(r"\\(.)")
_TURN = regex.compile(rf"{regex.escape(START)}(.*?)\n(.*?){regex.escape(END)}\n", regex.S)


def read_back(packs: DataFrame) -> DataFrame:
    """conv_id, formatted, turns and loss text of every conversation, from the packs alone.

    Follows the attention intervals of the leaf: its spans joined are the conversation.
    """
    kind = next(f.dataType.elementType["conv_id"].dataType.simpleString() for f in packs.schema if f.name == "leaves")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text, nodes, leaves in zip(f["text"], f["nodes"], f["leaves"]):
                for leaf in leaves:
                    at, spans, loss = leaf["node"], [], []
                    if at >= 0:
                        a = nodes[at]["attention"]
                        spans = [text[i:j] for i, j in zip(a[::2], a[1::2])]
                    while at >= 0:
                        n = nodes[at]
                        loss.append(text[n["loss_start"] : n["loss_stop"]])
                        at = n["parent"]
                    whole = "".join(spans)
                    turns = [(unescape(_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], r)), unescape(t)) for r, t in _TURN.findall(whole)]
                    said = "".join(unescape(x) for x in reversed(loss))
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    out.append((leaf["conv_id"], len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), len(whole)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return packs.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

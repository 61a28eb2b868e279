"""URL filter: a trie over reversed host labels, then path segments, with longest-match precedence.

A rule is (action, "host/path"). It fits its host and all subdomains when the url's path starts
with the rule's path. Of the fitting rules the one with the most host labels wins, then the one
with the longest path; the last of two equal rules counts. Without a fitting rule the default
action holds.

Defined cases: a null url or one without "://" has empty host and path and gets the default
action; urls of any length take time in proportion to it; repeated rows are judged each; other
columns are ignored; an empty table gives an empty result. The rules are checked
to be at most MAX_RULE_BYTES long together before they are broadcast; longer lists are cut into
blocks of that size, each its own pass, and the best match over the blocks wins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Bytes of rule text in one broadcast trie.
MAX_RULE_BYTES = 32 << 20


class UrlTrie:
    """Nodes are dicts; under None a host node holds its path trie, under False a path node its tails.

    A rule's path "/a/b" is the full segment "a" with the open tail "b": every url path that
    goes on with "/a/b..." fits. A path that ends in "/" has the empty tail.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.root: dict = {}
        for action, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            if not slash:
                node[True] = (action, rule)
                continue
            *full, tail = path.split("/")
            for segment in full:
                node = node.setdefault(segment, {})
            node.setdefault(False, {})[tail] = (action, rule)

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path characters, action, rule) of the longest rule that fits."""
        best, node, depth = None, self.root, 0
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            depth += 1
            if None in node:
                best = self._path(node[None], path, depth) or best
        return best

    @staticmethod
    def _path(node: dict, path: str, depth: int) -> tuple[int, int, str, str] | None:
        best = (depth, 0, *node[True]) if True in node else None
        if not path.startswith("/"):
            return best
        at = 1
        while True:
            for tail in sorted(node.get(False, ()), key=len):
                if path.startswith(tail, at):
                    best = (depth, at + len(tail), *node[False][tail])
            cut = path.find("/", at)
            node = node.get(path[at:cut]) if cut >= 0 else None
            if node is None:
                return best
            at = cut + 1


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty for null or without "://"."""
    if url is None or (start := url.find("://")) < 0:
        return "", ""
    rest = url[start + 3 :]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    if not host.isascii():
        return "".join(c.lower() if c.isascii() else c for c in host), path
    return host.lower(), path


def _blocks(rules: list[tuple[str, str]], limit: int) -> list[list[tuple[str, str]]]:
    out: list[list[tuple[str, str]]] = [[]]
    size = 0
    for rule in rules:
        n = len(rule[0]) + len(rule[1].encode())
        if out[-1] and size + n > limit:
            out.append([])
            size = 0
        out[-1].append(rule)
        size += n
    return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_column: str = "page_id", limit: int = MAX_RULE_BYTES) -> DataFrame:
    """id, host, path, rule, verdict of every row, by the broadcast trie."""
    spark = pages.sparkSession
    prepare(spark)
    kind = pages.schema[id_column].dataType.simpleString()
    out = pages.select(F.col(id_column).alias("id"), F.col("url"), F.lit(0).alias("labels"), F.lit(0).alias("chars"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    for block in _blocks(rules, limit):
        trie = spark.sparkContext.broadcast(UrlTrie(block))

        def judge(frames, trie=trie):
            t = trie.value
            for f in frames:
                labels, chars, rule, verdict = (f[c].tolist() for c in ("labels", "chars", "rule", "verdict"))
                for i, url in enumerate(f["url"].tolist()):
                    m = t.match(*split_url(url))
                    if m and (rule[i] is None or m[:2] >= (labels[i], chars[i])):
                        labels[i], chars[i], verdict[i], rule[i] = m
                yield pd.DataFrame({"id": f["id"], "url": f["url"], "labels": labels, "chars": chars, "rule": pd.Series(rule, dtype=object, index=f.index), "verdict": verdict})

        out = out.mapInPandas(judge, f"id {kind}, url string, labels int, chars int, rule string, verdict string")

    def parts(frames):
        for f in frames:
            both = [split_url(u) for u in f["url"].tolist()]
            yield pd.DataFrame({id_column: f["id"], "host": [b[0] for b in both], "path": [b[1] for b in both], "rule": f["rule"], "verdict": f["verdict"]})

    return out.mapInPandas(parts, f"{id_column} {kind}, host string, path string, rule string, verdict string")

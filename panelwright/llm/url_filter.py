"""Allow and block lists for URLs: a trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Rules of one broadcast trie (about 200 bytes a rule); more rules make more tries, each of which judges every url.
TRIE_RULES = 500_000

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or a text without ``://``."""
    m = _URL.search(url) if url is not None else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(_LOWER), slash + path


class Trie:
    """Host labels from the right, then path segments; each end of a rule holds its verdict.

    A node of the host part is ``[children, path node]``, one of the path part
    ``[children, ends]`` with ``ends`` a list of (start of the next segment, rule, verdict, size).
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: list = [{}, None]
        for rule, verdict in rules:
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, []]
            at = node[1]
            *whole, rest = path[1:].split("/") if path else [None]
            for segment in whole:
                at = at[0].setdefault(segment, [{}, []])
            # Longest first; of the same rule in both lists, block.
            at[1].append((rest, rule, verdict, (len(host) + len(path), len(host), verdict == "block")))

    def match(self, host: str, path: str) -> tuple[tuple, str | None, str | None]:
        """Size, rule and verdict of the longest rule that fits."""
        best, found = (-1, -1, False), (None, None)
        segments = path[1:].split("/") if path else []
        node = self.root
        for label in [None, *reversed(host.split("."))]:
            if label is not None:
                node = node[0].get(label)
                if node is None:
                    break
            at, i = node[1], 0
            while at is not None:
                for rest, rule, verdict, size in at[1]:
                    fits = rest is None or i < len(segments) and segments[i].startswith(rest)
                    if fits and size > best:
                        best, found = size, (rule, verdict)
                at = at[0].get(segments[i]) if i < len(segments) - 1 else None
                i += 1
        return best, *found


def url_filter(
    df: DataFrame,
    allow: list[str],
    block: list[str],
    url: str = "url",
    default: str = "allow",
    trie_rules: int = TRIE_RULES,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row; no shuffle.

    A rule ``host/path`` fits its host and all subdomains, for paths that start with its own;
    one without a slash fits every path. The longest rule wins (host and path characters, then
    host characters); the same rule in both lists blocks. Without a rule the verdict is ``default``.

    Null urls and urls without ``://``: empty host and path, no rule (but one with an empty host).
    Repeated rows are judged one by one; an empty table gives an empty one. Columns of the table
    that are named like a new one are replaced.
    """
    rules = [(r, "allow") for r in allow] + [(r, "block") for r in block]
    tries = [rules[i : i + trie_rules] for i in range(0, len(rules), trie_rules)] or [[]]
    judged = free_name(df.columns, "judged")
    best = F.greatest(*[_judge(df, x)(F.col(url)) for x in tries]) if len(tries) > 1 else _judge(df, tries[0])(F.col(url))
    new = ("host", "path", "rule", "verdict")
    keep = [F.col(c) for c in df.columns if c.lower() not in new]
    found = [F.col(f"{judged}.{c}").alias(c) for c in new[:3]]
    return df.withColumn(judged, best).select(*keep, *found, F.coalesce(f"{judged}.verdict", F.lit(default)).alias("verdict"))


def _judge(df: DataFrame, rules: list[tuple[str, str]]):
    """A function of a url: the size of the longest of ``rules`` that fits, which orders the results of several tries, then
    host, path, rule and verdict."""
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("size array<int>, host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        rows = []
        for u in urls:
            host, path = split_url(u)
            size, rule, verdict = match(host, path)
            rows.append(([int(x) for x in size], host, path, rule, verdict))
        return pd.DataFrame(rows, columns=["size", "host", "path", "rule", "verdict"])

    return judge

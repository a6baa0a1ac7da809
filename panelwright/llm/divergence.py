"""How far the sources of a language differ in their words, and by which words, in exact whole numbers.

Terms are counted in tasks; of each language, those in enough documents are kept and dealt into blocks. A tile is a block of terms by two
blocks of groups as a dense matrix of int64; all pairs of its groups are compared by broadcasting, and what comes out is a partial sum
for each pair and the best terms of each group. Spark adds up the sums and merges the best terms. A tile's size is bounded, whatever
the number of terms and groups; the number of rows is that of pairs, which is what the audit asks for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, slices

#: Terms of a tile, groups of a tile's side, terms (and bytes of text) that a task counts before it hands them on.
TERMS, GROUPS, COUNTED, COUNTED_BYTES = 1024, 64, 300_000, 128_000_000
#: Probabilities are whole numbers of this part.
SCALE = 1_000_000_000

#: A-Z lower-cased, all that is no letter and not above ASCII a space: words are then what is between spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    r"""The matches of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` in UTF-8, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = size = 0

    def out():
        for (lang, source), (n, docs) in counts.items():
            names = [b"", *n]
            yield pa.RecordBatch.from_pydict({
                "lang": [lang] * len(names), "source": [source] * len(names), "term": [t.decode("utf-8", "replace") for t in names],
                "n": [0, *n.values()], "docs": [0, *[docs[t] for t in n]],
            })
        counts.clear()

    for batch in slices(batches):
        for lang, source, text in zip(*[batch.column(c).to_pylist() for c in range(3)]):
            words = terms(text.encode())
            pair = counts.get((lang, source))
            if pair is None:
                pair = counts[lang, source] = Counter(), Counter()
            held -= len(pair[0])
            pair[0].update(words)
            pair[1].update(set(words))
            held += len(pair[0])
            size += len(text)
        if held > COUNTED or size > COUNTED_BYTES:
            yield from out()
            held = size = 0
    yield from out()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents with the term; a row with the term '' for every group. Nulls read as ''."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c2) for c, c2 in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * n / total)`` in int64, by long division in steps of a thousand: exact for totals up to 9 * 10^15."""
    q, r = n // total, n % total
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // total, r % total
    return 1 + q


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tile(top: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = pdf[pdf.term.isna()].sort_values("gi")
        rows = pdf[pdf.term.notna()]
        lang, row, column = pdf.lang.iat[0], int(pdf["row"].iat[0]), int(pdf["column"].iat[0])
        names, gi = heads.source.to_numpy(), heads.gi.to_numpy(np.int64)
        size, kept, there = heads.n.to_numpy(np.int64), int(heads.kept.iat[0]), int(heads.in_block.iat[0])
        out = {"source": [], "item": [], "value": [], "part": []}
        codes, found = pd.factorize(rows.term, sort=True)
        # A column for each term that a group of the tile has, and one for a term that none has.
        n = np.zeros((len(gi), len(found) + 1), np.int64)
        n[np.searchsorted(gi, rows.gi.to_numpy(np.int64)), codes] = rows.n.to_numpy(np.int64)
        times = np.ones(len(found) + 1, np.int64)
        times[-1] = there - len(found)
        p = probability(n + 2, size[:, None] + 2 * kept) if kept else np.ones_like(n)
        a, b = np.flatnonzero(gi // GROUPS == row), np.flatnonzero(gi // GROUPS == column)
        for i in a:
            others = b[b > i] if row == column else b
            value = gap(p[i][None, :], p[others]) @ times
            for one, two in ((np.full(len(others), i), others), (others, np.full(len(others), i))):
                out["source"] += [*names[one]]
                out["item"] += [*names[two]]
                out["value"] += [*value]
                out["part"] += ["pair"] * len(others)
        if row == column and len(found):
            total = np.zeros(len(found), np.int64)
            total[codes] = rows.total.to_numpy(np.int64)
            q = probability(total + 2, np.int64(int(heads.whole.iat[0]) + 2 * kept))
            for i in a:
                at = np.flatnonzero((n[i, :-1] > 0) & (p[i, :-1] > q))
                value = gap(p[i, at], q[at])
                best = np.lexsort((at, -value))[:top]  # terms are sorted, by code point
                out["source"] += [names[i]] * len(best)
                out["item"] += [*found[at[best]]]
                out["value"] += [*value[best]]
                out["part"] += ["term"] * len(best)
        out["lang"] = [lang] * len(out["item"])
        return pd.DataFrame({c: np.array(out[c], np.int64 if c == "value" else object) for c in ("lang", "source", "part", "item", "value")})

    return of


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: for each (lang, source) group every other source of its language (``pair``), and its
    ``top`` most over-used terms (``term``), the largest value first, ties by item.

    Each language keeps the terms in at least ``least_docs`` of its documents. With N occurrences of V kept terms a group's or language's
    p of a term is 1 + floor(10^9 (n + 2) / (N + 2V)); a value is floor((p - q)^2 / (p + q)), summed over all kept terms for pairs. Null
    text, language and source read as ''; groups without terms count; a language of one source has no pairs; an empty table gives none.
    Other columns don't matter, whatever their names.
    """
    counts = materialize(term_counts(docs, lang, source, text), "term-counts")
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = materialize(kept.drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("whole"))
    used = materialize(counts.filter("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept-counts")
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    order = W.partitionBy("lang").orderBy("source")  # a row a source of the language, of which the result has all pairs
    groups = counts.filter("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = groups.select("lang", "source", zero("size"), zero("kept"), zero("whole"), (F.row_number().over(order) - 1).cast("long").alias("gi"))
    groups = groups.withColumn("sides", F.floor((F.count("*").over(W.partitionBy("lang")) + GROUPS - 1) / GROUPS).cast("int"))
    groups = materialize(groups.withColumn("blocks", F.greatest(F.ceil(F.col("kept") / TERMS), F.lit(1)).cast("int")), "groups")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    in_block = kept.join(groups.filter("gi = 0").select("lang", "blocks"), "lang").groupBy("lang", block).agg(F.count("*").alias("in_block"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(in_block, ["lang", "block"], "left")
    # A group goes to the tiles of its block of groups with every other; a tile has the lower one first.
    mine = F.floor(F.col("gi") / GROUPS).cast("int")
    tiled = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).withColumns({"row": F.least(mine, "other"), "column": F.greatest(mine, "other")}).drop("other")
    columns = ["lang", "source", "gi", "block", "row", "column", "term", "n", "total", "kept", "whole", "in_block"]
    none = F.lit(None).cast("long")
    heads = tiled(heads).select(*[F.lit(None).cast("string").alias(c) if c == "term" else F.col("size").alias("n") if c == "n" else none.alias(c) if c == "total" else zero(c) if c == "in_block" else c for c in columns])
    cells = tiled(used.join(groups.select("lang", "source", "gi", "sides", "blocks"), ["lang", "source"]).select("lang", "gi", "sides", block, "term", "n", "total"))
    cells = cells.select(*[F.lit(None).cast("string").alias(c) if c == "source" else none.alias(c) if c in ("kept", "whole", "in_block") else c for c in columns])
    tiles = heads.unionByName(cells).groupBy("lang", "block", "row", "column").applyInPandas(_tile(top), "lang string, source string, part string, item string, value long")
    tiles = materialize(tiles, "tiles")
    pairs = tiles.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = tiles.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")

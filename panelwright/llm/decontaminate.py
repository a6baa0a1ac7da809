"""Benchmark decontamination by winnowed fingerprints with exact extension."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, materialize, word_hashes

#: Words of [0-9a-z] and everything beyond ASCII, after A-Z became a-z; all else ends a word.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Benchmark text that one broadcast holds; a larger benchmark is taken in blocks of this size.
BLOCK_BYTES = 32 << 20


def item_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash (the last of equals) of every ``window`` neighbours."""
    if len(h) == 0:
        return np.zeros(0, np.int64)
    w = min(window, len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(np.arange(len(views)) + (w - 1 - np.argmin(views[:, ::-1], axis=1)))


class Fingerprints:
    """The winnowed k-grams of a block of benchmark items, and the windows that hits are extended to.

    A window of ``length`` words holds ``length - k + 1`` k-grams, which is the winnowing window: text that
    shares it has the same smallest k-gram there, so no shared window is missed. Items with fewer words
    are one window of their own length and are looked up as a whole.
    """

    def __init__(self, items: list[tuple[str, str | None]], length: int, k: int):
        self.length, self.k, self.window = length, min(k, length), length - min(k, length) + 1
        self.ids: list[str] = []
        prints = [np.zeros(0, np.uint64)]
        rows: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            h = word_hashes(item_words(text))
            if not len(h):
                continue
            i = len(self.ids)
            self.ids.append(item_id)
            size = min(len(h), length)
            rows.setdefault(size, []).append((np.unique(gram_hashes(h, size)), i))
            if size == length:
                g = gram_hashes(h, self.k)
                prints.append(g[winnow(g, self.window)])
        self.prints = np.unique(np.concatenate(prints))
        #: For each size of windows: their hashes, ascending, and the items of each.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, some in rows.items():
            hashes = np.concatenate([x for x, _ in some])
            owner = np.repeat([i for _, i in some], [len(x) for x, _ in some])
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], owner[order]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words of a document are hit, and by which items. Linear in its words (but for sorting), whatever repeats."""
        n, found = len(h), set()
        edge = np.zeros(n + 1, np.int64)
        for size in self.windows:
            if n < size:
                continue
            if size < self.length:
                starts = np.arange(n - size + 1)
            else:
                g = gram_hashes(h, self.k)
                at = winnow(g, self.window)
                at = at[self._holds(self.prints, g[at])]
                # Every shared window holds a common print: those are the windows to compare.
                starts = np.unique(at[:, None] - np.arange(self.window))
                starts = starts[(starts >= 0) & (starts <= n - size)]
            if not len(starts):
                continue
            keys, owner = self.windows[size]
            grams = gram_hashes(h, size)[starts]
            same = self._holds(keys, grams)
            np.add.at(edge, starts[same], 1)
            np.add.at(edge, starts[same] + size, -1)
            hashes = np.unique(grams[same])
            for lo, hi in zip(np.searchsorted(keys, hashes, "left").tolist(), np.searchsorted(keys, hashes, "right").tolist()):
                found.update(owner[lo:hi].tolist())
        return np.cumsum(edge[:-1]) > 0, found

    @staticmethod
    def _holds(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(values), bool)
        return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _runs(hit: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()


def _digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    length: int = 10,
    k: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    spans`` (array of word positions: start, end, start, end, ...).

    A benchmark of up to ``block_bytes`` of text is broadcast; a larger one is taken in blocks,
    each against all documents, and the rows of a document are put together afterwards.

    Null and empty texts have no words and no hits, null and empty items no window. Repeated
    items count once for each distinct id; repeated documents each get their row (in blocks, they
    are told apart by the row, not by the id). Empty tables give no hits, or no rows.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if total <= block_bytes:
        return _pass(source, [(r.i, r.t) for r in items.collect()], length, k).drop("ids")
    blocks = -(-int(total) // block_bytes)
    dealt = materialize(items.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks))), "benchmark-blocks")
    keyed = materialize(source.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    parts = None
    for b in range(blocks):
        rows = [(r.i, r.t) for r in dealt.filter(F.col("b") == b).select("i", "t").collect()]
        got = materialize(_pass(keyed, rows, length, k, "row").select("row", "doc_id", "n_words", "spans", "ids"), "decontaminate-block")
        parts = got if parts is None else parts.unionByName(got)
    schema = _schema(source) + ", spans array<int>"

    def together(pdf):
        import pandas as pd

        hit = np.zeros(int(pdf.n_words.iloc[0]), bool)
        ids: set[str] = set()
        for spans, more in zip(pdf.spans, pdf.ids):
            for a, b in zip(spans[::2], spans[1::2]):
                hit[a:b] = True
            ids.update(more)
        n = int(hit.sum())
        return pd.DataFrame([(pdf.doc_id.iloc[0], len(hit), n, len(ids), _digest(ids), n > 0, _runs(hit))], columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return parts.groupBy("row").applyInPandas(together, schema)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    length: int = 10,
    k: int = 5,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows without a hit, with their columns as they are; no join, no shuffle.

    A benchmark beyond ``block_bytes`` is taken in blocks; what passes one is written and meets the next.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    blocks = max(1, -(-int(items.agg(F.sum(F.length("t"))).first()[0] or 0) // block_bytes))
    items = items.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    for b in range(blocks):
        prints = docs.sparkSession.sparkContext.broadcast(Fingerprints([(r.i, r.t) for r in items.filter(F.col("b") == b).collect()], length, k))
        docs = docs.filter(~_hit(prints)(F.col(text)))
        if b < blocks - 1:
            docs = materialize(docs, "decontaminated")
    return docs


def _hit(prints):
    @F.pandas_udf("boolean")
    def hit(texts):
        import pandas as pd

        return pd.Series([bool(prints.value.hits(word_hashes(item_words(t)))[1]) for t in texts], dtype="bool")

    return hit


def _schema(source: DataFrame) -> str:
    kind = source.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _pass(source: DataFrame, items: list[tuple[str, str]], length: int, k: int, row: str | None = None) -> DataFrame:
    """All documents against one block of items; no shuffle."""
    prints = source.sparkSession.sparkContext.broadcast(Fingerprints(items, length, k))
    schema = _schema(source) + ", spans array<int>, ids array<string>" + (f", {row} long" if row else "")

    def judge(batches):
        fp = prints.value
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for t in batch.column("text").to_pylist():
                h = word_hashes(item_words(t))
                hit, found = fp.hits(h)
                ids = {fp.ids[i] for i in found}
                n = int(hit.sum())
                for column, v in zip(out, (len(h), n, len(ids), _digest(ids), n > 0, _runs(hit) if n else [], sorted(ids))):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()))
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "ids"]
            arrays = [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, kinds)]]
            if row:
                names, arrays = [*names, row], [*arrays, batch.column(row)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(judge, schema)

"""Packing documents into training windows, in order, by dynamic programming.

Cuts may fall at document ends, sentence ends and, at a higher price, inside long sentences.
With ``P`` the positions of the possible cuts, the best cost of the first ``P[j]`` tokens is

    best[j] = penalty[j] + min over i with P[j] - P[i] <= window of best[i] + padding(P[j] - P[i]) + per_window

Padding is ``window`` less the length, so the term in i is ``best[i] + P[i]`` and the minimum over the
sliding range comes from a monotone queue; a window that is a power of two long needs no padding, and
is looked up besides where a document ends.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import open_tokenizer

#: Bytes of ids of the documents whose cuts are looked for together.
CUT_BYTES = 1 << 20
#: Tokens of the windows that are planned together; the last, open one goes on to the next plan.
PLAN_WINDOWS = 64


@dataclass(frozen=True)
class Costs:
    """In tokens of padding: a cut at a sentence end, one inside a sentence, and a window as such."""

    sentence: float = 4.0
    inside: float = 48.0
    per_window: float = 16.0
    #: Inside a sentence, a cut is possible every so many tokens.
    step: int = 128


def cut_windows(positions: np.ndarray, penalties: np.ndarray, window: int, costs: Costs) -> list[int]:
    """Ends of the windows; ``positions`` ascend from above 0 with gaps of at most ``window``."""
    p, pen = [0, *positions.tolist()], [0.0, *penalties.tolist()]
    best, back = [0.0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    index = {x: i for i, x in enumerate(p)}
    powers = [1 << b for b in range(8, window.bit_length()) if 1 << b < window]
    reach = [0.0] * len(p)  # best[i] + p[i]
    for j in range(1, len(p)):
        at, price = p[j], pen[j]
        while p[queue[0]] < at - window:
            queue.popleft()
        i = queue[0]
        least = reach[i] + window - at
        if not price:
            for w in powers:
                k = index.get(at - w)
                if k is not None and best[k] < least:
                    least, i = best[k], k
        best[j] = now = least + price + costs.per_window
        back[j], reach[j] = i, now + at
        mine = now + at
        while queue and reach[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    ends, j = [], len(p) - 1
    while j:
        ends.append(p[j])
        j = back[j]
    return ends[::-1]


def document_cuts(ids: np.ndarray, kinds: tuple[np.ndarray, np.ndarray], costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts of a document (positions after a token, its end id included) and their prices.

    A sentence ends after a token of the first kind that no digit follows.
    """
    return documents_cuts([ids], kinds, costs)[0]


def documents_cuts(documents: list[np.ndarray], kinds: tuple[np.ndarray, np.ndarray], costs: Costs) -> list[tuple[np.ndarray, np.ndarray]]:
    """:func:`document_cuts` of several documents at once."""
    stop, digit = kinds
    ids, ends = np.concatenate(documents), np.cumsum([len(x) for x in documents])
    ends_sentence = np.zeros(len(ids) + 1, bool)
    ends_sentence[1:-1] = stop[ids[:-1]] & ~digit[ids[1:]]
    ends_sentence[ends - 1] = False  # before the end id
    ends_sentence[ends] = True
    at = np.flatnonzero(ends_sentence[1:]) + 1
    price = np.full(len(at), costs.sentence)
    price[np.searchsorted(at, ends)] = 0.0
    gaps = np.diff(at, prepend=0)
    long = np.flatnonzero(gaps > costs.step)
    if len(long):
        count = (gaps[long] - 1) // costs.step
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        more = np.repeat(at[long] - gaps[long], count) + nth * costs.step
        at = np.concatenate((at, more))
        price = np.concatenate((price, np.full(len(more), costs.inside)))
        order = np.argsort(at, kind="stable")
        at, price = at[order], price[order]
    to = np.searchsorted(at, ends, "right").tolist()
    return [(at[i:j] - start, price[i:j]) for i, j, start in zip([0, *to], to, [0, *ends.tolist()])]


class Packer:
    """Windows of a stream of documents; ``add`` and ``close`` give the finished pieces."""

    def __init__(self, first_id: int, window: int, costs: Costs):
        self.next_id, self.window, self.costs = first_id, window, costs
        self.docs: list[tuple] = []  # doc_id, ids, first token, possible cuts, prices
        self.tokens = 0

    def add(self, doc_id, ids: bytes, cuts: np.ndarray, prices: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, 0, cuts, prices))
        self.tokens += len(ids) // 4
        return self._plan(False) if self.tokens >= PLAN_WINDOWS * self.window else []

    def close(self) -> list[tuple]:
        return self._plan(True) if self.docs else []

    def _plan(self, last: bool) -> list[tuple]:
        at, positions, prices = 0, [], []
        for _, ids, first, cuts, price in self.docs:
            positions.append(at + cuts - first)
            prices.append(price)
            at += len(ids) // 4 - first
        ends = cut_windows(np.concatenate(positions), np.concatenate(prices), self.window, self.costs)
        if not last:
            ends = ends[:-1]
        pieces, k, start = [], 0, 0
        docs, self.docs = self.docs, []
        queue = deque(docs)
        for end in ends:
            offset = 0
            while start < end:
                doc_id, ids, first, cuts, price = queue.popleft()
                left = len(ids) // 4 - first
                take = min(left, end - start)
                pieces.append((doc_id, first, ids[4 * first : 4 * (first + take)], len(ids) // 4, self.next_id, offset))
                offset += take
                start += take
                if take < left:
                    rest = cuts > first + take
                    queue.appendleft((doc_id, ids, first + take, cuts[rest], price[rest]))
            self.next_id += 1
        self.docs = list(queue)
        self.tokens = sum(len(ids) // 4 - first for _, ids, first, _, _ in self.docs)
        return pieces


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    style: str = "words",
    window: int = 4096,
    costs: Costs = Costs(),
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``with_ids``, ``ids``. Each partition's rows are packed in their order; nothing is shuffled, and a
    task holds the tokens of ``PLAN_WINDOWS`` windows and of one document.

    Null and empty texts are documents of the end id only. Repeated rows are packed once each. An
    empty table gives no pieces. Other columns are left out.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches):
        from pyspark import TaskContext

        tok = open_tokenizer(tokenizer, style)
        sorts = tok.token_kinds()
        packer = Packer(TaskContext.get().partitionId() << 33, window, costs)
        end = np.array([end_id], "<u4").tobytes()
        kinds = [None, *[pa.int64()] * 6]

        def rows(pieces, id_type):
            if not pieces:
                return
            columns = [[p[0] for p in pieces], [p[1] for p in pieces], [len(p[2]) // 4 for p in pieces], [zlib.crc32(p[2]) for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces], [p[5] for p in pieces]]
            arrays = [pa.array(c, t or id_type) for c, t in zip(columns, kinds)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p[2], "<u4").astype(np.int32) for p in pieces], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

        def packed(held, id_type):
            for (i, ids), (cuts, prices) in zip(held, documents_cuts([np.frombuffer(ids, "<u4") for _, ids in held], sorts, costs)):
                yield from rows(packer.add(i, ids, cuts, prices), id_type)

        id_type = None
        for batch in slices(batches):
            id_type = batch.column("doc_id").type
            ids_of = batch.column("doc_id").to_pylist()
            held, size = [], 0
            for i, ids in zip(ids_of, tok.encode(batch.column("text").cast(pa.binary()).to_pylist())):
                held.append((i, ids + end))
                size += len(ids)
                if size >= CUT_BYTES:
                    yield from packed(held, id_type)
                    held, size = [], 0
            if held:
                yield from packed(held, id_type)
        yield from rows(packer.close(), id_type)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)

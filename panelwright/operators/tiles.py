"""All pairs of rows, in tiles of two blocks: what is quadratic by definition, dealt to as many tasks as there are tiles.

The rows themselves are few, so Spark would broadcast one side, all its copies included, and leave every pair to the few tasks that
read the other, or would put the small shuffle back into a few partitions. Tiles are therefore joined by a shuffle into a number of
partitions of their own. A tile is bounded whatever the number of rows.

Numbers of two ends are worked out on arrays, a tile a task (:func:`laid`, :func:`worked`). A table of all pairs is as large as its writer makes it, so a tile's
pairs come in the order of their value: equal values are then side by side, and a task's ids are few, which Parquet stores in well under half the bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.sources.work import written

#: Rows of a block, and the most tasks that tiles are dealt to.
BLOCK, TASKS = 2048, 4096
#: About how many equal rows stand together.
COPIES = 64
#: Rows of a block of arrays at most (a pair's place in a tile takes ``PLACE`` bits) and at least, rows of it worked out at once, and pairs handed on at once.
SIDE, PLACE, LEAST, SLAB, BATCH = 4096, 24, 256, 16, 1 << 17


def met(a: DataFrame, b: DataFrame, keys: Sequence[str], tiles: int) -> DataFrame:
    """Inner join on the keys of tiles, each dealt to one of ``tiles`` tasks: neither broadcast nor put together."""
    parts = max(min(tiles, TASKS), 1)
    return a.repartition(parts, *keys).join(b.repartition(parts, *keys).hint("merge"), list(keys))


def pairs(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``by, src, dst`` and ``a_*, b_*``: every two rows ``src < dst`` (by ``id``) of a group, with the columns of both."""
    rows = written(rows.select(*by, "id", *columns), "ends")  # their number is needed first
    sizes = rows.groupBy(*by).count().agg(F.max("count").alias("most"), F.count("*").alias("groups")).first()
    blocks = max(-(-(sizes.most or 1) // block), 1)
    own, every = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = rows.select(*by, F.col("id").alias("src"), *[F.col(c).alias(f"a_{c}") for c in columns], own.alias("row"), every.alias("column"))
    b = rows.select(*by, F.col("id").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in columns], every.alias("row"), own.alias("column"))
    return met(a, b, [*by, "row", "column"], blocks * blocks * max(sizes.groups, 1)).filter("src < dst").drop("row", "column")


def shared(rows: DataFrame, columns: Sequence[str], values: dict[str, Column], more: Sequence[str] = (), block: int = BLOCK, copies: int = COPIES) -> DataFrame:
    """``src, dst``, the ``values`` and ``a_*, b_*`` of ``more``: every two rows ``src < dst`` (by ``id``).

    ``values`` come from ``a_*, b_*`` of ``columns`` and are the same with both ends exchanged. Rows equal in ``columns`` stand together, about ``copies``
    of them, so values are worked out once for two such groups, whose members are then paired. Groups are bounded whatever the data.
    """
    place, ends = F.xxhash64(*columns), F.struct("id", *more)
    placed = rows.select("id", *columns, *more).withColumn("place", place)
    dealt = placed.join(placed.groupBy("place").agg(F.count("*").alias("n")), "place").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / copies)))
    groups = dealt.groupBy(*columns, "part").agg(F.collect_list(ends).alias("members")).withColumn("group", F.monotonically_increasing_id())
    groups = written(groups.select("group", *columns, "members"), "ends")  # their number is needed first
    size = groups.agg(F.sum(F.size("members")).alias("n")).first().n or 0
    blocks = max(-(-size // block), 1)
    own = F.pmod(F.xxhash64("group"), F.lit(blocks)).cast("int")
    side = lambda e: groups.select(*[F.col(c).alias(f"{e}_{c}") for c in ("group", *columns, "members")], own.alias("own"))
    a = side("a").select("*", F.col("own").alias("row"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("column")).drop("own")
    b = side("b").select("*", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("row"), F.col("own").alias("column")).drop("own")
    both = met(a, b, ["row", "column"], blocks * (blocks + 1) // 2).filter("row < column or a_group <= b_group")
    both = both.select((F.col("a_group") == F.col("b_group")).alias("same"), "a_members", "b_members", *[v.alias(k) for k, v in values.items()])
    both = both.select("same", "b_members", *values, F.explode("a_members").alias("a")).select("same", *values, "a", F.explode("b_members").alias("b"))
    forward = F.col("a.id") < F.col("b.id")
    both = both.filter(forward | ((F.col("a.id") > F.col("b.id")) & ~F.col("same")))
    one = lambda x, y, c: F.when(forward, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    carried = [one(*e, c).alias(f"{n}_{c}") for c in more for n, e in (("a", "ab"), ("b", "ba"))]
    return both.select(one("a", "b", "id").alias("src"), one("b", "a", "id").alias("dst"), *values, *carried)


#: Values of a column and where there are any (nothing: everywhere), as a row or a column of a tile.
End = list[tuple[np.ndarray, np.ndarray | None]]
#: Group, both ends, and the values of their pairs with where there are any.
Value = Callable[[int, End, End], tuple[np.ndarray, np.ndarray | None]]


def rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """:func:`panelwright.functions.text.rounded` on arrays."""
    with np.errstate(over="ignore"):
        out = np.floor(v * 10.0**digits + 0.5) / 10.0**digits
    other = ~((v >= 0) & (v < 1e9))
    if other.any():
        step = Decimal(1).scaleb(-digits)
        out[other] = [float(Decimal(repr(x)).quantize(step, ROUND_HALF_UP)) if abs(x) < 1e15 else x for x in v[other].tolist()]
    return out


def laid(rows: DataFrame, columns: Sequence[str], by: str = "year", side: int = SIDE, order: Sequence[str] = ()) -> DataFrame:
    """Tiles of every two blocks of a group's rows (``by, id`` and numbers), two rows a tile, one where a block meets itself; a tile is a partition.

    Blocks are ranges of ids, so the ends of a tile's pairs are those of two blocks, or ranges of ``order``, so equal rows stand together and pairs of equal
    distance repeat the same ids. The driver gets a number for each block.
    """
    rows = written(rows.select(F.col(by).cast("long").alias(by), F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in columns]).filter(F.col(by).isNotNull() & F.col("id").isNotNull()), "ends")
    sizes = rows.groupBy(by).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    side = min(side, max(-(-(sizes.most or 1) // 6), LEAST))
    parts = max((sizes["all"] or 0) // (side * 8), 1)
    names = [by, "block", "ids", *columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [b for b in batches if b.num_rows]  # about eight blocks
        if not rest:
            return
        table, n = pa.Table.from_batches(rest).combine_chunks(), TaskContext.get().partitionId() << 32
        for group, size in zip(*(x.tolist() for x in np.unique(table[by].to_numpy(), return_counts=True))):
            at, table = table.slice(0, size), table.slice(size)
            for cut in np.array_split(np.arange(size), -(-size // side)):
                held = [at[c].slice(cut[0], len(cut)).combine_chunks() for c in ("id", *columns)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(cut)], pa.int32()), pa.concat_arrays([h] if isinstance(h, pa.Array) else h.chunks)) for h in held]
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([n], pa.int64()), *lists], names)
                n += 1

    dealt = rows.repartitionByRange(parts, by, *order, "id") if parts > 1 else rows.coalesce(1)
    schema = f"{by} long, block long, ids array<long>, " + ", ".join(f"{c} array<double>" for c in columns)
    blocks = written(dealt.sortWithinPartitions(by, *order, "id").mapInArrow(pack, schema), "ends")
    of: dict[int, list[int]] = {}
    for group, block in sorted(tuple(r) for r in blocks.select(by, "block").collect()):
        of.setdefault(group, []).append(block)
    places, tiles = [], 0
    for held in of.values():
        places += [(block, i, len(held), tiles) for i, block in enumerate(held)]
        tiles += len(held) * (len(held) + 1) // 2
    numbered = blocks.join(F.broadcast(rows.sparkSession.createDataFrame(places, "block long, own long, blocks long, first long")), "block")  # a row a block
    number = F.expr("first + row * blocks - row * (row - 1) div 2 + column - row").alias("tile")
    zero, last = F.lit(0).cast("long"), F.col("blocks") - 1
    own = F.col("own")
    a = numbered.select("*", own.alias("row"), F.explode(F.sequence(own, last)).alias("column")).select(number, F.lit(0).alias("end"), by, "ids", *columns)
    b = numbered.filter(own > 0).select("*", F.explode(F.sequence(zero, own - 1)).alias("row"), own.alias("column")).select(number, F.lit(1).alias("end"), by, "ids", *columns)
    parts = max(min(tiles, TASKS), 1)
    return a.unionByName(b).repartitionById(parts, (F.col("tile") % parts).cast("int")).sortWithinPartitions("tile", "end")


class _Block:
    """A block of a tile: its group, ids, and the columns with where there are values."""

    def __init__(self, row: dict[str, pa.Array], at: int, by: str, columns: Sequence[str]):
        self.group, self.ids = row[by][at].as_py(), row["ids"][at].values.to_numpy()
        held = [row[c][at].values for c in columns]
        self.columns = [(h.to_numpy(zero_copy_only=False), h.is_valid().to_numpy(zero_copy_only=False) if h.null_count else None) for h in held]

    def end(self, rows: slice, axis: int) -> End:
        """The rows as a tile's rows (0) or columns (1)."""
        turn = lambda v: None if v is None else v[rows, None] if axis == 0 else v[None, rows]
        return [(turn(v), turn(there)) for v, there in self.columns]


def _tiles(batches: Iterator[pa.RecordBatch], by: str, columns: Sequence[str]) -> Iterator[tuple[_Block, _Block]]:
    """Both blocks of each tile."""
    a = None
    for batch in batches:
        row = {c: batch.column(c) for c in (by, "ids", *columns)}
        for i, end in enumerate(batch.column("end").to_pylist()):
            block = _Block(row, i, by, columns)
            if end:
                yield a, block
                a = None
            else:
                if a is not None:
                    yield a, a
                a = block
    if a is not None:
        yield a, a


def _slabs(a: _Block, b: _Block, value: Value, digits: int | None) -> Iterator[tuple[slice, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Some rows of a tile after the other: the values, where there are any, and which pairs count (nothing: all): each two ids once, equal ones not."""
    twice = a is b or len(np.intersect1d(a.ids, b.ids))
    for i in range(0, len(a.ids), SLAB):
        at = slice(i, i + SLAB)
        with np.errstate(all="ignore"):
            v, there = value(a.group, a.end(at, 0), b.end(slice(None), 1))
        ends = None if not twice else a.ids[at, None] < b.ids[None] if a is b else a.ids[at, None] != b.ids[None]
        yield at, v if digits is None else rounded(v, digits), there, ends


def worked(tiles: DataFrame, columns: Sequence[str], value: Value, name: str, digits: int | None = None, most: dict[int, float] | None = None, by: str = "year") -> DataFrame:
    """``by, src, dst`` and the value: every two rows ``src < dst`` of a group, or those whose value is no more than ``most`` of their group.

    A task holds a tile, 16 bytes a pair. The pairs come in the order of their value (near enough to put equal ones together).
    """
    names, mask = [by, "src", "dst", name], np.uint64((1 << PLACE) - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _tiles(batches, by, columns):
            shape, width = (len(a.ids), len(b.ids)), len(b.ids)
            values, keys, known, kept = np.empty(shape), np.empty(shape, np.uint64), None, None
            mixed = a.ids.max() > b.ids.min() and a is not b
            for at, v, there, ends in _slabs(a, b, value, digits):
                values[at] = v
                with np.errstate(all="ignore"):
                    keys[at] = v.astype(np.float32).view(np.uint32)
                key, first = keys[at], at.start * width
                key <<= np.uint64(1)
                if mixed:  # first the pairs whose smaller id is in the one block, then the others
                    key |= a.ids[at, None] > b.ids[None]
                key <<= np.uint64(PLACE)
                key |= np.arange(first, first + v.size, dtype=np.uint64).reshape(v.shape)
                if there is not None:
                    known = np.ones(shape, bool) if known is None else known
                    known[at] = there
                if most is not None:
                    near = v <= most.get(a.group, -np.inf)
                    near = near if there is None else near & there
                    ends = near if ends is None else ends & near
                if ends is not None:
                    kept = np.ones(shape, bool) if kept is None else kept
                    kept[at] = ends
            keys = keys.ravel() if kept is None else keys[kept]
            keys.sort()
            values, known = values.ravel(), known if known is None else known.ravel()
            for i in range(0, len(keys), BATCH):
                place = (keys[i : i + BATCH] & mask).astype(np.uint32)
                row = place // np.uint32(width)
                src, dst = a.ids[row], b.ids[place - row * np.uint32(width)]
                src, dst = (np.minimum(src, dst), np.maximum(src, dst)) if mixed else (src, dst)
                held = pa.array(values[place], mask=None if known is None else ~known[place])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), a.group, np.int64)), pa.array(src), pa.array(dst), held], names)

    return tiles.mapInArrow(work, f"{by} long, src long, dst long, {name} double")


def largest(tiles: DataFrame, columns: Sequence[str], values: dict[str, tuple[Value, int | None]], by: str = "year") -> dict[str, dict[int, float]]:
    """For each value, given with its digits, the largest of each group: a row a group comes to the driver. Groups without any are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[tuple[int, str], float] = {}
        for a, b in _tiles(batches, by, columns):
            for name, (value, digits) in values.items():
                for _, v, there, ends in _slabs(a, b, value, digits):
                    counts = ends if there is None else there if ends is None else there & ends
                    v = v if counts is None else v[np.broadcast_to(counts, v.shape)]
                    if v.size:
                        tops[a.group, name] = max(tops.get((a.group, name), -np.inf), float(v.max()))
        yield pa.RecordBatch.from_pylist([{by: g, "name": n, "top": t} for (g, n), t in tops.items()], pa.schema([(by, pa.int64()), ("name", pa.string()), ("top", pa.float64())]))

    found = tiles.mapInArrow(work, f"{by} long, name string, top double").groupBy(by, "name").agg(F.max("top").alias("top")).collect()
    return {name: {r[by]: r.top for r in found if r.name == name} for name in values}

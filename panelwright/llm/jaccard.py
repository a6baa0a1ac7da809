"""Exact near-duplicate join on word n-grams.

Every document becomes the set of its n-grams (64-bit hashes). Equal sets are one class.

1. Blocking: two sets of sizes a and b that are similar enough differ in at most
   ``(100 - t) * (a + b) / (100 + t)`` elements. Elements are dealt into more parts than that by their
   hash, so similar sets agree on some whole parts. From a set's own size and its empty parts follows how
   many that are not empty it shares with any similar one; a class that shares fewer with
   all others together drops out. Classes that agree on a part in one size band get an edge to the
   smallest class there (as many edges as rows, however large the group). A class and all that have
   an edge to it are a star; both ends of every link stand in one of them.
2. Tiles: a star or cluster of bounded size is one tile. Of a larger one, the classes are cut by size
   band and hash into blocks; a tile is a pair of blocks whose bands can hold similar sets.
3. Tiles of bitmaps, from the stars: hashed bitmaps bound the overlap from above by bit counts. The
   components of the pairs that pass are clusters; most classes fall out here, and no set was moved yet.
4. Tiles of sets, from these clusters: pairs that pass the bitmaps are decided by intersecting the
   sorted arrays. For components, pairs that a tile has linked already are skipped, so it gives fewer links than rows.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, gram_hashes, materialize, mix, scratch, slices, word_hashes
from .components import components

#: Parts beyond the number that similar sets of one band can differ in.
SPARE = 3
#: Ways to deal the elements into parts; a set uses the next one while too many parts are empty in this one.
DEALS = 4
#: A size band ends where the sizes are this many times its start.
BAND = 1.6
#: Classes that a task remembers to pass over copies, keys that it holds at a time, and rows of one key that it then puts together.
SEEN, HELD, HOT = 200_000, 1 << 20, 32
#: Blocks: least and most classes, and most bytes of hashes.
BLOCK_LEAST, BLOCK_MOST, BLOCK_BYTES = 1024, 8192, 8 << 20


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(k, len(words))))


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Bands:
    """Size bands and the number of parts of each, for a threshold in per cent."""

    def __init__(self, percent: int):
        self.t, self.starts = percent, [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND)))
        self._starts = np.array(self.starts)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self._starts, n, "right")) - 1

    def differ(self, both: int) -> int:
        """How many elements similar sets of together ``both`` elements can differ in."""
        return both * (100 - self.t) // (100 + self.t)

    def parts(self, band: int) -> int:
        return self.differ(2 * (self.starts[band + 1] - 1)) + SPARE

    def reach(self, n: int) -> range:
        """The bands of sets of n or more elements that can be similar to one of n."""
        return range(self.of(n), self.of(n * 100 // self.t) + 1)

    def shared(self, n: int, band: int) -> int:
        """On how many parts a set of n agrees at least with any similar one that it meets in the band."""
        return self.parts(band) - self.differ(n + min(self.starts[band + 1] - 1, n * 100 // self.t))


def _deals(s: np.ndarray, bands: Bands):
    """For each band in which a partner at least as large can be, the ways of dealing that the set uses: code, hashes,
    the part of each, how many each part holds, and how many keys any similar set shares (below 1: not known)."""
    if not len(s):
        return
    m = mix(s)
    for band in bands.reach(len(s)):
        if not bands.differ(len(s) + min(bands.starts[band + 1] - 1, len(s) * 100 // bands.t)):
            continue  # only equal sets are similar
        n = bands.parts(band)
        for deal in range(DEALS):
            x = m if not deal else mix(m + np.uint64(deal))
            part = ((x >> np.uint64(11)) % np.uint64(n)).astype(np.int64)
            held = np.bincount(part, minlength=n)
            need = bands.shared(len(s), band) - int((held == 0).sum())
            yield band * DEALS + deal, x, part, held, need
            if need > 0:
                break


def needs(s: np.ndarray, bands: Bands) -> list[int]:
    """Codes of the ways of dealing, each with the number of keys that any similar set shares at least (0: not known)."""
    return [v for code, _, _, _, need in _deals(s, bands) for v in (code, max(0, need))]


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the parts that hold elements.

    A key's last 8 bits are the code, so that keys can be counted by it. Where empty parts leave no key that is
    shared for sure, the next way of dealing is used too; after the last one, empty parts are keys as well. Two similar
    sets meet in the first way that is enough for either of them.
    """
    out = [np.zeros(0, np.uint64)]
    for code, x, part, held, need in _deals(s, bands):
        n = len(held)
        hi, lo = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
        a, b = np.bincount(part, hi, n).astype(np.uint64), np.bincount(part, lo, n).astype(np.uint64)
        key = mix(mix(mix(np.arange(n, dtype=np.uint64) + np.uint64(code * 2654435761 + 12345)) ^ a) + b + held.astype(np.uint64))
        key = key & np.uint64(0xFFFFFFFFFFFFFF00) | np.uint64(code)
        out.append(key if need < 1 and code % DEALS == DEALS - 1 else key[held > 0])
    return np.concatenate(out)


def _sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, t, n, c, bits, needs``: of every row the hash of its text, and size, class, bitmap and needs of its set."""

    def run(batches):
        bands = Bands(percent)
        for batch in slices(batches):
            sets = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()), pa.array([needs(s, bands) for s in sets], pa.list_(pa.int32())),
                ],
                ["doc_id", "t", "n", "c", "bits", "needs"],
            )

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    return hashed.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, n long, c long, bits binary, needs array<int>")


def _keys(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``key, c, a``: the parts of every row's set; of copies that a task meets, those of the first (it remembers a bounded number).

    Rows are held and sorted in parts of bounded size. Of a key that many classes of a part share, the smallest goes on
    alone; the others name it in ``a`` and have a key of their own, so no key brings more than a few rows of a part together.
    """
    most, few = HELD, HOT

    def put_together(keys, classes):
        order = np.lexsort((classes, keys))
        keys, classes = keys[order], classes[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        count = np.diff(np.append(first, len(keys)))
        heads = np.repeat(classes[first], count)
        hot = np.repeat(count >= few, count)
        hot[first] = False
        shared, c = keys[hot].view(np.uint64), classes[hot].view(np.uint64)
        keys[hot] = (mix(shared ^ mix(c)) & np.uint64(0xFFFFFFFFFFFFFF00) | shared & np.uint64(0xFF)).view(np.int64)
        for i in range(0, len(keys), 20_000):
            at = slice(i, i + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(classes[at]), pa.array(heads[at], mask=~hot[at])], ["key", "c", "a"])

    def run(batches):
        bands, seen, keys, classes, held = Bands(percent), set(), [], [], 0
        for batch in slices(batches):
            for t in batch.column("text").to_pylist():
                s = shingle_set(t, k)
                c = class_of(s)
                if c in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(c)
                got = signatures(s, bands).view(np.int64)
                if len(got):
                    keys.append(got)
                    classes.append(np.full(len(got), c, np.int64))
                    held += len(got)
            if held >= most:
                yield from put_together(np.concatenate(keys), np.concatenate(classes))
                keys, classes, held = [], [], 0
        if held:
            yield from put_together(np.concatenate(keys), np.concatenate(classes))

    return docs.select("text").mapInArrow(run, "key long, c long, a long")


def _stars(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, root``: stars in which both ends of every link stand together; only classes that share enough keys have a place."""
    group = W.partitionBy("key")
    met = keys.withColumn("least", F.min("c").over(group)).withColumn("most", F.max("c").over(group)).filter("least <> most or a is not null")
    met = materialize(met.select("c", F.col("key").bitwiseAND(0xFF).cast("int").alias("code"), F.coalesce("a", "least").alias("a"), F.col("a").isNotNull().alias("hot")), "shared-keys")
    pairs = F.transform(F.sequence(F.lit(0), F.size("needs") - 1, F.lit(2)), lambda i: F.struct(F.get("needs", i).alias("code"), F.get("needs", i + 1).alias("need")))
    needs = sets.filter("c is not null and size(needs) > 0").select("c", F.explode(pairs).alias("x")).select("c", "x.*").distinct()
    shared = met.groupBy("c", "code").agg(F.count("*").alias("m"))
    enough = materialize(shared.join(needs.hint("merge"), ["c", "code"]).filter("m >= need").select("c", "code"), "places")
    edges = materialize(met.join(enough, ["c", "code"], "left_semi").filter("a <> c").select("a", "c", "hot").distinct(), "edges")
    # What a task has put together under its smallest class belongs to that class's groups elsewhere too.
    hot = edges.filter("hot").select("a", "c")
    up = met.filter("not hot and a <> c").select(F.col("a").alias("g"), F.col("c").alias("a")).join(hot.select("a").distinct(), "a", "left_semi").distinct()
    further = hot.join(up, "a").select("g", "c")
    members = edges.select("a", "c").unionByName(further.withColumnRenamed("g", "a").filter("a <> c")).distinct()
    return materialize(members.select(F.col("c").alias("node"), F.col("a").alias("root")).unionByName(members.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), "stars")


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bitmap of a set, two to four bits an element: a bit is on if an odd number of elements fall on it.

    An element that only one of two sets has changes one bit, so the bits that differ never outnumber those
    elements. :func:`fold` makes a bitmap narrower.
    """
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length())
    on = np.bincount(((s >> np.uint64(7)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(on.astype(np.uint8)).tobytes()


def fold(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of one matrix, each folded to the width of the narrowest."""
    width = min(map(len, maps)) // 8
    out = np.empty((len(maps), width), np.uint64)
    for row, m in zip(out, maps):
        np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, width), axis=0, out=row)
    return out


def tile_links(maps: list[bytes], sizes: np.ndarray, n: int | None, percent: int, similar=None, every: bool = False) -> list[tuple[int, int]]:
    """Links that span what the pairs of a tile connect, as positions; with ``every``, all links.

    The first ``n`` are paired with the others (null: all with all); each side is sorted by size. Pairs
    whose bitmaps allow it are linked if ``similar(i, j)``, without that function at once.
    """
    maps, label, links = fold(maps), np.arange(len(maps)), []
    for i in range(len(maps) if n is None else n):
        lo = i + 1 if n is None else n + int(np.searchsorted(sizes[n:], -(-int(sizes[i]) * percent // 100)))
        hi = lo + int(np.searchsorted(sizes[lo:], int(sizes[i]) * 100 // percent, "right"))
        for at in range(lo, hi, 1024):
            to = min(at + 1024, hi)
            differ = np.bitwise_count(maps[at:to] ^ maps[i]).sum(axis=1, dtype=np.int64)
            may = differ * (100 + percent) <= (sizes[at:to] + sizes[i]) * (100 - percent)
            if not every:
                may &= label[at:to] != label[i]
            for j in (np.flatnonzero(may) + at).tolist():
                if (every or label[i] != label[j]) and (similar is None or similar(i, j)):
                    if not every:
                        label[label == label[j]] = label[i]
                    links.append((i, j))
    return links


def _seats(clusters: DataFrame, reps: DataFrame, bands: Bands, per_element: int) -> DataFrame:
    """``c, doc_id, tile, side``: the tiles of every class in its clusters ``node, root``; an element takes so many bytes there."""
    percent = bands.t
    starts = F.array(*[F.lit(x) for x in bands.starts if x < 1 << 31])
    members = materialize(
        clusters.select(F.col("node").alias("c"), F.col("root").alias("g")).join(reps, "c")
        .withColumn("band", F.size(F.filter(starts, lambda s: s <= F.col("n"))) - 1),
        "members",
    )
    count = materialize(members.groupBy("g", "band").agg(F.count("*").alias("m"), F.max("n").alias("top")), "sizes")
    # A cluster that a task holds at ease is one tile.
    total = count.groupBy("g").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("top")).alias("elements"))
    small = materialize(total.filter((F.col("m") <= BLOCK_LEAST) & (F.col("elements") * per_element <= BLOCK_BYTES)).select("g"), "small-clusters").hint("merge")
    whole = members.join(small, "g", "left_semi").select("c", "doc_id", F.xxhash64("g").alias("tile"), F.lit(2).alias("side"))
    members, count = materialize(members.join(small, "g", "left_anti"), "large-members"), count.join(small, "g", "left_anti")
    # Blocks of a band: bounded in classes and in bytes.
    size = F.least(F.greatest(F.lit(BLOCK_LEAST), F.least(F.ceil(F.col("m") / 8), F.lit(BLOCK_MOST))), F.greatest(F.lit(16), F.floor(F.lit(BLOCK_BYTES) / (per_element * F.col("top")))))
    blocks = materialize(count.select("g", "band", F.ceil(F.col("m") / size).cast("int").alias("nb")), "blocks")
    # The tiles of a block: with the blocks of its own band, and of the next ones that similar sets reach.
    far = bands.of(int(bands.starts[30] * 100 / percent)) - 30 + 2
    steps = F.sequence(F.lit(0), F.lit(far))
    mine = blocks.select("g", "band", F.col("nb").alias("nb0"), F.explode(steps).alias("step")).withColumn("band1", F.col("band") + F.col("step"))
    theirs = blocks.select("g", F.col("band").alias("band1"), F.col("nb").alias("nb1"))
    pairs = mine.join(theirs, ["g", "band1"])
    within = F.element_at(starts, F.col("band") + 2) - 1  # the largest size of the lower band
    pairs = pairs.filter((F.col("step") == 0) | (F.element_at(starts, F.col("band1") + 1) * percent <= within * 100))
    pairs = materialize(pairs, "tiles")
    low = pairs.select("g", "band", "band1", "nb0", "nb1", F.lit(0).alias("side"))
    high = pairs.filter("step > 0").select("g", F.col("band1").alias("band"), F.col("band").alias("band0"), "nb0", "nb1")
    m = members.select("c", "doc_id", "g", "band", F.xxhash64("c").alias("h"))
    own = low.filter("band = band1")
    # Within a band, block i meets every block j >= i: block h stands on either side.
    same = m.join(own, ["g", "band"]).withColumn("h", F.pmod("h", "nb0").cast("int")).select(
        "c", "doc_id",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("nb0") - 1), lambda j: F.struct(
            F.xxhash64("g", "band", "band", F.least("h", j), F.greatest("h", j)).alias("tile"),
            F.when(j == F.col("h"), 2).when(F.col("h") < j, 0).otherwise(1).alias("side")))).alias("x"))
    lower = m.join(low.filter("band <> band1"), ["g", "band"]).withColumn("h", F.pmod("h", "nb0").cast("int")).select(
        "c", "doc_id",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("nb1") - 1), lambda j: F.struct(
            F.xxhash64("g", "band", "band1", "h", j).alias("tile"), F.lit(0).alias("side")))).alias("x"))
    upper = m.join(high, ["g", "band"]).withColumn("h", F.pmod("h", "nb1").cast("int")).select(
        "c", "doc_id",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("nb0") - 1), lambda j: F.struct(
            F.xxhash64("g", "band0", "band", j, "h").alias("tile"), F.lit(1).alias("side")))).alias("x"))
    seats = materialize(same.unionByName(lower).unionByName(upper).select("c", "doc_id", "x.tile", "x.side"), "seats")
    # Tiles with one row hold no pair, and those with one side only neither.
    useful = seats.groupBy("tile").agg(F.count("*").alias("rows"), F.min("side").alias("s0"), F.max("side").alias("s1")).filter("rows > 1 and (s0 <> s1 or s0 = 2)").select("tile")
    return materialize(whole.unionByName(seats.join(useful, "tile").select(whole.columns)), "seats")


def _same_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """The join on class and id; the class tells rows of one id with other texts apart, ids may be null."""
    r = right.withColumnRenamed("doc_id", "_id").withColumnRenamed("c", "_c")
    return left.join(r, left.doc_id.eqNullSafe(r._id) & (left.c == r._c)).drop("_id", "_c")


def _tile_rows(pdf):
    """The classes of a tile by side and size, and how many stand left (null: no sides)."""
    pdf = pdf.drop_duplicates("c").sort_values(["side", "n"])
    return pdf, None if (pdf.side == 2).any() else int((pdf.side == 0).sum())


def _candidates(sets: DataFrame, stars: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """``a, b``: edges that connect all classes whose bitmaps allow a link; tiles carry bitmaps, not sets.

    Most tiles hold a few classes, so a task reads its tiles one after the other, a tile at a time.
    """
    columns = ["tile", "side", "n", "c", "bits"]

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(x).to_pylist() for x in columns)))
        got = []
        for _, tile in groupby(rows, itemgetter(0)):
            _, side, n, c, maps = zip(*{row[3]: row for row in tile}.values())
            links = tile_links(maps, np.array(n), None if 2 in side else side.count(0), percent)
            got += [(c[i], c[j]) for i, j in links]
            if len(got) >= 20_000:
                yield _edge_batch(got)
                got = []
        yield _edge_batch(got)

    seats = _seats(stars, reps, Bands(percent), 1)
    rows = _same_row(seats, sets.select("doc_id", "c", "n", "bits")).select(columns)
    return rows.repartition("tile").sortWithinPartitions("tile", "side", "n").mapInArrow(run, "a long, b long")


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _links(docs: DataFrame, clusters: DataFrame, reps: DataFrame, k: int, percent: int, every: bool) -> DataFrame:
    """``a, b``: linked classes, from the tiles of every cluster; unless ``every``, some that connect all linked ones."""

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc_id", "c", "n", "s"],
            )

    def decide(pdf):
        import pandas as pd

        pdf, n = _tile_rows(pdf)
        c, sets = pdf.c.tolist(), [np.frombuffer(b, np.uint64) for b in pdf.s]

        def similar(i, j):
            merged = np.concatenate((sets[i], sets[j]))
            merged.sort(kind="stable")
            shared = int((merged[1:] == merged[:-1]).sum())
            return 100 * shared >= percent * (len(merged) - shared)

        got = tile_links([bitmap(s) for s in sets], pdf.n.to_numpy(), n, percent, similar, every)
        return pd.DataFrame([(c[i], c[j]) for i, j in got], columns=["a", "b"], dtype="int64")

    seats = _seats(clusters, reps, Bands(percent), 8)
    wanted = seats.select(F.col("doc_id").alias("_id")).distinct().hint("merge")
    texts = docs.join(wanted, docs.doc_id.eqNullSafe(wanted._id), "left_semi").dropDuplicates(["doc_id", "text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, c long, n long, s binary")
    return _same_row(seats, sets).select("tile", "side", "c", "n", "s").groupBy("tile").applyInPandas(decide, "a long, b long")


def _classes(docs: DataFrame, k: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the sets of all rows (see :func:`_sets`), a row for each class ``c, n, doc_id`` (its smallest id), and links ``a, b``."""
    with scratch(docs.sparkSession) as keep:
        sets = keep(_sets(docs, k, percent), "shingle-sets")
        stars = _stars(_keys(docs, k, percent), sets)
        reps = keep(sets.filter("c is not null").groupBy("c", "n").agg(F.min("doc_id").alias("doc_id")), "classes")
        clusters = components(_candidates(sets, stars, reps, percent))
        links = _links(docs, clusters, reps, k, percent, every).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return sets, reps, keep(links, "links")


def jaccard_classes(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", count_links: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, class_id, component_id`` and, with ``count_links``, ``n_links``.

    Documents link when 100 * intersection >= percent * union of their sets of ``shingle``-word
    shingles (A-Z lower-cased, words between ASCII white space); ``component_id`` is the smallest
    doc_id that links reach. ``class_id`` is equal for equal sets only. ``n_links`` is the number of other
    documents linked with this one, copies included; it needs every pair of a component to be decided. Nothing is approximate but
    for 64-bit hashes of shingles and sets.

    Fewer words than ``shingle``: the whole sequence is the one shingle. Null, empty and blank
    texts have no shingles, no class and link with nothing (their component is their own id).
    Repeated rows are copies; a null id never becomes a component, though it may link others. An empty table gives no
    rows; columns other than these two are not read.
    """
    return _named(docs, shingle, percent, doc_id, text, count_links).drop("t", "keep_t", "keep_id")


def _named(docs: DataFrame, shingle: int, percent: int, doc_id: str, text: str, count_links: bool) -> DataFrame:
    """:func:`jaccard_classes` with the hash of the text ``t``, and id and hash of the component's row that stands for it."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with scratch(docs.sparkSession) as keep:
        sets, reps, links = _classes(docs, shingle, percent, count_links)
        linked = components(links)
        roots = reps.select("c").join(linked.select(F.col("node").alias("c"), "root"), "c", "left").select("c", F.coalesce("root", "c").alias("root"))
        rows = sets.filter("c is not null").join(roots.hint("merge"), "c")
        # Ids that are null come last among those that can stand for a component.
        best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("first")
        by_class = materialize(rows.groupBy("root", "c").agg(best, F.count("*").alias("docs")), "class-rows")
        by_root = by_class.groupBy("root").agg(F.min("first").alias("first"))
        named = by_class.select("root", "c", "docs").join(by_root, "root").select("c", "docs", F.col("first.doc_id").alias("keep_id"), F.col("first.t").alias("keep_t"))
        more = []
        if count_links:
            ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            size = by_class.select(F.col("c").alias("b"), "docs")
            found = ends.join(size, "b").groupBy(F.col("a").alias("c")).agg(F.sum("docs").alias("others"))
            named = named.join(found, "c", "left").withColumn("n_links", F.col("docs") - 1 + F.coalesce("others", F.lit(0)))
            more = ["n_links"]
        out = sets.join(named.select("c", "keep_id", "keep_t", *more), "c", "left")
        links_of = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
        own = F.col("c").isNull()
        out = out.select(
            "doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("class_id"), F.coalesce("keep_id", "doc_id").alias("component_id"), *links_of, "t",
            F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(own, F.col("t")).otherwise(F.col("keep_t")).alias("keep_t"),
        )
        return keep(out, "near-duplicate-classes")


def jaccard_links(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link between different sets as ``a, b`` (classes, ``a < b``), and membership ``doc_id, class_id, n_shingles``.

    Nulls, copies and odd texts as in :func:`jaccard_classes`; documents of one class are linked with each other without a row.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with scratch(docs.sparkSession) as keep:
        sets, _, links = _classes(docs, shingle, percent, True)
        return keep(links, "links"), keep(sets.select("doc_id", F.col("c").alias("class_id"), F.col("n").alias("n_shingles")), "members")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with its columns as they are: that of the smallest id and, of rows with that id, the smallest hash of the text.

    Rows are told apart by id and text: rows of one id with unrelated texts are different documents and all stay. Rows
    with a null id take part and stand for a component only if all its ids are null. Texts without words link with
    nothing and stay. Of rows that agree in id and text one stays.
    """
    with scratch(docs.sparkSession) as keep:
        found = keep(_named(docs, shingle, percent, doc_id, text, False).select("doc_id", "t", "keep_id", "keep_t"), "near-duplicates")
    i, t = free_name(docs.columns, "stays_id"), free_name(docs.columns, "stays_text")
    stay = found.filter("doc_id <=> keep_id and t = keep_t").groupBy(F.col("doc_id").alias(i), F.col("t").alias(t)).agg(F.count("*").alias("rows"))

    def matching(rows: DataFrame, side: DataFrame) -> DataFrame:
        return rows.join(side.select(i, t), rows[doc_id].eqNullSafe(side[i]) & (F.xxhash64(rows[text]) == side[t]), "left_semi")

    repeated = stay.filter("rows > 1")
    if repeated.isEmpty():
        return matching(docs, stay)
    return matching(docs, stay.filter("rows = 1")).unionByName(matching(docs, repeated).dropDuplicates([doc_id, text]))

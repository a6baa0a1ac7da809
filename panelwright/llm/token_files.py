"""Token ids in files of byte or bit planes.

A file: magic, then chunks, then an index. A chunk holds ``block`` ids (the last one fewer) as
unsigned 32-bit integers, transposed into planes (byte b, or bit b, of every id together), each
compressed with zstandard. The index, zstandard-compressed, is a line of JSON with each chunk's place, ids and
plane sizes, then an Arrow stream with each document's id, of whatever type, and number of ids; its length and the magic end the file.

Executors write with pyarrow's file systems to the folder given; each attempt of a task has file
names of its own, and only those in the manifest, which Spark commits, count.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices
from .tokens import open_tokenizer

MAGIC = b"PLANEID1"
BLOCK = 1 << 16
#: Ids of one file, at most one document more.
FILE_IDS = 4 << 20


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, b].tobytes() for b in range(4)]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(spread[:, b]).tobytes() for b in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8))[:n] for p in planes], axis=1)
        raw = np.packbits(spread, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def encode_file(docs: list[tuple[object, bytes]], bits: bool = False, block: int = BLOCK, level: int = 1, id_type: pa.DataType | None = None) -> bytes:
    """``docs``: ids of documents (null is one) and their token ids as little-endian unsigned 32-bit integers.

    Without documents the file has no chunks. Equal ids stay as they are, in the order given.
    """
    packer = zstandard.ZstdCompressor(level=level)
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    out, chunks, at = [MAGIC], [], len(MAGIC)
    for i in range(0, len(ids), block):
        part = ids[i : i + block]
        planes = [packer.compress(p) for p in to_planes(part, bits)]
        chunks.append([at, len(part), [len(p) for p in planes]])
        at += sum(map(len, planes))
        out += planes
    table = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], id_type), pa.array([len(x) // 4 for _, x in docs], pa.int64())], ["doc_id", "length"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_batch(table)
    index = packer.compress(json.dumps({"block": block, "chunks": chunks}).encode() + b"\n" + sink.getvalue().to_pybytes())
    return b"".join([*out, index, len(index).to_bytes(8, "little"), MAGIC])


class TokenFile:
    """A file's index and its ids, all or a range of them. Ids of documents come back with their type, nulls as null."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC or raw[-8:] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(raw[-16:-8], "little")
        head, _, stream = zstandard.ZstdDecompressor().decompress(raw[-16 - size : -16]).partition(b"\n")
        index, table = json.loads(head), pa.ipc.open_stream(stream).read_all()
        self.raw, self.block, self.chunks = raw, index["block"], index["chunks"]
        self.id_type = table.schema.field("doc_id").type
        self.doc_ids, self.lengths = (table.column(c).to_pylist() for c in ("doc_id", "length"))

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.chunks[k]
        un, planes = zstandard.ZstdDecompressor(), []
        for size in sizes:
            planes.append(un.decompress(self.raw[at : at + size]))
            at += size
        return from_planes(planes, n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        first = start // self.block
        got = np.concatenate([self.chunk(k) for k in range(first, (stop - 1) // self.block + 1)])
        return got[start - first * self.block : stop - first * self.block]

    def documents(self):
        """Documents and their ids in order, with one chunk in memory besides the document's own."""
        k, have, start = 0, np.zeros(0, "<u4"), 0
        for doc_id, n in zip(self.doc_ids, self.lengths):
            held = [have]
            size = len(have)
            while size < n:
                held.append(self.chunk(k))
                size += len(held[-1])
                k += 1
            both = np.concatenate(held) if len(held) > 1 else have
            yield doc_id, start, both[:n]
            have, start = both[n:], start + n


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    style: str = "spaces",
    bits: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode every whole text, append ``end_id``, write the ids in ascending ``doc_id`` order.

    Returns the manifest ``part, nth, name, n_ids``, also written to ``path/_manifest``.
    Null and empty texts are the end id alone; null ids come first; rows of one id are ordered by
    their text. An empty table gives no files. Other columns are left out.
    """

    def run(batches):
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        tok, end = open_tokenizer(tokenizer, style), np.array([end_id], "<u4").tobytes()
        fs, base = FileSystem.from_uri(path)
        held: list[tuple[object, bytes]] = []
        size, id_type = 0, None

        def flush():
            nonlocal held, size, nth
            name = f"part-{part:06d}-{nth:06d}-{uuid.uuid4().hex}.ids"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(encode_file(held, bits, id_type=id_type))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([nth], pa.int64()), pa.array([name]), pa.array([size], pa.int64())], ["part", "nth", "name", "n_ids"])
            held, size, nth = [], 0, nth + 1
            return row

        for batch in slices(batches):
            id_type = batch.column("doc_id").type
            for i, ids in zip(batch.column("doc_id").to_pylist(), tok.encode(batch.column("text").cast(pa.binary()).to_pylist())):
                held.append((i, ids + end))
                size += len(held[-1][1]) // 4
                if size >= file_ids:
                    yield flush()
        if held:
            yield flush()

    spark = docs.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    ordered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange(_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part long, nth long, name string, n_ids long").write.parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_token_files(spark: SparkSession, path: str, doc_id_type: str = "long", with_ids: bool = True) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32`` and, with ``with_ids``, ``ids``.

    ``start`` counts the ids of all files before, summed up by Spark from the manifest; files of attempts that
    failed are in no manifest. Each file is read in one task. Without files there are no rows.
    """
    manifest = spark.read.parquet(f"{path}/_manifest")
    # A row for each range of ids that was written, of which there are as many as shuffle partitions.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = F.sum("size").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("within", within).join(parts, "part").select("name", (F.col("first") + F.col("within")).alias("start"))

    def run(batches):
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(path)
        for batch in batches:
            for name, first in zip(*(batch.column(c).to_pylist() for c in ("name", "start"))):
                with fs.open_input_file(f"{base}/{name}") as f:
                    file = TokenFile(f.read())
                held: list[tuple] = []
                for doc_id, start, ids in file.documents():
                    held.append((doc_id, first + start, len(ids), zlib.crc32(ids.tobytes()), ids))
                    if len(held) == 4096:
                        yield rows(held, file.id_type)
                        held = []
                if held:
                    yield rows(held, file.id_type)

    def rows(held, id_type):
        cols = list(zip(*held))
        arrays = [pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in cols[4]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    # Names are short and files long: they are dealt out by their names' hash.
    dealt = files.repartition(_parts(spark), F.xxhash64("name"))
    return dealt.mapInArrow(run, f"doc_id {doc_id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)

"""Token ids in files of shuffled planes.

A file holds documents in ascending order of their keys. Every section ends with a line feed, which
isn't part of it, so that Spark's own text writer can commit a file section by section to any
file system that Spark knows; sections are found by offsets only.

    header   b"PLN1", u8 plane kind (0 byte planes, 1 bit planes), u32 ids per block, i64 file ordinal
    block    for each plane a zstandard frame, one after the other
    docs     zstandard frame of (i64 key, u8 has a key, u32 number of ids) for each document, as columns
    index    zstandard frame of one record per block: u64 offset, u32 ids, u32 CRC-32 of the ids, u32 length of each plane
    trailer  u64 offset and u64 length of docs, the same of index, u64 documents, u64 ids, u32 blocks, b"PLN1"

A block holds ids as little-endian unsigned 32-bit integers, transposed so that plane p holds byte p (or
bit p) of each id in turn; the last block may be short. All integers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofkit.llm.common import bounded_batches, partitions_for, releasing, saved
from asofkit.llm.tokens import encoder

MAGIC = b"PLN1"
HEADER = struct.Struct("<4sBIq")
TRAILER = struct.Struct("<QQQQQQI4s")
PLANES = {"byte": 4, "bit": 32}
BLOCK_IDS = 65_536


def shuffle_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(octets[:, p]).tobytes() for p in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def join_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    """The block of *count* ids that has these planes."""
    table = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if kind == "bit":
        bits = np.unpackbits(table, axis=1, bitorder="little", count=count)
        table = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").T
    return np.ascontiguousarray(table.T).reshape(-1).view("<u4")


class PlaneWriter:
    """Yields the sections of a file, given documents in order; holds one block and the documents' keys and lengths."""

    def __init__(self, ordinal: int, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 1):
        import zstandard

        self.kind, self.block_ids, self.ordinal = kind, block_ids, ordinal
        self._zip = zstandard.ZstdCompressor(level=level).compress
        self._rest, self._at, self._index, self._docs, self._total = bytearray(), 0, [], [], 0

    def _section(self, data: bytes) -> bytes:
        self._at += len(data) + 1
        return data

    def start(self) -> bytes:
        return self._section(HEADER.pack(MAGIC, self.kind == "bit", self.block_ids, self.ordinal))

    def _block(self, raw: bytes) -> bytes:
        frames = [self._zip(p) for p in shuffle_planes(np.frombuffer(raw, "<u4"), self.kind)]
        self._index.append(struct.pack(f"<QII{len(frames)}I", self._at, len(raw) // 4, zlib.crc32(raw), *map(len, frames)))
        return self._section(b"".join(frames))

    def add(self, key: int | None, ids: bytes) -> Iterator[bytes]:
        self._docs.append((key, len(ids) // 4))
        self._total += len(ids) // 4
        self._rest += ids
        size = 4 * self.block_ids
        done = len(self._rest) // size * size
        for at in range(0, done, size):
            yield self._block(bytes(self._rest[at : at + size]))
        if done:
            del self._rest[:done]

    def finish(self) -> Iterator[bytes]:
        if self._rest:
            yield self._block(bytes(self._rest))
        keys = np.array([k or 0 for k, _ in self._docs], "<i8")
        has = np.array([k is not None for k, _ in self._docs], np.uint8)
        counts = np.array([n for _, n in self._docs], "<u4")
        docs_at, docs = self._at, self._zip(keys.tobytes() + has.tobytes() + counts.tobytes())
        yield self._section(docs)
        index_at, index = self._at, self._zip(b"".join(self._index))
        yield self._section(index)
        yield self._section(TRAILER.pack(docs_at, len(docs), index_at, len(index), len(keys), self._total, len(self._index), MAGIC))


class PlaneReader:
    """Reads a file's bytes; any block can be read alone through the index."""

    def __init__(self, data: bytes):
        import zstandard

        self.data, self._unzip, self._broken = data, zstandard.ZstdDecompressor().decompress, zstandard.ZstdError
        magic, bits, self.block_ids, self.ordinal = HEADER.unpack_from(data)
        docs_at, docs_len, index_at, index_len, self.n_docs, self.n_ids, blocks, tail = TRAILER.unpack_from(data, len(data) - TRAILER.size - 1)
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a plane file")
        self.kind = "bit" if bits else "byte"
        raw = self._unzip(data[docs_at : docs_at + docs_len]) if self.n_docs else b""
        n = self.n_docs
        self.keys, self.has_key, self.counts = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<u4", n, 9 * n)
        record = struct.Struct(f"<QII{PLANES[self.kind]}I")
        self.index = list(record.iter_unpack(self._unzip(data[index_at : index_at + index_len]))) if blocks else []

    def block(self, number: int) -> np.ndarray:
        at, count, crc, *lengths = self.index[number]
        planes = []
        for n in lengths:
            try:
                planes.append(self._unzip(self.data[at : at + n]))
            except self._broken as e:
                raise ValueError(f"block {number} is damaged") from e
            at += n
        ids = join_planes(planes, count, self.kind)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {number} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Each document's key and its ids, in order; holds a block and a document at a time."""
        rest, number = b"", 0
        for key, has, count in zip(self.keys.tolist(), self.has_key.tolist(), self.counts.tolist()):
            parts, have = [rest], len(rest)
            while have < 4 * count:
                parts.append(self.block(number).tobytes())
                have += len(parts[-1])
                number += 1
            raw = b"".join(parts)
            yield key if has else None, raw[: 4 * count]
            rest = raw[4 * count :]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", kind: str = "byte", block_ids: int = BLOCK_IDS, files: int | None = None) -> None:
    """Writes the ids of all documents to *path*, one file for each range of keys, ascending.

    Rows with equal keys stay together, ordered by text; null keys come first. A null or empty text has
    the end id alone. Files have about as many documents each: choose *files* so that one fits in memory twice.
    """

    def sections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, writer = encoder(tokenizer), None
        for batch in batches:
            if writer is None and len(batch):
                writer = PlaneWriter(TaskContext.get().partitionId(), kind, block_ids)
                yield pd.DataFrame({"section": [writer.start()]})
            for doc, ids in zip(batch["k"], encode.documents(batch["t"].tolist())):
                for section in writer.add(None if doc is None else int(doc), ids):
                    yield pd.DataFrame({"section": [section]})
        if writer:
            for section in writer.finish():
                yield pd.DataFrame({"section": [section]})

    bounded_batches(docs.sparkSession)
    # As text, a key keeps all its digits where the column has nulls.
    dealt = docs.select(F.col(key).cast("bigint").alias("o"), F.col(text).alias("t")).repartitionByRange(files or partitions_for(docs.sparkSession), F.col("o").asc_nulls_first())
    ordered = dealt.sortWithinPartitions(F.col("o").asc_nulls_first(), F.col("t").asc_nulls_first()).select(F.col("o").cast("string").alias("k"), "t")
    out = ordered.mapInPandas(releasing(sections), "section binary")
    out.select(F.col("section").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document in the files under *path*: doc_id, file, place (in the file), at (ids before it there), n_tokens, ids_crc32, and ids (null without *with_ids*)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                reader, kept, size, at = PlaneReader(bytes(data)), [], 0, 0
                for n, (key, ids) in enumerate(reader.documents()):
                    kept.append((key, reader.ordinal, n, at, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                    size, at = size + (len(ids) if with_ids else 64), at + len(ids) // 4
                    if size > 8_000_000:
                        yield _frame(kept)
                        kept, size = [], 0
                yield _frame(kept)

    bounded_batches(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(releasing(rows), "doc_id bigint, file bigint, place bigint, at bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "file", "place", "at", "n_tokens", "ids_crc32", "ids"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """read_tokens() without the ids, with start: what each document's ids are, and where they begin in the whole."""
    docs = saved(read_tokens(spark, path, with_ids=False).drop("ids"), "token_index")
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # One row for each file.
    before = totals.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(before, "file").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

"""Token-id shards as sorted string tables.

File: data blocks, then the block index, the Bloom filter, and a footer of fixed size. Integers are little-endian.

data block   zstd frame of entries: varint shared key bytes, varint own key bytes, varint value bytes, own key bytes,
             value; the first entry of a block shares nothing
block index  per block: varint key bytes, the block's first key, varint offset, varint stored bytes, varint raw bytes, varint entries
Bloom filter k probes over m bits, by double hashing of the key's BLAKE2b digest
footer       index offset and bytes, filter offset and bytes, m (5 x u64), k, id bytes, version (3 x u32), entries, ids (2 x u64), magic

Keys: one byte 0 for a null id, else 1 and the id as 8 bytes, big-endian, sign bit flipped, so that byte order is id
order. Values: ids as unsigned integers of 2 or 4 bytes.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordEncoder, bounded_batches, partitions, shared_path, whole

FOOTER = struct.Struct("<5Q3I2Q8s")
MAGIC = b"INKSST01"
BLOCK_BYTES, PROBES, BITS_PER_KEY = 64 * 1024, 7, 10
#: Bytes of text of a shard at most, about; a writer holds the digests of its keys.
SHARD_BYTES = 256 << 20
END_ID = 1


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _digest(key: bytes) -> tuple[int, int]:
    return struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())


def _probes(digest: tuple[int, int], bits: int, probes: int) -> list[int]:
    one, two = digest
    return [(one + i * (two | 1)) % bits for i in range(probes)]


class Writer:
    """Writes a table to a binary file; keys must come in ascending order, equal keys are kept side by side."""

    def __init__(self, file, id_bytes: int):
        import pyarrow as pa

        self.file, self.id_bytes, self.codec = file, id_bytes, pa.Codec("zstd", compression_level=1)
        self.at = self.entries = self.ids = self.in_block = 0
        self.block, self.index, self.digests = bytearray(), [], array("Q")
        self.first = self.last = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys must ascend")
        value = ids.astype("<u2" if self.id_bytes == 2 else "<u4").tobytes()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.digests.extend(_digest(key))
        self.entries, self.in_block, self.ids = self.entries + 1, self.in_block + 1, self.ids + len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            stored = self.codec.compress(bytes(self.block), asbytes=True)
            self.index.append((self.first, self.at, len(stored), len(self.block), self.in_block))
            self.file.write(stored)
            self.at += len(stored)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self._end_block()
        index = b"".join(_varint(len(k)) + k + b"".join(map(_varint, rest)) for k, *rest in self.index)
        bits = max(64, len(self.digests) // 2 * BITS_PER_KEY)
        bloom = bytearray(-(-bits // 8))
        for digest in zip(self.digests[::2], self.digests[1::2], strict=True):
            for p in _probes(digest, bits, PROBES):
                bloom[p >> 3] |= 1 << (p & 7)
        self.file.write(index + bytes(bloom))
        where = (self.at, len(index), self.at + len(index), len(bloom), bits)
        self.file.write(FOOTER.pack(*where, PROBES, self.id_bytes, 1, self.entries, self.ids, MAGIC))
        self.file.close()


class Reader:
    """Reads a table: one block at a time in order, or one key by the filter and binary search."""

    def __init__(self, file, size: int):
        import pyarrow as pa

        self.file, self.codec = file, pa.Codec("zstd")
        tail = self._bytes(size - FOOTER.size, FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.bits, self.probes, self.id_bytes, version, self.entries, self.ids, magic = FOOTER.unpack(tail)
        if magic != MAGIC or version != 1:
            raise ValueError("not a table of this format")
        data, at, self.index = self._bytes(index_at, index_size), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at, rest = data[at : at + n], at + n, []
            for _ in range(4):
                x, at = _read_varint(data, at)
                rest.append(x)
            self.index.append((key, *rest))
        self.bloom = self._bytes(bloom_at, bloom_size)

    def _bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, stored, raw, entries = self.index[k]
        data, at, key = self.codec.decompress(self._bytes(offset, stored), raw, asbytes=True), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, dtype="<u2" if self.id_bytes == 2 else "<u4", count=size // self.id_bytes, offset=at)
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(_digest(key_of(doc_id)), self.bits, self.probes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry under a document id."""
        key, found = key_of(doc_id), []
        if not self.may_hold(doc_id):
            return found
        k = max(0, bisect.bisect_left(self.index, key, key=lambda x: x[0]) - 1)
        while k < len(self.index) and self.index[k][0] <= key:
            found += [ids for got, ids in self._block(k) if got == key]
            k += 1
        return found


def _open(uri: str, write: bool):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    if write:
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path), system, path
    return system.open_input_file(path), system, path


def written(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """Encodes every whole text, appends END_ID, and writes shards in ascending id order into a shared folder.

    Returns (shard, uri, entries, ids, first id, last id) in order; one entry per shard is all the driver gets.
    Texts are shuffled once, by ranges of id and text hash, so that no id's rows need meet in one task; each task streams its range
    of at most about SHARD_BYTES into one file. A retried or speculative task writes a file of its own, and only files of
    tasks that ended well are listed. Null texts are empty (one END_ID), null ids come first, repeated ids are kept
    side by side in the order of their texts' hashes. An empty table gives no shard.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or shared_path(spark, "sst")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tie = F.xxhash64("text")
    ranges = partitions(spark, -(-size // SHARD_BYTES))
    ordered = rows.repartitionByRange(ranges, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = WordEncoder.of(tokenizer)
        id_bytes = 2 if max(encoder.tokenizer.get_vocab_size(), END_ID + 1) <= 1 << 16 else 4
        task = TaskContext.get()
        uri = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst"
        table = first = last = None
        for batch in batches:
            if batch.num_rows and table is None:
                table = Writer(_open(uri, True)[0], id_bytes)
                first = batch.column(0)[0].as_py()
            ids, ends = encoder.encode(batch.column(1), END_ID)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                table.add(key_of(doc_id), ids[ends[k] : ends[k + 1]])
                last = doc_id
        if table is not None:
            table.close()
            row = (task.partitionId(), uri, table.entries, table.ids, first, last)
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "uri", "entries", "ids", "first_id", "last_id"), row, strict=True))], schema=pa.schema(SHARD))

    SHARD = [(n, t) for n, t in zip(("shard", "uri", "entries", "ids", "first_id", "last_id"), _types(), strict=True)]
    listed = ordered.mapInArrow(write, "shard int, uri string, entries long, ids long, first_id long, last_id long").collect()
    return sorted(tuple(r) for r in listed)


def _types():
    import pyarrow as pa

    return pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()


def read_back(spark, shards: list[tuple]) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard.

    shards tells where the files are and their order; what they hold is read from them, how many ids first, from their footers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
    if not shards:
        return spark.createDataFrame([], schema)

    def counted(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = []
            for uri in batch.column(1).to_pylist():
                file, system, path = _open(uri, False)
                with file:
                    ids.append(Reader(file, system.get_file_info(path).size).ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64())], names=["shard", "uri", "ids"])

    spread = min(len(shards), partitions(spark))
    files = spark.createDataFrame([(shard, uri) for shard, uri, *_ in shards], "shard int, uri string").repartition(spread, "shard")
    before, listed = 0, []
    for r in sorted(files.mapInArrow(counted, "shard int, uri string, ids long").collect()):
        listed.append((r["shard"], r["uri"], before))
        before += r["ids"]
    files = spark.createDataFrame(listed, "shard int, uri string, start long").repartition(spread, "shard")

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]
        kinds = [pa.int64()] * 4 + [pa.int32()]
        for batch in batches:
            for shard, uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, system, path = _open(uri, False)
                rows = []
                with file:
                    for doc_id, ids in Reader(file, system.get_file_info(path).size):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                        start += len(ids)
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(read, schema)


def to_bytes(entries: Iterable[tuple[int | None, list[int]]], id_bytes: int = 4) -> bytes:
    """A whole table in memory, for callers without Spark."""
    kept = io.BytesIO()
    kept.close = lambda: None  # type: ignore[method-assign]
    table = Writer(kept, id_bytes)
    for doc_id, ids in entries:
        table.add(key_of(doc_id), np.asarray(ids))
    table.close()
    return kept.getvalue()

"""Token ids in sorted-string-table shards.

A shard holds documents by ascending key: blocks of prefix-compressed entries (restart points
every ``RESTART`` entries, zstd-packed), then a sparse index with one entry a block, a Bloom
filter over all keys, and a fixed footer. ``Shard`` opens one and finds a key by the Bloom
filter, a binary search of the index and a binary search of the block's restart points.

Layout, little-endian but for keys::

    block    = zstd(entry* restart_offset:u32* n_restarts:u32)
    entry    = shared:varint rest:varint value:varint key[shared:] value
    index    = (key_length:u32 last_key offset:u64 length:u32 n_entries:u32)*
    bloom    = n_bits:u64 n_hashes:u32 bits
    footer   = index_at:u64 index_length:u64 bloom_at:u64 bloom_length:u64 n_entries:u64 n_tokens:u64 id_width:u32 magic:8s

A key is one byte (0: null id, 1: present) and the id in eight big-endian bytes with the sign
bit turned, so that byte order is id order with nulls first.

Shards are rolled by size, so neither index nor filter grows with the table. Cases: a null text counts as empty (only the end id); null ids come first; rows with one id
are all kept, in order of a hash of their texts, and ``get_all`` returns each; an empty table
writes no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltic.llm.common import arrow_rows, saved, scratch_path
from basaltic.llm.tokens import batches_of, encoder, settle

MAGIC = b"BSSTBL01"
FOOTER = struct.Struct("<QQQQQQI8s")
INDEX = struct.Struct("<QII")
BLOCK_BYTES = 1 << 18
#: A shard is closed, and another one begun, at this size.
SHARD_BYTES = 256 << 20
RESTART = 16
BLOOM_BITS_A_KEY, BLOOM_HASHES = 10, 7
END_ID = 2
#: Documents that a worker takes from Spark at once.
ENCODED_ROWS = 1_000

MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_bytes long, first_key binary, last_key binary"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a plain path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id ^ -(1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    if key == b"\0":
        return None
    n = struct.unpack(">Q", key[1:])[0] ^ 1 << 63
    return n - (1 << 64) if n >> 63 else n


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (1 << 64) - 1 | 1
    return [((a + i * b) & (1 << 64) - 1) % bits for i in range(hashes)]


class ShardWriter:
    """Takes entries in key order; holds one block, the index and 16 bytes a key."""

    def __init__(self, sink, width: int) -> None:
        import zstandard

        self.sink, self.width, self.at = sink, width, 0
        self.packer = zstandard.ZstdCompressor(level=1)
        self.index, self.keys = bytearray(), []
        self.n = self.n_tokens = 0
        self.first = self.last = b""
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.first = self.first if self.n else key
        self.last = key
        self.keys.append(key)
        self.n += 1
        self.in_block += 1
        self.n_tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.in_block:
            tail = np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
            packed = self.packer.compress(bytes(self.block) + tail)
            self.index += struct.pack("<I", len(self.last)) + self.last + INDEX.pack(self.at, len(packed), self.in_block)
            self._put(packed)
            self._new_block()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._end_block()
        index_at = self.at
        self._put(bytes(self.index))
        bits = max(64, BLOOM_BITS_A_KEY * self.n)
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for place in bloom_places(key, bits, BLOOM_HASHES):
                bloom[place >> 3] |= 1 << (place & 7)
        bloom_at = self.at
        self._put(struct.pack("<QI", bits, BLOOM_HASHES) + bytes(bloom))
        self._put(FOOTER.pack(index_at, len(self.index), bloom_at, self.at - bloom_at, self.n, self.n_tokens, self.width, MAGIC))


class Shard:
    """Reads one shard by ranges; keeps its index and Bloom filter."""

    def __init__(self, path: str) -> None:
        import zstandard

        store, name = open_store(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        index_at, index_length, bloom_at, bloom_length, self.n, self.n_tokens, self.width, magic = FOOTER.unpack(self._range(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.unpacker = zstandard.ZstdDecompressor()
        index, at, self.lasts, self.places = self._range(index_at, index_length), 0, [], []
        while at < len(index):
            (n,) = struct.unpack_from("<I", index, at)
            self.lasts.append(bytes(index[at + 4 : at + 4 + n]))
            self.places.append(INDEX.unpack_from(index, at + 4 + n))
            at += 4 + n + INDEX.size
        self.bloom_at, self.bloom_length, self._bloom = bloom_at, bloom_length, None

    def _range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()

    def _block(self, i: int) -> tuple[bytes, np.ndarray]:
        at, n, _ = self.places[i]
        data = self.unpacker.decompress(self._range(at, n))
        (count,) = struct.unpack_from("<I", data, len(data) - 4)
        end = len(data) - 4 - 4 * count
        return data[:end], np.frombuffer(data, "<u4", count, end)

    def _entries(self, data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + n]
            at += rest + n

    def may_hold(self, key: bytes) -> bool:
        if self._bloom is None:
            self._bloom = self._range(self.bloom_at, self.bloom_length)
        bits, hashes = struct.unpack_from("<QI", self._bloom)
        return all(self._bloom[12 + (p >> 3)] >> (p & 7) & 1 for p in bloom_places(key, bits, hashes))

    def get_all(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry under ``doc_id``."""
        key, found = key_of(doc_id), []
        if not self.may_hold(key):
            return found
        for i in range(bisect_left(self.lasts, key), len(self.lasts)):
            data, restarts = self._block(i)
            low, high = 0, len(restarts) - 1
            while low < high:  # the last restart whose key is smaller; entries before it are smaller too
                middle = (low + high + 1) // 2
                if next(self._entries(data, int(restarts[middle])))[0] < key:
                    low = middle
                else:
                    high = middle - 1
            for k, v in self._entries(data, int(restarts[low])):
                if k > key:
                    return found
                if k == key:
                    found.append(np.frombuffer(v, f"<u{self.width}"))
        return found

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.places)):
            for key, value in self._entries(self._block(i)[0], 0):
                yield id_of(key), np.frombuffer(value, f"<u{self.width}")


class ShardSink:
    """A shard being written; its file name is new for each attempt, and only the manifest of
    the attempt that succeeds names it."""

    def __init__(self, folder: str, number: int, width: int) -> None:
        self.number, self.path = number, f"{folder}/shard-{number:012d}-{uuid.uuid4().hex}.sst"
        store, name = open_store(self.path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.sink = store.open_output_stream(name)
        self.writer = ShardWriter(self.sink, width)

    def close(self) -> pa.RecordBatch:
        """The shard's row of the manifest."""
        w = self.writer
        w.close()
        self.sink.close()
        names = ["shard", "path", "n_docs", "n_tokens", "n_bytes", "first_key", "last_key"]
        return pa.RecordBatch.from_pydict(dict(zip(names, ([x] for x in (self.number, self.path, w.n, w.n_tokens, w.at, w.first, w.last)), strict=True)))


def write_partition(folder: str, vocabulary: str, end_id: int, width: int | None):
    """Encodes a sorted partition into shards, numbered by partition and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, shard, end = encoder(vocabulary), None, np.array([end_id], "<u4")
        most = max(coder.size - 1, end_id)
        size = width or next(w for w in (1, 2, 4) if most < 256**w)
        if most >= 256**size:
            raise ValueError(f"ids up to {most} don't fit into {size} bytes")
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            for texts in batches_of(batch.column(1)):
                for coded in coder.encode(texts):
                    if shard is None:
                        shard = ShardSink(folder, number, size)
                    shard.writer.add(key_of(ids[at]), np.concatenate([coded, end]))
                    at += 1
                    if shard.writer.at >= SHARD_BYTES:
                        yield shard.close()
                        shard, number = None, number + 1
            settle()
        if shard is not None:
            yield shard.close()

    return run


def write_shards(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int | None = None) -> DataFrame:
    """Writes ``docs`` under ``folder`` (a URI that all executors share) and returns the
    manifest, one row a shard, which is saved: the shards are written once. width: bytes an
    id takes in a shard (1, 2 or 4), by default as few as the vocabulary needs; too few are an
    error. There are at least as many ranges of ids as the input has partitions."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie, ranges = F.xxhash64("text"), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    spread = rows.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    with arrow_rows(docs.sparkSession, ENCODED_ROWS):
        return saved(spread.mapInArrow(write_partition(folder, vocabulary, end_id, width), MANIFEST), "sst-manifest")


def lookup(manifest: DataFrame, doc_id: int | None) -> list[list[int]]:
    """The ids of every document under ``doc_id``, read from the shards whose range holds it."""
    key, found = key_of(doc_id), []
    for row in manifest.where(F.lit(bytearray(key)).between(F.col("first_key"), F.col("last_key"))).orderBy("shard").collect():
        shard = Shard(row["path"])
        found += [ids.tolist() for ids in shard.get_all(doc_id)]
        shard.close()
    return found


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard, rows = Shard(path), []
                for doc_id, ids in shard.scan():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _digests(rows)
                        rows = []
                shard.close()
                if rows:
                    yield _digests(rows)

    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("start"))
    return files.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=list(names))


def encode_and_read(docs: DataFrame, spark: SparkSession, vocabulary: str) -> DataFrame:
    """Writes the shards into scratch storage and returns what the files say of each document."""
    return read_shards(write_shards(docs, scratch_path(spark, "sst"), vocabulary))

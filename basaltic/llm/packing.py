"""Best-fit packing of tokenised documents by hierarchical residual packing.

Each partition encodes its documents, cuts the long ones into full sequences and one shorter
first piece, and packs the short pieces best-fit, largest first (``TASK_PIECES`` at a time).
Nearly full bins are done. The others go on as single items: up to ``FAN_IN`` partitions meet
in one, fewer where their bins would exceed ``TASK_BINS`` or ``TASK_BYTES``, which packs them
again; so on in a tree, until one task has seen all that is left or a round hardly joins any.
A bin too full for the smallest open bin anywhere is done as well, so what is carried on only
ever shrinks. Bins carry their pieces along (32 bytes each, ``capacity`` pieces at most), so
that no join is needed to place them at the end.

Cases: a null text counts as empty (only the end id); rows with a null id or with one id
several times are documents of their own; only documents over ``capacity`` are cut; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltic.llm.common import arrow_rows, materialize
from basaltic.llm.tokens import batches_of, encoder, settle

CAPACITY = 2048
END_ID = 0
#: A bin with no more than this share of its capacity free is done.
SLACK = 1 / 256
FAN_IN = 16
#: Open bins that one task packs at once, and their pieces' bytes; rounds use as many tasks as
#: that takes. Short pieces that a partition packs at once.
TASK_BINS, TASK_BYTES, TASK_PIECES = 200_000, 32 << 20, 200_000
#: Rounds end when one leaves more than this share of the open bins.
STALL = 0.98
#: Documents that a worker takes from Spark at once.
ENCODED_ROWS = 1_000

PIECE = np.dtype([("doc_id", "<i8"), ("null", "<i4"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BINS = "done boolean, fill int, sequence_id long, pieces binary"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what is over."""
    head = length % capacity or min(length, capacity)
    return [(0, head), *((at, capacity) for at in range(head, length, capacity))]


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Largest first, each item into the fullest bin that takes it; items by bin."""
    bins: list[list[int]] = []
    free_of: dict[int, list[int]] = {}  # bins by free space
    free: list[int] = []  # the free spaces that bins have, rising
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        at = bisect_left(free, size)
        if at == len(free):
            place, left = len(bins), capacity - size
            bins.append([item])
        else:
            space = free[at]
            place = free_of[space].pop()
            if not free_of[space]:
                del free_of[space], free[at]
            bins[place].append(item)
            left = space - size
        if left:
            if left not in free_of:
                free_of[left] = []
                insort(free, left)
            free_of[left].append(place)
    return bins


def _pack(sizes: np.ndarray, pieces: np.ndarray, starts: np.ndarray, capacity: int, close: int, first_id: int) -> Iterator[pa.RecordBatch]:
    """Packs items and yields the bins; those filled to ``close`` or more are done. An item's
    pieces are those from its start to the next one's."""
    rows: list[tuple] = []
    for n, members in enumerate(best_fit(sizes, capacity)):
        fill = int(sizes[members].sum())
        rows.append((fill >= close, fill, first_id + n, b"".join(pieces[starts[m] : starts[m + 1]].tobytes() for m in members)))
        if len(rows) == 5_000:
            yield _bins(rows)
            rows = []
    if rows:
        yield _bins(rows)


def _bins(rows: list[tuple]) -> pa.RecordBatch:
    done, fill, ids, pieces = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(done), pa.array(fill, pa.int32()), pa.array(ids, pa.int64()), pa.array(pieces, pa.binary())], names=["done", "fill", "sequence_id", "pieces"])


def _first_id(level: int) -> int:
    """Sequence ids are counted within a task; level and task stand above."""
    from pyspark import TaskContext

    return level << 56 | TaskContext.get().partitionId() << 32


def pieces_of(key: int | None, ids: np.ndarray, end: bytes, capacity: int) -> np.ndarray:
    """A document's pieces, the end id included; its ids are not copied."""
    data, parts = ids.view(np.uint8), cut(len(ids) + 1, capacity)
    out = np.empty(len(parts), PIECE)
    for n, (start, length) in enumerate(parts):
        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
        out[n] = (key or 0, key is None, n, start, length, zlib.crc32(end, crc) if n == len(parts) - 1 else crc)
    return out


def encode_partition(vocabulary: str, capacity: int, close: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(vocabulary), int(end_id).to_bytes(4, "little")
        first, kept, waiting = _first_id(1), [], 0
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for texts in batches_of(batch.column(1)):
                found = []
                for ids in coder.encode(texts):
                    found.append(pieces_of(keys[at], ids, end, capacity))
                    at += 1
                pieces = np.concatenate(found)
                full = pieces["length"] == capacity
                for a in range(0, int(full.sum()), 5_000):
                    some = pieces[full][a : a + 5_000]
                    yield _bins([(True, capacity, first + n, piece.tobytes()) for n, piece in enumerate(some)])
                    first += len(some)
                kept.append(pieces[~full])
                waiting += len(kept[-1])
                if waiting >= TASK_PIECES:
                    yield from packed(kept, first)
                    first, kept, waiting = first + waiting, [], 0
            settle()
        if waiting:
            yield from packed(kept, first)

    def packed(kept: list[np.ndarray], first: int) -> Iterator[pa.RecordBatch]:
        pieces = np.concatenate(kept)
        return _pack(pieces["length"].astype(np.int64), pieces, np.arange(len(pieces) + 1), capacity, close, first)

    return run


def pack_again(capacity: int, close: int, level: int):
    """One best-fit round over the open bins of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, pieces, counts = [], [], [np.zeros(1, np.int64)]
        for batch in batches:
            data = batch.column(1).to_pylist()
            sizes.append(batch.column(0).to_numpy().astype(np.int64))
            counts.append(np.fromiter(map(len, data), np.int64, len(data)) // PIECE.itemsize)
            pieces.append(np.frombuffer(b"".join(data), PIECE))
        if sizes:
            yield from _pack(np.concatenate(sizes), np.concatenate(pieces), np.cumsum(np.concatenate(counts)), capacity, close, _first_id(level))

    return run


def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bins to rows: each piece with its place in the sequence."""
    for batch in batches:
        for part in (batch.slice(a, 2_000) for a in range(0, batch.num_rows, 2_000)):
            data = part.column(1).to_pylist()
            counts = [len(d) // PIECE.itemsize for d in data]
            rows = np.frombuffer(b"".join(data), PIECE)
            ends = np.cumsum(rows["length"], dtype=np.int64)
            firsts = np.cumsum([0, *counts[:-1]])
            offset = ends - rows["length"] - np.repeat((ends - rows["length"])[firsts], counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(rows["doc_id"]), mask=rows["null"].astype(bool)),
                    pa.array(np.ascontiguousarray(rows["piece"])),
                    pa.array(np.ascontiguousarray(rows["start"])),
                    pa.array(rows["length"].astype(np.int64)),
                    pa.array(rows["crc"].astype(np.int64)),
                    pa.array(np.repeat(np.array(part.column(0)), counts)),
                    pa.array(offset),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    close = capacity - int(capacity * SLACK)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with arrow_rows(docs.sparkSession, ENCODED_ROWS):
        bins, _ = materialize(source.mapInArrow(encode_partition(vocabulary, capacity, close, end_id), BINS), "pack-1")
    finished, level = bins.where("done"), 1
    opened = bins.where("not done")
    tasks = opened.agg(F.count_distinct(F.shiftright("sequence_id", 32))).first()[0]
    while True:
        state = opened.agg(F.count(F.lit(1)).alias("n"), F.min("fill").alias("least")).first()
        if not state["n"]:
            break
        stuck = F.col("fill") > capacity - state["least"]
        finished = finished.union(opened.where(stuck))
        opened = opened.where(~stuck)
        left, size = opened.agg(F.count(F.lit(1)), F.sum(F.octet_length("pieces"))).first()
        if left < 2:
            finished = finished.union(opened)
            break
        level += 1
        tasks = max(-(-left // TASK_BINS), -(-size // TASK_BYTES), -(-tasks // FAN_IN))
        packed, _ = materialize(opened.select("fill", "pieces").repartition(tasks).mapInArrow(pack_again(capacity, close, level), BINS), f"pack-{level}")
        finished = finished.union(packed.where("done"))
        opened = packed.where("not done")
        if tasks == 1 or opened.count() > STALL * left:
            finished = finished.union(opened)
            break
    return finished.select("sequence_id", "pieces").mapInArrow(place, PIECES)

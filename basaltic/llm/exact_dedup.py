"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Senders (the partitions of the fingerprint table) sort their 64-bit fingerprints, split
them by the owner of each range and send the gaps Rice-coded (Golomb codes with a power of
two). An owner merges what it gets and answers every sender with a bitmap of the
fingerprints that occur more than once. Only texts behind a set bit (the suspects) are then
shuffled, and grouped by their bytes, so that a fingerprint collision joins nothing.

Cases: a null text counts as empty; a null ``doc_id`` is an ordinary row, smaller than any
id; repeated rows are copies of each other (of rows with equal text and id all but one are
dropped, see ``deduplicate``); an empty table gives an empty result; other columns are
carried by ``deduplicate`` and ignored by ``duplicate_groups``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltic.llm.common import free_names, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints one owner merges at once (8 bytes each).
OWNER_FINGERPRINTS = 1_000_000
#: Largest number of suspect fingerprints that is broadcast (about 16 bytes each).
BROADCAST_SUSPECTS = 500_000
#: Largest number of groups of copies that is broadcast (about 120 bytes each).
BROADCAST_GROUPS = 200_000

MESSAGE = "owner int, sender long, n long, k int, first decimal(20,0), gaps binary, tops binary, repeated binary"


def normalised(text) -> F.Column:
    """Lower-cases A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Gaps of strictly rising uint64 ``values`` (two or more) as (k, low bits, unary tops)."""
    gaps = np.diff(values) - np.uint64(1)
    mean = float(values[-1] - values[0]) / len(gaps)
    k = max(0, min(63, int(np.floor(np.log2(max(mean * 0.69, 1.0))))))
    low = np.zeros((len(gaps), k), np.uint8)
    for j in range(k):
        low[:, j] = (gaps >> np.uint64(k - 1 - j)) & np.uint64(1)
    tops = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(tops + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    return k, np.packbits(low).tobytes(), np.packbits(unary).tobytes()


def rice_decode(first: int, n: int, k: int, gaps: bytes, tops: bytes) -> np.ndarray:
    """The ``n`` values that ``rice_encode`` got."""
    out = np.empty(n, np.uint64)
    out[0] = first
    if n > 1:
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(tops, np.uint8)))[: n - 1]
        high = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
        low = np.zeros(n - 1, np.uint64)
        bits = np.unpackbits(np.frombuffer(gaps, np.uint8), count=(n - 1) * k).reshape(n - 1, k)
        for j in range(k):
            low = (low << np.uint64(1)) | bits[:, j].astype(np.uint64)
        out[1:] = np.cumsum((high << np.uint64(k)) + low + np.uint64(1), dtype=np.uint64) + np.uint64(first)
    return out


def owner_of(fingerprints: np.ndarray, owners: int) -> np.ndarray:
    """Equal ranges of the fingerprint space, by its upper 32 bits."""
    return (((fingerprints >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


def send(owners: int):
    """One message to each owner from each sender."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        got = [b["fp"].to_numpy(np.int64).view(np.uint64) for b in batches if len(b)]
        if not got:
            return
        values, counts = np.unique(np.concatenate(got), return_counts=True)
        places = owner_of(values, owners)
        starts = np.flatnonzero(np.diff(places, prepend=-1))
        rows = []
        for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
            part = values[a:b]
            k, gaps, tops = rice_encode(part) if b - a > 1 else (0, b"", b"")
            rows.append((int(places[a]), TaskContext.get().partitionId(), int(b - a), k, int(part[0]), gaps, tops, np.packbits(counts[a:b] > 1).tobytes()))
            if len(rows) == 1000:
                yield frame(rows)
                rows = []
        if rows:
            yield frame(rows)

    return run


def frame(rows: list[tuple]) -> pd.DataFrame:
    from decimal import Decimal

    out = pd.DataFrame(rows, columns=["owner", "sender", "n", "k", "first", "gaps", "tops", "repeated"])
    out["first"] = [Decimal(x) for x in out["first"]]
    return out


def answer(messages: pd.DataFrame) -> pd.DataFrame:
    """The owner's part: a bitmap for each sender, a bit for each fingerprint that it sent."""
    parts = [rice_decode(int(f), n, k, g, t) for f, n, k, g, t in zip(messages["first"], messages["n"], messages["k"], messages["gaps"], messages["tops"], strict=True)]
    local = [np.unpackbits(np.frombuffer(r, np.uint8), count=len(p)) for r, p in zip(messages["repeated"], parts, strict=True)]
    _, back, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    total = (counts > 1).astype(np.uint8)
    np.maximum.at(total, back, np.concatenate(local))
    bits = np.split(total[back], np.cumsum([len(p) for p in parts])[:-1])
    return pd.DataFrame({"owner": messages["owner"], "sender": messages["sender"], "bitmap": [np.packbits(b).tobytes() for b in bits]})


def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sender's part: the fingerprints whose bit is set."""
    for b in batches:
        for f, n, k, g, t, bitmap in zip(b["first"], b["n"], b["k"], b["gaps"], b["tops"], b["bitmap"], strict=True):
            hit = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)
            if hit.any():
                yield pd.DataFrame({"fp": rice_decode(int(f), n, k, g, t)[hit].view(np.int64)})


def suspect_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """Distinct ``fp`` of a written table that occur more than once. A fingerprint's copies
    within a sender are sent once, so no owner gets more of it than there are senders."""
    owners = max(1, -(-rows // OWNER_FINGERPRINTS))
    messages = saved(fingerprints.select("fp").mapInPandas(send(owners), MESSAGE), "golomb-messages")
    bitmaps = messages.groupBy("owner").applyInPandas(answer, "owner int, sender long, bitmap binary")
    return messages.join(bitmaps, ["owner", "sender"]).mapInPandas(suspects, "fp long").distinct()


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (the largest id among equal texts),
    group_size, kept, text_sha256 of the normalised text. Of rows with equal text and equal
    largest id every one is marked kept, as they can't be told apart."""
    text = normalised(F.col(text_col))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm"))
    base = saved(source.select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256")), "fingerprints")
    found = saved(suspect_fingerprints(base, base.count()), "suspects")
    if found.count() <= BROADCAST_SUSPECTS:
        found = F.broadcast(found)
    groups = (
        source.select("doc_id", "norm", F.xxhash64("norm").alias("fp"))
        .join(found, "fp", "left_semi")
        .groupBy("norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    groups = saved(groups.where("group_size > 1"), "groups")
    joined = base.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "text_sha256", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each normalised text: the one with the largest id. Columns
    and their order stay. Of fully tied rows (equal text and id) one stays."""
    own_id, own_sha, id_, sha, kept = free_names(docs, "id", "sha", "doc", "text", "kept")
    marks = duplicate_groups(docs, id_col, text_col)
    marks = saved(marks.where("group_size > 1").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha), F.col("kept").alias(kept)).distinct(), "marks")
    keyed = docs.select("*", F.col(id_col).alias(id_), F.sha2(normalised(F.col(text_col)), 256).alias(sha))
    if marks.count() <= BROADCAST_SUSPECTS:
        marks = F.broadcast(marks)
    joined = keyed.join(marks, F.col(sha).eqNullSafe(F.col(own_sha)) & F.col(id_).eqNullSafe(F.col(own_id)), "left")
    winners = joined.where(F.col(kept)).dropDuplicates([id_, sha])
    return joined.where(F.col(kept).isNull()).union(winners).select(*docs.columns)

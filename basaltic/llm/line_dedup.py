"""Removal of runs of lines that occurred before, by winnowing over line hashes.

A run counts from ``LEAST_WORDS`` words. Windows are the shortest stretches of lines of that
many words, from each line on and up to each line; the line with the smallest hash in a window
(the first of equal ones) is selected, its hash a fingerprint. Every run that counts, wherever
it stands, holds the same windows and so the same selected lines. Only they are shuffled first:
where a fingerprint stands at two or more places, those positions are joined back to their
texts and extended both ways, over each window in which the position is the selected one, and
the extensions are compared line by line through a 128-bit digest of their lines. Of equal
extensions the first by document id, then place, stays; the others are matched. Matched windows
overlap along a repeated run and reach both its ends, so their union is the run as far as it
goes, and a line goes exactly if it lies in some stretch of ``LEAST_WORDS`` words or more that
stood earlier. Positions are matched through the digest and never in pairs, so a line that a
third of all texts hold costs no more than its rows. Equal texts are taken apart once; the
later ones go as a whole if they have so many words. Texts are dealt to their places and their
spans by shuffles at every size: a broadcast would suit small tables only.

Lines are compared without white space at their ends; blank ones don't count, and go with the
lines around them. Cases: a null text stays null and counts as without lines; rows with equal
id and text are one document and get the same result; null ids come first; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltic.llm.common import saved
from basaltic.llm.tokens import settle

LEAST_WORDS = 50
#: Of a text: its lines that aren't blank (16 bytes each of a digest, the number of words, the
#: number of the line), and the selected ones with their fingerprints.
LINES = "doc_id long, h binary, digests binary, words binary, numbers binary, fps array<long>, places array<int>"
RUNS = "doc_id long, h binary, win binary, first int, last int"


def lines_of(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Digests, numbers of words and numbers of the lines that aren't blank."""
    from xxhash import xxh3_128_digest

    digests, words, numbers = [], [], []
    for n, line in enumerate(text.split("\n")):
        if line := line.strip():
            digests.append(xxh3_128_digest(line))
            words.append(len(line.split()))
            numbers.append(n)
    return b"".join(digests), np.array(words, np.int32), np.array(numbers, np.int32)


def windows(words: np.ndarray, least_words: int) -> list[tuple[int, int]]:
    """(start, end) of each shortest stretch of so many words, from each line on and up to each."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    if total[-1] < least_words:
        return []
    until = np.searchsorted(total, total[:-1] + least_words).tolist()
    since = (np.searchsorted(total, total[1:] - least_words, "right") - 1).tolist()
    return sorted({(a, b) for a, b in enumerate(until) if b < len(total)} | {(a, b) for b, a in enumerate(since, 1) if a >= 0})


def selected(spans: list[tuple[int, int]], hashes: list[int]) -> list[int]:
    """For each window the place of its smallest hash, the first of equal ones. Both ends of
    the windows, in order, never move back, so a queue of falling candidates finds them all in
    one pass."""
    queue, at, out = deque(), 0, []
    for a, b in spans:
        while at < b:
            while queue and hashes[queue[-1]] > hashes[at]:
                queue.pop()
            queue.append(at)
            at += 1
        while queue[0] < a:
            queue.popleft()
        out.append(queue[0])
    return out


def fingerprints(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<i8")[::2]


def select(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 1_000) for a in range(0, batch.num_rows, 1_000)):
                columns = [[] for _ in range(5)]
                for t in part.column(2):
                    digests, words, numbers = lines_of(t.as_py() or "")
                    hashes = fingerprints(digests)
                    places = sorted(set(selected(windows(words, least_words), hashes.tolist())))
                    for c, x in zip(columns, (digests, words.tobytes(), numbers.tobytes(), hashes[places] if places else [], places), strict=True):
                        c.append(x)
                kinds = [pa.binary()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["doc_id", "h", "digests", "words", "numbers", "fps", "places"])
            settle()

    return run


def extend(least_words: int):
    """Texts and the places in them that recur to the windows that select such a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                at, wins, firsts, lasts = [], [], [], []
                for i, (digests, words, numbers, recurring) in enumerate(zip(*(part.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                    recurring, numbers = set(recurring), np.frombuffer(numbers, np.int32)
                    spans = windows(np.frombuffer(words, np.int32), least_words)
                    for (a, b), place in zip(spans, selected(spans, fingerprints(digests).tolist()), strict=True):
                        if place in recurring:
                            at.append(i)
                            wins.append(xxh3_128_digest(digests[16 * a : 16 * b]))
                            firsts.append(numbers[a])
                            lasts.append(numbers[b - 1])
                keep = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(keep), part.column(1).take(keep), pa.array(wins, pa.binary()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())],
                    names=["doc_id", "h", "win", "first", "last"],
                )
            settle()

    return run


def cut(text: str | None, spans: list | None) -> tuple[str | None, int, int]:
    """``text`` without the lines of ``spans``, its number of lines and that of deleted ones."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not spans:
        return text, len(lines), 0
    gone = set()
    for s in spans:
        gone.update(range(s["first"], s["last"] + 1))
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def apply_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(a, 1_000) for a in range(0, batch.num_rows, 1_000)):
            done = [cut(t.as_py(), s.as_py()) for t, s in zip(part.column(1), part.column(2), strict=True)]
            text, n, gone = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "n_lines", "n_deleted", "text"])
        settle()


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, words, numbers) of texts that stood before to the run of all their lines."""
    for batch in batches:
        ends = [np.frombuffer(n, np.int32)[[0, -1]].tolist() for n in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([e[0] for e in ends], pa.int32()), pa.array([e[1] for e in ends], pa.int32())], names=["doc_id", "h", "first", "last"])


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted and the remaining text of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("h"), F.col(text_col).alias("text"))
    every = saved(rows.mapInArrow(select(least_words), LINES), "lines").where(F.size("places") > 0)
    same = [F.first(c).alias(c) for c in ("digests", "words", "numbers", "fps", "places")]
    texts = saved(every.groupBy("h").agg(F.min(F.struct("doc_id")).alias("least"), *same).withColumn("doc_id", F.col("least.doc_id")).drop("least"), "line-texts")
    copies = every.select("h", "doc_id", "numbers").join(texts.select("h", F.col("doc_id").alias("least")), "h").where(~F.col("doc_id").eqNullSafe(F.col("least")))
    gone = saved(copies.select("doc_id", "h", "numbers"), "line-copies").distinct().mapInArrow(whole_runs, "doc_id long, h binary, first int, last int")

    positions = texts.select("h", F.explode(F.arrays_zip("fps", "places")).alias("p")).select("h", F.col("p.fps").alias("fp"), F.col("p.places").alias("place"))
    repeated = saved(positions.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "line-fingerprints")
    recurring = positions.join(repeated, "fp", "left_semi").groupBy("h").agg(F.collect_list("place").alias("recurring"))
    joined = texts.join(recurring.hint("merge"), "h").select("doc_id", "h", "digests", "words", "numbers", "recurring")
    found = saved(joined.mapInArrow(extend(least_words), RUNS), "line-windows")
    place = F.struct("doc_id", "h", "first")
    earliest = saved(found.groupBy("win").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("win", "least"), "line-earliest")
    later = found.join(earliest, "win").where(place > F.col("least")).select("doc_id", "h", "first", "last").distinct()
    spans = later.union(gone).groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = saved(spans.select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"), "spans"), "line-spans")
    joined = rows.join(spans.hint("merge"), (F.col("h") == F.col("s_h")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(apply_cuts, "doc_id long, n_lines long, n_deleted long, text string")

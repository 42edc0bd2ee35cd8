"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is its lower-cased words; its k-mers are runs of five words (one run of all words
if there are fewer), each labelled with its occurrence in the document. A sketch is the
``L`` smallest labelled k-mers under one hash, kept in text order, so that moved text counts
as changed; ``SKETCHES`` sketches are taken. Two documents are near copies if the longest
common sequence M of their k-mers within the band gives M / (n1 + n2 - M) >= 0.8; at that
similarity no alignment leaves the diagonal by more than (n1 + n2) / 9, which is the band.

At 0.8 a sketch agrees with probability 0.8^3 = 0.51, so a pair shares at least ``AGREE`` of
the 20 sketches that make buckets with probability 0.9998, and enough of all 128 marks with
0.9998 again. That needs documents without repeated k-mers: where one recurs, its occurrences
are numbered anew once one is gone, and sketches lose their order though the texts align. So
``LOOSE`` sketches make buckets without their order as well, which agree with 0.51 in any case,
and a pair in which a k-mer recurs shares at least ``LOOSE_AGREE`` of them (0.9998) and has no
other filter but the bound by odd sketches, which no near copies fail. Loose buckets without a
document in which a k-mer recurs are dropped.

Equal texts are one class from the start. First each bucket's members are compared with its
most central one, whose buckets hold the most; linked classes are merged; then every pair of a
bucket whose classes still differ and that can be near copies by these tests is compared as
well. There a document leaves its ``AGREE`` - 1 largest buckets (``LOOSE_AGREE`` - 1 loose
ones): of the buckets that a pair shares the smallest has at least as many larger ones on
either side, so no pair is lost, and the buckets of common passages shrink. A group of many near
copies costs one comparison for each member and bucket; pairs that aren't near copies cost
sketch comparisons inside the join, and hardly any leave it; nothing is capped.

Cases: a null text counts as empty; texts without words are near copies of equal texts only;
rows with a null id take part, and a class's id is its smallest id that is not null; repeated
rows are copies (``deduplicate`` keeps one row); an empty table gives an empty result; other
columns are carried by ``deduplicate`` and ignored by ``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltic.llm.common import connected_components, free_names, saved
from basaltic.llm.tokens import forget, settle, sole

WORDS, SIMILARITY = 5, 0.8
#: Sketches that make buckets, their k-mers, and how many a pair must share.
SKETCHES, L, AGREE = 20, 3, 3
#: The first of them that make buckets without the order of their k-mers, too, and how many of
#: those a pair must share in which a k-mer recurs.
LOOSE, LOOSE_AGREE = 16, 2
#: All sketches, of which a pair must share so many; the second number is for fewer than
#: ``SHORT`` k-mers. Both stand three and a half deviations below what 0.8 lets expect.
MARKS, MARKS_AGREE, SHORT, SHORT_AGREE = 128, 44, 50, 32
#: Bits of the odd sketch.
PARITY = 2_048
MEMO_WORDS = 300_000
#: Largest number of classes whose keys are broadcast to pick their texts (about 60 bytes each).
BROADCAST_CLASSES = 200_000

U = np.uint64
_RNG = np.random.default_rng(20)
ODD = _RNG.integers(0, 1 << 63, WORDS + MARKS, dtype=np.uint64) * U(2) + U(1)
STEP = ODD[:WORDS]
SPIN = ODD[WORDS:]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    return x * U(0xD6E8FEB86659FD93)


class Hasher:
    """Word hashes, the same in every process, with a bounded memo."""

    def __init__(self) -> None:
        from xxhash import xxh3_64_intdigest

        self.digest, self.memo = xxh3_64_intdigest, {}

    def words(self, text: str) -> np.ndarray:
        words, memo = text.lower().split(), self.memo
        if len(memo) > MEMO_WORDS:
            self.memo = memo = {}
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            memo.update((w, self.digest(w)) for w in set(words).difference(memo))
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """One hash for each run of five words; of fewer words, one for all."""
    n = len(words)
    if not n:
        return words
    count, size = max(1, n - WORDS + 1), min(n, WORDS)
    out = words[:count] * STEP[0]
    for j in range(1, size):
        out = out + words[j : j + count] * STEP[j]
    return mix(out)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """K-mers with their occurrence number mixed in; first occurrences stay as they are, so that
    they equal those of a document in which nothing recurs."""
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    new = np.ones(len(kmers), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if new.all():
        return kmers
    at = np.arange(len(kmers))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(kmers)
    out[order] = np.where(nth > 0, mix(ordered + nth.astype(np.uint64) * U(0x9E3779B97F4A7C15)), ordered)
    return out


def parity(kmers: np.ndarray) -> np.ndarray:
    """An odd sketch: each labelled k-mer turns one of ``PARITY`` bits. Two of them differ in no
    more bits than the k-mers that only one document has, so this filter loses no pair."""
    turns = np.bincount((kmers >> U(24)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(turns.astype(np.uint8)).view(np.int64)


def sketches(kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each sketch of labelled k-mers, of its number and its k-mers in text order,
    and one for each of the first ``LOOSE`` in which their order doesn't count."""
    n = len(kmers)
    if not n:
        return kmers, kmers
    kept = min(L, n)
    keys, loose = np.empty(MARKS, np.uint64), []
    step = max(1, min(MARKS, 400_000 // n))
    for s in range(0, MARKS, step):
        spin = SPIN[s : s + step]
        spun = kmers[None, :] * spin[:, None]
        spun ^= spun >> U(31)
        spun *= U(0x9FB21C651E98DF25)
        places = np.sort(np.argpartition(spun, kept - 1, 1)[:, :kept], 1) if kept < n else np.tile(np.arange(n), (len(spin), 1))
        key = np.full(len(places), kept, np.uint64)
        for j in range(kept):
            key = mix(key * U(31) + kmers[places[:, j]])
        keys[s : s + step] = mix(key + spin)
        if s < LOOSE:
            loose.append(mix(mix(kmers[places]).sum(1, dtype=np.uint64) + ~spin))
    return keys, np.concatenate(loose)[:LOOSE]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """M / (n1 + n2 - M) of two k-mer sequences, 0 if surely below the threshold."""
    n1, n2 = len(a), len(b)
    if not n1 or not n2:
        return 0.0
    in_b, in_a = np.isin(a, b), np.isin(b, a)
    if (most := min(int(in_b.sum()), int(in_a.sum()))) < SIMILARITY * (n1 + n2 - most):
        return 0.0
    at_a, at_b = np.flatnonzero(in_b), np.flatnonzero(in_a)  # only k-mers of both can match
    a, b = a[at_a], b[at_b]
    m = len(a) if len(a) == len(b) and (a == b).all() and (np.abs(at_a - at_b) <= (n1 + n2) // 9).all() else aligned(a, b, at_a, at_b, (n1 + n2) // 9)
    return m / (n1 + n2 - m)


def aligned(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, band: int) -> int:
    """Longest common sequence of ``a`` and ``b`` in which matched places differ by ``band`` at
    most; a row at a time, all columns in the bits of an integer."""
    masks: dict[int, int] = {}
    for i, k in enumerate(a.tolist()):
        masks[k] = masks.get(k, 0) | 1 << i
    low = np.searchsorted(at_a, at_b - band, "left").tolist()
    high = np.searchsorted(at_a, at_b + band, "right").tolist()
    full = (1 << len(a)) - 1
    v = full
    for k, lo, hi in zip(b.tolist(), low, high, strict=True):
        match = v & masks[k] & ((1 << hi) - 1 >> lo << lo)
        v = ((v + match) | (v - match)) & full
    return len(a) - v.bit_count()


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, text to doc_id, h, n, twice (whether a k-mer recurs), keys (of buckets), loose
    (of buckets, without order), marks (short forms of all), odd."""
    hasher = sole(("kmers",), Hasher)
    for batch in batches:
        for part in (batch.slice(a, 1_000) for a in range(0, batch.num_rows, 1_000)):
            n, twice, keys, loose, marks, odd = [], [], [], [], [], []
            for t in part.column(2):
                plain = shingles(hasher.words(t.as_py()))
                kmers = labelled(plain)
                n.append(len(kmers))
                twice.append(kmers is not plain)
                found, free = sketches(kmers)
                loose.append(free.view(np.int64))
                odd.append(parity(kmers))
                keys.append(found[:SKETCHES].view(np.int64))
                marks.append((found >> U(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(twice), pa.array(keys, pa.list_(pa.int64())), pa.array(loose, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int32())), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "h", "n", "twice", "keys", "loose", "marks", "odd"])
        settle()


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, text to cid and words, four bytes each."""
    hasher = sole(("kmers",), Hasher)
    for batch in batches:
        for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([(hasher.words(t.as_py()) >> U(32)).astype(np.uint32).tobytes() for t in part.column(1)], pa.binary())], names=["cid", "words"])
        settle()


def words_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32).astype(np.uint64)


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and their words to the pairs that are near copies."""
    last, ka = None, None
    forget()
    for batch in batches:
        hit_a, hit_b = [], []
        for a, b, wa, wb in zip(*(batch.column(i) for i in range(4)), strict=True):
            if a.as_py() != last:
                last, ka = a.as_py(), shingles(words_of(wa.as_py()))
            if similarity(ka, shingles(words_of(wb.as_py()))) >= SIMILARITY:
                hit_a.append(last)
                hit_b.append(b.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(hit_a, pa.int64()), pa.array(hit_b, pa.int64())], names=["a", "b"])
        settle()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("h"), text.alias("text"))


def _agree(a: str, b: str) -> Column:
    """Whether structs ``a`` and ``b`` (n, twice, keys, loose, marks, odd) can be near copies:
    their odd sketches differ in few enough bits (half of them are looked at first), and they
    share enough sketches."""
    shared = lambda field: F.size(F.array_intersect(f"{a}.{field}", f"{b}.{field}"))
    turned = lambda upto: sum((F.bit_count(F.get(f"{a}.odd", F.lit(i)).bitwiseXOR(F.get(f"{b}.odd", F.lit(i)))) for i in range(upto)), F.lit(0))
    least = F.when(F.least(f"{a}.n", f"{b}.n") < SHORT, SHORT_AGREE).otherwise(MARKS_AGREE)
    recurs, most, whole = F.col(f"{a}.twice") | F.col(f"{b}.twice"), F.col(f"{a}.n") + F.col(f"{b}.n"), PARITY // 64
    enough = F.when(recurs, shared("loose") >= LOOSE_AGREE).otherwise((shared("keys") >= AGREE) & (shared("marks") >= least))
    return (turned(whole // 2) * 9 <= most) & (turned(whole) * 9 <= most) & enough


def _near_in_length(a: str, b: str) -> Column:
    return (F.col(a) >= F.col(b) * SIMILARITY - 1e-6) & (F.col(b) >= F.col(a) * SIMILARITY - 1e-6)


def links(pairs: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose texts are near copies."""
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = saved(reps.select("cid", "h", "rep").join(wanted, "cid"), "omh-wanted")
    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, (rows["h"] == wanted["h"]) & rows["doc_id"].eqNullSafe(wanted["rep"])).select("cid", "text")
    held = saved(texts.mapInArrow(sequences, "cid long, words binary").groupBy("cid").agg(F.min("words").alias("words")), "omh-words")
    first = pairs.join(held.select(F.col("cid").alias("a"), F.col("words").alias("wa")), "a")
    both = first.join(held.select(F.col("cid").alias("b"), F.col("words").alias("wb")), "b")
    return both.select("a", "b", "wa", "wb").mapInArrow(verify, "a long, b long")


def _pairs_left(placed: DataFrame, side: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes that can be near copies, within buckets out of
    ``placed`` (loose, key, size, cid, class)."""
    largest = F.row_number().over(Window.partitionBy("loose", "cid").orderBy(F.desc("size"), "key"))
    placed = saved(placed.withColumn("place", largest).where(F.col("place") >= F.when(F.col("loose"), LOOSE_AGREE).otherwise(AGREE)), "omh-placed")
    counted = placed.groupBy("loose", "key", "class").agg(F.count(F.lit(1)).alias("n"))
    mixed = counted.groupBy("loose", "key").agg(F.count(F.lit(1)).alias("classes"), F.max_by("class", "n").alias("major")).where("classes > 1").drop("classes")
    rows = placed.select("loose", "key", "cid", "class").join(saved(mixed, "omh-mixed"), ["loose", "key"]).join(side, "cid")
    rows = saved(rows.select("loose", "key", "cid", "class", (F.col("class") != F.col("major")).alias("minor"), "of"), "omh-open")
    ends = [rows.select("loose", "key", *[F.col(c).alias(f"{c}_{end}") for c in ("cid", "class", "minor", "of")]) for end in "ab"]
    # one of a pair stands outside the bucket's largest class, so that a large class isn't joined with itself
    once = ~F.col("minor_b") | (F.col("cid_a") < F.col("cid_b"))
    open_ = once & (F.col("class_a") != F.col("class_b")) & (~F.col("loose") | F.col("of_a.twice") | F.col("of_b.twice"))
    joined = ends[0].where("minor_a").join(ends[1], ["loose", "key"]).where(open_ & _near_in_length("of_a.n", "of_b.n") & _agree("of_a", "of_b"))
    return joined.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()


def _linked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """doc_id and h of every row; the different texts (cid, h, rep, copies); the links (a, b) of
    cids that were verified, which join all near copies; (node, component) of linked cids."""
    rows = _rows(docs, id_col, text_col)
    sketched = saved(rows.mapInArrow(sketch, "doc_id long, h binary, n long, twice boolean, keys array<long>, loose array<long>, marks array<int>, odd array<long>"), "omh-sketches")
    reps = sketched.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n", "twice", "keys", "loose", "marks", "odd")))
    reps = saved(reps.withColumn("cid", F.monotonically_increasing_id()), "omh-classes")

    ordered = reps.where("not twice").select("cid", "n", "twice", F.lit(False).alias("loose"), F.explode("keys").alias("key"))
    dealt = ordered.union(reps.select("cid", "n", "twice", F.lit(True).alias("loose"), F.explode("loose").alias("key")))
    shared = dealt.groupBy("loose", "key").agg(F.count(F.lit(1)).alias("size"), F.bool_or("twice").alias("recurs")).where("size > 1 and (recurs or not loose)")
    members = saved(dealt.drop("twice").join(saved(shared.drop("recurs"), "omh-shared"), ["loose", "key"]), "omh-members")
    scores = members.groupBy("cid").agg(F.sum("size").alias("score"))
    members = saved(members.join(scores, "cid"), "omh-members")
    leads = saved(members.groupBy("loose", "key").agg(F.max_by(F.struct("cid", "n"), F.struct("score", -F.col("cid"))).alias("lead")), "omh-leads")

    star = members.join(leads, ["loose", "key"]).where("cid <> lead.cid").where(_near_in_length("n", "lead.n"))
    star = star.select(F.col("lead.cid").alias("a"), F.col("cid").alias("b")).distinct()
    star = saved(star, "omh-star")
    side = reps.select("cid", F.struct("n", "twice", "keys", "loose", "marks", "odd").alias("of"))
    star = star.join(side.select(F.col("cid").alias("a"), F.col("of").alias("of_a")), "a").join(side.select(F.col("cid").alias("b"), F.col("of").alias("of_b")), "b")
    star = saved(star.where(_agree("of_a", "of_b")).select("a", "b"), "omh-star")
    found = saved(links(star, rows, reps), "omh-links")
    merged = connected_components(found, "omh-components")

    placed = members.join(merged, F.col("cid") == F.col("node"), "left").select("loose", "key", "size", "cid", F.coalesce("component", "cid").alias("class"))
    cross = _pairs_left(placed, side)
    cross = saved(cross.join(star, ["a", "b"], "left_anti"), "omh-cross")
    more = saved(links(cross, rows, reps), "omh-links")
    if not more.isEmpty():
        found = found.union(more)
        merged = connected_components(found, "omh-components")
    return sketched.select("doc_id", "h"), reps.select("cid", "h", "rep", "copies"), found, merged


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and h of every row, with its class: class_id, class_size, whether its text leads
    the class, and the number of its text's verified links."""
    listed, reps, found, merged = _linked(docs, id_col, text_col)
    ends = found.select(F.col("a").alias("end")).union(found.select("b")).groupBy("end").agg(F.count(F.lit(1)).alias("links"))
    reps = reps.join(merged, F.col("cid") == F.col("node"), "left").join(ends, F.col("cid") == F.col("end"), "left")
    grouped = saved(reps.select("h", "rep", "copies", F.coalesce("component", "cid").alias("class"), F.coalesce("links", F.lit(0)).alias("n_links")), "omh-grouped")
    lead = F.min(F.struct(F.col("rep").isNull(), F.col("rep"), F.col("h"))).alias("lead")
    named = grouped.groupBy("class").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), lead)
    by_text = saved(grouped.join(named, "class").select("h", "class_id", "class_size", "n_links", (F.col("h") == F.col("lead.h")).alias("leads")), "omh-named")
    return listed.join(by_text, "h", "left")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest id of its class), class_size, kept, and n_links (verified
    links of its text to different texts, see ``pairs``) of every row."""
    return _classes(docs, id_col, text_col).select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_links")


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b): the links between different texts that were verified, each text named by
    the smallest id that has it. They join all near copies; a link between two texts that
    others join already need not be among them."""
    _, reps, found, _ = _linked(docs, id_col, text_col)
    name = lambda c: reps.select(F.col("cid").alias(c), F.col("rep").alias("doc_" + c))
    return found.join(name("a"), "a").join(name("b"), "b").select("doc_a", "doc_b")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each class of near copies: the one with the smallest id. Of
    rows that tie in id the one with the smallest text hash stays, of equal rows any. Columns
    and their order stay."""
    own_id, own_h, doc, text, kept = free_names(docs, "id", "h", "doc", "text", "kept")
    found = _classes(docs, id_col, text_col).where("class_size > 1")
    wins = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    marks = saved(found.select(F.col("doc_id").alias(own_id), F.col("h").alias(own_h), wins.alias(kept)).distinct(), "omh-marks")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_CLASSES else marks
    keyed = docs.select("*", F.col(id_col).cast("long").alias(doc), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias(text))
    joined = keyed.join(marks, (F.col(text) == F.col(own_h)) & F.col(doc).eqNullSafe(F.col(own_id)), "left")
    winners = joined.where(F.col(kept)).dropDuplicates([doc, text])
    return joined.where(F.col(kept).isNull()).union(winners).select(*docs.columns)

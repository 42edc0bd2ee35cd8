"""Language identification by unigram piece models that sum over all segmentations.

The pieces are a fixed public vocabulary: all letter-only pieces of a sentencepiece model
(``▁`` marks a word's start), lower-cased, and every single letter. Each language has a
probability for each piece, fitted by expectation-maximisation on word counts. A word is a run
of letters; its likelihood is the sum over all ways to cut it into pieces, found by the forward
algorithm over the whole word. A text's likelihood is the product over its words, and the best
language's share of the total, with equal priors, is the score.

Learning reads a bounded sample: about ``SAMPLE_DOCS`` documents of each of the
``MOST_LANGUAGES`` commonest languages, chosen by a hash of their id, out of those that
``learnable`` admits. Prediction reads whole texts only.

Cases: a null text or one without a letter is ``und`` with score 0; with nothing to learn
from all are ``und``; rows without a language, or with an id that is null, are not learned from
(they are predicted); ties go to the first language in order of name; letters that no piece
holds count alike in all languages; words over ``LONG_WORD`` letters are not learned from, but
scored like others; repeated rows and other columns change nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltic.llm.tokens import MARKS, STRETCH, Memo, batches_of, bounds, large, settle, sole, stretches, words_of

UNKNOWN = "und"
#: About so many documents of each language are learned from, and languages at most.
SAMPLE_DOCS, MOST_LANGUAGES = 600, 256
#: Words up to this length are scored many at once.
LONG_WORD = 64
ROUNDS = 4
#: Expected count that every piece has beside its own.
SMOOTHING = 0.05
#: Bytes of the scores that a worker keeps, and of those of the words that it scores at once.
MEMO_BYTES, SLICE_BYTES = 12 << 20, 16 << 20

WORD = regex.compile(r"\p{L}+")


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def vocabulary(model_path: str) -> dict[str, int]:
    """Pieces by number; 0 is no piece and 1 any letter that is no piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return {p: i for i, p in enumerate(sorted(p for p in pieces if p == "▁" or WORD.fullmatch(p.removeprefix("▁"))), 2)}


class Trie:
    """Pieces by their letters: a hash table from (node, letter) to the next node."""

    def __init__(self, pieces: dict[str, int]) -> None:
        children: dict[tuple[int, int], int] = {}
        numbers = [0]
        for piece, number in pieces.items():
            node = 0
            for c in piece:
                node = children.setdefault((node, ord(c)), len(children) + 1)
                if node == len(numbers):
                    numbers.append(0)
            numbers[node] = number
        self.numbers = np.array(numbers, np.int32)
        self.shift = 64 - max(1, (4 * len(children) + 4).bit_length())
        self.keys = np.full(1 << 64 - self.shift, -1, np.int64)
        self.nodes = np.zeros(len(self.keys), np.int32)
        self.probes = 1
        for (node, c), child in children.items():
            key = node << 21 | c
            slot, probe = int(self._slots(np.array([key]))[0]), 1
            while self.keys[slot] >= 0:
                slot, probe = (slot + 1) % len(self.keys), probe + 1
            self.keys[slot], self.nodes[slot] = key, child
            self.probes = max(self.probes, probe)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The next nodes; 0 where there is none."""
        keys = nodes.astype(np.int64) << 21 | letters
        slots = self._slots(keys)
        found = np.where(self.keys[slots] == keys, self.nodes[slots], 0)
        left = np.flatnonzero((found == 0) & (self.keys[slots] >= 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            slots[left] = (slots[left] + 1) % len(self.keys)
            held = self.keys[slots[left]]
            hit = held == keys[left]
            found[left[hit]] = self.nodes[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        return found


def lattice(words: list[str], trie: Trie) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For words of one length: for each place, and each length of piece from 1 on, which words
    have a piece there, and its number."""
    n = len(words[0])
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.int64)
    out = []
    for start in range(n):
        rows, nodes, found = np.arange(len(words)), np.zeros(len(words), np.int32), []
        for end in range(start, n):
            nodes = trie.step(nodes, letters[rows, end])
            alive = nodes > 0
            numbers = trie.numbers[nodes]
            if end == start:  # a letter that is no piece by itself
                found.append((rows, np.where(numbers > 0, numbers, 1)))
            else:
                hit = numbers > 0
                found.append((rows[hit], numbers[hit]))
            rows, nodes = rows[alive], nodes[alive]
            if not len(rows):
                break
        out.append(found)
    return out


def forward(grid: list, count: int, p: np.ndarray) -> list[np.ndarray]:
    """For each length of prefix, its likelihood (words, languages). p: (pieces, languages)."""
    alpha = [np.zeros((count, p.shape[1])) for _ in range(len(grid) + 1)]
    alpha[0] += 1
    for start, found in enumerate(grid):
        for size, (rows, numbers) in enumerate(found, 1):
            if len(rows) == count:
                alpha[start + size] += alpha[start] * p[numbers]
            elif len(rows):
                alpha[start + size][rows] += alpha[start][rows] * p[numbers]
    return alpha


def log_likelihood(word: str, pieces: dict[str, int], longest: int, p: np.ndarray) -> np.ndarray:
    """The same for one word of any length, in logarithms by language: only the likelihoods of
    the last ``longest`` prefixes are held, scaled together for each language."""
    alpha, scale = np.zeros((longest + 1, p.shape[1])), np.zeros(p.shape[1])
    alpha[0] = 1
    for start in range(len(word)):
        here = alpha[start % (longest + 1)].copy()
        alpha[start % (longest + 1)] = 0
        if start % 16 == 15:
            scale += np.log(here)
            alpha /= here
            here[:] = 1
        for size in range(1, min(longest, len(word) - start) + 1):
            if number := pieces.get(word[start : start + size], int(size == 1)):
                alpha[(start + size) % (longest + 1)] += here * p[number]
    return scale + np.log(alpha[len(word) % (longest + 1)])


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else ()


def fit(counts: dict[str, dict[str, int]], pieces: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the piece probabilities (pieces, languages and, last, the same
    for every piece); counts: of words by language."""
    langs, size, trie = sorted(counts), len(pieces) + 2, Trie(pieces)
    table = np.zeros((size, len(langs) + 1))
    for k, lang in enumerate(langs):
        words = ["▁" + w for w in counts[lang] if len(w) < LONG_WORD]
        weight = np.array([n for w, n in counts[lang].items() if len(w) < LONG_WORD], float)
        grids = [(weight[at, None], lattice([words[i] for i in at], trie)) for at in by_length(words)]
        p = np.full((size, 1), 1.0 / size)
        p[0] = 0
        for _ in range(ROUNDS):
            expected = np.full(size, SMOOTHING)
            for weights, grid in grids:
                count, n = len(weights), len(grid)
                alpha = forward(grid, count, p)
                share = weights / np.maximum(alpha[n], 1e-300)
                beta = [np.zeros((count, 1)) for _ in range(n)] + [np.ones((count, 1))]
                for start in range(n - 1, -1, -1):
                    for length, (rows, numbers) in enumerate(grid[start], 1):
                        rest = p[numbers] * beta[start + length][rows]
                        beta[start][rows] += rest
                        expected += np.bincount(numbers, (alpha[start][rows] * rest * share[rows])[:, 0], size)
            expected[0] = 0
            p = (expected / expected.sum())[:, None]
        table[:, k] = p[:, 0]
    table[1:, -1] = 1 / (size - 1)
    table[1] = table[1].mean()  # letters no piece holds tell nothing
    return langs, table


def word_counts(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int) -> dict[str, dict[str, int]]:
    """Counts of words by language over the sample."""
    common = labelled.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col).limit(MOST_LANGUAGES)
    totals = {r[0]: r[1] for r in common.collect()}
    if not totals:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, sample_docs / n))])
    drawn = labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 20)) < F.element_at(share, F.col(lang_col)) * (1 << 20))
    words = drawn.select(F.col(lang_col).alias("lang"), F.explode(F.split(F.lower(text_col), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counts: dict[str, dict[str, int]] = {lang: {} for lang in totals}
    for lang, word, n in words.groupBy("lang", "word").count().toLocalIterator():
        counts[lang][word] = n
    return counts


class Scorer:
    """Log-likelihoods of texts by language, with a bounded memo of words."""

    def __init__(self, langs: list[str], table: np.ndarray, pieces: dict[str, int]) -> None:
        self.langs, self.p, self.pieces = langs, table, pieces
        self.trie, self.longest = Trie(pieces), max(map(len, pieces))
        #: Of each word that the memo knows, in lower case without marks: its log-likelihoods
        #: and, last, the number of its runs of letters.
        self.rows = np.zeros((1, table.shape[1] + 1))
        self.memo = Memo(MEMO_BYTES // self.rows.nbytes)
        self.slice_bytes = max(1_000, min(2_000_000, 4 * SLICE_BYTES // self.rows.nbytes))

    def _learn(self, cores: pa.Array) -> None:
        plain = pc.match_substring_regex(cores, r"^\p{L}+$").to_numpy(zero_copy_only=False)
        parts, owner = [], []
        for i, (core, whole) in enumerate(zip(cores.to_pylist(), plain.tolist(), strict=True)):
            for word in (core,) if whole else WORD.findall(core):
                parts.append("▁" + word)
                owner.append(i)
        logs = np.zeros((len(parts), self.p.shape[1]))
        for places in by_length(parts):
            if len(parts[places[0]]) > LONG_WORD:
                for i in places:
                    logs[i] = log_likelihood(parts[i], self.pieces, self.longest, self.p)
                continue
            for a in range(0, len(places), 20_000):
                at = places[a : a + 20_000]
                logs[at] = np.log(np.maximum(forward(lattice([parts[i] for i in at], self.trie), len(at), self.p)[-1], 1e-300))
        out = np.zeros((len(cores), self.rows.shape[1]))
        np.add.at(out[:, :-1], owner, logs)
        out[:, -1] = np.bincount(owner, minlength=len(cores))
        self.rows = np.concatenate([self.rows, out])
        self.memo.add(cores)

    def _sums(self, texts: pa.Array) -> np.ndarray:
        """Log-likelihoods and number of words of each text."""
        words, counts = words_of(texts, spaced=False)
        coded = words.dictionary_encode()
        cores = pc.utf8_lower(pc.utf8_rtrim(coded.dictionary, MARKS)).dictionary_encode()
        kept = self.memo.trim()
        if kept is not None:
            self.rows = self.rows[:kept].copy()
        at = self.memo.find(cores.dictionary)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at = at.copy()
            at[missing] = np.arange(len(self.rows), len(self.rows) + len(missing))
            self._learn(cores.dictionary.take(pa.array(missing)))
        of_word = at[cores.indices.to_numpy()][coded.indices.to_numpy()]
        return np.add.reduceat(self.rows[of_word], bounds(counts)[:-1], 0)  # no text is without a word, if an empty one

    def sums(self, texts: pa.Array) -> np.ndarray:
        texts, out = pc.fill_null(large(texts), ""), []
        for part in batches_of(texts, self.slice_bytes):
            if len(part) > 1 or pc.binary_length(part)[0].as_py() <= STRETCH:
                out.append(self._sums(part))
            else:
                out.append(sum(self._sums(large([s])) for s in stretches(part[0].as_py(), self.slice_bytes)))
        return np.concatenate(out) if out else np.zeros((0, self.rows.shape[1]))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether it explains the text better than chance does: no
        language has to tie with the others, nor all pieces to be as likely as each other."""
        sums, k = self.sums(texts), len(self.langs)
        empty = sums[:, -1] == 0
        best = np.argmax(sums[:, :k], 1)
        top = sums[np.arange(len(sums)), best]
        score = np.where(empty, 0.0, 1 / np.exp(sums[:, :k] - top[:, None]).sum(1))
        tie = (k > 1) & (sums[:, :k].min(1) == top)
        langs = [UNKNOWN if e else self.langs[b] for e, b in zip(empty.tolist(), best.tolist(), strict=True)]
        return langs, score, ~empty & ~tie & (top > sums[:, k])


def scorer_of(model: tuple) -> Scorer:
    """The worker's scorer; the model is kept with it, so that its identity stays its own."""
    return sole(("languages", id(model)), lambda: (model, Scorer(*model)))[1]


def learn(learnable: DataFrame, model_path: str, id_col: str, text_col: str, lang_col: str, sample_docs: int):
    """The model (languages, piece probabilities, pieces), on every executor."""
    labelled = learnable.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    pieces = vocabulary(model_path)
    langs, p = fit(word_counts(labelled, id_col, text_col, lang_col, sample_docs), pieces)
    return learnable.sparkSession.sparkContext.broadcast((langs, p, pieces))


def predict(docs: DataFrame, learnable: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``. learnable: rows whose ``lang_col``
    may be learned from."""
    model = learn(learnable, model_path, id_col, text_col, lang_col, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            langs, scores, _ = scorer_of(model.value).predict(batch.column(1)) if model.value[0] else ([UNKNOWN] * n, np.zeros(n), None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])
            settle()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def recognised(docs: DataFrame, learnable: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` whose language the model recognises: those with a letter which some
    language explains better than the others and than a model in which all pieces are as likely
    as each other. With nothing to learn from every row with a letter stays. Rows without a
    language get the predicted one; columns and their order stay."""
    model = learn(learnable, model_path, id_col, text_col, lang_col, sample_docs)
    places = {c: i for i, c in enumerate(docs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, arrays = batch.column(places[text_col]), list(batch.columns)
            if model.value[0]:
                langs, _, known = scorer_of(model.value).predict(texts)
                old = arrays[places[lang_col]]
                arrays[places[lang_col]] = pc.coalesce(old, pa.array(langs, old.type))
                keep = pa.array(known)
            else:
                keep = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(keep)
            settle()

    return docs.mapInArrow(run, docs.schema)

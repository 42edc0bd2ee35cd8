"""Encoding of whole texts with the ``tokenizers`` library, word by word.

Neither kind of vocabulary that is known here has a token that reaches from a character that
is no white space into white space, so a text's ids are those of its words, each encoded once
while it stays in a bounded memo. Words, memo and ids are Arrow and NumPy arrays throughout. A
vocabulary whose splitting rules aren't those looked for at load is given whole texts.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in the memo (some 25 bytes each); when it is full, the first half is kept and the
#: rest forgotten.
MEMO_WORDS = 400_000
#: Texts longer than this are encoded in stretches that end at a safe boundary.
STRETCH = 1 << 20
#: Bytes of text that are taken apart at once.
BATCH_BYTES = 4_000_000
#: Words that are given to the library as one text.
GROUP = 256

#: A space between two characters that are no white space.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """``text`` cut at safe spaces, each stretch at least ``size`` long but the last; joined by
    one space they give the text again."""
    at = 0
    while len(text) - at > size and (found := _SAFE.search(text, at + size)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


#: Stands where a text is cut; texts that hold it are encoded whole.
CUT = "\x02"
#: White space, and white space other than a single space or line break.
_WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD_WHITE = rf"[{_WHITE}][{_WHITE}]|[\t\v\f\r\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"
WORD_END = rf"([^{_WHITE}])([{_WHITE}])"
#: One word with the space before it, and one without.
LED, BARE = rf"^ [^{_WHITE}]+$", rf"^[^{_WHITE}]+$"

#: Marks that are cut off a word's end, after letters and digits that neither lower-casing nor
#: composition turns into something else.
MARKS = ".,;:!?"
FIRM_END = r"[0-9A-Za-zÀ-ÖØ-öø-įı-ſΑ-ΡΣ-Ωα-ωА-яぁ-ゖァ-ヺ一-鿋가-힣]$"


def large(texts) -> pa.Array:
    return pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())


def words_of(rows: pa.Array, spaced: bool) -> tuple[pa.Array, np.ndarray]:
    """The words of ``rows`` and the number of each row's words. spaced: the words with the
    white space before them, which joined give the rows; otherwise without spaces and line
    breaks, and empty words between them."""
    if not spaced:
        cut = pc.split_pattern(pc.replace_substring(rows, "\n", " "), " ")
        return cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False)
    odd = pc.match_substring_regex(rows, ODD_WHITE)
    plain = pc.replace_substring(pc.replace_substring(rows, " ", CUT + " "), "\n", f"{CUT}\n{CUT}")
    if pc.any(odd).as_py():
        mixed = pc.replace_substring_regex(rows.filter(odd), WORD_END, rf"\1{CUT}\2")
        plain = pc.replace_with_mask(plain, odd, mixed)
    cut = pc.split_pattern(plain, CUT)
    return cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False)


def parts_of(words: pa.Array, lower: bool) -> tuple[pa.Array, pa.Array]:
    """Each of ``words`` without the marks at its end, and those marks. lower: in lower case
    where that is all ASCII."""
    core = pc.utf8_rtrim(words, MARKS)
    firm = pc.and_(pc.not_equal(core, words), pc.match_substring_regex(core, FIRM_END))
    core = pc.if_else(firm, core, words)
    marks = pc.if_else(firm, pc.utf8_slice_codeunits(words, -1), "")
    several = pc.and_(firm, pc.greater(pc.subtract(pc.binary_length(words), pc.binary_length(core)), 1))
    if pc.any(several).as_py():
        full = [w[len(c) :] for w, c in zip(words.filter(several).to_pylist(), core.filter(several).to_pylist(), strict=True)]
        marks = pc.replace_with_mask(marks, several, pa.array(full, marks.type))
    return (pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core) if lower else core), marks


class Memo:
    """Strings by number, in the order in which they came, the empty one first."""

    def __init__(self, most: int) -> None:
        self.most, self.keys = most, large([""])

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 where it isn't known."""
        return pc.fill_null(pc.index_in(words, self.keys), -1).to_numpy(zero_copy_only=False)

    def trim(self) -> int | None:
        """Forgets the latter half once the memo is full; how many it keeps then."""
        if len(self.keys) <= self.most:
            return None
        self.keys = pa.concat_arrays([self.keys[: self.most // 2]])
        return len(self.keys)

    def add(self, words: pa.Array) -> None:
        self.keys = pa.concat_arrays([self.keys, words])


def gather(starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the members of the lists ``at`` stand, one list after the other, and the length of
    each of them."""
    n = lengths[at]
    ends = np.cumsum(n)
    return np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0), n


def bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


#: What the splitting rules of the two known kinds of vocabulary look like.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def kind_of(rules: dict) -> str | None:
    """``spaced`` (byte-level, a word with the space before it), ``bare`` (lower case, white
    space dropped) or None, by the contents of a vocabulary's file."""
    model, normalizer, split = rules.get("model") or {}, rules.get("normalizer"), rules.get("pre_tokenizer") or {}
    tame = not rules.get("truncation") and not rules.get("padding") and not rules.get("post_processor")
    tame &= all(not t["normalized"] and not t["single_word"] and t["content"].startswith("<|") for t in rules.get("added_tokens", ()))
    if not tame or any(model.get(k) != v for k, v in _MODEL.items()):
        return None
    if normalizer is None and not model.get("end_of_word_suffix") and all(split.get(k) == v for k, v in _BYTE_LEVEL.items()):
        return "spaced"
    steps, parts = (normalizer or {}).get("normalizers", []), split.get("pretokenizers", [])
    wanted = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    first = {"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True}
    if model.get("end_of_word_suffix") == "</w>" and steps == wanted and len(parts) == 2 and parts[0] == first and all(parts[1].get(k) == v for k, v in (_BYTE_LEVEL | {"use_regex": False}).items()):
        return "bare"
    return None


class WordEncoder:
    """Ids of texts as unsigned 32-bit integers, the same as the library gives whole texts with
    ``add_special_tokens=False``. specials_as_text: special tokens' strings in a text are
    ordinary text, which by the library's default they are not."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS, specials_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.kind, self.specials = kind_of(rules), bool(rules.get("added_tokens")) and not specials_as_text
        del rules
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.spaced, self.size = self.kind == "spaced", self.tokenizer.get_vocab_size()
        self.memo, self.flat, self.lengths = Memo(memo_words), np.zeros(0, np.uint16 if self.size <= 1 << 16 else np.uint32), np.zeros(1, np.int64)
        #: Of each id: it ends a word, or (spaced) starts one with the space before it.
        self.edge = np.zeros(self.size, bool)
        if self.kind:
            for token, i in self.tokenizer.get_vocab().items():
                self.edge[i] = token.startswith("Ġ") if self.spaced else token.endswith("</w>")

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.flat.dtype) for a in range(0, len(texts), 1024) for e in self.tokenizer.encode_batch_fast(texts[a : a + 1024], add_special_tokens=False)]

    def _grouped(self, words: list[str], glue: str, edge: np.ndarray) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Words encoded many at once, told apart by the ids that ``edge`` marks: the places of
        those that come out, their ids one after the other, and the number of each one's ids."""
        places, flat, lengths = [], [], []
        groups = [words[a : a + GROUP] for a in range(0, len(words), GROUP)]
        for a in range(0, len(groups), 16):
            texts = [glue.join(g) for g in groups[a : a + 16]]
            for n, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), a):
                ids, size = np.array(e.ids, self.flat.dtype), len(groups[n])
                at = np.flatnonzero(edge[ids])
                if glue == "\n":  # breaks stand between words and are dropped
                    found, counts = np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1
                elif self.spaced:
                    found, counts = ids, np.diff(at, append=len(ids))
                else:
                    found, counts = ids, np.diff(at, prepend=-1)
                if len(counts) == size:
                    places += range(n * GROUP, n * GROUP + size)
                    flat.append(found)
                    lengths.append(counts)
        return places, flat, lengths

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Adds ``words`` to the memo and returns the number of each."""
        if self.spaced:
            kinds = [(LED, "", self.edge), (BARE, "\n", self._breaks())]
            kinds = [(pc.match_substring_regex(words, pattern), glue, edge) for pattern, glue, edge in kinds]
        else:
            kinds = [(pc.utf8_is_alpha(words), " ", self.edge)]
        order, flat, lengths, left = [], [self.flat], [self.lengths], np.ones(len(words), bool)
        for mask, glue, edge in kinds:
            at = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            places, ids, counts = self._grouped(words.take(pa.array(at)).to_pylist(), glue, edge)
            order.append(at[places])
            left[order[-1]] = False
            flat += ids
            lengths += counts
        order.append(np.flatnonzero(left))
        single = self._whole(words.take(pa.array(order[-1])).to_pylist())
        flat += single
        lengths.append(np.fromiter(map(len, single), np.int64, len(single)))
        order = np.concatenate(order).astype(np.int64)
        numbers = np.empty(len(words), np.int64)
        numbers[order] = np.arange(len(self.memo.keys), len(self.memo.keys) + len(words))
        self.memo.add(words.take(pa.array(order)))
        self.flat, self.lengths = np.concatenate(flat), np.concatenate(lengths)
        return numbers

    def _breaks(self) -> np.ndarray:
        marked = np.zeros(self.size, bool)
        marked[self.tokenizer.encode("\n", add_special_tokens=False).ids] = True
        return marked

    def _rows(self, rows: pa.Array) -> list[np.ndarray]:
        """Ids of texts that may be taken apart."""
        words, counts = words_of(rows, self.spaced)
        coded = words.dictionary_encode()
        core, marks = parts_of(coded.dictionary, lower=not self.spaced)
        units = pa.concat_arrays([core, marks]).dictionary_encode()
        kept = self.memo.trim()
        if kept is not None:
            self.lengths = self.lengths[:kept].copy()
            self.flat = self.flat[: self.lengths.sum()].copy()
        at = self.memo.find(units.dictionary)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at = at.copy()
            at[missing] = self._learn(units.dictionary.take(pa.array(missing)))
        n = len(core)
        of_word = at[units.indices.to_numpy()].reshape(2, n).T.ravel()  # each word's core, then its marks
        places, lengths = gather(bounds(self.lengths)[:-1], self.lengths, of_word)
        flat, lengths = self.flat[places], lengths.reshape(n, 2).sum(1)
        places, lengths = gather(bounds(lengths)[:-1], lengths, coded.indices.to_numpy())
        ids = flat[places].astype("<u4")
        ends = bounds(lengths)[bounds(counts)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _long(self, text: str) -> np.ndarray:
        """A long text in stretches, each with the space before it."""
        lead, out = "", []
        for part in stretches(text):
            out += self._rows(large([lead + part]))
            lead = " "
        return np.concatenate(out)

    def encode(self, texts: pa.Array | list) -> list[np.ndarray]:
        """Ids of each text; a null counts as empty."""
        texts = pc.fill_null(large(texts), "")
        if not len(texts):
            return []
        if not self.kind:
            return [x.astype("<u4") for x in self._whole(texts.to_pylist())]
        odd = pc.match_substring(texts, CUT)
        if self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, "<|"))
        odd = odd.to_numpy(zero_copy_only=False)
        apart = odd | (pc.binary_length(texts).to_numpy(zero_copy_only=False) > STRETCH)
        if not apart.any():
            return self._rows(texts)
        rest = iter(self._rows(texts.filter(pa.array(~apart))) if not apart.all() else ())
        return [next(rest) if not a else self._whole([texts[i].as_py()])[0].astype("<u4") if o else self._long(texts[i].as_py()) for i, (a, o) in enumerate(zip(apart.tolist(), odd.tolist(), strict=True))]


_SOLE: dict = {}


def sole(key, make):
    """What ``make`` gives, kept in this process until another key is asked for: one operator's
    memos serve all tasks of a worker, and go when the worker turns to another operator."""
    if key not in _SOLE:
        _SOLE.clear()
        _SOLE[key] = make()
    return _SOLE[key]


def forget() -> None:
    """Drops what another operator keeps in this process."""
    _SOLE.clear()


def settle() -> None:
    """Gives freed memory back to the system; texts come and go, and would leave it in pieces."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def encoder(path: str) -> WordEncoder:
    return sole(("words", path), lambda: WordEncoder(path))


def batches_of(texts: pa.Array, most_bytes: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of bounded size; a longer text stands alone."""
    sizes, a, total = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0, 0
    for b, n in enumerate(sizes):
        if b > a and total + n > most_bytes:
            yield texts.slice(a, b - a)
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield texts.slice(a)

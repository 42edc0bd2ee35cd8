"""Each operator against brute force, round trips, and the cases that its docstring defines."""

import hashlib
import math
import os
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from basaltic.llm import bpe, embed_dedup, exact_dedup, lang_id, line_dedup, order_minhash, packing, secret_scan, sstable, tokens, url_filter
from basaltic.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
ODD_TEXTS = ["\x01a \x01b\n\x01c", "line one.\nLine two\nx", "\nq r\ns", "t u\n",  "", " ", "a  b", "\n", "a\n", "a \n b", "  lead", "x\n\ny z. w", "İSTANBUL ΣΑΣ. éa Å don't. 12,3 3.. ...", "a<|endoftext|>b <|endoftext|>", " x  y", "A. B!? c;", "日本語 テキスト", "\x1c a\x85b\u00a0c", "e\u0301 e\u0301."]


def prose(seed, n=200):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def corpus(n=60):
    """Originals, near copies with few and many changes, exact copies, odd texts, nulls, repeats."""
    rng, rows = random.Random(3), []
    for i in range(n):
        words = prose(i, rng.choice([3, 40, 120, 400])).split()
        rows.append((10 * i, " ".join(words)))
        for k, share in enumerate((0.005, 0.02, 0.03, 0.2)):
            changed = [w if rng.random() > share else "new" + str(rng.randrange(9)) for w in words]
            rows.append((10 * i + 1 + k, " ".join(changed)))
    rows += [(5_000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(6_000, None), (6_001, None), (None, prose(1)), (7_000, prose(2).upper()), (7_001, prose(2).upper()), (7_001, prose(2).upper())]
    return rows


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 80)] + [(i, i + 1) for i in range(2000, 2060)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# exact dedup


def test_rice_round_trip():
    rng = np.random.default_rng(0)
    for n in (2, 3, 50, 5000):
        v = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        k, low, tops = exact_dedup.rice_encode(v)
        assert (exact_dedup.rice_decode(int(v[0]), len(v), k, low, tops) == v).all()
    v = np.array([5, 6, 2**64 - 1], np.uint64)
    k, low, tops = exact_dedup.rice_encode(v)
    assert (exact_dedup.rice_decode(5, 3, k, low, tops) == v).all()
    many = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    k, low, tops = exact_dedup.rice_encode(many)
    assert len(low) + len(tops) < len(many) * 7.2  # 64 - log2(20,000) + 2 bits a fingerprint


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("broadcast", [True, False])
def test_exact_dedup(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(exact_dedup, "BROADCAST_SUSPECTS", 0)
        monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
        monkeypatch.setattr(exact_dedup, "OWNER_FINGERPRINTS", 40)
    rows = corpus(20)
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    want = Counter()
    for i, t in rows:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want[(i, keep, len(ids), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest())] += 1
    docs = documents(spark, rows).repartition(5)
    assert Counter(map(tuple, exact_dedup.duplicate_groups(docs).collect())) == want
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted((lowered(r.text), r.doc_id or -1) for r in left.collect()) == sorted((t, max((x for x in ids if x is not None), default=-1)) for t, ids in groups.items())
    assert exact_dedup.duplicate_groups(docs.limit(0)).count() == 0 and exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_clashing_columns(spark):
    docs = documents(spark, corpus(3)).withColumns({c: F.lit(1) for c in ("fp", "norm", "keep_id", "h", "cid", "n", "keys", "group_size", "ID", "id_", "sha", "doc", "kept", "__id", "__h", "__kept", "class_id")})
    assert exact_dedup.deduplicate(docs).columns == docs.columns
    assert order_minhash.deduplicate(docs).columns == docs.columns
    assert exact_dedup.duplicate_groups(docs).count() == docs.count() == order_minhash.classes(docs).count()


# tokens


ENCODED = ["a", "B", "é", "\n", " ", " ", ".", "!", "1", "\x01", "\x02", "'s", "\t", "ñ", "漢", "\u0301", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "\u0958", "\u212a", "\x85", "\u00a0", "\u2028", "\x1c", "\u200b", "J\u030c", "...", "|", " the", "\r\n"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_encoder(name, monkeypatch):
    """Against the library, untouched, on whole texts."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(name))
    coder = tokens.WordEncoder(public_tokenizers.path(name), memo_words=50)

    def same(texts):
        want = [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        return [x.tolist() for x in coder.encode(texts)] == want

    texts = [t for _, t in corpus(10)] + [prose(9, 400) + "\n" + prose(8, 30), "Ab.\nCd ef.\nGh,\n\nij", "x" * 500 + " y", "\n".join(prose(i, 5) for i in range(40)), "  \n ", "it's we'll. 'S 't"]
    assert same(texts) and same(texts)
    rng = random.Random(1)
    assert same(["".join(rng.choice(ENCODED) for _ in range(rng.randrange(40))) for _ in range(4_000)])
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    changed = [c for c in points if c.lower() != c or c.isspace() or any(unicodedata.normalize(form, c) != c for form in ("NFC", "NFD"))]
    marks = [c for c in points if unicodedata.category(c)[0] in "MN"]
    assert len(changed) > 5_000
    assert same([f"a{c}. B{c}, x {c}! {c}{c} y\n{c}z.\n {c} 1{c}" for c in changed + marks])
    monkeypatch.setattr(tokens, "STRETCH", 64)
    monkeypatch.setattr(tokens.stretches, "__defaults__", (64,))
    assert same(texts) and coder.encode([]) == []


def test_word_encoder_takes_other_vocabularies_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        rules = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": rules["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": None}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(rules | change), encoding="utf-8")
        coder, plain = tokens.WordEncoder(str(path)), Tokenizer.from_file(str(path))
        assert coder.kind is None
        assert [x.tolist() for x in coder.encode(["Ab cd.", None, " x\ny"])] == [plain.encode(t, add_special_tokens=False).ids for t in ("Ab cd.", "", " x\ny")]
    assert tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), specials_as_text=True).encode(["<|endoftext|>"])[0].tolist() != [50256]


def test_sstable(spark, monkeypatch):
    from tokenizers import Tokenizer

    from basaltic.llm.common import scratch_path

    rows = corpus(30)
    docs = documents(spark, rows).repartition(4)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    ids = {t: plain.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}
    manifest = sstable.write_shards(docs, scratch_path(spark, "test"), path)
    got = sstable.read_shards(manifest).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    want = Counter((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for i in (0, 290, 5_003, None, 7_001):
        assert sorted(sstable.lookup(manifest, i)) == sorted(ids[t] for j, t in rows if j == i)
    assert sstable.lookup(manifest, 777_777) == []
    monkeypatch.setattr(sstable, "SHARD_BYTES", 0)
    one = documents(spark, [(i, prose(i, 4)) for i in range(5)]).coalesce(1)
    with pytest.raises(Exception, match="don't fit"):
        sstable.write_shards(one, scratch_path(spark, "test"), path, width=1)
    assert sstable.read_shards(sstable.write_shards(docs.limit(0), scratch_path(spark, "test"), path)).count() == 0


def test_shard_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 300)
    keys = sorted([-5, 0, 3, 3, 3, 9, 1 << 40, *range(100, 400, 3)])
    with open(tmp_path / "x.sst", "wb") as f:
        w = sstable.ShardWriter(f, 2)
        for i, k in enumerate(keys):
            w.add(sstable.key_of(k), np.arange(i % 7, dtype="<u4") + i)
        w.close()
    shard = sstable.Shard(str(tmp_path / "x.sst"))
    assert len(shard.places) > 3 and [k for k, _ in shard.scan()] == keys
    for k in set(keys):
        assert [x.tolist() for x in shard.get_all(k)] == [(np.arange(i % 7) + i).tolist() for i, j in enumerate(keys) if j == k]
    assert all(shard.get_all(k) == [] for k in (-6, 1, 101, 1 << 50))
    assert sum(shard.may_hold(sstable.key_of(k)) for k in range(10_000, 12_000)) < 60


def test_byte_bpe(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = corpus(5) + [(9_000, prose(4, 30_000)), (9_001, "y" * 5_000)]
    plain = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = bpe.digests(documents(spark, rows), path, public_tokenizers.PATTERN).collect()
    want = Counter()
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    assert bpe.encode(documents(spark, [(1, "a b")]), path, public_tokenizers.PATTERN).first().ids == plain.encode_ordinary("a b")
    assert bpe.digests(documents(spark, rows).limit(0), path, public_tokenizers.PATTERN).count() == 0


# packing


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = corpus(40) + [(9_000, prose(4, 3_000)), (9_001, prose(5, 900))]
    plain = Tokenizer.from_file(path)
    got = packing.pack(documents(spark, rows).repartition(6), path, capacity=512).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 512
    once = [i for i, n in Counter(i for i, _ in rows).items() if n == 1]
    texts, total = dict(rows), 0
    for i, t in rows:
        total += len(plain.encode(t or "", add_special_tokens=False).ids) + 1
    for i in once:
        ids = plain.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 512 for r in pieces[1:])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in got) == total and len(by_bin) <= 1.05 * total / 512 + 1
    assert packing.pack(documents(spark, rows).limit(0), path).count() == 0


def test_best_fit_and_cut():
    assert packing.cut(3, 4) == [(0, 3)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    bins = packing.best_fit(np.array([6, 3, 5, 4, 7, 2, 3]), 10)
    assert sorted(x for b in bins for x in b) == list(range(7)) and len(bins) == 3


# URL filter


def test_url_filter(spark):
    urls = ["http://" + "a." * 20_000 + "net/es/", None, "", "example.com/en/", "http://WWW.Example.com/en/x?q#f", "https://a.b.example.com/en/", "https://example.com/e", "x://net/es/1", "x://a.net/fr", "x://anet/es/", "x://com", "x://com?y/en/", "http://x.com#/en/", "://example.com/en/é\nb", "http://a.com/x://b.net/es/"]
    rules = url_filter.RULES + [("net", "/es/deep", "allow"), ("b.net", "/", "block"), ("b.net", "/", "block"), (None, "/", "block")]
    rows = [(i, u) for i, u in enumerate(urls)] + [(4, urls[4]), (None, urls[4])]

    def judged(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = lowered(rest[:end]), rest[end:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fit = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = url_filter.judge(pages, url_filter.rules_table(spark, rules))
    assert Counter(map(tuple, got.collect())) == Counter((i, *judged(u)) for i, u in rows)
    none = url_filter.judge(pages, url_filter.rules_table(spark, rules).limit(0))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark)).count() == 0


def test_url_filter_with_many_rules(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/en/{i}") for i in range(50)], "page_id long, url string")
    got = url_filter.judge(pages, url_filter.rules_table(spark))
    assert {r.rule for r in got.collect()} == {"example.com/en/"}


# language identification


def test_language_id(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = {"en": "the of and to in is that it was for".split(), "fr": "le de un être et à il avoir ne je".split(), "de": "der die und in den von zu das mit sich".split()}
    rng, rows = random.Random(5), []
    for i in range(240):
        lang = rng.choice(list(vocab))
        rows.append((i, " ".join(rng.choice(vocab[lang]) for _ in range(30)).capitalize() + ".", lang, "s", 1))
    rows += [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, "12 !?", "en", "s", 0), (903, "Der die UND", None, "s", 0), (None, "le de un", "xx", "s", 0), (904, "\ua66e" * 100, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(docs, docs.where(~lang_id.held_out(F.col("doc_id"))), path).collect()}
    assert all(got[r[0]][0] == r[2] for r in rows[:240])
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "de" and got[None][0] == "fr"
    assert all(0 <= s <= 1 for _, s in got.values()) and len(got) == len(rows)
    assert {r[0] for r in lang_id.predict(docs, docs.limit(0), path).select("lang_pred").distinct().collect()} == {"und"}
    left = {r.doc_id: r.lang for r in lang_id.recognised(docs, docs, path).collect()}
    assert set(left) == {r[0] for r in rows} - {900, 901, 902, 904} and left[903] == "de" and left[None] == "xx"
    assert lang_id.recognised(docs, docs.limit(0), path).count() == len(rows) - 3
    held = {r.doc_id for r in docs.where(lang_id.held_out(F.col("doc_id"))).collect()}
    assert held == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2}


def test_forward_sums_all_segmentations():
    pieces = {"▁": 2, "▁a": 3, "b": 4, "ab": 5, "a": 6, "▁ab": 7, "babab": 8}
    p = np.array([0, 0.01, 0.1, 0.2, 0.3, 0.05, 0.15, 0.1, 0.09])[:, None] * [1, 0.5]

    def total(word):
        """One prefix after the other; all of its last pieces."""
        sums = [np.ones(2)]
        for end in range(1, len(word) + 1):
            sums.append(sum(p[pieces.get(word[a:end], int(end - a == 1))] * sums[a] for a in range(end)))
        return sums[-1]

    def every(word):
        return 1 if not word else sum(p[pieces.get(word[:m], int(m == 1))] * every(word[m:]) for m in range(1, len(word) + 1))

    trie = lang_id.Trie(pieces)
    words = ["▁ab", "▁", "▁abab", "▁ba", "▁xab", "▁bababababab", "▁" + "ab" * 20]
    for places in lang_id.by_length(words):
        found = lang_id.forward(lang_id.lattice([words[i] for i in places], trie), len(places), p)[-1]
        assert np.allclose(found, [total(words[i]) for i in places], rtol=1e-12)
        assert all(np.allclose(total(words[i]), every(words[i])) for i in places if len(words[i]) < 14)
    for word in [*words, "▁" + "abx" * 30]:
        assert np.allclose(lang_id.log_likelihood(word, pieces, 5, p), np.log(total(word)), rtol=1e-12)
    assert np.isfinite(lang_id.log_likelihood("▁" + "ab" * 20_000, pieces, 5, p)).all()


def test_long_words_are_scored_whole():
    pieces = lang_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert max(map(len, pieces)) > 12
    langs, table = lang_id.fit({"de": {"donau": 3, "schiff": 2, "fahrt": 4}, "en": {"steam": 2, "ship": 3, "voyage": 1}}, pieces)
    scorer = lang_id.Scorer(langs, table, pieces)
    words = ["schifffahrt", "donau" * 15, "steamship" * 30, "ship"]
    want = [lang_id.log_likelihood("▁" + w, pieces, scorer.longest, table) for w in words]
    assert np.allclose(scorer.sums([" ".join(words)])[0, :-1], sum(want))
    assert "\ua66e" not in pieces and scorer.predict([words[1], words[2], "½ ² ① 12", None])[0] == ["de", "en", "und", "und"]
    assert scorer.predict([words[1], "", "\ua66e" * 9])[2].tolist() == [True, False, False]


def test_language_id_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    from basaltic.llm import registry

    found = registry.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


# secrets


RANKED = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def guesser():
    return secret_scan.Guesser(secret_scan.ranked_words(RANKED))


def spans_by_hand(text):
    """The asked patterns, written out for themselves, a character at a time."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    keys = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    kinds = [(f"(?:{keys})[\"\']?[ ]*[:=][ ]*[\"\']?([-A-Za-z0-9+/_.=]+)", 6), ("(AKIA[A-Z0-9]+)", 20), ("([0-9a-f]+)", 24)]
    return sorted((m.start(), k, m.end()) for k, (pattern, least) in enumerate(kinds) for m in re.finditer(pattern, text) if len(m[1]) >= least)


def test_secret_scan(spark, guesser):
    texts = ["password=abc12", "é PassWord : 'abc123' x", 'api_key="Zx9+/=.-_" token=short1', "AKIA" + "A1" * 8, "AKIASHORT", "f" * 24 + " " + "0" * 23, "token = \"" + "ab" * 20 + "\"", "ſecret=abcdef passwd:= qqqqqq", "my passphrase is kX9#vQ2$mZ7!", "the password is monday", "secret:aaaaaaaaaa", None, "", "pwd: qwertyuiop", "x" * 200_000 + " token=abcdef1234", "token=" + "kV7" * 40_000]
    docs = documents(spark, list(enumerate(texts))).withColumns({c: F.lit(1) for c in ("spans", "base_sha256", "costs")})
    got = {r.doc_id: r for r in secret_scan.scan(docs, RANKED).collect()}
    for i, t in enumerate(texts):
        base = spans_by_hand(t or "")
        joined = secret_scan.joined(base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert set(joined.split(",")) - {""} <= set(got[i].spans.split(","))
    assert got[8].spans == "guess:17:28" and "guess" in got[6].spans or "ab" * 20 in texts[6]
    assert all("guess" not in got[i].spans for i in (9, 10, 12, 13))
    assert [round(c.log10, 1) for c in got[10].costs] == [2.3] and not got[11].costs
    assert secret_scan.scan(documents(spark, []), RANKED).count() == 0
    rng = random.Random(2)
    bits = ["password", "PASSWD", "Token", "secret", "api_key", "apiKEY", "AKIA", "=", ":", " ", "'", '"', "a1B2c3", "0f" * 6, "é", "ſ", "\n", ".", "K"]
    for _ in range(3_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert secret_scan.base_spans(t) == spans_by_hand(t)


def brute_cost(value, words):
    """The cheapest of all cuts, each part explained in the cheapest way, from the definitions."""
    low = value.lower()
    leet = dict(zip("4301!5$7@", "aeoiissta", strict=True))

    def maximal(a, b, ok):
        return b - a > 2 and ok(a, b) and not (a > 0 and ok(a - 1, b)) and not (b < len(low) and ok(a, b + 1))

    def part(a, b):
        s, t, costs = value[a:b], low[a:b], [float(b - a)]
        plain = "".join(leet.get(c, c) for c in t)
        rank = words.get(t) or words.get(plain)
        if b - a > 2 and rank:
            costs.append(math.log10(rank + 10) + (0 if t in words else 0.6) + (0 if s == t else 0.3 if s.istitle() or s.isupper() else 0.9) + 0.3)
        if re.fullmatch(r"(19|20)\d\d", s):
            costs.append(2.4)
        first = secret_scan.DATE.match(value, a)
        if first and first.end(1) == b:
            costs.append(4.9)
        steps = lambda f: lambda x, y: all(f(low[i], low[i + 1]) for i in range(x, y - 1))
        walks = "`1234567890-= qwertyuiop[]\\ asdfghjkl;' zxcvbnm,./"
        near = lambda x, y: " " not in x + y and x + y in walks
        rules = [(lambda x, y: x == y, 1), (lambda x, y: x.isalnum() and y.isalnum() and ord(y) == ord(x) + 1, 1.5), (lambda x, y: x.isalnum() and y.isalnum() and ord(y) == ord(x) - 1, 1.5), (near, 2), (lambda x, y: near(y, x), 2)]
        costs += [base + math.log10(b - a) + 0.3 for f, base in rules if maximal(a, b, steps(f))]
        for n in range(2, min(32, (b - a) // 2) + 1):
            end = a + n
            while end < len(low) and low[end] == low[end - n]:
                end += 1
            if end - a >= 2 * n and b == a + (end - a) // n * n and not (a > 0 and low[a - 1] == low[a - 1 + n]):
                costs.append(min(n, 6) + math.log10((b - a) // n) + 0.3)
        return min(costs)

    best = [0.0]
    for b in range(1, len(value) + 1):
        best.append(min(best[a] + part(a, b) for a in range(b)))
    return best[-1]


def test_guess_cost(guesser):
    cost = guesser.cost
    assert cost("password") < 2 < 8 <= cost("hX8#kQ!z") and cost("qwertyuiop") < 4 and cost("aaaaaaaaaaaa") < 3
    assert cost("20240131") < 6 and cost("abcabcabcabc") < 5 and cost("P4ssw0rd") < 4 and cost("") == 0
    assert cost("correcthorsebatterystaple") < 18 and cost("thequickbrownfox9") < 16.2 and cost("forgotten") < 5
    whole = "20240131" + "qwertyuiop" + "x" * 70 + "correct" * 20
    assert cost(whole) < 5 + 5 + 4 + 8 + 4 * secret_scan.PART and cost("kV7#" * 30_000) < 10
    rng = random.Random(7)
    bits = ["pass", "word", "Love", "2024", "1999", "0131", "qwer", "asdf", "aaa", "abc", "321", "x", "#", "Q", "7", "p4ss", "xyxy", "MONKEY", "-", "lkjh"]
    for _ in range(400):
        value = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 7)))
        assert math.isclose(cost(value), brute_cost(value, guesser.words), abs_tol=1e-9), value


def test_redaction(spark):
    docs = documents(spark, [(1, "a password=abc123def b"), (2, None), (3, "clean"), (4, "token=" + "ab" * 15)]).withColumn("start", F.lit(1))
    left = secret_scan.redact(docs, RANKED)
    got = {r.doc_id: r for r in left.collect()}
    assert got[1].text == "a [SECRET] b" and got[1].n_chars == 12 and got[2].text is None and got[3].text == "clean" and got[4].text == "[SECRET]" and left.columns == docs.columns


def test_credential_context(guesser):
    """Values that reach beyond a base span, and forms that no base pattern has."""
    for text, left in (
        ("x password=abcdef$Kd93!xQ y", "x [SECRET] y"),
        ("token: " + "0a" * 12 + "#Vk8?mZ2&", "[SECRET]"),
        ("secret=abc123def, b", "[SECRET], b"),
        ("password is Tr0ub4(dor&3).", "password is [SECRET])."[:-2] + ")."),
        ('pwd: "kd 93!x Qz7#" y', 'pwd: "[SECRET]" y'),
        ("login as bob/x9#Kq!27vT now", "login as bob/[SECRET] now"),
        ("ftp://bob:x9#Kq!27vT@host/a", "ftp://bob:[SECRET]@host/a"),
        ("passphrase is xqzvkjwpqmtrhbnd", "passphrase is [SECRET]"),
        ("the secret is unquestionably out; the token is ring", "the secret is unquestionably out; the token is ring"),
    ):
        base, every, _ = secret_scan.scan_text(text, guesser)
        assert set(base) <= set(every) and secret_scan.redact_text(text, guesser) == left, text
    assert (11, 3, 25) in secret_scan.scan_text("x password=abcdef$Kd93!xQ y", guesser)[1]
    assert (9, 3, 27) in secret_scan.scan_text("password=b7db7aa4a5fcc78305", guesser)[1]


# embeddings


def brute_links(rows, threshold=0.98):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float) / max(map(abs, v))
        return a / np.sqrt(a @ a)

    units = [unit(v) if label is not None else None for _, label, v in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if units[i] is not None and units[j] is not None and rows[i][1] == rows[j][1] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = Counter()
    for i, j in links:
        n[i] += 1
        n[j] += 1
        parent[root(i)] = root(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(v, least.get(root(i), v))
    return Counter((v, n[i], least.get(root(i)), v == least.get(root(i))) for i, (v, _, _) in enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
def test_embedding_links(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(embed_dedup, "CELL_TARGET", 40)
        monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng, rows = np.random.default_rng(2), []
    for k in range(60):
        base = rng.normal(size=8)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows), int(k % 3), np.float32(base + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.3])).tolist()))
    rows += [(800 + i, 1, rows[5][2]) for i in range(30)] + [(910, 2, [1.0, *[0.0] * 99_999]), (911, 2, [1.0, *[0.0] * 99_998, 0.1])] + [(900, None, rows[0][2]), (901, 1, None), (902, 1, []), (903, 1, [0.0] * 8), (904, 1, [float("nan")] * 8), (905, 1, [1.0, None] + [0.0] * 6), (906, 1, [float("inf")] * 8), (None, 1, rows[5][2]), (907, 1, [1.0, 2.0]), (908, 1, [2.0, 4.0]), (0, 0, rows[0][2])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("cid", F.lit(1))
    got = embed_dedup.link(table)
    assert Counter(map(tuple, got.collect())) == brute_links(rows)
    if not small:
        assert embed_dedup.link(table.limit(0)).count() == 0


# near copies


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def kmers(text):
    w = (text or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_alignment():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a = rng.integers(0, 12, rng.integers(1, 60)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), 3)) if rng.random() < 0.7 else rng.integers(0, 12, 40).astype(np.uint64)
        if not len(b):
            continue
        m = lcs(a.tolist(), b.tolist())
        want = m / (len(a) + len(b) - m)
        got = order_minhash.similarity(a, b)
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or math.isclose(got, want))


def test_near_copies(spark):
    rows = corpus(60) + [(8_000 + i, prose(1, 120) + " " + prose(700 + i, 60)) for i in range(20)]
    grams = [kmers(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = grams[i], grams[j]
        equal = (rows[i][1] or "") == (rows[j][1] or "")
        if not equal and a and b and len(set(a) & set(b)) >= 0.6 * len(set(a) | set(b)):
            m = lcs(a, b)
            equal = m >= 0.8 * (len(a) + len(b) - m)
        if equal:
            parent[root(i)] = root(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(v, least.get(root(i), v))
    size = Counter(root(i) for i in range(len(rows)))
    want = Counter((v, least.get(root(i)), size[root(i)], v == least.get(root(i))) for i, (v, _) in enumerate(rows))
    docs = documents(spark, rows).repartition(5)
    found = order_minhash.classes(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size, r.kept) for r in found) == want
    classes, linked = {r.doc_id: r.class_id for r in found}, defaultdict(set)
    for r in order_minhash.pairs(docs).collect():
        linked[r.doc_a].add(r.doc_b)
        linked[r.doc_b].add(r.doc_a)
        assert r.doc_a != r.doc_b and classes[r.doc_a] == classes[r.doc_b]
    for r in found:
        text = dict(rows)[r.doc_id]
        assert r.n_links == len(linked[min((i for i, t in rows if (t or "") == (text or "") and i is not None), default=None)])
    left = order_minhash.deduplicate(docs)
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert left.columns == docs.columns and Counter(ids) == Counter({least.get(root(i)) for i in range(len(rows))})
    same_id = [(5, prose(1)), (5, prose(2)), (5, prose(2)), (4, prose(2) + " x"), (6, prose(1)), (9, prose(3)), (9, prose(3) + " y")]
    got = Counter((r.doc_id, r.text) for r in order_minhash.deduplicate(documents(spark, same_id)).collect())
    assert set(got.values()) == {1} and {i for i, _ in got} == {5, 4, 9} and len(got) == 3
    assert order_minhash.classes(docs.limit(0)).count() == 0


def test_near_copies_with_repeated_blocks(spark):
    """A block that recurs loses one occurrence, which numbers the others anew."""
    rows = []
    for i in range(40):
        a, b, *rest = (prose(10_000 + 10 * i + j, 60) for j in range(8))
        whole = [[a, *rest[:4], a], [a, rest[0], a, rest[1], a, rest[2]], [a, b, *rest[:6], a, b], [a, rest[0], a, rest[0], rest[1], rest[2]]][i % 4]
        rows += [(10 * i, " ".join(whole)), (10 * i + 1, " ".join(whole[1:])), (10 * i + 2, " ".join(rest[:5] + whole[1:3]))]
    grams = {i: kmers(t) for i, t in rows}
    want = {i: i for i in grams}
    for i, j in combinations(grams, 2):
        a, b = grams[i], grams[j]
        if i // 10 == j // 10 and (m := lcs(a, b)) >= 0.8 * (len(a) + len(b) - m):
            want[j] = want[i]
    assert sum(i != c for i, c in want.items()) >= 30
    assert {r.doc_id: r.class_id for r in order_minhash.classes(documents(spark, rows)).collect()} == want


# lines


def brute_lines(rows, least=50):
    """Every stretch of lines with enough words that equals one that starts earlier."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, hashlib.md5((rows[i][1] or "").encode()).digest()))
    seen, gone = {}, {}
    stretches = []
    for rank, i in enumerate(order):
        kept = [(n, x.strip()) for n, x in enumerate((rows[i][1] or "").split("\n")) if x.strip()]
        for a in range(len(kept)):
            words = 0
            for b in range(a, len(kept)):
                words += len(kept[b][1].split())
                if words >= least:
                    key, at = tuple(x for _, x in kept[a : b + 1]), (rank, kept[a][0])
                    seen[key] = min(seen.get(key, at), at)
                    stretches.append((key, at, i, kept[a][0], kept[b][0]))
    for key, at, i, first, last in stretches:
        if at > seen[key]:
            gone.setdefault(i, set()).update(range(first, last + 1))
    out = Counter()
    for i, (v, t) in enumerate(rows):
        lines = [] if t is None else t.split("\n")
        g = gone.get(i, set())
        out[(v, len(lines), len(g), None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in g))] += 1
    return out


def test_line_dedup(spark):
    rng, rows = random.Random(8), []
    shared = ["\n".join(prose(100 + i * 10 + j, rng.choice([8, 20, 55])) for j in range(5)) for i in range(4)]
    for i in range(60):
        parts = [prose(1_000 + i * 7 + j, rng.choice([3, 12, 30])) for j in range(rng.randrange(1, 6))]
        for _ in range(rng.randrange(3)):
            block = rng.choice(shared).split("\n")
            a = rng.randrange(5)
            parts[rng.randrange(len(parts)) : 0] = ["", *block[a : a + rng.randrange(1, 6)], "   "]
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, shared[0]), (103, shared[1] + "\n" + shared[1]), (104, " x\n".join(["a b"] * 60))]
    docs = documents(spark, rows).repartition(4)
    assert Counter(map(tuple, line_dedup.deduplicate_lines(docs).collect())) == brute_lines(rows)
    again = line_dedup.deduplicate_lines(documents(spark, [(1, shared[0]), (1, shared[0])]))
    assert [r.n_deleted for r in again.collect()] == [0, 0]
    assert line_dedup.deduplicate_lines(docs.limit(0)).count() == 0

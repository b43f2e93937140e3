"""Resampling, periodic runs and repeated strings against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import packing, resampling, runindex, runs, toxicity

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " ", "a", "don't STOP...  now\n\n", "naïve café №5 \x1c x\x0b\x85", "日本語 text", "x" * 3000, "\0" * 700, "the cat sat on the mat . " * 60]
DOCS = "doc_id long, text string, score string, _text string, n_words string, a string, key string, h string"


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, *["clash"] * 6) for k, t in enumerate(texts)], DOCS)


def feature_buckets(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, percent=5):
    s, t = np.zeros(10000), np.zeros(10000)
    for _, text in rows:
        np.add.at(s, feature_buckets(text)[1], 1)
    for text in target:
        np.add.at(t, feature_buckets(text)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s.tolist(), t.tolist())]
    out, able = [], []
    for doc_id, text in rows:
        n, found = feature_buckets(text)
        weight = sum(gain[b] for b in found)
        h = None if doc_id is None else int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
        score = None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(found), weight, score))
        if n >= 20 and score is not None:
            able.append((-score, doc_id))
    ranks = {}
    for nth, (_, doc_id) in enumerate(sorted(able)[: len(able) * percent // 100], 1):
        ranks.setdefault(doc_id, []).append(nth)
    return sorted(((*r, ranks[r[0]].pop(0) if ranks.get(r[0]) and feature_buckets(t)[0] >= 20 else None) for r, (_, t) in zip(out, rows)), key=str)


@pytest.mark.parametrize("percent", [5, 50, 100, 0])
def test_resampling_equals_brute_force(spark, percent):
    r = random.Random(4)
    texts = ODD_TEXTS + [" ".join(r.choice(["ab", "C", "déjà", "日本", "q1", "z" * 80, "the"]) for _ in range(r.randint(0, 60))) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[-1])] * 3 + [(None, texts[-1])]
    target = ["AB the q1", None, "", "déjà 日本 " * 5]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, weight string, rank string")
    found = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent)
    got = sorted((tuple(x) for x in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == brute_resample(rows, target, percent)


def test_resampling_draws_alike_with_few_ranges_and_on_empty_tables(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "20L AS n_words", "cast(id * 7919 % 50 AS long) AS score")
    whole = sorted((-s, i) for i, _, s in rows.collect())[: 3000 * 5 // 100]
    for ranges in (2, 16, 65536):
        drawn = resampling.draw(rows, ranges=ranges).where("rank IS NOT NULL").orderBy("rank").collect()
        assert [(-r["score"], r["doc_id"]) for r in drawn] == whole and [r["rank"] for r in drawn] == list(range(1, 151))
    docs = documents(spark, ODD_TEXTS)
    assert resampling.resample(docs.limit(0), docs).count() == 0
    assert {r["n_features"] > 0 for r in resampling.resample(docs, docs.limit(0)).collect()} == {True, False}


def brute_runs(words, least=12):
    out, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, 2 * q) and (start, length) not in seen:
                seen.add((start, length))
                out.append((start, length, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_lists(r, n):
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a", "b"] * 6, list("abcdef") * 2, list("abcdefg") * 2, list("aab") * 4 + list("ab") * 7]
    for _ in range(n):
        size, letters = r.randint(0, 70), "abcdefghijklmnopqrstuvwxyz"[: r.choice([1, 2, 2, 3, 5, 20])]
        words = [r.choice(letters) for _ in range(size)]
        if words and r.random() < 0.5:
            a = r.randrange(size)
            p = 1 + (size - a) // r.randint(2, 9)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(size)]
        out.append(words)
    return out


@pytest.mark.parametrize("least", [4, 12, 13])
def test_runs_equal_brute_force(least):
    lists = periodic_lists(random.Random(least), 1200)
    for size in (1, 9, 400):
        for first in range(0, len(lists), size):
            part = lists[first : first + size]
            for words, found in zip(part, runs.runs_of(part, least)):
                assert [tuple(x) for x in found.tolist()] == brute_runs(words, least), words


def test_runs_mask_ordinary_prose():
    r = random.Random(1)
    prose = [f"w{r.randrange(500)}" for _ in range(2000)]
    prose[500:520] = [f"u{k % 5}" for k in range(20)]
    kept = runs.repeated_grams(np.unique(prose, return_inverse=True)[1], np.zeros(2000, np.int64), runs.overlap())
    assert kept[500:520].all() and kept.sum() < 30 and runs.overlap() == 6


def test_runs_query_digests(spark):
    r = random.Random(9)
    texts = ODD_TEXTS + ["\t ".join(w) for w in periodic_lists(r, 150)] + ["b c " * 30]
    docs = documents(spark, texts).unionByName(documents(spark, [texts[20], None], 20)).unionByName(spark.createDataFrame([(None, "x " * 20, *["clash"] * 6)], DOCS))
    got = sorted((tuple(x) for x in runs.digests(runs.find_runs(runs.planted(docs))).collect()), key=str)
    want = []
    for doc_id, text in [*enumerate(texts), (20, texts[20]), (21, None), (None, "x " * 20)]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute_runs(words)
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append(
            (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
             sha(" ".join(w for i, w in enumerate(words) if i not in drop)))
        )
    assert got == sorted(want, key=str)
    assert sum(w[1] for w in want) > 50 and runs.find_runs(docs.limit(0)).count() == 0


def brute_matches(pieces):
    """Longest match of each byte with another place, by all pairs."""
    out = []
    for i, s in enumerate(pieces):
        for x in range(len(s)):
            best = 0
            for j, t in enumerate(pieces):
                for y in range(len(t)):
                    n = 0
                    while (i, x) != (j, y) and x + n < len(s) and y + n < len(t) and s[x + n] == t[y + n]:
                        n += 1
                    best = max(best, n)
            out.append(best)
    return out


def test_run_index_matching_statistics():
    r = random.Random(5)
    for _ in range(60):
        pieces = [bytes(r.choice(b"ab\0"[: r.choice([1, 2, 3])]) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 6))]
        pieces += r.choice([[], [pieces[0] + b"x", b"y" + pieces[0], pieces[0]]])
        index = runindex.RunIndex(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces]))
        assert index.matching_statistics().tolist() == brute_matches(pieces)


def test_run_index_is_small_for_repetitive_text():
    r = random.Random(6)
    base = bytes(r.choice(b"abcdefgh ") for _ in range(3000))
    copies = [base[:k] + b"!" + base[k + 1 :] for k in range(100, 3000, 60)]
    index = runindex.RunIndex(np.frombuffer(b"".join(copies), np.uint8), np.cumsum([len(c) for c in copies]))
    assert len(index.runs) < len(copies) * 3000 / 10


def brute_repeats(texts, length):
    starts = {}
    raw = [(t or "").encode() for t in texts]
    for k, text in enumerate(raw):
        for i in range(len(text) - length + 1):
            starts[text[i : i + length]] = starts.get(text[i : i + length], 0) + 1
    out = []
    for text in raw:
        gone = [False] * len(text)
        for i in range(len(text) - length + 1):
            if starts[text[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        out.append((len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def digest_rows(found):
    return [(r["doc_id"], r["n_bytes"], sum(e - s for s, e in zip(r["starts"], r["ends"])), len(r["starts"]), r["kept_sha256"]) for r in found.collect()]


@pytest.mark.parametrize("most_segments", [runindex.MOST_SEGMENTS, 2])
def test_repeats_equal_brute_force(spark, most_segments):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(3)]
    texts = ODD_TEXTS + ["é" * 120, "ab" * 150, "é" * 99 + "a" * 3]
    for k in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 50)))]
        parts += [p[r.randint(0, 30) : r.randint(100, 300)] for p in passages if r.random() < 0.5]
        texts.append(r.choice([" ", ""]).join(parts))
    texts += texts[12:18] + [texts[20][:-3] + "zz"]
    near = " ".join(word() for _ in range(120))
    texts += [near[:k] + "#" + near[k + 1 :] for k in range(0, 400, 40)]
    docs = documents(spark, texts).unionByName(spark.createDataFrame([(None, texts[15], *["clash"] * 6), (3, texts[15], *["clash"] * 6)], DOCS))
    rows = [*enumerate(texts), (None, texts[15]), (3, texts[15])]
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 100))), key=str)
    got = sorted(digest_rows(runindex.remove_repeats(docs, 100, gram=32, most_segments=most_segments)), key=str)
    assert got == want
    assert 10 < sum(w[3] > 0 for w in want) < len(want) - 10


def test_repeats_of_long_texts_and_empty_tables(spark, monkeypatch):
    """Texts cut in many chunks, an index of many batches."""
    monkeypatch.setattr(runindex, "CHUNK", 1 << 10)
    monkeypatch.setattr(runindex, "BATCH", 3000)
    r = np.random.default_rng(2)
    text = "".join(r.choice(list("abcdefgh "), 9000))
    ends = np.array([4000, 9000])
    data = np.frombuffer(text.encode(), np.uint8)
    first, size, _ = runindex.segments(data, ends)
    windows = np.concatenate([np.arange(f, f + s - 199) for f, s in zip(first, size)])
    assert windows.tolist() == [*range(0, 3801), *range(4000, 8801)]
    texts = [text[:5000] + "!" + text[5001:], text[:4000] + "?" + text[4001:], text[300:800]]
    docs = documents(spark, texts)
    got = sorted(digest_rows(runindex.remove_repeats(docs)))
    assert [g[1:] for g in got] == brute_repeats(texts, 200)
    assert runindex.remove_repeats(docs.limit(0)).count() == 0
    assert digest_rows(runindex.remove_repeats(documents(spark, ["short", None])))[0][2] == 0


def test_toxicity_counts_stems_that_ordinary_text_holds_once():
    """What tells the classes apart is how many words of a stem a text holds, each with another end."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    ends = ["ent", "iche", "ux", "oso", "ada", "keit", "aux", "ing", "ers", "isch"]
    rows = []
    for k in range(2400):
        toxic = k % 6 == 0
        text = [r.choice(words) for _ in range(r.randint(60, 200))]
        for _ in range(r.randint(4, 7) if toxic else r.choice([0, 0, 0, 1])):
            text.insert(r.randrange(len(text)), r.choice(["vromp", "zkuld", "grelb"]) + r.choice(ends) + r.choice(ends))
        rows.append((k, int(toxic), " ".join(text)))
    model = toxicity.fit(rows[:1800])
    hit = model.scores(model.features([toxicity.normalise(t) for _, _, t in rows[1800:]])) >= toxicity.THRESHOLD
    y = np.array([y for _, y, _ in rows[1800:]])
    assert hit[y == 1].mean() > 0.8 and hit[y == 0].mean() < 0.02


def test_word_encoder_cuts_as_the_library(monkeypatch):
    """Apostrophes, digits, marks and capitals, many texts at once, and a table that is forgotten in between."""
    monkeypatch.setattr(packing, "WORDS_KEPT", 40)
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(3)
    parts = ["don't", "it'll", "'s", "''s", ".'s", "9's", "a'1", "éa", "1́", ".́b", "AbC-dEf", "x1y22.3", "É", "ß.", "\x85", "\xa0", "​", "İ", "<|endoftext|>", "x" * 40, "日本", "\0", "\x1c"]
    for _ in range(200):
        texts = ["".join(r.choice([*parts, " ", "\n", "'"]) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 6))]
        flat, ends = encoder.encode_all(texts, 1)
        found = np.split(flat, ends[:-1])
        assert [f.tolist() for f in found] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts], texts

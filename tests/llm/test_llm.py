"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import ann, bpe, chat, crf, extraction, packing, quality, simhash, topk, toxicity, warc
from tessera.llm.dom import block_features, leaf_blocks

ODD_TEXTS = [None, "", " ", "a", "don't STOP...  now\n\n", "naïve café №5 \x1c x", "<|endoftext|> [INST] \\ </s>", "日本語 text", "x" * 5000, "the cat sat on the mat . " * 400]
DOCS = "doc_id long, text string, score string, _text string"


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "s", "clash") for k, t in enumerate(texts)], DOCS)


def test_chat_round_trip(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("system", "</s>"), ("user", "a\\<|im_end|>\\"), ("assistant", "<|im_<|im_end|>"), ("user", None)])]
    rows += [(2, 0, "assistant", "x"), (None, None, None, None), (2, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    digest = hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:4]).encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest and got[1]["n_turns"] == 4 and not got[1]["valid"]
    assert got[1]["loss_chars"] == len("<|im_<|im_end|>") and got[2]["n_turns"] == 2 and not got[2]["valid"]
    assert got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_escapes_are_exact():
    codec, r = chat.ChatCodec(), random.Random(1)
    parts = [*chat.CHAT.controls, "\\", "<", "|", "s>", "a", "\n", "[/", "INST]"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        escaped = codec.escape(text)
        assert codec.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CHAT.controls)
        piece = "".join(s for s, _ in codec.segments(text, text))
        assert codec.read_turn(piece) == (text, text)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints_and_components(spark):
    r = random.Random(3)
    texts = ODD_TEXTS + ODD_TEXTS[:3] + [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    got = {x["doc_id"]: x for x in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert all(got[k]["fp"] & (1 << 64) - 1 == p for k, p in enumerate(prints))
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [min(root[j] for j in range(len(texts)) if bin(prints[i] ^ prints[j]).count("1") <= 2) for i in range(len(texts))]
        if new == root:
            break
        root = new
    assert [got[k]["component_id"] for k in range(len(texts))] == root


def test_golay_keys_meet_within_two_bits():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**64, 200, np.uint64)
    for _ in range(20):
        other = base ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64))
        a, b = simhash.bucket_keys(base.view(np.int64)), simhash.bucket_keys(other.view(np.int64))
        sets = [[set(keys[owners == k].tolist()) for k in range(200)] for keys, owners in (a, b)]
        assert all(x & y for x, y in zip(*sets))


def test_large_buckets_lose_no_link(spark):
    base = 0x0F0F0F0F0F0F0F0F
    prints = sorted({base ^ (1 << a) ^ (1 << b) for a in range(0, 40) for b in range(a)})
    unique = spark.createDataFrame([(p,) for p in prints], "fp long")
    few, many = (simhash.connected(simhash.links(unique, most)) for most in (2, 10_000))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_keep_first(spark):
    docs = documents(spark, ["one two three four", "one two three four", "other words are here", None, ""]).unionByName(documents(spark, ["one two three four"]))
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == [0, 2, 3]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def odd_vectors(n=700, d=9):
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (n, d)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(k, v.tolist(), "c") for k, v in enumerate(x)]
    short = [(5000, [1.0], "c"), (5050, [0.5] * (d + 3), "c")]
    out = [(1000, None, "c"), (1100, [None] * d, "c"), (1200, [float("nan")] * d, "c"), (1250, [float("inf")] * d, "c"), (None, [1.0] * d, "c")]
    return rows + short, rows + short + out + [rows[5], rows[101]]


def brute(rows, every, k, of):
    ids = np.array([r[0] for r in rows])
    x = np.zeros((len(rows), max(len(r[1]) for r in rows)))
    for n, r in enumerate(rows):
        x[n, : len(r[1])] = of(np.array(r[1], np.float32).astype(float))
    out = []
    for n, q in enumerate(ids):
        if q % every == 0:
            scores = (x * x[n]).cumsum(1)[:, -1]
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
            out += [(int(q), rank + 1, int(ids[j]), float(scores[j])) for rank, j in enumerate(order)]
    return out


def test_exact_top_k(spark):
    rows, odd = odd_vectors()
    empty, zero = (6001, [], "c"), (6050, [0.0] * 9, "c")
    got = sorted(tuple(r) for r in topk.search(vectors(spark, odd + [empty, zero]), 10, 50).collect())
    assert got == sorted(brute(rows + [empty, zero], 50, 10, lambda x: np.floor(1024 * x)))
    assert topk.search(vectors(spark, odd[:0])).count() == 0
    assert topk.search(vectors(spark, odd[:1])).count() == 0


def test_threshold_stops_early_and_is_exact():
    r = np.random.default_rng(0)
    x = (r.pareto(1.0, (5000, 4)) * 100).astype(np.int64)
    query = np.array([3, -1, 2, 5])
    lists, best = topk.SortedLists(x), sorted(x @ query)[-10:]
    found, scores = lists.search(query, 10)
    assert len(found) < 1000 and sorted(scores)[-10:] == best
    again, scores = lists.search(query, 10, int(best[0]))
    assert len(again) <= len(found) and sorted(scores)[-10:] == best
    assert len(lists.search(query, 10, 2 * int(best[-1]) + 10**9)[0]) == 0  # the block is skipped


@pytest.mark.parametrize("n", [150, 3000])
def test_ann_recall(spark, n):
    rows, odd = odd_vectors(n=n, d=33)
    got = [tuple(r) for r in ann.search(vectors(spark, odd + [(6050, [0.0] * 33, "c"), (6100, [], "c")]), 20, 50).collect()]
    want = brute(rows, 50, 20, lambda x: x)
    assert len(got) == len(want)
    assert len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}) >= 0.9 * len(want)
    exact = {(a, c): s for a, _, c, s in want}
    assert all(exact[a, c] == s for a, _, c, s in got if (a, c) in exact)
    assert ann.search(vectors(spark, odd[:0])).count() == 0


def test_ann_recall_on_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = {(a, c) for a, _, c, _ in brute(rows, 20, 20, lambda x: x)}
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(table).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("spread", ["clusters", "lengths", "huge"])
def test_ann_recall_on_rows_that_codes_tell_apart_badly(spark, spread):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (2400, 24))
    if spread == "clusters":
        x = r.normal(0, 1, (4, 24))[r.integers(0, 4, 2400)] + 0.01 * x
    elif spread == "lengths":
        x *= np.exp(2 * r.normal(0, 1, (2400, 1)))
    else:
        x[:, 0] *= 1e30
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).astype(float).tolist())]
    want = {(a, c) for a, _, c, _ in brute(rows, 50, 20, lambda v: v)}
    got = {(a, c) for a, _, c, _ in (tuple(row) for row in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, 50).collect())}
    assert len(got) == len(want) and len(got & want) >= 0.999 * len(want)


def test_anisotropic_loss_spares_the_parallel_part():
    x = np.random.default_rng(0).normal(0, 1, (2000, 32))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(weight):
        q = ann.AnisotropicQuantiser.fit(x, weight=weight)
        codes = q.encode(x)
        rest = x - np.concatenate([q.codebooks[j][codes[:, j]] for j in range(16)], 1)
        return ((rest * u).sum(1) ** 2).mean()

    assert parallel(6.0) < 0.7 * parallel(1.0)


def test_packing_is_whole(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ODD_TEXTS + ["Hello, world! it's 2024; l'été ça va? " * k for k in (1, 30, 900)]
    docs = documents(spark, texts)
    pieces = [r.asDict() for r in packing.pack_documents(docs, path).collect()]
    tokenizer = Tokenizer.from_file(path)
    for k, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted((p for p in pieces if p["doc_id"] == k), key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in own) == ids.tobytes() and all(p["doc_tokens"] == len(ids) for p in own)
        assert [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
    by: dict = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in by.values():
        spans.sort()
        size = sum(n for _, n in spans)
        assert [a for a, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist() and size <= 2048 and size & (size - 1) == 0
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_tasks_get_even_shares_of_the_tokens(spark):
    r = random.Random(8)
    rows = [(k, np.full(n := r.choice([3, 20, 20, 400]), 7, "<u2").tobytes(), n, r.choice([1, 1, 5, k]) << 20 | k % 7) for k in range(3000)]
    rows += [(9, rows[0][1], rows[0][2], 1 << 20)] * 3000  # repeated rows
    tokens = packing.materialize(spark.createDataFrame(rows, "doc_id long, ids binary, n long, order_key long"), "test-tokens")
    total = sum(r[2] for r in rows)
    dealt = packing.dealt_by_tokens(tokens, total, total // 12).withColumn("p", F.spark_partition_id()).withColumn("n", F.octet_length("ids") / 2)
    shares = [(x["n"], x["c"]) for x in dealt.groupBy("p").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()]
    assert sum(c for _, c in shares) == len(rows) and sum(n for n, _ in shares) == total
    assert max(n for n, _ in shares) < 1.5 * total / 12


def test_windows_take_the_best_unused_neighbours():
    r = np.random.default_rng(2)
    docs = [(k, r.integers(0, 30, r.integers(5, 30))) for k in range(60)]
    idf, mean = r.random(30) + 0.1, 15.0
    packer = packing.Packer(64, idf, mean)
    pieces = packer.shard(docs)
    lengths = np.array([len(ids) for _, ids in docs])
    score = lambda seed, k: sum(
        idf[t] * (tf := (docs[k][1] == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[k] / mean)) for t in np.unique(docs[seed][1])
    )
    used: set = set()
    for sequence in sorted({p[3 + 1] for p in pieces}):
        inside = [p for p in pieces if p[4] == sequence]
        seed = inside[0][0]
        used.add(seed)
        for piece in inside[1:]:
            left = [k for k in range(60) if k not in used]
            assert score(seed, piece[0]) == pytest.approx(max(score(seed, k) for k in left))
            used.add(piece[0])


def test_word_encoder_equals_the_library():
    random = np.random.default_rng(1)
    letters = list("aZ\u00e9 \u00f1\u00d1'stredvml 09\u00b2\u00bd.,;!?-_\x00\x85\xa0\u2019\u65e5\u0130\u00df\u1e9e\u212a\u017f\u0301\u02b0\u00aa\t\n\x1c")
    texts = ["".join(random.choice(letters, random.integers(0, 15))) for _ in range(5000)] + ["a <|endoftext|> B"]
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in texts:
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_bm25_scores_match_the_formula():
    docs = [np.array(d) for d in ([1, 2, 2, 3], [2, 4], [5, 5, 5, 1])]
    idf = np.linspace(0.1, 1.0, 8)
    got = packing.ShardIndex(docs, idf, 3.0).scores(np.array([1, 2, 7]))
    for d, s in zip(docs, got):
        want = sum(idf[t] * (tf := (d == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / 3)) for t in (1, 2))
        assert s == pytest.approx(want)


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.round_trip(documents(spark, ODD_TEXTS), path).collect()}
    for k, text in enumerate(ODD_TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(documents(spark, []), path).count() == 0


def test_bpe_on_random_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder, r = Tokenizer.from_file(path), bpe.SpeculativeBpe(path), random.Random(2)
    for _ in range(400):
        text = "".join(r.choice(["ab", "the", "é", " ", "  ", "\n", "1", "'s", "ing", "漢", "́", "<|endoftext|>", "\x00", "😀"]) for _ in range(r.randint(0, 40)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def labelled(n, bad, good):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(4000)]
    text = lambda: [r.choice(words) for _ in range(r.randint(20, 120))]
    rows = []
    for k in range(n):
        y = k % 3 == 0
        rows.append((k, int(y), (bad if y else good)(text(), r)))
    return rows


def test_toxicity_learns_planted_words():
    def bad(words, r):
        for _ in range(3):
            words.insert(r.randrange(len(words)), r.choice(["grobnik", "slurvox", "zedfool"]))
        return " ".join(words)

    rows = labelled(600, bad, lambda w, r: " ".join(w))
    model = toxicity.fit([x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 != 1])
    test = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    hit = model.scores(model.features([toxicity.normalise(t) for _, _, t in test])) >= toxicity.THRESHOLD
    truth = np.array([y for _, y, _ in test], bool)
    assert (hit == truth).mean() > 0.95


def test_classifiers_on_awkward_rows(spark):
    docs = documents(spark, ODD_TEXTS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        scored = module.score_documents(docs, module.train(docs, none)).collect()
        assert len(scored) == len(ODD_TEXTS) and all(0 <= r["score"] <= 1 for r in scored)
        assert module.score_documents(docs.limit(0), module.train(docs, none)).count() == 0
    rows = [(k, k % 2, k % 2) for k in range(len(ODD_TEXTS))] + [(None, 1, 1), (1, None, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        model = module.train(docs, labels)
        scored = module.score_documents(docs, model).collect()
        kept = docs.select(module.predicted(model)("text").alias("p")).collect()
        assert [r["predicted"] for r in scored] == [r["p"] for r in kept]


def test_quality_ranks():
    rows = labelled(400, lambda w, r: " ".join(x + "%%%" for x in w), lambda w, r: " ".join(w))
    rows = [(k, 1 - y, t) for k, y, t in rows]
    model = quality.fit(rows[:300])
    got = model.scores(np.array([quality.features(t) for _, _, t in rows[300:]])) >= 0.5
    assert (got == np.array([y for _, y, _ in rows[300:]], bool)).all()


def test_extraction(spark):
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></ul></nav><div class=ad>Buy now, it is cheap.</div>"
        "<article><h1>A &amp; B</h1><p><b>First   line\n here.<br><p>Second&nbsp;one.</p><aside class='related'><a href='/x'>More</a></aside></article>"
        "<div class='comments'><p>Nice post, thanks a lot.</p></div><footer>&copy; me</footer>"
    )
    rows = [(1, "u", page, "c"), (2, None, None, "c"), (3, "u", "", "c"), (None, "u", "plain <unfinished", "c"), (1, "u", page, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extraction.extract(df).collect()
    assert len(got) == 5 and got[0]["text"] == "A & B\n\nFirst line here.\n\nSecond one." and got[1]["text"] == ""
    assert extraction.extract(df.limit(0)).count() == 0


def test_crf_on_held_out_pages():
    model, r, right, total = extraction.trained(), random.Random(99), 0, 0
    for _ in range(150):
        features, labels = extraction.labelled_page(r)
        right += sum(a == b for a, b in zip(model.decode(features), labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_exact():
    r = random.Random(0)
    w = lambda: (r.gauss(0, 1), r.gauss(0, 1))
    for _ in range(50):
        chain = crf.LinearChain({f: w() for f in "abc"}, (w(), w()), w(), w())
        seq = [[r.choice("abc")] for _ in range(6)]

        def total(y):
            s = chain.start[y[0]] + chain.stop[y[-1]] + sum(chain.weights[f[0]][k] for f, k in zip(seq, y))
            return s + sum(chain.transitions[a][b] for a, b in zip(y, y[1:]))

        best = max(([k >> b & 1 for b in range(6)] for k in range(64)), key=total)
        assert total(chain.decode(seq)) == pytest.approx(total(best))


def test_dom_blocks():
    blocks = leaf_blocks("<div id=mainContent><p>a <b>b</b>c<p>d<br>e</div><ul><li>f<li>g</ul><style>x{}</style>&lt;h&gt;<!-- no --> i")
    assert [b.text for b in blocks] == ["a bc", "d e", "f", "g", "<h> i"]
    assert {"main", "content"} <= blocks[0].names and block_features(blocks)


def test_revisits(spark):
    h = {"server": "a", "content-length": "9", "date": "1"}
    fresh = {"date": "5", "content-length": "0", "x": "y"}
    rows = [
        (1, "response", "http://www.A.com/p/?utm_source=z#f", 10, '"e1"', None, h), (2, "response", "https://a.com/p", 20, '"e2"', None, h),
        (3, "revisit", "a.com/p/", 15, 'W/"e1"', None, fresh), (4, "revisit", "https://a.com/p", 25, '"e1"', None, fresh),
        (5, "revisit", "https://a.com/p", 5, '"e1"', None, None), (6, "revisit", None, 5, None, None, None), (7, "request", "https://a.com/p", 14, '"e9"', None, h),
        (8, "revisit", "https://a.com/p", 25, None, None, fresh), (9, "revisit", "https://a.com/p", None, None, None, fresh),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, date long, etag string, last_modified string, headers map<string,string>")
    for ranges in (1, 5):
        got = {r["record_id"]: r for r in warc.resolve_revisits(df, ranges).collect()}
        assert {k: (r["status"], r["source_id"]) for k, r in got.items()} == {
            3: ("resolved", 1), 4: ("mismatch", None), 5: ("missing", None), 6: ("missing", None), 8: ("unverified", 2), 9: ("missing", None),
        }
        assert got[3]["headers"] == {"server": "a", "content-length": "9", "date": "5", "x": "y"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_canonical_addresses(spark):
    pairs = [
        ("http://me:pw@www2.A.com:80/p/?b=2&utm_source=z&a=1#f", "a.com/p?a=1&b=2"), ("https://a.com:443", "a.com"), ("http://a.com:443/", "a.com:443"), ("https://a.com:80/x//", "a.com:80/x"),
        ("a.com:80/?gclid", "a.com"), ("ftp://a.com:80/", "a.com:80"), ("http://a.com/?x=1?y&&", "a.com?x=1?y"), ("", ""), (None, None),
    ]
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(pairs)], "k int, u string")
    assert [r[0] for r in df.orderBy("k").select(warc.canonical_url(F.col("u"))).collect()] == [want for _, want in pairs]


def test_revisits_of_repeated_rows_with_other_columns(spark):
    h = {"server": "a"}
    rows = [(1, "response", "a.com", 1, "t", None, h, "x"), (1, "response", "a.com", 1, "t", None, {"server": "b"}, "x"), (2, "revisit", "a.com", 2, "t", None, None, "y")] * 2
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, date long, etag string, last_modified string, headers map<string,string>, status string")
    got = warc.resolve_revisits(df).collect()
    assert [(r["record_id"], r["status"], r["source_id"], r["headers"]) for r in got] == [(2, "resolved", 1, h)] * 2

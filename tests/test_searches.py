"""Percentiles, the keyword index, many patterns and slugs by blocks against plain forms."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import evaluation, filters, keywords, patterns, quantiles, retrieval

LEVELS = {"low": 0.0, "p10": 0.1, "half": 0.5, "p99": 0.99, "high": 1.0}


def test_percentiles_of_a_hot_key_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", "x", float(v)) for v in rng.normal(size=3000).round(2)] + [(None, "x", float(k)) for k in range(7)] + [("one", None, 5.0)] * 3
    rows += [("hot", "x", None), ("hot", "x", float("nan")), ("none", "x", None), ("wide", "x", -1e300), ("wide", "x", 1e300), ("wide", "x", float("inf"))]
    df = spark.createDataFrame(rows, "a string, b string, value double").repartition(8).withColumn("n", F.lit("clash"))
    got = {(r["a"], r["b"]): r for r in quantiles.percentiles(df, ["a", "b"], "value", LEVELS).collect()}
    assert set(got) == {("hot", "x"), (None, "x"), ("one", None), ("wide", "x")}
    for key, r in got.items():
        own = [v for a, b, v in rows if (a, b) == key and v is not None and v == v]
        assert r["n"] == len(own)
        if key[0] != "wide":
            assert np.allclose([r[k] for k in LEVELS], np.quantile(own, list(LEVELS.values())))
    assert got["wide", "x"]["low"] == -1e300 and got["wide", "x"]["half"] == 1e300 and got["wide", "x"]["high"] == float("inf")


def test_percentiles_of_nothing_and_of_wrong_levels(spark):
    empty = spark.createDataFrame([], "a string, value double")
    assert quantiles.percentiles(empty, ["a"], "value", LEVELS).count() == 0
    with pytest.raises(ValueError):
        quantiles.percentiles(empty, ["a"], "value", {"p": 1.5})


def _texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "and", "of", "oil", "pump", "valve", "brake", "a1", "zz"]
    weights = [60, 40, 30, 8, 6, 4, 2, 1, 1]
    texts = [(k, rng.choice([" ", ", ", "\n", ". "]).join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for k in range(n)]
    return [*texts, (n, None), (n + 1, ""), (n + 2, "ZZ the the"), (n + 3, "ZZ the the"), (None, "zz"), (n + 4, "of the of the of " * 400), (n + 5, "rare and the"), (n + 6, "a rare pump for the oil"), (n + 7, "the brake is rare")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = _texts(600, 1)
    df = spark.createDataFrame(rows, "doc long, body string").withColumn("term", F.lit("clash"))
    path = str(tmp_path_factory.mktemp("index")) + "/i"
    keywords.build(df, path, "doc", "body", block_texts=8)
    return rows, df, keywords.KeywordIndex(spark, path)


@pytest.mark.parametrize("tokens", [["the"], ["zz"], ["zz", "the", "brake"], ["a1", "A1", "nowhere"], ["nowhere"], []])
@pytest.mark.parametrize("k", [1, 5, 40, 2000])
def test_index_gives_the_ranks_of_a_scan(index, tokens, k):
    rows, df, built = index
    scan = retrieval.keyword_scores(df.where("doc IS NOT NULL"), sorted({t.lower() for t in tokens}) or ["\n"], "doc", "body").orderBy(F.desc("rank"), "id").limit(k)
    assert [tuple(r) for r in built.top_k(tokens, k).collect()] == [tuple(r) for r in scan.collect()]


def test_index_reads_few_postings(index):
    _, _, built = index
    everything = built.postings.count()
    assert built.within_reach(["zz"], 5).count() < 0.1 * everything
    of_both = built.postings.where("term IN ('the', 'rare')").count()
    assert built.within_reach(["rare", "the"], 3).count() < 0.1 * of_both  # a frequent word beside a rare one: blocks without the rare one can't reach the third rank


def test_postings_are_made_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, 7, 4, ["", "of", "the", "of"]), (1, 8, 1, [""]), (2, 9, 2, ["the", "the"])], "block long, id int, n_words int, w array<string>")
    made = keywords._postings(rows)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in made.collect()) == [("of", 1, 7, 2, 4, [1, 3]), ("the", 1, 7, 1, 4, [2]), ("the", 2, 9, 2, 2, [0, 1])]
    assert keywords._postings(rows.limit(0)).count() == 0


def test_phrases_equal_a_scan(index):
    rows, _, built = index
    for phrase in (["of", "the"], ["the", "the"], ["of", "the", "of"], ["zz"], ["none", "the"]):
        want = {}
        for key, text in rows:
            w = keywords_of(text)
            n = sum(w[i : i + len(phrase)] == phrase for i in range(len(w)))
            if n and key is not None:
                want[key] = n
        assert {r["id"]: r["n"] for r in built.phrase(phrase).collect()} == want
    assert built.phrase([]).count() == 0


def keywords_of(text):
    return "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()


def test_index_of_nothing(spark, tmp_path):
    keywords.build(spark.createDataFrame([], "doc long, body string"), str(tmp_path / "i"), "doc", "body")
    built = keywords.KeywordIndex(spark, str(tmp_path / "i"))
    assert built.top_k(["the"], 3).count() == 0 and built.phrase(["the"]).count() == 0


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_patterns_equal_all_pairs(spark, most_bytes):
    rng = random.Random(5)
    letters = "abcé漢"
    texts = [(k, "".join(rng.choices(letters, k=rng.randrange(0, 40)))) for k in range(120)] + [(500, None), (None, "abc"), (501, ""), (502, "ab" * 3000 + "c漢c"), (3, "abcabc"), (503, "x😀y")]
    pats = [(k, "".join(rng.choices(letters, k=rng.randrange(1, 7)))) for k in range(80)] + [(90, ""), (91, None), (92, "ab"), (93, "ab"), (94, "zzz"), (None, "a"), (95, "c漢c"), (96, "😀")]
    t = spark.createDataFrame(texts, "id long, text string").withColumns({"pattern": F.lit("clash"), "gram": F.lit(1)})
    p = spark.createDataFrame(pats + pats[:5], "pattern_id int, pattern string").withColumn("id", F.lit(0))
    got = sorted(tuple(r) for r in patterns.found_in(t, p, most_bytes).collect())
    want = sorted({(i, k) for i, text in texts for k, pattern in pats if i is not None and k is not None and text and pattern and pattern in text})
    assert got == want and len(want) > 500


@pytest.mark.parametrize("most_bytes", [1 << 20, -1])
def test_patterns_of_nothing(spark, most_bytes):
    t, p = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([], "pattern_id string, pattern string")
    assert patterns.found_in(t, p, most_bytes).count() == 0
    assert patterns.found_in(spark.createDataFrame([(1, "abc")], "id long, text string"), p, most_bytes).count() == 0


def test_slugs_by_blocks_equal_all_pairs(spark):
    rng = random.Random(8)
    words = ["brake", "pad", "oil", "chain", "front", "rear", "tyre", "valve"]
    slug = lambda n: "-".join(rng.choices(words, k=n))
    known = {(m, k): slug(rng.randrange(1, 4)) for m in range(6) for k in range(12)}
    known[0, 20] = ""
    asked = {(m, "".join(c for c in slug(rng.randrange(1, 4)).replace("-", " ") if rng.random() > 0.2)) for m in range(7) for _ in range(15)} | {(1, "zzzz"), (2, None), (3, "abcd-dcba")}
    s = spark.createDataFrame([(m, k, v) for (m, k), v in known.items()] + [(1, 99, None)], "id int, nth int, slug string")
    r = spark.createDataFrame([*asked, *asked], "id int, name string").withColumn("slug", F.lit("clash"))
    made = {row["name"]: row["made"] for row in r.select("name", S.slug(F.col("name")).alias("made")).collect()}

    def plain(m, name):
        own = [v for (k, _), v in sorted(known.items()) if k == m]
        q = made[name]
        if q is None or q in own:
            return q
        inside = [v for v in own if q in v or v in q]
        if inside:
            return inside[0]
        best = max(own, key=lambda v: SequenceMatcher(None, q, v).ratio(), default=None)
        return best if best is not None and SequenceMatcher(None, q, best).ratio() >= 0.4 else None

    got = {(x["id"], x["name"]): x["slug"] for x in filters.closest_by_blocks(r, s, S.slug).collect()}
    assert got == {key: plain(*key) for key in asked}
    assert len(set(got.values())) > 10


def test_pinned_takes_manuals_and_tokens_as_they_are(spark):
    q = spark.createDataFrame([(1, "the MT-09 bike"), (2, "mt09 and r1-long"), (3, None), (4, "shared name"), (5, "abc")], "id int, text string")
    t = spark.createDataFrame([(7, "MT 09"), (7, "mt.09"), (8, "R1 long"), (9, "shared"), (10, "Shared"), (11, "abc"), (12, None)], "manual_id int, token string")
    assert {r["id"]: r["manual_id"] for r in filters.pinned(q, t).collect()} == {1: 7, 2: None, 3: None, 4: None, 5: None}


def test_lanes_put_signal_metrics_in_the_common_columns(spark):
    df = spark.createDataFrame([("event_finding", 0.1, 0.2, 0.3), ("lookup", 0.1, 0.2, 0.3), (None, 0.1, 0.2, 0.3)], "question_type string, section_recall double, signal_recall double, value_accuracy double")
    a, b, c = evaluation.by_lane(df).collect()
    assert (a["section_recall"], a["value_accuracy"], a["exploration_cost"], a["trajectory_efficiency"], a["claim_precision"]) == (0.2, 0.3, 0.0, 1.0, None)
    assert b.asDict() | {"question_type": 0} == c.asDict() | {"question_type": 0}
    assert (b["section_recall"], b["value_accuracy"], b["exploration_cost"]) == (0.1, 1.0, None)


def test_section_metrics_by_hand_and_without_joins(spark):
    r = random.Random(11)
    spell = lambda: r.choice(["A-1", "a_1", "b 2", "B2", "c", "ｃ", "d-4", "", "--", None])
    frames = {n: [(r.choice([1, 2, 3, 4, 9, None]), spell()) for _ in range(30)] for n in ("expected", "covered", "claims", "quoted", "read")}
    ids = [1, 2, 2, 3, 4, 5]
    df = {n: spark.createDataFrame(x, "entry int, slug string") for n, x in frames.items()}
    entries = spark.createDataFrame([(k,) for k in ids], "entry int")
    key = lambda t: re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", t).casefold())
    want, cost = {}, {}
    for k in set(ids):
        e, h, c, q, d = ({s for n, s in x if n == k and s} for x in frames.values())
        known, matched = {key(s) for s in e}, [s for s in c if key(s) in {key(t) for t in e}]
        only = [s for s in q if key(s) not in {key(t) for t in matched}]
        want[k] = (len(h & e) / len(e), min(len(c), len(matched) + len(only)) / len(c) if c else 1.0) if known or e else (None, None)
        cost[k] = 1 - len(d & c) / len(d) if d else 0.0
    out = evaluation.section_metrics(entries, df["expected"], df["covered"], df["claims"], df["quoted"])
    costs = evaluation.exploration_cost(entries, df["read"], df["claims"])
    assert {r["entry"]: (r["section_recall"], r["claim_precision"]) for r in out.collect()} == want
    assert {r["entry"]: r["exploration_cost"] for r in costs.collect()} == cost
    for x in (out, costs):  # each join of slugs would order them once more
        assert "Join" not in x._jdf.queryExecution().executedPlan().toString()

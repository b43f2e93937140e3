"""The registered queries against their SQL, and the pipeline's stages against plain forms of them."""

import os
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from tessera.llm import extraction, packing, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return "null"
    return round(float(x), 6) if isinstance(x, (int, float, np.number)) else str(x)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(queries.ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents with toxic, rejected, copied and clean ones, and labels for two thirds of them."""
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(3000)]
    texts, toxic, bad = [], [], []
    for k in range(360):
        w = list(r.choice(words, r.integers(30, 90)))
        toxic.append(k % 5 == 0)
        bad.append(k % 7 == 0)
        if toxic[-1]:
            for _ in range(4):
                w.insert(int(r.integers(len(w))), str(r.choice(["grobnik", "slurvox", "zedfool"])))
        texts.append(" ".join(x + "%%%" for x in w) if bad[-1] else " ".join(w))
    texts += texts[1:4] + ["", None]
    toxic += toxic[1:4] + [False, False]
    bad += bad[1:4] + [False, False]
    path = str(tmp_path_factory.mktemp("sf"))
    n = len(texts)
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(not bad[k]), int(toxic[k])) for k in range(n) if k % 9], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts, np.array(toxic), np.array(bad)


def test_filtering_stages_take_out_what_the_operators_reject(spark, made):
    path, texts, toxic, bad = made
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for stage, module, flag, keeps in ((corpus_pipeline.drop_toxic, toxicity, toxic, 0), (corpus_pipeline.keep_good, quality, bad, 1)):
        kept = stage(spark, docs, path)
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.collect()}
        model = module.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
        scored = {r["doc_id"]: r["predicted"] for r in module.score_documents(docs, model).collect()}
        assert ids == {k for k, p in scored.items() if p == keeps}
        held = [k for k in range(360) if zlib.crc32(str(k).encode()) % 3 == 1]
        assert np.mean([(k not in ids) == flag[k] for k in held]) > 0.93


def test_the_whole_pipeline_packs_what_the_stages_keep(spark, made):
    path, texts, _, _ = made
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
    left = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, path).toPandas()
    assert set(pieces["doc_id"]) == set(left)
    tokenizer = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path(queries.WORD_BPE))
    for doc, own in pieces.groupby("doc_id"):
        ids = np.array(tokenizer.encode(left[doc], add_special_tokens=False).ids + [packing.END_ID], "<u4")
        own = own.sort_values("start")
        assert own["length"].sum() == len(ids) == own["doc_tokens"].iloc[0]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()


def test_toxicity_holds_against_mislabelled_rows():
    r = np.random.default_rng(9)
    words = ["".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(4000)]
    rows_ = []
    for k in range(900):
        w, y = list(r.choice(words, r.integers(30, 120))), int(k % 4 == 0)
        if y and r.random() < 0.6:  # four in ten toxic labels are wrong
            for _ in range(3):
                w.insert(int(r.integers(len(w))), str(r.choice(["grobnik", "slurvox", "zedfool"])))
        rows_.append((k, y, " ".join(w)))
    model = toxicity.fit(rows_[:600])
    test = [t for _, _, t in rows_[600:]]
    named = np.array([any(w in t for w in ("grobnik", "slurvox", "zedfool")) for t in test])
    hit = model.scores(model.features([toxicity.normalise(t) for t in test])) >= toxicity.THRESHOLD
    assert hit[named].mean() > 0.95 and hit[~named].mean() < 0.02


def test_deep_pages_take_linear_time():
    import time

    model = extraction.trained()
    took = []
    for n in (2_000, 16_000):
        page = "".join(f"<div class=c{k}><p>text {k}" for k in range(n))
        began = time.perf_counter()
        extraction.main_text(page, model)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]


def test_labelled_sample_of_repeated_rows_is_bounded(spark):
    from tessera.llm.common import labelled_sample

    docs = spark.createDataFrame([(k % 3, f"text {k}", "x") for k in range(300)] + [(9, "y" * 1000, "x")], "doc_id long, text string, _t string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in (0, 1, 2, 9)] * 2, "doc_id long, quality int, toxic int")
    got = labelled_sample(docs, labels, "toxic", 10, class_bytes=500)
    assert len(got) == len({g[0] for g in got}) <= 3 and 9 not in {g[0] for g in got}


def test_quality_learns_from_every_permitted_row(spark):
    import numpy as np
    from tessera.llm import quality
    from tessera.llm.common import held_out

    draw = np.random.default_rng(5)
    plain = lambda k: " ".join(f"word{n}" for n in draw.integers(0, 50, 20 + k % 30))
    rows = [(k, ("@@ ## %% " * 5 + plain(k)) if k % 20 == 0 else plain(k), int(k % 20 > 0)) for k in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    blocks = quality._blocks(docs, labels, 50)
    width = 4 * len(quality.features(""))
    permitted = {r["doc_id"]: r["text"] for r in docs.where(~held_out(docs["doc_id"])).collect()}
    found = {(c, b[at : at + width]) for r in blocks.collect() for c in ("good", "bad") for b in [bytes(r[c])] for at in range(0, len(b), width)}
    assert found == {("bad" if k % 20 == 0 else "good", quality.features(t).astype("<f4").tobytes()) for k, t in permitted.items()}
    assert blocks.where("good = '' OR bad = ''").count() == 0
    model = quality.train(docs, labels, 50)
    got = model.scores(np.array([quality.features(t) for _, t, _ in rows])) >= 0.5
    assert (got == [y == 1 for _, _, y in rows]).mean() > 0.99


def test_threshold_is_the_exact_quantile():
    import numpy as np
    from tessera.llm import quality

    s = np.sort(np.random.default_rng(3).choice(np.random.default_rng(4).standard_cauchy(3000), 5000))

    def total(edges):
        if edges is None:
            return s[0], s[-1]
        x = s[(s >= edges[0]) & (s <= edges[-1])]
        at = np.minimum(np.searchsorted(edges, x, "right") - 1, quality.BINS - 1)
        least, most = np.full(quality.BINS, np.inf), np.full(quality.BINS, -np.inf)
        np.minimum.at(least, at, x)
        np.maximum.at(most, at, x)
        return np.bincount(at, minlength=quality.BINS) / len(s), least, most

    for share in (0.001, 0.15, 0.5, 0.97):
        k = int(np.ceil(share * len(s) - 1e-6))
        low = s[k - 1]
        assert quality._quantile(total, share) == (low + s[s > low][0]) / 2

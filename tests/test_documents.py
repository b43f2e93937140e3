"""Chunking, ids, trees and filters on small known cases."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import texts as X
from tessera.operators import chunking, indexing, manuals, writers
from tessera.sources import manuals as sources


def test_paragraphs_keep_together_and_carry_their_end():
    c = chunking.Chunker(60, 12)
    a, b, d = "one two three four five", "six seven eight nine", "ten eleven twelve thirteen fourteen"
    assert c.chunks(f"{a}\n\n{b}\n\n{d}") == [f"{a}\n\n{b}", f"eight nine\n\n{d}"]
    assert chunking.Chunker(60, 0).chunks(f"{a}\n\n{b}\n\n{d}") == [f"{a}\n\n{b}", d]
    assert c.chunks("  \n ") == [] and c.chunks(a) == [a]


def test_long_paragraphs_by_sentences_then_words():
    c = chunking.Chunker(20, 5)
    assert c.chunks("Aa bb cc dd. Ee ff gg hh ii. Jj kk.") == ["Aa bb cc dd.", "dd. Ee ff gg hh ii.", "ii. Jj kk."]
    assert c.chunks("aaaa bbbb cccc dddd eeee ffff") == ["aaaa bbbb cccc dddd", "dddd eeee ffff"]
    whole = " ".join(f"w{k}" for k in range(300))
    assert set(" ".join(c.chunks(whole)).split()) == set(whole.split()) and max(map(len, c.chunks(whole))) <= 20


def test_cjk_sentences_and_clauses():
    c = chunking.Chunker(10, 0)
    assert [x.strip() for x in c.chunks("第一句很長的話。第二句也是。")] == ["第一句很長的話。", "第二句也是。"]
    assert "".join(c.chunks("沒有標點的很長很長很長的文字")) == "沒有標點的很長很長很長的文字"
    assert chunking.paragraphs("第一行。\n第二行\n第三行。") == ["第一行。", "第二行\n第三行。"]


def test_images_take_one_paragraph_and_stay_whole():
    text = "before\n\n![a](b.png)\n\nwhat it shows\n\nafter"
    assert chunking.paragraphs(text) == ["before", "![a](b.png)\n\nwhat it shows", "after"]
    big = "![a](b.png)\n\n" + "x " * 40
    assert big.strip() in chunking.Chunker(30, 5).chunks(f"start\n\n{big}\n\nend")


def test_chunks_of_sections_are_numbered_through(spark):
    rows = [(1, 0, "T", "Generic", ["P0101"], "a. " * 300), (1, 1, "U", "Generic", [], "short"), (2, 0, "V", "Generic", [], None), (2, 1, "W", "Generic", [], " ")]
    df = spark.createDataFrame(rows, "id long, nth int, title string, vehicle_model string, codes array<string>, body string")
    got = sorted((r["id"], r["chunk_index"], r["title"]) for r in chunking.chunk_sections(df, 200, 20).collect())
    assert [g[:2] for g in got] == [(1, k) for k in range(len(got))] and got[-1][2] == "U"
    assert chunking.chunk_sections(df.limit(0)).count() == 0


def lines(spark, text):
    return spark.createDataFrame([(1, k + 1, line) for k, line in enumerate(text.split("\n"))], "id long, line_no long, line string")


def test_heading_tree_with_stubs_and_repeats(spark):
    text = (
        "# Book\n## Brake\n<span id='x'></span>![fig](a.png)\n*Vision description: a\nlong one*\n{12}------\n## Brake\nprose\n### Pads\ntext\n"
        "# 2. Remove:\n## Brake\nmore\n### Photo\n![only](b.png)"
    )
    got = manuals.sections(lines(spark, text)).orderBy("line_no").collect()
    assert [(r["line_no"], r["slug"], r["parent_line"], r["end_line"], r["subtree_end"], r["n_below"]) for r in got] == [
        (1, "book", None, 7, 16, 3), (7, "brake", 1, 9, 12, 1), (9, "pads", 7, 12, 12, 0), (12, "brake-2", 1, 16, 16, 0),
    ]


def test_section_titles_and_models(spark):
    df = spark.createDataFrame([("<a id='1'></a>**Bold  title** ", "an stf 900 bike"), ("__x__", "Tricity 155 and MWS-150A"), ("", "none")], "t string, m string")
    got = [tuple(r) for r in df.select(manuals.clean_title(F.col("t")), manuals.vehicle_model(F.col("m"))).collect()]
    assert got == [("Bold title", "STF-900"), ("x", "MWS-150A"), ("", "Generic")]
    anchored = spark.createDataFrame([('<span id="page-1-1"></span>Bleeding the brake',), ('<span id="page-1-1"></span>a. Turn it',), ("plain",)], "l string")
    assert [r[0] for r in anchored.select(manuals.promoted(F.col("l"))).collect()] == ["### Bleeding the brake", '<span id="page-1-1"></span>a. Turn it', "plain"]


def test_ids_that_may_collide(spark):
    bases = ["a", "a", "a-2", "a", "b", "a-2", "a-3"]
    df = spark.createDataFrame([("m", k, b) for k, b in enumerate(bases)], "manual_id string, nth int, base string")
    got = [r["node_id"] for r in indexing.unique_ids(df).orderBy("nth").collect()]
    want: list = []
    for b in bases:
        k = 2
        name = b
        while name in want:
            name, k = f"{b}-{k}", k + 1
        want.append(name)
    assert got == want and len(set(got)) == len(bases)


def test_normal_slugs_fold_wide_letters(spark):
    df = spark.createDataFrame([("Ｂrake_Pads-２",), ("STRASSE",), ("straße",), (None,)], "s string")
    assert [r[0] for r in df.select(X.normal_slug(F.col("s"))).collect()] == ["brakepads2", "strasse", "strasse", None]


def test_frontmatter_round_trip(spark):
    df = spark.createDataFrame([("x", 'say "no"'), (None, "b")], "a string, b string").select(X.frontmatter({"a": F.col("a"), "b": F.col("b")}).alias("t"))
    fields = [r[0] for r in df.select(X.frontmatter_fields(F.col("t"))).collect()]
    assert fields[1] == {"b": "b"} and fields[0]["a"] == "x"


def test_inserts_add_nothing_twice(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), (None, 5)], "k string, v int")
    added = writers.new_rows(old, new, ["k"], ["v"])
    assert sorted(map(tuple, added.where("k IS NOT NULL").collect())) == [("b", 3)]
    assert writers.new_rows(old.unionByName(added), new.where("k IS NOT NULL"), ["k"], ["v"]).count() == 0


def test_manual_files_of_a_folder(spark, tmp_path):
    for name in ("a.md", "sub/b.md", "images/c.md", ".queue/d.md", "e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("# T\n")
    assert sorted(r["manual_id"] for r in sources.manual_files(spark, str(tmp_path)).collect()) == ["a", "b"]


def test_rules_are_validated():
    from tessera.operators import rules
    from tessera.plans.signals import RULES

    assert rules.validate(RULES) == RULES
    for change in ({"severity": "odd"}, {"conditions": [{"type": "odd"}]}, {"conditions": []}):
        with pytest.raises(ValueError):
            rules.validate([{**RULES[0], **change}])
    with pytest.raises(ValueError):
        rules.validate([RULES[0], RULES[0]])


def merge_by_hand(leaves, least=50):
    """One at a time, as a list: a thin leaf goes into the next one, at the end into the one before."""
    out = [dict(title=t, aliases=[], chars=c, keeps=k, lo=n, hi=n + 1) for n, (t, c, k) in enumerate(leaves)]
    i = 0
    while i < len(out):
        if out[i]["keeps"] or out[i]["chars"] >= least or len(out) == 1:
            i += 1
            continue
        j = i + 1 if i + 1 < len(out) else i - 1
        thin, taker = out[i], out[j]
        taker["aliases"].append(thin["title"])
        taker["aliases"] += thin["aliases"] if j < i or thin["aliases"] else []
        taker["chars"] += thin["chars"]
        taker["lo"], taker["hi"] = min(taker["lo"], thin["lo"]), max(taker["hi"], thin["hi"])
        out.pop(i)
    return [(x["title"], sorted(x["aliases"]), x["lo"], x["hi"]) for x in out]


def test_thin_leaves_join_their_neighbours(spark):
    import random

    draw = random.Random(4)
    lists = [[(f"t{k}", draw.choice([0, 10, 30, 49, 50, 200]), draw.random() < 0.2) for k in range(draw.randint(1, 9))] for _ in range(40)]
    rows = [(str(m), 1, k, t, k, k + 1, c, keeps) for m, leaves in enumerate(lists) for k, (t, c, keeps) in enumerate(leaves)]
    df = spark.createDataFrame(rows, "manual_id string, parent int, nth int, title string, span_start int, span_end int, chars long, keeps boolean")
    got: dict = {}
    for r in indexing.merged_leaves(df).orderBy("manual_id", "span_start").collect():
        got.setdefault(int(r["manual_id"]), []).append((r["title"], sorted(r["aliases"]), r["span_start"], r["span_end"]))
    # the brute force counts an alias once for each leaf that it passed through
    want = {m: [(t, sorted(set(a)), lo, hi) for t, a, lo, hi in merge_by_hand(leaves)] for m, leaves in enumerate(lists)}
    assert got == want


def test_a_tree_tiles_its_items(spark):
    items = [
        (0, 1, "page_header", "Brakes"), (1, 1, "title_candidate", "Removing the pads"), (2, 1, "para", "x" * 80), (3, 2, "title_candidate", "Thin"), (4, 2, "title_candidate", "Fitting"), (5, 2, "para", "P0101 " + "y" * 80),
        (6, 3, "page_header", "Engine"), (7, 3, "para", "z" * 90), (8, 3, "title_candidate", "• no title"), (9, 4, "title_candidate", "Code table"), (10, 4, "para", "P0101 P0102 " + "w" * 60),
    ]
    df = spark.createDataFrame([("m", i, p, k, t, "") for i, p, k, t in items], "manual_id string, idx int, page int, kind string, text string, html string")
    nodes, cards, found = indexing.build_index(df, F.lower("chapter"), ["brakes", "engine"])
    got = [(r["title"], r["aliases"], r["chapter"], r["span_start"], r["span_end"]) for r in nodes.orderBy("span_start").collect()]
    assert got == [("Removing the pads", ["Brakes"], "Brakes", 0, 3), ("Fitting", ["Thin"], "Brakes", 3, 6), ("Engine", [], "Engine", 6, 9), ("Code table", [], "Engine", 9, 11)]
    assert {r["code"]: (r["n_rows"], r["detect_ref"] is not None) for r in cards.collect()} == {"P0101": (2, True), "P0102": (1, True)}
    assert all(r["passes"] for r in found.collect())


def test_unique_ids_equal_a_search_of_all_suffixes(spark):
    import random

    r = random.Random(2)
    rows = [(m, k, r.choice(["a", "a-2", "a-2-2", "b", "a-3", None, ""])) for m in (1, 2) for k in range(80)]
    got = sorted(((x["manual_id"], x["nth"], x["node_id"]) for x in indexing.unique_ids(spark.createDataFrame(rows, "manual_id long, nth long, base string")).collect()))
    want, used = [], {1: set(), 2: set()}
    for m, k, base in rows:
        free = base if base is None or base not in used[m] else next(f"{base}-{n}" for n in range(2, 200) if f"{base}-{n}" not in used[m])
        used[m].add(free)
        want.append((m, k, free))
    assert got == want


def test_sections_are_cut_once_and_dealt_without_joins(spark):
    lines = ["intro STF 900", "# One", "Aa bb. " * 9, "text P0301", "## 3. step", "# Two", "", "### Three", "nmax 155 end"]
    df = spark.createDataFrame([(k, n + 1, line) for k in (1, 2) for n, line in enumerate(lines[k - 1 :])], "id long, line_no int, line string")
    parsed = manuals.parse_sections(df)
    got = [(r["nth"], r["title"], r["level"], r["body"], r["vehicle_model"], r["codes"]) for r in parsed.where("id = 1").orderBy("nth").collect()]
    assert got[:2] == [(0, "Introduction", 0, "intro STF 900", "STF-900", []), (1, "One", 1, ("Aa bb. " * 9) + "\ntext P0301\n## 3. step", "STF-900", ["P0301"])]
    assert [g[:2] for g in got[2:]] == [(2, "Two"), (3, "Three")] and [g[4] for g in got[2:]] == ["STF-900", "NMAX-155"]
    assert {r["vehicle_model"] for r in parsed.where("id = 2").collect()} == {"NMAX-155"}
    chunks = chunking.chunk_sections(parsed, 30, 5)
    for k in (1, 2):
        rows = chunks.where(F.col("id") == k).orderBy("chunk_index").collect()
        bodies = {r["nth"]: r["body"] for r in parsed.where(F.col("id") == k).collect()}
        assert [(r["section"], r["text"]) for r in rows] == [(n, t) for n in sorted(bodies) for t in chunking.Chunker(30, 5).chunks(bodies[n])]
        assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("MapInArrow|ArrowEvalPython", plan)) == 1 and plan.count("Join") == 1  # with the documents' models

"""Running values over ranges, nested spans, trees and cards, against brute force."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import scans, trees
from tessera.plans.trees import WORDS, document_items
from tessera.queries import QUERIES

ITEMS = "manual_id string, idx int, page int, kind string, text string, html string"
SF = "/root/testdata/sf0.001"


def test_running_values_equal_plain_windows(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 2, None]), r.choice([None, *range(-20, 60)]), k, r.choice([None, 1.0, 2.0, 5.0])) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, at long, tie int, v double")
    w = Window.partitionBy("k").orderBy("at", "tie")
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("s", F.coalesce(F.sum("v").over(upto), F.lit(0))).withColumn("l", F.last("v", True).over(upto)).withColumn("b", F.last(F.struct("v"), True).over(past)["v"])
    for width in (1, 7, 1000):
        got = scans.running(df, ["k"], "at", ["tie"], width, {"s": F.col("v")}, {"l": F.col("v")}, {"b": F.struct("v")}).withColumn("b", F.col("b.v"))
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert scans.running(df.limit(0), ["k"], "at", ["tie"], 5, {"s": F.col("v")}).count() == 0


def nested(r, lo, hi, depth=0):
    out, at = [], lo
    while at < hi:
        end = r.randint(at + 1, hi)
        if r.random() < 0.7:
            out.append((at, end))
            if depth < 4:
                out += nested(r, at, end, depth + 1)
        at = end
    return out


def test_deepest_of_nested_spans(spark):
    r = random.Random(5)
    spans = [(m, lo, hi, k) for m in (1, 2, 3) for k, (lo, hi) in enumerate(nested(r, 0, 120))] + [(1, 5, 5, 900)]
    points = [(m, r.choice([None, *range(-3, 125)]), n) for m in (1, 2, 3, 4, None) for n in range(60)]
    df = scans.deepest_span(spark.createDataFrame(points, "m int, at long, n int"), spark.createDataFrame(spans, "m int, start long, end long, span_id int"), ["m"], 10)
    want = []
    for m, at, n in points:
        # equal spans nest in the order of their ids
        around = [(hi - lo, -k) for s, lo, hi, k in spans if at is not None and s == m and lo <= at < hi]
        want.append((m, at, n, -min(around)[1] if around else None))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


# --- trees by hand: a list of sections first, then siblings folded one at a time


def sections_by_hand(items):
    page_names, chapter = {}, "前言"
    for i in items:
        if i["kind"] == "page_header" and i["text"] in ("引擎系統", "故障排除詳細", "Engine overhaul"):
            page_names.setdefault(i["page"], i["text"])
    runs = []
    for page in sorted({i["page"] for i in items}):
        chapter = page_names.get(page, chapter)
        mine = [i for i in items if i["page"] == page]
        if runs and runs[-1][0] == chapter:
            runs[-1][1].extend(mine)
        else:
            runs.append((chapter, mine))
    return runs


def node_by_hand(title, kind, inside, lo, children=()):
    return {"title": title, "type": kind, "aliases": [], "lo": lo, "hi": lo + len(inside), "items": list(inside), "kids": list(children)}


def thin_by_hand(n):
    return not n["kids"] and sum(len(i["text"] or "") + len(i["html"] or "") for i in n["items"]) < 50 and all(i["kind"] != "image" for i in n["items"])


def folded_by_hand(nodes, parent=None):
    out = list(nodes)
    for n in out:
        n["kids"] = folded_by_hand(n["kids"], n)
    k = 0
    while k < len(out):
        n = out[k]
        if not thin_by_hand(n):
            k += 1
        elif len(out) > 1:
            to = out[k + 1] if k + 1 < len(out) else out[k - 1]
            to["aliases"] += [n["title"], *n["aliases"]]
            to["lo"], to["hi"] = min(to["lo"], n["lo"]), max(to["hi"], n["hi"])
            to["items"] = to["items"] + n["items"]
            del out[k]
        elif parent is not None:
            parent["aliases"] += [n["title"], *n["aliases"]]
            return []
        else:
            break
    return out


def tree_by_hand(items):
    named, seen = set(), set()
    good = lambda i: i["kind"] == "title_candidate" and i["text"] in TITLES
    for i in items:
        if good(i) and "編號" in i["text"]:
            named.add(i["text"][-5:].upper())
    roots = []
    for chapter, inside in sections_by_hand(items):
        starts = []
        for i in inside:
            if good(i):
                starts.append((i["idx"], i["text"], False))
            if i["kind"] == "para" and (i["text"] or "").strip() in ("油門的調整", "汽門間隙的檢查"):
                starts.append((i["idx"], i["text"], True))
            both = f"{i['text'] or ''} {i['html'] or ''}"
            if i["kind"] in ("para", "table") and "故障代碼編號" in both:
                code = both.split("故障代碼編號")[1].split()[0][:5].upper()
                if code not in named | seen:
                    seen.add(code)
                    starts.append((i["idx"], f"故障代碼編號 {code}", True))
        nodes, end = [], inside[-1]["idx"] + 1
        for k, (at, title, made) in enumerate(starts):
            upto = starts[k + 1][0] if k + 1 < len(starts) else end
            held = [i for i in inside if at <= i["idx"] < upto]
            kind = next((t for t, ps in WORDS.node_types.items() if any(p in title for p in ps)), "description")
            if made and "編號" in title:
                kind = "fault_isolation"
            for i in held:
                sign = next((t for p, t in trees.TABLE_TYPES if i["kind"] == "table" and p in (i["html"] or "")), None)
                if sign and kind == "description":
                    kind = sign
            n = node_by_hand(title, kind, held, at)
            symptoms = [s for s in nodes if s["title"] not in WORDS.causes]
            if "故障排除" in chapter and title in WORDS.causes and symptoms:
                symptoms[-1]["kids"].append(n)
                symptoms[-1]["hi"], symptoms[-1]["items"] = n["hi"], symptoms[-1]["items"] + n["items"]
            else:
                nodes.append(n)
        roots.append(node_by_hand(chapter, "description", inside, inside[0]["idx"], nodes))
    return folded_by_hand(roots)


def flat_by_hand(nodes, parent=None, depth=0):
    for n in nodes:
        yield depth, n["title"], parent, n["type"], n["lo"], n["hi"], sorted(n["aliases"])
        yield from flat_by_hand(n["kids"], n["title"] + str(n["lo"]), depth + 1)


TITLES = ("引擎", "點火系統", "煞車系統", "引擎無法起動", "火星塞", "Cold engine", "故障代碼編號 P0105")
NOISE = ("注 意", "3. 拆下", "• bullet", "這是一句話。", "x", "▲ ▼", "y" * 61)


def drawn_items(r, n):
    page, out = 1, []
    for idx in range(n):
        page += r.random() < 0.2
        kind = r.choice(["page_header", "title_candidate", "title_candidate", "para", "para", "table", "image"])
        html, text = "", ""
        if kind == "page_header":
            text = r.choice(["引擎系統", "故障排除詳細", "故障排除詳細", "YAMAHA", "2A-15", "Engine overhaul"])
        elif kind == "title_candidate":
            text = r.choice(TITLES + NOISE)
        elif kind == "para":
            text = r.choice(["短", "長" * 60, "油門的調整", "汽門間隙的檢查", "3. 油門的調整", "見故障代碼編號 p0101 " + "碼" * 50, "故障代碼編號P0105", None])
        elif kind == "table":
            html = r.choice(["<tr>鎖緊扭力</tr>", "<tr><td>故障防護系統</td></tr>" + "w" * 50, "<tr>故障代碼編號 P0102</tr>", None])
        out.append({"idx": idx, "page": int(page), "kind": kind, "text": text, "html": html})
    return out


@pytest.fixture(scope="module")
def manuals():
    r = random.Random(11)
    return {f"m{k}": drawn_items(r, r.choice([1, 5, 40, 120])) for k in range(30)}


@pytest.fixture(scope="module")
def built(spark, manuals):
    rows = [(m, i["idx"], i["page"], i["kind"], i["text"], i["html"]) for m, items in manuals.items() for i in items]
    items = spark.createDataFrame(rows, ITEMS)
    return items, trees.nested_tree(items, WORDS).cache()


def test_nested_trees_equal_those_by_hand(manuals, built):
    rows = built[1].collect()
    ids = {(r["manual_id"], r["node_id"]): r for r in rows}
    assert len(ids) == len(rows)
    got: dict = {m: [] for m in manuals}
    for r in rows:
        up = ids.get((r["manual_id"], r["parent_id"]))
        assert (up is None) == (r["depth"] == 0)
        got[r["manual_id"]].append((r["depth"], r["title"], up and up["title"] + str(up["span_start"]), r["node_type"], r["span_start"], r["span_end"], sorted(r["aliases"])))
    for m, items in manuals.items():
        assert sorted(got[m], key=str) == sorted(flat_by_hand(tree_by_hand(items)), key=str), m
    assert {r["depth"] for r in rows} == {0, 1, 2} and {"fault_isolation", "specification", "operation"} <= {r["node_type"] for r in rows}


def test_the_query_equals_trees_by_hand(spark):
    items: dict = {}
    for i in document_items(spark, SF).orderBy("manual_id", "idx").collect():
        items.setdefault(i["manual_id"], []).append(i.asDict())
    rows = QUERIES["nested_tree"](spark, SF).collect()
    got = sorted((r["manual_id"], r["depth"], r["title"], r["node_type"], r["span_start"], r["span_end"], r["aliases"]) for r in rows)
    want = sorted((m, d, t, k, lo, hi, "|".join(a)) for m, x in items.items() for d, t, _, k, lo, hi, a in flat_by_hand(tree_by_hand(x)))
    assert got == want and {r["depth"] for r in rows} == {0, 1, 2}
    cards = QUERIES["nested_cards"](spark, SF).collect()
    nodes = {(r["manual_id"], r["node_id"]): r for r in rows}
    assert cards
    for c in cards:
        at = next(i["idx"] for i in items[c["manual_id"]] if c["code"] in (i["html"] or "").upper() or f"編號 {c['code']}" in (i["text"] or ""))
        around = [n for n in nodes.values() if n["manual_id"] == c["manual_id"] and n["span_start"] <= at < n["span_end"]]
        assert max(around, key=lambda n: n["depth"])["node_id"] == c["isolate_ref"]


def test_a_three_level_tree(spark):
    body = "文" * 60
    texts = [("page_header", "故障排除"), ("title_candidate", "引擎無法起動"), ("para", body), ("title_candidate", "引擎"), ("para", body), ("title_candidate", "點火系統"), ("para", body), ("title_candidate", "火星塞"), ("para", body)]
    df = spark.createDataFrame([("m", k, 1 + k // 4, kind, t, "") for k, (kind, t) in enumerate(texts)], ITEMS)
    got = [(r["depth"], r["title"], r["parent_id"], r["span_start"], r["span_end"], r["page_first"], r["page_last"]) for r in trees.nested_tree(df, WORDS).orderBy("depth", "span_start").collect()]
    top, symptom = "general-des-故障排除", "engine-tro-引擎無法起動"
    assert got == [(0, "故障排除", None, 0, 9, 1, 3), (1, "引擎無法起動", top, 1, 7, 1, 2), (1, "火星塞", top, 7, 9, 2, 3), (2, "引擎", symptom, 3, 5, 1, 2), (2, "點火系統", symptom, 5, 7, 2, 2)]
    assert trees.nested_tree(df.limit(0), WORDS).count() == 0


def test_tasks_of_nested_spans_follow_the_rows(spark, monkeypatch):
    few = sorted(map(tuple, QUERIES["deepest_spans"](spark, SF).collect()), key=str)
    monkeypatch.setattr(scans, "ROWS_A_TASK", 500)
    out = QUERIES["deepest_spans"](spark, SF)
    dealt = re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), REPARTITION", out._jdf.queryExecution().executedPlan().toString())
    assert dealt and min(map(int, dealt)) >= 18  # some 9,000 rows; the session's shuffles have 4
    assert sorted(map(tuple, out.collect()), key=str) == few


def test_running_minimum(spark):
    rows = [(k % 2, (7 * k) % 40, k, None if k % 3 else (11 * k) % 29) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, at int, tie int, v int")
    plain = df.withColumn("m", F.min("v").over(Window.partitionBy("k").orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(str, scans.running(df, ["k"], "at", ["tie"], 7, mins={"m": F.col("v")}, tasks=3).collect())) == sorted(map(str, plain.collect()))


def test_cards_point_to_the_deepest_node(spark, built):
    items, tree = built
    nodes = tree.collect()
    blocks: dict = {}
    for i in sorted(items.collect(), key=lambda i: i["idx"]):
        both = f"{i['text'] or ''} {i['html'] or ''}"
        if "故障代碼編號" in both:
            blocks.setdefault((i["manual_id"], both.split("故障代碼編號")[1].split()[0][:5].upper()), i["idx"])
    want = {}
    for (m, code), at in blocks.items():
        around = [n for n in nodes if n["manual_id"] == m and n["span_start"] <= at < n["span_end"]]
        want[m, code] = max(around, key=lambda n: n["depth"])["node_id"]
    got = {(c["manual_id"], c["code"]): c["isolate_ref"] for c in trees.fault_cards(tree, items, 16).collect()}
    assert got == want and len({c for _, c in got}) == 3


def test_cards_of_fault_tables(spark):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    small = "<table>" + row("故障防護系統") + row("p0101", "Throttle", "x", "stalls", "limp") + "</table>"
    large = "<table>" + row("故障防護系統") + row("P0101", "<b>Air</b>") + row(" P0102\n", "Water", "", "hot", "off") + "</table>"
    items = spark.createDataFrame([("m", 0, 1, "table", "", small), ("m", 1, 1, "table", None, large), ("m", 2, 1, "para", "故障代碼編號 P0101", None), ("n", 0, 1, "para", None, None)], ITEMS)
    nodes = spark.createDataFrame([("m", "top", 0, 0, 3), ("m", "a", 1, 0, 1), ("m", "b", 1, 1, 2), ("m", "c", 1, 2, 3)], "manual_id string, node_id string, depth int, span_start int, span_end int")
    got = sorted(tuple(r) for r in trees.fault_cards(nodes, items).collect())
    assert got == [("m", "P0101", "Air", "", "", "b", "c"), ("m", "P0102", "Water", "hot", "off", "b", "b")]

"""Jaccard join, substring dedup and string tiling against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from protolens.llm import components, decontaminate, jaccard_join, substring_dedup

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(w[k:k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    base = [r.choice(vocabulary) for _ in range(90)]
    for _ in range(60):  # near copies of one text
        b = list(base)
        for _ in range(r.randint(0, 4)):
            b[r.randrange(90)] = r.choice(vocabulary)
        out.append(" ".join(b))
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    for _ in range(50):  # a passage that many share, and little else
        out.append(passage + " " + " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25))))
    out += [r.choice(out) for _ in range(20)] + [r.choice(out).upper() for _ in range(10)]
    out += [None, "", " ", "a", "a", "A b", "a b c", "a  b\tc", "a b c d", " ".join(f"u{i}" for i in range(5000))]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("short,block", [(32, 1024), (3, 11)])
def test_components_equal_brute_force(spark, short, block):
    rows = copies()
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n int, sid string").repartition(5)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.link_components(df, short=short, block=block).collect()}
    assert got == brute_components(rows)


def test_keep_one_leaves_a_row_a_component(spark):
    rows = [(3, "a b c d e", 1), (3, "a b c d e", 1), (1, "A b c d e", 2), (4, "q", 3), (5, None, 4), (6, "", 5), (None, "z z", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(map(tuple, jaccard_join.keep_one(df).collect()), key=str)
    assert got == sorted([(1, "A b c d e", 2), (4, "q", 3), (5, None, 4), (6, "", 5), (None, "z z", 6)], key=str)


def test_jaccard_edge_cases(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.link_components(spark.createDataFrame([], schema)).collect() == []
    got = jaccard_join.link_components(spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, None), (None, "q")], schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, 3), (3, 2, 3), (None, 0, None), (None, 1, None)], key=str)


def test_sketch_bound_and_prefix_rule_lose_no_link():
    rule, r = jaccard_join.Rule(85), random.Random(2)
    for _ in range(400):
        n = r.randint(1, 60)
        a = set(r.sample(range(1000), n))
        b = set(a)
        for _ in range(r.randint(0, 6)):
            b.discard(r.choice(sorted(a)))
            b.add(r.randrange(1000, 1100))
        if not b:
            continue
        inter, union = len(a & b), len(a | b)
        link = 100 * inter >= 85 * union
        ga, gb = (np.sort(np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for x in (a, b))
        sa, sb = (np.frombuffer(jaccard_join.parity(g, 512), np.uint8) for g in (ga, gb))
        d = int(np.bitwise_count(sa ^ sb).sum())
        assert d <= union - inter
        assert rule.links(inter, len(a) + len(b)) == link
        if link:
            assert not rule.differs(len(a) + len(b), d) and rule.sizes(len(a), len(b))
            assert set(ga[:rule.prefix(len(a))]) & set(gb[:rule.prefix(len(b))])


def test_connected_components_of_a_path_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def brute_dedup(rows, length):
    first, words = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - length + 1 if i is not None else 0):
            g = tuple(w[k:k + length])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1 if i is not None else 0):
            if first[tuple(w[k:k + length])] < i:
                gone[k:k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,period", [(50, 31), (12, 7), (5, 5)])
def test_removed_words_equal_brute_force(spark, length, period):
    r = random.Random(2)
    vocabulary = [f"w{i}é" for i in range(30)]
    passages = [[r.choice(vocabulary) for _ in range(70)] for _ in range(5)]
    rows = []
    for i in range(60):
        t = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))]
        for _ in range(r.randint(0, 3)):
            a = r.randint(0, 25)
            t.append("  ".join(r.choice(passages)[a:a + r.randint(20, 70)]))
        rows.append((i, " \n".join(t)))
    rows += [(5, rows[7][1]), (5, rows[7][1]), (200, None), (201, ""), (None, rows[9][1]), (None, None), (202, rows[11][1]), (203, " ".join(["a"] * 130)), (204, "a " * 3000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, pos int, h long").repartition(4)
    got = sorted(map(tuple, substring_dedup.remove_repeats(df, length, period, with_text=True).collect()), key=str)
    assert got == brute_dedup(rows, length)


def test_dedup_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("period", [1, 2, 3, 7, 13, 31])
def test_difference_cover(period):
    cover = substring_dedup.difference_cover(period)
    assert {(x - y) % period for x in cover for y in cover} == set(range(period))


def brute_tiles(a, b, least):
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((i, j, n))
        if not found:
            return out
        for i, j, n in found:
            if all(fa[i:i + n]) and all(fb[j:j + n]):
                fa[i:i + n] = fb[j:j + n] = [False] * n
                out.append((i, j, n))


def test_tiling_equals_brute_force():
    r = random.Random(3)
    for _ in range(150):
        a, b = ([r.randint(1, 3) for _ in range(r.randint(0, m))] for m in (14, 20))
        got = decontaminate.tile(np.array(a, np.uint64), np.array(b, np.uint64), 2)
        assert sorted(got) == sorted(brute_tiles(a, b, 2))


def test_tiling_of_long_and_periodic_texts(monkeypatch):
    monkeypatch.setattr(decontaminate, "_PAIRS", 7)
    r = random.Random(8)
    for _ in range(60):
        words = [r.randint(1, 3) for _ in range(8)]
        a, b = ([w for _ in range(r.randint(1, 4)) for w in words[r.randint(0, 6):] + [r.randint(1, 9)] * r.randint(0, 2)] for _ in range(2))
        got = decontaminate.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert sorted(got) == sorted(brute_tiles(a, b, 3))
        total = sum(n for *_, n in got)
        some = sum(n for *_, n in decontaminate.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3, enough=total / 2))
        assert total / 2 <= some <= total
    monkeypatch.undo()
    assert decontaminate.tile(np.full(300, 7, np.uint64), np.full(20_000, 7, np.uint64), 5) == [(0, 0, 300)]


def test_leaks_equal_plain_tiling_of_every_pair(spark):
    r = random.Random(21)
    word = lambda: f"w{r.randint(0, 5)}"
    items = [(k, " ".join(word() for _ in range(r.randint(1, 18)))) for k in range(12)]
    docs = []
    for i in range(60):
        parts = [word() for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            w = r.choice(items)[1].split()
            s = r.randint(0, len(w) - 1)
            parts += w[s:s + r.randint(1, 12)] + [word()]
        docs.append((i, " ".join(parts)))
    want = set()
    for k, item in items:
        w = item.split()
        for i, text in docs:
            tiles = brute_tiles(w, text.split(), min(5, len(w)))
            tiled = sum(n for *_, n in tiles)
            if tiled >= 0.5 * len(w):
                want.add((i, k, len(tiles), tiled, len(w)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(x)[:5] for x in decontaminate.find_leaks(df, bench).collect()} == want
    assert {x["doc_id"] for x in decontaminate.keep_clean(df, bench).collect()} == {i for i, _ in docs} - {w[0] for w in want}


def test_sets_that_share_a_64_bit_hash_stay_apart(spark, monkeypatch):
    one, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, one), (2, other), (3, one + " end"), (4, other + " end"), (5, one), (6, other)]
    sets = spark.createDataFrame([(i, 37, 7, 1 if "a0" in t else 2, None, None, None) for i, t in rows[:2] + rows[4:]],
                                 "doc_id long, n int, sid long, sid2 long, coarse binary, fine binary, prefix binary")
    apart, reps = jaccard_join.one_id_a_set(sets)
    ids = {r["doc_id"]: r["sid"] for r in apart.collect()}
    assert ids[1] == ids[5] != ids[2] == ids[6] and apart.columns == sets.columns
    assert sorted((r["rep"], r["low"]) for r in reps.collect()) == [(1, 1), (2, 2)]
    inner = jaccard_join.set_table
    monkeypatch.setattr(jaccard_join, "set_table", lambda *a: inner(*a).withColumn("sid", F.when(F.col("n") > 0, F.lit(7)).otherwise(F.col("sid"))))
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1, 6: 2}


def test_reordered_passages_are_found_and_clean_texts_left(spark):
    item = " ".join(f"Item{i}" for i in range(30))
    w = item.split()
    docs = [(1, "x " + item.upper() + " y"), (2, " ".join(w[15:] + ["filler"] * 5 + w[:15])), (3, " ".join(w[:14]) + " z"), (4, " ".join(w[:10] + w[:10])),
            (5, None), (6, ""), (7, "clean words only " * 4000), (8, " ".join(w[:8]) + " - " + " ".join(w[20:28])), (None, item)]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None), (13, item), (14, "")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.find_leaks(df, bench).collect()), key=str)
    want = [(1, 1, 30), (2, 2, 30), (8, 2, 16), (None, 1, 30)]
    assert got == sorted([(d, i, n, t, 30, t / 30) for d, n, t in want for i in (10, 13)], key=str)
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect()) == [3, 4, 5, 6, 7]
    assert decontaminate.find_leaks(df.limit(0), bench).collect() == [] and decontaminate.find_leaks(df, bench.limit(0)).collect() == []


def test_benchmark_blocks_give_the_same_leaks(spark):
    items = [(k, " ".join(f"b{k}x{i}" for i in range(12))) for k in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = decontaminate.item_blocks(bench, block_bytes=150)
    assert len(blocks) > 2 and sorted(i for b in blocks for i in b.ids) == list(range(9))


def test_unspaced_scripts_and_short_items_are_searched(spark):
    item = "人工知能は、世界を大きく変える技術である。"
    docs = [(1, "前置き" + item.replace("、", "") + "続きの文章"), (2, "人工知能は別の話。"), (3, "𠀀𠀁𠀂𠀃𠀄𠀅"), (4, "Capital OF France, they say"), (5, "capital of the France"), (6, "ภาษาไทยไม่มีช่องว่าง"), (7, "。、!")]
    bench = [(10, item), (11, "capital of France"), (12, "𠀁𠀂𠀃𠀄𠀅𠀆"), (13, "ไทยไม่มีช่อง"), (14, "。")]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_tiles"], r["tiled"], r["item_tokens"]) for r in decontaminate.find_leaks(df, items).collect()}
    assert got == {(1, 10): (1, 19, 19), (3, 12): (1, 5, 6), (4, 11): (1, 3, 3), (6, 13): (1, 12, 12)}
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(df, items).collect()) == [2, 5, 7]


def test_one_benchmark_block_at_a_time(spark, monkeypatch):
    items = [(k, " ".join(f"b{k}x{i}" for i in range(12))) for k in range(9)]
    docs = spark.createDataFrame(items + [(20, "clean words and nothing else")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    tables = []
    monkeypatch.setattr(decontaminate, "written", lambda df, name: tables.append(name) or df.localCheckpoint())
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, block_bytes=300).collect()) == [(k, k) for k in range(9)]
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, bench, block_bytes=300).collect()] == [20]
    n = len(decontaminate.item_blocks(bench, block_bytes=300))
    assert n > 1 and tables == ["leaks-block"] * n + ["clean-block"] * n


def test_keep_one_with_columns_of_its_own_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 1, 2, 3), (2, text, 4, 5, 6), (3, "other words stand here", 7, 8, 9), (3, "other words stand here", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, again int, `a.b` int")
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]

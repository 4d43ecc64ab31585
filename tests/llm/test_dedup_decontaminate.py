import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from uas_spark.llm import decontaminate, simhash
from uas_spark.llm.components import components


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def groups(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(159, 300), (7, 7), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == groups(nodes, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_match_all_pairs(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 1}
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 4, 12])):  # balls and chains of near values
            fps.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                f ^= 1 << b
    fps = sorted(fps)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2]
    exp = groups([signed[f] for f in fps], [(signed[a], signed[b]) for a, b in pairs])
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    linked = {n for e in pairs for n in (signed[e[0]], signed[e[1]])}
    for limit in (2, 16, 1000):  # cells split, mixed, and all paired
        found = simhash.links(df, limit)
        got = {r.node: r.root for r in components(found).collect()}
        assert {n: got.get(n, n) for n in exp} == exp
        assert set(got) == linked
    # unsplit cells give every link, as pairs of fingerprints that share a cell
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in found.collect()} == {
        (max(signed[a], signed[b]), min(signed[a], signed[b])) for a, b in pairs}


def test_cells_share_exactly_within_distance_two(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 5)):
            b ^= 1 << bit
        rows.append((a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", F.expr(f"arrays_overlap({simhash._cells('a')}, {simhash._cells('b')})").alias("o")).collect()

    def counts(x):
        return np.array([(x >> 2 * i & 3).bit_count() for i in range(32)])
    for r in got:
        near = np.abs(counts(r.a % (1 << 64)) - counts(r.b % (1 << 64))).sum() <= 2
        assert r.o == near


def test_near_duplicates_brute_force_and_odd_rows(docs, odd_rows):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["sun", "moon", "star", "sky", "rain"]) + str(rng.randint(0, 9)) for _ in range(400))
            for _ in range(12)]
    rows = [*odd_rows]
    for i, t in enumerate(base):
        w = t.split()
        rows.append((100 + 10 * i, t))
        for j in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = f"new{j}"
            rows.append((101 + 10 * i + j, " ".join(v)))
    got = simhash.near_duplicates(docs(rows, clash=True)).collect()
    assert len(got) == len(rows)
    fp = [(r[0], slow_fingerprint(r[1])) for r in rows]
    assert sorted((str(r.id), r.fingerprint) for r in got) == sorted((str(i), f"{f:016x}") for i, f in fp)
    distinct = sorted({f for _, f in fp})
    comp = groups(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    low = {}
    for i, f in fp:
        if i is not None:
            low[comp[f]] = min(low.get(comp[f], 1 << 60), i)
    assert sorted((str(r.id), str(r.component_id)) for r in got) == sorted(
        (str(i), str(low.get(comp[f]))) for i, f in fp)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_keep_one(docs, odd_rows):
    df = docs(odd_rows, clash=True)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    # 1, 2, 3 and a row without an id have no words; 5 is repeated and 6 a copy of it
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "7", "8", "9", "None"])
    x, y = "one text about rivers and stones", "another text that tells of letters"
    kept = simhash.keep_one(docs([(5, x), (5, y), (9, y), (None, y), (None, "a third one of its own")])).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("5", x), ("5", y), ("None", "a third one of its own")])
    assert simhash.keep_one(docs([])).count() == 0


def slow_leaks(docs, items, threshold=0.8):
    def shingles(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    out = []
    for d, t in docs:
        s = shingles(t)
        for i, u in items:
            q = shingles(u)
            if q and len(s & q) >= threshold * len(q):
                out.append((d, i, len(s & q), len(q)))
    return sorted(out)


def test_leaks_brute_force(spark, docs, odd_rows):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 60)))) for i in range(30)]
    items += [(30, items[0][1]), (31, "too short"), (32, None), (33, ""), (None, items[1][1])]
    rows = [r[:2] for r in odd_rows]
    for d in range(100, 180):
        t = rng.choices(vocab, k=rng.choice([3, 30, 400, 6000]))
        for _ in range(rng.randint(0, 3)):
            w = items[rng.randrange(30)][1].split()
            if rng.random() < 0.5:  # a share of it only
                w = w[:int(len(w) * rng.uniform(0.5, 1))]
            at = rng.randrange(len(t))
            t[at:at] = [x.upper() if rng.random() < 0.2 else x + rng.choice(["", ",", "."]) for x in w]
        rows.append((d, " ".join(t)))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    got = decontaminate.leaks(docs(rows, clash=True), bench).collect()
    exp = slow_leaks([r for r in rows if r[0] is not None], [x for x in items if x[0] is not None])
    assert sorted((r.id, r.item_id, r.n_found, r.n_item) for r in got) == exp and exp
    assert all(abs(r.containment - r.n_found / r.n_item) < 1e-12 for r in got)
    left = decontaminate.clean(docs(rows, clash=True), bench)
    bad = {e[0] for e in exp}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in rows if r[0] not in bad)
    assert decontaminate.leaks(docs([]), bench).count() == 0
    assert decontaminate.leaks(docs(rows), bench.filter("false")).count() == 0
    leak = items[0][1] + " w1 w2 w3 w4 w5 w6"
    left = decontaminate.clean(docs([(5, leak), (5, "clean"), (None, leak), (None, "clean")], clash=True), bench).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == [("5", "clean"), ("None", "clean")]
    assert decontaminate.clean(docs([]), bench).count() == 0
    # a filter that lets nearly everything through changes nothing
    full = decontaminate.leaks(docs(rows), bench, filter_bits=256).collect()
    assert sorted((r.id, r.item_id, r.n_found, r.n_item) for r in full) == exp


def test_a_common_phrase_makes_no_candidates(spark, docs, monkeypatch):
    """Documents and items that share an opening phrase: no more pairs than there are rows."""
    rng = random.Random(8)
    words = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(k))
    opening = "once upon a time there was"
    bench = spark.createDataFrame([(i, f"{opening} {words(30)}") for i in range(400)], "item_id long, text string")
    rows = [(i, f"{opening} {words(60)}") for i in range(400)]
    seen = []
    keep = decontaminate.saved
    monkeypatch.setattr(decontaminate, "saved", lambda df: seen.append(keep(df)) or seen[-1])
    out = decontaminate.leaks(docs(rows), bench)
    assert out.count() == 0
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert "n_found" in joined and seen[0].count() == 800  # two shingles of the phrase in each document
    assert len({r.shingle for r in seen[0].collect()}) == 2

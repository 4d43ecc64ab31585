import collections
import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from uas_spark.llm import ann, chat, queries

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ nearest neighbours

def exact(rows, is_query, k):
    """(query_id, rank, vec_id, score) by rows: ids may repeat, lengths differ."""
    ok = [(j, i, np.array(v, float)) for j, (i, v) in enumerate(rows)
          if v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for j, i, q in ok:
        if i is not None and is_query(i):
            d = sorted((-float(q @ v / np.sqrt((q @ q) * (v @ v))), n is None, n or 0, m) for m, n, v in ok
                       if m != j and len(v) == len(q))[:k]
            out += [(i, r, None if no else n, -s) for r, (s, no, n, _) in enumerate(d, 1)]
    return out


@pytest.mark.parametrize("dims,at_once", [(64, 4096), (100, 25), (3, 4096)])
def test_nearest_against_brute_force(spark, dims, at_once):
    rng = np.random.default_rng(dims)
    centre = rng.standard_normal((6, dims))
    rows = [(i, (centre[i % 6] + rng.standard_normal(dims)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[10][1]) for i in range(40)]  # one vector many times
    rows += [(2000, None), (2010, [0.0] * dims), (2020, [float("nan")] * dims), (2030, [float("inf")] * dims),
             (2040, [None] + [1.0] * (dims - 1)), (2050, []), (2060, [1.0] * (dims + 1)), (3000, [1e200] * dims),
             (3010, [1e-200] * dims)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, x string")
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, at_once=at_once).collect()
    exp = exact([(i, [x / max(map(abs, v)) for x in v] if i in (3000, 3010) else v) for i, v in rows], lambda i: i % 10 == 0, 5)
    assert len(got) == len(exp)
    found = len({(r.query_id, r.vec_id) for r in got} & {(e[0], e[2]) for e in exp})
    assert found >= 0.97 * len(exp)
    ties = [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 10]
    assert ties == [(i + 1, 1000 + i) for i in range(5)]
    assert ann.nearest(df.filter("vec_id < 0"), F.col("vec_id") % 10 == 0).count() == 0
    few = ann.nearest(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_nearest_of_every_length_and_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(60)] + [(100 + i, rng.standard_normal(2).tolist()) for i in range(55)]
    rows += [(7, rows[10][1]), (7, rows[11][1]), (10, (2 * np.array(rows[10][1])).tolist()), (None, rows[20][1]), (200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS row", "'c' AS code", "2 AS rank")
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, epsilon=9.0).collect()
    exp = exact(rows, lambda i: i % 10 == 0, 5)
    key = lambda t: (t[0], t[1], round(t[3], 9))
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, exp))
    assert sorted((r.query_id, str(r.vec_id)) for r in got) == sorted((e[0], str(e[2])) for e in exp)


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    est, err = ann.estimate(*ann.encode(x, turn), *ann._quantised(ann._unit(q) @ turn), ann.EPSILON)
    off = np.abs(est - ann._unit(q) @ ann._unit(x).T)
    assert (off <= err).mean() > 0.995 and abs((est - ann._unit(q) @ ann._unit(x).T).mean()) < 0.01


# ------------------------------------------------------------------ chat windows

CONV = "conv_id long, turn long, role string, text string"
HARD = ["", None, "<|im_end|>\n", "<|im_start|>user<|im_sep|>", "a<\\|b", "<\\\\|<|<<|", "ends in <", "|starts", "tail \\",
        "<|im_end|", "line\nbreak", "é日𝒳 " * 5, "$1 \\1 [x]"]


def made(spark, seed, n=30):
    rng, rows = random.Random(seed), []
    for c in range(n):
        turns = rng.choice([0, 1, 2, 8, 60, 200])
        for t in range(turns):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "tool<|", None])
            text = rng.choice(HARD) if rng.random() < 0.3 else " ".join(["word"] * rng.choice([1, 5, 20, 90]))
            rows.append((c, t if rng.random() < 0.97 else None, role, text))
    rows += [(None, 0, "user", "no conversation"), (999, 0, "system", "alone"), (998, 0, "user", "same"), (998, 0, "user", "same")]
    return rows, spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS pos", "2 AS block", "3 AS tokens", "4 AS window")


def ordered(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((-(1 << 62) if t is None else t, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), x.decode()) for _, r, x in sorted(v)] for c, v in by.items()}


@pytest.mark.parametrize("budget,history", [(60, 15), (200, 60), (1024, 256)])
def test_windows(spark, budget, history):
    rows, df = made(spark, budget)
    formatted = chat.windows(df, budget, history)
    got, exp = formatted.collect(), ordered(rows)
    size = lambda x: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", x)) + chat.TURN_TOKENS
    un = lambda s: __import__("re").sub(r"<\\(\\*)\|", r"<\1|", s)
    by = collections.defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    assert set(by) == set(exp)
    for c, ws in by.items():
        told, loss, turns = [], [], exp[c]
        system = turns[0] if turns[0][0] == "system" else None
        for w in sorted(ws, key=lambda w: w.window):
            parts = w.text.split(chat.END)
            assert parts.pop() == ""
            turn = [tuple(map(un, p.removeprefix(chat.START).split(chat.SEP))) for p in parts]
            context, own = turn[:w.n_context], turn[w.n_context:]
            assert w.window == len(told) and own
            if system and told:
                assert context and context.pop(0) == system
            # history is the turns just before, whole, within its limit, and as many as fit
            back = told[1:] if system else told
            assert context == (back[-len(context):] if context else [])
            assert sum(size(x) for _, x in context) <= history
            if len(back) > len(context):
                assert sum(size(x) for _, x in back[-len(context) - 1:]) > history
            room = max(budget - history - (size(system[1]) if system else 0), budget // 4)
            span = own[1:] if system and not told else own
            assert sum(size(x) for _, x in span) <= room or len(span) == 1
            told += own
            spans = [w.text[s.start:s.end] for s in w.loss]
            assert [un(s) for s in spans] == [x for r, x in own if r == "assistant"]
            loss += map(un, spans)
        assert told == turns
    out = {r.conv_id: r for r in chat.digest(formatted).collect()}
    for c, turns in exp.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(w.text) for w in by[c])
    assert chat.windows(df.filter("false")).count() == 0


def test_no_python_in_the_chat_plan(spark):
    plan = queries.QUERIES["op10_chat"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------ queries and pipeline

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    exp = con.sql(queries.ORACLE[name])
    assert sorted(exp.columns) == cols
    rows = sorted((tuple(r) for r in exp.select(*cols).fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == rows and rows


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash_dedup", "decontamination", "personal_data", "packing"]


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty tables, null and repeated ids, extra columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __key string, __quality double, __rank int"
    prose = "the quiet river runs below the old stone bridge and the winter garden lies behind the long wall of the mill "
    other = "a letter came from the summer house by the sea where the children sat at the window and looked for the boats "
    leak = "every morning the keeper of the northern light climbs one hundred and forty steps to trim the lamp and write the log "
    rows = [(5, prose * 3), (5, other * 3), (9, other * 3), (None, prose * 3), (6, f"{other} {leak} {prose}"), (6, prose * 2 + other),
            (None, f"{leak} {other}"), (7, None), (8, ""), (None, None), (10, "This."), (10, "This.")]
    for name, data, items in (("odd", rows, [(1, leak), (None, prose), (2, None)]), ("empty", [], [(1, leak)]), ("bare", rows, [])):
        home = f"{tmp_path}/{name}"
        spark.createDataFrame([(d, t, "en", "s", 1, "x", 0.5, 1) for d, t in data], schema).write.parquet(f"{home}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
        docs = spark.read.parquet(f"{home}/documents.parquet")
        for stage, fn in corpus_pipeline.STAGES[1:4]:
            out = fn(spark, docs, home)
            assert out.columns == docs.columns
            out.write.parquet(f"{home}/out/{stage}")
            docs = spark.read.parquet(f"{home}/out/{stage}")
        left = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "odd":
            assert sorted(left, key=str) == sorted([(5, prose * 3), (5, other * 3), (6, prose * 2 + other), (7, None), (10, "This.")], key=str)
        assert corpus_pipeline.run(spark, home).count() == len(corpus_pipeline.run(spark, home).select("sequence_id", "offset").distinct().collect())
        assert name != "empty" or not left


def test_pipeline_stages_on_planted_documents(spark, tmp_path):
    from test_dedup_decontaminate import groups, slow_fingerprint, slow_leaks
    from test_text_operators import slow_spans

    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice("river stone cloud winter garden letter bridge window summer old quiet".split())
                               + rng.choice(["", "s", "ly"]) for _ in range(n)) + "."
    rows = [(i, prose(rng.choice([3, 40, 300]))) for i in range(120)]
    items = [(i, prose(30)) for i in range(6)]
    rows += [(200 + i, f"{prose(400)} {items[i % 6][1]} {prose(20)}") for i in range(12)]  # leaks
    rows += [(300 + i, rows[i][1]) for i in range(30)]  # copies
    rows += [(400 + i, " ".join(w + "%%%" for w in prose(80).split())) for i in range(15)]  # junk
    rows += [(500 + i, f"{prose(50)} ann{i}@mail.example.org {prose(50)}") for i in range(5)]
    rows += [(600, None), (601, ""), (602, "This.")]
    home = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{home}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, home)
        out.write.parquet(f"{home}/out/{name}")
        new = spark.read.parquet(f"{home}/out/{name}")
        if name != "packing":
            assert new.columns == docs.columns
        seen.append([r.asDict() for r in new.collect()])
        docs = new
    good, one, clean, private, packed = seen
    assert {r["doc_id"] for r in good} == {d for d, _ in rows if not 400 <= d < 500}
    fp = {r["doc_id"]: slow_fingerprint(r["text"]) for r in good}
    nodes = sorted(set(fp.values()))
    comp = groups(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    first = {}
    for d, f in sorted(fp.items()):
        first.setdefault(comp[f], d)
    assert {r["doc_id"] for r in one} == set(first.values())
    bad = {x[0] for x in slow_leaks([(r["doc_id"], r["text"]) for r in one], items)}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in one} - bad and bad
    before = {r["doc_id"]: r["text"] for r in clean}
    for r in private:
        assert not slow_spans(r["text"] or "") and (r["text"] is None or r["n_chars"] == len(r["text"]))
        if not slow_spans(before[r["doc_id"]] or ""):
            assert r["text"] == before[r["doc_id"]]
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in private} == set(before)
    assert os.path.isdir(f"{home}/out/packing")
    again = corpus_pipeline.run(spark, home)
    assert sorted((r.doc_id, r.piece, r.length) for r in again.collect()) == sorted(
        (r["doc_id"], r["piece"], r["length"]) for r in packed)

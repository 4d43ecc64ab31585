"""Language identification, personal data, quality and language-model scores."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from uas_spark.llm import langid, lmscore, pii, quality

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------------ language identification

def test_kneser_ney_probabilities_sum_to_one(spark, docs):
    rows = [(i, "the cat sat on the mat and the dog ate the cat food " * 2, "en") for i in range(30)]
    rows += [(100 + i, "le chat est sur la table et le chien mange du pain", "fr") for i in range(30)]
    model = langid.fit(docs(rows), sample_chars=10**6)
    assert model.labels == ["en", "fr"]
    letters = sorted({c for r in rows for c in r[1]} | {" "})
    for context in ("the", "e c", " le", "zzq"):
        total = np.exp(langid.Model._block(model, langid.normalised("qq", model.letters))[:0].sum(axis=0)) * 0
        for c in [*letters, "ω"]:
            code = np.array([ord(x) for x in context + c], np.uint32)
            total = total + np.exp(model._block(code)[-1].astype(float))
        # all letters and one unseen one; the alphabet is shared, so unseen letters of a language count
        assert (np.abs(total - 1) < 0.02).all(), (context, total)


def plain_kneser_ney(texts, alphabet, order=4):
    """p(character | history) of one language, by dictionaries of whole n-grams."""
    counts = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        for i in range(1, len(t)):
            for n in range(1, min(order, i + 1) + 1):
                counts[n][t[i + 1 - n:i + 1]] += 1
    shares, weights = [{}], [{}]
    for n in range(1, order + 1):
        c = counts[n]
        if n < order:  # distinct characters before
            before = collections.Counter(g[1:] for g in counts[n + 1])
            c = {g: max(before[g], 1) for g in counts[n]}
        n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total, kinds = collections.Counter(), collections.Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            kinds[g[:-1]] += 1
        shares.append({g: (x - d) / total[g[:-1]] for g, x in c.items()})
        weights.append({ctx: d * kinds[ctx] / total[ctx] for ctx in total})

    def p(gram):
        if not gram:
            return 1 / alphabet
        n = len(gram)
        return shares[n].get(gram, 0.0) + weights[n].get(gram[:-1], 1.0) * p(gram[1:])
    return p


def test_model_equals_plain_kneser_ney(spark, docs):
    rng = random.Random(11)
    vocabulary = {"en": "the river bridge of stone and water was old".split(),
                  "fr": "le pont de pierre sur la rivière était très vieux".split(), "xx": "abba baab zzz aabb".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(12)), x) for i, x in
            enumerate(rng.choice(sorted(vocabulary)) for _ in range(90))]
    df = docs(rows)
    # the same tenth calibrates and stays out
    ids = df.select("doc_id", "lang", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("t")).withColumn(
        "draw", F.pmod(F.xxhash64("id", "t", F.lit(11)), F.lit(1 << 30))).withColumn(
        "held", F.pmod(F.xxhash64("id", F.lit(12)), F.lit(10)) == 0).collect()
    least = {x: min(r.draw for r in ids if r.lang == x) for x in vocabulary}
    used = {r.doc_id for r in ids if not r.held or r.draw == least[r.lang]}
    assert len(used) < len(rows)
    plain = lambda t: " " + re.sub(r"[\W\d_]+", " ", t.lower() + " ")
    texts = {x: [plain(t) for i, t, lang in rows if i in used and lang == x] for x in vocabulary}
    alphabet = len({c for ts in texts.values() for t in ts for c in t[1:]}) + 1
    models = {x: plain_kneser_ney(ts, alphabet) for x, ts in texts.items()}
    model = langid.fit(df)
    assert model.labels == sorted(vocabulary)
    for t in [rows[0][1], rows[1][1], "The old pont, 7 zebras & a rivière", "q", "ab"]:
        own = plain(t)
        for label, h in zip(model.labels, model.cross_entropy(t)):
            p = [models[label](own[max(i - 3, 0):i + 1]) for i in range(1, len(own))]
            assert abs(h + sum(map(math.log, p)) / len(p)) < 1e-4, (t, label)
    right = {i: min(models, key=lambda x: (-sum(math.log(models[x](plain(t)[max(k - 3, 0):k + 1]))
                                                for k in range(1, len(plain(t)))), x)) for i, t, _ in rows}
    assert {r.id: r.lang_pred for r in langid.predict(df, model).collect()} == right


def test_long_texts_score_like_their_blocks(docs, monkeypatch):
    model = langid.fit(docs([(i, "a quiet river runs below the old bridge", "en") for i in range(20)]))
    text = "the river and the bridge " * 200
    whole = model.cross_entropy(text)
    monkeypatch.setattr(langid, "_BLOCK", 37)
    assert np.allclose(whole, model.cross_entropy(text), atol=1e-5)


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = langid.predict(d, langid.fit(d, usable=~held)).join(d.filter(held).select(F.col("doc_id").alias("id"), "lang"), "id")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99
    assert out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_odd_rows(docs, odd_rows):
    df = docs([*odd_rows, (20, "le chat est sur la table et le chien", "fr"), (21, "la maison est dans le jardin", "fr")], clash=True)
    out = langid.predict(df, langid.fit(df)).collect()
    assert len(out) == len(odd_rows) + 2
    by = collections.defaultdict(list)
    for r in out:
        by[r.id].append(r)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (1, 2, 3, 8))
    assert by[20][0].lang_pred == "fr" and by[4][0].lang_pred == "en" and by[5][0][1:] == by[5][1][1:]
    assert langid.predict(docs([]), langid.fit(docs([]))).count() == 0
    nothing = langid.predict(df, langid.fit(df.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


# ------------------------------------------------------------------ personal data

_PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def slow_spans(t):
    out = []
    for kind, p in _PLAIN:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "phone" and not 9 <= len(d) <= 15
                    or kind == "card" and not (13 <= len(d) <= 19 and luhn(d))):
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_fuzz():
    rng, bits = random.Random(0), ["a", "b.", "@", "@c.d", "1", ".", "2.3", "25", "+1", " ", "-", "(", "444", "4111111111111111", "é"]
    for _ in range(20000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == slow_spans(t), t
    assert pii.base_spans("1" * 200_000 + "@" * 1000) == []  # long runs stay linear


def test_report_and_disclosing_terms(docs, odd_rows):
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(["water", "stone", "river", "cloud"]) for _ in range(n))
    rows = [(100 + i, filler(60)) for i in range(200)]
    # zephyrine stands by one address only, water everywhere
    rows += [(400 + i, f"{filler(10)} zephyrine {filler(2)} ann@mail.example.org {filler(10)}") for i in range(4)]
    rows += [(500, f"zephyrine {filler(30)} call +1 (555) 555-0100 {filler(3)}")]
    rows += odd_rows
    got = pii.report(docs(rows, clash=True)).collect()
    assert len(got) == len(rows)
    exp = collections.Counter()
    for d, t, *_ in rows:
        spans = slow_spans(t or "")
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        exp[(d, *(sum(k == x for k, *_ in spans) for x in ("email", "ip", "card", "phone")),
             hashlib.sha256(text.encode()).hexdigest())] += 1
    assert collections.Counter((r.id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == exp
    text = dict((d, t) for d, t, *_ in rows)
    for r in got:
        terms = {text[r.id][int(s):int(e)] for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
        # "call" stands by that number and nowhere else
        assert terms == ({"zephyrine"} if r.id and 400 <= r.id < 404 else {"call"} if r.id == 500 else set()), r
    assert pii.report(docs([])).count() == 0
    clean = {r.doc_id: r for r in pii.sanitise(docs(rows, clash=True)).collect()}
    assert pii.sanitise(docs(rows, clash=True)).columns == docs(rows, clash=True).columns
    assert "[EMAIL]" in clean[400].text and "zephyrine" not in clean[400].text and "ann@" not in clean[400].text
    assert "[PHONE]" in clean[500].text and "zephyrine" in clean[500].text
    assert clean[1].text is None and clean[2].text == "" and clean[101].text == text[101]


# ------------------------------------------------------------------ quality

def test_em_recovers_labellers():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.8
    v = np.zeros((20000, quality.N_LABELLERS), int)
    hit = np.linspace(0.5, 0.9, quality.N_LABELLERS)  # how often each labeller speaks on bad documents
    for k in range(quality.N_LABELLERS):
        says = rng.random(20000)
        v[:, k] = np.where(good, np.where(says < 0.02, 1, np.where(says < 0.6, 2, 0)), np.where(says < hit[k], 1, 0))
    pattern, inverse, n = np.unique(v @ 3 ** np.arange(quality.N_LABELLERS), return_inverse=True, return_counts=True)
    post, chance, prior = quality.fit_labellers(pattern, n.astype(float))
    assert abs(prior - 0.8) < 0.02
    assert np.abs(chance[0, :, 1] - hit).max() < 0.03 and chance[1, :, 1].max() < 0.04
    assert ((post[inverse] >= 0.5) == good).mean() > 0.99


def plain_em(votes, rounds=200):
    """Posterior of good per document, one document after the other."""
    post = [0.1 if 1 in v else 0.9 for v in votes]
    for _ in range(rounds):
        mass = [sum(1 - p for p in post), sum(post)]
        chance = [[[(sum((p if c else 1 - p) for v, p in zip(votes, post) if v[k] == x) + 0.5) / (mass[c] + 1.5)
                    for x in range(3)] for k in range(quality.N_LABELLERS)] for c in (0, 1)]
        prior = (mass[1] + 1) / (len(votes) + 2)
        new = []
        for v in votes:
            ll = [sum(math.log(chance[c][k][x]) for k, x in enumerate(v) if x) for c in (0, 1)]
            new.append(1 / (1 + math.exp(max(-50, min(50, math.log(1 - prior) - math.log(prior) + ll[0] - ll[1])))))
        done = max(abs(x - y) for x, y in zip(new, post)) < 1e-9
        post = new
        if done:
            break
    return post


def plain_scores(x, target, rounds=300):
    """Logistic regression on a dense matrix by Adam: the probability of good per row."""
    share = min(max(target.mean(), 0.01), 0.99)
    weight = target / share + (1 - target) / (1 - share)
    x, ridge = np.hstack([x, np.ones((len(x), 1))]), np.full(x.shape[1] + 1, 1e-4)
    ridge[-1] = 0
    w, m, s = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, rounds + 1):
        g = x.T @ ((1 / (1 + np.exp(-x @ w)) - target) * weight / weight.sum()) + ridge * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.2 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-6)
    return 1 / (1 + np.exp(-x @ w))


def test_quality_equals_plain_em_and_scorer(docs):
    rng = random.Random(2)
    good = "a quiet river ran below the old stone bridge in winter and the mountain was white with snow".split()
    rows = [(i, " ".join(rng.choice(good) for _ in range(40))) for i in range(40)]
    rows += [(100 + i, " ".join(rng.choice(["BUY", "NOW!!!", "$$$", "|", "click", "x9#z"]) for _ in range(40))) for i in range(12)]
    texts = [t.encode() for _, t in rows]
    votes = [quality.votes(t) for t in texts]
    post = plain_em(votes)
    weights = 3 ** np.arange(quality.N_LABELLERS)
    pattern, inverse, n = np.unique(np.array(votes) @ weights, return_inverse=True, return_counts=True)
    assert np.abs(quality.fit_labellers(pattern, n.astype(float))[0][inverse] - post).max() < 1e-6
    x = np.zeros((len(rows), quality.DIMS))
    for k, t in enumerate(texts):
        np.add.at(x[k], *quality.features(t))
    exp = plain_scores(x, np.array(post))
    got = {r.id: r for r in quality.classify(docs(rows)).collect()}
    for (i, _), p in zip(rows, exp):
        assert abs(got[i].score - p) < 5e-3 and (abs(p - quality.KEEP_AT) < 5e-3 or got[i].keep == (p >= quality.KEEP_AT))
    assert all(got[i].keep == (i < 100) for i, _ in rows)


def test_quality_on_labelled_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    lab = spark.read.parquet(f"{SF}/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    got = {(r.quality, r.keep): r["count"] for r in
           quality.classify(d).join(lab, "id").groupBy("quality", "keep").count().collect()}
    good, bad = got.get((1, True), 0) + got.get((1, False), 0), got.get((0, True), 0) + got.get((0, False), 0)
    assert got.get((1, True), 0) / good > 0.99 and got.get((0, False), 0) / bad > 0.9
    kept = quality.keep_good(d)
    assert kept.columns == d.columns and kept.count() == quality.classify(d).filter("keep").count()


def test_quality_odd_rows(docs, odd_rows):
    rows = [*odd_rows, *[(100 + i, "a quiet river ran below the old stone bridge in winter") for i in range(20)]]
    got = quality.classify(docs(rows, clash=True)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs(rows, clash=True))
    assert {1, 2, 3} <= {r.doc_id for r in kept.collect()}
    assert quality.classify(docs([])).count() == 0 and quality.keep_good(docs([])).count() == 0


# ------------------------------------------------------------------ language-model scores

def tokens(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


@pytest.mark.parametrize("frequent", [4, 1 << 19])
def test_base_scores_brute_force(docs, odd_rows, monkeypatch, frequent):
    monkeypatch.setattr(lmscore, "FREQUENT", frequent)  # the rest is joined
    rows = [*odd_rows, *[(100 + i, " ".join(f"W{i * k % 11}" for k in range(i))) for i in range(30)]]
    df = docs(rows, clash=True)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.crc32(F.lit("").cast("binary"))) % 10 == 0
    got = lmscore.score(df, lmscore.fit(df.filter(~held))).collect()
    is_held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = collections.Counter(w for d, t, *_ in rows if not is_held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    exp = []
    for d, t, *_ in rows:
        w = tokens(t)
        exp.append((str(d), len(w), sum(c[x] > 0 for x in w), n,
                    sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    got = sorted((str(r.id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(got, sorted(exp), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * max(1, abs(b[4]))


def test_estimated_counts_and_score(docs):
    rng = random.Random(9)
    text = [[f"w{min(int(rng.expovariate(0.05)), 200)}" for _ in range(300)] for _ in range(60)]
    df = docs([(i, " ".join(t)) for i, t in enumerate(text)])
    model = lmscore.fit(df)
    one, two = collections.Counter(), collections.Counter()
    for t in text:
        h, g, _ = lmscore._tokens([" ".join(t).encode()])
        one.update(h.tolist())
        two.update(g.tolist())
    wrong = 0
    for kind, counts in enumerate((one, two)):
        keys = np.array(list(counts), np.uint64)
        est = lmscore.estimated(model, keys, kind)
        for k, e in zip(keys.tolist(), est.tolist()):
            level = int(math.log2(counts[k]))
            true = 0.0 if level < kind else 1.0 if level == 0 else 1.5 * 2 ** level
            assert e >= true  # a Bloom filter never misses
            wrong += e != true
    assert wrong <= 0.03 * (len(one) + len(two))
    own = lmscore.score(df, model).agg(F.sum("score"), F.sum("base_score")).first()
    assert own[1] * 1.2 < own[0] < 0
    odd = lmscore.score(docs([(1, None), (2, "")]), model).collect()
    assert odd[0].score == odd[1].score and odd[0].n_tokens == 1
    # a small filter drops rare n-grams and stays within its bound
    small = lmscore.fit(df, max_bits=1 << 13)
    assert len(small["filter"]) <= (1 << 13) // 8 and small["low"].max() > 1
    assert lmscore.score(docs([]), model).count() == 0
    empty = lmscore.score(df, lmscore.fit(docs([]))).first()
    assert empty.n_known == 0 and empty.train_tokens == 0 and math.isfinite(empty.score) and math.isfinite(empty.base_score)


def test_the_filters_bound_holds_for_many_segments(docs, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(100))) for i in range(40)]
    whole = {r.id: r for r in lmscore.score(docs(rows), lmscore.fit(docs(rows))).collect()}
    monkeypatch.setattr(lmscore, "SEGMENT_TEXT", 4)  # as if there were terabytes of text
    small = lmscore.fit(docs(rows), max_bits=1 << 13)
    assert len(small["filter"]) <= (1 << 13) // 8 and small["power"] == 7
    monkeypatch.setattr(lmscore, "MAX_POWER", 5)
    model = lmscore.fit(docs(rows))
    assert model["power"] == 5 and model["tokens"] == 40 * 101
    for r in lmscore.score(docs(rows), model).collect():
        assert (r.n_tokens, r.n_known) == (101, 101) and abs(r.base_score - whole[r.id].base_score) < 1e-6
        assert abs(r.score - whole[r.id].score) < 0.02 * abs(r.score)  # false hits of the filter differ
    with pytest.raises(ValueError):
        lmscore.fit(docs(rows), max_bits=512)


@pytest.mark.parametrize("max_bits,frequent", [(1 << 29, 1 << 19), (1 << 13, 1 << 19), (1 << 13, 4)])
def test_no_ngram_is_lost_to_the_filters_bound(docs, monkeypatch, max_bits, frequent):
    monkeypatch.setattr(lmscore, "FREQUENT", frequent)
    monkeypatch.setattr(lmscore, "BITS_PER_KEY", 48)  # next to no false hits, so scores compare
    monkeypatch.setattr(lmscore, "_FLUSH", 500)
    rng = random.Random(3)
    text = [[f"w{min(int(rng.expovariate(0.02)), 300)}" for _ in range(120)] for _ in range(40)]
    train, more = [(i, " ".join(t)) for i, t in enumerate(text)], [(99, "w1 w2 unseen w3 w3 w250"), (98, None)]
    model = lmscore.fit(docs(train), max_bits=max_bits)
    assert (model["low"].max() > 1) == (max_bits < 1 << 20)
    one, two = collections.Counter(), collections.Counter()
    for _, t in train:
        w = [None, *tokens(t)]
        one.update(w[1:])
        two.update(zip(w, w[1:]))
    total = sum(one.values()) + 0.1 * (len(one) + 1)
    middle = lambda c: 0.0 if not c else 1.0 if c == 1 else 1.5 * 2 ** int(math.log2(c))
    exp = {}
    for d, t in [*train, *more]:
        w = [None, *tokens(t)]
        exp[d] = sum(math.log10((min(middle(two[x, y]), middle(one[x])) + lmscore.PRIOR * (middle(one[y]) + 0.1) / total)
                                / (middle(one[x]) + lmscore.PRIOR)) for x, y in zip(w, w[1:]))
    got = {r.id: r.score for r in lmscore.score(docs([*train, *more]), model).collect()}
    assert got.keys() == exp.keys()
    for d in exp:
        assert abs(got[d] - exp[d]) < 1e-3 * abs(exp[d]), (d, got[d], exp[d])


def test_disclosing_terms_of_single_documents(docs):
    rows = [(i, f"water stone river cloud {i % 7}") for i in range(2000)]
    rows += [(5000, "water zephyrine stone bob@mail.example.org river"), (5001, None)]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(rows)).collect()}
    assert clean[5000] == "water [TERM] stone [EMAIL] river" and clean[3] == rows[3][1]


def test_disclosing_terms_are_counted_and_marked_in_whole_documents(docs):
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(["water", "stone", "river", "cloud"]) for _ in range(n))
    rows = [(i, filler(60)) for i in range(3000)]
    # near the address in 3 of 10 documents only, and once more farther away; short and with a digit as well
    for i in range(10):
        near, far = ("Zephyrine q7 Bo ann@mail.example.org", "zephyrine Q7 bo") if i < 3 else ("ann@mail.example.org", "Zephyrine q7 Bo")
        rows.append((5000 + i, f"{near} {filler(60)} {far} {filler(3)}"))
    rows.append((6000, f"{filler(3)} call +1 (555) 555-0100 {filler(60)} zephyrine"))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(rows)).collect()}
    for i in range(10):
        words = set(re.findall(r"\w+", clean[5000 + i].lower()))
        assert not words & {"zephyrine", "q7", "bo", "ann"} and "water" in words, clean[5000 + i]
    assert "zephyrine" in clean[6000]


def test_no_language_is_lost_from_the_sample(docs):
    text = "the quiet river runs below the old bridge and the winter garden"
    rows = [(i, f"{text} {i % 3}", f"x{i:03}") for i in range(60)]  # a document for each label
    rows += [(100 + i, f"{text} " * 40, "long") for i in range(30)]
    model = langid.fit(docs(rows), sample_chars=100)  # less than one text of the last label
    assert model.labels == sorted({r[2] for r in rows})


def _brute_disclosed(rows, far):
    """(id, text) -> disclosed terms, by the formula over whole distinct documents."""
    docs = {(d, t) for d, t in rows if t}
    n = len(docs | {(d, t or "") for d, t in rows})
    terms = {k: {m.group().lower() for m in pii._TERM.finditer(k[1])
                 if not any(s < m.end() and m.start() < e for _, s, e in pii.base_spans(k[1]))} for k in docs}
    every = {k: {m.group().lower() for m in pii._TERM.finditer(k[1])} for k in docs}
    ents = {k: {pii._entity(kind, k[1][s:e]) for kind, s, e in pii.base_spans(k[1])} for k in docs}
    near = {(pii._entity(kind, k[1][s:e]), t) for k in docs for kind, s, e in pii.base_spans(k[1]) for t, _, _ in pii._near(k[1], s, e)}
    df = collections.Counter(t for k in docs for t in every[k])
    df_e = collections.Counter(e for k in docs for e in ents[k])
    c = collections.Counter((e, t) for k in docs for e in ents[k] for t in terms[k])
    c_all = collections.Counter((e, t) for k in docs for e in ents[k] for t in every[k])
    out = {}
    for k in docs:
        out[k] = {t for e in ents[k] for t in terms[k] if (far and c[e, t] > 1 or (e, t) in near)
                  and min(1, math.log((c_all[e, t] - pii.DISCOUNT) * n / (df[t] * df_e[e])) / max(math.log(n / df_e[e]), 1e-9)) >= pii.THRESHOLD}
    return out


@pytest.mark.parametrize("far", [False, True])
def test_disclosing_terms_equal_brute_force_pmi(docs, far):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocab, k=40))) for i in range(300)]
    for i in range(40):  # names far from their address, in several documents
        who = i % 9
        rows.append((1000 + i, f"name{who} {' '.join(rng.choices(vocab, k=30 + 3 * i))} near{who} p{who}@mail.example.org {' '.join(rng.choices(vocab, k=30))}"))
    rows += rows[300:312] * 2 + [(1, None), (None, rows[301][1])]  # copies change nothing
    want = _brute_disclosed(rows, far)
    got = pii.report(docs(rows, clash=True), far=far).collect()
    text = {}
    for d, t in rows:
        text.setdefault(d, set()).add(t)
    seen = 0
    for r in got:
        marked = [x.split(":") for x in r.spans.split(",") if x.startswith("term:")]
        options = [want.get((r.id, t), set()) for t in text[r.id]]
        words = [{t[int(a):int(b)].lower() for _, a, b in marked} for t in text[r.id] if t]
        assert not marked and not any(options) or any(w == o for w, o in zip(words, [want.get((r.id, t), set()) for t in text[r.id] if t]))
        seen += bool(marked)
    assert seen > 30
    assert ({f"name{k}" for k in range(9)} <= set().union(*want.values())) == far


def test_a_name_far_from_its_address_is_marked(docs):
    filler = "water stone river cloud " * 12
    rows = [(i, filler) for i in range(300)]
    rows += [(500 + i, f"Zephyrine {filler * (1 + i % 5)} ann@mail.example.org") for i in range(20)]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(rows), far=True).collect()}
    assert all("zephyrine" not in clean[500 + i].lower() and "water" in clean[500 + i] for i in range(20))


def test_candidates_come_from_whole_documents(docs):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocab, k=40))) for i in range(300)]
    for i in range(40):  # names far from their addresses, some in one document only
        who = i % 25
        rows.append((1000 + i, f"name{who} {' '.join(rng.choices(vocab, k=30 + 3 * i))} p{who}@mail.example.org q{i}@mail.example.org 10.0.{who}.7"))
    rows += rows[300:312] * 2 + [(1, None), (None, rows[301][1])]  # copies change nothing
    texts = {(d, t) for d, t in rows if t}
    n = len(texts | {(d, t or "") for d, t in rows})
    every = {k: {m.group().lower() for m in pii._TERM.finditer(k[1])} for k in texts}
    ents = {k: {pii._entity(kind, k[1][s:e]) for kind, s, e in pii.base_spans(k[1])} for k in texts}
    df = collections.Counter(t for k in texts for t in every[k])
    df_e = collections.Counter(e for k in texts for e in ents[k])
    c = collections.Counter((e, t) for k in texts for e in ents[k] for t in every[k])
    tells = lambda e, t: math.log((c[e, t] - pii.DISCOUNT) * n / (df[t] * df_e[e])) >= pii.THRESHOLD * math.log(n / df_e[e])
    want = {}
    for k in texts:
        free = [m.group().lower() for m in pii._TERM.finditer(k[1])
                if not any(s < m.end() and m.start() < e for _, s, e in pii.base_spans(k[1]))]
        want[k] = {t for t in free if any(tells(e, t) for e in ents[k])}
    got = pii.report(docs(rows)).collect()
    for r in got:
        marked = [x.split(":") for x in r.spans.split(",") if x.startswith("term:")]
        options = [(want[k], {k[1][int(a):int(b)].lower() for _, a, b in marked}) for k in texts if k[0] == r.id]
        assert any(w == g for w, g in options) if options else not marked
    assert len(got) == len(rows) and {f"name{k}" for k in range(25)} <= set().union(*want.values())

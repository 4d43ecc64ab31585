"""Main text of pages (11), spelling variants (12) and hard negatives (13)."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from uas_spark.llm import negatives, spelling, wrappers
from uas_spark.llm.common import prepare
from uas_spark.llm.expression import Chain, align, parse
from uas_spark.llm.markup import Page

PAGES = "page_id long, url string, html string"


# ---- expressions


def _regex(chain):
    out = ""
    for labels, repeated in chain.groups:
        items = ""
        for x in labels:
            _, optional, many = chain.marks[x]
            items += x + ("*" if optional and many else "?" if optional else "+" if many else "")
        out += f"(?:{items})+" if repeated else items
    return re.compile(out + r"\Z")


def _chain(labels):
    c = Chain()
    for x in labels:
        c.push(x)
    return c.close()


def test_expressions_read_what_they_were_made_of():
    rng = random.Random(5)
    for _ in range(3000):
        letters = "abcdef"[:rng.randint(1, 6)]
        seen = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 4))]
        both = _chain(seen[0])
        for s in seen:
            own = _chain(s)
            assert _regex(own).match(s) and str(parse(str(own))) == str(own)
            both = parse(str(align(both, own)))
        assert all(_regex(both).match(s) for s in seen), (seen, str(both))


def test_expressions_resolve_mismatches():
    assert str(_chain("hpppph")) == "( h p+? )+".replace("+?", "*")
    assert str(_chain("hpphp")) == "( h p+ )+"
    assert str(align(_chain("ahpf"), _chain("hpf"))) == "a? h p f"  # one side lacks it: optional
    assert str(align(_chain("ab"), _chain("ba"))) == "( a? b? )+"  # order differs: repeated group


# ---- pages


def _page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


def _texts(spark, rows, **kw):
    prepare(spark)
    df = spark.createDataFrame(rows, PAGES)
    return {r.id: r.text for r in wrappers.main_text(df, **kw).collect()}


class _Plain(HTMLParser):
    """Article text of simple pages by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_main_text_of_the_given_pages(spark):
    prepare(spark)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.id: (r.text, r.n_chars) for r in wrappers.main_text(pages).collect()}
    for r in pages.collect():
        plain = _Plain()
        plain.feed(r.html)
        plain.close()
        want = "\n\n".join(t for b in plain.blocks if (t := " ".join(b.split())))
        assert got[r.page_id] == (want, len(want))


def test_what_is_not_the_article_goes(spark):
    body = """<header class="site"><h1>The Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
    <div id="cookie-notice">We use cookies</div><div class="sidebar"><p>Elsewhere</p></div><aside>Aside</aside>
    <article><header><h1>Title &amp; more</h1><p>by someone</p></header><p>First   <b>bold</b>
    text&nbsp;&eacute;<br>line<script>var x = "</p>";</script><p>Second<div class="ad-slot">Buy</div>
    <span class="share">Share</span><ul><li>one<li>two <a href="x>y">link</a></ul><table><tr><td>c1<td>c2</table>
    <form><label>Mail</label><input><button>Go</button></form><blockquote>Quoted</blockquote><!-- gone -->
    <div hidden>hidden</div></article><section id="comments"><article><p>Reader says</p></article></section>
    <footer>&copy; site</footer>"""
    want = "Title & more\n\nFirst bold text é line\n\nSecond\n\none\n\ntwo link\n\nc1\n\nc2\n\nQuoted"
    got = _texts(spark, [(1, "http://a.b/1", _page(body)), (2, "http://a.b/2", body), (3, "http://a.b/3", body.replace("</article><section", "<section"))])
    assert got[1] == got[2] == want
    assert got[3] == want  # an article that is never closed


def test_wrapper_finds_region_template_and_menus(spark):
    """A host without article elements: constants and menus are told from slots by its pages alone."""
    rng = random.Random(2)
    def word():
        return "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for i in range(12):
        paras = [" ".join(word() for _ in range(20)) for _ in range(rng.randint(1, 4))]
        extra = f"<h2>{word()}</h2>" if i % 3 == 0 else ""
        links = "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(rng.randint(2, 5)))
        html = (f"<body><div><b>Best site ever</b></div><ul>{links}</ul><div class=content>{extra}"
                + "".join(f"<p>{p}</p>" for p in paras) + "<div>Call us today</div></div></body>")
        rows.append((i, f"HTTPS://u:p@Shop.Example.org:80/{i}", html))
        want[i] = "\n\n".join(([extra[4:-5]] if extra else []) + paras)
    assert _texts(spark, rows) == want
    assert _texts(spark, rows, broadcast_bytes=0) == want  # joined instead of broadcast
    nodes = wrappers.wrappers(spark.createDataFrame(rows, PAGES))
    by_label = {r.label: r for r in nodes.collect()}
    assert by_label["div.content"].chain == "h2? p+ div" and by_label["ul"].chain == "li+"
    assert {r.host for r in nodes.collect()} == {"shop.example.org"}
    # a single page of such a host keeps its constants: nothing shows that they are template
    assert "Call us today" in _texts(spark, rows[:1])[0]


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(i, "http://h.org/x", _page("<div class=content><p>All the same</p></div>")) for i in range(40)]
    assert set(_texts(spark, rows).values()) == {"All the same"}


def test_wrappers_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    rows = [(i, f"http://h{i % 3}.org/{i}", "<article>" + "".join(f"<{t}>x{rng.random()}</{t}>" for t in
             rng.choices(["p", "h2", "pre", "blockquote"], k=rng.randint(1, 7))) + "</article>") for i in range(60)]
    df = spark.createDataFrame(rows, PAGES)
    a = sorted(map(tuple, wrappers.wrappers(df.repartition(1)).collect()), key=str)
    b = sorted(map(tuple, wrappers.wrappers(df.repartition(7)).collect()), key=str)
    assert a == b
    for r in wrappers.wrappers(df).filter("label = 'article'").collect():
        labels = {x: chr(97 + k) for k, x in enumerate(["p", "h2", "pre", "blockquote"])}
        c = parse(r.chain)
        c.groups = [[[labels[x] for x in g], rep] for g, rep in c.groups]
        c.marks = {labels[x]: m for x, m in c.marks.items()}
        for i, url, html in rows:
            if url.startswith(f"http://{r.host}/"):
                assert _regex(c).match("".join(labels[t] for t in re.findall(r"<(\w+)>", html)[1:]))


def test_odd_pages(spark):
    long = "<article>" + "<p>para &lt; text</p>" * 30000 + "</article>"
    deep = "<div>" * 5000 + "deep"
    rows = [(1, None, None), (2, "", ""), (3, "http://x", "plain text  only"), (4, "http://x/", long), (4, "http://x/", long),
            (None, "http://x", "<p>no id"), (5, "no url", "<p>a<p>b"), (6, "http://x", "<script>never closed"),
            (7, "http://x", "a < b & c &amp d <!-- open"), (8, "http://x", deep), (9, "http://x", "<p title='it>x"),
            (10, "http://x", "<p title=it's>x</p>"), (11, "http://x", "x</p>y</div>z")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'c' AS id", "'c' AS host", "'c' AS text", "'c' AS level", "1 AS key")
    out = wrappers.main_text(df).collect()
    assert len(out) == len(rows)
    got = {r.id: r.text for r in out}
    assert got[1] == got[2] == got[6] == "" and got[9] == "x" and got[3] == "plain text only" and got[None] == "no id"
    assert got[4] == "\n\n".join(["para < text"] * 30000) and got[5] == "a\n\nb"
    assert got[7] == "a < b & c & d" and got[8] == "deep" and got[10] == "x" and got[11] == "x\n\nyz"
    assert wrappers.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_page_keeps_paths_apart():
    page = Page("<main><p>a</p><div class='post-comments'><p>b</p></div><div class='has-sidebar'><p>c</p></div></main>")
    assert [t for _, t in page.blocks] == ["a", "c"]


# ---- spelling


def _brute_near(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _brute_variants(rows):
    n = Counter()
    for i, text in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", t):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    v = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = defaultdict(list)
    for a, b in itertools.combinations(v, 2):
        if abs(len(a) - len(b)) < 2 and _brute_near(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in v:
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best and v[best] >= 2 * v[w] else None
    out = set()
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, v[w], len(near[w]), v.get(form[w])))
    return out


def _spelling_rows(rng, alphabet, words=140, texts=260):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))) for _ in range(words)]
    for w in list(base):
        for _ in range(3):
            i = rng.randint(0, len(w))
            base.append(rng.choice([w[:i] + rng.choice(alphabet) + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice(alphabet) + w[i + 1:]]))
    weights = [1 / (k + 1) for k in range(len(base))]
    rng.shuffle(base)
    return [(i, " ".join(rng.choices(base, weights, k=60))) for i in range(texts)]


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", "abcdefghijklmnoprstuvwß"])
def test_spelling_equals_brute_force(spark, docs, alphabet):
    rows = _spelling_rows(random.Random(len(alphabet)), alphabet)
    got = set(map(tuple, spelling.variants(docs(rows)).collect()))
    assert got == _brute_variants(rows)
    # many longer grams, and lists split by a shuffle
    again = set(map(tuple, spelling.variants(docs(rows), gram_share=0.0001, held=8).collect()))
    assert again == got


def test_affected_bound_holds():
    rng = random.Random(4)
    for trial in range(60):
        alphabet = "abcd"[:2 + trial % 3]
        count = {a + b: rng.randint(1, 9) for a in alphabet for b in alphabet}
        count.update({"".join(rng.choice(alphabet) for _ in range(rng.randint(3, 4))): 5 for _ in range(rng.randint(0, 40))})
        grams = spelling.Grams(count)
        for _ in range(60):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(5, 12)))
            own = grams.decompose(s)
            bound = grams.affected(s, own)
            i, kind = rng.randrange(len(s)), rng.choice("idr")
            t, shift = {"i": (s[:i] + rng.choice(alphabet + "z") + s[i:], 1), "d": (s[:i] + s[i + 1:], -1),
                        "r": (s[:i] + "z" + s[i + 1:], 0)}[kind]
            there = set(grams.decompose(t))
            after = i if kind == "i" else i + 1
            missing = sum(not ((p + len(g) <= i and (p, g) in there) or (p >= after and (p + shift, g) in there)) for p, g in own)
            assert missing <= bound


def test_spelling_odd_cases(spark, docs, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows] * 4 + [(20, "Ünïcödé naïve NAÏVE naïve naïve naive naive naive naives naives naives")]
    got = set(map(tuple, spelling.variants(docs(rows, clash=True)).collect()))
    assert got == _brute_variants(rows)
    assert spelling.variants(docs([])).collect() == []


# ---- hard negatives


def _brute_mine(rows, is_anchor, scale=256):
    live = [(i, v, lab, [int(np.floor(x * scale)) for x in vec]) for i, (v, vec, lab) in enumerate(rows)
            if lab is not None and vec and all(x is not None and np.isfinite(x) for x in vec)]
    def dot(a, b):
        return min(max(sum(x * y for x, y in zip(a, b)), -2 ** 63), 2 ** 63 - 1)
    out = []
    for i, v, lab, q in live:
        if v is None or not is_anchor(v):
            continue
        scored = sorted((-dot(q, x), w is None, w or 0, j, la) for j, w, la, x in live if j != i and len(x) == len(q))
        for s, null, w, _, la in [r for r in scored if r[4] == lab][:5]:
            fits = [r for r in scored if r[4] != lab and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(v, None if null else w, k + 1, None if r[1] else r[2], -s, -r[0]) for k, r in enumerate(fits)]
    return sorted(out, key=str)


def _mine(spark, rows, **kw):
    prepare(spark)
    df = spark.createDataFrame([(v, x, lab, "c", "c", "c") for v, x, lab in rows],
                               "vec_id long, embedding array<double>, label int, row string, code string, score string")
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 5 == 0, **kw).collect()), key=str)


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((4, 12))
    rows = [(int(i), (centre[i % 4] + 0.4 * rng.standard_normal(12)).tolist(), int(i % 3)) for i in range(120)]
    rows += [(200 + i, rng.standard_normal(70).tolist(), int(i % 2)) for i in range(40)]  # another length, over one word
    rows += [(r[0], r[1], r[2]) for r in rows[:10]]  # repeated rows are rows of their own
    want = _brute_mine(rows, lambda v: v % 5 == 0)
    assert want and _mine(spark, rows) == want
    assert _mine(spark, rows, at_once=20) == want  # several passes


def test_negatives_odd_cases(spark):
    rows = [(0, [1.0, 0.0], 1), (5, [0.0, 0.0], 1), (10, None, 1), (15, [], 1), (20, [1.0, None], 1), (25, [float("nan"), 1.0], 1),
            (30, [float("inf"), 1.0], 1), (35, [1.0, 1.0], None), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [0.9, 0.1], 2),
            (None, [0.95, 0.0], 2), (4, [-1.0, 0.0], 2), (40, [3e30, 1.0], 3), (41, [2e30, 1.0], 3), (42, [1e-30, 1e-30], 4),
            (43, [2e30, 0.5], 2), (6, [1.0, 0.0, 0.0], 1)]
    assert _mine(spark, rows) == _brute_mine(rows, lambda v: v % 5 == 0)
    assert _mine(spark, []) == []


def test_interval_is_certain():
    rng = np.random.default_rng(8)
    for dims in (3, 64, 100):
        turn = negatives.rotation(dims)
        x = rng.standard_normal((300, dims)) * rng.choice([1e-3, 1, 1e6], (300, 1))
        q = np.concatenate([x[:20], rng.standard_normal((20, dims)), np.zeros((1, dims))])
        low, high = negatives.Anchors(q, turn).interval(*negatives.encode(x, turn))
        exact = q @ x.T
        assert (low <= exact + 1e-9 * np.abs(exact)).all() and (exact <= high + 1e-9 * np.abs(exact)).all()
        assert (high - low).mean() < 2 * (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]).mean()

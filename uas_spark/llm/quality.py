"""Quality classifier (operator 4): a weak-label model trains a hashed linear scorer.

1. Heuristic labellers each vote good (2), bad (1) or abstain (0) on every whole text. They
   overlap and err; those that look for one kind of junk never vote good.
2. Expectation-maximisation over all documents estimates each labeller's accuracy (the chance of
   each vote given the true class; abstaining says nothing) and the posterior class of every
   pattern of votes. The corpus enters as a count per pattern, at most 3 ** labellers rows.
3. The posteriors of a bounded random sample of documents are the labels of a logistic scorer
   over hashed features: the shapes of words and the words themselves.
4. The scorer rates every whole text.

No given labels are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, saved, text_bytes, unused

SAMPLE = 4000  # documents the scorer is fitted on, about; a larger corpus does not raise it
DIMS = 1 << 15
KEEP_AT = 0.25  # a document goes if the scorer holds bad for three times as likely

_MARKS = b"#$%&*@^~<>{}[]=\\"
# classes of bytes: a lower case and others, A upper case, 0 digits; blanks and marks stay
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57
               else 32 if c in b" \t\n\r\x0b\x0c" else c for c in range(256))


def _vote(x: float, good: float, bad: float) -> int:
    """Good at or below ``good``, bad at or above ``bad``, no opinion between them."""
    return 2 if x <= good else 1 if x >= bad else 0


# shapes of ordinary words, with a mark of punctuation at most
_USUAL = frozenset(w + p for w in (b"a", b"A", b"Aa", b"0") for p in (b"", b".", b",", b";", b":", b"?", b"!"))
# (good at most, bad at least) per labeller; -1: it never votes good
_LIMITS = [(-1, 0.05), (0.15, 0.5), (-1, 0.3), (-1, 0.2), (-1, 0.15), (0.14, 0.25), (0.12, 0.3), (0.1, 0.25), (0.3, 0.6)]
N_LABELLERS = len(_LIMITS)


def _measure(text: bytes) -> tuple[list[bytes], Counter, Counter, list[float]]:
    """Words, their counts, their shapes' counts and the shares that the labellers look at."""
    words = text.split()
    n = max(len(words), 1)
    counts = Counter(words)
    classes = text.translate(_SHAPE)
    code = np.frombuffer(classes, np.uint8)
    # runs of one class count once, so a word's shape does not depend on its length
    shape = code[np.concatenate([[True], code[1:] != code[:-1]])].tobytes() if len(code) else b""
    shapes = Counter(shape.split())
    letters = classes.count(b"a") + (upper := classes.count(b"A"))
    solid = max(len(text) - classes.count(b" "), 1)
    unsure = 0.2  # too little text for an opinion
    shares = [
        sum(text.count(bytes([c])) for c in _MARKS) / solid,  # marks rare in prose
        upper / letters if letters >= 20 else unsure,
        text.count(b"!") / n,
        text.count(b"|") / n,
        sum(map(eq, words, words[1:])) / n if n >= 8 else 0.0,  # words said twice running
        counts.most_common(1)[0][1] / n if n >= 30 else unsure,  # the commonest word
        1 - letters / solid if n >= 20 else unsure,  # other than letters
        sum(v for s, v in shapes.items() if s not in _USUAL) / n if n >= 20 else unsure,  # odd words
        1 - len(set(zip(words, words[1:]))) / (n - 1) if n >= 20 else 0.5,  # pairs of words said before
    ]
    return words, counts, shapes, shares


def votes(text: bytes) -> list[int]:
    return [_vote(x, *lim) for x, lim in zip(_measure(text)[3], _LIMITS)]


def features(text: bytes, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes in the lower half, of words in the upper one."""
    words, counts, shapes, shares = _measure(text)
    half, n = dims // 2, max(len(words), 1)
    at = [zlib.crc32(s) % (half - 16) for s in shapes] + [half - 16 + k for k in range(N_LABELLERS)]
    at += [half + zlib.crc32(w.lower()) % half for w in counts]
    value = np.array([*shapes.values(), *(n * min(s, 1.0) for s in shares), *counts.values()], np.float32) / n
    return np.array(at, np.int32), value


def _voted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pattern): votes as the digits of a number to the base 3."""
    weights = 3 ** np.arange(N_LABELLERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array([votes(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, N_LABELLERS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v @ weights)], ["id", "pattern"])

    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, pattern long")


def fit_labellers(patterns: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns with counts ``n``: posterior of good per pattern, vote chances
    [class, labeller, vote] and the share of good documents. The start says which of the two
    classes is the good one."""
    v = patterns[:, None] // 3 ** np.arange(N_LABELLERS) % 3
    onehot = np.eye(3)[v]  # pattern, labeller, vote
    onehot[:, :, 0] = 0.0
    # the start: a bad vote is strong evidence, as most labellers know one kind of junk only
    post = np.where((v == 1).any(axis=1), 0.1, 0.9)
    chance, prior = np.full((2, N_LABELLERS, 3), 1 / 3), 0.5
    for _ in range(rounds):
        w = np.stack([(1 - post) * n, post * n])
        # chances are of all documents of the class, those it abstained on too
        seen = np.einsum("cp,plv->clv", w, onehot) + 0.5
        chance, prior = seen / (w.sum(axis=1)[:, None, None] + 1.5), (w[1].sum() + 1) / (n.sum() + 2)
        ll = np.einsum("plv,clv->cp", onehot, np.log(chance))
        new = 1 / (1 + np.exp(np.clip(np.log(1 - prior) - np.log(prior) + ll[0] - ll[1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            post = new
            break
        post = new
    return post, chance, prior


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, dims: int = DIMS,
               rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (Adam on the full bounded sample). Both classes weigh
    the same."""
    w, b = np.zeros(dims), 0.0
    if not rows:
        return w, b
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    value = np.concatenate([r[1] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = np.clip(target.mean(), 0.01, 0.99)
    weight = target / share + (1 - target) / (1 - share)
    weight /= weight.sum()
    m, s, mb, sb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[at], len(rows)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * weight
        g, gb = np.bincount(at, value * err[row], dims) + ridge * w, err.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        up, down = 1 - 0.9 ** t, 1 - 0.99 ** t
        w -= 0.2 * (m / up) / (np.sqrt(s / down) + 1e-6)
        b -= 0.2 * (mb / up) / (np.sqrt(sb / down) + 1e-6)
    return w, float(b)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
        dims: int = DIMS) -> tuple[np.ndarray, float, dict[int, float]]:
    """Scorer weights, its constant, and the posterior of good per vote pattern."""
    voted = saved(_voted(docs, id_col, text_col))
    found = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    patterns, n = np.array([r.pattern for r in found], np.int64), np.array([r.n for r in found], np.float64)
    if not found:
        return np.zeros(dims), 0.0, {}
    post = dict(zip(patterns.tolist(), fit_labellers(patterns, n)[0].tolist()))
    chosen = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(7)), F.lit(1 << 30)) \
        < int((1 << 30) * min(1.0, sample / n.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, value, good = [], [], []
            for t in b.column(0).to_pylist():
                x, y = features(t, dims)
                at.append(x)
                value.append(y)
                good.append(post.get(int(np.dot(votes(t), 3 ** np.arange(N_LABELLERS))), 0.5))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())),
                                              pa.array(good, pa.float64())], ["at", "value", "good"])

    picked = (docs.filter(chosen).select(text_bytes(text_col).alias("t"))
              .mapInArrow(run, "at array<int>, value array<float>, good double").toArrow())
    rows = [(np.array(a.values), np.array(v.values)) for a, v in zip(picked.column("at"), picked.column("value"))]
    w, b = fit_scorer(rows, picked.column("good").to_numpy(), dims)
    return w, b, post


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", out: str = "__quality") -> DataFrame:
    """``docs`` with a last column ``out``, the scorer's probability of good."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, const = shared.value
        for b in batches:
            z = []
            for t in b.column(len(names)).to_pylist():
                at, value = features(t, len(w))
                z.append(float(np.dot(w[at], value)) + const)
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], [*names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.withColumn(unused(docs, "__t"), text_bytes(text_col)).mapInArrow(run, schema)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, keep) per row: the scorer's probability of good, and whether it reaches ``KEEP_AT``.

    Null and empty texts have no features and get the scorer's constant; repeated rows get equal
    scores; other columns are ignored; an empty table gives no rows.
    """
    w, b, _ = fit(docs, id_col, text_col)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return (scored(own, (w, b)).select("id", F.col("__quality").alias("score"),
                                       (F.col("__quality") >= KEEP_AT).alias("keep")))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows the scorer rejects; columns unchanged. Rows whose text is null
    or has no word hold nothing to reject and stay."""
    w, b, _ = fit(docs, id_col, text_col)
    no_word = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"\A[\x20\x09-\x0D]*\z")
    score = unused(docs, "__quality")
    return scored(docs, (w, b), text_col, score).filter((F.col(score) >= KEEP_AT) | no_word).drop(score)

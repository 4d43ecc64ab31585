"""Language identification (operator 1): interpolated Kneser-Ney character models.

Texts become lower-case letters with one blank for every run of other characters. For each
language, character n-grams of a bounded sample are counted; the highest order keeps its counts,
lower orders count the distinct characters seen before the n-gram, and each order's discount is
n1 / (n1 + 2 n2) of its own counts. Interpolation is resolved when the model is built, so it
holds one log probability per n-gram and language and one back-off weight per context, in arrays
sorted by the n-grams' 64-bit hashes. A text gets the language with the lowest cross-entropy per
character. Held-back sample texts calibrate the confidence and, per language, the cross-entropy
beyond which a prediction is flagged as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty

ORDER = 4
SAMPLE_CHARS = 600_000  # per language, about; a larger corpus does not raise it
UNKNOWN = "und"
_BLOCK = 1 << 18  # characters scored at once
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """Lower-case letter of every code point of the first plane; 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low[0])
    return table


def normalised(text: str, table: np.ndarray) -> np.ndarray:
    """Letters of a text as code points, a blank (32) around and between runs of them; empty if
    it has no letter."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = table[np.minimum(code, 0xFFFF)]
    if len(code) and code.max(initial=0) > 0xFFFF:
        for i in np.flatnonzero(code > 0xFFFF).tolist():
            out[i] = ord(chr(code[i]).lower()[0]) if chr(code[i]).isalpha() else 0
    keep = np.concatenate([out > 0, [False]])
    keep[1:] |= keep[:-1].copy()  # a letter, or the first other character after one
    if not keep.any():
        return np.empty(0, np.uint32)
    padded = np.concatenate([out, np.zeros(1, np.uint32)])[keep]
    padded[padded == 0] = 32
    return np.concatenate([np.array([32], np.uint32), padded])


def _hashes(code: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n characters that end at each position (those that would
    start before the first position are wrapped and must not be used)."""
    c = code.astype(np.uint64) + np.uint64(1)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(order):
        # the n-gram's characters enter from its last to its first, so suffixes share the work
        h = (h ^ np.roll(c, n)) * _MIX
        h = h ^ (h >> np.uint64(29))
        out.append(h + np.uint64(n))
    return out


def _counted(sample: DataFrame, order: int) -> DataFrame:
    """(label, n, h, ctx, suf, c): n-grams with hashes of their first and last n - 1 characters."""
    table = sample.sparkSession.sparkContext.broadcast(_letters())
    names = ["label", "n", "h", "ctx", "suf", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(label, []).append(normalised(text, table.value))
            for label, codes in by.items():
                grams: list[list] = [[] for _ in range(order)]
                for code in codes:
                    hs = _hashes(code, order)
                    for n in range(1, order + 1):
                        if len(code) >= n + (n == 1):
                            at = np.arange(max(n - 1, 1), len(code))  # the leading blank is context only
                            grams[n - 1].append(np.stack([
                                hs[n - 1][at], hs[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64),
                                hs[n - 2][at] if n > 1 else np.zeros(len(at), np.uint64)]))
                for n, parts in enumerate(grams, 1):
                    if parts:
                        three = np.concatenate(parts, axis=1)
                        _, first, c = np.unique(three[0], return_index=True, return_counts=True)
                        g = three[:, first].view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([label] * len(c), pa.string()), pa.array(np.full(len(c), n, "i4")),
                             pa.array(g[0]), pa.array(g[1]), pa.array(g[2]), pa.array(c.astype("i8"))], names)

    rows = sample.select("label", "t").mapInArrow(run, "label string, n int, h long, ctx long, suf long, c long")
    return rows.groupBy("label", "n", "h", "ctx", "suf").agg(F.sum("c").alias("c"))


def _of(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``sought`` in sorted ``keys``, and which of them are there."""
    if not len(keys):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return at, keys[at] == sought


class Model:
    """Per order: sorted n-gram hashes with a row of log probabilities (a column for each
    language), and sorted context hashes with a row of log back-off weights."""

    def __init__(self, labels: list[str], grams: dict[str, list[dict[str, np.ndarray]]], order: int):
        self.labels, self.order, self.letters = labels, order, _letters()
        n_lang = len(labels)
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        alphabet = max([len(np.unique(np.concatenate([grams[x][0]["h"] for x in labels])))] if labels else [1]) + 1
        self.unseen = np.zeros(n_lang, np.float64)
        for n in range(1, order + 1):
            every = [grams[x][n - 1] for x in labels]
            keys = np.unique(np.concatenate([g["h"] for g in every])) if labels else np.empty(0, np.uint64)
            ctxs = np.unique(np.concatenate([g["ctx"] for g in every])) if labels else np.empty(0, np.uint64)
            ctx_of, suf_of = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint64)
            seen = np.full((len(keys), n_lang), -1.0)  # discounted share of a seen n-gram
            weight = np.ones((len(ctxs), n_lang))
            for k, g in enumerate(every):
                c = g["c"].astype(np.float64)
                if n < order:  # distinct characters before the n-gram, from the next order
                    up = grams[labels[k]][n]
                    own = np.sort(g["h"])
                    at, there = _of(own, up["suf"])
                    c_sorted = np.bincount(at[there], minlength=len(own)).astype(np.float64)
                    c = c_sorted[np.searchsorted(own, g["h"])]
                    c = np.maximum(c, 1.0)  # a text's first letters follow its leading blank
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                at_ctx = np.searchsorted(ctxs, g["ctx"])
                total = np.bincount(at_ctx, c, len(ctxs))
                kinds = np.bincount(at_ctx, minlength=len(ctxs))
                at = np.searchsorted(keys, g["h"])
                seen[at, k] = (c - d) / total[at_ctx]
                ctx_of[at], suf_of[at] = at_ctx, g["suf"]
                weight[:, k] = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            if n == 1:
                lower = np.full((len(keys), n_lang), 1 / alphabet)
                if n_lang:
                    self.unseen = np.log(weight[0] / alphabet) if len(ctxs) else np.log(np.ones(n_lang) / alphabet)
            else:
                below, there = _of(self.keys[-1], suf_of)
                lower = np.where(there[:, None], np.exp(self.logp[-1][below]), np.exp(self.unseen))
            p = np.maximum(seen, 0) + weight[ctx_of] * lower
            self.keys.append(keys)
            self.logp.append(np.log(p).astype(np.float32))
            self.contexts.append(ctxs)
            self.backoff.append(np.log(weight).astype(np.float32))
        self.temperature, self.limit = 1.0, np.full(n_lang, np.inf)

    @classmethod
    def of(cls, state: dict) -> "Model":
        """A model from ``vars(model)``: broadcasts hold plain arrays only."""
        model = cls.__new__(cls)
        vars(model).update(state)
        return model

    def _block(self, code: np.ndarray) -> np.ndarray:
        """Log probability of each character but the first, by language."""
        hs = _hashes(code, self.order)
        at = np.arange(1, len(code))
        out = np.zeros((len(at), len(self.labels)), np.float32)
        todo = np.arange(len(at))
        for n in range(self.order, 0, -1):
            pos = at[todo]
            fits = pos >= n - 1
            place, there = _of(self.keys[n - 1], hs[n - 1][pos])
            there &= fits
            out[todo[there]] += self.logp[n - 1][place[there]]
            todo, fits = todo[~there], fits[~there]
            if n > 1 and len(todo):
                ctx, known = _of(self.contexts[n - 1], hs[n - 2][at[todo] - 1])
                known &= fits
                out[todo[known]] += self.backoff[n - 1][ctx[known]]
        out[todo] += self.unseen
        return out

    def cross_entropy(self, text: str) -> np.ndarray | None:
        """Mean negative log probability per character by language; None without a letter."""
        code = normalised(text, self.letters)
        if not len(code):
            return None
        total = np.zeros(len(self.labels))
        keep = self.order - 1  # context that a block shares with the one before
        for lo in range(1, len(code), _BLOCK):
            start = max(lo - keep, 0)
            rows = self._block(code[start:lo + _BLOCK])
            total += rows[lo - start - 1:].sum(axis=0, dtype=np.float64)
        return -total / (len(code) - 1)

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """(label, confidence, cross-entropy, rejected)"""
        h = self.cross_entropy(text or "") if self.labels else None
        if h is None:
            return UNKNOWN, 0.0, None, False
        best = int(np.argmin(h))  # labels are sorted, so a tie goes to the first by name
        odds = np.exp(-(h - h[best]) * self.temperature)
        return self.labels[best], float(1 / odds.sum()), float(h[best]), bool(h[best] > self.limit[best])


def fit(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        usable: Column | None = None, order: int = ORDER, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a random sample of about ``sample_chars`` characters of whole texts per label: the
    texts of smallest hash until there are that many, at least one of them for the model.

    The sample's size does not depend on the table's, so the model's is bounded: at most
    ``sample_chars * order`` n-grams per language. One tenth of the sample only calibrates.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(label_col).cast("string").alias("label"), text_or_empty(text_col).alias("t"),
                       F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       (usable if usable is not None else F.lit(True)).alias("usable"))
    scale = 1 << 30
    rows = rows.filter("usable AND label IS NOT NULL").filter(F.col("t").rlike(r"\p{L}")).withColumn(
        "draw", F.pmod(F.xxhash64("id", "t", F.lit(11)), F.lit(scale)))
    # by steps of the draw that grow by a twelfth at most, so a sample ends soon after its budget
    step = F.floor(8 * F.log2(F.col("draw") + 1))
    sizes = rows.groupBy("label", step.alias("step")).agg(F.sum(F.length("t")).alias("n"), F.min("draw").alias("low")).collect()
    labels = sorted({r.label for r in sizes})
    if not labels:
        return Model([], {}, order)
    last, least = {}, {}
    for x in labels:
        n = 0
        for r in sorted((r for r in sizes if r.label == x), key=lambda r: r.step):
            least.setdefault(x, r.low)
            if n < sample_chars:
                last[x] = r.step
            n += r.n
    of = lambda d: F.create_map(*[F.lit(v) for x in labels for v in (x, int(d[x]))])[F.col("label")]
    # a label's first document is always for the model
    picked = rows.filter(step <= of(last)).select("label", "t", (
        (F.pmod(F.xxhash64("id", F.lit(12)), F.lit(10)) == 0) & (F.col("draw") != of(least))).alias("held"))
    t = _counted(picked.filter("NOT held"), order).toArrow()
    cols = {c: t.column(c).to_numpy() for c in ("n", "h", "ctx", "suf", "c")}
    label = np.array(t.column("label").to_pylist(), object)
    if missing := set(labels) - set(label.tolist()):
        raise ValueError(f"no model for the labels {sorted(missing)}")
    grams = {x: [{c: cols[c][(label == x) & (cols["n"] == n)].view(np.uint64) if c != "c" else
                  cols[c][(label == x) & (cols["n"] == n)] for c in ("h", "ctx", "suf", "c")}
                 for n in range(1, order + 1)] for x in labels}
    model = Model(labels, grams, order)

    # calibration on the held-back tenth: confidence, then the rejection limits
    shared = spark.sparkContext.broadcast(vars(model))

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Model.of(shared.value)
        for b in batches:
            h = [(x, kept.cross_entropy(s)) for x, s in zip(*(c.to_pylist() for c in b.columns))]
            h = [(x, y.tolist()) for x, y in h if y is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in h], pa.string()),
                                              pa.array([y for _, y in h], pa.list_(pa.float64()))], ["label", "h"])

    held = picked.filter("held").select("label", "t").mapInArrow(entropies, "label string, h array<double>").collect()
    held = [(labels.index(r.label), np.array(r.h)) for r in held if r.label in labels]
    if held:
        truth, h = np.array([x for x, _ in held]), np.array([y for _, y in held])
        gap = h - h.min(axis=1, keepdims=True)
        loss = [(np.mean(gap[np.arange(len(h)), truth] * s + np.log(np.exp(-gap * s).sum(axis=1))), s)
                for s in np.geomspace(0.5, 200, 60)]
        model.temperature = float(min(loss)[1])
        for k in range(len(labels)):
            own = h[truth == k, k]
            if len(own) >= 20:  # far above what texts of the language have
                q1, q3 = np.quantile(own, [0.25, 0.75])
                model.limit[k] = max(own.max(), q3 + 3 * (q3 - q1))
    shared.unpersist()
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected) per row, from the whole text alone.

    ``score`` is the calibrated confidence, 0 to 1. A null text, or one without a letter, gets
    ``und`` with score 0. Equal texts get equal results; a tie goes to the first language by
    name; other columns are ignored; an empty table gives no rows; with nothing to learn from
    every text is ``und``. ``rejected`` marks texts unlike any learned language.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(vars(model))
    names = ["id", "lang_pred", "score", "cross_entropy", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Model.of(shared.value)
        for b in batches:
            p = [kept.predict(t) for t in b.column(1).to_pylist()]
            lang, score, h, out = zip(*p) if p else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(h, pa.float64()), pa.array(out, pa.bool_())], names)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double, "
                               "cross_entropy double, rejected boolean")

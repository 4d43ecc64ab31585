"""Language-model scoring (operator 8): a log-frequency Bloom filter of n-gram counts.

Counting covers every training text: tasks pre-aggregate unigrams and bigrams, and rows of sorted
64-bit hashes with counts go to segments by the hashes' top bits. Hashes spread evenly and a task
sends an n-gram once, so no segment is hot. Each segment merges its counts and builds its own
piece of the filter: an n-gram of count c is entered at the levels up to 1 + floor(log2(c)), and
a reader probes level after level until one is absent, which gives the count up to a factor of 2.

The filter is broadcast, so its size is bounded by ``max_bits``. It gets ``BITS_PER_KEY`` bits a
key; bigrams below a count (2) are left out of it, and a segment whose keys would not fit in its
share doubles that count, and the one for unigrams (1), until they do. No n-gram is lost by that:
a segment keeps the bigrams below its count as sorted hashes, and bigrams that the filter does not
have are looked up there, packed by segment. Exact unigram counts, which the base score needs, are
not in the filter: the most frequent words, at most ``FREQUENT`` of them, are broadcast, and the
others are joined; that also gives the words below a segment's count. Counts that are looked up or
joined are read at their level like those of the filter, so the bound does not change a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved, text_bytes

MAX_BITS = 1 << 29
BITS_PER_KEY, PROBES = 12, 6
FREQUENT = 1 << 19
PRIOR = 100.0  # weight of the unigram model against a context's own counts
SEGMENT_TEXT = 4 << 20  # bytes of text a segment stands for
MAX_POWER = 20  # segments are at most 2 ** MAX_POWER; more text makes them larger instead
_FLUSH = 2_000_000  # tokens
_END = np.uint64(xxhash.xxh64_intdigest(b" "))  # the end token: no word holds a blank
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LEVELS = 48


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    return h ^ (h >> np.uint64(29))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, of their bigrams (the first follows an end), and offsets."""
    parts, end = [], np.array([_END])
    for t in texts:
        w = t.lower().split()
        parts += [np.fromiter(map(xxhash.xxh64_intdigest, w), "<u8", len(w)), end]
    at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts[::2]])]).astype(np.int64)
    one = np.concatenate(parts) if parts else np.empty(0, "<u8")
    before = np.concatenate([end, one[:-1]]) if len(one) else one
    return one, _mix(_mix(before) * _B + one), at


def _planes(a: np.ndarray) -> bytes:
    """An array's first bytes, its second bytes and so on: alike ones stand together and compress."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _of_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _counts(texts: DataFrame, shift: int) -> DataFrame:
    """(kind, seg, keys, counts) from column t: pre-aggregated hashes, packed per segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if held[kind]:
                    keys, n = np.unique(np.concatenate(held[kind]), return_counts=True)
                    seg = (keys >> np.uint64(shift)).astype(np.int64)
                    own, first = np.unique(seg, return_index=True)
                    cut = [*first.tolist(), len(keys)]
                    raw, num = keys.astype("<u8"), n.astype("<u4")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), kind, "i4")), pa.array(own.astype("i4")),
                         pa.array([_planes(raw[x:y]) for x, y in zip(cut, cut[1:])], pa.binary()),
                         pa.array([num[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())],
                        ["kind", "seg", "keys", "counts"])
            held[0].clear()
            held[1].clear()

        held: list[list[np.ndarray]] = [[], []]
        n = 0
        for b in batches:
            one, two, _ = _tokens(b.column(0).to_pylist())
            held[0].append(one)
            held[1].append(two)
            n += len(one)
            if n >= _FLUSH:
                yield from flush()
                n = 0
        yield from flush()

    return texts.mapInArrow(run, "kind int, seg int, keys binary, counts binary")


def _merged(rows: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    keys, n = [], []
    for k, x, y in zip(rows.column("kind").to_pylist(), rows.column("keys").to_pylist(), rows.column("counts").to_pylist()):
        if k == kind:
            keys.append(_of_planes(x, "<u8"))
            n.append(np.frombuffer(y, "<u4"))
    if not keys:
        return np.empty(0, "<u8"), np.empty(0, np.int64)
    key, num = np.concatenate(keys), np.concatenate(n).astype(np.int64)
    order = np.argsort(key)
    key, num = key[order], num[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(num, first)


def _log2(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1] - 1


def _of_level(level: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of its range; none below level 0."""
    return np.where(level < 0, 0.0, np.where(level == 0, 1.0, 1.5 * np.exp2(level)))


def _positions(h: np.ndarray, kind: int, level: np.ndarray, bits: np.ndarray, probe: int) -> np.ndarray:
    a = _mix(h + (level.astype(np.uint64) * np.uint64(2) + np.uint64(kind)) * _B)
    step = _mix(a * _B) | np.uint64(1)
    return (a + np.uint64(probe) * step) % bits.astype(np.uint64)


def _segment(rows: pa.Table, most_bits: int) -> pa.Table:
    """One segment's merged unigrams, its piece of the filter and the bigrams that are not in it."""
    grams = [_merged(rows, 0), _merged(rows, 1)]
    low = 1
    while True:  # bigrams are kept from counts of 2 ** low on, unigrams from half of that on
        n_keys = sum(int(np.maximum(_log2(n) - (low - 1 + kind) + 1, 0).sum()) for kind, (_, n) in enumerate(grams))
        if n_keys * BITS_PER_KEY <= most_bits:
            break
        low += 1
    bits = max(-(-n_keys * BITS_PER_KEY // 64) * 64, 64)
    table = np.zeros(bits, bool)
    for kind, (key, n) in enumerate(grams):
        top = _log2(n)
        for level in range(low - 1 + kind, int(top.max(initial=0)) + 1):
            h = key[top >= level]
            for probe in range(PROBES):
                table[_positions(h, kind, np.full(1, level), np.full(1, bits), probe)] = True
    key, n = grams[1]
    below = _log2(n) < low
    tail = np.frombuffer(_planes(key[below]), np.uint8).reshape(8, -1)
    rest = _log2(n[below]).astype("u1")
    key, n = grams[0]
    seg = rows.column("seg")[0].as_py()
    return pa.Table.from_pydict({
        "seg": pa.array([seg], pa.int32()), "low": pa.array([low], pa.int32()), "bits": pa.array([bits], pa.int64()),
        "filter": pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary()),
        "tail": pa.array([tail[:5].tobytes()], pa.binary()),  # low bytes of hashes do not compress
        "tail_high": pa.array([zlib.compress(tail[5:].tobytes(), 1)], pa.binary()),
        "tail_level": pa.array([zlib.compress(rest.tobytes(), 1)], pa.binary()),
        "keys": pa.array([key.tobytes()], pa.binary()), "counts": pa.array([n.astype("<i8").tobytes()], pa.binary()),
        "tokens": pa.array([int(n.sum())], pa.int64()), "words": pa.array([len(key)], pa.int64()),
        "by_level": pa.array([np.bincount(_log2(n), minlength=_LEVELS).tolist()], pa.list_(pa.int64()))})


def _unigrams(segments: DataFrame, level: int, frequent: bool) -> DataFrame:
    """(h, c) of the words whose count's level reaches ``level``, or of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, c = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                own = (_log2(c) >= level) == frequent
                yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(c[own])], ["h", "c"])

    return segments.select("keys", "counts").mapInArrow(run, "h long, c long")


def fit(train: DataFrame, text_col: str = "text", max_bits: int = MAX_BITS) -> dict:
    """Count every text of ``train`` and build the filter. The result's arrays are bounded by
    ``max_bits`` (at least 1,024: a segment takes a word of 64 bits), ``MAX_POWER`` and ``FREQUENT``;
    its "rare" is a DataFrame (h, c) of the other words, its "tail" one of the segments' bigrams that
    are not in the filter. The driver gets a segment's piece of the filter, and sums over all segments."""
    if max_bits < 1 << 10:
        raise ValueError("a filter takes 1,024 bits at least")
    spark = prepare(train.sparkSession)
    texts = train.select(text_bytes(text_col).alias("t"))
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    wanted = int(np.ceil(np.log2(max(size / SEGMENT_TEXT, 1))))
    power = max(4, min(wanted, MAX_POWER, (max_bits >> 6).bit_length() - 1))
    most = max_bits >> power
    segments = saved(_counts(texts, 64 - power).groupBy("seg").applyInArrow(
        lambda t: _segment(t, most),
        "seg int, low int, bits long, filter binary, tail binary, tail_high binary, tail_level binary, keys binary, counts binary, tokens long, words long, "
        "by_level array<long>"))
    got = segments.select("seg", "low", "bits", "filter").toArrow()
    tokens, n_words, *levels = segments.agg(F.sum("tokens"), F.sum("words"), *[
        F.sum(F.col("by_level")[k]) for k in range(_LEVELS)]).first()
    levels = np.array([x or 0 for x in levels])
    at_least = np.cumsum(levels[::-1])[::-1]  # words of each level or more
    level = int(np.argmax(at_least <= FREQUENT))
    top = _unigrams(segments, level, True).toArrow()
    h, c = top.column("h").to_numpy().view("<u8"), top.column("c").to_numpy()
    order = np.argsort(h)
    seg, n = got.column("seg").to_numpy(), 1 << power
    low, bits, parts = np.ones(n, np.int64), np.full(n, 64, np.int64), [bytes(8)] * n  # as without a key
    low[seg], bits[seg] = got.column("low").to_numpy(), got.column("bits").to_numpy()
    for k, part in zip(seg.tolist(), got.column("filter")):
        parts[k] = part.as_py()
    return {"power": power, "low": low, "bits": bits, "first": np.concatenate([[0], np.cumsum(bits // 8)[:-1]]),
            "filter": np.frombuffer(b"".join(parts), np.uint8),
            "h": h[order], "c": c[order], "tokens": tokens or 0, "words": n_words or 0,
            "rare": _unigrams(segments, level, False),
            "tail": segments.select("seg", "tail", "tail_high", "tail_level")}


def estimated(model: dict, h: np.ndarray, kind: int) -> np.ndarray:
    """Counts by repeated membership probes: the middle of the last level that is present, 0 for
    what is not in the filter."""
    return _of_level(_probed(model, h, kind))


def _probed(model: dict, h: np.ndarray, kind: int) -> np.ndarray:
    """Levels by repeated membership probes; -1 for what is not in the filter."""
    seg = (h >> np.uint64(64 - model["power"])).astype(np.int64)
    low, bits, first, table = model["low"][seg] - 1 + kind, model["bits"][seg], model["first"][seg], model["filter"]
    level = low - 1  # the last level found
    todo = np.arange(len(h))
    while len(todo):
        here = todo
        for probe in range(PROBES):
            p = _positions(h[here], kind, level[here] + 1, bits[here], probe)
            byte = table[first[here] + (p >> np.uint64(3)).astype(np.int64)]
            here = here[(byte >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            if not len(here):
                break
        level[here] += 1
        todo = here[level[here] < _LEVELS]
    return np.where(level < low, -1, level)


_PACKED = "chunk long, seg int, keys binary, at binary, word binary"


def _packed(chunk: int, power: int, pair: np.ndarray, row: np.ndarray, word: np.ndarray) -> list[pa.Array]:
    """Bigrams to look up, a record for each segment: hashes, rows and the levels of their words."""
    seg = (pair >> np.uint64(64 - power)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    own, first = np.unique(seg[order], return_index=True)
    cut = [*first.tolist(), len(seg)]
    pair, row, word = pair[order].astype("<u8"), row[order].astype("<i8"), (word[order] + 1).astype("u1")
    part = lambda f: pa.array([f(x, y) for x, y in zip(cut, cut[1:])], pa.binary())
    return [pa.array(np.full(len(own), chunk, "i8")), pa.array(own.astype("i4")),
            part(lambda x, y: pair[x:y].tobytes()), part(lambda x, y: _planes(row[x:y])),
            part(lambda x, y: word[x:y].tobytes())]


def _replaced(t: pa.Table, new: dict[str, pa.Array]) -> pa.Table:
    for name, col in new.items():
        t = t.set_column(t.schema.get_field_index(name), name, col)
    return t


def _looked_up(mixed: DataFrame, tail: DataFrame) -> DataFrame:
    """``mixed`` with the levels of the bigrams found in place of ``keys``; other records pass."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = level = None
        if right.num_rows:
            low, high, raw = (right.column(c)[0].as_py() for c in ("tail", "tail_high", "tail_level"))
            keys, level = _of_planes(low + zlib.decompress(high), "<u8"), np.frombuffer(zlib.decompress(raw), "u1")
        out: list[list] = [[], [], []]
        for x, y, z in zip(*(left.column(c).to_pylist() for c in ("keys", "at", "word"))):
            if x is not None and keys is not None and len(keys):
                sought = np.frombuffer(x, "<u8")
                place = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
                hit = keys[place] == sought
                x, y, z = (level[place[hit]].tobytes(), _planes(_of_planes(y, "<i8")[hit]),
                           np.frombuffer(z, "u1")[hit].tobytes())
            elif x is not None:
                x = y = z = b""
            for cell, v in zip(out, (x, y, z)):
                cell.append(v)
        return _replaced(left, {c: pa.array(v, pa.binary()) for c, v in zip(("keys", "at", "word"), out)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mixed.schema)
    return mixed.groupBy("seg").cogroup(tail.groupBy("seg")).applyInArrow(run, schema)


def _gains(t: pa.Table, total: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, what the bigrams found add to its score): log10 of 1 + c / (PRIOR p(w))."""
    parts = [(x, y, z) for x, y, z in zip(*(t.column(c).to_pylist() for c in ("keys", "at", "word"))) if x]
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    level, word = (np.frombuffer(b"".join(p[k] for p in parts), "u1").astype(np.int64) for k in (0, 2))
    row, own = np.unique(np.concatenate([_of_planes(p[1], "<i8") for p in parts]), return_inverse=True)
    p = np.minimum((_of_level(word - 1) + 0.1) / total, 1.0)
    return row, np.bincount(own, np.log10(1 + _of_level(level) / (PRIOR * p)), len(row))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score, and ``keep``.

    ``base_score`` is the add-0.1 unigram score from exact counts. ``score`` is the text's log10
    probability under the filter's model: p(w | v) = (c(v w) + PRIOR p(w)) / (c(v) + PRIOR) with
    estimated counts, p(w) smoothed like the base. Null and empty texts are an end token alone.
    Repeated rows get equal scores; other columns are ignored; an empty table gives no rows; a
    model of an empty corpus scores every token as unknown.
    """
    spark = prepare(docs.sparkSession)
    state = {k: v for k, v in model.items() if k not in ("rare", "tail")}
    shared = spark.sparkContext.broadcast(state)
    n, v = model["tokens"], model["words"]
    total = n + 0.1 * (v + 1)
    src = docs.select(F.col(id_col).alias("id"), *keep, text_bytes(text_col).alias("t"))
    open_type = pa.list_(pa.struct([("h", pa.int64()), ("lw", pa.int32()), ("lv", pa.int32()), ("lp", pa.int32()),
                                    ("w", pa.int64()), ("v", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        task = TaskContext.get().partitionId() << 33
        chunk, done, waiting, held = task, 0, 0, []
        end = _probed(m, np.array([_END]), 0)
        like = None

        def flush() -> pa.RecordBatch:
            packed = _packed(chunk, m["power"], *(np.concatenate([x[k] for x in held]) for k in range(3)))
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(packed[0]), t) for t in like.types[:-5]), *packed],
                                              names=like.names)

        def level_of(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Levels of words, which of them only the join can tell, and places in the frequent ones."""
            level = _probed(m, word, 0)
            place = np.minimum(np.searchsorted(m["h"], word), max(len(m["h"]) - 1, 0))
            known = m["h"][place] == word if len(m["h"]) else np.zeros(len(word), bool)
            if len(m["h"]):
                level = np.where((level < 0) & known, _log2(m["c"][place]), level)
            return level, (level < 0) & (m["low"][(word >> np.uint64(64 - m["power"])).astype(np.int64)] > 1), place, known

        for b in batches:
            one, two, at = _tokens(b.column(b.num_columns - 1).to_pylist())
            word, w_at = np.unique(one, return_inverse=True)
            pair, p_at = np.unique(two, return_inverse=True)
            l_word, rare, place, known = level_of(word)
            base = np.where(known, np.log10((m["c"][place] + 0.1) / total) if len(m["h"]) else 0.0, 0.0)
            l_end, rare_end, *_ = level_of(np.array([_END]))
            l_word, rare, l_pair = l_word[w_at], rare[w_at], _probed(m, pair, 1)[p_at]
            before, rare_before, v_hash = (np.concatenate([x, y[:-1]]) for x, y in (
                (l_end, l_word), (rare_end, rare), (np.array([_END]), one)))
            for x, y in ((before, l_end), (rare_before, rare_end), (v_hash, _END)):
                x[at[:-1]] = y  # a text starts after an end
            p = np.minimum((_of_level(l_word) + 0.1) / total, 1.0)
            c_before = _of_level(before)
            log = np.log10(np.minimum((np.minimum(_of_level(l_pair), c_before) + PRIOR * p) / (c_before + PRIOR), 1.0))
            opened = rare | rare_before
            log[opened] = 0.0
            known, base = known[w_at], base[w_at]
            row = task + done + np.repeat(np.arange(b.num_rows), np.diff(at))
            # a word or a word before that is unseen leaves nothing to look up
            ask = np.flatnonzero((l_pair < 0) & ~opened & (l_word >= 0) & (before >= 0))
            by = lambda x: np.add.reduceat(x, at[:-1]) if len(x) else x  # noqa: E731  every text has a token
            other, hang = np.flatnonzero(~known), np.flatnonzero(opened)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(other, at), pa.int32()),
                                             pa.array(one[other].view("<i8")))
            terms = pa.StructArray.from_arrays(
                [pa.array(two[hang].view("<i8")), *(pa.array(x[hang].astype("i4")) for x in (l_word, before, l_pair)),
                 pa.array(one[hang].view("<i8"), mask=~rare[hang]),
                 pa.array(v_hash[hang].view("<i8"), mask=~rare_before[hang])], fields=list(open_type.value_type))
            own = np.arange(b.num_rows) + task + done
            out = pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(np.diff(at)), pa.array(by(known.astype(np.int64))), pa.array(by(base)),
                 pa.array(by(log)), lists,
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(hang, at), pa.int32()), terms).cast(open_type),
                 pa.array(own), pa.array(np.full(len(own), chunk)), pa.array((own % (1 << m["power"])).astype("i4")),
                 *(pa.nulls(len(own), pa.binary()) for _ in range(3))],
                [*b.schema.names[:-1], "n_tokens", "known", "base", "score", "other", "open", "row",
                 "chunk", "seg", "keys", "at", "word"])
            like = out.schema
            yield out
            held.append((two[ask], row[ask], l_word[ask]))
            done, waiting = done + b.num_rows, waiting + len(one)
            if waiting >= _FLUSH:
                yield flush()
                chunk, waiting, held = task + done, 0, []
        if held:
            yield flush()

    def gathered(t: pa.Table) -> pa.Table:
        row, gain = _gains(t, total)
        t = t.filter(t.column("row").is_valid()).drop_columns(["chunk", "seg", "keys", "at", "word"])
        if len(row):
            own = t.column("row").to_numpy()
            place = np.minimum(np.searchsorted(row, own), len(row) - 1)
            t = _replaced(t, {"score": pa.array(t.column("score").to_numpy() + np.where(row[place] == own, gain[place], 0))})
        return t

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1])
    fields += (", n_tokens long, known long, base double, score double, other array<long>, "
               "open array<struct<h: long, lw: int, lv: int, lp: int, w: long, v: long>>, row long")
    rows = saved(_looked_up(src.mapInArrow(run, f"{fields}, {_PACKED}"), model["tail"])
                 .groupBy("chunk").applyInArrow(gathered, fields))
    rare = rows.select("row", F.explode("other").alias("h")).join(model["rare"], "h", "left")
    unknown = float(np.log10(0.1 / total))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNull(), unknown).otherwise(F.log10((F.col("c") + 0.1) / F.lit(total)))).alias("more"),
        F.count("c").alias("also"))
    out = rows.join(rare, "row", "left")
    score_col = F.col("score")
    if (model["low"] > 1).any():  # else every word is in the filter
        out = out.join(_opened(rows, model, total), "row", "left")
        score_col = F.col("score") + F.coalesce("rest", F.lit(0.0))
    return out.select("id", *keep, "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
                      F.lit(int(n)).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score_col.alias("score"))


def _opened(rows: DataFrame, model: dict, total: float) -> DataFrame:
    """(row, rest): the terms of words below their segment's count, which the join tells."""
    power = model["power"]
    level = F.expr("cast(length(bin(c)) - 1 as int)")
    words = model["rare"].select("h", level.alias("l"))
    terms = rows.select("row", F.inline("open"))
    for own, at in (("w", "lw"), ("v", "lv")):
        side = words.select(F.col("h").alias(own), F.col("l").alias("joined"))
        terms = terms.join(side, own, "left").withColumn(at, F.coalesce("joined", at)).drop("joined")
    terms = saved(terms)
    count = lambda c: f"CASE WHEN {c} < 0 THEN 0D WHEN {c} = 0 THEN 1D ELSE 1.5D * power(2D, {c}) END"
    p = f"least(({count('lw')} + 0.1D) / {total!r}D, 1D)"
    first = terms.select("row", F.expr(
        f"log10(least((least({count('lp')}, {count('lv')}) + {PRIOR}D * {p}) / ({count('lv')} + {PRIOR}D), 1D))").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for b in batches:
            h, row, lw = (b.column(k).to_numpy() for k in range(3))
            yield pa.RecordBatch.from_arrays(_packed(chunk, power, h.view("<u8"), row, lw),
                                             ["chunk", "seg", "keys", "at", "word"])
            chunk += 1

    def summed(t: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array(x) for x in _gains(t, total)], ["row", "x"])

    asked = terms.filter("lp < 0 AND lw >= 0 AND lv >= 0").select("h", "row", "lw").mapInArrow(pack, _PACKED)
    found = _looked_up(asked, model["tail"]).groupBy("chunk").applyInArrow(summed, "row long, x double")
    return first.unionByName(found).groupBy("row").agg(F.sum("x").alias("rest"))

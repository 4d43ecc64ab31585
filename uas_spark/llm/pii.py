"""Personal data (operator 3): fixed patterns plus information-theoretic sanitisation.

The patterns find the protected entities: e-mail and IP addresses, payment cards, phone numbers.
Deleting them is not enough where a term gives the entity away. Over the whole corpus of N
documents, let df(e) be the documents with entity e, df(t) those with term t and c(t, e) those
with both. The entity's information content is IC(e) = log(N / df(e)), and t reveals
PMI(t; e) = log(N c(t, e) / (df(t) df(e))) of it, at most all. Small counts say little, so c is
read a tenth of a document lower (a continuity correction) rather than cut: a term discloses e if

    log(N (c(t, e) - 1/10) / (df(t) df(e))) >= threshold * IC(e),

which a single document can reach in a corpus of any size but a few documents. Candidates are all
terms of the documents with e, wherever they stand (``far=False``: only those that stand near e
somewhere; ``far=True``: these and the ones that stand with e in two documents or more). Each is counted
over whole documents. A term that discloses e is marked wherever it occurs in a document with e:
removed if it reveals nearly everything, else generalised.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved, text_or_empty, unused

KINDS = ("email", "ip", "card", "phone", "term")
# fixed values of the contract
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a match can only start at the start of a run of digits; saying so keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[^\W\d_]{3,}")

NEAR_CHARS, NEAR_TERMS = 100, 8  # how far around an entity, and how many words on each side
DISCOUNT, THRESHOLD, REMOVE = 0.1, 0.9, 0.995
FILTER_BITS = 1 << 23  # 1 MB


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by kind as listed, then start. Leftmost matches of each
    pattern do not overlap; a match that fails its check is dropped without another try."""
    out = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            # the match starts where the run of characters before the @ starts
            at = m.start()
            while at > free and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                out.append(("email", at, m.end()))
                free = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


def _entity(kind: str, value: str) -> str:
    """One name for the spellings of an entity."""
    if kind == "email":
        return f"email:{value.lower()}"
    if kind == "ip":
        return "ip:" + ".".join(p.lstrip("0") or "0" for p in value.split("."))
    return f"{kind}:" + "".join(_DIGIT.findall(value))


def _near(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """The nearest terms before and after a span; a term cut by the edge of view is left out."""
    lo, hi = max(0, start - NEAR_CHARS), min(len(text), end + NEAR_CHARS)
    before = [m for m in _TERM.finditer(text[lo:start])]
    if before and before[0].start() == 0 and lo and text[lo - 1].isalnum():
        before = before[1:]
    after = [m for m in _TERM.finditer(text[end:hi])]
    if after and after[-1].end() == hi - end and hi < len(text) and text[hi].isalnum():
        after = after[:-1]
    # words of three letters or more count for the limit; shorter ones and numbers between them come along
    words = [[k for k, m in enumerate(part) if _WORD.fullmatch(m.group())] for part in (before, after)]
    before = before[words[0][-NEAR_TERMS] if len(words[0]) >= NEAR_TERMS else 0:]
    after = after[:words[1][NEAR_TERMS - 1] + 1 if len(words[1]) >= NEAR_TERMS else None]
    return ([(m.group().lower(), lo + m.start(), lo + m.end()) for m in before]
            + [(m.group().lower(), end + m.start(), end + m.end()) for m in after])


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _outside(starts: list[int], ends: list[int], s: int, e: int) -> bool:
    i = bisect_left(ends, s + 1)  # the first stretch that ends after the term starts
    return i == len(ends) or starts[i] >= e


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, base, entities, near) per row: base spans as text, and what stands near each entity.

    ``tk`` is a hash of the text: rows that share an id but not a text stay apart.
    """
    near_type = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, entities, near = [], [], []
            for text in b.column(2).to_pylist():
                spans = base_spans(text)
                base.append([f"{k}:{s}:{e}" for k, s, e in spans])
                names = [_entity(k, text[s:e]) for k, s, e in spans]
                entities.append(sorted(set(names)))
                starts, ends = _merged([(s, e) for _, s, e in spans])
                seen = {(name, t) for name, (_, s, e) in zip(names, spans) for t, ts, te in _near(text, s, e)
                        if _outside(starts, ends, ts, te)}
                near.append([{"entity": n, "term": t} for n, t in sorted(seen)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(base, pa.list_(pa.string())),
                 pa.array(entities, pa.list_(pa.string())), pa.array(near, near_type)],
                ["id", "tk", "base", "entities", "near"])

    prepare(docs.sparkSession)
    src = _source(docs, id_col, text_col)
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, tk long, base array<string>, "
                               "entities array<string>, near array<struct<entity: string, term: string>>")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("tk"),
                       text_or_empty(text_col).alias("t"))


def _key() -> Column:
    """One name for a document (id, tk); a null id is a name of its own."""
    return F.concat_ws(":", F.col("id").isNull().cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")),
                       F.col("tk").cast("string")).alias("d")


def _filter_of(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over ``terms``."""
    mask = FILTER_BITS - 1
    words = (terms.select(F.explode(F.expr(
        f"array(crc32(cast(term AS binary)) & {mask}L, shiftright(crc32(cast(term AS binary)), 8) & {mask}L)"))
        .alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("w"))
        .agg(F.expr("bit_or(1L << cast(p & 63 as int))").alias("m")).toArrow())
    table = np.zeros(FILTER_BITS // 64, "<i8")
    table[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return table.view(np.uint8)


def _passing(bits: np.ndarray, text: str) -> list[str]:
    """The distinct terms of a text that the filter lets through."""
    own = list({w.lower() for w in set(_TERM.findall(text))})
    h = np.fromiter((zlib.crc32(w.encode()) for w in own), np.int64, len(own))
    x, y = h & (FILTER_BITS - 1), (h >> 8) & (FILTER_BITS - 1)
    hit = (bits[x >> 3] >> (x & 7).astype(np.uint8)) & (bits[y >> 3] >> (y & 7).astype(np.uint8)) & 1
    return [own[k] for k in np.flatnonzero(hit).tolist()]


def _document_counts(docs: DataFrame, terms: DataFrame, extra: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """(term, df): in how many distinct documents of ``docs`` each of ``terms`` occurs.

    One pass over every text. A Bloom filter of fixed size spares the shuffle most other terms;
    the join takes out those it lets through. ``extra`` (d, more) are the documents that the table
    holds more than once, and how many times too often; these times are taken off again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def flush(n: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())],
                                              ["term", "n"])
        n: Counter = Counter()
        for b in batches:
            for text, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for term in _passing(bits, text):
                    n[term] += more
            if len(n) > 100_000:
                yield flush(n)
                n = Counter()
        yield flush(n)

    texts = docs.select(text_or_empty(text_col).alias("t"), F.lit(1).alias("more"))
    if extra is not None:
        again = _source(docs, id_col, text_col).select(_key(), "t").join(extra, "d").dropDuplicates(["d"])
        texts = texts.unionByName(again.select("t", (-F.col("more")).cast("int").alias("more")))
    seen = texts.mapInArrow(run, "term string, n long")
    return seen.groupBy("term").agg(F.sum("n").alias("df")).join(terms, "term", "left_semi")


def _all_counts(docs: DataFrame, extra: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """(term, df): in how many distinct documents each term occurs that some document with an entity
    holds. One pass over every text; ``extra`` as for ``_document_counts``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(n: Counter, held: set) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64()),
                                               pa.array([t in held for t in n], pa.bool_())], ["term", "n", "held"])
        n, held = Counter(), set()
        for b in batches:
            for text, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {w.lower() for w in set(_TERM.findall(text))}
                for term in own:
                    n[term] += more
                if base_spans(text):
                    held |= own
            if len(n) > 100_000:
                yield flush(n, held)
                n, held = Counter(), set()
        yield flush(n, held)

    texts = docs.select(text_or_empty(text_col).alias("t"), F.lit(1).alias("more"))
    if extra is not None:
        again = _source(docs, id_col, text_col).select(_key(), "t").join(extra, "d").dropDuplicates(["d"])
        texts = texts.unionByName(again.select("t", (-F.col("more")).cast("int").alias("more")))
    seen = texts.mapInArrow(run, "term string, n long, held boolean")
    return seen.groupBy("term").agg(F.sum("n").alias("df"), F.bool_or("held").alias("held")).filter("held").drop("held")


def _disclosing_whole(docs: DataFrame, held: DataFrame, extra: DataFrame | None, n: int,
                      id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``disclosing`` with all terms of whole documents as candidates.

    Entities of the same documents have the same shares, so one of them stands for all: a document of many
    addresses that no other has pairs its terms once. What ``df`` and ``df_e`` alone rule out is not paired.
    """
    def share(c: str) -> Column:
        value = F.expr(f"ln(({c} - {DISCOUNT}D) * {n}D / (df * df_e)) / greatest(ln({n}D / df_e), 1e-9)")
        return F.least(value, F.lit(1.0))

    of = held.groupBy("entity").agg(F.count("*").alias("df_e"), F.expr("bit_xor(xxhash64(d))").alias("x"),
                                    F.expr("bit_xor(xxhash64(d, 1))").alias("y"))
    of = saved(of.groupBy("df_e", "x", "y").agg(F.min("entity").alias("entity")).select("entity", "df_e"))
    held = saved(held.join(of, "entity"))
    sizes = of.select("df_e").distinct().agg(F.max("df_e")).first()[0] or 1
    # c is at most df and df_e, and the most documents a term can have rises with df_e
    most = (sizes - DISCOUNT) * n / sizes / (n / sizes) ** threshold if n else 0
    counts = saved(_all_counts(docs, extra, id_col, text_col).filter(F.col("df") <= most * (1 + 1e-9) + 1))
    both = saved(_occurrences(docs, counts.select("term"), id_col, text_col).join(counts, "term"))
    pairs = both.select("d", "term", "df").join(held, "d").filter(share("least(df, df_e)") >= threshold)
    told = (pairs.groupBy("entity", "term", "df", "df_e").agg(F.count("*").alias("c"))
            .withColumn("share", share("c")).filter(F.col("share") >= threshold).select("entity", "term", "share"))
    # of the entities that a term discloses in a document, the one it tells most of
    found = (held.select("d", "entity").join(told, "entity").groupBy("d", "term")
             .agg(F.max(F.struct("share", "entity")).alias("m")))
    return both.select("d", "term", "at").join(found, ["d", "term"]).select("d", "m.entity", "term", "at", "m.share")


def _occurrences(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, term, at) for the rows of ``docs`` with an entity: which of ``terms`` they hold, and
    where outside entities."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(terms))
    at_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            out: list[list] = [[], [], []]
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = base_spans(text)
                if spans:
                    at: dict[str, list] = {t: [] for t in _passing(bits, text)}
                    starts, ends = _merged([(s, e) for _, s, e in spans])
                    for m in _TERM.finditer(text):
                        own = at.get(m.group().lower())
                        if own is not None and _outside(starts, ends, *m.span()):
                            own.append({"s": m.start(), "e": m.end()})
                    for cell, v in zip(out, ([d] * len(at), at.keys(), at.values())):
                        cell.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()),
                                              pa.array(out[2], at_type)], ["d", "term", "at"])

    found = _source(docs, id_col, text_col).select(_key(), "t").mapInArrow(
        run, "d string, term string, at array<struct<s: long, e: long>>")
    return found.join(terms, "term", "left_semi").dropDuplicates(["d", "term"])


def _shared_terms(docs: DataFrame, held: DataFrame, of_entity: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(entity, term): terms that stand with an entity in two documents or more, however far from it.

    Only documents with an entity of several documents are read again. What stands with an entity in one
    document only is evidence by its nearness alone.
    """
    several = held.join(of_entity.filter("df_e > 1"), "entity").groupBy("d").agg(F.collect_set("entity").alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for names, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = base_spans(text)
                starts, ends = _merged([(s, e) for _, s, e in spans])
                terms = {m.group().lower() for m in _TERM.finditer(text) if _outside(starts, ends, *m.span())}
                n.update((name, t) for name in names for t in terms)
            cols = list(zip(*n)) if n else [(), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(n.values(), pa.int64())],
                                             ["entity", "term", "n"])

    texts = _source(docs, id_col, text_col).select(_key(), "t").join(several, "d").dropDuplicates(["d"]).select("names", "t")
    found = texts.mapInArrow(run, "entity string, term string, n long")
    return found.groupBy("entity", "term").agg(F.sum("n").alias("n")).filter("n > 1").select("entity", "term")


def disclosing(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, threshold: float,
               far: bool | None = None) -> DataFrame:
    """(d, entity, term, at, share): the terms that disclose an entity in each document that holds
    both, with their places there and discounted PMI / IC. By default terms anywhere in a document with the
    entity are candidates, and the entity is the one that the term tells most of."""
    held = rows.select(_key(), F.explode("entities").alias("entity")).distinct()
    of_entity = held.groupBy("entity").agg(F.count("*").alias("df_e"))
    # rows of one id and text are one document in c, df(e), df(t) and N
    again = saved(rows.groupBy(_key()).agg((F.count("*") - 1).alias("more")).filter("more > 0"))
    more = again.agg(F.sum("more")).first()[0] or 0
    n = rows.count() - more
    if far is None:
        return _disclosing_whole(docs, held, again if more else None, n, id_col, text_col, threshold)
    near = rows.select(F.inline("near"))
    if far:
        near = near.unionByName(_shared_terms(docs, held, of_entity, id_col, text_col))
    near = near.distinct()
    pairs = saved(near.join(of_entity, "entity"))
    counts = _document_counts(docs, pairs.select("term").distinct(), again if more else None, id_col, text_col)

    def share(c: str) -> Column:
        value = F.expr(f"ln(({c} - {DISCOUNT}D) * {n}D / (df * df_e)) / greatest(ln({n}D / df_e), 1e-9)")
        return F.least(value, F.lit(1.0))

    # c is at most df(t) and df(e): pairs that could not pass with that are not counted
    pairs = saved(pairs.join(counts, "term").filter(share("least(df, df_e)") >= threshold))
    both = saved(_occurrences(docs, pairs.select("term").distinct(), id_col, text_col)
                 .join(pairs, "term").join(held, ["d", "entity"], "left_semi"))
    told = (both.groupBy("entity", "term", "df", "df_e").agg(F.count("*").alias("c"))
            .withColumn("share", share("c")).filter(F.col("share") >= threshold).select("entity", "term", "share"))
    return both.select("d", "entity", "term", "at").join(told, ["entity", "term"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
         far: bool | None = None) -> DataFrame:
    """(id, tk, base, extra) per row of ``docs``.

    ``base`` holds the pattern spans "kind:start:end" by kind, then start; ``extra`` the spans
    (start, end, share) of terms that disclose an entity of the same row. Null and empty texts
    have none; repeated rows each get their spans; other columns are ignored; an empty table
    gives no rows. Candidates come from whole documents, whatever their distance to the entity, so the rare
    words of a document with an entity of its own are marked; ``far`` as in the module's description.
    """
    rows = saved(_scan(docs, id_col, text_col))
    told = disclosing(docs, rows, id_col, text_col, threshold, far)
    extra = (told.select("d", "share", F.inline("at")).groupBy("d", "s", "e").agg(F.max("share").alias("share"))
             .groupBy("d").agg(F.sort_array(F.collect_list(F.struct("s", "e", "share"))).alias("extra")))
    return rows.withColumn("d", _key()).join(extra, "d", "left").select("id", "tk", "base", "extra")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", far: bool | None = None) -> DataFrame:
    """Counts, digest and text of the spans per row of ``docs`` (see ``find``)."""
    found = find(docs, id_col, text_col, far=far)
    count = [F.expr(f"cast(size(filter(base, x -> startswith(x, '{k}:'))) as long)").alias(f"n_{k}")
             for k in KINDS[:4]]
    terms = F.expr("transform(coalesce(extra, array()), x -> concat('term:', x.s, ':', x.e))")
    return found.select("id", *count, F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
                        F.array_join(F.concat("base", terms), ",").alias("spans"))


def _redacted(text: str, base: list[str], extra: list[dict]) -> str:
    marks = [(int(s), int(e), f"[{k.upper()}]") for k, s, e in (x.split(":") for x in base)]
    marks += [(x["s"], x["e"], "" if x["share"] >= REMOVE else "[TERM]") for x in extra]
    out, at = [], 0
    for s, e, by in sorted(marks):
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)  # of overlapping spans the first names the gap, all of it goes
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", far: bool | None = None) -> DataFrame:
    """``docs`` with entities replaced by their kind, weaker disclosing terms by [TERM] and the
    strongest removed; the columns, and texts without spans (null ones too), are unchanged. Repeated rows
    are treated alike; an empty table gives no rows."""
    found = find(docs, id_col, text_col, far=far).filter("size(base) > 0").distinct()
    i, tk, base, extra = (unused(docs, n) for n in ("__id", "__tk", "__base", "__extra"))
    marks = found.select(F.col("id").alias(i), F.col("tk").alias(tk), F.col("base").alias(base),
                         F.expr("coalesce(extra, array())").alias(extra))
    joined = docs.join(marks, F.col(id_col).eqNullSafe(F.col(i))
                       & (F.xxhash64(text_or_empty(text_col)) == F.col(tk)), "left").drop(i, tk)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, extra = (b.column(len(names) + k).to_pylist() for k in (0, 1))
            text = [t if m is None or t is None else _redacted(t, m, x)
                    for t, m, x in zip(b.column(at).to_pylist(), base, extra)]
            cols = [b.column(k) for k in range(len(names))]
            cols[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, docs.schema)

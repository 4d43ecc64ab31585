"""Main text of web pages by inferred wrappers (operator 11).

A host's wrapper is a union-free regular expression over its pages' elements, held as one
expression per label path: the order of the path's children, with optional and repeated groups,
and whether its text is a constant of the template or a slot. It is inferred from all pages of
the host. Each page folds its own repeats; equal expressions of a path meet in an aggregate; the
different ones are aligned one after the other, first in shares and then the shares' results, each
in one pass over sorted rows that holds a single expression. The values of a text meet as smallest
and largest hash: where these differ, the text is a slot.

The wrapper then tells, for each host, which region holds the article (an article element, a main
element, an element named as content, or the whole body: the first that holds most of the text
outside boilerplate), which of its constants are template, and which lists are menus. Pages are
read again and the remaining slots are their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved
from .expression import align, parse
from .markup import ARTICLE, OTHER, PARAGRAPHS, Page

# A constant is template once it stands on so many pages of a host that are not all alike.
TEMPLATE_PAGES = 5
# Share of a host's text outside boilerplate that its article region holds; share of link text in a menu.
REGION_SHARE, MENU_SHARE = 0.5, 0.9
# Alignment shares of one path; wrappers up to this size are broadcast, beyond it they are joined.
SHARES, BROADCAST_BYTES = 64, 32 << 20

_NODE = ("host string, key long, parent long, label string, level int, chain string, pages long, "
         "chars long, linked long, text_min long, text_max long, page_min long, page_max long")
_NAMES = [c.split()[0] for c in _NODE.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 7]
_CHAIN, _SUMS = 5, (6, 7, 8)
_ENDS = ((9, min), (10, max), (11, min), (12, max))


def host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text))


def _pick(a: int | None, b: int | None, which) -> int | None:
    return b if a is None else a if b is None else which(a, b)


def _nodes(pages: DataFrame) -> DataFrame:
    """One row per (host, path, expression), already summed within a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, list] = {}
            for name, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = Page(html.decode("utf-8", "replace"))
                whole = _hash("\n".join(t for _, t in page.blocks))
                for p in page.paths:
                    text = _hash("\n".join(p.texts)) if p.texts else None
                    for k, chain in enumerate(sorted(p.chains)):
                        row = seen.get((name, p.key, chain))
                        if row is None:
                            row = seen[name, p.key, chain] = [
                                name, _signed(p.key), _signed(p.parent.key) if p.parent else None, p.label, p.level,
                                chain, 0, 0, 0, None, None, None, None]
                        # a page's figures of a path go with the first of its expressions
                        own = (1, p.chars, min(p.linked, p.chars)) if k == 0 else (0, 0, 0)
                        for at, x in zip(_SUMS, own):
                            row[at] += x
                        for (at, which), x in zip(_ENDS, (text, text, whole, whole)):
                            row[at] = _pick(row[at], x, which)
            cols = list(zip(*seen.values())) if seen else [[] for _ in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES)

    return pages.mapInArrow(run, _NODE)


def _aligned(nodes: DataFrame, share: Column) -> DataFrame:
    """Rows of one (host, path, share) become one row with their aligned expression, in sorted streams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, None  # the open row
        for b in batches:
            out = []
            for *row, part in zip(*(c.to_pylist() for c in b.columns)):
                if group == (row[0], row[1], part):
                    if last[_CHAIN] != row[_CHAIN]:
                        last[_CHAIN] = str(align(parse(last[_CHAIN]), parse(row[_CHAIN])))
                    for at in _SUMS:
                        last[at] += row[at]
                    for at, which in _ENDS:
                        last[at] = _pick(last[at], row[at], which)
                else:
                    if last is not None:
                        out.append(last)
                    last, group = row, (row[0], row[1], part)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, _TYPES)], _NAMES)

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["host", "key", "share"]
    return (nodes.withColumn("share", share).repartition(n, *keys).sortWithinPartitions(*keys, "chain")
            .mapInArrow(run, _NODE))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The wrapper of every host: one row per label path outside boilerplate.

    (host, key, parent, label, level, chain, pages, chars, linked, text_min, text_max, page_min,
    page_max): ``chain`` is the aligned expression over the children (``#`` a text,
    ``?`` optional, ``+`` and ``*`` repeated, ``( )+`` a repeated group), ``pages`` counts the pages
    with the path, ``chars`` and ``linked`` their text there and its part in links; the smallest and
    largest hash of that text, and of those pages' whole text, follow. Null html counts as an empty
    page, a null or host-less url as the host ``''``; other columns are ignored; an empty table
    gives no rows.
    """
    prepare(pages.sparkSession)
    src = pages.select(host(F.col(url_col)).alias("host"),
                       F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"))
    same = ["host", "key", "chain"]
    met = _nodes(src).groupBy(*same).agg(
        *[F.first(c).alias(c) for c in ("parent", "label", "level")],
        *[F.sum(c).alias(c) for c in ("pages", "chars", "linked")],
        *[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in ("text_min", "text_max", "page_min", "page_max")])
    met = met.select(*_NAMES)
    return _aligned(_aligned(met, F.pmod(F.xxhash64("chain"), F.lit(SHARES))), F.lit(0).cast("long"))


def _child_marks(nodes: DataFrame) -> DataFrame:
    """(host, key) of the paths that the parent's expression repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, keys = [], []
            for name, key, chain in zip(*(c.to_pylist() for c in b.columns)):
                c = parse(chain)
                for label in c.marks:
                    if label != "#" and c.many(label):
                        hosts.append(name)
                        keys.append(_signed(xxhash.xxh64_intdigest(label, key & ((1 << 64) - 1))))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64())], ["host", "key"])

    return nodes.select("host", "key", "chain").mapInArrow(run, "host string, key long")


def rules(nodes: DataFrame) -> DataFrame:
    """What a host's wrapper says of its pages: (host, level, repeated, template, menus).

    ``level`` is the region that holds the article; the others are lists of path keys. Hosts whose
    article is in article elements and that have neither template texts nor menus have no row.
    """
    nodes = nodes.withColumn("own", F.col("chars") - F.col("linked"))
    at = [F.sum(F.when(F.col("level") <= k, F.col("own")).otherwise(0)) for k in range(ARTICLE, OTHER)]
    level = F.lit(OTHER)
    for k, chars in reversed(list(enumerate(at, ARTICLE))):
        level = F.when(chars >= REGION_SHARE * F.sum("own"), k).otherwise(level)
    tag = F.substring_index("label", ".", 1)
    prose = tag.isin(*sorted(PARAGRAPHS))
    template = ((F.col("text_min") == F.col("text_max")) & (F.col("page_min") < F.col("page_max"))
                & (F.col("pages") >= TEMPLATE_PAGES) & ~(prose & (F.col("level") == ARTICLE)))
    menu = (F.col("chars") > 0) & (F.col("linked") >= MENU_SHARE * F.col("chars")) & ~prose
    marked = nodes.withColumn("template", template).withColumn("menu", menu)
    per_host = marked.groupBy("host").agg(
        level.alias("level"), F.collect_list(F.when(F.col("template"), F.col("key"))).alias("template"),
        F.collect_list(F.when(F.col("menu"), F.col("key"))).alias("menus"))
    per_host = per_host.filter((F.col("level") != ARTICLE) | (F.size("template") > 0) | (F.size("menus") > 0))
    many = (_child_marks(nodes).join(per_host.filter(F.size("template") > 0).select("host"), "host", "left_semi")
            .groupBy("host").agg(F.collect_list("key").alias("repeated")))
    return per_host.join(many, "host", "left")


def extract(html: str, level: int = ARTICLE, repeated: frozenset = frozenset(), template: frozenset = frozenset(),
            menus: frozenset = frozenset()) -> str:
    """The main text of one page under its host's rules."""
    page = Page(html)
    kept: list[tuple[int, str]] = []
    for path, text in page.blocks:
        keys, p = [], path
        while p is not None and (template or menus):
            keys.append(_signed(p.key))
            p = p.parent
        if keys and (keys[0] in menus or (keys[0] in template and repeated.isdisjoint(keys))):
            continue
        kept.append((path.level, text))
    # a page without the host's region falls back to the next one
    for region in range(level, OTHER + 1):
        out = [text for at, text in kept if at <= region]
        if out:
            return "\n\n".join(out)
    return ""


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, url, text, n_chars) per row of ``pages``: the article's blocks, two line feeds between.

    Character references are decoded, white space inside a block becomes one space. Null and empty
    html give an empty text; ids and urls may be null or repeat (every row is read for itself);
    other columns are ignored; an empty table gives no rows. Rules are broadcast up to
    ``broadcast_bytes`` and joined beyond that.
    """
    prepare(pages.sparkSession)
    told = saved(rules(saved(wrappers(pages, url_col, html_col))))
    keys = F.size("template") + F.size("menus") + F.coalesce(F.size("repeated"), F.lit(0))
    size = told.agg(F.sum(64 + F.octet_length("host") + 8 * keys)).first()[0] or 0
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                       F.col(html_col).cast("string").cast("binary").alias("html"), host(F.col(url_col)).alias("host"))
    src = src.join(F.broadcast(told) if size <= broadcast_bytes else told, "host", "left").select(
        "id", "url", "html", "level", "repeated", "template", "menus")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract((html or b"").decode("utf-8", "replace"), level or ARTICLE, frozenset(many or ()),
                             frozenset(fixed or ()), frozenset(lists or ()))
                     for html, level, many, fixed, lists in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")

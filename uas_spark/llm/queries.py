"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, chat, decontaminate, langid, lmscore, negatives, packing, pii, quality, simhash, spelling,
               tokenbin, wrappers)
from .common import id_bucket, prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if oracle:
            ORACLE[name] = oracle
        return fn
    return deco


@query("op1_language")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_bucket("doc_id", 4) == 2)
    model = langid.fit(docs, usable=~F.col("held_out"))
    out = langid.predict(docs, model).withColumnRenamed("id", "doc_id")
    return out.withColumn("held_out", id_bucket("doc_id", 4) == 2).select(
        "doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


@query("op2_simhash")
def op2(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op3_personal_data")
def op3(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_quality")
def op4(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op5_decontaminate", f"""
WITH sh AS (SELECT 'd' side, doc_id id, {_WORDS} w FROM documents
            UNION ALL SELECT 'b', item_id, {_WORDS} FROM benchmark),
g AS (SELECT DISTINCT side, id, array_to_string(list_slice(w, k, k + 4), ' ') s
      FROM (SELECT side, id, w, unnest(range(1, len(w) - 3)) k FROM sh WHERE len(w) >= 5)),
n AS (SELECT id, count(*) n_item FROM g WHERE side = 'b' GROUP BY 1)
SELECT d.id doc_id, b.id item_id, count(*) n_found, any_value(n_item) n_item,
       count(*) / any_value(n_item) containment
FROM g d JOIN g b ON d.s = b.s JOIN n ON n.id = b.id
WHERE d.side = 'd' AND b.side = 'b' GROUP BY 1, 2 HAVING count(*) >= {decontaminate.THRESHOLD} * any_value(n_item)""")
def op5(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@query("op6_token_files")
def op6(spark, sf_dir):
    return tokenbin.encode_and_read_back(table(spark, sf_dir, "documents"))


@query("op7_nearest")
def op7(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_lm_score")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_bucket("doc_id", 10) == 0)
    model = lmscore.fit(docs.filter("NOT held_out"))
    return lmscore.score(docs, model, keep=["held_out"]).withColumnRenamed("id", "doc_id")


@query("op9_packing")
def op9(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


_MARKED = "</s>[INST] ok [/INST]"
_LONG = len(chat.START + chat.SEP + chat.END)


def _esc(c: str) -> str:
    return f"regexp_replace({c}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"


@query("op10_chat", f"""
WITH c AS (SELECT conv_id, coalesce(turn, -{1 << 62}) turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL
           UNION ALL VALUES (-7, 0, 'user', '{_MARKED}'), (-7, 1, 'assistant', '{_MARKED}')),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 pos,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {chat.TURN_TOKENS} tok FROM c),
s AS (SELECT *, pos = 0 AND role = 'system' sys FROM p),
r AS (SELECT *, greatest({chat.BUDGET - chat.HISTORY} - coalesce(max(CASE WHEN sys THEN tok END)
      OVER (PARTITION BY conv_id), 0), {chat.BUDGET // 4}) room FROM s),
b AS (SELECT *, NOT sys AND tok * 2 > room big FROM r),
t AS (SELECT *, greatest(room - coalesce(max(CASE WHEN NOT big AND NOT sys THEN tok END)
      OVER (PARTITION BY conv_id), 0), 1) stride,
      coalesce(sum(CASE WHEN sys THEN 0 ELSE tok END) OVER w, 0) at0,
      coalesce(sum(CASE WHEN sys OR big THEN 0 ELSE tok END) OVER w, 0) line,
      coalesce(sum(CASE WHEN big THEN 1 ELSE 0 END) OVER w, 0) big_before,
      {_LONG} + length({_esc("role")}) + length({_esc("text")}) chars
      FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT conv_id, min(pos) first_pos, min(at0) f
      FROM t GROUP BY conv_id, big_before, big, CASE WHEN big THEN 0 ELSE line // stride END),
again AS (SELECT h.conv_id, sum(t.chars) n FROM h JOIN t ON t.conv_id = h.conv_id AND h.first_pos > 0
          AND (t.sys OR (t.pos < h.first_pos AND t.at0 + t.tok <= h.f AND t.at0 >= h.f - {chat.HISTORY}
                         AND t.tok <= {chat.HISTORY})) GROUP BY 1)
SELECT t.conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) loss_sha256,
       CAST(sum(chars) + coalesce(any_value(again.n), 0) AS BIGINT) formatted_chars
FROM t LEFT JOIN again ON again.conv_id = t.conv_id GROUP BY t.conv_id""")
def op10(spark, sf_dir):
    marked = spark.createDataFrame([(-7, 0, "user", _MARKED), (-7, 1, "assistant", _MARKED)],
                                   "conv_id long, turn long, role string, text string")
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.windows(own.unionByName(marked)))


# the given pages hold one article element each, with headings and paragraphs
_BLOCKS = "regexp_split_to_array(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '</?(?:p|h[1-6])(?: [^>]*)?>')"
_BARE = "regexp_replace(regexp_replace(b, '<br[^>]*>', ' ', 'g'), '</?[a-zA-Z][^>]*>', '', 'g')"
for _ref, _char in (("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&#39;", "''"), ("&amp;?", "&")):
    _BARE = f"regexp_replace({_BARE}, '{_ref}', '{_char}', 'g')"


@query("op11_main_text", f"""
WITH b AS (SELECT page_id, url, list_filter(list_transform({_BLOCKS}, lambda b: trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'))),
                  lambda b: b <> '') blocks FROM pages)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text,
       CAST(length(array_to_string(blocks, chr(10) || chr(10))) AS BIGINT) n_chars FROM b""")
def op11(spark, sf_dir):
    return wrappers.main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


# crc32 by its rule (reflected polynomial 0xEDB88320), over the UTF-8 bytes of code points below 2048
_CRC = """
bits AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1
         THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) t),
"""
_UTF8 = ("flatten(list_transform(regexp_split_to_array(s, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] "
         "ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END))")


@query("op12_spelling", f"""
WITH RECURSIVE {_CRC}
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') id, unnest(regexp_extract_all(translate(text,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) r FROM documents),
met AS (SELECT id, r, count(*) n, id || ':' || r s FROM runs WHERE length(r) >= {spelling.MIN_CHARS} GROUP BY ALL),
crc AS (SELECT r, n, xor(list_reduce({_UTF8}, lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256]), 4294967295), 4294967295) h
        FROM met, bits),
v AS (SELECT CASE WHEN h % {spelling.NOISE} = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END word,
             CAST(sum(n) AS BIGINT) n FROM crc GROUP BY 1
      HAVING length(word) >= {spelling.MIN_CHARS} AND sum(n) >= {spelling.MIN_COUNT}),
cut AS (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) k FROM v)),
near AS (SELECT DISTINCT a.word, b.word other, b.n k FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) n_near, max(k) k FROM near GROUP BY 1),
told AS (SELECT v.word, v.n, coalesce(n_near, 0) n_near, CASE WHEN best.k >= {spelling.FORM_RATIO} * v.n THEN best.k END form_n
         FROM v LEFT JOIN best USING (word)),
forms AS (SELECT told.word, min(other) form FROM told JOIN near ON near.word = told.word AND near.k = form_n GROUP BY 1),
walk AS (SELECT word, word AS last, 0 AS step FROM told
         UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.last),
roots AS (SELECT word, arg_max(last, step) root FROM walk GROUP BY 1)
SELECT told.word, form, root, n, n_near, form_n FROM told LEFT JOIN forms USING (word) JOIN roots USING (word)""")
def op12(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label,
                  list_transform(embedding, lambda x: floor({negatives.SCALE} * CAST(x AS DOUBLE))) x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id positive_id, score positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) rank, vec_id negative_id, positive_score,
       score negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {negatives.LOW} * positive_score <= 100 * score
     AND 100 * score <= {negatives.HIGH} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {negatives.NEGATIVES}""")
def op13(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)

"""Chat formatting in budgeted windows (operator 10), with DataFrame and SQL functions only.

A turn is written as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line end. Inside roles
and texts, ``<`` followed by any number of backslashes and ``|`` gets one backslash more, so no
marker can occur there, and taking one away gives the original back.

Prefix sums of turn tokens lay turns end to end. A window's span is the turns that start in one
stretch of that line, so spans are turn-aligned and every turn is in exactly one. The stretch is
what the budget leaves beside the system turn and the history, less the longest turn, so a span
never overruns; turns over half of what is left stand alone. Each later window starts with the
conversation's system turn and the preceding turns of at most ``history`` tokens; these repeats
are context. The loss mask holds the assistant texts of the span alone.

Prefix sums run in two levels, over blocks of turns and over the blocks' totals, and history is
joined by stretches of the line, so a very long conversation is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved, word_count_column

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
BUDGET, HISTORY, TURN_TOKENS, BLOCK_TURNS = 1024, 256, 4, 64


def escaped(col: Column) -> Column:
    return F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")


def unescaped(col: Column) -> Column:
    return F.regexp_replace(col, r"<\\(\\*)\|", "<$1|")


def _prefix(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add, for each name, the sum of an expression over the conversation's earlier turns."""
    within = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(F.expr(e)).alias(f"__{n}") for n, e in sums.items()])
    base = totals.select("conv_id", "block", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}")
                                               for n in sums])
    own = rows.withColumns({n: F.coalesce(F.sum(F.expr(e)).over(within), F.lit(0)) for n, e in sums.items()})
    return (own.join(base, ["conv_id", "block"])
            .withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop(*[f"__{n}" for n in sums]))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, pos, role, text, tokens): the turns with their position and tokens."""
    rows = (conversations.filter("conv_id IS NOT NULL")
            .select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"),
                    F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .withColumn("block", F.expr(f"floor(turn / {BLOCK_TURNS}D)"))
            .withColumn("tokens", word_count_column(F.col("text")) + TURN_TOKENS))
    return _prefix(rows, ["turn", "role", "text"], {"pos": "1L"}).drop("turn")


def laid_out(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per turn, without its text: where it starts on the line (at) and its window
    (big_before, is_big, stretch)."""
    rows = turns.select("conv_id", "block", "pos", "tokens", F.expr("pos = 0 AND role = 'system'").alias("is_system"))
    left = rows.groupBy("conv_id").agg(
        F.greatest(F.lit(budget - history) - F.coalesce(F.max(F.expr("CASE WHEN is_system THEN tokens END")), F.lit(0)),
                   F.lit(budget // 4)).alias("room"))
    rows = rows.join(left, "conv_id").withColumn("is_big", F.expr("NOT is_system AND tokens > room / 2D"))
    longest = rows.filter("NOT is_big AND NOT is_system").groupBy("conv_id").agg(F.max("tokens").alias("longest"))
    rows = rows.join(longest, "conv_id", "left").withColumn(
        "stride", F.expr("greatest(room - coalesce(longest, 0), 1)"))
    rows = _prefix(rows, ["pos"], {"at": "CASE WHEN is_system THEN 0L ELSE tokens END",
                                   "line": "CASE WHEN is_system OR is_big THEN 0L ELSE tokens END",
                                   "big_before": "CASE WHEN is_big THEN 1L ELSE 0L END"})
    return rows.withColumn("stretch", F.expr("CASE WHEN is_big THEN 0L ELSE floor(line / cast(stride AS double)) END"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, n_context, n_tokens, loss) for all conversations.

    ``window`` is the position of the span's first turn; ``n_context`` leading turns are repeats;
    ``loss`` holds (start, end) in code points of the text. Rows are ordered by turn, role and
    text, a null turn first; repeated rows are turns of their own. Null roles and texts are
    empty; rows without a conv_id belong to no conversation and are left out; other columns are
    ignored; an empty table gives no rows. A window exceeds the budget only if one turn, or the
    system turn, is too long to fit: turns are never cut.
    """
    prepare(conversations.sparkSession)
    texts = saved(numbered(conversations))
    turns = saved(laid_out(texts, budget, history))
    key = ["conv_id", "big_before", "is_big", "stretch"]
    heads = turns.groupBy(*key).agg(F.min("pos").alias("window"), F.min("at").alias("from"))
    body = ["conv_id", "window", "place", "pos"]
    span = turns.join(heads, key).withColumn("place", F.lit(2)).select(*body)
    later = heads.filter("window > 0").select("conv_id", "window", "from")
    system = (turns.filter("is_system").select("conv_id", "pos").join(later, "conv_id")
              .withColumn("place", F.lit(0)).select(*body))
    # a turn is history of the windows that start between its end and `history` past its start
    past = (turns.filter(f"NOT is_system AND tokens <= {history}")
            .withColumn("piece", F.explode(F.expr(f"sequence(floor((at + tokens) / {history}D), floor((at + {history}) / {history}D))")))
            .select("conv_id", "piece", "pos", "tokens", "at"))
    history_rows = (past.join(later.withColumn("piece", F.expr(f"floor(from / {history}D)")), ["conv_id", "piece"])
                    .filter(f"pos < window AND at + tokens <= from AND at >= from - {history}")
                    .withColumn("place", F.lit(1)).select(*body))
    # texts join the laid-out turns once, at the end
    every = span.unionByName(system).unionByName(history_rows).join(texts.drop("block"), ["conv_id", "pos"])
    every = every.withColumns({"is_loss": F.expr("place = 2 AND role = 'assistant'"), "role": escaped(F.col("role")),
                               "text": escaped(F.col("text"))})
    turn = F.struct("place", "pos", "is_loss", F.concat(F.lit(START), "role", F.lit(SEP)).alias("head"), "text")
    grouped = every.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(turn)).alias("t"), F.sum("tokens").alias("n_tokens"))
    n_end = len(END)
    return grouped.select(
        "conv_id", "window", F.expr("concat_ws('', transform(t, x -> concat(x.head, x.text, %s)))" % _sql(END)).alias("text"),
        F.expr("cast(size(filter(t, x -> x.place < 2)) AS long)").alias("n_context"), "n_tokens",
        F.expr(f"""filter(aggregate(t,
            named_struct('at', 0L, 'spans', cast(array() AS array<struct<start: long, end: long, own: boolean>>)),
            (a, x) -> named_struct('at', a.at + length(x.head) + length(x.text) + {n_end},
                'spans', concat(a.spans, array(named_struct('start', a.at + length(x.head),
                    'end', a.at + length(x.head) + length(x.text), 'own', x.is_loss)))),
            a -> a.spans), s -> s.own)""").alias("loss"))


def _sql(s: str) -> str:
    return "'" + s.replace("\n", "\\n") + "'"


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, n_turns, turns, loss_text) per window, from text, n_context and loss:
    role, line end, text, line end of every turn that is not a repeat."""
    head, n_start, n_sep = "substring_index(x, %s, 1)" % _sql(SEP), len(START), len(SEP)
    parts = F.expr(f"slice(split(text, {_sql(END.replace('|', '[|]'))}), cast(n_context AS int) + 1, "
                   f"greatest(size(split(text, {_sql(END.replace('|', '[|]'))})) - 1 - cast(n_context AS int), 0))")
    one = unescaped_sql(f"substring({head}, {n_start} + 1)"), unescaped_sql(f"substring(x, length({head}) + {n_sep} + 1)")
    return formatted.withColumn("parts", parts).select(
        "conv_id", "window", F.size("parts").cast("long").alias("n_turns"),
        F.expr(f"concat_ws('', transform(parts, x -> concat({one[0]}, '\\n', {one[1]}, '\\n')))").alias("turns"),
        F.expr("concat_ws('', transform(loss, s -> "
               + unescaped_sql("substring(text, cast(s.start AS int) + 1, cast(s.end - s.start AS int))")
               + "))").alias("loss_text"),
        F.length("text").cast("long").alias("n_chars"))


def unescaped_sql(expr: str) -> str:
    return f"regexp_replace({expr}, r'<\\\\(\\\\*)\\|', '<$1|')"


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted windows alone: the counts and hashes of its turns and
    of the text under the loss mask. Its texts are joined in one row, as one hash covers them."""
    back = read_back(formatted)
    order = lambda c: F.expr(f"concat_ws('', transform(sort_array(collect_list(struct(window, {c}))), x -> x.{c}))")
    return back.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sha2(order("turns").cast("binary"), 256).alias("turns_sha256"),
        F.sum(F.length("loss_text")).cast("long").alias("loss_chars"),
        F.sha2(order("loss_text").cast("binary"), 256).alias("loss_sha256"), F.sum("n_chars").alias("formatted_chars"))

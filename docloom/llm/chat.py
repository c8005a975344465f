"""Chat formatting in budgeted windows, in DataFrame functions alone.

A conversation's turns, in order of turn, have a number of tokens each (words plus ``OVERHEAD``); the prefix sum of
tokens before a turn, divided by ``SPAN``, says which window the turn is new in. So windows hold whole turns, and every
window's new turns begin within one span. A window shows, in order: the conversation's first system turn, as far as it
is not new there; those turns of the window before that begin at most ``HISTORY`` tokens ahead of it; its new turns. The
loss mask covers the texts of new assistant turns only, so each assistant text is a target exactly once.

A turn is written ``<|role|>``, line break, text, ``<|end|>``, line break. Inside roles and texts ``&``, ``<``, ``[``,
``|`` and ``>`` are written as ``&amp;`` and so on, which reverses exactly and leaves no control string standing.

No step needs a whole conversation in one task: prefix sums are taken within blocks of ``BLOCK`` turn numbers and then
over the blocks' totals, and a window's rows are bounded by the budget.

Null text: empty. Null role: empty role. Null turn: before all others. Null conv_id: one conversation of its own.
Rows with equal turn are ordered by role and text, and repeated rows are turns of their own. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import JAVA_SPACE, table

SPAN, HISTORY, OVERHEAD, BLOCK = 160, 60, 4, 1_024
#: What is escaped and how; the first pair goes first, and last when it is undone.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("|", "&#124;"))
END = "<|end|>\n"
_NONE = -(2**63)


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """``turns`` with i (place in the conversation) and before (tokens ahead), by blocks of turn numbers."""
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("i", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
    sums = turns.groupBy("conv", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    blocks = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "block", F.coalesce(F.sum("n").over(blocks), F.lit(0)).alias("n"), F.coalesce(F.sum("sum").over(blocks), F.lit(0)).alias("sum"))
    return turns.join(sums, ["conv", "block"]).withColumn("i", F.col("i") + F.col("n")).withColumn("before", F.col("before") + F.col("sum")).drop("n", "sum", "block")


def format_windows(conversations: DataFrame, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """conv_id, window (from 0), formatted, n_repeated (turns shown again, which come first), loss: array of
    struct<start, length> in characters of formatted."""
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NONE)).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(_NONE)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(JAVA_SPACE.replace("[", "[^"))) + OVERHEAD)
    turns = _prefix_sums(turns).withColumn("key", F.floor(F.col("before") / span))
    # the windows that exist: a number without gaps, and where the next one starts
    keys = turns.groupBy("conv", "key").agg(F.max(F.col("before") + F.col("tokens")).alias("upto"), F.min(F.when(F.col("role") == "system", F.col("i"))).alias("system"))
    by_key, whole = Window.partitionBy("conv").orderBy("key"), Window.partitionBy("conv")
    keys = keys.select("conv", "key", "upto", (F.row_number().over(by_key) - 1).alias("window"), F.count("*").over(whole).alias("n_windows"), F.min("system").over(whole).alias("system"))
    placed = turns.join(keys, ["conv", "key"])
    own = F.col("window")
    shown = F.when(F.col("i") == F.col("system"), F.transform(F.sequence(F.lit(0), F.col("n_windows") - 1), lambda w: F.struct(w.cast("long").alias("window"), (w == own).alias("new"))))
    shown = shown.otherwise(F.filter(F.array(F.struct(own.cast("long").alias("window"), F.lit(True).alias("new")), F.struct((own + 1).cast("long").alias("window"), F.lit(False).alias("new"))), lambda x: x["new"] | ((x["window"] < F.col("n_windows")) & (F.col("upto") - F.col("before") <= history))))
    rows = placed.select("conv", "i", "role", F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("i") == F.col("system")).alias("first"), F.inline(shown))
    # a system turn shown again comes first, then history, then what is new
    at = F.struct(F.col("new").alias("new"), (~F.coalesce("first", F.lit(False))).alias("later"), F.col("i").alias("i"), F.concat("head", "body", F.lit(END)).alias("piece"), F.char_length("head").alias("skip"), F.char_length("body").alias("length"), (F.col("new") & (F.col("role") == "assistant")).alias("target"))
    pieces = rows.groupBy("conv", "window").agg(F.sort_array(F.collect_list(at)).alias("p"))
    loss = F.expr(f"""aggregate(p, struct(0 as upto, cast(array() as array<struct<start:int,length:int>>) as spans),
        (a, x) -> struct(a.upto + x.skip + x.length + {len(END)} as upto,
            if(x.target, concat(a.spans, array(struct(a.upto + x.skip as start, x.length as length))), a.spans) as spans), a -> a.spans)""")
    return pieces.select(
        F.when(F.col("conv") != _NONE, F.col("conv")).alias("conv_id"), "window", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.size(F.filter("p", lambda x: ~x["new"])).alias("n_repeated"), loss.alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (new ones: array of struct<role, text>), targets (array of text) from the output alone."""
    parts = F.split("formatted", r"<\|end\|>\n")
    new = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    head = lambda p: F.substring_index(p, "|>\n", 1)
    turn = lambda p: F.struct(unescape(F.substr(head(p), F.lit(3))).alias("role"), unescape(F.substr(p, F.char_length(head(p)) + 4)).alias("text"))
    target = lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))
    return windows.select("conv_id", "window", "formatted", F.transform(new, turn).alias("turns"), F.transform("loss", target).alias("targets"))


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows."""
    read = read_windows(windows)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.groupBy("conv_id").agg(
        F.sum(F.size("turns")).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", joined.alias("turns"), F.array_join("targets", "").alias("targets")))).alias("w"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    turns, targets = (F.array_join(F.col("w")[c], "") for c in ("turns", "targets"))
    return rows.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(targets).cast("long").alias("loss_chars"), F.sha2(targets.cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return digests(format_windows(every))


_ESCAPED = lambda c: "".join(["replace("] * len(ESCAPES)) + c + "".join(f", '{a}', '{b}')" for a, b in ESCAPES)
ORACLE_SQL = rf"""
WITH every AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
    SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {OVERHEAD} AS tokens,
        row_number() OVER o - 1 AS i FROM every WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)
), summed AS (
    SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) - tokens AS before FROM turns
), keyed AS (
    SELECT *, floor(before / {SPAN}) AS k,
        min(CASE WHEN role = 'system' THEN i END) OVER (PARTITION BY conv_id) AS system FROM summed
), windowed AS (
    SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS w,
        max(before + tokens) OVER (PARTITION BY conv_id, k) AS upto,
        length('<|' || {_ESCAPED('role')} || '|>' || chr(10) || {_ESCAPED('text')} || '<|end|>' || chr(10)) AS piece FROM keyed
), counted AS (
    SELECT *, max(w) OVER (PARTITION BY conv_id) + 1 AS n_windows FROM windowed
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(piece * CASE WHEN i = system THEN n_windows
        WHEN w + 1 < n_windows AND upto - before <= {HISTORY} THEN 2 ELSE 1 END) AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id
"""

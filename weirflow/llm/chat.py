r"""Chat formatting into budgeted windows of whole turns.

Prefix sums of turn tokens choose the windows: a conversation's token line is cut
into strides, a turn belongs to the stride in which it starts, and the turn that
runs over the end of its stride has a window of its own. So a window's new turns
fit the stride, unless one turn alone is longer. Every later window repeats the
system turn and up to ``HISTORY_TURNS`` turns within ``HISTORY_TOKENS`` before it,
as context; the loss mask covers the texts of new assistant turns only, so a target
is learned once. Prefix sums are taken in blocks of ``BLOCK`` turn numbers, whose
sums are then added up, so one long conversation is spread over many tasks.

A formatted turn is ``<|turn|>role\ntext<|end|>\n``. Control strings inside texts
are broken by a backslash after their first character (one more if some follow it
already), which ``unescape`` takes away again.

Only DataFrame functions run here. Edge cases: null texts and roles count as empty;
turns that share a number go by role, then text; a null turn number comes last;
null conversation ids form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm.storage import written

BUDGET, HISTORY_TURNS, HISTORY_TOKENS, LEAST_STRIDE, BLOCK = 512, 2, 128, 64, 512
TURN, END = "<|turn|>", "<|end|>\n"
#: Tokens that the marks of a turn take.
MARKS = 4
#: What follows ``<`` or ``[`` in a control string.
CONTROL = r"(?=\||/?s>|/?INST\])"
KEY = ["ck", "cn"]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def numbered(turns: DataFrame, budget: int, history_tokens: int) -> DataFrame:
    """Turns with ``pos`` in their conversation, ``before`` (tokens ahead of them) and ``window``."""
    text = F.coalesce("text", F.lit(""))
    turns = turns.select(
        F.coalesce("conv_id", F.lit(0)).alias("ck"),
        F.col("conv_id").isNull().alias("cn"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        text.alias("text"),
        (F.regexp_count(text, F.lit(r"\S+")) + MARKS).cast("long").alias("tokens"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit((1 << 63) - 1)).alias("block"),
    )
    first = F.min(F.when(F.col("role") == "system", F.struct(F.col("turn").isNull(), "turn", "text", "tokens")))
    system = turns.groupBy(*KEY).agg(first.alias("s")).select(*KEY, F.coalesce("s.tokens", F.lit(0)).alias("system"))
    ahead = Window.partitionBy(*KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy(*KEY, "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    blocks = blocks.select(*KEY, "block", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    blocks = blocks.join(system, KEY)
    order = Window.partitionBy(*KEY, "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.join(blocks, [*KEY, "block"])
    rows = rows.withColumn("pos", F.col("n0") + F.count("*").over(order) - 1).withColumn("before", F.col("t0") + F.sum("tokens").over(order) - F.col("tokens"))
    stride = F.greatest(F.lit(budget - history_tokens) - F.col("system"), F.lit(LEAST_STRIDE))
    at = F.floor(F.col("before") / stride)
    over = (F.col("before") + F.col("tokens") > (at + 1) * stride).cast("long")
    return rows.select(*KEY, (2 * at + over).alias("window"), "pos", "before", "tokens", "role", "text")


def windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row for each window: conv_id, window, n_context, n_turns, tokens, formatted, loss (spans of code points)."""
    rows = written(numbered(turns, budget, history_tokens), "chat-turns")
    starts = rows.groupBy(*KEY, "window").agg(F.min("pos").alias("q"), F.min("before").alias("q_before"))
    wanted = starts.select(*KEY, F.col("window").alias("into"), "q_before", F.explode(F.sequence(F.col("q") - history_turns, F.col("q") - 1)).alias("pos"))
    history = rows.join(wanted.where("pos >= 0"), [*KEY, "pos"]).where(F.col("q_before") - F.col("before") <= history_tokens)
    system = rows.where("role = 'system'").groupBy(*KEY).agg(F.min(F.struct("pos", "text", "tokens")).alias("s"))
    system = system.select(*KEY, F.col("s.pos").alias("pos"), F.col("s.text").alias("text"), F.col("s.tokens").alias("tokens"))
    retained = starts.join(system, KEY).where("q > pos").select(*KEY, "window", "pos", F.lit("system").alias("role"), "text", "tokens")
    columns = [*KEY, "window", "pos", "role", "text", "tokens"]
    history = history.drop("window").withColumnRenamed("into", "window").select(*columns)
    history = history.join(system.select(*KEY, F.col("pos").alias("s_pos")), KEY, "left").where("s_pos is null or s_pos <> pos").select(*columns)
    context = history.unionByName(retained).withColumn("context", F.lit(True))
    parts = rows.select(*columns).withColumn("context", F.lit(False)).unionByName(context)
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    part = F.struct(
        "pos",
        "context",
        "tokens",
        (~F.col("context") & (F.col("role") == "assistant")).alias("target"),
        head.alias("head"),
        escape(F.col("text")).alias("body"),
    )
    held = parts.groupBy(*KEY, "window").agg(F.array_sort(F.collect_list(part)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x.head, x.body, F.lit(END))), "")
    span = "array<struct<start:bigint,end:bigint>>"

    def add(acc: Column, x: Column) -> Column:
        start = acc.at + F.length(x.head)
        stop = start + F.length(x.body)
        grown = F.when(x.target, F.array_append(acc.spans, F.struct(start.alias("start"), stop.alias("end")))).otherwise(acc.spans)
        return F.struct((stop + len(END)).alias("at"), grown.alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans"))
    return held.select(
        F.when(~F.col("cn"), F.col("ck")).alias("conv_id"),
        "window",
        F.size(F.filter("p", lambda x: x.context)).alias("n_context"),
        F.size(F.filter("p", lambda x: ~x.context)).alias("n_turns"),
        F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x.tokens).alias("tokens"),
        text.alias("formatted"),
        F.aggregate("p", zero, add, lambda acc: acc.spans).alias("loss"),
    )


def read_back(found: DataFrame) -> DataFrame:
    """From formatted windows: conv_id, window, turns (new ones, as role and text), loss_text."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x, i: i > F.col("n_context"))  # the first is what stands before a mark
    role = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.substring(x, F.length(role(x)) + 2, F.length(x) - F.length(role(x)) - 1 - len(END))
    turns = F.transform(pieces, lambda x: F.struct(unescape_role(role(x)).alias("role"), unescape(body(x)).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substring("formatted", (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
    return found.select("conv_id", "window", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").alias("chars"))


def digests(found: DataFrame) -> DataFrame:
    """One row for each conversation, of what its windows hold when read back.

    The digest of a conversation is over its whole text, so that text meets in one row here.
    """
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    read = read_back(found).select("conv_id", F.size("turns").alias("n"), F.struct("window", turns.alias("turns"), "loss_text").alias("w"), "chars")
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    loss = F.array_join("w.loss_text", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )

"""Chat formatting by prefix-target expansion. DataFrame functions only.

A turn is written ``<|role|>\\n``, the escaped text, ``<|end|>\\n``. Inside texts and roles, backslashes are doubled and a
backslash is put behind the first character of every control string (of this and other common templates), so that no
control string is left and dropping the escapes restores the text.

Every assistant turn is an example: its text is the conversation up to and including that turn, and only its reply is
under the loss mask. All examples of a conversation are prefixes of its rendered text, so ``render`` keeps the text once
with the spans of the examples (size in proportion to the conversation) and ``examples`` gives each its own row. Turns
after the last reply are kept as a last prefix without a target.

A conversation is one training text, so its rows come together in one row of output, as the digests over whole
conversations ask for; nothing else is gathered, and a first turn or a text that many conversations share moves no row.

Cases: a null text or role is empty; turns are ordered by turn (nulls first), ties by role and text; repeated rows are
turns of their own; a null conv_id is a conversation of its own; a conversation without assistant has one prefix and no
loss; other columns are ignored; an empty table has no conversations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Control strings that texts must not hold.
CONTROL_STRINGS = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
END = "<|end|>\n"
_CONTROL = r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\|(?=>)|\[(?=INST\]|/INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, F.lit(_CONTROL), F.lit("$0\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, prefixes: array of (chars, loss_start, loss_end), in order.

    Prefix p of a conversation is the first ``chars`` code points of ``formatted``; its loss mask is [loss_start, loss_end) (null for the
    turns behind the last reply)."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    c = c.withColumn("n", F.row_number().over(order)).withColumn("body", escape(F.col("text")))
    c = c.withColumn("piece", F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"), F.col("body"), F.lit(END)))
    c = c.withColumn("chars", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.col("chars") - len(END)
    c = c.withColumn("loss_end", F.when(F.col("role") == "assistant", stop)) \
        .withColumn("loss_start", F.when(F.col("role") == "assistant", stop - F.length("body")))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "chars", "loss_start", "loss_end"))).alias("t"))
    prefix = "transform(filter(t, (x, i) -> x.loss_end is not null or i = size(t) - 1), x -> struct(x.chars, x.loss_start, x.loss_end))"
    return g.select("conv_id", F.concat_ws("", F.transform("t", lambda x: x["piece"])).alias("formatted"), F.expr(prefix).alias("prefixes"))


def examples(rendered: DataFrame) -> DataFrame:
    """One row a prefix: conv_id, example, text, loss_start, loss_end."""
    e = rendered.select("conv_id", "formatted", F.posexplode("prefixes").alias("example", "p"))
    return e.select("conv_id", "example", F.expr("substring(formatted, 1, int(p.chars))").alias("text"), "p.loss_start", "p.loss_end")


def turns(text: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    parts = F.filter(F.split(text, F.lit(r"<\|end\|>\n")), lambda x: x != "")
    def one(x):
        head = F.substring_index(x, "|>\n", 1)
        return F.struct(unescape(F.substr(head, F.lit(3))).alias("role"), unescape(F.substr(x, F.length(head) + 4)).alias("text"))
    return F.transform(parts, one)


def digests(rendered: DataFrame) -> DataFrame:
    """Read back from the examples: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The turns come from the longest example, the loss text from the mask of each example's own text; formatted_chars counts the
    code points of all examples. The examples of a conversation stand in the partition of its render, so nothing is shuffled again."""
    e = examples(rendered)
    reply = F.when(F.col("loss_end").isNotNull(), unescape(F.expr("substring(text, int(loss_start) + 1, int(loss_end - loss_start))")))
    e = e.select("conv_id", "text", F.length("text").alias("chars"), "example", reply.alias("reply"))
    g = e.groupBy("conv_id").agg(F.max_by("text", "example").alias("longest"), F.sum("chars").cast("long").alias("formatted_chars"),
                                 F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"))
    r = g.select("conv_id", turns(F.col("longest")).alias("turns"), F.concat_ws("", F.transform("replies", lambda x: x["reply"])).alias("loss"), "formatted_chars")
    lines = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return r.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")
